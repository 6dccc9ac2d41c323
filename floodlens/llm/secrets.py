"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Three patterns give the base spans. Positions come from the pieces between the matches:
split() and regexp_extract_all() walk the text alike, so the lengths of pieces and
matches, added up, are the places of all matches in code points.

Ownership: the digest of each found value is counted over distinct repositories and
distinct owners of the whole corpus. A value that several owners have is a widely copied
example. One that a single owner has, in however many repositories, with enough different
characters, looks live, and gives a further span of kind `live` over the value itself;
the number of repositories that hold it tells how far its owner has spread it. Counts go
(digest, owner, repository), then (digest, owner), then digest, each pre-aggregated in
the tasks, so a value in a third of all rows is a few rows for each task.

Only digests of values leave the scan. Null texts have no spans. A null owner counts as
one unknown owner, a null id as one repository; repeated rows count once. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import id_and_text, text_mark
from floodlens.session import materialize

# Kinds in their order, patterns, the group that is the value, its least length.
KINDS = [
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that have 16 or more characters
]

# A value looks live if at most so many owners have it, and it has at least so many different
# characters.
MAX_OWNERS = 1
MIN_DISTINCT = 6

SPAN = "struct<start:int,rank:int,kind:string,end:int,value_start:int,digest:string>"


def base_spans(text: Column, rank: int) -> Column:
    """Array of spans of one kind, ascending; leftmost matches that do not overlap, the
    failing ones dropped afterwards."""
    kind, pattern, group, least = KINDS[rank]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), whole.alias("whole"), value.alias("value")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def walk(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["piece"])
        end = begin + F.char_length(x["whole"])
        span = F.struct(
            begin.alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            (end - F.char_length(x["value"])).alias("value_start"),
            F.when(
                F.size(F.array_distinct(F.split(x["value"], ""))) >= MIN_DISTINCT, F.sha2(x["value"], 256)
            ).alias("digest"),
        )
        kept = F.when(F.char_length(x["value"]) >= least, F.array_append(state["spans"], span)).otherwise(
            state["spans"]
        )
        # The piece after the last match has no match of its own.
        return F.when(x["whole"].isNull(), state).otherwise(
            F.struct(end.alias("at"), kept.cast(f"array<{SPAN}>").alias("spans"))
        )

    found = F.aggregate(zipped, start, walk, lambda state: state["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source"
) -> DataFrame:
    """doc_id, mark (hash of the text), owner, base: spans of all kinds by start, then kind."""
    more = (docs[owner_col].alias("owner"), text_mark(docs[text_col]).alias("mark"))
    plain = id_and_text(docs, *more, id_col=id_col, text_col=text_col)
    each = [base_spans(F.col("text"), rank).alias(KINDS[rank][0]) for rank in range(len(KINDS))]
    found = plain.select("doc_id", "mark", "owner", *each)
    base = F.array_sort(F.concat(*(F.col(kind) for kind, *_ in KINDS)))
    return found.select("doc_id", "mark", "owner", base.alias("base"))


def ownership(found: DataFrame) -> DataFrame:
    """(digest, repositories, owners) of every candidate value in the corpus."""
    seen = found.select("doc_id", "owner", F.explode("base.digest").alias("digest")).where("digest IS NOT NULL")
    # Nulls would drop out of counts: an unknown owner is one owner.
    seen = seen.select("digest", F.struct("owner").alias("owner"), F.struct("doc_id").alias("repository"))
    per_owner = seen.distinct().groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("pairs"))
    owners = per_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"))
    repositories = (
        seen.select("digest", "repository").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("repositories"))
    )
    return owners.join(repositories, "digest")


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per row of docs: doc_id, mark, base (spans), live (array of value spans by start, each with
    the number of repositories that hold its value), copied (number of base spans whose value is a
    widely copied example)."""
    found = materialize(scan(docs, id_col, text_col, owner_col), "secret-spans")
    live_look = (F.col("owners") <= max_owners).alias("looks_live")
    # Written, so that the join below shuffles both sides for itself and a value in a third of all
    # documents can be split.
    judged = materialize(ownership(found).select("digest", "repositories", live_look), "owned-values")
    each = found.select("doc_id", "mark", F.explode("base").alias("span"))
    each = each.select("doc_id", "mark", "span", "span.digest")
    each = each.where("digest IS NOT NULL").join(judged, "digest")
    place = F.struct(F.col("span.value_start").alias("start"), F.col("span.end").alias("end"), "repositories")
    marks = each.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.when(F.col("looks_live"), place))).alias("live"),
        F.collect_set(F.when(~F.col("looks_live"), F.col("digest"))).alias("examples"),
    )
    none = F.array().cast("array<struct<start:int,end:int,repositories:bigint>>")
    copied = F.size(F.filter("base", lambda x: F.array_contains(F.col("examples"), x["digest"])))
    marks = marks.withColumnsRenamed({"doc_id": "of_doc", "mark": "of_mark"})
    return found.join(marks, F.expr("doc_id <=> of_doc AND mark = of_mark"), "left").select(
        "doc_id",
        "mark",
        "base",
        F.coalesce("live", none).alias("live"),
        F.when(F.col("examples").isNull(), 0).otherwise(copied).alias("copied"),
    )


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, all spans as text, and the widest spread
    of a live value (n_repositories, 0 without one)."""
    written = F.transform(
        "base", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    )
    live = F.transform(
        "live",
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(len(KINDS)).alias("rank"),
            F.concat_ws(":", F.lit("live"), x["start"].cast("string"), x["end"].cast("string")).alias("said"),
        ),
    )
    based = F.transform(
        F.arrays_zip(F.col("base"), written.alias("said")),
        lambda x: F.struct(x["base"]["start"].alias("start"), x["base"]["rank"].alias("rank"), x["said"].alias("said")),
    )
    every = F.transform(F.array_sort(F.concat(based, live)), lambda x: x["said"])
    count = [
        F.size(F.filter("base", lambda x: x["rank"] == F.lit(rank))).cast("long").alias(f"n_{KINDS[rank][0]}")
        for rank in range(len(KINDS))
    ]
    return found.select(
        "doc_id",
        *count,
        F.sha2(F.array_join(written, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.col("copied").cast("long").alias("n_copied"),
        F.coalesce(F.array_max(F.col("live.repositories")), F.lit(0)).cast("long").alias("n_repositories"),
    )


def mask(docs: DataFrame, owner_col: str = "source", put: str = "[secret]") -> DataFrame:
    """docs with every live-looking value replaced in its text, and n_chars to match where the
    column exists. Values of several owners stay as they are, and so do all documents."""
    found = secrets(docs, owner_col=owner_col).where(F.size("live") > 0)
    # Repeated rows may differ in owner: what is live for one of them is masked in all.
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("live"))))
    found = found.groupBy("doc_id", "mark").agg(every.alias("live"))
    doc = F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc")
    whole = docs.select(doc, text_mark(docs["text"]).alias("own_mark"))
    joined = whole.join(found, F.expr("doc.doc_id <=> doc_id AND own_mark = mark"), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def walk(state: Column, x: Column) -> Column:
        # Spans are ascending; one that begins inside the last is covered as far as that goes.
        begin = F.greatest(state["at"], x["start"])
        gap = F.substring(F.col("doc.text"), state["at"] + 1, begin - state["at"])
        return F.when(x["end"] <= state["at"], state).otherwise(
            F.struct(x["end"].alias("at"), F.concat(state["out"], gap, F.lit(put)).alias("out"))
        )

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(F.col("doc.text"), state["at"] + 1, F.lit(2**31 - 1)))

    masked = F.when(F.col("live").isNull(), F.col("doc.text")).otherwise(F.aggregate("live", start, walk, finish))
    made = joined.select("doc", F.col("live").isNotNull().alias("changed"), masked.alias("masked"))
    columns = []
    for field in docs.schema.fields:
        own = F.col("doc").getField(field.name)
        if field.name == "text":
            own = F.col("masked")
        elif field.name == "n_chars":
            own = F.when(F.col("changed"), F.char_length("masked").cast(field.dataType)).otherwise(own)
        columns.append(own.alias(field.name))
    return made.select(*columns)
