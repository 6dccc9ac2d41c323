"""Exact duplicates, with frequent texts taken out before the shuffle.

Texts are compared by SHA-256 after lower-casing A-Z. Misra-Gries summaries of
every partition find the few digests that can be frequent; an exact count of just
those, added up inside the tasks, verifies them. Their winners (at most `counters`
rows) are broadcast and applied where the rows are, so no copy of a frequent text is
shuffled. All other digests occur at most once in `counters` rows and are grouped and
joined by an ordinary shuffle of (digest, doc_id).

Null texts count as empty texts and are copies of each other. Rows that repeat both
doc_id and text are one document: all of them are marked alike. A null doc_id never
wins against another id; of texts that differ in A-Z under one id, the largest mark wins. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import id_and_text, keep_marked, raw, text_mark
from floodlens.session import materialize

# Counters of a Misra-Gries summary: the bound of the broadcast, and one over the
# share of all rows beyond which a digest counts as frequent.
COUNTERS = 256


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, digest): SHA-256 of the text with A-Z in lower case; mark is a hash of the text as it is."""
    plain = id_and_text(docs, text_mark(docs[text_col]).alias("mark"), id_col=id_col, text_col=text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            ends = zip(at[:-1].tolist(), at[1:].tolist())
            found = [hashlib.sha256(data[a:b].tobytes().lower()).digest() for a, b in ends]
            columns = [batch.column(0), batch.column(2), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "digest"])

    return plain.mapInArrow(digest, f"doc_id {kind}, mark long, digest binary")


def shrink(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Keep at most `counters` entries, less the count of the largest one that goes."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: n - cut for k, n in counts.items() if n > cut}


def summaries(digest: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Misra-Gries over all rows: at most `counters` digests, with every one that has more
    than rows / counters rows among them. Summaries merge in two rounds, so that no task
    gets more than about the root of the number of partitions times `counters` rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[key] = counts.get(key, 0) + n
            counts = shrink(counts, 8 * counters)
        counts = shrink(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["digest", "n"]
        )

    schema = "digest binary, n long"
    first = digest.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(summarise, schema)
    middle = max(1, round(digest.rdd.getNumPartitions() ** 0.5))
    return first.repartition(middle).mapInArrow(summarise, schema).repartition(1).mapInArrow(summarise, schema)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per document: doc_id, keep_id (largest id of the equal texts), group_size, digest, kept, mark (hash of the text)."""
    digest = materialize(digests(docs, id_col, text_col), "digests")
    rows = digest.count()
    summary = [(x[0],) for x in summaries(digest, counters).select("digest").collect()]  # at most `counters`
    spark = docs.sparkSession
    # Nulls are the least ids.
    best = F.max(F.struct("doc_id", "mark"))
    tally = (
        best["doc_id"].alias("keep_id"),
        best["mark"].alias("keep_mark"),
        F.count(F.lit(1)).alias("group_size"),
    )
    suspects = spark.createDataFrame(summary, "digest binary")
    verified = digest.join(F.broadcast(suspects), "digest").groupBy("digest").agg(*tally)
    verified = verified.where(F.col("group_size") * counters > rows).collect()  # at most `counters`
    kind = digest.schema["doc_id"].dataType.simpleString()
    winners = spark.createDataFrame(verified, f"digest binary, keep_id {kind}, keep_mark long, group_size long")
    marked = digest.join(F.broadcast(winners), "digest", "left")
    rare = marked.where("group_size IS NULL").select("doc_id", "mark", "digest")
    shuffled = rare.join(rare.groupBy("digest").agg(*tally), "digest")
    columns = ["doc_id", "mark", "keep_id", "keep_mark", "group_size", "digest"]
    both = marked.where("group_size IS NOT NULL").select(columns).unionByName(shuffled.select(columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    return both.select("doc_id", "keep_id", "group_size", "digest", kept.alias("kept"), "mark")


def drop_exact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """The rows that stay, with their own columns; repeated rows once. Different texts under one id
    are judged apart. Of equal texts without any id, one stays."""
    kept = exact_groups(docs, id_col, text_col, counters).where("kept")
    return keep_marked(docs, kept.selectExpr("doc_id AS kept_id", "mark AS kept_mark"), id_col, text_col)
