"""Groups of spelling variants, by pairs of trie nodes.

All words stand in a trie, and reversed in a second one. A node is an integer: words are
sorted by ranges, a word adds nodes after the part it shares with the word before it,
and one summary row per range carries the path over each border. A word and a position
give a pair (prefix node, suffix node): around the position, with its letter skipped, and
at the gap, with nothing skipped. Two words that share a skipped pair differ in that one
letter. A skipped pair of one word that is a gap pair of another is that word without the
letter; of a run of equal letters only the first is skipped, so that each neighbour is
found once. A pair of nodes says all other letters, so no more words share it than
letters can stand in one place, and every near word is found, with no check afterwards.

A word's form is the near word of most occurrences, if it has at least `ratio` times as
many; roots follow forms to the last by doubling.

Null texts have no words, a null id reads as empty in hashes, repeated rows count each.
Words may be of any length: their paths are arrays, never lists of prefixes. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import STEP_BYTES, id_and_text, raw, steps
from floodlens.session import materialize

# Letters as UTF-8 after lower-casing A-Z, and where a letter goes.
LETTERS = rb"(?:[a-z]|\xc3[\x80-\xbf])+"
SPOIL = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
# Words in one sorted range, and different words that a task counts before it sends them on.
RANGE = 1 << 17
COUNTED = 1 << 18

RUNS = re.compile(LETTERS)
BREAK = re.compile(rb"[\x00-\x60\x7b-\x7f]")


def runs(text: bytes) -> Iterator[list[bytes]]:
    """Lists of the runs of a lower-cased text, cut at ASCII characters that are no letters."""
    at = 0
    while at < len(text):
        after = BREAK.search(text, at + STEP_BYTES)
        end = after.start() if after else len(text)
        yield RUNS.findall(text[at:end])
        at = end


def spoilt(word: bytes, start: int) -> bytes:
    """The word, or the word less one letter where its hash says so; start: the hash of what stands before it."""
    h = zlib.crc32(word, start)
    if h % SPOIL:
        return word
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS
) -> DataFrame:
    """(word, n): words of so many letters or more, counted in the tasks first."""
    plain = id_and_text(docs, id_col=id_col, text_col=text_col)
    plain = plain.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def batch_of(counts: Counter) -> pa.RecordBatch:
        long = ((w.decode(), n) for w, n in counts.items() if len(w) >= least_letters)
        kept = [(w, n) for w, n in long if len(w) >= least_letters]
        columns = [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in steps(batches):
            data, at = raw(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                start = zlib.crc32(f"{name}:".encode())
                for some in runs(data[at[i] : at[i + 1]].tobytes().lower()):
                    for word, n in Counter(some).items():
                        counts[spoilt(word, start)] += n
                if len(counts) > COUNTED:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return plain.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def numbered(keys: DataFrame, key: str, ranges: int) -> DataFrame:
    """keys with `path`: the trie nodes of the key's prefixes, from the empty one to the whole key. Keys
    are different; nodes ascend in the order of keys. One row per range passes the driver: its first
    and last key, its number of nodes, and the path of the last key."""
    ordered = keys.repartitionByRange(ranges, key).sortWithinPartitions(key)
    ordered = materialize(ordered.select(F.spark_partition_id().alias("range"), *keys.columns), "trie-keys")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields)

    def walk(table: pa.Table, path: list[int], before: str, number: int) -> Iterator[list[int]]:
        for word in table.column(key).to_pylist():
            same = shared(before, word)
            new = len(word) - same
            path = path[: same + 1] + list(range(number, number + new))
            number, before = number + new, word
            yield path

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        first, last = table.column(key)[0].as_py(), table.column(key)[-1].as_py()
        # Nodes that only this range knows, in its own numbers; -1: a node that the first key may share.
        path, number, before = [-1] * (len(first) + 1), 0, first
        for path in walk(table, path, first, 0):
            pass
        number = 0
        for word in table.column(key).to_pylist():
            number += len(word) - shared(before, word)
            before = word
        return pa.table(
            {
                "range": table.column("range").slice(0, 1),
                "first": pa.array([first]),
                "last": pa.array([last]),
                "nodes": pa.array([number], pa.int64()),
                "path": pa.array([path], pa.list_(pa.int64())),
            }
        )

    found = ordered.groupBy("range").applyInArrow(
        summary, "range int, first string, last string, nodes long, path array<bigint>"
    )
    starts: dict[int, tuple[int, str, list[int]]] = {}
    number, before, path = 1, "", [0]
    for row in sorted(found.collect(), key=lambda r: r["range"]):  # one row per range of RANGE words
        starts[row["range"]] = (number, before, path)
        same = shared(before, row["first"])
        entry = path[: same + 1] + list(range(number, number + len(row["first"]) - same))
        number += len(row["first"]) - same
        path = [entry[i] if x < 0 else number + x for i, x in enumerate(row["path"])]
        number, before = number + row["nodes"], row["last"]

    def give(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        first, before, entry = starts[table.column("range")[0].as_py()]
        paths = pa.array(list(walk(table, entry, before, first)), pa.list_(pa.int64()))
        return table.drop_columns("range").append_column("path", paths)

    return ordered.groupBy("range").applyInArrow(give, f"{schema}, path array<bigint>")


def node_pairs(vocabulary: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(prefix, suffix, gap, first, n, id): a row for each word and position, with its letter skipped or
    at the gap before it. id is the node of the whole word; first: no equal letter stands before. Also
    the dictionary (id, word, n)."""
    forward = numbered(vocabulary.select("word", "n"), "word", ranges)
    backward = numbered(vocabulary.select(F.reverse("word").alias("reversed")), "reversed", ranges)
    backward = backward.select(F.reverse("reversed").alias("word"), F.col("path").alias("back"))
    both = forward.join(backward, "word").withColumn("letters", F.split("word", ""))
    both = materialize(
        both.selectExpr(
            "word",
            "n",
            "path",
            "reverse(back) AS back",
            "transform(letters, (x, i) -> i = 0 OR x <> letters[i - 1]) AS first",
            "element_at(path, -1) AS id",
        ),
        "word-paths",
    )
    # The suffix after letter i starts one place later than the one at the gap before it.
    skipped = both.selectExpr(
        "n", "id", "slice(path, 1, size(path) - 1) AS p", "slice(back, 2, size(back) - 1) AS s", "first AS f"
    ).selectExpr("n", "id", "inline(arrays_zip(p, s, f))")
    around = skipped.selectExpr("p AS prefix", "s AS suffix", "false AS gap", "f AS first", "n", "id")
    gaps = both.selectExpr("n", "id", "inline(arrays_zip(path, back))")
    between = gaps.selectExpr("path AS prefix", "back AS suffix", "true AS gap", "false AS first", "n", "id")
    return around.unionByName(between), both.select("id", "word", "n")


# Of two members of a pair: both skip a letter, or one has a letter that the other goes without.
NEAR = """(NOT x.gap AND NOT y.gap AND x.id <> y.id) OR (x.gap AND NOT y.gap AND y.first)
    OR (NOT x.gap AND x.first AND y.gap)"""


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): for words with near words, how many, and the best as (n, -id)."""
    member = F.struct("gap", "first", "n", "id")
    met = pairs.groupBy("prefix", "suffix").agg(F.collect_list(member).alias("members")).where("size(members) > 1")
    each = met.selectExpr(f"inline(transform(members, x -> named_struct('id', x.id, 'near', filter(members, y -> {NEAR}))))")
    each = each.where("size(near) > 0").selectExpr(
        "id", "size(near) AS here", "array_max(transform(near, y -> named_struct('n', y.n, 'least', -y.id))) AS best"
    )
    return each.groupBy("id").agg(F.sum("here").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) for forms (id, up): the last form. Counts at least double along forms, so the paths are short."""
    up = materialize(forms, "forms")
    while True:
        further = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
        longer = materialize(up.join(further, "up", "left"), "forms")
        if longer.where("next IS NOT NULL").limit(1).count() == 0:
            return up.select("id", F.col("up").alias("root"))
        up = longer.select("id", F.coalesce("next", "up").alias("up"))


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    found = words(docs, id_col, text_col, least_letters).where(F.col("n") >= least_count)
    vocabulary = materialize(found, "words")
    pairs, named = node_pairs(vocabulary, max(1, -(-vocabulary.count() // RANGE)))
    near = named.join(near_words(pairs), "id", "left")
    form = F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.least"))
    near = near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form_id"))
    near = materialize(near, "near-words")
    root = roots(near.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("up")))
    forms = named.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = root.join(named.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    joined = near.join(forms, "form_id", "left").join(root.select("id", "root_word"), "id", "left")
    return joined.select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))
