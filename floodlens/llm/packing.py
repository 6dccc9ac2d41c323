"""Packing token sequences into windows by length combinations.

Full windows are cut off every document first. What is left of each has a length below
the window. These lengths, in classes of a few tokens, make a histogram of fixed size.
All shallow combinations (up to three classes that fill the window) are enumerated, and
non-negative least squares finds how often to repeat each so that the histogram is used
up; the solution is rounded down, and a greedy pass repeats combinations on what that
leaves. The remaining pieces form one stream that is cut at every window.

Nothing of this needs all pieces in one place. A piece's rank in its class is its place
in its partition plus a count for each earlier partition; a table of combinations turns
the rank into a window and a slot. The stream's positions are running sums in a partition
plus a sum for each earlier partition. So a length that a third of all documents have is
no hot key. Tokens are encoded once and written, with checksums, before they are placed.

Null and empty texts have the end id alone. Repeated rows are packed as often as they
occur. An empty table gives an empty result. All sequences but those of the stream's end
and the classes' rounding are full.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodlens.llm.common import id_and_text, per_worker, steps
from floodlens.llm.segments import Encoder, byte_encoder, vocabulary
from floodlens.session import materialize

WINDOW = 1024
# Tokens in a class of lengths; a piece wastes less than this.
CLASS = 8
# Pieces in a combination.
DEPTH = 3


def combinations(classes: int, depth: int = DEPTH) -> np.ndarray:
    """One row for each multiset of up to `depth` classes 1..classes whose sum is `classes`: how often
    it has each class."""
    found: list[list[int]] = []

    def extend(chosen: list[int], least: int, left: int) -> None:
        if left >= least and len(chosen) < depth:
            found.append([*chosen, left])
            for part in range(least, left // 2 + 1):
                extend([*chosen, part], part, left - part)

    extend([], 1, classes)
    table = np.zeros((len(found), classes + 1))
    for row, chosen in zip(table, found):
        np.add.at(row, chosen, 1)
    return table


def nnls(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |matrix x - target|: active sets, one column let in at a time."""
    columns = matrix.shape[1]
    x, free = np.zeros(columns), np.zeros(columns, bool)
    tolerance = 1e-9 * max(1.0, np.abs(target).max(initial=0.0))
    for _ in range(3 * columns):
        slope = matrix.T @ (target - matrix @ x)
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            index = np.flatnonzero(free)
            trial = np.linalg.lstsq(matrix[:, index], target, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[index] = trial
                break
            low = trial <= 0
            step = np.min(x[index][low] / np.maximum(x[index][low] - trial[low], 1e-300))
            x[index] += step * (trial - x[index])
            free[index[(x[index] <= 1e-12) & low]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Combinations to use (rows as above) and their repeat counts; histogram[c] pieces have class c."""
    table = combinations(len(histogram) - 1, depth)
    solved = np.floor(nnls(table.T, histogram.astype(float)) + 1e-6)
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(table), np.int64)
    parts = table.astype(np.int64)
    for wanted in (solved, np.full(len(table), np.inf)):  # rounded counts, then greedily what they leave
        for i in np.lexsort((parts.sum(axis=1), -wanted)):
            own = parts[i] > 0
            n = int(min(wanted[i], (left[own] // parts[i][own]).min()))
            counts[i] += n
            left -= n * parts[i]
    used = counts > 0
    return parts[used], counts[used]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(
    docs: DataFrame,
    build: Callable[[], Encoder],
    key: str,
    end_id: int,
    window: int = WINDOW,
    width: int = CLASS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: place (part, row), tokens, checksums of its full windows, what is left
    (ids, checksum, class) and its rank among the partition's pieces of that class."""
    plain = id_and_text(docs, id_col=id_col, text_col=text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, part int, row long, tokens long, full array<long>, full_before long, "
        "rest_crc long, class int, class_rank long, rest binary"
    )

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(key, build)
        part, row, full_before = TaskContext.get().partitionId(), 0, 0
        ranks = np.zeros(window // width + 2, np.int64)
        for batch in steps(batches):
            found, at = encode(batch.column(1))
            out: list[list] = [[] for _ in range(8)]
            for i in range(len(batch)):
                ids = np.append(found[at[i] : at[i + 1]], np.uint32(end_id))
                whole = len(ids) // window
                rest = ids[whole * window :]
                group = -(-len(rest) // width)
                values = (
                    row,
                    len(ids),
                    [crc(ids[k * window : (k + 1) * window]) for k in range(whole)],
                    full_before,
                    crc(rest),
                    group,
                    int(ranks[group]),
                    rest.astype("<u4").tobytes(),
                )
                for column, value in zip(out, values):
                    column.append(value)
                ranks[group] += 1
                row += 1
                full_before += whole
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(batch), pa.int32()), *columns],
                ["doc_id", "part", "row", "tokens", "full", "full_before", "rest_crc", "class", "class_rank", "rest"],
            )

    return plain.mapInArrow(encode_all, schema)


def offsets(counts: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Sum of value over the earlier partitions; counts has one row for each partition and `by`."""
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0))).drop(value)


def pack(tokens: DataFrame, window: int = WINDOW, width: int = CLASS, depth: int = DEPTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    counts = tokens.where("class > 0").groupBy("class").count().collect()  # at most window / width rows
    histogram = np.zeros(window // width + 1, np.int64)
    for group, n in counts:
        histogram[group] = n
    parts, repeats = plan(histogram, depth)
    first = np.concatenate([[0], np.cumsum(repeats)])
    # For each class: the combinations that use it, and the ranks up to which each does.
    users = {g: np.flatnonzero(parts[:, g]) for g in range(1, len(histogram))}
    bounds = {g: np.cumsum(parts[c, g] * repeats[c]) for g, c in users.items()}

    keys = tokens.select("part", "row", "doc_id", "tokens", "class", "class_rank", "rest_crc").where("class > 0")
    per_part = tokens.where("class > 0").groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    ranked = keys.join(offsets(per_part, ["class"], "n", "earlier"), ["class", "part"])
    ranked = ranked.select(
        *keys.columns, (F.col("earlier") + F.col("class_rank")).alias("rank"), (F.col("tokens") % window).alias("length")
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("class").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, slot = np.full(len(group), -1, np.int64), np.zeros(len(group), np.int64)
            for g in np.unique(group).tolist():
                own = np.flatnonzero((group == g) & (rank < (bounds[g][-1] if len(bounds[g]) else 0)))
                which = np.searchsorted(bounds[g], rank[own], side="right")
                use = users[g][which] if len(own) else np.zeros(0, int)
                inside = rank[own] - np.concatenate([[0], bounds[g]])[which]
                sequence[own] = first[use] + inside // parts[use, g]
                slot[own] = g * (depth + 1) + inside % parts[use, g]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence), pa.array(slot)], [*batch.schema.names, "sequence_id", "slot"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = materialize(ranked.mapInArrow(assign, schema + ", sequence_id long, slot long"), "packed-pieces")

    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    combined = placed.where("sequence_id >= 0").select(
        "doc_id",
        (F.col("tokens") - F.col("length")).alias("start"),
        "length",
        F.col("rest_crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
    )

    full_counts = tokens.groupBy("part").agg(F.sum(F.size("full").cast("long")).alias("n"))
    begin = int(first[-1])
    full = tokens.select("part", "doc_id", "tokens", "full_before", F.posexplode("full").alias("k", "crc"))
    # One row for each partition: their number is that of the tasks that wrote the tokens.
    full = full.join(F.broadcast(offsets(full_counts, [], "n", "earlier")), "part").select(
        "doc_id",
        (F.col("k") * F.lit(window)).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"),
        (F.col("earlier") + F.col("full_before") + F.col("k") + begin).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    number = tokens.agg(F.sum(F.size("full").cast("long"))).first()[0] or 0
    stream = residue(tokens, placed.where("sequence_id < 0"), begin + number, window)
    return combined.unionByName(full).unionByName(stream)


def residue(tokens: DataFrame, left: DataFrame, begin: int, window: int) -> DataFrame:
    """The pieces outside all combinations as one stream, cut at every window."""
    per_part = left.groupBy("part").agg(F.sum("length").alias("n"))
    before = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    running = left.select("part", "row", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("inside"))
    running = running.join(F.broadcast(offsets(per_part, [], "n", "earlier")), "part")
    at = running.select("part", "row", (F.col("earlier") + F.col("inside")).alias("at"))
    cut = tokens.select("part", "row", "doc_id", "tokens", "rest").join(at, ["part", "row"])
    kind = tokens.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, out = [], [[] for _ in range(6)]
            for i, (tokens_, rest, at_) in enumerate(
                zip(*(batch.column(c).to_pylist() for c in ("tokens", "rest", "at")))
            ):
                ids = np.frombuffer(rest, "<u4")
                done = 0
                while done < len(ids):
                    n = min(len(ids) - done, window - (at_ + done) % window)
                    sequence, offset = divmod(at_ + done, window)
                    values = (tokens_ - len(ids) + done, n, crc(ids[done : done + n]), tokens_, begin + sequence, offset)
                    for column, value in zip(out, values):
                        column.append(value)
                    whose.append(i)
                    done += n
            ids_ = batch.column("doc_id").take(pa.array(whose, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_, *(pa.array(x, pa.int64()) for x in out)], names)

    schema = f"doc_id {kind}, " + ", ".join(f"`{n}` long" for n in names[1:])
    return cut.mapInArrow(pieces, schema)


def pack_documents(docs: DataFrame, vocabulary_path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Encode with a byte-level vocabulary and pack."""

    def build() -> Encoder:
        return byte_encoder(vocabulary(vocabulary_path), pattern)

    tokens = encoded(docs, build, f"bytes {vocabulary_path} {pattern}", end_id)
    return pack(materialize(tokens, "tokens"))
