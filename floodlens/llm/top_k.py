"""Exact top-k inner products by blocks of a document range and their term maxima.

Terms are signed components: a vector has weight x on the term of a component's sign. An
inner product is then at most the sum, over the components of a query, of the query's
weight times the largest weight of that term in a block. Rows are renumbered so that
alike vectors stand together: two bounded passes over a sample give centres, and rows are
ranged by nearest centre, second centre, then id. `parts` of that order hold `blocks` of
BLOCK rows; a block has its term maxima and its forward index, all weights of its rows.

Each query first asks the part with the largest bound, which gives it a k-th score, and
then every other part whose bound does not fall below that score. In a part it takes the
blocks in descending order of their bounds, a few more each time, and stops at the first
bound below its k-th score. Bounds equal to it are still asked, since ties go to the
smaller id. Nothing else is skipped, so results are exact.

Parts meet queries in slices of SLICE queries, so a part that many queries ask is
several tasks. A query sends at most k candidates from each slice to the last step.

A vector that is null, or holds a null or non-finite component, takes no part, nor does a
row without an id. Shorter vectors end in zeros. Repeated rows count each on its own as
candidates, and once as queries. A row is never a candidate for its own id. Products are
exact below 2^63 in all. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.session import materialize

SCALE = 64
BLOCK = 64
PART = 8192
SLICE = 1024
# Vectors that centres are fitted on, and how many centres. They order rows, and decide no result.
SAMPLE = 8192
CENTRES = 128
# Part bounds that one routing task compares with a slice of queries.
CHUNK = 4096
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, codes): floor(scale * x) of every component, for rows that take part."""
    one = lambda x: F.floor(F.lit(scale).cast("double") * x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    plain = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v"))
    fit = plain.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(False)))
    return fit.select("vec_id", F.transform("v", one).alias("codes"))


def narrow(rows: np.ndarray) -> bytes:
    """Weights in the fewest bytes that hold them all; the length tells which."""
    most = int(max(rows.max(initial=0), -rows.min(initial=0) - 1))
    kind = next(k for k in WIDTHS if most <= np.iinfo(k).max)
    return np.ascontiguousarray(rows, kind).tobytes()


def widen(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = WIDTHS[(len(data) // max(1, rows * dims)).bit_length() - 1] if rows * dims else np.int8
    return np.frombuffer(data, kind).reshape(rows, dims).astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """One row of `dims` numbers for each list, with zeros after its end."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, through floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sum of term maxima for every query and block."""
    return products(np.maximum(queries, 0), high) + products(np.minimum(queries, 0), low)


def centres(sample: np.ndarray, count: int = CENTRES, rounds: int = 5) -> np.ndarray:
    """Means of alike vectors of a sample, always the same for the same sample."""
    rng = np.random.default_rng(5)
    found = sample[rng.permutation(len(sample))[:count]].astype(np.float64)
    for _ in range(rounds):
        near = (sample @ found.T - (found**2).sum(axis=1) / 2).argmax(axis=1)
        for i in np.unique(near):
            found[i] = sample[near == i].mean(axis=0)
    return found


INDEX = "part int, block int, dims int, ids binary, forward binary, high binary, low binary"


def index(coded: DataFrame, dims: int, total: int, part: int = PART, block: int = BLOCK) -> DataFrame:
    """One row per block, written: its part, ids, forward index (weights of all rows) and term maxima
    of both signs. The sample is drawn by hash of the id and has about SAMPLE rows at any size."""
    share = min(1.0, SAMPLE / max(1, total))
    drawn = coded.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("vec_id")
    rows = drawn.limit(2 * SAMPLE).toArrow()
    means = centres(matrix(rows.column("codes").combine_chunks(), dims)) if len(rows) else np.zeros((1, dims))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = matrix(batch.column(1), dims).astype(np.float64)
            near = own @ means.T - (means**2).sum(axis=1) / 2
            first = near.argmax(axis=1)
            near[np.arange(len(own)), first] = -np.inf
            place = first * len(means) + near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(place), *batch.columns], ["place", "vec_id", "codes"])

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, len(batch), block):
                some = batch.slice(at, block)
                own = matrix(some.column("codes"), dims)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("part").slice(0, 1),
                        pa.array([number], pa.int32()),
                        pa.array([dims], pa.int32()),
                        pa.array([some.column("vec_id").to_numpy().astype("<i8").tobytes()]),
                        pa.array([narrow(own)]),
                        pa.array([own.max(axis=0).astype("<i8").tobytes()]),
                        pa.array([own.min(axis=0).astype("<i8").tobytes()]),
                    ],
                    [x.split()[0] for x in INDEX.split(", ")],
                )
                number += 1

    order = ["place", "vec_id"]
    dealt = coded.mapInArrow(placed, "place long, vec_id long, codes array<bigint>")
    dealt = dealt.repartitionByRange(max(1, -(-total // part)), *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("part"), "vec_id", "codes")
    return materialize(dealt.mapInArrow(blocked, INDEX), "top-k-index")


def vectors_of(table: pa.Table, name: str, dims: int) -> np.ndarray:
    data = b"".join(x.as_py() for x in table.column(name))
    return np.frombuffer(data, "<i8").reshape(-1, dims)


class Best:
    """The k best (score, id) of each query so far, and the score that a newcomer must reach."""

    def __init__(self, least: np.ndarray, k: int) -> None:
        self.k, self.least = k, least.copy()
        self.query, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        query, score, row = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.row, row)))
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        start = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - start
        stay = rank < self.k
        self.query, self.score, self.row = query[stay], score[stay], row[stay]
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def search(own: np.ndarray, ids: np.ndarray, least: np.ndarray, blocks: pa.Table, k: int) -> Best:
    """Block-at-a-time: every query takes its blocks by descending bound until one is below its k-th score."""
    dims = own.shape[1]
    best = Best(least, k)
    limit = bounds(own, vectors_of(blocks, "high", dims), vectors_of(blocks, "low", dims))
    order = np.argsort(-limit, axis=1, kind="stable")
    limit = np.take_along_axis(limit, order, axis=1)
    names = [np.frombuffer(x.as_py(), "<i8") for x in blocks.column("ids")]
    forward = [x.as_py() for x in blocks.column("forward")]
    at, step, open_ = 0, 1, np.arange(len(own))
    while at < order.shape[1] and len(open_):
        open_ = open_[limit[open_, at] >= best.least[open_]]
        ranks = slice(at, at + step)
        asked = limit[open_, ranks] >= best.least[open_][:, None]
        query, block = np.repeat(open_, asked.sum(axis=1)), order[open_, ranks][asked]
        by_block = np.argsort(block, kind="stable")
        query, block = query[by_block], block[by_block]
        found = []
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            if not len(part):
                continue
            number, who = int(block[part[0]]), query[part]
            scores = products(own[who], widen(forward[number], len(names[number]), dims))
            hit = (scores >= best.least[who][:, None]) & (names[number][None, :] != ids[who][:, None])
            q, r = np.nonzero(hit)
            found.append((who[q], scores[q, r], names[number][r]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found)))
        at, step = at + step, 2 * step
    return best


ASKING = "part int, query_id long, codes binary, least long"
FOUND = "query_id long, codes binary, vec_id long, score long"
LOWEST = np.iinfo(np.int64).min


def route(
    queries: DataFrame,
    blocks: DataFrame,
    dims: int,
    keep: Callable[[np.ndarray, np.ndarray, pa.Table], np.ndarray],
) -> DataFrame:
    """(part, query_id, codes, least, bound): the parts that each query asks. `keep` marks them from the
    part numbers, bounds and a table of queries. Slices of queries meet chunks of parts: no side is broadcast."""
    tops = blocks.groupBy("part").applyInArrow(
        lambda table: pa.table(
            {
                "part": table.column("part").slice(0, 1),
                "high": pa.array([vectors_of(table, "high", dims).max(axis=0).tobytes()]),
                "low": pa.array([vectors_of(table, "low", dims).min(axis=0).tobytes()]),
            }
        ),
        "part int, high binary, low binary",
    )
    tops = materialize(tops, "top-k-parts")
    chunks = (tops.agg(F.max("part")).first()[0] or 0) // CHUNK + 1
    slices = max(1, -(-queries.count() // SLICE))
    sliced = queries.withColumn("slice", F.pmod(F.xxhash64("query_id", "codes"), F.lit(slices)).cast("int"))
    sliced = sliced.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = tops.withColumn("chunk", (F.col("part") / CHUNK).cast("int"))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def compare(some: pa.Table, parts: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(x.as_py() for x in some.column("codes")), "<i8").reshape(-1, dims)
        number = parts.column("part").to_numpy()
        limit = bounds(own, vectors_of(parts, "high", dims), vectors_of(parts, "low", dims))
        query, part = np.nonzero(keep(limit, number, some))
        picked = some.take(pa.array(query))
        return pa.table(
            {
                "part": pa.array(number[part], pa.int32()),
                "query_id": picked.column("query_id"),
                "codes": picked.column("codes"),
                "least": picked.column("least"),
                "bound": pa.array(limit[query, part], pa.int64()),
            }
        )

    keys = ["slice", "chunk"]
    return sliced.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, f"{ASKING}, bound long")


def ask(asking: DataFrame, blocks: DataFrame, dims: int, k: int) -> DataFrame:
    """The k best of each query in each part it asks. Slices of the queries of a part are tasks of their own."""
    sizes = asking.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    sizes = materialize(sizes, "top-k-slices")
    where = F.pmod(F.xxhash64("query_id", "codes"), F.col("slices")).cast("int").alias("slice")
    asked = asking.join(sizes, "part").select(*asking.columns, where)
    each = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    indexed = blocks.join(sizes, "part").select(*blocks.columns, each)

    def scored(some: pa.Table, own: pa.Table) -> pa.Table:
        vectors = np.frombuffer(b"".join(x.as_py() for x in some.column("codes")), "<i8").reshape(-1, dims)
        best = search(vectors, some.column("query_id").to_numpy(), some.column("least").to_numpy(), own, k)
        picked = some.select(["query_id", "codes"]).take(pa.array(best.query))
        columns = [*picked.columns, pa.array(best.row, pa.int64()), pa.array(best.score, pa.int64())]
        return pa.table(columns, names=["query_id", "codes", "vec_id", "score"])

    keys = ["part", "slice"]
    return asked.groupBy(*keys).cogroup(indexed.groupBy(*keys)).applyInArrow(scored, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("query_id", "codes").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    part: int = PART,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row that `queries` (a condition
    on vec_id) chooses, scores descending, then ids ascending."""
    coded = materialize(codes(vectors, id_col, vector_col, scale), "codes")
    size = coded.agg(F.count(F.lit(1)).alias("total"), F.max(F.size("codes")).alias("dims")).first()
    dims = max(1, size["dims"] or 0)
    blocks = index(coded, dims, size["total"], part, block)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([x.tobytes() for x in matrix(batch.column(1), dims).astype("<i8")], pa.binary())
            lowest = pa.array(np.full(len(batch), LOWEST), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, lowest], ["query_id", "codes", "least"])

    asked = coded.where(queries).mapInArrow(packed, "query_id long, codes binary, least long").distinct()
    asked = materialize(asked, "queries")

    def largest(limit: np.ndarray, number: np.ndarray, some: pa.Table) -> np.ndarray:
        return np.arange(limit.shape[1])[None, :] == limit.argmax(axis=1)[:, None] if limit.size else limit > 0

    # One row per query and chunk of parts, of which the largest bound is the seed.
    seeds = route(asked, blocks, dims, largest).groupBy("query_id", "codes", "least")
    seeds = materialize(seeds.agg(F.max_by("part", F.struct("bound", "part")).alias("part")), "seeds")
    first = materialize(best_of(ask(seeds, blocks, dims, k), k), "seed-results")
    known = first.groupBy("query_id", "codes").agg(F.max("rank").alias("n"), F.min("score").alias("last"))
    least = F.when(F.col("n") == k, F.col("last")).otherwise(F.lit(LOWEST)).alias("least")
    known = seeds.drop("least").withColumnRenamed("part", "seed").join(known, ["query_id", "codes"], "left")
    known = materialize(known.select("query_id", "codes", "seed", least), "thresholds")

    def rest(limit: np.ndarray, number: np.ndarray, some: pa.Table) -> np.ndarray:
        reach = limit >= some.column("least").to_numpy()[:, None]
        return reach & (number[None, :] != some.column("seed").to_numpy()[:, None])

    others = materialize(route(known, blocks, dims, rest).drop("bound"), "asking")
    found = first.drop("rank").unionByName(ask(others, blocks, dims, k))
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
