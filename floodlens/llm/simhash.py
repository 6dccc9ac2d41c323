"""SimHash fingerprints, and their links by vantage-point trees.

A bounded sample of the distinct fingerprints builds the upper tree: at each node a
vantage fingerprint and a radius part near from far. Every fingerprint goes home to one
leaf, and visits each further leaf that the triangle inequality cannot rule out: a near
one visits the far side if it lies within `bits` of the border, and below that both
sides of every border it is close to. So each linked pair meets in the home leaf of one
of the two. A leaf searches its fingerprints with a tree of its own and answers with a
star for each connected group, never with all pairs. The number of leaves grows with
the root of the number of fingerprints, as does the sample.

A fingerprint that is linked to the vantage point needs no comparison with others that
are: they are in one group already, and a branch with one group only is skipped. That
keeps large clouds of near copies from being compared pair by pair.

Copies of one fingerprint are one point. Texts without words (empty, null, white space)
have fingerprint zero and are linked like any other. Rows without a doc_id are linked too, and
name a group only where no row of it has an id. Rows may share a doc_id: each is judged by its
own text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import id_and_text, keep_marked, raw, text_mark
from floodlens.llm.components import components
from floodlens.session import materialize

SHINGLE = 3
BITS = 3
SEED = 42
# Sampled fingerprints for each leaf of the upper tree; leaves are root(n) / LEAF_ROOT.
SAMPLE_PER_LEAF = 32
LEAF_ROOT = 8
# Sets of at most this many points are compared directly.
DIRECT = 128


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the hashes of all shingles."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(text, SEED)
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    chosen = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(chosen.view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, mark, point): the fingerprint of the whole text as a signed 64-bit number, and a
    hash that tells texts under one id apart."""
    mark = text_mark(docs[text_col]).alias("mark")
    plain = id_and_text(docs, mark, id_col=id_col, text_col=text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw(batch.column(1))
            # bytes.split() without arguments cuts at exactly 0x20 and 0x09-0x0D.
            found = [
                fingerprint(data[a:b].tobytes().lower().split(), shingle) for a, b in zip(at[:-1].tolist(), at[1:].tolist())
            ]
            points = np.array(found, np.uint64).view(np.int64)
            columns = [batch.column(0), batch.column(2), pa.array(points)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "point"])

    return plain.mapInArrow(hashed, f"doc_id {kind}, mark long, point long")


def distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def build(sample: np.ndarray, leaves: int, bits: int) -> list[tuple]:
    """Nodes (vantage, radius, near, far) with root 0; a leaf is (None, its number).

    Of several vantage points and radii, the one that sends the fewest to both sides wins.
    """
    nodes: list[tuple] = []
    number = 0
    rng = np.random.default_rng(7)

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal number
        at = len(nodes)
        nodes.append(())
        best = None
        if wanted > 1 and len(points) > 1:
            for vantage in rng.choice(points, min(8, len(points)), replace=False):
                away = distance(points, vantage)
                for radius in np.unique(np.percentile(away, [30, 40, 50, 60, 70]).astype(int)):
                    near = int((away <= radius).sum())
                    if 0 < near < len(points):
                        both = int((np.abs(away - radius) <= bits).sum())
                        cost = both + abs(2 * near - len(points)) // 4
                        if best is None or cost < best[0]:
                            best = (cost, vantage, int(radius), away <= radius)
        if best is None:
            nodes[at] = (None, number)
            number += 1
            return at
        _, vantage, radius, near = best
        left = grow(points[near], wanted // 2)
        right = grow(points[~near], wanted - wanted // 2)
        nodes[at] = (vantage, radius, left, right)
        return at

    grow(np.unique(sample), leaves)
    return nodes


def route(points: np.ndarray, nodes: list[tuple], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, home): every point's home leaf and the leaves it visits."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, index, home = todo.pop()
        if not len(index):
            continue
        node = nodes[at]
        if node[0] is None:
            out.append((index, node[1], home))
            continue
        vantage, radius, left, right = node
        away = distance(points[index], vantage)
        near = away <= radius
        # A pair parted here meets on the far side; visitors go wherever a partner may live.
        to_near = near | ~home & (away <= radius + bits)
        to_far = away > radius - bits
        todo.append((left, index[to_near], home[to_near]))
        todo.append((right, index[to_far], (home & ~near)[to_far]))
    if not out:
        return np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0, bool)
    return (
        np.concatenate([x[0] for x in out]),
        np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in out]),
        np.concatenate([x[2] for x in out]),
    )


class Groups:
    """Disjoint sets over 0..n-1; the smallest member stands for a set."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        top = self.up[x]
        while True:
            higher = self.up[top]
            if np.array_equal(higher, top):
                self.up[x] = top
                return top
            top = higher

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def link(points: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """For each point the index of the first of its group; groups are joined by pairs within
    `bits` of which one at least is at home here."""
    groups = Groups(len(points))
    rng = np.random.default_rng(11)
    mine = np.flatnonzero(home)
    todo = [(np.arange(len(points)), mine)]
    while todo:
        queries, rows = todo.pop()
        if not len(queries) or not len(rows):
            continue
        first = groups.find(rows)
        if (first == first[0]).all():  # one group: only queries outside it can add a link
            queries = queries[groups.find(queries) != first[0]]
            if not len(queries):
                continue
        if len(rows) <= DIRECT:
            for at in range(0, len(queries), 4096):
                some = queries[at : at + 4096]
                q, r = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[rows][None, :]) <= bits)
                groups.union(some[q], rows[r])
            continue
        best = None
        for pick in rng.choice(rows, 4, replace=False):
            away = distance(points[rows], points[pick])
            radius = int(np.median(away))
            radius = radius if (away > radius).any() else radius - 1
            both = int((np.abs(away - radius) <= bits).sum())
            if best is None or both < best[0]:
                best = (both, pick, radius, away)
        _, pick, radius, away = best
        asked = distance(points[queries], points[pick])
        for some, far in ((rows, away), (queries, asked)):
            close = some[far <= bits]
            groups.union(close, np.full(len(close), pick))
        todo.append((queries[asked <= radius + bits], rows[away <= radius]))
        todo.append((queries[asked > radius - bits], rows[away > radius]))
    return groups.find(np.arange(len(points)))


def linked_points(points: DataFrame, bits: int = BITS) -> DataFrame:
    """(point, root) for distinct points (column `point`) that have another within `bits`."""
    total = points.count()
    leaves = max(1, round(total**0.5 / LEAF_ROOT))
    wanted = leaves * SAMPLE_PER_LEAF
    share = min(1.0, 2 * wanted / max(total, 1))
    # By hash, so that the sample is the same whenever it is drawn; its size follows root(n).
    spread = F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = np.array([x[0] for x in points.where(spread).collect()], np.int64).view(np.uint64)
    nodes = build(sample, leaves, bits)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            index, leaf, home = route(own.view(np.uint64), nodes, bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(own[index]), pa.array(home)], ["leaf", "point", "home"]
            )

    def searched(table: pa.Table) -> pa.Table:
        own = table.column("point").to_numpy()
        order = np.argsort(own)
        own = own[order]
        home = table.column("home").to_numpy(zero_copy_only=False)[order]
        first = link(own.view(np.uint64), home, bits)
        star = first != np.arange(len(own))
        return pa.table({"a": own[star], "b": own[first[star]]})

    shards = points.select("point").mapInArrow(dealt, "leaf int, point long, home boolean")
    stars = shards.groupBy("leaf").applyInArrow(searched, "a long, b long")
    return components(stars).select(F.col("node").alias("point"), "root")


def _grouped(docs: DataFrame, bits: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, mark, point, and the first document of its group (null ids last)."""
    marked = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "mark")).alias("first")
    points = materialize(marked.groupBy("point").agg(first), "points")
    roots = linked_points(points, bits)
    rooted = points.join(roots, "point", "left").withColumn("root", F.coalesce("root", "point"))
    named = rooted.groupBy("root").agg(F.min("first").alias("leader"))
    known = rooted.join(named, "root").select("point", "leader")
    return marked.join(known, "point")


def near_groups(
    docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, point, component_id (smallest doc_id it can reach over links)."""
    found = _grouped(docs, bits, shingle, id_col, text_col)
    return found.select("doc_id", "point", F.col("leader.doc_id").alias("component_id"))


def drop_near(
    docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group stays: the one with the smallest id, its repeated rows once. Of
    several texts under that id in one group, the one with the smallest mark stays. A group
    without any id keeps one text."""
    found = _grouped(docs, bits, shingle, id_col, text_col)
    stays = found.where("doc_id <=> leader.doc_id AND mark = leader.mark")
    return keep_marked(docs, stays.selectExpr("doc_id AS kept_id", "mark AS kept_mark"), id_col, text_col)
