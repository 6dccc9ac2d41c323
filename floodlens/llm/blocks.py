"""Blocks of documents that ask each other which of their hashes occur elsewhere.

Documents are dealt to blocks by ranges of doc_id, once. A block sends its different
hashes, sorted and as packed differences, to buckets of the hash range; a bucket answers
with one bit for each: another block has it too. So a hash that a third of all documents
share is one entry for each block, and nothing is gathered by hash value alone. A later
round computes the same hashes again from the block's texts and reads the answers in the
same order. All rounds of one query read one shuffle of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import id_and_text, part_of, parts_for, per_worker, range_cuts
from floodlens.llm.token_files import pack, unpack
from floodlens.session import materialize

# Bytes of text in a block.
BLOCK_BYTES = 8 << 20
# Rounds of answers, as told apart in one table.
ANSWER = "block int, round int, bucket int, answer binary"
LOWEST = np.iinfo(np.int64).min


def hash_bits(total_bytes: int) -> int:
    """Bits of a hash that only narrows a search: a chance meeting is rare at any size."""
    return int(min(62, max(32, total_bytes.bit_length() + 14)))


def blocked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[int], int]:
    """(block, doc_id, text) with one partition for each few blocks; the cuts of doc_id; total bytes."""
    plain = id_and_text(docs, id_col=id_col, text_col=text_col)
    plain = plain.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), "text")
    count = parts_for(docs, text_col, BLOCK_BYTES)
    cuts = range_cuts(plain, "doc_id", count)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = part_of(batch.column(0).to_numpy(), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *batch.columns], ["block", "doc_id", "text"])

    dealt = plain.mapInArrow(deal, "block int, doc_id long, text string").repartition("block")
    return dealt, cuts, count * BLOCK_BYTES


def nulls_again(result: DataFrame) -> DataFrame:
    """Rows without a doc_id take part under the least long, which is no id of its own."""
    own = F.when(F.col("doc_id") != LOWEST, F.col("doc_id")).alias("doc_id")
    return result.select(own, *[c for c in result.columns if c != "doc_id"])


def copies(docs: DataFrame, cuts: list[int], id_col: str, text_col: str) -> DataFrame:
    """Answers of round 0: for each block the documents whose whole text others have too,
    as (doc_id, smallest doc_id with that text, start of the text's digest)."""
    plain = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(LOWEST)).alias("doc_id"),
        F.md5(F.coalesce(docs[text_col], F.lit(""))).alias("digest"),
    )
    groups = plain.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # Written, so that the join below shuffles both sides for itself and a digest that many share can be split.
    groups = materialize(groups.where("most > least").select("digest", "least"), "copies")
    start = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")
    found = plain.join(groups, "digest").select("doc_id", "least", start.alias("start"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1).astype("<i8")
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part_of(ids, cuts), pa.int32()),
                    pa.array([0] * n, pa.int32()),
                    pa.array([0] * n, pa.int32()),
                    pa.array([x.tobytes() for x in rows], pa.binary()),
                ],
                ["block", "round", "bucket", "answer"],
            )

    return found.mapInArrow(deal, ANSWER)


def known_copies(answers: pa.Table) -> dict[int, dict[int, int]]:
    """doc_id to digest starts and the smallest doc_id with the same text."""
    own = answers.filter(pa.compute.equal(answers.column("round"), 0)).column("answer").to_pylist()
    known: dict[int, dict[int, int]] = {}
    for doc, least, start in np.frombuffer(b"".join(own), "<i8").reshape(-1, 3).tolist():
        known.setdefault(doc, {})[start] = least
    return known


def same_text(known: dict[int, dict[int, int]], doc: int, text: np.ndarray) -> int | None:
    """The smallest doc_id with this document's text, if others have it."""
    if doc not in known:
        return None
    return known[doc].get(int(hashlib.md5(text.tobytes()).hexdigest()[:12], 16))


def write_sorted(values: np.ndarray) -> bytes:
    """Ascending different numbers as packed differences, or plainly where one is too wide."""
    steps = np.diff(values, prepend=np.uint64(0))
    if len(steps) and steps.max() >= 1 << 32:
        return b"W" + values.astype("<u8").tobytes()
    return b"P" + pack(steps.astype(np.uint32))


def read_sorted(data: bytes) -> np.ndarray:
    if data[:1] == b"W":
        return np.frombuffer(data, "<u8", offset=1)
    return np.cumsum(unpack(data[1:]).astype(np.uint64), dtype=np.uint64)


def ask(hashes: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, numbers) for ascending different hashes of `bits` bits."""
    edges = [min((b << bits) // buckets, (1 << 64) - 1) for b in range(1, buckets)]
    places = [0, *np.searchsorted(hashes, np.array(edges, np.uint64)).tolist(), len(hashes)]
    for bucket, (a, b) in enumerate(zip(places[:-1], places[1:])):
        if b > a:
            yield bucket, write_sorted(hashes[a:b])


def answer(table: pa.Table) -> pa.Table:
    """One bucket: for every asking block, a bit for each of its numbers that another block has."""
    lists = [read_sorted(x.as_py()) for x in table.column("numbers")]
    sizes = np.array([len(x) for x in lists])
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[order][1:] == values[order][:-1]
    shared = np.zeros(len(values), bool)
    shared[order] = same[1:] | same[:-1]
    ends = np.cumsum(sizes)
    bits = [np.packbits(shared[b - n : b]).tobytes() for b, n in zip(ends, sizes)]
    return pa.table(
        [table.column("block"), table.column("round"), table.column("bucket"), pa.array(bits, pa.binary())],
        names=["block", "round", "bucket", "answer"],
    )


def answered(asked: DataFrame) -> DataFrame:
    """asked: block, round, bucket, numbers."""
    return asked.groupBy("bucket").applyInArrow(answer, ANSWER)


def read_answers(hashes: np.ndarray, answers: pa.Table, number: int, buckets: int, bits: int) -> np.ndarray:
    """For ascending different hashes, asked as in ask(): whether another block has each."""
    own = answers.filter(pa.compute.equal(answers.column("round"), number))
    by_bucket = dict(zip(own.column("bucket").to_pylist(), own.column("answer").to_pylist()))
    edges = [min((b << bits) // buckets, (1 << 64) - 1) for b in range(1, buckets)]
    places = [0, *np.searchsorted(hashes, np.array(edges, np.uint64)).tolist(), len(hashes)]
    out = np.zeros(len(hashes), bool)
    for bucket, (a, b) in enumerate(zip(places[:-1], places[1:])):
        if b > a:
            out[a:b] = np.unpackbits(np.frombuffer(by_bucket[bucket], np.uint8), count=b - a).astype(bool)
    return out


ASKED = "block int, round int, bucket int, numbers binary"


def asked_table(block: int, number: int, sent: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table(
        [
            pa.array([block] * len(sent), pa.int32()),
            pa.array([number] * len(sent), pa.int32()),
            pa.array([b for b, _ in sent], pa.int32()),
            pa.array([x for _, x in sent], pa.binary()),
        ],
        names=["block", "round", "bucket", "numbers"],
    )


def together(
    dealt: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """work(texts of a block in order of doc_id, answers for it) for every block."""

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        return work(texts.sort_by("doc_id").combine_chunks(), own)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count - 1) modulo 2^64, kept by the worker."""
    held = per_worker(f"powers {base}", dict)
    if len(held.get("table", ())) < count:
        table = np.full(count, base, np.uint64)
        table[0] = 1
        held["table"] = np.multiply.accumulate(table)
    return held["table"][:count]


# An odd number and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive values, by prefix sums of values times powers of a base."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    n = len(values) - size + 1
    return (sums[size:] - sums[:n]) * powers(INVERSE, len(values))[:n]
