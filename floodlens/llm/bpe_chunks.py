"""Byte-level BPE of whole texts in overlapping chunks, and back.

A text longer than a chunk is cut into overlapping chunks that tasks pre-tokenise in
parallel. Two neighbours are stitched at the first place of their overlap where both
have a boundary between a character that is no white space and a white space: from there
on the pattern, which never looks back, cuts both alike, and what stands before ends
whole. The pieces between such places are encoded in parallel, and their ids joined in
order. A text with an overlap in which the two never agree (a single pre-token longer
than the overlap) is encoded in one piece. Shorter texts are one chunk.

Decoding concatenates the bytes of the ids.

Null and empty texts have no ids. Chunks belong to (doc_id, hash of the text), so rows
may repeat. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import gather, id_and_text, per_worker, steps
from floodlens.llm.segments import Encoder, byte_encoder, rank_file

# Code points of a chunk, and of what it shares with the next one.
CHUNK = 32768
OVERLAP = 1024
# A boundary counts only so far from a chunk's end: a match must not depend on what follows.
MARGIN = 8


def boundaries(text: str, pattern: regex.Pattern, since: int, until: int) -> list[int]:
    """Places in [since, until) where a match ends before a white space and not after one."""
    found = []
    for match in pattern.finditer(text):
        at = match.end()
        if at >= until:
            break
        if at >= since and at < len(text) and text[at].isspace() and not text[at - 1].isspace():
            found.append(at)
    return found


class Bytes:
    """The bytes of ids, and their decimal writing, as flat tables to gather from."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, number in ranks.items():
            tokens[number] = token
        self.tokens = self.table(tokens)
        self.numbers = self.table([b"%d " % i for i in range(size)])

    @staticmethod
    def table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in values], np.int64)
        return np.frombuffer(b"".join(values), np.uint8), np.cumsum(sizes) - sizes, sizes

    @staticmethod
    def read(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
        return gather(table[0], table[1][ids], table[2][ids]).tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return self.read(self.tokens, ids)

    def write(self, ids: np.ndarray) -> bytes:
        return self.read(self.numbers, ids)[:-1]


def coder(path: str, pattern: str) -> Callable[[], tuple[Encoder, Bytes]]:
    def build() -> tuple[Encoder, Bytes]:
        ranks = rank_file(path)
        return byte_encoder(ranks, pattern), Bytes(ranks)

    return build


def digest_row(ids: np.ndarray, back: Bytes) -> tuple[int, str, str]:
    return (
        len(ids),
        hashlib.sha256(back.write(ids)).hexdigest(),
        hashlib.sha256(back.decode(ids)).hexdigest(),
    )


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def results(rows: list[tuple[int, str, str]]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.string())
    return [pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)]


def encode_whole(plain: DataFrame, path: str, pattern: str) -> DataFrame:
    """ids as little-endian 32 bit, for texts (doc_id, text) that are one chunk."""
    build, key = coder(path, pattern), f"coder {path} {pattern}"
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, back = per_worker(key, build)
        for batch in steps(batches):
            ids, at = encode(batch.column(1))
            ends = zip(at[:-1].tolist(), at[1:].tolist())
            rows = results([digest_row(ids[a:b], back) for a, b in ends])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *rows], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return plain.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RESULT}")


def cut_chunks(keyed: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, hash, k, text): chunk k with what it shares with the next."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            for i in range(len(batch)):
                text = batch.column(1)[i].as_py()
                starts = range(0, max(1, len(text) - overlap), chunk)
                count = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * count, batch.schema.field(0).type),
                        pa.array([batch.column(2)[i].as_py()] * count, pa.int64()),
                        pa.array(range(count), pa.int32()),
                        pa.array([text[s : s + chunk + overlap] for s in starts], pa.string()),
                    ],
                    ["doc_id", "hash", "k", "chunk"],
                )

    return keyed.mapInArrow(run, f"doc_id {kind}, hash long, k int, chunk string")


def stitch(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, hash, k, since, until): what each chunk is to encode, in its own places; since is
    null for all chunks of a text if one of its overlaps has no common boundary."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = regex.compile(pattern)
        for batch in steps(batches, "chunk"):
            texts = batch.column(3).to_pylist()
            limit = overlap - MARGIN
            heads = [boundaries(x[: overlap + MARGIN], match, 1, limit) for x in texts]
            tails = [[b - chunk for b in boundaries(x, match, chunk + 1, chunk + limit)] for x in texts]
            shared = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(heads, shared), pa.array(tails, shared)],
                ["doc_id", "hash", "k", "head", "tail"],
            )

    seen = chunks.mapInArrow(run, f"doc_id {kind}, hash long, k int, head array<int>, tail array<int>")
    # Rows of one text: as many as it has chunks.
    every = F.array_sort(F.collect_set(F.struct("k", "head", "tail")))
    listed = seen.groupBy("doc_id", "hash").agg(every.alias("all"))
    met = F.transform(
        "all",
        lambda x, i: F.when(i == 0, F.lit(0)).otherwise(
            F.array_min(F.array_intersect(F.element_at("all", F.greatest(i, F.lit(1)))["tail"], x["head"]))
        ),
    )
    cuts = listed.select("doc_id", "hash", met.alias("cuts")).withColumn(
        "cuts", F.when(~F.exists("cuts", lambda x: x.isNull()), F.col("cuts"))
    )
    return cuts


def encode_chunked(keyed: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Results by (doc_id, hash) for texts that are more than one chunk."""
    build, key = coder(path, pattern), f"coder {path} {pattern}"
    kind = keyed.schema["doc_id"].dataType.simpleString()
    chunks = cut_chunks(keyed, chunk, overlap).repartition("doc_id", "hash", "k")
    cuts = stitch(chunks, pattern, chunk, overlap)
    places = cuts.where("cuts IS NOT NULL").select(
        "doc_id", "hash", F.posexplode("cuts").alias("k", "since"), F.col("cuts")
    )
    # get() gives null beyond the last chunk, which goes to its end.
    places = places.select("doc_id", "hash", "k", "since", (F.get("cuts", F.col("k") + 1) + chunk).alias("until"))
    same = [chunks[c].eqNullSafe(places[c]) for c in ("doc_id", "hash", "k")]
    pieces = chunks.join(places, same).select(chunks["doc_id"], chunks["hash"], chunks["k"], "since", "until", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = per_worker(key, build)
        for batch in steps(batches, "chunk"):
            texts = [
                x[a:b] for x, a, b in zip(*(batch.column(c).to_pylist() for c in ("chunk", "since", "until")))
            ]
            ids, at = encode(pa.array(texts, pa.string()))
            data = ids.astype("<u4")
            packed = pa.array([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["doc_id", "hash", "k", "ids"])

    parts = pieces.mapInArrow(run, f"doc_id {kind}, hash long, k int, ids binary")

    def join(table: pa.Table) -> pa.Table:
        back = per_worker(key, build)[1]
        order = np.argsort(table.column("k").to_numpy(), kind="stable")
        held = dict(zip(table.column("k").to_pylist(), range(len(order))))  # a repeated row's chunks are the same
        column = table.column("ids").combine_chunks()
        data = b"".join(column[held[k]].as_py() for k in sorted(held))
        row = results([digest_row(np.frombuffer(data, "<u4"), back)])
        names = ["doc_id", "hash", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.table([table.column(0)[:1], table.column(1)[:1], *row], names=names)

    whole = parts.groupBy("doc_id", "hash").applyInArrow(join, f"doc_id {kind}, hash long, {RESULT}")
    failed = cuts.where("cuts IS NULL").select("doc_id", "hash")
    same = [keyed[c].eqNullSafe(failed[c]) for c in ("doc_id", "hash")]
    alone = keyed.join(failed, same, "left_semi")
    hashes = alone.select("doc_id", F.col("text"), "hash").dropDuplicates(["doc_id", "hash"])
    single = encode_whole(hashes.select(F.struct("doc_id", "hash").alias("doc_id"), "text"), path, pattern)
    single = single.select("doc_id.doc_id", "doc_id.hash", "n_tokens", "ids_sha256", "decoded_sha256")
    return whole.unionByName(single)


def encode_decode(
    docs: DataFrame,
    path: str,
    pattern: str,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (decimal ids, a space between),
    decoded_sha256 (bytes decoded from the ids)."""
    plain = id_and_text(docs, id_col=id_col, text_col=text_col)
    long = F.char_length("text") > chunk + overlap
    short = encode_whole(plain.where(~long), path, pattern)
    keyed = plain.where(long).select("doc_id", "text", F.xxhash64("text").alias("hash"))
    found = encode_chunked(keyed, path, pattern, chunk, overlap)
    rows = keyed.select("doc_id", "hash")
    same = [rows[c].eqNullSafe(found[c]) for c in ("doc_id", "hash")]
    chunked = rows.join(found, same).select(rows["doc_id"], "n_tokens", "ids_sha256", "decoded_sha256")
    return short.unionByName(chunked)
