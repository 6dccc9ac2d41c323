"""Token files in patched frame-of-reference blocks.

A page holds whole documents. Its ids are cut into blocks of 256. Each block stores its
minimum and the differences to it, packed at the width that fits most of them; the
others are exceptions, listed with place and full difference. An index has the start of
each block, so any block is read alone. Every array of a page stands by itself, which
lets all blocks of a page be packed and unpacked at once.

Documents are range-partitioned and sorted by doc_id. Only a count for each partition is
needed to know where each document starts in the whole. Pages are rows of a Parquet
table, so Spark's commit protocol keeps files of lost or repeated tasks out of it.

Null and empty texts have the end id alone. Rows with equal doc_id follow each other,
ordered by text; a null doc_id comes first. A document longer than a page is a page of
its own. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodlens.llm.common import id_and_text, parts_for, per_worker, steps
from floodlens.llm.segments import Encoder, word_encoder
from floodlens.session import scratch_dir

BLOCK = 256
# Ids after which a page ends; documents stay whole.
PAGE_IDS = 1 << 18
# Share of a block's differences that its width must fit.
FITTING = 0.9
MAGIC = b"PFR1"


def pack(ids: np.ndarray) -> bytes:
    """One stream of unsigned 32-bit ids as blocks."""
    count = -(-len(ids) // BLOCK)
    values = np.full(count * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    values[: len(ids)] = ids
    values = values.reshape(count, BLOCK)
    least = values.min(axis=1) if count else np.zeros(0, np.uint32)
    rest = values - least[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, int(FITTING * BLOCK))
    width = np.partition(bits, at, axis=1)[:, at] if count else np.zeros(0, np.uint8)
    patched = bits > width[:, None]
    block, place = np.nonzero(patched)
    words = width.astype(np.int64) * (BLOCK // 32)
    starts = np.cumsum(words) - words
    packed = np.zeros(int(words.sum()), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        low = (rest[own] & np.uint32((1 << w) - 1)).reshape(len(own), BLOCK // 32, 32)
        out = np.zeros((len(own), BLOCK // 32, w), np.uint32)
        for j in range(32):
            word, shift = divmod(j * w, 32)
            out[:, :, word] |= low[:, :, j] << np.uint32(shift)
            if shift + w > 32:
                out[:, :, word + 1] |= low[:, :, j] >> np.uint32(32 - shift)
        packed[starts[own][:, None] + np.arange(words[own[0]])] = out.reshape(len(own), -1)
    exceptions = np.bincount(block, minlength=count).astype(np.uint16)
    head = MAGIC + struct.pack("<IIII", len(ids), count, len(packed), len(block))
    parts = [least, width, exceptions, starts.astype("<u4"), packed, place.astype(np.uint8), rest[patched]]
    return head + b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first..last (all by default), found by the index of block starts."""
    if data[:4] != MAGIC:
        raise ValueError("not a block stream")
    length, count, words, patches = struct.unpack_from("<IIII", data, 4)
    at = 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, n, at)
        at += found.nbytes
        return found

    least, width, exceptions = take("<u4", count), take("u1", count), take("<u2", count)
    starts, packed = take("<u4", count).astype(np.int64), take("<u4", words)
    place, patch = take("u1", patches), take("<u4", patches)
    last = count if last is None else min(last, count)
    first = min(first, last)
    out = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]).tolist():
        if not w:
            continue
        own = np.flatnonzero(width[first:last] == w)
        coded = packed[starts[first + own][:, None] + np.arange(w * BLOCK // 32)]
        coded = coded.reshape(len(own), BLOCK // 32, w)
        plain = np.zeros((len(own), BLOCK // 32, 32), np.uint32)
        for j in range(32):
            word, shift = divmod(j * w, 32)
            value = coded[:, :, word] >> np.uint32(shift)
            if shift + w > 32:
                value = value | coded[:, :, word + 1] << np.uint32(32 - shift)
            plain[:, :, j] = value & np.uint32((1 << w) - 1)
        out[own] = plain.reshape(len(own), BLOCK)
    block = np.repeat(np.arange(count), exceptions)
    own = (block >= first) & (block < last)
    out[block[own] - first, place[own]] = patch[own]
    out += least[first:last, None]
    return out.reshape(-1)[: min(length, last * BLOCK) - first * BLOCK]


def write_tokens(
    docs: DataFrame,
    path: str,
    build: Callable[[], Encoder],
    key: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode all documents, an end id after each, to pages at path in ascending doc_id order."""
    plain = id_and_text(docs, id_col=id_col, text_col=text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()
    ordered = plain.repartitionByRange(parts_for(docs, text_col), "doc_id").sortWithinPartitions("doc_id", "text")
    names = ["part", "page", "before", "tokens", "doc_ids", "lengths", "payload"]

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(key, build)
        part, page, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names_held: list[pa.Array] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal page, before
            flat = np.concatenate(ids)
            own = pa.concat_arrays(names_held)
            row = [
                pa.array([part], pa.int32()),
                pa.array([page], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([len(flat)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                pa.array([np.array(sizes, "<i8").tobytes()], pa.binary()),
                pa.array([pack(flat)], pa.binary()),
            ]
            page, before = page + 1, before + len(flat)
            ids.clear(), names_held.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(row, names)

        for batch in steps(batches):
            found, at = encode(batch.column(1))
            rows = len(batch)
            done = 0
            while done < rows:
                room = PAGE_IDS - sum(map(len, ids))
                stop = int(np.searchsorted(at + np.arange(rows + 1), at[done] + done + room, side="left"))
                stop = min(rows, max(done + 1, stop))
                some = np.insert(found[at[done] : at[stop]], at[done + 1 : stop + 1] - at[done], end_id)
                ids.append(some.astype(np.uint32))
                names_held.append(batch.column(0).slice(done, stop - done))
                sizes.extend((np.diff(at[done : stop + 1]) + 1).tolist())
                done = stop
                if sum(map(len, ids)) >= PAGE_IDS:
                    yield flush()
        if ids:
            yield flush()

    schema = f"part int, page int, before long, tokens long, doc_ids array<{kind}>, lengths binary, payload binary"
    ordered.mapInArrow(paged, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (little-endian 32 bit)."""
    pages = spark.read.parquet(path)
    kind = pages.schema["doc_ids"].dataType.elementType.simpleString()
    totals = pages.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # one row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("begin"))
    placed = pages.join(F.broadcast(begins), "part")
    placed = placed.select((F.col("begin") + F.col("before")).alias("start"), "doc_ids", "lengths", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = unpack(batch.column(3)[i].as_py())
                lengths = np.frombuffer(batch.column(2)[i].as_py(), "<i8")
                ends = np.concatenate([[0], np.cumsum(lengths)])
                data = pa.BinaryArray.from_buffers(
                    pa.binary(),
                    len(lengths),
                    [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))],
                )
                starts = pa.array(batch.column(0)[i].as_py() + ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[i].values, starts, pa.array(lengths), data],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids binary")


def word_token_files(docs: DataFrame, vocabulary_path: str, end_id: int = 1) -> str:
    """Write docs with the word vocabulary to a fresh folder, and give its path."""
    path = scratch_dir(docs.sparkSession, "token-files")
    write_tokens(docs, path, lambda: word_encoder(vocabulary_path), f"words {vocabulary_path} {end_id}", end_id)
    return path


def checksums(tokens: DataFrame) -> DataFrame:
    """ids replaced by their CRC-32."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], found], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(summed, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
