"""Shared by the corpus operators: text columns, Arrow buffers, worker caches, key ranges."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text bytes that one step inside a task works on at a time. A longer text is a step of its own.
STEP_BYTES = 2 << 20


def id_and_text(docs: DataFrame, *more: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text only, so that other columns can have any name. A null text counts as empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *more)


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that docs do not have, letter case aside."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_mark(text: Column) -> Column:
    """Tells texts under one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_marked(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id (null too) and text mark stand in kept (kept_id, kept_mark); repeated
    rows once. Texts are shuffled once: the join and the last step share their keys."""
    mark = free_name(docs, "_mark")
    kept = kept.select("kept_id", "kept_mark").distinct()
    marked = docs.withColumn(mark, text_mark(docs[text_col]))
    same = marked[id_col].eqNullSafe(kept["kept_id"]) & (marked[mark] == kept["kept_mark"])
    return marked.join(kept, same, "left_semi").dropDuplicates([id_col, mark]).drop(mark)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of bounded text size, so memory does not depend on row lengths."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(sizes):
            fit = int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right"))
            yield batch.slice(at, max(1, fit))
            at += max(1, fit)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and its n + 1 offsets, from 0."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def per_worker(key: str, build: Callable[[], object]) -> object:
    """One object for each Python worker process, kept from task to task."""
    store = sys.modules.setdefault("_floodlens_worker_store", types.ModuleType("_floodlens_worker_store"))
    if not hasattr(store, key):
        setattr(store, key, build())
    return getattr(store, key)


def range_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending values of an integer key that cut its rows into even ranges.

    Only the key is read; the result has one number for each later partition.
    """
    if parts < 2:
        return []
    share = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, share, 10 * parts)).first()[0] or []
    return sorted(set(int(x) for x in found))


def part_of(keys: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Number of the range that a key lies in; keys equal to a cut go to the lower range."""
    return np.searchsorted(np.asarray(cuts, dtype=np.int64), keys, side="left").astype(np.int32)


def parts_for(docs: DataFrame, text_col: str = "text", most: int = 8 << 20) -> int:
    """Partitions needed so that each holds about `most` bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-int(total) // most))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for every (s, n), joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
