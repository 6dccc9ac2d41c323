"""Repeated passages of words, found over a difference cover.

A window is a run of consecutive words. Anchors are shorter runs that start only at word
numbers whose remainder modulo a period lies in a perfect difference cover: for any two
places there is a shift below the period that brings both to cover places. So two equal
windows always share an anchor at the same distance from their starts, and only places
near a repeated anchor can start a repeated window. Those are extended to whole windows,
whose hashes are asked for in a second round; whatever occurs twice is removed wherever
it stands, word by word.

Documents with exactly equal texts are found first, by digest. All their words are removed
if they have a window at all, and only the one with the smallest doc_id takes part further on.

Null, empty and white texts have no words. Rows that repeat doc_id and text are copies of
each other like any two equal texts. A null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from floodlens.llm.blocks import (
    ASKED,
    answered,
    ask,
    asked_table,
    blocked,
    copies,
    hash_bits,
    known_copies,
    nulls_again,
    read_answers,
    same_text,
    together,
    windows,
)
from floodlens.llm.common import mix64, raw
from floodlens.llm.segments import SPACE

WINDOW = 35
# A perfect difference cover of its period.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
FULL_BITS = 64


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes, and a 64-bit hash of each."""
    word = ~SPACE[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sizes = ends - starts
    index = np.arange(len(data))
    place = index - np.maximum.accumulate(np.where(edge[:-1] == 1, index, 0))
    value = mix64(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1))
    value[~word] = 0
    return starts, ends, mix64(np.add.reduceat(value, starts) + sizes.astype(np.uint64))


class Words:
    """The words of a block's documents that take part, and the places of their windows."""

    def __init__(self, texts: pa.Table, answers: pa.Table) -> None:
        self.ids = texts.column("doc_id").to_numpy()
        column = texts.column("text")
        chunk = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        self.data, self.rows = raw(chunk)
        same = known_copies(answers)
        seen: set[int] = set()
        # 0: no copies, 1: stands for its copies, 2: a copy of another row.
        self.kind = np.zeros(len(self.ids), np.int8)
        for i, doc in enumerate(self.ids.tolist()):
            least = same_text(same, doc, self.data[self.rows[i] : self.rows[i + 1]])
            if least is not None:
                self.kind[i] = 1 if least == doc and doc not in seen else 2
                seen.add(doc)
        self.words = [
            word_hashes(self.data[self.rows[i] : self.rows[i + 1]]) for i in range(len(self.ids))
        ]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word number and hash of every anchor of the documents that take part."""
        rows, places, hashes = [], [], []
        for i, (_, _, words) in enumerate(self.words):
            if self.kind[i] == 2 or len(words) < WINDOW:
                continue
            at = np.arange(len(words) - ANCHOR + 1)
            at = at[np.isin(at % PERIOD, COVER)]
            rows.append(np.full(len(at), i))
            places.append(at)
            hashes.append(mix64(windows(words, ANCHOR)[at]))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
        return np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)

    def candidates(self, answers: pa.Table, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word number and hash of the windows that have a repeated anchor."""
        row, place, hashes = self.anchors()
        hashes >>= np.uint64(64 - bits)
        values, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        repeated = (counts > 1) | read_answers(values, answers, 1, buckets, bits)
        hit = repeated[inverse]
        row, place = row[hit], place[hit]
        own = np.searchsorted(row, np.arange(len(self.ids) + 1))
        rows, places, full = [], [], []
        for i in np.unique(row).tolist():
            words = self.words[i][2]
            count = len(words) - WINDOW + 1
            near = np.zeros(len(words) + 2, np.int64)
            at = place[own[i] : own[i + 1]]
            # A window from p - (PERIOD - 1) to p has the anchor at p in its cover.
            np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(near, at + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[:count] > 0)
            rows.append(np.full(len(starts), i))
            places.append(starts)
            full.append(mix64(windows(words, WINDOW)[starts]))
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
        return np.concatenate(rows), np.concatenate(places), np.concatenate(full)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 of the words that stay, a space between."""
    dealt, cuts, total = blocked(docs, id_col, text_col)
    bits, buckets = hash_bits(total), len(cuts) + 1
    same = copies(docs, cuts, id_col, text_col)

    def first(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = texts.column("block")[0].as_py()
        hashes = np.unique(Words(texts, answers).anchors()[2] >> np.uint64(64 - bits))
        return asked_table(block, 1, list(ask(hashes, buckets, bits)))

    def second(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = texts.column("block")[0].as_py()
        full = np.unique(Words(texts, answers).candidates(answers, buckets, bits)[2])
        return asked_table(block, 2, list(ask(full, buckets, FULL_BITS)))

    def third(texts: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(texts, answers)
        row, place, full = words.candidates(answers, buckets, bits)
        values, inverse, counts = np.unique(full, return_inverse=True, return_counts=True)
        hit = ((counts > 1) | read_answers(values, answers, 2, buckets, FULL_BITS))[inverse]
        order = np.searchsorted(row[hit], np.arange(len(words.ids) + 1))
        starts = place[hit]
        out = list(_kept(words, starts, order))
        columns = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.table([texts.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    one = answered(together(dealt, same, first, ASKED))
    two = answered(together(dealt, same.unionByName(one), second, ASKED))
    return nulls_again(together(dealt, same.unionByName(one).unionByName(two), third, RESULT))


def _kept(words: Words, starts: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Words, removed words and digest of the rest, for each row."""
    for i, (begin, end, _) in enumerate(words.words):
        count = len(begin)
        if words.kind[i] and count >= WINDOW:
            gone = np.ones(count, bool)
        else:
            own = starts[order[i] : order[i + 1]]
            depth = np.zeros(count + WINDOW + 1, np.int64)
            np.add.at(depth, own, 1)
            np.add.at(depth, own + WINDOW, -1)
            gone = np.cumsum(depth)[:count] > 0
        text = words.data[words.rows[i] : words.rows[i + 1]].tobytes()
        stay = b" ".join([text[a:b] for a, b in zip(begin[~gone].tolist(), end[~gone].tolist())])
        yield count, int(gone.sum()), hashlib.sha256(stay).hexdigest()
