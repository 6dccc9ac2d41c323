"""Repeated byte strings by a sorted sample of suffixes.

A string of 50 bytes is a duplicate if a document with a smaller doc_id has it too. Of
every 27 neighbouring places the one with the least hash of its next 24 bytes is an
anchor; equal strings have the same anchors, and every string of 50 bytes has one. The
suffixes at anchors, with the bytes up to 26 before them, so speak for all suffixes.

A first round finds out which anchors occur in other blocks or more than once here; only
their suffixes are sent. Splitters from a bounded sample of texts range-partition them by
their leading bytes. A bucket sorts its suffixes by words of eight bytes, one after
another and only where the words before are equal (a multikey quicksort with wide
digits), compares neighbours, and takes the runs that agree for 24 bytes. The bytes before
the anchors are sorted once as well, backwards. Strings at one distance from the anchor are
equal if both neighbourhoods agree far enough; the bucket answers which of them a smaller
doc_id has. Runs do not cross buckets: splitters cut only between different
leading bytes, and of equal suffixes with equal bytes before them a block sends one, with
its smallest doc_id. So a suffix that a third of all documents share is one row for each block.

Texts that are whole copies are found first, by digest; all but the one with the smallest
doc_id take no part further on and lose everything if they have 50 bytes.

Null texts are empty. Rows with equal doc_id are never duplicates of each other's strings.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

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

LENGTH = 50
# Bytes that an anchor's hash covers, and places of which one is an anchor.
SEED_BYTES = 24
SPREAD = LENGTH - SEED_BYTES + 1
LEFT = SPREAD - 1
CONTEXT = LEFT + LENGTH
# Texts that splitters are drawn from, and suffixes of each.
SAMPLE_TEXTS = 4096
SAMPLE_SUFFIXES = 64


def sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """pick over every `width` neighbours."""
    n, done = len(values) - width + 1, 1
    while 2 * done <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[:n], values[width - done : width - done + n])


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Places with the least hash of some SPREAD neighbouring ones; all of equal ones."""
    if len(hashes) < SPREAD:
        return np.zeros(0, np.int64)
    least = sliding(np.minimum, hashes, SPREAD)
    around = np.zeros(len(least) + 2 * (SPREAD - 1), np.uint64)
    around[SPREAD - 1 : SPREAD - 1 + len(least)] = least
    return np.flatnonzero(sliding(np.maximum, around, SPREAD) == hashes)


class Texts:
    """The documents of a block; whole copies of earlier ones take no part."""

    def __init__(self, texts: pa.Table, answers: pa.Table) -> None:
        self.ids = texts.column("doc_id").to_numpy()
        column = texts.column("text")
        self.data, self.rows = raw(column.chunk(0) if column.num_chunks else pa.array([], pa.string()))
        same = known_copies(answers)
        ends = zip(self.ids.tolist(), self.rows[:-1].tolist(), self.rows[1:].tolist())
        self.copy = np.array([same_text(same, d, self.data[a:b]) not in (None, d) for d, a, b in ends], bool)


class Suffixes(Texts):
    """The anchors of a block's documents that take part."""

    def __init__(self, texts: pa.Table, answers: pa.Table) -> None:
        super().__init__(texts, answers)
        row, place, hashes = [], [], []
        for i in range(len(self.ids)):
            size = int(self.rows[i + 1] - self.rows[i])
            if self.copy[i] or size < LENGTH:
                continue
            found = mix64(windows(self.data[self.rows[i] : self.rows[i + 1]].astype(np.uint64) + np.uint64(1), SEED_BYTES))
            at = anchors(found)
            row.append(np.full(len(at), i))
            place.append(at)
            hashes.append(found[at])
        empty = [np.zeros(0, np.int64)]
        self.row, self.place = np.concatenate(row or empty), np.concatenate(place or empty)
        self.hashes = np.concatenate(hashes or [np.zeros(0, np.uint64)])

    def repeated(self, answers: pa.Table, buckets: int, bits: int) -> None:
        """Keep only anchors that occur again."""
        values, inverse, counts = np.unique(self.hashes >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        hit = ((counts > 1) | read_answers(values, answers, 1, buckets, bits))[inverse]
        self.row, self.place, self.hashes = self.row[hit], self.place[hit], self.hashes[hit]

    def contexts(self) -> None:
        """Bytes around each anchor, zero outside the document; one entry for equal ones, with the
        smallest doc_id; entries ascend by their suffix."""
        begin, end = self.rows[self.row], self.rows[self.row + 1]
        at = begin + self.place
        self.left = np.minimum(self.place, LEFT).astype(np.uint8)
        self.right = np.minimum(end - at, LENGTH).astype(np.uint8)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), self.data, np.zeros(LENGTH, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[at] if len(at) else np.zeros((0, CONTEXT), np.uint8)
        around = around * (np.arange(CONTEXT)[None, :] >= LEFT - self.left[:, None].astype(np.int64))
        around *= np.arange(CONTEXT)[None, :] < LEFT + self.right[:, None].astype(np.int64)
        # Suffix first, so that entries sort by it; then what stands before, and both sizes.
        entry = np.concatenate([around[:, LEFT:], around[:, :LEFT], self.left[:, None], self.right[:, None]], axis=1)
        entry = np.ascontiguousarray(entry.astype(np.uint8))
        order = sort_rows(entry)
        ordered = entry[order]
        new = np.ones(len(order), bool)
        if len(order) > 1:
            new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = group
        self.unique = ordered[new]
        self.least = np.full(len(self.unique), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.ids[self.row])

    def places(self) -> np.ndarray:
        """Of each anchor: its document's row, its place there, its entry, and whether an earlier document has the entry."""
        later = self.ids[self.row] > self.least[self.entry]
        return np.stack([self.row, self.place, self.entry, later]).astype("<i4")


def words_of(rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Leading `size` bytes of each row as big-endian numbers of eight bytes."""
    count = -(-size // 8)
    wide = np.zeros((len(rows), 8 * count), np.uint8)
    wide[:, :size] = rows[:, :size]
    return [np.ascontiguousarray(wide[:, 8 * i : 8 * i + 8]).view(">u8").ravel().astype(np.uint64) for i in range(count)]


def sort_rows(rows: np.ndarray) -> np.ndarray:
    """Order of byte strings: by one word after another, each only among rows that were equal so far."""
    order = np.arange(len(rows))
    if len(rows) < 2:
        return order
    digits = words_of(rows, rows.shape[1])
    order = np.argsort(digits[0], kind="stable")
    tied = np.zeros(len(rows), bool)
    group = np.concatenate([[0], np.cumsum(np.diff(digits[0][order]) != 0)])
    for digit in digits[1:]:
        sizes = np.bincount(group)
        tied = sizes[group] > 1
        if not tied.any():
            break
        own = np.flatnonzero(tied)
        finer = np.lexsort((digit[order[own]], group[own]))
        order[own] = order[own][finer]
        change = np.zeros(len(rows), bool)
        change[1:] = (np.diff(group) != 0) | (tied[1:] & tied[:-1] & (np.diff(digit[order].astype(np.int64)) != 0))
        group = np.cumsum(change)
    return order


def common(rows: np.ndarray) -> np.ndarray:
    """Leading bytes that each sorted row shares with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return out


def in_company(sorted_classes: np.ndarray) -> np.ndarray:
    """Whether a neighbour has the same class."""
    same = np.zeros(len(sorted_classes) + 1, bool)
    same[1:-1] = sorted_classes[1:] == sorted_classes[:-1]
    return same[1:] | same[:-1]


def found_before(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A bit for each distance from the anchor whose string a smaller doc_id has.

    Suffixes are sorted once, and the bytes before them, read backwards, once. Strings at one
    distance are equal if their suffixes agree up to the string's end and the bytes before them down
    to its start: two classes of neighbours, cut where they share fewer bytes.
    """
    order = sort_rows(rows[:, :LENGTH])
    # A suffix that shares no 24 bytes with a neighbour has no equal string.
    own = order[in_company(np.cumsum(common(rows[order, :LENGTH]) < SEED_BYTES))]
    mark = np.zeros(len(rows), np.uint32)
    if not len(own):
        return mark
    after = common(rows[own, :LENGTH])
    before = np.ascontiguousarray(rows[own, LENGTH:CONTEXT][:, ::-1])
    turn = sort_rows(before)
    turned = common(before[turn])
    left, right, doc = rows[own, CONTEXT], rows[own, CONTEXT + 1], least[own]
    side = np.zeros(len(own), np.int64)
    for back in range(LEFT + 1):
        suffix = np.cumsum(after < LENGTH - back)
        fits = np.flatnonzero((left >= back) & (right >= LENGTH - back))
        fits = fits[in_company(suffix[fits])]
        if not len(fits):
            continue
        side[turn] = np.cumsum(turned < back)
        both = suffix[fits] * (len(own) + 1) + side[fits]
        inner = np.argsort(both)
        new = np.concatenate([[True], np.diff(both[inner]) != 0])
        first = np.minimum.reduceat(doc[fits][inner], np.flatnonzero(new))
        hit = np.zeros(len(fits), bool)
        hit[inner] = first[np.cumsum(new) - 1] < doc[fits][inner]
        mark[own[fits[hit]]] |= np.uint32(1 << back)
    return mark


def judge(table: pa.Table) -> pa.Table:
    """One bucket: marks of every sent suffix. What a block keeps for itself comes back as it is."""
    answers = table.column("rows")
    if table.column("bucket")[0].as_py() >= 0:
        lists = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, CONTEXT + 2) for x in table.column("rows")]
        least = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("least")])
        marks = found_before(np.concatenate(lists), least).astype("<u4")
        ends = np.cumsum([len(x) for x in lists])
        answers = pa.array([marks[b - len(x) : b].tobytes() for b, x in zip(ends, lists)], pa.binary())
    return pa.table(
        [table.column("block"), table.column("round"), table.column("bucket"), answers],
        names=["block", "round", "bucket", "answer"],
    )


def splitters(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> np.ndarray:
    """Leading words of suffixes at which buckets begin, from a bounded sample of texts."""
    total = docs.count()
    share = min(1.0, SAMPLE_TEXTS / max(total, 1))
    picked = docs.where(F.pmod(F.xxhash64(docs[id_col], F.lit("splitters")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def leading(batches):
        for batch in batches:
            data, rows = raw(batch.column(0))
            found = []
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                at = np.linspace(a, max(a, b - 8), SAMPLE_SUFFIXES).astype(int)
                found += [int.from_bytes(data[p : p + 8].tobytes().ljust(8, b"\0"), "big") >> 1 for p in at if b - a >= LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["leading"])

    text = picked.select(F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sample = text.mapInArrow(leading, "leading long")
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sample.agg(F.percentile_approx("leading", shares, 10 * buckets)).first()[0] if shares else []
    return np.unique(np.array(cuts or [], np.uint64) << np.uint64(1))


SENT = "block int, round int, bucket int, rows binary, least binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    dealt, cuts, total = blocked(docs, id_col, text_col)
    bits, buckets = hash_bits(total), len(cuts) + 1
    same = copies(docs, cuts, id_col, text_col)
    split = splitters(docs, buckets, id_col, text_col)

    def first(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = texts.column("block")[0].as_py()
        hashes = np.unique(Suffixes(texts, answers).hashes >> np.uint64(64 - bits))
        return asked_table(block, 1, list(ask(hashes, buckets, bits)))

    def second(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = texts.column("block")[0].as_py()
        own = Suffixes(texts, answers)
        own.repeated(answers, buckets, bits)
        own.contexts()
        lead = words_of(own.unique, 8)[0] if len(own.unique) else np.zeros(0, np.uint64)
        numbers, starts = np.unique(np.searchsorted(split, lead, side="right"), return_index=True)
        ends = [*starts[1:].tolist(), len(lead)]
        parts = [(2, n, own.unique[a:b], own.least[a:b]) for n, a, b in zip(numbers.tolist(), starts.tolist(), ends)]
        # The anchors themselves travel beside, so that the last round need not look for them again.
        parts.append((3, -1 - block, own.places(), np.zeros(0, np.int64)))
        return pa.table(
            [
                pa.array([block] * len(parts), pa.int32()),
                pa.array([kind for kind, _, _, _ in parts], pa.int32()),
                pa.array([n for _, n, _, _ in parts], pa.int32()),
                pa.array([rows.tobytes() for _, _, rows, _ in parts], pa.binary()),
                pa.array([least.astype("<i8").tobytes() for _, _, _, least in parts], pa.binary()),
            ],
            names=["block", "round", "bucket", "rows", "least"],
        )

    def third(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = Texts(texts, answers)
        two = answers.filter(pa.compute.equal(answers.column("round"), 2)).sort_by("bucket")
        marks = np.frombuffer(b"".join(x.as_py() for x in two.column("answer")), "<u4")
        kept = answers.filter(pa.compute.equal(answers.column("round"), 3)).column("answer")
        row, place, entry, later = np.frombuffer(b"".join(x.as_py() for x in kept), "<i4").reshape(4, -1).astype(np.int64)
        # An equal suffix with equal bytes before it stands in an earlier document of this block.
        mark = np.where(later > 0, np.uint32((1 << (LEFT + 1)) - 1), marks[entry]) if len(entry) else np.zeros(0, np.uint32)
        size = own.rows[row + 1] - own.rows[row] - place
        depth = np.zeros(len(own.data) + LENGTH + 1, np.int64)
        for back in range(LEFT + 1):
            fits = (mark >> np.uint32(back) & np.uint32(1)).astype(bool) & (place >= back) & (size >= LENGTH - back)
            starts = (own.rows[row] + place)[fits] - back
            np.add.at(depth, starts, 1)
            np.add.at(depth, starts + LENGTH, -1)
        gone = np.cumsum(depth)[: len(own.data)] > 0
        out = []
        for i in range(len(own.ids)):
            a, b = int(own.rows[i]), int(own.rows[i + 1])
            cut = np.full(b - a, True) if own.copy[i] and b - a >= LENGTH else gone[a:b]
            spans = int((np.diff(cut.astype(np.int8), prepend=0) == 1).sum())
            kept = hashlib.sha256(own.data[a:b][~cut].tobytes()).hexdigest()
            out.append((b - a, int(cut.sum()), spans, kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.table([texts.column("doc_id"), *columns], names=names)

    one = answered(together(dealt, same, first, ASKED))
    sent = together(dealt, same.unionByName(one), second, SENT)
    two = sent.groupBy("bucket").applyInArrow(judge, "block int, round int, bucket int, answer binary")
    return nulls_again(together(dealt, same.unionByName(one).unionByName(two), third, RESULT))
