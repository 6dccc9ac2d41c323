"""Document fingerprints from prefix polynomial hashes.

For a text, the array of prefix sums of code points times powers of a base, modulo a
prime, gives the hash of any span as one difference; two bases give 62 bits. Equal spans
have equal hashes wherever they stand, and the longest common extension of two places is
found by binary search over span hashes.

A fingerprint is the hash of the whole text and, for each of 64 classes of spans of 12
code points, the end of the least hash in it. Two fingerprints are alike to the share of
classes with equal entries, an estimate of the share of spans that the texts have in
common. Texts shorter than a span are one span; the empty text has none. Equal texts have
equal fingerprints, two empty texts are alike to 1, an empty and another one to 0.

Null texts are empty. Documents follow each other by doc_id, those with equal doc_id by
text, a null doc_id first; after the last comes the first. A single document follows
itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import id_and_text, mix64, part_of, parts_for, per_worker, range_cuts, steps

PRIME = (1 << 31) - 1
BASES = (1_000_003, 735_632_797)
SPAN = 12
CLASSES = 64
# Powers are kept for so many places; further ones are products of two.
TABLE = 1 << 16
LOWEST = np.iinfo(np.int64).min


def powers(base: int, places: np.ndarray) -> np.ndarray:
    """base^place modulo the prime."""

    def table() -> np.ndarray:
        found = np.ones(TABLE, np.uint64)
        done = 1
        while done < TABLE:
            found[done : 2 * done] = found[:done] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
            done *= 2
        return found

    low = per_worker(f"powers modulo {base}", table)
    if not len(places) or places[-1] < TABLE:
        return low[places]
    far = np.array([pow(base, k * TABLE, PRIME) for k in range(int(places[-1]) // TABLE + 1)], np.uint64)
    return low[places % TABLE] * far[places // TABLE] % np.uint64(PRIME)


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.length = len(points)
        places = np.arange(self.length + 1)
        self.sums, self.back = [], []
        for base in BASES:
            sums = np.zeros(self.length + 1, np.uint64)
            np.cumsum(points * powers(base, places[:-1]) % np.uint64(PRIME), out=sums[1:])
            self.sums.append(sums % np.uint64(PRIME))
            self.back.append(powers(pow(base, -1, PRIME), places))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of text[start:end]; equal spans have equal ones."""
        one, two = (
            (sums[ends] + np.uint64(PRIME) - sums[starts]) % np.uint64(PRIME) * back[starts] % np.uint64(PRIME)
            for sums, back in zip(self.sums, self.back)
        )
        return one << np.uint64(31) | two

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Code points that a from i and b from j have in common, by binary search."""
    low, high = 0, min(a.length - i, b.length - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(text: Prefixes) -> np.ndarray:
    """For each class the end of its least span hash; 0 where it has no span."""
    if not text.length:
        return np.zeros(CLASSES, np.uint32)
    starts = np.arange(max(1, text.length - SPAN + 1))
    mixed = mix64(text.spans(starts, np.minimum(starts + SPAN, text.length)))
    least = np.full(CLASSES, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (mixed >> np.uint64(58)).astype(np.int64), mixed << np.uint64(6))
    ends = (mix64(least) % np.uint64(0xFFFF)).astype(np.uint32) + 1
    return np.where(least == np.iinfo(np.uint64).max, 0, ends).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    some = (a > 0) | (b > 0)
    return float(((a == b) & some).sum() / some.sum()) if some.any() else 1.0


def written(text: Prefixes, classes: np.ndarray) -> str:
    return f"{text.span(0, text.length):016x}" + "".join(f"{x:04x}" for x in classes.tolist())


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(part, tail, key, doc_id, text): documents dealt to ranges of doc_id, and to each range the
    document that follows its last one, marked as tail."""
    plain = id_and_text(docs, id_col=id_col, text_col=text_col)
    kind = plain.schema["doc_id"].dataType.simpleString()
    cuts = range_cuts(plain, "doc_id", parts_for(docs, text_col))
    keys = plain.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = part_of(batch.column(0).to_numpy(), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0)], ["part", "key"])

    # One row for each range that has documents.
    heads = keys.mapInArrow(ranged, "part int, key long").groupBy("part").agg(F.min("key")).orderBy("part").collect()
    before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}
    first = np.array(sorted(before), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "tail", "key", "doc_id", "text"]
        for batch in batches:
            key = batch.column(0).to_numpy()
            head = np.flatnonzero(np.isin(key, first))
            for rows, part, tail in (
                (np.arange(len(key)), part_of(key, cuts), False),
                (head, np.array([before[k] for k in key[head].tolist()], np.int32), True),
            ):
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array([tail] * len(rows), pa.bool_()), *own.columns], names
                )

    keyed = plain.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), "doc_id", "text")
    dealt = keyed.mapInArrow(deal, f"part int, tail boolean, key long, doc_id {kind}, text string")
    return dealt.repartition("part").sortWithinPartitions("part", "tail", "key", "text"), len(heads)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its fingerprint and that of its edited text, whose last half is replaced
    by the beginning of the next document; how alike they are to each other and to the next one's,
    and how many code points they begin with in common."""
    dealt, _ = with_next(docs, id_col, text_col)
    kind = dealt.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, common_edited long, common_next long"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.int64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last document of a part that has not met its next one
        for batch in steps(batches):
            whose, out = [], []
            columns = (batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text"))
            for part, tail, doc, text in zip(*columns):
                own = Prefixes(text)
                classes = sketch(own)
                print_ = written(own, classes)
                if held is not None and held[0] == part:
                    _, doc_, text_, own_, classes_, print_held = held
                    n = len(text_)
                    edited = text_[: n - n // 2] + text[: n // 2]
                    changed = Prefixes(edited)
                    changed_classes = sketch(changed)
                    whose.append(doc_)
                    out.append(
                        (
                            n,
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            print_held,
                            written(changed, changed_classes),
                            likeness(classes_, changed_classes),
                            likeness(classes_, classes),
                            common_extension(own_, 0, changed, 0),
                            common_extension(own_, 0, own, 0),
                        )
                    )
                held = None if tail else (part, doc, text, own, classes, print_)
            if out:
                rows = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(whose, batch.column("doc_id").type), *rows], names)

    return dealt.mapInArrow(run, schema)
