"""Language of texts and of spans in mixed-language texts.

Learning counts letter n-grams (one to three letters, with word borders) and scripts for
each language over a bounded sample of labelled rows, spread evenly by hash and drawn for
each language separately. The model is a table of fixed size: hashed n-grams times
languages, plus the scripts that each language is written in.

A text's words are its runs of letters. The script ranges of a word's letters narrow the
languages to those that were seen in these scripts. Each word gets a score for each of
them, the log-likelihood of its n-grams, and the Viterbi path with a penalty for every
switch labels the words; neighbours with one label form a span. The text's language is
the one with the most letters, its score the share of letters in that language's spans.

Texts without a letter, null texts, and all texts where nothing was learned are `und`
with score 0. Ties go to the language that comes first in order. Whole texts are
labelled; text is the only input. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from floodlens.llm.common import mix64, per_worker, steps

# Labelled rows of a language that the model learns from, at most (give or take the
# evenness of the hash).
SAMPLE_ROWS = 4000
BINS = 1 << 15
# Text bytes that are labelled at a time: tables of n-gram scores are many times their size.
LABEL_BYTES = 1 << 20
# Natural-log cost of changing the language between two words.
SWITCH = 8.0
# A language is a candidate in a script that at least this share of its letters has.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
# The pipeline rejects texts in which no language has this share of the letters.
MIN_SHARE = 0.3

# First and last code points of scripts, by Unicode blocks.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
NAMES = list(dict.fromkeys(name for name, *_ in SCRIPTS)) + ["other"]


def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, its lower case, its script."""
    size = 0x110000
    letter, lower = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
    for point in range(size):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            letter[point] = True
            small = char.lower()
            if len(small) == 1:
                lower[point] = ord(small)
    script = np.full(size, len(NAMES) - 1, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return letter, lower, script


class Words:
    """The words of a batch of texts: places, rows, n-gram bins and scripts of their letters."""

    def __init__(self, texts: list[str]) -> None:
        letter, lower, script = per_worker("letter tables", letter_tables)
        sizes = np.array([len(x) for x in texts], np.int64)
        self.rows = np.concatenate([[0], np.cumsum(sizes + 1)])  # a line end closes each text
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        own = letter[points]
        edge = np.diff(own.astype(np.int8), prepend=0, append=0)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.row = np.searchsorted(self.rows, self.begin, side="right") - 1
        self.size = self.end - self.begin
        self.first = np.cumsum(self.size) - self.size  # each word's first letter among all letters
        letters = lower[points[own]].astype(np.uint64)
        self.script = script[points[own]]
        self.bins = self.grams(letters)

    def grams(self, letters: np.ndarray) -> list[np.ndarray]:
        """Bins of the one-, two- and three-letter grams that end at each letter, and of the pair
        that each word ends with; zero stands before a word."""
        back = np.zeros(len(letters), np.int64)
        back[self.first] = 1
        before = np.concatenate([[0], letters[:-1]]).astype(np.uint64)
        before[self.first] = 0
        third = np.concatenate([[0, 0], letters[:-2]]).astype(np.uint64)[: len(letters)]
        third[self.first] = 1  # tells a word's first letter from its second
        second = self.first + 1
        second = second[second < len(letters)]
        third[second] = 0
        last = self.first + self.size - 1
        bits = np.uint64(64 - (BINS - 1).bit_length())
        pair = before << np.uint64(21) | letters
        return [
            (mix64(letters + np.uint64(1 << 62)) >> bits).astype(np.int32),
            (mix64(pair + np.uint64(1 << 61)) >> bits).astype(np.int32),
            (mix64(third << np.uint64(42) | pair) >> bits).astype(np.int32),
            (mix64((letters[last] << np.uint64(21) | before[last]) + np.uint64(3 << 61)) >> bits).astype(np.int32),
        ]


@dataclass
class Model:
    """Languages in order, log-likelihoods (bins, languages), candidates (scripts, languages)."""

    languages: list[str]
    logs: np.ndarray
    scripts: np.ndarray


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """From rows (key, text, lang) with a language. Only counts come to the driver: rows of each
    language, then BINS and the scripts for each."""
    sizes = labelled.groupBy("lang").count().orderBy("lang").collect()
    languages = [x[0] for x in sizes]
    number = {x: i for i, x in enumerate(languages)}
    width = BINS + len(NAMES)
    if not languages:
        return Model([], np.zeros((BINS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for lang, n in sizes for x in (lang, min(1.0, sample_rows / n))])
    spread = F.pmod(F.xxhash64("key", F.lit("language sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = labelled.where(spread < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), width), np.int64)
        for batch in steps(batches, most=LABEL_BYTES):
            words = Words(batch.column(1).to_pylist())
            if not len(words.begin):
                continue
            of_row = np.array([number[x] for x in batch.column(0).to_pylist()])
            of_word = of_row[words.row]
            of_letter = np.repeat(of_word, words.size)
            for bins, langs in zip(words.bins, (of_letter, of_letter, of_letter, of_word)):
                counts += np.bincount(langs * width + bins, minlength=counts.size).reshape(counts.shape)
            place = of_letter * width + BINS + words.script
            counts += np.bincount(place, minlength=counts.size).reshape(counts.shape)
        lang, bins = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(bins, pa.int32()), pa.array(counts[lang, bins])],
            ["lang", "bin", "n"],
        )

    counted = sample.mapInArrow(count, "lang int, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), width))
    for lang, at, n in counted.collect():
        table[lang, at] = n
    grams, scripts = table[:, :BINS] + 0.5, table[:, BINS:]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    seen = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.ascontiguousarray(logs), (seen & (scripts > 0)).T)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log-likelihood (words, languages); languages that a word's scripts rule out get a low one."""
    one, two, three, last = words.bins
    each = model.logs[one]
    each += model.logs[two]
    each += model.logs[three]
    scores = np.add.reduceat(each, words.first, axis=0) + model.logs[last]
    able = np.logical_and.reduceat(model.scripts[words.script], words.first, axis=0)
    able |= ~able.any(axis=1, keepdims=True)  # no language has such a word: the n-grams decide
    scores[~able] -= 1e4
    return scores


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of all words. Texts run side by side, longest first: step t treats word t of each."""
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    longest = int(counts[0]) if len(counts) else 0
    alive = np.searchsorted(-counts, -np.arange(longest), side="left")  # texts with more than t words
    best = scores[starts].copy()
    came = np.zeros(scores.shape, np.uint8)
    for t in range(1, longest):
        n = alive[t]
        held = best[:n]
        top = held.argmax(axis=1)
        change = held[np.arange(n), top] - switch
        stay = held >= change[:, None]
        at = starts[:n] + t
        came[at] = np.where(stay, np.arange(scores.shape[1]), top[:, None])
        best[:n] = scores[at] + np.where(stay, held, change[:, None])
    current = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        labels[at] = current[:n]
        current[:n] = came[at, current[:n]] if t else current[:n]
    return labels


SPANS = ArrayType(StructType().add("start", "integer").add("end", "integer").add("lang", "string"))


@dataclass
class Labels:
    """Of a batch of texts: the language's number (the number of languages: none), its share of the
    letters, and spans as rows, places and language numbers."""

    found: np.ndarray
    score: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    lang: np.ndarray


def labels_of(texts: list[str], model: Model, switch: float) -> Labels:
    words = Words(texts)
    rows, kinds = len(texts), len(model.languages)
    none = np.zeros(0, np.int64)
    if not len(words.begin) or not kinds:
        return Labels(np.full(rows, kinds), np.zeros(rows), none, none, none, none)
    counts = np.bincount(words.row, minlength=rows)
    some = np.flatnonzero(counts)
    starts = np.cumsum(counts)[some] - counts[some]
    best = viterbi(word_scores(words, model), starts, counts[some], switch)
    letters = np.bincount(words.row * kinds + best, words.size, rows * kinds).reshape(rows, kinds)
    total = letters.sum(axis=1)
    found = np.where(total > 0, letters.argmax(axis=1), kinds)
    score = letters.max(axis=1) / np.maximum(total, 1)
    change = np.flatnonzero((np.diff(best, prepend=-1) != 0) | (np.diff(words.row, prepend=-1) != 0))
    until = np.append(change[1:], len(best)) - 1
    row = words.row[change]
    return Labels(
        found, score, row, words.begin[change] - words.rows[row], words.end[until] - words.rows[row], best[change]
    )


def label(docs: DataFrame, model: Model, switch: float = SWITCH, *keep: Column) -> DataFrame:
    """keep, then lang_pred, score, and spans (code points, end exclusive, language) of docs' text."""
    plain = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"), *keep)
    added = StructType().add("lang_pred", "string").add("score", "double").add("spans", SPANS)
    schema = StructType([*plain.schema.fields[1:], *added.fields])
    languages = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=LABEL_BYTES):
            made = labels_of(batch.column(0).to_pylist(), model, switch)
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(made.begin.astype(np.int32)),
                    pa.array(made.end.astype(np.int32)),
                    pa.array(languages[made.lang], pa.string()),
                ],
                ["start", "end", "lang"],
            )
            offsets = np.searchsorted(made.row, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(languages[made.found], pa.string()),
                    pa.array(made.score),
                    pa.ListArray.from_arrays(pa.array(offsets), spans),
                ],
                [*batch.schema.names[1:], "lang_pred", "score", "spans"],
            )

    return plain.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that learning leaves out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn_fold(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from all folds but the held-out one."""
    own = docs.where(~held_out(docs["doc_id"]) & docs["lang"].isNotNull())
    rows = own.select(docs["doc_id"].alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"), docs["lang"])
    return learn(rows, sample_rows)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, switch: float = SWITCH) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, spans."""
    model = learn_fold(docs, sample_rows)
    return label(docs, model, switch, docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"))


def drop_unidentified(docs: DataFrame, min_share: float = MIN_SHARE, switch: float = SWITCH) -> DataFrame:
    """docs without those that have no letter or no language with a share of min_share. Only the text
    goes to Python and only a verdict comes back; rows and their columns stay as they are."""
    model = learn_fold(docs)

    @F.arrow_udf("boolean")
    def known(column: pa.Array) -> pa.Array:
        verdicts = []
        for batch in steps(iter([pa.RecordBatch.from_arrays([column], ["text"])]), most=LABEL_BYTES):
            made = labels_of(batch.column(0).to_pylist(), model, switch)
            verdicts.append((made.found < len(model.languages)) & (made.score >= min_share))
        return pa.array(np.concatenate([np.zeros(0, bool), *verdicts]))

    return docs.where(known(F.coalesce(docs["text"], F.lit(""))))
