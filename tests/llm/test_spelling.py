"""Spelling variants against a plain version over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from floodlens.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(word):
    """All strings that a word gives by leaving one letter out, or marking one as any."""
    skipped = {word[:i] + word[i + 1 :] for i in range(len(word))}
    marked = {word[:i] + "?" + word[i + 1 :] for i in range(len(word))}
    return skipped, marked


def plain(rows, letters=5, least=3):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    by_mark = {}
    near = {w: set() for w in counts}
    for w in counts:
        skipped, marked = one_edit(w)
        for s in skipped & counts.keys():
            near[w].add(s)
            near[s].add(w)
        for m in marked:
            by_mark.setdefault(m, []).append(w)
    for same in by_mark.values():
        for w in same:
            near[w] |= set(same) - {w}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, n, len(near[w]), forms[w], counts.get(forms[w]), root))
    return sorted(out)


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = found(queries.QUERIES["op12_spelling_variants"](spark, data))
    assert got == plain(rows)
    assert any(r[3] for r in got)


def docs_of(spark, rows):
    schema = "doc_id BIGINT, text STRING, word STRING, n BIGINT, id BIGINT, path STRING, prefix INT, `range` INT"
    return spark.createDataFrame([(i, t, "w", 1, 2, "p", 3, 4) for i, t in rows], schema).repartition(3)


def crowd():
    rng = random.Random(5)
    words = []
    for _ in range(60):
        word = "".join(rng.choice("aabé") for _ in range(rng.randint(4, 9)))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(word) + 1)
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abéÀ") + word[at:]])
            words += [word] * rng.choice([1, 3, 3, 6, 7, 14, 30])
    rng.shuffle(words)
    return words


@pytest.mark.parametrize("width", [1 << 17, 9])
def test_many_near_words(spark, width, monkeypatch):
    """Runs of equal letters, ties, and tries cut into many ranges."""
    monkeypatch.setattr(spelling, "RANGE", width)
    words = crowd()
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    got = found(spelling.variants(docs_of(spark, rows)))
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 100 and any(r[5] != r[3] for r in got if r[3])


def test_odd_texts(spark):
    long = "ab" * 30000
    rows = [
        (None, "Äpfel äpfel ÄPFEL Äpfel"),
        (1, None),
        (2, ""),
        (3, "hello hello hello hello hellö hellö hellö HELLO-helloo helloo helloo"),
        (3, "hello hello hello hello hellö hellö hellö HELLO-helloo helloo helloo"),
        (4, "日本語" * 2000 + " wörter wörter wörter naïve x÷y×z"),
        (5, " ".join([long, long, long[1:], long[1:], long, long[1:]])),
        (6, "word" * 9 + "1" + "a" * 4 + " aaaaa aaaaaa aaaaaaa aaaaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaaa"),
        (7, "words " * 300000),
    ]
    got = found(spelling.variants(docs_of(spark, rows)))
    short = [(i, None if t is None else t.replace(long, "").replace(long[1:], "")) for i, t in rows]
    counts = Counter(w for w, *_ in got)
    assert max(counts.values()) == 1
    assert [r for r in got if len(r[0]) < 1000] == plain(short)
    assert {(len(r[0]), r[1], r[2]) for r in got if len(r[0]) > 1000} <= {(59999, 3, 1), (60000, 3, 1), (59999, 3, 0), (60000, 3, 0)}
    assert found(spelling.variants(docs_of(spark, []))) == []


def test_pieces_of_a_text_cut_no_word():
    text = ("abc" * 7 + " " + "d" * 50 + "é,").encode() * 50
    whole = spelling.RUNS.findall(text)
    size, spelling.STEP_BYTES = spelling.STEP_BYTES, 64
    try:
        assert [w for some in spelling.runs(text) for w in some] == whole
    finally:
        spelling.STEP_BYTES = size
