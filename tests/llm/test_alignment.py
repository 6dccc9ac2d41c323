"""Alignment of two tokenizers against a plain version with the libraries themselves."""

import random
from collections import Counter

import brute
import public_tokenizers
import pytest
import sentencepiece

from floodlens.llm import alignment, queries
from floodlens.llm.segments import byte_letters

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain(rows):
    """(doc, text) to the columns of the query."""
    first = brute.tokenizer("byte_bpe_50k.json")
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = byte_letters()

    def piece(i):
        name = second.id_to_piece(i)
        if second.is_byte(i):
            return bytes([int(name[3:5], 16)])
        return name.replace("▁", " ").encode()

    found = []
    for doc, text in rows:
        whole = (" " + text).encode() if text else b""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [piece(i) for i in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            found.append((doc, [], [], [], []))
            continue
        i = j = a_at = b_at = start_a = start_b = 0
        groups, links = [], []
        while i < len(a):
            links.append((a[i], b[j]))
            a_end, b_end = a_at + len(a_bytes[i]), b_at + len(b_bytes[j])
            if a_end <= b_end:
                i, a_at = i + 1, a_end
            if b_end <= a_end:
                j, b_at = j + 1, b_end
            if a_at == b_at:
                groups.append(",".join(map(str, a[start_a:i])) + "|" + ",".join(map(str, b[start_b:j])))
                start_a, start_b = i, j
        found.append((doc, a, b, groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for doc, a, b, groups, links in found:
        best = sum(counts[p] == most[p[0]] for p in links)
        said = brute.sha(";".join(groups).encode()) if groups else ""
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), said))
    return sorted(out, key=str), counts


def tuples(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert tuples(queries.QUERIES["op13_token_alignment"](spark, data)) == plain(rows)[0]


def odd_rows():
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("etaoinsé") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    return [
        (0, None),
        (1, ""),
        (2, " "),
        (3, "   two  spaces , and\ttabs \n\n lines\r\n end  "),
        (4, "<s> </s> <unk> <|endoftext|> [INST]"),
        (5, "▁ a mark of its own"),
        (6, "日本語のテキスト und Äpfel, naïve 𝔘𝔫𝔦 　 x"),
        (7, "\x00\x1c\x85 odd"),
        (8, "don't you'll A.B.C. 12,345.67 x=y;z"),
        (8, "don't you'll A.B.C. 12,345.67 x=y;z"),
        (9, "word " * 70000),
        (10, long),
        (None, "x" * 3000 + long[:300]),
        (11, long.replace(" ", "")),
    ]


def frame(spark, rows):
    schema = "doc_id BIGINT, text STRING, a INT, b INT, n BIGINT, block BIGINT, kind INT, docs STRING, best INT"
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "d", 6) for i, t in rows], schema).repartition(3)


@pytest.mark.parametrize("limits", [{}, {"block_docs": 3, "step_bytes": 4096}])
def test_odd_texts(spark, limits):
    """With limits: blocks of a few documents, and texts in many pieces."""
    rows = odd_rows()
    want, counts = plain(rows)
    docs = frame(spark, rows)
    found = alignment.align(docs, *PATHS, public_tokenizers.PATTERN, groups=True, **limits)
    assert tuples(found) == want
    assert all(brute.sha(r.groups.encode()) == r.groups_sha256 or not r.groups for r in found.collect())
    pairs = alignment.pair_table(docs, *PATHS, public_tokenizers.PATTERN).collect()
    assert {(r.a, r.b): r.documents for r in pairs} == counts
    assert alignment.align(frame(spark, []), *PATHS, public_tokenizers.PATTERN).collect() == []
