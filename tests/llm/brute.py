"""The contracts of the corpus queries, done plainly in one process."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def edited(rows):
    """rows: (doc_id, text) in order."""
    out = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        out[doc] = (len(text), sha((text[: len(text) - half] + after[:half]).encode()))
    return out


def simhash(text: str) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def near_components(rows):
    prints = {doc: simhash(text) for doc, text in rows}
    points = sorted(set(prints.values()))
    up = {p: p for p in points}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for doc, p in prints.items():
        root = find(p)
        least[root] = min(least.get(root, doc), doc)
    return {doc: (f"{p:016x}", least[find(p)]) for doc, p in prints.items()}


KINDS = [
    ("assign", re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def base_spans(text: str):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), rank, kind, m.end(), m[group]))
    return sorted(found)


def byte_bpe():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(name: str) -> Tokenizer:
    own = Tokenizer.from_file(public_tokenizers.path(name))
    own.encode_special_tokens = True
    return own


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def passages(rows, size: int = 35):
    """rows: (doc_id, text), one for each row."""
    words = [WORD.findall(text) for _, text in rows]
    counts = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if counts[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), sha(kept.encode())))
    return out


def byte_strings(rows, size: int = 50):
    texts = [text.encode() for _, text in rows]
    least = {}
    for (doc, _), t in zip(rows, texts):
        for i in range(len(t) - size + 1):
            s = t[i : i + size]
            least[s] = min(least.get(s, doc), doc)
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if least[t[i : i + size]] < doc:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), spans, sha(kept)))
    return out
