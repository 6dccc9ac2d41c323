"""Encoding with each different piece of text encoded once.

Every pre-tokeniser used here must cut between a character that is not white space and a
following ASCII white space, and between a letter and a following ASCII sign or digit. Cut
at such places, a text is a list of segments whose ids are independent of each other. A batch's segments are dictionary-encoded by Arrow, only
unknown entries are encoded, and ids are gathered by index.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

from floodlens.llm.common import gather, raw

# Entries that a worker remembers; then it starts afresh. Bounds memory, not results.
REMEMBERED = 200_000
# Segments over this size are encoded each time.
REMEMBERED_BYTES = 64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGN = np.zeros(256, bool)
SIGN[0x21:0x7F] = ~LETTER[0x21:0x7F]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def segments(column: pa.Array, before_which: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, starts of segments, and the index of each row's first segment (n + 1).
    before_which: the white space bytes before which is cut."""
    data, rows = raw(column)
    space = before_which[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before = data[:-1]
        # What stands before must surely be no white space: ASCII, or two bytes from U+00C0 on.
        sure = (before > 0x20) & (before < 0x7F)
        sure[1:] |= (before[1:] >= 0x80) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
        cut[1:-1] = space[1:] & sure | LETTER[before] & SIGN[data[1:]]
    full = rows[:-1][np.diff(rows) > 0]
    cut[full] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    return data, starts, np.searchsorted(starts, rows)


class Encoder:
    """Ids of string columns. `encode` maps a list of segments to all their ids in a row and the
    number of ids of each; `fold` lower-cases A-Z first, for vocabularies that do so anyway."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], fold: bool = False) -> None:
        self.encode, self.fold = encode, fold
        self.known: dict[str, bytes] = {}

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 places where rows begin."""
        data, starts, rows = segments(column)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        data = LOWER[data] if self.fold else data
        ends = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))
        coded = pc.dictionary_encode(pieces)
        texts = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known = {}
        found = list(map(self.known.get, texts))
        missing = [i for i, x in enumerate(found) if x is None]
        new, counts = self.encode([texts[i] for i in missing])
        whole, at = new.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        for i, a, b in zip(missing, [0, *at], at):
            found[i] = whole[a:b]
            if len(texts[i]) <= REMEMBERED_BYTES:
                self.known[texts[i]] = found[i]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[index]
        ids = gather(flat, (np.cumsum(sizes) - sizes)[index], lengths)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[rows]


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for
    themselves, the others for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str, word_end: str = "", mark: bytes = b"") -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary whose ids ascend in the order of its merges. A word
    end becomes one byte, `mark`, which texts encoded this way must not contain."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"] for x in model["added_tokens"]}
    letters = byte_letters()
    ranks: dict[bytes, int] = {}
    for token, number in model["model"]["vocab"].items():
        if token in special:
            continue
        ended = bool(word_end) and token.endswith(word_end) and token != word_end
        body = bytes(letters[c] for c in (token[: -len(word_end)] if ended else token))
        if mark and mark in body and len(body) > 1:
            continue
        ranks[body + (mark if ended else b"")] = number
    return ranks


def byte_encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """Byte-level BPE on the matches of a pattern; special tokens are ordinary text."""
    one = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return Encoder(lambda texts: joined([one(x) for x in texts]))


# The pre-tokeniser of the word vocabulary, and its word end.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
WORD_END = "</w>"


def word_encoder(path: str) -> Encoder:
    """BPE with word ends, lower case, white space dropped. Segments of plain Latin letters
    and ASCII go by ranks; whatever else needs Unicode rules goes to the file's own library.

    All plain words are encoded as one string: the ids with a word end tell them apart."""
    import tokenizers

    ranks = vocabulary(path, WORD_END, b"\x00")
    one = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    words = regex.compile(WORD_PATTERN).findall
    plain = regex.compile("[\t-\r -~À-ÿ]*").fullmatch
    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    last = np.zeros(max(ranks.values()) + 1, bool)
    last[[number for token, number in ranks.items() if len(token) > 1 and token.endswith(b"\x00")]] = True

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, number, other = [], np.zeros(len(texts), np.int64), {}
        for i, text in enumerate(texts):
            word = text[1:]
            if word.isascii() and word.isalpha() and text[0] == " ":
                pieces.append(word.lower())
                number[i] = 1
            elif plain(text):
                found = words(text.lower())
                pieces += found
                number[i] = len(found)
            else:
                other[i] = own.encode(text, add_special_tokens=False).ids
        ids = np.array(one("\x00".join([*pieces, ""])), np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(last[ids]) + 1])
        if len(ends) != len(pieces) + 1:
            raise ValueError("a word has no end")
        bounds = ends[np.concatenate([[0], np.cumsum(number)])]
        if not other:
            return ids, np.diff(bounds)
        parts = np.split(ids, bounds[1:-1])
        return joined([other.get(i, part) for i, part in enumerate(parts)])

    return Encoder(encode, fold=True)
