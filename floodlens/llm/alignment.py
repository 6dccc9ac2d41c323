"""Alignment of two tokenizers, with corpus-wide scores from inverted pair bitmaps.

A text is cut where both tokenizers must cut (`segments`, checked against the pieces of the
second vocabulary), so ids, groups and links of a segment do not depend on its neighbours.
Each different segment of a step is encoded and aligned once: all ends of both tokenizers,
merged, cut the bytes into spans that lie in one token of either; each span is a link, and
an end of both closes a group.

A task inverts its documents block by block. For each linked id pair of a block it keeps a
compressed bitmap of the documents that hold it (a list of ordinals, or plain bits where
those are shorter), and planes of the same form for the binary digits of the multiplicity
less one. Bitmaps of the steps of a block are OR-merged by one sort. Blocks share no
document, so a pair's document count is the sum of the popcounts, and only those travel by
pair. Counts and the highest of each first id go back to the blocks, where the postings
hand them to their documents. A pair in a third of all documents is one row for each block.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no
tokens. Texts of any length are worked on in pieces. Repeated rows count each as a
document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.llm.common import STEP_BYTES, gather, id_and_text, per_worker, raw, steps
from floodlens.llm.segments import LETTER, SPACE, byte_encoder, segments, vocabulary
from floodlens.session import materialize

# A block closes at so many bytes of text, links of different (document, pair), or documents.
BLOCK_BYTES = 32 << 20
BLOCK_LINKS = 4_000_000
BLOCK_DOCS = 1 << 16
# Segments that a worker remembers; then it starts afresh. Bounds memory, not results.
REMEMBERED = 200_000
MANY = 0xFFFF

# How pieces write a space and a byte.
SPACE_MARK = "▁"
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


class Aligner:
    """Groups and links of segments, each different one worked out once while it is remembered."""

    def __init__(self, bytes_path: str, pieces_path: str, pattern: str) -> None:
        import sentencepiece

        ranks = vocabulary(bytes_path)
        self.first = byte_encoder(ranks, pattern).encode
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a_bytes = {i: token for token, i in ranks.items()}
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_size[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        count = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(count)]
        self.b_bytes = []
        for name in names:
            byte = BYTE_PIECE.fullmatch(name)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else name.replace(SPACE_MARK, " ").encode())
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        plain = [x for i, x in enumerate(names) if not (self.pieces.is_control(i) or self.pieces.is_unknown(i) or self.pieces.is_byte(i))]
        # Pieces may not reach over the places where `segments` cuts, nor over a line end.
        across = re.compile(rf"[^{SPACE_MARK}]{SPACE_MARK}|[A-Za-z][!-@\[-`{{-~]")
        self.cut = not any(across.search(x) for x in plain)
        held = set("".join(plain))
        if "\n" in held:
            raise ValueError("a piece holds a line end")
        # White space that pieces hold, as the \r of program texts, may stand inside a piece.
        self.space = SPACE.copy()
        self.space[[b for b in range(0x09, 0x0E) if chr(b) in held]] = False
        self.base = count
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.said: list[bytes] = []
        # Per segment: tokens of either, groups, start of its links; last the end of all links.
        self.sizes = np.zeros((0, 3), np.int64)
        self.good = np.zeros(0, bool)
        self.starts = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.uint32)

    def second(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces. The library puts a space before a text; behind a line end, which no piece
        holds, a segment stands as it is: the first two ids are that space and the line end."""
        lists = [x[2:] for x in self.pieces.encode(["\n" + x for x in texts], num_threads=1)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes

    def learn(self, new: list[bytes]) -> None:
        """Align segments that are not known."""
        texts = [x.decode() for x in new]
        a, a_count = self.first(texts)
        a = a.astype(np.int64)
        b, b_count = self.second(texts)
        length = np.fromiter(map(len, new), np.int64, len(new))
        b_segment = np.repeat(np.arange(len(new)), b_count)
        same = np.bincount(b_segment, self.b_size[b], len(new)).astype(np.int64) == length
        table, at = self.b_bytes, np.concatenate([[0], np.cumsum(b_count)]).tolist()
        ids = b.tolist()
        good = np.array(
            [ok and b"".join([table[i] for i in ids[x:y]]) == text for ok, text, x, y in zip(same.tolist(), new, at, at[1:])], bool
        )
        keep_a, keep_b = good[np.repeat(np.arange(len(new)), a_count)], good[b_segment]
        a, b, a_count, b_count = a[keep_a], b[keep_b], a_count * good, b_count * good
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(a_end, b_end)
        a_of = np.searchsorted(a_end, ends, side="left")
        b_of = np.searchsorted(b_end, ends, side="left")
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        # Where segments end, groups end.
        edge = np.cumsum(length * good)
        groups = np.diff(np.searchsorted(both, edge, side="right"), prepend=0)
        links = np.diff(np.searchsorted(ends, edge, side="right"), prepend=0)
        a_cut = [0, *np.searchsorted(a_end, both, side="right").tolist()]
        b_cut = [0, *np.searchsorted(b_end, both, side="right").tolist()]
        a_said, b_said = list(map(str, a.tolist())), list(map(str, b.tolist()))
        group = [
            ",".join(a_said[i:j]) + "|" + ",".join(b_said[k:m])
            for i, j, k, m in zip(a_cut, a_cut[1:], b_cut, b_cut[1:])
        ]
        group_at = np.concatenate([[0], np.cumsum(groups)]).tolist()
        number = len(self.said)
        self.said += [";".join(group[i:j]).encode() for i, j in zip(group_at, group_at[1:])]
        self.known.update(zip(new, range(number, number + len(new))))
        self.sizes = np.concatenate([self.sizes, np.stack([a_count, b_count, groups], axis=1)])
        self.good = np.concatenate([self.good, good])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(links)])
        self.links = np.concatenate([self.links, (a[a_of] * self.base + b[b_of]).astype(np.uint32)])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all segments, and the n + 1 places where rows begin."""
        if self.cut:
            data, starts, rows = segments(column, self.space)
        else:
            data, at = raw(column)
            starts = at[:-1][np.diff(at) > 0]
            rows = np.searchsorted(starts, at)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
        if len(self.known) > REMEMBERED:
            self.forget()
        ends = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]
        )
        coded = pc.dictionary_encode(pieces)
        texts = coded.dictionary.to_pylist()
        self.learn([x for x in texts if x not in self.known])
        number = np.fromiter(map(self.known.__getitem__, texts), np.int64, len(texts))
        return number[coded.indices.to_numpy(zero_copy_only=False)], rows


def pieces_of(batch: pa.RecordBatch, most: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each piece, pieces): the texts, the long ones in pieces cut before a space behind a letter."""
    column = batch.column(1)
    if column.nbytes <= 4 * most:
        yield np.arange(len(column)), column
        return
    data, rows = raw(column)
    able = np.flatnonzero((data[1:] == 0x20) & LETTER[data[:-1]]) + 1
    for row in range(len(column)):
        at, end = int(rows[row]), int(rows[row + 1])
        while at < end or (at == end and at == rows[row]):
            place = int(np.searchsorted(able, at + most))
            to = min(end, int(able[place])) if place < len(able) else end
            yield np.array([row]), pa.array([data[at:to].tobytes().decode()], pa.string())
            if to == end:
                break
            at = to


COLUMNS = {
    "kind": pa.int8(),
    "block": pa.int64(),
    "ordinal": pa.int32(),
    "doc_id": None,
    "n_a": pa.int64(),
    "n_b": pa.int64(),
    "n_groups": pa.int64(),
    "groups_sha256": pa.string(),
    "groups": pa.string(),
    "a": pa.int32(),
    "b": pa.int32(),
    "n": pa.int64(),
    "docs": pa.int32(),
    "entries": pa.binary(),
    "sparse": pa.binary(),
    "dense": pa.binary(),
}
DOC, PAIR, POSTINGS = 0, 1, 2
ENTRY = np.dtype([("pair", "<u4"), ("plane", "<u1"), ("dense", "?"), ("n", "<u4")])


def rows_of(id_type: pa.DataType, count: int, found: dict[str, object]) -> pa.RecordBatch:
    """A batch with the given columns, and nulls in the others."""
    columns = []
    for name, kind in COLUMNS.items():
        kind = kind or id_type
        value = found.get(name)
        if value is None:
            columns.append(pa.nulls(count, kind))
        elif np.isscalar(value):
            columns.append(pa.array([value] * count, kind))
        else:
            columns.append(value if isinstance(value, pa.Array) else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(columns, list(COLUMNS))


class Block:
    """Documents of one task that are inverted together."""

    def __init__(self, number: int, most: int) -> None:
        self.number, self.most, self.docs, self.bytes, self.links = number, most, 0, 0, 0
        # Pair (32 bits), ordinal (16), multiplicity (16; MANY: it stands in `many`).
        self.found: list[np.ndarray] = []
        self.many: dict[int, int] = {}

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or self.links >= BLOCK_LINKS or self.docs >= self.most

    def add(self, pair: np.ndarray, ordinal: np.ndarray, times: np.ndarray) -> None:
        keys = (pair << np.uint64(16) | ordinal.astype(np.uint64)) << np.uint64(16)
        self.found.append(keys | np.minimum(times, MANY).astype(np.uint64))
        high = times >= MANY
        self.many.update(zip(keys[high].tolist(), times[high].tolist()))
        self.links += len(pair)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, ordinals and multiplicities in order."""
        keys = np.concatenate([np.zeros(0, np.uint64), *self.found])
        self.found = []
        keys.sort()
        times = (keys & np.uint64(MANY)).astype(np.uint32)
        high = np.flatnonzero(times == MANY)
        times[high] = [self.many[k] for k in (keys[high] ^ np.uint64(MANY)).tolist()]
        return (keys >> np.uint64(32)).astype(np.uint32), (keys >> np.uint64(16)).astype(np.uint16), times

    def postings(self, id_type: pa.DataType, base: int) -> Iterator[pa.RecordBatch]:
        """The block's pairs with popcounts, and its bitmaps: presence as plane 0, then the planes of the
        multiplicity less one, from the lowest digit."""
        code, ordinal, times = self.merged()
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        pair = np.cumsum(new, dtype=np.int32) - 1
        codes = code[new].astype(np.int64)
        width = -(-self.docs // 8)
        entries, sparse, dense = [], [], []
        more = times - np.uint32(1)
        for plane in range(int(more.max(initial=0)).bit_length() + 1):
            have = slice(None) if not plane else (more >> np.uint32(plane - 1) & np.uint32(1)).astype(bool)
            own, place = pair[have], ordinal[have]
            edge = np.flatnonzero(np.diff(own, prepend=-1, append=len(codes)))
            who, n = own[edge[:-1]], np.diff(edge)
            entry = np.zeros(len(who), ENTRY)
            entry["pair"], entry["plane"], entry["n"], entry["dense"] = who, plane, n, 2 * n > width
            entries.append(entry)
            is_dense = np.repeat(entry["dense"], n)
            sparse.append(place[~is_dense].astype("<u2"))
            row = np.repeat(np.cumsum(entry["dense"]) - 1, n)[is_dense]
            bits = place[is_dense]
            for at in range(0, int(entry["dense"].sum()), 512):
                low, high = np.searchsorted(row, [at, at + 512])
                held = np.zeros((min(512, int(entry["dense"].sum()) - at), self.docs), bool)
                held[row[low:high] - at, bits[low:high]] = True
                dense.append(np.packbits(held, axis=1))
            if not plane:
                counted = {"kind": PAIR, "block": self.number, "a": codes // base, "b": codes % base, "n": n}
        if len(codes):
            yield rows_of(id_type, len(codes), counted)
        packed = [b"".join(x.tobytes() for x in part) for part in (entries, sparse, dense)]
        names = ("entries", "sparse", "dense")
        found = {"kind": POSTINGS, "block": self.number, "docs": self.docs}
        yield rows_of(id_type, 1, found | {k: pa.array([x], pa.binary()) for k, x in zip(names, packed)})


def linked(
    docs: DataFrame,
    bytes_path: str,
    pieces_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: bool = False,
    block_docs: int = BLOCK_DOCS,
    step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """Rows of documents, pairs and postings (COLUMNS), in one pass over the texts."""
    spaced = F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise(F.lit(""))
    plain = id_and_text(docs, id_col=id_col, text_col=text_col).select("doc_id", spaced.alias("text"))
    id_name = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = per_worker(f"aligner {bytes_path} {pieces_path}", lambda: Aligner(bytes_path, pieces_path, pattern))
        task = TaskContext.get().partitionId() << 32
        block, closed = Block(task, block_docs), 0
        sized = steps(batches, most=step_bytes)
        for batch in (x.slice(at, block_docs) for x in sized for at in range(0, len(x), block_docs)):
            count, id_type = len(batch), batch.column(0).type
            if block.docs and block.docs + count > block_docs:
                yield from block.postings(id_type, align.base)
                closed += 1
                block = Block(task + closed, block_docs)
            good = np.ones(count, bool)
            sizes = np.zeros((count, 3), np.int64)
            digest = [hashlib.sha256() for _ in range(count)]
            said: list[list[bytes]] = [[] for _ in range(count)]
            begun = np.zeros(count, bool)
            codes, rows = [], []
            for of, column in pieces_of(batch, step_bytes):
                number, at = align(column)
                own = np.repeat(of, np.diff(at))
                good &= np.bincount(own, ~align.good[number], count) == 0
                for k in range(3):
                    sizes[:, k] += np.bincount(own, align.sizes[number, k], count).astype(np.int64)
                flat, ends = number.tolist(), at.tolist()
                for i, row in enumerate(of.tolist()):
                    if ends[i] == ends[i + 1]:
                        continue
                    text = b";".join([align.said[x] for x in flat[ends[i] : ends[i + 1]]])
                    if begun[row]:
                        digest[row].update(b";")
                    begun[row] = True
                    digest[row].update(text)
                    if groups:
                        said[row].append(text)
                size = align.starts[number + 1] - align.starts[number]
                code = gather(align.links, align.starts[number], size).astype(np.uint64)
                keys, times = np.unique(np.repeat(own, size).astype(np.uint64) << np.uint64(32) | code, return_counts=True)
                codes.append(keys)
                rows.append(times)
            keys, times = np.concatenate(codes), np.concatenate(rows)
            if len(codes) > 1:  # a text in several pieces
                keys, inverse = np.unique(keys, return_inverse=True)
                times = np.bincount(inverse, times, len(keys)).astype(np.int64)
            row = (keys >> np.uint64(32)).astype(np.int64)
            good &= begun
            stay = good[row]
            block.add(keys[stay] & np.uint64(0xFFFFFFFF), row[stay] + block.docs, times[stay])
            sizes[~good] = 0
            found = {
                "kind": DOC,
                "block": block.number,
                "ordinal": np.arange(block.docs, block.docs + count),
                "doc_id": batch.column(0),
                "n_a": sizes[:, 0],
                "n_b": sizes[:, 1],
                "n_groups": sizes[:, 2],
                "groups_sha256": [d.hexdigest() if ok else "" for d, ok in zip(digest, good.tolist())],
            }
            if groups:
                found["groups"] = [b";".join(x).decode() if ok else "" for x, ok in zip(said, good.tolist())]
            yield rows_of(id_type, count, found)
            block.docs += count
            block.bytes += batch.column(1).nbytes
            if block.full():
                yield from block.postings(id_type, align.base)
                closed += 1
                block = Block(task + closed, block_docs)
        if block.docs:
            yield from block.postings(id_type, align.base)

    names = {pa.int8(): "tinyint", pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", None: id_name}
    return plain.mapInArrow(run, ", ".join(f"{name} {names[kind]}" for name, kind in COLUMNS.items()))


def scores(pairs: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many documents hold a linked pair, and whether no pair of its first
    id has more. pairs: a, b, n, a row for each block."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("documents"))
    counts = materialize(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def returned(own: pa.Table, scored: pa.Table) -> pa.Table:
    """The documents of one block with what their postings bring back."""
    kind = own.column("kind").to_numpy()
    held = own.filter(pa.array(kind == POSTINGS)).to_pylist()[0]
    rows = own.filter(pa.array(kind == DOC))
    docs = held["docs"]
    entry = np.frombuffer(held["entries"], ENTRY)
    order = np.lexsort((scored.column("b").to_numpy(), scored.column("a").to_numpy()))
    documents = scored.column("documents").to_numpy()[order]
    best = scored.column("best").to_numpy(zero_copy_only=False)[order]
    weight = np.where(entry["plane"] > 0, 1 << np.maximum(entry["plane"].astype(np.int64) - 1, 0), 1)
    gain = documents[entry["pair"]] * weight
    lead = np.where(best[entry["pair"]], weight, 0)
    total = [np.zeros(docs, np.int64) for _ in range(3)]

    def add(place: np.ndarray, of: np.ndarray) -> None:
        for out, values in zip(total, (weight, lead, gain)):
            np.add.at(out, place, values[of])

    few = np.flatnonzero(~entry["dense"])
    sparse = np.frombuffer(held["sparse"], "<u2").astype(np.int64)
    add(sparse, np.repeat(few, entry["n"][few]))
    many, width = np.flatnonzero(entry["dense"]), -(-docs // 8)
    bits = np.frombuffer(held["dense"], np.uint8).reshape(len(many), width)
    for at in range(0, len(many), 512):
        row, place = np.nonzero(np.unpackbits(bits[at : at + 512], axis=1, count=docs))
        add(place, many[at + row])
    ordinal = rows.column("ordinal").to_numpy()
    out = {name: rows.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups")}
    found = {name: pa.array(x[ordinal]) for name, x in zip(("n_links", "n_best", "count_sum"), total)}
    return pa.table(out | found)


def align(
    docs: DataFrame,
    bytes_path: str,
    pieces_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    groups: bool = False,
    block_docs: int = BLOCK_DOCS,
    step_bytes: int = STEP_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups_sha256, groups (ids of the groups as text,
    if asked for, else null), n_links, n_best, count_sum."""
    rows = linked(docs, bytes_path, pieces_path, pattern, id_col, text_col, groups, block_docs, step_bytes)
    rows = materialize(rows, "alignments")
    pairs = rows.where(F.col("kind") == PAIR).select("block", "a", "b", "n")
    scored = pairs.join(scores(pairs), ["a", "b"]).select(
        F.col("block").alias("to"), "a", "b", "documents", "best"
    )
    own = rows.where(F.col("kind") != PAIR).drop("a", "b", "n")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, "
        "n_links long, n_best long, count_sum long"
    )
    return own.groupBy("block").cogroup(scored.groupBy("to")).applyInArrow(returned, schema)


def pair_table(
    docs: DataFrame,
    bytes_path: str,
    pieces_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(a, b, documents, best) for all linked id pairs of a corpus."""
    rows = linked(docs, bytes_path, pieces_path, pattern, id_col, text_col)
    return scores(materialize(rows.where(F.col("kind") == PAIR).select("a", "b", "n"), "pairs"))
