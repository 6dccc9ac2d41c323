"""Every corpus query against a plain version of its contract, over whole tables."""

from collections import defaultdict

import brute
import pytest

from floodlens.llm import queries


@pytest.fixture(scope="module")
def documents(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text or "") for r in rows]


def result(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


def test_op1(spark, data, documents):
    rows = result(spark, data, "op1_prefix_fingerprints")
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == brute.edited(documents)
    texts = dict(documents)
    by_print = defaultdict(set)
    for r in rows:
        by_print[r.fingerprint].add(texts[r.doc_id])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in by_print.values())
    assert len(by_print) == len(set(texts.values()))
    long = [r for r in rows if r.n_chars > 200]
    assert sum(r.near_edited for r in long) / len(long) > 0.25
    assert sorted(r.near_next for r in long)[len(long) // 2] < 0.15


def test_op2(spark, data, documents):
    rows = result(spark, data, "op2_simhash_near_dedup")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == brute.near_components(documents)


def test_op3(spark, data, documents):
    rows = {r.doc_id: r for r in result(spark, data, "op3_secret_scan")}
    for doc, text in documents:
        spans = brute.base_spans(text)
        said = [f"{kind}:{a}:{b}" for a, _, kind, b, _ in spans]
        r = rows[doc]
        assert r.base_sha256 == brute.sha(",".join(said).encode())
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k[0] for s in spans) for k in brute.KINDS]
        assert set(said) <= set(r.spans.split(","))


def test_op4(spark, data, documents):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = result(spark, data, "op4_language_id")
    assert len(rows) == len(documents)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_op5(spark, data, documents):
    own = brute.byte_bpe()
    rows = {r.doc_id: tuple(r)[1:] for r in result(spark, data, "op5_byte_bpe_chunks")}
    for doc, text in documents:
        ids = own.encode_ordinary(text)
        assert rows[doc] == (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(text.encode()))


def test_op6(spark, data, documents):
    assert sorted(tuple(r) for r in result(spark, data, "op6_substring_dedup")) == sorted(brute.passages(documents))


def test_op7(spark, data, documents):
    own = brute.tokenizer("word_bpe_49k.json")
    rows = {r.doc_id: tuple(r)[1:] for r in result(spark, data, "op7_token_files")}
    start = 0
    for doc, text in documents:
        ids = [*own.encode(text, add_special_tokens=False).ids, 1]
        assert rows[doc] == (start, len(ids), brute.crc(ids))
        start += len(ids)


def packed_right(rows, documents):
    own = brute.tokenizer("byte_bpe_50k.json")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in documents:
        ids = [*own.encode(text, add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == brute.crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = 0
    for own_rows in sequences.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / sum(r.length for r in rows)


def test_op8(spark, data, documents):
    assert packed_right(result(spark, data, "op8_pack_sequences"), documents) < 0.02


def test_op9(spark, data, documents):
    assert sorted(tuple(r) for r in result(spark, data, "op9_suffix_dedup")) == sorted(brute.byte_strings(documents))


def test_op10(spark, data, documents):
    groups = defaultdict(list)
    for doc, text in documents:
        groups[brute.re.sub("[A-Z]", lambda m: m[0].lower(), text)].append(doc)
    expected = [
        (doc, max(docs), len(docs), doc == max(docs), brute.sha(text.encode()))
        for text, docs in groups.items()
        for doc in docs
    ]
    assert sorted(tuple(r) for r in result(spark, data, "op10_exact_dedup")) == sorted(expected)
