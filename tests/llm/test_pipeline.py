"""The pipeline, stage by stage, against plain versions of its stages."""

from collections import defaultdict

import brute
import pytest
from test_corpus_queries import packed_right

import corpus_pipeline
from floodlens.session import materialize


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], data), "stage"))
    return tables


def texts(df):
    return sorted((r.doc_id, r.text or "") for r in df.collect())


def test_all_stages_but_the_last_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID",
        "exact dedup",
        "SimHash near-dedup",
        "secret scans",
        "packing",
    ]
    assert all(t.schema == stages[0].schema for t in stages[1:-1])


def test_clean_documents_pass_language_id(stages):
    before, after = dict(texts(stages[0])), dict(texts(stages[1]))
    gone = {d: t for d, t in before.items() if d not in after}
    assert all(not any(c.isalpha() for c in t) for t in gone.values())
    assert all(after[d] == before[d] for d in after)


def test_one_of_equal_texts_stays(stages):
    groups = defaultdict(list)
    for doc, text in texts(stages[1]):
        groups[brute.re.sub("[A-Z]", lambda m: m[0].lower(), text)].append(doc)
    assert [d for d, _ in texts(stages[2])] == sorted(map(max, groups.values()))


def test_one_of_near_copies_stays(stages):
    found = brute.near_components(texts(stages[2]))
    assert [d for d, _ in texts(stages[3])] == sorted({c for _, c in found.values()})


def test_live_values_are_masked(stages):
    rows = {r.doc_id: r for r in stages[3].collect()}
    owners, places = defaultdict(set), defaultdict(set)
    for doc, r in rows.items():
        for *_, value in brute.base_spans(r.text):
            owners[value].add(r.source)
            places[value].add(doc)
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(after) == set(rows)
    masked = 0
    for doc, r in rows.items():
        spans = sorted(
            {
                (end - len(value), end)
                for _, _, _, end, value in brute.base_spans(r.text)
                if len(owners[value]) <= 1 and len(places[value]) <= 3 and len(set(value)) >= 6
            }
        )
        out, at = "", 0
        for a, b in spans:
            if b > at:
                out, at = out + r.text[at : max(at, a)] + "[secret]", b
        out += r.text[at:]
        assert after[doc].text == out
        assert after[doc].n_chars == (len(out) if spans else r.n_chars)
        masked += bool(spans)
    assert masked


def test_what_is_left_is_packed(stages):
    assert packed_right(stages[5].collect(), texts(stages[4])) < 0.02


def test_run_gives_the_last_stage(spark, data, stages):
    whole = corpus_pipeline.run(spark, data)
    assert whole.columns == stages[5].columns
    assert whole.count() >= stages[4].count()
    assert whole.select("doc_id").distinct().count() == stages[4].count()
