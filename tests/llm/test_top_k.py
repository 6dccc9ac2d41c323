"""Exact top-k search against all products."""

import math
import random

import pytest

from floodlens.llm import top_k

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, part INT, codes STRING, slice INT, score STRING"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "c", 2, "s") for i, v in rows], SCHEMA).repartition(4)


def plain(rows, every, k):
    fit = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    for q, own in fit.items():
        if q % every:
            continue
        found = [
            (-sum(a * b for a, b in zip(own[0], v)), i) for i, vs in fit.items() if i != q for v in vs
        ]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def cloud(seed=1, n=700, dims=12):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.1) for m in middles[i % 5]]) for i in range(n)]
    # A group of copies that is a third of the table, and ties among them.
    rows += [(n + i, rows[3][1]) for i in range(n // 2)]
    return [(i, [float(x) for x in v]) for i, v in rows]


def test_equals_all_products(spark):
    import numpy as np

    rows = [(i, np.array(v, np.float32).tolist()) for i, v in cloud()]
    got = top_k.top_k(frame(spark, rows), top_k.F.expr("vec_id % 20 = 0"), k=7, part=128, block=16).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 20, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.25, -1.0]),
        (1, None),
        (2, [0.5, None, 1.0]),
        (3, [nan, 0.0, 0.0]),
        (4, [inf, 0.0, 0.0]),
        (5, []),
        (6, [1.0]),
        (7, [-2.0, 2.0, 30000.0]),
        (7, [-2.0, 2.0, 30000.0]),
        (None, [9.0, 9.0, 9.0]),
        (8, [-2.0, 2.0, 3.0, 0.5]),
        (10, [1e9, -1e8, 3.0]),
    ]
    got = top_k.top_k(frame(spark, rows), top_k.F.expr("vec_id % 2 = 0"), k=20).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 2, 20)


def test_empty_and_alone(spark):
    assert top_k.top_k(frame(spark, []), top_k.F.expr("vec_id % 20 = 0")).collect() == []
    assert top_k.top_k(frame(spark, [(0, [1.0])]), top_k.F.expr("vec_id % 20 = 0")).collect() == []


@pytest.mark.parametrize("alike", [True, False])
def test_blocks_below_the_kth_score_are_not_scored(alike, monkeypatch):
    """In a table of far groups, the bounds leave out most blocks; results stay the same."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    groups = rng.integers(-40, 40, (20, 32)) * (rng.random((20, 32)) < 0.2)
    rows = np.concatenate([g + rng.integers(-1, 2, (64, 32)) for g in groups]) if alike else rng.integers(-9, 9, (1280, 32))
    ids = np.arange(len(rows))
    blocks = pa.table(
        {
            "ids": [ids[i : i + 64].astype("<i8").tobytes() for i in range(0, len(rows), 64)],
            "forward": [top_k.narrow(rows[i : i + 64]) for i in range(0, len(rows), 64)],
            "high": [rows[i : i + 64].max(axis=0).astype("<i8").tobytes() for i in range(0, len(rows), 64)],
            "low": [rows[i : i + 64].min(axis=0).astype("<i8").tobytes() for i in range(0, len(rows), 64)],
        }
    )
    scored, whole = [], top_k.products
    monkeypatch.setattr(top_k, "products", lambda a, b: scored.append(a.shape[0] * b.shape[0]) or whole(a, b))
    queries = rows[::50]
    best = top_k.search(queries, ids[::50], np.full(len(queries), top_k.LOWEST), blocks, 5)
    for q in range(len(queries)):
        every = queries[q] @ rows.T
        want = sorted((-int(s), int(i)) for i, s in zip(ids, every) if i != ids[::50][q])[:5]
        own = best.query == q
        assert sorted(zip((-best.score[own]).tolist(), best.row[own].tolist())) == want
    if alike:
        assert sum(scored) < 0.5 * len(queries) * len(rows)
