"""Flow tables: reading, cleaning, describing, splitting, scaling."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.operators import flows as fl
from floodlens.operators.ordered import exact_quantiles, select_ranks
from floodlens.operators.split import stratified_split
from floodlens.schemas import FLOW_FEATURES
from floodlens.sources.flows import headers, parse_errors, read_flows
from floodlens.sources.sinks import read_splits, write_splits


def test_reader_trims_names_and_parses_specials(spark, tmp_path):
    (tmp_path / "f.csv").write_text(" a, Flow Duration,Label\n1,Infinity,x\n2,Inf,x\n3,-Infinity,y\n4,NaN,y\n5,,y\n")
    got = read_flows(spark, str(tmp_path / "f.csv"))
    assert got.columns == ["a", "Flow Duration", "Label"]
    assert dict(got.dtypes)["Flow Duration"] == "double"
    values = [r["Flow Duration"] for r in got.orderBy("a").collect()]
    assert values[:3] == [float("inf"), float("inf"), float("-inf")]
    assert np.isnan(values[3]) and values[4] is None
    assert fl.clean_flows(got).count() == 0


def test_files_may_differ_in_order_and_hold_text(spark, tmp_path):
    folder = tmp_path / "flows"
    folder.mkdir()
    (folder / "a.csv").write_text("Flow ID, Flow Duration,SYN Flag Count,Timestamp,Label\n\"1,a\",7,3,03/07 8:55,x\n")
    (folder / "b.csv").write_text("SYN Flag Count,Label,Flow Duration,Flow ID\n4.0,y,8.5,b\nbad,y,1,c\n")
    (folder / "empty.csv").write_text("")
    got = {r["Flow ID"]: r for r in read_flows(spark, str(folder)).collect()}
    assert (got["1,a"]["Flow Duration"], got["1,a"]["SYN Flag Count"], got["1,a"]["Timestamp"]) == (7.0, 3, "03/07 8:55")
    assert (got["b"]["Flow Duration"], got["b"]["SYN Flag Count"], got["b"]["Timestamp"]) == (8.5, 4, None)
    assert got["c"]["SYN Flag Count"] is None
    errors = {r["column"]: tuple(r)[1:] for r in parse_errors(spark, str(folder)).collect()}
    assert errors == {"Flow Duration": (3, 0, None), "SYN Flag Count": (3, 1, "bad")}
    whole = read_flows(spark, str(folder / "a.csv"))
    assert fl.clean_flows(whole).count() == 1


def test_repeated_names_get_numbers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,a,Label\n1,2,x\n")
    assert read_flows(spark, str(tmp_path / "f.csv")).columns == ["a", "a.1", "Label"]


def test_ranks_are_exact_after_repeated_narrowing(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0.0, rng.random(), rng.gauss(50, 30)])) for g in "ab" for _ in range(4000)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    places = [("p", 1999), ("q", 3999), ("r", 0)]
    got = select_ranks(df, ["g"], "v", lambda n: [(t, F.lit(r)) for t, r in places], [0.5], most=20)
    found = {(r["g"], r["tag"]): r["value"] for r in got.collect()}
    for g in "ab":
        ordered = sorted(v for x, v in rows if x == g)
        assert all(found[(g, t)] == ordered[r] for t, r in places)


def test_cleaning_collapses_copies(spark):
    rows = [(1.0, "a")] * 50 + [(2.0, "a"), (None, "a"), (float("nan"), "b"), (float("-inf"), "b"), (3.0, None)]
    df = spark.createDataFrame(rows, "`x y` DOUBLE, Label STRING")
    assert fl.clean_flows(df, dedup=False).count() == 51
    assert fl.clean_flows(df).count() == 2
    stats = fl.cleaning_stats(df, fl.clean_flows(df)).first()
    assert (stats["initial"], stats["removed"], stats["remaining"]) == (55, 53, 2)


def test_cleaning_parses_each_value_once(spark, tmp_path):
    names = ["flow_id", *[f for f in FLOW_FEATURES if f not in ("SYN_ACK_Ratio", "Proto_Entropy")]]
    names += [c for c in ("Total Fwd Packets", "Total Backward Packets", "ACK Flag Count", "Label", "Flow ID") if c not in names]
    bad = ["inf", "-Infinity", "NaN", "", "x"]
    rows = [[f"k{i}" if n in ("flow_id", "Flow ID", "Label") else "3" for n in names] for i in range(8)]
    for row, text in zip(rows, bad):
        row[names.index("Flow Duration")] = text
    (tmp_path / "a.csv").write_text("\n".join(",".join(r) for r in [names, *rows]) + "\n")
    clean = fl.clean_flows(read_flows(spark, str(tmp_path)))
    assert sorted(r.flow_id for r in clean.collect()) == ["k5", "k6", "k7"]
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    assert [line.count("Duration") for line in plan.splitlines() if "Filter" in line] == [1]


def test_derived_flow_features(spark):
    rows = [(5, 0, 0, 0), (4, 2, 3, 1), (4, 2, 4, 0), (None, 1, 1, 1)]
    df = spark.createDataFrame(
        [(s, a, f, b) for s, a, f, b in rows],
        "`SYN Flag Count` BIGINT, `ACK Flag Count` BIGINT, `Total Fwd Packets` BIGINT, `Total Backward Packets` BIGINT",
    )
    got = fl.flow_features(df).collect()
    assert [r["SYN_ACK_Ratio"] for r in got] == [5.0, 2.0, 2.0, None]
    assert [r["Proto_Entropy"] for r in got] == pytest.approx([0.0, 0.811278, 0.0, 1.0], abs=1e-6)


def test_scaling_of_constant_and_outside_values(spark):
    train = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a DOUBLE, b DOUBLE")
    params = fl.fit_minmax(train, ["a", "b"])
    assert {r["feature"]: (r["data_range"], r["scale"]) for r in params.collect()} == {"a": (2.0, 0.5), "b": (0.0, 1.0)}
    test = spark.createDataFrame([(5.0, 7.0), (-1.0, 8.0)], "a DOUBLE, b DOUBLE")
    assert [tuple(r) for r in fl.apply_minmax(test, params).collect()] == [(2.0, 0.0), (-1.0, 1.0)]


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "two"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "spread": rng.normal(size=3000),
        # A third of all rows share one value.
        "ties": np.concatenate([np.full(1000, 5.0), rng.integers(0, 40, 2000).astype(float)]),
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", None)], "k STRING, v DOUBLE")
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for name, p in probs.items():
        assert got["g"][name] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert got["h"][name] == 1.0


def test_ranks_stay_exact_with_a_bad_guess(spark):
    values = list(range(1000))
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    got = select_ranks(df, [], "v", lambda n: [("a", F.lit(10)), ("b", n - 1)], [0.5]).collect()
    assert {r["tag"]: r["value"] for r in got} == {"a": 10.0, "b": 999.0}


def test_description_and_boxes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500), [50.0, -40.0]])
    df = spark.createDataFrame([(float(v), "BENIGN" if i % 2 else "Syn") for i, v in enumerate(x)], "f DOUBLE, Label STRING")
    d = fl.describe_features(df, ["f"], digits=6).first()
    assert d["std"] == pytest.approx(x.std(ddof=1), abs=1e-5)
    assert d["q75"] == pytest.approx(np.quantile(x, 0.75), abs=1e-6)
    for r in fl.box_stats(df, ["f"]).collect():
        part = x[1::2] if r["class"] == "Benign" else x[0::2]
        q1, q3 = np.quantile(part, [0.25, 0.75])
        inside = part[(part >= q1 - 1.5 * (q3 - q1)) & (part <= q3 + 1.5 * (q3 - q1))]
        assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
        assert r["outliers"] == len(part) - len(inside)


def test_correlations(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=200)
    b = 1e6 + a + rng.normal(size=200)
    df = spark.createDataFrame([(float(p), float(q), 1.0) for p, q in zip(a, b)], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = {(r["a"], r["b"]): r["r"] for r in fl.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["a", "c"] is None


def test_splits(spark):
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS k", "CAST(id % 3 = 0 AS INT) AS label")
    train, test = stratified_split(df, "k")
    assert train.count() + test.count() == 3000
    assert 480 < test.count() < 720
    assert stratified_split(df, "k")[1].exceptAll(test).count() == 0
    exact_train, exact_test = stratified_split(df, "k", exact=True)
    sizes = {r["label"]: r["count"] for r in exact_test.groupBy("label").count().collect()}
    assert sizes == {0: 400, 1: 200}
    assert exact_train.union(exact_test).exceptAll(df).count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_written_splits(spark, tmp_path, fmt):
    rows = [tuple(float(i + j) for j in range(10)) + (i % 2,) for i in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"`{f}` DOUBLE" for f in FLOW_FEATURES) + ", label INT")
    write_splits(df, df.limit(2), fl.fit_minmax(df), str(tmp_path / "s"), fmt)
    train, test, scaler = read_splits(spark, str(tmp_path / "s"), fmt)
    assert (train.count(), test.count(), scaler.count()) == (6, 2, 10)
    assert train.columns == df.columns
    assert scaler.where("scale = 0.2").count() == 10


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError, match="Flow Duration"):
        fl.select_features(spark.range(1).withColumn("Label", F.lit("x")))
    assert fl.available(spark.range(1).withColumn("Flow Duration", F.lit(1.0))) == ["Flow Duration"]


def test_headers_come_from_one_job(spark, tmp_path):
    """Many files, two orders of columns, a packed file, an empty one, and a name over two lines."""
    import gzip

    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(40):
        names, values = ("a,Label,b", f"{i},x,{i + 1}") if i % 2 else ("b,a,Label", f"{i + 1},{i},x")
        (folder / f"{i:02}.csv").write_text(f"﻿{names}\n{values}\n" if i % 3 else f"{names}\n{values}\n")
    (folder / "40.csv.gz").write_bytes(gzip.compress(b"a,Label,b\n40,x,41\n"))
    (folder / "41.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    got = read_flows(spark, str(folder), {"a": T.LongType(), "b": T.LongType()})
    assert len(tracker.getJobIdsForGroup("headers")) <= 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(i, i + 1) for i in range(41)]
    assert len(headers(spark, str(folder))) == 2
    long = tmp_path / "long.csv"
    long.write_text('a,"two\nlines",Label\n1,2,x\n3,4,y\n')
    rows = read_flows(spark, str(long))
    assert rows.columns == ["a", "two\nlines", "Label"]
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "2", "x"), ("3", "4", "y")]


def test_frequent_values_are_found_by_the_count_alone(spark):
    values = [float(i % 4) for i in range(8000)] + [-0.0, float("nan")]
    rows = [(g, v) for g in ("a", "b", None) for v in values]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(3)
    places = [("p", 3000), ("q", 5000), ("last", 7999)]
    found = select_ranks(df, ["g"], "v", lambda n: [(t, F.lit(r)) for t, r in places], [0.38, 0.63, 1.0], most=20)
    # Nothing is left to be ordered, and no group is without a name.
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {("p", 1.0), ("q", 2.0), ("last", 3.0)}
    assert {(r["g"], r["tag"], r["value"], r["total"]) for r in found.collect()} == {
        (g, t, v, 8002) for g in "ab" for t, v in want
    }
    top = select_ranks(df, ["g"], "v", lambda n: [("nan", n - 1), ("zero", F.lit(0))], [0.0, 1.0], most=20)
    assert {(r["g"], r["tag"], str(r["value"])) for r in top.collect()} == {
        (g, t, v) for g in "ab" for t, v in (("nan", "nan"), ("zero", "0.0"))
    }


def test_box_rows_find_their_fences_by_one_number(spark):
    df = spark.createDataFrame([(float(i), "BENIGN" if i % 2 else "Syn") for i in range(100)], "f DOUBLE, Label STRING")
    plan = fl.box_stats(df, ["f"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and "_group#" in joins[1] and "feature" not in joins[1]


def test_texts_that_cannot_be_numbers_are_not_parsed(spark, tmp_path):
    texts = ["1.5", " 2", "+3", "-4e2", ".5", "0x1p3", "inf", "-Infinity", "NaN", "nan ", "INF", "1d", "n/a 7", "nano", "Infinite", "é", "-", "/", "3 4"]
    lines = "".join(f'"{t}","{t}"\n' for t in texts)
    (tmp_path / "f.csv").write_text(f"Flow Duration,SYN Flag Count\n{lines},\n")
    parsed = read_flows(spark, str(tmp_path / "f.csv"))
    found = {r["column"]: r for r in parse_errors(spark, str(tmp_path / "f.csv")).collect()}
    for name in parsed.columns:
        wrong = len(texts) + 1 - parsed.where(F.col(f"`{name}`").isNotNull()).count() - 1
        assert (found[name]["present"], found[name]["unparsable"]) == (len(texts), wrong)
    assert found["Flow Duration"]["unparsable"] == 7 and found["Flow Duration"]["example"] == "-"
    plan = parse_errors(spark, str(tmp_path / "f.csv"))._jdf.queryExecution().optimizedPlan().toString()
    tops = [line for line in plan.splitlines() if "Aggregate" in line]
    assert tops and not any("try_cast" in line for line in tops) and "RLIKE" in plan
