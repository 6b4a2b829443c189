"""The distributed building blocks agree with a plain single-machine answer."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from asofkit import skew


def _numbers(seed, n, hot=0.4):
    rng = random.Random(seed)
    # One key holds a large share of the rows, as a skewed source would.
    return [("hot" if rng.random() < hot else f"k{rng.randrange(5)}", round(rng.gauss(0, 50), rng.choice([0, 3]))) for _ in range(n)]


@pytest.mark.parametrize("limit", [200_000, 3, None])
def test_percentiles_match_numpy(spark, rows, limit):
    data = _numbers(1, 900)
    frame = spark.createDataFrame(data, "k string, v double")
    wanted = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0}
    out = {r["k"]: r for r in rows(skew.percentiles(frame, ["k"], "v", wanted, limit=limit), "k")}
    for key in {k for k, _ in data}:
        values = [v for k, v in data if k == key]
        for name, p in wanted.items():
            assert out[key][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


@pytest.mark.parametrize("limit", [200_000, 2])
def test_weighted_global_percentiles(spark, limit):
    data = [(1.0, 3), (2.0, 1), (10.0, 4), (-5.0, 2)]
    frame = spark.createDataFrame(data, "v double, n long")
    out = skew.percentiles(frame, [], "v", {"m": 0.5, "q": 0.25}, freq="n", limit=limit).first()
    spread = [v for v, n in data for _ in range(n)]
    assert (out["m"], out["q"]) == (np.quantile(spread, 0.5), np.quantile(spread, 0.25))


@pytest.mark.parametrize("buckets,ascending", [(256, True), (4, True), (256, False), (16, False)])
def test_running_totals(spark, rows, buckets, ascending):
    data = {}
    for k, v in _numbers(2, 600):
        data[(k, v)] = data.get((k, v), 0) + 1
    frame = spark.createDataFrame([(k, v, n) for (k, v), n in data.items()], "k string, v double, n long")
    out = rows(skew.running_totals(frame, ["k"], "v", {"end": "n"}, buckets, ascending), "k", "v")
    for r in out:
        ahead = (lambda v: v <= r["v"]) if ascending else (lambda v: v >= r["v"])
        assert r["end"] == sum(n for (k, v), n in data.items() if k == r["k"] and ahead(v))


def test_previous_crosses_slices(spark, rows):
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    moments = sorted({start + dt.timedelta(seconds=rng.randrange(40 * 86_400)) for _ in range(300)})
    data = [("hot", m) for m in moments] + [("b", moments[0]), ("b", moments[-1])]
    frame = spark.createDataFrame(data, "k string, ts timestamp_ntz")
    out = rows(skew.previous(frame, ["k"], "ts", {"before": "ts"}, slice_days=0.5), "k", "ts")
    expected = {("hot", m): p for p, m in zip([None, *moments], moments)}
    expected.update({("b", moments[0]): None, ("b", moments[-1]): moments[0]})
    assert {(r["k"], r["ts"]): r["before"] for r in out} == expected


def test_lookup_is_a_join(spark, rows):
    frame = spark.createDataFrame(_numbers(4, 300), "k string, v double")
    table = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, tag int")
    assert rows(skew.lookup(frame, table, ["k"])) == rows(frame.join(table, "k", "left"))
    assert rows(skew.lookup(frame, table, ["k"], "inner", 1)) == rows(frame.join(table, "k"))


@pytest.mark.parametrize("count", [5, 1200])
def test_top_rows(spark, count):
    frame = spark.range(4000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    out = skew.top_rows(frame, ["k"], [F.desc("v")], count).groupBy("k").agg(F.min("v"), F.count("v")).collect()
    for k, low, n in out:
        assert n == count and low == 4000 - 2 * count + k


def test_hashed_places_number_every_row_once(spark):
    frame = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    out = skew.hashed_places(frame, ["k"], ["id"]).groupBy("k").agg(
        F.sort_array(F.collect_list("place")).alias("p"), F.count("id").alias("n")).collect()
    assert all(r["p"] == list(range(1, r["n"] + 1)) for r in out)


def test_distinct_in_windows(spark, at):
    cut = at("2024-01-10T00:00:00")
    data = [("a", cut, "x", at("2024-01-09T12:00:00")), ("a", cut, "x", at("2024-01-01T00:00:00")), ("a", cut, "y", at("2024-01-02T00:00:00")), ("a", cut, None, at("2024-01-09T00:00:00"))]
    frame = spark.createDataFrame(data, "entity string, cutoff timestamp_ntz, v string, ts timestamp_ntz")
    out = skew.distinct_in_windows(frame, ["entity", "cutoff"], F.col("v"), "ts", {"all": None, "day": 86_400.0}).first()
    assert (out["all"], out["day"]) == (2, 1)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_percentile_paths_agree(values):
    from pyspark.sql import SparkSession

    frame = SparkSession.getActiveSession().createDataFrame([(v,) for v in values], "v double")
    a = skew.percentiles(frame, [], "v", {"p": 0.37}).first()["p"]
    b = skew.percentiles(frame, [], "v", {"p": 0.37}, limit=0).first()["p"]
    assert a == pytest.approx(b, rel=1e-12, abs=1e-9)


def test_growing_tables_are_not_broadcast(spark, tmp_path):
    """A file below the broadcast threshold may hold more rows than the driver can: neither it nor its copies pass through the driver."""
    spark.range(0, 400_000, 1, 1).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    facts = spark.range(1_000_000).select((F.col("id") % 400_003).alias("k"), "id")
    for out in (skew.joined(facts, table, "k", "left"), skew.lookup(facts, table, ["k"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        totals = out.agg(F.count("id"), F.count("v"), F.sum("v")).first()
        missing = facts.filter("k >= 400000").count()
        wanted = facts.filter("k < 400000").agg(F.sum(F.col("k") % 7)).first()[0]
        assert tuple(totals) == (1_000_000, 1_000_000 - missing, wanted)


def test_copies_hold_each_row_once_per_salt(spark, rows):
    frame = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [(r["k"], r["_salt"]) for r in rows(skew.copies(frame, 3), "k", "_salt")] == [(k, i) for k in "ab" for i in range(3)]


def test_growing_lookup_is_not_broadcast(spark, rows):
    """The copies of a small table are broadcast after their shuffle, those of a growing one are not; the rows are the same."""
    many = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).groupBy("k").agg(F.max("v").alias("v"))
    out = {g: skew.lookup(many, table, ["k"], grows=g) for g in (False, True)}
    assert rows(out[True], "id") == rows(out[False], "id")
    plans = {g: f._jdf.queryExecution().executedPlan().toString() for g, f in out.items()}
    assert "BroadcastHashJoin" in plans[False] and "BroadcastHashJoin" not in plans[True]
