"""Integrity, bundles, stores, frames, plans, encoders and the plug-in boundary."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit import Catalog, Requests, Table
from asofkit.operators import encoders as en
from asofkit.operators import families as fam
from asofkit.plans import feature_plan as fp
from asofkit.plans import frames as fr
from asofkit.plans.providers import attach
from asofkit.sources import io
from suite.model import catalog
from suite.registry import Inputs
from tests.conftest import DATA


@pytest.fixture
def small(spark):
    parents = spark.createDataFrame([(1, "x"), (2, "y")], "id long, tag string")
    children = spark.createDataFrame([(10, 1), (11, 9), (12, None)], "cid long, pid long")
    grand = spark.createDataFrame([(100, 10), (101, 11)], "gid long, cid long")
    return Catalog({t.name: t for t in (
        Table("parents", parents, ("id",)), Table("children", children, ("cid",), foreign_keys=(("pid", "parents"),)),
        Table("grand", grand, ("gid",), foreign_keys=(("cid", "children"),)))})


def test_orphans_and_cascade(small, rows):
    assert [(r["edge"], r["key"]) for r in rows(io.orphan_report(small, ["children"]))] == [("children.pid", "9")]
    pruned = io.prune_orphans(small)
    assert sorted(r["cid"] for r in pruned["children"].frame.collect()) == [10, 12]
    assert [r["gid"] for r in pruned["grand"].frame.collect()] == [100]


def test_key_violations(spark, rows):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "k int, l string")
    assert [(r["key"], r["rows"]) for r in rows(io.key_violations(Table("t", frame, ("k", "l"))), "key")] == [("1|a", 2), ("null|b", 1)]


def test_declarations_are_checked(spark):
    frame = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="not found"):
        Table("t", frame, ("b",))
    with pytest.raises(ValueError, match="boundary"):
        Table("t", frame, ("a",), boundary="sometimes")


def test_unsupported_source_is_rejected(spark):
    with pytest.raises(ValueError, match="unsupported"):
        io.open_source(spark, "/data/things.xlsx")


def test_csv_source(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b c\n1,x\n2,y\n")
    frame = io.open_source(spark, str(tmp_path / "t.csv"))
    assert frame.columns == ["a", "b c"] and frame.agg(F.sum("a")).first()[0] == 3


def test_bundle_round_trip(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    rows_ = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1.0), (2, dt.datetime(2024, 2, 1), 0.0)], "entity int, cutoff timestamp_ntz, y double")
    io.export_bundle(spark, folder, {"training": rows_, "requests": rows_}, "y")
    frames = io.reopen_bundle(spark, folder, "y", "2024-01-15", {"training": "cutoff"})
    assert frames["training"].count() == 1 and "y" not in frames["requests"].columns
    with pytest.raises(Exception, match="already exists"):
        io.export_bundle(spark, folder, {"training": rows_}, "y")
    rows_.limit(1).write.mode("append").parquet(f"{folder}/training")
    with pytest.raises(ValueError, match="changed"):
        io.reopen_bundle(spark, folder, "y")


def test_fingerprint_ignores_order_and_sees_changes(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None), (2, "")], "k int, v string")
    same = io.fingerprint(frame.orderBy(F.desc("k")).repartition(3)).first()
    assert io.fingerprint(frame).first() == same
    assert io.fingerprint(frame.na.fill("")).first() != same
    assert io.difference(frame, frame.dropDuplicates()).count() == 0
    assert io.difference(frame.union(frame), frame).count() == 3


def test_cohort_cache_replaces_a_repeated_cohort(spark, tmp_path):
    folder = str(tmp_path / "cache")
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1), (dt.datetime(2024, 2, 1), 2)], "cutoff timestamp_ntz, x int")
    io.append_cohorts(frame, folder)
    io.append_cohorts(frame.filter("x = 2").withColumn("extra", F.lit("new")), folder)
    assert io.read_cohorts(spark, folder).count() == 2
    assert [r["extra"] for r in io.read_cohorts(spark, folder, ["2024-02-01"]).collect()] == ["new"]


def test_records_refuse_duplicates(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("a", 2)], "id string, n int")
    with pytest.raises(ValueError, match="repeat"):
        io.write_records(frame, str(tmp_path / "records"), "id")


def test_frame_schema_is_learned_once(spark):
    train = spark.createDataFrame([(1, 2.0, "a", None, 5), (2, None, None, None, 5)], "k int, x double, c string, n double, same int")
    schema = fr.fit_schema(train, ["k"])
    assert (schema.numeric, schema.categorical) == (("x",), ("c",))
    out = fr.prepare(spark.createDataFrame([(9, float("inf"))], "k int, x double"), schema).first()
    assert (out["x"], out["c"]) == (None, fr.MISSING)
    assert fr.model_columns(["id", "x", "p__id", "y"], ["id"], ["y"]) == ["x"]


def test_plan_replays_without_relearning(spark):
    cat = catalog(Inputs(spark, DATA))
    steps = (("orders", "o_custkey"), ("lineitem", "l_orderkey"))
    plan = fp.FeaturePlan.fit(cat, steps, "1998-01-01", ["l_quantity"], ["l_returnflag"])
    back = fp.FeaturePlan.from_json(plan.to_json())
    assert back == plan and back.fingerprint() == plan.fingerprint()
    assert plan.with_families("base").fingerprint() != plan.fingerprint()
    renamed = Catalog({**cat.tables, "orders": cat["orders"].with_frame(cat["orders"].frame.withColumn("o_totalprice", F.lit("x")))})
    with pytest.raises(ValueError, match="differ"):
        back.transform(renamed, Requests.every(cat["customer"].frame, "c_custkey", ["1999-01-01"]))


def test_cutpoints_rules(spark):
    flat = spark.createDataFrame([(1.0, 1.0, float(i)) for i in range(10)], "a double, b double, c double").withColumn("b", F.when(F.col("c") > 8, 2.0).otherwise(1.0))
    cuts = fam.cutpoints(flat, ["a", "b", "c"])
    assert cuts["a"] == cuts["b"] == [] and len(cuts["c"]) == 7 and max(cuts["c"]) < 9


def test_cutpoints_read_all_rows_of_all_columns(spark):
    rows = spark.range(60_000).select(F.pmod(F.xxhash64("id"), F.lit(9973)).cast("double").alias("a"), (F.col("id") * F.col("id") / 7).alias("b"), F.lit(None).cast("double").alias("c"))
    cuts = fam.cutpoints(rows, ["a", "b", "c"])
    values = rows.toPandas()
    for n in ("a", "b"):
        assert cuts[n] == pytest.approx(np.quantile(values[n], [i / 8 for i in range(1, 8)]).tolist(), rel=1e-12)
    assert cuts["c"] == []


def test_semantic_expression_errors_are_named(spark):
    frame = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="'bad'"):
        fam.semantic(frame, {"bad": "missing_column + 1"})


def test_provider_clash_is_refused(spark):
    req = Requests.every(spark.createDataFrame([(1,)], "p int"), "p", ["2024-01-01"])
    one = lambda r: r.frame.withColumn("f", F.lit(1.0))
    assert attach(req, one).columns == ["entity", "cutoff", "f"]
    with pytest.raises(ValueError, match="clash"):
        attach(req, one, one)


def test_document_and_tokens(spark):
    frame = spark.createDataFrame([(1, "<b>A&amp;B</b>  c", None), (2, "", "x")], "k int, a string, b string")
    out = [r[0] for r in frame.orderBy("k").select(en.document(["a", "b"])).collect()]
    assert out == ["Field 1: A&B c", "Field 2: x"]
    hashed = {r["k"]: r for r in en.hashed_text(frame, "k", "b").collect()}
    assert sum(abs(hashed[2][f"b_hash{i}"]) for i in range(8)) == 1.0 and hashed[1]["b_hash0"] == 0.0


def test_canonical_cells_sort_keys(spark):
    frame = spark.createDataFrame([({"b": 1, "a": 2},), ({"a": 2, "b": 1},)], "m map<string,int>")
    cells = {r[0] for r in en.canonical_frame(frame).collect()}
    assert [json.loads(c) for c in cells] == [{"a": 2, "b": 1}]


def test_parent_hidden_at_its_own_birth(spark):
    parents = spark.createDataFrame([(1, 5.0, dt.datetime(2024, 1, 5))], "id int, x double, born timestamp_ntz")
    req = Requests.every(parents, "id", ["2024-01-05", "2024-01-06"])
    out = {r["cutoff"].day: r["x"] for r in en.parent_payload(req, parents, "id", ["x"], "born").collect()}
    assert out == {5: None, 6: 5.0}
