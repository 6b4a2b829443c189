"""Clock contract, the worked example and the invariants every as-of operator keeps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asofkit import Catalog, Requests, Table
from asofkit import skew as sk
from asofkit.functions.scalars import stamp
from asofkit.operators import events as ev
from asofkit.operators import exposure as ex
from asofkit.operators import families as fam
from asofkit.operators import joins as jn
from asofkit.operators import peers as pr
from asofkit.operators import responses as rs
from asofkit.operators import timelines as tl
from asofkit.plans import paths as pl
from asofkit.plans import reduction as rd
from asofkit.requests import visible

K = ["entity", "cutoff"]
CUT = dt.datetime(2026, 1, 11)


def day(n, hour=0):
    return dt.datetime(2026, 1, n, hour)


@pytest.fixture
def shop(spark):
    customers = spark.createDataFrame([("A",), ("B",), ("C",)], "customer string")
    orders = spark.createDataFrame(
        [("O1", "A", day(7), 20.0), ("O2", "A", day(10), 100.0), ("O3", "B", day(9), 60.0), ("O4", "A", day(11), 999.0)],
        "o_orderkey string, entity string, ts timestamp_ntz, o_totalprice double")
    lines = spark.createDataFrame(
        [("O1", day(7), 10.0), ("O1", day(7), 10.0), ("O2", day(10), 100.0), ("O3", day(9), 60.0), ("O4", day(11), 999.0)],
        "l_orderkey string, l_shipdate timestamp_ntz, l_extendedprice double")
    return customers, orders, lines


@pytest.fixture
def shop_catalog(shop):
    customers, orders, lines = shop
    return Catalog({t.name: t for t in (
        Table("customers", customers, ("customer",)), Table("orders", orders, ("o_orderkey",), time="ts", foreign_keys=(("entity", "customers"),)),
        Table("lines", lines, time="l_shipdate", foreign_keys=(("l_orderkey", "orders"),)))})


PROGRAM = {"orders": {rd.ROWS: ("count",), "o_totalprice": ("sum", "avg")}, "lines": {"l_extendedprice": ("max", "avg")}}


@pytest.mark.parametrize("listed", [True, False])
def test_worked_example(shop_catalog, rows, listed):
    cat = shop_catalog
    requests = Requests.every(cat["customers"].frame, "customer", [CUT])
    if not listed:
        requests = Requests(requests.frame, None)
    out = rows(rd.reduce_tree(cat, rd.along(cat, ("customers", "orders", "lines")), requests, PROGRAM), "entity")
    assert [(r["orders_rows"], r["orders_o_totalprice_sum"], r["orders_o_totalprice_avg"], r["orders_lines_l_extendedprice_max_max"], r["orders_lines_l_extendedprice_avg_avg"]) for r in out] == [
        (2, 120.0, 60.0, 100.0, 55.0), (1, 60.0, 60.0, 60.0, 60.0), (None,) * 5]


@pytest.mark.parametrize("boundary", ["strict", "inclusive"])
def test_leaf_states_of_many_cutoffs(spark, rows, boundary):
    """Nulls, equal instants, a second clock, a phase and unasked entities; the requests are not copied for the leaf's rows."""
    roots = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    acts = spark.createDataFrame(
        [("A", day(2), day(2), 1, 2.0), ("A", day(2), day(9), 2, None), ("A", day(5), day(5), None, 4.0), ("A", None, day(3), 8, 8.0), ("A", day(8), None, 16, 8.0),
         ("B", day(4), day(4), None, None), ("B", day(12), day(12), 3, 1.0), (None, day(2), day(2), 5, 5.0)], "owner string, at timestamp_ntz, seen timestamp_ntz, n int, x double")
    cat = Catalog({"roots": Table("roots", roots, ("id",)), "acts": Table("acts", acts, time="at", available_at="seen", boundary=boundary, foreign_keys=(("owner", "roots"),))})
    program = {"acts": {rd.ROWS: ("count",), "n": ("sum", "count", "min"), "x": ("avg", "max")}}
    cuts = [day(d) for d in range(1, 15)]
    frame = roots.filter("id <> 'C'").select(F.col("id").alias("entity"), F.explode(F.array(*[stamp(c) for c in cuts])).alias("cutoff"))
    tree = rd.along(cat, ("roots", "acts"))
    for phase in (None, day(10)):
        many = rd.reduce_tree(cat, tree, Requests(frame, None, phase), program)
        listed = rd.reduce_tree(cat, tree, Requests(frame, tuple(cuts), phase), program)
        assert many.schema.simpleString() == listed.schema.simpleString()
        assert rows(many, "entity", "cutoff") == rows(listed, "entity", "cutoff")
    # Only the undated root meets copies of the requests.
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 16") == 1


def test_occurrence_trees(shop_catalog):
    cat = shop_catalog
    assert set(rd.occurrences(cat, "customers", 2).walks()) == {("customers",), ("customers", "orders"), ("customers", "orders", "lines")}
    again = set(rd.occurrences(cat, "orders", 3, repeats=2).walks())
    # The way back over the edge just taken leads to the same row only; the way down again leads to others.
    assert ("orders", "customers", "orders", "lines") in again and ("orders", "lines", "orders") not in again
    with pytest.raises(ValueError):
        rd.along(cat, ("customers", "lines"))


def test_reduction_by_keys_of_two_columns(spark, rows):
    """Null parts refer to nothing; names with odd characters, ``entity`` and ``cutoff`` included, stay apart."""
    owner = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 9.0)], "tenant string, id int, `cut/off.x` double")
    act = spark.createDataFrame(
        [("a", 1, day(3), 1.0, "u"), ("a", 1, day(12), 2.0, "u"), ("a", None, day(3), 4.0, "u"), ("b", 1, day(3), 8.0, "v"), (None, 1, day(3), 16.0, None), ("c", 1, day(3), 32.0, "u")],
        "entity string, cutoff int, at timestamp_ntz, `a.b` double, kind string")
    kinds = spark.createDataFrame([("u", 10.0), ("v", 20.0)], "kind string, entity double")
    cat = Catalog({"owner": Table("owner", owner, ("tenant", "id")), "kind": Table("kind", kinds, ("kind",)),
                   "act": Table("act", act, time="at", foreign_keys=((("entity", "cutoff"), "owner"), ("kind", "kind")))})
    frame = owner.select(F.struct(F.col("tenant").alias("k0"), F.col("id").alias("k1")).alias("entity")).withColumn("cutoff", stamp(CUT))
    tree = rd.along(cat, ("owner", "act", "kind"))
    for requests in (Requests.of(frame), Requests(frame, None)):
        out = rd.reduce_tree(cat, tree, requests, {"act": {rd.ROWS: ("count",), "a.b": ("sum",)}, "kind": {"entity": ("max",)}, "owner": {"cut/off.x": ("min",)}})
        found = {tuple(r["entity"].values()): tuple(r.values())[2:] for r in rows(out)}
        assert found == {("a", 1): (5.0, 1, 1.0, 10.0), ("a", 2): (7.0, None, None, None), ("b", 1): (9.0, 1, 8.0, 20.0)}
    assert {c.child for c in cat.relationships if c.reduce} == {"act"}


@pytest.mark.parametrize("boundary,expected", [("strict", 2), ("inclusive", 3), ("exact", 1)])
def test_boundaries(shop, boundary, expected):
    customers, orders, _ = shop
    seen = visible(orders, Requests.every(customers, "customer", [CUT]), boundary=boundary)
    assert seen.filter("entity = 'A'").count() == expected


def test_two_clocks_and_phase(spark):
    events = spark.createDataFrame([("a", day(3), day(3)), ("a", day(4), day(9)), ("a", day(6), day(6))], "entity string, ts timestamp_ntz, ready timestamp_ntz")
    people = spark.createDataFrame([("a",)], "p string")
    req = Requests.every(people, "p", [day(8)])
    assert visible(events, req, available="ready").count() == 2
    late = Requests.every(people, "p", [day(8)], phase=day(5))
    assert [r["ts"] for r in visible(events, late, available="ready").collect()] == [day(3)]


def _events(spark, seed=0):
    import random

    rng = random.Random(seed)
    data = [(f"e{rng.randrange(6)}", day(1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 25)), float(rng.randrange(9)), rng.choice("xyz"), rng.randrange(2))
            for _ in range(400)]
    return spark.createDataFrame(data, "entity string, ts timestamp_ntz, value double, kind string, response int").withColumn("channel", (F.col("kind") == "x").cast("int"))


def _requests(spark, cutoffs):
    people = spark.createDataFrame([(f"e{i}",) for i in range(8)], "p string")
    return Requests.every(people, "p", cutoffs)


OPERATORS = {
    "base": lambda e, r: r.align(visible(e, r).groupBy(*K).agg(*fam.base_numeric("value"))),
    "activity": lambda e, r: r.align(visible(e, r).groupBy(*K).agg(*fam.activity("ts", (1, 7)))),
    "state": lambda e, r: r.align(fam.state(visible(e, r), "ts", "value", ["value"], ["kind"])),
    "episode": lambda e, r: r.align(fam.episode(visible(e, r), "kind", "ts", (3,))),
    "momentum": lambda e, r: rs.response_momentum(r, visible(e, r), "response", 3 * 86_400),
    "marked": lambda e, r: rs.marked_timing(r, e, 3 * 86_400),
    "contexts": lambda e, r: rs.marked_contexts(r, e, 3 * 86_400, context="kind"),
    "sequence": lambda e, r: tl.exact_sequence(r, e, 2, 3 * 86_400),
    "transitions": lambda e, r: tl.transitions(r, e, 2, 2),
    "recurrence": lambda e, r: tl.peer_recurrence(r, e, 2.0),
    "breadth": lambda e, r: tl.breadth(r, e, "kind", 2 * 86_400),
}


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x.keys() == y.keys()
        for k in x:
            assert x[k] == y[k] or x[k] == pytest.approx(y[k], rel=1e-9, abs=1e-9), (k, x[k], y[k])


@pytest.mark.parametrize("name", OPERATORS)
def test_future_rows_and_order_change_nothing(spark, rows, name):
    events, req = _events(spark), _requests(spark, [day(10), day(18)])
    base = rows(OPERATORS[name](events, req), *K)
    future = events.filter(F.col("ts") >= F.lit(day(18))).withColumn("value", F.col("value") * -7).withColumn("kind", F.lit("z"))
    changed = events.filter(F.col("ts") < F.lit(day(18))).unionByName(future).unionByName(future).orderBy(F.rand(7)).repartition(5)
    _same(base, rows(OPERATORS[name](changed, req), *K))


@pytest.mark.parametrize("name", ["base", "state", "marked", "sequence", "breadth"])
def test_one_request_alone_equals_the_batch(spark, rows, name):
    events = _events(spark, 1)
    batch = rows(OPERATORS[name](events, _requests(spark, [day(10), day(18)])), *K)
    alone = rows(OPERATORS[name](events, _requests(spark, [day(18)])), *K)
    _same([r for r in batch if r["cutoff"] == day(18)], alone)


@pytest.mark.parametrize("rule", [{}, {"boundary": "inclusive"}, {"lookback_days": 5}])
def test_grid_and_join_paths_agree(spark, rows, rule):
    events, req = _events(spark, 2), _requests(spark, [day(9), day(17)])
    joined = Requests(req.frame, None)
    _same(rows(visible(events, req, **rule)), rows(visible(events, joined, **rule).select(*visible(events, req).columns)))


def test_duplicate_and_unknown_requests_keep_their_rows(spark, rows):
    frame = spark.createDataFrame([("e1", day(18)), ("e1", day(18)), ("nobody", day(18))], "entity string, cutoff timestamp_ntz")
    out = rows(OPERATORS["base"](_events(spark), Requests.of(frame)), *K)
    assert len(out) == 3 and out[0] == out[1] and out[2]["value_count"] is None


def test_latest_mature_ties_and_boundary(spark):
    history = spark.createDataFrame([("a", day(1), day(5), 1.0), ("a", day(2), day(5), 2.0), ("a", day(3), day(8), 9.0)], "entity string, ts timestamp_ntz, available_at timestamp_ntz, y double")
    people = spark.createDataFrame([("a",)], "p string")
    req = Requests.every(people, "p", [day(8)])
    assert jn.latest_mature(history, req, ["y"]).first()["y"] == 2.0
    assert jn.latest_mature(history, req, ["y"], strict=False).first()["y"] == 9.0


def test_path_needs_every_hop(spark):
    sessions = spark.createDataFrame([(1, "a", day(5)), (2, "a", day(12))], "s long, who string, at timestamp_ntz")
    facts = spark.createDataFrame([(1, day(4)), (1, day(20)), (2, day(3))], "session long, t timestamp_ntz")
    path = jn.path_facts([{"frame": sessions, "time": "at", "key": "s", "fk": "who"}, {"frame": facts, "time": "t", "key": None, "fk": "session"}])
    people = spark.createDataFrame([("a",)], "p string")
    counts = {c: visible(path, Requests.every(people, "p", [c]), "known").count() for c in (day(5), day(6), day(13), day(21))}
    assert counts == {day(5): 0, day(6): 1, day(13): 2, day(21): 3}


def test_dimension_not_yet_visible_reads_missing(spark, rows):
    facts = spark.createDataFrame([("a", day(2), 1), ("a", day(3), 2)], "entity string, ts timestamp_ntz, d int")
    dims = spark.createDataFrame([(1, 5.0, day(8)), (2, 7.0, day(9))], "key int, price double, born timestamp_ntz")
    req = Requests.every(spark.createDataFrame([("a",)], "p string"), "p", [day(8)])
    out = jn.dimension(visible(facts, req), dims, "d", "key", ["price"], "born")
    assert [r["price"] for r in rows(out, "d")] == [5.0, None]


def test_future_labels_bounds(spark):
    events = spark.createDataFrame([("a", day(11), 1.0), ("a", day(14), 2.0)], "entity string, ts timestamp_ntz, v double")
    req = Requests.every(spark.createDataFrame([("a",), ("b",)], "p string"), "p", [CUT])
    measures = {"any": ("bool", "v"), "total": ("sum", "v"), "mean": ("avg", "v")}
    left = {r["entity"]: r for r in fam.future_labels(events, req, 3, measures).collect()}
    right = {r["entity"]: r for r in fam.future_labels(events, req, 3, measures, closed="right").collect()}
    assert (left["a"]["total"], right["a"]["total"]) == (1.0, 2.0)
    assert (left["b"]["any"], left["b"]["total"], left["b"]["mean"]) == (0, 0, None)
    wide = fam.future_labels(events, Requests(req.frame, None), 3, measures)
    assert {r["entity"]: r["total"] for r in wide.collect()} == {"a": 1.0, "b": 0.0}


def test_numeric_latest_takes_smaller_value_on_ties(spark):
    events = spark.createDataFrame([("a", day(9), 5.0), ("a", day(9), 3.0), ("a", day(2), 8.0)], "entity string, ts timestamp_ntz, v double")
    req = Requests.every(spark.createDataFrame([("a",)], "p string"), "p", [CUT])
    out = ev.numeric(req, ev.window_rows(events, req, 30), ["v"], (1, 5, 30)).first()
    assert (out["d1_v_latest"], out["d5_v_latest"], out["d30_v_support"]) == (None, 3.0, 3)


def test_leave_own_out_ignores_own_events(spark, rows):
    data = [("a", day(2), day(2), 1, 10, 1, 1, 0.5), ("b", day(2), day(2), 2, 10, 1, 0, 0.5), ("b", day(3), day(3), 3, 11, 2, 1, 0.1)]
    schema = "entity string, ts timestamp_ntz, known timestamp_ntz, s long, o long, c long, r int, p double"
    req = Requests.every(spark.createDataFrame([("a",), ("b",)], "p string"), "p", [CUT])

    def expected(rs_):
        view = ex.events_view(spark.createDataFrame(rs_, schema), "s", "o", "c", "r", "p")
        return {(r["entity"], r["object"]): r["expected"] for r in ex.scored_strata(view, req, 86_400)[1].collect()}

    flipped = [(*d[:6], 1 - d[6], d[7]) if d[0] == "a" else d for d in data]
    assert expected(data)[("a", 10)] == expected(flipped)[("a", 10)]
    assert expected(data)[("b", 10)] != expected(flipped)[("b", 10)]


def test_peer_history_excludes_own_labels(spark, rows):
    facts = spark.createDataFrame([(e, day(1), "g") for e in "abc"], "entity string, known timestamp_ntz, obj string")
    req = Requests.every(spark.createDataFrame([(e,) for e in "abc"], "p string"), "p", [CUT])

    def support(ys):
        history = spark.createDataFrame([(e, day(3), day(5), y) for e, y in ys.items()], "entity string, ts timestamp_ntz, available_at timestamp_ntz, y double")
        latest = pr.latest_labels(history, req)
        members = pr.label_memberships(history, facts, "obj", 4)
        asked = jn.memberships(facts, req, "obj", 4)
        return {r["entity"]: (r["support_mean"], r["mean_mean"]) for r in rows(pr.peer_history(req, asked, pr.links(latest, members), latest))}

    base = support({"a": 1.0, "b": 0.0, "c": 1.0})
    assert base == {"a": (2.0, 0.5), "b": (2.0, 1.0), "c": (2.0, 0.5)}
    assert support({"a": 0.0, "b": 0.0, "c": 1.0})["a"] == base["a"]


def test_label_state_runs_and_ewma(spark, rows):
    ys = [1.0, 1.0, 0.0, 0.0, 0.0]
    history = spark.createDataFrame([("a", day(i + 1), day(i + 2), y) for i, y in enumerate(ys)], "entity string, ts timestamp_ntz, available_at timestamp_ntz, y double")
    req = Requests.every(spark.createDataFrame([("a",), ("z",)], "p string"), "p", [day(4), CUT])
    out = {(r["entity"], r["cutoff"]): r for r in tl.label_state(req, history).collect()}
    early, late, none = out[("a", day(4))], out[("a", CUT)], out[("z", CUT)]
    assert (early["labels"], early["run_length"], early["ewma"], early["last"]) == (2, 2, 1.0, 1.0)
    assert (late["labels"], late["run_length"], late["signed_run"], late["ewma"]) == (5, 3, -3.0, 0.125)
    assert late["days_since_positive"] == 8.0 and (none["labels"], none["rate"]) == (0, None)


def test_fact_paths_take_turns():
    class Fake(Table):
        def __post_init__(self):
            pass

    def table(name, key, time, fks):
        return Fake(name, None, key, time, foreign_keys=fks)

    cat = Catalog({t.name: t for t in (
        table("root", ("id",), None, ()), table("a", ("id",), "t", (("r1", "root"), ("r2", "root"))), table("b", ("id",), "t", (("r", "root"),)),
        table("c", (), "t", (("a", "a"),)))})
    kept, omitted = pl.fact_paths(cat, "root", 2, 3)
    assert kept == [(("a", "r1"),), (("b", "r"),), (("a", "r2"),)] and len(omitted) == 2
    for width in (2, 3, 4, 5, 8):
        pairs = pl.balanced_pairs(width, 10**6)
        assert len(set(pairs)) == len(pairs) == width * (width - 1) // 2 and all(a < b < width for a, b in pairs)
        for budget in range(1, len(pairs)):
            uses = [sum(i in p for p in pairs[:budget]) for i in range(width)]
            assert max(uses) - min(uses) <= 2 and len(pl.balanced_pairs(width, budget)) == budget
    assert pl.unrolled("root", cat.relationships, 2, 2)


def test_moving_average_of_labels_covers_all_of_them(spark):
    start = dt.datetime(2000, 1, 1)
    labels = {1: [1.0] + [0.0] * 69, 2: [float(i % 3 == 0) for i in range(1100)], 3: [1.0]}
    rows = [(e, *[start + dt.timedelta(hours=i)] * 2, y) for e, ys in labels.items() for i, y in enumerate(ys)]
    history = spark.createDataFrame(rows, "entity long, ts timestamp, available_at timestamp, y double")
    asked = Requests.every(spark.createDataFrame([(e,) for e in labels], "k long"), "k", ["2005-01-01"])
    for row in tl.label_state(asked, history).collect():
        expected = labels[row.entity][0]
        for y in labels[row.entity][1:]:
            expected = (expected + y) / 2
        assert abs(row.ewma - expected) <= 1e-12 * expected


def test_population_is_the_same_for_listed_and_unlisted_cutoffs(spark):
    rng = random.Random(5)
    data = [(e, day(rng.randint(1, 12)), rng.choice([1, 2, 3, None]), rng.randint(1, 2), rng.randint(0, 1), rng.random()) for e in "abcdef" for _ in range(12)]
    facts = spark.createDataFrame(data, "entity string, known timestamp_ntz, o long, c long, r int, p double").withColumn("ts", F.col("known")).withColumn("s", F.lit(1).cast("long"))
    view = ex.events_view(facts, "s", "o", "c", "r", "p")
    history = facts.select("entity", "ts", F.col("known").alias("available_at"), F.col("r").cast("double").alias("y"))
    every = spark.createDataFrame([(e,) for e in "abcdef"], "p string")
    for phase in (None, day(7)):
        listed = Requests.every(every, "p", [day(4), day(6), day(9)], phase)
        one = Requests(listed.frame.filter("entity = 'b'"), None, listed.phase)

        def answers(req):
            seen = visible(facts, req, "known")
            deviation = fam.peer_deviation(seen, "o", ["p"], everyone=facts, requests=req)
            frames = [
                deviation.groupBy("entity", "cutoff").agg(F.sum("group_size"), F.count("group_size"), F.min("p_deviation"), F.max("p_deviation")),
                ex.scored_strata(view, req, 86_400)[1].select("entity", "cutoff", "object", "context", "peer_n", "expected", "peer_context_n", "expected_context"),
                rs.own_history(req, history, 5 * 86_400),
            ]
            return [sorted(([round(v, 9) if isinstance(v, float) else v for v in r] for r in f.filter("entity = 'b'").collect()), key=str) for f in frames]

        assert answers(one) == answers(listed)


@pytest.mark.parametrize("limit", [0, 12, 1000])
def test_totals_at_sum_small_keys_whole_and_large_ones_in_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(sk, "WHOLE_LIMIT", limit)
    data = [("a", day(1 + i % 9), i) for i in range(40)] + [("b", day(2), 5), ("b", day(4), 7), (None, day(1), 100)]
    moments = [("a", day(i)) for i in range(1, 12)] + [("b", day(3)), ("b", day(9)), ("c", day(9)), (None, day(9))]
    events = spark.createDataFrame(data, "k string, t timestamp_ntz, v long")
    points = spark.createDataFrame(moments, "k string, m timestamp_ntz")
    found = {(r["k"], r["m"]): r["v"] for r in sk.totals_at(events, points, ["k"], "t", "m", {"v": F.col("v")}).collect()}
    assert found == {(k, m): sum(v for e, t, v in data if e == k and t < m) for k, m in moments if k}


def test_totals_at_leave_out_the_instant_itself(spark):
    events = spark.createDataFrame([("g", day(1), 2), ("g", day(3), 5), ("h", day(2), 7), (None, day(1), 9)], "k string, t timestamp_ntz, v long")
    points = spark.createDataFrame([("g", day(1)), ("g", day(3)), ("g", day(4)), ("h", day(9)), ("x", day(9)), (None, day(9))], "k string, m timestamp_ntz")
    found = {(r["k"], r["m"]): r["v"] for r in sk.totals_at(events, points, ["k"], "t", "m", {"v": F.col("v")}).collect()}
    assert found == {("g", day(1)): 0, ("g", day(3)): 2, ("g", day(4)): 7, ("h", day(9)): 7, ("x", day(9)): 0}
