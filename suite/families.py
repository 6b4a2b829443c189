"""Feature families over the orders and lines of each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.scalars import count_if, stamp
from asofkit.operators import families as fam
from asofkit.requests import visible
from asofkit.session import checkpoint
from suite.core import K, LINE_VIS, order_lines
from suite.registry import (
    EVENT_REQ, EVENT_VIS, N, ORDER_REQ, ORDER_VIS, OWN_REQ, R, aligned_sql, query, rounded, secs, since_sql,
)

PERIODS = (7, 30, 90, 365, 730)
_ZERO = ("_count",)


def _lines(t):
    req = t.order_requests()
    return visible(order_lines(t, req.latest()), req, "known")


def _orders(t):
    return visible(t.order_events(), t.order_requests())


def _events(t):
    return visible(t.user_events(), t.event_requests())


def _align(t, rows, aggs, zero=(), events=False):
    req = t.event_requests() if events else t.order_requests()
    return rounded(req.align(rows.groupBy(*K).agg(*aggs), zero=zero))


@query("A1_base_numeric", aligned_sql(LINE_VIS, [
    x for c in ("l_quantity", "l_extendedprice") for x in (
        (f"count({c})", f"{c}_count", "i"), (f"sum({c})", f"{c}_sum", "d"), (f"avg({c})", f"{c}_avg", "d"),
        (f"min({c})", f"{c}_min", "d"), (f"max({c})", f"{c}_max", "d"))]))
def _(t):
    return _align(t, _lines(t), [*fam.base_numeric("l_quantity"), *fam.base_numeric("l_extendedprice")])


_FLAGS = ["A", "N", "R"]


@query("A2_base_categorical", aligned_sql(LINE_VIS, [
    ("count(l_returnflag)", "l_returnflag_count", "n"), ("count(DISTINCT l_returnflag)", "l_returnflag_distinct", "n"),
    *[(f"count(*) FILTER (l_returnflag='{v}')", f"l_returnflag_v{i}_count", "n") for i, v in enumerate(_FLAGS)],
    ("sum((l_linestatus='O')::INT)", "is_open_sum", "n")]))
def _(t):
    rows = _lines(t).withColumn("is_open", F.col("l_linestatus") == "O")
    aggs = [*fam.base_categorical("l_returnflag", _FLAGS), *fam.base_boolean("is_open")]
    return _align(t, rows, aggs, ["l_returnflag_count", "l_returnflag_distinct", "is_open_sum",
                                  *[f"l_returnflag_v{i}_count" for i in range(3)]])


def _w(d):
    return since_sql(d)


def _ratio(a, b):
    return f"({a})::DOUBLE/nullif({b},0)"


@query("A3_base_activity", aligned_sql(ORDER_VIS, [
    (secs("max(ts)", "cutoff"), "seconds_since_last", "d"),
    *[(f"count(*) FILTER ({_w(p)})", f"num_events_{p}d", "n") for p in PERIODS],
    *[(_ratio(f"count(*) FILTER ({_w(p)})", f"count(*) FILTER ({_w(q)})"), f"events_ratio_{p}v{q}", "d") for p, q in zip(PERIODS, PERIODS[1:])],
    (secs("min(ts)", "cutoff"), "observed_history_seconds", "d"),
    (f"count(*)/({secs('min(ts)', 'cutoff')}/86400+1)", "events_per_observed_day", "d")]))
def _(t):
    return _align(t, _orders(t), fam.activity("ts", PERIODS), [f"num_events_{p}d" for p in PERIODS])


@query("A4_equality_trajectories", aligned_sql(EVENT_VIS, [
    *[(f"count(*) FILTER (event_type='purchase' AND {_w(w)})", f"purchase_{w}d_count", "n") for w in (1, 3, 7, 14)],
    *[(f"count(*) FILTER (event_type='purchase' AND {_w(b)} AND NOT {_w(a)})", f"purchase_lag_{a}_{b}d_count", "n") for a, b in ((1, 3), (3, 7), (7, 14))],
    (secs("max(ts) FILTER (event_type='purchase')", "cutoff"), "purchase_seconds_since", "d")]))
def _(t):
    windows = (1, 3, 7, 14)
    aggs = fam.trajectory("ts", F.col("event_type") == "purchase", "purchase", windows)
    zero = [f"purchase_{w}d_count" for w in windows] + [f"purchase_lag_{a}_{b}d_count" for a, b in zip(windows, windows[1:])]
    return _align(t, _events(t), aggs, zero, events=True)


# Cutpoints are fitted on all training rows: those before the first cutoff.
_TRAINING = "training AS (SELECT l.* FROM lineitem l WHERE l_shipdate<TIMESTAMP '1998-01-01')"
_MARKS = "[" + ",".join(str(i / 8) for i in range(1, 8)) + "]"


def _training_lines(t):
    return t.lineitem.filter(F.col("l_shipdate") < stamp("1998-01-01"))


@query("A5_distribution_sketch", aligned_sql(
    f"{_TRAINING}, cuts AS (SELECT quantile_cont(l_extendedprice, {_MARKS}) AS q FROM training), {LINE_VIS.replace('l.* FROM requests r', 'l.*, (SELECT q FROM cuts) AS q FROM requests r')}",
    [(f"avg((l_extendedprice<=q[{i + 1}])::INT)", f"l_extendedprice_cdf{i}", "d") for i in range(7)]
    + [("avg((l_extendedprice IS NOT NULL)::INT)", "l_extendedprice_coverage", "d")]))
def _(t):
    cuts = fam.cutpoints(_training_lines(t), ["l_extendedprice"])["l_extendedprice"]
    return _align(t, _lines(t), fam.cdf("l_extendedprice", cuts))


def _moments(c, ps):
    out = []
    for p in ps:
        f = f"FILTER ({_w(p)})"
        out += [(f"sum({c}) {f}", f"{c}_{p}d_sum", "d"), (f"avg({c}) {f}", f"{c}_{p}d_avg", "d"), (f"min({c}) {f}", f"{c}_{p}d_min", "d"),
                (f"max({c}) {f}", f"{c}_{p}d_max", "d"), (f"stddev_pop({c}) {f}", f"{c}_{p}d_std", "d"), (f"count({c}) {f}", f"{c}_{p}d_count", "n")]
    out += [(f"avg({c}) FILTER ({_w(p)}) - avg({c}) FILTER ({_w(q)})", f"{c}_change_{p}v{q}", "d") for p, q in zip(ps, ps[1:])]
    return out


@query("A6_temporal", aligned_sql(ORDER_VIS, _moments("o_totalprice", PERIODS)))
def _(t):
    return _align(t, _orders(t), fam.temporal("o_totalprice", "ts", PERIODS), [f"o_totalprice_{p}d_count" for p in PERIODS])


_STATE = f"""WITH {ORDER_VIS}, k AS (SELECT *, row_number() OVER (PARTITION BY entity, cutoff ORDER BY ts DESC, o_orderkey DESC) AS rn FROM visible),
  b AS (SELECT entity, cutoff, """ + ", ".join(
    [f"max(o_totalprice) FILTER (rn={k}) AS o_totalprice_{n}" for k, n in ((1, 'latest'), (2, 'lag2'), (3, 'lag3'))]
    + [f"{f}(o_totalprice) FILTER (rn<={k}) AS o_totalprice_last{k}_{f}" for k in (3, 5, 10) for f in ("avg", "min", "max", "sum")]
    + ["max(o_orderstatus) FILTER (rn=1) AS o_orderstatus_latest"]) + " FROM k GROUP BY 1,2) SELECT r.entity, r.cutoff, " + ", ".join(
    [R(f"o_totalprice_{n}") + f" AS o_totalprice_{n}" for n in ("latest", "lag2", "lag3")]
    + [R(f"o_totalprice_last{k}_{f}") + f" AS o_totalprice_last{k}_{f}" for k in (3, 5, 10) for f in ("avg", "min", "max", "sum")]
    + ["o_orderstatus_latest"]) + " FROM requests r LEFT JOIN b USING (entity, cutoff)"


@query("A7_state", _STATE)
def _(t):
    block = fam.state(_orders(t), "ts", "o_orderkey", ["o_totalprice"], ["o_orderstatus"])
    return rounded(t.order_requests().align(block))


@query("A8_sequence", aligned_sql(ORDER_VIS, [
    *[x for p in PERIODS for x in ((f"count(*) FILTER ({_w(p)})/{float(p)}", f"rate_{p}d", "d"), (_ratio(f"count(*) FILTER ({_w(p)})", "count(*)"), f"share_{p}d", "d"))],
    *[(_ratio(f"count(*) FILTER ({_w(p)})", f"count(*) FILTER ({_w(q)})"), f"burst_{p}v{q}", "d") for p, q in zip(PERIODS, PERIODS[1:])],
    (secs("min(ts)", "max(ts)"), "active_span_seconds", "d"),
    (f"count(*)/({secs('min(ts)', 'max(ts)')}/86400+1)", "activities_per_active_day", "d")]))
def _(t):
    return _align(t, _orders(t), fam.sequence("ts", PERIODS))


_TYPES = ["click", "purchase"]
_CW = (3, 7, 14)


def _cond():
    out = []
    for i, v in enumerate(_TYPES):
        m = f"event_type='{v}'"
        share = {w: _ratio(f"count(*) FILTER ({m} AND {_w(w)})", f"count(*) FILTER ({_w(w)})") for w in _CW}
        for w in _CW:
            out += [(f"count(*) FILTER ({m} AND {_w(w)})", f"event_type_v{i}_{w}d_count", "n"), (share[w], f"event_type_v{i}_{w}d_share", "d"),
                    (f"(count(*) FILTER ({m} AND {_w(w)})>0)::INT", f"event_type_v{i}_{w}d_present", "n")]
        out += [(f"{share[p]}-{share[q]}", f"event_type_v{i}_change_{p}v{q}", "d") for p, q in zip(_CW, _CW[1:])]
    return out


@query("A9_conditional", aligned_sql(EVENT_VIS, _cond()))
def _(t):
    zero = [f"event_type_v{i}_{w}d_{k}" for i in range(2) for w in _CW for k in ("count", "present")]
    return _align(t, _events(t), fam.conditional("event_type", _TYPES, "ts", _CW), zero, events=True)


@query("A10_episode", aligned_sql(LINE_VIS, [
    ("count(*)", "rows", "n"), ("count(DISTINCT o_orderkey)", "keys", "n"),
    *[x for w in (30, 365) for x in ((f"count(*) FILTER ({_w(w)})", f"rows_{w}d", "n"), (f"count(DISTINCT o_orderkey) FILTER ({_w(w)})", f"keys_{w}d", "n"))]]))
def _(t):
    block = fam.episode(_lines(t), "o_orderkey", "ts", (30, 365))
    return t.order_requests().align(block, zero=["rows", "keys", "rows_30d", "keys_30d", "rows_365d", "keys_365d"])


@query("A11_context_deviation", f"""WITH {LINE_VIS}, dev AS (SELECT *, count(*) OVER w AS group_size, l_extendedprice-avg(l_extendedprice) OVER w AS dv FROM visible WINDOW w AS (PARTITION BY l_suppkey, cutoff)),
  b AS (SELECT entity, cutoff, avg(group_size) AS a, max(group_size) AS m, avg(dv) AS d, min(dv) AS lo, max(dv) AS hi FROM dev GROUP BY 1,2)
  SELECT r.entity, r.cutoff, {R('a')} AS group_size_avg, CAST(m AS BIGINT) AS group_size_max, {R('d')} AS deviation_avg, {R('lo')} AS deviation_min, {R('hi')} AS deviation_max
  FROM requests r LEFT JOIN b USING (entity, cutoff)""")
def _(t):
    return _align(t, fam.peer_deviation(_lines(t), "l_suppkey", ["l_extendedprice"]), _deviations())


def _deviations():
    d = F.col("l_extendedprice_deviation")
    return [
        F.avg("group_size").alias("group_size_avg"), F.max("group_size").alias("group_size_max"),
        F.avg(d).alias("deviation_avg"), F.min(d).alias("deviation_min"), F.max(d).alias("deviation_max")]


@query("A11_context_deviation_own_cutoffs", f"""WITH {OWN_REQ}, every AS (SELECT o_custkey AS entity, greatest(o_orderdate, l_shipdate) AS known, l_suppkey, l_extendedprice FROM orders JOIN lineitem ON l_orderkey=o_orderkey),
  visible AS (SELECT r.cutoff, e.* FROM requests r JOIN every e ON e.entity=r.entity AND e.known<r.cutoff),
  g AS (SELECT p.l_suppkey, p.cutoff, count(*) AS group_size, avg(e.l_extendedprice) AS mean FROM (SELECT DISTINCT l_suppkey, cutoff FROM visible) p JOIN every e ON e.l_suppkey=p.l_suppkey AND e.known<p.cutoff GROUP BY 1,2),
  b AS (SELECT entity, cutoff, avg(group_size) AS a, max(group_size) AS m, avg(l_extendedprice-mean) AS d, min(l_extendedprice-mean) AS lo, max(l_extendedprice-mean) AS hi FROM visible JOIN g USING (l_suppkey, cutoff) GROUP BY 1,2)
  SELECT r.entity, r.cutoff, {R('a')} AS group_size_avg, CAST(m AS BIGINT) AS group_size_max, {R('d')} AS deviation_avg, {R('lo')} AS deviation_min, {R('hi')} AS deviation_max
  FROM requests r LEFT JOIN b USING (entity, cutoff)""")
def _(t):
    req = t.own_order_requests()
    lines = checkpoint(order_lines(t).select("entity", "known", "l_suppkey", "l_extendedprice"))
    rows = fam.peer_deviation(visible(lines, req, "known"), "l_suppkey", ["l_extendedprice"], everyone=lines, requests=req)
    return rounded(req.align(rows.groupBy(*K).agg(*_deviations())))


@query("A12_semantic_expressions", aligned_sql(LINE_VIS, [
    ("sum(l_extendedprice*(1-l_discount))", "net_sum", "d"), ("count(l_extendedprice*(1-l_discount))", "net_count", "i"),
    ("avg(l_extendedprice*(1-l_discount))", "net_avg", "d"), ("min(l_extendedprice*(1-l_discount))", "net_min", "d"), ("max(l_extendedprice*(1-l_discount))", "net_max", "d"),
    ("sum((l_quantity>=40 AND l_returnflag='R')::INT)", "bulk_return_sum", "i")]))
def _(t):
    rows = fam.semantic(_lines(t), {
        "net": "l_extendedprice * (1 - l_discount)", "bulk_return": "l_quantity >= 40 AND l_returnflag = 'R'"})
    return _align(t, rows, [*fam.base_numeric("net"), *fam.base_boolean("bulk_return")])


@query("A13_propagation", f"""WITH {LINE_VIS}, l AS (SELECT entity, cutoff, o_orderkey, count(*) AS q_count, sum(l_quantity) AS q_sum, avg(l_quantity) AS q_avg, min(l_quantity) AS q_min,
    max(l_quantity) AS q_max, avg((l_returnflag='R')::INT) AS r_share FROM visible GROUP BY 1,2,3),
  b AS (SELECT entity, cutoff, sum(q_count) AS a, sum(q_sum) AS b, avg(q_avg) AS c, min(q_min) AS d, max(q_max) AS e, avg(r_share) AS f FROM l GROUP BY 1,2)
  SELECT r.entity, r.cutoff, CAST(a AS BIGINT) AS q_count_count, {R('b')} AS q_sum_sum, {R('c')} AS q_avg_avg, {R('d')} AS q_min_min, {R('e')} AS q_max_max, {R('f')} AS r_share_share
  FROM requests r LEFT JOIN b USING (entity, cutoff)""")
def _(t):
    q = "l_quantity"
    orders = _lines(t).groupBy(*K, "o_orderkey").agg(
        F.count(F.lit(1)).alias("q_count"), F.sum(q).alias("q_sum"), F.avg(q).alias("q_avg"), F.min(q).alias("q_min"),
        F.max(q).alias("q_max"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("r_share"))
    return _align(t, orders, fam.propagate(["q_count", "q_sum", "q_avg", "q_min", "q_max", "r_share"]))


@query("A14_category_indicators", aligned_sql(
    f"""{ORDER_VIS}, {"top AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders WHERE o_orderdate<TIMESTAMP '1998-01-01' GROUP BY 1)"}""",
    [x for i in range(5) for x in ((f"sum((o_orderpriority=(SELECT v FROM top WHERE rn={i + 1}))::INT)", f"o_orderpriority_is{i}_sum", "i"),
                                   (f"avg((o_orderpriority=(SELECT v FROM top WHERE rn={i + 1}))::INT)", f"o_orderpriority_is{i}_avg", "d"))]))
def _(t):
    training = t.order_events().filter(F.col("ts") < stamp("1998-01-01"))
    values = fam.frequent_values(training, "o_orderpriority")
    rows = _orders(t).select("*", *fam.indicators("o_orderpriority", values, other=False))
    names = [f"o_orderpriority_is{i}" for i in range(len(values))]
    return _align(t, rows, [a for n in names for a in (F.sum(n).alias(f"{n}_sum"), F.avg(n).alias(f"{n}_avg"))])


@query("A15_gated_numerics", aligned_sql(LINE_VIS, [
    x for i, v in enumerate(_FLAGS) for c in ("l_quantity", "l_extendedprice") for x in (
        (f"avg({c}) FILTER (l_returnflag='{v}')", f"{c}_if_l_returnflag{i}_avg", "d"), (f"max({c}) FILTER (l_returnflag='{v}')", f"{c}_if_l_returnflag{i}_max", "d"))]))
def _(t):
    columns = fam.gated("l_returnflag", _FLAGS, ["l_quantity", "l_extendedprice"])
    rows = _lines(t).select("*", *columns)
    names = [f"{c}_if_l_returnflag{i}" for i in range(3) for c in ("l_quantity", "l_extendedprice")]
    return _align(t, rows, [a for n in names for a in (F.avg(n).alias(f"{n}_avg"), F.max(n).alias(f"{n}_max"))])


@query("A16_text_shape", f"""SELECT doc_id, {N('length(text)')} AS text_length,
  {N("len(list_filter(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w<>''))")} AS text_words,
  regexp_matches(text, '[0-9]') AS text_has_number, regexp_matches(text, 'https?://') AS text_has_url, trim(text, ' ')='' AS text_is_empty FROM documents""")
def _(t):
    out = t.documents.select("doc_id", *fam.text_shape("text"))
    return out.select("doc_id", *[F.col(c).cast("long") if c in ("text_length", "text_words") else F.col(c) for c in out.columns[1:]])


@query("A17_root_age", f"""WITH roots AS (SELECT user_id AS entity, min(ts) AS born FROM events GROUP BY 1), {EVENT_REQ}
  SELECT r.entity, r.cutoff, {R("CASE WHEN born<r.cutoff THEN date_diff('microsecond', born, r.cutoff)/86400e6 END")} AS age_days FROM requests r LEFT JOIN roots USING (entity)""")
def _(t):
    roots = t.user_events().groupBy("entity").agg(F.min("ts").alias("born"))
    out = t.event_requests().frame.join(roots, "entity", "left")
    return rounded(out.select(*K, F.when(F.col("born") < F.col("cutoff"), fam.root_age("born")).alias("age_days")))


@query("A18_inferred_periods", f"""WITH k AS (SELECT o_custkey, date_diff('microsecond', min(o_orderdate), max(o_orderdate))/86400e6 AS span, count(*) AS n FROM orders WHERE o_orderdate<TIMESTAMP '2000-01-01' GROUP BY 1),
  f AS (SELECT avg(span) AS d, avg(span/(n-1)) FILTER (n>1) AS c FROM k), s AS (SELECT *, greatest(1, ceil(c)) AS st FROM f),
  w AS (SELECT *, least(greatest(floor(log2(least(greatest(d, st), 3650)/st))+1, 5), 10) AS cnt FROM s)
  SELECT {R('c')} AS mean_cadence_days, {R('d')} AS mean_duration_days, CAST(i AS BIGINT) AS step, {R('st*pow(2,i)')} AS period_days FROM w, range(10) x(i) WHERE i<cnt""")
def _(t):
    rows = t.order_events().filter(F.col("ts") < stamp("2000-01-01"))
    out = fam.inferred_periods(fam.event_frequency(rows, "entity", "ts"), 3650)
    return rounded(out.withColumn("step", F.col("step").cast("long")))


@query("A19_future_labels", " UNION ALL ".join(f"""SELECT '{name}' AS bounds, r.entity, r.cutoff, CAST(coalesce(max(CASE WHEN o.o_orderkey IS NOT NULL THEN 1 END),0) AS BIGINT) AS ordered,
  CAST(count(o.o_orderkey) AS BIGINT) AS orders, {R('coalesce(sum(o_totalprice),0)', 2)} AS spend, {R('avg(o_totalprice)', 2)} AS mean_spend
  FROM ({{req}}) r LEFT JOIN orders o ON o.o_custkey=r.entity AND o.o_orderdate{lo}r.cutoff AND o.o_orderdate{hi}r.cutoff+INTERVAL 90 DAY GROUP BY 2,3"""
    for name, lo, hi in (("left", ">=", "<"), ("right", ">", "<="))).replace("{req}", ORDER_REQ[len("requests AS ("):-1]))
def _(t):
    measures = {"ordered": ("bool", "o_totalprice"), "orders": ("count", "o_totalprice"), "spend": ("sum", "o_totalprice"), "mean_spend": ("avg", "o_totalprice")}
    out = None
    for name in ("left", "right"):
        x = fam.future_labels(t.order_events(), t.order_requests(), 90, measures, closed=name)
        x = x.withColumn("ordered", F.col("ordered").cast("long")).select(F.lit(name).alias("bounds"), *x.columns)
        out = x if out is None else out.unionByName(x)
    return rounded(out, "spend", "mean_spend", places=2)


# Historical targets: one label per customer and quarter, mature 90 days later.
HISTORY = """hist AS (SELECT o_custkey AS entity, date_trunc('quarter', o_orderdate) AS ts, date_trunc('quarter', o_orderdate)+INTERVAL 90 DAY AS available_at,
  max((o_totalprice>250000)::INT)::DOUBLE AS y FROM orders GROUP BY 1,2)"""


def label_history(t):
    quarter = F.date_trunc("quarter", "ts").cast("timestamp_ntz")
    out = t.order_events().groupBy("entity", quarter.alias("ts")).agg(
        F.max((F.col("o_totalprice") > 250000).cast("double")).alias("y"))
    return out.withColumn("available_at", F.col("ts") + F.expr("INTERVAL 90 DAYS"))


@query("A20_target_history", aligned_sql(
    f"{HISTORY}, {ORDER_REQ}, visible AS (SELECT r.cutoff, h.* FROM requests r JOIN hist h ON h.entity=r.entity AND h.ts<r.cutoff AND h.available_at<r.cutoff)",
    [("count(*)", "labels", "n"), ("avg(y)", "label_avg", "d"), ("sum(y)", "label_sum", "d"), ("arg_max(y, ts)", "label_latest", "d"),
     ("date_diff('microsecond', max(ts), cutoff)/86400e6", "label_age_days", "d")]))
def _(t):
    return rounded(fam.target_history(label_history(t), t.order_requests()))
