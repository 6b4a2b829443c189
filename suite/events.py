"""Event-path, response and exposure summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.functions.scalars import days, stamp
from asofkit.operators import events as ev
from asofkit.operators import exposure as ex
from asofkit.operators import families as fam
from asofkit.operators import joins as jn
from asofkit.operators import responses as rs
from asofkit.plans import paths as pl
from asofkit.requests import visible
from suite.core import K, LINE_VIS, order_lines
from suite.families import _MARKS, _TRAINING, HISTORY, _training_lines, label_history
from suite.model import catalog
from suite.registry import (
    EVENT_REQ, EVENT_VIS, N, ORDER_CUTS, ORDER_REQ, ORDER_VIS, OWN_REQ, R, aligned_sql, query, rounded, secs, since_sql,
)

DAY = 86_400


def after(d, time="ts"):
    return f"{time}>cutoff-to_microseconds({round(d * DAY * 1_000_000)})"


def _events_sql(d):
    return f"""{EVENT_REQ}, visible AS (SELECT r.entity, r.cutoff, e.* FROM requests r JOIN events e ON e.user_id=r.entity AND e.ts<=r.cutoff
      AND e.ts>r.cutoff-INTERVAL {d} DAY)"""


# Lines with part dimensions, inclusive clocks, at most 730 days back.
_WIDE = f"""{ORDER_REQ}, visible AS (SELECT r.entity, r.cutoff, l_shipdate AS ts, l.*, p_retailprice, p_size FROM requests r JOIN orders o ON o.o_custkey=r.entity AND o.o_orderdate<=r.cutoff
    JOIN lineitem l ON l.l_orderkey=o.o_orderkey AND l.l_shipdate<=r.cutoff AND l.l_shipdate>r.cutoff-INTERVAL 730 DAY LEFT JOIN part ON p_partkey=l_partkey)"""


def _wide(t):
    req = t.order_requests()
    rows = ev.window_rows(order_lines(t, req.latest()), req, 730, "known")
    return jn.dimension(rows, t.part, "l_partkey", "p_partkey", ["p_retailprice", "p_size"])


@query("A21_payload_profile", f"""WITH m AS (SELECT 'l_quantity' AS c, true AS num, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS v FROM lineitem WHERE l_shipdate<=TIMESTAMP '2000-01-01'
   UNION ALL SELECT 'l_linenumber', true, CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_shipdate<=TIMESTAMP '2000-01-01' UNION ALL SELECT 'l_returnflag', false, l_returnflag FROM lineitem WHERE l_shipdate<=TIMESTAMP '2000-01-01'
   UNION ALL SELECT 'l_linestatus', false, l_linestatus FROM lineitem WHERE l_shipdate<=TIMESTAMP '2000-01-01'),
  c AS (SELECT c, num, v, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT c, num, count(v) AS card, sum(n) AS rows FROM c GROUP BY ALL),
  nums AS (SELECT c AS "column", 'numeric' AS kind, NULL::VARCHAR AS value, 1.0::DOUBLE AS weight, row_number() OVER (ORDER BY c) AS place FROM p WHERE num),
  cats AS (SELECT c FROM p WHERE card<=16 ORDER BY c LIMIT 2),
  vals AS (SELECT c AS "column", 'category' AS kind, v AS value, n::DOUBLE AS weight, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS place FROM c SEMI JOIN cats USING (c))
  SELECT "column", kind, value, weight, {N('place')} AS place FROM nums UNION ALL SELECT "column", kind, value, weight, place FROM vals WHERE place<=4""")
def _(t):
    rows = t.lineitem.filter(F.col("l_shipdate") <= stamp("2000-01-01")).withColumn("l_quantity", F.col("l_quantity").cast("int"))
    out = ev.payload_profile(rows, ["l_quantity", "l_linenumber"], ["l_returnflag", "l_linestatus"])
    return out.withColumn("place", F.col("place").cast("long"))


def _subday():
    cols = []
    for h in ev.SUBDAY_HOURS:
        f = after(h / 24)
        cols += [(f"count(*) FILTER ({f})", f"h{h}_count", "n"), (f"count(value) FILTER ({f})", f"h{h}_value_support", "n"), (f"avg(value) FILTER ({f})", f"h{h}_value_mean", "d")]
    for h in ev.SUBDAY_HOURS[:-1]:
        cols.append((f"(count(*) FILTER ({after(h / 24)}))::DOUBLE/greatest(count(*) FILTER ({after(1)}),1)", f"h{h}_fraction", "z"))
    return cols


@query("A22_subday", aligned_sql(_events_sql(1), _subday()))
def _(t):
    req = t.event_requests()
    return rounded(ev.subday(req, ev.window_rows(t.user_events(), req, 1), ["value"]))


def _bands():
    cols = []
    for h in (24, 168):
        cols.append((f"count(*) FILTER ({after(h / 24)})", f"h{h}_count", "n"))
        for b in range(4):
            f = f"{after(h / 24)} AND floor(hour(ts)/6)={b}"
            cols += [(f"count(*) FILTER ({f})", f"h{h}_b{b}_count", "n"), (f"count(DISTINCT CAST(ts AS DATE)) FILTER ({f})", f"h{h}_b{b}_active_days", "n"),
                     (f"(count(*) FILTER ({f}))::DOUBLE/greatest(count(*) FILTER ({after(h / 24)}),1)", f"h{h}_b{b}_share", "z")]
    return cols


@query("A23_clock_bands", aligned_sql(_events_sql(7), _bands()))
def _(t):
    req = t.event_requests()
    return rounded(ev.clock_bands(req, ev.window_rows(t.user_events(), req, 7)))


def _numeric():
    cols = []
    for d in ev.NUMERIC_DAYS:
        cols.append((f"count(*) FILTER ({after(d)})", f"d{d}_count", "n"))
        for c in ("l_extendedprice", "p_retailprice"):
            f = f"FILTER ({after(d)} AND {c} IS NOT NULL)"
            cols += [(f"count({c}) {f}", f"d{d}_{c}_support", "n"), (f"avg({c}) {f}", f"d{d}_{c}_mean", "d"), (f"sum({c}) {f}", f"d{d}_{c}_sum", "z"),
                     (f"first({c} ORDER BY ts DESC, {c} ASC) {f}", f"d{d}_{c}_latest", "d")]
    return cols


@query("A24_numeric", aligned_sql(_WIDE, _numeric()))
def _(t):
    return rounded(ev.numeric(t.order_requests(), _wide(t), ["l_extendedprice", "p_retailprice"]))


def _condition():
    cols = [("count(*)", "all_support", "n")]
    for i, v in enumerate(("N", "R")):
        m = f"l_returnflag='{v}'"
        s = f"count(*) FILTER ({m})"
        cols += [(s, f"l_returnflag_v{i}_support", "n"), (f"({s})::DOUBLE/greatest(count(*),1)", f"l_returnflag_v{i}_share", "z"),
                 (f"count(l_quantity) FILTER ({m})", f"l_returnflag_v{i}_l_quantity_support", "n"), (f"sum(l_quantity) FILTER ({m})", f"l_returnflag_v{i}_l_quantity_sum", "z"),
                 (f"(sum(l_quantity) FILTER ({m}))/nullif(count(l_quantity) FILTER ({m}),0)", f"l_returnflag_v{i}_l_quantity_mean", "d")]
    return cols


@query("A25_conditional_summary", aligned_sql(_WIDE, _condition()))
def _(t):
    return rounded(ev.conditional(t.order_requests(), _wide(t), {"l_returnflag": ["N", "R"]}, ["l_quantity"]))


def _joint():
    cols = []
    names = ["l_quantity", "l_extendedprice", "p_size"]
    for d in ev.JOINT_DAYS:
        cols.append((f"count(*) FILTER ({after(d)})", f"d{d}_count", "n"))
        for i, j in pl.balanced_pairs(3, 2):
            a, b = names[i], names[j]
            f = f"FILTER ({after(d)} AND {a} IS NOT NULL AND {b} IS NOT NULL)"
            cols += [(f"count(*) {f}", f"d{d}_{a}_{b}_support", "n"), (f"avg({a}*{b}) {f}", f"d{d}_{a}_{b}_product_mean", "d"), (f"covar_pop({a},{b}) {f}", f"d{d}_{a}_{b}_covariance", "d"),
                     (f"(covar_pop({a},{b}) {f})/nullif((stddev_pop({a}) {f})*(stddev_pop({b}) {f}),0)", f"d{d}_{a}_{b}_correlation", "d")]
    return cols


@query("A26_joint_numeric", aligned_sql(_WIDE, _joint()))
def _(t):
    names = ["l_quantity", "l_extendedprice", "p_size"]
    pairs = [(names[i], names[j]) for i, j in pl.balanced_pairs(3, 2)]
    return rounded(ev.joint_numeric(t.order_requests(), _wide(t), pairs))


_M3 = "[0.25,0.5,0.75]"


@query("A27_joint_distribution", aligned_sql(
    f"{_TRAINING}, cuts AS (SELECT quantile_cont(l_quantity, {_M3}) AS qa, quantile_cont(l_extendedprice, {_M3}) AS qb FROM training), "
    + LINE_VIS.replace("l.* FROM requests r", "l.*, (SELECT qa FROM cuts) AS qa, (SELECT qb FROM cuts) AS qb FROM requests r"),
    [("avg(1.0)", "l_quantity_l_extendedprice_coverage", "d"),
     *[(f"avg((l_quantity<=qa[{i + 1}] AND l_extendedprice<=qb[{j + 1}])::INT)", f"l_quantity_l_extendedprice_cdf{i}{j}", "d") for i in range(3) for j in range(3)],
     *[x for i, v in enumerate(("A", "N", "R")) for x in (
         (f"avg((l_returnflag='{v}')::INT)", f"l_returnflag{i}_share", "d"),
         *[(f"avg((l_extendedprice<=qb[{j + 1}])::INT) FILTER (l_returnflag='{v}')", f"l_returnflag{i}_l_extendedprice_cdf{j}", "d") for j in range(3)])]]))
def _(t):
    cuts = fam.cutpoints(_training_lines(t), ["l_quantity", "l_extendedprice"], steps=3)
    aggs = [*fam.joint_cdf("l_quantity", "l_extendedprice", cuts["l_quantity"], cuts["l_extendedprice"]),
            *fam.category_cdf("l_returnflag", ["A", "N", "R"], "l_extendedprice", cuts["l_extendedprice"])]
    rows = visible(order_lines(t), t.order_requests(), "known")
    return rounded(t.order_requests().align(rows.groupBy(*K).agg(*aggs)))


# --- responses ------------------------------------------------------------------


def _marked_lines(t):
    return order_lines(t, ORDER_CUTS[-1]).withColumn("returned", (F.col("l_returnflag") == "R").cast("int")).withColumn(
        "still_open", (F.col("l_linestatus") == "O").cast("int"))


_TRAIN = "FROM lineitem JOIN orders ON o_orderkey=l_orderkey WHERE l_shipdate<TIMESTAMP '1998-01-01' AND o_orderdate<TIMESTAMP '1998-01-01'"


@query("A28_response_plan", f"""WITH f AS (SELECT (l_returnflag='R')::INT AS returned, (l_linestatus='O')::INT AS still_open, o_orderstatus, o_orderpriority, l_quantity {_TRAIN}),
  c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS v, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM f GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS place FROM c)
  SELECT 'returned' AS "column", 'response' AS kind, 0::BIGINT AS place, NULL AS value, {R('avg(returned)')} AS edge FROM f UNION ALL SELECT 'still_open', 'response', 0, NULL, {R('avg(still_open)')} FROM f
  UNION ALL SELECT "column", 'value', place, v, NULL FROM k WHERE place<=2
  UNION ALL SELECT 'l_quantity', 'edge', 1, NULL, {R('quantile_cont(l_quantity, 1.0/3)')} FROM f UNION ALL SELECT 'l_quantity', 'edge', 2, NULL, {R('quantile_cont(l_quantity, 2.0/3)')} FROM f""")
def _(t):
    rows = _marked_lines(t).filter(F.col("known") < stamp("1998-01-01"))
    marks = rs.binary_columns(rows, ["returned", "still_open", "l_linenumber", "l_quantity"])
    marks = marks.select("column", F.lit("response").alias("kind"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("value"), F.col("prevalence").alias("edge"))
    plan = rs.context_plan(rows, ["o_orderstatus", "o_orderpriority"], ["l_quantity"])
    return rounded(marks.unionByName(plan).withColumn("place", F.col("place").cast("long")), "edge")


H180 = 180 * DAY


def _ctx():
    y = "(l_returnflag='R')::INT"
    masks = {"l_linestatus": ["l_linestatus='F'", "l_linestatus NOT IN ('F')"], "l_quantity": ["l_quantity<=17", "l_quantity>17 AND l_quantity<=34", "l_quantity>34"]}
    cols = []
    for scope, cond in (("all", "true"), ("recent", since_sql(180))):
        rate = f"avg({y}) FILTER ({cond})"
        cols += [(f"count(*) FILTER ({cond})", f"{scope}_support", "n"), (rate, f"{scope}_rate", "d")]
        for c, ms in masks.items():
            for b, m in enumerate(ms):
                f = f"FILTER ({cond} AND {m})"
                cols += [(f"count(*) {f}", f"{scope}_{c}_b{b}_support", "n"), (f"sum({y}) {f}", f"{scope}_{c}_b{b}_responses", "z"),
                         (f"avg({y}) {f}", f"{scope}_{c}_b{b}_rate", "d"), (f"(avg({y}) {f})-({rate})", f"{scope}_{c}_b{b}_lift", "d")]
    return cols


@query("A29_response_contexts", aligned_sql(LINE_VIS, _ctx()))
def _(t):
    rows = visible(_marked_lines(t), t.order_requests(), "known")
    contexts = {"l_linestatus": {"values": ["F"]}, "l_quantity": {"edges": [17.0, 34.0]}}
    return rounded(rs.response_contexts(t.order_requests(), rows, "returned", contexts, H180))


PURCHASE = "(event_type='purchase')::INT"


def _momentum():
    h = 4
    cols = [(secs("max(ts) FILTER (event_type='purchase')", "cutoff"), "seconds_since_response", "d"),
            ("count(DISTINCT date_trunc('hour', ts)) FILTER (event_type='purchase')", "response_hours", "n")]
    for i, d in enumerate((h / 4, h / 2, h, 2 * h)):
        f = f"FILTER ({since_sql(d)})"
        cols += [(f"count(*) {f}", f"w{i}_support", "n"), (f"sum({PURCHASE}) {f}", f"w{i}_responses", "z"), (f"avg({PURCHASE}) {f}", f"w{i}_rate", "d")]
    a, b = f"FILTER ({since_sql(h)})", f"FILTER ({since_sql(2 * h)} AND NOT {since_sql(h)})"
    cols += [(f"coalesce(sum({PURCHASE}) {a},0)-coalesce(sum({PURCHASE}) {b},0)", "count_change", "z"), (f"avg({PURCHASE}) {a}-avg({PURCHASE}) {b}", "rate_change", "d")]
    return cols


def marked_events(t):
    return t.user_events().withColumn("response", (F.col("event_type") == "purchase").cast("int")).withColumn(
        "context", F.floor(F.col("value") / 20).cast("long"))


@query("A30_response_momentum", aligned_sql(EVENT_VIS, _momentum()))
def _(t):
    rows = visible(marked_events(t), t.event_requests())
    return rounded(rs.response_momentum(t.event_requests(), rows, "response", 4 * DAY))


@query("A31_own_label_history", f"""WITH {HISTORY}, {ORDER_REQ}, v AS (SELECT r.cutoff, h.* FROM requests r JOIN hist h ON h.entity=r.entity AND h.available_at<r.cutoff),
  prior AS (SELECT cutoff, avg(y) AS p FROM v GROUP BY 1),
  b AS (SELECT entity, cutoff, count(y) AS n, avg(y) AS m, stddev_pop(y) AS s, arg_max(y, available_at) AS l, {secs('max(available_at)', 'cutoff')} AS sec,
   count(y) FILTER (available_at>=cutoff-INTERVAL 360 DAY) AS rc, avg(y) FILTER (available_at>=cutoff-INTERVAL 360 DAY) AS rm,
   count(y) FILTER (available_at>=cutoff-INTERVAL 720 DAY) AS tc, avg(y) FILTER (available_at>=cutoff-INTERVAL 720 DAY) AS tm FROM v GROUP BY 1,2)
  SELECT r.entity, r.cutoff, {N('coalesce(n,0)')} AS history_count, {R('m')} AS history_mean, {R('s')} AS history_std, {R('l')} AS history_latest, {R('sec')} AS history_seconds,
   {N('coalesce(rc,0)')} AS recent_count, {R('rm')} AS recent_mean, {N('coalesce(tc,0)')} AS two_horizon_count, {R('tm')} AS two_horizon_mean,
   {R('(coalesce(m,0)*coalesce(n,0)+5*p)/(coalesce(n,0)+5)')} AS history_shrunk_mean FROM requests r LEFT JOIN b USING (entity, cutoff) LEFT JOIN prior USING (cutoff)""")
def _(t):
    return rounded(rs.own_history(t.order_requests(), label_history(t), 360 * DAY))


# --- exposure ----------------------------------------------------------------------


@query("A32_exposure_path", f"""WITH m AS (SELECT l_linenumber::DOUBLE AS x, 'l_linenumber' AS c FROM lineitem UNION ALL SELECT l_discount, 'l_discount' FROM lineitem UNION ALL SELECT l_quantity, 'l_quantity' FROM lineitem
   UNION ALL SELECT (l_returnflag='R')::INT, 'returned' FROM lineitem), s AS (SELECT c, count(DISTINCT x) AS d, min(x) AS lo, max(x) AS hi FROM m GROUP BY 1),
  r AS (SELECT c, d, CASE WHEN d=2 AND lo=0 AND hi=1 THEN 'response' WHEN d BETWEEN 2 AND 32 THEN 'context' WHEN d>32 AND lo>=0 AND hi<=1 THEN 'prior' END AS role FROM s)
  SELECT c AS "column", {N('d')} AS "distinct", role, p.object, p.parent FROM r, (VALUES ('part','orders'),('supplier','orders')) p(object, parent) WHERE role IS NOT NULL""")
def _(t):
    cat = catalog(t)
    lines = t.lineitem.withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    roles = ex.numeric_roles(lines, ["l_linenumber", "l_discount", "l_quantity", "returned"])
    # Roles are profile output; the walk over declared keys is metadata.
    walks = ex.discover(cat, "customer", {"lineitem": {"response": ["returned"], "context": ["l_linenumber"]}})
    named = F.array(*[F.struct(F.lit(w["object"]).alias("object"), F.lit(w["parent"]).alias("parent")) for w in walks])
    return roles.select("column", "distinct", "role", F.explode(named).alias("p")).select("column", "distinct", "role", "p.object", "p.parent")


def exposure_facts(t, until=ORDER_CUTS[-1]):
    lines = order_lines(t, until).withColumn("returned", (F.col("l_returnflag") == "R").cast("int")).withColumn(
        "hint", F.col("l_discount") * 4)
    return ex.events_view(lines, "o_orderkey", "l_partkey", "l_linenumber", "returned", "hint")


_EXP = f"""{LINE_VIS.replace('l_shipdate AS ts, o.*, l.*', "l_shipdate AS ts, o.o_orderkey AS search, l_partkey AS object, l_linenumber AS context, (l_returnflag='R')::INT AS response, least(1, greatest(0, l_discount*4)) AS prior")},
  tot AS (SELECT cutoff, count(*) AS tn, sum(response) AS tk FROM visible GROUP BY 1), u AS (SELECT cutoff, entity, count(*) AS un, sum(response) AS uk FROM visible GROUP BY 1,2),
  ub AS (SELECT cutoff, entity, coalesce((tk-uk)::DOUBLE/nullif(tn-un,0),0) AS base FROM u JOIN tot USING (cutoff)),
  a AS (SELECT cutoff, object, count(*) AS an, sum(response) AS ak FROM visible GROUP BY 1,2), uo AS (SELECT cutoff, entity, object, count(*) AS n, sum(response) AS k FROM visible GROUP BY 1,2,3),
  ac AS (SELECT cutoff, object, context, count(*) AS cn, sum(response) AS ck FROM visible GROUP BY 1,2,3), uc AS (SELECT cutoff, entity, object, context, count(*) AS n, sum(response) AS k FROM visible GROUP BY 1,2,3,4),
  po AS (SELECT uo.cutoff, uo.entity, uo.object, an-n AS peer_n, (ak-k+20*base)/(an-n+20) AS e FROM uo JOIN a USING (cutoff, object) JOIN ub USING (cutoff, entity)),
  pc AS (SELECT uc.cutoff, uc.entity, uc.object, uc.context, peer_n, e, cn-n AS peer_cn, (ck-k+10*e)/(cn-n+10) AS ec FROM uc JOIN ac USING (cutoff, object, context) JOIN po USING (cutoff, entity, object)),
  scored AS (SELECT v.*, peer_n, e, peer_cn, ec FROM visible v JOIN pc USING (cutoff, entity, object, context))"""


@query("A33_response_priors", f"""WITH {_EXP} SELECT entity, cutoff, object, context, {N('peer_n')} AS peer_n, {R('e', 6)} AS expected, {N('peer_cn')} AS peer_context_n, {R('ec', 6)} AS expected_context FROM pc""")
def _(t):
    return _priors(exposure_facts(t), t.order_requests())


def _priors(facts, req):
    _, scored = ex.scored_strata(facts, req, 180 * DAY)
    out = scored.select(*K, "object", F.col("context").cast("int").alias("context"), "peer_n", "expected", "peer_context_n", "expected_context")
    return rounded(out, places=6)


_OWN_EXP = f"""{OWN_REQ}, every AS (SELECT o_custkey AS entity, greatest(o_orderdate, l_shipdate) AS known, l_partkey AS object, l_linenumber AS context, (l_returnflag='R')::INT AS response FROM orders JOIN lineitem ON l_orderkey=o_orderkey),
  visible AS (SELECT r.cutoff, e.* FROM requests r JOIN every e ON e.entity=r.entity AND e.known<r.cutoff),
  tot AS (SELECT p.cutoff, count(*) AS tn, sum(response) AS tk FROM (SELECT DISTINCT cutoff FROM visible) p JOIN every e ON e.known<p.cutoff GROUP BY 1),
  a AS (SELECT p.cutoff, p.object, count(*) AS an, sum(response) AS ak FROM (SELECT DISTINCT cutoff, object FROM visible) p JOIN every e ON e.object=p.object AND e.known<p.cutoff GROUP BY 1,2),
  ac AS (SELECT p.cutoff, p.object, p.context, count(*) AS cn, sum(response) AS ck FROM (SELECT DISTINCT cutoff, object, context FROM visible) p JOIN every e ON e.object=p.object AND e.context=p.context AND e.known<p.cutoff GROUP BY 1,2,3),
  """ + _EXP[_EXP.index("u AS (SELECT"):_EXP.index("a AS (SELECT cutoff, object")] + _EXP[_EXP.index("uo AS (SELECT"):_EXP.index("ac AS (SELECT")] + _EXP[_EXP.index("uc AS (SELECT"):_EXP.index(",\n  scored AS")]


@query("A33_response_priors_own_cutoffs", f"""WITH {_OWN_EXP} SELECT entity, cutoff, object, context, {N('peer_n')} AS peer_n, {R('e', 6)} AS expected, {N('peer_cn')} AS peer_context_n, {R('ec', 6)} AS expected_context FROM pc""")
def _(t):
    return _priors(exposure_facts(t, None).drop("search", "prior"), t.own_order_requests())


_WINS = (("all", "true"), ("w0", since_sql(45)), ("w1", since_sql(90)), ("w2", since_sql(180)))


def _exposure():
    cols = []
    for w, c in _WINS:
        f = f"FILTER ({c})"
        cols += [(f"count(*) {f}", f"{w}_exposures", "n"), (f"sum(response) {f}", f"{w}_clicks", "z"), (f"avg(response) {f}", f"{w}_rate", "d"), (f"count(DISTINCT object) {f}", f"{w}_objects", "n"),
                 (f"count(DISTINCT search) {f}", f"{w}_searches", "n"), (f"count(DISTINCT date_trunc('hour', ts)) {f}", f"{w}_active_hours", "n"),
                 (f"date_diff('microsecond', max(ts) FILTER ({c} AND response=1), cutoff)/3600e6", f"{w}_hours_since_click", "d"),
                 (f"avg(e) {f}", f"{w}_expected_mean", "d"), (f"stddev_pop(e) {f}", f"{w}_expected_std", "d"), (f"min(e) {f}", f"{w}_expected_min", "d"), (f"max(e) {f}", f"{w}_expected_max", "d"),
                 (f"avg(ln(1+peer_n)) {f}", f"{w}_peer_support", "d"), (f"avg((peer_n>0)::INT) {f}", f"{w}_peer_coverage", "d"),
                 (f"avg(ec) {f}", f"{w}_context_expected_mean", "d"), (f"avg(ln(1+peer_cn)) {f}", f"{w}_context_support", "d")]
    return cols


@query("A34_exposure_quality", aligned_sql(_EXP, _exposure(), "").replace("FROM visible  GROUP BY entity, cutoff)", "FROM scored GROUP BY entity, cutoff)"))
def _(t):
    req = t.order_requests()
    rows, scored = ex.scored_strata(exposure_facts(t), req, 180 * DAY)
    act = ex.activity(rows, 180 * DAY)
    zero = [c for c in act.columns if c.endswith(("_exposures", "_clicks", "_objects", "_searches", "_active_hours"))]
    return rounded(req.align(act, zero=zero).join(ex.quality(scored), K, "left"))


def _residual():
    cols = []
    for label, e in (("prior", "prior"), ("object", "e"), ("context", "ec")):
        for w, c in _WINS:
            f = f"FILTER ({c})"
            if label == "prior":
                cols += [(f"avg(prior) {f}", f"{w}_prior_mean", "d"), (f"avg((prior IS NOT NULL)::INT) {f}", f"{w}_prior_coverage", "d")]
            cols += [(f"avg(response-{e}) {f}", f"{w}_{label}_residual_mean", "d"), (f"sum(response-{e}) {f}", f"{w}_{label}_residual_sum", "d"),
                     (f"avg((response>{e})::INT) {f}", f"{w}_{label}_positive", "d"), (f"avg((response<{e})::INT) {f}", f"{w}_{label}_negative", "d"),
                     (f"(sum(response-{e}) {f})/sqrt(1+(sum({e}*(1-{e})) {f}))", f"{w}_{label}_z", "d"), (f"sum(response*(1-{e})) {f}", f"{w}_{label}_unexpected", "d")]
    return cols


@query("A35_exposure_residuals", aligned_sql(_EXP, _residual()).replace("FROM visible  GROUP BY entity, cutoff)", "FROM scored GROUP BY entity, cutoff)"))
def _(t):
    req = t.order_requests()
    rows, scored = ex.scored_strata(exposure_facts(t), req, 180 * DAY)
    out = req.align(ex.given_prior_residuals(rows, 180 * DAY))
    for label, e in (("object", "expected"), ("context", "expected_context")):
        block = ex.residuals(scored, e, label)
        for w, _ in ex.WINDOWS:
            n = F.col(f"{w}_{label}_residual_mean")
            for c in ("residual_sum", "unexpected"):
                name = f"{w}_{label}_{c}"
                block = block.withColumn(name, F.when(n.isNotNull(), F.col(name)))
        out = out.join(block, K, "left")
    return rounded(out)


# --- marked response ---------------------------------------------------------------------


@query("A36_rarest_mark", f"""WITH e AS (SELECT 'events' AS route, m."column", avg(m.x) AS p FROM (SELECT 'purchase' AS "column", (event_type='purchase')::INT AS x FROM events WHERE ts<TIMESTAMP '2024-01-10'
   UNION ALL SELECT 'click', (event_type='click')::INT FROM events WHERE ts<TIMESTAMP '2024-01-10') m GROUP BY ALL
   UNION ALL SELECT 'orders<lineitem', 'returned', avg((l_returnflag='R')::INT) FROM lineitem JOIN orders ON o_orderkey=l_orderkey WHERE l_shipdate<TIMESTAMP '1998-01-01' AND o_orderdate<TIMESTAMP '1998-01-01'
   UNION ALL SELECT 'orders<lineitem', 'still_open', avg((l_linestatus='O')::INT) FROM lineitem JOIN orders ON o_orderkey=l_orderkey WHERE l_shipdate<TIMESTAMP '1998-01-01' AND o_orderdate<TIMESTAMP '1998-01-01')
  SELECT route, "column", {R('p', 6)} AS prevalence, CAST(row_number() OVER (ORDER BY p, route, "column") AS BIGINT) AS place FROM e""")
def _(t):
    events = t.user_events().filter(F.col("ts") < stamp("2024-01-10"))
    for v in ("purchase", "click"):
        events = events.withColumn(v, (F.col("event_type") == v).cast("int"))
    lines = _marked_lines(t).filter(F.col("known") < stamp("1998-01-01"))
    out = rs.rarest_mark({"events": (events, ["purchase", "click", "value"]),
                          "orders<lineitem": (lines, ["returned", "still_open", "l_linenumber"])})
    return rounded(out.select("route", "column", "prevalence", F.col("place").cast("long").alias("place")), "prevalence", places=6)


_HM = 3 * DAY


def _since_s(s, time="ts"):
    return f"{time}>=cutoff-to_microseconds({round(s * 1_000_000)})"


def _marked():
    pos = "event_type='purchase'"
    cols = [("count(*)", "exposures", "n"), (f"sum({PURCHASE})", "positive_events", "n"), (f"count(DISTINCT ts) FILTER ({pos})", "positive_arrivals", "n"),
            (f"{secs(f'max(ts) FILTER ({pos})', 'cutoff')}/{_HM}", "positive_recency", "d"), (f"{secs(f'max(ts) FILTER (NOT {pos})', 'cutoff')}/{_HM}", "negative_recency", "d")]
    for i, s in enumerate((1 / 3, 1, 4)):
        c = _since_s(_HM * s)
        cols += [(f"count(*) FILTER ({c})", f"w{i}_exposures", "n"), (f"sum({PURCHASE}) FILTER ({c})", f"w{i}_positives", "n"), (f"avg({PURCHASE}) FILTER ({c})", f"w{i}_rate", "d"),
                 (f"count(DISTINCT ts) FILTER ({c} AND {pos})", f"w{i}_positive_arrivals", "n"), (f"count(DISTINCT date_trunc('hour',ts)) FILTER ({c} AND {pos})", f"w{i}_positive_hours", "n")]
    return cols


def _marked_sql():
    base = aligned_sql(EVENT_VIS, _marked())
    head, tail = base.rsplit(" SELECT r.entity, r.cutoff, ", 1)
    gaps = f""", arr AS (SELECT DISTINCT entity, cutoff, ts FROM visible WHERE event_type='purchase'), g AS (SELECT *, {secs('lag(ts) OVER (PARTITION BY entity, cutoff ORDER BY ts)', 'ts')} AS gap FROM arr),
      ag AS (SELECT *, {secs('max(ts) OVER (PARTITION BY entity, cutoff)', 'cutoff')} AS age FROM g),
      gg AS (SELECT entity, cutoff, count(gap) AS gaps, avg(gap)/{_HM} AS mean_gap, median(gap)/{_HM} AS median_gap, stddev_pop(gap)/nullif(avg(gap),0) AS gap_cv,
        count(*) FILTER (gap>age) AS sv, count(*) FILTER (gap>age+{_HM}) AS fs FROM ag GROUP BY 1,2)"""
    extra = f"""CAST(coalesce(gaps,0) AS BIGINT) AS gaps, {R('mean_gap')} AS mean_gap, {R('median_gap')} AS median_gap, {R('gap_cv')} AS gap_cv, {R('CASE WHEN gaps>=3 THEN (fs+1.0)/(sv+1) END')} AS conditional_tail,
      {R('CASE WHEN gaps>=3 THEN sv::DOUBLE/gaps END')} AS tail_fraction, {R('CASE WHEN gaps>=3 THEN positive_recency/nullif(mean_gap,0) END')} AS age_over_mean_gap, """
    return f"{head}{gaps} SELECT r.entity, r.cutoff, {extra}{tail} LEFT JOIN gg USING (entity, cutoff)"


@query("A37_marked_timing", _marked_sql())
def _(t):
    out = rs.marked_timing(t.event_requests(), marked_events(t), _HM)
    out = out.withColumn("positive_events", F.col("positive_events").cast("long"))
    for i in range(3):
        out = out.withColumn(f"w{i}_positives", F.col(f"w{i}_positives").cast("long"))
    return rounded(out)


def _contexts_sql():
    ctes, cols, joins = [], [], []
    for w, s in enumerate((None, 1 / 3, 1, 4)):
        c = "true" if s is None else _since_s(_HM * s)
        ctes.append(f"""s{w} AS (SELECT entity, cutoff, c, count(*) AS n, sum(y) AS k FROM v WHERE {c} GROUP BY 1,2,3),
          x{w} AS (SELECT *, n::DOUBLE/sum(n) OVER (PARTITION BY entity, cutoff) AS f, (k+5*rate)/(n+5) AS p FROM s{w} JOIN own USING (entity, cutoff)),
          b{w} AS (SELECT entity, cutoff, count(*) AS a, count(*) FILTER (k>0) AS pc, max(f) AS m, -sum(f*ln(f)) AS e, avg(p) AS ra, stddev_pop(p) AS rs FROM x{w} GROUP BY 1,2)""")
        cols.append(f"""CAST(coalesce(b{w}.a,0) AS BIGINT) AS w{w}_contexts, CAST(coalesce(b{w}.pc,0) AS BIGINT) AS w{w}_positive_contexts, {R(f'b{w}.m')} AS w{w}_largest_share,
          {R(f'b{w}.e')} AS w{w}_entropy, {R(f'b{w}.ra')} AS w{w}_rate_mean, {R(f'b{w}.rs')} AS w{w}_rate_std""")
        joins.append(f"LEFT JOIN b{w} ON b{w}.entity=r.entity AND b{w}.cutoff=r.cutoff")
    return f"""WITH {EVENT_VIS}, v AS (SELECT *, {PURCHASE} AS y, floor(value/20) AS c FROM visible), own AS (SELECT entity, cutoff, avg(y) AS rate FROM v GROUP BY 1,2), {', '.join(ctes)}
      SELECT r.entity, r.cutoff, {', '.join(cols)} FROM requests r {' '.join(joins)}"""


@query("A38_marked_contexts", _contexts_sql())
def _(t):
    return rounded(rs.marked_contexts(t.event_requests(), marked_events(t), _HM))


def _attr_sql():
    ctes, cols, joins = [], [], []
    for w, d in enumerate((None, 180, 720)):
        c = "true" if d is None else since_sql(d)
        ctes.append(f"o{w} AS (SELECT entity, cutoff, c_mktsegment, c_nationkey, count(*) AS n, sum(y)::DOUBLE AS p FROM v WHERE {c} GROUP BY ALL)")
        ctes.append(f"t{w} AS (SELECT cutoff, count(*) AS r, sum(n) AS n, sum(p) AS p, sum(p/n) AS s, count(*) FILTER (p>0) AS q FROM o{w} GROUP BY 1)")
        joins += [f"LEFT JOIN o{w} ON o{w}.entity=r.entity AND o{w}.cutoff=r.cutoff", f"LEFT JOIN t{w} ON t{w}.cutoff=r.cutoff"]
        own = {"r": f"(o{w}.entity IS NOT NULL)::INT", "n": f"coalesce(o{w}.n,0)", "p": f"coalesce(o{w}.p,0)", "s": f"coalesce(o{w}.p/o{w}.n,0)", "q": f"coalesce((o{w}.p>0)::INT,0)"}
        for a in ("c_mktsegment", "c_nationkey"):
            g = f"g_{a}{w}"
            ctes.append(f"{g} AS (SELECT cutoff, {a}, count(*) AS r, sum(n) AS n, sum(p) AS p, sum(p/n) AS s, count(*) FILTER (p>0) AS q FROM o{w} GROUP BY 1,2)")
            joins.append(f"LEFT JOIN {g} ON {g}.cutoff=r.cutoff AND {g}.{a}=c.{a}")
            o = {k: f"(coalesce({g}.{k},0)-{own[k]})" for k in "rnpsq"}

            def prior(top, bottom):
                return f"((t{w}.{top}-{own[top]})/nullif((t{w}.{bottom}-{own[bottom]})::DOUBLE,0))"

            cols += [f"CAST({o['r']} AS BIGINT) AS {a}_w{w}_peers", f"{R('(' + o['p'] + '+20*' + prior('p', 'n') + ')/(' + o['n'] + '+20)')} AS {a}_w{w}_event_rate",
                     f"{R('(' + o['s'] + '+20*' + prior('s', 'r') + ')/(' + o['r'] + '+20)')} AS {a}_w{w}_root_rate", f"{R('(' + o['q'] + '+20*' + prior('q', 'r') + ')/(' + o['r'] + '+20)')} AS {a}_w{w}_positive_root_share"]
    return f"""WITH {LINE_VIS}, v AS (SELECT visible.*, (l_returnflag='R')::INT AS y, c_mktsegment, c_nationkey FROM visible JOIN customer ON c_custkey=entity), {', '.join(ctes)}
      SELECT r.entity, r.cutoff, {', '.join(cols)} FROM requests r JOIN customer c ON c.c_custkey=r.entity {' '.join(joins)}"""


@query("A39_attribute_priors", _attr_sql())
def _(t):
    facts = _marked_lines(t).select("entity", F.col("known").alias("seen"), "ts", "returned")
    # Lines shipped before their order date are known only once the order is.
    roots = t.customer.select(F.col("c_custkey").alias("entity"), "c_mktsegment", "c_nationkey")
    rows = facts.withColumn("response", F.col("returned"))
    out = rs.attribute_priors(t.order_requests(), rows, roots, ["c_mktsegment", "c_nationkey"], 180 * DAY, known="seen")
    return rounded(out.select(*[F.col(c).cast("long").alias(c) if c.endswith("_peers") else F.col(c) for c in out.columns]))


def _typed():
    h = 180
    cols = []
    vocab = [f"(SELECT v FROM voc WHERE rn={i})" for i in (1, 2, 3)]
    slots = [f"l_linenumber={v}" for v in vocab] + [f"l_linenumber NOT IN ({','.join(vocab)})"]
    for i, m in enumerate(slots):
        cols += [(f"count(*) FILTER ({m})", f"s{i}_count", "n"), (f"count(*) FILTER ({m} AND {since_sql(h / 4)})", f"s{i}_quarter", "n"), (f"count(*) FILTER ({m} AND {since_sql(h)})", f"s{i}_one", "n"),
                 (f"count(*) FILTER ({m} AND {since_sql(4 * h)})", f"s{i}_four", "n"), (f"{secs(f'max(ts) FILTER ({m})', 'cutoff')}/{h * DAY}", f"s{i}_last_age", "d"),
                 (f"sum(exp(-ln(2)*{secs('ts', 'cutoff')}/{4 * h * DAY})) FILTER ({m})", f"s{i}_decayed", "z")]
    return cols


@query("A40_typed_history", aligned_sql(
    f"voc AS (SELECT l_linenumber AS v, row_number() OVER (ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem WHERE l_shipdate<TIMESTAMP '1998-01-01' GROUP BY 1), {LINE_VIS}", _typed()))
def _(t):
    vocabulary = rs.code_vocabulary(t.lineitem.filter(F.col("l_shipdate") < stamp("1998-01-01")), "l_linenumber", 3)
    return rounded(rs.typed_history(t.order_requests(), order_lines(t), "l_linenumber", vocabulary, 180 * DAY, known="known"))
