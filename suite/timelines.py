"""Timelines, recurrence, breadth, window forms and channel unions (A51-A60, W, U)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from asofkit.functions.scalars import days, minus_seconds, seconds, stamp
from asofkit.operators import families as fam
from asofkit.operators import joins as jn
from asofkit.operators import timelines as tl
from asofkit.requests import visible
from asofkit.skew import lookup, previous
from suite.core import EXAMPLES, K, LINE_VIS, example_rows, order_lines
from suite.events import marked_events
from suite.families import HISTORY, label_history
from suite.model import catalog
from suite.registry import EVENT_REQ, EVENT_VIS, N, ORDER_REQ, ORDER_VIS, R, aligned_sql, query, rounded, secs, since_sql

DAY = 86_400


def order_channels(t):
    """Channel 0: orders; channel 1: shipped lines of the customer's orders."""
    a = t.order_events().select("entity", "ts", F.col("ts").alias("visible_at"), F.lit(0).alias("channel"))
    b = order_lines(t).select("entity", "ts", F.col("known").alias("visible_at"), F.lit(1).alias("channel"))
    return a.unionByName(b)


ORDER_CH = """ch AS (SELECT o_custkey AS entity, o_orderdate AS ts, o_orderdate AS visible_at, 0 AS channel FROM orders UNION ALL
  SELECT o_custkey, l_shipdate, greatest(l_shipdate, o_orderdate), 1 FROM orders JOIN lineitem ON l_orderkey=o_orderkey)"""


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def type_channels(t):
    """Each event type as a channel of its own."""
    number = F.array_position(F.array(*[F.lit(x) for x in EVENT_TYPES]), F.col("event_type")) - 1
    return t.user_events().select("entity", "ts", F.col("ts").alias("visible_at"), number.cast("int").alias("channel"))


TYPE_CH = f"""ch AS (SELECT user_id AS entity, ts, ts AS visible_at, CAST(list_position({list(EVENT_TYPES)!r}, event_type)-1 AS INT) AS channel FROM events)"""


def _timeline():
    d = "g"
    cols = [("count(*)", "active_days", "i"), ("sum(events)", "events", "i"), ("min(age)", "recency", "i"), ("max(age)-min(age)", "span", "i"), ("avg(gap)", "gap_mean", "d"), ("stddev_pop(gap)", "gap_std", "d"),
            ("median(gap)", "gap_median", "d"), ("quantile_cont(gap,0.9)", "gap_p90", "d"), ("max(gap)", "gap_max", "i"), ("avg(gap) FILTER (rank<=10)", "recent_gap", "d"), ("avg(gap) FILTER (rank BETWEEN 11 AND 30)", "older_gap", "d"),
            ("count(*) FILTER (gap>=30)", "long_gap_count", "n"), ("avg(channels)", "channels_per_day", "d"), ("max(events)", "daily_max", "i"), ("stddev_pop(events)", "daily_std", "d")]
    for w in tl.TIMELINE_DAYS:
        cols += [(f"sum(events) FILTER (age<{w})", f"events_{w}", "n"), (f"count(*) FILTER (age<{w})", f"days_{w}", "n"), (f"count(*) FILTER (age<{w} AND channels>1)", f"multichannel_days_{w}", "n"),
                 (f"max(events) FILTER (age<{w})", f"daily_peak_{w}", "i"), (f"count(DISTINCT date_trunc('week',day)) FILTER (age<{w})", f"weeks_{w}", "n")]
    cols += [(f"count(*) FILTER (dayofweek(day)={x})", f"weekday_{x}", "n") for x in range(7)]
    return cols


def _timeline_sql():
    base = aligned_sql(f"""{ORDER_CH}, {ORDER_REQ}, seen AS (SELECT r.cutoff, ch.* FROM requests r JOIN ch ON ch.entity=r.entity AND ts<cutoff AND visible_at<=cutoff AND ts>=cutoff-INTERVAL 730 DAY),
      dd AS (SELECT entity, cutoff, CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT channel) AS channels FROM seen GROUP BY ALL),
      visible AS (SELECT *, date_diff('day', day, CAST(cutoff AS DATE)) AS age, date_diff('day', lag(day) OVER (PARTITION BY entity, cutoff ORDER BY day), day) AS gap, row_number() OVER (PARTITION BY entity, cutoff ORDER BY day DESC) AS rank FROM dd),
      pc AS (SELECT entity, cutoff, {', '.join(f"count(*) FILTER (channel={c} AND ts>=cutoff-INTERVAL 90 DAY) AS e{c}, date_diff('day', CAST(max(ts) FILTER (channel={c}) AS DATE), CAST(cutoff AS DATE)) AS r{c}" for c in (0, 1))} FROM seen GROUP BY 1,2)""", _timeline())
    head, tail = base.rsplit(" SELECT r.entity, r.cutoff, ", 1)
    wd = [f"coalesce(b.weekday_{d},0)" for d in range(7)]
    total = "(" + "+".join(wd) + "+0.07)"
    ent = "-(" + "+".join(f"(({x}+0.01)/{total})*ln(({x}+0.01)/{total})" for x in wd) + ")"
    extra = [f"{R('gap_std/(1+gap_mean)')} AS gap_cv", f"{R('recency/(1+recent_gap)')} AS normalized_recency", f"{R('(1+older_gap)/(1+recent_gap)')} AS cadence_change", f"{R(ent)} AS weekday_entropy"]
    for a, b in ((7, 30), (30, 90), (90, 365)):
        extra.append(f"{R(f'((coalesce(days_{a},0)+0.5)/{a})/((coalesce(days_{b},0)+0.5)/{b})')} AS day_rate_change_{a}_{b}")
    for c in (0, 1):
        extra.append(f"CAST(coalesce(e{c},0) AS BIGINT) AS channel{c}_events_90, CAST(r{c} AS BIGINT) AS channel{c}_recency")
    return f"{head} SELECT r.entity, r.cutoff, {', '.join(extra)}, {tail} LEFT JOIN pc USING (entity, cutoff)"


def _ints(frame):
    return frame.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() in ("integer", "short") else F.col(f.name) for f in frame.schema.fields])


@query("A51_activity_timeline", _timeline_sql())
def _(t):
    return rounded(_ints(tl.timeline(t.order_requests(), order_channels(t), 2)))


_RC = [("count(*)", "active_days", "n"), ("sum(events)", "events", "n"), ("max(age)", "first_age", "d"), ("min(age)", "recency", "d"), ("avg(gap)", "gap_mean", "d"), ("median(gap)", "gap_median", "d"), ("quantile_cont(gap,0.9)", "gap_p90", "d"),
       ("max(gap)", "gap_max", "i"), ("stddev_pop(gap)", "gap_std", "d"), ("count(gap)", "gap_support", "n"), ("avg(gap) FILTER (rank<=10)", "recent_gap", "d"), ("avg(gap) FILTER (rank BETWEEN 11 AND 30)", "older_gap", "d"), ("max(gap) FILTER (rank=1)", "previous_gap", "i"),
       ("count(*) FILTER (gap>=90)", "returns_90", "n"), ("count(*) FILTER (gap>=365)", "returns_365", "n"), ("count(*) FILTER (age<365)", "days_365", "n"), ("count(*) FILTER (age<730)", "days_730", "n"),
       ("count(*) FILTER (gap>=cur)", "gaps_beyond", "n"), ("count(*) FILTER (gap>=cur AND gap<cur+90)", "gaps_next", "n"),
       ("min(age)/(1+median(gap))", "recency_over_median", "d"), ("min(age)/(1+quantile_cont(gap,0.9))", "recency_over_p90", "d"), ("(count(*) FILTER (gap>=cur))::DOUBLE/nullif(count(gap),0)", "gap_exceedance", "d"),
       ("(count(*) FILTER (gap>=cur AND gap<cur+90))::DOUBLE/nullif(count(*) FILTER (gap>=cur),0)", "conditional_gap_fraction", "d"), ("(1+(avg(gap) FILTER (rank BETWEEN 11 AND 30)))/(1+(avg(gap) FILTER (rank<=10)))", "cadence_change", "d"),
       ("count(*)-(count(*) FILTER (age<730))", "days_before_730", "n")]


def channel_sql(prefix, columns, rows="rows", channels=2):
    """Wide per-channel output from a long table with a channel column."""
    ctes, outer, joins = [], [], []
    for c, label in ((-1, "all"), *((c, f"c{c}") for c in range(channels))):
        inner = ", ".join(f"{e} AS {n}" for e, n, _ in columns)
        ctes.append(f"b_{label} AS (SELECT entity, cutoff, {inner} FROM {rows} WHERE channel={c} GROUP BY 1,2)")
        joins.append(f"LEFT JOIN b_{label} ON b_{label}.entity=r.entity AND b_{label}.cutoff=r.cutoff")
        for _, n, k in columns:
            v = f"b_{label}.{n}"
            e = {"n": f"CAST(coalesce({v},0) AS BIGINT)", "i": f"CAST({v} AS BIGINT)", "d": R(v), "z": R(f"coalesce({v},0)")}[k]
            outer.append(f"{e} AS {label}_{n}")
    return f"WITH {prefix}, {', '.join(ctes)} SELECT r.entity, r.cutoff, {', '.join(outer)} FROM requests r {' '.join(joins)}"


@query("A52_recurrence", channel_sql(f"""{ORDER_CH}, {ORDER_REQ}, past AS (SELECT r.cutoff, ch.* FROM requests r JOIN ch ON ch.entity=r.entity AND ts<cutoff AND visible_at<=cutoff),
  ex AS (SELECT * FROM past UNION ALL SELECT cutoff, entity, ts, visible_at, -1 FROM past), dd AS (SELECT entity, cutoff, channel, CAST(ts AS DATE) AS day, count(*) AS events, max(ts) AS last FROM ex GROUP BY ALL),
  rows AS (SELECT *, date_diff('day', lag(day) OVER w, day) AS gap, date_diff('microsecond', last, cutoff)/86400e6 AS age, row_number() OVER (PARTITION BY entity, cutoff, channel ORDER BY day DESC) AS rank,
   date_diff('microsecond', max(last) OVER (PARTITION BY entity, cutoff, channel), cutoff)/86400e6 AS cur FROM dd WINDOW w AS (PARTITION BY entity, cutoff, channel ORDER BY day))""", _RC))
def _(t):
    return rounded(_ints(tl.recurrence(t.order_requests(), order_channels(t), 2, 90)))


_HS = 4 * DAY


def _f(cond):
    return f"FILTER ({cond})"


_near, _quart = f"ts>=cutoff-to_microseconds({_HS * 1_000_000})", f"ts>=cutoff-to_microseconds({_HS * 250_000})"
_SQ = [("count(*)", "instants", "n"), ("sum(events)", "events", "n"), (f"max(age)/{_HS}", "age", "d"), (f"{secs('min(ts)', 'max(ts)')}/{_HS}", "span", "d"), ("count(gap)", "gap_support", "n"), (f"avg(gap)/{_HS}", "gap_mean", "d"),
       ("stddev_pop(gap)/nullif(avg(gap),0)", "gap_cv", "d"), (f"1+count(*) FILTER (gap>={_HS / 64})", "sessions_64", "n"), (f"1+count(*) FILTER (gap>={_HS / 16})", "sessions_16", "n"), (f"count(*) {_f(_near)}", "instants_h", "n"),
       (f"count(*) {_f(_quart)}", "instants_quarter", "n"), (f"sum(events) {_f(_near)}", "events_h", "n"), (f"sum(events) {_f(_quart)}", "events_quarter", "n"), (f"max(gap) FILTER (rank=1)/{_HS}", "latest_gap", "d"),
       (f"avg(gap) FILTER (rank<=8)/{_HS}", "recent_gap", "d"), (f"avg(gap) FILTER (rank BETWEEN 9 AND 32)/{_HS}", "older_gap", "d"), ("count(*) FILTER (gap>=age)", "gap_beyond_age", "n"), (f"count(*) FILTER (gap>=age+{_HS})", "gap_beyond_next", "n"),
       (f"median(gap)/{_HS}", "gap_median", "d"), (f"quantile_cont(gap,0.9)/{_HS}", "gap_p90", "d"), ("max(age)/nullif(median(gap),0)", "age_over_median", "d"), ("max(age)/nullif(avg(gap) FILTER (rank<=8),0)", "age_over_recent", "d"),
       ("(avg(gap) FILTER (rank BETWEEN 9 AND 32))/nullif(avg(gap) FILTER (rank<=8),0)", "cadence_change", "d"), (f"count(*)/(1+{secs('min(ts)', 'max(ts)')}/{_HS})", "instant_density", "d"),
       (f"(1+count(*) FILTER (gap>={_HS / 64}))/(1+{secs('min(ts)', 'max(ts)')}/{_HS})", "session_density", "d"),
       (f"CASE WHEN count(gap)>=3 THEN 1-((count(*) FILTER (gap>=age+{_HS}))+1)/((count(*) FILTER (gap>=age))+2) END", "return_sketch", "d"), ("(max(gap) FILTER (rank=1))/nullif(median(gap),0)", "last_over_median", "d")]


@query("A53_exact_sequence", channel_sql(f"""{TYPE_CH}, {EVENT_REQ}, ins AS (SELECT r.cutoff, ch.entity, channel, ts, count(*) AS events FROM requests r JOIN ch ON ch.entity=r.entity AND ts<least(cutoff, TIMESTAMP '2024-01-18') AND ts>=cutoff-INTERVAL 3650 DAY GROUP BY ALL),
  ex AS (SELECT entity, cutoff, channel, ts, events FROM ins UNION ALL SELECT entity, cutoff, -1, ts, sum(events) FROM ins GROUP BY ALL),
  rows AS (SELECT *, {secs('lag(ts) OVER w', 'ts')} AS gap, {secs('max(ts) OVER (PARTITION BY entity, cutoff, channel)', 'cutoff')} AS age, row_number() OVER (PARTITION BY entity, cutoff, channel ORDER BY ts DESC) AS rank FROM ex WINDOW w AS (PARTITION BY entity, cutoff, channel ORDER BY ts))""", _SQ, channels=len(EVENT_TYPES)))
def _(t):
    return rounded(tl.exact_sequence(t.event_requests(phase="2024-01-18"), type_channels(t), len(EVENT_TYPES), _HS))


def _trans():
    cols = []
    for w, d in enumerate((3, 12)):
        for a in range(len(EVENT_TYPES)):
            for b in range(len(EVENT_TYPES)):
                c = f"FILTER (pm & {1 << a} <> 0 AND mask & {1 << b} <> 0 AND age<{d})"
                cols += [(f"sum(mass) {c}", f"w{w}_{a}_{b}_count", "z"), (f"(sum(mass*gap) {c})/nullif(sum(mass) {c},0)", f"w{w}_{a}_{b}_gap", "d")]
    return cols


@query("A54_channel_transitions", aligned_sql(f"""{TYPE_CH}, {EVENT_REQ}, ins AS (SELECT entity, ts, bit_or(1::BIGINT << channel) AS mask FROM ch GROUP BY 1,2),
  o AS (SELECT r.cutoff, ins.*, lag(mask) OVER w AS pm, lag(ts) OVER w AS pt FROM requests r JOIN ins ON ins.entity=r.entity AND ts<cutoff WINDOW w AS (PARTITION BY ins.entity, r.cutoff ORDER BY ts)),
  visible AS (SELECT *, 1.0::DOUBLE/(bit_count(mask)*bit_count(pm)) AS mass, date_diff('microsecond', pt, ts)/86400e6 AS gap, date_diff('microsecond', ts, cutoff)/86400e6 AS age FROM o WHERE pt IS NOT NULL AND ts>cutoff-INTERVAL 12 DAY)""", _trans()))
def _(t):
    return rounded(tl.transitions(t.event_requests(), type_channels(t), len(EVENT_TYPES), 3))


def _km_sql(h):
    step = math.log(128 * 128) / 63

    def b(x):
        return f"CASE WHEN {x}<{h / 128} THEN 0 ELSE least(floor(ln({x}/{h / 128})/{step}+1e-12)+1, 64) END"

    def at(table, cohort, expr, label):
        return f"LEFT JOIN {table} {label} ON {label}.cutoff=s.cutoff AND {label}.cohort={cohort} AND {label}.bin={expr}"

    joins, cols = [], []
    for name, cohort in (("global", "-1"), ("peer", "s.cohort")):
        n = name[0]
        joins += [at("km", cohort, b("s.age"), n), at("km", cohort, f"({b('s.age')})-1", n + "a"), at("km", cohort, f"({b(f'(s.age+{h})')})-1", n + "b")]
        sa, sb = f"coalesce({n}a.s,1)", f"coalesce({n}b.s,1)"
        cols += [f"CASE WHEN {sa}>0 THEN greatest(0,least(1,1-{sb}/nullif({sa},0))) END AS {name}_return", f"{sa} AS {name}_tail", f"{n}.risk AS {name}_at_risk", f"{n}.closed AS {name}_closed", f"{n}.cens AS {name}_entities"]
    return f"""WITH {EVENT_REQ}, ins AS (SELECT DISTINCT user_id AS entity, ts FROM events), v AS (SELECT r.cutoff, ins.*, date_diff('microsecond', lag(ts) OVER (PARTITION BY ins.entity, r.cutoff ORDER BY ts), ts)/86400e6 AS gap FROM requests r JOIN ins ON ins.entity=r.entity AND ts<cutoff),
     su AS (SELECT entity, cutoff, least(floor(log2(count(DISTINCT CAST(ts AS DATE)))),6) AS cohort, date_diff('microsecond', max(ts), cutoff)/86400e6 AS age FROM v GROUP BY 1,2),
     iv AS (SELECT v.cutoff, cohort, gap AS d, 1 AS cl FROM v JOIN su USING (entity, cutoff) WHERE gap IS NOT NULL UNION ALL SELECT cutoff, cohort, age, 0 FROM su),
     al AS (SELECT * FROM iv UNION ALL SELECT cutoff, -1, d, cl FROM iv), hi AS (SELECT cutoff, cohort, {b('d')} AS bin, sum(cl) AS c, sum(1-cl) AS z FROM al GROUP BY ALL),
     de AS (SELECT g.cutoff, g.cohort, x.bin, coalesce(c,0) AS c, coalesce(z,0) AS z FROM (SELECT DISTINCT cutoff, cohort FROM hi) g CROSS JOIN (SELECT range AS bin FROM range(65)) x LEFT JOIN hi ON hi.cutoff=g.cutoff AND hi.cohort=g.cohort AND hi.bin=x.bin),
     rk AS (SELECT *, sum(c+z) OVER (PARTITION BY cutoff, cohort ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk, sum(c) OVER (PARTITION BY cutoff, cohort) AS closed, sum(z) OVER (PARTITION BY cutoff, cohort) AS cens FROM de),
     kp AS (SELECT *, 1-coalesce(c::DOUBLE/nullif(risk,0),0) AS k FROM rk), km AS (SELECT *, CASE WHEN max((k<=0)::INT) OVER w=1 THEN 0 ELSE exp(sum(CASE WHEN k>0 THEN ln(k) ELSE 0 END) OVER w) END AS s FROM kp WINDOW w AS (PARTITION BY cutoff, cohort ORDER BY bin)),
     o AS (SELECT s.entity, s.cutoff, s.cohort, {', '.join(cols)} FROM su s {' '.join(joins)})
     SELECT r.entity, r.cutoff, CAST(cohort AS BIGINT) AS cohort, {', '.join(f"{R(f'{x}_return')} AS {x}_return, {R(f'{x}_tail')} AS {x}_tail, CAST({x}_at_risk AS BIGINT) AS {x}_at_risk, CAST({x}_closed AS BIGINT) AS {x}_closed, CAST({x}_entities AS BIGINT) AS {x}_entities" for x in ('global', 'peer'))},
      {R('(peer_entities/(peer_entities+50))*peer_return+(1-peer_entities/(peer_entities+50))*global_return')} AS shrunk_return FROM requests r LEFT JOIN o USING (entity, cutoff)"""


@query("A55_peer_recurrence", _km_sql(3.0))
def _(t):
    return rounded(_ints(tl.peer_recurrence(t.event_requests(), t.user_events(), 3.0)))


def _breadth_sql(obj, h):
    cond = [since_sql(h * s) for s in (1 / 3, 1, 4)]
    fresh = [since_sql(h * s, "first") for s in (1 / 3, 1, 4)]
    cols = []
    for w in range(3):
        cols += [(f"count(*) FILTER (n{w}>0)", f"w{w}_objects", "n"), (f"sum(n{w})", f"w{w}_events", "n"), (f"count(*) FILTER (n{w}=1)", f"w{w}_singletons", "n"), (f"count(*) FILTER ({fresh[w]})", f"w{w}_new_objects", "n"),
                 (f"sum(n{w}) FILTER ({fresh[w]})", f"w{w}_new_events", "n"), (f"max(n{w})/nullif(sum(n{w}),0)::DOUBLE", f"w{w}_largest_share", "d"), (f"sum(n{w}::DOUBLE*n{w})/nullif(sum(n{w})::DOUBLE*sum(n{w}),0)", f"w{w}_concentration", "d")]
    n = ", ".join(f"count(*) FILTER ({c}) AS n{w}" for w, c in enumerate(cond))
    prefix = f"{LINE_VIS.replace('visible AS', 'raw AS')}, visible AS (SELECT entity, cutoff, {obj}, min(ts) AS first, {n} FROM raw WHERE ts>=cutoff-INTERVAL 730 DAY GROUP BY 1,2,3)"
    return aligned_sql(prefix, cols)


@query("A56_object_breadth", _breadth_sql("l_partkey", 180))
def _(t):
    return tl_rounded(tl.breadth(t.order_requests(), order_lines(t), "l_partkey", 180 * DAY, "known"))


def tl_rounded(frame):
    return rounded(_ints(frame))


@query("A56_object_paths", f"""WITH o AS (SELECT 'l_partkey' AS object_key, count(DISTINCT l_partkey) AS objects FROM lineitem WHERE l_shipdate<TIMESTAMP '1998-01-01' UNION ALL
  SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem WHERE l_shipdate<TIMESTAMP '1998-01-01' UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem WHERE l_shipdate<TIMESTAMP '1998-01-01')
  SELECT object_key, {N('objects')} AS objects, CAST(row_number() OVER (ORDER BY objects DESC, object_key) AS BIGINT) AS place FROM o WHERE objects>=64 QUALIFY place<=2""")
def _(t):
    rows = t.lineitem.filter(F.col("l_shipdate") < stamp("1998-01-01"))
    return _ints(tl.wide_object_keys(rows, ["l_partkey", "l_suppkey", "l_linenumber"]))


@query("A57_label_state", f"""WITH {HISTORY}, {ORDER_REQ}, a AS (SELECT *, row_number() OVER w AS n, avg(y) OVER (w ROWS UNBOUNDED PRECEDING) AS rate, avg(y) OVER (w ROWS 2 PRECEDING) AS m3, avg(y) OVER (w ROWS 4 PRECEDING) AS m5,
   list(y) OVER (w ROWS UNBOUNDED PRECEDING) AS ys, lag(y) OVER w AS py FROM hist WINDOW w AS (PARTITION BY entity ORDER BY available_at, ts)),
  b AS (SELECT *, list_reduce(ys, lambda p, x: (p+x)/2) AS ewma, last_value(CASE WHEN py IS DISTINCT FROM y THEN n END IGNORE NULLS) OVER w AS st, last_value(CASE WHEN y=1 THEN available_at END IGNORE NULLS) OVER w AS lp FROM a WINDOW w AS (PARTITION BY entity ORDER BY available_at, ts ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT r.cutoff, b.*, row_number() OVER (PARTITION BY r.entity, r.cutoff ORDER BY available_at DESC, ts DESC) AS rn FROM requests r JOIN b ON b.entity=r.entity AND b.available_at<r.cutoff)
  SELECT r.entity, r.cutoff, {R('y')} AS last, {N('coalesce(n,0)')} AS labels, {R('rate')} AS rate, {R('m3')} AS mean3, {R('m5')} AS mean5, {R('ewma')} AS ewma, {N('n-st+1')} AS run_length, {R('(n-st+1)*(2*y-1)')} AS signed_run,
   {R("date_diff('microsecond', available_at, r.cutoff)/86400e6")} AS days_since_observed, {R("date_diff('microsecond', lp, r.cutoff)/86400e6")} AS days_since_positive FROM requests r LEFT JOIN c ON c.entity=r.entity AND c.cutoff=r.cutoff AND rn=1""")
def _(t):
    return rounded(tl.label_state(t.order_requests(), label_history(t)))


@query("A58_sequence_basis", f"""WITH {ORDER_VIS}, b AS (SELECT entity, cutoff, count(*) AS n, count(*) FILTER ({since_sql(30)}) AS a, count(*) FILTER ({since_sql(365)}) AS c, date_diff('second', min(ts), max(ts)) AS span FROM visible GROUP BY 1,2)
  SELECT r.entity, r.cutoff, true AS valid, {R('coalesce(a,0)/30.0')} AS rate_30d, {R('coalesce(a,0)::DOUBLE/n')} AS share_30d, {R('coalesce(c,0)/365.0')} AS rate_365d, {R('coalesce(c,0)::DOUBLE/n')} AS share_365d, {R('coalesce(a,0)::DOUBLE/nullif(coalesce(c,0),0)')} AS burst_30v365,
   {R('span')} AS active_span_seconds, {R('n/(span/86400.0+1)')} AS activities_per_active_day FROM requests r LEFT JOIN b USING (entity, cutoff)""")
def _(t):
    req = t.order_requests()
    rows = visible(t.order_events(), req)
    frame = req.align(rows.groupBy(*K).agg(*fam.activity("ts", (30, 365)), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max")),
                      zero=["num_events_30d", "num_events_365d"])
    return rounded(tl.sequence_basis(frame, [30, 365]))


@query("A60_entity_timelines", f"""WITH {EXAMPLES}, {TYPE_CH}, picked AS (SELECT entity, cutoff FROM ex WHERE truth=1) SELECT p.entity, p.cutoff, CAST(channel AS BIGINT) AS channel, CAST(ts AS DATE) AS day, {N('count(*)')} AS events
  FROM picked p JOIN ch ON ch.entity=p.entity AND ts<p.cutoff GROUP BY ALL""")
def _(t):
    return _ints(tl.entity_timelines(type_channels(t), example_rows(t).filter("truth = 1"), t.event_requests()))


# --- window forms -----------------------------------------------------------------------


@query("W1_lag_gaps", f"""SELECT user_id AS entity, event_type, ts, {R(secs('lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)', 'ts'))} AS gap FROM (SELECT DISTINCT user_id, event_type, ts FROM events)""")
def _(t):
    rows = t.user_events().select("entity", "event_type", "ts").distinct()
    linked = previous(rows, ["entity", "event_type"], "ts", {"before": "ts"})
    return rounded(linked.select("entity", "event_type", "ts", seconds("before", "ts").alias("gap")))


@query("W2_recency_rank", f"""SELECT o_custkey AS entity, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS place FROM orders QUALIFY place<=30""")
def _(t):
    from asofkit.skew import top_rows

    out = top_rows(t.order_events(), ["entity"], [F.col("ts").desc(), F.col("o_orderkey").desc()], 30, "place")
    return out.select("entity", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("W3_partition_totals", f"""SELECT user_id AS entity, event_type, {R('count(*)::DOUBLE/sum(count(*)) OVER (PARTITION BY user_id)', 6)} AS share, max(max(ts)) OVER (PARTITION BY user_id) AS newest FROM events GROUP BY 1,2""")
def _(t):
    cells = t.user_events().groupBy("entity", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    whole = cells.groupBy("entity").agg(F.sum("n").alias("total"), F.max("last").alias("newest"))
    out = cells.join(whole, "entity")
    return rounded(out.select("entity", "event_type", (F.col("n") / F.col("total")).alias("share"), "newest"), "share", places=6)


@query("W4_running_forms", f"""WITH d AS (SELECT user_id AS entity, CAST(ts AS DATE) AS day, sum(value) AS v, count(*) FILTER (event_type='purchase') AS p FROM events GROUP BY 1,2)
  SELECT entity, day, {R('avg(v) OVER (w ROWS UNBOUNDED PRECEDING)')} AS expanding, {R('avg(v) OVER (w ROWS 2 PRECEDING)')} AS rolling3, {R('avg(v) OVER (w ROWS 4 PRECEDING)')} AS rolling5,
  last_value(CASE WHEN p>0 THEN day END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_purchase_day FROM d WINDOW w AS (PARTITION BY entity ORDER BY day)""")
def _(t):
    from pyspark.sql import Window

    daily = t.user_events().groupBy("entity", F.to_date("ts").alias("day")).agg(
        F.sum("value").alias("v"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("p"))
    w = Window.partitionBy("entity").orderBy("day")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return rounded(daily.select(
        "entity", "day", F.avg("v").over(so_far).alias("expanding"), F.avg("v").over(w.rowsBetween(-2, 0)).alias("rolling3"),
        F.avg("v").over(w.rowsBetween(-4, 0)).alias("rolling5"), F.last(F.when(F.col("p") > 0, F.col("day")), True).over(so_far).alias("last_purchase_day")))


@query("W5_survival_curve", f"""WITH g AS (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts)/86400e6 AS gap FROM (SELECT DISTINCT user_id, ts FROM events)),
  h AS (SELECT 0 AS cohort, CASE WHEN gap<{3 / 128} THEN 0 ELSE least(floor(ln(gap/{3 / 128})/{math.log(128 * 128) / 63}+1e-12)+1,64) END AS bin, count(*) AS c FROM g WHERE gap IS NOT NULL GROUP BY 2),
  d AS (SELECT range AS bin, coalesce(c,0) AS c FROM range(65) LEFT JOIN h ON h.bin=range), k AS (SELECT *, sum(c) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM d),
  q AS (SELECT *, 1-coalesce(c::DOUBLE/nullif(risk,0),0) AS kept FROM k) SELECT CAST(bin AS BIGINT) AS bin, CAST(risk AS BIGINT) AS risk,
  {R('CASE WHEN max((kept<=0)::INT) OVER w=1 THEN 0 ELSE exp(sum(CASE WHEN kept>0 THEN ln(kept) ELSE 0 END) OVER w) END', 6)} AS survival FROM q WINDOW w AS (ORDER BY bin)""")
def _(t):
    linked = previous(t.user_events().select("entity", "ts").distinct(), ["entity"], "ts", {"before": "ts"})
    bins = linked.filter("before IS NOT NULL").groupBy(tl.duration_bin(days("before", "ts"), 3.0).alias("bin")).agg(F.count(F.lit(1)).alias("closed"))
    hist = bins.withColumn("censored", F.lit(0).cast("long")).withColumn("cohort", F.lit(0))
    out = tl.survival_curves(hist, ["cohort"])
    return rounded(_ints(out.select("bin", "risk", "survival")), "survival", places=6)


# --- set forms ---------------------------------------------------------------------------


@query("U1_channel_union", f"""SELECT CAST(0 AS BIGINT) AS channel, {N('count(*)')} AS n, {N('count(DISTINCT user_id)')} AS entities, min(ts) AS first FROM events UNION ALL SELECT 1, count(*), count(DISTINCT o_custkey), min(o_orderdate) FROM orders""")
def _(t):
    cat = catalog(t)
    rows = tl.channel_rows(cat, tl.channels(cat, "customer"))
    return _ints(rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("entities"), F.min("ts").alias("first")))


@query("U2_all_channel", f"""WITH {TYPE_CH}, e AS (SELECT entity, channel FROM ch UNION ALL SELECT entity, -1 FROM ch) SELECT entity, CAST(channel AS BIGINT) AS channel, {N('count(*)')} AS n FROM e GROUP BY 1,2""")
def _(t):
    return _ints(tl.with_all(type_channels(t)).groupBy("entity", "channel").agg(F.count(F.lit(1)).alias("n")))


@query("U3_distinct_memberships", "SELECT DISTINCT o_custkey AS entity, l_suppkey FROM orders JOIN lineitem ON l_orderkey=o_orderkey")
def _(t):
    return order_lines(t).select("entity", "l_suppkey").distinct()


@query("U4_concatenate_frames", f"""SELECT split, {N('count(*)')} AS n, {N('count(o_orderpriority)')} AS with_priority, {N('count(l_linenumber)')} AS with_line FROM (
  SELECT 'orders' AS split, o_orderkey, o_orderpriority, NULL AS l_linenumber FROM orders UNION ALL SELECT 'lines', l_orderkey, NULL, l_linenumber FROM lineitem) GROUP BY 1""")
def _(t):
    a = t.orders.select(F.lit("orders").alias("split"), "o_orderkey", "o_orderpriority")
    b = t.lineitem.select(F.lit("lines").alias("split"), F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("with_priority"), F.count("l_linenumber").alias("with_line"))
