"""Scoring, paired uncertainty and selection."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from asofkit.functions.scalars import hash_unit, stamp
from asofkit.operators import evidence as ev
from suite.core import EXAMPLES, K, example_rows
from suite.families import HISTORY, label_history
from suite.registry import EVENT_REQ, N, ORDER_REQ, R, query, rounded

# Predictions: the observed label blended with content noise, by policy and seed.
POLICIES = (("incumbent", 0.30), ("alpha", 0.45), ("beta", 0.32), ("gamma", -0.30))
SEEDS = (0, 1, 2)
FIRST = "1999-01-01"


def evidence(t):
    policies = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(w).alias("w")) for p, w in POLICIES])
    rows = label_history(t).filter((F.col("ts") >= stamp(FIRST)) & (F.col("ts") < stamp("2000-01-01")))
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS]))).withColumn("_p", F.explode(policies))
    noise = hash_unit("entity", "ts", "seed", "_p.policy")
    prediction = F.round(F.col("_p.w") * F.col("y") + (1 - F.col("_p.w")) * noise, 3)
    return rows.select(F.col("ts").alias("origin"), "seed", F.col("_p.policy").alias("policy"), "entity", F.col("y").cast("int").alias("truth"), prediction.alias("prediction"))


EV = f"""{HISTORY}, ev AS (SELECT ts AS origin, s.seed, p.policy, entity, y::INT AS truth,
  round(p.w*y+(1-p.w)*(CAST('0x'||substr(md5(concat_ws('|', entity, CAST(ts AS VARCHAR), s.seed, p.policy)),1,8) AS BIGINT)/4294967296.0), 3)::DOUBLE AS prediction
  FROM hist, (VALUES (0),(1),(2)) s(seed), (VALUES {','.join(f"('{p}',{w}::DOUBLE)" for p, w in POLICIES)}) p(policy, w) WHERE ts>=TIMESTAMP '{FIRST}' AND ts<TIMESTAMP '2000-01-01')"""
KEYS = ["origin", "seed", "policy"]


def auc_sql(name, source, keys, score="prediction", truth="truth", weight="1"):
    """Area from tie-averaged counts of negatives below each distinct score."""
    k = ", ".join(keys)
    return f"""{name}_c AS (SELECT {k}, {score} AS sc, sum({truth}*{weight})::DOUBLE AS p, sum((1-{truth})*{weight})::DOUBLE AS n FROM {source} GROUP BY ALL), {name}_w AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY sc) AS below FROM {name}_c),
      {name} AS (SELECT {k}, sum(p*(below-n/2))/nullif(sum(p)*sum(n),0) AS auc, sum(p) AS positives, sum(n) AS negatives FROM {name}_w GROUP BY {k})"""


SC = auc_sql("au", "ev", KEYS)
ERR = "sqrt(greatest(0,(auc*(1-auc)+(positives-1)*(auc/greatest(1e-12,2-auc)-auc*auc)+(negatives-1)*(2*auc*auc/greatest(1e-12,1+auc)-auc*auc))/(positives*negatives)))"


@query("V3_scores", f"""WITH {EV}, {SC}, m AS (SELECT origin, seed, policy, avg(abs(truth-prediction)) AS mae, avg((truth=(prediction>=0.5)::INT)::INT) AS acc FROM ev GROUP BY ALL)
  SELECT au.origin, au.seed, au.policy, {R('auc', 6)} AS auc, {R('mae', 6)} AS mae, {R('acc', 6)} AS accuracy FROM au JOIN m USING (origin, seed, policy)""")
def _(t):
    rows = evidence(t).withColumn("predicted", (F.col("prediction") >= 0.5).cast("int"))
    out = ev.roc_auc(rows, KEYS).select(*KEYS, "auc").join(ev.mean_absolute_error(rows, KEYS).select(*KEYS, "mae"), KEYS)
    return rounded(out.join(ev.accuracy(rows, KEYS, "truth", "predicted").select(*KEYS, "accuracy"), KEYS), places=6)


@query("V4_standard_errors", f"""WITH {EV}, {SC}, m AS (SELECT origin, seed, policy, stddev_samp(abs(truth-prediction))/sqrt(count(*)) AS me, stddev_samp((truth=(prediction>=0.5)::INT)::INT)/sqrt(count(*)) AS ae FROM ev GROUP BY ALL)
  SELECT au.origin, au.seed, au.policy, {R(ERR, 6)} AS auc_error, {R('me', 6)} AS mae_error, {R('ae', 6)} AS accuracy_error FROM au JOIN m USING (origin, seed, policy)""")
def _(t):
    rows = evidence(t).withColumn("predicted", (F.col("prediction") >= 0.5).cast("int"))
    out = ev.auc_standard_error(ev.roc_auc(rows, KEYS)).select(*KEYS, "auc_error")
    out = out.join(ev.mean_absolute_error(rows, KEYS).select(*KEYS, "mae_error"), KEYS)
    return rounded(out.join(ev.accuracy(rows, KEYS, "truth", "predicted").select(*KEYS, "accuracy_error"), KEYS), places=6)


_PE = f"""{EXAMPLES}, c AS (SELECT cutoff, p, sum(1-truth) AS n FROM ex GROUP BY 1,2), w AS (SELECT *, sum(n) OVER (PARTITION BY cutoff ORDER BY p DESC) AS ab FROM c),
  pe AS (SELECT ex.*, CASE WHEN truth=1 THEN ab-n/2.0 ELSE 0 END AS pair_errors FROM ex JOIN w USING (cutoff, p))"""


@query("V5_pair_errors", f"""WITH {_PE} SELECT cutoff, {N('count(*) FILTER (recency>=1)')} AS rows, {N('coalesce(sum(truth) FILTER (recency>=1),0)')} AS positives, {R('avg(truth) FILTER (recency>=1)')} AS positive_rate, {R('(sum(truth) FILTER (recency>=1))::DOUBLE/nullif(sum(truth),0)')} AS share_of_positives,
  {R('(sum(pair_errors) FILTER (recency>=1))/nullif(sum(pair_errors),0)')} AS share_of_errors, {R('avg(p) FILTER (recency>=1 AND truth=1)')} AS positive_score, {R('avg(p) FILTER (recency>=1 AND truth=0)')} AS negative_score FROM pe GROUP BY 1""")
def _(t):
    rows = ev.pair_errors(example_rows(t), ["cutoff"], "p")
    return rounded(ev.cohort_summary(rows, F.col("recency") >= 1, ["cutoff"], "p"))


@query("V6_average_precision", f"""WITH {EV}, c AS (SELECT origin, seed, policy, prediction, sum(truth)::DOUBLE AS p, count(*)::DOUBLE AS n FROM ev GROUP BY ALL), w AS (SELECT *, sum(p) OVER x AS hits, sum(n) OVER x AS seen FROM c WINDOW x AS (PARTITION BY origin, seed, policy ORDER BY prediction DESC)),
  a AS (SELECT origin, seed, policy, sum(p*hits/seen)/nullif(sum(p),0) AS ap FROM w GROUP BY ALL), b AS (SELECT origin, seed, policy, avg((prediction-truth)*(prediction-truth)) AS br FROM ev GROUP BY ALL)
  SELECT origin, seed, policy, {R('ap', 6)} AS average_precision, {R('br', 6)} AS brier FROM a JOIN b USING (origin, seed, policy)""")
def _(t):
    rows = evidence(t)
    return rounded(ev.average_precision(rows, KEYS).join(ev.brier(rows, KEYS), KEYS), places=6)


@query("V7_fold_objective", f"""WITH {EV}, {SC} SELECT policy, {R('avg(auc)', 6)} AS mean_score, {R('stddev_pop(auc)/sqrt(count(auc))', 6)} AS score_error, {N('count(auc)')} AS folds, {R('avg(auc)-0.25*stddev_pop(auc)/sqrt(count(auc))', 6)} AS objective FROM au WHERE seed=0 GROUP BY 1""")
def _(t):
    scored = ev.roc_auc(evidence(t).filter("seed = 0"), KEYS)
    return rounded(ev.fold_objective(scored, ["policy"], "auc"), places=6)


@query("V8_frame_ensemble", f"""WITH {EV} SELECT origin, policy, entity, {R('avg(prediction)', 6)} AS prediction, {N('count(*)')} AS members FROM ev GROUP BY ALL""")
def _(t):
    return rounded(ev.frame_ensemble(evidence(t), ["origin", "policy", "entity"]), places=6)


_BLEND = f"""bl AS (SELECT * FROM ev UNION ALL SELECT a.origin, a.seed, a.policy||'__blend_'||w.l, a.entity, a.truth, (1-w.w)*c.prediction+w.w*a.prediction FROM ev a JOIN ev c ON c.origin=a.origin AND c.seed=a.seed AND c.entity=a.entity AND c.policy='incumbent', (VALUES ('0.125',0.125::DOUBLE),('0.5',0.5::DOUBLE)) w(l,w) WHERE a.policy<>'incumbent')"""
_WEIGHTS = [0.125, 0.5]


@query("V9_blend_grid", f"""WITH {EV}, {_BLEND} SELECT policy, {N('count(*)')} AS rows, {R('avg(prediction)', 6)} AS mean, {R('avg(abs(prediction-truth))', 6)} AS mae FROM bl GROUP BY 1""")
def _(t):
    rows = ev.blends(evidence(t), _WEIGHTS)
    return rounded(rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("prediction").alias("mean"), F.avg(F.abs(F.col("prediction") - F.col("truth"))).alias("mae")), places=6)


_COUNTS = "cn AS (SELECT o_custkey AS entity, date_trunc('quarter', o_orderdate) AS ts, count(*)::DOUBLE AS y, avg(o_totalprice) AS price FROM orders GROUP BY 1,2)"


def counts(t):
    q = F.date_trunc("quarter", "ts").cast("timestamp_ntz")
    return t.order_events().groupBy("entity", q.alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"), F.avg("o_totalprice").alias("price"))


@query("V10_target_projection", f"""WITH {_COUNTS}, d AS (SELECT min(y)>=0 AS nn, min(y)>=0 AND count(DISTINCT y)>=3 AND max(abs(y-round(y)))<=1e-10 AS ic FROM cn WHERE ts<TIMESTAMP '2000-01-01'), p AS (SELECT entity, ts, price/100000-1.5 AS prediction FROM cn WHERE ts>=TIMESTAMP '2000-01-01')
  SELECT entity, ts, {R('prediction')} AS prediction, {R('CASE WHEN nn THEN greatest(prediction,0) END')} AS nonnegative, {R('CASE WHEN ic THEN round_even(greatest(prediction,0),0) END')} AS integer_counts FROM p, d""")
def _(t):
    rows = counts(t)
    domain = ev.target_domain(rows.filter(F.col("ts") < stamp("2000-01-01")))
    held = rows.filter(F.col("ts") >= stamp("2000-01-01")).select("entity", "ts", (F.col("price") / 100000 - 1.5).alias("prediction"))
    return rounded(ev.project_target(held, domain))


def _mixture():
    lv = (0.0, *ev.MIXTURE_LEVELS)
    q = ["0.0", "greatest(0,q0)", "greatest(0,q0,q1)", "greatest(0,q0,q1,q2)", "greatest(0,q0,q1,q2,q3)", "greatest(0,q0,q1,q2,q3,q4)"]
    case = " ".join(f"WHEN aa<={lv[i + 1]} THEN {q[i]}+(aa-{lv[i]})/{lv[i + 1] - lv[i]!r}*({q[i + 1]}-{q[i]})" for i in range(5))
    return f"CASE WHEN p>0.5 THEN exp(CASE {case} ELSE {q[5]} END)-1 ELSE 0 END"


@query("V11_mixture_median", f"""WITH c AS (SELECT user_id AS entity, avg((value>5)::INT) AS p, {', '.join(f'quantile_cont(ln(1+value), {l}) FILTER (value>5) AS q{i}' for i, l in enumerate(ev.MIXTURE_LEVELS))} FROM events GROUP BY 1),
  a AS (SELECT *, greatest(0, 1-0.5/greatest(p,1e-12)) AS aa FROM c) SELECT entity, {R('p')} AS p, {R(_mixture())} AS median FROM a""")
def _(t):
    from asofkit.skew import percentiles

    rows = t.user_events()
    rate = rows.groupBy("entity").agg(F.avg((F.col("value") > 5).cast("double")).alias("p"))
    logs = rows.filter("value > 5").select("entity", F.log1p("value").alias("v"))
    names = {f"q{i}": level for i, level in enumerate(ev.MIXTURE_LEVELS)}
    out = rate.join(percentiles(logs, ["entity"], "v", names), "entity", "left")
    return rounded(out.select("entity", "p", ev.mixture_median("p", list(names)).alias("median")))


_BINS = 4
_ORD = f"""tr AS (SELECT user_id AS entity, value AS y FROM events WHERE ts<TIMESTAMP '2024-01-20'), q AS (SELECT quantile_cont(y, [0.25,0.5,0.75]) AS q FROM tr),
  tb AS (SELECT tr.*, (y>q[1])::INT+(y>q[2])::INT+(y>q[3])::INT AS bin FROM tr, q), md AS (SELECT bin, median(y) AS m FROM tb GROUP BY 1)"""


@query("V12_ordinal_median", f"""WITH {_ORD}, pr AS (SELECT entity, bin, count(*)::DOUBLE/sum(count(*)) OVER (PARTITION BY entity) AS p FROM tb GROUP BY 1,2), cu AS (SELECT *, sum(p) OVER (PARTITION BY entity ORDER BY bin) AS c FROM pr), f AS (SELECT entity, min(bin) AS bin FROM cu WHERE c>=0.5-1e-12 GROUP BY 1)
  SELECT entity, CAST(f.bin AS BIGINT) AS bin, {R('m')} AS prediction FROM f JOIN md ON md.bin=f.bin""")
def _(t):
    train = t.user_events().filter(F.col("ts") < stamp("2024-01-20")).select("entity", F.col("value").alias("y"))
    cuts, medians = ev.target_bins(train, _BINS)
    coded = train.withColumn("bin", ev.bin_of("y", cuts)).groupBy("entity", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = coded.groupBy("entity").agg(F.sum("n").alias("t"))
    shares = coded.join(total, "entity").withColumn("probability", F.col("n") / F.col("t"))
    return rounded(ev.ordinal_median(shares, medians, ["entity"]).withColumn("bin", F.col("bin").cast("long")))


_SCALE = "sc AS (SELECT o_custkey, count(*)::DOUBLE AS orders_count, sum(o_totalprice) AS spend, max((o_orderstatus='F')::INT)::DOUBLE AS any_f, avg(o_totalprice) AS y FROM orders GROUP BY 1)"


def _scale_one(c):
    return f"""SELECT '{c}' AS "column", (SELECT covar_pop(a,b)/nullif(stddev_pop(a)*stddev_pop(b),0) FROM (SELECT rank() OVER (ORDER BY {c})+(count(*) OVER (PARTITION BY {c})-1)/2.0 AS a, rank() OVER (ORDER BY y)+(count(*) OVER (PARTITION BY y)-1)/2.0 AS b FROM sc)) AS correlation, 1.0::DOUBLE AS coverage,
      quantile_cont({c},0.1) AS low, median({c}) AS fill, quantile_cont({c},0.9) AS high, count(DISTINCT {c}) AS d, min({c}) AS least FROM sc"""


@query("V13_exposure_scale", f"""WITH {_SCALE}, k AS ({' UNION ALL '.join(_scale_one(c) for c in ('any_f', 'orders_count', 'spend'))}), e AS (SELECT *, coalesce(least>=0 AND d>=16 AND (high+1)/(low+1)>=4 AND correlation>0, false) AS eligible FROM k)
  SELECT "column", {R('correlation')} AS correlation, coverage, {R('low', 2)} AS low, {R('fill', 2)} AS fill, {R('high', 2)} AS high, {N('d')} AS "distinct", eligible, CAST(row_number() OVER (ORDER BY eligible DESC, correlation DESC NULLS LAST, "column") AS BIGINT) AS place FROM e""")
def _(t):
    rows = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("orders_count"), F.sum("o_totalprice").alias("spend"),
        F.max((F.col("o_orderstatus") == "F").cast("double")).alias("any_f"), F.avg("o_totalprice").alias("y"))
    out = ev.exposure_scale(rows, ["orders_count", "spend", "any_f"], "y")
    out = out.withColumn("place", F.col("place").cast("long"))
    return rounded(rounded(out, "correlation"), "low", "fill", "high", places=2)


@query("V14_reliability", f"""WITH {EV}, a AS (SELECT entity, avg(prediction) FILTER (policy='incumbent') AS base, avg(prediction) FILTER (policy='alpha') AS extra FROM ev GROUP BY 1), f AS (SELECT c_custkey AS entity, c_acctbal, c_mktsegment, n AS orders_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate>=TIMESTAMP '2001-06-01' GROUP BY 1) ON o_custkey=c_custkey)
  SELECT a.entity, {R('abs(extra-base)')} AS disagreement, {R('extra-base')} AS signed_disagreement, {R('((c_acctbal IS NOT NULL)::INT+(orders_count IS NOT NULL)::INT)/2.0')} AS numeric_coverage, {R('ln(1+coalesce(orders_count,0))')} AS historical_support, {R('length(c_mktsegment)/2048.0', 6)} AS text_coverage FROM a JOIN f USING (entity)""")
def _(t):
    rows = evidence(t)
    wide = rows.groupBy("entity").agg(*[F.avg(F.when(F.col("policy") == p, F.col("prediction"))).alias(n) for p, n in (("incumbent", "base"), ("alpha", "extra"))])
    recent = t.orders.filter(F.col("o_orderdate") >= stamp("2001-06-01")).groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("orders_count"))
    frame = t.customer.select(F.col("c_custkey").alias("entity"), "c_acctbal", "c_mktsegment").join(recent, "entity", "left")
    out = ev.reliability(wide.join(frame, "entity"), "base", "extra", ["c_acctbal", "orders_count"], ["c_mktsegment"])
    out = out.select("entity", "disagreement", "signed_disagreement", "numeric_coverage", "historical_support", "text_coverage")
    return rounded(rounded(out, "disagreement", "signed_disagreement", "numeric_coverage", "historical_support"), "text_coverage", places=6)


def _poisson(u):
    total, term, parts = 0.0, math.exp(-1.0), []
    for k in range(12):
        total += term
        parts.append(f"({u}>={total!r})::INT")
        term /= k + 1
    return "(" + "+".join(parts) + ")"


def _pair(policy, source="ev"):
    return f"(SELECT a.origin, a.entity, a.truth, a.prediction AS control, b.prediction AS candidate FROM ev a JOIN {source} b ON a.origin=b.origin AND a.entity=b.entity AND a.seed=0 AND b.seed=0 AND a.policy='incumbent' AND b.policy='{policy}')"


REPEATS = 600


def _bound_sql(tag, policy, alpha, source="ev", repeats=REPEATS):
    u = "(CAST('0x'||substr(md5(concat_ws('|', entity, repeat//4)),CAST(1+8*(repeat%4) AS INT),8) AS BIGINT)/4294967296.0)"
    return f"""{tag}d AS (SELECT * FROM (SELECT p.*, r.repeat, {_poisson(u)} AS w FROM {_pair(policy, source)} p, (SELECT range AS repeat FROM range({repeats})) r) WHERE w>0),
      {tag}s AS (SELECT repeat, origin, 0 AS side, truth, control AS sc, w FROM {tag}d UNION ALL SELECT repeat, origin, 1, truth, candidate, w FROM {tag}d), {auc_sql(tag + 'a', tag + 's', ['repeat', 'origin', 'side'], 'sc', 'truth', 'w')},
      {tag}g AS (SELECT repeat, origin, CASE WHEN count(auc)=2 THEN sum(CASE WHEN side=1 THEN auc ELSE -auc END) END AS gain FROM {tag}a GROUP BY 1,2), {tag}n AS (SELECT max(origin) AS last, count(DISTINCT origin) AS n FROM ev),
      {tag}r AS (SELECT repeat, sum(CASE WHEN origin=last THEN 0.5 ELSE 0.5/greatest(1,n-1) END*gain) AS g FROM {tag}g, {tag}n GROUP BY repeat, n HAVING count(gain)=n),
      {tag} AS (SELECT '{policy}' AS policy, quantile_cont(g, {alpha}) AS lower_bound, count(*) AS repeats FROM {tag}r)"""


@query("V15_gain_lower_bound", f"""WITH {EV}, {', '.join(_bound_sql('b' + p[0], p, 0.05) for p in ('alpha', 'beta'))} SELECT policy, {R('lower_bound', 6)} AS lower_bound, {N('repeats')} AS repeats FROM (SELECT * FROM ba UNION ALL SELECT * FROM bb)""")
def _(t):
    return rounded(ev.gain_lower_bounds(evidence(t), ["alpha", "beta"], REPEATS, 0.05), places=6)


@query("V16_recent_resample", f"""WITH {EV}, p AS (SELECT * FROM {_pair('alpha')} WHERE origin=(SELECT max(origin) FROM ev)), e AS (SELECT entity, row_number() OVER (ORDER BY CAST('0x'||substr(md5(CAST(entity AS VARCHAR)),1,8) AS BIGINT), entity)-1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT entity FROM p)),
  d AS (SELECT r.range AS repeat, CAST('0x'||substr(md5(concat_ws('|', r.range, place)),1,8) AS BIGINT)%n AS place, count(*) AS w FROM e, range({REPEATS}) r GROUP BY 1,2), x AS (SELECT repeat, w, p.* FROM d JOIN e USING (place) JOIN p USING (entity)),
  s AS (SELECT repeat, 0 AS side, truth, control AS sc, w FROM x UNION ALL SELECT repeat, 1, truth, candidate, w FROM x), {auc_sql('a', 's', ['repeat', 'side'], 'sc', 'truth', 'w')}, g AS (SELECT repeat, sum(CASE WHEN side=1 THEN auc ELSE -auc END) AS gain FROM a GROUP BY 1 HAVING count(auc)=2)
  SELECT 'alpha' AS policy, {R('quantile_cont(gain, 0.05)', 6)} AS recent_lower_bound, {N('count(*)')} AS repeats FROM g""")
def _(t):
    return rounded(ev.recent_resample(evidence(t), "alpha", REPEATS, 0.05), places=6)


_PS = f"{SC}, ps AS (SELECT a.*, a.auc-c.auc AS gain, 0.005 AS cap FROM au a JOIN au c ON c.origin=a.origin AND c.seed=a.seed AND c.policy='incumbent')"


def admission_sql(policies, source="ev", repeats=REPEATS):
    """The admission rule over a menu of challengers scored on ``source`` rows."""
    tags = [f"b{i}" for i in range(len(policies))]
    scored = _PS if source == "ev" else _PS.replace(SC, auc_sql("au", source, KEYS))
    bounds = ", ".join(_bound_sql(g, p, 0.05 / len(policies), source, repeats) for g, p in zip(tags, policies))
    extra = "" if source == "ev" else f"{_BLEND}, "
    return f"""WITH {EV}, {extra}{scored}, {bounds}, bo AS ({' UNION ALL '.join(f'SELECT * FROM {g}' for g in tags)}), la AS (SELECT max(origin) AS last FROM ev),
  st AS (SELECT policy, max(gain) FILTER (origin=last AND seed=0) AS rg, min(gain) FILTER (origin=last) AS ws, max((origin<>last AND seed=0 AND gain<-cap)::INT) AS ol FROM ps, la WHERE policy<>'incumbent' GROUP BY 1),
  de AS (SELECT st.*, lower_bound, CASE WHEN rg<=0 THEN 'no_recent_improvement' WHEN ws<=0 THEN 'recent_gain_not_seed_stable' WHEN ol=1 THEN 'older_origin_regression' WHEN lower_bound IS NULL OR lower_bound<=0 THEN 'no_confident_temporal_improvement' ELSE 'eligible' END AS reason FROM st LEFT JOIN bo USING (policy))
  SELECT policy, {R('rg', 6)} AS recent_gain, {R('ws', 6)} AS worst_recent_seed, {R('lower_bound', 6)} AS lower_bound, reason, (reason='eligible' AND row_number() OVER (ORDER BY (reason='eligible') DESC, rg DESC, policy)=1) AS selected FROM de"""


@query("V17_admission", admission_sql(("alpha", "beta", "gamma")))
def _(t):
    rows = evidence(t)
    bounds = ev.gain_lower_bounds(rows, ["alpha", "beta", "gamma"], REPEATS, 0.05 / 3)
    return rounded(ev.admission(ev.paired_scores(rows), bounds), places=6)


# Trials: one configuration per policy, its width and depth fixed by name.
_WIDTH = {"incumbent": (400, 3), "alpha": (900, 4), "beta": (150, 2), "gamma": (60, 1)}
_TRIALS = f"{SC}, wd AS (SELECT * FROM (VALUES {','.join(f'({chr(39)}{p}{chr(39)},{w},{c})' for p, (w, c) in _WIDTH.items())}) v(config, features, complexity)), la AS (SELECT max(origin) AS last FROM ev), ae AS (SELECT *, {ERR} AS err FROM au)"


def trials(t):
    scored = ev.auc_standard_error(ev.roc_auc(evidence(t), KEYS)).withColumnRenamed("policy", "config")
    shape = F.create_map(*[x for p, (w, c) in _WIDTH.items() for x in (F.lit(p), F.struct(F.lit(w).alias("features"), F.lit(c).alias("complexity")))])
    last = scored.agg(F.max("origin").alias("m")).scalar()
    return scored.withColumn("_w", shape[F.col("config")]).select(
        "config", "seed", "origin", "auc", "auc_error", F.col("_w.features").alias("features"), F.col("_w.complexity").alias("complexity"),
        (F.col("origin") == last).alias("recent"))


@query("V18_small_finalist", f"""WITH {EV}, {_TRIALS}, r AS (SELECT policy AS config, seed, 1-auc AS loss, features, complexity FROM au JOIN wd ON config=policy, la WHERE origin=last), b AS (SELECT seed, min(loss) AS best FROM r GROUP BY 1),
  g AS (SELECT config, min(features) AS features, min(complexity) AS complexity, min((loss<=best*1.5+1e-12)::INT) AS ok, avg(loss) AS ml FROM r JOIN b USING (seed) GROUP BY 1), e AS (SELECT *, config<>'alpha' AND features<900 AND ok=1 AS eligible FROM g)
  SELECT config, {N('features')} AS features, {N('complexity')} AS complexity, {R('ml', 6)} AS mean_loss, eligible, (eligible AND row_number() OVER (ORDER BY eligible DESC, features, complexity, config)=1) AS chosen FROM e""")
def _(t):
    rows = trials(t).filter("recent").select("config", "seed", "features", "complexity", F.col("auc").alias("recent_score"))
    out = ev.small_finalist(rows, "alpha", cap=0.5)
    return rounded(out.withColumn("features", F.col("features").cast("long")).withColumn("complexity", F.col("complexity").cast("long")), places=6)


_OBJ = f"ob AS (SELECT policy AS config, avg(auc) AS score, avg(auc)-0.25*stddev_pop(auc)/sqrt(count(*)) AS objective, avg(err) AS error, max(auc) FILTER (origin=last) AS rs, max(err) FILTER (origin=last) AS re, min(features) AS features, min(complexity) AS complexity FROM ae JOIN wd ON config=policy, la WHERE seed=0 GROUP BY 1)"


def objectives(t):
    rows = trials(t).filter("seed = 0")
    n = F.count(F.lit(1))
    return rows.groupBy("config").agg(
        F.avg("auc").alias("score"), (F.avg("auc") - 0.25 * F.stddev_pop("auc") / F.sqrt(n)).alias("objective"), F.avg("auc_error").alias("error"),
        F.max(F.when(F.col("recent"), F.col("auc"))).alias("recent_score"), F.max(F.when(F.col("recent"), F.col("auc_error"))).alias("recent_error"),
        F.min("features").cast("long").alias("features"), F.min("complexity").cast("long").alias("complexity"))


@query("V19_confidence_frontier", f"""WITH {EV}, {_TRIALS}, {_OBJ}, b AS (SELECT * FROM ob ORDER BY objective DESC, features, complexity, config LIMIT 1)
  SELECT ob.config, {R('ob.objective', 6)} AS objective, {R('ob.error', 6)} AS error, {N('ob.features')} AS features, {N('ob.complexity')} AS complexity, CAST(row_number() OVER (ORDER BY ob.objective DESC, ob.features, ob.complexity, ob.config) AS BIGINT) AS place
  FROM ob, b WHERE b.objective-ob.objective<=greatest(0.01, 4*sqrt(b.error*b.error+ob.error*ob.error))""")
def _(t):
    out = ev.confidence_frontier(objectives(t).select("config", "objective", "error", "features", "complexity"), multiplier=4.0)
    return rounded(out.withColumn("place", F.col("place").cast("long")), places=6)


@query("V20_negligible_gain", f"""WITH {EV}, {_TRIALS}, {_OBJ}, o AS (SELECT *, row_number() OVER (ORDER BY config DESC) AS number FROM ob), p AS (SELECT a.number, b.score AS ps, b.error AS pe, b.features AS pf, row_number() OVER (PARTITION BY a.number ORDER BY b.objective DESC, b.number) AS rn FROM o a JOIN o b ON b.number<a.number AND b.features<=a.features AND b.complexity<=a.complexity)
  SELECT CAST(o.number AS BIGINT) AS number, config, {R('score-ps', 6)} AS gain, {R('features::DOUBLE/greatest(1,pf)')} AS growth, {R('greatest(0.002, sqrt(error*error+pe*pe))', 6)} AS threshold, coalesce(features::DOUBLE/greatest(1,pf)>=2 AND score-ps<=greatest(0.002, sqrt(error*error+pe*pe)), false) AS negligible
  FROM o LEFT JOIN p ON p.number=o.number AND rn=1""")
def _(t):
    from pyspark.sql import Window

    rows = objectives(t).withColumn("number", F.row_number().over(Window.orderBy(F.desc("config"))).cast("long"))
    out = ev.negligible_gains(rows.select("number", "config", "score", "objective", "error", "features", "complexity"))
    # A first trial has no simpler one: greatest() ignores the missing error there.
    out = out.withColumn("threshold", F.when(F.col("gain").isNull(), F.lit(0.002)).otherwise(F.col("threshold")))
    return rounded(rounded(out, "gain", "threshold", places=6), "growth")


# Episodes: one per origin, candidates are (policy, seed) with a hashed ranking.
_PRED = "(CAST('0x'||substr(md5(concat_ws('|', CAST(origin AS VARCHAR), policy, seed)),1,8) AS BIGINT)/4294967296.0)"
_CAND = f"""{SC}, ca AS (SELECT CAST(origin AS VARCHAR) AS episode, CAST(year(origin) AS VARCHAR)||'-'||quarter(origin)%2 AS database, CASE WHEN quarter(origin)<=2 THEN 'classification' ELSE 'regression' END AS task_type, 'rerank' AS stage, policy||'/'||seed AS candidate,
  CASE WHEN {_PRED}<0.2 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN {_PRED}>=0.2 THEN auc END AS objective, {_PRED} AS predicted FROM au)"""


def episodes(t):
    scored = ev.roc_auc(evidence(t), KEYS)
    predicted = hash_unit("origin", "policy", "seed")
    failed = predicted < 0.2
    one = F.struct(
        F.concat("policy", F.lit("/"), F.col("seed").cast("string")).alias("candidate"), F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(~failed, F.col("auc")).alias("objective"), predicted.alias("predicted"))
    database = F.concat(F.year("origin").cast("string"), F.lit("-"), (F.quarter("origin") % 2).cast("string"))
    kind = F.when(F.quarter("origin") <= 2, "classification").otherwise("regression")
    return scored.groupBy(F.col("origin").cast("string").alias("episode"), database.alias("database"), kind.alias("task_type")).agg(
        F.collect_list(one).alias("observations")).withColumn("stage", F.lit("rerank"))


_REL = "re AS (SELECT *, CASE WHEN status<>'completed' THEN 0 WHEN hi-lo<=1e-12 THEN 1 ELSE 1+99*(objective-lo)/(hi-lo) END AS relevance FROM (SELECT *, min(objective) OVER (PARTITION BY episode) AS lo, max(objective) OVER (PARTITION BY episode) AS hi FROM ca))"


@query("V21_ranker_evaluation", f"""WITH {EV}, {_CAND}, pl AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY predicted DESC, candidate) AS p FROM ca),
  s AS (SELECT episode, database, task_type, stage, count(*) AS n, arg_max(candidate, objective) FILTER (status='completed') AS best, max(objective) AS hi, min(objective) AS lo, max(candidate) FILTER (p=1) AS selected, max(objective) FILTER (p=1 AND status='completed') AS got, list(candidate) FILTER (p<=3) AS top FROM pl GROUP BY ALL)
  SELECT episode, database, task_type, stage, {N('n')} AS candidates, best, selected, {R('hi-got', 6)} AS raw_regret, {R('CASE WHEN got IS NULL THEN 1 WHEN hi-lo>1e-12 THEN (hi-got)/(hi-lo) ELSE 0 END', 6)} AS normalized_regret, CASE WHEN got IS NULL THEN 1 WHEN hi-lo>1e-12 THEN (hi-got)/(hi-lo) ELSE 0 END<=0.01 AS within_tolerance,
   list_contains(top, best) AS top_k_recall, got IS NULL AS selected_failed FROM s""")
def _(t):
    return rounded(ev.evaluate_ranker(ev.candidate_rows(episodes(t))), places=6)


@query("V22_candidate_rows", f"""WITH {EV}, {_CAND}, {_REL} SELECT episode, database, task_type, stage, candidate, status, {R('objective', 6)} AS objective, {R('predicted', 6)} AS predicted, {R('relevance')} AS relevance FROM re""")
def _(t):
    out = ev.candidate_rows(episodes(t))
    return rounded(rounded(out, "objective", "predicted", places=6), "relevance")


@query("V22_corpus_summary", f"""WITH {EV}, {_CAND} SELECT stage, {N('count(DISTINCT episode)')} AS episodes, {N('count(DISTINCT database)')} AS databases, {N('count(*)')} AS candidates FROM ca GROUP BY 1""")
def _(t):
    return ev.corpus_summary(episodes(t))


@query("V23_rerank_choice", f"""WITH {EV}, {_TRIALS}, {_OBJ}, wf AS (SELECT config FROM ob ORDER BY objective DESC, features, complexity, config LIMIT 1), ld AS (SELECT rs, re FROM ob ORDER BY rs DESC, features, complexity, config LIMIT 1),
  sf AS (SELECT ob.*, NOT (ld.rs-ob.rs>greatest(0.01, 4*sqrt(ld.re*ld.re+ob.re*ob.re))) AS safe FROM ob, ld), sb AS (SELECT * FROM sf WHERE safe ORDER BY objective DESC, features, complexity, config LIMIT 1),
  pl AS (SELECT a.policy AS config, stddev_pop(b.auc-a.auc)/sqrt(count(*)) AS pe FROM au a JOIN au b ON a.origin=b.origin AND a.seed=0 AND b.seed=0 JOIN sb ON sb.config=b.policy GROUP BY 1),
  ti AS (SELECT sf.*, coalesce(safe AND sb.score-sf.score<=least(greatest(0.002, 4*pe), 0.3)+1e-12 AND sf.features*2<=sb.features, false) AS tie FROM sf JOIN pl USING (config), (SELECT score, features FROM sb) sb)
  SELECT ti.config, ti.config=(SELECT config FROM wf) AS walk_forward_best, safe AS recent_safe, ti.config=(SELECT config FROM sb) AS recent_safe_best, tie AS practical_tie,
   CASE WHEN max(tie::INT) OVER ()=1 THEN tie AND row_number() OVER (ORDER BY tie DESC, features, complexity, objective DESC, config)=1 ELSE ti.config=(SELECT config FROM sb) END AS recommended FROM ti""")
def _(t):
    folds = trials(t).filter("seed = 0").select("config", F.col("origin").alias("fold"), F.col("auc").alias("score"))
    return ev.rerank_choice(objectives(t), folds, multiplier=4.0, cap=0.3)


@query("V24_early_vetoes", f"""WITH {EV.replace('ev AS (', 'full_ev AS (')}, ev AS (SELECT * FROM full_ev WHERE NOT (origin=TIMESTAMP '1999-10-01' AND seed=1)), {_BLEND}, {auc_sql('au', 'bl', KEYS)}, ps AS (SELECT a.*, a.auc-c.auc AS gain FROM au a JOIN au c ON c.origin=a.origin AND c.seed=a.seed AND c.policy='incumbent' WHERE a.policy<>'incumbent'),
  r AS (SELECT *, CASE WHEN origin=TIMESTAMP '1999-10-01' AND gain<=0 THEN CASE WHEN seed=0 THEN 'no_recent_improvement' ELSE 'recent_gain_not_seed_stable' END WHEN origin<>TIMESTAMP '1999-10-01' AND seed=0 AND gain<-0.005 THEN 'older_origin_regression' END AS reason,
    CASE WHEN origin=TIMESTAMP '1999-10-01' AND seed=0 THEN 0 WHEN origin=TIMESTAMP '1999-10-01' THEN 1 ELSE 2 END AS o FROM ps),
  f AS (SELECT *, string_split(policy, '__blend_')[1] AS base FROM r WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY policy ORDER BY o, CASE WHEN o<2 THEN seed ELSE 0 END, origin)=1),
  m AS (SELECT string_split(policy, '__blend_')[1] AS base, count(DISTINCT policy) AS n FROM ps GROUP BY 1) SELECT base, policy, reason, origin, seed, {R('gain', 6)} AS gain FROM f WHERE base IN (SELECT f.base FROM f JOIN m USING (base) GROUP BY f.base, m.n HAVING count(*)=m.n)""")
def _(t):
    partial = evidence(t).filter(~((F.col("origin") == stamp("1999-10-01")) & (F.col("seed") == 1)))
    scores = ev.paired_scores(ev.blends(partial, _WEIGHTS))
    return rounded(ev.vetoes(scores, stamp("1999-10-01")), places=6)
