"""Frames, end-to-end jobs and model-backed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit import Requests
from asofkit.functions.scalars import days, hash_unit, stamp
from asofkit.learning import heads, text
from asofkit.operators import evidence as ev
from asofkit.operators import families as fam
from asofkit.operators import joins as jn
from asofkit.plans import feature_plan as fp
from asofkit.plans import frames as fr
from asofkit.requests import visible
from asofkit.session import checkpoint
from asofkit.sources import io
from suite.core import K, LINE_VIS, example_rows, order_lines
from suite.evidence import REPEATS, KEYS, admission_sql, evidence
from suite.families import HISTORY, label_history
from suite.model import catalog
from suite.sources import _folder
from suite.registry import EVENT_REQ, N, ORDER_REQ, R, aligned_sql, query, rounded, since_sql

DAY = 86_400
STEPS = (("orders", "o_custkey"), ("lineitem", "l_orderkey"))


def fitted_plan(t, cutoff="1998-01-01", **options):
    return fp.FeaturePlan.fit(catalog(t), STEPS, cutoff, ["l_quantity", "l_extendedprice"], ["l_returnflag"], **options)


def _plan_sql(cutoffs, requests=None, vis=None, fit="1998-01-01"):
    training = f"""tr AS (SELECT l.* FROM lineitem l JOIN orders ON o_orderkey=l_orderkey WHERE l_shipdate<TIMESTAMP '{fit}' AND o_orderdate<TIMESTAMP '{fit}'),
      cuts AS (SELECT quantile_cont(l_quantity, [0.25,0.5,0.75]) AS qa, quantile_cont(l_extendedprice, [0.25,0.5,0.75]) AS qb FROM tr), voc AS (SELECT list(l_returnflag) AS v FROM (SELECT l_returnflag FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2))"""
    values = ",".join(f"(TIMESTAMP '{c}')" for c in cutoffs)
    req = requests or f"requests AS (SELECT c_custkey AS entity, v.cutoff FROM customer, (VALUES {values}) v(cutoff))"
    vis = vis or "o.o_orderdate<r.cutoff AND l.l_shipdate<r.cutoff"
    rows = f"""visible AS (SELECT r.entity, r.cutoff, l_shipdate AS ts, l.*, qa, qb, v FROM requests r JOIN orders o ON o.o_custkey=r.entity JOIN lineitem l ON l.l_orderkey=o.o_orderkey AND {vis} AND l.l_shipdate>=r.cutoff-INTERVAL 3650 DAY, cuts, voc)"""
    cols = [("count(*)", "rows", "n")]
    for c in ("l_quantity", "l_extendedprice"):
        cols += [(f"count({c})", f"{c}_count", "i"), (f"sum({c})", f"{c}_sum", "d"), (f"avg({c})", f"{c}_avg", "d"), (f"min({c})", f"{c}_min", "d"), (f"max({c})", f"{c}_max", "d")]
    for c, q in (("l_quantity", "qa"), ("l_extendedprice", "qb")):
        cols += [(f"avg(({c}<={q}[{i + 1}])::INT)", f"{c}_cdf{i}", "d") for i in range(3)] + [(f"avg(({c} IS NOT NULL)::INT)", f"{c}_coverage", "d")]
    cols += [(f"count(*) FILTER (l_returnflag=v[{i + 1}])", f"l_returnflag_v{i}_count", "n") for i in range(2)]
    cols += [(f"count(*) FILTER ({since_sql(p)})", f"rows_{p}d", "n") for p in (30, 365)]
    return aligned_sql(f"{training}, {req}, {rows}", cols)


# --- frames ------------------------------------------------------------------


def _wide_orders(t):
    return t.orders.select(
        "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "o_orderdate",
        F.lit(1).alias("constant"), F.lit(None).cast("double").alias("empty"), F.array("o_orderpriority").alias("tags"))


@query("V1_training_frame", f"""SELECT o_orderkey, {R('o_totalprice', 2)} AS o_totalprice, CASE WHEN o_orderstatus='P' THEN '__missing__' ELSE o_orderstatus END AS status, '["'||o_orderpriority||'"]' AS tags, {R('epoch(o_orderdate)', 2)} AS o_orderdate FROM orders""")
def _(t):
    frame = _wide_orders(t)
    schema = fr.fit_schema(frame.filter(F.col("o_orderdate") < stamp("1999-01-01")), ["o_orderkey"])
    return rounded(fr.prepare(frame, schema), "o_totalprice", "o_orderdate", places=2)


@query("V2_prediction_frame", f"""SELECT o_orderkey, {R('o_totalprice', 2)} AS o_totalprice, '__missing__' AS status, '["'||o_orderpriority||'"]' AS tags, CAST(NULL AS DOUBLE) AS o_orderdate FROM orders WHERE o_orderdate>=TIMESTAMP '1999-01-01'""")
def _(t):
    frame = _wide_orders(t)
    schema = fr.fit_schema(frame.filter(F.col("o_orderdate") < stamp("1999-01-01")), ["o_orderkey"])
    held = frame.filter(F.col("o_orderdate") >= stamp("1999-01-01")).drop("status", "o_orderdate")
    return rounded(fr.prepare(held, schema), "o_totalprice", places=2)


# --- jobs ---------------------------------------------------------------------

_CUTS = ("1997-01-01", "1997-07-01", "1998-01-01")


@query("K1_multi_cutoff_frame", _plan_sql(_CUTS))
def _(t):
    requests = Requests.every(t.customer, "c_custkey", _CUTS)
    return rounded(fitted_plan(t).transform(catalog(t), requests))


@query("K2_frozen_plan", _plan_sql(("2001-01-01",)))
def _(t):
    plan = fp.FeaturePlan.from_json(fitted_plan(t).to_json())
    return rounded(plan.transform(catalog(t), Requests.every(t.customer, "c_custkey", ["2001-01-01"])))


@query("K3_source_binding", f"""SELECT 'orders' AS "table", 'o_totalprice' AS "column", 'double' AS was, 'string' AS now, {N('count(*)')} AS affected_rows FROM orders""")
def _(t):
    cat = catalog(t)
    expected = fp.blueprint(cat)
    changed = cat["orders"].with_frame(t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("string")))
    changes = fp.binding_changes(expected, type(cat)({**cat.tables, "orders": changed}))
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("table", "column", "was", "now"), c)]) for c in changes])
    rows = changed.frame.agg(F.count(F.lit(1)).alias("affected_rows")).withColumn("c", F.explode(listed))
    return rows.select("c.*", "affected_rows")


@query("K7_batched_frame", f"SELECT {N('2*count(*)')} AS rows, {N('2*count(*)')} AS batched_rows, {N('0')} AS differences FROM customer")
def _(t):
    plan, requests = fitted_plan(t), t.order_requests()
    whole = rounded(plan.transform(catalog(t), requests))
    parts = rounded(fp.batched(plan, catalog(t), requests, 3))
    gap = io.difference(parts, whole).agg(F.count(F.lit(1)).alias("n")).scalar()
    size = parts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return whole.agg(F.count(F.lit(1)).alias("rows")).select("rows", size.alias("batched_rows"), gap.alias("differences"))


_FOLDS = [{"fold": 0, "boundary": "1999-06-01", "cutoffs": ["1999-07-01", "1999-10-01"]}, {"fold": 1, "boundary": "1999-12-01", "cutoffs": ["2000-01-01", "2000-04-01"]}]


def _folds_sql():
    parts = []
    for f in _FOLDS:
        cuts = ",".join(f"TIMESTAMP '{c}'" for c in f["cutoffs"])
        req = f"{HISTORY}, requests AS (SELECT entity, ts AS cutoff FROM hist WHERE ts IN ({cuts}))"
        b = f"least(r.cutoff, TIMESTAMP '{f['boundary']}')"
        sql = _plan_sql((), req, f"o.o_orderdate<{b} AND l.l_shipdate<{b}")
        parts.append(f"SELECT {N(str(f['fold']))} AS fold, * FROM ({sql})")
    return " UNION ALL ".join(parts)


@query("K8_phase_folds", _folds_sql())
def _(t):
    held = label_history(t).select("entity", F.col("ts").alias("cutoff"))
    return rounded(fp.phase_folds(fitted_plan(t), catalog(t), held, _FOLDS))


def labelled_frame(t, cutoffs, families=fp.FAMILIES):
    """Plan features with the label: any order above 250,000 in the next 180 days."""
    plan = fitted_plan(t).with_families(*families)
    requests = Requests.every(t.customer, "c_custkey", cutoffs)
    features = plan.transform(catalog(t), requests)
    big = t.order_events().filter("o_totalprice > 250000")
    labels = fam.future_labels(big, requests, 180, {"y": ("bool", "o_totalprice"), "spend": ("sum", "o_totalprice")})
    return features, labels


def _joined(t, cutoffs, families=fp.FAMILIES):
    features, labels = labelled_frame(t, cutoffs, families)
    return features.join(labels.select(*K, "y"), K)


@query("K4_fit_and_validate")
def _(t):
    train = _joined(t, ["1997-01-01", "1997-07-01"])
    held = _joined(t, ["1998-07-01"])
    head = heads.fit_head(train, "y")
    scored = head.predict(held).join(held.select(*K, F.col("y").alias("truth")), K)
    return ev.auc_standard_error(ev.roc_auc(scored, ["cutoff"]))


@query("K5_predict")
def _(t):
    head = heads.fit_head(_joined(t, ["1997-01-01", "1997-07-01"]), "y")
    requests = Requests.every(t.customer, "c_custkey", ["2000-01-01"])
    predictions = head.predict(fitted_plan(t).transform(catalog(t), requests))
    return jn.align_predictions(requests.frame, predictions, K)


@query("K6_configuration_comparison")
def _(t):
    from pyspark.ml.classification import LogisticRegression

    menu = {"base": ("base",), "base+cdf": ("base", "cdf"), "all": fp.FAMILIES}
    contract, store = io.contract_hash(fp.blueprint(catalog(t))), _folder(t, "trials")
    for name, families in menu.items():
        estimator = LogisticRegression(featuresCol="features", labelCol="label", maxIter=10, regParam=0.01)
        head = heads.fit_head(_joined(t, ["1997-01-01"], families), "y", estimator=estimator)
        held = _joined(t, ["1997-07-01", "1998-01-01"], families)
        scored = head.predict(held).join(held.select(*K, F.col("y").alias("truth")), K)
        trial = ev.auc_standard_error(ev.roc_auc(scored, ["cutoff"])).withColumns({
            "config": F.lit(name), "features": F.lit(len(head.schema.columns)), "status": F.lit("completed")})
        # Each trial is stored as it completes, so a rerun resumes after it.
        io.save_trials(trial, store, contract)
    out = t.spark.read.parquet(store).filter(F.col("contract") == contract)
    recent = stamp("1998-01-01")
    trials = out.groupBy("config").agg(
        F.avg("auc").alias("score"), (F.avg("auc") - 0.25 * F.stddev_pop("auc") / F.sqrt(F.count(F.lit(1)))).alias("objective"), F.avg("auc_error").alias("error"),
        F.max(F.when(F.col("cutoff") == recent, F.col("auc"))).alias("recent_score"), F.max(F.when(F.col("cutoff") == recent, F.col("auc_error"))).alias("recent_error"),
        F.max("features").alias("features"), F.lit(1).alias("complexity"))
    return ev.rerank_choice(trials, out.select("config", F.col("cutoff").alias("fold"), F.col("auc").alias("score")))


_MENU = [f"{p}{b}" for p in ("alpha", "beta", "gamma") for b in ("", "__blend_0.125", "__blend_0.5")]


@query("K9_candidate_menu", admission_sql(_MENU, "bl"))
def _(t):
    rows, names = checkpoint(ev.blends(evidence(t), [0.125, 0.5])), _MENU
    bounds = ev.gain_lower_bounds(rows, names, REPEATS, 0.05 / len(names))
    return rounded(ev.admission(ev.paired_scores(rows), bounds), places=6)


@query("X3_learner_plugin")
def _(t):
    from pyspark.ml.regression import LinearRegression

    features, labels = labelled_frame(t, ["1997-01-01", "1998-01-01"])
    frame = features.join(labels.select(*K, "spend"), K)
    line = LinearRegression(featuresCol="features", labelCol="label", maxIter=10, regParam=0.1)
    head = heads.fit_head(frame.filter(F.col("cutoff") < stamp("1998-01-01")), "spend", "regression", line)
    scored = head.predict(frame).join(frame.select(*K, F.col("spend").alias("truth")), K)
    return ev.mean_absolute_error(scored, ["cutoff"])


# --- model-backed features -----------------------------------------------------------------


def _marked(t):
    return order_lines(t).withColumn("returned", (F.col("l_returnflag") == "R").cast("int")).withColumn(
        "lag_days", days(F.col("o_orderdate"), F.col("l_shipdate")))


@query("A41_source_annotation")
def _(t):
    inputs = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "lag_days"]
    return heads.source_annotation(t.order_requests(), _marked(t), inputs, "returned", stamp("1998-01-01"), 180 * DAY)


@query("A59_association_state")
def _(t):
    first = Requests.every(t.customer, "c_custkey", ["1998-01-01"])
    train = jn.memberships(order_lines(t), first, "l_suppkey", 32)
    _, transform = text.association_state(train, K)
    return transform(jn.memberships(order_lines(t), t.order_requests(), "l_suppkey", 32))


@query("E3_parent_text")
def _(t):
    _, transform = text.lexical_projection(t.part, ["p_name", "p_type"], components=8, width=256)
    return transform(t.part.select("p_partkey", "p_name", "p_type")).drop("p_name", "p_type")


@query("E4_payload_encoder")
def _(t):
    payload = t.documents.select("doc_id", "text", "n_chars", "lang")
    _, transform = text.lexical_projection(payload, ["text"], components=8, width=256)
    top = fam.frequent_values(payload, "lang")
    return transform(payload).select("doc_id", "n_chars", *fam.indicators("lang", top, False), *[f"text{i}" for i in range(8)])


@query("E8_forward_messages")
def _(t):
    inputs = ["l_quantity", "l_extendedprice", "l_discount"]
    return heads.forward_messages(t.order_requests(), label_history(t), order_lines(t), inputs)


def labelled_documents(t):
    return t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("entity"), "text", "source", "lang", F.col("quality").alias("y"))


@query("E10_text_readout")
def _(t):
    rows = labelled_documents(t)
    train = rows.filter(hash_unit("entity") < 0.7)
    model = text.text_readout(train, ["text"], "y")
    scored = text.read_out(model, rows, ["text"], ["entity", "y"])
    return scored.withColumn("train", hash_unit("entity") < 0.7)


@query("E11_field_text_readout")
def _(t):
    rows = labelled_documents(t)
    model = text.text_readout(rows.filter(hash_unit("entity") < 0.7), ["text", "source", "lang"], "y", per_field=1024)
    return text.read_out(model, rows, ["text", "source", "lang"], ["entity", "y"])


@query("E12_crossfit_annotation")
def _(t):
    _, transform = text.lexical_projection(t.documents, ["text"], components=8, width=256)
    dense = transform(labelled_documents(t))
    from pyspark.ml.feature import VectorAssembler

    frame = VectorAssembler(inputCols=[f"text{i}" for i in range(8)], outputCol="features").transform(dense)
    return heads.entity_crossfit(frame.select("entity", "features", "y"), "features", "y")


@query("E13_embedding_projection")
def _(t):
    _, transform = text.embedding_projection(t.embeddings, "embedding", 8)
    return transform(t.embeddings.select("vec_id", "embedding")).drop("embedding")
