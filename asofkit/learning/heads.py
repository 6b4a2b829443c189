"""Fitting, scoring and cross-fitting over prepared frames."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.scalars import finite, hash_number, minus_seconds, stamp, when
from asofkit.plans.frames import FrameSchema, fit_schema, prepare
from asofkit.requests import Requests, visible
from asofkit.session import checkpoint
from asofkit.skew import joined

KEYS = ["entity", "cutoff"]


def default_estimator(task: str):
    if task == "classification":
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=10, maxDepth=4, seed=0)
    return GBTRegressor(featuresCol="features", labelCol="label", lossType="absolute", maxIter=10, maxDepth=4, seed=0)


def probability(frame: DataFrame, name: str = "prediction") -> DataFrame:
    """Positive-class probability where the model gives one, else its prediction."""
    if "probability" in frame.columns:
        return frame.withColumn(name, vector_to_array("probability")[1])
    return frame.withColumn(name, F.col("prediction").cast("double"))


class FittedHead:
    """A frozen frame schema with the model fitted on it."""

    def __init__(self, schema: FrameSchema, model, task: str):
        self.schema, self.model, self.task = schema, model, task

    def predict(self, frame: DataFrame, keep=KEYS) -> DataFrame:
        inputs = _filled(prepare(frame, self.schema), self.schema)
        return probability(self.model.transform(inputs)).select(*keep, "prediction")


def _filled(frame: DataFrame, schema: FrameSchema) -> DataFrame:
    """A numeric gap becomes a flag plus zero, so trees and lines can both use it."""
    columns = {}
    for c in (*schema.numeric, *schema.datetime):
        columns[f"{c}__gap"] = F.col(c).isNull().cast("double")
        columns[c] = F.coalesce(F.col(c), F.lit(0.0))
    return frame.withColumns(columns) if columns else frame


def fit_head(frame: DataFrame, target: str, task: str = "classification", estimator=None, keys=KEYS, weight: str | None = None) -> FittedHead:
    """Learn the schema on training rows and fit an estimator on it."""
    extra = [target, *([weight] if weight else [])]
    schema = fit_schema(frame, [*keys, *extra])
    # Estimators pass over their input many times: cut the feature plan's lineage.
    inputs = checkpoint(_filled(prepare(frame, schema), schema).withColumn("label", F.col(target).cast("double")))
    indexed = [f"{c}__code" for c in schema.categorical]
    stages = []
    if indexed:
        stages.append(StringIndexer(inputCols=list(schema.categorical), outputCols=indexed, handleInvalid="keep"))
    numbers = [x for c in (*schema.numeric, *schema.datetime) for x in (c, f"{c}__gap")]
    stages.append(VectorAssembler(inputCols=[*numbers, *indexed], outputCol="features"))
    stages.append(estimator if estimator is not None else default_estimator(task))
    kept = FrameSchema(schema.numeric, schema.categorical, schema.datetime, tuple(keys))
    return FittedHead(kept, Pipeline(stages=stages).fit(inputs), task)


# --- annotations and messages ---------------------------------------------------


def _logistic(rows: DataFrame, inputs: list[str], label: str, weight: str | None = None, scales: list[float] | None = None):
    """``scales`` are factors that standardise the inputs; without them the estimator finds its own."""
    stages = [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")]
    head = LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, regParam=0.01)
    if scales is not None:
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(scales), inputCol="features", outputCol="scaled"))
        head = head.setFeaturesCol("scaled").setStandardization(False)
    if weight:
        head = head.setWeightCol(weight)
    return Pipeline(stages=[*stages, head]).fit(rows)


def source_annotation(
    requests: Requests, facts: DataFrame, inputs: list[str], response: str, first_query: Column, horizon_seconds: float,
) -> DataFrame:
    """Expected response of past events from a model fitted before the first query.

    Per root: rate, expectation, residual and chance of at least one response
    over everything seen, one horizon and four horizons.
    """
    model = _logistic(facts.filter(F.col("known") < first_query).select(*inputs, F.col(response).cast("double").alias("mark")), inputs, "mark")
    scored = probability(model.transform(facts.withColumn("mark", F.col(response).cast("double"))), "expected").select(
        "entity", "ts", "known", "mark", "expected")
    rows = visible(scored, requests, "known")
    aggs = []
    for w, scale in enumerate((None, 1, 4)):
        inside = F.lit(True) if scale is None else F.col("ts") >= minus_seconds("cutoff", horizon_seconds * scale)
        e, y = when(inside, "expected"), when(inside, "mark")
        miss = F.log1p(-F.least(e, F.lit(1 - 1e-8)))
        aggs += [
            F.count(y).alias(f"w{w}_count"), F.avg(y).alias(f"w{w}_rate"), F.avg(e).alias(f"w{w}_expected"),
            F.stddev_samp(e).alias(f"w{w}_expected_std"), F.max(e).alias(f"w{w}_expected_max"),
            F.avg(y - e).alias(f"w{w}_residual"), F.sum(y - e).alias(f"w{w}_residual_sum"),
            F.avg(when(F.col("mark") == 1, e)).alias(f"w{w}_positive_expected"), (-F.expm1(F.sum(miss))).alias(f"w{w}_any_expected"),
        ]
    return requests.align(rows.groupBy(*KEYS).agg(*aggs), zero=[f"w{w}_count" for w in range(3)])


# The estimator takes no more classes than this.
CLASSES = 100


def _label_weights(labels: DataFrame, dealt: DataFrame, classes: list, cutoffs) -> DataFrame:
    """(entity, after, ``_w``, ``_q``): what the labels at or after an instant weigh, for each cutoff.

    A label shares a unit weight among the rows before it. ``_w`` holds the sums of these shares for each cutoff and class
    and ``_q`` those of their squares for each cutoff. One timeline of an entity's labels and row counts gives both: running
    counts say how many rows a label has, running sums from the end what a row gets.
    """
    counts = dealt.groupBy("entity", F.col("after").alias("_at")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_kind", F.lit(0))
    same = F.count(F.lit(1)).over(Window.partitionBy("entity", "_at"))
    marks = labels.select("entity", F.col("ts").alias("_at"), "label", "available_at", F.lit(1).alias("_kind")).withColumn("_same", same)
    line = Window.partitionBy("entity")
    upto = line.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    later = line.orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = counts.unionByName(marks, allowMissingColumns=True).withColumn("_n", F.sum("_rows").over(upto) * F.col("_same"))
    share = F.when((F.col("_kind") == 1) & (F.col("_n") > 0), 1 / F.col("_n"))

    def total(value):
        return F.coalesce(F.sum(value).over(later), F.lit(0.0))

    weights, squares = [], []
    for cutoff in cutoffs:
        known = F.col("available_at") < stamp(cutoff)
        weights += [total(F.when(known & F.col("label").eqNullSafe(F.lit(c)), share)) for c in classes]
        squares.append(total(F.when(known, share * share)))
    return both.select("entity", "_at", "_kind", F.array(*weights).alias("_w"), F.array(*squares).alias("_q")).filter("_kind = 0").select(
        "entity", F.col("_at").alias("after"), "_w", "_q")


def _scales(rows: DataFrame, inputs: list[str], weight: Column, square: Column) -> list[float]:
    """One over the weighted standard deviation of each input, zero for a constant, from rows that stand for several examples each."""
    aggs = [F.sum(weight).alias("w"), F.sum(square).alias("q")]
    for i, c in enumerate(inputs):
        aggs += [F.sum(weight * F.col(c)).alias(f"a{i}"), F.sum(weight * F.col(c) * F.col(c)).alias(f"b{i}")]
    row = rows.agg(*aggs).first()
    out = []
    for i in range(len(inputs)):
        a, b = row[f"a{i}"], row[f"b{i}"]
        freedom = row["w"] - row["q"] / row["w"] if row["w"] else 0.0
        variance = (b - a * a / row["w"]) / freedom if a is not None and freedom > 0 else 0.0
        out.append(variance ** -0.5 if variance > 0 else 0.0)
    return out


def forward_messages(
    requests: Requests, history: DataFrame, facts: DataFrame, inputs: list[str], target: str = "y",
) -> DataFrame:
    """Row scores pooled per request from the newest model its cutoff may use.

    One model per distinct cutoff, fitted on labels available strictly before
    it; rows of an example share its unit weight.

    A row is an example of every label after it, but these differ only in label and weight: the loss of all of them
    is that of one example per class with the weights added up. So a row stands once for each class, not once for each label,
    and rows meet the sums by the first label instant after them. Inputs are standardised as over all examples.
    """
    labels = checkpoint(history.filter("ts IS NOT NULL").select(
        "entity", "ts", F.col(target).cast("double").alias("label"), "available_at"))
    grid = Requests.of(labels.select("entity", F.col("ts").alias("cutoff")).distinct()).cutoffs
    found = labels.select("label").distinct().limit(CLASSES + 1).collect()
    if len(found) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes in {target}")
    classes = sorted((r[0] for r in found), key=lambda c: (c is None, c))
    known = F.col("known")
    if grid is None:
        after = known + F.expr("INTERVAL '0.000001' SECOND")
    else:
        after = F.get(F.filter(F.array(*[stamp(c) for c in grid]), lambda g: g > known), F.lit(0))
    dealt = checkpoint(facts.select("entity", "known", *inputs, after.alias("after")))
    followed = dealt.filter("after IS NOT NULL").select("entity", "after", *inputs)
    weighted = joined(followed, _label_weights(labels, followed, classes, requests.cutoffs), ["entity", "after"])
    weighted = checkpoint(weighted.select(*inputs, "_w", "_q"))
    out = None
    for i, cutoff in enumerate(requests.cutoffs):
        moment = F.lit(cutoff).cast("timestamp_ntz")
        asked = Requests(requests.frame.filter(F.col("cutoff") == moment), (cutoff,), requests.phase)
        own = [F.col("_w")[i * len(classes) + k] for k in range(len(classes))]
        examples = F.filter(F.array(*[F.struct(F.lit(c).cast("double").alias("label"), w.alias("weight")) for c, w in zip(classes, own)]), lambda e: e["weight"] > 0)
        train = weighted.select(*inputs, F.explode(examples).alias("_e")).select(*inputs, "_e.label", "_e.weight")
        scales = _scales(weighted, inputs, sum(own, F.lit(0.0)), F.col("_q")[i])
        model = _logistic(train, inputs, "label", "weight", scales)
        seen = visible(dealt.select("entity", "known", *inputs), asked, "known")
        scored = probability(model.transform(seen), "score")
        block = scored.groupBy(*KEYS).agg(
            F.avg("score").alias("score_mean"), F.max("score").alias("score_max"), F.count(F.lit(1)).alias("rows"),
            *[F.avg(finite(c)).alias(f"{c}_mean") for c in inputs])
        part = asked.align(block, zero=["rows"])
        out = part if out is None else out.unionByName(part)
    return out


def entity_crossfit(frame: DataFrame, features: str, label: str, folds: int = 3, make=None) -> DataFrame:
    """Every row scored by a model that never saw its entity.

    ``make`` builds the (unfitted) pipeline for the features column; folds come
    from the entity's content hash.
    """
    make = make or (lambda: LogisticRegression(featuresCol=features, labelCol="label", maxIter=20, regParam=0.01))
    rows = frame.withColumn("fold", F.pmod(hash_number("entity"), F.lit(folds)).cast("int")).withColumn("label", F.col(label).cast("double"))
    out = None
    for fold in range(folds):
        model = make().fit(rows.filter(F.col("fold") != fold))
        part = probability(model.transform(rows.filter(F.col("fold") == fold)), "oof").select("entity", "fold", "label", "oof")
        out = part if out is None else out.unionByName(part)
    return out


