"""Deterministic samples, splits and training-support choices.

Order comes from content hashes instead of a random generator, so a sample is
the same on any partitioning and a smaller one is contained in a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.scalars import as_column, content_rank, days, hash_number, stamp, text
from asofkit.skew import hashed_places, lookup, running_totals, top_rows


def mature_labels(labels: DataFrame, boundary, available: str | None = None, horizon_days: float | None = None,
                  time: str = "ts", strict: bool = False) -> DataFrame:
    """Labels observable by the boundary, by their own clock or by time plus horizon."""
    if available is not None:
        ready = F.col(available)
    else:
        ready = F.col(time) + F.expr(f"INTERVAL {int(horizon_days * 86_400)} SECONDS")
    limit = stamp(boundary)
    return labels.filter(ready < limit if strict else ready <= limit)


def canonical_order(rows: DataFrame, cohort: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """Zero-based row ordinal inside each cohort.

    Cohorts are split by hash of the leading order column's range through a
    two-step count: rows are numbered inside (cohort, leading value) and the
    offsets of the leading values come from their counts.
    """
    lead = order[0]
    inside = Window.partitionBy(cohort, lead).orderBy(*order[1:])
    sizes = rows.groupBy(cohort, lead).agg(F.count(F.lit(1)).alias("_n"))
    sized = running_totals(sizes, [cohort], lead, {"_end": "_n"})
    offsets = sized.select(cohort, lead, (F.col("_end") - F.col("_n")).alias("_start"))
    numbered = rows.withColumn("_place", F.row_number().over(inside) - 1).join(offsets, [cohort, lead])
    return numbered.withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_start", "_place")


def top_values(rows: DataFrame, name: str, count: int, tie: str = "value", seed: int = 0) -> DataFrame:
    """Most frequent values; ties by value, by first appearance key or by seeded hash."""
    counts = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    breaker = {"value": text("value"), "hash": content_rank("value", F.lit(seed))}[tie]
    ranked = counts.withColumn("_one", F.lit(1))
    return top_rows(ranked, ["_one"], [F.col("n").desc(), breaker, text("value")], count, "place").drop("_one")


def nested_sample(rows: DataFrame, key: list[str], limit: int, name: str = "", seed: int = 0) -> DataFrame:
    """A prefix of a fixed permutation: the 10k sample lies inside the 50k sample."""
    order = content_rank(F.lit(name), F.lit(seed), *key)
    return rows.withColumn("_h", order).orderBy("_h", *key).limit(limit).drop("_h")


def identity_sample(history: DataFrame, limit: int, entity: str = "entity", time: str = "ts") -> DataFrame:
    """Lowest hashes of (entity, time); the target takes no part."""
    return history.withColumn("_h", content_rank(entity, time)).orderBy("_h", entity, time).limit(limit).drop("_h")


def stratified_budget(rows: DataFrame, target: str, limit: int, identity: list[str], cohorts: list[str] | None = None,
                      quota: Column | None = None) -> DataFrame:
    """Class-proportional row budget, largest remainders first.

    Class sizes are counted first; each class then keeps its lowest hashes.
    ``cohorts`` applies a budget per cohort, given by ``quota`` or ``limit``.
    """
    scope = cohorts or []
    sizes = rows.groupBy(*scope, target).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*scope)
    budget = F.lit(limit) if quota is None else quota
    share = F.col("_n") * F.least(budget, F.sum("_n").over(whole)) / F.sum("_n").over(whole)
    sizes = sizes.withColumn("_take", F.floor(share).cast("long")).withColumn("_rest", F.round(share - F.floor(share), 9))
    order = Window.partitionBy(*scope).orderBy(F.desc("_rest"), F.col(target))
    spare = F.least(budget, F.sum("_n").over(whole)) - F.sum("_take").over(whole)
    sizes = sizes.withColumn("_take", F.col("_take") + (F.row_number().over(order) <= spare).cast("long"))
    ranked = top_rows(rows, [*scope, target], [content_rank(*identity), *[as_column(i) for i in identity]], limit, "_place")
    return ranked.join(sizes.select(*scope, target, "_take"), [*scope, target]).filter(
        F.col("_place") <= F.col("_take")).drop("_place", "_take")


def time_split(rows: DataFrame, time: str, fraction: float, tie: list[str]) -> DataFrame:
    """The last ``fraction`` of rows in time order becomes validation.

    The boundary instant is found from per-instant counts; only rows at that
    instant are ordered among themselves, by content hash.
    """
    counts = rows.groupBy(time).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    keep = F.greatest(F.lit(1), F.least(total - 1, F.round(total * (1 - fraction)).cast("long")))
    micros = counts.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    placed = running_totals(micros, [], "_t", {"_end": "_n"}).select(time, (F.col("_end") - F.col("_n")).alias("_start"), "_end")
    out = lookup(rows, placed, [time], "inner").withColumn("_keep", keep)
    split_here = (F.col("_start") < F.col("_keep")) & (F.col("_end") > F.col("_keep"))
    inside = hashed_places(out.filter(split_here), [time], tie, "_place")
    inside = inside.withColumn("_at", F.col("_start") + F.col("_place")).drop("_place")
    both = out.filter(~split_here).withColumn("_at", F.col("_end")).unionByName(inside)
    label = F.when(F.col("_at") <= F.col("_keep"), "train").otherwise("validation")
    return both.withColumn("split", label).drop("_start", "_end", "_keep", "_at")


def infer_task(rows: DataFrame, target: str) -> DataFrame:
    classes = rows.filter(F.col(target).isNotNull()).select(target).distinct().agg(F.count(F.lit(1)).alias("classes"))
    kind = F.when(F.col("classes") == 2, "classification").when(F.col("classes") > 2, "multiclass_classification").otherwise("regression")
    return classes.withColumn("task", kind)


def cohort_counts(rows: DataFrame, time: str = "cutoff", target: str | None = None) -> DataFrame:
    """Rows, and classes when a target is given, per distinct cutoff."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if target is None:
        return rows.groupBy(time).agg(*aggs)
    per_class = rows.groupBy(time, target).agg(F.count(F.lit(1)).alias("_n"))
    return per_class.groupBy(time).agg(F.sum("_n").alias("rows"), F.count(target).alias("classes"))


def _numbered(cohorts: DataFrame, time: str, descending: bool = False) -> DataFrame:
    """Place of each cutoff among the distinct cutoffs (a small table)."""
    order = Window.orderBy(F.desc(time) if descending else F.col(time))
    return cohorts.withColumn("place", F.row_number().over(order) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))


def spaced_cutoffs(cohorts: DataFrame, limit: int, time: str = "cutoff", recent_days: float | None = None) -> DataFrame:
    """Evenly spaced cutoffs that always include the latest one."""
    if recent_days is not None:
        latest = cohorts.agg(F.max(time).alias("m")).scalar()
        size = cohorts.agg(F.count(F.lit(1)).alias("n")).scalar()
        near = F.col(time) >= latest - F.expr(f"INTERVAL {int(recent_days * 86_400)} SECONDS")
        cohorts = cohorts.filter(near | (size <= limit))
    numbered = _numbered(cohorts, time)
    span, steps = F.col("total") - 1, limit - 1
    if limit == 1:
        return numbered.filter(F.col("place") == span).drop("place", "total")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.floor((i * span + steps // 2) / steps))
    return numbered.filter((F.col("total") <= limit) | F.array_contains(wanted, F.col("place").cast("long"))).drop("place", "total")


def class_valid_cutoffs(rows: DataFrame, target: str, limit: int, time: str = "cutoff") -> DataFrame:
    """Spaced cutoffs over those with two classes, when enough of them exist."""
    counts = cohort_counts(rows, time, target)
    valid = counts.filter("classes >= 2")
    total = counts.agg(F.count(F.lit(1)).alias("n")).scalar()
    enough = valid.agg(F.count(F.lit(1)).alias("n")).scalar() >= F.least(F.lit(limit), total)
    usable = counts.withColumn("_ok", F.when(enough, F.col("classes") >= 2).otherwise(F.lit(True))).filter("_ok").drop("_ok")
    return spaced_cutoffs(usable, limit, time)


def stratified_cutoffs(cohorts: DataFrame, limit: int, time: str = "cutoff", seed: int = 0) -> DataFrame:
    """One cutoff by hash from each of ``limit - 1`` history strata, plus the latest."""
    numbered = _numbered(cohorts, time)
    history, strata = F.col("total") - 1, limit - 1
    stratum = F.when(F.col("place") == history, limit).otherwise(F.floor(((F.col("place") + 1) * strata - 1) / history))
    numbered = numbered.withColumn("stratum", F.when(F.col("total") <= limit, F.col("place")).otherwise(stratum))
    return top_rows(numbered, ["stratum"], [content_rank(time, F.lit(seed)), F.col(time)], 1).drop("_rank", "place", "total", "stratum")


def frame_quota(cohorts: DataFrame, total: int, time: str = "cutoff") -> DataFrame:
    """A global row budget divided over frames, earlier frames taking the remainder."""
    numbered = _numbered(cohorts, time)
    base = F.floor(F.lit(total) / F.col("total"))
    extra = (F.col("place") < F.lit(total) % F.col("total")).cast("long")
    return numbered.withColumn("quota", (base + extra).cast("long")).drop("place", "total")


def framed_sample(rows: DataFrame, target: str, total: int, identity: list[str], time: str = "cutoff") -> DataFrame:
    quotas = frame_quota(cohort_counts(rows, time).select(time), total, time)
    return stratified_budget(lookup(rows, quotas, [time], "inner"), target, total, identity, [time, "quota"], F.col("quota")).drop("quota")


def fit_regime(training: DataFrame, validation: DataFrame, time: str = "cutoff", max_rows: int = 100_000,
               least_rows: int = 100, balance: float = 0.5) -> DataFrame:
    """Frames to fit and how to combine them, from cohort counts alone."""
    recent = _numbered(cohort_counts(training, time), time, descending=True)
    stats = recent.agg(
        F.max("total").alias("cutoffs"),
        F.min(F.when(F.col("place") < 3, F.col("rows"))).alias("low"), F.max(F.when(F.col("place") < 3, F.col("rows"))).alias("high"),
        F.sum(F.when(F.col("place") < 3, F.col("rows"))).alias("recent_rows"),
    )
    held = validation.select(time).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    reason = (
        F.when(held != 1, "multiple_validation_cutoffs").when(F.col("cutoffs") < 3, "insufficient_training_cutoffs")
        .when(F.col("low") < least_rows, "sparse_training_cutoff").when(F.col("recent_rows") > max_rows, "training_row_budget")
        .otherwise("three_cutoff_candidate")
    )
    chosen = reason == "three_cutoff_candidate"
    return stats.select(
        reason.alias("reason"), F.when(chosen, 3).otherwise(1).alias("frames"),
        F.when(chosen & (F.col("low") / F.col("high") < balance), "pooled").otherwise("frame_ensemble").alias("mode"), "recent_rows",
    )


def _recent_support(counts: DataFrame, time: str, rows_floor: int, frames_floor: int, most: int | None, size: str) -> DataFrame:
    """Newest cutoffs until both floors are met; the one that meets them is kept."""
    newest = Window.orderBy(F.desc(time))
    before = newest.rowsBetween(Window.unboundedPreceding, -1)
    counted = counts.withColumn("_frames", F.row_number().over(newest) - 1).withColumn(
        "_rows", F.coalesce(F.sum(size).over(before), F.lit(0)))
    open_still = (F.col("_frames") < frames_floor) | (F.col("_rows") < rows_floor)
    if most is not None:
        open_still = open_still & (F.col("_frames") < most)
    return counted.filter(open_still).drop("_frames", "_rows")


def mature_history_sample(training: DataFrame, boundary, preferred: int = 8, per_cutoff: int = 1200, least_rows: int = 2000,
                          time: str = "cutoff", available: str = "available_at") -> DataFrame:
    """Recent mature cutoffs under a per-cutoff cap, backfilled to a row floor."""
    eligible = training.filter(F.col(available) < stamp(boundary))
    counts = cohort_counts(eligible, time).withColumn("kept", F.least(F.col("rows"), F.lit(per_cutoff)))
    chosen = _recent_support(counts, time, least_rows, preferred, None, "kept").select(time)
    rows = lookup(eligible, chosen, [time], "inner")
    return top_rows(rows, [time], [content_rank("entity", time), F.col("entity")], per_cutoff).drop("_rank")


def training_support(training: DataFrame, boundary, horizon_days: float, least_rows: int, least_frames: int = 1,
                     most_frames: int = 64, time: str = "cutoff") -> DataFrame:
    """Newest completed cutoffs until the row and frame floors are met."""
    ready = F.col(time) + F.expr(f"INTERVAL {int(horizon_days * 86_400)} SECONDS")
    counts = cohort_counts(training.filter(ready <= stamp(boundary)), time)
    return _recent_support(counts, time, least_rows, least_frames, most_frames, "rows")


def recency_weights(rows: DataFrame, half_life_days: float, time: str = "cutoff", name: str = "weight") -> DataFrame:
    """Exponential weights by age, scaled to mean one."""
    raw = F.pow(F.lit(2.0), -days(F.col(time), F.col("_newest")) / half_life_days)
    per_time = rows.groupBy(time).agg(F.count(F.lit(1)).alias("_n"))
    newest = per_time.agg(F.max(time).alias("m")).scalar()
    weighted = per_time.withColumn("_newest", newest).withColumn("_w", raw)
    mean = weighted.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("m")).scalar()
    return rows.withColumn("_newest", newest).withColumn(name, raw / mean).drop("_newest")


def policy_support(training: DataFrame, origin, horizon_days: float, refit_frames: int, least_rows: int, least_frames: int = 1,
                   most_frames: int = 64, time: str = "cutoff") -> DataFrame:
    """Initial cohorts mature before the refit block, and the refit block itself."""
    ready = F.col(time) + F.expr(f"INTERVAL {int(horizon_days * 86_400)} SECONDS")
    counts = cohort_counts(training.filter((F.col(time) < stamp(origin)) & (ready <= stamp(origin))), time)
    refit = counts.orderBy(F.desc(time)).limit(refit_frames)
    first = refit.agg(F.coalesce(F.min(time), stamp(origin)).alias("m")).scalar()
    older = counts.filter((F.col(time) < first) & (ready <= first))
    initial = _recent_support(older, time, least_rows, least_frames, most_frames, "rows")
    return initial.withColumn("role", F.lit("initial")).unionByName(refit.withColumn("role", F.lit("refit")))


def retrospective_folds(cohorts: DataFrame, size: int, origins: int = 3, time: str = "cutoff") -> DataFrame:
    """The last blocks of ``size`` cutoffs, oldest fold first; none below two folds."""
    numbered = _numbered(cohorts.select(time).distinct(), time)
    count = F.least(F.lit(origins), F.floor((F.col("total") - size - 1) / size))
    back = F.floor((F.col("total") - 1 - F.col("place")) / size)
    kept = numbered.filter((count >= 2) & (back < count))
    return kept.select(time, (count - 1 - back).cast("long").alias("fold"))


def required_cutoffs(training: DataFrame, size: int, horizon_days: float, lag_days: float, least_rows: int,
                     time: str = "cutoff", origins: int = 3) -> DataFrame:
    """Held-out folds together with the support each fold's policy needs."""
    counts = cohort_counts(training, time)
    folds = retrospective_folds(counts, size, origins, time)
    starts = folds.groupBy("fold").agg(F.min(time).alias("origin")).withColumn(
        "boundary", F.col("origin") - F.expr(f"INTERVAL {int(lag_days * 86_400)} SECONDS"))
    # At most ``origins`` folds: each cutoff is repeated over that short list.
    listed = starts.agg(F.collect_list(F.struct("fold", "boundary")).alias("f")).scalar()
    ready = F.col(time) + F.expr(f"INTERVAL {int(horizon_days * 86_400)} SECONDS")
    per_fold = counts.withColumn("_f", F.explode(listed)).select("*", "_f.fold", "_f.boundary").drop("_f")
    open_rows = per_fold.filter((F.col(time) < F.col("boundary")) & (ready <= F.col("boundary")))
    newest = Window.partitionBy("fold").orderBy(F.desc(time))
    placed = open_rows.withColumn("_k", F.row_number().over(newest))
    refit = placed.filter(F.col("_k") <= size).select("fold", time, F.lit("refit").alias("role"))
    first = refit.groupBy("fold").agg(F.min(time).alias("_first"))
    older = open_rows.join(first, "fold").filter((F.col(time) < F.col("_first")) & (ready <= F.col("_first")))
    before = newest.rowsBetween(Window.unboundedPreceding, -1)
    initial = older.withColumn("_rows", F.coalesce(F.sum("rows").over(before), F.lit(0))).filter(F.col("_rows") < least_rows)
    initial = initial.select("fold", time, F.lit("initial").alias("role"))
    held = folds.select("fold", time, F.lit("heldout").alias("role"))
    return held.unionByName(refit).unionByName(initial)


def entity_folds(rows: DataFrame, folds: int = 3, entity: str = "entity") -> DataFrame:
    """Entity-disjoint folds from the entity's content hash."""
    return rows.withColumn("fold", F.pmod(hash_number(entity), F.lit(folds)))


def grouped_split(rows: DataFrame, group: str, kind: str, required: list[str], validation: int = 1, test: int = 2) -> DataFrame:
    """Group-disjoint train/validation/test; test covers the required kinds.

    Groups are ordered by hash.  The first group of each required kind is
    reserved for test, then the lowest hashes fill it up.
    """
    groups = rows.select(group, kind).distinct()
    order = content_rank(group)
    first = top_rows(groups.filter(F.col(kind).isin(required)), [kind], [order, F.col(group)], 1).select(group).distinct()
    names = groups.select(group).distinct().join(first.withColumn("_must", F.lit(1)), group, "left")
    places = Window.orderBy(F.coalesce(F.col("_must"), F.lit(0)).desc(), order, F.col(group))
    names = names.withColumn("_place", F.row_number().over(places))
    label = F.when(F.col("_place") <= test, "test").when(F.col("_place") <= test + validation, "validation").otherwise("train")
    return rows.join(names.select(group, label.alias("split")), group)
