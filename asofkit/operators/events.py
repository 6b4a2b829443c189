"""Event-path summaries: sub-day, clock bands, numeric, conditional and joint.

Rows come from ``visible(..., boundary="inclusive", lookback_open=True)``; each
summary is a list of aggregate columns plus the ratios derived from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions.scalars import as_column, count_if, finite, minus_seconds, ratio, text, when
from asofkit.requests import Requests, visible
from asofkit.skew import joined, top_rows

KEYS = ["entity", "cutoff"]
SUBDAY_HOURS = (1, 3, 6, 12, 24)
NUMERIC_DAYS = (30, 90, 365, 730)
JOINT_DAYS = (7, 30, 365, 730)


def after(width_seconds: float, time: str = "ts") -> Column:
    return F.col(time) > minus_seconds("cutoff", width_seconds)


def window_rows(events: DataFrame, requests: Requests, days: float, known: str = "ts") -> DataFrame:
    """Rows known by the cutoff (inclusive) whose event time is in the window."""
    if known == "ts":
        return visible(events, requests, "ts", boundary="inclusive", lookback_days=days, lookback_open=True)
    return visible(events, requests, known, boundary="inclusive").filter(after(days * 86_400))


def _reduce(requests: Requests, rows: DataFrame, aggs: list[Column]) -> DataFrame:
    block = rows.groupBy(*KEYS).agg(*aggs)
    zero = [c for c in block.columns if c.endswith(("_count", "_support", "_sum", "_active_days"))]
    return requests.align(block, zero=zero)


def _at_least_one(name: str) -> Column:
    return F.greatest(F.col(name), F.lit(1))


def subday(requests: Requests, rows: DataFrame, numbers: list[str]) -> DataFrame:
    aggs = []
    for h in SUBDAY_HOURS:
        inside = after(h * 3600)
        aggs.append(count_if(inside).alias(f"h{h}_count"))
        for c in numbers:
            x = when(inside, finite(c))
            aggs += [F.count(x).alias(f"h{h}_{c}_support"), F.avg(x).alias(f"h{h}_{c}_mean")]
    out = _reduce(requests, rows, aggs)
    return out.withColumns(
        {f"h{h}_fraction": F.col(f"h{h}_count") / _at_least_one("h24_count") for h in SUBDAY_HOURS[:-1]})


def clock_bands(requests: Requests, rows: DataFrame) -> DataFrame:
    """Counts, active days and shares of four six-hour bands.

    Rows reduce to (day, band) cells first; active days are then a count of
    cells and need no distinct aggregate.
    """
    cells = rows.groupBy(*KEYS, F.to_date("ts").alias("day"), F.floor(F.hour("ts") / 6).alias("band")).agg(
        *[count_if(after(h * 3600)).alias(f"n{h}") for h in (24, 168)]
    )
    aggs = []
    for hours in (24, 168):
        n = F.col(f"n{hours}")
        aggs.append(F.sum(n).alias(f"h{hours}_count"))
        for band in range(4):
            match = F.col("band") == band
            aggs.append(F.sum(F.when(match, n).otherwise(0)).alias(f"h{hours}_b{band}_count"))
            aggs.append(count_if(match & (n > 0)).alias(f"h{hours}_b{band}_active_days"))
    out = _reduce(requests, cells, aggs)
    return out.withColumns({
        f"h{hours}_b{band}_share": F.col(f"h{hours}_b{band}_count") / _at_least_one(f"h{hours}_count")
        for hours in (24, 168) for band in range(4)})


def numeric(requests: Requests, rows: DataFrame, numbers: list[str], windows=NUMERIC_DAYS) -> DataFrame:
    """Support, mean, sum and latest value; equal times resolve to the smaller value.

    Windows share their upper end, so the latest value of the widest one answers
    every window it still lies in.
    """
    aggs, newest = [], []
    for d in windows:
        inside = after(d * 86_400)
        aggs.append(count_if(inside).alias(f"d{d}_count"))
        for c in numbers:
            x = when(inside, finite(c))
            aggs += [F.count(x).alias(f"d{d}_{c}_support"), F.avg(x).alias(f"d{d}_{c}_mean"), F.sum(x).alias(f"d{d}_{c}_sum")]
    for c in numbers:
        x = finite(c)
        order = when(x.isNotNull(), F.struct(F.col("ts").alias("at"), (-x).alias("down")))
        newest.append(F.max(order).alias(f"_{c}"))
    out = joined(_reduce(requests, rows, aggs), rows.groupBy(*KEYS).agg(*newest), KEYS, "left")
    latest = {
        f"d{d}_{c}_latest": when(F.col(f"_{c}.at") > minus_seconds("cutoff", d * 86_400), -F.col(f"_{c}.down"))
        for c in numbers for d in windows
    }
    return out.withColumns(latest).drop(*[f"_{c}" for c in numbers])


def conditional(requests: Requests, rows: DataFrame, categories: dict[str, list], numbers: list[str]) -> DataFrame:
    """Event-weighted means and shares per retained category value."""
    aggs = [F.count(F.lit(1)).alias("all_support")]
    for c, values in categories.items():
        for i, v in enumerate(values):
            match = as_column(c) == F.lit(v)
            aggs.append(count_if(match).alias(f"{c}_v{i}_support"))
            for n in numbers:
                if n != c:
                    x = when(match, finite(n))
                    aggs += [F.count(x).alias(f"{c}_v{i}_{n}_support"), F.sum(x).alias(f"{c}_v{i}_{n}_sum")]
    out = _reduce(requests, rows, aggs)
    derived = {}
    for c, values in categories.items():
        for i in range(len(values)):
            name = f"{c}_v{i}"
            derived[f"{name}_share"] = F.col(f"{name}_support") / _at_least_one("all_support")
            derived.update({f"{name}_{n}_mean": ratio(f"{name}_{n}_sum", f"{name}_{n}_support") for n in numbers if n != c})
    return out.withColumns(derived)


def joint_numeric(requests: Requests, rows: DataFrame, pairs: list[tuple[str, str]], windows=JOINT_DAYS) -> DataFrame:
    """Within-event association of column pairs."""
    aggs = []
    for d in windows:
        inside = after(d * 86_400)
        aggs.append(count_if(inside).alias(f"d{d}_count"))
        for a, b in pairs:
            both = inside & finite(a).isNotNull() & finite(b).isNotNull()
            x, y = when(both, finite(a)), when(both, finite(b))
            name = f"d{d}_{a}_{b}"
            covariance = F.covar_pop(x, y)
            aggs += [
                F.count(x).alias(f"{name}_support"), F.avg(x * y).alias(f"{name}_product_mean"),
                covariance.alias(f"{name}_covariance"),
                ratio(covariance, F.stddev_pop(x) * F.stddev_pop(y)).alias(f"{name}_correlation"),
            ]
    return _reduce(requests, rows, aggs)


def payload_profile(
    frame: DataFrame, numeric_columns: list[str], other_columns: list[str], max_numeric: int = 4,
    max_categories: int = 2, max_values: int = 4, category_limit: int = 16,
) -> DataFrame:
    """Numeric payloads by coverage and categories with their top values.

    Columns are melted and counted by value in one aggregation, which yields
    coverage, cardinality and frequencies together.
    """
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(c in numeric_columns).alias("is_numeric"), text(c).alias("value"),
                 (finite(c) if c in numeric_columns else F.lit(None).cast("double")).alias("number"))
        for c in [*numeric_columns, *other_columns]
    ]
    counts = (
        frame.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        .groupBy("column", "is_numeric", "value").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("finite"))
    )
    per_column = counts.groupBy("column", "is_numeric").agg(
        F.count("value").alias("cardinality"), F.sum("n").alias("rows"), F.sum("finite").alias("finite"),
        F.count(when(F.col("finite") > 0, "value")).alias("finite_values"),
    ).filter("cardinality >= 2")
    coverage = F.col("finite") / F.col("rows")
    numbers = top_rows(
        per_column.filter("is_numeric AND finite_values > 1").withColumn("coverage", coverage).withColumn("_one", F.lit(1)),
        ["_one"], [F.col("coverage").desc(), F.col("column")], max_numeric,
    ).select("column", F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("value"),
             F.col("coverage").alias("weight"), F.col("_rank").alias("place"))
    kept = top_rows(
        per_column.filter(F.col("cardinality") <= category_limit).withColumn("_one", F.lit(1)),
        ["_one"], [F.col("column")], max_categories,
    ).select("column")
    values = top_rows(
        counts.filter("value IS NOT NULL").join(kept, "column"), ["column"], [F.col("n").desc(), F.col("value")], max_values,
    ).select("column", F.lit("category").alias("kind"), "value", F.col("n").cast("double").alias("weight"),
             F.col("_rank").alias("place"))
    return numbers.unionByName(values)
