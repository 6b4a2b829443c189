"""Feature families: aggregate expressions over a child's visible rows.

Every function returns aliased aggregate columns, so one ``groupBy(...).agg``
computes any mix of families in a single pass with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions.scalars import (
    as_column, count_if, days, finite, minus_seconds, ratio, seconds, text, when,
)
from asofkit.requests import Requests, population_totals
from asofkit.session import checkpoint
from asofkit.skew import SALTS, lookup, percentiles, top_rows

# The retrospective day grid and the default lookback.
PERIOD_DAYS = (1, 3, 4, 7, 14, 30, 60, 90, 180, 365, 730)
LOOKBACK_DAYS = 3650
KEYS = ["entity", "cutoff"]

# One continuation function per recognised aggregate suffix.
CONTINUATION = {
    "max": F.max, "min": F.min, "sum": F.sum, "count": F.sum, "avg": F.avg, "share": F.avg,
}


def base_numeric(name: str, alias: str | None = None) -> list[Column]:
    x, a = finite(name), alias or name
    return [
        F.count(x).alias(f"{a}_count"), F.sum(x).alias(f"{a}_sum"), F.avg(x).alias(f"{a}_avg"),
        F.min(x).alias(f"{a}_min"), F.max(x).alias(f"{a}_max"),
    ]


def base_boolean(name: str, alias: str | None = None) -> list[Column]:
    return [F.sum(as_column(name).cast("int")).alias(f"{alias or name}_sum")]


def base_categorical(name: str, values: list, alias: str | None = None) -> list[Column]:
    a, c = alias or name, as_column(name)
    out = [F.count(c).alias(f"{a}_count"), F.count_distinct(c).alias(f"{a}_distinct")]
    out += [count_if(c == F.lit(v)).alias(f"{a}_v{i}_count") for i, v in enumerate(values)]
    return out


def since(time: str, width_days: float) -> Column:
    """Row lies in the window of ``width_days`` that ends at the cutoff."""
    return F.col(time) >= minus_seconds("cutoff", width_days * 86_400)


def activity(time: str, periods=PERIOD_DAYS) -> list[Column]:
    """Recency, rolling counts, adjacent-window ratios and observed density."""
    n = [count_if(since(time, p)) for p in periods]
    out = [seconds(F.max(time), F.col("cutoff")).alias("seconds_since_last")]
    out += [c.alias(f"num_events_{p}d") for p, c in zip(periods, n)]
    out += [
        ratio(a, b).alias(f"events_ratio_{p}v{q}")
        for p, q, a, b in zip(periods, periods[1:], n, n[1:])
    ]
    history = seconds(F.min(time), F.col("cutoff"))
    out.append(history.alias("observed_history_seconds"))
    out.append((F.count(F.lit(1)) / (history / 86_400 + 1)).alias("events_per_observed_day"))
    return out


def trajectory(time: str, condition: Column, alias: str, windows=(7, 14, 30, 60)) -> list[Column]:
    """Counts in windows, in the lag buckets between them, and time since a match."""
    out = [count_if(condition & since(time, w)).alias(f"{alias}_{w}d_count") for w in windows]
    for a, b in zip(windows, windows[1:]):
        out.append(
            count_if(condition & since(time, b) & ~since(time, a)).alias(f"{alias}_lag_{a}_{b}d_count")
        )
    out.append(seconds(F.max(when(condition, time)), F.col("cutoff")).alias(f"{alias}_seconds_since"))
    return out


def temporal(name: str, time: str, periods=PERIOD_DAYS) -> list[Column]:
    """Six moments per window and the change of the mean to the next wider window."""
    out, means = [], []
    for p in periods:
        x = when(since(time, p), finite(name))
        means.append(F.avg(x))
        out += [
            F.sum(x).alias(f"{name}_{p}d_sum"), F.avg(x).alias(f"{name}_{p}d_avg"),
            F.min(x).alias(f"{name}_{p}d_min"), F.max(x).alias(f"{name}_{p}d_max"),
            F.stddev_pop(x).alias(f"{name}_{p}d_std"), F.count(x).alias(f"{name}_{p}d_count"),
        ]
    out += [
        (a - b).alias(f"{name}_change_{p}v{q}")
        for p, q, a, b in zip(periods, periods[1:], means, means[1:])
    ]
    return out


def sequence(time: str, periods=PERIOD_DAYS) -> list[Column]:
    """Rates, shares, bursts, span and density of activity."""
    total = F.count(F.lit(1))
    n = {p: count_if(since(time, p)) for p in periods}
    out = []
    for p in periods:
        out.append((n[p] / F.lit(float(p))).alias(f"rate_{p}d"))
        out.append(ratio(n[p], total).alias(f"share_{p}d"))
    out += [ratio(n[p], n[q]).alias(f"burst_{p}v{q}") for p, q in zip(periods, periods[1:])]
    span = seconds(F.min(time), F.max(time))
    out.append(span.alias("active_span_seconds"))
    out.append((total / (span / 86_400 + 1)).alias("activities_per_active_day"))
    return out


def conditional(name: str, values: list, time: str, windows=(7, 30, 90, 365)) -> list[Column]:
    """Count, share, presence and change per retained category and window."""
    out = []
    for i, v in enumerate(values):
        match = as_column(name) == F.lit(v)
        shares = []
        for w in windows:
            n = count_if(match & since(time, w))
            share = ratio(n, count_if(since(time, w)))
            shares.append(share)
            out += [
                n.alias(f"{name}_v{i}_{w}d_count"), share.alias(f"{name}_v{i}_{w}d_share"),
                (n > 0).cast("long").alias(f"{name}_v{i}_{w}d_present"),
            ]
        out += [
            (a - b).alias(f"{name}_v{i}_change_{p}v{q}")
            for p, q, a, b in zip(windows, windows[1:], shares, shares[1:])
        ]
    return out


def episode(rows: DataFrame, key: str, time: str, windows=(7, 30, 90, 365)) -> DataFrame:
    """Row opportunities and distinct keys, over the lifetime and per window."""
    per_key = rows.groupBy(*KEYS, key).agg(
        F.count(F.lit(1)).alias("_n"), F.max(time).alias("_last"),
        *[count_if(since(time, w)).alias(f"_n{w}") for w in windows],
    )
    aggs = [F.sum("_n").alias("rows"), F.count(key).alias("keys")]
    for w in windows:
        aggs.append(F.sum(f"_n{w}").alias(f"rows_{w}d"))
        aggs.append(F.count(when(since("_last", w), key)).alias(f"keys_{w}d"))
    return per_key.groupBy(*KEYS).agg(*aggs)


def state(rows: DataFrame, time: str, tie: str, numeric=(), categorical=(), lags=3, spans=(3, 5, 10)):
    """Latest values, ordered lags and summaries of the last rows per request."""
    depth = max(lags, *spans)
    ranked = top_rows(rows, KEYS, [F.col(time).desc(), F.col(tie).desc()], depth)
    out = []
    for c in numeric:
        x = finite(c)
        for k in range(1, lags + 1):
            label = "latest" if k == 1 else f"lag{k}"
            out.append(F.max(when(F.col("_rank") == k, x)).alias(f"{c}_{label}"))
        for k in spans:
            y = when(F.col("_rank") <= k, x)
            out += [
                F.avg(y).alias(f"{c}_last{k}_avg"), F.min(y).alias(f"{c}_last{k}_min"),
                F.max(y).alias(f"{c}_last{k}_max"), F.sum(y).alias(f"{c}_last{k}_sum"),
            ]
    out += [F.max(when(F.col("_rank") == 1, text(c))).alias(f"{c}_latest") for c in categorical]
    return ranked.groupBy(*KEYS).agg(*out)


def peer_deviation(
    rows: DataFrame, group: str, names: list[str], cutoff=("cutoff",), everyone: DataFrame | None = None,
    requests: Requests | None = None, time: str = "known",
) -> DataFrame:
    """Peer-group size and deviation from the group mean, per visible child row.

    Group statistics are aggregated first and looked up with salted keys, so a
    group that holds a large share of the rows is not gathered in one task.
    Where cutoffs are too many to list, ``rows`` are those of requested entities only; the
    statistics then come from ``everyone``, the events before the expansion.
    """
    salts = SALTS
    if everyone is not None and requests.cutoffs is None:
        # Rows ask for the statistics and meet them, at nearly one group and cutoff a row.
        rows, salts = checkpoint(rows), 1
        measures = {"group_size": F.lit(1)}
        for c in names:
            measures |= {f"_s_{c}": F.coalesce(finite(c), F.lit(0.0)), f"_n_{c}": finite(c).isNotNull().cast("long")}
        totals = population_totals(everyone, requests, rows, [group], time, measures)
        stats = totals.select(group, "cutoff", "group_size", *[ratio(F.col(f"_s_{c}"), F.col(f"_n_{c}")).alias(f"_mean_{c}") for c in names])
    else:
        stats = rows.groupBy(group, *cutoff).agg(
            F.count(F.lit(1)).alias("group_size"), *[F.avg(finite(c)).alias(f"_mean_{c}") for c in names]
        )
    out = lookup(rows, stats, [group, *cutoff], salts=salts)
    out = out.withColumns({f"{c}_deviation": finite(c) - F.col(f"_mean_{c}") for c in names})
    return out.drop(*[f"_mean_{c}" for c in names])


def semantic(rows: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Caller-declared SQL expressions as row columns.

    Each is checked against the schema on its own, so a typing mistake is
    reported with the name of the expression before any data is read.
    """
    for name, sql in expressions.items():
        try:
            rows.select(F.expr(sql))
        except Exception as error:
            raise ValueError(f"expression {name!r} does not fit the table: {error}") from error
    return rows.select("*", *[F.expr(sql).alias(name) for name, sql in expressions.items()])


def propagate(names: list[str], prefix: str = "") -> list[Column]:
    """One compatible continuation per already aggregated column."""
    out = []
    for name in names:
        kind = name.rsplit("_", 1)[-1]
        if kind in CONTINUATION:
            out.append(CONTINUATION[kind](name).alias(f"{prefix}{name}_{kind}"))
    return out


def reduce_edge(parent: DataFrame, child: DataFrame, parent_key: list[str], child_key: list[str], aggs):
    """Aggregate the child by its foreign key, then attach it to the parent.

    The child reaches the parent at one row per key, so siblings cannot
    multiply each other and the parent keeps its grain.
    """
    reduced = child.groupBy(*child_key).agg(*aggs)
    renamed = reduced
    for a, b in zip(child_key, parent_key):
        if a != b:
            renamed = renamed.withColumnRenamed(a, b)
    return parent.join(renamed, parent_key, "left")


# --- annotation -----------------------------------------------------------


def frequent_values(rows: DataFrame, name: str, top: int = 5, threshold: int = 20) -> list:
    """Values kept as indicators: all when few, else the most frequent ones."""
    counts = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.orderBy(F.col("n").desc(), text(name)).limit(threshold + 1).collect()
    values = [r[0] for r in ranked]
    return values if len(values) <= threshold else values[:top]


def indicators(name: str, values: list, other: bool) -> list[Column]:
    c = as_column(name)
    out = [F.when(c == F.lit(v), 1).otherwise(0).alias(f"{name}_is{i}") for i, v in enumerate(values)]
    if other:
        out.append(
            F.when(c.isNotNull() & ~c.isin(list(values)), 1).otherwise(0).alias(f"{name}_other")
        )
    return out


def gated(category: str, values: list, numbers: list[str]) -> list[Column]:
    """A numeric payload under the condition of one category value."""
    return [
        when(as_column(category) == F.lit(v), finite(x)).alias(f"{x}_if_{category}{i}")
        for i, v in enumerate(values[:3])
        for x in numbers[:4]
    ]


def text_shape(name: str) -> list[Column]:
    c = as_column(name)
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    return [
        F.length(c).alias(f"{name}_length"), words.alias(f"{name}_words"),
        c.rlike("[0-9]").alias(f"{name}_has_number"), c.rlike("https?://").alias(f"{name}_has_url"),
        (F.trim(c) == "").alias(f"{name}_is_empty"),
    ]


def root_age(time: str) -> Column:
    return days(time, "cutoff")


# --- distribution sketches ------------------------------------------------

CUT_STEPS = 7


def cutpoints(rows: DataFrame, names: list[str], steps: int = CUT_STEPS) -> dict[str, list[float]]:
    """Frozen quantile cutpoints over all training rows: distinct, below the maximum, none if too few values.

    All columns are counted by value in one pass and narrowed to the wanted ranks together, so nothing
    is sampled and no column is sorted as a whole. One row of results per column reaches the driver.
    """
    cells = F.array(*[F.struct(F.lit(n).alias("name"), finite(n).alias("v")) for n in names])
    counted = (
        rows.select(F.explode(cells).alias("cell")).select("cell.*").filter("v IS NOT NULL")
        .groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    marks = {f"q{i}": i / (steps + 1) for i in range(1, steps + 1)}
    ranges = counted.groupBy("name").agg(F.max("v").alias("top"), F.count(F.lit(1)).alias("distinct"))
    fitted = {n: [] for n in names}
    for row in percentiles(counted, ["name"], "v", marks, freq="n").join(ranges, "name").collect():
        if row["distinct"] >= 3:
            fitted[row["name"]] = [q for q in sorted({row[m] for m in marks}) if q < row["top"]]
    return fitted


def cdf(name: str, cuts: list[float]) -> list[Column]:
    """Share of finite values at or below each cutpoint, and their coverage."""
    x = finite(name)
    out = [F.avg((x <= F.lit(c)).cast("double")).alias(f"{name}_cdf{i}") for i, c in enumerate(cuts)]
    return [*out, F.avg(x.isNotNull().cast("double")).alias(f"{name}_coverage")]


def joint_cdf(a: str, b: str, cuts_a: list[float], cuts_b: list[float]) -> list[Column]:
    x, y = finite(a), finite(b)
    both = x.isNotNull() & y.isNotNull()
    out = [F.avg(both.cast("double")).alias(f"{a}_{b}_coverage")]
    for i, p in enumerate(cuts_a):
        for j, q in enumerate(cuts_b):
            inside = ((x <= F.lit(p)) & (y <= F.lit(q))).cast("double")
            out.append(F.avg(when(both, inside)).alias(f"{a}_{b}_cdf{i}{j}"))
    return out


def category_cdf(category: str, values: list, name: str, cuts: list[float]) -> list[Column]:
    x = finite(name)
    out = []
    for i, v in enumerate(values):
        match = as_column(category) == F.lit(v)
        out.append(F.avg(match.cast("double")).alias(f"{category}{i}_share"))
        for j, c in enumerate(cuts):
            inside = when(match, (x <= F.lit(c)).cast("double"))
            out.append(F.avg(inside).alias(f"{category}{i}_{name}_cdf{j}"))
    return out


# --- windows inferred from event frequency --------------------------------


def event_frequency(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Mean duration and cadence over the keys' first and last events."""
    per_key = rows.groupBy(key).agg(
        F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n")
    )
    span = days("first", "last")
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.avg("n").alias("mean_events"),
        F.avg(span).alias("mean_duration_days"),
        F.avg(when(F.col("n") > 1, span / (F.col("n") - 1))).alias("mean_cadence_days"),
    )


def inferred_periods(frequency: DataFrame, horizon_days: float, least: int = 5, most: int = 10) -> DataFrame:
    """Windows doubling from the cadence up to the duration or the horizon.

    The count of windows is held between ``least`` and ``most``.
    """
    start = F.greatest(F.lit(1.0), F.ceil(F.col("mean_cadence_days")).cast("double"))
    bound = F.least(F.greatest(F.col("mean_duration_days"), start), F.lit(float(horizon_days)))
    steps = F.floor(F.log2(bound / start)) + 1
    kept = F.least(F.greatest(steps, F.lit(least)), F.lit(most)).cast("int")
    return frequency.select("*", F.explode(F.sequence(F.lit(0), kept - 1)).alias("step")).select(
        "mean_cadence_days", "mean_duration_days", "step", (start * F.pow(F.lit(2.0), "step")).alias("period_days")
    )


# --- targets --------------------------------------------------------------


def future_labels(events: DataFrame, requests: Requests, horizon_days: float, measures: dict, time="ts", closed="left"):
    """Targets from the window after each cutoff.

    ``measures`` maps an output name to (kind, column); bool, count and sum are
    zero when the window is empty, other kinds are null.  ``closed`` selects
    ``[c, c+H)`` or ``(c, c+H]``.
    """
    from asofkit.functions.scalars import stamp

    upper = minus_seconds("cutoff", -horizon_days * 86_400)
    t = F.col(time)
    inside = (t >= F.col("cutoff")) & (t < upper) if closed == "left" else (t > F.col("cutoff")) & (t <= upper)
    aggs, zero = [], []
    for name, (kind, source) in measures.items():
        if kind == "bool":
            aggs.append(F.max(F.lit(1)).alias(name))
            zero.append(name)
        elif kind == "count":
            aggs.append(F.count(F.lit(1)).alias(name))
            zero.append(name)
        elif kind == "sum":
            aggs.append(F.sum(finite(source)).alias(name))
            zero.append(name)
        else:
            aggs.append({"avg": F.avg, "min": F.min, "max": F.max}[kind](finite(source)).alias(name))
    if requests.cutoffs is not None:
        grid = F.array(*[stamp(c) for c in requests.cutoffs])
        rows = events.filter(t >= stamp(requests.cutoffs[0])).withColumn("cutoff", F.explode(grid)).filter(inside)
    else:
        from asofkit.functions.scalars import row_salt
        from asofkit.requests import SALTS

        asked = requests.keys().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = events.withColumn("_salt", row_salt(SALTS, *[F.col(c) for c in events.columns]))
        rows = salted.join(asked, ["entity", "_salt"]).filter(inside)
    return requests.align(rows.groupBy(*KEYS).agg(*aggs), zero=zero)


def target_history(labels: DataFrame, requests: Requests, target="y", available="available_at", time="ts"):
    """Earlier mature labels as an ordinary strict child of the entity."""
    from asofkit.requests import visible

    rows = visible(labels, requests, time, available=available, available_strict=True)
    block = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("labels"), F.avg(finite(target)).alias("label_avg"),
        F.sum(finite(target)).alias("label_sum"), F.max_by(finite(target), F.col(time)).alias("label_latest"),
        days(F.max(time), F.col("cutoff")).alias("label_age_days"),
    )
    return requests.align(block, zero=["labels"])


