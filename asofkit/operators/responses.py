"""Binary-response summaries: contexts, momentum, marked timing, typed history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions.scalars import (
    as_column, count_if, finite, minus_seconds, ratio, seconds, text, when,
)
from asofkit.requests import Requests, by_cutoff, population_totals, visible
from asofkit.skew import lookup, numbered, percentiles, previous, top_rows

KEYS = ["entity", "cutoff"]


def recent(width_seconds: float, time: str = "ts") -> Column:
    return F.col(time) >= minus_seconds("cutoff", width_seconds)


# --- discovery ------------------------------------------------------------


def binary_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Prevalence of every column whose observed values are exactly 0 and 1."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("x")) for c in columns])
    stats = (
        frame.select(F.explode(cells).alias("c")).select("c.*").filter("x IS NOT NULL").groupBy("column")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"),
             count_if(~F.col("x").isin(0.0, 1.0)).alias("outside"), F.avg("x").alias("prevalence"))
    )
    return stats.filter("low = 0 AND high = 1 AND outside = 0").select("column", "prevalence")


def context_plan(frame: DataFrame, categorical: list[str], numbers: list[str]) -> DataFrame:
    """Contexts as top-two values, or as tercile borders for magnitudes."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in categorical])
    counts = (
        frame.select(F.explode(cells).alias("c")).select("c.*").filter("value IS NOT NULL")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    out = top_rows(counts, ["column"], [F.col("n").desc(), F.col("value")], 2).select(
        "column", F.lit("value").alias("kind"), F.col("_rank").alias("place"), "value",
        F.lit(None).cast("double").alias("edge"),
    )
    if numbers:
        melted = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("x")) for c in numbers])
        rows = frame.select(F.explode(melted).alias("c")).select("c.*")
        cuts = percentiles(rows, ["column"], "x", {"a": 1 / 3, "b": 2 / 3})
        edges = cuts.select("column", F.posexplode(F.array("a", "b")).alias("i", "edge")).select(
            "column", F.lit("edge").alias("kind"), (F.col("i") + 1).alias("place"),
            F.lit(None).cast("string").alias("value"), "edge",
        )
        out = out.unionByName(edges)
    return out


def rarest_mark(routes: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Binary marks of all routes, rarest first; the first is the chosen one."""
    found = None
    for name, (frame, columns) in sorted(routes.items()):
        part = binary_columns(frame, columns).withColumn("route", F.lit(name))
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("_one", F.lit(1))
    return numbered(ranked, ["_one"], [F.col("prevalence"), F.col("route"), F.col("column")]).drop("_one")


# --- contexts and momentum ---------------------------------------------------


def context_masks(contexts: dict[str, dict]) -> dict[str, list[Column]]:
    """Bucket conditions; ``values`` adds an "other" bucket, ``edges`` covers the line."""
    masks = {}
    for name, plan in contexts.items():
        c = as_column(name)
        if plan.get("values"):
            known = [c.cast("string") == F.lit(v) for v in plan["values"]]
            other = c.isNotNull() & ~c.cast("string").isin(list(plan["values"]))
            masks[name] = [*known, other]
        else:
            e = plan["edges"]
            masks[name] = [c <= e[0], *[(c > a) & (c <= b) for a, b in zip(e, e[1:])], c > e[-1]]
    return masks


def response_contexts(
    requests: Requests, rows: DataFrame, response: str, contexts: dict[str, dict], horizon_seconds: float
) -> DataFrame:
    """Support, rate, responses and lift per bucket, all-time and last horizon."""
    y = finite(response)
    aggs = []
    for scope, inside in (("all", F.lit(True)), ("recent", recent(horizon_seconds))):
        rate = F.avg(when(inside, y))
        aggs += [F.count(when(inside, y)).alias(f"{scope}_support"), rate.alias(f"{scope}_rate")]
        for name, masks in context_masks(contexts).items():
            for b, mask in enumerate(masks):
                x = when(inside & mask, y)
                label = f"{scope}_{name}_b{b}"
                aggs += [
                    F.count(x).alias(f"{label}_support"), F.sum(x).alias(f"{label}_responses"),
                    F.avg(x).alias(f"{label}_rate"), (F.avg(x) - rate).alias(f"{label}_lift"),
                ]
    block = rows.groupBy(*KEYS).agg(*aggs)
    zero = [c for c in block.columns if c.endswith(("_support", "_responses"))]
    return requests.align(block, zero=zero)


def response_momentum(requests: Requests, rows: DataFrame, response: str, horizon_seconds: float) -> DataFrame:
    y, h = finite(response), horizon_seconds
    positive = y == 1
    aggs = [
        seconds(F.max(when(positive, "ts")), F.col("cutoff")).alias("seconds_since_response"),
        F.count_distinct(when(positive, F.date_trunc("hour", "ts"))).alias("response_hours"),
    ]
    for i, width in enumerate((h / 4, h / 2, h, 2 * h)):
        x = when(recent(width), y)
        aggs += [F.count(x).alias(f"w{i}_support"), F.sum(x).alias(f"w{i}_responses"), F.avg(x).alias(f"w{i}_rate")]
    now, before = when(recent(h), y), when(recent(2 * h) & ~recent(h), y)
    zero = F.lit(0.0)
    aggs.append((F.coalesce(F.sum(now), zero) - F.coalesce(F.sum(before), zero)).alias("count_change"))
    aggs.append((F.avg(now) - F.avg(before)).alias("rate_change"))
    block = rows.groupBy(*KEYS).agg(*aggs)
    counts = [c for c in block.columns if c.endswith(("_support", "_responses", "_hours", "count_change"))]
    return requests.align(block, zero=counts)


def own_history(
    requests: Requests, history: DataFrame, horizon_seconds: float, target: str = "y", strength: float = 5.0
) -> DataFrame:
    """The root's own labels, mature strictly before the cutoff, shrunk to the global mean.

    ``history`` carries ``entity``, ``available_at`` and the target.
    """
    rows = visible(history, requests, None, available="available_at", available_strict=True)
    y = finite(target)
    near, wide = recent(horizon_seconds, "available_at"), recent(2 * horizon_seconds, "available_at")
    block = rows.groupBy(*KEYS).agg(
        F.count(y).alias("history_count"), F.avg(y).alias("history_mean"), F.stddev_pop(y).alias("history_std"),
        F.max_by(y, F.struct(F.col("available_at"), y)).alias("history_latest"),
        seconds(F.max("available_at"), F.col("cutoff")).alias("history_seconds"),
        F.count(when(near, y)).alias("recent_count"), F.avg(when(near, y)).alias("recent_mean"),
        F.count(when(wide, y)).alias("two_horizon_count"), F.avg(when(wide, y)).alias("two_horizon_mean"),
    )
    out = requests.align(block, zero=["history_count", "recent_count", "two_horizon_count"])
    if requests.cutoffs is not None:
        prior = rows.groupBy("cutoff").agg(F.avg(y).alias("_prior"))
    else:
        # The rows are those of requested roots; the mean is that of all roots.
        measures = {"_sum": F.coalesce(y, F.lit(0.0)), "_n": y.isNotNull().cast("long")}
        prior = population_totals(history, requests, requests.frame, [], "available_at", measures)
        prior = prior.select("cutoff", ratio(F.col("_sum"), F.col("_n")).alias("_prior"))
    out = out.join(by_cutoff(prior, requests), "cutoff", "left")
    n = F.col("history_count")
    shrunk = (F.coalesce(F.col("history_mean"), F.lit(0.0)) * n + strength * F.col("_prior")) / (n + strength)
    return out.withColumn("history_shrunk_mean", shrunk).drop("_prior")


# --- marked timing --------------------------------------------------------------


def marked_timing(
    requests: Requests, events: DataFrame, horizon_seconds: float, response: str = "response",
    history_days: float = 730, slice_days: float = 1.0,
) -> DataFrame:
    """Exposure and gap statistics of one binary mark.

    Gaps are taken once over each entity's distinct positive instants.  A prefix
    in time keeps every predecessor, so the same gaps serve all cutoffs; only a
    gap that starts before the lookback is dropped.
    """
    h = horizon_seconds
    rows = visible(events, requests, lookback_days=history_days)
    y = finite(response)
    positive = y == 1
    scales = (1 / 3, 1, 4)
    hourly = rows.groupBy(*KEYS, F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(y).alias("n"), F.sum(y).alias("k"), F.max(when(positive, "ts")).alias("hit"),
        F.max(when(y == 0, "ts")).alias("miss"),
        *[F.count(when(recent(h * s), y)).alias(f"n{i}") for i, s in enumerate(scales)],
        *[F.sum(when(recent(h * s), y)).alias(f"k{i}") for i, s in enumerate(scales)],
    )
    aggs = [
        F.sum("n").alias("exposures"), F.sum("k").alias("positive_events"),
        (seconds(F.max("hit"), F.col("cutoff")) / h).alias("positive_recency"),
        (seconds(F.max("miss"), F.col("cutoff")) / h).alias("negative_recency"),
    ]
    for i, s in enumerate(scales):
        aggs += [
            F.sum(f"n{i}").alias(f"w{i}_exposures"), F.sum(f"k{i}").alias(f"w{i}_positives"),
            ratio(F.sum(f"k{i}"), F.sum(f"n{i}")).alias(f"w{i}_rate"),
            count_if(recent(h * s, "hit")).alias(f"w{i}_positive_hours"),
        ]
    block = hourly.groupBy(*KEYS).agg(*aggs)

    instants = events.filter(positive).select("entity", "ts").distinct()
    linked = previous(instants, ["entity"], "ts", {"before": "ts"}, slice_days)
    arrivals = visible(linked, requests, lookback_days=history_days)
    reached = arrivals.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("positive_arrivals"),
        *[count_if(recent(h * s)).alias(f"w{i}_positive_arrivals") for i, s in enumerate(scales)],
    )
    block = block.join(reached, KEYS, "left")
    inside = F.col("before") >= minus_seconds("cutoff", history_days * 86_400)
    arrivals = arrivals.withColumn("gap", when(inside, seconds("before", "ts")))
    latest = arrivals.groupBy(*KEYS).agg(seconds(F.max("ts"), F.col("cutoff")).alias("age"))
    aged = lookup(arrivals.filter("gap IS NOT NULL"), latest, KEYS)
    gaps = aged.groupBy(*KEYS).agg(
        F.count("gap").alias("gaps"), (F.avg("gap") / h).alias("mean_gap"),
        ratio(F.stddev_pop("gap"), F.avg("gap")).alias("gap_cv"),
        count_if(F.col("gap") > F.col("age")).alias("_surviving"),
        count_if(F.col("gap") > F.col("age") + h).alias("_later"),
    )
    middle = percentiles(aged, KEYS, "gap", {"_median": 0.5})
    counts = [c for c in block.columns if c.endswith(("exposures", "events", "arrivals", "hours", "positives"))]
    out = requests.align(block, zero=counts)
    out = out.join(gaps, KEYS, "left").join(middle, KEYS, "left")
    out = out.withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    enough = F.col("gaps") >= 3
    return (
        out.withColumn("median_gap", F.col("_median") / h)
        .withColumn("conditional_tail", when(enough, (F.col("_later") + 1) / (F.col("_surviving") + 1)))
        .withColumn("tail_fraction", when(enough, ratio("_surviving", "gaps")))
        .withColumn("age_over_mean_gap", when(enough, ratio("positive_recency", "mean_gap")))
        .drop("_surviving", "_later", "_median")
    )


def marked_contexts(
    requests: Requests, events: DataFrame, horizon_seconds: float, response: str = "response",
    context: str = "context", history_days: float = 730, strength: float = 5.0,
) -> DataFrame:
    """How a mark spreads over contexts: count, share, entropy and shrunk rates.

    One aggregation to (entity, cutoff, context) carries every window; all later
    steps work on that reduced table.
    """
    rows = visible(events, requests, lookback_days=history_days).withColumn(
        "_c", F.coalesce(text(context), F.lit("__missing__"))
    )
    y = finite(response)
    scales = (None, 1 / 3, 1, 4)
    insides = [F.lit(True) if s is None else recent(horizon_seconds * s) for s in scales]
    strata = rows.groupBy(*KEYS, "_c").agg(
        *[F.count(when(i, y)).alias(f"n{w}") for w, i in enumerate(insides)],
        *[F.sum(when(i, y)).alias(f"k{w}") for w, i in enumerate(insides)],
    )
    own = strata.groupBy(*KEYS).agg(
        (F.sum("k0") / F.sum("n0")).alias("_rate"), *[F.sum(f"n{w}").alias(f"t{w}") for w in range(4)]
    )
    joined = lookup(strata, own, KEYS)
    aggs = []
    for w in range(4):
        n = when(F.col(f"n{w}") > 0, F.col(f"n{w}").cast("double"))
        share = n / F.nullif(F.col(f"t{w}"), F.lit(0))
        rate = (F.coalesce(F.col(f"k{w}"), F.lit(0.0)) + strength * F.col("_rate")) / (n + strength)
        aggs += [
            F.count(n).alias(f"w{w}_contexts"), count_if(F.col(f"k{w}") > 0).alias(f"w{w}_positive_contexts"),
            F.max(share).alias(f"w{w}_largest_share"), (-F.sum(share * F.log(share))).alias(f"w{w}_entropy"),
            F.avg(rate).alias(f"w{w}_rate_mean"), F.stddev_pop(rate).alias(f"w{w}_rate_std"),
        ]
    block = joined.groupBy(*KEYS).agg(*aggs)
    return requests.align(block, zero=[c for c in block.columns if c.endswith("contexts")])


# --- group priors and typed codes --------------------------------------------------


def attribute_priors(
    requests: Requests, events: DataFrame, roots: DataFrame, attributes: list[str], horizon_seconds: float,
    response: str = "response", strength: float = 20.0, known: str = "ts",
) -> DataFrame:
    """Response rates of other roots that share a parent attribute.

    Everything is derived from one table per (root, cutoff), so removing the
    requested root is a subtraction and its own events never reach its prior.
    """
    y = finite(response)
    rows = visible(events, requests, known).filter(recent(3650 * 86_400))
    scales = (None, 1.0, 4.0)
    insides = [F.lit(True) if s is None else recent(horizon_seconds * s) for s in scales]
    aggs = []
    for w, i in enumerate(insides):
        aggs += [F.count(when(i, y)).alias(f"n{w}"), F.coalesce(F.sum(when(i, y)), F.lit(0.0)).alias(f"p{w}")]
    own = rows.groupBy(*KEYS).agg(*aggs).join(roots.select("entity", *attributes), "entity")
    derived = {}
    for w in range(3):
        derived[f"r{w}"] = F.when(F.col(f"n{w}") > 0, 1).cast("long")
        derived[f"s{w}"] = ratio(f"p{w}", f"n{w}")
        derived[f"q{w}"] = F.when(F.col(f"p{w}") > 0, 1).cast("long")
    own = own.withColumns(derived)
    parts = [f"{k}{w}" for w in range(3) for k in "rnpsq"]
    totals = own.groupBy("cutoff").agg(*[F.sum(c).alias(f"t_{c}") for c in parts])
    asked = requests.frame.join(roots.select("entity", *attributes), "entity", "left")
    out = asked.join(own.select(*KEYS, *parts), KEYS, "left").join(by_cutoff(totals, requests), "cutoff", "left")
    for i, a in enumerate(attributes):
        group = own.filter(F.col(a).isNotNull()).groupBy("cutoff", a).agg(*[F.sum(c).alias(f"g{i}_{c}") for c in parts])
        out = lookup(out, group, ["cutoff", a])

    def zero(name):
        return F.coalesce(F.col(name), F.lit(0))

    columns = []
    for i, a in enumerate(attributes):
        known = F.col(a).isNotNull()
        for w in range(3):
            def other(k, i=i, w=w, known=known):
                return zero(f"g{i}_{k}{w}") - F.when(known, zero(f"{k}{w}")).otherwise(0)

            def prior(top, bottom, w=w):
                return ratio(F.col(f"t_{top}{w}") - zero(f"{top}{w}"), F.col(f"t_{bottom}{w}") - zero(f"{bottom}{w}"))

            label = f"{a}_w{w}"
            columns += [
                other("r").alias(f"{label}_peers"),
                ((other("p") + strength * prior("p", "n")) / (other("n") + strength)).alias(f"{label}_event_rate"),
                ((other("s") + strength * prior("s", "r")) / (other("r") + strength)).alias(f"{label}_root_rate"),
                ((other("q") + strength * prior("q", "r")) / (other("r") + strength)).alias(f"{label}_positive_root_share"),
            ]
    return out.select(*KEYS, *columns)


def typed_history(
    requests: Requests, events: DataFrame, code: str, vocabulary: list, horizon_seconds: float, known: str = "ts",
    available: str | None = None,
) -> DataFrame:
    """Counts, last age and decayed count for each retained code and the rest."""
    h = horizon_seconds
    rows = visible(events, requests, known, available=available, available_strict=True)
    rows = rows.filter(recent(3650 * 86_400))
    c = as_column(code)
    slots = [c == F.lit(v) for v in vocabulary]
    slots.append(~F.coalesce(c.isin(list(vocabulary)), F.lit(False)))
    weight = F.exp(F.lit(-math.log(2.0)) * seconds("ts", "cutoff") / (4 * h))
    aggs = []
    for i, match in enumerate(slots):
        aggs += [
            count_if(match).alias(f"s{i}_count"), count_if(match & recent(h / 4)).alias(f"s{i}_quarter"),
            count_if(match & recent(h)).alias(f"s{i}_one"), count_if(match & recent(4 * h)).alias(f"s{i}_four"),
            (seconds(F.max(when(match, "ts")), F.col("cutoff")) / h).alias(f"s{i}_last_age"),
            F.sum(when(match, weight)).alias(f"s{i}_decayed"),
        ]
    block = rows.groupBy(*KEYS).agg(*aggs)
    zero = [c for c in block.columns if c.endswith(("_count", "_quarter", "_one", "_four"))]
    return requests.align(block, zero=zero, defaults={c: 0.0 for c in block.columns if c.endswith("_decayed")})


def code_vocabulary(frame: DataFrame, code: str, size: int = 8) -> list:
    counts = frame.filter(as_column(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.orderBy(F.col("n").desc(), F.col(code)).limit(size).collect()]
