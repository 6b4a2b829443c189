"""Exact building blocks that stay distributed when one key dominates.

A window partitioned by a hot entity would sort that entity's whole history in
one task, and a join on it would send every row to one reducer.  These helpers
give the same answers from bounded pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.scalars import as_column, count_if, hash_number, minus_seconds, row_salt
from asofkit.session import checkpoint

SALTS = 8


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the input.

    Spark sizes a scan by its compressed files and an aggregate by its source, so a table of a million rows may look small
    enough to be broadcast through the driver. The hint keeps such a join distributed at every size.
    """
    return left.join(right.hint("merge"), on, how)


def copies(table: DataFrame, salts: int) -> DataFrame:
    """``table`` once for each ``_salt`` below ``salts``.

    A product with a short range, because the planner's size of a table counts the rows of a product but not those of an
    ``explode``: it would broadcast the copies of a table that only just fits by itself.
    """
    numbers = table.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt"))
    return table.crossJoin(F.broadcast(numbers))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS, grows: bool = False):
    """Join many rows to a one-row-per-key table, spreading hot keys.

    The small side is repeated ``salts`` times; rows choose a copy by content.
    The result is not partitioned by ``keys`` alone, so a following aggregation
    on those keys combines partially before it shuffles.  With one salt this is
    a plain join, for tables nearly as large as the rows: adaptive execution
    splits a skewed partition there because another exchange follows anyway.
    A table that ``grows`` with the input is never broadcast, also where adaptive
    execution finds its copies small enough.
    """
    if salts == 1:
        return joined(rows, table, keys, how)
    spread = [f.name for f in rows.schema.fields if f.dataType.typeName() != "map"]
    salted = rows.withColumn("_salt", row_salt(salts, *[F.col(c) for c in spread]))
    repeated = copies(table, salts)
    return (joined(salted, repeated, [*keys, "_salt"], how) if grows else salted.join(repeated, [*keys, "_salt"], how)).drop("_salt")


def previous(
    instants: DataFrame,
    keys: list[str],
    order: str,
    carry: dict[str, str],
    slice_days: float = 1.0,
) -> DataFrame:
    """``lag`` of the ``carry`` columns over ``keys`` ordered by a timestamp.

    ``instants`` holds one row per (keys, order).  Rows are windowed inside time
    slices; only the last row of each slice is carried over to the next one, so
    no task ever sorts more than a slice of one key, plus one row per slice.
    """
    width = int(slice_days * 86_400)
    sliced = instants.withColumn(
        "_slice", F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / F.lit(width))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_slice")
    bundle = F.struct(F.col(order).alias("_at"), *[F.col(c).alias(n) for n, c in carry.items()])
    heads = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max_by(bundle, F.col(order)).alias("_tail"))
        .withColumn("_carried", F.lag("_tail").over(across))
        .select(*keys, "_slice", "_carried")
    )
    linked = joined(sliced.withColumn("_inside", F.lag(bundle).over(inside)), heads, [*keys, "_slice"], "left")
    prior = F.coalesce(F.col("_inside"), F.col("_carried"))
    return linked.withColumns({name: prior[name] for name in carry}).drop("_inside", "_carried", "_slice")


def _log_bucket(value: Column) -> Column:
    """Monotone bucket number, 16384 buckets to each factor of e."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * 16384)).cast("long")


def percentiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    freq: str | None = None,
    limit: int | None = 200_000,
) -> DataFrame:
    """Exact linear-interpolated percentiles per key.

    Values are counted first (a map-side combine), so repeated values cost one
    row.  Keys with at most ``limit`` distinct values use the built-in
    aggregate; larger ones are narrowed to the buckets that hold the wanted
    ranks and never meet in one task.  ``limit=None`` states that the distinct
    values are bounded by their nature (whole days, fan-outs, flags).
    """
    whole = not keys
    if whole:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    weight = F.sum(freq) if freq else F.count(F.lit(1))
    counted = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(weight.cast("long").alias("_n"))
    )
    names = list(probabilities)
    wanted = F.array(*[F.lit(float(probabilities[n])) for n in names])

    def small(part):
        done = part.groupBy(*keys).agg(F.percentile("_v", wanted, F.col("_n")).alias("_p"))
        return done.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])

    if limit is None:
        out = small(counted)
    elif whole:
        large = counted.agg(F.count(F.lit(1)) > limit).scalar()
        out = small(counted.filter(~large)).unionByName(_large_percentiles(counted.filter(large), keys, probabilities))
    else:
        sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"))
        large = sizes.filter(F.col("_distinct") > limit).select(*keys)
        hot = _large_percentiles(counted.join(large, keys, "left_semi"), keys, probabilities)
        out = small(counted.join(large, keys, "left_anti")).unionByName(hot)
    return out.drop("_all") if whole else out


def _large_percentiles(counted: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Find the bucket of each wanted rank, then order only those buckets."""
    names = list(probabilities)
    running = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_b", _log_bucket(F.col("_v")))
    coarse = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m")).withColumns(
        {"_end": F.sum("_m").over(running), "_total": F.sum("_m").over(Window.partitionBy(*keys))}
    )
    position = [(F.col("_total") - 1) * F.lit(float(probabilities[n])) for n in names]
    ranks = F.array(
        *[
            F.struct(
                F.lit(2 * i + side).alias("slot"),
                (F.floor(p) if side == 0 else F.ceil(p)).cast("long").alias("rank"),
                (p - F.floor(p)).alias("part"),
            )
            for i, p in enumerate(position)
            for side in (0, 1)
        ]
    )
    start = F.col("_end") - F.col("_m")
    inside = F.filter(ranks, lambda r: (r["rank"] < F.col("_end")) & (r["rank"] >= start))
    targets = coarse.withColumn("_want", inside).filter(F.size("_want") > 0).select(*keys, "_b", "_want", start.alias("_start"))
    by_value = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.join(targets, [*keys, "_b"]).withColumn("_end", F.col("_start") + F.sum("_n").over(by_value))
    hits = rows.withColumn("_hit", F.explode("_want")).filter(
        (F.col("_hit.rank") < F.col("_end")) & (F.col("_hit.rank") >= F.col("_end") - F.col("_n"))
    )

    def at(slot):
        return F.max(F.when(F.col("_hit.slot") == slot, F.col("_v")))

    columns = []
    for i, name in enumerate(names):
        part = F.max(F.when(F.col("_hit.slot") == 2 * i, F.col("_hit.part")))
        columns.append((at(2 * i) + part * (at(2 * i + 1) - at(2 * i))).alias(name))
    return hits.groupBy(*keys).agg(*columns)


STRIDE = 16


def running_totals(
    rows: DataFrame,
    keys: list[str],
    order: str,
    totals: dict[str, str],
    buckets: int = 256,
    ascending: bool = True,
) -> DataFrame:
    """Inclusive running sums over ``keys`` ordered by a number.

    ``rows`` holds one row per (keys, order).  Rows are windowed inside value
    buckets whose borders are approximate quantiles of the data; the bucket
    sums (at most ``buckets`` + 1 per key) give each bucket its offset.  The
    borders only balance the work: any borders give the same sums.
    """
    number = F.col(order).cast("double")
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    borders = rows.agg(F.percentile_approx(number, steps, F.lit(10_000)).alias("_cuts"))
    spread = rows.withColumn("_cuts", borders.scalar())
    if buckets > STRIDE:
        # Two short scans instead of one over all borders.
        marks = F.filter(F.transform(F.sequence(F.lit(1), F.lit(buckets // STRIDE - 1)), lambda i: F.col("_cuts")[i * STRIDE - 1]), lambda c: c <= number)
        spread = spread.withColumn("_skip", F.size(marks) * STRIDE)
        near = F.slice("_cuts", F.col("_skip") + 1, F.lit(STRIDE - 1))
        bucket = F.col("_skip") + F.size(F.filter(near, lambda c: c <= number))
    else:
        bucket = F.size(F.filter("_cuts", lambda c: c <= number))
    spread = spread.withColumn("_bucket", bucket).drop("_cuts", "_skip")
    direction = F.asc if ascending else F.desc
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    across = Window.partitionBy(*keys).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy(*keys, "_bucket").agg(
        *[F.sum(source).alias(f"_o_{name}") for name, source in totals.items()]
    )
    offsets = offsets.withColumns({f"_o_{name}": F.sum(f"_o_{name}").over(across) for name in totals})
    out = spread.withColumns({name: F.sum(source).over(inside) for name, source in totals.items()})
    out = out.join(offsets, [*keys, "_bucket"], "left")
    out = out.withColumns({name: F.col(name) + F.coalesce(F.col(f"_o_{name}"), F.lit(0)) for name in totals})
    return out.drop("_bucket", *[f"_o_{name}" for name in totals])


WHOLE_LIMIT = 200_000


def totals_at(
    events: DataFrame, points: DataFrame, keys: list[str], time: str, moment: str, measures: dict[str, Column]
) -> DataFrame:
    """Sums of ``measures`` over a key's events strictly before each point (keys, moment).

    Events are reduced to one change per key and instant, points join them as changes of nothing, and a running total in time
    answers all points in one pass: the work grows with events plus points, never with their product. Rows with a null key are left out.
    Keys of more than ``WHOLE_LIMIT`` rows, which are few, are summed in buckets.
    """
    def instant(column: str, after: int) -> Column:
        # A point stands before the events of its own instant.
        return (F.unix_micros(F.col(column).cast("timestamp")) * 2 + after).alias("_at")

    named = [F.col(k) for k in keys]
    known = F.lit(True)
    for k in named:
        known = known & k.isNotNull()
    changes = events.filter(known).withColumns({f"_m_{n}": m for n, m in measures.items()}).groupBy(*named, instant(time, 1)).agg(
        *[F.sum(f"_m_{n}").alias(n) for n in measures])
    asked = points.filter(known).select(*named, instant(moment, 0), F.col(moment).alias("_moment")).distinct()
    empty = asked.select(*keys, "_at", *[F.lit(0).cast(changes.schema[n].dataType).alias(n) for n in measures], "_moment")
    # Sizes, borders and sums all read this table, so it is computed once.
    both = checkpoint(changes.withColumn("_moment", F.lit(None).cast(points.schema[moment].dataType)).unionByName(empty))
    sums = {f"_t_{n}": n for n in measures}
    if keys:
        # A key of few rows is summed whole; in buckets each would have nearly as many sums as rows.
        sizes = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        large = F.broadcast(sizes.filter(F.col("_rows") > WHOLE_LIMIT).select(*keys))
        upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        whole = both.join(large, keys, "left_anti").withColumns({t: F.sum(n).over(upto) for t, n in sums.items()})
        totals = whole.unionByName(running_totals(both.join(large, keys, "left_semi"), keys, "_at", sums))
    else:
        totals = running_totals(both, keys, "_at", sums)
    totals = totals.filter("_moment IS NOT NULL")
    return totals.select(*keys, F.col("_moment").alias(moment), *[F.coalesce(F.col(f"_t_{n}"), F.lit(0)).alias(n) for n in measures])


def distinct_in_windows(
    rows: DataFrame, keys: list[str], value: Column, time: str, widths: dict[str, float | None]
) -> DataFrame:
    """Distinct values in several windows that all end at the cutoff.

    A value lies in a window exactly when its latest row does, so one reduction
    to (keys, value) replaces a separate distinct aggregate per window.
    """
    latest = (
        rows.withColumn("_value", value).filter("_value IS NOT NULL")
        .groupBy(*keys, "_value").agg(F.max(time).alias("_last"))
    )
    aggs = []
    for name, width in widths.items():
        inside = F.lit(True) if width is None else F.col("_last") >= minus_seconds("cutoff", width)
        aggs.append(count_if(inside).alias(name))
    return latest.groupBy(*keys).agg(*aggs)


PARTIAL_LIMIT = 1000


def top_rows(rows: DataFrame, keys: list[str], order: list, count: int, rank: str = "_rank") -> DataFrame:
    """The first ``count`` rows per key.

    Written as ``row_number <= count`` so Spark limits each group before and
    after the shuffle.  That rule stops at a thousand rows per group; a larger
    ``count`` goes through two salted rounds first, so the last window sees at
    most 64 x ``count`` rows of a hot key.
    """
    named = [as_column(k) for k in keys]
    if count > PARTIAL_LIMIT:
        spread = [f.name for f in rows.schema.fields if f.dataType.typeName() != "map"]
        rows = rows.withColumn("_s", row_salt(4096, *[F.col(c) for c in spread]))
        for salts in (4096, 64):
            first = Window.partitionBy(*named, F.pmod("_s", F.lit(salts))).orderBy(*order)
            rows = rows.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= count).drop(rank)
        rows = rows.drop("_s")
    window = Window.partitionBy(*named).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= count)


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """Row numbers on metadata-sized tables (columns, paths, cutoffs)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def hashed_places(rows: DataFrame, keys: list[str], identity: list[str], name: str = "place") -> DataFrame:
    """One-based place of every row in content-hash order within ``keys``.

    Rows are counted by 32-bit hash number, the counts are accumulated in value
    buckets, and only rows that share a hash number are ordered by a window.
    """
    hashed = rows.withColumn("_hash", hash_number(*identity))
    sizes = hashed.groupBy(*keys, "_hash").agg(F.count(F.lit(1)).alias("_n"))
    ends = running_totals(sizes, keys, "_hash", {"_end": "_n"})
    offsets = ends.select(*keys, "_hash", (F.col("_end") - F.col("_n")).alias("_before"))
    inside = Window.partitionBy(*keys, "_hash").orderBy(*[as_column(i) for i in identity])
    placed = joined(hashed.withColumn("_k", F.row_number().over(inside)), offsets, [*keys, "_hash"])
    return placed.withColumn(name, F.col("_before") + F.col("_k")).drop("_hash", "_before", "_k")
