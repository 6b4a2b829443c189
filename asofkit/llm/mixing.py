"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``SHARE`` times the words of all
documents; a target stops at ``MOST`` times its source's words and the excess is shared again by weight.

Slot j of the schedule belongs to the source in whose part of the cumulated targets the
golden-ratio point frac((j + 1) * phi) falls. A source's slots are ranked; its k-th takes the k-th block of
``block`` words of its stream, which is its documents in a shuffled (hash) order, as often as its target needs.
Rounding leaves a source some words short or long; slots behind its target take nothing, and closing slots
at the end of the schedule take what the points left. So each source meets its target to the word.
``first_slot`` and ``last_slot`` say when the mix reads a document, ``n_pieces`` in how many pieces of blocks; null, null and 0 where
it takes nothing of it.

Null and empty texts have no words: size 0, taken 0. Null ids and null sources are values like others. Repeated
rows are separate documents of equal size. An empty table, or one without words, gives targets of 0. Only
the named columns of the input are read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.shared import NULL_ID, stored

WEIGHTS = (5, 2, 1)
SHARE_HALVES = 3  # 150 %
MOST = 2
BLOCK = 4096
CELLS = 4096
PHI = (math.sqrt(5) - 1) / 2
SLICE = 20_000  # documents of one slice of a source's shuffled order


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, size): words ``[^\\x20\\x09-\\x0D]+`` by built-in functions."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return docs.select("doc_id", "source", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")))).alias("shuffle"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"), words.cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, documents, source_size, weight, target): one row for each source.

    Sources stop at their cap in the order of cap over weight: the first k are capped exactly if the
    level that the others would get reaches the k-th cap. One window over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(w) for w in weights])
    ranked = by.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.get(pick, (F.col("rank") - 1) % len(weights)).cast("long"))
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = ranked.withColumns({
        "all": F.sum("source_size").over(everything),
        "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST,
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # Twice the words still to share when all before this source are capped; exact in integers.
    rest = level.withColumn("rest", F.col("all") * SHARE_HALVES - F.col("capped") * 2)
    rest = rest.withColumn("stops", F.col("weight") * F.col("rest") >= F.col("source_size") * (2 * MOST) * F.col("left"))
    first_free = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "rank", "rest", "left"))).over(everything)
    free = rest.withColumn("free", first_free)
    share = (F.col("weight") * F.col("free.rest")).cast("double") / (F.col("free.left") * 2).cast("double")
    target = F.when(F.col("stops"), (F.col("source_size") * MOST).cast("double")).otherwise(share)
    return free.select("source", "documents", "source_size", "weight", "rank", target.alias("target"))


def streams(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Each document with ``at``, the words before it in its source's shuffled order.

    A hot source is cut into slices of the hash range; only slice totals meet, so no task orders a whole source.
    """
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    cut = sizes.alias("s").join(goals.select("source", "rank", "documents", "source_size", "target").alias("g"), same).select("s.*", "g.rank", "g.documents", "g.source_size", "g.target")
    # The first 32 bits of the hash, scaled to the number of slices of the source.
    part = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * F.ceil(F.col("documents") / SLICE) / F.lit(2**32))
    cut = cut.withColumn("slice", part)
    inside = Window.partitionBy("rank", "slice").orderBy("shuffle", "sig").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("rank", "slice").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0))).drop("n")
    return cut.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["rank", "slice"]).withColumn("at", F.col("before") + F.col("within"))


def schedule(spark, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, k, first, last): which words of which source's stream each slot takes."""
    ends = Window.partitionBy(F.lit(0)).orderBy("rank")
    goals = goals.withColumn("goal", F.round("target").cast("long"))
    bounds = goals.withColumn("high", F.sum("goal").over(ends)).withColumn("low", F.col("high") - F.col("goal")).select("rank", "goal", "low", "high")
    whole = bounds.agg(F.max("high")).first()[0] or 0
    slots = max(1, math.ceil(whole / block))
    point = F.col("slot").cast("double") * PHI + PHI
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", (point - F.floor(point)) * whole)
    # Points meet the cumulated targets cell by cell, an equi-join whatever the number of sources.
    cell = F.lit(CELLS / whole if whole else 0.0)
    spread = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cell), F.floor(F.col("high") * cell))))
    drawn = points.withColumn("cell", F.floor(F.col("point") * cell)).join(spread, "cell").filter("point >= low AND point < high").select("slot", "rank", "goal")
    # Ranks of slots within their source: counts of slot ranges first, so a heavy source is not ordered in one task.
    drawn = drawn.withColumn("part", F.floor(F.col("slot") / 65536))
    inside = Window.partitionBy("rank", "part").orderBy("slot")
    across = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("rank", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0)))
    ranked = drawn.withColumn("within", F.row_number().over(inside) - 1).join(counts.select("rank", "part", "before"), ["rank", "part"])
    first = (F.col("before") + F.col("within")) * block
    regular = ranked.withColumn("first", first).withColumn("last", F.least(F.col("first") + block, "goal")).filter("first < last")
    regular = regular.select("slot", "rank", (F.col("first") / block).cast("long").alias("k"), "first", "last")
    given = counts.groupBy("rank").agg(F.sum("n").alias("n"))
    start = F.coalesce(F.col("n"), F.lit(0))
    blocks = F.ceil(F.col("goal") / block)
    closing = bounds.join(given, "rank", "left").filter(start < blocks).select("rank", "goal", F.explode(F.sequence(start, blocks - 1)).alias("k"))
    closing = closing.select((F.lit(slots) + F.col("k")).alias("slot"), "rank", F.col("k").cast("long").alias("k"), (F.col("k") * block).alias("first"), F.least((F.col("k") + 1) * block, "goal").alias("last"))
    return regular.unionByName(closing)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, sig, size, source_size, target, taken, first_slot, last_slot, n_pieces)."""
    spark = docs.sparkSession
    sizes = stored(measured(docs), "sizes")
    goals = stored(targets(sizes), "targets")
    rows = streams(sizes, goals)
    # A document stands in its source's stream once for each pass; each place meets the blocks it reaches into.
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "streams")
    passes = rows.filter("size > 0").select("row", "rank", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda e: F.col("at") + e * F.col("source_size"))).alias("from"))
    passes = passes.withColumn("to", F.col("from") + F.col("size"))
    touched = passes.select("row", "rank", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("k"))
    plan = schedule(spark, goals, block)
    taken = touched.join(plan, ["rank", "k"]).withColumn("words", F.least("to", "last") - F.greatest("from", "first")).filter("words > 0")
    taken = taken.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count(F.lit(1)).alias("n_pieces"))
    none = F.lit(0).cast("long")
    return rows.join(taken, "row", "left").select(
        "doc_id", "source", "sig", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", "last_slot", F.coalesce("n_pieces", none).alias("n_pieces"))


SQL = r"""
WITH w AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(source, '')) AS shuffle,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM w GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
g AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight FROM r),
l AS (
  SELECT *, sum(source_size) OVER () * 3 - 4 * coalesce(sum(source_size) OVER f, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS lft
  FROM g WINDOW f AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, weight * rest >= 4 * source_size * lft AS stops FROM l),
q AS (SELECT rest, lft FROM p WHERE NOT stops ORDER BY source_size / weight, rank LIMIT 1),
t AS (
  SELECT p.source, p.rank, source_size,
         CASE WHEN stops THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * q.rest AS DOUBLE) / CAST(q.lft * 2 AS DOUBLE) END AS target
  FROM p LEFT JOIN q ON true),
b AS (
  SELECT *, CAST(sum(goal) OVER (ORDER BY rank) AS BIGINT) AS high, CAST(sum(goal) OVER () AS BIGINT) AS whole
  FROM (SELECT *, CAST(round(target) AS BIGINT) AS goal FROM t)),
n AS (SELECT CAST(greatest(1, ceil(any_value(whole) / 4096)) AS BIGINT) AS slots, any_value(whole) AS whole FROM b),
j AS (
  SELECT slot, (point - floor(point)) * whole AS point
  FROM (SELECT unnest(range(slots)) AS slot, whole, CAST(unnest(range(slots)) AS DOUBLE) * ((sqrt(5) - 1) / 2) + (sqrt(5) - 1) / 2 AS point FROM n)),
h AS (
  SELECT slot, rank, goal, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS k
  FROM j JOIN b ON point >= high - goal AND point < high),
e AS (
  SELECT slot, rank, k, goal FROM h
  UNION ALL
  SELECT slots + k, rank, k, goal
  FROM (SELECT slots, rank, goal, unnest(range(CAST(coalesce(given, 0) AS BIGINT), CAST(ceil(goal / 4096) AS BIGINT))) AS k
        FROM n, b LEFT JOIN (SELECT rank, count(*) AS given FROM h GROUP BY rank) USING (rank))),
d AS (
  SELECT w.*, row_number() OVER () AS r, b.rank, b.source_size, b.target, b.goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY w.source ORDER BY shuffle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM w JOIN b ON w.source IS NOT DISTINCT FROM b.source),
x AS (
  SELECT r, rank, start, start + size AS stop, unnest(range(start // 4096, (start + size - 1) // 4096 + 1)) AS k
  FROM (SELECT r, rank, size, pos + unnest([0, 1]) * source_size AS start FROM d WHERE size > 0)),
y AS (
  SELECT r, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n_pieces
  FROM x JOIN e USING (rank, k) WHERE least(stop, (k + 1) * 4096, goal) > greatest(start, k * 4096) GROUP BY r)
SELECT doc_id, size, source_size, target,
       CAST(greatest(least(pos + size, goal) - pos, 0) + greatest(least(pos + source_size + size, goal) - pos - source_size, 0) AS BIGINT) AS taken,
       first_slot, last_slot, coalesce(n_pieces, 0) AS n_pieces
FROM d LEFT JOIN y USING (r)
"""


def query(spark, folder: str) -> DataFrame:
    return mix(spark.read.parquet(f"{folder}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot", "last_slot", "n_pieces")


def _words(text, count):
    """The first ``count`` words of a text, joined by one space."""
    return F.array_join(F.slice(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.lit(1), count.cast("int")), " ")


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as the mix takes them: one row for each pass, whole ones unchanged, the last one cut; untaken ones go.

    Documents without words weigh nothing and stay.
    """
    names = docs.columns
    given = mix(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("source").alias("_source"), "sig", "size", "taken")
    given = given.groupBy("id", "_source", "sig").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"), F.struct(*[docs[c] for c in names]).alias("row"))
    # Equal rows share what they took: the first ones as much as fits.
    same = (F.col("d.id") == F.col("g.id")) & (F.col("d.sig") == F.col("g.sig")) & F.col("d.row.source").eqNullSafe(F.col("g._source"))
    joined = rows.alias("d").join(given.alias("g"), same).select("d.row", "g.taken", "g.size", "g.copies")
    each = joined.withColumn("taken", F.floor(F.col("taken") / F.col("copies")))
    passes = F.when(F.col("size") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.array(F.least("taken", "size"), F.col("taken") - F.least("taken", "size")), lambda n: n > 0))
    out = each.select("row", "size", F.explode(passes).alias("words"))
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(_words(F.col("row.text"), F.col("words")))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
