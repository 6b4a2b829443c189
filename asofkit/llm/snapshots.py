"""Chat formatting: logged conversations that are prefixes of longer ones collapse before rendering.

A conversation logged after each turn leaves snapshots, each a prefix of the next. Every turn gets two 64-bit
hashes of its place, role and text; the rolling hash of a prefix is the exclusive or of its turns' hashes.
A conversation whose whole hash and length equal a proper prefix of another one goes by an anti-join; of equal whole
conversations the smallest conv_id stays. What is left is rendered. Built-in functions only.

Turns are in the order of turn, then role, then text; rows equal in all four columns are one turn logged twice. A
null text is empty, a null role is ``unknown``, a null turn comes first, a null conv_id is an id like any other. Long conversations are
worked on in slices of ``SLICE`` turn numbers and rendered in parts of ``PART`` turns, so no task needs a whole one.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 512
PART = 64


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, h1, h2): each turn with the hashes of the prefix that it ends."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("slice", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / SLICE))
    conv = ["conv_id", "slice"]
    inside = Window.partitionBy(*conv).orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    across = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*conv).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(across), F.lit(0)))
    placed = _by_slice(rows.withColumn("within", F.row_number().over(inside)), sizes, ["before"])
    placed = placed.withColumn("place", F.col("before") + F.col("within"))
    own = placed.withColumns({"g1": F.xxhash64("place", "role", "text"), "g2": F.xxhash64(F.lit("second"), "text", "role", "place")})
    running = Window.partitionBy(*conv).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"w1": F.bit_xor("g1").over(running), "w2": F.bit_xor("g2").over(running)})
    total = own.groupBy(*conv).agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"))
    carried = total.withColumns({"b1": F.coalesce(F.bit_xor("t1").over(across), F.lit(0)), "b2": F.coalesce(F.bit_xor("t2").over(across), F.lit(0))})
    out = _by_slice(own.drop("before"), carried, ["b1", "b2"])
    return out.select("conv_id", "place", "role", "text", F.col("w1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("w2").bitwiseXOR(F.col("b2")).alias("h2"))


def _by_slice(rows: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    right = table.select(F.col("conv_id").alias("_conv"), F.col("slice").alias("_slice"), *names)
    return rows.join(right, rows["conv_id"].eqNullSafe(right["_conv"]) & (rows["slice"] == right["_slice"])).drop("_conv", "_slice")


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one begins with; ``rolled`` is turns(...)."""
    lengths = rolled.groupBy("conv_id").agg(F.max("place").alias("n"))
    right = lengths.select(F.col("conv_id").alias("_conv"), "n")
    marked = rolled.select("conv_id", "place", "h1", "h2").join(right, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    ends = marked.filter("place = n")
    # Equal conversations are one; a null id counts as the smallest.
    whole = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("least"), F.max(F.col("conv_id").isNull()).alias("none"))
    whole = whole.withColumn("conv_id", F.when(~F.col("none"), F.col("least"))).drop("none", "least")
    begun = marked.filter("place < n").select("place", "h1", "h2").distinct()
    return whole.join(begun, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, part, text): parts in order make up a maximal conversation's whole text."""
    rolled = turns(conversations)
    kept = maximal(rolled).select(F.col("conv_id").alias("_conv"), "n_turns")
    rows = rolled.join(kept, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    rows = rows.withColumn("part", F.floor((F.col("place") - 1) / PART))
    parts = rows.groupBy("conv_id", "part").agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", rendered_turn(F.col("role"), F.col("text")).alias("t")))).alias("list"))
    return parts.select("conv_id", "n_turns", "part", F.array_join(F.transform("list", lambda x: x["t"]), "").alias("text"))


SQL = """
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
c AS (SELECT conv_id, list(md5(role || chr(10) || text) ORDER BY place) AS l, count(*) AS n FROM o GROUP BY conv_id),
p AS (SELECT DISTINCT array_to_string(l[1:k], ' ') AS key FROM (SELECT l, unnest(generate_series(1, n - 1)) AS k FROM c)),
w AS (SELECT min(conv_id) AS conv_id, array_to_string(l, ' ') AS key, any_value(n) AS n FROM c GROUP BY l),
m AS (SELECT conv_id, n FROM w WHERE key NOT IN (SELECT key FROM p))
SELECT o.conv_id, CAST(m.n AS BIGINT) AS n_turns, CAST((place - 1) // 64 AS BIGINT) AS part,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM o JOIN m ON o.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY 1, 2, 3
"""


def query(spark, folder: str) -> DataFrame:
    return render(spark.read.parquet(f"{folder}/conversations.parquet")).select("conv_id", F.col("n_turns").cast("long"), F.col("part").cast("long"), "text")
