"""Payload encoders: point-in-time parents, categories, hashed tokens, pooled neighbours."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.functions.scalars import as_column, days, finite, text
from asofkit.requests import Requests, visible
from asofkit.skew import lookup, numbered, top_rows

KEYS = ["entity", "cutoff"]
# Word characters as Unicode letters, digits and underscore.
WORD = r"[\p{L}\p{N}_]+"


def pooled_payload(requests: Requests, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and maximum of each neighbour column plus the neighbour count."""
    aggs = [F.count(F.lit(1)).alias("neighbors")]
    for c in columns:
        aggs += [F.avg(finite(c)).alias(f"{c}_mean"), F.max(finite(c)).alias(f"{c}_max")]
    return requests.align(rows.groupBy(*KEYS).agg(*aggs), zero=["neighbors"])


def enriched_neighbors(members: DataFrame, children: DataFrame, requests: Requests, aggs: list[Column]) -> DataFrame:
    """Attach each neighbour's own child aggregates before anything is pooled.

    ``children.entity`` is the neighbour key.  Children reduce to one row per
    (neighbour, cutoff), so siblings cannot multiply a neighbour.
    """
    asked = Requests(
        members.select(F.col("neighbor").alias("entity"), "cutoff").distinct(), requests.cutoffs, requests.phase
    )
    reduced = visible(children, asked).groupBy(F.col("entity").alias("neighbor"), "cutoff").agg(*aggs)
    return lookup(members, reduced, ["neighbor", "cutoff"])


# --- parents ----------------------------------------------------------------


def parent_payload(requests: Requests, parent: DataFrame, key: str, columns: list[str], time: str | None = None):
    """Parent attributes aligned to requests; a parent not yet visible reads as missing."""
    picked = [as_column(key).alias("entity"), *[as_column(c) for c in columns]]
    if time is None:
        return requests.frame.join(parent.select(*picked), "entity", "left")
    out = requests.frame.join(parent.select(*picked, as_column(time).alias("_seen")), "entity", "left")
    shown = F.col("_seen") < F.col("cutoff")
    return out.select(*KEYS, *[F.when(shown, as_column(c)).alias(c) for c in columns])


def column_coverage(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by observed share, name breaking ties."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_column(c).isNotNull().alias("seen")) for c in columns])
    stats = frame.select(F.explode(cells).alias("c")).select("c.*").groupBy("column").agg(
        F.avg(F.col("seen").cast("double")).alias("coverage")
    ).withColumn("_one", F.lit(1))
    return numbered(stats, ["_one"], [F.col("coverage").desc(), F.col("column")]).drop("_one")


def category_vocabulary(frame: DataFrame, name: str, most: int = 2048) -> list[str]:
    counts = frame.filter(as_column(name).isNotNull()).groupBy(text(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return [r["v"] for r in counts.orderBy(F.col("n").desc(), F.col("v")).limit(most).collect()]


def structured_parent(frame: DataFrame, plan: list[tuple[str, str]], vocabularies: dict[str, list[str]], most: int = 64):
    """Typed parent columns: numbers, ages, calendar parts and tagged categories.

    Vocabularies are frozen; a value outside one reads ``other:``.
    """
    out = []
    for name, kind in plan[:most]:
        c = as_column(name)
        if kind == "numeric":
            out.append(finite(name).alias(f"{name}_number"))
        elif kind == "age_days":
            out.append(days(c, "cutoff").alias(f"{name}_age_days"))
        elif kind == "month":
            out.append(F.month(c).alias(f"{name}_month"))
        elif kind == "dayofweek":
            out.append(F.weekday(c).alias(f"{name}_dayofweek"))
        else:
            v = text(name)
            known = F.concat(F.lit("value:"), v)
            out.append(
                F.when(v.isNull(), "missing:").when(v.isin(vocabularies[name]), known).otherwise("other:").alias(f"{name}_category")
            )
    return frame.select(*KEYS, *out)


# --- text -------------------------------------------------------------------


HEX = "0123456789abcdef"


def hashed_text(frame: DataFrame, key: str, name: str, buckets: int = 8) -> DataFrame:
    """Signed hash buckets of a text's words, scaled by the root of their number.

    The first eight hex digits of a word's MD5 form a number: its remainder
    modulo ``buckets`` (a power of two up to 16) is the bucket and bit 256 the
    sign, so two single digits are enough.  The text is read whole; words are
    combined where they are read and one row per text is shuffled.
    """
    if buckets not in (2, 4, 8, 16):
        raise ValueError("buckets must be a power of two up to 16")
    words = F.regexp_extract_all(F.lower(as_column(name)), F.lit(WORD), F.lit(0))
    rows = frame.select(key, F.explode_outer(F.transform(words, F.md5)).alias("_h"))

    def digit(place):
        return F.instr(F.lit(HEX), F.substring("_h", place, 1)) - 1

    # Grouping by the bucket evaluates it once per word.
    sign = F.when(digit(6) % 2 == 1, 1).otherwise(-1)
    cells = rows.groupBy(key, F.pmod(digit(8), F.lit(buckets)).alias("_b")).agg(F.sum(sign).alias("_s"), F.count("_h").alias("_n"))
    sums = cells.groupBy(key).agg(
        F.sum("_n").alias("_words"), *[F.sum(F.when(F.col("_b") == i, F.col("_s"))).alias(f"_b{i}") for i in range(buckets)])
    scale = F.sqrt(F.greatest(F.col("_words"), F.lit(1)))
    empty = F.col("_words") == 0
    return sums.select(
        key, *[F.when(empty, 0.0).otherwise(F.coalesce(F.col(f"_b{i}"), F.lit(0)) / scale).alias(f"{name}_hash{i}") for i in range(buckets)])


def text_columns(frame: DataFrame, columns: list[str], mean_length: float = 32, distinct: int = 20, most: int = 8):
    """Text columns long and varied enough to model, longest first."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(text(c), F.lit("")).alias("v")) for c in columns])
    rows = frame.select(F.explode(cells).alias("c")).select("c.*")
    # Texts are represented by their digest, so no text is shuffled.
    values = rows.groupBy("column", F.md5("v").alias("h")).agg(
        F.first(F.length("v")).alias("length"), F.count(F.lit(1)).alias("n")
    )
    n = F.when(F.col("length") > 0, F.col("n"))
    stats = values.groupBy("column").agg(
        (F.sum(F.col("length") * F.col("n")) / F.sum(n)).alias("mean_length"), F.count(F.lit(1)).alias("distinct"),
    )
    kept = stats.filter((F.col("mean_length") >= mean_length) & (F.col("distinct") >= distinct)).withColumn("_one", F.lit(1))
    return top_rows(kept, ["_one"], [F.col("mean_length").desc(), F.col("column")], most, "place").drop("_one")


@F.pandas_udf(T.StringType())
def unescape(values: pd.Series) -> pd.Series:
    """HTML character references to text; Spark has no such function."""
    return values.map(html.unescape, na_action="ignore")


def document(columns: list[str]) -> Column:
    """One text per row: tags out, references decoded, spaces squeezed, fields marked."""
    fields = []
    for i, c in enumerate(columns):
        clean = F.regexp_replace(F.coalesce(text(c), F.lit("")), "<[^>]*>", " ")
        # Texts without a reference travel to Python as nulls and keep their value.
        decoded = F.coalesce(unescape(F.when(F.contains(clean, F.lit("&")), clean)), clean)
        squeezed = F.trim(F.regexp_replace(decoded, r"(?U)\s+", " "))
        fields.append(F.when(squeezed != "", F.concat(F.lit(f"Field {i + 1}: "), squeezed)))
    return F.concat_ws("\n", *fields)


def canonical(value, data_type: T.DataType) -> Column:
    """Nested cells as JSON text with sorted keys, so they can be grouped and compared."""
    return F.to_json(_sorted_cells(as_column(value), data_type))


def _sorted_cells(c: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.MapType):
        entries = F.array_sort(F.map_entries(c))
        inner = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), _sorted_cells(e["value"], data_type.valueType).alias("value")))
        return F.map_from_entries(inner)
    if isinstance(data_type, T.ArrayType):
        if isinstance(data_type.elementType, (T.MapType, T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: _sorted_cells(x, data_type.elementType))
        return c
    if isinstance(data_type, T.StructType):
        fields = sorted(data_type.fields, key=lambda f: f.name)
        return F.struct(*[_sorted_cells(c[f.name], f.dataType).alias(f.name) for f in fields])
    return c


def canonical_frame(frame: DataFrame) -> DataFrame:
    """Every nested column as canonical text, scalars unchanged."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return frame.select(*[
        canonical(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, nested) else as_column(f.name)
        for f in frame.schema.fields
    ])


