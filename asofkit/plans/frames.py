"""Learner frames: which columns a learner sees, and their frozen preparation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.catalog import column
from asofkit.functions.scalars import finite
from asofkit.operators.encoders import canonical_frame
from asofkit.operators.profiling import physical_type

MISSING = "__missing__"


def model_columns(columns, structural=(), roles=()) -> list[str]:
    """Payload only: no keys, clocks, splits, targets or path-qualified aliases of them."""
    hidden = {*structural, *roles}
    suffixes = tuple(f"__{c}" for c in structural)
    return [c for c in columns if c not in hidden and not (suffixes and c.endswith(suffixes))]


@dataclass(frozen=True)
class FrameSchema:
    """Columns and roles learned on training rows and then fixed."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    datetime: tuple[str, ...]
    keys: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categorical, *self.datetime)


def fit_schema(frame: DataFrame, keys: list[str], excluded: list[str] = ()) -> FrameSchema:
    """Drop empty and constant training columns and record the rest by role.

    One pass: a column is constant when its smallest and largest value agree and
    it has no gaps, which needs no distinct count.
    """
    frame = canonical_frame(frame)
    names = [c for c in frame.columns if c not in {*keys, *excluded}]
    kinds = {f.name: physical_type(f.dataType) for f in frame.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(names):
        v = column(c)
        if kinds[c] == "bool":
            v = v.cast("int")
        aggs += [F.count(v).alias(f"n{i}"), (F.min(v) < F.max(v)).alias(f"d{i}")]
    row = frame.agg(*aggs).first()
    kept = [c for i, c in enumerate(names) if row[f"n{i}"] and (row[f"d{i}"] or row[f"n{i}"] < row["_rows"])]
    return FrameSchema(
        tuple(c for c in kept if kinds[c] in ("integer", "float")),
        tuple(c for c in kept if kinds[c] in ("string", "bool", "collection")),
        tuple(c for c in kept if kinds[c] == "datetime"), tuple(keys))


def prepare(frame: DataFrame, schema: FrameSchema) -> DataFrame:
    """Replay the schema: absent columns are missing, gaps in categories get a token."""
    frame = canonical_frame(frame)
    present = set(frame.columns)
    out = [column(k) for k in schema.keys]
    for c in schema.numeric:
        out.append((finite(column(c)) if c in present else F.lit(None).cast("double")).alias(c))
    for c in schema.categorical:
        value = column(c).cast("string") if c in present else F.lit(None).cast("string")
        out.append(F.coalesce(value, F.lit(MISSING)).alias(c))
    for c in schema.datetime:
        value = F.unix_micros(column(c).cast("timestamp")) / F.lit(1e6) if c in present else F.lit(None).cast("double")
        out.append(value.alias(c))
    return frame.select(*out)
