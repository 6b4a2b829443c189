"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def stamp(value) -> Column:
    """A naive-UTC timestamp literal."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def microseconds(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", as_column(start), as_column(end))


def seconds(start, end) -> Column:
    """Exact elapsed seconds as a double."""
    return microseconds(start, end) / F.lit(1e6)


def days(start, end) -> Column:
    return microseconds(start, end) / F.lit(86_400e6)


def minus_seconds(moment, width: float) -> Column:
    """``moment`` moved back by ``width`` seconds, microsecond exact."""
    micros = round(abs(width) * 1_000_000)
    whole, rest = divmod(micros, 1_000_000)
    sign = "-" if width < 0 else ""
    interval = F.expr(f"INTERVAL '{sign}{whole}.{rest:06d}' SECOND")
    return as_column(moment) - interval


def finite(value) -> Column:
    """The value as a double, null when it is not a finite number."""
    x = as_column(value).cast("double")
    return F.when((x > float("-inf")) & (x < float("inf")), x)


def ratio(top, bottom) -> Column:
    """Division with a null, not an error, on a zero denominator."""
    bottom = as_column(bottom).cast("double")
    return as_column(top).cast("double") / F.nullif(bottom, F.lit(0.0))


def count_if(condition) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def when(condition, value) -> Column:
    return F.when(condition, as_column(value))


def flag(condition) -> Column:
    return condition.cast("double")


def text(value) -> Column:
    return as_column(value).cast("string")


def content_rank(*values) -> Column:
    """A deterministic order that depends on content only, never on input order."""
    parts = [F.coalesce(text(v), F.lit("")) for v in values]
    return F.md5(F.concat_ws("|", *parts))


def hash_number(*values) -> Column:
    """Non-negative integer below 2^32 from the content hash."""
    return F.conv(F.substring(content_rank(*values), 1, 8), 16, 10).cast("long")


def hash_unit(*values) -> Column:
    """Uniform number in [0, 1) from the content hash."""
    return hash_number(*values) / F.lit(4294967296.0)


def row_salt(count: int, *values) -> Column:
    """Deterministic salt for spreading a hot key over ``count`` tasks."""
    return F.pmod(F.xxhash64(*[as_column(v) for v in values]), F.lit(count)).cast("int")


def logit(p) -> Column:
    p = as_column(p)
    return F.log(p / (1 - p))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-as_column(x)))


def float_noise_floor(mean) -> Column:
    """Below this a second moment minus a squared mean is rounding noise."""
    return F.lit((32 * 2.220446049250313e-16) ** 0.5) * F.abs(as_column(mean))
