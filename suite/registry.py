"""Query registry: a Spark callable and, where SQL can express it, a DuckDB string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.requests import Requests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_OPENED: dict[tuple, DataFrame] = {}

ORDER_CUTS = ("1998-01-01", "2000-01-01")
EVENT_CUTS = ("2024-01-10", "2024-01-20")


class Inputs:
    """Lazy access to the driver tables of one scale."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # Opening a path lists files and reads a footer; the lazy handle is reused.
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _OPENED:
            _OPENED[key] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return _OPENED[key]

    # Point-in-time sources in the engine's column convention.
    def order_events(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"), "o_orderkey",
            "o_totalprice", "o_orderstatus", "o_orderpriority",
        )

    def user_events(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("entity"), "ts", "event_id", "event_type", "value"
        )

    def order_requests(self, phase=None) -> Requests:
        return Requests.every(self.customer, "c_custkey", ORDER_CUTS, phase)

    def own_order_requests(self) -> Requests:
        """Each customer at the moment of its last order: more cutoffs than can be listed."""
        last = self.orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.max("o_orderdate").alias("cutoff"))
        return Requests(last, None)

    def event_requests(self, phase=None) -> Requests:
        return Requests.every(self.customer, "c_custkey", EVENT_CUTS, phase)


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark, folder):
            return fn(Inputs(spark, folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# Floating results are compared after the same decimal rounding on both sides.
def rounded(frame: DataFrame, *names: str, places: int = 4) -> DataFrame:
    """Round the named (default: all double) columns."""
    chosen = names or [f.name for f in frame.schema.fields if f.dataType.typeName() in ("double", "float")]
    out = []
    for c in frame.columns:
        if c in chosen:
            x = F.round(F.col(c).cast("decimal(28,8)"), places).cast("double")
            out.append(x.alias(c))
        else:
            out.append(F.col(c))
    return frame.select(*out)


def R(expr: str, places: int = 4) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,8)),{places}) AS DOUBLE)"


def N(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def requests_sql(cuts) -> str:
    values = ",".join(f"(TIMESTAMP '{c}')" for c in cuts)
    return f"SELECT c_custkey AS entity, v.cutoff FROM customer, (VALUES {values}) v(cutoff)"


ORDER_REQ = f"requests AS ({requests_sql(ORDER_CUTS)})"
EVENT_REQ = f"requests AS ({requests_sql(EVENT_CUTS)})"
OWN_REQ = "requests AS (SELECT o_custkey AS entity, max(o_orderdate) AS cutoff FROM orders GROUP BY 1)"
# Visible rows joined to requests on the entity with a strict clock.
ORDER_VIS = f"""{ORDER_REQ}, visible AS (
  SELECT r.entity, r.cutoff, o.o_orderdate AS ts, o.* FROM requests r JOIN orders o
  ON o.o_custkey=r.entity AND o.o_orderdate<r.cutoff)"""
EVENT_VIS = f"""{EVENT_REQ}, visible AS (
  SELECT r.entity, r.cutoff, e.* FROM requests r JOIN events e
  ON e.user_id=r.entity AND e.ts<r.cutoff)"""


def secs(a: str, b: str) -> str:
    """Exact seconds between two timestamps in the oracle."""
    return f"(date_diff('microsecond',{a},{b})/1e6)"


def since_sql(days: float, time: str = "ts") -> str:
    return f"{time}>=cutoff-to_microseconds({round(days * 86_400_000_000)})"


def aligned_sql(prefix: str, columns: list[str], tail: str = "") -> str:
    """``WITH`` prefix plus aggregates per request joined back to all requests.

    ``columns`` holds (expression, name, kind) triples; kind ``n`` is a
    zero-filled count, ``z`` a zero-filled rounded double, ``d`` a rounded
    double, ``i`` a nullable integer and ``t`` any other value.
    """
    inner = ", ".join(f"{e} AS {n}" for e, n, _ in columns)
    outer = ", ".join(_outer(n, k) for _, n, k in columns)
    return (
        f"WITH {prefix}, block AS (SELECT entity, cutoff, {inner} FROM visible {tail} GROUP BY entity, cutoff) "
        f"SELECT r.entity, r.cutoff, {outer} FROM requests r LEFT JOIN block b USING (entity, cutoff)"
    )


def _outer(n: str, k: str) -> str:
    if k == "n":
        return f"CAST(coalesce(b.{n},0) AS BIGINT) AS {n}"
    if k == "z":
        return f"{R(f'coalesce(b.{n},0)')} AS {n}"
    if k == "d":
        return f"{R(f'b.{n}')} AS {n}"
    if k == "i":
        return f"CAST(b.{n} AS BIGINT) AS {n}"
    return f"b.{n} AS {n}"
