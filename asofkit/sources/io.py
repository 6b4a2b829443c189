"""Sources, sinks, integrity reports and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.catalog import Catalog, Table, column, complete, key_value, names_of
from asofkit.functions.scalars import stamp, text
from asofkit.skew import lookup

READERS = {".parquet": "parquet", ".csv": "csv"}


def open_source(spark: SparkSession, source, schema: T.StructType | str | None = None) -> DataFrame:
    """A DataFrame as it is, a Parquet or CSV path, or a catalog table or view."""
    if isinstance(source, DataFrame):
        return source
    name = str(source)
    suffix = next((s for s in READERS if name.lower().rstrip("/").endswith(s)), None)
    if suffix is not None:
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        elif suffix == ".csv":
            reader = reader.option("inferSchema", True)
        return reader.parquet(name) if suffix == ".parquet" else reader.option("header", True).csv(name)
    if "/" in name or ("." in name and not spark.catalog.tableExists(name)):
        raise ValueError(f"unsupported source {name!r}: use Parquet, CSV or a catalog table")
    return spark.table(name)


def write_sidecar(spark: SparkSession, catalog: Catalog, folder: str) -> None:
    """Declared roles as one small JSON Lines file next to the data."""
    spark.createDataFrame(catalog.describe()).coalesce(1).write.mode("errorifexists").json(folder)


def read_sidecar(spark: SparkSession, folder: str) -> dict[str, dict]:
    rows = spark.read.json(folder).collect()
    return {r["table"]: r.asDict() for r in rows}


# --- integrity --------------------------------------------------------------


def key_violations(table: Table) -> DataFrame:
    """Declared keys that are incomplete or occur more than once."""
    keys = [column(k) for k in table.key]
    missing = F.lit(False)
    for k in keys:
        missing = missing | k.isNull()
    counts = table.frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    bad = counts.filter(missing | (F.col("rows") > 1))
    rendered = F.concat_ws("|", *[F.coalesce(text(k), F.lit("null")) for k in keys])
    return bad.select(F.lit(table.name).alias("table"), rendered.alias("key"), "rows")


def orphan_report(catalog: Catalog, names: list[str]) -> DataFrame:
    """Foreign-key values without a parent row, per declared edge.

    The child is reduced to one row per key value before the anti join. Values of keys of several columns
    are rendered with bars; a key with a null part refers to nothing and is no orphan.
    """
    out = None
    for name in names:
        for fk, parent in sorted((names_of(fk), p) for fk, p in catalog[name].foreign_keys):
            values = catalog[name].frame.filter(complete(fk)).groupBy(key_value(fk).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
            lost = values.join(catalog[parent].frame.select(key_value(catalog[parent].key).alias("k")), "k", "left_anti")
            key = F.col("k").cast("string") if len(fk) == 1 else F.concat_ws("|", *[F.col(f"k.k{i}").cast("string") for i in range(len(fk))])
            part = lost.select(F.lit(f"{name}.{'+'.join(fk)}").alias("edge"), key.alias("key"), "rows")
            out = part if out is None else out.unionByName(part)
    return out


def snapshot(table: Table, boundary) -> Table:
    """The rows of a table that a phase boundary lets through on both clocks."""
    frame, limit = table.frame, stamp(boundary)
    if table.time:
        t = column(table.time)
        frame = frame.filter(t <= limit if table.boundary == "inclusive" else t < limit)
    if table.available_at:
        frame = frame.filter(column(table.available_at) <= limit)
    return table.with_frame(frame)


def phase_snapshot(catalog: Catalog, boundary) -> Catalog:
    return Catalog({name: snapshot(t, boundary) for name, t in catalog.tables.items()})


def prune_orphans(catalog: Catalog, rounds: int | None = None) -> Catalog:
    """Drop rows whose complete foreign key lost its parent, parents first.

    Over an acyclic schema one pass in topological order is the fixpoint; a
    cycle needs at most ``rounds`` repetitions.  Surviving rows keep their keys. Every table is read once: a row is
    marked by an outer join with the parent's distinct keys, and an incomplete key needs no mark.
    """
    order, cyclic = _parents_first(catalog)
    tables = dict(catalog.tables)
    for _ in range(rounds or len(order) if cyclic else 1):
        for name in order:
            frame, columns = tables[name].frame, [column(c) for c in tables[name].frame.columns]
            for n, (fk, parent) in enumerate(tables[name].foreign_keys):
                mark, value = f"_found_{n}", f"_key_{n}"
                keys = tables[parent].frame.select(key_value(tables[parent].key).alias(value)).distinct().withColumn(mark, F.lit(True))
                # A null value meets nothing, so its rows pass through the join without a shuffle of their own.
                valued = frame.withColumn(value, F.when(complete(fk), key_value(fk)))
                frame = valued.join(keys, value, "left").filter(F.col(value).isNull() | F.col(mark)).select(*columns)
            tables[name] = tables[name].with_frame(frame)
    return Catalog(tables)


def _parents_first(catalog: Catalog) -> tuple[list[str], bool]:
    left = {n: {p for _, p in t.foreign_keys if p != n} for n, t in catalog.tables.items()}
    cyclic = any(p == n for n, t in catalog.tables.items() for _, p in t.foreign_keys)
    order: list[str] = []
    while left:
        free = sorted(n for n, parents in left.items() if parents <= set(order))
        if not free:
            return [*order, *sorted(left)], True
        order += free
        left = {n: p for n, p in left.items() if n not in free}
    return order, cyclic


def routing_key(*names) -> Column:
    """Stable non-negative surrogate for string and composite keys.

    It depends on the key values only, so neither row order nor later rows can
    change it.  Sixty bits of SHA-256 fit a signed long.
    """
    parts = F.to_json(F.array(*[text(n) for n in names]))
    return F.conv(F.substring(F.sha2(parts, 256), 1, 15), 16, 10).cast("long")


def native_or_routed(name: str, data_type: T.DataType) -> Column:
    """Non-negative integer keys pass through; every other key is routed."""
    if not isinstance(data_type, T.IntegralType):
        return routing_key(name)
    c = column(name).cast("long")
    return F.when(c >= 0, c).otherwise(routing_key(name))


def routing_collisions(frame: DataFrame, names: list[str]) -> DataFrame:
    keys = frame.select(*[column(n) for n in names]).distinct().withColumn("_r", routing_key(*names))
    return keys.groupBy("_r").agg(F.count(F.lit(1)).alias("keys")).filter("keys > 1")


# --- fingerprints -------------------------------------------------------------------


def row_digest(frame: DataFrame) -> Column:
    """Number from the row's canonical text; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), text(column(c))), F.lit("~")) for c in sorted(frame.columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def fingerprint(frame: DataFrame) -> DataFrame:
    """Order-insensitive digest: row count, sum and xor of row digests."""
    d = row_digest(frame)
    return frame.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(d.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
        F.coalesce(F.bit_xor(d), F.lit(0)).alias("digest_xor"))


def difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that only one of two frames holds."""
    names = sorted(expected.columns)
    a, b = actual.select(*[column(c) for c in names]), expected.select(*[column(c) for c in names])
    return a.exceptAll(b).withColumn("side", F.lit("actual")).unionByName(b.exceptAll(a).withColumn("side", F.lit("expected")))


# --- bundles, caches and stores --------------------------------------------------------


def export_bundle(spark: SparkSession, folder: str, frames: dict[str, DataFrame], target: str, masked: tuple = ("requests",)) -> DataFrame:
    """Write named frames and a manifest of their digests; never overwrite.

    Frames named in ``masked`` lose the target column before they are written.
    """
    manifest = None
    for name, frame in sorted(frames.items()):
        out = frame.drop(target) if name in masked else frame
        out.write.mode("errorifexists").parquet(f"{folder}/{name}")
        part = fingerprint(spark.read.parquet(f"{folder}/{name}")).select(F.lit(name).alias("name"), "*")
        manifest = part if manifest is None else manifest.unionByName(part)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return spark.read.json(f"{folder}/manifest")


def reopen_bundle(spark: SparkSession, folder: str, target: str, boundary=None, clocks: dict[str, str] | None = None,
                  masked: tuple = ("requests",)) -> dict[str, DataFrame]:
    """Frames of a bundle after digest, target and boundary checks."""
    frames = {}
    for row in spark.read.json(f"{folder}/manifest").collect():
        frame = spark.read.parquet(f"{folder}/{row['name']}")
        found = fingerprint(frame).first()
        if (found["rows"], found["digest_sum"], found["digest_xor"]) != (row["rows"], row["digest_sum"], row["digest_xor"]):
            raise ValueError(f"bundle part {row['name']} changed since it was written")
        if row["name"] in masked and target in frame.columns:
            raise ValueError("held-out targets reached the forecast requests")
        clock = (clocks or {}).get(row["name"])
        frames[row["name"]] = frame if clock is None or boundary is None else frame.filter(column(clock) < stamp(boundary))
    return frames


def append_cohorts(frame: DataFrame, folder: str, cutoff: str = "cutoff") -> None:
    """Write feature frames partitioned by cutoff; a repeated cohort replaces itself."""
    day = F.date_format(F.col(cutoff), "yyyy-MM-dd'T'HH-mm-ss")
    (
        frame.withColumn("cohort", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("cohort").parquet(folder)
    )


def read_cohorts(spark: SparkSession, folder: str, cutoffs: list | None = None) -> DataFrame:
    """Cohorts under one schema, pruned to the wanted partitions."""
    frame = spark.read.option("mergeSchema", True).parquet(folder)
    if cutoffs is not None:
        days_wanted = [str(c).replace(" ", "T").replace(":", "-") for c in cutoffs]
        frame = frame.filter(F.col("cohort").isin([d if "T" in d else f"{d}T00-00-00" for d in days_wanted]))
    return frame.drop("cohort")


def contract_hash(contract: dict) -> str:
    return hashlib.sha256(json.dumps(contract, sort_keys=True, default=str).encode()).hexdigest()


def save_trials(trials: DataFrame, folder: str, contract: str) -> None:
    """Append completed trials under a contract; other states are not kept."""
    done = trials.filter(F.col("status") == "completed").withColumn("contract", F.lit(contract))
    done.write.mode("append").partitionBy("contract").parquet(folder)


def pending_trials(wanted: DataFrame, completed: DataFrame, keys=("config", "stage", "sample_rows")) -> DataFrame:
    """Trials still to run: all that are wanted less those already completed."""
    pairs = [wanted[k].eqNullSafe(completed[k]) for k in keys]
    condition = pairs[0]
    for p in pairs[1:]:
        condition = condition & p
    return wanted.join(completed, condition, "left_anti")


def write_records(frame: DataFrame, folder: str, identity: str) -> None:
    """JSON Lines sink that refuses duplicate identities."""
    if not duplicate_records(frame, identity).isEmpty():
        raise ValueError(f"records repeat {identity}")
    frame.write.mode("errorifexists").json(folder)


def read_records(spark: SparkSession, folder: str, schema, identity: str) -> DataFrame:
    frame = spark.read.schema(schema).json(folder)
    if not duplicate_records(frame, identity).isEmpty():
        raise ValueError(f"records repeat {identity}")
    return frame


def duplicate_records(frame: DataFrame, identity: str) -> DataFrame:
    return frame.groupBy(identity).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


# --- supervised phases -------------------------------------------------------------------


def phase_violations(
    training: DataFrame, validation: DataFrame, requests: DataFrame, roots: DataFrame, inner, outer, horizon_days: float,
    target: str = "y",
) -> DataFrame:
    """Count of rows that break each boundary rule of a supervised task.

    Labels carry (entity, cutoff, available_at, target); requests carry
    (entity, cutoff) and must not hold the target.
    """
    if target in requests.columns:
        raise ValueError("forecast requests must not hold targets")
    lo, hi = stamp(inner), stamp(outer)
    ready = F.col("cutoff") + F.expr(f"INTERVAL {int(horizon_days * 86_400)} SECONDS")
    y = F.col(target)
    labelled = [("training", training), ("validation", validation)]
    checks = []
    for name, frame in labelled:
        checks.append((f"{name}: incomplete", frame.filter(F.col("entity").isNull() | F.col("cutoff").isNull() | y.isNull())))
        checks.append((f"{name}: available before horizon", frame.filter(F.col("available_at") < ready)))
        checks.append((f"{name}: repeated entity and time", frame.groupBy("entity", "cutoff").count().filter("count > 1")))
        checks.append((f"{name}: unknown entity", frame.join(roots.select("entity"), "entity", "left_anti")))
    checks += [
        ("training: immature at inner boundary", training.filter(F.col("available_at") > lo)),
        ("validation: before inner boundary", validation.filter(F.col("cutoff") < lo)),
        ("validation: immature at outer boundary", validation.filter(F.col("available_at") > hi)),
        ("requests: before outer boundary", requests.filter(F.col("cutoff") < hi)),
        ("requests: unknown entity", requests.join(roots.select("entity"), "entity", "left_anti")),
    ]
    out = None
    for rule, rows in checks:
        part = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def supervised_rows(labels: DataFrame, horizon_days: float, available: str | None = None) -> DataFrame:
    """Label availability is the cutoff plus the horizon unless it is declared."""
    if available is not None:
        return labels.withColumn("available_at", F.col(available))
    return labels.withColumn("available_at", F.col("cutoff") + F.expr(f"INTERVAL {int(horizon_days * 86_400)} SECONDS"))


def split_view(labels: DataFrame, roots: DataFrame, boundary) -> DataFrame:
    """Mature labels of roots that are visible at the boundary."""
    mature = labels.filter(F.col("available_at") <= stamp(boundary))
    visible_roots = roots.filter(F.col("born") < stamp(boundary)).select("entity", F.lit(1).alias("_seen"))
    return lookup(mature, visible_roots, ["entity"], "inner").drop("_seen")
