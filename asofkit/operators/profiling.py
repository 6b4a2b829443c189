"""Value-free profiles of columns, tables, relationships, labels and schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.catalog import Catalog, Table, column, names_of
from asofkit.functions.scalars import count_if, finite, ratio, seconds, stamp, text, when
from asofkit.skew import lookup, numbered, percentiles, previous, top_rows

# Name patterns and hints that decide a column's role.
IDENTIFIER = r"(^id$|(^|_)\w*id$|uuid$|guid$|identifier$|key$)"
TEXT_HINTS = (
    "body", "comment", "description", "message", "note", "notes", "review", "summary", "text", "title",
)
# Feature families open to each role.
ROLE_FAMILIES = {
    "structural": ("base", "temporal", "state", "episode", "context"),
    "identifier": ("base", "temporal", "state", "episode"),
    "boolean": ("base", "conditional", "temporal", "state"),
    "numerical": ("base", "temporal", "state", "sequence", "context"),
    "timestamp": ("base", "temporal", "sequence"),
    "text": ("base",),
    "categorical": ("base", "conditional", "state"),
}


def physical_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, T.NumericType):
        return "float"
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return "datetime"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return "collection"
    return "string"


def name_role(name: str, kind: str, structural: bool) -> str | None:
    """Role known from declarations alone; strings may still depend on their length."""
    if structural:
        return "structural"
    if re.search(IDENTIFIER, name, re.IGNORECASE):
        return "identifier"
    if kind == "bool":
        return "boolean"
    if kind == "datetime":
        return "timestamp"
    if kind in ("integer", "float"):
        return "numerical"
    if set(re.split(r"[^a-z0-9]+", name.lower())) & set(TEXT_HINTS):
        return "text"
    return None


def _identity(value, kind: str):
    """Short values stand for themselves; long texts travel as a digest."""
    if kind == "collection":
        return F.lit(None).cast("string")
    plain = value.cast("string")
    return F.when(F.length(plain) > 31, F.md5(plain)).otherwise(plain) if kind == "string" else plain


def value_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Frequencies of all columns at once: (position, column, digest, n, number, length).

    Long texts travel as digests, and each value is combined where it is read
    before anything moves.
    """
    kinds = {f.name: physical_type(f.dataType) for f in frame.schema.fields}
    cells = []
    for i, c in enumerate(columns):
        v = column(c)
        numeric = kinds[c] in ("integer", "float")
        is_text = kinds[c] == "string"
        cells.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            _identity(v, kinds[c]).alias("digest"),
            v.isNull().alias("missing"), (finite(v) if numeric else F.lit(None).cast("double")).alias("number"),
            (F.length(v) if is_text else F.lit(None).cast("int")).alias("length"),
        ))
    rows = frame.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return rows.groupBy("position", "column", "digest", "missing").agg(
        F.count(F.lit(1)).alias("n"), F.first("number").alias("number"), F.first("length").alias("length"))


def _column_stats(counts: DataFrame, scope: list[str] = ()) -> DataFrame:
    """Coverage, cardinality and normalised entropy per column from frequencies."""
    seen = when(~F.col("missing"), "n")
    valued = when(F.col("digest").isNotNull(), "n")
    weight = F.col("n").cast("double")
    stats = counts.groupBy(*scope, "position", "column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(seen), F.lit(0)).alias("non_null"),
        F.count("digest").alias("cardinality"), F.coalesce(F.sum(valued), F.lit(0)).alias("_valued"),
        F.sum(when(F.col("digest").isNotNull(), weight * F.log(weight))).alias("_nlogn"),
        ratio(F.sum(F.col("length") * F.col("n")), F.sum(when(F.col("length").isNotNull(), "n"))).alias("mean_length"),
        F.sum(F.col("length") * F.col("length") * F.col("n")).cast("double").alias("_square"),
        F.sum(when(F.col("length").isNotNull(), "n")).cast("double").alias("_texts"),
    )
    total = F.col("_valued").cast("double")
    # -sum(p ln p) with p = n / N equals ln N - sum(n ln n) / N.
    entropy = (F.log(total) - F.col("_nlogn") / total) / F.log(F.col("cardinality").cast("double"))
    spread = F.sqrt(F.greatest(F.col("_square") / F.col("_texts") - F.col("mean_length") * F.col("mean_length"), F.lit(0.0)))
    return (
        stats.withColumn("non_null_fraction", ratio("non_null", "rows"))
        .withColumn("unique_fraction", F.coalesce(ratio("cardinality", F.greatest(F.col("non_null"), F.lit(1))), F.lit(0.0)))
        .withColumn("entropy", F.when(F.col("cardinality") > 1, entropy).otherwise(0.0))
        .withColumn("length_std", spread).drop("_valued", "_nlogn", "_square", "_texts")
    )


def column_audit(catalog: Catalog, names: list[str], budget: int | None = 4) -> DataFrame:
    """Utility audit of every column with ranks per table and feature family."""
    audit = _audit_rows([catalog[n] for n in names])
    order = [F.col("structural").desc(), F.col("utility").desc(), F.col("position"), F.col("column")]
    audit = numbered(audit, ["table"], order, "utility_rank")
    families = F.create_map(*[x for r, fs in ROLE_FAMILIES.items() for x in (F.lit(r), F.array(*[F.lit(f) for f in fs]))])
    audit = audit.withColumn("families", families[F.col("role")])
    # One pass per family column: rank of this column among those open to the family.
    opened = audit.filter(~F.col("structural")).select("table", "column", "utility_rank", F.explode("families").alias("family"))
    ranked = numbered(opened, ["table", "family"], [F.col("utility_rank")], "family_rank")
    best = ranked.groupBy("table", "column").agg(
        F.array_join(F.array_sort(F.collect_list(F.format_string("%s:%d", "family", "family_rank"))), ",").alias("family_ranks"),
        F.min("family_rank").alias("_best"),
    )
    out = audit.join(best, ["table", "column"], "left")
    inside = F.col("structural") | F.lit(budget is None) | (F.col("_best") <= F.lit(budget or 0))
    return out.select(
        "table", "column", "role", "structural", "non_null_fraction", "cardinality", "unique_fraction", "entropy", "spread",
        F.when(~F.col("structural"), F.col("utility")).alias("utility"), "utility_rank",
        F.coalesce(F.col("family_ranks"), F.lit("")).alias("family_ranks"), inside.alias("within_budget"),
    )


def _audit_rows(tables: list[Table]) -> DataFrame:
    """Statistics of all columns of all tables in one pass over their frequencies."""
    counts, known = None, []
    for table in tables:
        columns = table.frame.columns
        part = value_counts(table.frame, columns).withColumn("table", F.lit(table.name))
        counts = part if counts is None else counts.unionByName(part)
        kinds = {f.name: physical_type(f.dataType) for f in table.frame.schema.fields}
        for c in columns:
            role = name_role(c, kinds[c], c in table.structural)
            known += [F.lit(f"{table.name}.{c}"), F.lit(role).cast("string")]
    stats = _column_stats(counts, ["table"])
    by_length = F.when(F.col("mean_length") >= 40, "text").otherwise("categorical")
    declared = F.create_map(*known)[F.concat_ws(".", "table", "column")]
    stats = stats.withColumn("role", F.coalesce(declared, by_length))
    keys = ["table", "column"]
    marks = percentiles(counts.filter("number IS NOT NULL"), keys, "number", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, freq="n")
    stats = stats.join(marks, keys, "left")
    reach = F.abs(F.col("q90") - F.col("q10"))
    numeric = F.when(F.col("non_null") > 1, F.coalesce(reach / (F.abs("q50") + reach + 1e-12), F.lit(0.0))).otherwise(0.0)
    words = F.least(F.lit(1.0), F.col("length_std") / F.greatest(F.lit(1.0), F.col("mean_length")))
    spread = F.when(F.col("role") == "numerical", numeric).when(F.col("role") == "text", F.coalesce(words, F.lit(0.0))).otherwise(F.col("entropy"))
    redundancy = F.when((F.col("role") == "identifier") & (F.col("unique_fraction") >= 0.98), 0.1).otherwise(1.0)
    utility = (
        F.col("non_null_fraction") * redundancy * (0.35 + 0.65 * F.greatest(F.col("entropy"), F.col("spread")))
        * F.log1p(F.greatest(F.lit(1), F.col("cardinality")))
    )
    structural = F.col("role") == "structural"
    return stats.withColumn("spread", spread).withColumn("structural", structural).withColumn(
        "utility", F.when(structural, float("inf")).otherwise(utility)
    ).select("table", "position", "column", "role", "structural", "non_null_fraction", "cardinality", "unique_fraction", "entropy", "spread", "utility")


def available_families(catalog: Catalog, audit: DataFrame, names: list[str]) -> DataFrame:
    """Families that can produce a feature on this schema, with the reason."""
    children = {fk_child for fk_child in names if catalog[fk_child].foreign_keys}
    dated = [n for n in sorted(children) if catalog[n].time]
    context = any(catalog[n].context_keys for n in children)
    declared = [
        ("base", True, "always"), ("episode", bool(children), "reduced child"),
        ("context", context, "context key on a reduced child"),
        *[(f, bool(dated), "dated reduced child") for f in ("temporal", "sequence", "state")],
    ]
    usable = audit.filter(F.col("table").isin(dated) & F.col("within_budget") & ~F.col("structural") & (F.col("role") == "categorical"))
    row = usable.agg((F.count(F.lit(1)) > 0).alias("found"))
    fixed = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(ok).alias("available"), F.lit(why).alias("needs")) for f, ok, why in declared])
    measured = F.struct(F.lit("conditional").alias("family"), F.col("found").alias("available"), F.lit("category on a dated child").alias("needs"))
    return row.select(F.explode(F.concat(fixed, F.array(measured))).alias("r")).select("r.*")


def enrichment_columns(table: Table, limit: int, high_text: str = "skip") -> DataFrame:
    """Dimension attributes worth joining: compact ones first, long text never."""
    columns = [c for c in table.frame.columns if c not in table.structural]
    kinds = {f.name: physical_type(f.dataType) for f in table.frame.schema.fields}
    stats = _column_stats(value_counts(table.frame, columns))
    kind = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])[F.col("column")]
    stats = stats.withColumn("kind", kind).filter("cardinality > 1")
    share = ratio("cardinality", "non_null")
    compact = F.col("cardinality") <= 1000
    wide = (F.col("cardinality") > 1000) & (share > 0.25)
    priority = (
        F.when(F.col("kind") == "bool", 0)
        .when(F.col("kind").isin("integer", "float"), F.when(compact & (share <= 0.5), 0).otherwise(2))
        .when(F.col("kind") == "datetime", 1)
        .when(F.col("kind") == "string", F.when(F.col("mean_length") > 80, F.lit(None).cast("int")).when(
            wide, F.lit(None if high_text == "skip" else 2).cast("int")).otherwise(F.when(compact, 0).otherwise(1)))
    )
    kept = stats.withColumn("priority", priority).filter("priority IS NOT NULL").withColumn("_one", F.lit(1))
    return top_rows(kept, ["_one"], [F.col("priority"), F.col("position")], limit, "place").select("column", "priority", "place")


def column_profiles(table: Table, cutoff) -> DataFrame:
    """Column profile as of a cutoff: types, coverage, entropy and moments."""
    frame = table.frame if table.time is None else table.frame.filter(column(table.time) <= stamp(cutoff))
    columns = frame.columns
    counts = value_counts(frame, columns)
    stats = _column_stats(counts)
    x, n = F.col("number"), F.col("n").cast("double")
    moments = counts.filter("number IS NOT NULL").groupBy("column").agg(
        (F.sum(x * n) / F.sum(n)).alias("mean"), F.sum(n).alias("_n"), F.min(x).alias("minimum"), F.max(x).alias("maximum"))
    centred = lookup(counts.filter("number IS NOT NULL").select("column", "number", "n"), moments.select("column", "mean", "_n"), ["column"])
    spread = centred.groupBy("column").agg(
        F.sqrt(F.sum((x - F.col("mean")) * (x - F.col("mean")) * F.col("n")) / F.first("_n")).alias("standard_deviation"))
    kinds = {f.name: physical_type(f.dataType) for f in frame.schema.fields}
    parents = {c for fk, _ in table.foreign_keys for c in names_of(fk)}

    def role(c):
        if c in table.key:
            return "primary_key"
        return "date" if c == table.time else "foreign_key" if c in parents else None

    physical = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])[F.col("column")]
    roles = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(role(c)).cast("string"))])[F.col("column")]
    out = stats.join(moments.drop("_n"), "column", "left").join(spread, "column", "left")
    out = out.withColumn("physical_type", physical).withColumn("role", roles)
    semantic = (
        F.when(F.col("role").isNotNull(), F.col("role")).when(F.col("physical_type").isin("integer", "float"), "numeric")
        .when(F.col("physical_type") == "string", F.when(
            (F.col("cardinality") <= 100) | (ratio("cardinality", F.greatest(F.col("non_null"), F.lit(1))) <= 0.05), "categorical").otherwise("text"))
        .otherwise(F.col("physical_type"))
    )
    return out.select(
        "column", "physical_type", semantic.alias("semantic_type"), F.col("non_null").alias("non_null_count"),
        F.col("cardinality").alias("distinct_count"), (1 - F.col("non_null_fraction")).alias("missing_fraction"),
        ratio("cardinality", "non_null").alias("uniqueness_fraction"),
        F.when(F.col("cardinality") > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("entropy")))).alias("normalized_entropy"),
        "mean", "standard_deviation", "minimum", "maximum",
    )


def relationship_profile(parent: DataFrame, child: DataFrame, key: str, fk: str) -> DataFrame:
    """Coverage, orphans, fan-out and cardinality class of one foreign key.

    Both sides are reduced to one row per key before they meet.
    """
    fan = child.groupBy(column(fk).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    owners = parent.filter(column(key).isNotNull()).groupBy(column(key).alias("k")).agg(F.count(F.lit(1)).alias("m"))
    both = fan.join(owners, "k", "left")
    known = F.col("k").isNotNull()
    main = both.agg(
        ratio(F.sum(when(known, "n")), F.sum("n")).alias("foreign_key_coverage"),
        ratio(F.coalesce(F.sum(when(known & F.col("m").isNull(), "n")), F.lit(0)), F.sum(when(known, "n"))).alias("orphan_fraction"),
        F.avg(when(known, "n")).alias("avg_fanout"), F.max(when(known, "n")).alias("max_fanout"),
    )
    # Distinct fan-outs are few: their sum cannot exceed the child's rows.
    spread = fan.filter("k IS NOT NULL").groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    marks = percentiles(spread, [], "n", {"median_fanout": 0.5, "p90_fanout": 0.9}, freq="keys", limit=None)
    marks = marks.select(F.struct("median_fanout", "p90_fanout").alias("m")).scalar()
    parent_unique = owners.agg((F.max("m") <= 1).alias("u")).scalar()
    main = main.withColumns({"_marks": marks, "_unique": parent_unique})
    child_unique = F.col("max_fanout") <= 1
    kind = (
        F.when(F.col("_unique") & child_unique, "one_to_one").when(F.col("_unique"), "one_to_many")
        .when(child_unique, "many_to_one").otherwise("many_to_many")
    )
    return main.select(
        kind.alias("cardinality"), "foreign_key_coverage", "orphan_fraction", "avg_fanout", "max_fanout",
        F.col("_marks.median_fanout").alias("median_fanout"), F.col("_marks.p90_fanout").alias("p90_fanout"),
    )


def mean_fanout(child: DataFrame, fk: str) -> DataFrame:
    """Average rows per referenced key, the only relationship figure a schema row needs."""
    return child.filter(column(fk).isNotNull()).groupBy(column(fk).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.avg("n").alias("avg_fanout"))


def event_frequency_profile(child: DataFrame, fk: str, time: str, slice_days: float = 1.0) -> DataFrame:
    """Per-key counts and durations and the gaps between events."""
    rows = child.select(column(fk).alias("k"), column(time).alias("ts")).filter("k IS NOT NULL AND ts IS NOT NULL")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), seconds(F.min("ts"), F.max("ts")).alias("span"))
    # Repeated instants are gaps of zero; distinct instants carry the rest.
    instants = rows.groupBy("k", "ts").agg(F.count(F.lit(1)).alias("n"))
    linked = previous(instants, ["k"], "ts", {"before": "ts"}, slice_days)
    gaps = linked.select(F.explode(F.array(
        F.struct(seconds("before", "ts").alias("gap"), F.when(F.col("before").isNotNull(), 1).otherwise(0).alias("w")),
        F.struct(F.lit(0.0).alias("gap"), (F.col("n") - 1).cast("int").alias("w")),
    )).alias("g")).select("g.*").filter("w > 0")
    gaps = gaps.groupBy("gap").agg(F.sum("w").alias("w"))
    marks = percentiles(gaps, [], "gap", {"p10_gap": 0.1, "median_gap": 0.5, "p90_gap": 0.9}, freq="w")
    keyed = percentiles(per_key, [], "span", {"m": 0.5})
    sizes = per_key.groupBy("n").agg(F.count(F.lit(1)).alias("w"))
    counted = percentiles(sizes, [], "n", {"m": 0.5}, freq="w", limit=None)
    mean_gap = gaps.agg(ratio(F.sum(F.col("gap") * F.col("w")), F.sum("w")).alias("m"))
    out = per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.avg("span").alias("avg_duration"), F.avg("n").alias("avg_events"),
    ).withColumns({
        "median_duration": keyed.scalar(), "median_events": counted.scalar(), "avg_gap": mean_gap.scalar(),
        "_m": marks.select(F.struct("p10_gap", "median_gap", "p90_gap").alias("m")).scalar(),
    })
    return out.select("*", "_m.*").drop("_m")


def label_profile(labels: DataFrame, target: str = "y", time: str = "ts", task: str = "classification") -> DataFrame:
    """Support, class balance or target moments, and repeats per entity."""
    y = finite(target)
    per_entity = labels.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"), F.count(y).alias("known"),
        F.min(time).alias("first"), F.max(time).alias("last"), F.min(y).alias("low"), F.max(y).alias("high"),
    )
    classes = labels.filter(y.isNotNull()).select(y.alias("v")).distinct().agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("known").cast("double")
    mean = F.sum("s") / n
    out = per_entity.agg(
        F.sum("n").alias("support_rows"), F.min("first").alias("support_start"), F.max("last").alias("support_end"),
        F.avg("n").alias("rows_per_entity"), mean.alias("target_mean"),
        F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))).alias("target_std"),
        ((F.sum("s") - F.min("low") * n) / n / F.nullif(F.max("high") - F.min("low"), F.lit(0.0))).alias("positive_fraction"),
    )
    return out.withColumn("class_count", classes.scalar()) if task == "classification" else out


def table_profiles(catalog: Catalog, cutoff) -> DataFrame:
    """Rows, span and width of every table as of a cutoff."""
    out = None
    for name, t in sorted(catalog.tables.items()):
        frame = t.frame if t.time is None else t.frame.filter(column(t.time) <= stamp(cutoff))
        span = seconds(F.min(column(t.time)), F.max(column(t.time))) if t.time else F.lit(None).cast("double")
        part = frame.agg(F.count(F.lit(1)).alias("rows"), span.alias("span_seconds")).select(
            F.lit(name).alias("table"), "rows", "span_seconds", F.lit(len(t.frame.columns)).cast("long").alias("columns"),
            F.lit("event" if t.time else "entity").alias("role"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def schema_features(catalog: Catalog, tables: DataFrame, relations: DataFrame) -> DataFrame:
    """One flat row that summarises the whole schema."""
    edges = [(name, parent) for name, t in catalog.tables.items() for _, parent in t.foreign_keys]
    fan = relations.agg(F.struct(
        F.avg("avg_fanout").alias("fanout_mean"), F.max("avg_fanout").alias("fanout_max"), F.min("avg_fanout").alias("fanout_min")).alias("f"))
    return tables.agg(
        F.count(F.lit(1)).alias("table_count"), F.log1p(F.sum("rows")).alias("total_rows_log1p"),
        F.log1p(F.max("rows")).alias("max_rows_log1p"), F.sum("columns").alias("column_count"),
        count_if(F.col("role") == "event").alias("dated_table_count"), F.avg("span_seconds").alias("span_mean"),
        F.max("span_seconds").alias("span_max"),
    ).select(
        "*", F.lit(len(edges)).cast("long").alias("relationship_count"),
        F.lit(sum(a == b for a, b in edges)).cast("long").alias("self_relationship_count"),
        fan.scalar().alias("_f"),
    ).select("*", "_f.*").drop("_f")


def equality_predicates(tables: dict, cutoff, limit: int = 4, most_values: int = 16) -> DataFrame:
    """Frequent low-cardinality values per dated table, frozen as a manifest."""
    out = None
    for name, (frame, time, columns) in tables.items():
        rows = frame.filter(column(time) < stamp(cutoff))
        cells = F.array(*[F.struct(F.lit(c).alias("col"), text(column(c)).alias("value")) for c in columns])
        part = rows.select(F.explode(cells).alias("c")).select("c.*").filter("value IS NOT NULL").groupBy("col", "value").agg(
            F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    sizes = out.groupBy("source", "col").agg(F.count(F.lit(1)).alias("card")).filter(F.col("card") <= most_values)
    kept = lookup(out, sizes, ["source", "col"], "inner")
    ranked = top_rows(kept, ["source"], [F.col("n").desc(), F.col("col"), F.col("value")], limit, "rank")
    return ranked.select("source", "col", "value", "n", F.col("rank").cast("long").alias("rank"))


