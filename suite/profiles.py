"""Profiles of columns, tables, relationships and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import profiling as pf
from suite.families import HISTORY, label_history
from suite.model import catalog
from suite.registry import N, R, query, rounded

CUT = "2000-01-01"


def _long(frame):
    return frame.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() == "integer" else F.col(f.name) for f in frame.schema.fields])


# (table, column, kind, structural) in file order for the audited tables.
_AUDIT = {
    "customer": [("c_custkey", "s", 1), ("c_name", "t", 0), ("c_nationkey", "s", 1), ("c_acctbal", "n", 0), ("c_mktsegment", "t", 0)],
    "orders": [("o_orderkey", "s", 1), ("o_custkey", "s", 1), ("o_orderstatus", "t", 0), ("o_totalprice", "n", 0), ("o_orderdate", "s", 1), ("o_orderpriority", "t", 0)],
    "part": [("p_partkey", "s", 1), ("p_name", "t", 0), ("p_brand", "t", 0), ("p_type", "t", 0), ("p_size", "n", 0), ("p_retailprice", "n", 0)],
}


def _audit_sql():
    rows = []
    for table, cols in _AUDIT.items():
        for i, (c, kind, structural) in enumerate(cols):
            role = "'structural'" if structural else "'numerical'" if kind == "n" else f"(SELECT CASE WHEN avg(length({c}))>=40 THEN 'text' ELSE 'categorical' END FROM {table})"
            spread = f"(SELECT coalesce(abs(quantile_cont({c},0.9)-quantile_cont({c},0.1))/(abs(quantile_cont({c},0.5))+abs(quantile_cont({c},0.9)-quantile_cont({c},0.1))+1e-12),0) FROM {table})" if kind == "n" else "NULL"
            rows.append(f"""SELECT '{table}' AS "table", '{c}' AS "column", {i} AS position, {bool(structural)} AS structural, {role} AS role, {spread} AS sp, count({c})::DOUBLE/count(*) AS nnf, count(DISTINCT {c}) AS card,
              count(DISTINCT {c})::DOUBLE/greatest(count({c}),1) AS uf, (SELECT CASE WHEN count(*)>1 THEN -sum((n::DOUBLE/t)*ln(n::DOUBLE/t))/ln(count(*)) ELSE 0 END FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})) AS ent FROM {table}""")
    fam = " UNION ALL ".join(f"SELECT '{r}' AS role, '{f}' AS family" for r, fs in pf.ROLE_FAMILIES.items() for f in fs)
    return f"""WITH a AS ({' UNION ALL '.join(rows)}), b AS (SELECT *, coalesce(sp, ent) AS spread FROM a), c AS (SELECT *, CASE WHEN structural THEN 1e300 ELSE nnf*(0.35+0.65*greatest(ent, spread))*ln(1+greatest(1,card)) END AS utility FROM b),
      d AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY structural DESC, utility DESC, position) AS utility_rank FROM c), f AS ({fam}),
      g AS (SELECT d."table", d."column", family, row_number() OVER (PARTITION BY d."table", family ORDER BY utility_rank) AS fr FROM d JOIN f USING (role) WHERE NOT structural),
      h AS (SELECT "table", "column", string_agg(family||':'||fr, ',' ORDER BY family||':'||fr) AS family_ranks, min(fr) AS best FROM g GROUP BY 1,2)
      SELECT d."table", d."column", role, structural, {R('nnf')} AS non_null_fraction, {N('card')} AS cardinality, {R('uf')} AS unique_fraction, {R('ent')} AS entropy, {R('spread')} AS spread, {R('CASE WHEN NOT structural THEN utility END')} AS utility,
       {N('utility_rank')} AS utility_rank, coalesce(family_ranks,'') AS family_ranks, (structural OR best<=4) AS within_budget FROM d LEFT JOIN h ON h."table"=d."table" AND h."column"=d."column" """


@query("A61_column_audit", _audit_sql())
def _(t):
    return rounded(_long(pf.column_audit(catalog(t), list(_AUDIT))))


@query("A62_available_families", """SELECT * FROM (VALUES ('base', true, 'always'), ('episode', true, 'reduced child'), ('context', false, 'context key on a reduced child'), ('temporal', true, 'dated reduced child'),
  ('sequence', true, 'dated reduced child'), ('state', true, 'dated reduced child')) v(family, available, needs) UNION ALL SELECT 'conditional', count(*)>0, 'category on a dated child' FROM (SELECT 1 FROM orders HAVING avg(length(o_orderstatus))<40)""")
def _(t):
    cat = catalog(t)
    return pf.available_families(cat, pf.column_audit(cat, list(_AUDIT)), list(_AUDIT))


@query("A63_enrichment_columns", f"""WITH s AS (SELECT 'p_name' AS "column", 0 AS pos, count(DISTINCT p_name) AS c, count(p_name) AS n, 't' AS k FROM part UNION ALL SELECT 'p_brand', 1, count(DISTINCT p_brand), count(*), 't' FROM part UNION ALL SELECT 'p_type', 2, count(DISTINCT p_type), count(*), 't' FROM part
   UNION ALL SELECT 'p_size', 3, count(DISTINCT p_size), count(*), 'n' FROM part UNION ALL SELECT 'p_retailprice', 4, count(DISTINCT p_retailprice), count(*), 'n' FROM part),
  p AS (SELECT *, CASE WHEN k='n' THEN CASE WHEN c<=1000 AND c::DOUBLE/n<=0.5 THEN 0 ELSE 2 END WHEN c>1000 AND c::DOUBLE/n>0.25 THEN NULL WHEN c<=1000 THEN 0 ELSE 1 END AS pr FROM s WHERE c>1)
  SELECT "column", {N('pr')} AS priority, CAST(row_number() OVER (ORDER BY pr, pos) AS BIGINT) AS place FROM p WHERE pr IS NOT NULL QUALIFY place<=4""")
def _(t):
    return _long(pf.enrichment_columns(catalog(t)["part"], 4))


def _profile_sql():
    cols = [("o_orderkey", "integer", "'primary_key'", 1), ("o_custkey", "integer", "'foreign_key'", 1), ("o_orderstatus", "string", None, 0), ("o_totalprice", "float", "'numeric'", 1), ("o_orderdate", "datetime", "'date'", 0), ("o_orderpriority", "string", None, 0)]
    rows = []
    for c, kind, sem, num in cols:
        semantic = sem or f"CASE WHEN count(DISTINCT {c})<=100 THEN 'categorical' ELSE 'text' END"
        m = [f"avg({c})", f"stddev_pop({c})", f"min({c})", f"max({c})"] if num else ["NULL::DOUBLE"] * 4
        rows.append(f"""SELECT '{c}' AS "column", '{kind}' AS physical_type, {semantic} AS semantic_type, {N(f'count({c})')} AS non_null_count, {N(f'count(DISTINCT {c})')} AS distinct_count, {R(f'1-count({c})::DOUBLE/count(*)')} AS missing_fraction,
          {R(f'count(DISTINCT {c})::DOUBLE/count({c})')} AS uniqueness_fraction, {R(f"(SELECT CASE WHEN count(*)>1 THEN least(1,-sum((n::DOUBLE/t)*ln(n::DOUBLE/t))/ln(count(*))) END FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM o GROUP BY {c}))")} AS normalized_entropy,
          {R(m[0])} AS mean, {R(m[1])} AS standard_deviation, {R(m[2])} AS minimum, {R(m[3])} AS maximum FROM o""")
    return f"WITH o AS (SELECT * FROM orders WHERE o_orderdate<=TIMESTAMP '{CUT}') " + " UNION ALL ".join(rows)


@query("A64_column_profile", _profile_sql())
def _(t):
    return rounded(pf.column_profiles(catalog(t)["orders"], CUT))


_EDGES = (("customer", "orders", "c_custkey", "o_custkey"), ("orders", "lineitem", "o_orderkey", "l_orderkey"), ("part", "lineitem", "p_partkey", "l_partkey"), ("customer", "events", "c_custkey", "user_id"))


@query("A65_relationship_profile", " UNION ALL ".join(f"""SELECT '{p}<{c}' AS edge, CASE WHEN max(n)<=1 THEN 'one_to_one' ELSE 'one_to_many' END AS cardinality, {R(f'(SELECT count({fk})::DOUBLE/count(*) FROM {c})')} AS foreign_key_coverage,
   {R(f'(SELECT count(*) FROM {c} WHERE {fk} NOT IN (SELECT {k} FROM {p}))::DOUBLE/(SELECT count({fk}) FROM {c})')} AS orphan_fraction, {R('avg(n)')} AS avg_fanout, {N('max(n)')} AS max_fanout, {R('median(n)')} AS median_fanout, {R('quantile_cont(n,0.9)')} AS p90_fanout
   FROM (SELECT count(*) AS n FROM {c} WHERE {fk} IS NOT NULL GROUP BY {fk})""" for p, c, k, fk in _EDGES))
def _(t):
    out = None
    for p, c, k, fk in _EDGES:
        x = pf.relationship_profile(getattr(t, p), getattr(t, c), k, fk).select(F.lit(f"{p}<{c}").alias("edge"), "*")
        out = x if out is None else out.unionByName(x)
    return rounded(out)


def _freq(c, fk, ts):
    return f"""SELECT '{c}' AS child, {N('count(*)')} AS keys, {R('avg(span)')} AS avg_duration, {R('avg(n)')} AS avg_events, {R('median(span)')} AS median_duration, {R('median(n)')} AS median_events, {R('(SELECT avg(gap) FROM g)')} AS avg_gap,
      {R('(SELECT quantile_cont(gap,0.1) FROM g)')} AS p10_gap, {R('(SELECT median(gap) FROM g)')} AS median_gap, {R('(SELECT quantile_cont(gap,0.9) FROM g)')} AS p90_gap FROM (SELECT {fk}, count(*) AS n, date_diff('microsecond', min({ts}), max({ts}))/1e6 AS span FROM {c} GROUP BY 1)"""


@query("A66_event_frequency", f"WITH g AS (SELECT date_diff('microsecond', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), o_orderdate)/1e6 AS gap FROM orders) {_freq('orders', 'o_custkey', 'o_orderdate')}")
def _(t):
    out = pf.event_frequency_profile(t.orders, "o_custkey", "o_orderdate", slice_days=30)
    return rounded(out.select(F.lit("orders").alias("child"), "*"))


@query("A67_label_profile", f"""WITH {HISTORY} SELECT {N('count(*)')} AS support_rows, min(ts) AS support_start, max(ts) AS support_end, {R('count(*)::DOUBLE/count(DISTINCT entity)')} AS rows_per_entity, {R('avg(y)')} AS target_mean, {R('stddev_pop(y)')} AS target_std, {R('avg(y)')} AS positive_fraction,
  {N('count(DISTINCT y)')} AS class_count FROM hist""")
def _(t):
    return rounded(pf.label_profile(label_history(t)))


@query("A68_schema_features", f"""WITH t AS (SELECT 'region' AS n, count(*) AS rows, NULL::DOUBLE AS span, 2 AS cols FROM region UNION ALL SELECT 'nation', count(*), NULL, 3 FROM nation UNION ALL SELECT 'customer', count(*), NULL, 5 FROM customer UNION ALL SELECT 'supplier', count(*), NULL, 4 FROM supplier UNION ALL SELECT 'part', count(*), NULL, 6 FROM part
   UNION ALL SELECT 'orders', count(*), date_diff('microsecond', min(o_orderdate), max(o_orderdate))/1e6, 6 FROM orders WHERE o_orderdate<=TIMESTAMP '{CUT}' UNION ALL SELECT 'lineitem', count(*), date_diff('microsecond', min(l_shipdate), max(l_shipdate))/1e6, 11 FROM lineitem WHERE l_shipdate<=TIMESTAMP '{CUT}'
   UNION ALL SELECT 'events', count(*), NULL, 6 FROM events WHERE ts<=TIMESTAMP '{CUT}'), f AS (SELECT avg(n) AS f FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) UNION ALL SELECT avg(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) UNION ALL SELECT avg(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey) UNION ALL SELECT avg(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))
  SELECT {N('count(*)')} AS table_count, {R('ln(1+sum(rows))')} AS total_rows_log1p, {R('ln(1+max(rows))')} AS max_rows_log1p, {N('sum(cols)')} AS column_count, CAST(3 AS BIGINT) AS dated_table_count, {R('avg(span)')} AS span_mean, {R('max(span)')} AS span_max, CAST(8 AS BIGINT) AS relationship_count,
   CAST(0 AS BIGINT) AS self_relationship_count, {R('(SELECT avg(f) FROM f)')} AS fanout_mean, {R('(SELECT max(f) FROM f)')} AS fanout_max, {R('(SELECT min(f) FROM f)')} AS fanout_min FROM t""")
def _(t):
    cat = catalog(t)
    relations = None
    for _, c, _, fk in _EDGES:
        x = pf.mean_fanout(getattr(t, c), fk)
        relations = x if relations is None else relations.unionByName(x)
    return rounded(pf.schema_features(cat, pf.table_profiles(cat, CUT), relations))
