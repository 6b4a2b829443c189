"""Sources, integrity, fingerprints, stores and the plug-in surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit import Catalog, Table
from asofkit.catalog import table_from_metadata
from asofkit.functions.scalars import stamp
from asofkit.operators import families as fam
from asofkit.operators import joins as jn
from asofkit.requests import visible
from asofkit.sources import io
from suite.core import K
from suite.families import HISTORY, label_history
from suite.model import catalog
from suite.registry import EVENT_REQ, EVENT_VIS, N, ORDER_REQ, R, aligned_sql, query, rounded


def _count(frame, name):
    return frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")


@query("S1_open_sources", f"SELECT 'parquet' AS source, {N('count(*)')} AS rows FROM orders UNION ALL SELECT 'frame', count(*) FROM part UNION ALL SELECT 'view', count(*) FROM supplier")
def _(t):
    t.supplier.createOrReplaceTempView("supplier_source")
    out = _count(io.open_source(t.spark, f"{t.folder}/orders.parquet"), "parquet")
    out = out.unionByName(_count(io.open_source(t.spark, t.part), "frame"))
    return out.unionByName(_count(io.open_source(t.spark, "supplier_source"), "view"))


_DECL = [("customer", "c_custkey", "", "c_nationkey->nation"), ("events", "event_id", "ts", "user_id->customer"), ("lineitem", "", "l_shipdate", "l_orderkey->orders,l_partkey->part,l_suppkey->supplier"),
         ("nation", "n_nationkey", "", "n_regionkey->region"), ("orders", "o_orderkey", "o_orderdate", "o_custkey->customer"), ("part", "p_partkey", "", ""), ("region", "r_regionkey", "", ""), ("supplier", "s_suppkey", "", "s_nationkey->nation")]


@query("S2_declared_catalog", " UNION ALL ".join(f"""SELECT '{n}' AS "table", '{k}' AS key, '{c}' AS time, '{f}' AS foreign_keys, {N('count(*)')} AS rows FROM {n}""" for n, k, c, f in _DECL))
def _(t):
    cat = catalog(t)
    # Roles travel in the schema and are read back from it.
    back = Catalog({n: table_from_metadata(n, cat.with_column_metadata(n)) for n in cat.tables})
    out = None
    for row in back.describe():
        part = back[row["table"]].frame.agg(F.count(F.lit(1)).alias("rows")).select(
            *[F.lit(row[c]).alias(c) for c in ("table", "key", "time", "foreign_keys")], "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("S3_key_violations", f"""SELECT 'lineitem' AS "table", concat_ws('|', l_orderkey, l_linenumber) AS key, {N('count(*)')} AS rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1 UNION ALL
  SELECT 'orders', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*)>1""")
def _(t):
    lines = Table("lineitem", t.lineitem, ("l_orderkey", "l_linenumber"), "l_shipdate")
    return io.key_violations(lines).unionByName(io.key_violations(catalog(t)["orders"]))


@query("S4_orphan_report", f"""WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate<TIMESTAMP '1998-01-01') SELECT 'lineitem.l_orderkey' AS edge, CAST(l_orderkey AS VARCHAR) AS key, {N('count(*)')} AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) GROUP BY 2""")
def _(t):
    cat = catalog(t)
    early = io.snapshot(cat["orders"], "1998-01-01")
    return io.orphan_report(Catalog({**cat.tables, "orders": early}), ["lineitem"])


_OFFERS = "offers AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linenumber<=2)"


def _with_offers(t, cat, kept="l_linenumber <= 2"):
    """Offers have a key of two columns, to which lines refer."""
    offers = t.lineitem.filter(kept).select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct()
    lines = Table("lineitem", t.lineitem, time="l_shipdate", foreign_keys=(("l_orderkey", "orders"), (("l_partkey", "l_suppkey"), "offer")))
    return Catalog({**cat.tables, "lineitem": lines, "offer": Table("offer", offers, ("part", "supplier"), foreign_keys=(("supplier", "supplier"),))})


@query("S4_composite_orphans", f"""WITH {_OFFERS} SELECT 'lineitem.l_partkey+l_suppkey' AS edge, l_partkey||'|'||l_suppkey AS key, {N('count(*)')} AS rows
  FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM offers WHERE p=l_partkey AND s=l_suppkey) GROUP BY 2""")
def _(t):
    return io.orphan_report(_with_offers(t, catalog(t)), ["lineitem"])


@query("S6_composite_prune", f"""WITH s AS (SELECT * FROM supplier WHERE s_acctbal>0), {_OFFERS}, o AS (SELECT * FROM offers WHERE s IN (SELECT s_suppkey FROM s)),
  l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND EXISTS (SELECT 1 FROM o WHERE p=l_partkey AND s=l_suppkey))
  SELECT 'offer' AS "table", {N('count(*)')} AS rows FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def _(t):
    cat = _with_offers(t, catalog(t))
    solvent = cat["supplier"].with_frame(t.supplier.filter("s_acctbal > 0"))
    pruned = io.prune_orphans(Catalog({**cat.tables, "supplier": solvent}))
    parts = [pruned[n].frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n in ("offer", "lineitem")]
    return parts[0].unionByName(parts[1])


@query("S5_phase_snapshot", " UNION ALL ".join(
    f"""SELECT '{n}' AS "table", {N('count(*)')} AS rows FROM {n}{f" WHERE {c}<TIMESTAMP '1999-06-01'" if c else ''}""" for n, _, c, _ in _DECL))
def _(t):
    cat = io.phase_snapshot(catalog(t), "1999-06-01")
    out = None
    for name, table in sorted(cat.tables.items()):
        part = table.frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("S6_cascading_prune", f"""WITH c AS (SELECT * FROM customer WHERE c_acctbal>0), o AS (SELECT * FROM orders WHERE o_orderdate<TIMESTAMP '1999-06-01' AND o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_shipdate<TIMESTAMP '1999-06-01' AND l_orderkey IN (SELECT o_orderkey FROM o)),
  e AS (SELECT * FROM events WHERE ts<TIMESTAMP '1999-06-01') SELECT 'customer' AS "table", {N('count(*)')} AS rows FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def _(t):
    cat = io.phase_snapshot(catalog(t), "1999-06-01")
    solvent = cat["customer"].with_frame(cat["customer"].frame.filter("c_acctbal > 0"))
    pruned = io.prune_orphans(Catalog({**cat.tables, "customer": solvent}))
    out = None
    for name in ("customer", "orders", "lineitem"):
        part = pruned[name].frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("S7_routing_keys", f"""SELECT l_orderkey, l_linenumber, CAST('0x'||substr(sha256('["'||l_orderkey||'","'||l_linenumber||'"]'),1,15) AS BIGINT) AS route, {N('0')} AS collisions FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def _(t):
    keys = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    clashes = io.routing_collisions(t.lineitem, ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    return keys.select("*", io.routing_key("l_orderkey", "l_linenumber").alias("route"), clashes.alias("collisions"))


def _phases(t):
    labels = io.supervised_rows(label_history(t).select("entity", F.col("ts").alias("cutoff"), "y"), 90)
    training = labels.filter(F.col("available_at") <= stamp("1999-01-01"))
    validation = labels.filter((F.col("cutoff") >= stamp("1999-01-01")) & (F.col("available_at") <= stamp("2000-01-15")))
    requests = labels.filter(F.col("cutoff") >= stamp("2000-01-01")).select("entity", "cutoff")
    return labels, training, validation, requests


_RULES = [f"{n}: {r}" for n in ("training", "validation") for r in ("incomplete", "available before horizon", "repeated entity and time", "unknown entity")]


@query("S8_phase_rules", f"""WITH {HISTORY}, v AS (SELECT * FROM hist WHERE ts>=TIMESTAMP '1999-01-01' AND available_at<=TIMESTAMP '2000-01-15') SELECT rule, CAST(0 AS BIGINT) AS rows FROM (VALUES {','.join(f"('{r}')" for r in _RULES)}, ('training: immature at inner boundary'), ('validation: before inner boundary'), ('requests: before outer boundary'), ('requests: unknown entity')) r(rule)
  UNION ALL SELECT 'validation: immature at outer boundary', count(*) FROM v WHERE available_at>TIMESTAMP '2000-01-01'""")
def _(t):
    _, training, validation, requests = _phases(t)
    roots = t.customer.select(F.col("c_custkey").alias("entity"))
    return io.phase_violations(training, validation, requests, roots, "1999-01-01", "2000-01-01", 90)


@query("S9_split_view", f"""WITH {HISTORY}, b AS (SELECT o_custkey AS entity, min(o_orderdate) AS born FROM orders GROUP BY 1) SELECT h.entity, h.ts AS cutoff, y FROM hist h JOIN b ON b.entity=h.entity AND born<TIMESTAMP '1999-01-01' WHERE available_at<=TIMESTAMP '1999-01-01'""")
def _(t):
    labels, *_ = _phases(t)
    roots = t.order_events().groupBy("entity").agg(F.min("ts").alias("born"))
    return io.split_view(labels, roots, "1999-01-01").select("entity", "cutoff", "y")


@query("S12_cohort_cache", f"""SELECT cutoff, {N('count(*)')} AS rows, {R('sum(o_totalprice)', 2)} AS total FROM (SELECT date_trunc('year', o_orderdate) AS cutoff, o_totalprice FROM orders) WHERE cutoff IN (TIMESTAMP '1996-01-01', TIMESTAMP '1999-01-01') GROUP BY 1""")
def _(t):
    folder = _folder(t, "cohorts")
    frame = t.orders.select(F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("cutoff"), "o_orderkey", "o_totalprice")
    io.append_cohorts(frame, folder)
    back = io.read_cohorts(t.spark, folder, ["1996-01-01", "1999-01-01"])
    return rounded(back.groupBy("cutoff").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total")), "total", places=2)


def _folder(t, name):
    """A fresh folder in the shared checkpoint folder."""
    import uuid

    from asofkit.session import shared_folder

    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _digest_sql(name, cols):
    parts = ", ".join(f"coalesce('='||CAST({c} AS VARCHAR),'~')" for c in sorted(cols))
    d = f"CAST('0x'||substr(md5(concat_ws('|', {parts})),1,12) AS BIGINT)"
    return f"SELECT '{name}' AS name, {N('count(*)')} AS rows, CAST(sum({d}) AS VARCHAR) AS digest_sum, bit_xor({d}) AS digest_xor FROM {name}"


@query("S13_fingerprint", " UNION ALL ".join(_digest_sql(n, c) for n, c in (("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]), ("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]))))
def _(t):
    out = None
    for name, frame in (("orders", t.orders.drop("o_totalprice")), ("part", t.part.drop("p_retailprice"))):
        part = io.fingerprint(frame).select(F.lit(name).alias("name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("S14_frame_difference", """SELECT 'actual' AS side, * FROM (SELECT user_id, event_type FROM events WHERE event_type<>'view' EXCEPT ALL SELECT user_id, event_type FROM events WHERE value<50)
  UNION ALL SELECT 'expected', * FROM (SELECT user_id, event_type FROM events WHERE value<50 EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_type<>'view')""")
def _(t):
    rows = t.events.select("user_id", "event_type", "value")
    a = rows.filter("event_type <> 'view'").drop("value")
    b = rows.filter("value < 50").drop("value")
    return io.difference(a, b)


@query("S15_pending_trials", """SELECT DISTINCT o_orderpriority AS config, o_orderstatus AS stage, NULL::BIGINT AS sample_rows FROM orders WHERE o_orderstatus<>'F'""")
def _(t):
    wanted = t.orders.select(F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("stage"), F.lit(None).cast("long").alias("sample_rows")).distinct()
    folder = _folder(t, "trials")
    contract = io.contract_hash({"catalog": catalog(t).describe()})
    io.save_trials(wanted.withColumn("status", F.when(F.col("stage") == "F", "completed").otherwise("failed")), folder, contract)
    done = t.spark.read.parquet(folder).filter(F.col("contract") == contract)
    return io.pending_trials(wanted, done.select("config", "stage", "sample_rows"))


@query("S16_record_store", f"""SELECT role, {N('count(*)')} AS turns, {N('count(DISTINCT conv_id)')} AS conversations, {N('sum(length(text))')} AS characters FROM conversations GROUP BY 1""")
def _(t):
    folder = _folder(t, "records")
    records = t.conversations.withColumn("record", F.concat_ws(":", "conv_id", "turn"))
    io.write_records(records, folder, "record")
    back = io.read_records(t.spark, folder, records.schema, "record")
    return back.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).alias("characters"))


_PHASES = f"""WITH {HISTORY}, p AS (SELECT 'training' AS name, * FROM hist WHERE available_at<=TIMESTAMP '1999-01-01' UNION ALL SELECT 'validation', * FROM hist WHERE ts>=TIMESTAMP '1999-01-01' AND available_at<=TIMESTAMP '2000-01-15'
  UNION ALL SELECT 'requests', * FROM hist WHERE ts>=TIMESTAMP '2000-01-01')"""


@query("S10_bundle_export", f"{_PHASES} SELECT name, {N('count(*)')} AS rows FROM p GROUP BY 1")
def _(t):
    _, training, validation, requests = _phases(t)
    frames = {"training": training, "validation": validation, "requests": requests.withColumn("y", F.lit(None).cast("double"))}
    return io.export_bundle(t.spark, _folder(t, "bundle"), frames, "y").select("name", "rows")


@query("S11_bundle_reopen", f"{_PHASES} SELECT name AS source, {N('count(*)')} AS rows FROM p WHERE name<>'training' OR ts<TIMESTAMP '1998-06-01' GROUP BY 1")
def _(t):
    folder = _folder(t, "bundle")
    _, training, validation, requests = _phases(t)
    io.export_bundle(t.spark, folder, {"training": training, "validation": validation, "requests": requests}, "y")
    frames = io.reopen_bundle(t.spark, folder, "y", "1998-06-01", {"training": "cutoff"})
    out = None
    for name, frame in sorted(frames.items()):
        part = _count(frame, name)
        out = part if out is None else out.unionByName(part)
    return out


# --- plug-in surface ---------------------------------------------------------------------


@query("X1_caller_expressions", aligned_sql(EVENT_VIS, [
    ("sum((value>100 AND event_type IN ('click','purchase'))::INT)", "big_sum", "i"), ("avg(ln(1+value))", "log_value_avg", "d"), ("max(ln(1+value))", "log_value_max", "d")]))
def _(t):
    rows = fam.semantic(visible(t.user_events(), t.event_requests()), {
        "big": "value > 100 AND event_type IN ('click', 'purchase')", "log_value": "ln(1 + value)"})
    block = rows.groupBy(*K).agg(*fam.base_boolean("big"), F.avg("log_value").alias("log_value_avg"), F.max("log_value").alias("log_value_max"))
    return rounded(t.event_requests().align(block))


@query("X2_feature_provider", f"""WITH {ORDER_REQ} SELECT r.entity, r.cutoff, {R('avg(o_totalprice)')} AS peer_price, {N('0')} AS repeated_keys FROM requests r JOIN customer c ON c.c_custkey=r.entity
  LEFT JOIN (SELECT c_nationkey, o_totalprice, o_orderdate FROM orders JOIN customer ON c_custkey=o_custkey) o ON o.c_nationkey=c.c_nationkey AND o_orderdate<r.cutoff GROUP BY 1,2""")
def _(t):
    from asofkit.plans.providers import attach

    req = t.order_requests()

    def provider(requests):
        nations = t.customer.select(F.col("c_custkey").alias("entity"), "c_nationkey")
        rows = t.order_events().join(nations, "entity").withColumnRenamed("entity", "buyer").withColumnRenamed("c_nationkey", "entity")
        asked = jn_requests(requests, nations)
        seen = visible(rows, asked).groupBy(F.col("entity").alias("c_nationkey"), "cutoff").agg(F.avg("o_totalprice").alias("peer_price"))
        return requests.frame.join(nations, "entity").join(seen, ["c_nationkey", "cutoff"], "left").drop("c_nationkey")

    out = attach(req, provider)
    repeated = jn.snapshot_violations(out).agg(F.count(F.lit(1)).alias("n")).scalar()
    return rounded(out, "peer_price").withColumn("repeated_keys", repeated)


def jn_requests(requests, nations):
    from asofkit import Requests

    frame = requests.frame.join(nations, "entity").select(F.col("c_nationkey").alias("entity"), "cutoff").distinct()
    return Requests(frame, requests.cutoffs, requests.phase)
