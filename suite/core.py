"""Clocks, projections, joins and the keyed-reduction families (P, J, A1-A20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit import Catalog, Requests, Table
from asofkit.functions.scalars import count_if, days, finite, flag, hash_unit, minus_seconds, seconds, stamp, when
from asofkit.operators import families as fam
from asofkit.operators import joins as jn
from asofkit.plans import paths as pl
from asofkit.plans import reduction as rd
from asofkit.requests import visible
from suite.model import catalog
from suite.registry import (
    EVENT_CUTS, EVENT_REQ, EVENT_VIS, N, ORDER_CUTS, ORDER_REQ, ORDER_VIS, R, aligned_sql, query, rounded, secs,
    since_sql,
)

K = ["entity", "cutoff"]

# --- P: predicates and projections -------------------------------------------

_boundary = {"strict": "<", "inclusive": "<=", "exact": "="}


@query("P1_cutoff_boundary", " UNION ALL ".join(
    f"SELECT '{k}' AS boundary, v.cutoff, {N('count(*)')} AS orders, {R('sum(o_totalprice)', 2)} AS total "
    f"FROM orders, (VALUES (TIMESTAMP '1998-01-01'),(TIMESTAMP '2000-01-01')) v(cutoff) WHERE o_orderdate{op}v.cutoff GROUP BY 2"
    for k, op in _boundary.items()))
def _(t):
    req = t.order_requests()
    out = None
    for kind in _boundary:
        rows = visible(t.order_events(), req, boundary=kind).groupBy("cutoff").agg(
            F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
        rows = rows.select(F.lit(kind).alias("boundary"), "*")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "total", places=2)


@query("P2_two_clock_visibility", aligned_sql(
    f"""{ORDER_REQ}, visible AS (SELECT r.entity, r.cutoff, o.* FROM requests r JOIN
    (SELECT o.*, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 90) AS ready FROM orders o) o
    ON o.o_custkey=r.entity AND o_orderdate<r.cutoff AND ready<=r.cutoff)""",
    [("count(*)", "n", "n"), ("sum(o_totalprice)", "total", "d"), (secs("max(ready)", "cutoff"), "age", "d")]))
def _(t):
    ready = F.col("ts") + F.make_dt_interval(F.pmod("o_orderkey", F.lit(90)).cast("int"))
    rows = t.order_events().withColumn("ready", ready)
    req = t.order_requests()
    v = visible(rows, req, available="ready")
    return rounded(req.align(v.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"),
        seconds(F.max("ready"), F.col("cutoff")).alias("age")), zero=["n"]))


@query("P3_query_and_phase_clock", aligned_sql(
    f"""{EVENT_REQ}, visible AS (SELECT r.entity, r.cutoff, e.* FROM requests r JOIN events e ON e.user_id=r.entity
    AND e.ts<least(r.cutoff, TIMESTAMP '2024-01-15') AND e.ts>=r.cutoff-INTERVAL 14 DAY)""",
    [("count(*)", "n", "n"), ("sum(value)", "total", "d"), (secs("max(ts)", "cutoff"), "age", "d")]))
def _(t):
    req = t.event_requests(phase="2024-01-15")
    v = visible(t.user_events(), req, lookback_days=14)
    return rounded(req.align(v.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"),
        seconds(F.max("ts"), F.col("cutoff")).alias("age")), zero=["n"]))


@query("P4_lookback_window", aligned_sql(
    ORDER_VIS.replace("o.o_orderdate<r.cutoff", "o.o_orderdate<r.cutoff AND o.o_orderdate>=r.cutoff-INTERVAL 365 DAY"),
    [("count(*)", "n", "n"), ("min(ts)", "first_order", "t")]))
def _(t):
    req = t.order_requests()
    v = visible(t.order_events(), req, lookback_days=365)
    return req.align(v.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_order")), zero=["n"])


@query("P5_structural_projection", f"""SELECT o_orderkey AS "order key", o_custkey AS "cust`key", o_orderdate AS "the date",
  o_orderstatus AS "status: raw", upper(o_orderpriority) AS shout, CAST(1 AS BIGINT) AS missing_columns FROM orders
  WHERE o_orderstatus <> 'P'""")
def _(t):
    frame = t.orders.select(
        F.col("o_orderkey").alias("order key"), F.col("o_custkey").alias("cust`key"),
        F.col("o_orderdate").alias("the date"), F.col("o_orderstatus").alias("status: raw"),
        F.col("o_orderpriority").alias("prio \"quoted\""), "o_totalprice")
    table = Table(
        "odd names", frame, ("order key",), "the date", foreign_keys=(("cust`key", "customer"),),
        predicates=("`status: raw` <> 'P'",), payload=("status: raw", "prio \"quoted\"", "not there"))
    out = table.projected().withColumn("shout", F.upper(F.col("`prio \"quoted\"`"))).drop("prio \"quoted\"")
    return out.withColumn("missing_columns", F.lit(len(table.missing_payload())).cast("long"))


_COHORT = "SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING'"


@query("P6_cohort_restriction", f"""SELECT o_custkey AS entity, {N('count(*)')} AS n, {R('avg(o_totalprice)')} AS mean
  FROM orders WHERE o_custkey IN ({_COHORT}) AND o_orderdate<TIMESTAMP '2000-01-01' GROUP BY 1""")
def _(t):
    cohort = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity"))
    rows = jn.cohort_rows(t.order_events().filter(F.col("ts") < stamp("2000-01-01")), cohort, ["entity"])
    return rounded(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")), "mean")


@query("P7_reachable_scoping", f"""WITH o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_COHORT}))
  SELECT 'orders' AS source, {N('count(*)')} AS kept FROM o UNION ALL
  SELECT 'lineitem', {N('count(*)')} FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def _(t):
    cohort = t.customer.filter("c_mktsegment = 'BUILDING'")
    walk = [(t.orders, "o_custkey", "o_orderkey"), (t.lineitem, "l_orderkey", None)]
    orders, lines = jn.reachable(walk, cohort, "c_custkey")
    count = lambda f, n: f.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("source"), "kept")
    return count(orders, "orders").unionByName(count(lines, "lineitem"))


@query("P8_mature_labels", f"""SELECT rule, {N('count(*)')} AS labels, {R('avg(y)')} AS mean FROM (
  SELECT 'declared' AS rule, (value>50)::INT AS y FROM events WHERE ts + INTERVAL 1 HOUR * (event_id % 72) <= TIMESTAMP '2024-01-20'
  UNION ALL SELECT 'horizon', (value>50)::INT FROM events WHERE ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-20') GROUP BY 1""")
def _(t):
    from asofkit.operators.sampling import mature_labels

    rows = t.events.select("ts", "event_id", (F.col("value") > 50).cast("int").alias("y"))
    rows = rows.withColumn("ready", F.col("ts") + F.make_dt_interval(F.lit(0), F.pmod("event_id", F.lit(72)).cast("int")))
    declared = mature_labels(rows, stamp("2024-01-20"), available="ready", strict=False)
    implied = mature_labels(rows, stamp("2024-01-20"), horizon_days=7, strict=True)
    both = declared.withColumn("rule", F.lit("declared")).unionByName(implied.withColumn("rule", F.lit("horizon")))
    return rounded(both.groupBy("rule").agg(F.count(F.lit(1)).alias("labels"), F.avg("y").alias("mean")), "mean")


@query("P9_equality_predicates", f"""WITH c AS (
  SELECT 'orders' AS source, 'o_orderstatus' AS col, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderdate<TIMESTAMP '2000-01-01' GROUP BY 3
  UNION ALL SELECT 'orders','o_orderpriority',o_orderpriority,count(*) FROM orders WHERE o_orderdate<TIMESTAMP '2000-01-01' GROUP BY 3
  UNION ALL SELECT 'lineitem','l_returnflag',l_returnflag,count(*) FROM lineitem WHERE l_shipdate<TIMESTAMP '2000-01-01' GROUP BY 3
  UNION ALL SELECT 'lineitem','l_linestatus',l_linestatus,count(*) FROM lineitem WHERE l_shipdate<TIMESTAMP '2000-01-01' GROUP BY 3
  UNION ALL SELECT 'events','event_type',event_type,count(*) FROM events WHERE ts<TIMESTAMP '2000-01-01' GROUP BY 3),
  k AS (SELECT *, count(*) OVER (PARTITION BY source,col) AS card FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, col, value) AS rank FROM k WHERE card<=16)
  SELECT source, col, value, {N('n')} AS n, {N('rank')} AS rank FROM r WHERE rank<=4""")
def _(t):
    from asofkit.operators.profiling import equality_predicates

    return equality_predicates(
        {"orders": (t.orders, "o_orderdate", ["o_orderstatus", "o_orderpriority"]),
         "lineitem": (t.lineitem, "l_shipdate", ["l_returnflag", "l_linestatus"]),
         "events": (t.events, "ts", ["event_type"])}, "2000-01-01", limit=4)


@query("P10_canonical_order", """SELECT user_id AS entity, event_id, date_trunc('day', ts) AS cutoff,
  CAST(row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY user_id, ts, event_id)-1 AS BIGINT) AS ordinal FROM events""")
def _(t):
    from asofkit.operators.sampling import canonical_order

    rows = t.user_events().withColumn("cutoff", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return canonical_order(rows, "cutoff", ["entity", "ts", "event_id"]).select("entity", "event_id", "cutoff", "ordinal")


@query("P11_model_exclusions", f"""SELECT {R('o_totalprice', 2)} AS o_totalprice, o_orderstatus, o_orderpriority FROM orders""")
def _(t):
    from asofkit.plans.frames import model_columns

    table = catalog(t)["orders"]
    labelled = table.frame.withColumn("split", F.lit("train")).withColumn("y", F.lit(1))
    keep = model_columns(labelled.columns, structural=table.structural, roles=("split", "y"))
    return rounded(labelled.select(*keep), "o_totalprice", places=2)


# --- J: joins ------------------------------------------------------------------

@query("J1_keyed_reduction", f"""WITH {ORDER_REQ},
  l AS (SELECT o.o_orderkey, r.cutoff, count(*) AS lines, max(l_extendedprice) AS price_max, avg(l_extendedprice) AS price_avg
    FROM requests r JOIN orders o ON o.o_custkey=r.entity AND o.o_orderdate<r.cutoff
    JOIN lineitem l ON l.l_orderkey=o.o_orderkey AND l.l_shipdate<r.cutoff GROUP BY 1,2),
  o AS (SELECT r.entity, r.cutoff, o.o_orderkey, o.o_totalprice FROM requests r JOIN orders o ON o.o_custkey=r.entity AND o.o_orderdate<r.cutoff),
  b AS (SELECT o.entity, o.cutoff, count(*) AS orders, sum(o_totalprice) AS total_sum, avg(o_totalprice) AS total_avg,
    sum(lines) AS line_count, max(price_max) AS price_max_max, avg(price_avg) AS price_avg_avg
    FROM o LEFT JOIN l ON o.o_orderkey=l.o_orderkey AND o.cutoff=l.cutoff GROUP BY 1,2)
  SELECT r.entity, r.cutoff, CAST(orders AS BIGINT) AS orders, {R('total_sum')} AS total_sum, {R('total_avg')} AS total_avg,
    CAST(line_count AS BIGINT) AS line_count, {R('price_max_max')} AS price_max_max, {R('price_avg_avg')} AS price_avg_avg
  FROM requests r LEFT JOIN b USING (entity, cutoff)""")
def _(t):
    cat = catalog(t)
    out = rd.reduce_tree(cat, rd.along(cat, ("customer", "orders", "lineitem")), t.order_requests(), {
        "orders": {rd.ROWS: ("count",), "o_totalprice": ("sum", "avg")},
        "lineitem": {rd.ROWS: ("count",), "l_extendedprice": ("max", "avg")}})
    return rounded(out.select(*K, F.col("orders_rows").alias("orders"), F.col("orders_o_totalprice_sum").alias("total_sum"), F.col("orders_o_totalprice_avg").alias("total_avg"),
        F.col("orders_lineitem_rows_count").alias("line_count"), F.col("orders_lineitem_l_extendedprice_max_max").alias("price_max_max"),
        F.col("orders_lineitem_l_extendedprice_avg_avg").alias("price_avg_avg")))


_SUPPLIER_REQ = f"""requests AS (SELECT s_suppkey AS entity, v.cutoff FROM supplier, (VALUES {','.join(f"(TIMESTAMP '{c}')" for c in ORDER_CUTS)}) v(cutoff))"""


@query("J1_supplier_reduction", f"""WITH {_SUPPLIER_REQ},
  b AS (SELECT l_suppkey AS entity, r.cutoff, count(*) AS n, sum(l_quantity) AS q, max(p_retailprice) AS p, min(p_size) AS s, avg(o.o_totalprice) AS o
    FROM requests r JOIN lineitem l ON l_suppkey=r.entity AND l_shipdate<r.cutoff LEFT JOIN part ON p_partkey=l_partkey
    LEFT JOIN (SELECT o_orderkey, o_totalprice, o_orderdate FROM orders) o ON o_orderkey=l_orderkey AND o_orderdate<r.cutoff GROUP BY 1,2)
  SELECT r.entity, r.cutoff, {R('s_acctbal', 2)} AS s_acctbal, n_name AS nation, CAST(n AS BIGINT) AS lines, {R('q')} AS quantity, {R('p', 2)} AS dearest, CAST(s AS INT) AS smallest, {R('o')} AS order_mean
  FROM requests r JOIN supplier ON s_suppkey=r.entity LEFT JOIN nation ON n_nationkey=s_nationkey LEFT JOIN b USING (entity, cutoff)""")
def _(t):
    cat = catalog(t)
    tree = rd.along(cat, ("supplier", "lineitem", "part"), ("supplier", "lineitem", "orders"), ("supplier", "nation"))
    out = rd.reduce_tree(cat, tree, Requests.every(t.supplier, "s_suppkey", ORDER_CUTS), {
        "supplier": {"s_acctbal": ()}, "nation": {"n_name": ()}, "lineitem": {rd.ROWS: ("count",), "l_quantity": ("sum",)},
        "part": {"p_retailprice": ("max",), "p_size": ("min",)}, "orders": {"o_totalprice": ("avg",)}})
    out = out.select(*K, "s_acctbal", F.col("nation_n_name").alias("nation"), F.col("lineitem_rows").alias("lines"), F.col("lineitem_l_quantity_sum").alias("quantity"),
        F.col("lineitem_part_p_retailprice_max").alias("dearest"), F.col("lineitem_part_p_size_min").alias("smallest"), F.col("lineitem_orders_o_totalprice_avg").alias("order_mean"))
    return rounded(rounded(out, "s_acctbal", "dearest", places=2), "quantity", "order_mean")


_NATION_SQL = f"""WITH requests AS (SELECT n_nationkey AS entity, v.cutoff FROM nation, (VALUES {{cuts}}) v(cutoff)),
  o AS (SELECT r.cutoff, o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM (SELECT DISTINCT cutoff FROM requests) r JOIN orders ON o_orderdate<r.cutoff GROUP BY 1,2),
  e AS (SELECT r.cutoff, user_id, count(*) AS n, max(value) AS m FROM (SELECT DISTINCT cutoff FROM requests) r JOIN events ON ts<r.cutoff GROUP BY 1,2),
  l AS (SELECT r.cutoff, l_suppkey, avg(l_discount) AS a FROM (SELECT DISTINCT cutoff FROM requests) r JOIN lineitem ON l_shipdate<r.cutoff GROUP BY 1,2),
  c AS (SELECT c_nationkey AS entity, r.cutoff, count(*) AS n, avg(c_acctbal) AS b, sum(o.n) AS orders, sum(o.s) AS total, sum(e.n) AS events, max(e.m) AS peak
    FROM (SELECT DISTINCT cutoff FROM requests) r CROSS JOIN customer LEFT JOIN o ON o.cutoff=r.cutoff AND o_custkey=c_custkey LEFT JOIN e ON e.cutoff=r.cutoff AND user_id=c_custkey GROUP BY 1,2),
  s AS (SELECT s_nationkey AS entity, r.cutoff, count(*) AS n, avg(l.a) AS a FROM (SELECT DISTINCT cutoff FROM requests) r CROSS JOIN supplier LEFT JOIN l ON l.cutoff=r.cutoff AND l_suppkey=s_suppkey GROUP BY 1,2)
  SELECT r.entity, r.cutoff, c.n AS customers, {R('c.b')} AS balance, CAST(c.orders AS BIGINT) AS orders, {R('c.total')} AS total, CAST(c.events AS BIGINT) AS events, {R('c.peak')} AS peak, s.n AS suppliers, {R('s.a', 6)} AS discount
  FROM requests r LEFT JOIN c ON c.entity=r.entity AND c.cutoff=r.cutoff LEFT JOIN s ON s.entity=r.entity AND s.cutoff=r.cutoff"""


def _nations(t, requests):
    """Two children with children of their own on both sides: neither multiplies the other."""
    cat = catalog(t)
    tree = rd.along(cat, ("nation", "customer", "orders"), ("nation", "customer", "events"), ("nation", "supplier", "lineitem"))
    out = rd.reduce_tree(cat, tree, requests, {
        "customer": {rd.ROWS: ("count",), "c_acctbal": ("avg",)}, "supplier": {rd.ROWS: ("count",)}, "lineitem": {"l_discount": ("avg",)},
        "orders": {rd.ROWS: ("count",), "o_totalprice": ("sum",)}, "events": {rd.ROWS: ("count",), "value": ("max",)}})
    out = out.select("entity", "cutoff", F.col("customer_rows").alias("customers"), F.col("customer_c_acctbal_avg").alias("balance"), F.col("customer_orders_rows_count").alias("orders"),
        F.col("customer_orders_o_totalprice_sum_sum").alias("total"), F.col("customer_events_rows_count").alias("events"), F.col("customer_events_value_max_max").alias("peak"),
        F.col("supplier_rows").alias("suppliers"), F.col("supplier_lineitem_l_discount_avg_avg").alias("discount"))
    return rounded(rounded(out, "balance", "total", "peak"), "discount", places=6)


@query("J1_sibling_reduction", _NATION_SQL.format(cuts=",".join(f"(TIMESTAMP '{c}')" for c in (*ORDER_CUTS, *EVENT_CUTS))))
def _(t):
    return _nations(t, Requests.every(t.nation, "n_nationkey", (*ORDER_CUTS, *EVENT_CUTS)))


@query("J1_many_cutoffs", _NATION_SQL.format(cuts="").replace("SELECT n_nationkey AS entity, v.cutoff FROM nation, (VALUES ) v(cutoff)",
    "SELECT n_nationkey AS entity, TIMESTAMP '1998-01-01' + to_days(CAST(i AS INT)) AS cutoff FROM nation, (SELECT unnest(generate_series(0, 2970, 11)) AS i)"))
def _(t):
    # More cutoffs than are listed: the requests go down the tree.
    days = F.explode(F.sequence(F.lit(0), F.lit(2970), F.lit(11)))
    frame = t.nation.select(F.col("n_nationkey").alias("entity"), days.alias("i")).select("entity", F.expr("TIMESTAMP_NTZ '1998-01-01' + make_dt_interval(i)").alias("cutoff"))
    return _nations(t, Requests.of(frame))


def _offers(t, cat):
    """Offers of a part by a supplier, named by both keys, and the lines that refer to them."""
    offers = t.lineitem.filter("l_linenumber <= 2").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("price")).select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "price")
    lines = Table("lineitem", t.lineitem, time="l_shipdate", foreign_keys=(("l_orderkey", "orders"), (("l_partkey", "l_suppkey"), "offer")))
    offer = Table("offer", offers, ("part", "supplier"), foreign_keys=(("supplier", "supplier"),))
    return Catalog({**cat.tables, "offer": offer, "lineitem": lines})


_OFFERS = "offers AS (SELECT l_partkey AS p, l_suppkey AS s, min(l_extendedprice) AS price FROM lineitem WHERE l_linenumber<=2 GROUP BY 1,2)"


@query("J1_composite_reduction", f"""WITH {_SUPPLIER_REQ}, {_OFFERS},
  x AS (SELECT p, s, r.cutoff, price, count(l_partkey) AS n, sum(l_quantity) AS q FROM offers CROSS JOIN (SELECT DISTINCT cutoff FROM requests) r
    LEFT JOIN lineitem ON l_partkey=p AND l_suppkey=s AND l_shipdate<r.cutoff GROUP BY ALL),
  b AS (SELECT s AS entity, cutoff, count(*) AS offers, min(price) AS price, sum(CASE WHEN n>0 THEN n END) AS n, sum(q) AS q FROM x GROUP BY 1,2)
  SELECT r.entity, r.cutoff, CAST(offers AS BIGINT) AS offers, {R('price')} AS cheapest, CAST(n AS BIGINT) AS lines, {R('q')} AS quantity FROM requests r LEFT JOIN b USING (entity, cutoff)""")
def _(t):
    cat = _offers(t, catalog(t))
    out = rd.reduce_tree(cat, rd.along(cat, ("supplier", "offer", "lineitem")), Requests.every(t.supplier, "s_suppkey", ORDER_CUTS), {
        "offer": {rd.ROWS: ("count",), "price": ("min",)}, "lineitem": {rd.ROWS: ("count",), "l_quantity": ("sum",)}})
    return rounded(out.select(*K, F.col("offer_rows").alias("offers"), F.col("offer_price_min").alias("cheapest"),
        F.col("offer_lineitem_rows_count").alias("lines"), F.col("offer_lineitem_l_quantity_sum_sum").alias("quantity")))


@query("J2_dimension_lookup", aligned_sql(
    f"""{ORDER_REQ}, firsts AS (SELECT p_partkey, p_retailprice, p_size, min(l_shipdate) AS since FROM part JOIN lineitem ON l_partkey=p_partkey GROUP BY ALL),
    visible AS (SELECT r.entity, r.cutoff, d.p_retailprice, d.p_size, l.* FROM requests r JOIN orders o ON o.o_custkey=r.entity AND o.o_orderdate<r.cutoff
    JOIN lineitem l ON l.l_orderkey=o.o_orderkey AND l.l_shipdate<r.cutoff
    LEFT JOIN firsts d ON d.p_partkey=l.l_partkey AND d.since + INTERVAL 180 DAY <= r.cutoff)""",
    [("count(*)", "lines", "n"), ("count(p_size)", "known_parts", "n"), ("avg(p_retailprice)", "retail_mean", "d"), ("sum(p_size)", "sizes", "i")]))
def _(t):
    firsts = t.lineitem.groupBy("l_partkey").agg(F.min("l_shipdate").alias("since"))
    parts = t.part.join(firsts, F.col("p_partkey") == F.col("l_partkey")).select(
        "p_partkey", "p_retailprice", "p_size", (F.col("since") + F.expr("INTERVAL 180 DAYS")).alias("since"))
    req = t.order_requests()
    v = visible(order_lines(t, req.latest()), req, "known")
    v = jn.dimension(v, parts, "l_partkey", "p_partkey", ["p_retailprice", "p_size"], time="since")
    return rounded(req.align(v.groupBy(*K).agg(
        F.count(F.lit(1)).alias("lines"), F.count("p_size").alias("known_parts"),
        F.avg("p_retailprice").alias("retail_mean"), F.sum("p_size").alias("sizes")), zero=["lines", "known_parts"]))


def order_lines(t, until=None):
    """Lines reached from customers through orders, with the path's clock."""
    cat = catalog(t)
    steps = (("orders", "o_custkey"), ("lineitem", "l_orderkey"))
    return jn.path_facts(pl.path_hops(cat, steps), until)


LINE_VIS = f"""{ORDER_REQ}, visible AS (SELECT r.entity, r.cutoff, l_shipdate AS ts, o.*, l.* FROM requests r
    JOIN orders o ON o.o_custkey=r.entity AND o.o_orderdate<r.cutoff JOIN lineitem l ON l.l_orderkey=o.o_orderkey AND l.l_shipdate<r.cutoff)"""


@query("J3_multi_hop_path", aligned_sql(LINE_VIS, [
    ("count(*)", "lines", "n"), ("sum(l_quantity)", "quantity", "z"), ("count(DISTINCT l_suppkey)", "suppliers", "n"),
    ("max(ts)", "last_ship", "t")]))
def _(t):
    req = t.order_requests()
    v = visible(order_lines(t, req.latest()), req, "known")
    return rounded(req.align(v.groupBy(*K).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"),
        F.count_distinct("l_suppkey").alias("suppliers"), F.max("ts").alias("last_ship")),
        zero=["lines", "suppliers"], defaults={"quantity": 0.0}))


@query("J3_composite_path", f"""WITH {_SUPPLIER_REQ}, {_OFFERS}, visible AS (SELECT r.entity, r.cutoff, l.* FROM requests r JOIN offers ON s=r.entity
    JOIN lineitem l ON l_partkey=p AND l_suppkey=s AND l_shipdate<r.cutoff)
  SELECT r.entity, r.cutoff, CAST(coalesce(n,0) AS BIGINT) AS lines, {R('q')} AS quantity FROM requests r LEFT JOIN (SELECT entity, cutoff, count(*) AS n, sum(l_quantity) AS q FROM visible GROUP BY 1,2) b USING (entity, cutoff)""")
def _(t):
    cat = _offers(t, catalog(t))
    req = Requests.every(t.supplier, "s_suppkey", ORDER_CUTS)
    facts = jn.path_facts(pl.path_hops(cat, (("offer", "supplier"), ("lineitem", ("l_partkey", "l_suppkey")))), req.latest())
    block = visible(facts, req, "known").groupBy(*K).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))
    return rounded(req.align(block, zero=["lines"]))


_HIST = """hist AS (SELECT o_custkey AS who, o_orderdate AS ts, o_orderdate + INTERVAL 30 DAY AS ready, o_orderkey, o_totalprice FROM orders)"""


@query("J4_latest_mature", " UNION ALL ".join(f"""(WITH {ORDER_REQ}, {_HIST}, x AS (SELECT r.entity, r.cutoff, h.*, row_number() OVER (
    PARTITION BY r.entity, r.cutoff ORDER BY ready DESC, ts DESC, o_orderkey DESC) AS rn FROM requests r JOIN hist h ON h.who=r.entity AND h.ready{op}r.cutoff)
    SELECT '{name}' AS rule, entity, cutoff, o_orderkey, {R('o_totalprice', 2)} AS o_totalprice, ready FROM x WHERE rn=1)"""
    for name, op in (("strict", "<"), ("inclusive", "<="))))
def _(t):
    hist = t.order_events().withColumn("ready", F.col("ts") + F.expr("INTERVAL 30 DAYS"))
    req = t.order_requests()
    out = None
    for name, strict in (("strict", True), ("inclusive", False)):
        x = jn.latest_mature(hist, req, ["o_orderkey", "o_totalprice"], "ready", "ts", strict, ("o_orderkey",))
        x = x.select(F.lit(name).alias("rule"), *K, "o_orderkey", "o_totalprice", "ready")
        out = x if out is None else out.unionByName(x)
    return rounded(out, "o_totalprice", places=2)


@query("J5_exact_snapshot", f"""WITH {EVENT_REQ}, f AS (SELECT user_id AS entity, date_trunc('day', ts) AS cutoff, avg(value) AS score FROM events GROUP BY 1,2)
  SELECT r.entity, r.cutoff, {R('score')} AS score FROM requests r LEFT JOIN f USING (entity, cutoff)""")
def _(t):
    daily = t.user_events().groupBy("entity", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("cutoff")).agg(
        F.avg("value").alias("score"))
    return rounded(jn.snapshot(t.event_requests(), daily), "score")


@query("J6_bounded_membership", f"""WITH {LINE_VIS}, d AS (SELECT DISTINCT entity, cutoff, l_suppkey FROM visible), k AS (
  SELECT *, row_number() OVER (PARTITION BY entity, cutoff ORDER BY md5(CAST(l_suppkey AS VARCHAR)), l_suppkey) AS rn FROM d)
  SELECT entity, cutoff, l_suppkey AS neighbor FROM k WHERE rn<=8""")
def _(t):
    return jn.memberships(order_lines(t), t.order_requests(), "l_suppkey", 8)


@query("J7_content_key", f"""SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_shipdate AS VARCHAR))) AS content_key,
  {N('count(*)')} AS copies, {R('sum(l_quantity)')} AS quantity FROM lineitem GROUP BY 1""")
def _(t):
    keyed = jn.content_key(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"])
    return rounded(keyed.groupBy("content_key").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("l_quantity").alias("quantity")), "quantity")


@query("J8_member_payload", f"""WITH {LINE_VIS}, d AS (SELECT DISTINCT entity, cutoff, l_suppkey FROM visible)
  SELECT entity, cutoff, l_suppkey AS neighbor, s_nationkey, {R('s_acctbal', 2)} AS s_acctbal FROM d LEFT JOIN supplier ON s_suppkey=l_suppkey""")
def _(t):
    members = jn.memberships(order_lines(t), t.order_requests(), "l_suppkey", None)
    return rounded(jn.member_payload(members, t.supplier, "s_suppkey", ["s_nationkey", "s_acctbal"]), "s_acctbal", places=2)


@query("J9_schema_paths", f"""SELECT 'customer<events' AS path, {N('1')} AS depth, {N('count(*)')} AS facts, {N('count(DISTINCT user_id)')} AS roots FROM events WHERE ts<TIMESTAMP '2024-01-20'
  UNION ALL SELECT 'customer<orders', 1, count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderdate<TIMESTAMP '2024-01-20'
  UNION ALL SELECT 'customer<orders<lineitem', 2, count(*), count(DISTINCT o_custkey) FROM orders JOIN lineitem ON l_orderkey=o_orderkey
  WHERE o_orderdate<TIMESTAMP '2024-01-20' AND l_shipdate<TIMESTAMP '2024-01-20'""")
def _(t):
    cat = catalog(t)
    kept, _ = pl.fact_paths(cat, "customer", depth=2)
    out = None
    for steps in kept:
        facts = jn.path_facts(pl.path_hops(cat, steps)).filter(F.col("known") < stamp("2024-01-20"))
        row = facts.agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("entity").alias("roots")).select(
            F.lit("<".join(["customer", *(n for n, _ in steps)])).alias("path"),
            F.lit(len(steps)).cast("long").alias("depth"), "facts", "roots")
        out = row if out is None else out.unionByName(row)
    return out


@query("J10_unrolled_self_walk", f"""WITH n AS (SELECT c_nationkey AS k, count(*) AS peers, avg(c_acctbal) AS bal FROM customer GROUP BY 1)
  SELECT c_custkey AS entity, {N('peers')} AS peers, {R('bal')} AS peer_balance FROM customer JOIN n ON k=c_nationkey""")
def _(t):
    cat = catalog(t)
    walk = next(w for w in pl.unrolled("customer", cat.relationships, 2, 2) if w == ("customer", "nation", "customer"))
    req = Requests.every(t.customer, "c_custkey", ORDER_CUTS[:1])
    out = rd.reduce_tree(cat, rd.along(cat, walk), req, {"customer": {rd.ROWS: ("count",), "c_acctbal": ("avg",)}})
    return rounded(out.select("entity", F.col("nation_customer_rows").alias("peers"), F.col("nation_customer_c_acctbal_avg").alias("peer_balance")), "peer_balance")


@query("J10_five_step_walk", f"""WITH {ORDER_REQ}, w AS (SELECT DISTINCT cutoff FROM requests),
  l AS (SELECT cutoff, l_orderkey AS k, count(*) AS n, sum(l_quantity) AS q, max(s.s_acctbal) AS m FROM w JOIN lineitem ON l_shipdate<cutoff LEFT JOIN supplier s ON s_suppkey=l_suppkey GROUP BY 1,2),
  o AS (SELECT w.cutoff, o_custkey AS k, sum(l.n) AS n, sum(l.q) AS q, max(l.m) AS m FROM w JOIN orders ON o_orderdate<cutoff LEFT JOIN l ON l.k=o_orderkey AND l.cutoff=w.cutoff GROUP BY 1,2),
  c AS (SELECT w.cutoff, c_nationkey AS k, count(*) AS peers, sum(o.n) AS n, sum(o.q) AS q, max(o.m) AS m FROM w CROSS JOIN customer LEFT JOIN o ON o.k=c_custkey AND o.cutoff=w.cutoff GROUP BY 1,2)
  SELECT r.entity, r.cutoff, CAST(peers AS BIGINT) AS peers, CAST(n AS BIGINT) AS peer_lines, {R('q')} AS peer_quantity, {R('m', 2)} AS richest_supplier
  FROM requests r JOIN customer ON c_custkey=r.entity LEFT JOIN c ON c.k=c_nationkey AND c.cutoff=r.cutoff""")
def _(t):
    cat = catalog(t)
    tree = rd.along(cat, ("customer", "nation", "customer", "orders", "lineitem", "supplier"))
    out = rd.reduce_tree(cat, tree, t.order_requests(), {
        "customer": {rd.ROWS: ("count",)}, "lineitem": {rd.ROWS: ("count",), "l_quantity": ("sum",)}, "supplier": {"s_acctbal": ("max",)}})
    name = "nation_customer_orders_lineitem"
    return rounded(rounded(out.select(*K, F.col("nation_customer_rows").alias("peers"), F.col(f"{name}_rows_count_count").alias("peer_lines"),
        F.col(f"{name}_l_quantity_sum_sum_sum").alias("peer_quantity"), F.col(f"{name}_supplier_s_acctbal_max_max_max").alias("richest_supplier")), "peer_quantity"), "richest_supplier", places=2)


@query("J11_leave_own_out", f"""WITH own AS (SELECT o_custkey, c_nationkey, sum(o_totalprice) AS s, count(*) AS n FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1,2),
  g AS (SELECT c_nationkey, sum(s) AS s, sum(n) AS n FROM own GROUP BY 1)
  SELECT o_custkey AS entity, own.c_nationkey, {N('g.n-own.n')} AS others_n, {R('g.s-own.s', 2)} AS others_total FROM own JOIN g USING (c_nationkey)""")
def _(t):
    nations = t.customer.select(F.col("c_custkey").alias("entity"), "c_nationkey")
    rows = t.order_events().join(nations, "entity").withColumn("one", F.lit(1).cast("long"))
    out = jn.without_own(rows, ["c_nationkey"], [], {"n": "one", "total": "o_totalprice"})
    return rounded(out.select("entity", "c_nationkey", "others_n", "others_total"), "others_total", places=2)


@query("J12_available_roots", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey=l_orderkey AND o_orderdate<=l_shipdate""")
def _(t):
    out = jn.available_roots(t.lineitem, t.orders, "l_orderkey", "o_orderkey", "l_shipdate", "o_orderdate")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("J13_prediction_alignment", f"""WITH {ORDER_REQ}, a AS (SELECT entity, cutoff, count(*) AS asked FROM requests GROUP BY 1,2),
  p AS (SELECT o_custkey AS entity, CASE WHEN o_orderdate<TIMESTAMP '1998-01-01' THEN TIMESTAMP '1998-01-01' WHEN o_orderdate<TIMESTAMP '2000-01-01' THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '2002-01-01' END AS cutoff FROM orders),
  g AS (SELECT entity, cutoff, count(*) AS given FROM p GROUP BY 1,2)
  SELECT {N('sum(asked)')} AS request_rows, {N('sum(given)')} AS prediction_rows, {N('count(*) FILTER (given IS NULL)')} AS missing_keys,
  {N('count(*) FILTER (asked IS NULL)')} AS unexpected_keys, {N('count(*) FILTER (given>1)')} AS duplicated_keys FROM a FULL JOIN g USING (entity, cutoff)""")
def _(t):
    e = t.order_events()
    period = F.when(F.col("ts") < stamp("1998-01-01"), stamp("1998-01-01")).when(
        F.col("ts") < stamp("2000-01-01"), stamp("2000-01-01")).otherwise(stamp("2002-01-01"))
    return jn.alignment_report(t.order_requests().frame, e.select("entity", period.alias("cutoff")), K)


def example_rows(t):
    """(entity, cutoff, truth, p, recency, days): labels and a content-hash score."""
    req = t.event_requests()
    past = visible(t.user_events(), req)
    state = past.groupBy(*K).agg(
        days(F.max("ts"), F.col("cutoff")).alias("recency"), F.count_distinct(F.to_date("ts")).alias("active"))
    future = fam.future_labels(
        t.user_events().filter("event_type = 'purchase'"), req, 3, {"truth": ("bool", "value")})
    p = 0.02 + 0.96 * hash_unit("entity", F.date_format("cutoff", "yyyyMMdd"))
    return state.join(future, K).withColumn("p", p)


EXAMPLES = f"""{EVENT_REQ}, state AS (SELECT r.entity, r.cutoff, date_diff('microsecond', max(ts), r.cutoff)/86400e6 AS recency, count(DISTINCT CAST(ts AS DATE)) AS active
    FROM requests r JOIN events e ON e.user_id=r.entity AND e.ts<r.cutoff GROUP BY 1,2),
  fut AS (SELECT r.entity, r.cutoff, 1 AS y FROM requests r JOIN events e ON e.user_id=r.entity AND e.ts>=r.cutoff AND e.ts<r.cutoff+INTERVAL 3 DAY AND event_type='purchase' GROUP BY 1,2),
  ex AS (SELECT entity, cutoff, recency, active, coalesce(y,0) AS truth,
    0.02+0.96*(CAST('0x'||substr(md5(concat_ws('|',entity,strftime(cutoff,'%Y%m%d'))),1,8) AS BIGINT)/4294967296.0) AS p FROM state LEFT JOIN fut USING (entity, cutoff))"""


@query("J14_nearest_negative", f"""WITH {EXAMPLES}, pos AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY p DESC, entity) AS place FROM ex WHERE truth=1),
  d AS (SELECT a.cutoff, a.entity AS positive, a.place, b.entity AS negative, round(sqrt(pow(ln(1+a.recency)-ln(1+b.recency),2)+pow(ln(1+a.active)-ln(1+b.active),2)),9) AS dist
    FROM pos a JOIN ex b ON a.cutoff=b.cutoff AND b.truth=0 WHERE a.place<=12),
  k AS (SELECT *, row_number() OVER (PARTITION BY cutoff, positive ORDER BY dist, negative) AS rn FROM d)
  SELECT cutoff, positive, {N('place')} AS place, negative, {R('dist', 6)} AS log_distance FROM k WHERE rn=1""")
def _(t):
    out = jn.nearest_negative(example_rows(t), ["recency", "active"], 12, "p")
    return rounded(out.withColumn("place", F.col("place").cast("long")), "log_distance", places=6)


def _h(*parts):
    return f"CAST('0x'||substr(md5(concat_ws('|', {', '.join(parts)})),1,8) AS BIGINT)"


_CUT = "CAST(cutoff AS VARCHAR)"


def _pairs_sql(maximum):
    """Classes in hash order, each cohort's quota, and the uniform pairs by number."""
    return f"""pl AS (SELECT *, ln(p/(1-p)) AS z, {_h('entity', _CUT, "'pair'")} AS off, row_number() OVER (PARTITION BY cutoff, truth ORDER BY {_h('entity', _CUT)}, entity)-1 AS place FROM ex),
  sz AS (SELECT cutoff, sum(truth) AS np, sum(1-truth) AS nn FROM ex GROUP BY 1 HAVING sum(truth)>0 AND sum(1-truth)>0),
  qu AS (SELECT *, {maximum}//(count(*) OVER ()) + CASE WHEN row_number() OVER (ORDER BY cutoff)-1 < {maximum}%(count(*) OVER ()) THEN 1 ELSE 0 END AS q FROM sz),
  ui AS (SELECT *, unnest(generate_series(0, CAST(least(q, np*nn) AS BIGINT)-1)) AS i FROM qu),
  un AS (SELECT ui.cutoff, q, i, p.entity AS positive, n.entity AS negative FROM ui JOIN pl p ON p.cutoff=ui.cutoff AND p.truth=1 AND p.place=i%np
    JOIN pl n ON n.cutoff=ui.cutoff AND n.truth=0 AND n.place=(p.off+i//np)%nn)"""


_NEAR_SQL = f"""nz AS (SELECT cutoff, entity, z, row_number() OVER (PARTITION BY cutoff ORDER BY z, {_h('entity', _CUT)}, entity)-1 AS r FROM pl WHERE truth=0),
  pi AS (SELECT p.cutoff, p.entity, p.place, p.z, count(*) FILTER (n.z<p.z-1) AS lo, count(*) FILTER (n.z<=p.z+1) AS hi, count(*) FILTER (n.z<p.z) AS under FROM pl p JOIN nz n ON n.cutoff=p.cutoff WHERE p.truth=1 GROUP BY ALL),
  dr AS (SELECT *, unnest(generate_series(0, CAST(4*q AS BIGINT)-1)) AS j FROM qu),
  di AS (SELECT dr.cutoff, q, j, pi.entity AS positive, z, lo, hi, under, lo+{_h('pi.entity', 'CAST(dr.cutoff AS VARCHAR)', 'CAST(j//np AS BIGINT)', "'near'")}%greatest(hi-lo,1) AS r FROM dr JOIN pi ON pi.cutoff=dr.cutoff AND pi.place=j%np),
  ca AS (SELECT di.cutoff, q, j, positive, n.entity AS negative, row_number() OVER (PARTITION BY di.cutoff, j ORDER BY round(abs(n.z-di.z),9), n.entity) AS rn
    FROM di JOIN nz n ON n.cutoff=di.cutoff AND ((hi>lo AND n.r=di.r) OR (hi=lo AND n.r BETWEEN under-1 AND under))),
  mx AS (SELECT cutoff, q, positive, negative, min(t) AS t FROM (SELECT cutoff, q, positive, negative, CASE WHEN i<q//2 THEN i ELSE 5*q+i END AS t FROM un UNION ALL SELECT cutoff, q, positive, negative, q+j FROM ca WHERE rn=1) GROUP BY ALL)"""


@query("J15_cohort_pairs", f"WITH {EXAMPLES}, {_pairs_sql(500)} SELECT cutoff, positive, negative FROM un")
def _(t):
    return jn.cohort_pairs(example_rows(t), 500)


@query("J16_hard_pairs", f"WITH {EXAMPLES}, {_pairs_sql(600)}, {_NEAR_SQL} SELECT cutoff, positive, negative FROM (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY t) AS k FROM mx) WHERE k<=q")
def _(t):
    return jn.mixed_pairs(example_rows(t), 600)


@query("J17_pair_gradient", f"""WITH {EXAMPLES}, {_pairs_sql(500)}, pairs AS (SELECT cutoff, positive, negative FROM un),
  e AS (SELECT pr.*, 1/(1+exp(-(ln(n.p/(1-n.p))-ln(a.p/(1-a.p))))) AS err FROM pairs pr JOIN ex a ON a.cutoff=pr.cutoff AND a.entity=pr.positive JOIN ex n ON n.cutoff=pr.cutoff AND n.entity=pr.negative),
  s AS (SELECT cutoff, positive AS entity, err AS g FROM e UNION ALL SELECT cutoff, negative, -err FROM e)
  SELECT cutoff, entity, {R('sum(g)')} AS gradient, {N('count(*)')} AS pairs FROM s GROUP BY 1,2""")
def _(t):
    ex = example_rows(t)
    return rounded(jn.pair_gradient(jn.cohort_pairs(ex, 500), ex), "gradient")
