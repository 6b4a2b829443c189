"""Payload encoders and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import encoders as en
from suite.core import K
from suite.registry import EVENT_REQ, N, ORDER_REQ, R, query, rounded

_PARENT = "pa AS (SELECT c.*, b.born FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS born FROM orders GROUP BY 1) b ON b.o_custkey=c.c_custkey)"
_COLS = ("c_acctbal", "c_mktsegment", "c_name", "born")


def parent(t):
    born = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("born"))
    return t.customer.join(born, F.col("c_custkey") == F.col("o_custkey"), "left")


@query("E1_parent_payload", f"""WITH {_PARENT}, {ORDER_REQ} SELECT r.entity, r.cutoff, {', '.join(f"CASE WHEN born<r.cutoff THEN {c} END AS {c}" if c != 'c_acctbal' else R('CASE WHEN born<r.cutoff THEN c_acctbal END', 2) + ' AS c_acctbal' for c in _COLS)} FROM requests r LEFT JOIN pa ON pa.c_custkey=r.entity""")
def _(t):
    out = en.parent_payload(t.order_requests(), parent(t), "c_custkey", list(_COLS), "born")
    return rounded(out, "c_acctbal", places=2)


@query("E2_structured_parent", f"""WITH {_PARENT}, {ORDER_REQ}, x AS (SELECT r.entity, r.cutoff, CASE WHEN born<r.cutoff THEN c_acctbal END AS a, CASE WHEN born<r.cutoff THEN c_mktsegment END AS m, CASE WHEN born<r.cutoff THEN born END AS b FROM requests r LEFT JOIN pa ON pa.c_custkey=r.entity),
  v AS (SELECT c_mktsegment AS s FROM pa WHERE born<TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
  SELECT entity, cutoff, {R('a', 2)} AS c_acctbal_number, {R("date_diff('microsecond', b, cutoff)/86400e6")} AS born_age_days, CAST(month(b) AS BIGINT) AS born_month, CAST(isodow(b)-1 AS BIGINT) AS born_dayofweek,
   CASE WHEN m IS NULL THEN 'missing:' WHEN m IN (SELECT s FROM v) THEN 'value:'||m ELSE 'other:' END AS c_mktsegment_category FROM x""")
def _(t):
    frame = en.parent_payload(t.order_requests(), parent(t), "c_custkey", list(_COLS), "born")
    training = parent(t).filter("born < timestamp_ntz'1998-01-01'")
    vocabulary = {"c_mktsegment": en.category_vocabulary(training, "c_mktsegment", 3)}
    plan = [("c_acctbal", "numeric"), ("born", "age_days"), ("born", "month"), ("born", "dayofweek"), ("c_mktsegment", "category")]
    out = en.structured_parent(frame, plan, vocabulary)
    out = rounded(out, "c_acctbal_number", places=2)
    return rounded(out, "born_age_days").withColumn("born_month", F.col("born_month").cast("long")).withColumn("born_dayofweek", F.col("born_dayofweek").cast("long"))


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("E6_token_hash", f"""WITH w AS (SELECT doc_id, unnest({_TOK}) AS word FROM documents), n AS (SELECT doc_id, CAST('0x'||substr(md5(word),1,8) AS BIGINT) AS h FROM w),
  s AS (SELECT doc_id, count(*) AS words, {', '.join(f"sum(CASE WHEN h%8={i} THEN CASE WHEN h&256<>0 THEN 1 ELSE -1 END END) AS b{i}" for i in range(8))} FROM n GROUP BY 1)
  SELECT doc_id, {', '.join(f"{R(f'coalesce(b{i},0)/sqrt(greatest(coalesce(words,0),1))')} AS text_hash{i}" for i in range(8))} FROM documents LEFT JOIN s USING (doc_id)""")
def _(t):
    return rounded(en.hashed_text(t.documents, "doc_id", "text"))


@query("E9_text_columns", f"""WITH s AS (SELECT 'text' AS "column", sum(length(text))::DOUBLE/count(*) FILTER (length(text)>0) AS m, count(DISTINCT text) AS d FROM documents UNION ALL SELECT 'lang', sum(length(lang))::DOUBLE/count(*) FILTER (length(lang)>0), count(DISTINCT lang) FROM documents
  UNION ALL SELECT 'source', sum(length(source))::DOUBLE/count(*) FILTER (length(source)>0), count(DISTINCT source) FROM documents) SELECT "column", {R('m')} AS mean_length, {N('d')} AS "distinct", CAST(row_number() OVER (ORDER BY m DESC, "column") AS BIGINT) AS place FROM s WHERE m>=4 AND d>=4""")
def _(t):
    out = en.text_columns(t.documents, ["text", "lang", "source"], mean_length=4, distinct=4)
    return rounded(out.select("column", "mean_length", "distinct", F.col("place").cast("long").alias("place")), "mean_length")


_SP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def _clean(c):
    un = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&amp;", "&")):
        un = f"replace({un}, '{a}', '{b}')"
    return f"trim(regexp_replace({un}, '{_SP}', ' ', 'g'), ' ')"


@query("E14_document_assembly", f"""WITH c AS (SELECT page_id, trim(regexp_replace(url, '{_SP}', ' ', 'g'), ' ') AS a, {_clean('html')} AS b FROM pages)
  SELECT page_id, md5(concat_ws(chr(10), CASE WHEN a<>'' THEN 'Field 1: '||a END, CASE WHEN b<>'' THEN 'Field 2: '||b END)) AS digest FROM c""")
def _(t):
    return t.pages.select("page_id", F.md5(en.document(["url", "html"])).alias("digest"))


@query("E15_canonical_cells", f"""SELECT event_id, '{{"k":'||json_extract(props, '$.k')||',"type":"'||event_type||'"}}' AS cell FROM events""")
def _(t):
    cell = F.struct(F.col("event_type").alias("type"), F.from_json("props", "k int")["k"].alias("k"))
    out = en.canonical_frame(t.events.select("event_id", cell.alias("cell")))
    return out
