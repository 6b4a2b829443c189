"""Samples, splits and training support."""

from __future__ import annotations

from pyspark.sql import functions as F

from asofkit.operators import sampling as sp
from suite.families import HISTORY, label_history
from suite.registry import N, R, query, rounded

# Labelled examples: one row per customer and quarter.
EX = f"{HISTORY}, ex AS (SELECT entity, ts AS cutoff, available_at, y FROM hist)"
MD = "md5(concat_ws('|', entity, CAST(cutoff AS VARCHAR)))"


def examples(t):
    return label_history(t).withColumnRenamed("ts", "cutoff")


def _long(frame):
    return frame.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() == "integer" else F.col(f.name) for f in frame.schema.fields])


@query("T1_top_values", f"""WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1) SELECT 'value' AS rule, value, {N('n')} AS n, CAST(row_number() OVER (ORDER BY n DESC, value) AS BIGINT) AS place FROM c QUALIFY place<=3
  UNION ALL SELECT 'hash', value, n, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', value, '7')), value) AS place FROM c QUALIFY place<=3""")
def _(t):
    a = sp.top_values(t.part, "p_type", 3).select(F.lit("value").alias("rule"), "value", "n", "place")
    b = sp.top_values(t.part, "p_type", 3, "hash", 7).select(F.lit("hash").alias("rule"), "value", "n", "place")
    return _long(a.unionByName(b))


@query("T2_nested_sample", " UNION ALL ".join(f"SELECT {n}::BIGINT AS size, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', 'orders', '0', o_orderkey)), o_orderkey LIMIT {n})" for n in (500, 2000)))
def _(t):
    out = None
    for n in (500, 2000):
        x = sp.nested_sample(t.orders, ["o_orderkey"], n, "orders").select(F.lit(n).cast("long").alias("size"), "o_orderkey")
        out = x if out is None else out.unionByName(x)
    return out


@query("T3_identity_sample", f"WITH {EX} SELECT entity, cutoff, y FROM ex ORDER BY {MD}, entity, cutoff LIMIT 1000")
def _(t):
    return sp.identity_sample(examples(t), 1000, "entity", "cutoff").select("entity", "cutoff", "y")


def _stratified(scope, limit, source="ex"):
    part = f"PARTITION BY {scope}" if scope else ""
    keys = f"{scope}, y" if scope else "y"
    return f"""sz AS (SELECT {keys}, count(*) AS n{', any_value(quota) AS quota' if scope else f', {limit} AS quota'} FROM {source} GROUP BY {keys}), s1 AS (SELECT *, n*least(quota, sum(n) OVER ({part}))::DOUBLE/sum(n) OVER ({part}) AS sh, sum(n) OVER ({part}) AS tot FROM sz),
      s2 AS (SELECT *, floor(sh) AS fl, round(sh-floor(sh), 9) AS rest FROM s1), s3 AS (SELECT *, fl + (row_number() OVER ({part} ORDER BY rest DESC, y) <= least(quota, tot) - sum(fl) OVER ({part}))::INT AS take FROM s2),
      k AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {MD}, entity, cutoff) AS rn FROM {source})"""


@query("T4_stratified_budget", f"WITH {EX}, {_stratified('', 1500)} SELECT k.entity, k.cutoff, k.y FROM k JOIN s3 USING (y) WHERE rn<=take")
def _(t):
    return sp.stratified_budget(examples(t), "y", 1500, ["entity", "cutoff"]).select("entity", "cutoff", "y")


@query("T5_split_labels", f"""WITH {EX}, o AS (SELECT *, row_number() OVER (ORDER BY cutoff, CAST('0x'||substr({MD},1,8) AS BIGINT), entity) AS rn, count(*) OVER () AS n FROM ex)
  SELECT entity, cutoff, CASE WHEN rn<=greatest(1, least(n-1, round(n*0.8))) THEN 'train' ELSE 'validation' END AS split FROM o""")
def _(t):
    return sp.time_split(examples(t), "cutoff", 0.2, ["entity", "cutoff"]).select("entity", "cutoff", "split")


@query("T6_task_inference", f"""SELECT 'o_orderstatus' AS target, {N('count(DISTINCT o_orderstatus)')} AS classes, 'multiclass_classification' AS task FROM orders UNION ALL
  SELECT 'l_linestatus', count(DISTINCT l_linestatus), CASE WHEN count(DISTINCT l_linestatus)=2 THEN 'classification' ELSE 'multiclass_classification' END FROM lineitem""")
def _(t):
    a = sp.infer_task(t.orders, "o_orderstatus").select(F.lit("o_orderstatus").alias("target"), "*")
    return a.unionByName(sp.infer_task(t.lineitem, "l_linestatus").select(F.lit("l_linestatus").alias("target"), "*"))


_CO = f"{EX}, co AS (SELECT cutoff, count(*) AS rows, count(DISTINCT y) AS classes FROM ex GROUP BY 1), nu AS (SELECT *, row_number() OVER (ORDER BY cutoff)-1 AS place, count(*) OVER () AS total FROM co)"


def _spaced(src, limit):
    return f"SELECT cutoff, rows FROM {src}, (SELECT list((i*(t-1)+{(limit - 1) // 2})//{limit - 1}) AS w FROM (SELECT max(total) AS t FROM {src}) x, range({limit}) r(i)) WHERE total<={limit} OR list_contains(w, place)"


@query("T7_spaced_cutoffs", f"""WITH {_CO}, va AS (SELECT cutoff, rows, row_number() OVER (ORDER BY cutoff)-1 AS place, count(*) OVER () AS total FROM co WHERE classes>=2)
  SELECT 'spaced' AS rule, cutoff, {N('rows')} AS rows FROM ({_spaced('nu', 6)}) UNION ALL SELECT 'class_valid', cutoff, rows FROM ({_spaced('va', 6)})""")
def _(t):
    ex = examples(t)
    a = sp.spaced_cutoffs(sp.cohort_counts(ex), 6).select(F.lit("spaced").alias("rule"), "cutoff", "rows")
    b = sp.class_valid_cutoffs(ex, "y", 6).select(F.lit("class_valid").alias("rule"), "cutoff", "rows")
    return a.unionByName(b)


@query("T8_recent_and_stratified", f"""WITH {_CO}, re AS (SELECT cutoff, rows, row_number() OVER (ORDER BY cutoff)-1 AS place, count(*) OVER () AS total FROM co WHERE cutoff>=(SELECT max(cutoff) FROM co)-INTERVAL 1500 DAY),
  st AS (SELECT *, CASE WHEN place=total-1 THEN 6 ELSE floor(((place+1)*5-1)/(total-1)) END AS s FROM nu), sr AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(concat_ws('|', CAST(cutoff AS VARCHAR), '0')), cutoff) AS rn FROM st)
  SELECT 'recent' AS rule, cutoff, {N('rows')} AS rows FROM ({_spaced('re', 4)}) UNION ALL SELECT 'stratified', cutoff, rows FROM sr WHERE rn=1""")
def _(t):
    counts = sp.cohort_counts(examples(t))
    a = sp.spaced_cutoffs(counts, 4, recent_days=1500).select(F.lit("recent").alias("rule"), "cutoff", "rows")
    b = sp.stratified_cutoffs(counts, 6).select(F.lit("stratified").alias("rule"), "cutoff", "rows")
    return a.unionByName(b)


_QUOTA = "qx AS (SELECT ex.*, quota FROM ex JOIN (SELECT cutoff, 2000//total + (place < 2000%total)::INT AS quota FROM nu) USING (cutoff))"


@query("T9_frame_budget", f"WITH {_CO}, {_QUOTA}, {_stratified('cutoff', 2000, 'qx')} SELECT k.entity, k.cutoff, k.y FROM k JOIN s3 ON s3.cutoff=k.cutoff AND s3.y=k.y WHERE rn<=take")
def _(t):
    return sp.framed_sample(examples(t), "y", 2000, ["entity", "cutoff"]).select("entity", "cutoff", "y")


def _regime(limit):
    return f"""SELECT CASE WHEN h<>1 THEN 'multiple_validation_cutoffs' WHEN n<3 THEN 'insufficient_training_cutoffs' WHEN lo<100 THEN 'sparse_training_cutoff' WHEN s>{limit} THEN 'training_row_budget' ELSE 'three_cutoff_candidate' END AS reason, s, lo, hi FROM
      (SELECT count(*) AS n, min(rows) FILTER (p<3) AS lo, max(rows) FILTER (p<3) AS hi, sum(rows) FILTER (p<3) AS s FROM (SELECT *, row_number() OVER (ORDER BY cutoff DESC)-1 AS p FROM co WHERE cutoff<TIMESTAMP '2000-01-01')), (SELECT count(DISTINCT cutoff) AS h FROM ex WHERE cutoff=TIMESTAMP '2000-01-01')"""


@query("T10_fit_regime", f"WITH {_CO} " + " UNION ALL ".join(
    f"SELECT {b}::BIGINT AS budget, reason, CASE WHEN reason='three_cutoff_candidate' THEN 3 ELSE 1 END::BIGINT AS frames, CASE WHEN reason='three_cutoff_candidate' AND lo::DOUBLE/hi<0.5 THEN 'pooled' ELSE 'frame_ensemble' END AS mode, {N('s')} AS recent_rows FROM ({_regime(b)})" for b in (100, 100000, 100000000)))
def _(t):
    ex = examples(t)
    train, held = ex.filter("cutoff < timestamp_ntz'2000-01-01'"), ex.filter("cutoff = timestamp_ntz'2000-01-01'")
    out = None
    for b in (100, 100_000, 100_000_000):
        x = _long(sp.fit_regime(train, held, max_rows=b)).select(F.lit(b).cast("long").alias("budget"), "*")
        out = x if out is None else out.unionByName(x)
    return out


def _support(src, rows, frames, most, size="rows"):
    cap = f" AND f<{most}" if most else ""
    return f"SELECT cutoff, rows FROM (SELECT *, row_number() OVER (ORDER BY cutoff DESC)-1 AS f, coalesce(sum({size}) OVER (ORDER BY cutoff DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS r FROM {src}) WHERE (f<{frames} OR r<{rows}){cap}"


@query("T11_mature_history", f"""WITH {EX}, el AS (SELECT * FROM ex WHERE available_at<TIMESTAMP '2000-01-01'), co AS (SELECT cutoff, count(*) AS rows, least(count(*),120) AS kept FROM el GROUP BY 1),
  ch AS ({_support('co', 1500, 8, None, 'kept')}), k AS (SELECT el.*, row_number() OVER (PARTITION BY cutoff ORDER BY {MD}, entity) AS rn FROM el JOIN ch USING (cutoff)) SELECT entity, cutoff, y FROM k WHERE rn<=120""")
def _(t):
    return sp.mature_history_sample(examples(t), "2000-01-01", 8, 120, 1500).select("entity", "cutoff", "y")


@query("T12_training_support", f"""WITH {EX}, co AS (SELECT cutoff, count(*) AS rows FROM ex WHERE cutoff+INTERVAL 90 DAY<=TIMESTAMP '2000-01-01' GROUP BY 1) SELECT cutoff, {N('rows')} AS rows FROM ({_support('co', 3000, 2, 64)})""")
def _(t):
    return sp.training_support(examples(t), "2000-01-01", 90, 3000, 2).select("cutoff", "rows")


@query("T13_recency_weights", f"""WITH {EX}, w AS (SELECT *, pow(2, -(date_diff('microsecond', cutoff, (SELECT max(cutoff) FROM ex))/86400e6)/180) AS w FROM ex) SELECT entity, cutoff, {R('w/avg(w) OVER ()', 6)} AS weight FROM w""")
def _(t):
    return rounded(sp.recency_weights(examples(t), 180).select("entity", "cutoff", "weight"), places=6)


@query("T14_policy_support", f"""WITH {EX}, co AS (SELECT cutoff, count(*) AS rows FROM ex WHERE cutoff<TIMESTAMP '2000-01-01' AND cutoff+INTERVAL 90 DAY<=TIMESTAMP '2000-01-01' GROUP BY 1), re AS (SELECT * FROM co ORDER BY cutoff DESC LIMIT 3),
  ol AS (SELECT * FROM co WHERE cutoff<(SELECT min(cutoff) FROM re) AND cutoff+INTERVAL 90 DAY<=(SELECT min(cutoff) FROM re)) SELECT 'refit' AS role, cutoff, {N('rows')} AS rows FROM re UNION ALL SELECT 'initial', cutoff, rows FROM ({_support('ol', 1200, 2, 64)})""")
def _(t):
    return sp.policy_support(examples(t), "2000-01-01", 90, 3, 1200, 2).select("role", "cutoff", "rows")


_FOLDS = "fo AS (SELECT cutoff, cnt-1-back AS fold FROM (SELECT *, floor((total-1-place)/2) AS back, least(3, floor((total-2-1)/2)) AS cnt FROM nu) WHERE cnt>=2 AND back<cnt)"


@query("T15_retrospective_folds", f"""WITH {_CO}, {_FOLDS}, st AS (SELECT fold, min(cutoff)-INTERVAL 30 DAY AS b FROM fo GROUP BY 1), op AS (SELECT st.fold, co.*, row_number() OVER (PARTITION BY fold ORDER BY cutoff DESC) AS k FROM co JOIN st ON cutoff<b AND cutoff+INTERVAL 90 DAY<=b),
  fi AS (SELECT fold, min(cutoff) AS f FROM op WHERE k<=2 GROUP BY 1), ol AS (SELECT op.fold, op.cutoff, coalesce(sum(rows) OVER (PARTITION BY op.fold ORDER BY cutoff DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS r FROM op JOIN fi USING (fold) WHERE cutoff<f AND cutoff+INTERVAL 90 DAY<=f)
  SELECT CAST(fold AS BIGINT) AS fold, cutoff, role FROM (SELECT fold, cutoff, 'heldout' AS role FROM fo UNION ALL SELECT fold, cutoff, 'refit' FROM op WHERE k<=2 UNION ALL SELECT fold, cutoff, 'initial' FROM ol WHERE r<1000)""")
def _(t):
    return sp.required_cutoffs(examples(t), 2, 90, 30, 1000)


@query("T16_entity_folds", f"SELECT DISTINCT user_id AS entity, CAST(CAST('0x'||substr(md5(CAST(user_id AS VARCHAR)),1,8) AS BIGINT)%3 AS BIGINT) AS fold FROM events")
def _(t):
    return sp.entity_folds(t.user_events().select("entity").distinct())


@query("T17_grouped_split", f"""WITH g AS (SELECT DISTINCT source, lang FROM documents), fi AS (SELECT DISTINCT source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(source), source) AS rn FROM g WHERE lang IN ('en','de')) WHERE rn=1),
  n AS (SELECT source, row_number() OVER (ORDER BY (source IN (SELECT source FROM fi)) DESC, md5(source), source) AS p FROM (SELECT DISTINCT source FROM g)) SELECT doc_id, source, CASE WHEN p<=4 THEN 'test' WHEN p<=7 THEN 'validation' ELSE 'train' END AS split FROM documents JOIN n USING (source)""")
def _(t):
    docs = t.documents.select("doc_id", "source", "lang")
    return sp.grouped_split(docs, "source", "lang", ["en", "de"], validation=3, test=4).select("doc_id", "source", "split")
