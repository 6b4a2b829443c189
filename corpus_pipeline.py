"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage reads what the one before it wrote and works on all of it; ``run`` writes every stage's rows to
the shared folder. Stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofkit.llm import line_join, mixing, ngram_join, pattern_packing, rule_ledger
from asofkit.llm.shared import stored

STAGES = [
    ("quality_rules", rule_ledger.stage),
    ("line_dedup", line_join.stage),
    ("near_duplicates", ngram_join.stage),
    ("mixing", mixing.stage),
    ("packing", pattern_packing.stage),
]

#: Token ids cannot be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
