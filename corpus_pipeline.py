"""Training-corpus pipeline: language ID, exact dedup, near-dedup, source mixing and sequence packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Stages are written as Parquet
and read again, so a lost executor never reaches back beyond the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgrid.llm import stages
from inkgrid.llm.common import Store, prepare

STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.exact_dedup),
    ("simhash_near_dedup", stages.near_dedup),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

#: Suffix-automaton parses and fingerprints have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(prepare(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = store.put(stage(spark, docs, sf_dir), name)
        if i:
            store.drop(STAGES[i - 1][0])
    return docs
