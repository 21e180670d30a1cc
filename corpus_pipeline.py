"""A training-corpus pipeline in four stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents: poor documents go, toxic ones go, one document of each near-duplicate group stays, and the
rest is packed into bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborlight.llm.common import materialize, table
from harborlight.llm.op04_toxicity_chain import keep_civil
from harborlight.llm.op06_ngram_jaccard import one_of_each
from harborlight.llm.op07_best_fit_packing import pack_stage
from harborlight.llm.op10_quality_nbsvm import keep_good

STAGES = [("quality", keep_good), ("toxicity", keep_civil), ("near_duplicates", one_of_each), ("packing", pack_stage)]

#: The classifiers and the packing can't be written in SQL; tests/llm holds the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
