"""A corpus pipeline over ``documents``: each stage reads what the one before it kept, from a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamloom.llm.common import written
from streamloom.llm.decontaminate import decontamination_stage
from streamloom.llm.language_id import language_stage
from streamloom.llm.near_dedup import dedup_stage
from streamloom.llm.packing import packing_stage
from streamloom.llm.secret_scan import secret_stage

STAGES = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: Tokenisation and the models have no SQL; the pipeline is tested against a brute-force version (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(docs), sf_dir)
    return docs
