"""A corpus through five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import shared_dir, table
from sparkloom.llm.jaccard_join import pipeline_dedup
from sparkloom.llm.mixing import pipeline_mix
from sparkloom.llm.packing import pipeline_pack
from sparkloom.llm.pii import pipeline_pii
from sparkloom.llm.toxicity import pipeline_toxicity

#: Rejected documents go; one of each group of near copies stays; personal data is masked; sources are mixed; the rest is packed.
STAGES = [
    ("toxicity", pipeline_toxicity),
    ("ngram_jaccard_join", pipeline_dedup),
    ("pii", pipeline_pii),
    ("mixing", pipeline_mix),
    ("packing", pipeline_pack),
]

#: Scores, sampled paths and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/sparkloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
