"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents:

toxicity          documents that the classifier scores at its threshold or above go
line_dedup        lines that an earlier document holds go from the texts
near_dedup        of each group of linked fingerprints the document with the smallest doc_id stays
decontamination   documents that hold a passage of a benchmark item go
mixing            documents that the mix takes words of stay, with size, source_size, target and taken
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fragloom.llm import decontamination, line_dedup, mixing, simhash, toxicity
from fragloom.llm.common import shared_folder, table

#: SQL has no word for the classifier, the 64-bit fingerprints or the edit distance within texts.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; the tables between them lie in the shared folder."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
