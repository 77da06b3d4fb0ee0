"""A training corpus from `documents`: five stages, each written as Parquet and reread by the next.

toxicity            documents scored 0.7 or more go
line dedup          repeated multi-line chunks are cut out; a document of which nothing is left goes
n-gram Jaccard join one document (the smallest id) of each group of near copies stays
decontamination     spans shared with the benchmark are cut out; a document mostly made of them goes
packing             what is left is tokenised and packed; the rows are pieces of windows
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mediagrain.llm.components import new_folder, removed
from mediagrain.llm.decontaminate import decontaminate
from mediagrain.llm.line_dedup import dedup_lines
from mediagrain.llm.packing import pack
from mediagrain.llm.shingle_join import keep_one
from mediagrain.llm.toxicity import drop_toxic


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Trained, iterative and tokenising stages can't be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table is dropped once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
