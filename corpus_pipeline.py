"""The training-text pipeline: quality, toxicity, near duplicates, decontamination, packing.

Every stage takes the whole table that the one before it kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, packing, quality, toxicity
from tessera.llm.jaccard import jaccard_components
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import free, release, semi_by_id, shared_dir

#: Scores from which a document is good, and toxic.
GOOD, TOXIC = 0.3, 0.5


def _learn_on() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _learn_on())
    own = free(docs, "quality_score")
    return quality.score(docs, rules, own).where(F.col(own) >= GOOD).drop(own)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't find toxic."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _learn_on())
    own = free(docs, "toxic_score")
    return toxicity.score(docs, model, own).where(F.col(own) < TOXIC).drop(own)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents that are linked by 5-word shingles at 0.8.

    Rows of one doc_id stand or fall together; rows without a doc_id are in no group and stay.
    """
    groups = jaccard_components(docs, k=5, percent=80)
    return semi_by_id(docs, groups.where("doc_id != component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return semi_by_id(docs, leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned models and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark)
    return docs
