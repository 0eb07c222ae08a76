"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of ``documents``; the last adds the shard of each row.
SQL cannot express the language model, so there is no oracle; the tests hold
``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sifter.llm import decontaminate, jaccard, langid, mixing, sharding
from sifter.llm.common import boxed, written

#: near duplicates share four fifths of their five-word shingles
NEAR = jaccard.Rule(words=5, num=80, den=100)
MIX_SEED = 29
MIX = {"temperature": 0.7, "epochs": 2.0}
SHARD_BYTES = 32 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too) or without a trustworthy
    language go; ids play no part beyond the choice of training rows."""
    model = langid.learn(docs, langid.fold("doc_id", 5) != 0)
    rows = boxed(docs, text=F.col("text"))
    return langid.identify(rows, model).where("_langid.accepted").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays;
    rows that share an id count as documents of their own unless their texts are
    equal, rows without id are compared as well, texts without words all stay."""
    return jaccard.one_per_group(docs, NEAR)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a verbatim benchmark window go; null texts and rows without
    id have their own row and stay."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources (null is one) repeated to their target weights, shuffled globally.
    Rows that share an id share their number of copies; an empty table stays empty."""
    rows = boxed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text"))
    return mixing.mix(rows, MIX_SEED, keep=["_row"], **MIX).select("_row.*")


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of at most ``SHARD_BYTES``; rows that share an id
    lie in one shard as far as it holds them.  An empty table has no shard."""
    return sharding.shard(docs, SHARD_BYTES)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
