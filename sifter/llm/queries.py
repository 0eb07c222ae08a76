"""One query per operator over the driver's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from sifter.llm import decontaminate, jaccard, langid, lm, merkle, mixing, oracle, quality, secrets, sharding, spelling, tokens, topk, warc
from sifter.llm.common import scratch_path

PIECES = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")
SHARD_BYTES = 32 << 20
MIX = {"temperature": 0.5, "epochs": 1.0}
MIX_SEED = 13
WORDS = spelling.Rule(letters=5, times=3, ratio=2, typo=97)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), tokens.load_pieces(PIECES))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.learn(docs, langid.fold("doc_id", 5) != 0)
    return langid.identify(docs, model).select(
        "doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "_langid.lang_pred", "_langid.score", "_langid.accepted")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), SHARD_BYTES, keep=["doc_id"])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"), jaccard.Rule(words=4, num=85, den=100))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_matches(docs, _read(spark, sf_dir, "benchmark"), window=10)
    ids = decontaminate.item_ids(F.col("_matches"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), decontaminate.n_hit(F.col("_matches")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_matches") > 0).alias("contaminated"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("_spans")
    return found.select(
        "doc_id", *[secrets.count_kind(spans, k).alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(secrets.joined(secrets.base_only(spans)).cast("binary"), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = langid.fold("doc_id", 10)
    role = F.when(part == 0, lm.SCORED).when(part == 1, lm.TUNED).otherwise(lm.FITTED)
    scored = lm.score_texts(_read(spark, sf_dir, "documents"), role)
    return scored.select("doc_id", (part == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.archive_pages(_read(spark, sf_dir, "pages"), path, min_bytes=1000)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), MIX_SEED, keep=["doc_id", "source"], **MIX)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(langid.fold("doc_id", 5) == 0, lowered).otherwise(F.col("text"))
    manifest = merkle.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], group_col="source", order_col="doc_id", changed={"text": tampered})
    return merkle.proofs(manifest).select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256",
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, _read(spark, sf_dir, "labels"), langid.fold("doc_id", 5) != 0)
    return quality.score(docs, model).select(
        "doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), F.col("_quality").alias("score"),
        (F.col("_quality") >= 0.3).cast("int").alias("predicted"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"), WORDS)


QUERIES = {f.__name__: f for f in (op1_topk, op2_token_counts, op3_language_id, op4_sharding, op5_jaccard_join, op6_decontamination, op7_secrets, op8_lm_scoring, op9_warc, op10_mixing,
                                  op11_merkle, op12_quality, op13_spelling)}

ORACLE = {
    "op1_topk": oracle.topk_sql(50, 5),
    "op4_sharding": oracle.sharding_sql(SHARD_BYTES),
    "op5_jaccard_join": oracle.jaccard_sql(4, 85, 100),
    "op6_decontamination": oracle.decontamination_sql(10),
    "op9_warc": oracle.warc_sql(1000),
    "op10_mixing": oracle.mixing_sql(MIX_SEED, **MIX),
    "op11_merkle": oracle.merkle_sql(),
    "op13_spelling": oracle.spelling_sql(WORDS.letters, WORDS.times, WORDS.ratio, WORDS.typo),
}
