"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvidex.llm import lm_score, mixing, ngram_join, packing, quality_clf, quality_rules, secrets, simhash, token_counts, toxicity
from corvidex.llm.oracles import ORACLES as ORACLES


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir), quality_clf.fold(F.col("doc_id"), 3) == 1
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    out = toxicity.score(docs.select("doc_id", "text"), machine)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic; background: all documents."""
    target = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir), target)


def op3_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(c, 9).alias(c) for c in quality_rules.RATES)
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir))


def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near (more): for every hundredth document, how many others lie within three bits of it."""
    rows = simhash.fingerprints(table(spark, sf_dir))
    rows = simhash.with_near(rows, F.col("doc_id") % 100 == 0)
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.hexed(F.col("fp")).alias("fingerprint"),
        simhash.hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        simhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        simhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )


def op6_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir))
    base = {k: F.col(k) for k in secrets.KINDS[:3]}
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(base | {"random": F.col("random")}).alias("spans"),
    )


def op7_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir), join=ngram_join.Join(words=3, percent=90))


def op8_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(table(spark, sf_dir))


def op9_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir), quality_clf.fold(F.col("doc_id"), 5) == 0
    weights = quality_clf.train(docs, table(spark, sf_dir, "labels"), ~held)
    out = quality_clf.score(docs.select("doc_id", "text"), weights)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_factorization_toxicity, op2_cross_entropy_difference, op3_host_quality_rules, op4_best_fit_packing, op5_simhash_fingerprints, op6_randomness_secrets, op7_partenum_jaccard, op8_edit_aware_counts, op9_ftrl_quality, op10_source_mix)}
