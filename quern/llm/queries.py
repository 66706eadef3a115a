"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, language_id, license_scan, line_dedup, quality_classifier, quality_rules, reshard, secret_scan, simhash_dedup
from quern.llm.oracles import ORACLES
from quern.session import table


def _id_remainder(by: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text").withColumnRenamed("text", "raw"), text_col="raw")
    ids = F.array_join(F.col("input_ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"), _sha(ids).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _id_remainder(3) == 1
    forest = quality_classifier.train(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    scored = quality_classifier.score(docs, forest).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = reshard.reshard(docs, reshard.shard_by_hash(), reshard.OLD_SHARDS, [1 / reshard.NEW_SHARDS] * reshard.NEW_SHARDS)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"), _sha(F.array_join(c["items"], ",")).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), _sha(secret_scan.listed("base")).alias("base_sha256"), secret_scan.listed("spans").alias("spans"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return judged.select("doc_id", *(F.col(f"quality.{c}").alias(c) for c in base))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _id_remainder(4) == 2
    net = language_id.train(docs, learn=~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), net).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.transform("places", lambda p: p["word"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("bigint").alias("kept_chars"), _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_quality_classifier, op3_reshard, op4_decontaminate, op5_secret_scan, op6_simhash_dedup, op7_quality_rules, op8_language_id, op9_license_scan, op10_line_dedup)
}
ORACLE_SQL: dict[str, str] = ORACLES
