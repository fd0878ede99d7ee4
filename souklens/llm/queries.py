"""The numbered queries: each applies its operator to the whole of its table and digests what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .licenses import scan_licenses
from .lm_score import lm_scores
from .manifest import folded, manifest, proof_digest
from .media_tiff import LAYOUTS, read_tiff, store_as_tiff
from .mixing import mix_sources
from .near_dup import near_duplicates
from .pieces import digests, encode_pieces
from .quality import quality_verdicts
from .substring_bwt import bwt_dedup
from .substring_rlz import rlz_dedup
from .token_align import align_tokens
from .token_counts import token_counts
from .wrappers import extract_main_text


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = store_as_tiff(_read(spark, sf_dir, "documents").select("doc_id", "text"), layouts=LAYOUTS)
    read = read_tiff(files.select("doc_id", "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")))
    read = read.withColumn("payload", F.reduce("pages", F.lit(b""), lambda all_, page: F.concat(all_, page["pixels"])))
    return read.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", F.size("pages").alias("n_pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_join(F.array_sort(F.array_distinct("base.label")), ",")
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"), base.alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op5_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_pieces(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *digests(out))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _read(spark, sf_dir, "labels"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)


def tampered() -> Column:
    """What a holder says that the text is: where 3 divides the id's CRC-32, with A-Z in lower case."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(_read(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id", {"text": tampered()})
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rlz_dedup": op1_rlz_dedup,
    "op2_tiff_pages": op2_tiff_pages,
    "op3_minhash": op3_minhash,
    "op4_license_scan": op4_license_scan,
    "op5_wrapper_text": op5_wrapper_text,
    "op6_lm_score": op6_lm_score,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality_rules": op9_quality_rules,
    "op10_bwt_dedup": op10_bwt_dedup,
    "op11_token_align": op11_token_align,
    "op12_token_counts": op12_token_counts,
    "op13_merkle_manifest": op13_merkle_manifest,
}
