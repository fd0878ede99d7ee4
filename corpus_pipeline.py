"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from souklens.llm.blocks import settled
from souklens.llm.mixing import WORD, mix_sources
from souklens.llm.near_dup import near_groups, node_of
from souklens.llm.pieces import digests, encode_pieces
from souklens.llm.quality import quality_verdicts
from souklens.llm.substring_rlz import rlz_dedup

#: Five-word shingles. 48 bands of 5: a pair at exactly 0.80 shares none with odds of about 5e-9 (with op3's 40 of 6, 5e-6).
NEAR = {"percent": 80, "rows": 5}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_verdicts(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity of 0.8 or more): of the smallest id, if there is one. Groups are made by
    id and text, so rows without an id are told apart; rows of the same id and text stay once. Texts without words are no copies."""
    found = near_groups(docs, **NEAR).where("first").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("size"))
    found = settled(found.select(F.col("node").alias("_node"), ((F.col("n") > 1) & (F.col("size") > 0)).alias("_again")))
    d = docs.select(*COLUMNS).withColumn("_node", node_of())
    out = d.join(found.where("not _again"), "_node", "left_semi")
    again = found.where("_again")
    if not again.isEmpty():
        out = out.unionByName(d.join(again, "_node", "left_semi").dropDuplicates(["_node"]))
    return out.select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; a document of which nothing is left stays, empty."""
    out = rlz_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last copy of a document at a source's cut ends at the budget."""
    d = mix_sources(docs.select(*COLUMNS)).where("taken > 0")
    d = d.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))))
    words = F.least("size", F.col("taken") - (F.col("_copy") - 1) * F.col("size")).cast("int")
    text = F.when(words < F.col("size"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, words), " ")).otherwise(F.col("text"))
    return d.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row."""
    out = encode_pieces(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", "source", *digests(out))


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("substring dedup", passages), ("mixing", mixing), ("sentencepiece", tokens)]

#: The SentencePiece stage can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
