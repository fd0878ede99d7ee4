"""Cutting lineage in the shared checkpoint folder, and connected components, which need it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, on storage that all executors share. Only a session on one
    machine (as in tests) may name none: it gets a folder of its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df dealt evenly to tasks of about `rows` rows, two a core at least: for small files whose rows take long each, of which few tasks
    would else read all."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def join_hint(df: DataFrame, most: int = 4_000_000) -> str:
    """The hint for df as the smaller side of a join: broadcast if its rows have `most` characters at most, counted as JSON; else
    merge. Of a df that was exploded or read from a checkpoint Spark may guess far too little, and what it broadcasts passes the driver."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return "broadcast" if size <= most else "merge"


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for the ids in links (a, b): large-star and small-star steps until every id but the roots has one
    edge, to its root."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        up = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root"))
        down = edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root"))
        ends = up.unionByName(down).groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.where("up > 1 or (up = 1 and root = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
