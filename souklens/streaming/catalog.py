"""Streams over landed files: progress of scans, and sightings folded into products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from souklens.sources.structured import extract_pages, page_products


def landed(spark: SparkSession, path: str, glob: str = "*.parquet", files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema they have now."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(path)


def stream_progress(events: DataFrame, *, scope: str = "user_id", delay: str = "1 hour", width: str = "1 day", ts: str = "ts") -> DataFrame:
    """Events and their kinds per scope and window, closed by a watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), scope).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def stream_dedupe(sightings: DataFrame, fields: list[str], *, key: str, seq: str) -> DataFrame:
    """The surest value of each field per key so far (update or complete mode): the aggregate keeps value, confidence and
    place, so the result doesn't depend on the order in which sightings arrive."""
    best = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(f"{f}_conf", -F.col(seq)))).alias(f) for f in fields]
    return sightings.groupBy(key).agg(*best, F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("n"))


def stream_extract(pages: DataFrame, **options) -> DataFrame:
    """Products and variations of a stream of pages (page_id, url, html), each page read within its row as in a batch: append mode,
    no state, nothing moved between tasks. Not verified: no run of it has been seen to its end (README)."""
    return page_products(extract_pages(pages, **options))


def run_to_end(stream: DataFrame, out: str, checkpoint: str, *, mode: str = "append") -> None:
    """Reads what has landed and stops; a rerun goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
