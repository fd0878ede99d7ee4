"""Mixing sources to target weights: hash-random order, range buckets, distributed prefix sums, exact cuts.

Each row gets a hash-random key. The key's range is cut into 65,536 buckets; rows meet in (source, bucket), so a source
that holds most rows is spread over all of them. A bucket's total and the running total over a source's buckets (at most
65,536 rows) give each row the words that stand before it in its source, and the source's exact budget cuts there: whole
epochs first, then rows in key order, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .blocks import hidden

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """_src, source_size -> with target: share of all sizes by weight, none above cap times its size, the excess reshared.

    Sources in order of their names take the weights in turn. Resharing until no target is above its cap comes to one
    level: target = least(cap, level x weight). In order of cap / weight, the level is the one at the first source that
    stays below its cap when all before it are at theirs. One row per source passes here, and no text.
    """
    order, every = W.orderBy("_src"), W.partitionBy()
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
    by = W.orderBy(F.col("_cap") / F.col("_w"), "_src")
    s = s.withColumn("_before", F.coalesce(F.sum("_cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(by.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_src", "_level"))).over(every)["_level"])
    return s.select("_src", "source_size", F.least(F.col("_cap"), F.coalesce("_level", F.lit(0.0)) * F.col("_w")).alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted).

    Sources are ordered by code point, null last and a source of its own. Within a source, rows are ordered by the MD5 of
    the id, the id and the size, so that reruns agree; rows equal in all three are interchangeable. A source's taken words
    are its target, rounded down. Defined cases: a null text has no words; a null id takes the place of an empty one; a
    source without words has target 0; an empty table gives an empty table; other columns pass through, but for columns of
    the added names, which are replaced.
    """
    new = ("size", "source_size", "target", "taken")
    docs, (text, source, doc_id), back = hidden(docs, text, source, doc_id)
    names = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    key = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary"))
    d = docs.select(*names, word_count(F.col(f"`{text}`")).alias("size"), F.struct(F.col(f"`{source}`").isNull().alias("n"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("s")).alias("_src"), key.alias("_key"))
    return _cut(d, names, doc_id, weights, share, cap).withColumnsRenamed(back)


def _cut(d: DataFrame, names: list, doc_id: str, weights, share, cap) -> DataFrame:
    dealt = d.withColumn("_bucket", F.substring("_key", 1, 4)).repartition("_src", "_bucket")
    sums = dealt.groupBy("_src", "_bucket").agg(F.sum("size").alias("_n"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("_src").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(sums.groupBy("_src").agg(F.sum("_n").alias("source_size")), weights=weights, share=share, cap=cap)
    cuts = sums.join(targets, "_src").drop("_n")
    inside = W.partitionBy("_src", "_bucket").orderBy("_key", f"`{doc_id}`", "size").rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(cuts, ["_src", "_bucket"])
    goal, whole = F.floor("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    rest = goal % whole - F.col("_base") - F.col("_in")
    taken = F.floor(goal / whole).cast("long") * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return out.select(*names, "size", "source_size", "target", taken.alias("taken"))
