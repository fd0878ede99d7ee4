"""Unique keys: SKUs and handles, in the order of the rows, with -2, -3, ... for repeats."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from souklens.functions.text import canonical_url, let, short_hash, slugify
from souklens.plans.lineage import settled


def _suffix_group(table: pa.Table) -> pa.Table:
    keys = table.select(["_late", "seq", "_candidate", "_key"]).to_pandas().sort_values(["_late", "seq"], kind="stable")
    taken, last, out = set(), {}, [""] * len(keys)
    for row, c, key in zip(keys.index.tolist(), keys["_candidate"], keys["_key"], strict=True):
        k = last.get(key, 1)  # names are never given back, so the search goes on where it ended
        tail = "" if k == 1 else f"-{k}"
        while key + tail in taken:
            k += 1
            tail = f"-{k}"
        last[key] = k
        taken.add(key + tail)
        out[row] = c + tail
    return table.append_column("unique", pa.array(out, pa.string()))


def unique_in_order(rows: DataFrame, candidate: str, *, scope: list[str] | None = None, late: str | None = None, fold_case: bool = False) -> DataFrame:
    """rows (with a seq) and unique: each candidate as it is if it is free, else with the first free suffix. fold_case: names that
    differ only in case are the same.

    A candidate can only meet candidates that are its root and a number. Roots are found by taking a last number off while
    what remains is a candidate itself. Where no candidate of a root ends in a number, the suffix is a row number, native
    and spread by the candidate; only roots with both go to a group function, each whole to one task. Candidates are read once for the
    distinct ones, and once more to be numbered. Rows without a candidate or scope are left out.
    """
    scope = scope or []
    d = rows.withColumns({"_candidate": F.col(candidate), "_key": F.lower(candidate) if fold_case else F.col(candidate), "_late": F.col(late).cast("int") if late else F.lit(0)})
    d = d.where(reduce(and_, [F.col(c).isNotNull() for c in (*scope, "_key")]))
    roots = settled(d.select(*scope, "_key").distinct().withColumn("_root", F.col("_key")))
    names = roots.select(*scope, F.col("_key").alias("_stem"), F.lit(True).alias("_is"))
    numbered = F.regexp_extract("_root", r"^(.+)-\d+$", 1)
    while True:
        step = settled(roots.withColumn("_stem", numbered).join(names, [*scope, "_stem"], "left"))
        if step.where("_is").isEmpty():
            break
        roots = step.select(*scope, "_key", F.when(F.col("_is"), F.col("_stem")).otherwise(F.col("_root")).alias("_root"))
    n = F.row_number().over(W.partitionBy(*scope, "_key").orderBy("_late", "seq"))
    native = F.when(n == 1, F.col("_candidate")).otherwise(F.concat("_candidate", F.lit("-"), n.cast("string")))
    mixed = roots.where("_root <> _key").select(*scope, "_root").distinct()
    if mixed.isEmpty():
        return d.withColumn("unique", native).drop("_candidate", "_key", "_late")
    d = d.join(roots.join(mixed, [*scope, "_root"]), [*scope, "_key"], "left")
    few = d.where("_root is not null")
    fixed = few.groupBy(*scope, "_root").applyInArrow(_suffix_group, T.StructType([*few.schema, T.StructField("unique", T.StringType())]))
    return d.where("_root is null").withColumn("unique", native).unionByName(fixed).drop("_candidate", "_key", "_late", "_root")


def parent_sku(url: Column, prefix: str = "P123") -> Column:
    return F.concat(F.lit(prefix + "-"), short_hash(canonical_url(url)))


def variation_sku(parent: Column, values: Column, ascii_only: bool = False) -> Column:
    """PARENT-slug of the values; a hash where there is no slug, and for the tail of one of more than 40 characters."""
    joined = F.trim(F.array_join(values, " "))
    tail = F.when(joined == "", short_hash(parent, 6)).otherwise(slugify(joined, ascii_only, 6))
    tail = F.when(tail == "", short_hash(joined, 6)).otherwise(tail)
    tail = F.when(F.length(tail) > 40, F.concat(F.substring(tail, 1, 33), F.lit("-"), short_hash(joined, 6))).otherwise(tail)
    return F.concat(parent, F.lit("-"), tail)


def assign_skus(products: DataFrame, *, prefix: str = "P123", ascii_only: bool = False, scope: list[str] | None = None) -> DataFrame:
    """products with sku_out, sku_generated, sku_changed; parents first, then variations, unique by suffixes (case counts).

    A parent has its own SKU, else PREFIX-hash of its canonical URL. A variation has its own, else its parent's with a slug of its
    attribute values (attribute_values, if there is such a column); its parent_sku, where blank, is that of the last parent with
    the same canonical URL."""
    scope = scope or []
    own = F.when(F.trim("sku") != "", F.trim("sku"))
    d = products.withColumns({"_own": own, "_url": canonical_url(F.col("source_url"))})
    parents = d.where("kind <> 'variation'").withColumn("_c", F.coalesce("_own", parent_sku(F.col("source_url"), prefix))).withColumn("_late", F.lit(0))
    kids = d.where("kind = 'variation'")
    values = F.col("attribute_values") if "attribute_values" in products.columns else F.array().cast("array<string>")
    parents = settled(parents)
    done = unique_in_order(parents, "_c", scope=scope).withColumnRenamed("unique", "sku_out")
    by_url = done.groupBy(*scope, "_url").agg(F.max_by("sku_out", "seq").alias("_by_url"))
    kids = kids.join(by_url, [*scope, "_url"], "left").withColumn("parent_sku", F.coalesce(F.when(F.trim("parent_sku") != "", F.trim("parent_sku")), "_by_url")).drop("_by_url")
    kids = kids.withColumn("_c", F.coalesce("_own", variation_sku(F.coalesce("parent_sku", parent_sku(F.col("source_url"), prefix)), values, ascii_only))).withColumn("_late", F.lit(1))
    every = settled(parents.unionByName(kids).withColumnRenamed("_late", "_v"))  # read five times below
    out = unique_in_order(every, "_c", scope=scope, late="_v").withColumnRenamed("unique", "sku_out")
    return out.withColumns({"sku_generated": F.col("_own").isNull(), "sku_changed": F.col("sku_out") != F.col("_c")}).drop("_c", "_v", "_own", "_url")


def base_handle(prefix: str | None = None) -> Column:
    """The handle that a product would have if all were free: a-z, 0-9 and dashes, at most 255."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    pick = lambda c: let(clean(slugify(c, True, 10)), lambda v: F.when(v != "", v))
    base = F.coalesce(pick(F.col("name")), pick(F.col("sku")), short_hash(F.col("source_url"), 12))
    base = base if prefix is None else F.concat(clean(F.lit(prefix)), F.lit("-"), base)
    return F.regexp_replace(F.substring(base, 1, 255), "-+$", "")


def number_handles(d: DataFrame, *, scope: list[str] | None = None, tries: str | None = None) -> DataFrame:
    """d with handle, unique, in place of its base_handle _h."""
    d = unique_in_order(d, "_h", scope=scope).withColumnRenamed("unique", "handle")
    if tries is not None:
        suffix = F.substring(F.col("handle"), F.length("_h") + 2, F.length("handle"))
        d = d.withColumn(tries, F.when(F.col("handle") == F.col("_h"), 0).otherwise(suffix.try_cast("long") - 1).cast("long"))
    return d.drop("_h")


def assign_handles(products: DataFrame, *, prefix: str | None = None, scope: list[str] | None = None, tries: str | None = None) -> DataFrame:
    """Parents with handle: slug of the name (a hash of it where the slug isn't ASCII), else of the SKU, else a hash of the URL;
    a-z, 0-9 and dashes, at most 255, unique. tries names a column for the number of taken names before the one found."""
    d = settled(products.where("kind <> 'variation'").withColumn("_h", base_handle(prefix)))  # slugs take longest, and are read twice below
    return number_handles(d, scope=scope, tries=tries)
