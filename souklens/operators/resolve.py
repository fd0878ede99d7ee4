"""Claims to products: arg-max per field, price pairs, sightings of one product, parents and their variations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from souklens.functions.text import canonical_url, fold_for_compare
from souklens.plans.lineage import connected, settled


def resolve_claims(claims: DataFrame, key: str = "product_key") -> DataFrame:
    """(key, field, value, confidence, source): the surest claim of each field; of equal ones the earliest. Blank values never win."""
    d = claims.where(F.col("value").isNotNull() & (F.trim(F.col("value").cast("string")) != ""))
    best = F.max_by(F.struct("value", "confidence", "source"), F.struct("confidence", -F.col("seq")))
    return d.groupBy(key, "field").agg(best.alias("b")).select(key, "field", "b.*")


def resolve_wide(claims: DataFrame, fields: list[str], key: str = "product_key") -> DataFrame:
    """One row per product with a column for each field and the map of confidences."""
    pick = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.struct("confidence", -F.col("seq"))))
    d = claims.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    sure = [F.struct(F.lit(f).alias("f"), F.max(F.when(F.col("field") == f, F.col("confidence"))).alias("c")) for f in fields]
    d = d.groupBy(key).agg(*[pick(f).alias(f) for f in fields], F.array(*sure).alias("_c"))
    return d.withColumn("field_confidence", F.map_from_entries(F.filter("_c", lambda x: x["c"].isNotNull()))).drop("_c")


def resolve_price_pair(claims: DataFrame, key: str = "product_key") -> DataFrame:
    """claims (key, regular, sale, confidence, seq) to one pair: both move together; a sale not below regular goes; a lone sale is the price."""
    best = F.max_by(F.struct("regular", "sale"), F.struct("confidence", -F.col("seq")))
    d = claims.where("regular is not null or sale is not null").groupBy(key).agg(best.alias("p"))
    regular, sale = F.col("p.regular"), F.col("p.sale")
    return d.select(key, F.coalesce(regular, sale).alias("regular"), F.when(sale < regular, sale).alias("sale"))


def product_key(url: Column, kind: Column | None = None, sku: Column | None = None, attributes: Column | None = None, name: Column | None = None) -> Column:
    """The canonical URL; for a variation with # and its folded SKU, else its sorted axis=value list, else its folded name."""
    if kind is None:
        return canonical_url(url)
    axes = F.transform(F.filter(attributes, lambda a: a["is_variation_axis"]), lambda a: F.concat(fold_for_compare(a["name"]), F.lit("="), fold_for_compare(F.array_join(a["values"], "|"))))
    own = F.coalesce(F.when(sku != "", fold_for_compare(sku)), F.when(F.size(axes) > 0, F.array_join(F.array_sort(axes), "&")), fold_for_compare(name))
    return F.when(kind == "variation", F.concat(canonical_url(url), F.lit("#"), own)).otherwise(canonical_url(url))


def _first_keys(table: pa.Table) -> pa.Table:
    """For each sighting of one component, in order, the key that it is folded into: its own if seen, else that of its SKU, else its own."""
    rows = table.select(["seq", "_key", "_sku"]).to_pandas().sort_values("seq", kind="stable")
    seen, by_sku, out = set(), {}, [None] * len(rows)
    for at, key, sku in zip(rows.index.tolist(), rows["_key"], rows["_sku"], strict=True):
        to = key if key in seen or not sku else by_sku.get(sku, key)
        seen.add(to)
        if sku:
            by_sku.setdefault(sku, to)
        out[at] = to
    return table.append_column("product_key", pa.array(out, pa.string()))


def alias_by_sku(sightings: DataFrame, *, scope: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """sightings (kind, sku, _key) with product_key: a parent under a new key whose folded SKU was seen joins that earlier product.

    Only SKUs that stand under several keys need the sightings in order; those keys and SKUs form components, each of which is
    read in order by one task. Everything else keeps its key, without a shuffle by component."""
    scope = scope or []
    d = sightings.withColumn("_sku", F.when((F.col("kind") != "variation") & (F.col("sku") != ""), fold_for_compare(F.col("sku"))))
    pairs = d.where("_sku is not null").select(*scope, "_key", "_sku").distinct()
    shared = pairs.groupBy(*scope, "_sku").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = pairs.join(pairs.join(shared, [*scope, "_sku"]).select(*scope, "_key").distinct(), [*scope, "_key"], "left_semi")
    node = lambda c: F.xxhash64(F.lit(c), *scope, c)
    label = connected(pairs.select(node("_key").alias("a"), node("_sku").alias("b")))
    d = d.withColumn("_node", node("_key")).join(label.withColumnRenamed("id", "_node"), "_node", "left").drop("_node")
    plain = d.where("component is null").withColumn("product_key", F.col("_key"))
    few = d.where("component is not null").withColumn("seq", F.col(seq)) if seq != "seq" else d.where("component is not null")
    fixed = few.groupBy("component").applyInArrow(_first_keys, T.StructType([*few.schema, T.StructField("product_key", T.StringType())]))
    return plain.unionByName(fixed.select(*plain.columns)).drop("component", "_sku")


def dedupe_products(sightings: DataFrame, fields: list[str], *, scope: list[str] | None = None, url: str = "url", seq: str = "seq") -> DataFrame:
    """One row per product of a scope: each field from its surest sighting (`<field>_conf`, null as -1), ties from the first.

    Adds product_key, first_seq and duplicates (sightings folded in). Fields with no value never win. Where sightings have kind,
    sku, attributes and name, variations have keys of their own, and parents are also found by their SKU.
    """
    scope = scope or []
    if {"kind", "sku", "attributes", "name"} <= set(sightings.columns):
        d = sightings.withColumn("_key", product_key(F.col(url), F.col("kind"), F.col("sku"), F.col("attributes"), F.col("name")))
        d = alias_by_sku(d, scope=scope, seq=seq)
    else:
        d = sightings.withColumn("product_key", product_key(F.col(url)))
    conf = lambda f: F.coalesce(F.col(f"{f}_conf"), F.lit(-1.0)) if f"{f}_conf" in sightings.columns else F.lit(-1.0)
    best = [F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(conf(f), -F.col(seq)))).alias(f) for f in fields]
    return d.groupBy(*scope, "product_key").agg(*best, F.min(seq).alias("first_seq"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def link_variations(rows: DataFrame, *, scope: list[str] | None = None, last: bool = True) -> DataFrame:
    """Variations with parent_key: the stated parent_sku, if a parent has it, else the parent with the same canonical URL (the last one, or the first)."""
    scope = scope or []
    parents, kids = rows.where("kind <> 'variation'"), rows.where("kind = 'variation'")
    pick = F.max_by if last else F.min_by
    by_url = parents.groupBy(*scope, canonical_url(F.col("source_url")).alias("_u")).agg(pick("sku", "seq").alias("_by_url"))
    by_sku = parents.where("trim(sku) <> ''").select(*scope, F.col("sku").alias("_s")).distinct().withColumn("_by_sku", F.col("_s"))
    d = kids.withColumns({"_u": canonical_url(F.col("source_url")), "_s": F.trim("parent_sku")})
    d = d.join(by_sku, [*scope, "_s"], "left").join(by_url, [*scope, "_u"], "left")
    return d.withColumn("parent_key", F.coalesce("_by_sku", "_by_url")).drop("_u", "_s", "_by_sku", "_by_url")


def orphan_variations(linked: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): variations without a parent are kept or not, and always reported."""
    issues = linked.where("parent_key is null").select(F.lit("warning").alias("severity"), F.lit("variation-orphaned").alias("code"), "sku", "source_url")
    return (linked if keep else linked.where("parent_key is not null")), issues


def category_paths(products: DataFrame, tree: DataFrame) -> DataFrame:
    """(product_id, category_path): of a product's categories (product_id, term, pos and name, if there is one) the deepest of the
    tree (id, parent, name), the first of equals, from the root down. Terms that the tree lacks have no depth; where a product's
    choice is one of them, its own name is the path. The tree is walked level by level until no term is left; terms of a cycle
    are never reached."""
    known = tree.select(F.col("id").alias("child"), "parent", "name")
    tops = known.join(tree.select(F.col("id").alias("parent")), "parent", "left_anti")
    level = settled(tops.select(F.col("child").alias("id"), F.array("name").alias("path")))
    every = level
    while not level.isEmpty():
        level = settled(known.join(level, known["parent"] == level["id"]).select(F.col("child").alias("id"), F.concat("path", F.array("name")).alias("path")))
        every = every.unionByName(level)
    own = F.col("name") if "name" in products.columns else F.lit(None).cast("string")
    d = products.select("product_id", "term", "pos", own.alias("_name")).join(every, products["term"] == every["id"], "left")
    best = F.max_by(F.struct("path", "_name"), F.struct(F.coalesce(F.size("path"), F.lit(0)), -F.col("pos")))
    d = d.groupBy("product_id").agg(best.alias("b"))
    return d.select("product_id", F.coalesce("b.path", F.when(F.col("b._name").isNotNull(), F.array("b._name"))).alias("category_path"))


def category_ids(wanted: DataFrame, tree: DataFrame) -> DataFrame:
    """wanted (slug) with term: an all-digit slug is the id itself, any other that of the term with this slug."""
    terms = tree.groupBy(F.col("slug")).agg(F.min("id").alias("_id"))
    return wanted.join(terms, "slug", "left").withColumn("term", F.when(F.col("slug").rlike(r"^\d+$"), F.col("slug").try_cast("long")).otherwise(F.col("_id"))).drop("_id")


def translate_terms(variations: DataFrame, terms: DataFrame) -> DataFrame:
    """Slugs of variations (parent, attribute, slug) as the parent's display names; unknown slugs stay, null means any and goes."""
    t = terms.select("parent", "attribute", "slug", F.col("name").alias("_name"))
    d = variations.where("slug is not null").join(t, ["parent", "attribute", "slug"], "left")
    return d.withColumn("value", F.coalesce("_name", "slug")).drop("_name")


def align_attributes(parents: DataFrame, variations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, issues): variation values (parent, attribute, value, seq) brought to their parent's spelling (parent, attribute,
    option, ord); equal but for case: the parent's; missing: added behind the parent's own, first seen first."""
    p = parents.select("parent", fold_for_compare(F.col("attribute")).alias("_a"), fold_for_compare(F.col("option")).alias("_v"), F.col("attribute").alias("_attribute"), F.col("option").alias("_option"), "ord")
    known = p.groupBy("parent", "_a", "_v").agg(F.min_by("_option", "ord").alias("_option"), F.min_by("_attribute", "ord").alias("_attribute"))
    v = variations.withColumns({"_a": fold_for_compare(F.col("attribute")), "_v": fold_for_compare(F.col("value"))})
    first = W.partitionBy("parent", "_a", "_v").orderBy("seq")
    d = v.join(known, ["parent", "_a", "_v"], "left").withColumn("_first", F.first("value").over(first))
    code = F.when(F.col("_option").isNull(), "variation-value-added-to-parent").when(F.col("_option") != F.col("value"), "variation-value-normalized")
    out = d.select("parent", F.coalesce("_attribute", "attribute").alias("attribute"), F.coalesce("_option", "_first").alias("value"), "seq", code.alias("code"))
    return out.drop("code"), out.where("code is not null").select("parent", "attribute", "value", "code")
