"""Queries over store answers that Spark renders from `part`: products by brand and size, a variation for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from souklens.plans.page_queries import _attributes
from souklens.plans.queries import query, read
from souklens.sources.store import read_store_api

API = "https://www.nuts.example/wp-json/wc/store/v1/products"
VARIED = 500_000_000  # ids of variations begin behind those of all parts


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A variable product for each brand and size, its parts as its variations, whose answers are missing for every fifth size; each
    part of an odd number also as a simple product, twice; the tree has a category for each brand, below one of all."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    p = p.withColumns({"b": brand, "up": F.lit(10**9) + brand * 1000 + F.col("p_size"), "slug": text("s", k), "cents": F.format_string("%.0f", F.col("p_retailprice") * 100)})
    none = F.lit(None).cast("string")
    price = lambda regular, sale, low, high, code: F.struct(F.lit(code).alias("currency_code"), F.lit(2).alias("currency_minor_unit"), F.lit(" x").alias("currency_suffix"), regular.alias("regular_price"), sale.alias("sale_price"), F.struct(low.alias("min_amount"), high.alias("max_amount")).alias("price_range"))
    cats = F.array(F.struct(F.lit(5).alias("id"), F.lit("All").alias("name")), F.struct((F.col("b") + 10).alias("id"), F.lit("other").alias("name")))
    simple = p.where(k % 2 == 1).select("p_size", F.struct(k.alias("id"), F.lit("grouped").alias("type"), text(" ", F.col("p_name"), " ").alias("name"), text("/p/", k, "/").alias("permalink"), text("P", k).alias("sku"), (k % 3 == 0).alias("on_sale"), (k % 5 > 0).alias("is_in_stock"), price(F.col("cents"), F.lit("100"), none, none, "IRR").alias("prices"), cats.alias("categories")).alias("n"))
    term, said = F.struct(F.col("p_name").alias("name"), "slug"), F.struct((k + VARIED).alias("id"), F.array(F.struct(F.lit("Kind").alias("name"), F.when(k % 7 == 0, "any thing").otherwise(F.col("slug")).alias("value"))).alias("attributes"))
    made = p.groupBy("b", "p_size", "up").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), term.alias("t"), said.alias("s")))).alias("x"), F.min(F.col("cents").cast("long")).cast("string").alias("low"), F.max(F.col("cents").cast("long")).cast("string").alias("high"))
    parent = made.select("p_size", F.struct(F.col("up").alias("id"), F.lit("variable").alias("type"), text("Size ", F.col("p_size")).alias("name"), text("/v/", F.col("up")).alias("permalink"), text("V", F.col("up")).alias("sku"), price(F.col("low"), F.col("low"), F.col("low"), F.col("high"), "EUR").alias("prices"), cats.alias("categories"), F.array(F.struct(F.lit("Kind").alias("name"), F.lit(True).alias("has_variations"), F.transform("x", lambda e: e["t"]).alias("terms"))).alias("attributes"), F.transform("x", lambda e: e["s"]).alias("variations")).alias("n"))
    kid = p.where("p_size % 5 > 0").select("p_size", "up", F.struct((k + VARIED).alias("id"), F.col("up").alias("parent"), F.lit("variation").alias("type"), text("/v/", F.col("up"), "?kind=", k).alias("permalink"), text("K", k).alias("sku"), price(F.col("cents"), none, none, none, "EUR").alias("prices")).alias("n"))
    listed = lambda d, url: d.groupBy(url.alias("url"), (F.pmod(F.col("p_size"), F.lit(10))).alias("seq")).agg(F.to_json(F.collect_list("n")).alias("body")).withColumn("status", F.lit(200))
    pages = listed(simple, F.lit(API)).unionByName(listed(simple, F.lit(API + "?page=2"))).unionByName(listed(parent, F.lit(API))).unionByName(listed(kid, F.concat(F.lit(API + "?type=variation&parent="), F.col("up").cast("string"))))
    dead = made.where("p_size % 5 = 0").select(F.concat(F.lit(API + "?type=variation&parent="), F.col("up").cast("string")).alias("url"), F.lit(1).cast("long").alias("seq"), F.lit("<html>").alias("body"), F.lit(404).alias("status"))
    tree = p.select((F.col("b") + 10).alias("id"), F.lit(5).cast("long").alias("parent"), F.col("p_brand").alias("name")).distinct().unionByName(spark.range(1).select(F.lit(5).cast("long").alias("id"), F.lit(0).cast("long").alias("parent"), F.lit("All").alias("name")))
    return pages.select("url", F.col("seq").cast("long").alias("seq"), "body", "status").unionByName(dead), tree


@query
def store_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Every product and variation of a store's answers: paths by its tree, values in the parent's words, prices by their pair."""
    p, _ = read_store_api(*_answers(spark, d))
    return p.select(
        "id", "kind", "source_url", "name", "sku", "parent_sku", "linked", F.array_join("category_path", ">").alias("category"), F.when(F.col("kind") == "variation", _attributes("attributes")).alias("worn"), F.size(F.coalesce(F.try_element_at("attributes", F.lit(1))["values"], F.array())).cast("long").alias("n_values"),
        F.round("regular.amount", 2).alias("regular"), F.round("sale.amount", 2).alias("sale"), F.col("regular.currency").alias("currency"), "in_stock",
    )


@query
def store_issues(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of parents, prices without a unit, and variations that no answer holds."""
    return read_store_api(*_answers(spark, d))[1].select("source_url", "severity", "code", "field")


_MADE = "(SELECT *, regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT AS b, 1000000000 + regexp_extract(p_brand, '([0-9]+)$', 1)::BIGINT * 1000 + p_size AS up, p_partkey AS k FROM part)"
ORACLES = {
    "store_catalog": f"""WITH p AS {_MADE}
      SELECT k AS id, 'simple' AS kind, 'https://www.nuts.example/p/' || k AS source_url, p_name AS name, 'P' || k AS sku, NULL::VARCHAR AS parent_sku, false AS linked, 'All>' || p_brand AS category, NULL::VARCHAR AS worn, 0::BIGINT AS n_values,
        round(p_retailprice, 2) AS regular, CASE WHEN k % 3 = 0 AND p_retailprice > 1 THEN 1.0::DOUBLE END AS sale, 'IRR' AS currency, k % 5 > 0 AS in_stock FROM p WHERE k % 2 = 1 UNION ALL
      SELECT up, 'variable', 'https://www.nuts.example/v/' || up, 'Size ' || any_value(p_size), 'V' || up, NULL, false, 'All>' || any_value(p_brand), NULL, count(*), NULL, NULL, NULL, false FROM p GROUP BY up UNION ALL
      SELECT k + {VARIED}, 'variation', 'https://www.nuts.example/v/' || up || '?kind=' || k, 'Size ' || p_size, 'K' || k, 'V' || up, true, '', 'Kind=' || CASE WHEN k % 7 = 0 THEN 'any thing' ELSE p_name END, 1, round(p_retailprice, 2), NULL, 'EUR', false FROM p WHERE p_size % 5 > 0""",
    "store_issues": f"""WITH p AS {_MADE}
      SELECT 'https://www.nuts.example/p/' || k AS source_url, 'warning' AS severity, 'price-unit-unknown' AS code, 'regular' AS field FROM p WHERE k % 2 = 1 UNION ALL
      SELECT DISTINCT 'https://www.nuts.example/v/' || up, 'info', 'price-range-only', 'regular' FROM p UNION ALL SELECT DISTINCT 'https://www.nuts.example/v/' || up, 'warning', 'variations-unavailable', NULL FROM p WHERE p_size % 5 = 0""",
}
