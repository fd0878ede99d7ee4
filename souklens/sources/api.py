"""Landed API answers and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from souklens.functions.numbers import minor_unit_price
from souklens.functions.text import canonical_url, clean_text, resolve_url
from souklens.sources.profiles import read_profiles  # noqa: F401

STORE = "array<struct<id:long,name:string,type:string,permalink:string,sku:string,parent:long,is_in_stock:boolean,on_sale:boolean,prices:struct<currency_code:string,currency_minor_unit:int,regular_price:string,sale_price:string>,images:array<struct<src:string>>,categories:array<struct<id:long,name:string>>>>"
COLLECTION = "struct<products:array<struct<id:long,title:string,handle:string,vendor:string,product_type:string,images:array<struct<src:string>>,variants:array<struct<id:long,title:string,sku:string,price:string,compare_at_price:string,available:boolean>>>>>"


def read_pages(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Landed pages (page_id, url, html) of a Parquet folder, as a table or as a stream of the files that come."""
    schema = "page_id long, url string, html string"
    return (spark.readStream if stream else spark.read).schema(schema).parquet(path)


def read_api_responses(responses: DataFrame) -> DataFrame:
    """responses (url, status, headers, body) with json (null where the body is no JSON or the status no success: an endpoint that is
    off is a normal answer) and total_pages, as the shop's header states it in any case."""
    total = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == "x-wp-totalpages")
    return responses.withColumns({"json": F.when(F.col("status").between(200, 299), F.try_parse_json("body")), "total_pages": F.try_element_at(total, F.lit(1))["value"].try_cast("int")})


def store_api_products(responses: DataFrame) -> DataFrame:
    """(url, pos, ...) one row per product of Store API answers; unknown types are simple; variable parents carry no price.
    A body that doesn't parse is no error: it yields nothing."""
    d = responses.select("url", F.posexplode(F.from_json("body", STORE)).alias("pos", "p"))
    kind = F.when(F.col("p.type").isin("simple", "variable", "variation", "grouped", "external"), F.col("p.type")).otherwise("simple")
    price = lambda c: F.when(kind != "variable", minor_unit_price(F.col(f"p.prices.{c}"), F.col("p.prices.currency_minor_unit")))
    regular, sale = price("regular_price"), price("sale_price")
    return d.select("url", "pos", F.col("p.id").alias("id"), clean_text(F.col("p.name")).alias("name"), kind.alias("kind"), canonical_url(F.col("p.permalink")).alias("source_url"), F.col("p.sku").alias("sku"), F.col("p.parent").alias("parent_id"), F.col("p.is_in_stock").alias("in_stock"), F.col("p.prices.currency_code").alias("currency"), regular.alias("regular"), F.when(sale < regular, sale).alias("sale"), F.col("p.images.src").alias("images"), F.col("p.categories.name").alias("categories"))


def collection_products(responses: DataFrame, base: str = "") -> DataFrame:
    """One row per variant of products.json answers; products need a title; one "Default Title" variant makes a simple product;
    a product (by its handle) seen on two pages stays once, as first seen. A compare-at price above the price makes a sale."""
    d = responses.select(F.posexplode(F.from_json("body", COLLECTION)["products"]).alias("pos", "p")).where("trim(p.title) <> ''")
    d = d.withColumn("_at", F.monotonically_increasing_id()).groupBy(F.coalesce("p.handle", F.concat(F.lit("\n"), F.col("p.id").cast("string"))).alias("_key")).agg(F.min_by("p", "_at").alias("p"))
    d = d.select("p", F.posexplode("p.variants").alias("vpos", "v"))
    single = (F.size("p.variants") == 1) & (F.coalesce("v.title", F.lit("Default Title")) == "Default Title")
    price, compare = F.col("v.price").try_cast("double"), F.col("v.compare_at_price").try_cast("double")
    sale = compare > price
    return d.select(F.col("p.handle").alias("handle"), F.concat(F.lit(base + "/products/"), "p.handle").alias("source_url"), clean_text(F.col("p.title")).alias("name"), F.col("p.vendor").alias("brand"), F.when(single, "simple").otherwise("variation").alias("kind"), F.col("v.title").alias("option"), F.col("v.sku").alias("sku"), F.coalesce(F.when(sale, compare), price).alias("regular"), F.when(sale, price).alias("sale"), F.col("v.available").alias("in_stock"), (F.col("vpos") + 1).alias("position"), F.col("p.images.src").alias("images"))


def sitemap_urls(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, loc, lastmod): locations of urlsets (url) and sitemap indexes (sitemap), absolute by the document's base_url
    if it has one, http(s) only, each once a document, the first one's lastmod.

    Entries are found by their tags, not by an XML parser, so a broken document gives what it holds and fails nothing."""
    base = F.col("base_url") if "base_url" in docs.columns else F.lit(None).cast("string")
    d = docs.select("doc_id", base.alias("base_url"), F.regexp_replace("xml", r"(?s)<!--.*?-->", "").alias("xml"))
    entry = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?(?:url|sitemap)\b[^>]*>.*?</(?:\w+:)?(?:url|sitemap)\s*>"), F.lit(0))
    d = d.select("doc_id", "base_url", F.posexplode(entry).alias("pos", "entry"))
    within = lambda tag: F.regexp_extract("entry", rf"(?is)<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}\s*>", 1)
    plain = lambda c: clean_text(F.regexp_replace(F.replace(F.replace(F.replace(F.replace(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), r"&#0*39;|&apos;", "'"))
    d = d.select("doc_id", "pos", F.when(F.lower("entry").rlike(r"^<(?:\w+:)?sitemap\b"), "sitemap").otherwise("url").alias("kind"), plain(within("loc")).alias("loc"), plain(within("lastmod")).alias("lastmod"), "base_url")
    d = d.withColumn("loc", F.when(F.col("base_url").isNotNull(), F.coalesce(resolve_url(F.col("loc"), F.col("base_url")), "loc")).otherwise(F.col("loc"))).where(F.col("loc").rlike("(?i)^https?:"))
    return d.groupBy("doc_id", "kind", "loc").agg(F.min_by(F.when(F.col("lastmod") != "", F.col("lastmod")), "pos").alias("lastmod"))


def sitemap_issues(docs: DataFrame, urls: DataFrame) -> DataFrame:
    """(doc_id, severity, code): sitemaps that hold no entry."""
    return docs.select("doc_id").join(urls, "doc_id", "left_anti").select("doc_id", F.lit("warning").alias("severity"), F.lit("sitemap-empty").alias("code"))


def filter_sitemap_urls(urls: DataFrame, hints: list[str]) -> DataFrame:
    """Locations whose decoded, lower-case path holds a hint; without hints all."""
    path = F.lower(F.coalesce(F.try_url_decode(F.regexp_extract("loc", r"^[a-z]+://[^/]*(.*)$", 1)), F.col("loc")))
    return urls if not hints else urls.where(F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(path, h)))

