"""Registered queries of the catalogue operators, over the given tables or pages rendered from them by Spark."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from souklens.functions import graph as G, numbers as N, text as T
from souklens.operators import export as X, keys as K, reports as R, resolve as V
from souklens.sources import api as A, markup as M
from souklens.sources.structured import read_markup
from souklens.plans.lineage import shared_folder, spread
from souklens.streaming import catalog as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _text(c: str | Column) -> Column:
    """HTML-escaped."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _pages(parts: DataFrame, body: Column) -> DataFrame:
    return parts.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("<html><head><title>shop</title>"), body, F.lit("</head><body><p>x</body></html>")).alias("html"))


@query
def jsonld_products(spark: SparkSession, d: str) -> DataFrame:
    """Product pages rendered from `part`, read back from JSON-LD, claimed and resolved."""
    part = spread(read(spark, d, "part"))
    doc = F.to_json(F.struct(F.lit("https://schema.org/Product").alias("@type"), F.col("p_name").alias("name"), F.concat(F.lit("P-"), "p_partkey").alias("sku"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.array(F.struct(F.format_string("%.2f", "p_retailprice").alias("price"), F.lit("USD").alias("priceCurrency"), F.lit("InStock").alias("availability"))).alias("offers")))
    nodes = M.dom_nodes(_pages(part, F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script>"))))
    p = M.offers_of(M.jsonld_products(M.jsonld_blocks(nodes)))
    claims = M.claims_of(p, F.col("page_id"), {"sku": F.col("product.sku"), "name": F.col("product.name"), "brand": F.col("product.brand.name"), "price": F.col("price"), "in_stock": F.col("in_stock")}, "json-ld", F.lit(0))
    out = V.resolve_wide(claims, ["sku", "name", "brand", "price", "in_stock"])
    return out.select(F.col("product_key").alias("page_id"), "sku", "name", "brand", F.col("price").cast("double").alias("price"), F.col("in_stock").cast("boolean").alias("in_stock"), F.size("field_confidence").cast("long").alias("n_fields"))


@query
def microdata_products(spark: SparkSession, d: str) -> DataFrame:
    part = spread(read(spark, d, "part"))
    body = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name">'), _text("p_name"), F.lit('</h1><meta itemprop="brand" content="'), _text("p_brand"), F.lit('"><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><span itemprop="price" content="'), F.format_string("%.2f", "p_retailprice"), F.lit('">x</span></div></div>'))
    pages = _pages(part, body).withColumn("url", F.lit("https://shop.example.com/"))
    item = read_markup(pages).select("page_id", F.explode("items").alias("item")).select("page_id", F.parse_json("item").alias("v"))
    get = lambda *keys: reduce(G.get, keys, F.col("v"))
    return item.where(G.is_product_node(F.col("v"))).select("page_id", G.read_name(get("name")).alias("name"), G.read_name(get("brand")).alias("brand"), G.as_number(get("offers", "price")).alias("price"))


@query
def microdata_properties(spark: SparkSession, d: str) -> DataFrame:
    """The same pages in long form: each property with its nearest item."""
    pages = spread(read(spark, d, "part")).select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("<div itemscope itemtype='Product'>"), F.repeat(F.lit("<div>"), F.col("p_size").cast("int")), F.lit("<b itemprop='name'>"), _text("p_name"), F.lit("</b></div></div>")).alias("html"))
    return M.microdata_properties(M.dom_nodes(pages)).select("page_id", "type", "prop", "value")


@query
def opengraph_products(spark: SparkSession, d: str) -> DataFrame:
    part = spread(read(spark, d, "part"))
    tag = lambda k, v: F.concat(F.lit(f'<meta property="{k}" content="'), v, F.lit('">'))
    kind = F.when(F.col("p_partkey") % 3 == 0, "website").otherwise("og:product")
    price = F.when(F.col("p_partkey") % 2 == 0, tag("product:price:amount", F.format_string("%.2f", "p_retailprice"))).otherwise("")
    body = F.concat(tag("og:type", kind), tag("og:title", _text("p_name")), tag("og:url", F.concat(F.lit("HTTP://Shop.example.com:80/p/"), "p_partkey", F.lit("/?utm_source=x"))), price)
    return M.opengraph_products(M.dom_nodes(_pages(part, body))).select("page_id", "name", "url", "price")


@query
def dom_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements of the given pages by tag, for tags that close themselves or never nest."""
    nodes = M.dom_nodes(read(spark, d, "pages").select("page_id", "html"))
    return nodes.where(F.col("tag").isin("nav", "article", "footer", "h1", "meta", "br")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query
def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = M.page_links(M.dom_nodes(read(spark, d, "pages").select("page_id", "html")))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("href").alias("n_targets"))


@query
def parse_number_formats(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("x"))
    us, k = F.format_number("x", 2), F.pmod("l_linenumber", F.lit(4))
    text = F.when(k == 0, us).when(k == 1, F.translate(us, ",.", ".,")).when(k == 2, F.translate(us, "0123456789,.", "۰۱۲۳۴۵۶۷۸۹٬٫")).otherwise(F.concat(F.replace(us, F.lit(","), F.lit(" ")), F.lit(" $")))
    return li.select("l_orderkey", "l_linenumber", F.round(N.parse_number(text)["value"], 2).alias("price"))


@query
def parse_money_units(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.pmod("p_partkey", F.lit(5)), F.format_number("p_retailprice", 2)
    text = F.when(k == 0, F.concat(x, F.lit(" تومان"))).when(k == 1, F.concat(x, F.lit(" rial"))).when(k == 2, F.concat(F.lit("$"), x)).when(k == 3, F.concat(x, F.lit(" EUR"))).otherwise(x)
    m = N.parse_money(text, default_currency="GBP")
    return spread(read(spark, d, "part")).select("p_partkey", F.round(m["amount"], 2).alias("amount"), m["currency"].alias("currency"), m["unit"].alias("unit"), F.round(N.convert_currency_unit(m["amount"], m["currency"], m["unit"], "rial"), 2).alias("in_rial"))


@query
def convert_measures(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(4))
    unit = F.when(k == 0, "g").when(k == 1, "kg").when(k == 2, "oz").otherwise("parsec")
    m = N.read_measure(F.concat(F.col("p_size").cast("string"), F.lit(" "), unit))
    return read(spark, d, "part").select("p_partkey", N.convert_weight(m["value"], m["unit"], "g").alias("grams"))


@query
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url_key"), T.profile_domain(F.col("url")).alias("domain"))


@query
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.page_number(F.col("url")).alias("page_no"))


@query
def short_hash_urls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.short_hash(F.col("url"), 8).alias("h"))


@query
def slugify_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", T.slugify(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, cleaned and folded, as digests."""
    return read(spark, d, "documents").select("doc_id", F.length(T.clean_text(F.col("text"))).cast("long").alias("n_clean"), F.md5(T.fold_for_compare(F.col("text")).cast("binary")).alias("folded_md5"))


@query
def offers_min_price(spark: SparkSession, d: str) -> DataFrame:
    """Line items as the offers of one JSON-LD product per part."""
    li = read(spark, d, "lineitem")
    offer = F.struct(F.format_string("%.2f", "l_extendedprice").alias("price"), F.lit("EUR").alias("priceCurrency"), F.when(F.col("l_returnflag") == "R", "OutOfStock").otherwise("https://schema.org/InStock").alias("availability"))
    docs = li.groupBy(F.col("l_partkey").alias("page_id")).agg(F.collect_list(offer).alias("o")).select("page_id", F.lit(0).alias("node_id"), F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("o").alias("offers"))).alias("doc"))
    return M.offers_of(M.jsonld_products(docs)).select("page_id", F.round("price", 2).alias("price"), F.round("high_price", 2).alias("high_price"), F.col("n_offers").cast("long").alias("n_offers"), "in_stock")


def _claims(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    copies = [(0.95, 1, F.when(F.col("p_partkey") % 3 > 0, F.col("p_name"))), (0.7, 2, F.upper("p_name")), (0.95, 3, F.concat(F.lit("z"), "p_name"))]
    rows = [part.select(F.col("p_partkey").alias("product_key"), F.lit("name").alias("field"), v.alias("value"), F.lit(c).alias("confidence"), F.lit(f"s{s}").alias("source"), F.lit(s).cast("long").alias("seq")) for c, s, v in copies]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def resolve_claims(spark: SparkSession, d: str) -> DataFrame:
    return V.resolve_claims(_claims(spark, d)).select("product_key", "field", "value", "confidence", "source")


@query
def resolve_price_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    c = li.select(F.col("l_partkey").alias("product_key"), F.when(F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("regular"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice") * F.when(F.col("l_discount") > 0.05, 0.5).otherwise(2.0)).alias("sale"), F.round("l_discount", 2).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return V.resolve_price_pair(c).select("product_key", F.round("regular", 3).alias("regular"), F.round("sale", 3).alias("sale"))


@query
def dedupe_products(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select("page_id", "url")
    twice = pages.withColumn("seq", F.col("page_id")).unionByName(pages.select("page_id", F.concat("url", F.when(F.col("url").contains("?") | F.col("url").contains("#"), "").otherwise("?gclid=1")).alias("url"), (F.col("page_id") + 1_000_000).alias("seq")))
    s = twice.select("url", "seq", F.concat(F.lit("n"), "seq").alias("name"), F.when(F.col("seq") % 2 == 0, 0.9).otherwise(0.5).alias("name_conf"))
    return V.dedupe_products(s, ["name"]).select("product_key", "name", "first_seq", "duplicates")


def _products(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "part")).select(F.concat(F.lit("https://shop.example.com/p/"), "p_partkey").alias("source_url"), F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("B"), F.regexp_extract("p_brand", r"(\d+)$", 1))).alias("sku"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.lit("simple").alias("kind"), F.col("p_retailprice").alias("regular"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice") / 2).alias("sale"), (F.col("p_partkey") % 7 > 0).alias("in_stock"), F.split("p_type", " ").alias("category_path"), F.lit(None).cast("string").alias("parent_sku"), F.col("p_partkey").alias("seq"), F.col("p_size"))


@query
def assign_skus(spark: SparkSession, d: str) -> DataFrame:
    return K.assign_skus(_products(spark, d)).select("seq", "sku_out", "sku_generated")


@query
def assign_handles(spark: SparkSession, d: str) -> DataFrame:
    return K.assign_handles(_products(spark, d).withColumn("name", F.col("brand"))).select("seq", "handle")


@query
def link_variations(spark: SparkSession, d: str) -> DataFrame:
    """Line items as variations of orders; a third without the parent's SKU, linked by URL; a tenth without either."""
    orders, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    url = lambda c: F.concat(F.lit("http://s.example.com/o/"), c)
    parents = orders.where("o_orderkey % 10 > 0").select(F.lit("variable").alias("kind"), F.concat(F.lit("O"), "o_orderkey").alias("sku"), F.lit(None).cast("string").alias("parent_sku"), url("o_orderkey").alias("source_url"), F.col("o_orderkey").alias("seq"))
    kids = li.select(F.lit("variation").alias("kind"), F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("sku"), F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lit("O"), "l_orderkey")).alias("parent_sku"), F.concat(url("l_orderkey"), F.lit("/#v")).alias("source_url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return V.link_variations(parents.unionByName(kids)).groupBy("parent_key").agg(F.count(F.lit(1)).alias("n"))


@query
def category_paths(spark: SparkSession, d: str) -> DataFrame:
    region, nation = read(spark, d, "region"), read(spark, d, "nation")
    tree = region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent"), F.col("r_name").alias("name")).unionByName(nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_name").alias("name")))
    s = read(spark, d, "supplier")
    terms = s.select(F.col("s_suppkey").alias("product_id"), (F.col("s_nationkey") + 100).cast("long").alias("term"), F.lit(1).alias("pos")).unionByName(s.select(F.col("s_suppkey").alias("product_id"), F.lit(1).cast("long").alias("term"), F.lit(0).alias("pos")))
    return V.category_paths(terms, tree).select("product_id", F.array_join("category_path", " > ").alias("path"))


@query
def align_attributes(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    parents = part.where("p_size <= 25").select(F.col("p_brand").alias("parent"), F.lit("Size").alias("attribute"), F.concat(F.lit("S"), "p_size").alias("option"), F.col("p_size").alias("ord")).distinct()
    kids = part.select(F.col("p_brand").alias("parent"), F.lit("size").alias("attribute"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("S"), "p_size").alias("value"), F.col("p_partkey").alias("seq"))
    values, _ = V.align_attributes(parents, kids)
    return values.groupBy("parent", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def filter_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = _products(spark, d).withColumns({"kind": F.when(F.col("seq") % 6 == 0, "grouped").otherwise("simple"), "parent_key": F.lit(None).cast("string")})
    return R.apply_catalog_filter(p, kinds=["simple", "variable"], category="standard > anodized").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.field_coverage(_products(spark, d), ["sku", "name", "sale", "brand", "parent_sku"], scope=["brand"], wanted=["sku", "name", "sale", "parent_sku"])


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("start_ts"), (F.col("ts").cast("timestamp") + F.expr("interval 1 second") * F.pmod("event_id", F.lit(5))).alias("end_ts"), "event_type", "value", "props")


@query
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    kind = F.pmod("seq", F.lit(3))
    i = _log(spark, d).select("scan_id", "seq", F.col("event_type").alias("code"), F.when(kind == 0, "error").when(kind == 1, "warning").otherwise("info").alias("severity"), F.concat(F.lit("m"), "seq").alias("message"))
    return R.summarize_issues(i, scope=["scan_id"]).select("scan_id", "code", "message", "severity", "n", F.col("rank").cast("long").alias("rank"))


@query
def top_issues(spark: SparkSession, d: str) -> DataFrame:
    """Feature: the first three issues of a scan."""
    kind = F.pmod("seq", F.lit(3))
    i = _log(spark, d).select("scan_id", "seq", F.when(kind == 0, "error").when(kind == 1, "warning").otherwise("info").alias("severity"))
    return R.top_issues(i, 3).select("scan_id", "seq", F.col("rank").cast("long").alias("rank"))


@query
def currency_units(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(4))
    price = F.struct(F.when(k == 0, "USD").when(k == 1, "IRR").alias("currency"), F.when(k == 1, "toman").alias("unit"))
    p = read(spark, d, "part").select(price.alias("regular"), F.when(F.col("p_partkey") % 3 == 0, price).alias("sale"))
    return R.currency_unit_counts(p, ["regular", "sale"])


@query
def signal_scores(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("fr", 1, "lang", 'lang="fr"', 0.6), ("fr", 2, "path", "/fr/", 0.25), ("en", 1, "lang", 'lang="en"', 0.8), ("en", 2, "the", " the ", 0.3), ("weak", 1, "nav", "<nav", 0.2), ("ads", 1, "ad", 'class="ad"', 0.2), ("ads", 2, "track", "track(", 0.15)], "target string, rule_no int, label string, needle string, weight double")
    return R.score_signals(read(spark, d, "pages"), rules).select("page_id", "target", "confidence", F.array_join("labels", ",").alias("labels"), F.col("rank").cast("long").alias("rank"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("seq", F.lit(50))
    status = F.when(k == 7, 429).when(k == 11, 403).when(k == 13, 404).otherwise(200)
    return _log(spark, d).select("scan_id", "seq", status.alias("status"), F.create_map(F.lit("server"), F.lit("x")).alias("headers"), F.when(F.pmod("seq", F.lit(100)) == 11, "<html>Just a moment...").otherwise("ok").alias("body"))


@query
def detect_blocks(spark: SparkSession, d: str) -> DataFrame:
    return R.detect_blocks(_responses(spark, d)).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query
def block_latch(spark: SparkSession, d: str) -> DataFrame:
    return R.block_latch(R.detect_blocks(_responses(spark, d))).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"))


@query
def pacing_audit(spark: SparkSession, d: str) -> DataFrame:
    return R.pacing_audit(_log(spark, d), delay_ms=60_000).select("scan_id", "seq", "gap_ms", "too_close")


@query
def overlap_audit(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d).withColumn("end_ts", F.col("start_ts") + F.expr("interval 6 hours"))
    return R.overlap_audit(e, most=2).groupBy("scan_id").agg(F.max("in_flight").alias("most"))


@query
def walk_pagination(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a host as a chain in order of their ids; the walk from each host's first page, ten pages at most."""
    p = read(spark, d, "pages").select("page_id", T.profile_domain(F.col("url")).alias("seed"), F.col("page_id").cast("string").alias("url"))
    chain = p.withColumn("next_url", F.lead("url").over(W.partitionBy("seed").orderBy("page_id")))
    seeds = p.groupBy("seed").agg(F.min("page_id").cast("string").alias("url"))
    return R.walk_pagination(chain, seeds, max_pages=10).groupBy("seed").agg(F.count(F.lit(1)).alias("n_pages"), F.max("hop").cast("long").alias("last_hop"))


@query
def verify_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that stand in the text, and ones that don't, checked against whole documents."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("fragment"))
    true = docs.select("request_id", F.lit("name").alias("field"), F.upper(F.substring(F.regexp_extract("fragment", r"[a-zA-Z]{4,}", 0), 1, 20)).alias("value")).where("value <> ''")
    false = docs.select("request_id", F.lit("invented").alias("field"), F.lit("zzqqxxvv product").alias("value"))
    return R.verify_answers(true.unionByName(false), docs).groupBy("field", "present").agg(F.count(F.lit(1)).alias("n"))


@query
def fill_empty(spark: SparkSession, d: str) -> DataFrame:
    p = _products(spark, d).select(F.col("seq").alias("product_key"), "sku")
    a = read(spark, d, "part").where("p_partkey % 8 = 0").select(F.col("p_partkey").alias("product_key"), F.concat(F.lit("A"), "p_partkey").alias("value"))
    return R.fill_empty(p, a, "sku")


@query
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.usage_rollup(_log(spark, d).select(F.col("event_type").alias("provider"), F.pmod("scan_id", F.lit(3)).cast("string").alias("model"), F.col("seq").alias("input_tokens"), F.pmod("seq", F.lit(10)).alias("output_tokens")))


@query
def redact_log(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    m = F.map_concat(m, F.create_map(F.lit("api_key"), F.col("event_type"), F.lit("note"), F.repeat(F.lit("x"), F.pmod("seq", F.lit(2)).cast("int") * 600)))
    out = T.redact_fields(m)
    return _log(spark, d).select("seq", out["api_key"].alias("api_key"), out["k"].alias("k"), out["note"].alias("note"))


@query
def woo_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _products(spark, d)
    p = K.assign_skus(p).drop("sku").withColumnRenamed("sku_out", "sku").withColumn("images", F.array(F.concat(F.lit("a,b"), "seq"), F.lit("c")))
    attributes = p.select("sku", F.lit(1).alias("slot"), F.lit("Brand").alias("name"), F.array("brand").alias("values")).unionByName(p.where("p_size > 25").select("sku", F.lit(2).alias("slot"), F.lit("Size").alias("name"), F.array(F.col("p_size").cast("string"), F.lit("x")).alias("values")))
    return X.woo_rows(p, attributes)


@query
def shopify_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _products(spark, d).withColumns({"handle": F.lower("brand"), "option": F.col("p_size").cast("string")})
    return X.shopify_rows(p)


@query
def image_rows(spark: SparkSession, d: str) -> DataFrame:
    """Feature: a product's images end at the shop's limit."""
    o = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("handle")).agg(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: F.concat(F.lit("i"), x.cast("string"))).alias("images"))
    return X.image_rows(o, most=5).select("handle", F.col("position").cast("long").alias("position"), "src")


@query
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, ', "big"').otherwise("")).alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("brand"))
    return X.csv_lines(p, ["p_partkey"])


@query
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.json_lines(read(spark, d, "nation").select("n_name", "n_nationkey", "n_regionkey"))


@query
def store_api_products(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    item = F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), F.when(F.col("p_partkey") % 5 == 0, "variable").when(F.col("p_partkey") % 5 == 1, "odd").otherwise("simple").alias("type"), F.concat(F.lit("https://s.example.com/p/"), "p_partkey", F.lit("/")).alias("permalink"), F.struct(F.lit("EUR").alias("currency_code"), F.lit(2).alias("currency_minor_unit"), F.format_string("%.0f", F.col("p_retailprice") * 100).alias("regular_price"), F.format_string("%.0f", F.col("p_retailprice") * F.when(F.col("p_partkey") % 2 == 0, 50).otherwise(100)).alias("sale_price")).alias("prices"))
    body = part.groupBy(F.floor(F.col("p_partkey") / 100).alias("page")).agg(F.to_json(F.collect_list(item)).alias("body")).select(F.col("page").cast("string").alias("url"), "body")
    return A.store_api_products(body).select("id", "name", "kind", "source_url", F.round("regular", 2).alias("regular"), F.round("sale", 2).alias("sale"))


@query
def collection_products(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").withColumn("g", F.concat(F.lit("h"), F.regexp_extract("p_brand", r"(\d+)$", 1), F.lit("-"), F.col("p_size").cast("string")))
    variant = F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "Default Title").otherwise(F.col("p_type")).alias("title"), F.format_string("%.2f", "p_retailprice").alias("price"), F.when(F.col("p_partkey") % 3 == 0, F.format_string("%.2f", F.col("p_retailprice") + 10)).alias("compare_at_price"), F.concat(F.lit("V"), "p_partkey").alias("sku"))
    products = part.groupBy("g").agg(F.collect_list(variant).alias("variants")).select(F.struct(F.col("g").alias("handle"), F.concat(F.lit("T "), "g").alias("title"), "variants").alias("p"))
    body = products.groupBy(F.pmod(F.xxhash64("p.handle"), F.lit(64)).alias("page")).agg(F.to_json(F.struct(F.collect_list("p").alias("products"))).alias("body"))
    return A.collection_products(body).select("sku", "handle", "kind", F.round("regular", 2).alias("regular"), F.round("sale", 2).alias("sale"))


@query
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select(F.floor(F.col("page_id") / 50).alias("doc_id"), F.concat(F.lit("<url><loc> "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url><url><loc>mailto:x</loc></url>")).alias("x"))
    docs = p.groupBy("doc_id").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("x"), ""), F.lit("</urlset>")).alias("xml"))
    return A.filter_sitemap_urls(A.sitemap_urls(docs), ["/en/", "/fr/"]).select("doc_id", "kind", "loc")


@query
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of landed files, read to the end, per user and day."""
    return _streamed(spark, d, lambda e: S.stream_progress(e).select(F.col("w.start").alias("day"), "user_id", "n", F.round("total", 4).alias("total")), "stream_progress")


@query
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Sightings streamed in; the last state of each key."""
    shape = lambda e: e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.round("value", 2).alias("kind_conf"))
    return _streamed(spark, d, lambda e: S.stream_dedupe(shape(e), ["kind"], key="key", seq="seq"), "stream_dedupe", mode="complete")


def _streamed(spark: SparkSession, d: str, shape, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream to the end in complete mode; each run has its own folder in the checkpoint folder (or a new temporary one)."""
    import uuid

    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    stream = shape(S.landed(spark, d, "events.parquet"))

    def keep(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")
