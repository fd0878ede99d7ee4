"""Queries of page extraction, over pages of six shapes rendered from `part`; their SQL is written from the shapes, not from the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from souklens.functions import graph as G, text as T
from souklens.operators import detect as D, export as X, keys as K, normalize as N, reports as R
from souklens.plans.lineage import spread
from souklens.plans.queries import _log, query, read
from souklens.sources import api as A, structured as S

# what a page holds, by p_partkey % 6; {k} is the key, {b} the brand, {p} the price with two decimals
SHAPES = (
    """<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":["Thing","https://schema.org/Product"],"@id":"#p","name":"Item {k}","brand":{"@id":"#b"},"image":["/i/{k}.jpg",{"url":"j.jpg"},"/i/{k}.jpg"],
      "weight":{"value":"1.5","unitCode":"KGM"},"gtin13":"40-{k}-1234567","keywords":"a, b,a","category":["x","y > z"],"additionalProperty":[{"name":"Fabric","value":["wool","silk"]},{"name":"FABRIC","value":"silk"}],
      "offers":{"@type":"AggregateOffer","lowPrice":"0.5","offers":[{"price":"{p}","priceCurrency":"EUR","availability":"https://schema.org/OutOfStock"},{"price":"0.75","priceCurrency":"EUR","sku":"S{k}","inventoryLevel":{"value":3},"availability":"InStock","priceSpecification":[{"priceType":"https://schema.org/ListPrice","price":"0.9"}]}]}},
      {"@type":"Brand","@id":"#b","name":"{b}"},{"@type":"BreadcrumbList","itemListElement":[{"position":3,"name":"Item {k}"},{"position":1,"name":"Home","item":"/"},{"position":2,"name":"All","item":"/all"}]}]}</script>""",
    """<script type="application/ld+json">{"@type":"ProductGroup","name":"Group {k}","sku":"G{k}","additionalProperty":[{"name":"size","value":"any"},{"name":"Care","value":"cold"}],
      "hasVariant":[{"@type":"Product","sku":"G{k}-s","size":"S","offers":{"price":"{p}","priceCurrency":"EUR"}},{"@type":"Product","name":"Own {k}","sku":"G{k}-m","size":"M","offers":{"price":"7","priceCurrency":"EUR"}}]}</script>""",
    """<div itemscope itemtype="https://schema.org/Product"><div><div><h1 itemprop="name">Micro <b>{k}</b></h1></div></div><span itemprop="brand" itemscope itemtype="Brand"><i itemprop="name">{b}</i></span>
      <p itemprop="offers" itemscope itemtype="Offer"><span itemprop="price">{p}</span><meta itemprop="priceCurrency" content="EUR"></p></div>
      <meta property="og:type" content="product"><meta property="og:title" content="Other {k}"><meta property="og:url" content="/elsewhere"><meta property="product:retailer_item_id" content="R{k}"><meta property="product:price:amount" content="1">""",
    """<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"position":2,"url":"/l/{k}?utm_source=x"},{"position":1,"item":{"@type":"Product","name":"Inline {k}","url":"/p/{k}/"}},{"item":"/p/{k}"}]}</script>""",
    """<script type="application/ld+json">{"@type":"Product","name":"Plain {k}","brand":"{b}","offers":{"seller":{"name":"x"},"priceSpecification":{"price":"۱٬۲۳۴٫۵ تومان"}},}</script><script type="application/ld+json">{broken</script>""",
    """<script type="application/ld+json">[{"@type":"WebPage","mainEntity":{"@id":"#m"}},[{"@type":"Product","@id":"#m","name":"Range {k}","offers":{"@type":"AggregateOffer","lowPrice":"5","highPrice":"9","priceCurrency":"EUR"}}]]</script>
      <meta property="product:price:amount" content="{p}"><meta property="product:price:currency" content="EUR"><meta property="og:title" content="OG {k}">""",
)


def shaped_pages(spark: SparkSession, d: str) -> DataFrame:
    part = spread(read(spark, d, "part"))
    html = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    for mark, value in (("{k}", F.col("p_partkey").cast("string")), ("{b}", F.col("p_brand")), ("{p}", F.format_string("%.2f", "p_retailprice"))):
        html = F.replace(html, F.lit(mark), value)
    return part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example.com/d/"), "p_partkey", F.lit(".html")).alias("url"), F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")).alias("html"))


@query
def extract_structured(spark: SparkSession, d: str) -> DataFrame:
    """Products and variations of all pages: scripts, microdata and meta tags merged."""
    p, _, _ = S.extract_structured(shaped_pages(spark, d))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws("=", x["name"], F.array_join(x["values"], "|"))), ";")
    return p.select(
        "page_id", F.coalesce(F.col("variant") + 1, F.lit(0)).cast("long").alias("row"), "source_url", "kind", "parent_sku", "name", "sku", "brand", "gtin", F.round("price.regular.amount", 2).alias("regular"), F.round("price.sale.amount", 2).alias("sale"), F.col("price.regular.unit").alias("unit"),
        "in_stock", "stock_quantity", F.array_join("category_path", " > ").alias("category"), F.array_join("images", " ").alias("images"), F.array_join("tags", ",").alias("tags"), F.col("weight.value").alias("kg"), text(F.col("attributes")).alias("attributes"), F.col("field_confidence")["price"].alias("price_confidence"),
    )


@query
def structured_issues(spark: SparkSession, d: str) -> DataFrame:
    """What reading the pages found wrong, and links to products that no page described."""
    _, links, issues = S.extract_structured(shaped_pages(spark, d))
    return issues.select("page_id", "code", F.lit(None).cast("string").alias("link")).unionByName(links.select("page_id", F.lit("discovered").alias("code"), "link"))


@query
def offers_graph(spark: SparkSession, d: str) -> DataFrame:
    """Offers of every product node as they are, with what is to be said of their prices."""
    offers = S.node_offers(S.read_markup(shaped_pages(spark, d)))
    issues = S.price_issues(offers).groupBy("page_id", "source", "pos", "variant").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    o, i = offers.alias("o"), issues.alias("i")
    same = (F.col("o.page_id") == F.col("i.page_id")) & (F.col("o.source") == F.col("i.source")) & (F.col("o.pos") == F.col("i.pos")) & F.col("o.variant").eqNullSafe(F.col("i.variant"))
    return o.join(i, same, "left").select("o.page_id", F.coalesce(F.col("o.variant") + 1, F.lit(0)).cast("long").alias("row"), F.round("o.regular.amount", 2).alias("regular"), F.col("o.regular.currency").alias("currency"), F.round("o.high_price", 2).alias("high"), F.col("o.is_range").alias("is_range"), F.coalesce("i.codes", F.lit("")).alias("codes"))


@query
def declared_counts(spark: SparkSession, d: str) -> DataFrame:
    """List pages that declare how many items they have, against the rows fetched for them."""
    orders, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    pages = orders.select(F.col("o_orderkey").alias("page_id"), F.lit("https://s.example.com/").alias("url"), F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","numberOfItems":'), (F.col("o_orderkey") % 5).cast("string"), F.lit("}</script>")).alias("html"))
    return S.declared_count_issues(S.read_markup(pages), li.select(F.col("l_orderkey").alias("page_id"))).select("page_id", "declared", "fetched")


@query
def lenient_values(spark: SparkSession, d: str) -> DataFrame:
    """JSON values of every kind, read as lists, texts, numbers and flags."""
    k = F.col("event_id") % 6
    value = F.when(k == 0, F.concat(F.lit('" '), "event_type", F.lit('  x "'))).when(k == 1, F.col("event_id").cast("string")).when(k == 2, "true").when(k == 3, F.concat(F.lit('[null,"'), "event_type", F.lit('",7]'))).when(k == 4, '{"name":["",{"alternateName":"n"}]}').otherwise("null")
    v = F.parse_json(value)
    return read(spark, d, "events").select("event_id", F.size(G.as_array(v)).cast("long").alias("n"), G.as_text(v).alias("text"), G.as_number(v).alias("number"), G.as_boolean(v).alias("flag"), G.read_name(v).alias("name"))


ORACLES = {
    "extract_structured": """
WITH a AS (SELECT p_partkey AS k, p_brand AS b, round(p_retailprice, 2) AS p, 'https://shop.example.com/' AS h FROM part),
r AS (
  SELECT k, 0 AS row, h || 'd/' || k || '.html' AS source_url, 'simple' AS kind, NULL AS parent_sku, 'Item ' || k AS name, 'S' || k AS sku, b AS brand, '40' || k || '1234567' AS gtin, 0.9 AS regular, 0.75 AS sale, NULL AS unit, true AS in_stock, 3 AS stock_quantity, 'y > z' AS category,
    h || 'i/' || k || '.jpg ' || h || 'd/j.jpg' AS images, 'a,b' AS tags, 1.5 AS kg, 'Fabric=wool|silk' AS attributes, 0.35 AS price_confidence FROM a WHERE k % 6 = 0
  UNION ALL SELECT k, 0, h || 'd/' || k || '.html', 'variable', NULL, 'Group ' || k, 'G' || k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Size=S|M;Care=cold', NULL FROM a WHERE k % 6 = 1
  UNION ALL SELECT k, 1, h || 'd/' || k || '.html', 'variation', 'G' || k, 'Group ' || k, 'G' || k || '-s', NULL, NULL, p, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Size=S', 0.95 FROM a WHERE k % 6 = 1
  UNION ALL SELECT k, 2, h || 'd/' || k || '.html', 'variation', 'G' || k, 'Own ' || k, 'G' || k || '-m', NULL, NULL, 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Size=M', 0.95 FROM a WHERE k % 6 = 1
  UNION ALL SELECT k, 0, h || 'd/' || k || '.html', 'simple', NULL, 'Micro ' || k, 'R' || k, b, NULL, p, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.7 FROM a WHERE k % 6 = 2
  UNION ALL SELECT k, 0, h || 'p/' || k, 'simple', NULL, 'Inline ' || k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM a WHERE k % 6 = 3
  UNION ALL SELECT k, 0, h || 'd/' || k || '.html', 'simple', NULL, 'Plain ' || k, NULL, b, NULL, 1234.5, NULL, 'toman', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.95 FROM a WHERE k % 6 = 4
  UNION ALL SELECT k, 0, h || 'd/' || k || '.html', 'simple', NULL, 'Range ' || k, NULL, NULL, NULL, p, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.5 FROM a WHERE k % 6 = 5)
SELECT k AS page_id, row::BIGINT AS row, source_url, kind, parent_sku, name, sku, brand, gtin, regular::DOUBLE AS regular, sale::DOUBLE AS sale, unit, in_stock, stock_quantity::BIGINT AS stock_quantity, category, images, tags, kg::DOUBLE AS kg, attributes, price_confidence::DOUBLE AS price_confidence FROM r""",
    "structured_issues": """SELECT p_partkey AS page_id, 'json-ld-repaired' AS code, NULL::VARCHAR AS link FROM part WHERE p_partkey % 6 = 4 UNION ALL SELECT p_partkey, 'json-ld-invalid', NULL FROM part WHERE p_partkey % 6 = 4
      UNION ALL SELECT p_partkey, 'discovered', 'https://shop.example.com/l/' || p_partkey FROM part WHERE p_partkey % 6 = 3""",
    "offers_graph": """WITH a AS (SELECT p_partkey AS k, round(p_retailprice, 2) AS p FROM part)
      SELECT k AS page_id, 0::BIGINT AS row, 0.9::DOUBLE AS regular, 'EUR' AS currency, p AS high, true AS is_range, 'price-range-only' AS codes FROM a WHERE k % 6 = 0
      UNION ALL SELECT k, 0, NULL, NULL, NULL, false, '' FROM a WHERE k % 6 IN (1, 3) UNION ALL SELECT k, 1, p, 'EUR', NULL, false, '' FROM a WHERE k % 6 = 1 UNION ALL SELECT k, 2, 7, 'EUR', NULL, false, '' FROM a WHERE k % 6 = 1
      UNION ALL SELECT k, 0, p, 'EUR', NULL, false, '' FROM a WHERE k % 6 = 2 UNION ALL SELECT k, 0, 1234.5, 'IRR', NULL, false, '' FROM a WHERE k % 6 = 4 UNION ALL SELECT k, 0, 5, 'EUR', 9, true, 'price-range-only' FROM a WHERE k % 6 = 5""",
    "declared_counts": "SELECT o_orderkey AS page_id, o_orderkey % 5 AS declared, count(l_orderkey) AS fetched FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 > 0 GROUP BY 1, 2 HAVING count(l_orderkey) <> o_orderkey % 5",
    "lenient_values": """SELECT event_id, [1, 1, 1, 2, 1, 0][(event_id % 6 + 1)::INT]::BIGINT AS n, CASE event_id % 6 WHEN 0 THEN event_type || ' x' WHEN 1 THEN event_id::VARCHAR END AS text, CASE WHEN event_id % 6 = 1 THEN event_id::DOUBLE END AS number,
      CASE event_id % 6 WHEN 1 THEN event_id <> 0 WHEN 2 THEN true END AS flag, CASE event_id % 6 WHEN 0 THEN event_type || ' x' WHEN 1 THEN event_id::VARCHAR WHEN 3 THEN event_type END AS name FROM events""",
}


@query
def platforms(spark: SparkSession, d: str) -> DataFrame:
    """Pages of shops of several kinds; marks in scripts, classes, generators and ids."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey") % 5
    html = F.when(k == 0, '<meta name="generator" content="WooCommerce 9"><body class="x Woocommerce-Page">').when(k == 1, '<div id="shopify-features"></div>').when(k == 2, '<script id="__NEXT_DATA__">{}</script><script src="/_NEXT/static/x.js">').when(k == 3, '<link rel="https://api.w.org/"><p>').otherwise('<a href="index.php?route=a">catalog/view/theme/ myshopify.com')
    return D.detect_platforms(o.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))).select("page_id", "target", "confidence", F.array_join("labels", ",").alias("labels"), "adapter", F.col("rank").cast("long").alias("rank"))


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """Pages that state their successor in every way there is."""
    o = read(spark, d, "orders")
    k, n = F.col("o_orderkey") % 7, (F.col("o_orderkey") % 3 + 1).cast("string")
    nav = F.lit('<ul class="my-pagination"><li><a href="/c/">1</a><a href="/c/page/2/">2</a><a href="/c/page/3/?utm_source=x">3</a></li></ul>')
    html = (
        F.when(k == 0, '<link rel="next" href="/c/page/9/">').when(k == 1, nav).when(k == 2, '<button data-next="x?page=4">Load  MORE products</button>').when(k == 3, "<p class='infinite-scroll'>")
        .when(k == 4, F.concat(F.lit('<a rel="prev next" href="'), F.lit("https://s.example.com/c/page/"), n, F.lit('/">'))).when(k == 5, '<a class="button">buy</a><div class="js-load-more">').otherwise("<p>x")
    )
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("https://s.example.com/c/page/"), n, F.lit("/")).alias("url"), html.alias("html"))
    return pages


@query
def pagination_plans(spark: SparkSession, d: str) -> DataFrame:
    return D.detect_pagination(_paged(spark, d)).drop("signals")


@query
def pagination_signals(spark: SparkSession, d: str) -> DataFrame:
    """What each plan was told by, in words."""
    return D.detect_pagination(_paged(spark, d)).select("page_id", F.array_join("signals", "; ").alias("signals"))


@query
def import_rows(spark: SparkSession, d: str) -> DataFrame:
    """All columns of an import: parents of `part`, two variations each for a fourth of them, some without a parent."""
    p = read(spark, d, "part").withColumn("k", F.col("p_partkey") % 4)
    money = lambda c: F.struct(c.alias("amount"), F.when(F.col("p_partkey") % 3 == 0, "IRR").otherwise("EUR").alias("currency"), F.when(F.col("p_partkey") % 6 == 0, "rial").alias("unit"))
    price = F.struct(money(F.col("p_retailprice")).alias("regular"), F.when(F.col("p_partkey") % 5 == 0, money(F.col("p_retailprice") / 2)).alias("sale"))
    none = F.lit(None).cast("string")
    axis = lambda name, *v: F.struct(F.lit(name).alias("name"), F.array(*v).alias("values"), F.lit(True).alias("is_variation_axis"))
    measure = lambda v, u: F.struct(v.cast("double").alias("value"), F.lit(u).alias("unit"))
    base = {"gtin": none, "name": F.col("p_name"), "description": F.lit("a\\nb"), "short_description": none, "brand": F.col("p_brand"), "stock_quantity": F.col("p_size").cast("long"), "images": F.array(F.lit("x,y"), F.lit("z")), "tags": F.array().cast("array<string>"), "category_path": F.array(F.lit("a"), F.lit("b > c")), "price": price, "weight": measure(F.col("p_size"), "g"), "dimensions": F.struct(measure(F.col("p_size"), "mm").alias("length"), measure(F.lit(None), None).cast("struct<value:double,unit:string>").alias("width"), measure(F.lit(1), "m").alias("height"))}
    url = F.concat(F.lit("https://s.example.com/p/"), "p_partkey")
    own = p.select(F.concat(F.lit("P"), "p_partkey").alias("sku"), none.alias("parent_sku"), F.lit("simple").alias("kind"), url.alias("source_url"), (F.col("p_partkey") * 10).alias("seq"), F.when(F.col("k") == 0, F.array(axis("Size", F.lit("S"), F.lit("M")))).otherwise(F.array(axis("Brand", F.col("p_brand")), axis("Kind", F.col("p_type")))).alias("attributes"), F.when(F.col("p_partkey") % 7 > 0, F.lit(True)).alias("in_stock"), *[v.alias(c) for c, v in base.items()])
    kid = lambda n, size: p.where("k <= 1").select(none.alias("sku"), F.when(F.col("k") == 0, F.concat(F.lit("P"), "p_partkey")).otherwise("gone").alias("parent_sku"), F.lit("variation").alias("kind"), F.concat(F.lit("https://s.example.com/v/"), "p_partkey").alias("source_url"), (F.col("p_partkey") * 10 + n).alias("seq"), F.array(axis("Size", F.lit(size))).alias("attributes"), F.lit(True).alias("in_stock"), *[v.alias(c) for c, v in base.items()])
    every = own.unionByName(kid(1, "S")).unionByName(kid(2, "M")).withColumn("attribute_values", F.flatten(F.transform("attributes", lambda a: a["values"])))
    rows, issues, _ = X.woo_import(K.assign_skus(every), currency="EUR", unit="toman")
    codes = issues.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return codes.join(rows, "seq", "full").select("seq", "Type", "SKU", "Name", F.col("`In stock?`").alias("in_stock"), "Stock", F.col("`Weight (kg)`").alias("kg"), F.col("`Length (cm)`").alias("length"), F.col("`Width (cm)`").alias("width"), F.col("`Height (cm)`").alias("height"), F.col("`Sale price`").alias("sale"), F.col("`Regular price`").alias("regular"), "Categories", "Images", "Parent", "Position", F.col("`Attribute 1 name`").alias("a1"), F.col("`Attribute 1 value(s)`").alias("v1"), F.col("`Attribute 2 name`").alias("a2"), F.col("Description"), F.coalesce("codes", F.lit("")).alias("codes"))


@query
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    """What products of the first tier lack, and the layers that filled what they have."""
    p = read(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 4 == 0, "variation").when(F.col("p_partkey") % 4 == 1, "variable").otherwise("simple").alias("kind"), "p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 > 0, F.lit(0.0)).alias("regular"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("images"), F.lit("  ").alias("description"), F.array().cast("array<string>").alias("attributes"))
    return R.missing_tier1(p, ["name", "regular", "images", "attributes"]).select("p_partkey", F.array_join("missing", ",").alias("missing"), "needs_more")


@query
def field_sources(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_brand", F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("layer"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("name"), F.create_map(F.lit("name"), F.when(F.col("p_partkey") % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5))).alias("field_confidence"))
    return R.field_sources(p, ["name"], scope=["p_brand"]).select("p_brand", "field", F.array_join("sources", " and ").alias("sources"))


@query
def scan_failures(spark: SparkSession, d: str) -> DataFrame:
    """The first error that ended each user's scan, and their first warnings."""
    k = F.pmod("seq", F.lit(4))
    i = _log(spark, d).select("scan_id", "seq", F.col("event_type").alias("code"), F.concat(F.lit("m"), "seq").alias("message"), F.when(k < 2, "error").otherwise("warning").alias("severity"), F.when(k == 1, "network").otherwise("other").alias("kind"))
    first = R.blocking_issue(i, scope=["scan_id"]).select("scan_id", F.lit("failed").alias("what"), "message")
    return first.unionByName(R.top_warnings(i, 2).select("scan_id", F.lit("warning").alias("what"), "message"))


@query
def scan_summaries(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d)
    products = e.select("scan_id", F.when(F.col("seq") % 3 == 0, "variation").otherwise("simple").alias("kind"))
    pages = e.select("scan_id", F.when((F.col("scan_id") % 10 == 0) & (F.col("seq") % 5 == 0), "captcha").alias("block"))
    return R.scan_summary(products, pages)


@query
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers as models give them: plain, fenced, wrapped in words, or none."""
    k = F.col("event_id") % 5
    body = F.concat(F.lit('{"name":"'), "event_type", F.lit('"}'))
    text = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure. "), body, F.lit(" Done."))).when(k == 3, F.concat(F.lit("["), body, F.lit("]"))).otherwise("no")
    return R.parse_answers(read(spark, d, "events").select("event_id", text.alias("text"))).select("event_id", F.try_variant_get("answer", "$.name", "string").alias("name"))


@query
def verify_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of several fields against whole documents: words of the text, numbers of it in other forms, invented ones."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ۱٬۲۵۰٬۰۰۰ <img src=/p/a.jpg>")).alias("fragment"))
    asked = [("regular", "1250000.00"), ("regular", "0"), ("regular", "98989898989"), ("images", "https://x.example.com/p/a.jpg?v=2"), ("images", "data:image"), ("brand", "zzqqxxvv product"), ("sku", "IMG  SRC"), ("stock_quantity", "7")]
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(k).alias("k")) for k, (f, v) in enumerate(asked)])
    a = docs.select("request_id", F.explode(values).alias("v")).select("request_id", "v.*")
    return R.verify_answers(a, docs).groupBy(F.col("k").cast("long").alias("k"), "present").agg(F.count(F.lit(1)).alias("n"))


ORACLES |= {
    "platforms": """WITH a AS (SELECT o_orderkey AS page_id, o_orderkey % 5 AS k FROM orders)
      SELECT page_id, 'woocommerce' AS target, 0.9::DOUBLE AS confidence, 'generator meta names WooCommerce,body class woocommerce-page' AS labels, true AS adapter, 1::BIGINT AS rank FROM a WHERE k = 0
      UNION ALL SELECT page_id, 'shopify', 0.3, 'shopify-features script', true, 1 FROM a WHERE k = 1 UNION ALL SELECT page_id, 'nextjs', 1.0, '__NEXT_DATA__ script,/_next/static asset path', true, 1 FROM a WHERE k = 2
      UNION ALL SELECT page_id, 'unknown', 0.0, '', false, 1 FROM a WHERE k = 3 UNION ALL SELECT page_id, 'opencart', 0.8, 'catalog/view/theme asset,index.php?route= link', false, 1 FROM a WHERE k = 4 UNION ALL SELECT page_id, 'shopify', 0.4, 'myshopify.com host', true, 2 FROM a WHERE k = 4""",
    "pagination_signals": """SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 0 THEN 'rel="next" link' WHEN 1 THEN CASE WHEN o_orderkey % 3 < 2 THEN 'numbered pagination, page ' || (o_orderkey % 3 + 1) || ' of 3' ELSE 'numbered pagination exhausted at page 3' END
      WHEN 2 THEN 'control labelled "Load MORE products"; next page URL in data-next' WHEN 3 THEN 'infinite-scroll markup' WHEN 5 THEN 'load-more control' ELSE '' END AS signals FROM orders""",
    "pagination_plans": """WITH a AS (SELECT o_orderkey AS page_id, o_orderkey % 7 AS k, o_orderkey % 3 + 1 AS n, 'https://s.example.com/c/page/' AS u FROM orders),
      b AS (SELECT *, CASE k WHEN 0 THEN 'rel-next' WHEN 1 THEN CASE WHEN n < 3 THEN 'numbered' ELSE 'none' END WHEN 2 THEN 'load-more' WHEN 3 THEN 'infinite-scroll' WHEN 5 THEN 'load-more' ELSE 'none' END AS strategy,
        CASE k WHEN 0 THEN u || '9' WHEN 1 THEN CASE WHEN n < 3 THEN u || (n + 1) END WHEN 2 THEN u || n || '/x?page=4' END AS next_url FROM a)
      SELECT page_id, strategy, next_url, n AS current_page, CASE WHEN k = 1 THEN 3::BIGINT END AS last_page, next_url IS NOT NULL AS automatable FROM b""",
    "missing_fields": """WITH a AS (SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'regular' END, CASE WHEN p_partkey % 2 = 1 THEN 'images' END, CASE WHEN p_partkey % 4 = 1 THEN 'attributes' END) AS missing FROM part)
      SELECT p_partkey, missing, p_partkey % 4 <> 0 AND missing <> '' AS needs_more FROM a""",
    "field_sources": """WITH a AS (SELECT p_brand, bool_or(p_partkey % 2 = 0) AS a, bool_or(p_partkey % 2 = 1) AS b FROM part WHERE p_partkey % 3 > 0 GROUP BY 1)
      SELECT p_brand, 'name' AS field, concat_ws(' and ', CASE WHEN a THEN 'the shop’s own product API (certain)' END, CASE WHEN b THEN 'the page’s structured data (probable)' END) AS sources FROM a""",
    "scan_failures": """SELECT user_id AS scan_id, 'failed' AS what, 'm' || min(event_id) AS message FROM events WHERE event_id % 4 = 1 GROUP BY 1
      UNION ALL SELECT user_id, 'warning', 'm' || event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_id % 4 >= 2) WHERE r <= 2""",
    "scan_summaries": """SELECT user_id AS scan_id, count(*) AS requests, count(*) FILTER (NOT (user_id % 10 = 0 AND event_id % 5 = 0)) AS pages, count(*) AS rows, count(*) FILTER (event_id % 3 > 0) AS products, count(*) FILTER (event_id % 3 = 0) AS variations,
      CASE WHEN bool_or(user_id % 10 = 0 AND event_id % 5 = 0) THEN 'blocked' ELSE 'complete' END AS status FROM events GROUP BY 1""",
    "model_answers": "SELECT event_id, CASE WHEN event_id % 5 <= 3 THEN event_type END AS name FROM events",
    "verify_values": """WITH a AS (SELECT doc_id, coalesce(text, '') || ' ۱٬۲۵۰٬۰۰۰ <img src=/p/a.jpg>' AS t FROM documents), b AS (SELECT *, regexp_replace(translate(t, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789'), '[^0-9]', '', 'g') AS d FROM a),
      c AS (SELECT 0 AS k, true AS present FROM b UNION ALL SELECT 1, false FROM b UNION ALL SELECT 2, contains(d, '98989898989') FROM b UNION ALL SELECT 3, true FROM b UNION ALL SELECT 4, false FROM b UNION ALL SELECT 5, contains(lower(t), 'zzqqxxvv product') FROM b UNION ALL SELECT 6, true FROM b UNION ALL SELECT 7, true FROM b)
      SELECT k::BIGINT AS k, present, count(*) AS n FROM c GROUP BY 1, 2""",
    "import_rows": """WITH p AS (SELECT *, p_partkey % 4 AS k, round(p_retailprice, 2) AS r FROM part),
      f AS (SELECT *, regexp_replace(regexp_replace((floor(CASE WHEN p_partkey % 6 = 0 THEN p_retailprice * 0.1::DOUBLE ELSE p_retailprice END * 1000000 + 0.5) / 1000000)::DECIMAL(30, 6)::VARCHAR, '0+$', ''), '\\.$', '') AS full_,
        CASE WHEN p_partkey % 5 = 0 THEN regexp_replace(regexp_replace((floor(CASE WHEN p_partkey % 6 = 0 THEN p_retailprice / 2 * 0.1::DOUBLE ELSE p_retailprice / 2 END * 1000000 + 0.5) / 1000000)::DECIMAL(30, 6)::VARCHAR, '0+$', ''), '\\.$', '') ELSE '' END AS half,
        p_partkey % 3 = 0 AND p_partkey % 6 <> 0 AS assumed FROM p),
      kid AS (SELECT *, unnest([1, 2]) AS n FROM f WHERE k <= 1),
      codes AS (SELECT p_partkey * 10 AS seq, concat_ws(',', 'category-separator-in-name', CASE WHEN assumed AND k <> 0 THEN 'currency-unit-assumed' END, CASE WHEN assumed AND k <> 0 AND p_partkey % 5 = 0 THEN 'currency-unit-assumed' END, CASE WHEN p_partkey % 7 = 0 THEN 'stock-status-assumed' END) AS codes FROM f
        UNION ALL SELECT p_partkey * 10 + n, concat_ws(',', 'category-separator-in-name', CASE WHEN assumed THEN 'currency-unit-assumed' END, CASE WHEN assumed AND p_partkey % 5 = 0 THEN 'currency-unit-assumed' END, CASE WHEN k = 1 THEN 'orphan-variation' END,
          CASE WHEN k = 1 AND row_number() OVER (PARTITION BY k, n ORDER BY p_partkey) > 1 THEN 'sku-deduplicated' END) FROM kid),
      g AS (SELECT p_partkey * 10 AS seq, CASE WHEN k = 0 THEN 'variable' ELSE 'simple' END AS "Type", 'P' || p_partkey AS "SKU", p_name, p_size, CASE WHEN k <> 0 THEN half ELSE '' END AS sale, CASE WHEN k <> 0 THEN full_ ELSE '' END AS regular, '' AS "Parent", '' AS "Position", CASE WHEN k = 0 THEN 'Size' ELSE 'Brand' END AS a1, CASE WHEN k = 0 THEN 'S, M' ELSE p_brand END AS v1, CASE WHEN k = 0 THEN '' ELSE 'Kind' END AS a2 FROM f
        UNION ALL SELECT p_partkey * 10 + n, 'variation', 'P' || p_partkey || CASE WHEN n = 1 THEN '-s' ELSE '-m' END, p_name, p_size, half, full_, 'P' || p_partkey, (n - 1)::VARCHAR, 'Size', CASE WHEN n = 1 THEN 'S' ELSE 'M' END, '' FROM kid WHERE k = 0)
      SELECT coalesce(g.seq, codes.seq) AS seq, "Type", "SKU", p_name AS "Name", CASE WHEN g.seq IS NOT NULL THEN '1' END AS in_stock, p_size::VARCHAR AS "Stock", regexp_replace(regexp_replace((p_size / 1000)::DECIMAL(30, 6)::VARCHAR, '0+$', ''), '\\.$', '') AS kg, regexp_replace(regexp_replace((p_size / 10)::DECIMAL(30, 6)::VARCHAR, '0+$', ''), '\\.$', '') AS length,
        CASE WHEN g.seq IS NOT NULL THEN '' END AS width, CASE WHEN g.seq IS NOT NULL THEN '100' END AS height, sale, regular, CASE WHEN g.seq IS NOT NULL THEN 'a > b > c' END AS "Categories", CASE WHEN g.seq IS NOT NULL THEN 'x\\,y, z' END AS "Images", "Parent", "Position", a1, v1, a2, CASE WHEN g.seq IS NOT NULL THEN '' END AS "Description", codes FROM codes FULL JOIN g USING (seq)""",
}


@query
def normalized_prices(spark: SparkSession, d: str) -> DataFrame:
    """Price texts of line items in one unit, and what is to be said of them."""
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"), "l_linenumber", F.floor("l_extendedprice").cast("long").alias("n"))
    m = F.col("l_linenumber") % 5
    text = F.when(m == 0, F.concat(F.col("n").cast("string"), F.lit(" toman"))).when(m == 1, F.concat(F.lit("IRR "), F.col("n").cast("string"))).when(m == 2, F.concat(F.lit("€"), (F.col("n") % 900 + 100).cast("string"), F.lit(",125"))).when(m == 3, F.col("n").cast("string")).otherwise("ask us")
    out, issues = N.normalize_prices(li.select("k", text.alias("price")), ["price"], key="k", unit="rial")
    codes = issues.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return out.join(codes, "k", "left").select("k", F.col("price.amount").alias("amount"), F.col("price.currency").alias("currency"), F.col("price.unit").alias("unit"), F.coalesce("codes", F.lit("")).alias("codes"))


@query
def normalized_measures(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 4
    text = F.concat(F.col("p_size").cast("string"), F.when(m == 0, " kilos").when(m == 1, '"').when(m == 2, " میلیمتر").otherwise(" pieces"))
    out = N.normalize_measures(read(spark, d, "part").select("p_partkey", text.alias("size")), ["size"], weight="g", dimension="mm")
    return out.select("p_partkey", F.col("size.value").alias("value"), F.col("size.unit").alias("unit"))


@query
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The events as a log of JSON lines; a fourth of them below the level, some broken."""
    e = read(spark, d, "events")
    k = F.pmod("event_id", F.lit(5))
    line = F.to_json(F.struct(F.when(k == 0, "debug").when(k == 1, "error").otherwise("info").alias("level"), F.col("event_type").alias("event"), F.col("event_id").alias("n"), F.lit("s").alias("auth_token"), F.lit("m").alias("monkey"), F.struct(F.lit("x").alias("password"), F.lit("y").alias("user")).alias("who")))
    out = N.redact_log(e.select(F.when(k == 4, F.concat(F.lit("{"), line)).otherwise(line).alias("value")))
    f = F.col("fields")
    return out.select(f["n"].cast("long").alias("n"), f["event"].alias("event"), f["auth_token"].alias("auth_token"), f["monkey"].alias("monkey"), f["who"].alias("who"))


@query
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of orders in many spellings, to one key each; and their profiles by host."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey") % 3
    n = F.col("o_orderkey").cast("string")
    url = F.when(k == 0, F.concat(F.lit("HTTP://WWW.Shop.com:80/shop/کفش/"), n, F.lit("/page/2/?b=%20&utm_source=x&a=1#f"))).when(k == 1, F.concat(F.lit("https://shop.com/x/../product-category/"), n, F.lit("?page=7"))).otherwise(F.concat(F.lit("https://other.com/"), n))
    keys = N.canonicalize_urls(o.select("o_orderkey", url.alias("url")), "url")
    profiles = spark.createDataFrame([(1, "www.SHOP.com"), (2, "third.com")], "profile_id long, domain string")
    found = N.profiles_for_pages(keys.select("o_orderkey", "url"), profiles).select("o_orderkey", "profile_id")
    return keys.join(found, "o_orderkey", "left").select("o_orderkey", "url_key", "host", "page_no", "category_slug", "profile_id")


@query
def api_responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers of an endpoint: JSON, an error page, an error status; with the number of pages in a header."""
    e, k = read(spark, d, "events"), F.pmod("event_id", F.lit(4))
    r = e.select("event_id", F.when(k == 2, 404).otherwise(200).alias("status"), F.create_map(F.lit("X-WP-TotalPages"), F.when(k == 3, "many").otherwise(F.col("user_id").cast("string"))).alias("headers"), F.when(k == 1, "<html>off").otherwise('[{"id":1},{"id":2}]').alias("body"))
    return A.read_api_responses(r).select("event_id", F.size(G.as_array(F.col("json"))).cast("long").alias("n"), F.col("total_pages").cast("long").alias("total_pages"))


@query
def choose_layer(spark: SparkSession, d: str) -> DataFrame:
    """Lines as answers of an order's APIs, orders as its own readings: the reading that counts for each order."""
    item, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    api = item.select(F.col("l_orderkey").alias("page_id"), F.lit("api").alias("layer"), F.col("l_linenumber").alias("seq"), (F.col("l_quantity").cast("long") % 4).alias("n"), (F.col("l_partkey") % 2 == 0).alias("incomplete"), (F.col("l_suppkey") % 5 == 0).alias("blocked"))
    own = lambda name, n: o.select(F.col("o_orderkey").alias("page_id"), F.lit(name).alias("layer"), n.alias("n"))
    markup, profile = own("markup", F.col("o_orderkey") % 3 * 2).where("n > 0 or page_id % 2 = 0"), own("profile", F.col("o_custkey") % 3)
    return D.choose_layer(api.unionByName(markup, allowMissingColumns=True).unionByName(profile, allowMissingColumns=True))


@query
def walk_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a host as a ring in order of their ids, some of them missing; how the walk from the first one ends after ten pages at most."""
    p = read(spark, d, "pages").select("page_id", T.profile_domain(F.col("url")).alias("seed"), F.col("page_id").cast("string").alias("url"))
    first = p.groupBy("seed").agg(F.min("page_id").cast("string").alias("first"))
    ring = p.withColumn("next_url", F.lead("url").over(W.partitionBy("seed").orderBy("page_id"))).join(first, "seed").withColumn("next_url", F.coalesce("next_url", "first"))
    there = ring.where(F.col("page_id") % 7 != 3)
    walk = R.walk_pagination(there, first.select("seed", F.col("first").alias("url")), max_pages=10)
    return R.walk_statuses(walk, there, max_pages=10)


ORACLES |= {
    "walk_statuses": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY page_id) AS rn FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS seed FROM pages)),
      s AS (SELECT seed, count(*) AS n, min(rn) FILTER (WHERE page_id % 7 = 3) AS gone FROM p GROUP BY seed)
      SELECT seed, least(10, n, coalesce(gone, n))::BIGINT AS n_pages, CASE WHEN gone <= 10 THEN 'page-unavailable' WHEN n > 10 THEN 'budget-reached' ELSE 'complete' END AS status FROM s""",
    "choose_layer": """WITH a AS (SELECT * FROM (SELECT l_orderkey AS k, l_linenumber AS seq, l_quantity::BIGINT % 4 AS n, l_partkey % 2 = 0 AS part, l_suppkey % 5 = 0 AS blocked FROM lineitem) WHERE blocked OR n > 0
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq, blocked DESC, n DESC, part) = 1),
      p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 * 2 ELSE o_custkey % 3 END AS own, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 3 > 0 THEN 'profile' ELSE 'markup' END AS own_layer FROM orders),
      j AS (SELECT coalesce(p.k, a.k) AS k, a.seq, a.n, a.part, a.blocked, coalesce(own, 0) AS own, coalesce(own_layer, 'markup') AS own_layer, coalesce(a.blocked OR NOT a.part OR coalesce(own, 0) <= a.n, FALSE) AS api FROM p FULL JOIN a ON p.k = a.k)
      SELECT k AS page_id, CASE WHEN api THEN 'api' ELSE own_layer END AS layer, CASE WHEN api THEN seq::BIGINT END AS seq, CASE WHEN api AND blocked THEN 0 WHEN api THEN n ELSE own END::BIGINT AS n, api AND (blocked OR part) AS incomplete, coalesce(blocked, FALSE) AS blocked FROM j""",
    "normalized_prices": """WITH a AS (SELECT l_orderkey * 100 + l_linenumber AS k, l_linenumber % 5 AS m, floor(l_extendedprice)::BIGINT AS n FROM lineitem)
      SELECT k, CASE m WHEN 0 THEN n * 10.0::DOUBLE WHEN 1 THEN n::DOUBLE WHEN 2 THEN ((n % 900 + 100) * 1000 + 125)::DOUBLE WHEN 3 THEN n::DOUBLE END AS amount, CASE m WHEN 0 THEN 'IRR' WHEN 1 THEN 'IRR' WHEN 2 THEN 'EUR' WHEN 3 THEN '' END AS currency, CASE m WHEN 0 THEN 'rial' END AS unit,
        CASE m WHEN 1 THEN 'price-unit-unknown' WHEN 2 THEN 'price-separator-ambiguous' WHEN 3 THEN 'price-currency-missing' ELSE '' END AS codes FROM a""",
    "normalized_measures": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 1 THEN floor(p_size * 25.4::DOUBLE * 1000000 + 0.5) / 1000000 WHEN 2 THEN p_size::DOUBLE END AS value, CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'mm' WHEN 2 THEN 'mm' END AS unit FROM part",
    "log_lines": """SELECT event_id AS n, event_type AS event, '[redacted]' AS auth_token, 'm' AS monkey, '{"password":"[redacted]","user":"y"}' AS who FROM events WHERE event_id % 5 IN (1, 2, 3)""",
    "url_keys": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'http://www.shop.com/shop/%DA%A9%D9%81%D8%B4/' || o_orderkey || '/page/2?a=1&b=+' WHEN 1 THEN 'https://shop.com/product-category/' || o_orderkey || '?page=7' ELSE 'https://other.com/' || o_orderkey END AS url_key,
      CASE WHEN o_orderkey % 3 < 2 THEN 'shop.com' ELSE 'other.com' END AS host, CASE o_orderkey % 3 WHEN 0 THEN 2::BIGINT WHEN 1 THEN 7 END AS page_no, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey::VARCHAR END AS category_slug, CASE WHEN o_orderkey % 3 < 2 THEN 1::BIGINT END AS profile_id FROM orders""",
    "api_responses": "SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN event_id % 4 <> 3 THEN user_id END::BIGINT AS total_pages FROM events",
}
