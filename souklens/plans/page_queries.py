"""Queries over pages by taught profiles and embedded state, over `pages` with its own markup and pages rendered from `part`."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from souklens.functions import text as T
from souklens.plans.lineage import shared_folder, spread
from souklens.plans.queries import query, read
from souklens.sources import embedded as E, profiles as P
from souklens.streaming import state as S

PROFILES = (
    (1, '{"version":1,"domain":"www.Shop.example.com","card":{"container":"ul.grid > li.card","fields":{"name":{"selector":".title a","from":"text"},"url":{"selector":".title > a","from":"attribute","attribute":"href"},"image":{"selector":"li img[src]","from":"attribute","attribute":"src"},"regularPrice":{"selector":"s.was","from":"text"},"salePrice":{"selector":".price","from":"text"},"availability":{"selector":"[data-stock]","from":"attribute","attribute":"data-stock"}}}}'),
    (2, '{"version":1,"domain":"shop.example.com","card":{"container":"aside li, aside dl","fields":{"name":{"selector":"h3","from":"text"}}}}'),
    (3, '{"version":1,"domain":"other.example","card":{"container":"ul.grid li:nth-of-type(2)","fields":{"name":{"selector":"h3.title","from":"text"},"sku":{"selector":".nope","from":"text"}}}}'),
    (4, '{"version":1,"domain":"gone.example","card":{"container":"li","fields":{"name":{"selector":"h3","from":"text"}}}}'),
    (5, '{"version":1,"domain":"other.example","card":{"container":"ul[","fields":{"name":{"selector":"h3","from":"text"}}}}'),
    (6, '{"version":2,"domain":"other.example","card":{"container":"ul","fields":{"bogus":{"selector":"h3","from":"text"}}}}'),
)
CARDS = """<![foo[x]]><ul class="grid"><li class="tile card"><h3 class="title"><a href="/p/{k}?utm_source=z">Item <b>{k}</b><script>var x = "no";</script></a></h3><img src="i/{k}.jpg"><span class="price">{p} EUR</span>
<li class="card tile" data-n='2'><h3 class="title"><a href="mailto:x">Second {k}</a></h3><s class="was">1{p} EUR</s><span class="price">{p} EUR</span><i data-stock="in stock"></i></li>{promo}</ul><aside><li class="tile"><h3 class="title"> Not
 here </h3></li></aside><![ x"""


def carded_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page of two cards for each part, and of a third one without a name for every third; every fifth has no id, and others' ids repeat."""
    part = spread(read(spark, d, "part"))
    html = F.lit(CARDS)
    promo = F.when(F.col("p_partkey") % 3 == 0, '<li class="card promo"><p>Only today').otherwise("")
    for mark, value in (("{k}", F.col("p_partkey").cast("string")), ("{p}", F.format_string("%.2f", "p_retailprice")), ("{promo}", promo)):
        html = F.replace(html, F.lit(mark), value)
    k = F.col("p_partkey")
    host = F.when(k % 2 == 0, "https://shop.example.com/c/").otherwise("https://www.other.example/c/")
    return part.select(F.when(k % 5 > 0, k - F.when(k % 5 == 2, 1).otherwise(0)).alias("page_id"), F.concat(host, k.cast("string")).alias("url"), html.alias("html"))


def _taught(spark: SparkSession) -> DataFrame:
    return P.read_profiles(spark.createDataFrame(PROFILES, "profile_id long, json string")).where(F.size("violations") == 0)


@query
def profile_products(spark: SparkSession, d: str) -> DataFrame:
    """Cards of all pages by the two profiles of their host; ids of pages are null or repeated, markup is malformed."""
    p = P.profile_products(P.match_profiles(carded_pages(spark, d), _taught(spark)))
    return p.select(
        "page_id", "profile_id", F.col("card").cast("long").alias("card"), "source_url", "name", F.array_join("images", " ").alias("images"), F.round("regular.amount", 2).alias("regular"), F.round("sale.amount", 2).alias("sale"), F.col("regular.currency").alias("currency"), "in_stock",
        F.size("field_confidence").cast("long").alias("n_stated"), F.col("field_confidence")["name"].alias("sure"),
    )


@query
def profile_issues(spark: SparkSession, d: str) -> DataFrame:
    """What the profiles found wrong on which page."""
    return P.profile_issues(P.match_profiles(carded_pages(spark, d), _taught(spark))).select("url", "profile_id", "severity", "code", "field")


@query
def profile_health(spark: SparkSession, d: str) -> DataFrame:
    """Whether each profile still works, over all its pages."""
    profiles = _taught(spark)
    h = P.profile_health(P.match_profiles(carded_pages(spark, d), profiles), profiles)
    return h.select("profile_id", "pages", "cards", F.array_join("broken", ",").alias("broken"), F.array_join("partial", ",").alias("partial"), "healthy")


def _learned(pages: DataFrame) -> DataFrame:
    """Two profiles for each host of `pages`, numbered by the host's least page: its menu, and its articles."""
    doc = '{"version":1,"domain":"%s","card":{"container":"%s","fields":{"name":{"selector":"%s","from":"text"},"url":{"selector":"a[href^=\'/\']","from":"attribute","attribute":"href"},"sku":{"selector":"nav b","from":"text"}}}}'
    hosts = pages.groupBy(T.profile_domain(F.col("url")).alias("host")).agg(F.min("page_id").alias("n")).where("host is not null")
    made = lambda k, container, name: hosts.select((F.col("n") * 2 + k).alias("profile_id"), F.format_string(doc, "host", F.lit(container), F.lit(name)).alias("json"))
    return P.read_profiles(made(0, "body > nav li", "a").unionByName(made(1, "article", "h1:first-of-type")))


@query
def profile_menus(spark: SparkSession, d: str) -> DataFrame:
    """The entries of each page's menu, and its headline, by profiles of its host: names, and whether they lead to the page's own host."""
    pages = read(spark, d, "pages").select("page_id", "url", "html")
    p = P.profile_products(P.match_profiles(pages, _learned(pages)))
    own = T.profile_domain(F.col("source_url")) == T.profile_domain(F.col("url"))
    return p.select("page_id", (F.col("profile_id") % 2).alias("kind"), F.col("card").cast("long").alias("card"), "name", own.alias("own_host"))


STATES = (
    """<script id="__NEXT_DATA__" type="application/json">{"props":{"collections":[{"id":"c","title":"All","handle":"all"}],"products":[{"title":"Item {k}","handle":"i-{k}","body_html":"<p>a</p>","vendor":"{b}","product_type":"Goods","tags":["x","y"],"images":[{"src":"/i/{k}.jpg"},{"src":"/i/{k}.jpg"}],
      "options":[{"name":"Size","values":["S","M"]},{"name":"Tint","values":[]}],"variants":[{"option1":"S","option2":"red","sku":"{k}-S","price":"{p}","compare_at_price":"9{p}","available":true,"grams":250,"featured_image":"/v.jpg"},{"option1":"M","sku":"{k}-M","price":"{p}","compare_at_price":"0.5","available":false,"grams":0}]},
      {"title":"Second","handle":"i-{k}","variants":[{"price":"1"}]}]}}</script>""",
    """<script>window.__INITIAL_STATE__ = {"a":"br } { \\" ace","list":{"edges":[{"node":{"id":"g{k}","title":"Front {k}","slug":"f-{k}","descriptionHtml":"d","availableForSale":true,"priceRange":{"minVariantPrice":{"amount":"{p}","currencyCode":"EUR"}},"compareAtPrice":"9{p}","images":{"edges":[{"node":{"originalSrc":"f.jpg"}}]}}}]},}; go();</script>""",
    """<script>Shopify.currency = {"active":"CAD","rate":"1.0"};</script><script id="__NUXT_DATA__" type="application/json">[1,{"title":"Lone {k}","handle":"l-{k}","options":[{"name":"Title","values":["Default Title"]}],"variants":[{"option1":"Default Title","sku":"L{k}","price":"{p}","available":true}]},{"name":"tile","price":3}]</script>""",
    """<script>window.__NUXT__ = {"title":"Open {k}","id":"x","price":"{p}"</script><script id="__APOLLO_STATE__">{broken {k}}</script>""",
)


def _rendered(spark: SparkSession, d: str, shapes: tuple[str, ...]) -> DataFrame:
    """A page for each part, in turn of each shape; every fifth has no id, and others' ids repeat."""
    part, k = spread(read(spark, d, "part")), F.col("p_partkey")
    html = F.element_at(F.array(*map(F.lit, shapes)), (k % len(shapes) + 1).cast("int"))
    for mark, value in (("{k}", k.cast("string")), ("{b}", F.col("p_brand")), ("{p}", F.format_string("%.2f", "p_retailprice"))):
        html = F.replace(html, F.lit(mark), value)
    return part.select(F.when(k % 5 > 0, k - F.when(k % 5 == 2, 1).otherwise(0)).alias("page_id"), F.concat(F.lit("https://s.example.com/c/"), k.cast("string")).alias("url"), html.alias("html"))


def _attributes(c: str) -> Column:
    return F.array_join(F.transform(c, lambda a: F.concat_ws("=", a["name"], F.array_join(a["values"], "|"))), ";")


@query
def embedded_products(spark: SparkSession, d: str) -> DataFrame:
    """Products that pages carry in their scripts' state, of both shapes, with states that are half open, broken or hold no product."""
    p = E.read_embedded_state(E.embedded_states(_rendered(spark, d, STATES)))
    return p.select(
        "page_id", "url", "label", F.col("row").cast("long").alias("row"), "source_url", "kind", "name", "description", "brand", F.array_join("category_path", ">").alias("category"), F.array_join("tags", ",").alias("tags"), F.array_join("images", " ").alias("images"), _attributes("attributes").alias("attributes"), "sku", "in_stock",
        F.round("regular.amount", 2).alias("regular"), F.round("sale.amount", 2).alias("sale"), F.col("regular.currency").alias("currency"), F.col("weight.value").alias("grams"), F.col("confidence").cast("double").alias("confidence"),
    )


@query
def collection_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Collection answers of parts by brand and size, a variant for each part, with pages that repeat products: each product once, as first seen."""
    part = read(spark, d, "part").withColumn("g", F.concat(F.lit("h"), F.regexp_extract("p_brand", r"(\d+)$", 1), F.lit("-"), F.col("p_size").cast("string")))
    variant = F.struct(F.col("p_partkey").alias("id"), F.col("p_type").alias("option1"), F.concat(F.lit("V"), "p_partkey").alias("sku"), F.format_string("%.2f", "p_retailprice").alias("price"), F.lit(True).alias("available"), F.col("p_size").alias("grams"))
    made = part.groupBy("g", "p_size").agg(F.sort_array(F.collect_list(variant)).alias("variants"))
    product = lambda title: F.struct(F.lit(title).alias("title"), F.col("g").alias("handle"), F.lit("Brand").alias("vendor"), F.array(F.struct(F.lit("Type").alias("name"), F.col("variants.option1").alias("values"))).alias("options"), "variants")
    pages = made.select("p_size", F.explode(F.array(F.struct(F.lit(1).alias("seq"), product("First").alias("p")), F.struct(F.lit(2).alias("seq"), product("Again").alias("p")))).alias("x")).select((F.col("p_size") * 2 + F.col("x.seq")).alias("seq"), "x.p")
    body = pages.groupBy("seq").agg(F.to_json(F.struct(F.collect_list("p").alias("products"))).alias("body")).withColumn("url", F.lit("https://s.example.com/collections/all/products.json"))
    p = E.read_collection_json(body, default_currency="EUR")
    return p.select("source_url", F.col("row").cast("long").alias("row"), "kind", "name", "sku", F.round("regular.amount", 2).alias("regular"), F.col("regular.currency").alias("currency"), F.size(F.coalesce(F.col("attributes")[0]["values"], F.array())).cast("long").alias("n_values"), F.col("weight.value").alias("grams"), "in_stock")


def _in_thirds(spark: SparkSession, d: str, columns: list[Column], shape, *, mode: str) -> DataFrame:
    """The events in three steps by their ids, each landed and streamed to its end before the next, from one checkpoint; what each run
    emitted, with its number in batch."""
    events = read(spark, d, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    third = F.floor((F.col("event_id") - (low or 0)) * 3 / ((high or 0) - (low or 0) + 1))
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    S.landed_in_steps([events.where(third == k).select(*columns) for k in range(3)], at, S.stream_session(spark), shape, mode=mode)
    return spark.read.parquet(f"{at}/out")


def _block() -> Column:
    return F.when(F.col("event_id") % 13 == 0, "captcha").alias("block")


@query
def stream_latched(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user before the first that is blocked, streamed in three runs."""
    columns = [F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq"), "event_type", _block()]
    return _in_thirds(spark, d, columns, S.stream_block_latch, mode="append").select("scan_id", "seq", "event_type")


@query
def stream_scan_state(spark: SparkSession, d: str) -> DataFrame:
    """How far each user's scan came in three runs: pages read once, repeats, products, and whether it was blocked."""
    columns = [F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("url"), (F.col("event_id") % 4).alias("n_products"), _block()]
    out = _in_thirds(spark, d, columns, S.stream_scans, mode="update")
    return out.groupBy("scan_id").agg(F.max_by(F.struct("pages", "repeats", "products", "last_seq", "status"), "batch").alias("s")).select("scan_id", "s.*")


@query
def stream_product_state(spark: SparkSession, d: str) -> DataFrame:
    """The surest kind of each user's events after three runs, and how often it was emitted: once for each run that changed it."""
    columns = [F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.round("value", 2).alias("kind_conf")]
    out = _in_thirds(spark, d, columns, lambda e: S.stream_products(e, ["kind"], key="key", seq="seq"), mode="update")
    return out.groupBy("key").agg(F.max_by("kind", "batch").alias("kind"), F.min("first_seq").alias("first_seq"), F.count(F.lit(1)).alias("n_emitted"))


ORACLES = {
    "stream_latched": """SELECT user_id AS scan_id, event_id AS seq, event_type FROM events JOIN (SELECT user_id, min(event_id) FILTER (event_id % 13 = 0) AS b FROM events GROUP BY 1) USING (user_id) WHERE b IS NULL OR event_id < b""",
    "stream_scan_state": """WITH e AS (SELECT user_id AS k, event_id AS s, event_type || (event_id % 3) AS url, event_id % 4 AS n, min(CASE WHEN event_id % 13 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS b FROM events),
      f AS (SELECT *, row_number() OVER (PARTITION BY k, url ORDER BY s) = 1 AS fresh FROM e WHERE b IS NULL OR s < b)
      SELECT k AS scan_id, count(url) FILTER (fresh) AS pages, count(url) FILTER (NOT fresh) AS repeats, coalesce(sum(n) FILTER (fresh), 0)::BIGINT AS products, coalesce(any_value(x.b), max(s)) AS last_seq, CASE WHEN any_value(x.b) IS NULL THEN 'running' ELSE 'blocked' END AS status
      FROM (SELECT DISTINCT k, b FROM e) x LEFT JOIN (SELECT k, s, url, n, fresh FROM f) USING (k) GROUP BY k""",
    "stream_product_state": """WITH e AS (SELECT user_id AS key, event_id AS s, event_type AS kind, round(value, 2) AS c, (event_id - min(event_id) OVER ()) * 3 // (max(event_id) OVER () - min(event_id) OVER () + 1) AS step FROM events),
      b AS (SELECT key, t, arg_max(s, {'a': c, 'b': -s}) AS best, arg_max(kind, {'a': c, 'b': -s}) AS kind, min(s) AS first_seq FROM e JOIN (SELECT unnest([0, 1, 2]) AS t) ON step <= t GROUP BY key, t)
      SELECT key, arg_max(kind, t) AS kind, min(first_seq) AS first_seq, count(DISTINCT best) AS n_emitted FROM b GROUP BY key""",
    "embedded_products": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 2 THEN p_partkey - 1 WHEN p_partkey % 5 > 0 THEN p_partkey END AS page_id, 'https://s.example.com/c/' || p_partkey AS url, p_brand AS b, printf('%.2f', p_retailprice) AS t FROM part),
      c AS (SELECT page_id, url, '__NEXT_DATA__' AS label, 0 AS row, 'https://s.example.com/products/i-' || k AS source_url, 'variable' AS kind, 'Item ' || k AS name, '<p>a</p>' AS description, b AS brand, 'Goods' AS category, 'x,y' AS tags, 'https://s.example.com/i/' || k || '.jpg' AS images, 'Size=S|M' AS attributes,
          NULL AS sku, NULL AS in_stock, NULL AS regular, NULL AS sale, NULL AS currency, NULL AS grams, 1.0 AS confidence FROM p WHERE k % 4 = 0 UNION ALL
        SELECT page_id, url, '__NEXT_DATA__', 1, 'https://s.example.com/products/i-' || k, 'variation', 'Item ' || k, NULL, NULL, '', '', 'https://s.example.com/v.jpg', 'Size=S;Tint=red', k || '-S', true, ('9' || t)::DOUBLE, t::DOUBLE, '', 250, 1.0 FROM p WHERE k % 4 = 0 UNION ALL
        SELECT page_id, url, '__NEXT_DATA__', 2, 'https://s.example.com/products/i-' || k, 'variation', 'Item ' || k, NULL, NULL, '', '', '', 'Size=M', k || '-M', false, t::DOUBLE, NULL, '', NULL, 1.0 FROM p WHERE k % 4 = 0 UNION ALL
        SELECT page_id, url, 'window.__INITIAL_STATE__', 0, 'https://s.example.com/products/f-' || k, 'simple', 'Front ' || k, 'd', NULL, '', '', 'https://s.example.com/c/f.jpg', '', NULL, true, ('9' || t)::DOUBLE, t::DOUBLE, 'EUR', NULL, 0.8 FROM p WHERE k % 4 = 1 UNION ALL
        SELECT page_id, url, '__NUXT_DATA__', 0, 'https://s.example.com/products/l-' || k, 'simple', 'Lone ' || k, NULL, NULL, '', '', '', '', 'L' || k, true, t::DOUBLE, NULL, 'CAD', NULL, 1.0 FROM p WHERE k % 4 = 2)
      SELECT page_id, url, label, row::BIGINT AS row, source_url, kind, name, description, brand, category, tags, images, attributes, sku, in_stock::BOOLEAN AS in_stock, regular::DOUBLE AS regular, sale::DOUBLE AS sale, currency, grams::DOUBLE AS grams, confidence::DOUBLE AS confidence FROM c""",
    "collection_catalog": """WITH a AS (SELECT *, 'https://s.example.com/products/h' || regexp_extract(p_brand, '([0-9]+)$', 1) || '-' || p_size AS source_url FROM part),
      v AS (SELECT source_url, row_number() OVER (PARTITION BY source_url ORDER BY p_partkey) AS row, p_partkey AS k, p_retailprice AS v, p_size AS s FROM a)
      SELECT source_url, 0::BIGINT AS row, 'variable' AS kind, 'First' AS name, NULL::VARCHAR AS sku, NULL::DOUBLE AS regular, NULL::VARCHAR AS currency, count(*) AS n_values, NULL::DOUBLE AS grams, NULL::BOOLEAN AS in_stock FROM v GROUP BY source_url UNION ALL
      SELECT source_url, row, 'variation', 'First', 'V' || k, round(v, 2), 'EUR', 1, CASE WHEN s > 0 THEN s::DOUBLE END, true FROM v""",
    "profile_products": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 2 THEN p_partkey - 1 WHEN p_partkey % 5 > 0 THEN p_partkey END AS page_id, round(p_retailprice, 2) AS v, printf('%.2f', p_retailprice) AS t FROM part),
      c AS (SELECT k, page_id, 1 AS profile_id, 0 AS card, 'https://shop.example.com/p/' || k AS source_url, 'Item ' || k AS name, 'https://shop.example.com/c/i/' || k || '.jpg' AS images, v AS regular, NULL AS sale, 'EUR' AS currency, NULL AS in_stock, 4 AS n_stated FROM p WHERE k % 2 = 0 UNION ALL
        SELECT k, page_id, 1, 1, 'https://shop.example.com/c/' || k, 'Second ' || k, '', ('1' || t)::DOUBLE, v, 'EUR', true, 4 FROM p WHERE k % 2 = 0 UNION ALL
        SELECT k, page_id, 2, 0, 'https://shop.example.com/c/' || k, 'Not here', '', NULL, NULL, NULL, NULL, 2 FROM p WHERE k % 2 = 0 UNION ALL
        SELECT k, page_id, 3, 0, 'https://www.other.example/c/' || k, 'Second ' || k, '', NULL, NULL, NULL, NULL, 2 FROM p WHERE k % 2 = 1)
      SELECT page_id, profile_id::BIGINT AS profile_id, card::BIGINT AS card, source_url, name, images, regular::DOUBLE AS regular, sale::DOUBLE AS sale, currency, in_stock::BOOLEAN AS in_stock, n_stated::BIGINT AS n_stated, 0.4::DOUBLE AS sure FROM c""",
    "profile_issues": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'https://shop.example.com/c/' ELSE 'https://www.other.example/c/' END || p_partkey AS url FROM part)
      SELECT url, 1::BIGINT AS profile_id, 'warning' AS severity, 'profile-nameless-cards' AS code, NULL::VARCHAR AS field FROM p WHERE k % 6 = 0 UNION ALL
      SELECT url, 3, 'warning', 'profile-field-missed', 'sku' FROM p WHERE k % 2 = 1 UNION ALL SELECT url, 5, 'error', 'profile-selector-unreadable', NULL FROM p WHERE k % 2 = 1""",
    "profile_health": """WITH n AS (SELECT count(*) FILTER (p_partkey % 2 = 0) AS e, count(*) FILTER (p_partkey % 6 = 0) AS t, count(*) FILTER (p_partkey % 2 = 1) AS o FROM part)
      SELECT 1::BIGINT AS profile_id, e AS pages, 2 * e + t AS cards, '' AS broken, CASE WHEN t > 0 THEN 'name,url,image,regularPrice,salePrice,availability' ELSE 'image,regularPrice,availability' END AS partial, true AS healthy FROM n UNION ALL
      SELECT 2, e, e, '', '', true FROM n UNION ALL SELECT 3, o, o, 'sku', '', false FROM n UNION ALL SELECT 4, 0, 0, 'name', '', false FROM n UNION ALL SELECT 5, o, 0, 'name', '', false FROM n""",
    "profile_menus": r"""WITH p AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '(?s)<li><a href="/[^"]*">(.*?)</a></li>', 1) AS l, regexp_extract(html, '(?s)<article>.*?<h1>(.*?)</h1>', 1) AS h FROM pages),
      c AS (SELECT page_id, 0::BIGINT AS kind, generate_subscripts(l, 1) - 1 AS card, unnest(l) AS t FROM p UNION ALL SELECT page_id, 1, 0, h FROM p),
      n AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS name FROM c)
      SELECT page_id, kind, card::BIGINT AS card, name, true AS own_host FROM n WHERE name <> ''""",
}
