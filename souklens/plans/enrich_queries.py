"""Queries of what is asked about incomplete products: trimmed fragments and requests, over `pages` and pages rendered from `part`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from souklens.operators import enrich as E, reports as R
from souklens.plans.page_queries import _rendered
from souklens.plans.queries import query, read

LONG, CUT = "and on " * 80, 420
# A product below its trail, with furniture; a main part that has its own trail and is cut; a page of no known shape; one without a body.
SHOPS = (
    """<html><head><script>track("{k}")</script></head><body><header class="h">Shop</header><nav aria-label="Breadcrumb"><a href="/c" onclick="x()">All</a> / <b>{b}</b></nav>
  <div itemscope itemtype="https://schema.org/Product" style="color:red" data-gtm="1" data-price="{p}"><h1 class="a b c d e f g h i j">Item   {k}</h1><!-- x --><img src="/i/{k}.jpg" alt="say &quot;hi&quot;"><form><select><option value="1">S<option value="2">M</select></form><div class="Related-Items"><h3>Other {k}</h3></div></div><footer>{b}</footer></body></html>""",
    """<body><main><nav class="breadcrumb">{b}</nav><nav class="menu">no</nav><p>Item {k} &amp; long text of {b} that goes on """ + LONG + """</p><p>behind {k}</p></main><article>no</article></body>""",
    """<body class="home"><p>Item {k}<aside>no</aside><p>{p}<div id="comments"><p>Nice {k}</div></body>""",
    """<p>Loose {k}</p>""",
)


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return E.trim_fragments(_rendered(spark, d, SHOPS), max_chars=CUT)


@query
def trimmed_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of each fragment, of four shapes of pages, one of them cut; ids of pages are null or repeated."""
    return _fragments(spark, d)


@query
def page_fragments(spark: SparkSession, d: str) -> DataFrame:
    """What was chosen of each of `pages`, how much it was of, and how many paragraphs it has; no budget is met."""
    f = E.trim_fragments(read(spark, d, "pages"), max_chars=10**9, max_elements=10**9)
    return f.select("page_id", "root", "source_chars", "truncated", F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"), F.startswith("html", F.lit("<article>")).alias("begins"))


def _asking(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three products a page, the second a variation, of each part; pages by number, every fourth without a fragment."""
    part, k = read(spark, d, "part"), F.col("p_partkey")
    no = lambda kind: F.lit(None).cast(kind)
    product = lambda n, kind, name, regular: part.select(k.alias("page_id"), (k * 10 + n).alias("seq"), F.lit("https://s.example.com/p").alias("source_url"), F.lit(kind).alias("kind"), name.alias("name"), regular.alias("regular"), F.array("p_brand").alias("category_path"), F.when(k % 3 == 0, F.array("p_brand")).alias("images"), F.when(k % 5 > 0, F.col("p_comment") if "p_comment" in part.columns else F.col("p_name")).alias("description"), F.when(k % 7 > 0, F.lit(True)).alias("in_stock"), no("array<string>").alias("attributes"), F.when(k % 2 == 0, "fr").alias("lang"))
    name, price = F.col("p_name"), F.col("p_retailprice").cast("double")
    products = product(1, "simple", name, F.when(k % 2 == 0, price)).unionByName(product(2, "variation", no("string"), no("double"))).unionByName(product(3, "variable", F.when(k % 11 > 0, name), price))
    fragments = part.select(k.alias("page_id"), F.lit("https://s.example.com/p").alias("source_url"), F.when(k % 4 > 0, F.concat(F.lit("<main>"), "p_brand")).otherwise("").alias("html"))
    return products, fragments


WANTED = ["name", "regular", "category_path", "images", "description", "in_stock", "attributes"]


@query
def enrichment_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request a page at most: its fields, what its schema asks for and demands, and its fragment."""
    requests, _ = E.enrichment_requests(*_asking(spark, d), wanted=WANTED, locale="lang")
    doc = lambda path, kind: F.try_variant_get(F.parse_json("schema"), path, kind)
    names: Column = F.array_sort(F.map_keys(F.from_json(doc("$.properties", "string"), "map<string,string>")))
    return requests.select(
        "request_id", "page_id", "seq", F.array_join("fields", ",").alias("fields"), F.array_join(names, ",").alias("asked"), F.array_join(doc("$.required", "array<string>"), ",").alias("required"),
        (~doc("$.additionalProperties", "boolean")).alias("strict"), F.regexp_extract("prompt", "Fields wanted: (.*?)\\.", 1).alias("spoken"), F.endswith("prompt", F.lit(" fr.")).alias("french"), "fragment",
    )


@query
def enrichment_issues(spark: SparkSession, d: str) -> DataFrame:
    """Pages that ask nothing, and products left out by the limit of a page."""
    _, issues = E.enrichment_requests(*_asking(spark, d), wanted=WANTED)
    return issues.select("page_id", "code", "n_products")


@query
def enrichment_round(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered, checked against what was sent, and filled in: a brand that stands in the fragment, and one that doesn't."""
    products, fragments = _asking(spark, d)
    requests, _ = E.enrichment_requests(products, fragments, wanted=WANTED)
    says = F.when(F.col("page_id") % 3 == 1, F.lit("nowhere to be seen")).otherwise(F.regexp_extract("fragment", "<main>(.*)", 1))
    answers = requests.where(F.array_contains("fields", "images")).select("request_id", F.col("seq").alias("product_key"), F.lit("brand").alias("field"), says.alias("value"))
    true = R.verify_answers(answers, requests).where("present").select("product_key", "value")
    p = products.where("kind <> 'variation'").select(F.col("seq").alias("product_key"), F.lit(None).cast("string").alias("brand"), F.lit("B").alias("layer"))
    return R.fill_empty(p, true, "brand").select("product_key", "brand", "filled", "layer")


_LACKS = """(SELECT p_partkey AS k, p_partkey * 10 + n AS seq, n, list_filter([CASE WHEN n = 3 AND p_partkey % 11 = 0 THEN 'name' END, CASE WHEN n = 1 AND p_partkey % 2 = 1 THEN 'regular' END, CASE WHEN p_partkey % 3 > 0 THEN 'images' END, CASE WHEN p_partkey % 5 = 0 THEN 'description' END,
  CASE WHEN p_partkey % 7 = 0 THEN 'in_stock' END, CASE WHEN n = 3 THEN 'attributes' END], lambda x: x IS NOT NULL) AS f, p_brand FROM part, (VALUES (1), (3)) v(n))"""
_FIRST = f"(SELECT * FROM {_LACKS} WHERE len(f) > 0 AND k % 4 > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1)"
_PLAIN = [len(s) - 3 * sum(s.count(m) for m in ("{k}", "{b}", "{p}")) for s in SHOPS]
ORACLES = {
    "trimmed_fragments": f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 2 THEN p_partkey - 1 WHEN p_partkey % 5 > 0 THEN p_partkey END AS page_id, 'https://s.example.com/c/' || p_partkey AS source_url, p_brand AS b, printf('%.2f', p_retailprice) AS t FROM part),
      m AS (SELECT *, '<main><nav class="breadcrumb">' || b || '</nav>' AS h, 'Item ' || k || ' & long text of ' || b || ' that goes on {LONG}' AS x FROM p WHERE k % 4 = 1)
      SELECT page_id, source_url, '<nav><a href="/c">All</a> / <b>' || b || '</b></nav><div itemscope itemtype="https://schema.org/Product" data-price="' || t || '"><h1 class="a b c d e f g h">Item ' || k || '</h1><img src="/i/' || k || '.jpg" alt="say &quot;hi&quot;"></img>' ||
        '<form><select><option value="1">S</option><option value="2">M</option></select></form></div>' AS html, '[itemscope][itemtype*="schema.org/Product" i]' AS root, false AS truncated, {_PLAIN[0]} + 4 * length(k::VARCHAR) + 2 * length(b) + length(t) AS source_chars FROM p WHERE k % 4 = 0 UNION ALL
      SELECT page_id, source_url, h || '<p>' || substr(x, 1, {CUT} - length(h) - 3) || '</p></main>', 'main', true, {_PLAIN[1]} + 2 * length(k::VARCHAR) + 2 * length(b) FROM m UNION ALL
      SELECT page_id, source_url, '<body class="home"><p>Item ' || k || '</p><p>' || t || '</p></body>', 'body', false, {_PLAIN[2]} + 2 * length(k::VARCHAR) + length(t) FROM p WHERE k % 4 = 2 UNION ALL
      SELECT page_id, source_url, '', 'none', false, {_PLAIN[3]} + length(k::VARCHAR) FROM p WHERE k % 4 = 3""",
    "page_fragments": "SELECT page_id, 'article' AS root, length(html) AS source_chars, false AS truncated, len(regexp_extract_all(regexp_extract(html, '(?s)<article>.*?</article>'), '<p>'))::BIGINT AS n_paragraphs, true AS begins FROM pages",
    "enrichment_requests": f"""SELECT k || '#1' AS request_id, k AS page_id, seq, array_to_string(f, ',') AS fields, array_to_string(list_sort(flatten(list_transform(f, lambda x: CASE x WHEN 'in_stock' THEN ['in_stock', 'stock_quantity'] ELSE [x] END))), ',') AS asked,
      array_to_string(flatten(list_transform(f, lambda x: CASE x WHEN 'in_stock' THEN ['in_stock', 'stock_quantity'] ELSE [x] END)), ',') AS required, true AS strict, array_to_string(f, ', ') AS spoken, k % 2 = 0 AS french, '<main>' || p_brand AS fragment FROM {_FIRST}""",
    "enrichment_issues": f"""WITH n AS (SELECT k, count(*) AS n FROM {_LACKS} WHERE len(f) > 0 GROUP BY k)
      SELECT k AS page_id, CASE WHEN k % 4 = 0 THEN 'no-fragment' ELSE 'request-limit' END AS code, CASE WHEN k % 4 = 0 THEN n ELSE n - 1 END AS n_products FROM n WHERE k % 4 = 0 OR n > 1""",
    "enrichment_round": f"""WITH a AS (SELECT seq, p_brand FROM {_FIRST} WHERE list_contains(f, 'images') AND k % 3 <> 1)
      SELECT l.seq AS product_key, a.p_brand AS brand, a.seq IS NOT NULL AS filled, CASE WHEN a.seq IS NULL THEN 'B' ELSE 'D' END AS layer FROM {_LACKS} l LEFT JOIN a USING (seq)""",
}
