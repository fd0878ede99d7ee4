"""Queries of import tables and reports, over products made from `part` and logs made from `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from souklens.operators import export as X, reports as R
from souklens.operators.attributes import align_variations
from souklens.operators.keys import assign_skus
from souklens.plans.lineage import spread
from souklens.plans.queries import _log, query, read


def _shop_products(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a product, names repeated; two variations each for half of them, linked by SKU or address; some without a parent."""
    p, k = spread(read(spark, d, "part")), F.col("p_partkey")
    none, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    money = lambda c, currency, unit: F.struct(c.cast("double").alias("amount"), F.lit(currency).alias("currency"), unit.alias("unit"))
    attribute = lambda name, axis, *v: F.struct(F.lit(name).alias("name"), F.array(*v).alias("values"), axis.alias("is_variation_axis"))
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    shared = [F.concat(F.lit("W"), F.col("p_size").cast("string")).alias("name"), none.alias("description"), none.alias("short_description"), none.alias("gtin"), F.lit(True).alias("in_stock"), F.lit(None).cast("long").alias("stock_quantity"), F.array().cast("array<string>").alias("tags"), F.split("p_type", " ").alias("category_path"), F.struct(F.col("p_size").cast("double").alias("value"), F.lit("g").alias("unit")).alias("weight")]
    eur, sale = money(F.col("p_retailprice"), "EUR", none), F.when(k % 5 == 0, money(F.col("p_retailprice") / 2, "EUR", none))
    brand, size = attribute("Brand", F.lit(False), F.col("p_brand")), attribute("Size", F.lit(True), F.lit("S"), F.lit("M"))
    own = p.select((k * 10).alias("seq"), F.lit("simple").alias("kind"), F.when(k % 4 < 3, text("P", k)).alias("sku"), none.alias("parent_sku"), text("https://s.example.com/p/", k).alias("source_url"), F.when(k % 4 == 0, F.array(size, brand)).otherwise(F.array(brand)).alias("attributes"), F.when(k % 2 == 0, F.array(text(k, "-1"), text(k, "-2"))).otherwise(F.array().cast("array<string>")).alias("images"), F.struct(eur.alias("regular"), sale.alias("sale")).alias("price"), *shared)
    irr = F.struct(money(F.col("p_retailprice"), "IRR", F.when(k % 3 == 0, "rial")).alias("regular"), F.lit(None).cast("struct<amount:double,currency:string,unit:string>").alias("sale"))
    url, parent = F.when(k % 4 == 3, text("https://s.example.com/p/", k)).otherwise(text("https://s.example.com/v/", k)), F.when(k % 4 == 0, text("P", k)).when(k % 4 == 1, "gone")
    worn = {1: F.array(attribute("Size", flag, F.lit("S")), attribute("Tint", flag, F.lit("red"))), 2: F.array(attribute("Size", flag, F.lit("M")))}
    kid = lambda n, some: p.where(some).select((k * 10 + n).alias("seq"), F.lit("variation").alias("kind"), none.alias("sku"), parent.alias("parent_sku"), url.alias("source_url"), worn[n].alias("attributes"), F.array().cast("array<string>").alias("images"), irr.alias("price"), *shared)
    return own.unionByName(kid(1, k % 4 != 2)).unionByName(kid(2, (k % 4 == 0) | (k % 4 == 3)))


@query
def shopify_import(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the wide table, with what is told of each variant."""
    rows, issues, _ = X.shopify_import(_shop_products(spark, d), currency="EUR")
    codes = issues.groupBy(F.col("seq").alias("place")).agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    shown = {"URL handle": "handle", "Title": "title", "Type": "type", "SKU": "sku", "Option1 name": "n1", "Option1 value": "v1", "Option2 name": "n2", "Option2 value": "v2", "Price": "price", "Compare-at price": "compare_at", "Weight value (grams)": "grams", "Product image URL": "image", "Image position": "position", "Continue selling when out of stock": "policy"}
    rows = rows.select("seq", F.col("part").cast("long").alias("part"), "place", *[F.col(f"`{c}`").alias(n) for c, n in shown.items()])
    return rows.join(codes.withColumn("part", F.lit(0).cast("long")), ["place", "part"], "full").withColumn("codes", F.coalesce("codes", F.lit("")))


@query
def shopify_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row: products, variants, image rows, names that were taken, and how prices were quoted."""
    _, _, stats = X.shopify_import(_shop_products(spark, d), currency="EUR")
    unit = lambda u: F.coalesce(F.try_element_at("currency_units", F.lit(u)), F.lit(0)).alias(u.lower())
    return stats.select("products", "variants", "image_rows", "handles_deduplicated", F.size("currency_units").cast("long").alias("n_units"), unit("EUR"), unit("rial"), unit("unknown"))


@query
def filtered_products(spark: SparkSession, d: str) -> DataFrame:
    """The fate of each product and variation; kinds, categories and parents by SKU or address."""
    return R.apply_catalog_filter(_kinds(_shop_products(spark, d)), kinds=["simple"], category="standard").select("seq", "kind", "verdict")


@query
def filter_issues(spark: SparkSession, d: str) -> DataFrame:
    p = R.apply_catalog_filter(_kinds(_shop_products(spark, d)), kinds=["simple"], category="standard")
    return R.filter_issues(p, kinds=["simple"], category="standard", off=["tags", "sku"])


def _kinds(products: DataFrame) -> DataFrame:
    return products.withColumn("kind", F.when((F.col("kind") == "simple") & (F.col("seq") % 30 == 10), "grouped").otherwise(F.col("kind")))


@query
def filled_answers(spark: SparkSession, d: str) -> DataFrame:
    """Products with several answers each: the surest fills what is empty, once."""
    k = F.col("p_partkey")
    p = read(spark, d, "part").select(k.alias("product_key"), F.when(k % 2 == 0, F.col("p_brand")).when(k % 2 == 1, F.lit(" ")).alias("brand"), F.lit("B").alias("layer"), F.create_map(F.lit("brand"), F.lit(0.9), F.lit("name"), F.lit(0.8)).alias("field_confidence"))
    a = read(spark, d, "lineitem").select(F.col("l_partkey").alias("product_key"), (F.col("l_linenumber") % 3).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("a"), "l_orderkey", F.lit("-"), "l_linenumber").alias("value"))
    return R.fill_empty(p, a, "brand").select("product_key", "brand", "filled", "layer", F.col("field_confidence")["brand"].alias("sure"), F.col("field_confidence")["name"].alias("sure_name"))


@query
def projected_fields(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("stock_quantity"), F.array("p_brand").alias("tags"), F.create_map(F.lit("name"), F.lit(0.9), F.lit("tags"), F.lit(0.5)).alias("field_confidence"))
    p = R.project_target_fields(p, ["name"], ["name", "stock_quantity", "tags"])
    return p.select("p_partkey", "name", F.col("stock_quantity").cast("long").alias("stock_quantity"), F.size("tags").cast("long").alias("n_tags"), F.array_join(F.map_keys("field_confidence"), ",").alias("told"))


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _log(spark, d)
    k = F.col("seq")
    products = e.where("scan_id % 5 > 0").select("scan_id", F.col("event_type").alias("name"), F.when(k % 3 == 0, F.col("event_type")).alias("brand"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("tags"), F.when(k % 2 == 0, "A").otherwise("B").alias("layer"), F.create_map(F.lit("name"), F.when(k % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5)), F.lit("brand"), F.lit(0.4)).alias("field_confidence"))
    issues = e.where("scan_id % 7 = 0").select("scan_id", "seq", F.lit("c").alias("code"), F.concat(F.lit("m"), "seq").alias("message"), F.lit("error").alias("severity"), F.when(k % 2 == 0, "network").otherwise("other").alias("kind"))
    return e.select("scan_id").distinct(), products, issues


@query
def report_fields(spark: SparkSession, d: str) -> DataFrame:
    """Why each field of each user's scan is as it is; a fifth of the scans has no products, a seventh ended early."""
    out = R.report_fields(*_scans(spark, d), ["name", "brand", "description", "tags"], wanted=["name", "brand", "description"])
    return out.select("scan_id", "field", F.col("tier").cast("long").alias("tier"), "filled", "total", "reason", "message")


@query
def scan_report(spark: SparkSession, d: str) -> DataFrame:
    scans, products, issues = _scans(spark, d)
    health = scans.select("scan_id", (F.col("scan_id") % 2 == 0).alias("healthy"), F.lit("2 fields are gone.").alias("summary"))
    return R.scan_report(scans, products, issues, ["name", "brand", "description", "tags"], wanted=["name", "brand", "description"], health=health)


def _cell(x: str) -> str:
    return rf"regexp_replace(regexp_replace(((floor({x} * 1000000 + 0.5) / 1000000)::DECIMAL(30, 6))::VARCHAR, '0+$', ''), '\.$', '')"


_PARTS = "SELECT *, p_partkey AS k, p_partkey % 4 AS m, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part"
def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Brands with the sizes to 25 that they have, and their parts with a size in one of two spellings, every third with two tints."""
    p, k = spread(read(spark, d, "part")), F.col("p_partkey")
    attribute = lambda name, values: F.struct(F.lit(name).alias("name"), values.alias("values"), F.lit(None).cast("boolean").alias("is_variation_axis"))
    size = F.concat(F.when(k % 2 == 0, "s").otherwise("S"), F.col("p_size").cast("string"))
    own = p.groupBy(F.col("p_brand").alias("parent")).agg(F.array_sort(F.collect_set(F.when(F.col("p_size") <= 25, F.concat(F.lit("S"), F.col("p_size").cast("string"))))).alias("v"))
    kids = p.select(F.col("p_brand").alias("parent"), k.alias("seq"), F.array_compact(F.array(attribute("size", F.array(size)), F.when(k % 3 == 0, attribute("Tint", F.array(F.lit(" "), F.split("p_type", " ")[0], F.lit("x")))))).alias("attributes"))
    return own.select("parent", F.array(attribute("Size", F.col("v"))).alias("attributes")), kids


def _both(spark: SparkSession, d: str, show) -> DataFrame:
    return show(*align_variations(*_sized(spark, d))).withColumn("repair", F.lit(True)).unionByName(show(*align_variations(*_sized(spark, d), repair=False)).withColumn("repair", F.lit(False)))


@query
def aligned_values(spark: SparkSession, d: str) -> DataFrame:
    """What each part has in each of its brand's slots, with repair and without, and what was told of it."""

    def show(_, values: DataFrame, issues: DataFrame) -> DataFrame:
        codes = issues.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
        return values.select("seq", F.get("values", F.lit(0)).alias("size"), F.get("values", F.lit(1)).alias("tint")).join(codes, "seq", "full").withColumn("codes", F.coalesce("codes", F.lit("")))

    return _both(spark, d, show)


@query
def aligned_slots(spark: SparkSession, d: str) -> DataFrame:
    """The slots of each brand, with repair and without: their values and whether parts differ by them."""
    return _both(spark, d, lambda slots, *_: slots.select("parent", F.posexplode("slots").alias("slot", "s")).select("parent", F.col("slot").cast("long").alias("slot"), "s.name", F.array_join("s.values", ",").alias("values"), F.col("s.is_variation_axis").alias("axis")))


@query
def import_slots(spark: SparkSession, d: str) -> DataFrame:
    """Attribute columns of an import of products and variations that lack some of each other's attributes."""
    p = _shop_products(spark, d).withColumns({"brand": F.lit(None).cast("string"), "dimensions": F.lit(None).cast("struct<length:struct<value:double,unit:string>,width:struct<value:double,unit:string>,height:struct<value:double,unit:string>>")})
    rows, _, _ = X.woo_import(assign_skus(p.withColumn("attribute_values", F.flatten(F.transform("attributes", lambda a: a["values"])))), currency="EUR")
    shown = [F.col(f"`Attribute {k} {what}`").alias(f"{what[0]}{k}") for k in (1, 2, 3) for what in ("name", "value(s)")]
    return rows.select("seq", "Type", F.col("Position").alias("position"), *shown)


_USES = """SELECT p_partkey AS seq, p_brand AS b, p_size, CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE 'S' END || p_size AS v, p_size <= 25 AS has, p_partkey % 3 = 0 AS t, split_part(p_type, ' ', 1) AS tint,
      row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) = 1 AS f, first_value(CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE 'S' END || p_size) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS fv,
      row_number() OVER (PARTITION BY p_brand, p_partkey % 3 = 0 ORDER BY p_partkey) = 1 AS tf, row_number() OVER (PARTITION BY p_brand, p_partkey % 3 = 0, split_part(p_type, ' ', 1) ORDER BY p_partkey) = 1 AS tvf FROM part"""
ORACLES = {
    "aligned_values": f"""WITH u AS ({_USES}), c AS (SELECT *, CASE WHEN has THEN 'S' || p_size ELSE fv END AS m FROM u)
      SELECT seq, m AS size, CASE WHEN t THEN tint END AS tint, array_to_string(list_sort(list_filter([CASE WHEN t THEN 'variation-multiple-values' END, CASE WHEN t AND tf THEN 'variation-attribute-not-on-parent' END, CASE WHEN t AND tvf THEN 'variation-value-added-to-parent' END,
        CASE WHEN NOT has AND f THEN 'variation-value-added-to-parent' WHEN v <> m THEN 'variation-value-normalized' END], lambda x: x IS NOT NULL)), ',') AS codes, true AS repair FROM c UNION ALL
      SELECT seq, CASE WHEN has THEN m ELSE v END, NULL, array_to_string(list_sort(list_filter([CASE WHEN t THEN 'variation-multiple-values' END, CASE WHEN t THEN 'variation-attribute-not-on-parent' END,
        CASE WHEN NOT has THEN 'variation-value-not-on-parent' WHEN v <> m THEN 'variation-value-normalized' END], lambda x: x IS NOT NULL)), ','), false FROM c""",
    "aligned_slots": f"""WITH u AS ({_USES}), o AS (SELECT b, coalesce(list_sort(list_distinct(list('S' || p_size) FILTER (has))), []) AS own, coalesce(list(v ORDER BY seq) FILTER (NOT has AND f), []) AS more, list(tint ORDER BY seq) FILTER (t AND tvf) AS tints FROM u GROUP BY b)
      SELECT b AS parent, 0::BIGINT AS slot, 'Size' AS name, array_to_string(own || more, ',') AS values, true AS axis, true AS repair FROM o UNION ALL
      SELECT b, 0, 'Size', array_to_string(own, ','), true, false FROM o UNION ALL SELECT b, 1, 'Tint', array_to_string(tints, ','), true, true FROM o WHERE tints IS NOT NULL""",
    "import_slots": """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS m, p_brand AS b FROM part)
      SELECT k * 10 AS seq, CASE WHEN m IN (0, 3) THEN 'variable' ELSE 'simple' END AS "Type", '' AS position, CASE WHEN m = 0 THEN 'Size' ELSE 'Brand' END AS n1, CASE WHEN m = 0 THEN 'S, M' ELSE b END AS v1,
        CASE m WHEN 0 THEN 'Brand' WHEN 3 THEN 'Size' ELSE '' END AS n2, CASE m WHEN 0 THEN b WHEN 3 THEN 'S, M' ELSE '' END AS v2, CASE WHEN m IN (0, 3) THEN 'Tint' ELSE '' END AS n3, CASE WHEN m IN (0, 3) THEN 'red' ELSE '' END AS v3 FROM p UNION ALL
      SELECT k * 10 + 1, 'variation', '0', CASE WHEN m = 0 THEN 'Size' ELSE '' END, CASE WHEN m = 0 THEN 'S' ELSE '' END, CASE WHEN m = 3 THEN 'Size' ELSE '' END, CASE WHEN m = 3 THEN 'S' ELSE '' END, 'Tint', 'red' FROM p WHERE m IN (0, 3) UNION ALL
      SELECT k * 10 + 2, 'variation', '1', CASE WHEN m = 0 THEN 'Size' ELSE '' END, CASE WHEN m = 0 THEN 'M' ELSE '' END, CASE WHEN m = 3 THEN 'Size' ELSE '' END, CASE WHEN m = 3 THEN 'M' ELSE '' END, '', '' FROM p WHERE m IN (0, 3)""",
    "shopify_import": f"""WITH p AS (SELECT *, 'w' || p_size || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS h, 'W' || p_size AS name, split_part(p_type, ' ', -1) AS last FROM ({_PARTS})),
      i AS (SELECT k, k % 2 = 0 AS has FROM p),
      v AS (SELECT k * 10 AS seq, 0 AS part, k * 10 AS place, h AS handle, name AS title, last AS type, CASE WHEN m < 3 THEN 'P' || k ELSE '' END AS sku, 'Title' AS n1, 'Default Title' AS v1, '' AS n2, '' AS v2, CASE WHEN k % 5 = 0 THEN {_cell("p_retailprice / 2")} ELSE {_cell("p_retailprice")} END AS price,
          CASE WHEN k % 5 = 0 THEN {_cell("p_retailprice")} ELSE '' END AS compare_at, {_cell("p_size")} AS grams, CASE WHEN k % 2 = 0 THEN k || '-1' ELSE '' END AS image, CASE WHEN k % 2 = 0 THEN '1' ELSE '' END AS position, 'DENY' AS policy, CASE WHEN n > 1 THEN 'handle-deduplicated' ELSE '' END AS codes FROM p WHERE m IN (1, 2) UNION ALL
        SELECT k * 10, 0, k * 10 + 1, h, name, last, '', 'Size', 'S', 'Tint', 'red', CASE WHEN k % 3 = 0 THEN {_cell("p_retailprice / 10")} ELSE {_cell("p_retailprice")} END, '', {_cell("p_size")}, CASE WHEN k % 2 = 0 THEN k || '-1' ELSE '' END, CASE WHEN k % 2 = 0 THEN '1' ELSE '' END, 'DENY', CASE WHEN k % 3 = 0 THEN '' ELSE 'currency-unit-assumed' END FROM p WHERE m IN (0, 3) UNION ALL
        SELECT k * 10, 0, k * 10 + 2, h, '', '', '', '', 'M', '', '', CASE WHEN k % 3 = 0 THEN {_cell("p_retailprice / 10")} ELSE {_cell("p_retailprice")} END, '', {_cell("p_size")}, '', '', 'DENY', CASE WHEN k % 3 = 0 THEN '' ELSE 'currency-unit-assumed,' END || 'variation-missing-option-value' FROM p WHERE m IN (0, 3) UNION ALL
        SELECT k * 10, 1, 2, h, '', '', '', '', '', '', '', '', '', '', k || '-2', '2', '', '' FROM p WHERE k % 2 = 0 UNION ALL
        SELECT NULL, 0, k * 10, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'handle-deduplicated' FROM p WHERE m IN (0, 3) AND n > 1 UNION ALL
        SELECT NULL, 0, k * 10 + 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'orphan-variation' FROM p WHERE m = 1)
      SELECT seq, part::BIGINT AS part, place, handle, title, type, sku, n1, v1, n2, v2, price, compare_at, grams, image, position, policy, codes FROM v""",
    "shopify_stats": f"""WITH p AS ({_PARTS}) SELECT count(*) AS products, (count(*) FILTER (m IN (1, 2)) + 2 * count(*) FILTER (m IN (0, 3)))::BIGINT AS variants, count(*) FILTER (k % 2 = 0) AS image_rows, sum(n - 1)::BIGINT AS handles_deduplicated, 3::BIGINT AS n_units,
      (count(*) FILTER (m IN (1, 2)) + count(*) FILTER (m IN (1, 2) AND k % 5 = 0))::BIGINT AS eur, (2 * count(*) FILTER (m IN (0, 3) AND k % 3 = 0))::BIGINT AS rial, (2 * count(*) FILTER (m IN (0, 3) AND k % 3 > 0))::BIGINT AS unknown FROM p""",
    "filtered_products": f"""{(_FATE := """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS m, CASE WHEN p_partkey % 3 = 1 THEN 'grouped' ELSE 'simple' END AS kind, CASE WHEN p_partkey % 3 = 1 THEN 'filtered-kind' WHEN list_contains(string_split(lower(p_type), ' '), 'standard') THEN 'kept' ELSE 'filtered-category' END AS v FROM part),
      f AS (SELECT k * 10 AS seq, kind, v AS verdict FROM p UNION ALL SELECT k * 10 + 1, 'variation', CASE WHEN m = 1 THEN 'filtered-orphan' ELSE v END FROM p WHERE m <> 2 UNION ALL SELECT k * 10 + 2, 'variation', v FROM p WHERE m IN (0, 3))""")} SELECT * FROM f""",
    "filter_issues": f"""{_FATE}, c AS (SELECT count(*) FILTER (verdict = 'filtered-kind' AND kind <> 'variation') AS a, count(*) FILTER (verdict = 'filtered-category' AND kind <> 'variation') AS b, count(*) FILTER (verdict <> 'kept' AND kind = 'variation') AS v, count(*) FILTER (verdict = 'kept') AS n FROM f)
      SELECT * FROM (SELECT 'filtered-by-product-type' AS code, a AS n, a || ' product(s) were left out because their type is not in simple.' AS message FROM c UNION ALL SELECT 'filtered-by-category', b, b || ' product(s) were left out; they are not under "standard".' FROM c UNION ALL
        SELECT 'filtered-variations', v, v || ' variation(s) went with the products they belong to. A variation without its parent cannot be imported.' FROM c UNION ALL SELECT 'fields-turned-off', n, 'These fields are empty because the settings turn them off: tags, sku.' FROM c) WHERE n > 0""",
    "filled_answers": """WITH a AS (SELECT l_partkey AS k, arg_min('a' || l_orderkey || '-' || l_linenumber, {'c': -(l_linenumber % 3), 's': l_orderkey * 10 + l_linenumber}) AS v FROM lineitem GROUP BY 1)
      SELECT p_partkey AS product_key, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN v IS NULL THEN ' ' ELSE v END AS brand, p_partkey % 2 = 1 AND v IS NOT NULL AS filled, CASE WHEN p_partkey % 2 = 1 AND v IS NOT NULL THEN 'D' ELSE 'B' END AS layer,
        (CASE WHEN p_partkey % 2 = 1 AND v IS NOT NULL THEN 0.3 ELSE 0.9 END)::DOUBLE AS sure, 0.8::DOUBLE AS sure_name FROM part LEFT JOIN a ON k = p_partkey""",
    "projected_fields": "SELECT p_partkey, p_name AS name, NULL::BIGINT AS stock_quantity, 0::BIGINT AS n_tags, 'name' AS told FROM part",
    "report_fields": f"""{(_WHY := """WITH s AS (SELECT user_id AS scan_id, CASE WHEN user_id % 5 > 0 THEN count(*) ELSE 0 END AS total, CASE WHEN user_id % 5 > 0 THEN count(*) FILTER (event_id % 3 = 0) ELSE 0 END AS b, 'm' || min(event_id) FILTER (user_id % 7 = 0 AND event_id % 2 = 0) AS stop,
        CASE WHEN bool_or(event_id % 2 = 0) THEN 'the shop’s own product API (certain)' END AS n1, CASE WHEN bool_or(event_id % 2 = 1) THEN 'the page’s structured data (probable)' END AS n2,
        CASE WHEN bool_or(event_id % 6 = 0) THEN 'the shop’s own product API (rough)' END AS b1, CASE WHEN bool_or(event_id % 6 = 3) THEN 'the page’s structured data (rough)' END AS b2 FROM events GROUP BY 1),
      f AS (SELECT scan_id, 'name' AS field, 1 AS tier, total AS filled, total, concat_ws(' and ', n1, n2) AS src, stop FROM s UNION ALL SELECT scan_id, 'brand', 2, b, total, concat_ws(' and ', b1, b2), stop FROM s UNION ALL SELECT scan_id, 'description', 1, 0, total, '', stop FROM s UNION ALL SELECT scan_id, 'tags', 2, 0, total, '', stop FROM s),
      r AS (SELECT *, CASE WHEN field = 'tags' THEN 'turned-off' WHEN filled > 0 AND filled = total THEN 'filled' WHEN filled = 0 AND stop IS NOT NULL THEN 'scan-failed' WHEN filled = 0 THEN 'not-published' ELSE 'partial' END AS reason FROM f)""")}
      SELECT scan_id, field, tier::BIGINT AS tier, filled, total, reason, CASE reason WHEN 'turned-off' THEN 'Empty because "tags" is switched off in your settings. Turn it on and scan again to fill it.' WHEN 'filled' THEN 'Filled for every product, from ' || src || '.' WHEN 'scan-failed' THEN 'Empty because the scan could not finish: ' || stop
        WHEN 'not-published' THEN CASE tier WHEN 1 THEN 'Empty because this shop’s pages do not publish it anywhere it can be read. If you can see it on the page yourself, a taught profile will pick it up.' ELSE 'Empty because the shop does not publish it. This is common and usually fine.' END
        ELSE 'Filled for ' || filled || ' of ' || total || ' products, from ' || src || '. The rest of the pages do not state it.' END AS message FROM r""",
    "scan_report": f"""{_WHY}, g AS (SELECT scan_id, max(total) AS n, count(*) FILTER (reason <> 'turned-off') AS asked, count(*) FILTER (reason = 'filled') AS done, any_value(stop) AS stop, string_agg(field, ', ' ORDER BY array_position(['name', 'brand', 'description'], field)) FILTER (reason = 'not-published' AND tier = 1) AS bare FROM r GROUP BY 1)
      SELECT scan_id, n AS n_products, asked AS n_asked, done AS n_complete, CASE WHEN n = 0 THEN coalesce('The scan stopped: ' || stop, 'No products were found on this page. If you can see products yourself, teach a profile, so that the layout is known.')
        ELSE n || ' product(s) read. ' || done || ' of ' || asked || ' requested fields are filled for every one of them. ' || coalesce(bare || ' came back empty everywhere, which usually means this shop does not publish them in a readable form.', 'Nothing here looks wrong.') END AS summary,
        CASE WHEN scan_id % 2 <> 0 THEN 'The layout you taught for this site has stopped matching: 2 fields are gone. Teach this site again to point it at the right places.' END AS profile_note FROM g""",
}
