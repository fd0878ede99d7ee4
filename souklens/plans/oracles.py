"""DuckDB SQL for the registered queries, from the source columns, never from the rendered pages."""

ORACLES: dict[str, str] = {
    "jsonld_products": "SELECT p_partkey AS page_id, 'P-' || p_partkey AS sku, p_name AS name, p_brand AS brand, round(p_retailprice, 2) AS price, true AS in_stock, 5::BIGINT AS n_fields FROM part",
    "microdata_products": "SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, round(p_retailprice, 2) AS price FROM part",
    "microdata_properties": "SELECT p_partkey AS page_id, 'Product' AS type, 'name' AS prop, p_name AS value FROM part",
    "opengraph_products": "SELECT p_partkey AS page_id, p_name AS name, 'http://shop.example.com/p/' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN round(p_retailprice, 2) END AS price FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0",
    "dom_tag_counts": "WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'g'), '<(nav|article|footer|h1|meta|br)[ >]', 1)) AS tag FROM pages) SELECT tag, count(*) AS n FROM t GROUP BY tag",
    "page_links": "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM t GROUP BY page_id",
    "parse_number_formats": "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price FROM lineitem",
    "parse_money_units": """SELECT p_partkey, round(p_retailprice, 2) AS amount, ['IRR', 'IRR', 'USD', 'EUR', 'GBP'][(p_partkey % 5 + 1)::INT] AS currency, CASE p_partkey % 5 WHEN 0 THEN 'toman' WHEN 1 THEN 'rial' END AS unit,
      round(round(p_retailprice, 2) * CASE WHEN p_partkey % 5 = 0 THEN 10 ELSE 1 END, 2) AS in_rial FROM part""",
    "convert_measures": "SELECT p_partkey, floor(p_size * CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1000.0::DOUBLE WHEN 2 THEN 28.349523125::DOUBLE END * 1000000 + 0.5) / 1000000 AS grams FROM part",
    "canonical_urls": r"""WITH a AS (SELECT page_id, regexp_extract(trim(url), '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['s', 'h', 'p', 'q']) AS x FROM pages),
      b AS (SELECT page_id, lower(x.s) AS s, lower(x.h) AS h, CASE WHEN x.p IN ('', '/') THEN '/' ELSE regexp_replace(x.p, '/+$', '') END AS p, list_sort(list_filter(string_split(substr(x.q, 2), '&'), lambda z: z <> '' AND NOT regexp_matches(z, '^(utm_|pk_|mtm_|matomo_|(ref|source|gclid|fbclid)(=|$))'))) AS q FROM a)
      SELECT page_id, s || '://' || h || p || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key, regexp_replace(h, '^www\.', '') AS domain FROM b""",
    "page_numbers": r"SELECT page_id, CAST(nullif(coalesce(nullif(regexp_extract(url, '[?&]page=(\d+)(&|#|$)', 1), ''), regexp_extract(url, '/page/(\d+)(/|$)', 1)), '') AS BIGINT) AS page_no FROM pages",
    "short_hash_urls": "WITH a AS (SELECT page_id, ('0x' || substr(sha256(url), 1, 16))::UBIGINT::HUGEINT % 2821109907456 AS v FROM pages) SELECT page_id, lpad(lower(to_base(v::BIGINT, 36)), 8, '0') AS h FROM a",
    "slugify_names": r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^\pL\pN]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part",
    "clean_documents": r"""WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]+', ' ', 'g')) AS c FROM documents)
      SELECT doc_id, length(c)::BIGINT AS n_clean, md5(lower(translate(regexp_replace(c, '[\x{0610}-\x{061A}\x{0640}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{200C}]', '', 'g'), 'يىكۀة', 'ییکهه'))) AS folded_md5 FROM a""",
    "offers_min_price": "SELECT l_partkey AS page_id, round(min(l_extendedprice), 2) AS price, round(max(l_extendedprice), 2) AS high_price, count(*) AS n_offers, bool_or(l_returnflag <> 'R') AS in_stock FROM lineitem GROUP BY l_partkey",
    "resolve_claims": "SELECT p_partkey AS product_key, 'name' AS field, CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE 'z' || p_name END AS value, 0.95::DOUBLE AS confidence, CASE WHEN p_partkey % 3 > 0 THEN 's1' ELSE 's3' END AS source FROM part",
    "resolve_price_pairs": """WITH a AS (SELECT l_partkey AS product_key, CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS regular, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * CASE WHEN l_discount > 0.05 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END END AS sale, round(l_discount, 2) AS c, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
      b AS (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY c DESC, seq) AS r FROM a)
      SELECT product_key, round(coalesce(regular, sale), 3) AS regular, round(CASE WHEN sale < regular THEN sale END, 3) AS sale FROM b WHERE r = 1""",
    "assign_skus": """WITH a AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 > 0 THEN 'B' || regexp_extract(p_brand, '(\\d+)$', 1) END AS own, ('0x' || substr(sha256('https://shop.example.com/p/' || p_partkey), 1, 16))::UBIGINT::HUGEINT % 2821109907456 AS v FROM part),
      b AS (SELECT seq, own IS NULL AS g, coalesce(own, 'P123-' || lpad(lower(to_base(v::BIGINT, 36)), 8, '0')) AS c FROM a), d AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY seq) AS n FROM b)
      SELECT seq, c || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS sku_out, g AS sku_generated FROM d""".replace("\\\\", "\\"),
    "assign_handles": r"""WITH a AS (SELECT p_partkey AS seq, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS h FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY seq) AS n FROM a)
      SELECT seq, h || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS handle FROM b""",
    "link_variations": "SELECT CASE WHEN l_orderkey % 10 > 0 THEN 'O' || l_orderkey END AS parent_key, count(*) AS n FROM lineitem GROUP BY 1",
    "category_paths": "SELECT s_suppkey AS product_id, r_name || ' > ' || n_name AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    "align_attributes": """WITH k AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size <= 25), v AS (SELECT p_brand, p_size, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE 'S' END || p_size AS x FROM part),
      o AS (SELECT v.*, k.p_size AS has, first_value(x) OVER (PARTITION BY v.p_brand, v.p_size ORDER BY p_partkey) AS f FROM v LEFT JOIN k USING (p_brand, p_size))
      SELECT p_brand AS parent, CASE WHEN has IS NULL THEN 'size' ELSE 'Size' END AS attribute, CASE WHEN has IS NULL THEN f ELSE 'S' || p_size END AS value, count(*) AS n FROM o GROUP BY ALL""",
    "filter_catalog": "SELECT CASE WHEN p_partkey % 6 = 0 THEN 'filtered-kind' WHEN lower(p_type) LIKE 'standard anodized%' THEN 'kept' ELSE 'filtered-category' END AS verdict, count(*) AS n FROM part GROUP BY 1",
    "field_coverage": """WITH a AS (SELECT p_brand AS brand, count(*) AS total, count(*) FILTER (p_partkey % 4 > 0) AS sku, count(*) AS name, count(*) FILTER (p_partkey % 5 = 0) AS sale FROM part GROUP BY 1),
      b AS (SELECT brand, 'sku' AS field, sku AS filled, total FROM a UNION ALL SELECT brand, 'name', name, total FROM a UNION ALL SELECT brand, 'sale', sale, total FROM a UNION ALL SELECT brand, 'brand', total, total FROM a UNION ALL SELECT brand, 'parent_sku', 0, total FROM a)
      SELECT *, CASE WHEN field = 'brand' THEN 'turned-off' WHEN filled = total THEN 'filled' WHEN filled = 0 THEN 'not-published' ELSE 'partial' END AS reason FROM b""",
    "issue_summary": """WITH a AS (SELECT user_id AS scan_id, event_id AS seq, event_type AS code, event_id % 3 AS k FROM events WHERE event_id % 3 < 2),
      b AS (SELECT scan_id, code, 'm' || min(seq) AS message, CASE arg_min(k, seq) WHEN 0 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n, min(seq) AS f FROM a GROUP BY ALL)
      SELECT scan_id, code, message, severity, n, row_number() OVER (PARTITION BY scan_id ORDER BY severity <> 'error', f) AS rank FROM b""",
    "top_issues": "WITH a AS (SELECT user_id AS scan_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) AS rank FROM events) SELECT * FROM a WHERE rank <= 3",
    "currency_units": "WITH a AS (SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) SELECT CASE p_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'toman' ELSE 'unknown' END AS unit, count(*) AS n FROM a GROUP BY 1",
    "signal_scores": """WITH r(target, no, label, needle, weight) AS (VALUES ('fr', 1, 'lang', 'lang="fr"', 0.6), ('fr', 2, 'path', '/fr/', 0.25), ('en', 1, 'lang', 'lang="en"', 0.8), ('en', 2, 'the', ' the ', 0.3), ('weak', 1, 'nav', '<nav', 0.2), ('ads', 1, 'ad', 'class="ad"', 0.2), ('ads', 2, 'track', 'track(', 0.15)),
      a AS (SELECT page_id, target, least(1.0, round(sum(weight)::DOUBLE, 2)) AS confidence, string_agg(label, ',' ORDER BY no) AS labels FROM pages, r WHERE contains(lower(html), needle) GROUP BY 1, 2)
      SELECT page_id, target, confidence::DOUBLE AS confidence, labels, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, target) AS rank FROM a WHERE confidence >= 0.3""",
    "detect_blocks": "SELECT CASE WHEN event_id % 50 = 7 THEN 'rate-limited' WHEN event_id % 50 = 11 THEN CASE WHEN event_id % 100 = 11 THEN 'captcha' ELSE 'forbidden' END END AS block, count(*) AS n FROM events GROUP BY 1",
    "block_latch": "WITH f AS (SELECT user_id, min(event_id) FILTER (event_id % 50 IN (7, 11)) AS f FROM events GROUP BY 1) SELECT user_id AS scan_id, count(*) AS n, max(event_id) AS last_seq FROM events JOIN f USING (user_id) WHERE f IS NULL OR event_id < f GROUP BY 1",
    "pacing_audit": "WITH a AS (SELECT user_id AS scan_id, event_id AS seq, epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 AS gap_ms FROM events) SELECT *, coalesce(gap_ms < 60000, false) AS too_close FROM a",
    "overlap_audit": """WITH e AS (SELECT user_id, ts AS moment, 1 AS s FROM events UNION ALL SELECT user_id, ts + INTERVAL 6 HOUR, -1 FROM events), r AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY moment, s ROWS UNBOUNDED PRECEDING) AS n FROM e)
      SELECT user_id AS scan_id, max(n)::BIGINT AS most FROM r WHERE n > 2 GROUP BY 1""",
    "walk_pagination": r"WITH a AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS seed, count(*) AS n FROM pages GROUP BY 1) SELECT seed, least(n, 10) AS n_pages, least(n, 10) AS last_hop FROM a",
    "verify_answers": "WITH a AS (SELECT * FROM documents) SELECT 'name' AS field, true AS present, count(*) AS n FROM a WHERE regexp_matches(text, '[a-zA-Z]{4,}') UNION ALL SELECT 'invented', false, count(*) FROM a",
    "fill_empty": "SELECT p_partkey AS product_key, CASE WHEN p_partkey % 4 > 0 THEN 'B' || regexp_extract(p_brand, '([0-9]+)$', 1) WHEN p_partkey % 8 = 0 THEN 'A' || p_partkey END AS sku, p_partkey % 8 = 0 AS filled FROM part",
    "usage_rollup": "SELECT event_type AS provider, (user_id % 3)::VARCHAR AS model, count(*) AS requests, sum(event_id)::BIGINT AS input_tokens, sum(event_id % 10)::BIGINT AS output_tokens FROM events GROUP BY 1, 2",
    "redact_log": "SELECT event_id AS seq, '[redacted]' AS api_key, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 1 THEN '[600 chars]' ELSE '' END AS note FROM events",
    "image_rows": "WITH a AS (SELECT l_orderkey AS handle, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS position, 'i' || l_linenumber AS src FROM lineitem) SELECT * FROM a WHERE position <= 5",
    "csv_lines": """SELECT CASE WHEN p_partkey % 2 = 0 THEN '"' || replace(p_name || ', "big"', '"', '""') || '"' ELSE p_name END || ',' || CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE '' END AS value FROM part""",
    "json_lines": """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
    "store_api_products": """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 'variable' ELSE 'simple' END AS kind, 'https://s.example.com/p/' || p_partkey AS source_url, CASE WHEN p_partkey % 5 <> 0 THEN round(p_retailprice, 2) END AS regular,
      CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN round(printf('%.0f', p_retailprice * 50)::DOUBLE / 100, 2) END AS sale FROM part""",
    "collection_products": """WITH a AS (SELECT *, 'h' || regexp_extract(p_brand, '([0-9]+)$', 1) || '-' || p_size AS handle FROM part)
      SELECT 'V' || p_partkey AS sku, handle, CASE WHEN count(*) OVER (PARTITION BY handle) = 1 AND p_partkey % 2 = 0 THEN 'simple' ELSE 'variation' END AS kind, round(p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 0 END, 2) AS regular, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice, 2) END AS sale FROM a""",
    "sitemap_urls": "SELECT DISTINCT page_id // 50 AS doc_id, 'url' AS kind, url AS loc FROM pages WHERE lower(regexp_replace(url, '^[a-z]+://[^/]*', '')) LIKE '%/en/%' OR lower(regexp_replace(url, '^[a-z]+://[^/]*', '')) LIKE '%/fr/%'",
    "stream_progress": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_dedupe": "SELECT user_id AS key, arg_max(event_type, {'a': round(value, 2), 'b': -event_id}) AS kind, min(event_id) AS first_seq, count(*) AS n FROM events GROUP BY 1",
}

# column names of import tables have blanks, hence apart
ORACLES["woo_rows"] = r"""
WITH a AS (SELECT *, p_partkey AS seq, CASE WHEN p_partkey % 4 > 0 THEN 'B' || regexp_extract(p_brand, '(\d+)$', 1) END AS own, ('0x' || substr(sha256('https://shop.example.com/p/' || p_partkey), 1, 16))::UBIGINT::HUGEINT % 2821109907456 AS v FROM part),
b AS (SELECT *, coalesce(own, 'P123-' || lpad(lower(to_base(v::BIGINT, 36)), 8, '0')) AS c FROM a),
d AS (SELECT *, c || CASE WHEN row_number() OVER (PARTITION BY c ORDER BY seq) > 1 THEN '-' || row_number() OVER (PARTITION BY c ORDER BY seq) ELSE '' END AS sku FROM b)
SELECT seq, 'simple' AS "Type", sku AS "SKU", p_name AS "Name", '1' AS "Published", CASE WHEN p_partkey % 7 > 0 THEN '1' ELSE '0' END AS "In stock?",
  CASE WHEN p_partkey % 5 = 0 THEN regexp_replace(regexp_replace(((floor(p_retailprice / 2 * 1000000 + 0.5) / 1000000)::DECIMAL(30, 6))::VARCHAR, '0+$', ''), '\.$', '') ELSE '' END AS "Sale price",
  regexp_replace(regexp_replace(((floor(p_retailprice * 1000000 + 0.5) / 1000000)::DECIMAL(30, 6))::VARCHAR, '0+$', ''), '\.$', '') AS "Regular price",
  replace(p_type, ' ', ' > ') AS "Categories", 'a\,b' || seq || ', c' AS "Images", '' AS "Parent", 'Brand' AS "Attribute 1 name", p_brand AS "Attribute 1 value(s)",
  CASE WHEN p_size > 25 THEN 'Size' ELSE '' END AS "Attribute 2 name", CASE WHEN p_size > 25 THEN p_size || ', x' ELSE '' END AS "Attribute 2 value(s)" FROM d
"""
ORACLES["shopify_rows"] = r"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) = 1 AS first FROM part),
m AS (SELECT *, regexp_replace(regexp_replace(((floor(p_retailprice * 1000000 + 0.5) / 1000000)::DECIMAL(30, 6))::VARCHAR, '0+$', ''), '\.$', '') AS full_, regexp_replace(regexp_replace(((floor(p_retailprice / 2 * 1000000 + 0.5) / 1000000)::DECIMAL(30, 6))::VARCHAR, '0+$', ''), '\.$', '') AS half FROM a)
SELECT lower(p_brand) AS "Handle", p_partkey AS seq, CASE WHEN first THEN p_name ELSE '' END AS "Title", CASE WHEN first THEN p_brand ELSE '' END AS "Vendor", CASE WHEN first THEN 'TRUE' ELSE '' END AS "Published",
  'Title' AS "Option1 Name", p_size::VARCHAR AS "Option1 Value", CASE WHEN p_partkey % 4 > 0 THEN 'B' || regexp_extract(p_brand, '(\d+)$', 1) ELSE '' END AS "Variant SKU",
  CASE WHEN p_partkey % 5 = 0 THEN half ELSE full_ END AS "Variant Price", CASE WHEN p_partkey % 5 = 0 THEN full_ ELSE '' END AS "Variant Compare At Price" FROM m
"""
ORACLES["dedupe_products"] = f"""
WITH p AS ({ORACLES['canonical_urls']}), u AS (SELECT page_id, url_key FROM p),
s AS (SELECT url_key, page_id AS seq FROM u UNION ALL SELECT url_key, page_id + 1000000 FROM u)
SELECT url_key AS product_key, 'n' || arg_max(seq, {{'a': CASE WHEN seq % 2 = 0 THEN 0.9 ELSE 0.5 END, 'b': -seq}}) AS name, min(seq) AS first_seq, count(*) - 1 AS duplicates FROM s GROUP BY url_key
"""


def _structured() -> dict[str, str]:
    from souklens.plans.enrich_queries import ORACLES as asked
    from souklens.plans.export_queries import ORACLES as tables
    from souklens.plans.page_queries import ORACLES as pages
    from souklens.plans.store_queries import ORACLES as stores
    from souklens.plans.structured_queries import ORACLES as more

    return more | pages | tables | asked | stores


ORACLES |= _structured()
