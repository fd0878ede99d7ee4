"""What a page runs on and how it goes on: platform rules and pagination plans, from one parse of each page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from souklens.functions.text import canonical_url, clean_text, fold_for_compare, page_number, resolve_url
from souklens.operators.reports import rule_table, score_targets
from souklens.sources.markup import PageTree

# Platforms, whether their catalogue can be read, and the marks that tell them (kind, what, weight, label), in order.
ADAPTERS = ("woocommerce", "shopify", "nextjs", "nuxt")
PLATFORM_RULES = {
    "woocommerce": (
        ("generator", "woocommerce", 0.6, "generator meta names WooCommerce"), ("body", "woocommerce", 0.5, "body class woocommerce"), ("body", "woocommerce-page", 0.3, "body class woocommerce-page"),
        ("text", "/plugins/woocommerce/", 0.5, "wp-content/plugins/woocommerce asset"), ("text", "/wp-json/wc/store/", 0.6, "Store API path in page"), ("text", "wc_add_to_cart_params", 0.4, "wc_add_to_cart_params"),
        ("text", "woocommerce_params", 0.4, "woocommerce_params"), ("text", "wp-block-woocommerce", 0.25, "wp-block-woocommerce markup"), ("mark", "link[rel=https://api.w.org/]", 0.15, "WordPress REST link header"),
    ),
    "shopify": (
        ("mark", "#shopify-digital-wallet", 0.6, "shopify-digital-wallet meta"), ("text", "shopify.shop", 0.6, "Shopify JS global"), ("text", "cdn.shopify.com", 0.5, "cdn.shopify.com asset"), ("text", "cdn.shopifycloud.com", 0.4, "cdn.shopifycloud.com asset"),
        ("text", "/cdn/shop/", 0.4, "/cdn/shop/ asset path"), ("text", "myshopify.com", 0.4, "myshopify.com host"), ("mark", "#shopify-features", 0.3, "shopify-features script"),
    ),
    "magento": (("text", "text/x-magento-init", 0.6, "x-magento-init script"), ("text", "magento_", 0.4, "Magento_ JS module"), ("text", "/static/version", 0.4, "/static/version asset path"), ("generator", "magento", 0.6, "generator meta names Magento")),
    "nextjs": (("mark", "script#__NEXT_DATA__", 0.7, "__NEXT_DATA__ script"), ("text", "/_next/static", 0.4, "/_next/static asset path")),
    "nuxt": (("text", "window.__nuxt__", 0.7, "__NUXT__ state global"), ("text", "/_nuxt/", 0.4, "/_nuxt/ asset path"), ("mark", "script#__NUXT_DATA__", 0.5, "nuxt-data script")),
    "prestashop": (("generator", "prestashop", 0.6, "generator meta names PrestaShop"), ("text", "var prestashop", 0.6, "prestashop JS global"), ("text", "/modules/ps_", 0.3, "/modules/ps_ asset")),
    "opencart": (("generator", "opencart", 0.6, "generator meta names OpenCart"), ("text", "catalog/view/theme/", 0.5, "catalog/view/theme asset"), ("text", "index.php?route=", 0.3, "index.php?route= link")),
}
# Fixed values, in order: words on controls that load more, and attributes that hold the next page's address or number.
LOAD_MORE = ("load more", "show more", "view more", "see more", "more products", "نمایش بیشتر", "بیشتر", "مشاهده بیشتر", "محصولات بیشتر")
URL_ATTRS = ("data-url", "data-href", "data-next", "data-next-url", "data-next-page-url", "data-load-more-url", "data-ajax-url")
PAGE_ATTRS = ("data-page", "data-next-page", "data-paged", "data-current-page")
SCROLLERS = ("infinitescroll", "infinite_scroll", "jscroll", "data-auto-load")

FACTS = "generator string, body array<string>, marks array<string>"
CONTROLS = "rel_next array<string>, nav array<string>, explicit boolean, buttons array<string>, attrs array<map<string,string>>, scroll boolean"


def _parsed(pages: DataFrame, schema: str, read) -> DataFrame:
    """pages (html and more) with what read(tree) says of each, in one pass over Arrow batches: a page keeps its row, whatever
    its id. Columns of the added names are replaced."""
    new = pages.sparkSession.createDataFrame([], schema).schema
    pages = pages.drop(*new.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(new)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = pa.RecordBatch.from_pylist([read(PageTree(h or "")) for h in part.column("html").to_pylist()], schema=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, *found.columns], names=[*part.schema.names, *arrow.names])

    return pages.mapInArrow(run, T.StructType([*pages.schema, *new]))


def _own(pages: DataFrame, *more: str) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), *more, "html")


def _facts(tree: PageTree) -> dict:
    generator = next((a.get("content") for _, _, _, tag, a, _ in tree.nodes if tag == "meta" and a.get("name") == "generator"), None)
    body = next((a.get("class", "").lower().split() for _, _, _, tag, a, _ in tree.nodes if tag == "body"), [])
    marks = {m for _, _, _, tag, a, _ in tree.nodes if a.get("id") for m in (f"#{a['id']}", f"{tag}#{a['id']}")} | {f"{tag}[rel={a['rel']}]" for _, _, _, tag, a, _ in tree.nodes if a.get("rel")}
    return {"generator": generator.lower() if generator else None, "body": body, "marks": sorted(marks)}


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, generator, body, marks): what rules ask of a page's elements."""
    return _parsed(_own(pages), FACTS, _facts).drop("html")


def platform_rules(spark: SparkSession) -> DataFrame:
    rows = [(p, n, kind, needle, weight, label) for p, rules in PLATFORM_RULES.items() for n, (kind, needle, weight, label) in enumerate(rules)]
    return spark.createDataFrame(rows, "target string, rule_no int, kind string, needle string, weight double, label string")


def detect_platforms(pages: DataFrame, rules: DataFrame | None = None, *, least: float = 0.3) -> DataFrame:
    """(page_id, target, confidence, labels, adapter, rank) of pages (page_id, html): sums of the weights of marks found, at most 1, at
    least `least`; pages with none of them have one row: unknown.

    All is done within the page's row, in the pass that parses it: no exchange, null and repeated ids stay pages of their own, and
    a null page is unknown."""
    rules = platform_rules(pages.sparkSession) if rules is None else rules
    table = rule_table(rules.select("target", "rule_no", "kind", "needle", "weight", "label"))
    d = _parsed(_own(pages), FACTS, _facts).withColumn("_h", F.lower("html")).drop("html")
    has = lambda r: F.when(r["kind"] == "text", F.contains(F.col("_h"), r["needle"])).when(r["kind"] == "generator", F.contains(F.col("generator"), r["needle"])).when(r["kind"] == "body", F.array_contains("body", r["needle"])).otherwise(F.array_contains("marks", r["needle"]))
    d = d.select("page_id", F.filter(table, lambda r: F.coalesce(has(r), F.lit(False))).alias("_fired"))
    place = lambda t: F.array_position(F.array(*map(F.lit, PLATFORM_RULES)), t)
    shown = lambda t: F.struct((-F.floor(t["weight"] * 100 + 0.5) / 100).alias("less"), place(t["target"]).alias("place"), t["target"].alias("target"), t["labels"].alias("labels"))
    found = F.array_sort(F.transform(F.filter(score_targets(F.col("_fired")), lambda t: t["weight"] >= least - 1e-9), shown))
    none = F.array(F.struct(F.lit(-0.0).alias("less"), F.lit(0).cast("long").alias("place"), F.lit("unknown").alias("target"), F.array().cast("array<string>").alias("labels")))
    d = d.select("page_id", found.alias("_found")).select("page_id", F.posexplode(F.when(F.size("_found") > 0, F.col("_found")).otherwise(none)).alias("_k", "t"))
    return d.select("page_id", "t.target", F.abs("t.less").alias("confidence"), "t.labels", F.col("t.target").isin(*ADAPTERS).alias("adapter"), (F.col("_k") + 1).alias("rank"))


def _controls(tree: PageTree) -> dict:
    def classes(n: int) -> str:
        return tree.nodes[n][4].get("class", "").lower()

    def more(n: int) -> bool:
        return "data-load-more" in tree.nodes[n][4] or "load-more" in classes(n) or "loadmore" in classes(n)

    rel, nav, buttons, attrs, inside = {"link": [], "a": []}, [], [], [], [False] * len(tree.nodes)
    for n, parent, _, tag, a, _ in tree.nodes:
        c = classes(n)
        pager = "pagination" in c or "page-numbers" in c.split() or (tag in ("nav", "ul") and "pagin" in c)
        above = parent is not None and inside[parent]
        inside[n] = above or pager
        if tag == "a" and a.get("href") is not None and (above or "page-numbers" in c.split()):
            nav.append(a["href"])
        if tag in rel and a.get("href") is not None and ("next" in a.get("rel", "").split() if tag == "a" else a.get("rel") == "next"):
            rel[tag].append(a["href"])
        button = tag == "button" or tag == "a" and "button" in c.split()
        if button or tag == "a" and a.get("role") == "button":
            buttons.append(tree.text_of(n))
        if button or more(n):
            attrs.append({k: v for k, v in a.items() if k in URL_ATTRS or k in PAGE_ATTRS})
    scroll = any("data-infinite-scroll" in a or "infinite-scroll" in classes(n) for n, _, _, _, a, _ in tree.nodes)
    return {"rel_next": rel["link"][:1] + rel["a"][:1], "nav": nav, "explicit": any(more(n) for n in range(len(tree.nodes))), "buttons": buttons, "attrs": attrs, "scroll": scroll}


def _listed(tree: PageTree) -> dict:
    c = _controls(tree)
    return c | {"attrs": [list(x.items()) for x in c["attrs"]]}


def page_controls(pages: DataFrame) -> DataFrame:
    """(page_id, rel_next, nav, explicit, buttons, attrs, scroll): what a page says of its successor."""
    return _parsed(_own(pages), CONTROLS, _listed).drop("html")


def detect_pagination(pages: DataFrame) -> DataFrame:
    """(page_id, strategy, next_url, current_page, last_page, automatable, signals) of pages (page_id, url, html), the first that holds: a stated
    successor, a numbered link to the page after this one, a numbered list that ends here, a control that loads more (with the
    address in its attributes, or the number of a numbered link), endless scrolling, none. signals: in words, what it was told by."""
    d = _parsed(_own(pages, "url"), CONTROLS, _listed).withColumn("_h", F.lower("html")).drop("html")
    link = lambda h: canonical_url(resolve_url(F.when(F.trim(h) != "", h), F.col("url"), only_http=True))
    d = d.withColumns({"current_page": F.coalesce(page_number(F.col("url")), F.lit(1).cast("long")), "_self": canonical_url(F.col("url")), "_rel": F.transform("rel_next", link), "_nav": F.transform("nav", link)})
    numbered = F.filter(F.transform("_nav", lambda u: F.struct(page_number(u).alias("page"), u.alias("url"))), lambda s: s["page"].isNotNull())
    d = d.withColumn("_links", numbered).withColumn("last_page", F.array_max(F.transform("_links", lambda s: s["page"])))
    at = lambda page: F.try_element_at(F.filter("_links", lambda s: s["page"] == page), F.lit(1))["url"]
    rel = F.try_element_at(F.array_compact(F.col("_rel")), F.lit(1))
    words = F.array(*[fold_for_compare(F.lit(w)) for w in LOAD_MORE])
    label = F.try_element_at(F.filter("buttons", lambda t: F.exists(words, lambda w: F.contains(fold_for_compare(clean_text(t)), w))), F.lit(1))
    stated = F.filter(F.flatten(F.transform("attrs", lambda a: F.transform(F.array(*map(F.lit, URL_ATTRS)), lambda k: F.struct(link(F.try_element_at(a, k)).alias("url"), k.alias("k"))))), lambda x: x["url"].isNotNull())
    number = F.try_element_at(F.filter(F.flatten(F.transform("attrs", lambda a: F.transform(F.array(*map(F.lit, PAGE_ATTRS)), lambda k: F.trim(F.try_element_at(a, k))))), lambda t: t.rlike(r"^\d+$")), F.lit(1)).try_cast("long")
    d = d.withColumns({"_next": at(F.col("current_page") + 1), "_stated": F.try_element_at(stated, F.lit(1)), "_number": number, "_label": clean_text(label), "_first": rel})
    marker = F.try_element_at(F.filter(F.array(*map(F.lit, SCROLLERS)), lambda m: F.contains(F.col("_h"), m)), F.lit(1))
    scroll = F.when(F.col("scroll"), "infinite-scroll markup").otherwise(F.concat(marker, F.lit(" in page scripts")))
    more = F.when(F.col("explicit"), "load-more control").otherwise(F.concat(F.lit('control labelled "'), F.col("_label"), F.lit('"')))
    where = F.concat(F.lit("next page URL in "), F.col("_stated.k"))
    page, last = F.col("current_page").cast("string"), F.col("last_page").cast("string")
    more_url = F.coalesce("_stated.url", F.when(F.col("_number") > F.col("current_page"), at(F.col("_number"))))
    plan = lambda name, url, *told: F.struct(F.lit(name).alias("strategy"), url.cast("string").alias("next_url"), (F.array_compact(F.array(*told)) if told else F.array().cast("array<string>")).alias("signals"))
    chosen = (
        F.when(F.col("_first") != F.col("_self"), plan("rel-next", F.col("_first"), F.lit('rel="next" link'))).when(F.col("_next").isNotNull(), plan("numbered", F.col("_next"), F.concat(F.lit("numbered pagination, page "), page, F.lit(" of "), last)))
        .when(F.col("current_page") >= F.col("last_page"), plan("none", F.lit(None), F.concat(F.lit("numbered pagination exhausted at page "), last))).when(more.isNotNull(), plan("load-more", more_url, more, where)).when(scroll.isNotNull(), plan("infinite-scroll", F.lit(None), scroll)).otherwise(plan("none", F.lit(None)))
    )
    return d.withColumn("p", chosen).select("page_id", "p.strategy", "p.next_url", "current_page", "last_page", F.col("p.next_url").isNotNull().alias("automatable"), "p.signals")


def shop_currency(html: Column, fallback: str | None = None) -> Column:
    """The currency a shop's page states in its scripts."""
    stated = [F.regexp_extract(html, r, 1) for r in (r"Shopify\.currency\s*=\s*\{[^}]*[\"']?active[\"']?\s*:\s*[\"']([A-Za-z]{3})[\"']", r"[\"']currencyCode[\"']\s*:\s*[\"']([A-Za-z]{3})[\"']")]
    return F.coalesce(*[F.when(x != "", F.upper(x)) for x in stated], F.lit(fallback))


def choose_layer(candidates: DataFrame, page: str = "page_id") -> DataFrame:
    """One row per page: which of its readings counts (layer, seq, n, incomplete, blocked).

    candidates: layer (api, markup, profile), seq (the order in which APIs are asked), n products, incomplete, blocked. The first
    API answer that is blocked or has products decides: blocked ends the page with nothing; a complete one counts; of an
    incomplete one and the page's own reading the page counts only where it has strictly more, else the answer stays
    marked incomplete. Without such an answer the page counts. A page is read from its markup, and by its profile only
    where the markup gave nothing and the profile something. Null flags are false, a null n is 0, an API without seq comes
    last, the fullest of repeated readings stands; pages without an id are one page. One aggregation, combined before the exchange.
    """
    layer, n = F.col("layer"), F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long"))
    blocked, incomplete = F.coalesce("blocked", F.lit(False)), F.coalesce("incomplete", F.lit(False))
    answer = F.struct(F.col("seq").isNull().alias("late"), F.col("seq").cast("long").alias("seq"), (~blocked).alias("open"), (-n).alias("less"), incomplete.alias("incomplete"))
    most = lambda name: F.coalesce(F.max(F.when(layer == name, n)), F.lit(0).cast("long"))
    g = candidates.groupBy(F.col(page)).agg(F.min(F.when((layer == "api") & (blocked | (n > 0)), answer)).alias("_a"), most("markup").alias("_m"), most("profile").alias("_p"))
    own, by_profile = F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.col("_p")), (F.col("_m") == 0) & (F.col("_p") > 0)
    a = F.col("_a")
    stop = F.coalesce(~a["open"], F.lit(False))
    api = stop | (a.isNotNull() & (~a["incomplete"] | (own <= -a["less"])))
    return g.select(
        page,
        F.when(api, "api").when(by_profile, "profile").otherwise("markup").alias("layer"),
        F.when(api, a["seq"]).alias("seq"),
        F.when(stop, F.lit(0).cast("long")).when(api, -a["less"]).otherwise(own).alias("n"),
        (stop | (api & a["incomplete"])).alias("incomplete"),
        stop.alias("blocked"),
    )
