"""Products out of the state that a page's scripts carry, and out of collection answers, which have the same shape.

A page is parsed once: its state scripts and assigned objects are cut out and walked, and what has the shape of a product comes
back as JSON. All fields are columns over those nodes; nothing is joined or grouped by page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.functions import graph as G
from souklens.functions.numbers import parse_number
from souklens.functions.text import canonical_url, let, resolve_url
from souklens.sources.markup import CONFIDENCE, PageTree

# Ids of state scripts, and names that state is assigned to.
SCRIPT_IDS = ("__NEXT_DATA__", "__NUXT_DATA__", "__APOLLO_STATE__")
GLOBALS = ("__NUXT__", "__INITIAL_STATE__", "__APOLLO_STATE__", "__PRELOADED_STATE__")
STATES = "page_id long, url string, currency string, nodes array<struct<label:string,shape:string,json:string>>"
MONEY = "struct<amount:double,currency:string>"
_DIGIT = re.compile("[0-9۰-۹٠-٩]")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)
_COMMA = re.compile(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', re.S)


def _constant(name: str):
    raise ValueError(name)


def lenient_json(text: str):
    """A script's JSON, as it is or without trailing commas; None if it is none (or nested beyond what a parser takes)."""
    text = text.strip()
    for wrapper in (r"\s*<!--(.*?)-->\s*", r"\s*(?://)?\s*<!\[CDATA\[(.*?)(?://)?\s*\]\]>\s*"):
        if m := re.fullmatch(wrapper, text, re.S):
            text = m[1].strip()
    for attempt in (lambda: text, lambda: _COMMA.sub(lambda m: m[1] or "", text)):
        try:
            return json.loads(attempt(), parse_constant=_constant)
        except (ValueError, RecursionError):
            continue
    return None


def assigned_object(html: str, name: str):
    """The object of the first `name = {...}`: from its brace to the one that closes it, braces within strings aside; None if none does."""
    m = re.search(rf"{re.escape(name)}\s*=\s*\{{", html)
    depth = 0
    for t in _TOKEN.finditer(html, m.end() - 1) if m else ():
        depth += {"{": 1, "}": -1}.get(t[0], 0)
        if depth == 0:
            return lenient_json(html[m.end() - 1 : t.end()])
    return None


def _priced(node: dict) -> bool:
    ranged = node.get("priceRange")
    for c in (ranged.get("minVariantPrice") if isinstance(ranged, dict) else None, node.get("price"), node.get("priceV2")):
        c = c.get("amount") if isinstance(c, dict) else c
        if isinstance(c, str | int | float) and not isinstance(c, bool) and _DIGIT.search(str(c)):
            return True
    return False


def shape_of(node: dict) -> str | None:
    """collection: a title and variants of which one has a price; storefront: a name, an identity and a price; else None."""
    variants = node.get("variants")
    variants = [v for v in (variants if isinstance(variants, list) else [variants]) if isinstance(v, dict)]
    if isinstance(node.get("title"), str) and any("price" in v for v in variants):
        return "collection"
    named = any(isinstance(node.get(k), str) for k in ("title", "name"))
    known = any(isinstance(node.get(k), str) for k in ("handle", "slug", "id", "url"))
    return "storefront" if named and known and _priced(node) else None


def product_nodes(state, deepest: int = 14, most: int = 20_000) -> list[tuple[str, dict]]:
    """Product-shaped objects of a state in order, those of the collection shape first; what is within one is part of it. Values
    below `deepest` levels, or behind the first `most`, aren't looked at: a state holds whole caches."""
    found: dict[str, list[dict]] = {"collection": [], "storefront": []}
    open_, seen = [(state, 0)], 0
    while open_ and seen <= most:
        value, depth = open_.pop()
        if depth > deepest:
            continue
        seen += 1
        if isinstance(value, dict):
            shape = shape_of(value)
            if shape:
                found[shape].append(value)
                continue
            value = list(value.values())
        if isinstance(value, list):
            open_ += [(x, depth + 1) for x in reversed(value)]
    return [(shape, node) for shape, nodes in found.items() for node in nodes]


def page_states(html: str) -> list[tuple[str, object]]:
    """(label, value) of each state of a page: the first script of each id, then assigned objects."""
    out = []
    if any(i in html for i in SCRIPT_IDS):
        tree = PageTree(html)
        for i in SCRIPT_IDS:
            n = next((k for k, x in enumerate(tree.nodes) if x[3] == "script" and x[4].get("id") == i), None)
            out.append((i, lenient_json(tree.text_of(n)) if n is not None else None))
    out += [(f"window.{name}", assigned_object(html, name)) for name in GLOBALS]
    return [(label, value) for label, value in out if value is not None]


def embedded_states(pages: DataFrame, *, default_currency: str | None = None, deepest: int = 14, most: int = 20_000) -> DataFrame:
    """One row per page (page_id, url, html): url, the currency that its scripts state, and the product nodes of its states as JSON.

    A page without any, a null page and broken or half-open JSON have no nodes; null and repeated ids are rows of their own."""
    from souklens.operators.detect import shop_currency

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("currency", pa.string()), ("nodes", pa.list_(pa.struct([("label", pa.string()), ("shape", pa.string()), ("json", pa.string())])))])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for page in batch.slice(at, 64).to_pylist():
                    nodes = [{"label": label, "shape": shape, "json": json.dumps(node, ensure_ascii=False)} for label, value in page_states(page.pop("html") or "") for shape, node in product_nodes(value, deepest, most)]
                    rows.append(page | {"nodes": nodes})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", shop_currency(F.col("html"), default_currency).alias("currency")).mapInArrow(run, STATES)


def _first_text(v: Column, *keys: str) -> Column:
    return F.coalesce(*[G.as_text(G.get(v, k)) for k in keys])


def _decimal(text: Column, currency: Column) -> Column:
    """Money of a text whose lone separator is a decimal point; null without a number."""
    return let(parse_number(text, "decimal")["value"], lambda n: F.when(n.isNotNull(), F.struct(n.alias("amount"), F.coalesce(currency, F.lit("")).alias("currency"))))


def _pair(price: Column, compare: Column) -> Column:
    """struct(regular, sale): a comparison price counts only above the price."""
    both = F.struct(price.alias("p"), compare.alias("c"))
    reduced = lambda b: b["c"]["amount"] > b["p"]["amount"]
    return let(both, lambda b: F.struct(F.when(reduced(b), b["c"]).otherwise(b["p"]).alias("regular"), F.when(reduced(b), b["p"]).alias("sale")))


def _objects(v: Column) -> Column:
    return F.filter(G.as_array(v), G.is_object)


def _distinct_links(texts: Column, url: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(texts, lambda t: resolve_url(t, url))))


def collection_url(node: Column, url: Column) -> Column:
    handle = G.as_text(G.get(node, "handle"))
    return canonical_url(F.coalesce(F.when(handle.isNotNull(), resolve_url(F.concat(F.lit("/products/"), handle), url)), url))


def collection_fields(node: Column, url: Column, currency: Column) -> Column:
    """Array of the rows that a product of the collection shape makes: itself, and behind a variable one its variations."""
    title, variants, options = G.as_text(G.get(node, "title")), _objects(G.get(node, "variants")), _objects(G.get(node, "options"))
    values = lambda o: F.array_compact(F.transform(G.as_array(G.get(o, "values")), G.as_text))
    texts = lambda v: F.array_compact(F.transform(G.as_array(v), G.as_text))
    axis = lambda name, vals: F.struct(name.alias("name"), vals.alias("values"), F.lit(True).alias("is_variation_axis"))

    def single(vs: Column, os: Column) -> Column:
        first = F.try_element_at(os, F.lit(1))
        raw = G.as_array(G.get(first, "values"))
        only = let(F.try_element_at(F.transform(raw, G.as_text), F.lit(1)), lambda x: x.isNull() | (x == "Default Title"))
        return (F.size(vs) == 1) & (F.size(os) <= 1) & (F.coalesce(F.size(raw), F.lit(0)) <= 1) & only

    def of_variant(v: Column) -> dict[str, Column]:
        price = _pair(_decimal(G.as_text(G.get(v, "price")), currency), _decimal(G.as_text(G.get(v, "compare_at_price")), currency))
        image = F.array_compact(F.array(resolve_url(G.as_text(G.get(v, "featured_image")), url)))
        return {"sku": G.as_text(G.get(v, "sku")), "in_stock": F.coalesce(F.try_variant_get(v, "$.available", "boolean"), F.lit(False)), "price": price, "grams": let(G.as_number(G.get(v, "grams")), lambda g: F.when(g > 0, g)), "images": image}

    def rows(x: Column) -> Column:
        v, o, one = x["v"], x["o"], x["one"]
        lone = of_variant(v[0])
        images = _distinct_links(F.transform(_objects(G.get(node, "images")), lambda i: G.as_text(G.get(i, "src"))), url)
        kind = G.as_text(G.get(node, "product_type"))
        axes = F.filter(F.transform(o, lambda q: axis(G.as_text(G.get(q, "name")), values(q))), lambda a: a["name"].isNotNull() & (F.size(a["values"]) > 0))
        none = lambda c: F.when(one, c)
        row = lambda **c: F.struct(*[c[k].alias(k) for k in ("kind", "name", "description", "brand", "category_path", "tags", "images", "attributes", "sku", "in_stock", "price", "grams")])
        blank = F.lit(None).cast("string")
        head = row(
            kind=F.when(one, "simple").otherwise("variable"), name=title, description=G.as_text(G.get(node, "body_html")), brand=G.as_text(G.get(node, "vendor")), category_path=F.array_compact(F.array(kind)), tags=texts(G.get(node, "tags")),
            images=F.when(F.size(images) > 0, images).otherwise(F.coalesce(none(lone["images"]), images)), attributes=F.when(one, F.slice(axes, 1, 0)).otherwise(axes), sku=none(lone["sku"]), in_stock=none(lone["in_stock"]), price=none(lone["price"]), grams=none(lone["grams"]),
        )

        def child(w: Column) -> Column:
            own = of_variant(w)
            said = F.filter(F.transform(o, lambda q, i: axis(G.as_text(G.get(q, "name")), F.array(F.element_at(F.array(*[G.as_text(G.get(w, f"option{k}")) for k in (1, 2, 3)]), F.least(i + 1, F.lit(3)))))), lambda a: a["name"].isNotNull() & a["values"][0].isNotNull())
            return row(kind=F.lit("variation"), name=title, description=blank, brand=blank, category_path=F.array().cast("array<string>"), tags=F.array().cast("array<string>"), images=own["images"], attributes=F.slice(said, 1, 3), sku=own["sku"], in_stock=own["in_stock"], price=own["price"], grams=own["grams"])

        return F.when(one, F.array(head)).otherwise(F.concat(F.array(head), F.transform(v, child)))

    both = let(F.struct(variants.alias("v"), options.alias("o")), lambda s: F.struct(s["v"].alias("v"), s["o"].alias("o"), single(s["v"], s["o"]).alias("one")))
    return let(both, rows)


def storefront_url(node: Column, url: Column) -> Column:
    handle = _first_text(node, "handle", "slug")
    target = F.coalesce(_first_text(node, "url", "onlineStoreUrl"), F.when(handle.isNotNull(), F.concat(F.lit("/products/"), handle)), url)
    return canonical_url(F.coalesce(resolve_url(target, url), url))


def storefront_fields(node: Column, url: Column, currency: Column) -> Column:
    """The one row of a storefront product, in the form of collection_fields."""

    def money(*candidates: Column) -> Column:
        read = lambda c: let(c, lambda x: _decimal(F.when(G.is_object(x), G.as_text(G.get(x, "amount"))).otherwise(G.as_text(x)), F.coalesce(F.when(G.is_object(x), G.as_text(G.get(x, "currencyCode"))), currency)))
        return F.coalesce(*[read(c) for c in candidates])

    least = lambda k: G.get(G.get(node, k), "minVariantPrice")
    compare = F.when(G.is_object(G.get(node, "compareAtPriceRange")), money(least("compareAtPriceRange"))).otherwise(money(G.get(node, "compareAtPrice")))
    raw = F.coalesce(*[G.get(node, k) for k in ("images", "featuredImage", "image")])
    listed = let(raw, lambda r: F.when(G.is_object(r), let(_objects(G.get(r, "edges")), lambda e: F.when(F.size(e) > 0, F.transform(e, lambda x: G.get(x, "node"))).otherwise(F.array(r)))).otherwise(G.as_array(r)))
    links = F.transform(listed, lambda i: F.when(G.is_object(i), _first_text(i, "url", "src", "originalSrc")).otherwise(G.as_text(i)))
    stock = let(F.coalesce(*[G.get(node, k) for k in ("availableForSale", "available", "inStock")]), lambda s: F.when(F.schema_of_variant(s) == "BOOLEAN", F.try_variant_get(s, "$", "boolean")))
    none = F.array().cast("array<string>")
    axes = F.array().cast("array<struct<name:string,values:array<string>,is_variation_axis:boolean>>")
    return F.array(F.struct(
        F.lit("simple").alias("kind"), _first_text(node, "title", "name").alias("name"), _first_text(node, "descriptionHtml", "description").alias("description"), _first_text(node, "vendor", "brand").alias("brand"), none.alias("category_path"), none.alias("tags"),
        F.coalesce(_distinct_links(links, url), none).alias("images"), axes.alias("attributes"), G.as_text(G.get(node, "sku")).alias("sku"), stock.alias("in_stock"), _pair(money(least("priceRange"), G.get(node, "price"), G.get(node, "priceV2")), compare).alias("price"), F.lit(None).cast("double").alias("grams"),
    ))


def _flat(d: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of `rows`, each with its place (row, from 0), and the confidence of the shape."""
    d = d.select(*keep, "source_url", "sure", F.posexplode_outer("rows").alias("row", "r")).where("row is not null")  # outer: else a filter reads the rows once more
    r = lambda *names: [F.col(f"r.{n}").alias(n) for n in names]
    return d.select(*keep, "row", "source_url", *r("kind", "name", "description", "brand", "category_path", "tags", "images", "attributes", "sku", "in_stock"), F.col("r.price.regular").alias("regular"), F.col("r.price.sale").alias("sale"), F.when(F.col("r.grams").isNotNull(), F.struct(F.col("r.grams").alias("value"), F.lit("g").alias("unit"))).alias("weight"), F.col("sure").alias("confidence"))


def read_embedded_state(states: DataFrame) -> DataFrame:
    """(page_id, url, label, pos, row, ...) of embedded_states: one row for each product and variation. Of nodes with the same
    address on a page the first counts; those without a name are none. Nodes of the collection shape are as sure as an API's
    answer, inferred ones less than JSON-LD."""
    url = F.col("url")
    node = lambda n: n["node"]
    parsed = F.transform("nodes", lambda n: F.struct(n["label"].alias("label"), n["shape"].alias("shape"), F.try_parse_json(n["json"]).alias("node")))
    addressed = F.transform(parsed, lambda n: F.struct(n["label"].alias("label"), n["shape"].alias("shape"), node(n).alias("node"), F.when(n["shape"] == "collection", collection_url(node(n), url)).otherwise(storefront_url(node(n), url)).alias("source_url")))
    named = F.filter(addressed, lambda n: F.when(n["shape"] == "collection", G.as_text(G.get(node(n), "title"))).otherwise(_first_text(node(n), "title", "name")).isNotNull())
    d = states.withColumn("_n", named).withColumn("_u", F.transform("_n", lambda n: n["source_url"]))
    first = F.filter("_n", lambda n, i: F.array_position("_u", n["source_url"]) == i + 1)
    d = d.select("page_id", "url", "currency", F.posexplode_outer(first).alias("pos", "n")).where("pos is not null").select("page_id", "url", "currency", "pos", "n.*")
    shop = F.col("shape") == "collection"
    rows = F.when(shop, collection_fields(F.col("node"), url, F.col("currency"))).otherwise(storefront_fields(F.col("node"), url, F.col("currency")))
    d = d.withColumns({"rows": rows, "sure": F.when(shop, CONFIDENCE["api"]).otherwise(CONFIDENCE["json-ld-derived"])})
    return _flat(d, ["page_id", "url", "label", "shape", "pos"])


def read_collection_json(responses: DataFrame, *, default_currency: str | None = None) -> DataFrame:
    """Products and variations of collection answers (url, seq, body, and, if it is there, currency) in full: options as axes, each
    variant's answers to them, weights, images, tags, the kind of product as category.

    A product needs a title. Answers repeat products when their paging fails: of those with one address on a host the first counts, by
    seq and place. A body that is no JSON has none."""
    currency = F.coalesce(F.col("currency"), F.lit(default_currency)) if "currency" in responses.columns else F.lit(default_currency)
    url = F.col("url")
    d = responses.select("url", "seq", currency.cast("string").alias("currency"), F.posexplode(_objects(G.get(F.try_parse_json("body"), "products"))).alias("pos", "node")).where(G.as_text(G.get(F.col("node"), "title")).isNotNull())
    d = d.withColumn("source_url", collection_url(F.col("node"), url))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("source_url").orderBy(F.col("seq").asc_nulls_last(), "pos"))).where("_n = 1").drop("_n")
    return _flat(d.withColumns({"rows": collection_fields(F.col("node"), url, F.col("currency")), "sure": F.lit(CONFIDENCE["api"])}), ["url", "seq", "pos"])
