"""Pages to products by what their markup states: JSON-LD, microdata and meta tags, read once, merged by product.

One parse of a page yields one row: its JSON-LD scripts, its microdata items as JSON of the same shape, its meta tags. All
that follows is columns over that row, an explode of product nodes and their offers, and aggregates by page and product.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions import graph as G
from souklens.functions.numbers import GRAMS, MILLIMETRES, availability, parse_money, read_measure
from souklens.functions.text import canonical_url, fold_for_compare, let, resolve_url
from souklens.plans.lineage import settled
from souklens.sources.markup import CONFIDENCE, PageTree, without_home

READ = "page_id long, url string, scripts array<struct<type:string,text:string>>, items array<string>, meta array<struct<key:string,value:string>>"
SOURCES = ("json-ld", "microdata", "opengraph")
FIELDS = ("name", "sku", "description", "short_description", "gtin", "brand", "images", "category_path", "tags", "weight", "dimensions", "attributes", "price", "in_stock", "stock_quantity", "kind")
MONEY = "struct<amount:double,currency:string,unit:string>"
ATTRIBUTES = "array<struct<name:string,values:array<string>,is_variation_axis:boolean>>"
# Attributes of images that are loaded late; elements whose value is an address.
LAZY = ("data-src", "data-lazy-src", "data-original", "data-lazy")
ADDRESS = {"a": "href", "area": "href", "link": "href", "object": "data", **dict.fromkeys(("audio", "embed", "iframe", "source", "track", "video"), "src")}


def _joined(url: str, href: str) -> str:
    """A link against its page, or as it is written if it is no address."""
    try:
        return urljoin(url, href.strip())
    except ValueError:
        return href.strip()


def _property(tree: PageTree, n: int, url: str) -> str:
    """The value of a microdata property that is no item itself."""
    tag, attrs = tree.nodes[n][3], tree.nodes[n][4]
    if "content" in attrs:
        return attrs["content"]
    if tag == "img":
        src = attrs.get("src")
        late = [attrs[a] for a in LAZY if attrs.get(a)] + [attrs[a].split(",")[0].split()[0] for a in ("srcset", "data-srcset") if attrs.get(a, "").split(",")[0].strip()]
        src = src if src and not src.lower().startswith("data:") else (late or [src])[0]
        return _joined(url, src) if src else ""
    if tag in ADDRESS:
        return _joined(url, attrs[ADDRESS[tag]]) if ADDRESS[tag] in attrs else ""
    if tag in ("data", "meter") and "value" in attrs:
        return attrs["value"]
    return attrs["datetime"] if tag == "time" and "datetime" in attrs else tree.text_of(n)


def microdata_items(tree: PageTree, url: str, deepest: int = 12) -> list[dict]:
    """The items of a page that are no property of another, with the properties of their elements and of those they refer to."""

    def properties(root: int) -> list[int]:
        found, open_ = [], list(reversed(tree.children[root]))
        for ref in tree.nodes[root][4].get("itemref", "").split():
            n = tree.ids.get(ref)
            if n is not None and n != root:
                open_ = ([n] if "itemprop" in tree.nodes[n][4] else list(reversed(tree.children[n]))) + open_
        while open_:
            n = open_.pop()
            attrs = tree.nodes[n][4]
            if "itemprop" in attrs:
                found.append(n)
            if "itemscope" not in attrs:
                open_ += reversed(tree.children[n])
        return found

    def item(root: int, depth: int) -> dict:
        attrs, out = tree.nodes[root][4], {}
        kinds = attrs.get("itemtype", "").split()
        if kinds:
            out["@type"] = kinds if len(kinds) > 1 else kinds[0]
        if attrs.get("itemid", "").strip():
            out["@id"] = attrs["itemid"].strip()
        for n in properties(root) if depth < deepest else []:
            value = item(n, depth + 1) if "itemscope" in tree.nodes[n][4] else _property(tree, n, url)
            for name in tree.nodes[n][4]["itemprop"].split():
                out[name] = value if name not in out else [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        return out

    return [item(n, 0) for n, x in enumerate(tree.nodes) if "itemscope" in x[4] and "itemprop" not in x[4]]


def read_markup(pages: DataFrame) -> DataFrame:
    """One row per page (page_id, url, html): its scripts of linked data, its microdata items, its meta tags. The only parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("scripts", pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))), ("items", pa.list_(pa.string())), ("meta", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b, scripts, items, meta = batch.slice(at, 256), [], [], []
                for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                    tree = PageTree(html or "")
                    kinds = [(n, x[4].get("type", "")) for n, x in enumerate(tree.nodes) if x[3] == "script"]
                    scripts.append([{"type": kind, "text": tree.text_of(n)} for n, kind in kinds if "ld+json" in kind.lower() or "json+ld" in kind.lower()])
                    stated = [((a.get("property") or a.get("name") or "").strip().lower(), a.get("content", "").strip()) for _, _, _, tag, a, _ in tree.nodes if tag == "meta"]
                    meta.append([{"key": key, "value": value} for key, value in stated if key and value])
                    items.append([json.dumps(x, ensure_ascii=False) for x in microdata_items(tree, url or "")])
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *(pa.array(c, schema.field(n).type) for n, c in (("scripts", scripts), ("items", items), ("meta", meta)))], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, READ)


def parse_blocks(read: DataFrame) -> DataFrame:
    """read with blocks: array of (doc, status) of its JSON-LD scripts: ok, repaired (without trailing commas) or invalid; empty ones
    are ignored, and one bad script costs no other."""
    kind = lambda s: F.lower(F.trim(F.substring_index(s["type"], ";", 1)))
    bare = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)^\s*<!--(.*?)-->\s*$", "$1"), r"(?s)^\s*(?://)?\s*<!\[CDATA\[(.*?)(?://)?\s*\]\]>\s*$", "$1"))
    mended = lambda t: F.regexp_replace(t, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")
    raw = F.filter(F.transform(F.filter("scripts", lambda s: kind(s).isin("application/ld+json", "application/json+ld")), lambda s: bare(s["text"])), lambda t: t != "")
    both = F.transform(raw, lambda t: F.struct(F.try_parse_json(t).alias("first"), F.try_parse_json(mended(t)).alias("second")))
    status = lambda b: F.when(b["first"].isNotNull(), "ok").when(b["second"].isNotNull(), "repaired").otherwise("invalid")
    return read.withColumn("blocks", F.transform(both, lambda b: F.struct(F.coalesce(b["first"], b["second"]).alias("doc"), status(b).alias("status"))))


def _docs(source: int) -> Column:
    """The documents of a page (blocks and items of read_markup) in one source."""
    blocks = F.transform(F.filter("blocks", lambda b: b["doc"].isNotNull()), lambda b: b["doc"])
    return blocks if source == 0 else F.array_compact(F.transform("items", lambda t: F.try_parse_json(t)))


def with_subjects(nodes: Column, index: Column) -> Column:
    """Schema.org nodes, and behind them what those that are no products are about."""
    about = F.flatten(F.transform(F.filter(nodes, lambda n: ~G.is_product_node(n)), lambda n: F.flatten(F.array(*[G.resolve_all(G.get(n, k), index) for k in ("mainEntity", "mainEntityOfPage", "about")]))))
    return F.concat(nodes, F.filter(about, G.is_object))


def _both(name: str, f) -> dict[str, Column]:
    """A column for each source: name0 and name1."""
    return {f"{name}{k}": f(k) for k in range(2)}


def _scanned(read: DataFrame) -> DataFrame:
    """read with, for each source k: index{k}, products{k} (product nodes in order, without those that are another's variants),
    discovered{k} (addresses of lists), breadcrumb{k} (the longest trail). Each step is a column, computed once."""
    url = F.col("url")
    names = lambda v: F.try_variant_get(v, "$['@id']", "string")
    is_list = lambda n: G.is_type(n, "itemlist", "offercatalog")
    d = parse_blocks(read).withColumns(_both("_docs", lambda k: _docs(k)))
    d = d.withColumns(_both("index", lambda k: G.id_index(F.col(f"_docs{k}"))) | _both("_flat", lambda k: G.flatten_graph(F.col(f"_docs{k}"))))
    d = d.withColumns(_both("_nodes", lambda k: with_subjects(F.col(f"_flat{k}"), F.col(f"index{k}"))))
    index = lambda k: F.col(f"index{k}")
    others = lambda k: F.filter(f"_nodes{k}", lambda n: ~G.is_product_node(n))
    trails = lambda k: F.transform(F.filter(others(k), lambda n: G.is_type(n, "breadcrumblist")), lambda n: without_home(G.crumbs_of(n, index(k), url)))
    new = _both("_found", lambda k: F.flatten(F.transform(f"_nodes{k}", lambda n: F.when(G.is_product_node(n), F.array(n)).when(is_list(n), G.list_products(n, index(k))).otherwise(G._nothing()))))
    new |= _both("discovered", lambda k: F.array_distinct(F.flatten(F.transform(F.filter(others(k), is_list), lambda n: G.list_urls(n, index(k), url)))))
    new |= _both("breadcrumb", lambda k: F.reduce(trails(k), F.array().cast("array<string>"), lambda best, p: F.when(F.size(p) > F.size(best), p).otherwise(best)))
    d = d.withColumns(new)
    d = d.withColumns(_both("_json", lambda k: F.transform(f"_found{k}", lambda p: F.to_json(p))))  # a node reached twice counts once
    d = d.withColumns(_both("_once", lambda k: F.filter(f"_found{k}", lambda p, i: F.array_position(F.col(f"_json{k}"), F.col(f"_json{k}")[i]) == i + 1)))
    taken = lambda k: F.array_compact(F.flatten(F.transform(F.filter(f"_once{k}", G.is_product_group), lambda p: F.transform(G.resolve_all(G.get(p, "hasVariant"), F.col(f"index{k}")), names))))
    d = d.withColumns(_both("_taken", lambda k: taken(k)))
    d = d.withColumns(_both("products", lambda k: F.filter(f"_once{k}", lambda p: ~F.coalesce(F.array_contains(F.col(f"_taken{k}"), names(p)), F.lit(False)))))
    return d.drop(*[f"{c}{k}" for c in ("_docs", "_flat", "_nodes", "_found", "_json", "_once", "_taken") for k in (0, 1)])


def _with_rows(d: DataFrame) -> DataFrame:
    """_scanned with nodes: an array of (source, pos, has_variants, variant, node, axis_attributes), each product node (variant null) and
    behind it each node of its hasVariant (variant from 0), with the attributes that variants give."""
    c = lambda name, k: F.col(f"{name}{k}")
    value = lambda v, a, index: F.struct(G.axis_label(a).alias("name"), G.axis_value(v, a, index).alias("value"))
    row = lambda k, pos, has, variant, node, axes: F.struct(F.lit(k).alias("source"), pos.alias("pos"), has.alias("has_variants"), variant.alias("variant"), node.alias("node"), axes.alias("axis_attributes"))
    axis = lambda p: F.struct(p["name"].alias("name"), F.array(p["value"]).alias("values"), F.lit(True).alias("is_variation_axis"))
    d = d.withColumns(_both("_variants", lambda k: F.transform(f"products{k}", lambda p: F.when(G.is_product_group(p), F.filter(G.resolve_all(G.get(p, "hasVariant"), c("index", k)), G.is_object)).otherwise(G._nothing()))))
    d = d.withColumns(_both("_axes", lambda k: F.transform(f"products{k}", lambda p, i: F.when(F.size(c("_variants", k)[i]) > 0, G.axis_names(p, c("_variants", k)[i])).otherwise(F.array().cast("array<string>")))))
    stated = lambda v, axes, index: F.filter(F.transform(axes, lambda a: value(v, a, index)), lambda p: p["value"].isNotNull())
    d = d.withColumns(_both("_stated", lambda k: F.transform(f"_variants{k}", lambda vs, i: F.transform(vs, lambda v: stated(v, c("_axes", k)[i], c("index", k))))))
    d = d.withColumns(_both("_options", lambda k: F.transform(f"_stated{k}", lambda st: G.axis_options(st))))

    def rows(p: Column, i: Column, k: int) -> Column:
        vs = c("_variants", k)[i]
        return F.concat(F.array(row(k, i, F.size(vs) > 0, F.lit(None).cast("int"), p, c("_options", k)[i])), F.transform(vs, lambda v, j: row(k, i, F.size(vs) > 0, j, v, F.transform(c("_stated", k)[i][j], axis))))

    of = lambda k: F.flatten(F.transform(f"products{k}", lambda p, i: rows(p, i, k)))
    d = d.withColumn("nodes", F.concat(of(0), of(1)))
    return d.drop(*[f"{x}{k}" for x in ("_variants", "_axes", "_stated", "_options") for k in (0, 1)])


def _index(r: Column) -> Column:
    """The index of a row's source."""
    return F.when(r["source"] == 0, F.col("index0")).otherwise(F.col("index1"))


def _with_offers(d: DataFrame, default_currency: str | None = None, default_unit: str | None = None) -> DataFrame:
    """_with_rows with offers: what the offers of each node come to: the cheapest one's regular and sale price (the first of equals), the
    range, whether any is in stock, the first stated quantity and SKU, and how many have a price."""
    money = lambda text, currency: parse_money(text, F.coalesce(currency, F.lit(default_currency)), default_unit)
    texts = lambda o: F.struct(*[v.alias(x) for x, v in G.offer_texts(o).items()])
    moneys = lambda t: F.struct(t.alias("t"), money(t["now_text"], t["now_currency"]).alias("now"), money(t["list_text"], t["list_currency"]).alias("list"), money(t["high_text"], t["now_currency"]).alias("high"))

    def priced(m: Column, i: Column) -> Column:
        t, reduced = m["t"], m["list"]["amount"] > m["now"]["amount"]
        regular, sale = F.when(reduced, m["list"]).otherwise(F.coalesce(m["now"], m["list"])), F.when(reduced, m["now"])
        return F.struct(regular["amount"].alias("amount"), i.alias("i"), regular.alias("regular"), sale.alias("sale"), F.when(m["high"]["amount"] > regular["amount"], m["high"]["amount"]).alias("high"), t["offer_stock"].alias("stock"), t["quantity"].alias("quantity"), t["offer_sku"].alias("sku"))

    def best(offers: Column) -> Column:
        stated = F.filter(offers, lambda o: o["regular"].isNotNull())
        first = lambda name: F.try_element_at(F.filter(F.transform(offers, lambda o: o[name]), lambda x: x.isNotNull()), F.lit(1))
        stock = F.when(F.exists(offers, lambda o: F.coalesce(o["stock"], F.lit(False))), True).when(F.exists(offers, lambda o: o["stock"].isNotNull()), False)
        return F.struct(F.array_min(stated).alias("b"), F.array_max(F.transform(offers, lambda o: F.coalesce(o["high"], o["amount"]))).alias("high"), stock.alias("stock"), first("quantity").alias("quantity"), first("sku").alias("sku"), F.size(stated).cast("long").alias("n"))

    def whole(x: Column) -> Column:
        b, above = x["b"], x["high"] > x["b"]["amount"]
        return F.struct(
            b["regular"].alias("regular"), F.when(b["sale"]["amount"] < b["amount"], b["sale"]).alias("sale"), F.when(above, x["high"]).alias("high_price"), F.coalesce(above, F.lit(False)).alias("is_range"),
            x["stock"].alias("in_stock"), x["quantity"].alias("stock_quantity"), x["sku"].alias("offer_sku"), x["n"].alias("n_priced"),
        )

    d = d.withColumn("_list", F.transform("nodes", lambda r: G.nested_offers(G.get(r["node"], "offers"), _index(r))))
    d = d.withColumn("_texts", F.transform("_list", lambda os: F.transform(os, texts)))
    d = d.withColumn("_moneys", F.transform("_texts", lambda ts: F.transform(ts, moneys)))
    d = d.withColumn("_priced", F.transform("_moneys", lambda ms: F.transform(ms, priced)))
    d = d.withColumn("_best", F.transform("_priced", best))
    return d.withColumn("offers", F.transform("_best", whole)).drop("_list", "_texts", "_moneys", "_priced", "_best")


def node_offers(read: DataFrame, default_currency: str | None = None, default_unit: str | None = None) -> DataFrame:
    """One row per product node and variant of the pages of read_markup: (page_id, url, source, pos, has_variants, variant) and what
    its offers come to."""
    d = _with_offers(_with_rows(_scanned(read)), default_currency, default_unit)
    pairs = F.zip_with("nodes", "offers", lambda r, o: F.struct(r["source"].alias("source"), r["pos"].alias("pos"), r["has_variants"].alias("has_variants"), r["variant"].alias("variant"), o.alias("o")))
    d = d.select("page_id", "url", F.explode_outer(pairs).alias("x")).where("x is not null")  # outer: else a filter computes the pairs once more
    return d.select("page_id", "url", "x.source", "x.pos", "x.has_variants", "x.variant", "x.o.*")


def price_issues(read: DataFrame) -> DataFrame:
    """(page_id, source, pos, variant, severity, code) of prices as node_offers gives them."""
    currency, unit = F.col("regular.currency"), F.col("regular.unit")
    issue = lambda ok, severity, code: F.when(ok, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    found = F.array_compact(F.array(issue(F.col("is_range"), "info", "price-range-only"), issue(F.col("regular.ambiguous"), "warning", "price-separator-ambiguous"), issue(currency == "", "warning", "price-currency-missing"), issue((F.upper(currency) == "IRR") & unit.isNull(), "warning", "price-unit-unknown")))
    return read.where("regular is not null").select("page_id", "source", "pos", "variant", F.explode(found).alias("i")).select("page_id", "source", "pos", "variant", "i.*")


def _money(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c["amount"].alias("amount"), c["currency"].alias("currency"), c["unit"].alias("unit")))


def _stated(value: Column, confidence: Column | float, blank: Column | None = None) -> Column:
    """struct(value, confidence), null where the value says nothing."""
    return F.when(value.isNotNull() & (F.lit(True) if blank is None else ~blank), F.struct(value.alias("value"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence")))


#: A product or variant as one source of a page has it: each field with its confidence, null where it says nothing.
_SIZE = "struct<value:double,unit:string>"
_KINDS = {
    "images": "array<string>", "category_path": "array<string>", "tags": "array<string>", "weight": _SIZE, "dimensions": f"struct<length:{_SIZE},width:{_SIZE},height:{_SIZE}>", "attributes": ATTRIBUTES,
    "price": f"struct<regular:{MONEY},sale:{MONEY}>", "in_stock": "boolean", "stock_quantity": "bigint",
}
ROW = "struct<source:int,pos:int,variant:int,has_variants:boolean,product_url:string," + ",".join(f"{f}:struct<value:{_KINDS.get(f, 'string')},confidence:double>" for f in FIELDS) + ">"


def _row(source: Column, pos: Column, variant: Column, has_variants: Column, product_url: Column, values: dict[str, Column]) -> Column:
    heads = {"source": source, "pos": pos, "variant": variant, "has_variants": has_variants, "product_url": product_url}
    return F.struct(*[v.alias(k) for k, v in heads.items()], *[values[f].alias(f) for f in FIELDS]).cast(ROW)


def map_node(r: Column, o: Column, index: Column, url: Column) -> Column:
    """A node of _with_rows, and what its offers come to, as a ROW."""
    node = r["node"]
    text = lambda k: G.as_text(G.get(node, k))
    length, width, height = (G.read_quantity(v, MILLIMETRES) for v in (F.coalesce(G.get(node, "depth"), G.get(node, "length")), G.get(node, "width"), G.get(node, "height")))
    maker = lambda k: G.read_name(G.resolve(G.get(node, k), index))
    sure = F.when(r["source"] == 0, CONFIDENCE["json-ld"]).otherwise(CONFIDENCE["microdata"])
    some = lambda c: let(c, lambda x: _stated(x, sure))
    listed = lambda c: let(c, lambda x: _stated(x, sure, F.size(x) == 0))
    url_of = canonical_url(F.coalesce(G.node_url(node, url), url))

    def attributes(spec: Column) -> Column:
        axes = r["axis_attributes"]
        own = let(F.transform(axes, lambda a: fold_for_compare(a["name"])), lambda folded: F.filter(spec, lambda a: ~F.array_contains(folded, fold_for_compare(a["name"]))))
        return F.when(r["variant"].isNotNull(), F.when(F.size(axes) > 0, axes).otherwise(spec)).otherwise(F.concat(axes, own))

    price = F.struct(_money(o["regular"]).alias("regular"), _money(o["sale"]).alias("sale"))
    values = {
        "name": some(text("name")), "sku": some(F.coalesce(text("sku"), o["offer_sku"])), "description": some(text("description")), "short_description": some(F.coalesce(text("disambiguatingDescription"), text("abstract"))), "gtin": some(G.read_gtin(node)),
        "brand": some(F.coalesce(maker("brand"), maker("manufacturer"))), "images": listed(G.read_images(G.get(node, "image"), url)), "category_path": listed(G.read_category_path(G.get(node, "category"))), "tags": listed(G.read_keywords(G.get(node, "keywords"))),
        "weight": some(G.read_quantity(G.get(node, "weight"), GRAMS)), "dimensions": let(F.struct(length.alias("length"), width.alias("width"), height.alias("height")), lambda x: _stated(x, sure, F.coalesce(x["length"], x["width"], x["height"]).isNull())),
        "attributes": listed(let(G.read_properties(G.get(node, "additionalProperty")), attributes)), "price": _stated(price, F.when(o["is_range"], CONFIDENCE["weak"]).otherwise(sure), o["regular"].isNull()), "in_stock": _stated(o["in_stock"], sure), "stock_quantity": _stated(o["stock_quantity"], sure),
        "kind": _stated(F.when(r["variant"].isNotNull(), "variation").when(F.size(r["axis_attributes"]) > 0, "variable"), sure),
    }
    return _row(r["source"], r["pos"], r["variant"], r["has_variants"], url_of, values)


def with_opengraph(read: DataFrame, default_currency: str | None = None, default_unit: str | None = None) -> DataFrame:
    """read with opengraph: an array of the one ROW that a page's meta tags describe, empty unless they say that it is a product, or state a price."""
    every = lambda k: F.transform(F.filter("meta", lambda m: m["key"] == k), lambda m: m["value"])
    first = lambda *keys: F.coalesce(*[F.try_element_at(every(k), F.lit(1)) for k in keys])
    listed = lambda *keys: F.array_distinct(F.concat(*[every(k) for k in keys]))
    tags = {
        "_type": F.lower(first("og:type")), "_price": first("product:price:amount"), "_og_price": first("og:price:amount"), "_sale": first("product:sale_price:amount"), "_was": first("product:original_price:amount"), "_currency": first("product:price:currency", "og:price:currency"),
        "_sale_currency": first("product:sale_price:currency"), "_was_currency": first("product:original_price:currency"), "_gtin": first("product:ean", "product:gtin13", "product:upc", "product:isbn"),
        "_category": first("product:category", "article:section"), "_weight": first("product:weight:value"), "_units": first("product:weight:units"), "_stock": first("product:availability", "og:availability"), "_url": first("og:url"),
    }
    d = read.withColumns(tags)
    told = F.coalesce(F.col("_type").isin("product", "og:product", "product.item", "product.group"), F.lit(False)) | F.col("_price").isNotNull() | F.col("_sale").isNotNull()
    money = lambda c, currency: let(parse_money(c, F.coalesce(currency, F.lit(default_currency)), default_unit), _money)
    d = d.withColumns({"price_": money(F.coalesce("_price", "_og_price"), F.col("_currency")), "sale_": money(F.col("_sale"), F.coalesce("_sale_currency", "_currency")), "was_": money(F.col("_was"), F.coalesce("_was_currency", "_currency"))})
    pair = lambda r, s: F.struct(r.alias("regular"), s.cast(MONEY).alias("sale"))
    price = F.when(F.col("sale_.amount") < F.col("price_.amount"), pair(F.col("price_"), F.col("sale_"))).when(F.col("was_.amount") > F.col("price_.amount"), pair(F.col("was_"), F.col("price_"))).otherwise(pair(F.coalesce("price_", "sale_", "was_"), F.lit(None)))
    url = F.col("url")
    images = F.array_distinct(F.array_compact(F.transform(listed("og:image:secure_url", "og:image", "og:image:url", "twitter:image"), lambda t: resolve_url(t, url, only_http=True))))
    weight = read_measure(F.col("_weight"), None, F.col("_units"))
    sure = CONFIDENCE["opengraph"]
    none = lambda kind: F.lit(None).cast(f"struct<value:{kind},confidence:double>")
    size = "struct<value:double,unit:string>"
    values = {
        "name": _stated(first("og:title", "twitter:title"), sure), "short_description": _stated(first("og:description", "twitter:description"), sure), "sku": _stated(first("product:retailer_item_id", "product:retailer_part_no", "product:sku"), sure),
        "brand": _stated(first("product:brand", "og:brand"), sure), "gtin": _stated(F.col("_gtin"), sure, ~F.col("_gtin").rlike(r"^\d{6,14}$")), "images": _stated(images, sure, F.size(images) == 0), "in_stock": _stated(availability(F.col("_stock")), sure),
        "price": _stated(price, sure, price["regular"].isNull()), "weight": _stated(F.when(weight["unit"].isin(*GRAMS), weight), sure), "category_path": _stated(F.array("_category"), sure, F.col("_category").isNull() | F.col("_category").rlike(r"^\d+$")),
        "description": none("string"), "tags": none("array<string>"), "dimensions": none(f"struct<length:{size},width:{size},height:{size}>"), "attributes": none(ATTRIBUTES), "stock_quantity": none("bigint"), "kind": none("string"),
    }
    url_of = canonical_url(F.coalesce(resolve_url(F.col("_url"), url, only_http=True), url))
    row = _row(F.lit(2), F.lit(0), F.lit(None), F.lit(False), url_of, values)
    return d.select(*read.columns, F.when(told, F.array(row)).otherwise(F.array().cast(f"array<{ROW}>")).alias("opengraph"))


def _merged(d: DataFrame) -> DataFrame:
    """d (rows: ROWs of all sources, by source and pos) with merged: parents, one struct per product, in order: each field from its
    surest source, of equals the first; a page with one product in each source has one product, whatever their addresses; owner:
    the node whose variants count."""
    addresses = lambda k: F.array_distinct(F.transform(F.filter("_parents", lambda r: r["source"] == k), lambda r: r["product_url"]))
    one = lambda a, b: (F.size(a) == 1) & (F.size(b) == 1)
    u0, u1, u2, first = (F.col(c) for c in ("_u0", "_u1", "_u2", "_u01"))
    key = lambda r: F.when((r["source"] == 1) & one(u0, u1), u0[0]).when((r["source"] == 2) & one(first, u2), first[0]).otherwise(r["product_url"])

    def best(xs: Column, f: str) -> Column:
        stated = F.filter(F.transform(xs, lambda x, i: F.struct(x[f]["confidence"].alias("c"), (-i).alias("i"), x[f].alias("v"))), lambda s: s["v"].isNotNull())
        return F.array_max(stated)["v"].alias(f)

    def product(g: Column) -> Column:
        owner = F.try_element_at(F.filter(g["rows"], lambda x: x["has_variants"]), F.lit(1))
        return F.struct(g["k"].alias("source_url"), F.when(owner.isNotNull(), F.struct(owner["source"].alias("source"), owner["pos"].alias("pos"))).alias("owner"), *[best(g["rows"], f) for f in FIELDS])

    d = d.withColumn("_parents", F.filter("rows", lambda r: r["variant"].isNull()))
    d = d.withColumns({f"_u{k}": addresses(k) for k in (0, 1, 2)})
    d = d.withColumn("_u01", F.when(one(u0, u1), u0).otherwise(F.array_union("_u0", "_u1")))
    d = d.withColumn("_keys", F.transform("_parents", key))
    groups = F.transform(F.array_distinct("_keys"), lambda k: F.struct(k.alias("k"), F.filter("_parents", lambda r, i: F.col("_keys")[i].eqNullSafe(k)).alias("rows")))
    d = d.withColumn("_groups", groups)
    return d.withColumn("merged", F.transform("_groups", product)).drop("_parents", "_u0", "_u1", "_u2", "_u01", "_keys", "_groups")


def trim_self_crumb(path: Column, name: Column) -> Column:
    return F.when(fold_for_compare(F.try_element_at(path, F.lit(-1))) == fold_for_compare(name), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).otherwise(path)


def with_breadcrumb(p: Column, trail: Column) -> Column:
    """The category of a merged product: the page's trail (breadcrumb, source) where nothing surer states one, without the product's own crumb."""
    sure = F.when(trail["source"] == 0, CONFIDENCE["json-ld-derived"]).otherwise(CONFIDENCE["microdata-derived"])
    path = F.when(p["name"].isNotNull(), trim_self_crumb(trail["breadcrumb"], p["name"]["value"])).otherwise(trail["breadcrumb"])
    better = (F.size(path) > 0) & (sure > F.coalesce(p["category_path"]["confidence"], F.lit(-1.0)))
    return F.when(better, F.struct(path.alias("value"), sure.alias("confidence"))).otherwise(p["category_path"])


def finish_products(merged: Column, rows: Column, trail: Column) -> Column:
    """Products and, behind each, its variations: a parent without a name goes with its variants; a variation has its parent's address
    and, without one of its own, its name."""
    rest = [f for f in FIELDS if f not in ("kind", "name")]

    def sure(confidences: dict[str, Column]) -> Column:
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("k"), c.alias("v")) for f, c in confidences.items()]), lambda e: e["v"].isNotNull()))

    def row(url: Column, variant: Column, kind: Column, parent_sku: Column, name: Column, fields: dict[str, Column]) -> Column:
        stated = {f: (name if f == "name" else fields[f])["confidence"] for f in FIELDS}
        heads = {"source_url": url, "variant": variant, "kind": kind, "parent_sku": parent_sku, "name": name["value"]}
        return F.struct(*[v.alias(k) for k, v in heads.items()], *[fields[f]["value"].alias(f) for f in rest], sure(stated).alias("field_confidence"))

    def family(p: Column) -> Column:
        kind = F.when(p["owner"].isNotNull(), "variable").otherwise(F.coalesce(p["kind"]["value"], F.lit("simple")))
        fields = {f: p[f] for f in FIELDS} | {"category_path": with_breadcrumb(p, trail)}
        head = row(p["source_url"], F.lit(None).cast("int"), kind, F.lit(None).cast("string"), p["name"], fields)
        kids = F.filter(rows, lambda r: r["variant"].isNotNull() & (r["source"] == p["owner"]["source"]) & (r["pos"] == p["owner"]["pos"]))
        child = lambda r: row(p["source_url"], r["variant"], F.lit("variation"), p["sku"]["value"], F.coalesce(r["name"], p["name"]), {f: r[f] for f in FIELDS})
        return F.concat(F.array(head), F.transform(kids, child))

    return F.flatten(F.transform(F.filter(merged, lambda p: p["name"].isNotNull()), family))


def extract_pages(pages: DataFrame, *, default_currency: str | None = None, default_unit: str | None = None) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, products, discovered, issues), a row for each: everything above, within the row.

    No page is joined, grouped or moved, so ids may be null or repeated, and the same code reads a stream of pages. products:
    parents and behind each its variations (variant from 0); discovered: addresses of lists that no product of the page has;
    issues: (severity, code). A null page has no products and the issue that it holds no structured data."""
    url = F.col("url")
    d = _with_offers(_with_rows(_scanned(read_markup(pages))), default_currency, default_unit)
    d = with_opengraph(d, default_currency, default_unit)
    d = d.withColumn("_mapped", F.transform("nodes", lambda r, i: map_node(r, F.col("offers")[i], _index(r), url)))
    trail = lambda k: F.when(F.size(f"breadcrumb{k}") > 0, F.struct(F.col(f"breadcrumb{k}").alias("breadcrumb"), F.lit(k).alias("source")))
    links = F.array_distinct(F.transform(F.concat("discovered0", "discovered1"), lambda x: canonical_url(x)))
    d = d.select("page_id", "url", "blocks", F.concat("_mapped", "opengraph").alias("rows"), F.coalesce(trail(0), trail(1)).alias("trail"), links.alias("links"))
    d = _merged(d)
    d = d.withColumn("products", finish_products(F.col("merged"), F.col("rows"), F.col("trail")))
    d = d.withColumn("discovered", F.filter("links", lambda u: u.isNotNull() & ~F.exists("products", lambda p: p["source_url"].eqNullSafe(u))))
    issue = lambda severity, code: F.struct(severity.alias("severity"), code.alias("code"))
    bad = F.transform(F.filter("blocks", lambda b: b["status"] != "ok"), lambda b: issue(F.when(b["status"] == "repaired", "info").otherwise("warning"), F.concat(F.lit("json-ld-"), b["status"])))
    nameless = F.transform(F.filter("merged", lambda p: p["name"].isNull()), lambda p: issue(F.lit("warning"), F.lit("product-name-missing")))
    nothing = F.filter(F.array(issue(F.lit("info"), F.lit("no-structured-data"))), lambda _: (F.size("products") == 0) & (F.size("discovered") == 0))
    return d.select("page_id", "url", "products", "discovered", F.concat(bad, nameless, nothing).alias("issues"))


def page_products(extracted: DataFrame) -> DataFrame:
    """One row for each product and variation of extract_pages."""
    return extracted.select("page_id", F.explode("products").alias("p")).select("page_id", "p.*")


def extract_structured(pages: DataFrame, *, default_currency: str | None = None, default_unit: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, discovered, issues) of pages (page_id, url, html); what extract_pages found is written once, since three tables
    are made of it."""
    d = settled(extract_pages(pages, default_currency=default_currency, default_unit=default_unit))
    issues = d.select("page_id", F.explode("issues").alias("i")).select("page_id", "i.*")
    return page_products(d), d.select("page_id", F.explode("discovered").alias("link")), issues


def declared_count_issues(read: DataFrame, fetched: DataFrame) -> DataFrame:
    """(page_id, declared, fetched, code) where the first positive numberOfItems of a page's markup isn't the number of rows fetched for it."""
    d = parse_blocks(read).withColumn("_docs", _docs(0)).withColumns({"_index": G.id_index(F.col("_docs")), "_flat": G.flatten_graph(F.col("_docs"))})
    d = d.select("page_id", G.first_of(F.transform(with_subjects(F.col("_flat"), F.col("_index")), lambda n: F.when(G.as_number(G.get(n, "numberOfItems")) > 0, G.as_number(G.get(n, "numberOfItems"))))).alias("declared"))
    n = fetched.groupBy("page_id").agg(F.count(F.lit(1)).alias("fetched"))
    d = d.where("declared is not null").join(n, "page_id", "left").withColumns({"declared": F.col("declared").cast("long"), "fetched": F.coalesce("fetched", F.lit(0).cast("long"))})
    return d.where("declared <> fetched").withColumn("code", F.lit("shopify-count-mismatch"))
