"""Pages to element rows, and element rows to product claims."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.functions import graph as G
from souklens.functions.numbers import availability, parse_number
from souklens.functions.text import canonical_url, clean_text, fold_for_compare, let, normalize_type

NODE = "page_id long, node_id int, parent_id int, depth int, tag string, attrs map<string,string>, text string, scope_id int"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AUTO = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
# Tags as they are mostly written: small letters, values in double quotes without references. What the general parser makes of them
# is known beforehand. Not of elements whose content isn't markup.
PLAIN_TAG = re.compile(r'<(?!(?:script|style|title|textarea|iframe|noembed|noframes|noscript|plaintext|xmp)[ >])([a-z][a-z0-9]*)((?: [a-z][a-z0-9:_-]*(?:="[^"&]*")?)*)>')
PLAIN_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9:_-]*)(?:="([^"]*)")?')
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
# Confidence of a value by where it was stated.
CONFIDENCE = {"api": 1.0, "json-ld": 0.95, "json-ld-derived": 0.8, "microdata": 0.7, "microdata-derived": 0.6, "opengraph": 0.5, "profile": 0.4, "weak": 0.35, "answer": 0.3}


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.stream: list[tuple[int, str]] = []
        self.span: list[list[int]] = []  # of each element, where its text begins and ends in the stream

    def _shut(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for n in self.open[k:]:
            self.span[n][1] = len(self.stream)
        del self.open[k:]

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)  # what isn't markup here is a comment, whatever it says

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines

    def parse_starttag(self, i: int) -> int:
        m = PLAIN_TAG.match(self.rawdata, i)
        if m is None:
            return super().parse_starttag(i)
        self.handle_starttag(m[1], PLAIN_ATTRIBUTE.findall(m[2]) if m[2] else [])
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and self.nodes[self.open[-1]][3] in AUTO.get(tag, ()):
            self._shut(len(self.open) - 1)
        kept: dict[str, str] = {}
        for k, v in attrs:
            kept.setdefault(k, v or "")
        self.nodes.append([len(self.nodes), self.open[-1] if self.open else None, len(self.open), tag, kept, []])
        self.span.append([len(self.stream)] * 2)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self._shut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        k = next((i for i in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[i]][3] == tag), None)
        if k is not None:
            self._shut(k)

    def close(self) -> None:
        super().close()
        self._shut(0)

    def handle_data(self, data: str) -> None:
        if self.open:
            self.nodes[self.open[-1]][5].append(data)
            self.stream.append((self.open[-1], data))


class PageTree(_Tree):
    """A page's elements in page order: (id, parent, depth, tag, attributes, own texts), their children, the first element of each
    id, and the whole text below an element."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.feed(html)
        self.close()
        self.children: list[list[int]] = [[] for _ in self.nodes]
        self.ids: dict[str, int] = {}
        self.end = list(range(1, len(self.nodes) + 1))
        for n, parent, *_, attrs, _ in self.nodes:
            if parent is not None:
                self.children[parent].append(n)
            if attrs.get("id"):
                self.ids.setdefault(attrs["id"], n)
        for n in range(len(self.nodes) - 1, -1, -1):
            if self.children[n]:
                self.end[n] = self.end[self.children[n][-1]]

    def text_of(self, n: int, shown: bool = False) -> str:
        """The whole text below an element; shown: without scripts and styles."""
        begin, end = self.span[n]
        return "".join(data for at, data in self.stream[begin:end] if not shown or self.nodes[at][3] not in ("script", "style"))


def dom_nodes(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per element: its own text, its parent, its depth; node_id counts in page order; scope_id: the nearest element
    above it with itemscope. Scripts stay, comments go.

    The only parse of a page; everything after it is relational. A null page has no elements.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b, rows = batch.slice(at, 256), []
                for i, page in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                    tree = _Tree()
                    tree.feed(page or "")
                    tree.close()
                    scope: list[int | None] = []
                    for n, p, d, t, a, x in tree.nodes:
                        scope.append(None if p is None else p if "itemscope" in tree.nodes[p][4] else scope[p])
                        rows.append((i, n, p, d, t, list(a.items()), "".join(x), scope[n]))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32()]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in NODE.split(", ")])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html")).mapInArrow(run, NODE)


def jsonld_blocks(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, doc): JSON-LD scripts that parse, as they are or without trailing commas; status says which, or invalid."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(F.col("attrs")["type"], F.lit("")), ";", 1)))
    raw = F.trim(F.regexp_replace(F.col("text"), r"^\s*(?:<!--|//<!\[CDATA\[|<!\[CDATA\[)|(?:-->|//\]\]>|\]\]>)\s*$", ""))
    fixed = F.regexp_replace(raw, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")
    d = nodes.where((F.col("tag") == "script") & kind.isin("application/ld+json", "application/json+ld")).withColumn("_raw", raw).where("_raw <> ''")
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return d.select("page_id", "node_id", F.when(ok(F.col("_raw")), F.col("_raw")).when(ok(fixed), fixed).alias("doc"), F.when(ok(F.col("_raw")), "ok").when(ok(fixed), "repaired").otherwise("invalid").alias("status"))


def jsonld_products(blocks: DataFrame) -> DataFrame:
    """(page_id, node_id, pos, product): product nodes of single blocks, @graph and lists opened, references within the block followed;
    product: name, sku, url, description, brand (name) and offers, those within an offer in its stead. `structured.py` reads
    whole pages and every field."""
    d = blocks.where("doc is not null").withColumn("_docs", F.array(F.try_parse_json("doc")))
    named = F.contains(F.col("doc"), F.lit('"@id"'))  # without names there is nothing to look up
    d = d.select("page_id", "node_id", F.when(named, G.id_index(F.col("_docs"))).alias("_index"), F.posexplode_outer(F.filter(G.flatten_graph(F.col("_docs")), G.is_product_node)).alias("pos", "_node"))
    d = d.where("pos is not null")  # outer: else a filter opens the graph once more
    node, index = F.col("_node"), F.col("_index")
    text = lambda o, k: G.as_text(G.get(o, k)).alias(k)
    offer = lambda o: F.struct(*[text(o, k) for k in ("price", "priceCurrency", "availability", "lowPrice", "highPrice", "sku", "priceType")])
    brand = F.struct(G.read_name(G.resolve(G.get(node, "brand"), index)).alias("name")).alias("brand")
    offers = F.transform(G.nested_offers(G.get(node, "offers"), index), offer).alias("offers")
    return d.select("page_id", "node_id", "pos", F.struct(*[text(node, k) for k in ("name", "sku", "url", "description")], brand, offers).alias("product"))


def offers_of(products: DataFrame) -> DataFrame:
    """Per product node: the cheapest offer's price and currency, the range, and whether any offer is in stock."""
    price = lambda o: parse_number(F.coalesce(o["price"], o["lowPrice"]))["value"]
    offers = F.transform(F.col("product.offers"), lambda o, i: let(price(o), lambda p: F.struct(p.alias("amount"), i.alias("i"), o["priceCurrency"].alias("currency"), F.coalesce(parse_number(o["highPrice"])["value"], p).alias("high"), availability(o["availability"]).alias("in_stock"))))
    d = products.withColumn("_o", F.filter(offers, lambda o: o["amount"].isNotNull()))
    best = F.array_min("_o")
    return d.withColumns({"price": best["amount"], "currency": best["currency"], "high_price": F.array_max(F.col("_o.high")), "n_offers": F.size("_o"), "in_stock": F.when(F.exists("_o.in_stock", lambda x: x), True).when(F.exists("_o.in_stock", lambda x: ~x), False)}).drop("_o")


def claims_of(rows: DataFrame, key: Column, fields: dict[str, Column], source: str, seq: Column) -> DataFrame:
    """Wide rows to claims (product_key, field, value, confidence, source, seq); blank values claim nothing."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()])
    d = rows.select(key.alias("product_key"), seq.cast("long").alias("seq"), F.explode(pairs).alias("c"))
    return d.where("trim(c.value) <> ''").select("product_key", "c.field", "c.value", F.lit(CONFIDENCE[source]).alias("confidence"), F.lit(source).alias("source"), "seq")


def microdata_properties(nodes: DataFrame) -> DataFrame:
    """(page_id, item_id, type, prop, value): each property belongs to its nearest element with itemscope, however far up it is."""
    a = F.col("attrs")
    item = nodes.where(F.map_contains_key("attrs", F.lit("itemscope"))).select("page_id", F.col("node_id").alias("item_id"), a["itemtype"].alias("type"))
    value = F.coalesce(a["content"], F.when(F.col("tag").isin("img", "source", "video", "audio"), F.coalesce(a["src"], a["data-src"], a["data-lazy-src"])), F.when(F.col("tag").isin("a", "link", "area"), a["href"]), F.when(F.col("tag") == "time", a["datetime"]), F.when(F.col("tag").isin("data", "meter"), a["value"]), clean_text(F.col("text")))
    props = nodes.where(F.map_contains_key("attrs", F.lit("itemprop")) & F.col("scope_id").isNotNull()).select("page_id", F.col("scope_id").alias("item_id"), "node_id", F.explode(F.split(a["itemprop"], r"\s+")).alias("prop"), value.alias("value"))
    return props.join(item, ["page_id", "item_id"]).select("page_id", "item_id", "node_id", "prop", "value", "type")


def meta_tags(nodes: DataFrame) -> DataFrame:
    """(page_id, key, values): meta elements by property, else name, lower case, in page order."""
    key = F.lower(F.coalesce(F.col("attrs")["property"], F.col("attrs")["name"]))
    d = nodes.where("tag = 'meta'").select("page_id", key.alias("key"), F.struct("node_id", F.col("attrs")["content"].alias("v")).alias("s")).where("key is not null and s.v is not null")
    return d.groupBy("page_id", "key").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["v"]).alias("values"))


def opengraph_products(nodes: DataFrame) -> DataFrame:
    """One row per page that says it is a product or states a price: name, url, image, price, currency, in_stock, brand."""
    first = lambda *keys: F.coalesce(*[F.max(F.when(F.col("key") == k, F.col("values")[0])) for k in keys])
    d = meta_tags(nodes).groupBy("page_id").agg(
        first("og:type").alias("og_type"), first("og:title").alias("name"), first("og:url").alias("url"), first("og:image:secure_url", "og:image").alias("image"),
        first("product:sale_price:amount", "product:price:amount", "og:price:amount").alias("price_text"), first("product:price:currency", "og:price:currency").alias("currency"),
        first("product:availability", "og:availability").alias("availability"), first("product:brand", "og:brand").alias("brand"), first("og:description").alias("description"),
    )
    d = d.where(F.lower("og_type").contains("product") | F.col("price_text").isNotNull())
    return d.select("page_id", "name", canonical_url(F.col("url")).alias("url"), "image", parse_number(F.col("price_text"))["value"].alias("price"), "currency", availability(F.col("availability")).alias("in_stock"), "brand", "description")


def page_links(nodes: DataFrame) -> DataFrame:
    """(page_id, href, rel, text) of links in page order."""
    a = F.col("attrs")
    return nodes.where(F.col("tag").isin("a", "link") & a["href"].isNotNull()).select("page_id", "node_id", a["href"].alias("href"), a["rel"].alias("rel"), clean_text(F.col("text")).alias("text"))


# Names of a shop's front page in breadcrumbs.
HOME_NAMES = ("home", "homepage", "index", "main", "خانه", "صفحه اصلی", "صفحه نخست", "accueil", "inicio", "startseite", "главная")


def is_home_crumb(name: Column, url: Column) -> Column:
    return fold_for_compare(name).isin(*HOME_NAMES) | F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/?(?:[?#]|$)"), F.lit(False))


def without_home(crumbs: Column) -> Column:
    """The names of crumbs (structs of name and url, in order) behind all leading ones of the front page."""
    state = F.reduce(
        crumbs,
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("path")),
        lambda at, x: F.struct((at["inside"] | ~is_home_crumb(x["name"], x["url"])).alias("inside"), F.when(at["inside"] | ~is_home_crumb(x["name"], x["url"]), F.array_append(at["path"], x["name"])).otherwise(at["path"]).alias("path")),
    )
    return state["path"]


def breadcrumb_paths(items: DataFrame) -> DataFrame:
    """(page_id, category_path) of crumbs (page_id, list_id, position, name, url): leading front pages left out, the longest list
    of a page, the first of equals."""
    d = items.groupBy("page_id", "list_id").agg(F.array_sort(F.collect_list(F.struct("position", "name", "url"))).alias("c"))
    return d.select("page_id", "list_id", without_home(F.col("c")).alias("p")).groupBy("page_id").agg(F.max_by("p", F.struct(F.size("p"), -F.col("list_id"))).alias("category_path"))


def item_list_order(items: DataFrame) -> DataFrame:
    """Entries of lists in stated order: by position, else by place; stable."""
    return items.withColumn("rank", F.row_number().over(W.partitionBy("page_id", "list_id").orderBy(F.coalesce("position", F.col("pos") + 1), "pos")))
