"""What is asked of a model about products that pages left incomplete: trimmed fragments of pages, and requests over them.

Nothing is sent from here: requests are rows for any batch run, and its answers come back through `verify_answers` and `fill_empty`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from souklens.functions.selectors import Matcher
from souklens.operators.reports import missing_tier1
from souklens.sources.markup import PageTree

# Elements that are left out, parts of classes and ids that mark other products or furniture, attributes that stay,
# where a product's own content begins and where its trail stands (best first).
LEFT_OUT = frozenset("script style noscript svg canvas iframe template link nav header footer aside video audio source".split())
FURNITURE = (
    "related", "upsell", "cross-sell", "crosssell", "you-may-also", "also-like", "also-bought", "recently-viewed", "recently_viewed", "recent-view",
    "similar-product", "comment", "review-list", "newsletter", "cookie", "site-header", "site-footer", "menu-main", "mega-menu",
)
KEPT_ATTRIBUTES = frozenset("class id itemprop itemtype itemscope href src alt title content datetime value lang dir".split())
KEPT_DATA = re.compile("data-(?:price|regular|sale|product|sku|stock|qty|quantity|value|src|image|currency|attribute|variation|id)", re.I)
ROOTS = (
    '[itemscope][itemtype*="schema.org/Product" i]', '[itemscope][itemtype*="Product" i]', ".product-single", ".single-product", "#product", ".product-detail",
    ".product-details", ".product-page", "main", '[role="main"]', "article", "#content", ".content",
)
TRAILS = ('[itemtype*="BreadcrumbList" i]', 'nav[class*="breadcrumb" i]', 'nav[aria-label*="breadcrumb" i]', '[class*="breadcrumb" i]', '[id*="breadcrumb" i]')
MAX_CHARS, MAX_ELEMENTS, MAX_CLASSES = 24_000, 1_500, 8

FRAGMENT = "page_id long, source_url string, html string, root string, truncated boolean, source_chars long"
_SPACE = "[\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_SPACES, _GAPS = re.compile(f"{_SPACE}+"), re.compile(f"{_SPACE}{{2,}}")
_BLANK = "\t\n\v\f\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def _stays(tag: str, attrs: dict[str, str]) -> bool:
    if tag in LEFT_OUT:
        marks = " ".join(attrs.get(k, "") for k in ("class", "id", "aria-label", "itemtype", "typeof")).lower()
        if tag != "nav" or "breadcrumb" not in marks:
            return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return not any(mark in names for mark in FURNITURE)


def _opening(tag: str, attrs: dict[str, str]) -> str:
    out = [tag]
    for name, value in attrs.items():
        if name in KEPT_ATTRIBUTES or KEPT_DATA.match(name):
            if name == "class":
                value = " ".join(_SPACES.split(value)[:MAX_CLASSES])
            out.append('{}="{}"'.format(name, value.replace('"', "&quot;")) if value else name)
    return f"<{' '.join(out)}>"


class _Writer:
    """Subtrees of a page as text, in page order, within what is left of elements and characters. Elements are numbers and an
    element's text is a slice of the page's, so a subtree is one walk over both, however deep it is."""

    def __init__(self, tree: PageTree, elements: int, chars: int) -> None:
        self.tree, self.elements, self.chars, self.out = tree, elements, chars, []

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.chars -= len(text)

    def _texts(self, begin: int, end: int) -> None:
        for _, data in self.tree.stream[begin:end]:
            if self.chars <= 0:
                return
            if data.strip(_BLANK):
                self._put(_SPACES.sub(" ", data)[: self.chars])

    def write(self, root: int) -> None:
        tree, opened, n, at = self.tree, [], root, self.tree.span[root][0]
        stop = tree.end[root]
        while n < stop and self.elements > 0 and self.chars > 0:
            at = self._close(opened, n, at)
            self._texts(at, tree.span[n][0])
            tag, attrs = tree.nodes[n][3:5]
            if self.chars <= 0:
                break
            if _stays(tag, attrs):
                self.elements -= 1
                self._put(_opening(tag, attrs))
                opened.append(n)
                at, n = tree.span[n][0], n + 1
            else:
                at, n = tree.span[n][1], tree.end[n]
        while n < stop and self.chars > 0:  # no elements are left, but texts of the open ones
            at = self._close(opened, n, at)
            self._texts(at, tree.span[n][0])
            at, n = tree.span[n][1], tree.end[n]
        self._close(opened, stop, at)

    def _close(self, opened: list[int], n: int, at: int) -> int:
        """Ends the open elements that end before n; the place in the page's text behind them."""
        while opened and self.tree.end[opened[-1]] <= n:
            k = opened.pop()
            self._texts(at, self.tree.span[k][1])
            self._put(f"</{self.tree.nodes[k][3]}>")
            at = self.tree.span[k][1]
        return at


def trim_page(html: str, max_chars: int = MAX_CHARS, max_elements: int = MAX_ELEMENTS) -> tuple[str, str, bool]:
    """(fragment, root, truncated) of one page; root: the selector that chose it, body, or none."""
    matcher = Matcher(PageTree(html))
    first = lambda selectors: next(((found[0], s) for s in selectors if (found := matcher.find(s))), None)
    root, trail = first((*ROOTS, "body")), first(TRAILS)
    if root is None:
        return "", "none", False
    writer = _Writer(matcher.tree, max_elements, max_chars)
    if trail and not root[0] <= trail[0] < matcher.tree.end[root[0]]:
        writer.write(trail[0])
    writer.write(root[0])
    return _GAPS.sub(" ", "".join(writer.out)).strip(_BLANK), root[1], writer.chars <= 0 or writer.elements <= 0


def trim_fragments(pages: DataFrame, *, max_chars: int = MAX_CHARS, max_elements: int = MAX_ELEMENTS) -> DataFrame:
    """(page_id, source_url, html, root, truncated, source_chars) of pages (page_id, url, html), a row each: the subtree of the product,
    its trail before it if it stands elsewhere, without scripts, menus, other products and attributes that say nothing.

    Both budgets are the feature: what they cut is said by truncated. Open elements are ended, so a fragment can be a little
    longer than max_chars. A null page, and one without a body, has an empty fragment of root none. No exchange; ids of pages may
    repeat or be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = [(p["page_id"], p["url"], *trim_page(p["html"] or "", max_chars, max_elements), len(p["html"] or "")) for p in batch.slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in FRAGMENT.split(", ")])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, FRAGMENT)


def _text(about: str | None = None) -> dict:
    return {"type": "string"} | ({"description": about} if about else {})


def _list(items: dict, about: str | None = None) -> dict:
    return {"type": "array", "items": items} | ({"description": about} if about else {})


def _object(about: str | None, properties: dict) -> dict:
    return {"type": "object"} | ({"description": about} if about else {}) | {"properties": properties, "required": list(properties), "additionalProperties": False}


def _money(about: str) -> dict:
    unit = {"type": ["string", "null"], "enum": ["toman", "rial"], "description": "For IRR only: the unit that the page names; null if it names none. They differ by ten: never guess."}
    return _object(about, {"amount": {"type": "number", "description": "The printed amount without grouping."}, "currency": _text("ISO 4217, IRR for toman and rial."), "unit": unit})


# What may be asked of a page, by column.
PROPERTIES = {
    "name": _text("The product's title as printed."),
    "sku": _text("The product's code, if the page prints one."),
    "description": _text("The main description as plain text."),
    "short_description": _text("The summary, if there is one of its own."),
    "regular": _money("The price as printed, never converted, rounded or computed."),
    "sale": _money("The lower price, only where the page shows a higher one beside it."),
    "category_path": _list(_text(), "The trail of categories from the outermost in, without the front page and the product itself."),
    "images": _list(_text(), "Addresses of this product's images as they stand in the markup; no logos, icons or other products."),
    "attributes": _list(_object(None, {"name": _text("The label as printed."), "values": _list(_text(), "Every option that is offered, as printed.")})),
    "tags": _list(_text()),
    "in_stock": {"type": "boolean", "description": "Whether the page says that the product can be bought now."},
    "stock_quantity": {"type": "integer", "description": "Only where the page prints an exact number."},
    "brand": _text(),
    "gtin": _text("The number of the bar code: EAN, UPC or ISBN."),
}
# Fields that ask for more than one property.
ASKS = {"in_stock": ("in_stock", "stock_quantity")}

RULES = (
    "The text below is part of one product's page in a shop. Report what it says.",
    "",
    "1. Only what stands there: where nothing does, the answer is null.",
    "2. As printed: nothing is computed, converted, rounded or guessed.",
    "3. Only the product of this page; others that it mentions don't count.",
    "4. In the page's own language and script: nothing is translated.",
    "",
)


def _with_nullable(schema: dict) -> dict:
    """A schema in the dialect that has `nullable` in place of unions with null, and no additionalProperties."""
    out = {k: v for k, v in schema.items() if k != "additionalProperties"}
    if isinstance(out.get("type"), list):
        out |= {"type": next((t for t in out["type"] if t != "null"), "string"), "nullable": True}
    if "properties" in out:
        out["properties"] = {k: _with_nullable(v) for k, v in out["properties"].items()}
    if "items" in out:
        out["items"] = _with_nullable(out["items"])
    return out


def _property_texts(dialect: str) -> dict[str, str]:
    """The text of each property's schema; all of them may be null."""
    out = {k: v | {"type": [v["type"], "null"]} for k, v in PROPERTIES.items()}
    return {k: json.dumps(v if dialect == "union" else _with_nullable(v), ensure_ascii=False, separators=(",", ":")) for k, v in out.items()}


def enrichment_requests(products: DataFrame, fragments: DataFrame, *, wanted: list[str], on: str = "page_id", seq: str = "seq", per_page: int = 1, locale: str | None = None, dialect: str = "union") -> tuple[DataFrame, DataFrame]:
    """(requests, issues) for products (on, seq, source_url, kind and their fields) that lack a wanted field of the first tier.

    requests: (request_id, on, seq, source_url, fields, schema, prompt, fragment). The schema has the missing fields only, each
    required and nullable; dialect: `union` with null, or `nullable`. Variations never ask. Of each page the first per_page products
    by seq, then by address, ask: a limit of cost, and the rest is told as request-limit with its number. A page without a fragment
    asks nothing and is told as no-fragment; rows without a page are one such page. locale: a column of products. Fragments that share
    a page: the first by address, then by text. The rank is limited before the exchange, and whole rows of products that are left out never travel."""
    if dialect not in ("union", "nullable"):
        raise ValueError(f"no dialect: {dialect}")
    need = missing_tier1(products, wanted).where("needs_more")
    told = F.col(locale).cast("string") if locale else F.lit(None).cast("string")
    need = need.select(F.col(on).alias("_on"), F.col(seq).alias("_seq"), F.col("source_url").alias("_url"), F.col("missing").alias("_missing"), told.alias("_locale"))
    first = need.where("_on is not null").withColumn("_rank", F.row_number().over(W.partitionBy("_on").orderBy("_seq", "_url"))).where(F.col("_rank") <= per_page)
    has = fragments.where(F.col(on).isNotNull() & (F.col("html") != "")).groupBy(F.col(on).alias("_on")).agg(F.min(F.struct("source_url", "html")).alias("_f"))
    d = first.join(has, "_on")
    asks = F.flatten(F.transform("_missing", lambda f: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in ASKS.items() for x in (k, list(v))]), f), F.array(f))))
    texts = F.create_map(*[F.lit(x) for pair in _property_texts(dialect).items() for x in pair])
    asked = F.filter(asks, lambda p: F.map_contains_key(texts, p))
    quoted = lambda p: F.concat(F.lit('"'), p, F.lit('"'))
    schema = F.concat(
        F.lit('{"type":"object","properties":{'), F.array_join(F.transform(asked, lambda p: F.concat(quoted(p), F.lit(":"), texts[p])), ","),
        F.lit('},"required":['), F.array_join(F.transform(asked, quoted), ","), F.lit("]}" if dialect == "nullable" else '],"additionalProperties":false}'),
    )
    spoken = F.when(F.trim("_locale") != "", F.concat(F.lit("\nThe page says that its language is "), F.col("_locale"), F.lit(".")))
    prompt = F.concat(F.lit("\n".join(RULES) + "\nFields wanted: "), F.array_join("_missing", ", "), F.lit("."), F.coalesce(spoken, F.lit("")))
    requests = d.select(
        F.concat_ws("#", F.col("_on").cast("string"), F.col("_rank").cast("string")).alias("request_id"), F.col("_on").alias(on), F.col("_seq").alias(seq), F.col("_url").alias("source_url"), F.col("_missing").alias("fields"),
        schema.alias("schema"), prompt.alias("prompt"), F.col("_f.html").alias("fragment"),
    )
    counts = need.groupBy("_on").agg(F.count(F.lit(1)).alias("_n")).join(has.select("_on", F.lit(True).alias("_has")), "_on", "left")
    code = F.when(F.col("_has").isNull(), "no-fragment").when(F.col("_n") > per_page, "request-limit")
    left = F.when(F.col("_has").isNull(), F.col("_n")).otherwise(F.col("_n") - per_page)
    message = F.when(F.col("_has").isNull(), "No content of a product could be found on this page, and whole pages are never sent.").otherwise(
        F.concat(left.cast("string"), F.lit(f" products ask nothing: a page asks for {per_page} at most.")))
    issues = counts.where(code.isNotNull()).select(F.col("_on").alias(on), F.lit("info").alias("severity"), code.alias("code"), left.alias("n_products"), message.alias("message"))
    return requests, issues
