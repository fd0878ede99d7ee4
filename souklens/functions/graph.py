"""Columns over schema.org nodes: variants read one-or-many, references by @id, and the fields of a product node."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import availability, parse_number, read_measure
from .text import clean_text, fold_for_compare, let, normalize_type, resolve_url

# Types of product nodes, properties by which variants differ, and kinds of prices.
PRODUCT_TYPES = ("product", "productgroup", "productmodel", "individualproduct", "book", "vehicle", "car")
IMPLICIT_AXES = ("color", "size", "material", "pattern", "flavor")
GTIN_KEYS = ("gtin13", "gtin12", "gtin14", "gtin8", "gtin", "isbn")
LIST_PRICE_TYPES = ("listprice", "msrp", "strikethroughprice", "regularprice", "suggestedretailprice", "recommendedretailprice")
SALE_PRICE_TYPES = ("saleprice", "discountedprice", "promotionalprice")
#: Objects within objects are followed so deep.
DEPTH = 12


def get(v: Column, key: str) -> Column:
    """A member of an object; null if there is none, or if it is JSON's null."""
    return let(F.try_variant_get(v, f"$['{key}']", "variant"), lambda x: F.when(~F.is_variant_null(x), x))


def members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()  # its schema would be that of all within it


def is_text(v: Column) -> Column:
    return F.coalesce(scalar_kind(v) == "STRING", F.lit(False))


def scalar_kind(v: Column) -> Column:
    """The type of a value that holds no others; null for objects and lists, whose schema would be that of all within."""
    return F.when(~is_object(v) & F.try_variant_get(v, "$[0]", "variant").isNull(), F.schema_of_variant(v))


def _nothing() -> Column:
    return F.filter(F.array(F.parse_json(F.lit("0"))), lambda x: F.lit(False))


def as_array(v: Column) -> Column:
    """A list without its nulls; anything else as a list of one; nothing as an empty list."""
    some = lambda x: x.isNotNull() & ~F.is_variant_null(x)
    return let(v, lambda x: F.coalesce(F.filter(F.try_variant_get(x, "$", "array<variant>"), some), F.when(some(x), F.array(x)), _nothing()))


def as_objects(v: Column) -> Column:
    return F.filter(as_array(v), is_object)


def as_text(v: Column) -> Column:
    """A clean text, or a number as text; null for anything else and for blanks."""

    def text(x: Column) -> Column:
        kind, raw = scalar_kind(x), F.try_variant_get(x, "$", "string")
        number = F.regexp_replace(F.regexp_replace(raw, r"^(-?\d+\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(kind == "STRING", clean_text(raw)).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), number)

    return let(let(v, text), lambda t: F.when(t != "", t))


def as_number(v: Column) -> Column:
    read = lambda x: F.when(is_text(x), parse_number(F.try_variant_get(x, "$", "string"))["value"]).when(F.schema_of_variant(x) != "BOOLEAN", F.try_variant_get(x, "$", "double"))
    return let(v, read)


def as_boolean(v: Column) -> Column:
    kind, word = F.schema_of_variant(v), F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    told = F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False)
    return F.when(kind == "STRING", told).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).otherwise(F.try_variant_get(v, "$", "double") != 0)


def first_of(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))


def read_name(v: Column) -> Column:
    """The first text among texts, or names of objects."""
    return first_of(F.transform(as_array(v), name_or_text))


def name_or_text(x: Column) -> Column:
    return F.when(is_object(x), F.coalesce(as_text(get(x, "name")), as_text(get(x, "alternateName")))).otherwise(as_text(x))


def absolute(v: Column, page_url: Column) -> Column:
    return resolve_url(as_text(v), page_url, only_http=True)


def node_url(v: Column, page_url: Column) -> Column:
    """The address of a node, as it states it: url, @id, contentUrl, the first that is http(s)."""
    return first_of(F.transform(F.array(as_text(get(v, "url")), as_text(get(v, "@id")), as_text(get(v, "contentUrl"))), lambda x: resolve_url(x, page_url, only_http=True)))


def read_images(v: Column, page_url: Column) -> Column:
    one = lambda x: F.when(is_object(x), node_url(x, page_url)).otherwise(absolute(x, page_url))
    return F.array_distinct(F.array_compact(F.transform(as_array(v), one)))


def read_gtin(node: Column) -> Column:
    """The first of the GTIN properties with 6 to 20 digits or hyphens, without hyphens."""
    stated = F.array(*[as_text(get(node, k)) for k in GTIN_KEYS])
    return F.replace(F.try_element_at(F.filter(stated, lambda t: t.rlike(r"^[\d-]{6,20}$")), F.lit(1)), F.lit("-"), F.lit(""))


def read_category_path(v: Column) -> Column:
    """The deepest path among several, the first of equals; > stands between names."""
    paths = F.transform(F.transform(as_array(v), lambda x: name_or_text(x)), lambda t: F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), ">"), lambda p: clean_text(p)), lambda p: p != ""))
    return F.reduce(paths, F.array().cast("array<string>"), lambda best, p: F.when(F.size(p) > F.size(best), p).otherwise(best))


def read_keywords(v: Column) -> Column:
    texts = F.array_compact(F.transform(as_array(v), lambda x: name_or_text(x)))
    return F.array_distinct(F.filter(F.flatten(F.transform(texts, lambda t: F.transform(F.split(t, ","), lambda p: clean_text(p)))), lambda p: p != ""))


def read_quantity(v: Column, units: dict[str, float]) -> Column:
    """struct(value, unit) of the first entry with a number; null without a unit of this kind. A lone separator is decimal."""
    raw = lambda x: F.when(is_object(x), F.coalesce(get(x, "value"), get(x, "minValue"))).otherwise(x)
    read = lambda x: F.struct(F.try_variant_get(raw(x), "$", "string").alias("text"), as_text(get(x, "unitCode")).alias("code"), as_text(get(x, "unitText")).alias("unit"))
    amount = lambda t: parse_number(t["text"], "decimal")["value"]
    first = F.try_element_at(F.filter(F.transform(as_array(v), read), lambda t: amount(t).isNotNull()), F.lit(1))
    return let(let(first, lambda t: read_measure(t["text"], t["code"], t["unit"])), lambda m: F.when(m["unit"].isin(*units), m))


def read_properties(v: Column) -> Column:
    """array of (name, values) of a specification table: names that fold alike are one, values distinct in order."""
    named = lambda x: F.coalesce(as_text(get(x, "name")), as_text(get(x, "propertyID")))
    values = lambda x: F.array_compact(F.transform(as_array(get(x, "value")), lambda y: name_or_text(y)))
    rows = F.transform(as_objects(v), lambda x: F.struct(named(x).alias("name"), values(x).alias("values")))
    rows = F.filter(F.transform(rows, lambda r: F.struct(fold_for_compare(r["name"]).alias("key"), r["name"].alias("name"), r["values"].alias("values"))), lambda r: r["name"].isNotNull() & (F.size(r["values"]) > 0))
    one = lambda same: F.struct(same[0]["name"].alias("name"), F.array_distinct(F.flatten(F.transform(same, lambda r: r["values"]))).alias("values"), F.lit(False).alias("is_variation_axis"))
    return let(rows, lambda every: F.transform(F.array_distinct(F.transform(every, lambda r: r["key"])), lambda k: let(F.filter(every, lambda r: r["key"] == k), one)))


def types_of(node: Column) -> Column:
    return F.filter(F.transform(as_array(get(node, "@type")), lambda x: F.when(is_text(x), normalize_type(F.try_variant_get(x, "$", "string"))).otherwise("")), lambda t: t != "")


def is_type(node: Column, *names: str) -> Column:
    return F.arrays_overlap(types_of(node), F.array(*map(F.lit, names)))


def is_product_node(node: Column) -> Column:
    return is_object(node) & is_type(node, *PRODUCT_TYPES)


def is_product_group(node: Column) -> Column:
    return is_type(node, "productgroup") | F.coalesce(F.map_contains_key(members(node), F.lit("hasVariant")), F.lit(False))


def flatten_graph(docs: Column) -> Column:
    """The objects of documents: lists and @graph containers opened, to a depth of 12; a container with members of its own stays
    behind its graph."""
    own = lambda x: F.exists(F.map_keys(members(x)), lambda k: ~k.isin("@graph", "@context"))
    cell = lambda x, done: F.struct(x.alias("v"), done.alias("done"))
    inner = lambda x: F.transform(as_array(get(x, "@graph")), lambda y: cell(y, F.lit(False)))
    listed = lambda x: F.try_variant_get(x, "$", "array<variant>")

    def opened(c: Column) -> Column:
        x = c["v"]
        return (
            F.when(c["done"], F.array(c))
            .when(listed(x).isNotNull(), F.transform(as_array(x), lambda y: cell(y, F.lit(False))))
            .when(is_object(x) & get(x, "@graph").isNotNull(), F.concat(inner(x), F.when(own(x), F.array(cell(x, F.lit(True)))).otherwise(F.slice(F.array(cell(x, F.lit(True))), 1, 0))))
            .otherwise(F.array(cell(x, F.lit(True))))
        )

    cells = F.reduce(F.sequence(F.lit(0), F.lit(DEPTH)), F.transform(docs, lambda x: cell(x, F.lit(False))), lambda at, _: F.flatten(F.transform(at, opened)))
    return F.filter(F.transform(cells, lambda c: c["v"]), is_object)


def id_index(docs: Column) -> Column:
    """array of (id, node): every object with an @id and more than that, at any depth up to 12, outer ones first."""
    named = lambda x: is_text(get(x, "@id")) & (F.size(F.map_keys(members(x))) > 1)
    entry = lambda x: F.struct(F.try_variant_get(x, "$['@id']", "string").alias("id"), x.alias("node"))
    below = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.map_values(members(x)), _nothing())
    start = F.struct(docs.alias("level"), F.slice(F.transform(docs, entry), 1, 0).alias("found"))
    step = lambda at, _: F.struct(F.flatten(F.transform(at["level"], below)).alias("level"), F.concat(at["found"], F.transform(F.filter(at["level"], lambda x: is_object(x) & named(x)), entry)).alias("found"))
    return F.reduce(F.sequence(F.lit(0), F.lit(DEPTH)), start, step)["found"]


def resolve(v: Column, index: Column) -> Column:
    """A text or a bare {"@id": ...} as the node of that name, if there is one; anything else as it is."""

    def found(x: Column) -> Column:
        bare = is_object(x) & (F.size(F.map_keys(members(x))) == 1)
        ref = F.when(is_text(x), F.try_variant_get(x, "$", "string")).when(bare, F.try_variant_get(x, "$['@id']", "string"))
        return F.coalesce(let(ref, lambda r: F.try_element_at(F.filter(index, lambda e: e["id"] == r), F.lit(1))["node"]), x)

    return let(v, found)


def resolve_all(v: Column, index: Column) -> Column:
    return F.transform(as_array(v), lambda x: resolve(x, index))


def ordered_elements(node: Column, index: Column) -> Column:
    """The entries of a list by their stated position, else by their place; stable."""
    place = lambda x, i: F.struct(F.coalesce(F.when(is_object(x), as_number(get(x, "position"))), (i + 1).cast("double")).alias("p"), i.alias("i"))
    return let(resolve_all(get(node, "itemListElement"), index), lambda every: F.transform(F.array_sort(F.transform(every, place)), lambda s: F.element_at(every, s["i"] + 1)))


def list_products(node: Column, index: Column) -> Column:
    """Product nodes that a list describes itself, in order."""
    entry = lambda x: F.when(is_product_node(x), x).when(is_object(x), resolve(get(x, "item"), index))
    return F.filter(F.transform(ordered_elements(node, index), entry), is_product_node)


def list_urls(node: Column, index: Column, page_url: Column) -> Column:
    """Addresses that a list names without describing them, in order, each once."""

    def entry(x: Column) -> Column:
        link = lambda item: F.when(is_object(item), F.when(~is_product_node(item), node_url(item, page_url))).when(is_text(item), absolute(item, page_url)).otherwise(absolute(get(x, "url"), page_url))
        return F.when(is_text(x), absolute(x, page_url)).when(is_object(x) & ~is_product_node(x), let(resolve(get(x, "item"), index), link))

    return F.array_distinct(F.array_compact(F.transform(ordered_elements(node, index), entry)))


def crumbs_of(node: Column, index: Column, page_url: Column) -> Column:
    """array of (name, url) of a breadcrumb list, in order; crumbs without a name are left out."""

    def crumb(x: Column) -> Column:
        def read(item: Column) -> Column:
            name = F.coalesce(as_text(get(x, "name")), F.when(is_object(item), name_or_text(item)))
            return F.struct(name.alias("name"), F.when(is_object(item), node_url(item, page_url)).otherwise(absolute(F.coalesce(item, get(x, "url")), page_url)).alias("url"))

        return let(resolve(get(x, "item"), index), read)

    return F.filter(F.transform(F.filter(ordered_elements(node, index), is_object), crumb), lambda c: c["name"].isNotNull())


def axis_names(group: Column, variants: Column) -> Column:
    """What variants differ by: as declared (variesBy), else the properties and specification names they state, in order."""
    declared = F.array_distinct(F.transform(F.array_compact(F.transform(as_array(get(group, "variesBy")), lambda x: name_or_text(x))), lambda t: normalize_type(t)))
    stated = lambda x: F.concat(F.filter(F.array(*map(F.lit, IMPLICIT_AXES)), lambda a: F.map_contains_key(members(x), a)), F.transform(read_properties(get(x, "additionalProperty")), lambda p: p["name"]))
    return let(declared, lambda d: F.when(F.size(d) > 0, d).otherwise(F.array_distinct(F.flatten(F.transform(variants, stated)))))


def axis_value(variant: Column, axis: Column, index: Column) -> Column:
    text = let(resolve(F.try_element_at(members(variant), axis), index), name_or_text)
    listed = F.filter(read_properties(get(variant, "additionalProperty")), lambda p: fold_for_compare(p["name"]) == fold_for_compare(axis))
    return F.coalesce(text, F.try_element_at(F.try_element_at(listed, F.lit(1))["values"], F.lit(1)))


def axis_label(axis: Column) -> Column:
    return F.when(axis.rlike("^[a-z][a-z0-9]*$"), F.concat(F.upper(F.substring(axis, 1, 1)), F.substring(axis, F.lit(2), F.length(axis)))).otherwise(axis)


def axis_options(values: Column) -> Column:
    """Parent attributes from array<array<(name, value)>>, the variants' values: distinct options in order of first sight."""
    names = lambda flat: F.array_distinct(F.transform(flat, lambda p: p["name"]))
    return let(F.flatten(values), lambda flat: F.transform(names(flat), lambda n: F.struct(n.alias("name"), F.array_distinct(F.transform(F.filter(flat, lambda p: p["name"] == n), lambda p: p["value"])).alias("values"), F.lit(True).alias("is_variation_axis"))))


def nested_offers(v: Column, index: Column) -> Column:
    """The offers of a node, those within an offer (to a depth of 3) in its stead."""
    within = lambda o: as_objects(get(o, "offers"))
    opened = lambda o: let(within(o), lambda inner: F.when(F.size(inner) > 0, inner).otherwise(F.array(o)))
    deep = lambda first: F.filter(F.reduce(F.sequence(F.lit(1), F.lit(3)), first, lambda at, _: F.flatten(F.transform(at, opened))), lambda o: F.size(within(o)) == 0)
    return let(F.filter(resolve_all(v, index), is_object), lambda first: F.when(F.exists(first, lambda o: get(o, "offers").isNotNull()), deep(first)).otherwise(first))


def offer_texts(o: Column) -> dict[str, Column]:
    """What an offer states: price texts and currencies (now, listed, highest), availability, stock and SKU."""
    kind = lambda s: normalize_type(as_text(get(s, "priceType")))
    specs = as_objects(get(o, "priceSpecification"))
    first = lambda ok: F.try_element_at(F.filter(specs, ok), F.lit(1))
    listed, sale = first(lambda s: kind(s).isin(*LIST_PRICE_TYPES)), first(lambda s: kind(s).isin(*SALE_PRICE_TYPES))
    now = F.coalesce(sale, first(lambda s: kind(s).isNull()))
    currency = as_text(get(o, "priceCurrency"))
    quantity = lambda x: F.when(is_object(x), as_number(get(x, "value"))).otherwise(as_number(x))
    stock = first_of(F.filter(F.transform(as_array(get(o, "inventoryLevel")), quantity), lambda n: n >= 0))
    return {
        "now_text": as_text(F.coalesce(get(o, "price"), get(now, "price"), get(o, "lowPrice"))),
        "now_currency": F.coalesce(currency, as_text(get(now, "priceCurrency"))),
        "list_text": as_text(get(listed, "price")),
        "list_currency": F.coalesce(as_text(get(listed, "priceCurrency")), currency),
        "high_text": as_text(get(o, "highPrice")),
        "offer_stock": availability(as_text(get(o, "availability"))),
        "quantity": F.when(stock.isNotNull(), F.floor(stock).cast("long")),
        "offer_sku": as_text(get(o, "sku")),
    }
