"""Store API answers in full: products, the variations that answers of their own hold, and what was found wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from souklens.functions.numbers import detect_currency
from souklens.functions.text import canonical_url, clean_text, let, profile_domain, resolve_url
from souklens.operators.resolve import category_paths
from souklens.plans.lineage import settled
from souklens.sources.markup import CONFIDENCE

_NAMED = "array<struct<name:string>>"
STORE_NODE = (
    "struct<id:string,parent:string,type:string,name:string,permalink:string,sku:string,description:string,short_description:string,on_sale:boolean,is_in_stock:boolean,"
    "prices:struct<currency_code:string,currency_minor_unit:string,currency_prefix:string,currency_suffix:string,regular_price:string,sale_price:string,price_range:struct<min_amount:string,max_amount:string>>,"
    f"images:array<struct<src:string>>,categories:array<struct<id:string,name:string>>,tags:{_NAMED},brands:{_NAMED},"
    "attributes:array<struct<name:string,has_variations:boolean,terms:array<struct<name:string,slug:string>>>>,variations:array<struct<id:string,attributes:array<struct<name:string,value:string>>>>>"
)
_AXES = "array<struct<name:string,values:array<string>,is_variation_axis:boolean>>"


def _text(c: Column) -> Column:
    return let(clean_text(c), lambda t: F.when(t != "", t))


def _texts(c: str, key: str) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_compact(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: _text(x[key]))), none)


def _money(c: str, default_unit: str | None) -> Column:
    """struct(amount, currency, unit) of an integer text in minor units; null for an empty one. The unit is what the shop writes around
    its prices, else for IRR the default."""
    p = F.col("n.prices")
    code = F.coalesce(_text(p["currency_code"]), F.lit(""))
    minor = F.coalesce(F.trim(p["currency_minor_unit"]).try_cast("int"), F.lit(2))
    told = detect_currency(F.concat_ws(" ", p["currency_prefix"], p["currency_suffix"]))["unit"]
    amount = F.when(F.trim(F.col(c)).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.trim(F.col(c)).try_cast("double") / F.pow(F.lit(10.0), minor))
    unit = F.coalesce(told, F.when(F.upper(code) == "IRR", F.lit(default_unit).cast("string")))
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), code.alias("currency"), unit.alias("unit")))


def _terms() -> tuple[Column, Column]:
    """The attributes of a node, and of each of its variations (id, axes) what it is, in the words of the node's terms: a slug that
    the terms don't have stays as it is, and null means any and goes."""
    named = lambda a: F.filter(F.transform(F.filter(a["terms"], lambda t: t.isNotNull()), lambda t: F.struct(_text(t["name"]).alias("name"), F.coalesce(_text(t["slug"]), _text(t["name"])).alias("slug"))), lambda t: t["name"].isNotNull())
    read = F.transform(F.filter("n.attributes", lambda a: a.isNotNull()), lambda a: F.struct(_text(a["name"]).alias("name"), named(a).alias("terms"), F.coalesce(a["has_variations"], F.lit(False)).alias("axis")))
    held = F.filter(read, lambda a: a["name"].isNotNull() & (F.coalesce(F.size(a["terms"]), F.lit(0)) > 0))
    return held, F.transform(F.filter("n.variations", lambda v: v["id"].isNotNull()), lambda v: F.struct(v["id"].alias("id"), F.coalesce(F.filter(F.transform(v["attributes"], lambda x: F.struct(_text(x["name"]).alias("name"), _text(x["value"]).alias("slug"))), lambda x: x["name"].isNotNull() & x["slug"].isNotNull()), F.array().cast("array<struct<name:string,slug:string>>")).alias("said")))


def store_nodes(responses: DataFrame, *, default_unit: str | None = None) -> DataFrame:
    """One row for each object of the answers (url, body and, if they are there, seq and status): its own fields, its terms, what it
    says of its variations, and key, the store's host with its id. Of objects with one id of a host the first counts, by seq, address
    and place; those without an id all stay. Answers without success, and bodies that aren't lists of objects, hold none."""
    seq = F.col("seq").cast("long") if "seq" in responses.columns else F.lit(None).cast("long")
    ok = responses.where(F.coalesce(F.col("status").between(200, 299), F.lit(False))) if "status" in responses.columns else responses
    # outer: else a filter parses every body once more
    d = ok.select("url", seq.alias("seq"), F.posexplode_outer(F.from_json("body", f"array<{STORE_NODE}>")).alias("pos", "n")).where("n is not null and to_json(n) <> '{}'")
    number = lambda c: F.regexp_extract(F.trim(F.col(c)), r"^0*(\d+)(?:\.0+)?$", 1)
    host = F.coalesce(profile_domain(F.col("url")), F.lit(""))
    named = lambda c: F.when(number(c) != "", F.concat(host, F.lit("\n"), number(c)))
    d = d.withColumns({"host": host, "key": named("n.id"), "up": named("n.parent")})
    lone = d.where("key is null")
    first = d.where("key is not null").withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(F.col("seq").asc_nulls_last(), "url", "pos"))).where("_n = 1").drop("_n")
    d = first.unionByName(lone)
    held, said = _terms()
    money = {"_regular": _money("n.prices.regular_price", default_unit), "_sale": F.when(F.col("n.on_sale"), _money("n.prices.sale_price", default_unit)), "low": _money("n.prices.price_range.min_amount", default_unit), "high": _money("n.prices.price_range.max_amount", default_unit)}
    d = d.withColumns(money | {"held": held, "said": said})
    kind = F.when(F.col("n.type").isin("variable", "variation"), F.col("n.type")).otherwise("simple")
    priced = lambda c: F.when(kind != "variable", c)
    links = F.array_distinct(F.array_compact(F.transform(_texts("n.images", "src"), lambda s: resolve_url(s, F.col("url")))))
    return d.select(
        "host", "key", "up", "url", "seq", "pos", number("n.id").try_cast("long").alias("id"), F.when(number("n.parent") != "0", number("n.parent").try_cast("long")).alias("parent_id"), kind.alias("kind"),
        canonical_url(F.coalesce(resolve_url(F.col("n.permalink"), F.col("url")), "url")).alias("source_url"), _text(F.col("n.name")).alias("name"), _text(F.col("n.sku")).alias("sku"), _text(F.col("n.description")).alias("description"), _text(F.col("n.short_description")).alias("short_description"),
        links.alias("images"), F.col("n.categories").alias("categories"), _texts("n.tags", "name").alias("tags"), _text(F.try_element_at("n.brands", F.lit(1))["name"]).alias("brand"), F.coalesce("n.is_in_stock", F.lit(False)).alias("in_stock"),
        priced(F.coalesce("_regular", "_sale")).alias("regular"), priced(F.when(F.col("_sale.amount") < F.col("_regular.amount"), F.col("_sale"))).alias("sale"), F.when(kind == "variable", F.struct("low", "high")).alias("range"), "held", "said",
        F.coalesce(F.transform("held", lambda a: F.struct(a["name"].alias("name"), F.transform(a["terms"], lambda t: t["name"]).alias("values"), a["axis"].alias("is_variation_axis"))), F.array().cast(_AXES)).alias("attributes"),
    )


def _with_paths(nodes: DataFrame, tree: DataFrame | None) -> DataFrame:
    first = let(_text(F.try_element_at("categories", F.lit(1))["name"]), lambda t: F.when(t.isNotNull(), F.array(t)))
    none = F.array().cast("array<string>")
    if tree is None:
        return nodes.withColumn("category_path", F.coalesce(first, none))
    store = F.coalesce(F.col("host"), F.lit("")) if "host" in tree.columns else None
    if store is None:
        terms, at = tree.select(F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), _text(F.col("name")).alias("name")), lambda c: F.trim(c)
    else:
        joined = lambda c: F.concat(store, F.lit("\n"), F.col(c).cast("string"))
        terms, at = tree.select(joined("id").alias("id"), joined("parent").alias("parent"), _text(F.col("name")).alias("name")), lambda c: F.concat("host", F.lit("\n"), F.trim(c))
    stated = nodes.where("key is not null").select("key", "host", F.posexplode("categories").alias("pos", "c"))
    found = category_paths(stated.select(F.col("key").alias("product_id"), at(F.col("c.id")).alias("term"), "pos", _text(F.col("c.name")).alias("name")), terms)
    d = nodes.join(found.withColumnRenamed("product_id", "key"), "key", "left")
    return d.withColumn("category_path", F.coalesce(F.array_compact("category_path"), F.when(F.col("key").isNull(), first), none))


def read_store_api(responses: DataFrame, tree: DataFrame | None = None, *, default_unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, issues) of Store API answers (url, body and, if they are there, seq and status), products and variations alike.

    tree: the store's categories (id, parent, name and, for several stores, host); a product's path is that of its deepest category,
    the first of equals; without a tree the name of the first. A variation stands with the variable parent of its store that it names:
    it has the parent's SKU, and as attributes what the parent says of it, in the words of the parent's terms. Parents carry no price:
    their range is an issue (price-range-only), as are IRR prices without a unit (price-unit-unknown), and variable products whose
    variations no successful answer holds (variations-unavailable), by their own parent or by the address of an answer that asks
    for them. Bodies that are no JSON hold nothing and are no issue."""
    nodes = settled(_with_paths(store_nodes(responses, default_unit=default_unit), tree))
    parents = nodes.where("kind = 'variable' and key is not null and size(said) > 0")
    term = lambda x: F.try_element_at(F.filter(F.try_element_at(F.filter("held", lambda a: a["name"] == x["name"]), F.lit(-1))["terms"], lambda t: t["slug"] == x["slug"]), F.lit(-1))["name"]
    listed = parents.select("key", "host", F.col("sku").alias("_sku"), F.col("name").alias("_name"), "held", F.posexplode("said").alias("at", "v"))
    axes = F.transform("v.said", lambda x: F.struct(x["name"].alias("name"), F.array(F.coalesce(term(x), x["slug"])).alias("values"), F.lit(True).alias("is_variation_axis")))
    listed = listed.select(F.col("key").alias("up"), F.concat("host", F.lit("\n"), F.regexp_replace(F.trim("v.id"), "^0+(?=.)", "")).alias("key"), axes.alias("axes"), "at").groupBy("up", "key").agg(F.max_by("axes", "at").alias("axes"))
    kids = nodes.where("kind = 'variation'").join(parents.select(F.col("key").alias("up"), F.col("sku").alias("parent_sku"), F.col("name").alias("_name"), F.lit(True).alias("_linked")), "up", "left").join(listed, ["up", "key"], "left")
    kids = kids.withColumns({"name": F.coalesce("name", "_name"), "attributes": F.when(F.size("axes") > 0, F.col("axes")).otherwise(F.col("attributes"))})
    every = nodes.where("kind <> 'variation'").withColumns({"parent_sku": F.lit(None).cast("string"), "_linked": F.lit(None).cast("boolean")}).unionByName(kids.drop("_name", "axes"))
    products = every.select(
        "host", "id", "seq", "pos", "source_url", "kind", "name", "description", "short_description", "brand", "category_path", "tags", "images", "attributes", "sku", "parent_id", "parent_sku", F.coalesce("_linked", F.lit(False)).alias("linked"), "in_stock", "regular", "sale", F.lit(CONFIDENCE["api"]).alias("confidence"),
    )

    ok = responses.where(F.coalesce(F.col("status").between(200, 299), F.lit(False))) if "status" in responses.columns else responses
    asked = F.regexp_extract("url", r"[?&]parent=0*(\d+)(?:[&#]|$)", 1)
    answered = ok.where((asked != "") & F.try_parse_json("body").isNotNull()).select(F.concat(F.coalesce(profile_domain(F.col("url")), F.lit("")), F.lit("\n"), asked).alias("key"))
    answered = answered.unionByName(nodes.where("kind = 'variation' and up is not null").select(F.col("up").alias("key"))).distinct()
    issue = lambda d, severity, code, field, message: d.select("source_url", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), message.alias("message"))
    amount = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    ranges = issue(nodes.where("range.low is not null and range.high is not null"), "info", "price-range-only", "regular", F.concat(F.lit("Its variations cost from "), amount(F.col("range.low.amount")), F.lit(" to "), amount(F.col("range.high.amount")), F.lit("; the product itself has no price, they have.")))
    units = issue(nodes.where("upper(regular.currency) = 'IRR' and regular.unit is null"), "warning", "price-unit-unknown", "regular", F.lit("Priced in IRR, but the shop's symbol says neither toman nor rial, which differ by ten: set the unit before an export."))
    lost = issue(parents.join(answered, "key", "left_anti"), "warning", "variations-unavailable", None, F.lit("No answer holds its variations: it stays without them, and nobody can buy it like that."))
    return products, ranges.unionByName(units).unionByName(lost)
