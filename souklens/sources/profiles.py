"""Rules over selectors: pages of a host read by the profiles that were written for it, and whether these still work.

One parse of a page finds the cards of each of its host's profiles and what each rule reads of them. All that follows is
columns over a (page, profile) row: nothing is joined or grouped by page, so ids may repeat or be null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from souklens.functions.numbers import availability, parse_money
from souklens.functions.selectors import Matcher, parse_selector
from souklens.functions.text import canonical_url, clean_text, let, profile_domain, resolve_url
from souklens.plans.lineage import settled
from souklens.sources.markup import CONFIDENCE, PageTree

# What a rule can say of a card.
PROFILE_FIELDS = ("name", "url", "image", "regularPrice", "salePrice", "sku", "availability")
RULE = "struct<selector:string,`from`:string,attribute:string>"
MATCHED = f"page_id long, url string, profile_id long, domain string, container string, fields map<string,{RULE}>, cards array<map<string,string>>, bad string"


def read_profiles(docs: DataFrame) -> DataFrame:
    """(profile_id, domain, container, fields, violations) of rule documents (profile_id, json): every violation is listed,
    each unknown field by its name."""
    v = F.try_parse_json("json")
    p = F.from_json("json", f"struct<version:int,domain:string,card:struct<container:string,fields:map<string,{RULE}>>>")
    d = docs.select("profile_id", p.alias("p"), v.alias("v")).withColumn("f", F.coalesce(F.col("p.card.fields"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{RULE}>"))))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    whole = F.array_compact(F.array(
        F.when(F.col("v").isNull(), "json"), F.when(F.coalesce(F.col("p.version"), F.lit(0)) != 1, "version"), F.when(blank(F.col("p.domain")), "domain"),
        F.when(blank(F.col("p.card.container")), "container"), F.when(~F.map_contains_key("f", F.lit("name")), "name"),
        F.when(F.try_variant_get("v", "$.pagination", "variant").isNotNull() & F.try_variant_get("v", "$.pagination.next", "string").isNull(), "pagination"),
    ))
    rule = lambda e: F.array_compact(F.array(F.when(blank(e["value"]["selector"]), "selector"), F.when(~F.coalesce(e["value"]["from"].isin("text", "attribute"), F.lit(False)), "from"), F.when((e["value"]["from"] == "attribute") & e["value"]["attribute"].isNull(), "attribute")))
    each = F.flatten(F.transform(F.map_entries("f"), lambda e: F.when(e["key"].isin(*PROFILE_FIELDS), rule(e)).otherwise(F.array(F.concat(F.lit("unknown field "), e["key"])))))
    return d.select("profile_id", F.col("p.domain").alias("domain"), F.col("p.card.container").alias("container"), F.col("f").alias("fields"), F.array_distinct(F.concat(whole, each)).alias("violations"))


def _read_page(html: str, rules: list[dict]) -> list[tuple[list | None, str | None]]:
    """For each profile its cards, as the raw text or attribute of each field that has one, or what is wrong with its selectors."""
    matcher, out = Matcher(PageTree(html)), []
    tree = matcher.tree
    for p in rules:
        try:
            cards = []
            for selector in [p["container"] or "", *(r["selector"] or "" for _, r in p["fields"])]:
                parse_selector(selector)
            for card in matcher.find(p["container"]):
                found = {}
                for name, rule in p["fields"]:
                    n = matcher.first_within(rule["selector"], card)
                    if n is not None:
                        found[name] = tree.text_of(n, shown=True) if rule["from"] == "text" else tree.nodes[n][4].get((rule["attribute"] or "").lower())
                cards.append([(k, v) for k, v in found.items() if v is not None])
            out.append((cards, None))
        except ValueError as e:
            out.append((None, str(e)))
    return out


def match_profiles(pages: DataFrame, profiles: DataFrame, *, most: int = 10_000) -> DataFrame:
    """One row for each page (page_id, url, html) and profile (profile_id, domain, container, fields) of its host: its cards, each a
    map of what the rules read; bad: why a profile's selectors can't be read (null otherwise).

    Up to `most` hosts, profiles are broadcast, so that no page is moved; beyond, pages and profiles meet by host, split where a host
    is large. Null and repeated page ids are rows like others; a page whose host has no profile has none; a null page has no cards.
    """
    host = F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "")
    rule = F.struct("profile_id", "domain", "container", F.map_entries("fields").alias("fields"))
    hosts = profiles.where("domain is not null and fields is not null").groupBy(host.alias("host")).agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    few = hosts.limit(most + 1).count() <= most
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", profile_domain(F.col("url")).alias("host"))
    d = p.join(F.broadcast(hosts) if few else hosts, "host").select("page_id", "url", "html", "rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.struct([("selector", pa.string()), ("from", pa.string()), ("attribute", pa.string())]))
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("profile_id", pa.int64()), ("domain", pa.string()), ("container", pa.string()), ("fields", kind), ("cards", pa.list_(pa.map_(pa.string(), pa.string()))), ("bad", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for page in batch.slice(at, 64).to_pylist():
                    rules = [r | {"fields": [(f["key"], f["value"]) for f in r["fields"] if f["value"]]} for r in page["rules"]]
                    for r, (cards, bad) in zip(rules, _read_page(page["html"] or "", rules), strict=True):
                        rows.append({"page_id": page["page_id"], "url": page["url"], "profile_id": r["profile_id"], "domain": r["domain"], "container": r["container"], "fields": r["fields"], "cards": cards, "bad": bad})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _cleaned(d.mapInArrow(run, MATCHED))


def _cleaned(matched: DataFrame) -> DataFrame:
    """cards with what a rule's raw text or attribute means: clean text, or an absolute http(s) address; null where that is nothing."""

    def value(card: Column, f: str) -> Column:
        raw, rule = card[f], F.col("fields")[f]
        text = let(clean_text(raw), lambda t: F.when(t != "", t))
        link = (rule["from"] == "attribute") & F.lower(rule["attribute"]).isin("href", "src")
        return F.when(raw.isNull(), None).when(link, F.when(F.trim(raw) != "", resolve_url(raw, F.col("url"), only_http=True))).otherwise(text)

    return matched.withColumn("cards", F.transform("cards", lambda c: F.struct(*[value(c, f).alias(f) for f in PROFILE_FIELDS])))


def profile_products(matched: DataFrame, *, default_currency: str | None = None, default_unit: str | None = None) -> DataFrame:
    """One product for each card with a name: (page_id, url, profile_id, card, source_url, kind, name, sku, images, regular, sale,
    in_stock, field_confidence), read with the least confidence that a page's own words have. A sale price needs a higher regular one;
    alone it is the regular one."""
    d = matched.select("page_id", "url", "profile_id", F.posexplode_outer("cards").alias("card", "c")).where("c.name is not null")  # outer: else a filter cleans the cards once more
    money = lambda f: let(parse_money(F.col(f"c.{f}"), default_currency, default_unit), lambda m: F.when(m.isNotNull(), F.struct(m["amount"].alias("amount"), m["currency"].alias("currency"), m["unit"].alias("unit"))))
    d = d.withColumns({"_regular": money("regularPrice"), "_sale": money("salePrice")})
    sale = F.when(F.col("_sale.amount") < F.col("_regular.amount"), F.col("_sale"))
    d = d.select(
        "page_id", "url", "profile_id", "card", canonical_url(F.coalesce("c.url", "url")).alias("source_url"), F.lit("simple").alias("kind"), F.col("c.name").alias("name"), F.col("c.sku").alias("sku"),
        F.array_compact(F.array("c.image")).alias("images"), F.coalesce("_regular", "_sale").alias("regular"), sale.alias("sale"), availability(F.col("c.availability")).alias("in_stock"),
    )
    stated = {"name": F.col("name"), "kind": F.col("kind"), "sku": F.col("sku"), "images": F.try_element_at("images", F.lit(1)), "price": F.col("regular.amount"), "in_stock": F.col("in_stock")}
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.isNotNull().alias("v")) for k, v in stated.items()]), lambda e: e["v"])
    return d.withColumn("field_confidence", F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"], F.lit(CONFIDENCE["profile"])))))


def _hits(cards: Column, f: str) -> Column:
    return F.coalesce(F.size(F.filter(cards, lambda c: c[f].isNotNull())), F.lit(0)).cast("long")


def profile_issues(matched: DataFrame) -> DataFrame:
    """(page_id, url, profile_id, severity, kind, code, field, message): a container that finds no card, a rule that finds nothing on
    any card, cards without a name, selectors that can't be read. A rule that misses some cards only is no issue."""
    n = F.size("cards")
    kind = "struct<severity:string,kind:string,code:string,field:string,message:string>"
    issue = lambda ok, severity, kind_, code, message, f=None: F.when(ok, F.struct(F.lit(severity).alias("severity"), F.lit(kind_).cast("string").alias("kind"), F.lit(code).alias("code"), F.lit(f).cast("string").alias("field"), message.alias("message")))
    lost = _hits(F.col("cards"), "name")
    missed = [
        issue((n > 0) & F.map_contains_key("fields", F.lit(f)) & (_hits(F.col("cards"), f) == 0), "warning", "structure-changed", "profile-field-missed", F.concat(F.lit(f"The rule for {f} ("), F.col("fields")[f]["selector"], F.lit(") found nothing on any of "), n.cast("string"), F.lit(" cards.")), f)
        for f in PROFILE_FIELDS
    ]
    found = F.array_compact(F.array(
        issue(F.col("bad").isNotNull(), "error", "structure-changed", "profile-selector-unreadable", F.col("bad")),
        issue(n == 0, "warning", "structure-changed", "profile-container-missed", F.concat(F.lit("The container "), F.col("container"), F.lit(" found no card on this page."))),
        *missed, issue((n > 0) & (lost < n), "warning", None, "profile-nameless-cards", F.concat((n - lost).cast("string"), F.lit(" of "), n.cast("string"), F.lit(" cards have no name and are left out."))),
    ).cast(f"array<{kind}>"))
    return matched.select("page_id", "url", "profile_id", F.explode_outer(found).alias("i")).where("i is not null").select("page_id", "url", "profile_id", "i.*")


def extract_with_profiles(pages: DataFrame, profiles: DataFrame, *, default_currency: str | None = None, default_unit: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, issues) of pages by their hosts' profiles; the pages are parsed once."""
    matched = settled(match_profiles(pages, profiles))
    return profile_products(matched, default_currency=default_currency, default_unit=default_unit), profile_issues(matched)


def profile_health(matched: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile_id, domain, pages, cards, broken, partial, healthy, summary) of each profile over all pages of its host: fields whose
    rule finds nothing on any card, and on some cards only. A profile without cards isn't healthy."""
    counts = [F.sum(_hits(F.col("cards"), f)).alias(f"hit_{f}") for f in PROFILE_FIELDS]
    n = matched.groupBy("profile_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.greatest(F.coalesce(F.size("cards"), F.lit(0)), F.lit(0))).cast("long").alias("cards"), *counts)
    d = profiles.select("profile_id", "domain", "fields").join(n, "profile_id", "left").fillna(0, ["pages", "cards", *[f"hit_{f}" for f in PROFILE_FIELDS]])
    hits = F.filter(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"hit_{f}").alias("n")) for f in PROFILE_FIELDS]), lambda x: F.coalesce(F.map_contains_key("fields", x["f"]), F.lit(False)))
    names = lambda ok: F.transform(F.filter(hits, ok), lambda x: x["f"])
    d = d.withColumns({"broken": names(lambda x: x["n"] == 0), "partial": names(lambda x: (x["n"] > 0) & (x["n"] < F.col("cards")))})
    count = F.concat(F.col("cards").cast("string"), F.lit(" cards found"))
    summary = (
        F.when(F.col("cards") == 0, "no cards found: the profile has to be taught again").when(F.size("broken") > 0, F.concat(count, F.lit(", but nothing by "), F.array_join("broken", ", ")))
        .when(F.size("partial") > 0, F.concat(count, F.lit("; some lack "), F.array_join("partial", ", "))).otherwise(F.concat(count, F.lit(", and every rule found its field")))
    )
    return d.select("profile_id", "domain", "pages", "cards", "broken", "partial", ((F.col("cards") > 0) & (F.size("broken") == 0)).alias("healthy"), summary.alias("summary"))


def profile_text(profile: dict) -> str:
    """A profile as the text of a document that people keep: two blanks of indent, a line feed at its end."""
    return json.dumps(profile, ensure_ascii=False, indent=2) + "\n"
