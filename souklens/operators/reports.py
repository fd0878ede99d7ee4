"""Filters, coverage, issues, detections, pagination and audits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from souklens.functions.numbers import to_ascii_digits
from souklens.functions.text import canonical_url, clean_text, describe_confidence, fold_for_compare, url_part
from souklens.plans.lineage import settled


def matches_category(path: Column, wanted: str) -> Column:
    """A folded prefix of the path, `a > b`; one segment alone matches anywhere; an empty wish keeps all."""
    parts = [p.strip() for p in wanted.split(">") if p.strip()]
    if not parts:
        return F.lit(True)
    folded, want = F.transform(path, lambda x: fold_for_compare(x)), F.array(*[fold_for_compare(F.lit(p)) for p in parts])
    head = F.slice(folded, 1, len(parts)) == want
    return F.coalesce(head | F.array_contains(folded, want[0]) if len(parts) == 1 else head, F.lit(False))


def apply_catalog_filter(products: DataFrame, *, kinds: list[str], category: str = "") -> DataFrame:
    """products with verdict: kept, filtered-kind, filtered-category or, for variations without a parent, filtered-orphan.

    Variations follow their parent: the product whose SKU, or whose canonical address where it has none, is the variation's
    parent_key, else its parent_sku, else its own canonical address; the address of a parent that is kept counts too. Of several
    such parents one that is kept decides, and keeps the others of its key. One aggregate over the parents, one join."""
    own = F.when(~F.col("kind").isin(*kinds), "filtered-kind").when(~matches_category(F.col("category_path"), category), "filtered-category").otherwise("kept")
    has = lambda c: [F.col(c)] if c in products.columns else []
    address = [canonical_url(c) for c in has("source_url")]
    none = F.lit(None).cast("string")
    parent, variation = F.col("kind") != "variation", F.col("kind") == "variation"
    mine, theirs = F.coalesce(*has("sku"), *address, none), F.coalesce(*has("parent_key"), *has("parent_sku"), *address, none)
    d = products.withColumns({"verdict": F.when(parent, own), "_key": F.when(variation, theirs).otherwise(mine)})
    keys = d.where(parent).select("verdict", F.explode(F.array_distinct(F.array("_key", *address))).alias("_key")).where("_key is not null")
    fate = keys.groupBy("_key").agg(F.when(F.max(F.col("verdict") == "kept"), "kept").otherwise(F.max("verdict")).alias("_fate"))
    d = d.join(fate, "_key", "left")
    return d.withColumn("verdict", F.when(variation, F.coalesce("_fate", F.lit("filtered-orphan"))).when(F.col("_fate") == "kept", "kept").otherwise(F.col("verdict"))).drop("_key", "_fate")


def filter_issues(filtered: DataFrame, *, kinds: list[str], category: str = "", off: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """(scope, code, n, message): what apply_catalog_filter left out, by reason, and fields that are turned off (off) where products
    remain. A reason without rows gives no row."""
    scope = scope or []
    kid, left = F.col("kind") == "variation", F.col("verdict") != "kept"
    n = lambda c: F.count(F.when(c, 1))
    told = (
        ("filtered-by-product-type", n(~kid & (F.col("verdict") == "filtered-kind")), f" product(s) were left out because their type is not in {' / '.join(kinds)}."), ("filtered-by-category", n(~kid & (F.col("verdict") == "filtered-category")), f' product(s) were left out; they are not under "{category}".'),
        ("filtered-variations", n(kid & left), " variation(s) went with the products they belong to. A variation without its parent cannot be imported."),
    )
    counts = [F.struct(F.lit(code).alias("code"), c.alias("n"), F.concat(c.cast("string"), F.lit(m)).alias("message")) for code, c, m in told]
    if off:
        counts.append(F.struct(F.lit("fields-turned-off").alias("code"), n(~left).alias("n"), F.lit(f"These fields are empty because the settings turn them off: {', '.join(off)}.").alias("message")))
    return filtered.groupBy(*scope).agg(F.array(*counts).alias("c")).select(*scope, F.explode("c").alias("c")).select(*scope, "c.*").where("n > 0")


def project_target_fields(products: DataFrame, wanted: list[str], every: list[str]) -> DataFrame:
    """Unwanted fields become null, arrays empty, and their entries leave field_confidence; columns stay."""
    off = [f for f in every if f not in wanted]
    empty = lambda kind: (F.array() if isinstance(kind, T.ArrayType) else F.lit(None)).cast(kind)
    d = products.withColumns({f: empty(products.schema[f].dataType) for f in off})
    return d.withColumn("field_confidence", F.map_filter("field_confidence", lambda k, _: ~k.isin(*off))) if off and "field_confidence" in d.columns else d


def field_coverage(products: DataFrame, fields: list[str], *, scope: list[str] | None = None, wanted: list[str] | None = None) -> DataFrame:
    """(scope, field, filled, total, reason): one pass, whatever the number of fields. Blanks and empty lists aren't filled; nor is
    any field of an empty table."""
    kinds = dict(products.dtypes)
    counts = [F.struct(F.lit(f).alias("field"), F.count(F.when(has_value(f, kinds[f]), True)).alias("filled"), F.count(F.lit(1)).alias("total"), F.lit(wanted is None or f in wanted).alias("on")) for f in fields]
    d = products.groupBy(*(scope or [])).agg(F.array(*counts).alias("c")).select(*(scope or []), F.explode("c").alias("c")).select(*(scope or []), "c.*")
    reason = F.when(~F.col("on"), "turned-off").when((F.col("total") > 0) & (F.col("filled") == F.col("total")), "filled").when(F.col("filled") == 0, "not-published").otherwise("partial")
    return d.withColumn("reason", reason).drop("on")


def summarize_issues(issues: DataFrame, *, scope: list[str] | None = None) -> DataFrame:
    """One row per code: its first message, how many; rank: errors before warnings, then as first seen. Notes are left out."""
    scope = scope or []
    d = issues.where("severity <> 'info'").groupBy(*scope, "code").agg(F.min_by("message", "seq").alias("message"), F.min_by("severity", "seq").alias("severity"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return d.withColumn("rank", F.row_number().over(W.partitionBy(*scope).orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "first_seq")))


def currency_unit_counts(products: DataFrame, prices: list[str]) -> DataFrame:
    """(unit, n) over all prices (structs with currency and unit); neither known: unknown."""
    p = products.select(F.explode(F.array(*[F.col(c) for c in prices])).alias("p")).where("p is not null")
    return p.groupBy(F.coalesce("p.unit", F.when(F.col("p.currency") != "", F.col("p.currency")), F.lit("unknown")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def rule_table(rules: DataFrame, *, most: int = 20_000) -> Column:
    """Rules (target, rule_no, label, needle, weight and more) as one constant array, so that a page meets them within its row.
    A table of rules is written by people: one of more than `most` rows is refused, never cut."""
    rows = rules.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), T.ArrayType(rules.schema))


def score_targets(fired: Column) -> Column:
    """Array of (target, weight, labels) of the rules that fired: the sum of a target's weights, at most 1, labels by rule_no."""
    own = lambda t: F.filter(fired, lambda r: r["target"] == t)
    weight = lambda t: F.least(F.lit(1.0), F.aggregate(own(t), F.lit(0.0), lambda a, r: a + r["weight"]))
    labels = lambda t: F.transform(F.array_sort(F.transform(own(t), lambda r: F.struct(r["rule_no"].alias("n"), r["label"].alias("l")))), lambda x: x["l"])
    return F.transform(F.array_distinct(F.transform(fired, lambda r: r["target"])), lambda t: F.struct(t.alias("target"), weight(t).alias("weight"), labels(t).alias("labels")))


def score_signals(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", html: str = "html", least: float = 0.3) -> DataFrame:
    """(page_id, target, confidence, labels, rank) from rules (target, rule_no, label, needle, weight): sum of weights found in the
    page, at most 1, at least `least`. All is done within the page's row, without an exchange: null and repeated ids stay pages of
    their own."""
    low = pages.select(page_id, F.lower(html).alias("_h"))
    d = low.select(page_id, F.filter(rule_table(rules), lambda r: F.coalesce(F.contains(F.col("_h"), r["needle"]), F.lit(False))).alias("_fired"))
    found = F.transform(score_targets(F.col("_fired")), lambda t: F.struct((-F.round(t["weight"], 2)).alias("less"), t["target"].alias("target"), t["labels"].alias("labels")))
    d = d.select(page_id, F.posexplode(F.array_sort(F.filter(found, lambda t: -t["less"] >= least))).alias("_k", "t"))
    return d.select(page_id, "t.target", (-F.col("t.less")).alias("confidence"), "t.labels", (F.col("_k") + 1).alias("rank"))


# Marks of challenge pages, in the first 4,096 characters, and what each is evidence of.
CHALLENGES = (
    ("/cdn-cgi/challenge-platform/", "Cloudflare challenge platform script"), ("cf-browser-verification", "Cloudflare browser verification"), ("cf_chl_opt", "Cloudflare challenge options"),
    ("just a moment...", 'Cloudflare "Just a moment..." interstitial'), ("attention required! | cloudflare", "Cloudflare block page"), ("checking your browser before accessing", "browser-check interstitial"),
    ("g-recaptcha", "reCAPTCHA widget"), ("h-captcha", "hCaptcha widget"), ("_incapsula_resource", "Imperva/Incapsula challenge"), ("captcha-delivery.com", "DataDome challenge"),
    ("px-captcha", "PerimeterX challenge"), ("/_sec/cp_challenge/", "Akamai challenge"),
)


def detect_blocks(responses: DataFrame) -> DataFrame:
    """responses (status, headers, body) with block and evidence: null where the site hasn't refused. Header names are matched in
    any case; 404 and 500 are no refusals."""
    head = F.lower(F.substring(F.coalesce("body", F.lit("")), 1, 4096))
    mark = F.coalesce(*[F.when(F.contains(head, F.lit(m)), F.lit(label)) for m, label in CHALLENGES])
    named = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == "cf-mitigated")
    mitigated = F.coalesce(F.lower(F.try_element_at(named, F.lit(1))["value"]) == "challenge", F.lit(False))
    http = F.concat(F.lit("HTTP "), F.col("status").cast("string"))
    block = (
        F.when(mitigated, F.struct(F.lit("captcha"), F.lit("cf-mitigated: challenge"))).when(F.col("status") == 429, F.struct(F.lit("rate-limited"), http)).when(F.col("status") == 401, F.struct(F.lit("login-required"), http))
        .when(F.col("status") == 403, F.struct(F.when(mark.isNotNull(), "captcha").otherwise("forbidden"), F.coalesce(mark, http))).when(F.col("status").isin(200, 503) & mark.isNotNull(), F.struct(F.lit("captcha"), mark))
    )
    return responses.withColumn("_b", block).withColumns({"block": F.col("_b")["col1"], "evidence": F.col("_b")["col2"]}).drop("_b")


def block_latch(responses: DataFrame, *, scope: str = "scan_id", seq: str = "seq") -> DataFrame:
    """Rows before the first block of their scan. A scan's first block is one row, found by an aggregate, not a window."""
    first = responses.where("block is not null").groupBy(scope).agg(F.min(seq).alias("_first"))
    return responses.join(first, scope, "left").where(F.col("_first").isNull() | (F.col(seq) < F.col("_first"))).drop("_first")


def pacing_audit(log: DataFrame, *, delay_ms: int = 800, scope: str = "scan_id", start: str = "start_ts", tie: str = "seq") -> DataFrame:
    """log with gap_ms to the start before it in the scan, and too_close."""
    gap = F.unix_millis(F.col(start)) - F.unix_millis(F.lag(start).over(W.partitionBy(scope).orderBy(start, tie)))
    return log.withColumn("gap_ms", gap).withColumn("too_close", F.coalesce(F.col("gap_ms") < delay_ms, F.lit(False)))


def overlap_audit(log: DataFrame, *, most: int = 2, scope: str = "scan_id", start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """(scope, at, in_flight) where more than `most` requests run at once: a running sum of starts and ends."""
    events = log.select(scope, F.col(start).alias("at"), F.lit(1).alias("step")).unionByName(log.select(scope, F.col(end).alias("at"), F.lit(-1).alias("step")))
    return events.withColumn("in_flight", F.sum("step").over(W.partitionBy(scope).orderBy("at", "step").rowsBetween(W.unboundedPreceding, 0))).where(F.col("in_flight") > most).drop("step")


def walk_pagination(pages: DataFrame, seeds: DataFrame, *, max_pages: int = 20) -> DataFrame:
    """(seed, url, hop): pages (url, next_url) followed from seeds (seed, url), each once, at most max_pages a seed; repeated rows
    of either count once."""
    at = seeds.select("seed", "url", F.lit(1).alias("hop")).distinct()
    pages, seen = settled(pages.select("url", "next_url").distinct()), at
    for hop in range(2, max_pages + 1):
        at = at.join(pages.select("url", "next_url"), "url").where("next_url is not null").select("seed", F.col("next_url").alias("url"), F.lit(hop).alias("hop")).distinct().join(seen.select("seed", "url"), ["seed", "url"], "left_anti")
        at = settled(at)
        if at.isEmpty():
            break
        seen = seen.unionByName(at)
    return seen


def walk_statuses(walk: DataFrame, pages: DataFrame, *, max_pages: int = 20) -> DataFrame:
    """One row per seed of a walk: n_pages and how it ended.

    pages: url, next_url and, if there is one, blocked. blocked: a page of the walk said no; budget-reached: the last page
    allowed names one that wasn't visited; page-unavailable: a visited address has no page; else complete, loops included.
    """
    flag = F.coalesce(F.col("blocked"), F.lit(False)) if "blocked" in pages.columns else F.lit(False)
    links = pages.groupBy("url", "next_url").agg(F.max(flag).alias("_blocked"), F.lit(True).alias("_read"))
    at = walk.select("seed", "url", "hop").join(links, "url", "left")
    seen = walk.select("seed", F.col("url").alias("next_url"), F.lit(True).alias("_seen")).distinct()
    at = at.join(seen, ["seed", "next_url"], "left")
    more = (F.col("hop") >= max_pages) & F.col("next_url").isNotNull() & F.col("_seen").isNull()
    status = F.when(F.max(F.coalesce("_blocked", F.lit(False))), "blocked").when(F.max(more), "budget-reached").when(F.max(F.col("_read").isNull()), "page-unavailable").otherwise("complete")
    return at.groupBy("seed").agg(F.countDistinct("url").alias("n_pages"), status.alias("status"))


def top_issues(issues: DataFrame, n: int = 6, scope: str = "scan_id") -> DataFrame:
    """The first n issues of each scan: errors, warnings, notes, as first seen."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.withColumn("rank", F.row_number().over(W.partitionBy(scope).orderBy(rank, "seq"))).where(F.col("rank") <= n)


def usage_rollup(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider", "model").agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def verify_answers(answers: DataFrame, fragments: DataFrame) -> DataFrame:
    """answers (request_id, field, value) against the text that was sent (request_id, fragment): present says whether the value
    stands in it.

    Prices and quantities (regular, sale, stock_quantity) by the digits of their integer part, also ten times or a tenth of
    them; one or two digits prove nothing and pass; a price must be above 0. images by the path of their URL, never data:.
    Names and descriptions are taken by length alone (500 and 8,000 characters); everything else by its folded text, of at
    most 500. Each fragment is folded once, before the join; a value without a fragment isn't present."""
    folded = F.when(F.col("fragment").isNotNull(), F.struct(fold_for_compare(F.col("fragment")).alias("text"), F.regexp_replace(to_ascii_digits(F.col("fragment")), "[^0-9]", "").alias("digits")))
    d = answers.join(fragments.select("request_id", folded.alias("_f")), "request_id", "left")
    value, text, digits = clean_text(F.col("value")), F.col("_f.text"), F.col("_f.digits")
    amount = F.col("value").try_cast("double")
    whole = F.floor(F.abs(amount)).cast("decimal(38,0)")
    own = whole.cast("string")
    tenth = F.when(whole % 10 == 0, F.contains(digits, F.substring(own, F.lit(1), F.length(own) - 1))).otherwise(False)
    by_digits = amount.isNotNull() & ((F.length(own) <= 2) | F.contains(digits, own) | tenth | F.contains(digits, F.concat(own, F.lit("0"))))
    inside = lambda c: F.contains(text, fold_for_compare(c)) & (fold_for_compare(c) != "")
    path = F.when(value.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url_part(value, 3)).otherwise(F.regexp_extract(value, r"^([^?#]*)", 1))
    by_path = ~F.startswith(value, F.lit("data:")) & ((F.length(path) <= 1) | inside(path))
    field = F.col("field")
    ok = (
        F.when(value == "", False).when(field == "name", F.length(value) <= 500).when(field.isin("description", "short_description"), F.length(value) <= 8000)
        .when(field.isin("regular", "sale"), by_digits & (amount > 0)).when(field == "stock_quantity", by_digits & (amount >= 0)).when(field == "images", by_path)
        .otherwise((F.length(value) <= 500) & inside(value))
    )
    return d.withColumn("present", F.coalesce(ok & F.col("_f").isNotNull(), F.lit(False))).drop("_f")


def fill_empty(products: DataFrame, answers: DataFrame, field: str, key: str = "product_key") -> DataFrame:
    """products with a field filled from verified answers (key, value and, if there are such columns, confidence and seq) only where
    it is empty; filled marks those rows, whose layer becomes D and whose confidence of the field 0.3, if there are such columns.

    A key has one answer: the surest, then the first, then the least value; empty ones are none. Rows without a key stay as they are."""
    kinds = dict(answers.dtypes)
    sure = -F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) if "confidence" in kinds else F.lit(0.0)
    seq = F.col("seq").cast("long") if "seq" in kinds else F.lit(0).cast("long")
    order = F.struct(sure.alias("sure"), seq.isNull().alias("late"), seq.alias("seq"), F.col("value"))
    best = answers.where(F.col(key).isNotNull() & has_value("value", kinds["value"])).groupBy(key).agg(F.min_by("value", order).alias("_v"))
    d = products.join(best, key, "left").withColumn("filled", ~has_value(field, dict(products.dtypes)[field]) & F.col("_v").isNotNull())
    new = {field: F.when(F.col("filled"), F.col("_v")).otherwise(F.col(field))}
    if "layer" in products.columns:
        new["layer"] = F.when(F.col("filled"), F.lit("D")).otherwise(F.col("layer"))
    if "field_confidence" in products.columns:
        rest = F.map_filter(F.coalesce("field_confidence", F.create_map().cast("map<string,double>")), lambda k, _: k != field)
        new["field_confidence"] = F.when(F.col("filled"), F.map_concat(rest, F.create_map(F.lit(field), F.lit(0.3)))).otherwise(F.col("field_confidence"))
    return d.withColumns(new).drop("_v")


# Fields that decide whether a product needs more, kinds of errors that end a scan, names of layers.
TIER_1 = ("name", "regular", "category_path", "images", "description", "in_stock")
BLOCKING = ("network", "site-blocked", "parse-failed", "structure-changed")
LAYERS = {"A": "the shop’s own product API", "B": "the page’s structured data", "C": "the layout you taught it", "D": "the AI fallback"}


def has_value(c: str, kind: str) -> Column:
    """Whether a field says something: blanks and empty lists don't, 0 and false do."""
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind.startswith("array") else F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) if kind == "string" else F.col(c).isNotNull()


def missing_tier1(products: DataFrame, wanted: list[str]) -> DataFrame:
    """products with missing (wanted fields of the first tier that are empty; attributes too for variable ones) and needs_more,
    which variations never do."""
    kinds = dict(products.dtypes)
    gate = [F.when(~has_value(f, kinds[f]), F.lit(f)) for f in TIER_1 if f in wanted and f in kinds]
    gate += [F.when((F.col("kind") == "variable") & ~has_value("attributes", kinds["attributes"]), F.lit("attributes"))] if "attributes" in wanted and "attributes" in kinds else []
    d = products.withColumn("missing", F.array_compact(F.array(*gate)) if gate else F.array().cast("array<string>"))
    return d.withColumn("needs_more", (F.col("kind") != "variation") & (F.size("missing") > 0))


def field_sources(products: DataFrame, fields: list[str], *, scope: list[str] | None = None) -> DataFrame:
    """(scope, field, sources): the layers (layer, field_confidence of the products) that filled a field, by their highest confidence
    down, each with a word for it."""
    kinds = dict(products.dtypes)
    told = F.array(*[F.struct(F.lit(f).alias("field"), F.when(has_value(f, kinds[f]), F.coalesce(F.try_element_at("field_confidence", F.lit(f)), F.lit(0.0))).alias("c")) for f in fields])
    d = products.select(*(scope or []), "layer", F.explode(told).alias("t")).where("t.c is not null")
    d = d.groupBy(*(scope or []), "t.field", "layer").agg(F.max("t.c").alias("c"))
    name = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in LAYERS.items()], F.concat(F.lit("layer "), "layer"))
    line = F.concat(name, F.lit(" ("), describe_confidence(F.col("c")), F.lit(")"))
    return d.groupBy(*(scope or []), "field").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "layer", line.alias("line")))), lambda s: s["line"]).alias("sources"))


def blocking_issue(issues: DataFrame, *, scope: list[str] | None = None) -> DataFrame:
    """(scope, code, message): the first error of each scan that ends it."""
    d = issues.where((F.col("severity") == "error") & F.col("kind").isin(*BLOCKING)).groupBy(*(scope or [])).agg(F.min_by(F.struct("code", "message"), "seq").alias("b"))
    return d.select(*(scope or []), "b.*")


def explain_fields(coverage: DataFrame, blocking: DataFrame, *, scope: list[str]) -> DataFrame:
    """coverage as field_coverage gives it, with scan-failed for empty fields of scans that an error ended, and its message."""
    d = coverage.join(blocking.select(*scope, F.col("message").alias("_m")), scope, "left")
    failed = (F.col("reason") == "not-published") & F.col("_m").isNotNull()
    message = F.when(failed, F.concat(F.lit("Empty because the scan could not finish: "), "_m"))
    return d.withColumns({"reason": F.when(failed, "scan-failed").otherwise(F.col("reason")), "message": message}).drop("_m")


def top_warnings(issues: DataFrame, n: int = 5, scope: str = "scan_id") -> DataFrame:
    """The first n warnings of each export."""
    d = issues.where("severity = 'warning'")
    return d.withColumn("rank", F.row_number().over(W.partitionBy(scope).orderBy("seq"))).where(F.col("rank") <= n)


def scan_summary(products: DataFrame, pages: DataFrame, *, scope: str = "scan_id") -> DataFrame:
    """(scope, rows, products, variations, pages, requests, status): one row per scan of either table, null scans as one. A scan with
    a blocked page is blocked; else, if pages has over_budget and one is, budget-reached; else complete. If products has duplicates,
    their sum is there too."""
    extra = [F.sum("duplicates").alias("duplicates")] if "duplicates" in products.columns else []
    late = F.max(F.coalesce("over_budget", F.lit(False))) if "over_budget" in pages.columns else F.lit(False)
    p = products.groupBy(scope).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("kind") != "variation", 1)).alias("products"), F.count(F.when(F.col("kind") == "variation", 1)).alias("variations"), *extra)
    q = pages.groupBy(F.col(scope).alias("_scan")).agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("block").isNull(), 1)).alias("pages"), F.max(F.col("block").isNotNull()).alias("_blocked"), late.alias("_late"))
    d = q.join(p, q["_scan"].eqNullSafe(p[scope]), "full").withColumn(scope, F.coalesce(scope, "_scan"))
    d = d.fillna(0, ["rows", "products", "variations", "requests", "pages", *(["duplicates"] if extra else [])])
    d = d.withColumn("status", F.when(F.col("_blocked"), "blocked").when(F.col("_late"), "budget-reached").otherwise("complete"))
    return d.select(scope, "requests", "pages", "rows", "products", "variations", *(["duplicates"] if extra else []), "status")


# Fields of the second tier; all others are of the first.
TIER_2 = ("sku", "tags", "weight", "dimensions", "brand", "gtin")


def report_fields(scans: DataFrame, products: DataFrame, issues: DataFrame, fields: list[str], *, wanted: list[str], scope: str = "scan_id") -> DataFrame:
    """(scope, field, tier, filled, total, reason, sources, message): why each field of each of the scans (scope, one row each) is
    as it is, in words. A scan without products, or without issues, has its rows too; an empty field of a scan that an error
    ended is scan-failed. Everything is counted before it is joined: per scan and field, never per product."""
    every = scans.select(scope, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(2 if f in TIER_2 else 1).alias("tier"), F.lit(f in wanted).alias("_on")) for f in fields])).alias("f")).select(scope, "f.*")
    counted = field_coverage(products, fields, scope=[scope], wanted=wanted).select(scope, "field", "filled", "total")
    d = every.join(counted, [scope, "field"], "left").fillna(0, ["filled", "total"]).join(field_sources(products, fields, scope=[scope]), [scope, "field"], "left")
    d = d.join(blocking_issue(issues, scope=[scope]).select(scope, F.col("message").alias("_stop")), scope, "left")
    none = F.col("filled") == 0
    reason = F.when(~F.col("_on"), "turned-off").when((F.col("filled") == F.col("total")) & ~none, "filled").when(none & F.col("_stop").isNotNull(), "scan-failed").when(none, "not-published").otherwise("partial")
    said = F.col("reason").isin("filled", "partial")
    d = d.withColumn("reason", reason).withColumn("sources", F.when(said, F.coalesce("sources", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    by = F.array_join("sources", " and ")
    message = (
        F.when(F.col("reason") == "turned-off", F.concat(F.lit('Empty because "'), "field", F.lit('" is switched off in your settings. Turn it on and scan again to fill it.')))
        .when(F.col("reason") == "filled", F.concat(F.lit("Filled for every product, from "), by, F.lit(".")))
        .when(F.col("reason") == "scan-failed", F.concat(F.lit("Empty because the scan could not finish: "), "_stop"))
        .when((F.col("reason") == "not-published") & (F.col("tier") == 1), "Empty because this shop’s pages do not publish it anywhere it can be read. If you can see it on the page yourself, a taught profile will pick it up.")
        .when(F.col("reason") == "not-published", "Empty because the shop does not publish it. This is common and usually fine.")
        .otherwise(F.concat(F.lit("Filled for "), F.col("filled").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" products, from "), by, F.lit(". The rest of the pages do not state it.")))
    )
    return d.withColumn("message", message).drop("_on", "_stop")


def scan_report(scans: DataFrame, products: DataFrame, issues: DataFrame, fields: list[str], *, wanted: list[str], health: DataFrame | None = None, scope: str = "scan_id") -> DataFrame:
    """(scope, n_products, n_asked, n_complete, summary, profile_note): one row per scan in words. health: scope, healthy and summary of
    the scan's taught profile; a healthy one, or none, has no note. Fields are named in the order of `fields`."""
    told = report_fields(scans, products, issues, fields, wanted=wanted, scope=scope)
    place = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    bare = F.when((F.col("reason") == "not-published") & (F.col("tier") == 1), F.struct(place.alias("at"), F.col("field").alias("field")))
    d = told.groupBy(scope).agg(F.max("total").alias("n_products"), F.count(F.when(F.col("reason") != "turned-off", 1)).alias("n_asked"), F.count(F.when(F.col("reason") == "filled", 1)).alias("n_complete"), F.array_sort(F.collect_list(bare)).alias("_bare"))
    d = d.join(blocking_issue(issues, scope=[scope]).select(scope, F.col("message").alias("_stop")), scope, "left")
    names = F.array_join(F.transform("_bare", lambda x: x["field"]), ", ")
    tail = F.when(F.size("_bare") == 0, "Nothing here looks wrong.").otherwise(F.concat(names, F.lit(" came back empty everywhere, which usually means this shop does not publish them in a readable form.")))
    full = F.concat(F.col("n_products").cast("string"), F.lit(" product(s) read. "), F.col("n_complete").cast("string"), F.lit(" of "), F.col("n_asked").cast("string"), F.lit(" requested fields are filled for every one of them. "), tail)
    nothing = F.coalesce(F.concat(F.lit("The scan stopped: "), "_stop"), F.lit("No products were found on this page. If you can see products yourself, teach a profile, so that the layout is known."))
    d = d.withColumn("summary", F.when(F.col("n_products") == 0, nothing).otherwise(full))
    if health is None:
        return d.select(scope, "n_products", "n_asked", "n_complete", "summary", F.lit(None).cast("string").alias("profile_note"))
    ill = health.where(~F.coalesce("healthy", F.lit(True))).groupBy(scope).agg(F.min("summary").alias("_ill"))
    note = F.concat(F.lit("The layout you taught for this site has stopped matching: "), "_ill", F.lit(" Teach this site again to point it at the right places."))
    return d.join(ill, scope, "left").select(scope, "n_products", "n_asked", "n_complete", "summary", note.alias("profile_note"))


def parse_answers(raw: DataFrame) -> DataFrame:
    """raw (text) with answer: the JSON object of a model's answer as it is, else within a fence, else between its outermost braces."""
    text = F.trim("text")
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = [F.when(F.startswith(F.schema_of_variant(F.try_parse_json(x)), F.lit("OBJECT")), F.try_parse_json(x)) for x in (text, fenced, braced)]
    return raw.withColumn("answer", F.coalesce(*found))


def countable_units(currency: Column) -> Column:
    """Whether a price of this currency needs a unit."""
    return F.upper(currency).isin("IRR", "IRT")
