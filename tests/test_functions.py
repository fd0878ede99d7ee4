"""Worked examples of the expressions and of order-dependent operators, as small tables."""

import random

from pyspark.sql import functions as F

from souklens.functions import numbers as N, text as T
from souklens.operators import export as X, keys as K, reports as R, resolve as V
from souklens.sources import api as A, markup as M


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_numbers(spark):
    got = one(spark, ["1,234.56", "1.234,56", "1 234,5", "۱۲۳٬۴۵۶", "1,234", "0.500", "12.34.56", "no", None, "1'234'567", "$ 5."], N.parse_number)
    assert [(x.value, x.ambiguous) for x in got] == [(1234.56, False), (1234.56, False), (12345.0, False), (123456.0, True), (1234.0, True), (0.5, False), (123456.0, False), (None, False), (None, False), (1234567.0, False), (5.0, False)]
    # a blank between digits groups like a comma, so one more comma makes it a repeated separator
    got = one(spark, [".5", "$ .99", "12 50", "-1,5", "007,123", "0,123", "-", "٫۵"], N.parse_number)
    assert [(x.value, x.ambiguous) for x in got] == [(0.5, False), (0.99, False), (12.5, False), (-1.5, False), (7123.0, True), (0.123, False), (None, False), (0.5, False)]
    assert one(spark, [9.3e15, 1e22, 1.005, -0.0, float("nan")], N.format_decimal, "double") == ["9300000000000000", "10000000000000000000000", "1.005", "0", ""]
    assert [x.value for x in one(spark, ["1,234", "1.500 kg"], lambda c: N.parse_number(c, "decimal"))] == [1.234, 1.5]
    assert one(spark, [1.0, 1.5, 0.1 + 0.2, None, 1234567.0], N.format_decimal, "double") == ["1", "1.5", "0.3", "", "1234567"]


def test_money(spark):
    got = one(spark, ["IRR ۱۵۰٬۰۰۰ تومان", "100 rial", "country 5", "€ 3,50", "7", "none"], lambda c: N.parse_money(c, "USD", "toman"))
    assert [x and (x.amount, x.currency, x.unit) for x in got] == [(150000.0, "IRR", "toman"), (100.0, "IRR", "rial"), (5.0, "USD", None), (3.5, "EUR", None), (7.0, "USD", None), None]
    m = one(spark, ["1.5 kg", "۵۰۰ گرم", '5"', "12", "3 parsec"], N.read_measure)
    assert [x and (x.value, x.unit) for x in m] == [(1.5, "kg"), (500.0, "g"), (5.0, "in"), None, None]
    assert one(spark, ["https://schema.org/InStock", "Pre-Order", "sold out", "maybe"], N.availability) == [True, True, False, None]


def test_text_and_urls(spark):
    assert one(spark, [" a​ b\t\n", "می‌خواهم"], T.clean_text) == ["a b", "می‌خواهم"]
    assert one(spark, ["كتابي", "KeTaB"], T.fold_for_compare) == ["کتابی", "ketab"]
    assert one(spark, ["abc"], T.short_hash) == ["vf0fasx6"]
    urls = ["HTTPS://Shop.com:443/a/?b=2&utm_source=x&a=1#f", "http://x.com", "http://x.com/p/?ref=1", " not a url "]
    once = one(spark, urls, T.canonical_url)
    assert once == ["https://shop.com/a?a=1&b=2", "http://x.com/", "http://x.com/p", "not a url"] and one(spark, once, T.canonical_url) == once
    assert one(spark, ["http://x/c/page/3/", "http://x/?paged=7", "http://x/", "http://x/?offset_page=4", "http://x/PAGE/3", "http://x/%D8%B5%D9%81%D8%AD%D9%87/7/", "http://x/?page=a&page=5"], T.page_number) == [3, 7, None, 4, 3, 7, None]
    same = one(spark, ["http://x.com/کتاب/?b=ک&a=%20x", "http://x.com/%DA%A9%D8%AA%D8%A7%D8%A8?a=+x&b=%DA%A9", "https://x.com/a/../b/./c d", "http://x.com?x"], T.canonical_url)
    assert same == ["http://x.com/%DA%A9%D8%AA%D8%A7%D8%A8?a=+x&b=%DA%A9"] * 2 + ["https://x.com/b/c%20d", "http://x.com/?x="]
    base = F.lit("https://shop.com/a/b.html?q=1")
    links = ["c", "../c", "/x", "//h.com/y", "?z=1", "#f", "mailto:a@b", "http://q.com", ""]
    assert one(spark, links, lambda c: T.resolve_url(c, base)) == ["https://shop.com/a/c", "https://shop.com/c", "https://shop.com/x", "https://h.com/y", "https://shop.com/a/b.html?z=1", "https://shop.com/a/b.html?q=1#f", "mailto:a@b", "http://q.com/", "https://shop.com/a/b.html?q=1"]
    assert one(spark, links, lambda c: T.resolve_url(c, base, only_http=True))[6] is None
    assert one(spark, ["کتاب", "Ab c"], lambda c: T.slugify(c, True, 10)) == one(spark, ["کتاب"], lambda c: T.short_hash(c, 10)) + ["ab-c"]
    assert one(spark, ["a,b", 'say "x"', "plain", None, "=1"], lambda c: T.csv_field(c, guard=True)) == ['"a,b"', '"say ""x"""', "plain", "", "'=1"]


def test_unique_keys_follow_the_order(spark):
    def greedy(values, fold=str.lower):
        taken, out = set(), []
        for v in values:
            k, n = 1, v
            while fold(n) in taken:
                k += 1
                n = f"{v}-{k}"
            taken.add(fold(n))
            out.append(n)
        return out

    r = random.Random(2)
    values = ["DUP", "DUP", "dup", "X", "X", "X-2", "X-2", "A-1", "A-1-1"] + [r.choice(["P", "P-2", "P-2-2", "q", "Q-10", "z-1-2"]) for _ in range(60)]
    for parts in (1, 7):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "seq long, c string").repartition(parts)
        assert [x.unique for x in K.unique_in_order(df, "c", fold_case=True).orderBy("seq").collect()] == greedy(values)
        assert [x.unique for x in K.unique_in_order(df, "c").orderBy("seq").collect()] == greedy(values, str)


def test_skus_of_variations(spark):
    """A variation takes its parent's SKU and its values; the parent by stated SKU, else by address; case tells SKUs apart."""
    rows = [("simple", "A", None, "http://x/1", [], 1), ("simple", "a", None, "http://x/2", [], 2), ("variable", None, None, "http://x/3", [], 3), ("variation", None, "A", "http://x/1", ["Red", "XL"], 4), ("variation", None, None, "http://x/3/?utm_source=1", ["ب"], 5), ("variation", "own", None, "http://x/9", [], 6), ("variation", None, None, "http://x/9", [], 7), ("variation", None, "A", "http://x/1", ["red xl"], 8), ("variation", None, "A", "http://x/1", ["long " * 20], 9)]
    df = spark.createDataFrame(rows, "kind string, sku string, parent_sku string, source_url string, attribute_values array<string>, seq long")
    got = {r.seq: (r.sku_out, r.parent_sku) for r in K.assign_skus(df).collect()}
    h = lambda t, n=8: one(spark, [t], lambda c: T.short_hash(c, n))[0]
    p3, p9 = "P123-" + h("http://x/3"), "P123-" + h("http://x/9")
    assert got == {1: ("A", None), 2: ("a", None), 3: (p3, None), 4: ("A-red-xl", "A"), 5: (p3 + "-ب", p3), 6: ("own", None), 7: (f"{p9}-{h(p9, 6)}", None), 8: ("A-red-xl-2", "A"), 9: (f"A-{('long-' * 20)[:33]}-{h(('long ' * 20).strip(), 6)}", "A")}


def test_products_found_by_their_sku(spark):
    """Sightings in order: a new address whose SKU was seen joins that product; variations never do."""
    rows = [("u1", "simple", "S", 1), ("u2", "simple", None, 2), ("u3", "simple", "s ", 3), ("u2", "simple", "S", 4), ("u3", "simple", "T", 5), ("u4", "simple", "T", 6), ("u5", "variation", "S", 7), ("u6", "simple", "Q", 8)]
    df = spark.createDataFrame([("http://x/" + u, k, s, n, f"n{n}") for u, k, s, n in rows], "url string, kind string, sku string, seq long, name string").withColumn("attributes", F.lit(None).cast("array<struct<name:string,values:array<string>,is_variation_axis:boolean>>"))
    got = sorted((r.product_key, r.first_seq, r.duplicates) for r in V.dedupe_products(df, ["name"]).collect())
    # u3 is folded into u1 at first; when it comes with another SKU it has no product of its own yet, so it starts one, and u4 joins it
    assert got == [("http://x/u1", 1, 1), ("http://x/u2", 2, 1), ("http://x/u3", 5, 1), ("http://x/u5#s", 7, 0), ("http://x/u6", 8, 0)]


def test_category_trees_deeper_than_any_bound(spark):
    tree = spark.createDataFrame([(k, k - 1, f"c{k}") for k in range(1, 41)] + [(90, 91, "x"), (91, 90, "y")], "id long, parent long, name string")
    of = spark.createDataFrame([(1, 40, 0, "c40"), (1, 2, 1, "c2"), (2, 777, 0, "gone"), (3, 90, 0, "x")], "product_id long, term long, pos int, name string")
    got = {r.product_id: r.category_path for r in V.category_paths(of, tree).collect()}
    assert got == {1: [f"c{k}" for k in range(1, 41)], 2: ["gone"], 3: ["x"]}


def test_broken_sitemaps(spark):
    docs = [(1, "<urlset><url><loc> /a?x=1&amp;y=2 </loc><lastmod>2020</lastmod></url><url><loc>http://s/b</loc></url><url><loc>http://s/b</loc></url><url><loc>mailto:x</loc></url></urlset>"), (2, "<sitemapindex><sitemap><loc><![CDATA[http://s/c.xml]]></loc></sitemap><<<"), (3, "<html>error"), (4, None)]
    df = spark.createDataFrame([(k, x, "http://s/d/") for k, x in docs], "doc_id long, xml string, base_url string")
    urls = A.sitemap_urls(df)
    assert sorted(tuple(r) for r in urls.select("doc_id", "kind", "loc").collect()) == [(1, "url", "http://s/a?x=1&y=2"), (1, "url", "http://s/b"), (2, "sitemap", "http://s/c.xml")]
    assert sorted(r.doc_id for r in A.sitemap_issues(df, urls).collect()) == [3, 4]


def test_blocks_and_answers(spark):
    df = spark.createDataFrame([(1, 200, {"CF-Mitigated": "Challenge"}, ""), (2, 200, {"cf-mitigated": "no"}, "x"), (3, 503, {}, "<title>Just a moment...</title>"), (4, 403, {}, "h-captcha"), (5, 403, {}, ""), (6, 404, {}, "")], "k int, status int, headers map<string,string>, body string")
    assert {r.k: (r.block, r.evidence) for r in R.detect_blocks(df).collect()} == {1: ("captcha", "cf-mitigated: challenge"), 2: (None, None), 3: ("captcha", 'Cloudflare "Just a moment..." interstitial'), 4: ("captcha", "hCaptcha widget"), 5: ("forbidden", "HTTP 403"), 6: (None, None)}
    sent = spark.createDataFrame([(1, "قیمت ۱٬۲۵۰٬۰۰۰ تومان <img src=/a/b.jpg> Red Shoe")], "request_id long, fragment string")
    asked = [("regular", "1250000.00", True), ("regular", "12500000", True), ("regular", "125000", True), ("regular", "999", False), ("regular", "7", True), ("regular", "0", False), ("regular", "x", False), ("images", "https://s/a/b.jpg?v=1", True), ("images", "data:x", False), ("images", "/zz.jpg", False), ("brand", " RED  shoe", True), ("brand", "blue", False), ("name", "anything", True), ("name", "n" * 501, False), ("description", "d" * 8000, True)]
    a = spark.createDataFrame([(1, f, v, k) for k, (f, v, _) in enumerate(asked)] + [(2, "brand", "red", 99)], "request_id long, field string, value string, k int")
    got = {r.k: r.present for r in R.verify_answers(a, sent).collect()}
    assert got == {k: ok for k, (_, _, ok) in enumerate(asked)} | {99: False}


def test_more_rules_than_a_block(spark):
    pages = spark.createDataFrame([(1, "needle-1200 needle-3"), (2, "none")], "page_id long, html string")
    rules = spark.createDataFrame([("t", k, f"l{k}", f"needle-{k} " if k == 3 else f"needle-{k}", 0.4) for k in range(0, 10_001)], "target string, rule_no int, label string, needle string, weight double")
    got = {r.page_id: r.labels for r in R.score_signals(pages, rules).collect()}
    assert got == {1: ["l1", "l12", "l120", "l1200"]}


def test_secrets(spark):
    df = spark.createDataFrame([('{"apiKey":"s","keyboard":"k","monkey":"m","x-token":"t","list":[1,"a"],"o":{"token":"x","y":"z"},"long":"' + "x" * 600 + '"}',)], "j string")
    got = df.select(T.redact_values(F.parse_json("j")).alias("m")).collect()[0].m
    assert got == {"apiKey": "[redacted]", "keyboard": "k", "monkey": "m", "x-token": "[redacted]", "list": '["1","a"]', "o": '{"token":"[redacted]","y":"z"}', "long": "[600 chars]"}


def test_resolution(spark):
    claims = spark.createDataFrame([("p", "name", "b", 0.5, 2), ("p", "name", "a", 0.9, 3), ("p", "name", "c", 0.9, 4), ("p", "brand", " ", 1.0, 1), ("p", "stock", "0", 0.1, 9)], "product_key string, field string, value string, confidence double, seq long").withColumn("source", F.lit("s"))
    assert sorted((r.field, r.value) for r in V.resolve_claims(claims).collect()) == [("name", "a"), ("stock", "0")]
    rows = spark.createDataFrame([("simple", "S1", None, "http://a/x", 1), ("variation", "v1", "S1", "http://b/", 2), ("variation", "v2", None, "http://a/x/?utm_source=1", 3), ("variation", "v3", "nope", "http://zz/", 4)], "kind string, sku string, parent_sku string, source_url string, seq long")
    linked = V.link_variations(rows)
    assert sorted((r.sku, r.parent_key) for r in linked.collect()) == [("v1", "S1"), ("v2", "S1"), ("v3", None)]
    kept, issues = V.orphan_variations(linked)
    assert kept.count() == 2 and issues.collect()[0].sku == "v3"


def test_jsonld_guards(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"n","offers":{"price":"1,5","priceCurrency":"EUR"}},]}</script><script type="application/ld+json">{broken</script><script type="APPLICATION/LD+JSON; charset=utf-8">[{"@type":"https://schema.org/Product","name":"m"},{"@type":"Thing","name":"t"}]</script>'
    blocks = M.jsonld_blocks(M.dom_nodes(spark.createDataFrame([(1, page)], "page_id long, html string")))
    assert sorted(r.status for r in blocks.collect()) == ["invalid", "ok", "repaired"]
    assert sorted(r.product.name for r in M.jsonld_products(blocks).collect()) == ["m", "n"]


def test_jsonld_in_many_shapes(spark):
    """Lists of types, a brand as text or by reference, offers within offers and with objects inside."""
    page = '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Product"],"name":"a","brand":"plain","offers":{"seller":{"name":"x"},"price":3}},{"@type":"Product","name":"b","brand":{"@id":"#b"},"offers":{"@type":"AggregateOffer","offers":[{"price":"5"},{"price":"4","availability":"InStock"}]}},{"@id":"#b","name":"B"}]}</script>'
    blocks = M.jsonld_blocks(M.dom_nodes(spark.createDataFrame([(1, page)], "page_id long, html string")))
    got = {r.product.name: (r.product.brand.name, r.price, r.n_offers, r.in_stock) for r in M.offers_of(M.jsonld_products(blocks)).collect()}
    assert got == {"a": ("plain", 3.0, 1, None), "b": ("B", 4.0, 2, True)}


def test_reports_and_profiles(spark):
    paths = spark.createDataFrame([(1, ["Home", "Shoes", "Red"]), (2, ["Shoes"])], "k int, p array<string>")
    assert [r.x for r in paths.select("k", R.matches_category(F.col("p"), "shoes").alias("x")).orderBy("k").collect()] == [True, True]
    assert [r.x for r in paths.select("k", R.matches_category(F.col("p"), "home > shoes").alias("x")).orderBy("k").collect()] == [True, False]
    docs = spark.createDataFrame([(1, '{"version":1,"domain":"a.com","card":{"container":".c","fields":{"name":{"selector":"h2","from":"text"}}}}'), (2, '{"version":2,"card":{"fields":{"url":{"selector":"a","from":"attribute"}}}}'), (3, "{")], "profile_id long, json string")
    assert {r.profile_id: sorted(r.violations) for r in A.read_profiles(docs).collect()} == {1: [], 2: ["attribute", "container", "domain", "name", "version"], 3: ["container", "domain", "json", "name", "version"]}


def test_csv_is_ordered(spark):
    df = spark.createDataFrame([(k, f"n,{k}") for k in range(100)], "seq long, name string").repartition(7)
    assert [r.value for r in X.csv_lines(df, ["seq"]).collect()] == [f'"n,{k}"' for k in range(100)]


def test_microdata_far_below_its_item(spark):
    deep = lambda n, x: "<div>" * n + x + "</div>" * n
    pages = [(n, f"<div itemscope itemtype='Product'>{deep(n, '<span itemprop=name>n</span>')}</div>" + deep(3, "<b itemprop=lost>x</b>")) for n in (0, 11, 12, 30)]
    got = M.microdata_properties(M.dom_nodes(spark.createDataFrame(pages, "page_id long, html string"))).collect()
    assert sorted((r.page_id, r.type, r.prop, r.value) for r in got) == [(n, "Product", "name", "n") for n in (0, 11, 12, 30)]


def test_suffixes_of_repeated_rows(spark):
    """Rows of the same seq and candidate stay as many as they are, also where a candidate ends in a number."""
    df = spark.createDataFrame([(1, "X"), (1, "X"), (1, "X"), (2, "X-2"), (3, "x")], "seq long, c string")
    assert sorted(r.unique for r in K.unique_in_order(df, "c", fold_case=True).collect()) == ["X", "X-2", "X-2-2", "X-3", "x-4"]


def test_choose_layer(spark):
    from souklens.operators.detect import choose_layer

    rows = [
        (1, "api", 1, 0, False, False), (1, "api", 2, 5, False, None), (1, "markup", None, 9, None, None),  # a complete answer counts
        (2, "api", 1, 3, True, None), (2, "markup", None, 4, None, None),  # the page has strictly more
        (3, "api", 1, 3, True, None), (3, "markup", None, 3, None, None),  # a tie: the answer stays, incomplete
        (4, "api", 1, None, None, True), (4, "api", 2, 8, None, None), (4, "markup", None, 7, None, None),  # blocked: nothing
        (5, "api", 1, 2, None, None), (5, "api", 2, 8, None, True),  # blocked later: not reached
        (6, "markup", None, 0, None, None), (6, "profile", None, 2, None, None), (7, "profile", None, 0, None, None),
        (8, "api", None, 1, None, None), (8, "api", 3, 2, True, None), (8, "profile", None, 2, None, None), (8, "api", 3, 2, True, None),
        (None, "markup", None, 1, None, None),
    ]
    df = choose_layer(spark.createDataFrame(rows, "page_id long, layer string, seq int, n int, incomplete boolean, blocked boolean"))
    assert {tuple(r) for r in df.collect()} == {
        (1, "api", 2, 5, False, False), (2, "markup", None, 4, False, False), (3, "api", 1, 3, True, False), (4, "api", 1, 0, True, True),
        (5, "api", 1, 2, False, False), (6, "profile", None, 2, False, False), (7, "markup", None, 0, False, False), (8, "api", 3, 2, True, False),
        (None, "markup", None, 1, False, False),
    }
    assert choose_layer(df.limit(0)).count() == 0


def test_a_number_is_made_a_text_once(spark):
    """Its expression names the decimal once, however long the tests around it are."""
    from souklens.functions.numbers import format_decimal

    d = spark.range(1).select(format_decimal(F.col("id").cast("double")).alias("x"))
    assert d._jdf.queryExecution().analyzed().toString().lower().count("decimal(38,6)") == 1
    values = [None, -0.0, -1e-9, 0.1, 100.0, -1200.50, 1e22, 1e30, float("nan"), float("-inf")]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(format_decimal(F.col("v")).alias("x")).collect()]
    assert got == ["", "0", "0", "0.1", "100", "-1200.5", "10000000000000000000000", "1.0E30", "", ""]
