"""Detections stay with their page, whatever its id."""

from souklens.operators import detect as D, reports as R

SHOP, NEXT = '<meta name="generator" content="WooCommerce 9">', '<link rel="next" href="/c/page/9/">'
PAGES = [(1, "https://s.example/c/", SHOP + NEXT), (1, "https://s.example/d/", '<div id="shopify-digital-wallet">'), (None, "https://s.example/e/", SHOP), (None, None, None), (7, "https://s.example/f/", "<![foo[x]]><p>")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_platforms_of_pages_of_any_id(spark):
    d = D.detect_platforms(pages(spark))
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.page_id or 0, r.target, r.confidence, r.labels, r.adapter, r["rank"]) for r in d.collect())
    shop = (0.6, ["generator meta names WooCommerce"], True, 1)
    assert got == [(0, "unknown", 0.0, [], False, 1), (0, "woocommerce", *shop), (1, "shopify", 0.6, ["shopify-digital-wallet meta"], True, 1), (1, "woocommerce", *shop), (7, "unknown", 0.0, [], False, 1)]


def test_pagination_of_pages_of_any_id(spark):
    d = D.detect_pagination(pages(spark))
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.page_id or 0, r.strategy, r.next_url or "") for r in d.collect())
    assert got == [(0, "none", ""), (0, "none", ""), (1, "none", ""), (1, "rel-next", "https://s.example/c/page/9"), (7, "none", "")]


def test_signals_of_pages_of_any_id(spark):
    rules = spark.createDataFrame([("a", 2, "wool", "woo", 0.2), ("a", 1, "gen", "generator", 0.3), ("b", 1, "div", "<div", 0.9), ("c", 1, "none", "zzz", 0.9)], "target string, rule_no int, label string, needle string, weight double")
    d = R.score_signals(pages(spark), rules)
    assert sorted((r.page_id or 0, r.target, r.confidence, r.labels) for r in d.collect()) == [(0, "a", 0.5, ["gen", "wool"]), (1, "a", 0.5, ["gen", "wool"]), (1, "b", 0.9, ["div"])]
