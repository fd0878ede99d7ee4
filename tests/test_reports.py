"""Repeated rows and empty values in walks and coverage."""

from souklens.operators import reports as R


def test_repeated_pages_are_walked_once(spark):
    pages = spark.createDataFrame([("a", "b")] * 3 + [("b", "c")] * 2 + [("c", "a")], "url string, next_url string")
    seeds = spark.createDataFrame([("s", "a")] * 2, "seed string, url string")
    assert sorted((r.url, r.hop) for r in R.walk_pagination(pages, seeds).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_coverage_of_empty_values(spark):
    d = spark.createDataFrame([("n", [], 0.0), (" ", [], None)], "name string, images array<string>, price double")
    got = {r.field: (r.filled, r.total, r.reason) for r in R.field_coverage(d, ["name", "images", "price"]).collect()}
    assert got == {"name": (1, 2, "partial"), "images": (0, 2, "not-published"), "price": (1, 2, "partial")}
    assert [(r.filled, r.reason) for r in R.field_coverage(d.limit(0), ["name"]).collect()] == [(0, "not-published")]


def test_one_answer_a_product(spark):
    p = spark.createDataFrame([(1, ""), (2, "own"), (3, None), (None, None)], "product_key long, sku string")
    a = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.9), (1, " ", 1.0), (2, "x", 0.9), (None, "y", 0.9)], "product_key long, value string, confidence double")
    assert sorted((r.product_key or 0, r.sku or "", r.filled) for r in R.fill_empty(p, a, "sku").collect()) == [(0, "", False), (1, "a", True), (2, "own", False), (3, "", False)]


def test_scans_without_pages_or_products(spark):
    products = spark.createDataFrame([("a", "simple"), (None, "variation")], "scan_id string, kind string")
    pages = spark.createDataFrame([("b", None, True), ("c", "captcha", True), (None, None, False)], "scan_id string, block string, over_budget boolean")
    got = sorted((r.scan_id or "", r.rows, r.requests, r.status) for r in R.scan_summary(products, pages).collect())
    assert got == [("", 1, 1, "complete"), ("a", 1, 0, "complete"), ("b", 0, 1, "budget-reached"), ("c", 0, 1, "blocked")]


def test_unwanted_arrays_are_empty(spark):
    d = spark.createDataFrame([("n", ["t"], {"name": 0.9, "tags": 0.5})], "name string, tags array<string>, field_confidence map<string,double>")
    assert R.project_target_fields(d, ["name"], ["name", "tags"]).first().asDict() == {"name": "n", "tags": [], "field_confidence": {"name": 0.9}}


def test_variations_follow_by_sku_or_address(spark):
    rows = [(1, "simple", "A", None, "https://s.example/a"), (2, "grouped", None, None, "https://s.example/b"), (3, "variation", None, "A", "https://s.example/z"), (4, "variation", None, None, "https://s.example/a?utm_source=x"), (5, "variation", None, None, "https://s.example/b"), (6, "variation", None, "gone", "https://s.example/a")]
    d = spark.createDataFrame([(*r, []) for r in rows], "seq long, kind string, sku string, parent_sku string, source_url string, category_path array<string>")
    got = {r.seq: r.verdict for r in R.apply_catalog_filter(d, kinds=["simple"]).collect()}
    assert got == {1: "kept", 2: "filtered-kind", 3: "kept", 4: "kept", 5: "filtered-kind", 6: "filtered-orphan"}
    assert {r.code: r.n for r in R.filter_issues(R.apply_catalog_filter(d, kinds=["simple"]), kinds=["simple"]).collect()} == {"filtered-by-product-type": 1, "filtered-variations": 2}
