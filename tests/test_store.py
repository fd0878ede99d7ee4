"""Store answers in full: paths, terms, variations by id, units and what is told."""

import json

import pytest

from souklens.sources.store import read_store_api

SHOP = "https://www.nuts.example/wp-json/wc/store/v1/products"
EUR = {"currency_code": "EUR", "currency_minor_unit": 2, "currency_prefix": "", "currency_suffix": " €"}
TOMAN = {"currency_code": "IRR", "currency_minor_unit": 0, "currency_prefix": "", "currency_suffix": " تومان"}
SIMPLE = {"id": 101, "name": " Almond &nbsp;".replace("&nbsp;", " "), "type": "simple", "permalink": "/p/almond/?utm_source=x", "sku": "A", "description": "<p>d</p>", "short_description": "", "on_sale": True, "is_in_stock": True, "parent": 0, "prices": TOMAN | {"regular_price": "1000000", "sale_price": "920000", "price_range": None},
          "images": [{"src": "/a.jpg"}, {"src": "/a.jpg"}, {"src": None}], "categories": [{"id": 12, "name": "Nuts"}, {"id": 15, "name": "Almonds"}, {"id": 16, "name": "Pistachios"}], "tags": [{"name": "dry"}, {}], "brands": [{"name": "B"}], "attributes": [], "variations": []}
PARENT = {"id": 102, "name": "Pistachio", "type": "variable", "permalink": "https://nuts.example/p/pist/", "sku": "P", "is_in_stock": True, "prices": EUR | {"regular_price": "1800", "sale_price": "1800", "price_range": {"min_amount": "1800", "max_amount": "3450"}}, "categories": [{"id": 99, "name": "Gone"}],
          "attributes": [{"name": "Weight", "has_variations": True, "terms": [{"name": "500 g", "slug": "500-gram"}, {"name": "1 kg", "slug": "1-kilo"}]}, {"name": "Care", "terms": [{"name": "cool"}]}, {"name": "None", "terms": []}],
          "variations": [{"id": 501, "attributes": [{"name": "Weight", "value": "500-gram"}]}, {"id": 502, "attributes": [{"name": "Weight", "value": "odd  slug"}, {"name": "Care", "value": None}]}, {"id": 503, "attributes": [{"name": "Weight", "value": None}]}]}
KIDS = [{"id": k, "parent": 102, "type": "variation", "permalink": f"https://nuts.example/p/pist/?attribute_w={k}", "sku": f"P-{k}", "on_sale": False, "is_in_stock": k == 501, "prices": EUR | {"regular_price": str(k), "sale_price": "1"}, "attributes": [{"name": "Own", "terms": [{"name": "x"}]}]} for k in (501, 502, 503)]
TREE = [(12, 0, "Nuts"), (15, 12, "Almonds"), (16, 12, "Pistachios")]


def read(spark, *answers, tree=True, **more):
    rows = [(u, n, s, b if isinstance(b, str) or b is None else json.dumps(b)) for n, (u, s, b) in enumerate(answers)]
    t = spark.createDataFrame(TREE, "id long, parent long, name string") if tree else None
    products, issues = read_store_api(spark.createDataFrame(rows, "url string, seq long, status int, body string"), t, **more)
    return {(r.host, r.id): r for r in products.collect()}, sorted((i.code, i.source_url) for i in issues.collect())


def test_products_and_variations(spark):
    p, issues = read(spark, (SHOP, 200, [SIMPLE, PARENT]), (SHOP + "?page=2", 200, [SIMPLE | {"name": "Again"}]), (SHOP + "?type=variation&parent=102", 200, KIDS))
    h = "nuts.example"
    a, parent, small, odd, any_ = (p[h, k] for k in (101, 102, 501, 502, 503))
    assert (a["name"], a.source_url, a.category_path, a.images, a.tags, a.brand, a.description, a.short_description) == ("Almond", "https://www.nuts.example/p/almond", ["Nuts", "Almonds"], ["https://www.nuts.example/a.jpg"], ["dry"], "B", "<p>d</p>", None)
    assert (a.regular.amount, a.regular.unit, a.sale.amount) == (1000000.0, "toman", 920000.0)
    assert (parent.kind, parent.regular, parent.category_path, [(x.name, x["values"], x.is_variation_axis) for x in parent.attributes]) == ("variable", None, ["Gone"], [("Weight", ["500 g", "1 kg"], True), ("Care", ["cool"], False)])
    assert [(x.parent_sku, x.linked, x["name"], [(y.name, y["values"]) for y in x.attributes]) for x in (small, odd, any_)] == [("P", True, "Pistachio", [("Weight", ["500 g"])]), ("P", True, "Pistachio", [("Weight", ["odd slug"])]), ("P", True, "Pistachio", [("Own", ["x"])])]
    assert (small.regular.amount, small.sale, small.in_stock, odd.in_stock) == (5.01, None, True, False)
    assert issues == [("price-range-only", "https://nuts.example/p/pist")] and len(p) == 5


@pytest.mark.parametrize(("status", "body", "lost"), [(404, "<html>", True), (200, "no json", True), (200, "[]", False)])
def test_variations_that_did_not_come(spark, status, body, lost):
    p, issues = read(spark, (SHOP, 200, [PARENT]), (SHOP + "?parent=102&type=variation", status, body), tree=False)
    assert len(p) == 1 and (("variations-unavailable", "https://nuts.example/p/pist") in issues) == lost


def test_units_ids_and_other_stores(spark):
    irr = SIMPLE | {"prices": TOMAN | {"currency_suffix": "", "regular_price": "5", "sale_price": ""}}
    p, issues = read(spark, (SHOP, 200, [irr, {"name": "No id", "type": "grouped", "prices": EUR | {"regular_price": "", "sale_price": "50"}, "on_sale": True}]), ("https://other.example/x", 200, KIDS[:1]), (SHOP, 500, [PARENT]), (SHOP, 200, None), (SHOP, 200, "{}"), tree=False)
    assert [c for c, _ in issues] == ["price-unit-unknown"] and set(p) == {("nuts.example", 101), ("nuts.example", None), ("other.example", 501)}
    none, kid = p["nuts.example", None], p["other.example", 501]
    assert (none.kind, none.regular.amount, none.sale, none.in_stock, none.category_path) == ("simple", 0.5, None, False, []) and (kid.linked, kid.parent_sku) == (False, None)
    assert p["nuts.example", 101].category_path == ["Nuts"]
    assert read(spark, (SHOP, 200, [irr]), default_unit="rial")[1] == []


def test_empty(spark):
    assert read(spark, (SHOP, 200, "[]")) == ({}, [])
