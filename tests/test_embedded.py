"""Embedded state and collection answers: what is cut out, what counts as a product, and its fields."""

import json

from souklens.sources import embedded as E

PRODUCT = {"id": 1, "title": "Nuts", "handle": "nuts", "body_html": "<p>x</p>", "vendor": "V", "product_type": "Food", "tags": ["a", "b"], "images": [{"src": "/i.jpg"}, {"src": "/i.jpg"}], "options": [{"name": "Size", "values": ["250g", "1kg"]}], "variants": [
    {"option1": "250g", "sku": "N-250", "price": "8.50", "compare_at_price": "10.00", "available": True, "grams": 250, "featured_image": "/v.jpg"}, {"option1": "1kg", "sku": "N-1", "price": "29.00", "compare_at_price": None, "available": False, "grams": 0}]}
SINGLE = {"title": "Tea", "handle": "tea", "options": [{"name": "Title", "values": ["Default Title"]}], "variants": [{"option1": "Default Title", "price": "1.250", "compare_at_price": "1.00", "available": True}]}
FRONT = {"id": "g", "title": "Pistachios", "handle": "pist", "descriptionHtml": "<b>d</b>", "availableForSale": True, "priceRange": {"minVariantPrice": {"amount": "24.00", "currencyCode": "EUR"}}, "compareAtPriceRange": {"minVariantPrice": {"amount": "30.00", "currencyCode": "EUR"}}, "images": {"edges": [{"node": {"url": "/p.jpg"}}]}}


def script(value, name="__NEXT_DATA__"):
    return f'<script id="{name}" type="application/json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def rows(spark, *pages):
    df = spark.createDataFrame([(k if k != 3 else None, "https://s.example/c", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return sorted(E.read_embedded_state(E.embedded_states(df)).collect(), key=lambda r: (r.page_id or 0, r.pos, r.row))


def test_fields(spark):
    got = rows(spark, script({"collections": [{"title": "Nuts", "handle": "nuts", "id": "c"}], "products": [PRODUCT, SINGLE], "featured": {"edges": [{"node": FRONT}]}}))
    parent, small, large, tea, pist = got
    assert [r.kind for r in got] == ["variable", "variation", "variation", "simple", "simple"]
    assert (parent.source_url, parent.category_path, parent.tags, parent.images, parent.sku, parent.in_stock) == ("https://s.example/products/nuts", ["Food"], ["a", "b"], ["https://s.example/i.jpg"], None, None)
    assert [(a.name, a["values"], a.is_variation_axis) for a in parent.attributes] == [("Size", ["250g", "1kg"], True)]
    assert (small.regular.amount, small.sale.amount, small.weight.value, small.images, small.in_stock) == (10.0, 8.5, 250.0, ["https://s.example/v.jpg"], True)
    assert (large.regular.amount, large.sale, large.weight, large.in_stock, large.attributes[0]["values"]) == (29.0, None, None, False, ["1kg"])
    assert (tea.regular.amount, tea.sale, tea.attributes, tea.confidence) == (1.25, None, [], 1.0)
    assert (pist.regular.amount, pist.sale.amount, pist.sale.currency, pist.images, pist.description, pist.confidence, pist.in_stock) == (30.0, 24.0, "EUR", ["https://s.example/p.jpg"], "<b>d</b>", 0.8, True)


def test_where_state_is_found(spark):
    tile = {"name": "n", "slug": "s", "price": 3}
    text = json.dumps({"a": 'br } "{ace', "p": tile})
    assert [r.label for r in rows(spark, f"<script>window.__NUXT__ = {text}; x = {{</script>")] == ["window.__NUXT__"]
    assert rows(spark, f"<script>window.__NUXT__ = {text[:-1]}</script>", script("{broken"), script('{"p":{"name":"n","price":1}}'), script(""), script({"p": {"name": "n", "slug": "s"}})) == []
    assert [r.name for r in rows(spark, script('{"p":[{"name":"n","slug":"s","price":"5",},],}'), script([tile]) + script([{**tile, "slug": "t"}]))] == ["n", "n"]
    assert [r.currency for r in E.embedded_states(spark.createDataFrame([(1, "u", 'Shopify.currency = {"active":"CAD"}'), (None, None, None)], "page_id long, url string, html string")).collect()] == ["CAD", None]


def test_walk_has_bounds():
    deep = {"name": "n", "id": "i", "price": 1}
    for _ in range(14):
        deep = {"x": deep}
    assert len(E.product_nodes(deep)) == 1 and E.product_nodes({"x": deep}) == [] and len(E.product_nodes({"x": deep}, deepest=15)) == 1
    assert len(E.product_nodes([{"name": "n", "id": str(k), "price": 1} for k in range(30_000)])) == 20_000
    assert E.lenient_json("[" * 100_000) is None


def test_first_of_an_address_counts(spark):
    got = rows(spark, script([{**FRONT, "title": "a"}, {**FRONT, "title": "b"}]), "", "", script(FRONT), script(FRONT))
    assert [r.name for r in got] == ["a", "Pistachios", "Pistachios"]
    answers = spark.createDataFrame([("https://s.example/products.json", 2, json.dumps({"products": [{**SINGLE, "title": "later"}, {"title": " ", "variants": []}]})), ("https://s.example/products.json", 1, json.dumps({"products": [PRODUCT, SINGLE]})), ("https://s.example/", 3, "<html>"), (None, None, None)], "url string, seq int, body string")
    assert sorted((r.seq, r.pos, r.row, r.name) for r in E.read_collection_json(answers, default_currency="EUR").collect()) == [(1, 0, 0, "Nuts"), (1, 0, 1, "Nuts"), (1, 0, 2, "Nuts"), (1, 1, 0, "Tea")]
