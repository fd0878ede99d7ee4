"""Whole pages: ids say nothing, and markup may be anything."""

from souklens.sources import structured as S

PRODUCT = '<script type="application/ld+json">{"@type":"Product","name":"N%d","url":"/p/%d","offers":{"price":"%d","priceCurrency":"EUR"}}</script>'
PAGES = [
    (1, "https://s.example/a", PRODUCT % (1, 1, 5)), (1, "https://s.example/b", PRODUCT % (2, 2, 6) + PRODUCT % (3, 1, 7)), (None, "https://s.example/c", PRODUCT % (4, 4, 8) + "<![foo[x]]><p>"), (None, None, PRODUCT % (5, 5, 9)), (7, "https://s.example/d", None),
    (8, "https://s.example/e", '<div itemscope itemtype="Product"><a itemprop="url" href="http://[bad">x</a><b itemprop="name">M</b></div><![ x'),
]


def test_pages_of_any_id(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    read = S.extract_pages(pages)
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.page_id or 0, r.url or "", [p.name for p in r.products], [i.code for i in r.issues]) for r in read.collect())
    assert got == [(0, "", ["N5"], []), (0, "https://s.example/c", ["N4"], []), (1, "https://s.example/a", ["N1"], []), (1, "https://s.example/b", ["N2", "N3"], []), (7, "https://s.example/d", [], ["no-structured-data"]), (8, "https://s.example/e", ["M"], [])]
