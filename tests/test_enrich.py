"""Trimmed fragments against a recursive reading of the tree, and requests for what is missing."""

import json
import random
import re

import pytest

from souklens.operators import enrich as E
from souklens.operators.reports import verify_answers
from souklens.sources.markup import PageTree

PAGE = """<!doctype html><html><head><script>var p = 777777;</script></head><body><header class="site-header"><a href="/">Shop</a></header><nav class="menu-main"><a href="/c">All</a></nav>
<div id="bread-Breadcrumbs"><a href="/c/nuts">Nuts</a></div><main><article class="product-detail a b c d e f g h i" data-product-id="42" style="x" onclick="y()"><h1>Wal  nut &amp; co</h1> <div class="price" data-gtm-id="z">150<br>EUR</div><img src="/w.jpg" alt=''>
<section class="Related-products">Almond 98</section></article></main><footer>(c)</footer></body></html>"""


def brute(html, max_chars, max_elements):
    """The rules again, by recursion over children and own texts."""
    tree = PageTree(html)
    texts = [[] for _ in tree.nodes]
    for at, (n, data) in enumerate(tree.stream):
        texts[n].append((at, data))
    left, out = [max_elements, max_chars], []

    def put(s):
        out.append(s)
        left[1] -= len(s)

    def go(n):
        tag, attrs = tree.nodes[n][3], tree.nodes[n][4]
        if left[0] <= 0 or left[1] <= 0 or not E._stays(tag, attrs):
            return
        left[0] -= 1
        put(E._opening(tag, attrs))
        kids, k = tree.children[n], 0
        for at, data in texts[n]:
            while k < len(kids) and tree.span[kids[k]][0] <= at:
                if left[1] <= 0:
                    break
                go(kids[k])
                k += 1
            if left[1] > 0 and data.strip():
                put(re.sub(r"\s+", " ", data)[: left[1]])
        while k < len(kids) and left[1] > 0:
            go(kids[k])
            k += 1
        put(f"</{tag}>")

    first = lambda s: next(iter(E.Matcher(tree).find(s)), None)
    root = next((first(s) for s in (*E.ROOTS, "body") if first(s) is not None), None)
    if root is None:
        return "", False
    trail = next((first(s) for s in E.TRAILS if first(s) is not None), None)
    if trail is not None and not root <= trail < tree.end[root]:
        go(trail)
    go(root)
    return re.sub(r"\s{2,}", " ", "".join(out)).strip(), left[0] <= 0 or left[1] <= 0


def test_fragment():
    html, root, truncated = E.trim_page(PAGE)
    assert (root, truncated) == (".product-detail", False)
    assert html == '<div id="bread-Breadcrumbs"><a href="/c/nuts">Nuts</a></div><article class="product-detail a b c d e f g" data-product-id="42"><h1>Wal nut & co</h1><div class="price">150<br></br>EUR</div><img src="/w.jpg" alt></img></article>'


def test_breadcrumbs_within_the_root_stand_once():
    html, root, _ = E.trim_page('<main><nav class="x breadcrumb">a</nav><nav>menu</nav><p>b</main>')
    assert (html, root) == ('<main><nav class="x breadcrumb">a</nav><p>b</p></main>', "main")


@pytest.mark.parametrize("html", ["", "text only", "<p>no body", "<![foo[x]]>"])
def test_nothing_to_ask_about(html):
    assert E.trim_page(html) == ("", "none", False)


def test_budgets():
    html, _, truncated = E.trim_page(f"<main><p>{'nut ' * 4000}</p><p>more</p></main>", 500)
    assert truncated and len(html) <= 520 and html.endswith("</p></main>")
    html, _, truncated = E.trim_page("<main><p>a</p>t<p>b</p>u</main>", 500, 2)
    assert (html, truncated) == ("<main><p>a</p>tu</main>", True)
    deep = "<div>" * 3000 + "x"
    assert E.trim_page(f"<body>{deep}")[2] and "x" in E.trim_page(f"<body>{deep}", 10**6, 10**6)[0]


def test_equal_to_recursion_on_random_pages():
    r = random.Random(5)
    bits = ["<div>", "<div class=related>", "<main>", "</div>", "<p>", "</p>", "</main>", "<nav>", "<nav class=breadcrumb>", "</nav>", "<br>", "<b id=product>", "</b>", "a  b", "\n", "text ", "<!-- c -->", "<script>x<y</script>", "<li data-price=3 data-x=4>", "<body>"]
    for _ in range(400):
        page, chars, elements = "".join(r.choice(bits) for _ in range(60)), r.choice([10, 40, 120, 10**6]), r.choice([1, 3, 10, 10**6])
        got = E.trim_page(page, chars, elements)
        assert (got[0], got[2]) == brute(page, chars, elements), page


def test_whole_pages_equal_recursion(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    want = {p.page_id: brute(p.html, E.MAX_CHARS, E.MAX_ELEMENTS) for p in pages.collect()}
    got = E.trim_fragments(pages).collect()
    assert len(got) == len(want) and all((g.html, g.truncated) == want[g.page_id] for g in got)


FIELDS = "page_id long, seq long, source_url string, kind string, name string, regular double, category_path array<string>, images array<string>, description string, in_stock boolean, attributes array<string>, lang string"
WANTED = ["name", "regular", "category_path", "images", "description", "in_stock", "attributes"]


def asked(spark, **more):
    full = ("N", 1.0, ["c"], ["i"], "d", True)
    rows = [
        (1, 1, "u1", "simple", "N", None, ["c"], [], "d", None, [], "fr"), (1, 2, "u2", "simple", " ", 1.0, ["c"], ["i"], "d", True, [], None), (1, 3, "u3", "simple", *full, [], None), (1, 4, "u4", "variation", None, None, None, None, None, None, None, None),
        (2, 5, "u5", "variable", *full, [], ""), (3, 6, "u6", "simple", None, *full[1:], [], None), (None, 7, "u7", "simple", None, *full[1:], [], None), (4, 8, "u8", "simple", None, *full[1:], [], None),
    ]
    fragments = [(1, "a", "<p>1"), (1, "b", "<p>0"), (2, "c", "<p>2"), (3, "d", ""), (None, "e", "<p>n")]
    return E.enrichment_requests(spark.createDataFrame(rows, FIELDS), spark.createDataFrame(fragments, "page_id long, source_url string, html string"), wanted=WANTED, locale="lang", **more)


def test_requests(spark):
    requests, issues = asked(spark)
    got = {r.source_url: r for r in requests.collect()}
    assert set(got) == {"u1", "u5"} and got["u1"].fragment == "<p>1" and got["u1"].fields == ["regular", "images", "in_stock"]
    schema = json.loads(got["u1"].schema)
    assert list(schema["properties"]) == schema["required"] == ["regular", "images", "in_stock", "stock_quantity"] and schema["additionalProperties"] is False
    assert all("null" in p["type"] for p in schema["properties"].values()) and schema["properties"]["regular"]["required"] == ["amount", "currency", "unit"]
    assert "Fields wanted: regular, images, in_stock.\n" in got["u1"].prompt and got["u1"].prompt.endswith("fr.") and got["u5"].prompt.endswith("attributes.")
    assert sorted((i.page_id or 0, i.code, i.n_products) for i in issues.collect()) == [(0, "no-fragment", 1), (1, "request-limit", 1), (3, "no-fragment", 1), (4, "no-fragment", 1)]
    assert json.loads({r.source_url: r.schema for r in asked(spark, dialect="nullable")[0].collect()}["u1"])["properties"]["regular"]["nullable"] is True


def test_more_requests_a_page_have_ids_of_their_own(spark):
    requests, issues = asked(spark, per_page=5)
    assert sorted((r.request_id, r.source_url) for r in requests.collect()) == [("1#1", "u1"), ("1#2", "u2"), ("2#1", "u5")]
    answers = spark.createDataFrame([("1#1", "regular", "1")], "request_id string, field string, value string")
    assert verify_answers(answers, requests).first().present and not issues.where("code = 'request-limit'").count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], FIELDS), spark.createDataFrame([], "page_id long, source_url string, html string")
    requests, issues = E.enrichment_requests(*none, wanted=WANTED)
    assert requests.count() == issues.count() == 0
    assert E.trim_fragments(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).collect()[0][2:] == ("", "none", False, 0)
