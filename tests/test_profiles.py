"""Selectors and profiles, against worked examples and a walk over the tree."""

import random

import pytest

from souklens.functions.selectors import Matcher, parse_selector
from souklens.sources import profiles as P
from souklens.sources.markup import PageTree

PAGE = """<div id=a class="x y"><p>1<p class=x lang=en-GB>2<ul><li>a<li class=x>b<li><b class=x>c</b></ul></div><div data-u="/p/1.jpg"><p>3</p><span>s</span><p>4</p></div><P CLASS=x>5</P>"""


def found(selector, page=PAGE):
    m = Matcher(PageTree(page))
    return [m.tree.text_of(n) for n in m.find(selector)]


@pytest.mark.parametrize(("selector", "texts"), [
    ("p.x", ["2abc", "5"]), ("#a > p", ["1", "2abc"]), ("div p", ["1", "2abc", "3", "4"]), ("ul > li:nth-of-type(2)", ["b"]), ("li:nth-child(odd)", ["a", "c"]), ("li:last-child b", ["c"]), ("p:nth-of-type(2)", ["2abc", "4"]), ("[data-u$='.jpg'] span + p", ["4"]),
    ("p ~ p", ["2abc", "4"]), ("li:not(.x)", ["a", "c"]), ("b.x, span", ["c", "s"]), ("[lang|=en]", ["2abc"]), ("[class~=y] li.x", ["b"]), ("*[data-u^='/p']  >  span", ["s"]), ("[data-u*='P/1' i] p:first-of-type", ["3"]), ("div > div", []), ("li:only-child", []), ("li:nth-child(-n+2)", ["a", "b"]),
])
def test_selectors(selector, texts):
    assert found(selector) == texts


@pytest.mark.parametrize("selector", ["", "ul[", "p >", "a::before", "p:hover", ", p", "p..x", ":nth-child(x)"])
def test_no_selector(selector):
    with pytest.raises(ValueError):
        parse_selector(selector)


def test_chains_equal_a_walk():
    """Descendants and children against every element's path upwards."""
    r = random.Random(2)
    for _ in range(60):
        page = "".join(r.choice(["<div class=a>", "<div class=b>", "<i class=a>", "</div>", "</i>", "t"]) for _ in range(80))
        m = Matcher(PageTree(page))
        chain = [r.choice([".a", ".b", "div", "i"]) for _ in range(3)]
        links = [r.choice([" ", " > "]) for _ in range(2)]
        fits = lambda n, c: c[1:] in m.tree.nodes[n][4].get("class", "").split() if c[0] == "." else m.tree.nodes[n][3] == c

        def holds(n, k):
            if not fits(n, chain[k]):
                return False
            up = m.tree.nodes[n][1]
            if k == 0:
                return True
            while up is not None:
                if holds(up, k - 1):
                    return True
                if links[k - 1] == " > ":
                    return False
                up = m.tree.nodes[up][1]
            return False

        assert m.find(chain[0] + links[0] + chain[1] + links[1] + chain[2]) == [n for n in range(len(m.tree.nodes)) if holds(n, 2)]


def test_texts_are_slices_and_bad_markup_is_read():
    page = "a<div>b<p>c<b>d</b>e<p>f</div>g<![foo[ <i>h</i> ]]><![ x>j<!--k--><div>l"
    t = PageTree(page)
    assert [t.text_of(n) for n in range(len(t.nodes))] == ["bcdef", "cde", "d", "f", "l"]
    big = PageTree("<div>" + "<span>x</span>" * 20_000 + "</div>")
    assert sum(len(big.text_of(n)) for n in range(len(big.nodes))) == 40_000


RULES = {"name": ("h3", "text", None), "url": ("a", "attribute", "href"), "image": ("img", "attribute", "src"), "regularPrice": (".p", "text", None), "availability": (".s", "text", None)}


def profile(spark, container=".card", rules=RULES, domain="shop.example"):
    return spark.createDataFrame([(1, domain, container, {k: {"selector": s, "from": f, "attribute": a} for k, (s, f, a) in rules.items()})], f"profile_id long, domain string, container string, fields map<string,{P.RULE}>")


def test_cards_are_read(spark):
    page = '<div class=card><h3> گردو <i>۵۰۰</i></h3><a href="/w?utm_source=a">x</a><img src="i.jpg"><u class=p>۱٬۵۰۰٬۰۰۰ تومان</u><u class=s>InStock</u></div><div class=card><h3>b</h3><a href="javascript:x">x</a><u class=p>none</u></div><div class=card><h3> </h3></div>'
    pages = spark.createDataFrame([(None, "https://www.shop.example/c", page), (7, "https://shop.example/", None), (7, "https://nobody.example/", page), (8, None, page)], "page_id long, url string, html string")
    products, issues = P.extract_with_profiles(pages, profile(spark), default_unit="toman")
    a, b = sorted(products.collect(), key=lambda r: r.card)
    assert (a.name, a.source_url, a.images, a.in_stock) == ("گردو ۵۰۰", "https://www.shop.example/w", ["https://www.shop.example/i.jpg"], True)
    assert (a.regular.amount, a.regular.currency, a.regular.unit, a.sale) == (1500000.0, "IRR", "toman", None)
    assert (b.name, b.source_url, b.regular, b.field_confidence) == ("b", "https://www.shop.example/c", None, {"name": 0.4, "kind": 0.4})
    assert sorted((r.page_id or 0, r.code) for r in issues.collect()) == [(0, "profile-nameless-cards"), (7, "profile-container-missed")]


def test_only_rules_that_miss_all_cards_are_issues(spark):
    page = "<li class=card><h3>a</h3><b class=old>9</b></li><li class=card><h3>b</h3></li>"
    pages = spark.createDataFrame([(1, "https://shop.example/", page)], "page_id long, url string, html string")
    p = profile(spark, rules={"name": ("h3", "text", None), "salePrice": (".old", "text", None), "sku": (".nope", "text", None)})
    matched = P.match_profiles(pages, p)
    assert [(r.code, r.field) for r in P.profile_issues(matched).collect()] == [("profile-field-missed", "sku")]
    (h,) = P.profile_health(matched, p).collect()
    assert (h.cards, h.broken, h.partial, h.healthy) == (2, ["sku"], ["salePrice"], False)
    (h,) = P.profile_health(P.match_profiles(pages, q := profile(spark, rules={"name": ("h3", "text", None)})), q).collect()
    assert h.healthy and h.broken == h.partial == []


def test_many_hosts_meet_by_join(spark):
    pages = spark.createDataFrame([(k, f"https://h{k % 3}.example/", "<p class=card><h3>n</h3>") for k in range(9)], "page_id long, url string, html string")
    p = profile(spark, container="h3", domain="h1.example", rules={"name": ("h3", "text", None)}).unionByName(profile(spark, container="body, p", domain="h2.example"))
    both = [sorted(tuple(r)[:3] for r in P.match_profiles(pages, p, most=m).collect()) for m in (0, 10)]
    assert both[0] == both[1] and len(both[0]) == 6


def test_profiles_say_what_is_wrong(spark):
    docs = spark.createDataFrame([(1, P.profile_text({"version": 1, "domain": "d", "card": {"container": "li", "fields": {"name": {"selector": "b", "from": "text"}, "bogus": {"selector": "b", "from": "text"}, "sku": {"selector": " ", "from": "json"}}}, "pagination": {}})), (2, None)], "profile_id long, json string")
    got = {r.profile_id: sorted(r.violations) for r in P.read_profiles(docs).collect()}
    assert got == {1: ["from", "pagination", "selector", "unknown field bogus"], 2: ["container", "domain", "json", "name", "version"]}
