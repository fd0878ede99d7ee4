"""The parse of pages: plain tags take a short path, whose elements are those of the general parser."""

from html.parser import HTMLParser

import pytest

from souklens.sources.markup import PageTree


class General(PageTree):
    parse_starttag, parse_endtag, updatepos = HTMLParser.parse_starttag, HTMLParser.parse_endtag, HTMLParser.updatepos


def told(kind: type[PageTree], html: str) -> tuple:
    tree = kind(html)
    return tree.nodes, tree.children, tree.ids, [tree.text_of(n) for n in range(len(tree.nodes))]


def test_plain_tags_do_not_take_the_general_path(monkeypatch):
    seen = []
    general, end = HTMLParser.parse_starttag, HTMLParser.parse_endtag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: seen.append(self.rawdata[i : i + 6]) or general(self, i))
    monkeypatch.setattr(HTMLParser, "parse_endtag", lambda self, i: seen.append(self.rawdata[i : i + 6]) or end(self, i))
    tree = PageTree('<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name">a &amp; b</h1><meta content="x>y" itemprop="brand"></div><b title="a&amp;b">c</b>')
    assert seen == ["<b tit"] and [n[4] for n in tree.nodes] == [{"itemscope": "", "itemtype": "https://schema.org/Product"}, {"itemprop": "name"}, {"content": "x>y", "itemprop": "brand"}, {"title": "a&b"}]


@pytest.mark.parametrize("html", [
    '<script type="application/ld+json">{"a":"<b></b>"}</script><b>x</b>', '<title><i>a</i></title><style>a</b>{}</style>c', '<textarea><b a="1"></textarea></b>', "<scripty a=\"1\"><b></scripty>", '<b a="1"b="2"  c=\'3\' d=4 e>x</b >',
    '<b a="1" a="2" A="3">x</B>', '<a href="x>y" b="">t</a', '<b a=""">x</b>', '<b a="c&d" e="&amp;">x</b x="y">', '<br/><img src="i" />x', "<svg:g><x-y a:b=\"1\">z</x-y>", '<b a="\n<p>\x00">x</b></>', "</ b>a<![x]>b<!-- <b> -->c<?p?>d", "<p>a<p>b<li>c<li>d",
])
def test_both_paths_read_the_same(html):
    assert told(PageTree, html) == told(General, html)
