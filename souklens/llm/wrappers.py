"""Main text of web pages by wrappers inferred for each host.

A page becomes a tree of its block elements, with a slot for the text of each. The wrapper of a host is a union-free regular
expression over such trees: pages are folded in one after another, the children of matching elements are aligned, children
that one side lacks become optional, and runs of equal children (or of equal groups of up to four) become repeated. Pages of
a host mostly have a few shapes, so equal shapes are counted together where they are read, then folded in two steps (host
and salt, then host): a host of any size meets as its distinct shapes. The wrapper knows how many characters its slots hold,
and from that and the elements' names, which of its parts is the article. A host may have several templates: its shapes are
kept apart by the path of the article that each page alone would give, and those that the host's path does not fit get a path
of their own. Pages are then read through the paths of their host, and where none of them has text, through their own wrapper.
"""

from __future__ import annotations

import html
import json
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .blocks import hidden, one, settled
from .media_tiff import _bounded, _plus, _schema

TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|svg|iframe|select|math|object)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", regex.S | regex.I)
NAME = regex.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del img br input button video audio source track param picture area map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
STOPS = frozenset("ul ol dl table div article section main body".split())
OUT_TAGS = frozenset("nav footer aside form menu dialog head button header figcaption".split())
OUT_WORDS = regex.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adslot|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumb\w*|sidebar|side|footer|header|masthead|topbar|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|comment\w*|reply|replies|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|widget|pagination|pager|skip|copyright|legal)(?:$|[\s_-])", regex.I)
MAIN_WORDS = regex.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", regex.I)
# names that differ from page to page, but for those of a grid's columns
VOLATILE = regex.compile(r"^(?!(?:col|grid|span|row|cell|size|large|medium|small|[wmhp][trblxy]?)[-_]).*\d{2,}|^(?:post|postid|entry|article|item|node|page|story|content|id|p|t|comment)[-_]?\d+$", regex.I)
ONCE = frozenset("html body article main".split())
#: Elements nested deeper stand beside each other in the tree, each a block of its own, as browsers do at 512; nothing is left out.
DEPTH = 250
RELATED = regex.compile(r"^section\b.*(?:related|recommend)", regex.I)
#: Class words of parts that may yet be the article's: modifiers (post comments-open, layout with-sidebar, section related-work).
TALK = regex.compile(r"comment|repl(?:y|ies)|disqus|respond", regex.I)
OWN = frozenset("article post entry story hentry".split())


class Node:
    __slots__ = ("label", "kids", "chars", "links", "pages", "rep", "opt", "out", "parts")

    def __init__(self, label: str, out: bool = False):
        self.label, self.kids, self.chars, self.links, self.pages, self.rep, self.opt, self.out, self.parts = label, [], 0, 0, 1, False, False, out, []


def read_tree(page: str) -> Node:
    """The block elements of a page. parts: the page's text and children of an element in order; text as (text, in a link)."""
    root = Node("")
    stack, tags, link, open_ = [root], [""], 0, Counter()
    doubtful: list[tuple[Node, bool]] = []

    def close(k: int) -> None:
        for i in range(len(stack) - 1, k - 1, -1):
            open_[tags[i]] -= 1
            if stack[i] is stack[i - 1]:
                stack[i].parts.append(Node("div"))
        del stack[k:], tags[k:]

    for m in TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            stack[-1].parts.append((text, link > 0))
            continue
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() in ("select", "textarea"):
                stack[-1].parts.append((" ", False))
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                link = 0
            if tag in INLINE:
                continue
            k = next((i for i in range(len(tags) - 1, 0, -1) if tags[i] == tag), 0) if open_[tag] else 0
            if k:
                close(k)
                link = 0
            continue
        if tag in INLINE:
            if tag == "a":
                link = 1
            elif tag == "br":
                stack[-1].parts.append((" ", False))
            continue
        if tag in CLOSES_P and open_["p"]:
            close(len(tags) - 1 - tags[::-1].index("p"))
        for i in range(len(tags) - 1, 0, -1):
            if tags[i] in SIBLINGS.get(tag, ()):
                close(i)
                break
            if tags[i] in STOPS:
                break
        names = {a.lower(): b or c or d for a, b, c, d in NAME.findall(m[4])}
        words = f"{names.get('class', '')} {names.get('id', '')}".strip()
        inside = open_["article"] + open_["main"] > 0
        named = bool(words and OUT_WORDS.search(words))
        out = (tag in OUT_TAGS and not (tag in ("header", "figcaption") and inside)) or names.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        sure, out = out, out or named
        if tag in ("body", "html", "article", "main") and tag not in OUT_TAGS:
            sure, out = True, tag == "article" and bool(regex.search(r"comment|reply", words, regex.I)) and not OWN & set(words.split())
        classes, name = ([x for x in sorted(names.get("class", "").split()) if not VOLATILE.search(x)][:3], names.get("id", "")) if tag not in ONCE else ([], "")
        label = ".".join([tag, *classes]) + ("#" + name if name and not VOLATILE.search(name) else "")
        node = Node("main" if names.get("role") == "main" else label, out)
        if out and not sure:
            doubtful.append((node, bool(TALK.search(words)) and not OWN & set(words.split())))
        stack[-1].parts.append(node)
        if tag not in VOID:
            stack.append(node if len(stack) < DEPTH or (out and not stack[-1].out) else stack[-1])
            tags.append(tag)
            open_[tag] += 1
            link = 0
    if doubtful:
        _keep_articles(root, doubtful)
    return root


def _keep_articles(root: Node, doubtful: list[tuple[Node, bool]]) -> None:
    """A class word alone drops no part that holds most of the page's text, nor a part named as related in which most of the text
    isn't in links; what it encloses is judged on its own. doubtful: those parts and whether they are readers' talk, which is
    never kept for its size, unless it encloses most text within an element named article or main."""
    talk, asked = {id(n) for n, is_talk in doubtful if is_talk}, {id(n) for n, _ in doubtful}
    text: dict[int, tuple[int, int, int]] = {}  # characters outside of parts that go for sure; those in links; those in articles

    def add(n: Node, kids: list[Node]) -> None:
        own = [len(" ".join(p[0].split())) for p in n.parts if not isinstance(p, Node)]
        links = sum(c for c, p in zip(own, (p for p in n.parts if not isinstance(p, Node)), strict=True) if p[1])
        below = [text[id(k)] for k in kids if not (k.out and (id(k) not in asked or id(k) in talk)) or text[id(k)][2]]
        chars = sum(own) + sum(x[0] for x in below)
        held = chars if n.label.split(".")[0].split("#")[0] in ("article", "main") and not n.out else sum(x[2] for x in below)
        text[id(n)] = (chars, links + sum(x[1] for x in below), held)

    order, todo = [], [root]
    while todo:
        n = todo.pop()
        kids = [p for p in n.parts if isinstance(p, Node)]
        order.append((n, kids))
        todo += kids
    for n, kids in reversed(order):
        add(n, kids)
    every = text[id(root)][0]
    for n, is_talk in doubtful:
        chars, links, held = text[id(n)]
        most = 2 * (held if is_talk else chars - links) > every
        related = not is_talk and RELATED.search(n.label) and chars and 2 * links < chars
        if most or related:
            n.out = False


def shape_of(page: Node) -> Node:
    """A page's tree with text lengths and runs of equal children folded: the wrapper of this page alone."""
    out = Node(page.label, page.out)
    for part in page.parts:
        if isinstance(part, Node):
            out.kids.append(shape_of(part))
        else:
            n = len(part[0].strip())
            out.chars += n
            out.links += n if part[1] else 0
    out.kids = fold_runs(out.kids)
    return out


def key_of(n: Node) -> str:
    return n.label


def fold_runs(kids: list[Node]) -> list[Node]:
    """Runs of equal children, then of equal groups of 2 to 4, as one repeated child each."""
    for size in (1, 2, 3, 4):
        out, i = [], 0
        while i < len(kids):
            group = kids[i : i + size]
            names, j = [key_of(k) for k in group], i + size
            while len(group) == size and [key_of(k) for k in kids[j : j + size]] == names:
                for a, b in zip(group, kids[j : j + size], strict=True):
                    merge_into(a, b)
                j += size
            if j > i + size:
                if size == 1:
                    group[0].rep = True
                    out.append(group[0])
                else:
                    g = Node("()")
                    g.kids, g.rep = group, True
                    out.append(g)
                i = j
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return kids


def merge_into(a: Node, b: Node, pages: bool = False) -> None:
    """Aligns b with a: a becomes the wrapper of both. Children of one side only become optional."""
    a.chars, a.links, a.rep, a.opt, a.out = a.chars + b.chars, a.links + b.links, a.rep or b.rep, a.opt or b.opt, a.out and b.out
    if pages:
        a.pages += b.pages
    if not b.kids and not a.kids:
        return
    out = []
    for op, i, j, x, y in SequenceMatcher(None, [key_of(k) for k in a.kids], [key_of(k) for k in b.kids], autojunk=False).get_opcodes():
        if op == "equal":
            for p, q in zip(a.kids[i:j], b.kids[x:y], strict=True):
                merge_into(p, q, pages)
                out.append(p)
        else:
            for k in [*a.kids[i:j], *b.kids[x:y]]:
                k.opt = True
                out.append(k)
    a.kids = fold_runs(out) if any(key_of(p) == key_of(q) for p, q in zip(out, out[1:], strict=False)) else out


def pattern(n: Node) -> str:
    """The wrapper as a regular expression."""
    inner = ("#" if n.chars else "") + " ".join(pattern(k) for k in n.kids)
    body = (f"({inner})" if n.label == "()" else f"{n.label or 'page'}[{inner}]" if inner else n.label) + ("!" if n.out else "")
    return body + ("+" if n.rep else "") + ("?" if n.opt else "")


def dump(n: Node) -> list:
    return [n.label, n.chars, n.links, n.pages, int(n.rep) + 2 * int(n.opt) + 4 * int(n.out), [dump(k) for k in n.kids]]


def load(x: list) -> Node:
    n = Node(x[0], bool(x[4] & 4))
    n.chars, n.links, n.pages, n.rep, n.opt, n.kids = x[1], x[2], x[3], bool(x[4] & 1), bool(x[4] & 2), [load(k) for k in x[5]]
    return n


def article_of(wrapper: Node) -> str:
    """The path of the part that holds the article: the element named as one with most text, else as deep as most text stays together."""
    found: list[tuple[int, int, str]] = []
    total: dict[int, int] = {}

    def weigh(n: Node, path: str, depth: int, inside: bool) -> int:
        own = 0 if n.out else n.chars - n.links + sum(weigh(k, f"{path}/{k.label}" if k.label != "()" else path, depth + 1, inside or is_main(n)) for k in n.kids)
        total[id(n)] = own
        if is_main(n) and not n.out and not inside and own:
            found.append((own, -depth, path))
        return own

    def is_main(n: Node) -> bool:
        return n.label.split(".")[0].split("#")[0] in ("article", "main")

    all_ = weigh(wrapper, "", 0, False)
    if found and max(found)[0] * 5 >= all_:
        return max(found)[2]
    at, path = wrapper, ""
    while True:
        kids = [k for k in at.kids if not k.out and total.get(id(k), 0) * 10 >= 7 * max(all_, 1) and not (k.rep and k.label != "()")]
        if len(kids) != 1 or kids[0].label.split(".")[0] in ("p", "h1", "h2", "ul", "ol", "li", "table", "blockquote", "pre"):
            return path
        at = kids[0]
        path = path if at.label == "()" else f"{path}/{at.label}"


def blocks_of(page: Node, article: str) -> list[str]:
    """The texts of the article's blocks in page order: references decoded, white space to one blank, empty ones left out."""
    out: list[str] = []

    def flush(run: list[str]) -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    def walk(n: Node, path: str, inside: bool) -> None:
        inside = inside or path == article
        run: list[str] = []
        for part in n.parts:
            if not isinstance(part, Node):
                if inside:
                    run.append(part[0])
            else:
                flush(run)
                if not part.out:
                    walk(part, f"{path}/{part.label}", inside)
        flush(run)

    walk(page, "", False)
    return out


def _merged(shapes: list[str]) -> Node:
    wrapper = load(json.loads(shapes[0]))
    for shape in shapes[1:]:
        merge_into(wrapper, load(json.loads(shape)), pages=True)
    return wrapper


def _at(wrapper: Node, path: str) -> list[Node]:
    """The elements of a wrapper at a path, none of them left out."""
    found = [wrapper]
    for label in path.split("/")[1:]:
        kids = [k for n in found for k in n.kids]
        while any(k.label == "()" for k in kids):
            kids = [x for k in kids for x in (k.kids if k.label == "()" else [k])]
        found = [k for k in kids if k.label == label and not k.out]
    return found


def _fits(path: str, template: str, of: Node, wrapper: Node) -> bool:
    """Whether pages of a template (their wrapper: of) are read by the path found in the wrapper of more. Not so if they lack
    it, or if it only encloses their article: one that is named, or the part of a fifth of the pages that others lack."""
    if not _at(of, path):
        return False
    if template == path or not template.startswith(path + "/"):
        return True
    step = template[len(path) + 1 :].split("/")
    if any(x.split(".")[0] in ("article", "main") for x in step):
        return any(x.split(".")[0] in ("article", "main") for x in path.split("/"))
    part = _at(wrapper, f"{path}/{step[0]}")
    return not (of.pages > 1 and of.pages * 5 >= wrapper.pages and part and all(k.opt for k in part))


def articles_of(templates: dict[str, Node], wrapper: Node) -> list[tuple[str | None, str]]:
    """(template, path of its article) for all templates that the path of the whole wrapper does not fit; it comes first, as (None, path)."""
    path, rest = article_of(wrapper), dict(templates)
    out: list[tuple[str | None, str]] = [(None, path)]
    while True:
        left = {t: n for t, n in rest.items() if not _fits(path, t, n, wrapper)}
        out += [(t, path) for t in rest if t not in left and path != out[0][1]]
        if not left:
            return out
        if len(left) == len(rest) or len(left) == 1:  # each by the path that its pages have alone
            return out + [(t, t) for t in left]
        rest = left
        wrapper = _merged([json.dumps(dump(n)) for n in rest.values()])
        path = article_of(wrapper)


def _fold(pdf: pd.DataFrame, *, last: bool) -> pd.DataFrame:
    host = pdf["host"].iloc[0]
    if not last:
        return pd.DataFrame([{"host": host, "template": pdf["template"].iloc[0], "wrapper": json.dumps(dump(_merged(sorted(pdf["wrapper"]))))}])
    wrapper = _merged(sorted(pdf["wrapper"]))
    templates = {t: _merged(sorted(g)) for t, g in sorted(pdf.groupby("template")["wrapper"], key=lambda x: x[0])}
    row = {"host": host, "wrapper": json.dumps(dump(wrapper)), "pattern": pattern(wrapper), "article": article_of(wrapper), "pages": wrapper.pages}
    return pd.DataFrame([row | {"articles": json.dumps(articles_of(templates, wrapper))}])


def host_of(url):
    """Lower-cased host of a URL column; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, *, url: str = "url", page: str = "html") -> DataFrame:
    """One row per host: host, wrapper (as JSON), pattern, article (the path of its main part), pages, articles (JSON: that path
    and those of the templates that it does not fit)."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str, str], Node] = {}
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                n = shape_of(read_tree(text or ""))
                key = (host, article_of(n), pattern(n))
                if key in seen:
                    merge_into(seen[key], n, pages=True)
                else:
                    seen[key] = n
            yield pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in seen], pa.string()) for c in range(3)), pa.array([json.dumps(dump(n)) for n in seen.values()], pa.string())], names=["host", "template", "shape", "wrapper"])

    d = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("html"))
    rows = d.mapInArrow(shapes, "host string, template string, shape string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("shape", F.spark_partition_id()), F.lit(16)))
    part = rows.groupBy("host", "template", "salt").applyInPandas(one(_fold, last=False), "host string, template string, wrapper string")
    return part.groupBy("host").applyInPandas(one(_fold, last=True), "host string, wrapper string, pattern string, article string, pages long, articles string")


def main_blocks(page: Node, articles: list[tuple[str | None, str]]) -> list[str]:
    """The blocks of a page by its template's path, else by the host's; where that finds none, by the page's own wrapper."""
    paths, own = dict(articles), None
    if len(paths) > 1:
        own = article_of(shape_of(page))
    return blocks_of(page, paths.get(own, paths[None])) or blocks_of(page, article_of(shape_of(page)) if own is None else own)


def extract_main_text(pages: DataFrame, *, url: str = "url", page: str = "html", broadcast_mb: int = 32) -> DataFrame:
    """pages with text and n_chars (code points).

    Defined cases: a null or empty page has an empty text; a null or broken URL belongs to the host ''; a host of one page
    has the wrapper of that page, and so has a page on which its host's paths find no text; columns of the added names are replaced, others pass through; an empty table gives an
    empty table. The paths of the hosts' articles are broadcast only if they measure less than broadcast_mb; beyond that
    they are joined by host, each host dealt over 64 salts.
    """
    pages, (url, page), back = hidden(pages, url, page)
    found = settled(infer_wrappers(pages, url=url, page=page).select(F.col("host").alias("_host"), F.col("articles").alias("_article")))
    size = found.agg(F.sum(F.length("_host") + F.length("_article"))).first()[0] or 0
    d = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars"))).withColumn("_host", host_of(F.col(f"`{url}`")))
    if size <= broadcast_mb * 1_000_000:
        d = d.join(F.broadcast(found), "_host", "left")
    else:
        d = d.withColumn("_salt", F.pmod(F.xxhash64(F.col(f"`{page}`")), F.lit(64)).cast("int")).join(found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63)))), ["_host", "_salt"], "left").drop("_salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in _bounded(batches, page):
            known = {a: known.get(a) or (json.loads(a) if a else [(None, "")]) for a in set(batch.column("_article").to_pylist())}
            text = ["\n".join(main_blocks(read_tree(h or ""), known[a])) for h, a in zip(batch.column(page).to_pylist(), batch.column("_article").to_pylist(), strict=True)]
            yield _plus(batch, {"text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64())})

    return d.mapInArrow(run, _schema(d, {"text": T.StringType(), "n_chars": T.LongType()})).drop("_host", "_article").withColumnsRenamed(back)
