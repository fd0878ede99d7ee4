import html
import random

from souklens.llm.wrappers import article_of, blocks_of, extract_main_text, infer_wrappers, merge_into, pattern, read_tree, shape_of


def page(k, blocks, named=True):
    menu = "".join(f"<li><a href='/{i}'>m{i}</a></li>" for i in range(k % 5 + 1))
    body = "".join(f"<p>{html.escape(b)}" + ("</p>" if k % 2 else "") for b in blocks[1:])
    wrap = ("<article>", "</article>") if named else ('<div class="x1"><div class="x2">', "</div></div>")
    aside = "<aside><p>see also</p></aside>" if k % 3 == 0 else ""
    talk = '<div class="comments"><h3>Comments</h3><p>nice post, thanks a lot</p></div>' if k % 4 == 0 else ""
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><header>Site</header><nav><ul>{menu}</ul></nav><!-- <p>x</p> --><div class=ad>buy {k}</div>{wrap[0]}<h1>{html.escape(blocks[0])}</h1>{body}{talk}{wrap[1]}{aside}<form><input value=1> name <button>go</button></form><footer>&copy; me {k}</footer>"


def corpus(named, n=40):
    r = random.Random(3)
    word = lambda: r.choice(["a & b", "x < y", "é", "\"q\"", "the", "long words here", "&amp;"])
    return [(k, f"http://h{k % 3}.example.com/{k}", [" ".join(word() for _ in range(r.randint(3, 40))) for _ in range(r.randint(2, 6))]) for k in range(n)]


def test_article_text(spark):
    for named in (True, False):
        rows = corpus(named)
        df = spark.createDataFrame([(k, u, page(k, b, named), 7) for k, u, b in rows], "page_id long, url string, html string, n_chars int").repartition(4)
        got = {r.page_id: r for r in extract_main_text(df).collect()}
        for k, _, b in rows:
            assert got[k].text == "\n".join(" ".join(x.split()) for x in b) and got[k].n_chars == len(got[k].text)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (3, "no url", "plain &lt;text&gt;  here"), (4, "http://a/", "<article>one<br>two<p>three &am &eacute;</article>"), (None, "http://a/", "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got[1] == "" and got[2] == "" and got[3] == "plain <text> here" and got[4] == "one two\nthree &am é"
    assert extract_main_text(df.limit(0)).count() == 0


def test_wrapper_is_union_free(spark):
    a, b = shape_of(read_tree("<body><ul><li>1<li>2</ul><div>x</div><dl><dt>a<dd>b<dt>c<dd>d</dl></body>")), shape_of(read_tree("<body><ul><li>1</ul><h1>t</h1><div>y</div></body>"))
    merge_into(a, b, pages=True)
    assert pattern(a) == "page[body[ul[li[#]+] h1[#]? div[#] dl[(dt[#] dd[#])+]?]]" and a.pages == 2
    assert blocks_of(read_tree("<p>a<p>b"), "") == ["a", "b"] and article_of(a) == "/body"
    rows = corpus(True)
    w = infer_wrappers(spark.createDataFrame([(k, u, page(k, t)) for k, u, t in rows], "page_id long, url string, html string").repartition(5)).collect()
    assert len(w) == 3 and sum(r.pages for r in w) == len(rows) and all(r.article == "/html/body/article" for r in w)


def test_templates_ids_and_missing_urls(spark):
    """Pages that the one path of a host would leave empty, or read with all that stands around their article."""
    side = "<div class=col><p>quick facts and figures of the whole site</p></div>"
    say = lambda k: f"text {k} of some length that makes it the article"
    rows = []
    for k in range(12):
        rows.append((k, "http://two/", f"<html><body>{side}<article><h1>t{k}</h1><p>{say(k)}</article></body></html>" if k % 2 else f"<html><body><div class=shop>{side}<main><h1>t{k}</h1><p>{say(k)}</main></div></body></html>"))
        rows.append((100 + k, "http://ids/", f"<html><body class='postid-{k}'>{side}<article id=post-{k} class='post-{k} category-{'abc'[k % 3]}'><h1>t{k}</h1><p>{say(k)}</article>"))
        rows.append((200 + k, None if k % 2 else "no url", f"<html><body>{side}<article><h1>t{k}</h1><p>{say(k)}</article>" if k % 3 else f"<div><div id=main-text><h1>t{k}</h1><p>{say(k)}</div></div>"))
    rows.append((300, "http://two/", f"<p>{say(0)}"))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got.pop(300) == say(0)
    assert got == {k: f"t{k % 100}\n{say(k % 100)}" for k in got}
    both = spark.createDataFrame([(1, "http://a/", "<article>one<p>three</article>"), (2, "http://a/", "<p>x")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_main_text(both).collect()} == {1: "one\nthree", 2: "x"}


def test_two_unnamed_templates(spark):
    rows = []
    for k in range(20):
        text, part = f"text {k} of some length " * 9, "ab"[k % 2]
        rows.append((k, "http://a/", f"<html><body><div class=facts><p>quick facts</p></div><div class={part}><h1>t{k}</h1><p>{text}</div></body></html>", f"t{k}\n{text.strip()}"))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_class_words_and_depth(spark):
    """No class word empties an article, nested pages are read whole, and helper names don't clash."""
    body = "<h1>t{k}</h1><p>" + "text {k} of some length " * 9 + "</p>"
    talk = "<div class='comments'><p>" + "nice post " * 90 + "</p></div>"
    want = lambda k: f"t{k}\n" + (f"text {k} of some length " * 9).strip()
    rows = []
    for k in range(8):
        b = body.format(k=k)
        rows.append((k, "http://a/", f"<body><div class='layout with-sidebar'>{b}<div class=sidebar><p>side</p></div></div>{talk}", want(k)))
        rows.append((100 + k, "http://b/", f"<body><div class='post comments-open'>{b.replace('{k}', str(k))}</div>{talk}", want(k)))
        rows.append((200 + k, "http://c/", f"<body><article>{b}<section class='related-work'><p>earlier work</p></section><div class=related><a href=/>more</a></div></article>", want(k) + "\nearlier work"))
        rows.append((300 + k, "http://d/", "<div>" * 3000 + b + f"<nav>menu</nav>one<div>two</div>three" + "</div>" * 3000, want(k) + "\none\ntwo\nthree"))
    df = spark.createDataFrame([(*r[:3], 5, 6) for r in rows], "page_id long, url string, html string, _host int, _article int").repartition(3)
    got = {r.page_id: (r.text, r["_host"], r["_article"]) for r in extract_main_text(df).collect()}
    assert got == {r[0]: (r[3], 5, 6) for r in rows}
