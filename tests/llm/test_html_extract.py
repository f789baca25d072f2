import html as h
import re

from headway.llm.html_extract import extract, infer_rules, main_text, merge_wrappers, rule_of, wrapper_of

PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Buy</div>%s<aside>side</aside><div id="comments"><p>I say</p></div><form><p>Mail</p></form><footer>&copy; f</footer></body></html>'


def test_article_without_the_rest():
    assert main_text(PAGE % '<article><h1>A &amp; B</h1><p>one<b>two</b>\n\tthree<br>four<p>five < six &lt;x&gt;<!-- no --><p title="a>b">&nbsp;seven</article>') == "A & B onetwo three four five < six <x> seven"
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("<article><p>open <script>x") == "open"
    assert main_text("<div><p>" + "<" * 5000 + "</p></div>") == "<" * 5000
    assert len(main_text("<article>" + "<p>word</p>" * 20000 + "</article>")) == 20000 * 5 - 1


def test_names_do_not_take_the_article():
    article = "<article><h1>Title</h1><p>the story</p><div class='share'>tell</div></article>"
    for page in ('<div class="page has-sidebar">%s</div>', '<div id="with-menu">%s</div>', '<div class="no-comments">%s</div>', '<div class="page sidebar">%s</div>', '<div class="related"><div id="comments">%s</div></div>'):
        assert main_text("<p>top</p>" + page % article + '<div class="cookie-banner">yes</div>') == "Title the story", page
    for names in ('class="post category-social"', 'class="social post"', 'id="ad"'):
        assert main_text(PAGE % article.replace("<article>", f"<article {names}>")) == "Title the story", names
    assert main_text(article + '<div id="comments"><article><p>I say</p></article></div>') == "Title the story"
    assert main_text('<div><p>the long story itself</p></div><div class="related"><article>other</article></div>') == "the long story itself"


def test_wrapper_finds_slots_in_elements_whose_names_only_hold_a_dropped_word():
    page = '<div class="intro">Welcome to all of this</div><div class="has-sidebar"><h2>Title %d</h2><p>text %d</p></div>'
    w = wrapper_of(page % (0, 0))
    for i in range(1, 8):
        w = merge_wrappers(w, wrapper_of(page % (i, i)))
    assert rule_of(w)["main"] == "div.has.sidebar"


def test_wrapper_aligns_pages_of_a_host():
    pages = [f'<div class="top">Welcome</div><div class="box"><h2>Title {i}</h2>' + "".join(f"<p>text {i} {j}</p>" for j in range(2 + i % 3)) + ("<ul><li>x</li></ul>" if i % 2 else "") + "</div>" for i in range(8)]
    w = wrapper_of(pages[0])
    for p in pages[1:]:
        w = merge_wrappers(w, wrapper_of(p))
    box = w[1][1]
    assert [(n[0], n[2], n[3]) for n in box[1]] == [("h2", False, False), ("p", False, True), ("ul", True, False)]
    rule = rule_of(w)
    assert rule["main"] == "div.box" and ["div.top", "Welcome"] in rule["constant"]


def test_extract_uses_the_wrapper_where_there_is_no_article(spark):
    rows = [(i, "https://a.example/%d" % i, f'<div class="top">Welcome to all of this</div><div class="box"><h2>Title {i}</h2><p>text {i}</p></div>') for i in range(8)]
    rows += [(20, None, None), (21, "", ""), (22, "https://b.example", "<p>alone</p>"), (22, "https://b.example", "<p>alone</p>")]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(i, f"Title {i} text {i}", 14) for i in range(8)] + [(20, "", 0), (21, "", 0), (22, "alone", 5), (22, "alone", 5)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0
    assert infer_rules(spark.createDataFrame([], "url string, html string")).count() == 0


def test_a_long_notice_of_all_pages_goes(spark):
    notice = "Terms of use. " * 200
    rows = [(i, "https://a.example/%d" % i, f'<div><p>{notice}</p><h2>Title {i}</h2><p>text {i}</p></div>') for i in range(8)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} text {i}" for i in range(8)}


def test_pages_repeated_over_tasks_count_once(spark):
    page = '<div class="box"><h2>Title %d</h2><p>text %d</p></div>'
    rows = [("https://a.example", page % (i % 4, i % 4)) for i in range(64)] + [("https://b.example", page % (i % 5, i % 5)) for i in range(64)]
    rules = infer_rules(spark.createDataFrame(rows, "url string, html string").repartition(8)).collect()
    assert {r["host"]: r["rule"] != "{}" for r in rules} == {"a.example": False, "b.example": True}


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        body = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body)
        want[r["page_id"]] = " ".join(h.unescape(re.sub(r"</?[a-z][^>]*>", "", body)).split())
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert got == want


def opaque(page):
    """The page with telling elements turned into ``div`` and all class names and ids into hashes of them."""
    import hashlib
    import re

    name = lambda x: "x" + hashlib.md5(x.encode()).hexdigest()[:8]
    page = re.sub(r"(class|id)=\"([^\"]*)\"", lambda m: f'{m[1]}="{" ".join(map(name, m[2].split()))}"', page)
    return re.sub(r"<(/?)(article|main|header|footer|nav|aside|section)\b", lambda m: f"<{m[1]}div" + (f' class="{name(m[2])}"' if not m[1] and "class=" not in page[m.start() : page.find(">", m.start())] else ""), page)


def test_wrapper_finds_articles_without_names():
    import json
    from collections import defaultdict

    import pyarrow.parquet as pq

    from headway.llm import html_extract as H

    pages = defaultdict(list)
    for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").slice(0, 1000).to_pylist():
        pages[H.host_of(r["url"])].append(r["html"])
    equal = total = 0
    for of_host in pages.values():
        wrappers = [None, None]
        for html in dict.fromkeys(x for x in of_host if x):
            for i, x in enumerate((html, opaque(html))):
                w = H.wrapper_of(x)
                wrappers[i] = w if wrappers[i] is None else H.merge_wrappers(wrappers[i], w)
        named, bare = (json.dumps(H.rule_of(w)) for w in wrappers)
        if named == "{}":
            continue
        assert json.loads(bare)["main"]
        for html in of_host:
            total += 1
            equal += H.main_text(html, named) == H.main_text(opaque(html), bare)
    assert total > 900 and equal >= 0.99 * total, (equal, total)


def test_article_beside_its_largest_division(spark):
    """Headline, lead and closing of an article whose text is mostly in a division, with a rule of its host and without."""

    def page(i):
        said = [f"Headline number {i} of the day", f"The lead {i} sums it up {i * 7}.", *(f"Paragraph {j} of page {i} goes on about matter {i * 31 + j} for quite a while and more." for j in range(4)), f"So ends story {i}."]
        html = f'<html><body><div class="top"><a href="/">Home</a> <a href="/x">Old news</a></div><article><h1>{said[0]}</h1><p class="lead">{said[1]}</p><div class="body">' + "".join(f"<p>{t}</p>" for t in said[2:6]) + f'</div><p class="end">{said[6]}</p></article><div class="foot">All rights kept</div></body></html>'
        return (i, f"http://one.example/{i}", html), " ".join(said)

    made = [page(i) for i in range(12)]
    for n in (4, 12):
        got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame([m[0] for m in made[:n]], "page_id long, url string, html string")).collect()}
        assert got == {m[0][0]: m[1] for m in made[:n]}, n
