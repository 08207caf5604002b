from __future__ import annotations

import random

import numpy as np

from notewright.llm import htmltext


def text(page):
    return "\n\n".join(b.text for b in htmltext.Page(page).blocks)


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><article>no</article>";</script></head><body>
    <header class="top">Site <nav>menu</nav></header><div class="cookie-notice">We use cookies</div><aside>side</aside>
    <article><header><h1>Title &amp; more</h1>By me</header><!-- c --><p>One <b>two</b><br>three&nbsp;four<p>five <i>six
    </i><form><input value="x"><button>Go</button></form><div class="ad-slot">Buy</div><ul><li>a</li><li>b</li></ul><table><tr><td>c<td>d</table>
    <noscript>no</noscript><section id="comments"><p>bad</p><article class="comment">worse</article></section><footer>foot</footer></article>
    <footer>&copy; x</footer></body></html>"""
    assert text(page) == "Title & more\n\nOne two three four\n\nfive six\n\na\n\nb\n\nc d"


def test_odd_markup():
    assert text("<article><p title='a > b'>x < y &lt;b&gt; &#233; &am &amp;amp;</article>") == "x < y <b> é &am &amp;"
    assert text("<article>a<div hidden>no</div><p style='display: none'>no</p>b</article>") == "a\n\nb"
    assert text('<article><p id="x>broken</article>') in ("", "broken")
    assert text('<article><div class="body has-sidebar ad-free">a</div><div class="post-footer">b</div></article>') == "a"
    assert text("") == text("<p></p>") == text("<script>x") == ""
    assert text("<main><nav>menu<p>x</nav>kept</main>") == "kept" and text("no markup at all") == "no markup at all"
    assert text("<b>" * 50_000 + "</i>" * 50_000 + "deep") == "deep"
    assert text("<ARTICLE>Up</ARTICLE><div role=main>also</div>") == "Up\n\nalso"


def test_open_elements_end_where_html_ends_them():
    assert text("<article><p>a<p class=promo>Buy<p>b<p>c</article>") == "a\n\nb\n\nc"
    assert text("<article><ul><li>a<li class=ad>Buy<ul><li>in</ul><li>b</ul><dl><dt class=promo>x<dd>c</dl></article>") == "a\n\nb\n\nc"
    assert text("<article><table><tr><td>a<td class=ad>Buy<table><tr><td>x</table><td>b<td>b<tr><td>c</table></article>") == "a\n\nb b\n\nc"
    assert text("<article><p class=ad>x<b><i>y<div>kept</div></article>") == "kept"
    assert text("<p><button>" * 20_000 + "<b>" * 20_000 + "<div>" * 20_000) == ""


def test_words_beside_a_zones_word_leave_it_in_doubt():
    """What only sounds like a zone keeps its text; certain names and lists of links go."""
    for name in ("market-share", "search-for-life", "lunch-menu", "article-header", "noticeable", "social-security"):
        assert text(f'<article><p>a</p><div class="{name}">our text</div></article>') == "a\n\nour text", name
    for name in ("ad-slot", "related-posts", "share-bar", "site-header", "post-footer", "comments-section", "newsletter_signup", "cookieBanner", "menu"):
        assert text(f'<article><p>a</p><div class="{name}">Buy</div></article>') == "a", name
    assert text('<article><p>a</p><div class="market-share"><a href=x>More news</a> <a href=y>here</a></div></article>') == "a"


def test_doubt_is_settled_by_the_host(spark):
    """On 20 marked pages one block in doubt repeats and another is each page's own; copies of an article keep theirs."""
    row = lambda i: f"<article><p>{' '.join(f'p{i}x{k}' for k in range(30))}</p><div class='market-share'>{{}}</div></article>"
    same, own = "subscribe to our market report and get ten per cent off", "the market share of company {} rose by two points this year again"
    pages = [(i, "http://h.com/", row(i).format(same if i % 2 else own.format(i * 31))) for i in range(20)]
    pages += [(100 + i, "http://c.com/", row(0).format(own.format(7))) for i in range(4)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.report(df).collect()}
    assert all((same in got[i]) is False and ("rose" in got[i]) is (i % 2 == 0) for i in range(20)) and all("rose" in got[100 + i] for i in range(4))


def test_pages_whose_mark_is_none(spark):
    """A mark in a comment, or an article of comments, marks nothing: what such pages hold is judged by their host."""
    frame = "<!-- <article> --><div>welcome to our great site please enjoy the many pages here</div><p>{}</p><article class=comment>bad</article>"
    pages = [(i, "http://h.com/", frame.format(" ".join(f"p{i}x{k}" for k in range(20)))) for i in range(12)]
    pages += [(20 + i, f"http://tiny{i}.com/", h) for i, h in enumerate(["<p>Hello world</p>", "", None, "<article></article>", "a b c d e f g h", "<p>one</p>" * 3])]
    got = {r["page_id"]: r["text"] for r in htmltext.report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == " ".join(f"p3x{k}" for k in range(20))
    assert [got[20 + i] for i in range(6)] == ["Hello world", "", "", "", "a b c d e f g h", "one\n\none\n\none"]


def test_hosts_of_few_tokens():
    for n in range(11):
        for pages in (1, 2, 4):
            got = htmltext.repeated([np.arange(n)] * pages, 8, 0.2)
            assert [g.tolist() for g in got] == [[n >= 8 and pages >= 3] * n] * pages
    assert htmltext.repeated([], 8, 0.2) == []


def test_suffix_array_against_brute_force():
    r = random.Random(2)
    common = [r.randrange(50) for _ in range(14)]
    pages = []
    for i in range(20):
        own = [100 + 40 * i + k for k in range(r.randint(0, 30))]
        pages.append(np.array(own[:5] + (common if i % 2 else common[:9]) + own[5:], np.int64))
    got = htmltext.repeated(pages, 8, 0.2)
    least = max(3, -(-20 * 0.2 // 1))
    for p, page in enumerate(pages):
        want = np.zeros(len(page), bool)
        for i in range(len(page) - 7):
            run = tuple(page[i : i + 8])
            n = sum(any(tuple(q[j : j + 8]) == run for j in range(len(q) - 7)) for q in pages)
            want[i : i + 8] |= n >= least
        assert (got[p] == want).all()


def test_unmarked_pages_lose_what_their_host_repeats(spark, rows):
    frame = "<body><div>welcome to our great site please enjoy the many pages here</div><div>own words of page {0} number {1} that no other page has at all</div><p>copyright all rights reserved by the owners of this host forever</p></body>"
    pages = [(i, f"http://H.com/{i}", frame.format(i, i * 31)) for i in range(12)] + [(50, "http://other.com/", frame.format("x", "y")), (60, None, None), (None, "http://h.com/a", "<article>short</article>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in htmltext.report(df).collect()}
    assert got[3]["text"] == "own words of page 3 number 93 that no other page has at all"
    assert got[50]["text"].startswith("welcome") and got[50]["text"].count("\n\n") == 2
    assert got[60]["text"] == "" and got[60]["n_chars"] == 0 and got[None]["text"] == "short"
    assert htmltext.report(df.limit(0)).count() == 0


def test_pages_of_the_table_hold_their_documents(spark):
    """The synthetic pages wrap documents: behind the heading stands a document's text, block by block."""
    sf = "/root/testdata/sf0.01"
    texts = {" ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = htmltext.report(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert got and all(" ".join(r["text"].split("\n\n")[1:]) in texts for r in got)


def test_runs_are_counted_over_the_whole_host(spark):
    """Of 600 pages, 60 hold one text (a tenth) and 59 another; the first goes everywhere and the second nowhere."""
    tenth, fewer = "this notice stands on just a tenth of all the pages here", "that other text stands on one page fewer than a tenth does"
    page = lambda i: "".join(f"<p>{t}</p>" for t in [" ".join(f"w{i}x{k}" for k in range(40)), *[tenth] * (i % 10 == 0), *[fewer] * (i % 10 == 1 and i > 1)])
    df = spark.createDataFrame([(i, f"http://h.com/{i}", page(i)) for i in range(600)], "page_id long, url string, html string")
    got = [r["text"] for r in htmltext.report(df).collect()]
    assert len(got) == 600 and sum(tenth in t for t in got) == 0 and sum(fewer in t for t in got) == 59


def test_copies_of_an_article_stay(spark):
    frame = "<div>welcome to our great site please enjoy the many pages here</div><p>{}</p><p>{}</p><p>copyright all rights reserved by the owners of this host forever</p>"
    article = [" ".join(f"{c}{k}" for k in range(30)) for c in "ab"]
    pages = [(i, f"http://h.com/{i}", frame.format(*(article if i < 3 else [f"{x} ".join(map(str, range(100 * i, 100 * i + 30))) for x in "cd"]))) for i in range(20)]
    pages += [(100 + i, f"http://small.com/{i}", f"<p>{article[0]}</p>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in htmltext.report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n\n".join(article) for i in range(3)) and all(got[100 + i] == article[0] for i in range(3))
    assert "welcome" not in got[7] and "copyright" not in got[7] and got[7].startswith("700c")


def test_marked_pages_are_in_their_hosts_array(spark):
    """Thirty marked pages show what is their host's frame, so it goes from two pages without a mark too; a line that their articles share stays and is counted."""
    frame, line = "welcome to our great site please enjoy the many pages here", "this text may be copied under the terms of its license"
    own = lambda i: " ".join(f"p{i}x{k}" for k in range(20))
    pages = [(i, "http://h.com/", f"<div>{frame}</div><article><p>{own(i)}</p>{f'<p>{line}</p>' * (i < 10)}</article>") for i in range(30)]
    pages += [(i, "http://h.com/", f"<div>{frame}</div><p>{own(i)}</p>") for i in (30, 31)]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in htmltext.report(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: (f"{own(i)}\n\n{line}", 1) if i < 10 else (own(i), 0) for i in range(32)}


def test_shared_runs_do_not_depend_on_how_pages_are_dealt(spark):
    """Over arrays of one page or of all, with proposed runs as lists or by a shuffle, a host's shared runs are those of a plain count."""
    r = random.Random(5)
    phrases = [" ".join(f"q{p}w{k}" for k in range(r.randint(8, 12))) for p in range(30)]
    pages = []
    for i in range(150):
        host = "big" if i < 100 else "mid" if i < 130 else f"one{i}" if i < 145 else "five"
        some = [phrases[int(30 * r.random() ** 3)] for _ in range(4)]
        body = f"<div>{some[0]}</div>" + ("<article>" if i % 3 else "") + f"<p>own{i} {some[1]}</p><p>{some[2]}</p>" + (f"<div class='market-share'>{some[3]}</div>" if i % 5 == 0 else "")
        pages.append((i, f"http://{host}.com/{i}", body))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    want = {}
    hosts = {}
    for _, url, html in pages:
        page = htmltext.Page(html)
        streams = [{tuple(t[k : k + 8]) for k in range(len(t) - 7)} for t in (" ".join(b.text for b in blocks).split(" ") for blocks in (page.blocks, page.frame))]
        hosts.setdefault(url.split("/")[2], []).append((*streams, not page.marked or any(b.doubt for b in page.blocks)))
    for host, own in hosts.items():
        opened = sum(o for _, _, o in own)
        least, least_open = (max(3, -(-n // 10)) for n in (len(own), opened))
        for run in set().union(*(a | b for a, b, _ in own)):
            held, held_open, frames = sum(run in a or run in b for a, b, _ in own), sum(run in a and o for a, _, o in own), sum(run in b for _, b, _ in own)
            n = htmltext.FRAME if frames >= 3 and 2 * frames > len(own) else held_open if held_open >= least_open else 0
            if n or held >= least:
                want[host, int(htmltext.run_hashes([" ".join(run)])[0])] = (n, held if held >= least else 0)
    parsed = htmltext.materialize(htmltext.parsed_pages(df), "html-parsed")
    for size, listed in ((1, htmltext.LISTED), (1, 100), (2_000, 0), (htmltext.ARRAY, htmltext.LISTED)):
        got = htmltext.common_runs(parsed, size, listed).collect()
        assert {(g["host"], c["run"]): (c["n"], c["pages"]) for g in got for c in g["common"]} == want and len(want) > 50
