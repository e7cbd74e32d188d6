import html
import math
import re
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from tabloom.llm import html_text as H


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""),
        ("", ""),
        ("plain <i>text</i> 1 < 2 &amp; 3", "plain text 1 < 2 & 3"),
        ("<article><h1>T</h1><p><b>One<br>two<p>Three</article>after", "T\n\nOne two\n\nThree"),
        ("<p>a\n\n b&nbsp; &lt;c&gt; &#233; &amp;amp;", "a b <c> é &amp;"),
        ("<nav>n</nav><header>h</header><div>text</div><footer>f</footer><aside>a</aside>", "text"),
        ("<div class='cookie-notice'>c</div><div id=sidebar>s</div><p>x</p><div class='article-comments'><p>bad</p></div>", "x"),
        ("<script>if(a<b)'</p>'</script><style>p{}</style><p>x<!-- no --></p><noscript>n</noscript>", "x"),
        ("<form><label>l</label><input value=1></form>t", "t"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1\n\n2\n\n3"),
        ("<main>m<article>a</article></main>", "a"),
        ("<main>m</main>x", "m"),
        ("<article>a<article class='comment'>c</article></article>", "a"),
        ("<div role=navigation>n</div><div hidden>h</div><div style='display: none'>d</div>x", "x"),
        ("<p class='read'>bread <span class='ads'>no</span> x</p>", "bread x"),
        ("<p title='a > b'>x</p><p title=\"unclosed>y", "x\n\ny"),
        ("</p></div>x</b>", "x"),
        ("<article><p>&#x1F600; ok</p></article>", "😀 ok"),
        ("<pre>a\n  b</pre>", "a b"),
    ],
)
def test_blocks(source, want):
    assert H.main_text(H.Page(source)) == want


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="<>/apbdiv&;\"'=! -", max_size=80))
def test_never_fails(source):
    H.main_text(H.Page(source))


def site(n):
    return [(i, f"http://a.org/{i}", f"<div class='top'>Welcome to us</div><div class='body'><p>Story {i} of {i * 7}</p><p>More {i}</p></div><div class='end'>Bye</div>") for i in range(n)]


def test_style_tree(spark):
    rows = site(12) + [(100 + i, "http://b.org/", "<div class='top'>Welcome to us</div>") for i in range(12)] + [(None, None, None), (5, "x", ""), (6, "http://c.org", "<p>once</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 host", "2 low", "3 path")
    got = {(r[0], r[1]): (r[2], r[3]) for r in H.extract(df).collect()}
    assert len(got) == len(rows)
    assert got[3, "http://a.org/3"] == ("Story 3 of 21\n\nMore 3", 21)
    assert got[100, "http://b.org/"][0] == "Welcome to us"  # never all text of a page
    assert got[None, None] == ("", 0) and got[5, "x"] == ("", 0) and got[6, "http://c.org"][0] == "once"
    assert H.extract(df, most_broadcast=0).count() == len(rows)
    assert H.extract(df.limit(0)).collect() == []
    shown = {r[0]: r[2] for r in H.extract(df, most_broadcast=0).collect()}
    assert shown[3] == "Story 3 of 21\n\nMore 3" and shown[100] == "Welcome to us"


def plain_tree(pages):
    """The tree's entropies and importances by counting over all pages."""
    shows, holds = defaultdict(Counter), defaultdict(Counter)
    for url, source in pages:
        nodes, contents = H.Page(source, urls_host(url)).seen()
        for n, x in nodes:
            shows[n][x] += 1
        for n, x in contents:
            holds[n][x] += 1
    many = {n: sum(c.values()) for n, c in shows.items() if sum(c.values()) > 1}
    entropy = {n: (-sum(c / m * math.log(c / m) for c in shows[n].values()) / math.log(m), len(shows[n])) for n, m in many.items()}
    return entropy, {H.content_key(n, x): 1 - math.log(c) / math.log(m + 1) for n, m in many.items() for x, c in holds[n].items() if c > 1}


def urls_host(url):
    return re.match("[^/?#]*", (url or "").partition("://")[2])[0].lower()


def boilerplate(spark, sf):
    """Pages of the table, each article between its host's own menu, slogan and footer, all in elements that say nothing."""
    rows = []
    for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect():
        host = urls_host(r["url"])
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        menu = "".join(f"<div><a>{host} part {k}</a></div>" for k in range(5))
        rows.append((r["page_id"], r["url"], f"<div>{menu}</div><div>All about {host}</div><div>{inner}</div><div><div>{host} since 1999</div></div>"))
    return rows


def test_tree_alone_and_against_counting(spark):
    rows = boilerplate(spark, "sf0.01")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes, contents = H.style_tree(df)
    entropy, importance = plain_tree([r[1:] for r in rows])
    got = {r["node"] & H.MASK: (r["entropy"], r["styles"]) for r in nodes.collect()}
    assert got.keys() == entropy.keys() and all(got[n] == pytest.approx(entropy[n], abs=1e-9) for n in got)
    got = {r["key"] & H.MASK: r["importance"] for r in contents.collect()}
    assert got.keys() == importance.keys() and all(got[n] == pytest.approx(importance[n], abs=1e-9) for n in got)
    hosts = Counter(urls_host(r[1]) for r in rows)
    table, enough = 0, 0
    for (i, _), text in {(r["page_id"], r["url"]): r["text"] for r in H.extract(df).collect()}.items():
        url, source = next(r[1:] for r in rows if r[0] == i)
        assert text == H.main_text(H.Page(source, urls_host(url)), entropy, importance)
        if hosts[urls_host(url)] >= 3:
            table += 1
            enough += "part" not in text and "about" not in text and "1999" not in text and len(text) > 0
    assert table > 100 and enough == table


def test_an_article_keeps_what_only_its_names_speak_against():
    text = lambda s: H.main_text(H.Page(s))
    body = "<p>" + "long text " * 50 + "</p>"
    for names in ("content no-sidebar", "has-sidebar", "post comments-open", "article-header", "search-results", "comments", "page menu"):
        assert len(text(f"<div class='{names}'>{body}</div><p>x</p>")) > 400
    kept = text(f"<article><header><h1>Title</h1></header>{body}<section class='discussion'><p>D</p></section><table class='share-prices'><td>9</td></table><div class='search-and-rescue'>S</div><p>E = <math><mi>m</mi></math></p></article>")
    assert all(x in kept.split("\n\n") for x in ("Title", "D", "9", "S", "E = m"))
    assert text(f"<main>{body}<article>Teaser</article></main>").startswith("long text")
    assert text(f"<form id=all>{body}</form>").startswith("long text")


def test_depth_and_length():
    for source in ("<div>" * 100_000 + "a", "<b>" * 100_000 + "a", "<p>a<div>" * 50_000, "<ul><li>" * 50_000 + "x", "<i></b>" * 50_000 + "t"):
        start = time.perf_counter()
        assert H.main_text(H.Page(source))
        assert time.perf_counter() - start < 3


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in df.collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n\n".join(p for p in parts if p)
    assert {r[0]: r[2] for r in H.extract(df).collect()} == want
