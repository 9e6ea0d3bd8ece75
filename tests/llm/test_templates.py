import pytest
from pyspark.sql import functions as F

from latticework.llm import templates as tp

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>Title</title><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; tail</h1><p><b>First&nbsp;one.<br><p>Second   <i>two</i>
lines</p><ul><li>x<li>y</ul><aside>Side</aside><div class="comments"><p>Reader says</p></div><form>Name <input name=a></form></article>
<footer>&copy; foot</footer></body></html>"""


def text_of(html):
    page = tp.parse(html)
    mine = [t for t, own in page.blocks if own]
    return "\n\n".join(mine or [t for t, _ in page.blocks])


def test_article_of_a_page():
    assert text_of(PAGE) == "Head & tail\n\nFirst one.\n\nSecond two lines\n\nx\n\ny"


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<p>a</p>tail", "a\n\ntail"),
    ("<article><p>un<b>bro</b>ken</p></article>", "unbroken"), ("<article>a<br>b<br/>c</article>", "a b c"),
    ("<article><p>1 &lt; 2 &#x41; &eacute;&notanentity;</p></article>", "1 < 2 A é¬anentity;"),
    ("<article><p>a</p><script>if (a<b) {}</script><p>b</p><style>x</style></article>", "a\n\nb"),
    ("<article><header><h1>T</h1></header><p>b</p><footer>f</footer></article>", "T\n\nb"),
    ("<header>h</header><main><p>m</p></main>", "m"), ("<article><p hidden>x</p><p>y</p></article>", "y"),
    ("<article><p>a<!-- <p>c</p> -->d</p><p>never closed", "ad\n\nnever closed"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n\n2\n\n3"),
    ("<article><p>x < y and a<b</p></article>", "x < y and a"),
    ("<article><p data-x=it's>Hello world</p><p>don't go</p><p>end</p></article>", "Hello world\n\ndon't go\n\nend"),
    ("<article><div class='article-header'><h1>Title</h1></div><p>body</p></article>", "Title\n\nbody"),
    ("<article><p class=\"a>b\" title='c>d' hidden=no>x</p><p id=e/f class>y</p></article>", "y"),
    ("<article><p title=\"never closed>x</p><p>y</p></article>", "x\n\ny"), ("<article><p \"odd' sign>x</p></article>", "x"),
    ("<article><menu><li>x<li>y</menu><p>z</p></article>", "x\n\ny\n\nz"), ("<menu><li>x</menu><p>z</p>", "z"),
    ("a</ b>c<!d>e<?f?>g</>h<3i", "acegh<3i"), ("<p>a</p><p unfinished", "a"),
    ("<section id='comment-list'><p>c</p></section><div><p>body</p></div>", "body"),
])
def test_blocks(html, want):
    assert text_of(html) == want


def site(host, i, body, article=False):
    inner = f"<article>{body}</article>" if article else f"<div class=body>{body}</div>"
    return f"http://{host}/{i}", f"<html><body><div class=top>Our site {host}</div>{inner}<div class=end>All rights</div></body></html>"


def test_templates_go_and_content_stays(spark):
    rows = [(i, *site("one.example", i, f"<p>Story {i}</p><p>shared thought</p>")) for i in range(4)]
    rows += [(10 + i, *site("two.example", i, f"<p>Tale {i}</p><p>more {i}</p>")) for i in range(12)]
    rows += [(50 + i, *site("two.example", 100 + i, "<p>The same tale</p>")) for i in range(30)]  # copies of one page
    rows += [(100 + i, *site("two.example", 200 + i, "<p>The same article</p>", True)) for i in range(30)]
    rows += [(200, None, "<p>no url</p>"), (201, "http://[bad", "<p>bad url</p>"), (202, "http://two.example/x", None), (None, "http://two.example/y", ""), (10, *site("two.example", 0, "<p>Tale 0</p><p>more 0</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    out = tp.extract(df, carry=["page_id", "url", "host"]).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert got[0] == "Our site one.example\n\nStory 0\n\nshared thought\n\nAll rights"  # too few pages to tell
    assert got[10] == "Tale 0\n\nmore 0" and got[21] == "Tale 11\n\nmore 11"
    assert got[55] == "The same tale" and got[100] == "The same article"
    assert (got[200], got[201], got[202], got[None]) == ("no url", "bad url", "", "")
    assert tp.extract(df.limit(0)).collect() == []
    assert "_text" in tp.extract(df).columns


def test_long_and_deep_pages():
    import time

    began = time.time()
    for odd in ('<p "', '<p a="', "<p a='b", "<a/", "<b></i>", "<p><b>", "<div>x", "<!-", "</", "<p a", "<script>", "&#", "<li><ul>"):
        text_of(odd * (1_000_000 // len(odd)))
    assert time.time() - began < 60
    assert text_of("<div>x" * 2000).count("x") == 2000
    assert text_of("<div>" * 5000 + "deep") == "deep"
    assert len(text_of("<article><p>" + "word " * 200_000 + "</p></article>")) == 999_999


def test_whole_table_against_plain_extraction(spark):
    import html
    import re

    from latticework.llm.queries import op1_site_templates

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()

    def plain(raw):
        inside = re.search(r"<article>(.*?)</article>", raw, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|li|ul|div)>", inside)
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split()) for b in blocks]
        return "\n\n".join(b for b in blocks if b)

    got = {r.page_id: (r.url, r.text, r.n_chars) for r in op1_site_templates(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.page_id: (r.url, t := plain(r.html), len(t)) for r in pages}


def test_hashes_cover_text_in_inline_elements(spark):
    body = lambda i: f"<h1><a href=/{i}>Title {i}</a></h1><p><span>Unique <i>text {i}</i></span></p><ul><li><a>item {i}</a></li></ul><p><b>Same line</b></p>"
    df = spark.createDataFrame([(i, *site("three.example", i, body(i))) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in tp.extract(df).collect()}
    assert got == {i: f"Title {i}\n\nUnique text {i}\n\nitem {i}" for i in range(12)}


def test_boxes_in_articles_go_and_articles_are_a_hint(spark):
    boxed = lambda i: f"<p>Report {i} in full</p><div class=box><p>Read also our best</p></div><p>It ends {i}</p>"
    rows = [(i, *site("four.example", i, boxed(i) if i < 9 else f"<p>Report {i} in full</p>", True)) for i in range(100)]
    rows += [(200 + i, f"http://five.example/{i}", f"<div class=story><p>A long story {i} that stands outside</p></div><article><p>Teaser</p></article>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in tp.extract(df).collect()}
    assert got[3] == "Report 3 in full\n\nIt ends 3" and got[50] == "Report 50 in full"
    assert got[201] == "A long story 1 that stands outside\n\nTeaser"


@pytest.mark.parametrize("start", ["section id='discussion'", "div class='post-header'", "h2 id='search'", "p class='notice-text'", "div class='legal-news'", "section class='widgets'", "p class='ad-hoc'"])
@pytest.mark.parametrize("around", ["article", "main"])
def test_names_alone_do_not_drop_main_text(start, around):
    tag = start.split()[0]
    assert text_of(f"<{around}><p>a</p><{start}>kept</{tag}><div class='x advert'>Buy</div><p>b</p></{around}>") == "a\n\nkept\n\nb"
    if "ad-hoc" not in start:
        assert text_of(f"<div><{start}>kept</{tag}></div>") == "kept"


def test_prose_of_articles_stays_however_often_it_recurs(spark):
    passage = "<p>A passage that many stories quote</p><ul><li>and a list</li></ul>"
    rows = [(i, *site("six.example", i, f"<h1>Story {i}</h1>{passage}<section class=more><p>More from us</p></section><p>It ends {i}</p>", True)) for i in range(40)]
    rows += [(100 + i, *site("six.example", 100 + i, f"<div class=text><p>One long text in a box that all copies of it have</p></div><p>Edit {i}</p>", True)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in tp.extract(df).collect()}
    assert all(got[i] == f"Story {i}\n\nA passage that many stories quote\n\nand a list\n\nIt ends {i}" for i in range(40))
    assert all(got[100 + i] == f"One long text in a box that all copies of it have\n\nEdit {i}" for i in range(40))
    off = {r.page_id: r.text for r in tp.extract(df, least=10**9).collect()}
    assert off[0] == "Story 0\n\nA passage that many stories quote\n\nand a list\n\nMore from us\n\nIt ends 0"
