import html
import os
import re
import time

import pytest

from weekloom.llm import extraction

SCHEMA = "page_id long, url string, html string, text string, key int, n_chars string"


def pages(spark, *texts):
    return spark.createDataFrame([(i, f"http://h/{i}", t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)


def texts(spark, *given):
    return [r.text for r in extraction.main_text(pages(spark, *given)).orderBy("page_id").collect()]


LONG = " ".join(f"word{i}" for i in range(40))
SURROUNDED = f"""<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{{}}</style><script>var a = "<article><p>no</p>";</script>
</head><body class="with-sidebar"><header><h1>Site</h1><p>{LONG}</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>
<div id="cookie-banner"><p>{LONG}</p></div><!-- <article>no</article> -->
<main><article><h1>A  title</h1><p>First <b>bold</b> line&nbsp;&eacute;&#8212;x<br>next</p><p>Two.
<ul><li>one<li><a href="/x">two</a></ul><div class="advert">{LONG}</div><table><tr><td>c1<td>c2</tr></table>
<pre>a
  b</pre><form><p>{LONG}</p><button>Send</button></form><p>AT&T &lt;p&gt; &am &copy</p><noscript>{LONG}</noscript>
<section id="comments"><h2>3 comments</h2><article class="comment"><p>{LONG}</p></article></section></article></main>
<aside><p>{LONG}</p></aside><div role="alert">{LONG}</div><footer><p>&copy; {LONG}</p></footer></body></html>"""


def test_article_among_all_that_is_not(spark):
    want = "A title\nFirst bold line é—x next\nTwo.\none\ntwo\nc1\nc2\na b\nAT&T <p> &am ©"
    row = extraction.main_text(pages(spark, SURROUNDED)).first()
    assert row.text == want and row.n_chars == len(want) and (row.page_id, row.url) == (0, "http://h/0")


def test_pages_without_marked_article(spark):
    soup = (f"<div class=menu><a href=x>Home</a><a href=y>More</a></div><h1>The title of it</h1><div>{LONG}</div><div>{LONG} a</div>"
            f"<ul><li><a href=x>Other page</a><li><a href=y>Next page</a></ul><div class=footer>{LONG}</div>")
    assert texts(spark, soup)[0].split("\n")[-2:] == [LONG, f"{LONG} a"]
    assert "Other page" not in texts(spark, soup)[0]


def test_odd_pages(spark):
    odd = [None, "", "   ", "<p", "<!-- open", "<script>let x = '<p>no</p>'", "</p></div>", "<article>", "<article><p>One<p>Two",
           "<article></nav>a</article></article>", "<nav><article><p>in an open menu</p></article>", "<article>\U0001F600 \u0000x</article>",
           "<ARTICLE><P>Big</P></ARTICLE>", "<article>a<script>b</script>c</article>", "<article><p>" + LONG * 20000 + "</p></article>"]
    got = texts(spark, *odd)
    assert got[:8] == [""] * 8
    assert got[8:14] == ["One\nTwo", "a", "in an open menu", "\U0001F600 \x00x", "Big", "ac"]
    assert got[14] == LONG * 20000


def test_repeated_rows_null_keys_and_no_rows(spark):
    frame = pages(spark, "<article>a</article>").selectExpr("cast(null as long) page_id", "cast(null as string) url", "html")
    got = extraction.main_text(frame.union(frame)).collect()
    assert [tuple(r) for r in got] == [(None, None, "a", 1)] * 2
    assert extraction.main_text(frame.limit(0)).count() == 0


def test_text_sizes_of_a_task_do_not_change_rows(spark):
    given = [f"<article><p>{i}</p></article>" for i in range(30)]
    got = extraction.main_text(pages(spark, *given), size=50).orderBy("page_id")
    assert [r.text for r in got.collect()] == [str(i) for i in range(30)]


@pytest.mark.parametrize("markup", ["<a \"", "<a b=\"", "<!--", "<", "<div>", "<b></i>", "<li>", "&", "<p x='"])
def test_broken_markup_takes_linear_time(markup):
    start = time.time()
    extraction.text_blocks(markup * 100_000)
    assert time.time() - start < 10


def test_tree_agrees_with_its_table():
    rows, labels = extraction.labelled()
    tree = extraction.grown(rows, labels)
    assert len(rows) < 600 and (tree.predict(rows) == labels).mean() > 0.99


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_whole_table_against_its_article_elements(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extraction.main_text(table).collect()}
    for row in table.collect():
        inner = re.search("<article>(.*)</article>", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[row.page_id] == "\n".join(b for b in blocks if b)
