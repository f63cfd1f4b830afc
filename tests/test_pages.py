"""Feeds and result pages, with what regular expressions alone get wrong."""

import html as python_html

from pyspark.sql import functions as F

from trendlake.functions import html as H
from trendlake.sources import payloads as P


def page(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, payload string")


BING = """<!-- <li class="b_algo"><h2><a href="https://no.example/">commented</a></h2></li> --><script>"<li class='b_algo'>"</script>
<ol id=b_results><li class='b_algo extra' data-x="a>b"><h2><span>x</span><a target=_blank href='https://a.example/p?q=1&amp;utm_source=y'>A &#233;&#x1F600; <b>bo</b>ld</a></h2>
<div class="b_caption"><ul><li>one</li><li>two <ul><li>deep</li></ul></li></ul><p>First&nbsp;line<br>second &lt;i&gt; &unknown; &amp;lt;</p><div class="b_attribution"><cite>a.example › p</cite></div></div><p>not the caption's</p></li>
<li class="b_ad"><h2><a href="https://ad.example/">ad</a></h2></li>
<li class="b_algo_not"><h2><a href="https://other.example/">other class</a></h2></li>
<li class=b_algo><h2><a href=https://b.example/>B</a></h2><p>plain</li>
<li class="x b_algo"><h2><a href="https://c.example/"> </a></h2></li></ol><p>after all</p>"""


def test_bing_results_end_where_they_close(spark):
    rows = P.bing(page(spark, BING, "", None, "<ol></ol>")).orderBy("id", "rank").collect()
    assert [(r.id, r["rank"], r.title, r.url) for r in rows] == [(0, 1, "A é😀 bold", "https://a.example/p?q=1"), (0, 2, "B", "https://b.example/")]
    assert rows[0].summary == "First line second <i> &unknown; &lt;" and rows[0].cite == "a.example › p" and rows[1].summary == "plain"
    assert P.bing(page(spark, BING), 1).count() == 1


DDG = """<div class="results"><div class="result web"><div><h2 class="result__title"><a rel=n class='result__a' href='//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.example%2Fp%3Fa%3D1&amp;rut=1'>T &#x4E2D;</a></h2>
<div class="inner"><div>deep</div></div><a class="result__snippet" href="#">S <b>one</b></a></div></div>
<div class="result"><h2 class="result__title"><a href="https://y.example/">U</a></h2></div><div class="result__snippet">of no result</div></div>"""


def test_duckduckgo_results_end_where_they_close(spark):
    rows = P.duckduckgo(page(spark, DDG)).orderBy("rank").collect()
    assert [(r.title, r.url, r.summary) for r in rows] == [("T 中", "https://x.example/p?a=1", "S one"), ("U", "https://y.example/", None)]


def test_references(spark):
    texts = ["&#65;&#x42;&amp;&lt;", "a & b &; &#; &#xD800; &#0; &#1114112; &amp;amp;", "no references", "&eacute;&nbsp;&copy;", "&", "", "&#128512;" * 500]
    got = {r.payload: r.d for r in page(spark, *texts).select("payload", H.decoded(F.col("payload")).alias("d")).collect()}
    assert got[texts[0]] == "AB&<" and got[texts[1]] == "a & b &; &#; &#xD800; &#0; &#1114112; &amp;" and got[texts[2]] == texts[2]
    assert all(got[t] == python_html.unescape(t) for t in texts[3:])


def test_nested_elements(spark):
    cases = {
        "<div>a<div>b</div>c</div>d": "a<div>b</div>c", "x<DIV id=1><br/><div>b</div></div>e": "<br/><div>b</div>", "<div><div></div></div>": "<div></div>", "<div>open <div>never closed</div>": "open <div>never closed</div>",
        "<div></div><div>two</div>": "", "<divider>no</divider>": None, "none": None, "</div><div>z</div>": "z",
    }
    got = {r.payload: r.c for r in page(spark, *cases).select("payload", H.content(F.col("payload"), H.opening("div")).alias("c")).collect()}
    assert got == cases


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>
<entry><id>http://arxiv.org/abs/2401.1v1</id><title type="html">A &#233; &amp; <i>b</i>
 c</title><summary><![CDATA[x < y]]></summary><published>2024-01-02T03:04:05Z</published><author><name>X &amp; Y</name></author><author><name> </name></author><category term='cs.AI'/><category term=" "/><arxiv:primary_category term="cs.LG"/><link href="http://h"/><link title="pdf" href="http://p"/></entry>
<entry><id>http://arxiv.org/abs/2</id><title>no date</title></entry></feed>"""


def test_atom_feeds(spark):
    rows = P.arxiv(page(spark, ATOM, "<feed><entry>", None, "<feed/>")).orderBy("id", F.desc("url")).collect()
    one = next(r for r in rows if r.url == "http://arxiv.org/abs/2401.1v1")
    assert (one.arxiv_id, one.title, one.summary, one.authors, one.categories, one.pdf_url, one.error) == ("2401.1v1", "A é & b c", "x < y", ["X & Y"], ["cs.AI"], "http://p", None)
    assert sorted((r.id, r.error) for r in rows if r.error) == [(0, "missing field"), (1, "no XML")] and len(rows) == 3
