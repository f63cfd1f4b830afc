"""Queries of the payload parsers, over pages that Spark makes of the documents: ten items a page, in each source's form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import payloads as P
from ..sources import tables as D
from .oracles import _W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Code points that XML does not allow.
_BANNED = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFE}\x{FFFF}]"


def _items(spark, sf_dir) -> DataFrame:
    """Items with a page, ten neighbours a page, and clean short texts."""
    short = lambda c, n: F.trim(F.substring(T.clean(F.regexp_replace(F.regexp_replace(c, _BANNED, ""), " ", " ")), 1, n))
    return D.items(spark, sf_dir).withColumns({"page": F.floor(F.col("hot_item_id") / 10), "name": short("title", 120), "body": short("summary", 200)}).drop("summary")


_ITEMS = rf"""{_W},
it AS (SELECT *, hot_item_id // 10 AS page, trim(substring(trim(regexp_replace(replace(regexp_replace(title, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{fffe}}\x{{ffff}}]', '', 'g'), chr(160), ' '), '[ \t\n\r]+', ' ', 'g')), 1, 120)) AS name,
  trim(substring(trim(regexp_replace(replace(regexp_replace(summary, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}\x{{fffe}}\x{{ffff}}]', '', 'g'), chr(160), ' '), '[ \t\n\r]+', ' ', 'g')), 1, 200)) AS body FROM items)"""


def _escaped(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _pages(rows: DataFrame, one, head: str = "", tail: str = "", between: str = "") -> DataFrame:
    """(id, payload): the texts of a page's ten items, in order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("hot_item_id", one.alias("x")))), lambda s: s["x"])
    return rows.groupBy(F.col("page").alias("id")).agg(F.concat(F.lit(head), F.array_join(parts, between), F.lit(tail)).alias("payload"))


@query
def atom_papers(spark, sf_dir):
    """Papers of Atom feeds; some have no title, or no PDF."""
    i = F.col("hot_item_id")
    title = F.when(F.pmod(i, F.lit(13)) > 0, F.concat(F.lit("<title type='html'>"), _escaped(F.col("name")), F.lit("\n </title>"))).otherwise("")
    pdf = F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit("<link title='pdf' href='https://arxiv.org/pdf/"), "external_id", F.lit("?a=1&amp;b=2'/>"))).otherwise("")
    one = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/2401."), "external_id", F.lit("v1</id>"), title, F.lit("<summary><![CDATA[a < b]]></summary><author><name> "), "author", F.lit(" &amp; Co</name></author><author><name>B. &#233;</name></author><category term='cs.AI'/><category term='"),
        F.pmod(i, F.lit(3)).cast("string"), F.lit("'/><arxiv:primary_category term='x'/><published>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published><link href='http://h'/>"), pdf, F.lit("</entry>"),
    )
    pages = _pages(_items(spark, sf_dir), one, "<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom' xmlns:arxiv='http://arxiv.org/schemas/atom'>", "</feed>")
    return P.arxiv(pages).select("id", "arxiv_id", "title", "summary", F.array_join("authors", ";").alias("authors"), F.array_join("categories", ",").alias("categories"), F.unix_seconds("published_at").alias("published"), "pdf_url", "error")


ORACLES["atom_papers"] = rf"""{_ITEMS},
p AS (SELECT *, CASE WHEN hot_item_id % 13 > 0 THEN nullif(name, '') END AS t FROM it)
SELECT page AS id, '2401.' || external_id || 'v1' AS arxiv_id, t AS title, 'a < b' AS summary, author || ' & Co;B. é' AS authors, 'cs.AI,' || (hot_item_id % 3) AS categories, CAST(epoch(published_at) AS BIGINT) AS published,
  CASE WHEN hot_item_id % 2 = 0 THEN 'https://arxiv.org/pdf/' || external_id || '?a=1&b=2' END AS pdf_url, CASE WHEN t IS NULL THEN 'missing field' END AS error FROM p"""


@query
def result_pages(spark, sf_dir):
    """Results of two searches' pages: adverts, nested lists and results without a fit address among them."""
    i, rows = F.col("hot_item_id"), _items(spark, sf_dir)
    url = F.when(F.pmod(i, F.lit(11)) == 4, "javascript:void(0)").otherwise(F.concat(F.lit("https://x.example/"), "external_id", F.lit("?a=1&utm_source=t&b=2")))
    kind = F.when(F.pmod(i, F.lit(7)) == 3, "b_ad").otherwise("b_algo b_big")
    bing = F.concat(
        F.lit("<li class='"), kind, F.lit("'><h2><a target=_blank href=\""), _escaped(url), F.lit('">'), _escaped(F.col("name")), F.lit("<b>&#33;</b></a></h2><div class=\"b_caption\"><ul><li>one<li></li></li></ul><p>"), _escaped(F.col("body")),
        F.lit("</p><div class='b_attribution'><cite>"), "author", F.lit("</cite></div></div></li>"),
    )
    ddg = F.concat(
        F.lit("<div class='"), F.when(F.pmod(i, F.lit(7)) == 3, "ad").otherwise("web result"), F.lit("'><div><h2 class='result__title'><a href='//duckduckgo.com/l/?uddg="), F.url_encode(url), F.lit("&amp;rut=1'>"), _escaped(F.col("name")),
        F.lit("</a></h2></div><a class='result__snippet'>"), _escaped(F.col("body")), F.lit("</a></div>"),
    )
    one = P.bing(_pages(rows, bing, "<html><!-- <li class='b_algo'> --><ol id=b_results>", "</ol></html>"), 6).select(F.lit("bing").alias("engine"), "id", "rank", "title", "url", "summary", "cite")
    two = P.duckduckgo(_pages(rows, ddg, "<html><div class='results'>", "</div></html>"), 20).select(F.lit("duckduckgo").alias("engine"), "id", "rank", "title", "url", "summary", F.lit(None).cast("string").alias("cite"))
    return one.unionByName(two)


ORACLES["result_pages"] = rf"""{_ITEMS},
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY hot_item_id) AS rank FROM it WHERE hot_item_id % 7 <> 3 AND hot_item_id % 11 <> 4 AND name <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY hot_item_id) AS rank2 FROM it WHERE hot_item_id % 7 <> 3 AND hot_item_id % 11 <> 4)
SELECT 'bing' AS engine, page AS id, CAST(rank2 AS INT) AS rank, name || '!' AS title, 'https://x.example/' || external_id || '?a=1&b=2' AS url, nullif(body, '') AS summary, author AS cite FROM b WHERE rank2 <= 6
UNION ALL SELECT 'duckduckgo', page, CAST(rank AS INT), name, 'https://x.example/' || external_id || '?a=1&b=2', nullif(body, ''), NULL FROM r"""


@query
def parsed_payloads(spark, sf_dir):
    """JSON pages of seven sources: (source, page, key, number, text) of what is read of each."""
    i, rows = F.col("hot_item_id"), _items(spark, sf_dir)
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = lambda *cols: F.to_json(F.struct(*cols))
    of = lambda head, tail, *cols: _pages(rows, said(*cols), head, tail, ",")
    row = lambda df, source, page, key, number, text: df.select(F.lit(source).alias("source"), page.cast("long").alias("page"), key.cast("string").alias("key"), number.cast("double").alias("number"), text.cast("string").alias("text"))
    c, none = F.col, F.lit(None)
    repo = of('{"items":[', "]}", F.concat(F.lit("o/r"), "external_id").alias("full_name"), c("source_url").alias("html_url"), c("points").alias("stargazers_count"), F.array(F.lit(" a "), F.lit(""), c("author")).alias("topics"), at.alias("updated_at"))
    model = of("[", "]", F.when(i % 2 == 0, F.concat(F.lit("org/m"), "external_id")).alias("modelId"), F.concat(F.lit("m"), "external_id").alias("id"), c("points").alias("downloads"), F.array(*(F.concat(F.lit(f"t{k}"), "external_id") for k in range(8))).alias("tags"), F.lit("text-generation").alias("pipeline_tag"))
    story = rows.select(said(i.alias("id"), c("name").alias("title"), F.when(i % 3 == 0, "").otherwise(c("source_url")).alias("url"), c("points").alias("score")).alias("payload"))
    hits = of('{"hits":[', "]}", F.when(i % 5 == 0, " ").otherwise(c("external_id")).alias("objectID"), c("name").alias("title"), c("points").alias("points"), F.unix_seconds("published_at").alias("created_at_i"))
    topics = rows.groupBy(c("page").alias("id")).agg(said(F.when(F.pmod("page", F.lit(5)) == 0, 0).otherwise(1).alias("ok"), F.struct(F.transform(F.sort_array(F.collect_list(F.struct("hot_item_id", F.struct(F.when(i % 4 == 1, " ").otherwise(c("name")).alias("word"), c("points").alias("num")).alias("t")))), lambda s: s["t"]).alias("realtime")).alias("data")).alias("payload"))
    tweets = of('{"tweets":[', "]}", (i % 700).cast("string").alias("id"), F.when(i % 2 == 0, c("name")).alias("text"), F.lit("full").alias("full_text"), F.when(i % 3 == 0, c("points")).alias("likeCount"), F.lit(7).alias("favorite_count"))
    found = F.when(i % 6 == 1, "{").otherwise(said(c("name").alias("title"), (c("points") / 4).alias("score")))
    sogou = _pages(rows, _quoted(found), '{"Response":{"Pages":[', "]}}", ",")
    parts = [
        row(P.github(repo), "GITHUB", c("id"), c("full_name"), c("stargazers_count"), F.concat_ws(";", "url", F.array_join("topics", ","), F.unix_seconds("updated_at").cast("string"))),
        row(P.hugging_face(model), "HUGGING_FACE", c("id"), c("model_id"), c("downloads"), F.concat_ws(";", "author", "summary")),
        row(P.news_stories(story, rows.select(i.alias("place"), i.alias("item_id")), 500), "HACKER_NEWS", none, c("item_id"), c("score"), c("url")),
        row(P.news_search(hits, F.lit("2024-01-03 00:00:00").cast("timestamp")), "HACKER_NEWS_SEARCH", c("id"), c("objectID"), c("points"), c("url")),
        row(P.weibo(topics), "WEIBO_HOT_SEARCH", c("id"), c("rank"), c("num"), c("word")),
        row(P.tweets(tweets), "TWITTER", c("id"), c("tweet_id"), c("like_count"), c("text")),
        row(P.sogou(sogou), "SOGOU_SEARCH", c("id"), c("rank"), c("score"), c("title")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _quoted(text):
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


ORACLES["parsed_payloads"] = rf"""{_ITEMS},
w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY hot_item_id) AS place FROM it),
tw AS (SELECT *, row_number() OVER (PARTITION BY hot_item_id % 700 ORDER BY hot_item_id) AS turn FROM it)
SELECT 'GITHUB' AS source, page, 'o/r' || external_id AS key, CAST(points AS DOUBLE) AS number, source_url || ';a,' || author || ';' || CAST(epoch(published_at) AS BIGINT) AS text FROM it
UNION ALL SELECT 'HUGGING_FACE', page, CASE WHEN hot_item_id % 2 = 0 THEN 'org/m' ELSE 'm' END || external_id, points, CASE WHEN hot_item_id % 2 = 0 THEN 'org;' ELSE '' END || 'Pipeline: text-generation | Tags: ' || array_to_string([x || external_id for x in ['t0', 't1', 't2', 't3', 't4', 't5']], ', ') FROM it
UNION ALL SELECT 'HACKER_NEWS', NULL, external_id, points, CASE WHEN hot_item_id % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || external_id ELSE source_url END FROM it WHERE hot_item_id < 500
UNION ALL SELECT 'HACKER_NEWS_SEARCH', page, external_id, points, 'https://news.ycombinator.com/item?id=' || external_id FROM it WHERE hot_item_id % 5 <> 0 AND published_at > TIMESTAMP '2024-01-03 00:00:00'
UNION ALL SELECT 'WEIBO_HOT_SEARCH', page, CAST(place AS VARCHAR), points, name FROM w WHERE page % 5 <> 0 AND hot_item_id % 4 <> 1 AND name <> ''
UNION ALL SELECT 'TWITTER', page, CAST(hot_item_id % 700 AS VARCHAR), CASE WHEN hot_item_id % 3 = 0 THEN points ELSE 7 END, CASE WHEN hot_item_id % 2 = 0 THEN name ELSE 'full' END FROM tw WHERE turn = 1
UNION ALL SELECT 'SOGOU_SEARCH', page, CAST(place AS VARCHAR), points / 4.0, name FROM w WHERE hot_item_id % 6 <> 1"""
