"""Source payloads to rows. Each function takes a table with a string column `payload` (a page or response each) and keeps its column `id`; transport is a file scan or the connector in connector.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BLOCKED, EMPTY_RESULT
from ..functions import html as H
from ..functions import text as T
from ..functions.text import sanitized_url


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def blocked(title: Column, page: Column) -> Column:
    return _any(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(page, F.lit("")))), BLOCKED)


def empty_result(page: Column) -> Column:
    """Whether a page says that nothing was found; a blank page doesn't."""
    return F.when(F.coalesce(F.trim(page), F.lit("")) == "", False).otherwise(_any(F.lower(page), EMPTY_RESULT))


def requires_javascript(page: Column) -> Column:
    low = F.lower(F.coalesce(page, F.lit("")))
    return low.contains("<noscript") & low.contains("javascript")


#: What is read of an Atom feed; names with another prefix than the feed's own are other elements.
_FEED = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,category:array<struct<_term:string>>,link:array<struct<_href:string,_title:string>>>>, broken string"


def arxiv(pages: DataFrame) -> DataFrame:
    """Entries of an Atom feed, with `error` where a required field is missing; a page that is no XML is one row with an error."""
    feed = pages.select("id", F.from_xml("payload", _FEED, {"columnNameOfCorruptRecord": "broken"}).alias("f"))
    rows = feed.select("id", F.col("f.broken").isNotNull().alias("broken"), F.explode_outer(F.when(F.col("f.broken").isNull(), F.coalesce("f.entry", F.array().cast(feed.schema["f"].dataType["entry"].dataType))).otherwise(F.array(F.lit(None).cast(feed.schema["f"].dataType["entry"].dataType.elementType)))).alias("e"))
    rows = rows.where("broken or e is not null")
    said = lambda c: F.nullif(T.clean(F.regexp_replace(c, r"</?[A-Za-z][^>]*>", "")), F.lit(""))
    some = lambda a, value: F.coalesce(F.filter(F.transform(a, value), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    url = said(F.col("e.id"))
    rows = rows.select(
        "id", "broken", F.coalesce(F.regexp_extract(url, r"/abs/(.+)$", 1), F.lit("")).alias("arxiv_id"), url.alias("url"), said(F.col("e.title")).alias("title"), said(F.col("e.summary")).alias("summary"),
        some("e.author", lambda x: said(x["name"])).alias("authors"), some("e.category", lambda x: F.nullif(F.trim(x["_term"]), F.lit(""))).alias("categories"), F.try_to_timestamp(said(F.col("e.published"))).alias("published_at"),
        F.get(F.filter("e.link", lambda x: (x["_title"] == "pdf") & (F.trim(x["_href"]) != "")), F.lit(0))["_href"].alias("pdf_url"),
    )
    missing = (F.col("arxiv_id") == "") | F.col("title").isNull() | F.col("published_at").isNull()
    return rows.withColumn("error", F.when(F.col("broken"), "no XML").when(missing, "missing field")).drop("broken")


_REPO = "array<struct<full_name:string,html_url:string,description:string,language:string,stargazers_count:bigint,forks_count:bigint,watchers_count:bigint,open_issues_count:bigint,topics:array<string>,created_at:string,updated_at:string,owner:struct<login:string>>>"


def github(pages: DataFrame) -> DataFrame:
    rows = pages.select("id", F.explode(F.from_json(F.get_json_object("payload", "$.items"), _REPO)).alias("r"))
    return rows.select("id", "r.full_name", F.col("r.html_url").alias("url"), "r.description", "r.language", "r.stargazers_count", "r.forks_count", "r.watchers_count", "r.open_issues_count", F.filter(F.transform("r.topics", lambda t: F.trim(t)), lambda t: t != "").alias("topics"), F.try_to_timestamp("r.updated_at").alias("updated_at"), F.col("r.owner.login").alias("owner"))


def hugging_face(pages: DataFrame) -> DataFrame:
    kind = "array<struct<modelId:string,id:string,downloads:bigint,likes:bigint,pipeline_tag:string,tags:array<string>,lastModified:string>>"
    rows = pages.select("id", F.explode(F.from_json("payload", kind)).alias("m"))
    model = F.coalesce("m.modelId", "m.id")
    return rows.select("id", model.alias("model_id"), F.when(model.contains("/"), F.substring_index(model, "/", 1)).alias("author"), "m.downloads", "m.likes", "m.pipeline_tag", "m.tags", F.concat_ws(" | ", F.concat(F.lit("Pipeline: "), "m.pipeline_tag"), F.concat(F.lit("Tags: "), F.array_join(F.slice("m.tags", 1, 6), ", "))).alias("summary"))


def sort_direction(direction: Column) -> Column:
    """What a model search's request says for asc (1), desc or nothing (-1); null for what it does not take."""
    d = F.lower(F.trim(F.coalesce(direction, F.lit(""))))
    return F.when(d == "asc", 1).when(d.isin("", "desc"), -1)


def news_stories(stories: DataFrame, top: DataFrame, limit: int) -> DataFrame:
    """Stories (payload JSON) whose ids are among the first `limit` of top (place, item_id); a story without URL points to its discussion."""
    j = lambda p: F.get_json_object("payload", f"$.{p}")
    first = top.where(F.col("place") < limit).select("item_id")
    rows = stories.select(j("id").cast("long").alias("item_id"), j("title").alias("title"), j("url").alias("url"), j("by").alias("author"), j("score").cast("long").alias("score"), j("descendants").cast("long").alias("descendants"))
    url = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("item_id").cast("string")))
    return rows.join(first, "item_id", "left_semi").withColumn("url", url)


def news_search(pages: DataFrame, since: Column) -> DataFrame:
    kind = "array<struct<objectID:string,title:string,url:string,author:string,points:bigint,num_comments:bigint,created_at_i:bigint>>"
    rows = pages.select("id", F.explode(F.from_json(F.get_json_object("payload", "$.hits"), kind)).alias("h")).select("id", "h.*")
    url = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID"))
    return rows.where((F.coalesce(F.trim("objectID"), F.lit("")) != "") & (F.col("created_at_i") > F.unix_seconds(since))).withColumn("url", url)


def weibo(pages: DataFrame) -> DataFrame:
    """Topics of pages that say ok, ranked by place, blanks counted."""
    kind = "array<struct<word:string,note:string,category:string,num:bigint>>"
    rows = pages.where(F.get_json_object("payload", "$.ok") == "1").select("id", F.posexplode(F.from_json(F.get_json_object("payload", "$.data.realtime"), kind)).alias("p", "t"))
    return rows.where(F.coalesce(F.trim("t.word"), F.lit("")) != "").select("id", (F.col("p") + 1).alias("rank"), "t.*")


def tweets(pages: DataFrame, only_original: bool = False) -> DataFrame:
    """Tweets of result pages (id, place of the page), each once, the first one; names differ by interface version. Pages of several searches (top, latest) may follow each other by id. only_original: no replies and retweets."""
    kind = "array<struct<id:string,id_str:string,text:string,full_text:string,likeCount:bigint,favorite_count:bigint,retweetCount:bigint,retweet_count:bigint,viewCount:bigint,replyCount:bigint,reply_count:bigint,quoteCount:bigint,quote_count:bigint,bookmarkCount:bigint,isReply:boolean,in_reply_to_status_id_str:string,createdAt:string,created_at:string,author:struct<userName:string,followers:bigint,isBlueVerified:boolean>>>"
    rows = pages.select("id", F.posexplode(F.from_json(F.get_json_object("payload", "$.tweets"), kind)).alias("p", "t"))
    rows = rows.select("id", "p", F.coalesce("t.id", "t.id_str").alias("tweet_id"), F.coalesce("t.text", "t.full_text").alias("text"), F.coalesce("t.likeCount", "t.favorite_count", F.lit(0)).alias("like_count"), F.coalesce("t.retweetCount", "t.retweet_count", F.lit(0)).alias("retweet_count"), F.coalesce("t.viewCount", F.lit(0)).alias("view_count"), F.coalesce("t.replyCount", "t.reply_count", F.lit(0)).alias("reply_count"), F.coalesce("t.quoteCount", "t.quote_count", F.lit(0)).alias("quote_count"), F.coalesce("t.bookmarkCount", F.lit(0)).alias("bookmark_count"), F.coalesce("t.isReply", F.col("t.in_reply_to_status_id_str").isNotNull()).alias("is_reply"), F.coalesce("t.author.followers", F.lit(0)).alias("followers"), F.coalesce("t.author.isBlueVerified", F.lit(False)).alias("verified"))
    if only_original:
        rows = rows.where(~F.col("is_reply") & ~F.coalesce(F.col("text").startswith("RT @"), F.lit(False)))
    w = Window.partitionBy("tweet_id").orderBy("id", "p")
    return rows.where("tweet_id is not null").withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn", "p")


def sogou(pages: DataFrame) -> DataFrame:
    """Results that are JSON texts in a JSON array; ones that can't be read are skipped, ranks go by place."""
    rows = pages.select("id", F.posexplode(F.from_json(F.get_json_object("payload", "$.Response.Pages"), "array<string>")).alias("p", "s"))
    j = lambda k: F.get_json_object("s", f"$.{k}")
    at = F.coalesce(F.try_to_timestamp(j("date"), F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(j("date")))
    return rows.where(F.try_parse_json("s").isNotNull() & j("title").isNotNull()).select("id", (F.col("p") + 1).alias("rank"), j("title").alias("title"), j("url").alias("url"), j("passage").alias("summary"), j("site").alias("site"), j("score").try_cast("double").alias("score"), at.alias("published_at"))


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with a title and a fit URL, ranked among themselves."""
    w = Window.partitionBy("id").orderBy("p")
    return rows.where("title is not null and url is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("p")


def _link(html: Column) -> tuple[Column, Column]:
    """(text, address) of the first link."""
    return H.text_of(H.content(html, H.opening("a"))), H.attribute(F.regexp_extract(html, f"(?is){H.opening('a')}", 0), "href")


def _results(pages: DataFrame, blocks: Column, one, limit: int) -> DataFrame:
    """Rows of results, ranked: one(block) is a struct of their columns. Each block is taken apart once: what reads the structs, filters included, stays behind the explosion."""
    rows = pages.select("id", F.posexplode_outer(F.transform(blocks, one)).alias("p", "r")).where("p is not null")
    return _ranked(rows.select("id", "p", "r.*"), limit)


def bing(pages: DataFrame, limit: int = 10) -> DataFrame:
    """Results of a page: list elements of class b_algo, each to its own end, whatever it holds."""

    def one(block: Column) -> Column:
        parts = F.struct(block.alias("b"), H.content(block, H.opening("h2")).alias("head"), H.content(block, H.opening(css_class="b_caption")).alias("caption"))
        return T.bound(parts, read)

    def read(m: Column) -> Column:
        title, url = _link(m["head"])
        # results without a caption have their paragraph and address beside the title
        part = lambda tag: H.text_of(H.content(F.coalesce(m["caption"], m["b"]), H.opening(tag)))
        return F.struct(title.alias("title"), T.bound(url, sanitized_url).alias("url"), part("p").alias("summary"), part("cite").alias("cite"))

    return _results(pages, H.contents(H.visible(F.col("payload")), H.opening("li", "b_algo")), one, limit)


def duckduckgo(pages: DataFrame, limit: int = 10) -> DataFrame:
    """Results of a page: elements of class result, each to its own end; pages without any have links of class result__a alone, each with what follows to the next."""
    start = H.opening("a", "result__a")

    def blocks(page: Column) -> Column:
        tails = F.filter(F.split(page, f"(?is)(?={start})"), lambda p: p.rlike(f"(?is)^{start}"))
        return T.bound(H.contents(page, H.opening(css_class="result")), lambda found: F.when(F.size(found) > 0, found).otherwise(tails))

    def one(block: Column) -> Column:
        return T.bound(F.struct(block.alias("b"), F.coalesce(H.content(block, H.opening(css_class="result__title")), block).alias("head")), read)

    def read(m: Column) -> Column:
        title, href = _link(m["head"])
        address = T.bound(href, lambda h: F.when(h.contains("uddg="), F.coalesce(F.try_url_decode(F.regexp_extract(h, r"uddg=([^&]*)", 1)), h)).otherwise(h))
        return F.struct(title.alias("title"), T.bound(address, sanitized_url).alias("url"), H.text_of(H.content(m["b"], H.opening(css_class="result__snippet"))).alias("summary"))

    return _results(pages, T.bound(H.visible(F.col("payload")), blocks), one, limit)


#: By source, number settings with default, least and greatest value; settings with what they match (case apart where (?i) leads); and settings that must not be blank. Blank texts count as unset where a default stands for them.
RULES = {
    "HACKER_NEWS": ({"fetchLimit": (100, 1, 100)}, {"feed": r"(?i)TOP"}, ()),
    "ARXIV": ({"start": (0, 0, None), "maxResults": (20, 1, 100)}, {}, ("searchQuery",)),
    "GITHUB": ({"perPage": (10, 1, 100), "page": (1, 1, None)}, {"sort": r"(?i)\s*(stars|forks|updated)?\s*", "order": r"(?i)\s*(asc|desc)?\s*"}, ("query",)),
    "HUGGING_FACE": ({"limit": (20, 1, 100)}, {"sort": r"(?i)\s*(downloads|likes|createdAt|lastModified)?\s*", "direction": r"(?i)\s*(asc|desc)?\s*"}, ("search",)),
    "SOGOU_SEARCH": ({}, {"cnt": "10|20|30|40|50", "mode": "0|1|2", "freshness": r"\s*([dmy]\d{0,2})?\s*"}, ("query",)),
    "WEIBO_HOT_SEARCH": ({}, {}, ("query",)),
    "HACKER_NEWS_SEARCH": ({"limit": (20, 1, 100), "freshnessHours": (24, 1, 720)}, {}, ("query",)),
    "TWITTER": ({"limit": (20, 1, 100), "topDays": (7, 1, 30), "latestDays": (3, 1, 30), "minLikes": (10, 0, None), "minRetweets": (5, 0, None), "minViews": (500, 0, None), "minFollowers": (100, 0, None)}, {}, ("query",)),
    "BING_SEARCH": ({"limit": (10, 1, 20), "freshnessDays": (7, 1, 30)}, {"market": r"\s*[a-z]{2}-[A-Z]{2}\s*", "safeSearch": r"\s*(off|moderate|strict)\s*"}, ("query",)),
    "DUCKDUCKGO_SEARCH": ({"limit": (10, 1, 20), "freshnessDays": (7, 1, 30)}, {}, ("query",)),
}
#: Fixed value: results of a code search that pages reach.
REACH = 1000


def config_errors(sources: DataFrame) -> DataFrame:
    """sources (source_code, source_type, config_payload JSON, crawl_interval_minutes) with the list of settings that are wrong, by name. An unset number has its default, and one that is no number counts as 0 unless it is written as one."""
    j = lambda k: F.get_json_object("config_payload", f"$.{k}")

    def number(k: str, default: int) -> Column:
        return F.when(j(k).isNull(), default).otherwise(F.coalesce(F.floor(j(k).try_cast("double")), F.lit(default))).cast("long")

    found = [F.when(F.col("crawl_interval_minutes") <= 0, "crawlIntervalMinutes"), F.when(F.try_parse_json("config_payload").isNull(), "config")]
    for s, (numbers, words, needed) in RULES.items():
        here = F.col("source_type") == s
        for k, (default, low, high) in numbers.items():
            v = number(k, default)
            found.append(F.when(here & ((v < low) | (v > high if high is not None else F.lit(False))), k))
        for k, pattern in words.items():
            found.append(F.when(here & j(k).isNotNull() & ~j(k).rlike(rf"^(?:{pattern})$" if not pattern.startswith("(?i)") else rf"(?i)^(?:{pattern[4:]})$"), k))
        for k in needed:
            found.append(F.when(here & (F.coalesce(F.trim(j(k)), F.lit("")) == ""), k))
    keywords = F.from_json(j("keywords"), "array<string>")
    found.append(F.when((F.col("source_type") == "HACKER_NEWS") & ~F.coalesce(F.size(keywords) > 0, F.lit(False)), "keywords"))
    far = (number("page", 1) - 1) * number("perPage", 10) >= REACH
    found.append(F.when((F.col("source_type") == "GITHUB") & far, "reach"))
    found.append(F.when(~F.col("source_type").isin(*RULES), "sourceType"))
    return sources.select("source_code", F.array_join(F.array_compact(F.array(*found)), ",").alias("errors"))


def annotations(lines: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new cases (dataset, case_code, case_type, payload), bad lines) of JSON lines (line_number, value): blank lines are skipped; of equal codes in a dataset the first counts; known ones are left out; a line needs a code, and a type that is known (see evaluation.CASE_TYPES)."""
    from ..operators.evaluation import CASE_TYPES

    j = lambda k: F.nullif(F.trim(F.get_json_object("value", f"$.{k}")), F.lit(""))
    rows = lines.where(F.trim("value") != "").select("line_number", "value", F.coalesce(j("dataset"), F.lit("")).alias("dataset"), j("case_code").alias("case_code"), j("case_type").alias("case_type"), F.try_parse_json("value").isNotNull().alias("json"))
    rows = rows.withColumn("reason", F.when(~F.col("json"), "not JSON").when(F.col("case_code").isNull(), "no case_code").when(F.col("case_type").isNotNull() & ~F.col("case_type").isin(*CASE_TYPES), "unknown case_type"))
    keys = ["dataset", "case_code"]
    w = Window.partitionBy(*keys).orderBy("line_number")
    known = existing if "dataset" in existing.columns else existing.withColumn("dataset", F.lit(""))
    good = rows.where("reason is null").withColumn("turn", F.row_number().over(w)).where("turn = 1").join(known.select(*keys), keys, "left_anti")
    return good.select("dataset", "case_code", "case_type", F.col("value").alias("payload")), rows.where("reason is not null").select("line_number", "reason")
