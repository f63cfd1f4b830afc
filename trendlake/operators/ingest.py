"""Raw records to items: normalizers, upserts, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: For each source: item type, JSON paths of title, required fields, points and comments (SQL over j(path)), parts of the content hash, and paths of further metrics.
_N = {
    "ARXIV": ("PAPER", "title", ("title", "arxivId", "url"), "0", "0", ("arxivId", "lower:title"), ("authorsCount", "categoriesCount")),
    "HACKER_NEWS": ("POST", "title", ("title",), "score", "descendants", ("lower:title", "url"), ()),
    "HACKER_NEWS_SEARCH": ("ARTICLE", "title", ("objectId", "title"), "points", "numComments", ("lower:objectId",), ()),
    "GITHUB": ("REPOSITORY", "fullName", ("fullName", "url"), "stargazersCount", "forksCount", ("lower:fullName", "url"), ("stargazersCount", "forksCount", "watchersCount", "openIssuesCount")),
    "HUGGING_FACE": ("MODEL", "modelId", ("modelId", "url"), "downloads", "likes", ("lower:modelId", "url"), ("downloads", "likes")),
    "BING_SEARCH": ("WEB_PAGE", "title", ("title", "url"), "place", "0", ("lower:title", "url"), ("rank",)),
    "DUCKDUCKGO_SEARCH": ("WEB_PAGE", "title", ("title", "url"), "place", "0", ("lower:title", "url"), ("rank",)),
    "SOGOU_SEARCH": ("SEARCH_RESULT", "title", ("title", "url"), "place", "0", ("lower:title", "url"), ("rank", "score")),
    "WEIBO_HOT_SEARCH": ("TREND", "word", ("word",), "num", "0", ("lower:word", "url"), ("rank", "rawHot")),
    "TWITTER": ("POST", "text", ("tweetId", "text"), "tweet", "replies", ("lower:tweetId",), ("likeCount", "retweetCount", "replyCount", "quoteCount", "viewCount")),
}


_TEXTS = ("title", "url", "type", "dead", "deleted", "arxivId", "objectId", "tweetId", "text", "word", "fullName", "modelId", "publishedAt", "summary", "description", "language", "updatedAt", "ownerLogin", "author", "authorName", "authorUsername", "by", "storyText", "snippet", "passage", "content", "note", "category", "query", "market", "region", "site", "pipelineTag", "pdfUrl", "libraryName", "lastModified", "private")
_LISTS = ("categories", "authors", "topics", "tags")
_NUMBERS = ("score", "descendants", "points", "numComments", "stargazersCount", "forksCount", "watchersCount", "openIssuesCount", "downloads", "likes", "num", "rank", "totalCount", "likeCount", "retweetCount", "viewCount", "replyCount", "quoteCount", "rawHot")


def _told(source: str, j, n) -> tuple[Column, Column, Column]:
    """(tags, summary, author) of a source's payload. Tags are clean, not blank, and each there once, whatever its case; summaries have a length at most; blank ones are null."""
    clean = lambda c: F.coalesce(T.clean(j(c)), F.lit(""))
    some = lambda x: F.when(x != "", x)
    short = lambda x, most=2000: some(F.substring(x, 1, most))
    list_of = lambda c: F.coalesce(F.transform(j(c), lambda x: F.coalesce(T.clean(x), F.lit(""))), F.array().cast("array<string>"))
    words = lambda p: F.split(clean("query"), p)
    host = F.coalesce(T.host_of(j("url")), F.lit(""))
    label = lambda s: F.array(F.lit(s))
    tags = {
        "ARXIV": lambda: list_of("categories"), "HACKER_NEWS": lambda: F.col("matched"), "HACKER_NEWS_SEARCH": lambda: F.array(F.lit("hacker-news-search"), clean("query")), "GITHUB": lambda: F.array_append(list_of("topics"), clean("language")),
        "HUGGING_FACE": lambda: F.array_append(list_of("tags"), clean("pipelineTag")), "BING_SEARCH": lambda: F.concat(label("bing-search"), words(r"\s+"), F.array(clean("market"), host)), "DUCKDUCKGO_SEARCH": lambda: F.concat(label("duckduckgo-search"), words(r"\s+"), F.array(clean("region"), host)),
        "SOGOU_SEARCH": lambda: F.array_append(words(r"\s+OR\s+|\s+"), clean("site")), "WEIBO_HOT_SEARCH": lambda: F.array(F.lit("weibo-hot-search"), clean("query"), clean("category")), "TWITTER": lambda: F.concat(F.array(F.lit("twitter"), clean("query")), T.hashtags(clean("text"))),
    }[source]()
    tags = F.filter(tags, lambda t: t != "")
    if source not in ("ARXIV", "HACKER_NEWS"):
        tags = T.distinct_ignoring_case(tags)
    model = F.concat_ws(" | ", F.concat(F.lit("Pipeline: "), some(clean("pipelineTag"))), F.concat(F.lit("Tags: "), some(F.array_join(F.slice(tags, 1, 6), ", "))))
    heat = F.concat(F.lit("热度: "), n("num").cast("string"))
    summary = {
        "ARXIV": lambda: short(clean("summary")), "HACKER_NEWS": lambda: short(T.clean_html(j("text"), " "), 1000), "HACKER_NEWS_SEARCH": lambda: short(clean("storyText")), "GITHUB": lambda: short(clean("description")), "HUGGING_FACE": lambda: short(model),
        "BING_SEARCH": lambda: short(clean("snippet")), "DUCKDUCKGO_SEARCH": lambda: short(clean("snippet")), "SOGOU_SEARCH": lambda: short(F.coalesce(some(clean("passage")), clean("content"))),
        "WEIBO_HOT_SEARCH": lambda: short(F.coalesce(F.concat(some(clean("note")), F.lit(" ("), heat, F.lit(")")), heat), 500), "TWITTER": lambda: some(clean("text")),
    }[source]()
    author = {
        "ARXIV": lambda: some(F.get(list_of("authors"), F.lit(0))), "HACKER_NEWS": lambda: j("by"), "HACKER_NEWS_SEARCH": lambda: some(clean("author")), "GITHUB": lambda: some(clean("ownerLogin")), "HUGGING_FACE": lambda: F.coalesce(some(clean("author")), F.when(F.instr(clean("modelId"), "/") > 1, F.substring_index(clean("modelId"), "/", 1))),
        "BING_SEARCH": lambda: F.coalesce(some(host), F.lit("Bing Search")), "DUCKDUCKGO_SEARCH": lambda: F.coalesce(some(host), F.lit("DuckDuckGo Search")), "SOGOU_SEARCH": lambda: some(clean("site")), "WEIBO_HOT_SEARCH": lambda: F.lit("微博热搜"), "TWITTER": lambda: F.coalesce(some(clean("authorName")), some(clean("authorUsername"))),
    }[source]()
    return tags, summary, author


def _text_metrics(source: str, j) -> Column:
    """A map of what a source tells besides numbers: clean texts, blank ones left out."""
    clean = lambda c: F.coalesce(T.clean(j(c)), F.lit(""))
    pdf = T.canonical_url(F.regexp_replace(j("pdfUrl"), r"http://(?:www\.)?arxiv\.org/", "https://arxiv.org/"))
    host = F.coalesce(T.host_of(j("url")), F.lit(""))
    named = {
        "ARXIV": {"pdfUrl": F.coalesce(pdf, F.lit(""))}, "HUGGING_FACE": {**{c: clean(c) for c in ("pipelineTag", "libraryName", "lastModified")}, "private": F.when(j("private") == "true", "true").otherwise("false")},
        "BING_SEARCH": {"sourceHost": host, "market": clean("market")}, "DUCKDUCKGO_SEARCH": {"sourceHost": host, "region": clean("region")}, "SOGOU_SEARCH": {"site": clean("site")}, "WEIBO_HOT_SEARCH": {"category": clean("category")},
    }.get(source, {})
    if not named:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_filter(F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))), lambda k, v: F.trim(v) != "")


def matched_keywords(text: Column, keywords: Column) -> Column:
    """Those of a source's keywords that a text holds, whatever their case; empty for none."""
    given = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: F.coalesce(k != "", F.lit(False)))
    return T.bound(F.lower(text), lambda t: F.filter(given, lambda k: t.contains(F.lower(k))))


def normalize(raw: DataFrame, carried: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """`carried` columns of raw are kept; with `every` all records are, with a column ok. raw (id, source_type, external_id, raw_payload JSON, fetched_at, and for news posts keywords array<string>, as their source is configured) to items; records without a required field are dropped, as are news posts that are no stories, are dead or deleted, or hold none of the keywords."""
    if "keywords" not in raw.columns:
        raw = raw.withColumn("keywords", F.lit(None).cast("array<string>"))
    raw = raw.withColumn("p", F.from_json("raw_payload", ", ".join([*(f"{c} string" for c in (*_TEXTS, *_NUMBERS)), *(f"{c} array<string>" for c in _LISTS)])))
    raw = raw.select("id", "source_type", "external_id", "fetched_at", "keywords", *carried, *(F.col(f"p.{c}").alias(c) for c in (*_TEXTS, *_LISTS)), *(F.coalesce(F.col(f"p.{c}").try_cast("long"), F.lit(0).cast("long")).alias(c) for c in _NUMBERS), F.coalesce(F.col("p.score").try_cast("double"), F.lit(0.0)).alias("exact_score"))
    counted = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0))).cast("long")
    # an address that the source doesn't give follows from the record
    url = F.when(F.col("source_type") == "TWITTER", F.concat(F.lit("https://twitter.com/i/web/status/"), F.trim("tweetId"))).when(F.col("source_type") == "WEIBO_HOT_SEARCH", F.concat(F.lit("https://s.weibo.com/weibo?q="), F.url_encode(T.clean(F.col("word"))))).otherwise(F.col("url"))
    raw = raw.withColumns({"authorsCount": counted("authors"), "categoriesCount": counted("categories"), "url": url})
    post = F.concat_ws(" ", F.coalesce(T.clean_html(F.col("title"), " "), F.lit("")), T.clean_html(F.col("text"), " "))
    raw = raw.withColumn("matched", F.when(F.col("source_type") == "HACKER_NEWS", matched_keywords(post, F.col("keywords"))))
    j = n = F.col
    cases: dict[str, Column] = {}

    def add(name: str, source: str, value: Column) -> None:
        here = F.col("source_type") == source
        cases[name] = cases[name].when(here, value) if name in cases else F.when(here, value)

    for s, (kind, title, needed, points, comments, hashed, metrics) in _N.items():
        said = T.clean_html(j(title), " ") if s == "HACKER_NEWS" else T.clean(j(title))
        add("item_type", s, F.lit(kind))
        add("title", s, F.substring(said, 1, 100) if s == "TWITTER" else said)
        ok = F.lit(True)
        for p in needed:
            ok = ok & (F.coalesce(F.trim(j(p)), F.lit("")) != "")
        if s == "HACKER_NEWS":
            ok = ok & (F.coalesce(j("type"), F.lit("")) == "story") & ~F.coalesce(j("dead") == "true", F.lit(False)) & ~F.coalesce(j("deleted") == "true", F.lit(False)) & (F.size("matched") > 0)
        add("ok", s, ok)
        for name, value in zip(("tags", "summary", "author"), _told(s, j, n)):
            add(name, s, value)
        likes = n("likeCount") + 3 * n("retweetCount") + F.floor(n("viewCount") / 100)
        value = {"place": F.greatest(F.lit(1).cast("long"), n("totalCount") - n("rank") + 1), "tweet": likes, "replies": n("replyCount") + n("quoteCount"), "0": F.lit(0).cast("long")}
        add("points", s, value.get(points) if points in value else n(points))
        add("comments_count", s, value.get(comments) if comments in value else n(comments))
        parts = [F.lower(T.clean(j(h[6:]))) if h.startswith("lower:") else F.coalesce(T.canonical_url(j(h)) if h == "url" else j(h), F.lit("")) for h in hashed]
        add("content_hash", s, F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256))
        pairs = [x for m in metrics for x in (F.lit(m), n("exact_score" if m == "score" else m).cast("double"))]
        add("text_metrics", s, _text_metrics(s, j))
        add("metrics", s, F.map_concat(F.create_map(F.lit("points"), cases["points"].cast("double"), F.lit("commentsCount"), cases["comments_count"].cast("double")), F.create_map(*pairs)) if pairs and s not in ("HACKER_NEWS",) else F.create_map(F.lit("points"), cases["points"].cast("double"), F.lit("commentsCount"), cases["comments_count"].cast("double")))
    rows = raw.select("id", "source_type", "external_id", *carried, *(v.alias(k) for k, v in cases.items()), T.canonical_url(j("url")).alias("source_url"), F.when(F.col("source_type") == "GITHUB", F.nullif(T.clean(j("language")), F.lit(""))).alias("language"), F.try_to_timestamp(j("publishedAt")).alias("published_at"), "fetched_at")
    rows = rows.withColumn("ok", F.coalesce("ok", F.lit(False)))
    return rows if every else rows.where("ok").drop("ok")


def with_payload_hash(raw: DataFrame) -> DataFrame:
    return raw.withColumn("payload_hash", F.sha2(F.col("raw_payload").cast("binary"), 256))


def upsert(items: DataFrame) -> DataFrame:
    """One row a (source_type, external_id): the latest by fetched_at, then id, with the first and last time seen."""
    rest = [c for c in items.columns if c not in ("source_type", "external_id")]
    rows = items.groupBy("source_type", "external_id").agg(F.min("fetched_at").alias("first_seen_at"), F.max_by(F.struct(*rest), F.struct("fetched_at", "id")).alias("r"))
    return rows.select("source_type", "external_id", "r.*", "first_seen_at", F.col("r.fetched_at").alias("last_seen_at"))


def new_only(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are new, one for each key."""
    return rows.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def split_errors(rows: DataFrame, error: Column, stage: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters with stage and message of at most 1000 characters)."""
    told = rows.withColumn("error_message", F.substring(error, 1, 1000))
    return told.where("error_message is null").drop("error_message"), told.where("error_message is not null").withColumn("stage", F.lit(stage))


def deduplicated(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


def tweet_score(likes: Column, retweets: Column, views: Column) -> Column:
    return likes + 3 * retweets + F.floor(views / 100)


def good_tweets(tweets: DataFrame, likes: int, retweets: int, views: int, followers: int) -> DataFrame:
    """Tweets that reach all thresholds; verified authors need half, 1 at least."""
    ok = F.lit(True)
    for c, n in (("like_count", likes), ("retweet_count", retweets), ("view_count", views), ("followers", followers)):
        ok = ok & (F.col(c) >= F.when(F.col("verified"), max(1, n // 2)).otherwise(n))
    return tweets.where(ok)


def match_or_top(topics: DataFrame, needle: str, n: int = 5, include_top: bool = False) -> DataFrame:
    """Topics whose word, note or category holds the text; where none does, the first n with `include_top`, else none."""
    hit = F.lit(False)
    for c in ("word", "note", "category"):
        hit = hit | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    found = topics.where(hit)
    if not include_top:
        return found
    none = found.agg((F.count("*") == 0).alias("none"))
    return found.unionByName(topics.orderBy("rank").limit(n).join(F.broadcast(none), F.col("none")).drop("none"))


def tweet_query(words: Column, since: Column, likes: int) -> Column:
    return F.concat_ws(" ", words, F.lit("-filter:retweets -filter:replies"), F.concat(F.lit("since:"), F.date_format(since, "yyyy-MM-dd")), F.when(F.lit(likes) > 0, F.lit(f"min_faves:{likes}")))


def top_tweets(tweets: DataFrame, n: int) -> DataFrame:
    """The n tweets with the best score; equal ones by id."""
    return tweets.orderBy(tweet_score(F.col("like_count"), F.col("retweet_count"), F.col("view_count")).desc(), "tweet_id").limit(n)
