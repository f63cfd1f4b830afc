"""Items to normalized signals, 0 to 100 in each dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import linear_signal, log_signal, rank_signal


def signal(source: Column, metrics: Column) -> Column:
    """(attention, discussion, adoption, authority, relevance, rank) of a source's metrics, a map of numbers; missing ones count as 0. Null without a source; an unknown one is an error."""

    def m(name: str) -> Column:
        return F.coalesce(F.try_element_at(metrics, F.lit(name)).cast("double"), F.lit(0.0))

    def of(attention=None, discussion=None, adoption=None, authority=0.0, relevance=None, rank=None) -> Column:
        zero = F.lit(0.0)
        return F.struct(
            (attention if attention is not None else zero).alias("attention"),
            (discussion if discussion is not None else zero).alias("discussion"),
            (adoption if adoption is not None else zero).alias("adoption"),
            F.lit(authority).alias("authority"),
            (relevance if relevance is not None else zero).alias("relevance"),
            (rank if rank is not None else F.lit(None)).cast("int").alias("rank"),
        )

    place = F.coalesce(F.try_element_at(metrics, F.lit("rank")).cast("double"), F.lit(1.0))
    total = F.coalesce(F.try_element_at(metrics, F.lit("totalCount")).cast("double"), place)
    known = F.try_element_at(metrics, F.lit("rank")).isNotNull()
    search = of(relevance=F.when(known, rank_signal(place, total)).otherwise(0.0), rank=F.when(known, place).otherwise(0))
    weibo = F.when(m("rank") > 0, F.greatest(F.lit(0.0), 100.0 - 2 * (m("rank") - 1))).otherwise(0.0)
    return (
        F.when(source == "ARXIV", of(adoption=linear_signal(m("authorsCount"), 20) * 0.6 + linear_signal(m("categoriesCount"), 10) * 0.4, authority=100.0))
        .when(source == "GITHUB", of(log_signal(m("stargazersCount") + m("watchersCount"), 5000), log_signal(m("openIssuesCount"), 500), log_signal(m("stargazersCount") + 2 * m("forksCount") + m("watchersCount"), 10000)))
        .when(source == "HUGGING_FACE", of(log_signal(m("likes"), 500), adoption=log_signal(m("downloads"), 50000)))
        .when(source.isin("HACKER_NEWS", "HACKER_NEWS_SEARCH"), of(log_signal(m("points"), 500), log_signal(m("commentsCount"), 200)))
        .when(source == "TWITTER", of(log_signal(m("viewCount") + m("likeCount"), 100000), log_signal(m("replyCount") + m("quoteCount"), 10000), log_signal(m("likeCount") + 3 * m("retweetCount"), 25000)))
        .when(source == "WEIBO_HOT_SEARCH", of(log_signal(m("points"), 1_000_000), weibo))
        .when(source.isin("BING_SEARCH", "DUCKDUCKGO_SEARCH", "SOGOU_SEARCH"), search)
        .when(source.isNull(), None)
        .otherwise(F.raise_error(F.concat(F.lit("no signals of source "), source)))
    )


def signals(items: DataFrame) -> DataFrame:
    """items with a column `signal`."""
    return items.withColumn("signal", signal(F.col("source_type"), F.col("metrics")))
