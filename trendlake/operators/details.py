"""What a page shows of one cluster, its analysis with all its fields, and the contents of daily reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean

#: Sentences of an analysis, what follows up on it, the code of a failed one, and the most references.
SCOPES = ("a focused source channel", "multiple source types")
RECENT, TRAIL = "The latest evidence is still recent.", "The cluster already has a persisted evidence trail."
FOLLOW_UPS = ("Compare the next crawl against this cluster to confirm the trend is still active.", "Review raw evidence for the top-linked source before escalating this signal.")
ONE_SOURCE, FEW, ENOUGH = "This signal still depends on a single source family.", "Evidence density is still light, so the narrative may shift after the next crawl.", "Cross-source clustering should still be spot-checked against raw evidence."
NO_EVIDENCE, NO_SUMMARY = "No evidence summary available.", "No analysis summary available."
FAILURE, REFERENCES = "ANALYSIS_GENERATION_FAILED", 3

#: What evidence shows of an item.
ITEM = {"hot_item_id": "hotItemId", "source_type": "sourceType", "external_id": "externalId", "title": "title", "summary": "summary", "source_url": "sourceUrl", "author": "author", "published_at": "publishedAt"}


def _sources(placed: DataFrame) -> DataFrame:
    """(hot_cluster_id, n, sources): number of items, and distinct sources in order of evidence. Members are reduced to a row a source before any are gathered."""
    first = placed.groupBy("hot_cluster_id", "source_type").agg(F.count("*").alias("k"), F.min("place").alias("place"))
    order = F.sort_array(F.collect_list(F.when(F.col("source_type").isNotNull(), F.struct("place", "source_type"))))
    return first.groupBy("hot_cluster_id").agg(F.sum("k").alias("n"), F.transform(order, lambda s: s["source_type"]).alias("sources"))


def details(clusters: DataFrame, placed: DataFrame, scores: DataFrame) -> DataFrame:
    """clusters with item_count, sources (array, in order of evidence), total_score and items (array of structs, in order of evidence). placed: members with items and a place, as evidence() gives them. All items of a cluster are one array: meant for the clusters of a page."""
    have = [(c, n) for c, n in ITEM.items() if c in placed.columns]
    items = F.transform(F.sort_array(F.collect_list(F.struct("place", F.struct(*(F.col(c).alias(n) for c, n in have)).alias("item")))), lambda x: x["item"])
    rows = clusters.join(_sources(placed), "hot_cluster_id", "left").join(placed.groupBy("hot_cluster_id").agg(items.alias("items")), "hot_cluster_id", "left")
    rows = rows.join(scores.select("hot_cluster_id", "total_score"), "hot_cluster_id", "left")
    return rows.select(*clusters.columns, F.coalesce("n", F.lit(0)).alias("item_count"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "total_score", F.col("items"))


def _plain(x: Column) -> Column:
    """A number without trailing zeros or exponent."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(24,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def analysis_results(clusters: DataFrame, placed: DataFrame, scores: DataFrame) -> DataFrame:
    """(hot_cluster_id, status, failure_code, failure_message, result): a deterministic analysis of each cluster (hot_cluster_id, title, summary, last_seen_at) from its evidence `placed`. result: headline, brief, why_it_matters, key_signals, evidence_refs, risks, follow_ups, confidence. One that lacks a field that is required has FAILED, says which, and has no result. Of a cluster's members its first three, two texts and its sources are gathered."""
    said = lambda c: F.coalesce(clean(F.col(c)), F.lit(""))
    ref = F.struct("place", F.struct(F.col("hot_item_id").alias("hotItemId"), F.col("source_type").alias("sourceType"), "title", F.col("source_url").alias("sourceUrl")).alias("ref"))
    of_items = placed.groupBy("hot_cluster_id").agg(
        F.min_by(F.when(said("summary") != "", said("summary")), F.when(said("summary") != "", F.col("place"))).alias("first_summary"), F.min_by(said("title"), "place").alias("first_title"),
        F.max_by("source_type", F.when(F.col("published_at").isNotNull(), F.struct("published_at", -F.col("place")))).alias("latest"),
    )
    refs = placed.where(F.col("place") <= REFERENCES).groupBy("hot_cluster_id").agg(F.transform(F.sort_array(F.collect_list(ref)), lambda r: r["ref"]).alias("refs"))
    rows = clusters.join(_sources(placed), "hot_cluster_id", "left").join(of_items, "hot_cluster_id", "left").join(refs, "hot_cluster_id", "left").join(scores.select("hot_cluster_id", "total_score"), "hot_cluster_id", "left")
    some = lambda x: F.when(F.trim(x) != "", x)
    rows = rows.withColumns({"n": F.coalesce("n", F.lit(0)), "sources": F.coalesce("sources", F.array().cast("array<string>")), "headline": said("title")})
    k = F.size("sources")
    names = F.array_join("sources", ", ")
    brief = F.coalesce(some(said("summary")), some(F.col("first_summary")), some(F.coalesce("first_title", F.lit(NO_EVIDENCE))), F.lit(NO_SUMMARY))
    why = F.concat(F.lit("This cluster turns scattered signals into an event-level view across "), F.when(k > 1, SCOPES[1]).otherwise(SCOPES[0]), F.lit(" ("), names, F.lit("). "), F.when(F.col("last_seen_at").isNotNull(), RECENT).otherwise(TRAIL))
    score = F.coalesce(F.concat(F.lit("score "), _plain(F.col("total_score"))), F.lit("no score yet"))
    signals = F.array_compact(F.array(
        F.concat(F.lit("The cluster currently aggregates "), F.col("n").cast("string"), F.lit(" evidence item(s).")), F.concat(F.lit("Source coverage includes "), names, F.lit(".")),
        F.concat(F.lit("The cluster remains active with "), score, F.lit(".")), F.concat(F.lit("Latest evidence came from "), F.col("latest"), F.lit(".")),
    ))
    risks = F.array_compact(F.array(F.when(k <= 1, ONE_SOURCE), F.when(F.col("n") < 3, FEW)))
    confidence = F.when((k >= 2) & (F.col("n") >= 2), "HIGH").when(F.col("n") >= 2, "MEDIUM").otherwise("LOW")
    result = F.struct(
        "headline", brief.alias("brief"), why.alias("why_it_matters"), signals.alias("key_signals"), F.col("refs").alias("evidence_refs"),
        F.when(F.size(risks) > 0, risks).otherwise(F.array(F.lit(ENOUGH))).alias("risks"), F.array(*map(F.lit, FOLLOW_UPS)).alias("follow_ups"), confidence.alias("confidence"),
    )
    needed = lambda field: f"Structured analysis field {field} is required."
    rows = rows.select("hot_cluster_id", result.alias("r"))
    wrong = F.when(F.col("r.headline") == "", needed("headline")).when(F.trim("r.brief") == "", needed("brief")).when(F.size(F.coalesce("r.evidence_refs", F.array())) == 0, "At least one evidence reference is required.")
    rows = rows.withColumn("failure_message", wrong)
    ok = F.col("failure_message").isNull()
    return rows.select("hot_cluster_id", F.when(ok, "SUCCEEDED").otherwise("FAILED").alias("status"), F.when(~ok, FAILURE).alias("failure_code"), "failure_message", F.when(ok, F.col("r")).alias("result"))


def report_contents(top: DataFrame, placed: DataFrame, scores: DataFrame, analyses: DataFrame) -> DataFrame:
    """(report_date, content): for each day, the JSON array of its clusters in order, each with title, summary, sources, item count, score, times and its last succeeded analysis. top: (report_date, place, hot_cluster_id, title, summary, first_seen_at, last_seen_at), a few a day; analyses: (hot_cluster_id, result)."""
    mine = placed.join(top.select("hot_cluster_id").distinct(), "hot_cluster_id", "left_semi")
    rows = top.join(_sources(mine), "hot_cluster_id", "left").join(scores.select("hot_cluster_id", "total_score"), "hot_cluster_id", "left").join(analyses.select("hot_cluster_id", F.col("result").alias("analysis")), "hot_cluster_id", "left")
    one = F.struct(
        F.col("hot_cluster_id").alias("hotClusterId"), "title", "summary", F.coalesce("sources", F.array().cast("array<string>")).alias("sourceTypes"), F.coalesce("n", F.lit(0)).alias("itemCount"), F.col("total_score").alias("score"),
        F.col("first_seen_at").alias("firstSeenAt"), F.col("last_seen_at").alias("lastSeenAt"), "analysis",
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", one.alias("c")))), lambda x: x["c"])
    return rows.groupBy("report_date").agg(F.to_json(ordered, {"ignoreNullFields": "false"}).alias("content"))
