"""Explainable scores of clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AUTHORITY, CONFIDENCE_FACTOR, SCORE_WEIGHTS
from ..functions.numbers import age_hours, capped_log, clamp

V1, V2 = "hn-score-v1", "cross-source-score-v2"


def v1_scores(members: DataFrame, now: Column) -> DataFrame:
    """First score of each cluster from its members' (points, comments_count, tags, published_at): capped logarithms of the greatest points and comments, freshness, tags and evidence; to 4 places, half up."""
    best = members.groupBy("hot_cluster_id").agg(F.max("points").alias("points"), F.max("comments_count").alias("comments"), F.max(F.size("tags")).alias("tags"), F.max("published_at").alias("newest"), F.count("*").alias("n"))
    hours = age_hours(F.coalesce("newest", now), now)
    parts = {
        "points_score": capped_log(F.coalesce("points", F.lit(0)), 500, 35),
        "comments_score": capped_log(F.coalesce("comments", F.lit(0)), 200, 20),
        "freshness_score": F.greatest(F.lit(0.0), 1 - hours / 72.0) * 30.0,
        "keyword_score": F.least(F.lit(10.0), 2.0 * F.col("tags")),
        "evidence_score": F.least(F.lit(5.0), 2.5 * (F.col("n") - 1)),
    }
    rows = best.select("hot_cluster_id", *(v.alias(k) for k, v in parts.items()))
    total = reduce(lambda a, b: a + b, map(F.col, parts))
    return rows.withColumn("total_score", F.round(total, 4)).withColumn("scoring_version", F.lit(V1))


def v2_scores(clusters: DataFrame, members: DataFrame, day_trends: DataFrame, now: Column) -> DataFrame:
    """Second score: the weighted sum of seven components, 0 to 100 each.

    clusters (hot_cluster_id, first_seen_at), members (hot_cluster_id, role, signal, url, published_at) of active memberships, day_trends (hot_cluster_id, momentum, confidence) of the 24-hour window.
    """
    has = F.col("signal").isNotNull()
    in_role = lambda r, x: F.when(has & (F.col("role") == r), x)
    order = reduce(lambda c, kv: c.when(F.col("role") == kv[0], kv[1]), list(AUTHORITY.items())[1:], F.when(F.col("role") == "PRIMARY", AUTHORITY["PRIMARY"])).alias("order")
    url = F.when((F.col("role") == "DISCOVERY") & has & (F.trim("url") != ""), F.col("url"))
    m = members.groupBy("hot_cluster_id").agg(
        F.max(in_role("ADOPTION", F.col("signal.adoption"))).alias("ad_max"), F.avg(in_role("ADOPTION", F.col("signal.adoption"))).alias("ad_avg"),
        F.max(in_role("COMMUNITY", F.col("signal.discussion"))).alias("di_max"), F.avg(in_role("COMMUNITY", F.col("signal.discussion"))).alias("di_avg"),
        F.max(in_role("DISCOVERY", F.col("signal.relevance"))).alias("re_max"), F.avg(in_role("DISCOVERY", F.col("signal.relevance"))).alias("re_avg"),
        F.min(in_role("DISCOVERY", F.col("signal.rank"))).alias("best_rank"),
        F.max(reduce(lambda c, kv: c.when(has & (F.col("role") == kv[0]), kv[1]), list(AUTHORITY.items())[1:], F.when(has & (F.col("role") == "PRIMARY"), AUTHORITY["PRIMARY"]))).alias("authority"),
        F.count_distinct(F.when(has & (F.col("role") != "DISCOVERY"), F.col("role"))).alias("roles"), F.count_distinct(url).alias("urls"),
        F.min(F.when(has & (F.col("role") != "DISCOVERY"), F.col("published_at"))).alias("event_at"),
        *(F.count(in_role(r, F.lit(1))).alias(f"{p}_n") for p, r in (("ad", "ADOPTION"), ("di", "COMMUNITY"), ("re", "DISCOVERY"))), F.max(F.when(has, F.struct(order, "role")))["role"].alias("top_role"),
    )
    rows = clusters.select("hot_cluster_id", "first_seen_at").join(m, "hot_cluster_id", "left").join(day_trends.select("hot_cluster_id", F.col("momentum").alias("t_momentum"), F.col("confidence").alias("t_confidence"), (F.col("contributing") if "contributing" in day_trends.columns else F.lit(None).cast("long")).alias("t_contributing")), "hot_cluster_id", "left")
    factor = reduce(lambda c, kv: c.when(F.col("t_confidence") == kv[0], kv[1]), list(CONFIDENCE_FACTOR.items())[1:], F.when(F.col("t_confidence") == "HIGH", CONFIDENCE_FACTOR["HIGH"])).otherwise(0.3)
    event_at = F.coalesce("event_at", "first_seen_at")
    mixed = lambda p, share, none: F.when(F.col(f"{p}_max").isNotNull(), clamp(F.col(f"{p}_max") + share * F.col(f"{p}_avg"), 0, 100)).otherwise(none)
    parts = {
        "momentum": F.when(F.col("t_momentum").isNotNull(), clamp(F.col("t_momentum") * factor, 0, 100)).otherwise(10.0),
        "adoption": mixed("ad", 0.15, 0.0),
        "freshness": F.when(event_at.isNull(), 0.0).otherwise(100.0 * F.greatest(F.lit(0.0), 1 - age_hours(event_at, now) / 72.0)),
        "relevance": mixed("re", 0.10, 50.0),
        "authority": F.coalesce("authority", F.lit(20.0)),
        "discussion": mixed("di", 0.15, 0.0),
        "evidenceDiversity": F.least(F.lit(100.0), 25.0 * (F.coalesce("roles", F.lit(0)) + (F.coalesce("urls", F.lit(0)) > 0).cast("int"))),
    }
    rows = rows.withColumn("reasons", _reasons(rows, factor, event_at, now)).select("hot_cluster_id", "t_momentum", "t_confidence", "best_rank", "reasons", *(v.alias(f"c_{k}") for k, v in parts.items()))
    total = reduce(lambda a, b: a + b, (F.col(f"c_{k}") * w for k, w in sorted(SCORE_WEIGHTS.items())))
    return rows.withColumn("total_score", F.round(clamp(total, 0, 100), 4)).withColumn("scoring_version", F.lit(V2))


#: Names in explanations of components, in their order.
_SAID = {
    "adoption": ("ad", "adoption_sources", "max_adoption", "avg_adoption", "no_adoption_source"), "discussion": ("di", "community_sources", "max_discussion", "avg_discussion", "no_community_source"),
    "relevance": ("re", "discovery_sources", "max_relevance", "avg_relevance", "no_discovery_source,fallback=50.00"),
}


def _reasons(rows: DataFrame, factor: Column, event_at: Column, now: Column) -> Column:
    """By component, ordered explanations; numbers to two places."""
    two = lambda name, c: F.concat(F.lit(f"{name}="), F.format_string("%.2f", c))
    whole = lambda name, c: F.concat(F.lit(f"{name}="), c.cast("string"))
    out = {
        "momentum": F.when(F.col("t_momentum").isNull(), F.array(F.when(F.col("t_confidence").isNull(), "no_cluster_trend").otherwise("momentum_not_computed"))).otherwise(F.array(F.lit("window=24h"), whole("contributing_items", F.coalesce("t_contributing", F.lit(0))), two("raw_momentum", F.col("t_momentum")), F.concat(F.lit("confidence="), "t_confidence", F.lit("*factor="), F.format_string("%.2f", factor)))),
        "authority": F.when(F.col("top_role").isNull(), F.array(F.lit("no_signals_in_cluster"))).otherwise(F.array(whole("top_role", F.col("top_role")), two("score", F.col("authority")))),
        "freshness": F.when(event_at.isNull(), F.array(F.lit("no_credible_event_time"))).otherwise(F.array(F.concat(F.lit("event_time="), F.date_format(event_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")), whole("age_hours", F.floor(age_hours(event_at, now))))),
        "evidenceDiversity": F.array(whole("distinct_roles", F.coalesce("roles", F.lit(0))), whole("deduped_search_urls", F.coalesce("urls", F.lit(0)))),
    }
    for name, (p, count, most, mean, none) in _SAID.items():
        rank = [F.concat(F.lit("best_rank="), F.coalesce(F.col("best_rank").cast("string"), F.lit("n/a")))] if name == "relevance" else []
        out[name] = F.when(F.col(f"{p}_max").isNull(), F.array(F.lit(none))).otherwise(F.array(whole(count, F.col(f"{p}_n")), two(most, F.col(f"{p}_max")), two(mean, F.col(f"{p}_avg")), *rank))
    return F.create_map(*(x for k, v in out.items() for x in (F.lit(k), v)))


def latest_scores(scores: DataFrame, by_id_only: bool = False) -> DataFrame:
    """The latest row of each cluster and version: by calculated_at, then id (or by id alone)."""
    order = [F.desc("id")] if by_id_only else [F.desc("calculated_at"), F.desc("id")]
    w = Window.partitionBy("hot_cluster_id", "scoring_version").orderBy(*order)
    return scores.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


def resolved_scores(scores: DataFrame, version: str | None, online: str = V1) -> DataFrame:
    """The score that readers see: of the version asked for, else of the online one; where the second is asked for, missing and not online, the first."""
    want = (version or "").strip().lower() or online
    last = latest_scores(scores)
    if want == V2 and online != V2:
        both = last.groupBy("hot_cluster_id").agg(F.max(F.when(F.col("scoring_version") == V2, F.struct("total_score", "scoring_version"))).alias("two"), F.max(F.when(F.col("scoring_version") == V1, F.struct("total_score", "scoring_version"))).alias("one"))
        return both.select("hot_cluster_id", F.coalesce("two", "one").alias("s")).where("s is not null").select("hot_cluster_id", "s.*")
    return last.where(F.col("scoring_version") == want).select("hot_cluster_id", "total_score", "scoring_version")
