"""Lists, details, alerts, reports and analyses of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SOURCES
from ..functions.numbers import bucket
from .keyword_search import holding
from .ordering import Stored, ranks

def check_page(page: int, size: int, most: int = 100) -> None:
    if page < 1 or not 1 <= size <= most:
        raise ValueError(f"page must be at least 1 and size 1 to {most}")


def total_pages(total: Column, size: int) -> Column:
    return F.ceil(total / size)


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None filters nothing."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def cluster_page(clusters: DataFrame, membership: DataFrame, items: DataFrame, scores: DataFrame, page: int = 1, size: int = 20, sort: str = "SCORE_DESC", source: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """A page of active clusters, with item count, ordered sources and score. since and until are inclusive; `source` keeps clusters with an active item of it."""
    check_page(page, size)
    rows = clusters.where("status = 'ACTIVE'")
    if since is not None:
        rows = rows.where(F.col("last_seen_at") >= since)
    if until is not None:
        rows = rows.where(F.col("last_seen_at") <= until)
    active = membership.where("removed_at is null").join(items.select("hot_item_id", "source_type"), "hot_item_id")
    if source is not None:
        rows = rows.join(active.where(F.col("source_type") == source), "hot_cluster_id", "left_semi")
    rows = rows.join(scores.select("hot_cluster_id", "total_score"), "hot_cluster_id", "left")
    by = [F.coalesce("total_score", F.lit(0.0)).desc()] if sort == "SCORE_DESC" else []
    top = rows.orderBy(*by, F.desc("last_seen_at"), F.desc("hot_cluster_id")).offset((page - 1) * size).limit(size)
    # only the page's clusters meet their members
    return top.join(ordered_sources(active.join(F.broadcast(top.select("hot_cluster_id")), "hot_cluster_id")), "hot_cluster_id", "left").select("hot_cluster_id", "title", "status", "last_seen_at", "total_score", F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("sources", F.lit("")).alias("sources"))


def ordered_sources(active: DataFrame) -> DataFrame:
    """Number of items and distinct sources of each cluster: the primary's first, then by time of assignment. Members are reduced to a row for each source before any are gathered."""
    first = active.groupBy("hot_cluster_id", "source_type").agg(F.count("*").alias("n"), F.min(F.struct((~F.col("is_primary")).alias("p"), "assigned_at", "hot_item_id")).alias("o"))
    order = F.array_sort(F.collect_list(F.struct("o", "source_type")))
    return first.groupBy("hot_cluster_id").agg(F.sum("n").alias("item_count"), F.array_join(F.transform(order, lambda s: s["source_type"]), ",").alias("sources"))


def evidence(membership: DataFrame, items: DataFrame, stored: Stored | None = None) -> DataFrame:
    """Active members with their items, the primary first, then by time of assignment: a place within the cluster. Places are dealt out by ranges, before the items' texts come in, so a cluster of any size is sorted by many tasks."""
    from ..sources import sinks

    active = membership.where("removed_at is null").withColumn("other", ~F.col("is_primary"))
    return ranks(active, ["hot_cluster_id"], ["other", "assigned_at", "hot_item_id"], stored or sinks.stored, "place").drop("other").join(items, "hot_item_id")


def timeline(members: DataFrame, n: int = 5) -> DataFrame:
    """The n earliest items of each cluster; undated ones count as the epoch."""
    w = Window.partitionBy("hot_cluster_id").orderBy(F.coalesce("published_at", F.timestamp_seconds(F.lit(0))), "hot_item_id")
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def page_summary(rows: DataFrame, needle: str | None, least: float | None, now: Column, source: str | None = None) -> DataFrame:
    """Mean and greatest score, and number seen in the last day, of the rows that hold a text, reach a score and have a source (of their `sources`, joined by commas)."""
    if source:
        rows = rows.where(F.array_contains(F.split("sources", ","), source))
    if needle:
        rows = rows.where(F.lower("title").contains(needle.lower()))
    if least is not None:
        rows = rows.where(F.col("total_score") >= least)
    return rows.agg(F.round(F.avg("total_score"), 2).alias("mean_score"), F.max("total_score").alias("max_score"), F.count_if(F.unix_seconds("last_seen_at") >= F.unix_seconds(now) - 86400).alias("fresh"), F.count("*").alias("n"))


def alert_matches(clusters: DataFrame, members: DataFrame, scores: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, hot_cluster_id, matched, suppress_window_hours): matches of active clusters and enabled rules: some keyword in the cluster's title or summary or an item's title, summary or URL, a source in common if the rule names any, and the least score. No instant is part of it: runs at several can share it.

    Texts of clusters and members meet the rules' distinct keywords by grams (keyword_search.holding), each on its own; what is then gathered is the distinct keywords that a cluster holds, and its sources, never its texts. Rules meet clusters by keyword.
    """
    rules = rules.where("enabled")
    words = rules.select(F.explode("keywords").alias("k")).where("k is not null").select(F.lower("k").alias("k")).distinct()
    active = clusters.where("status = 'ACTIVE'")
    said = lambda *parts: F.lower(F.concat_ws("\n", *parts)).alias("said")
    mine = members.join(active.select("hot_cluster_id"), "hot_cluster_id", "left_semi")
    texts = active.select("hot_cluster_id", said("title", "summary")).unionByName(mine.select("hot_cluster_id", said("title", "summary", "source_url"))).withColumn("item", F.xxhash64("said"))
    held = holding(texts, ["hot_cluster_id", "item"], "said", words).select("hot_cluster_id", "k").distinct()
    asked = rules.select("rule_id", F.col("min_score"), "source_types", "suppress_window_hours", F.posexplode("keywords").alias("place", "keyword"))
    hits = held.join(asked.withColumn("k", F.lower("keyword")), "k").groupBy("hot_cluster_id", "rule_id").agg(F.array_sort(F.collect_list(F.struct("place", "keyword"))).alias("hits"), F.first("min_score").alias("min_score"), F.first("source_types").alias("source_types"), F.first("suppress_window_hours").alias("suppress_window_hours"))
    sources = members.groupBy("hot_cluster_id").agg(F.collect_set("source_type").alias("sources"))
    rows = hits.join(sources, "hot_cluster_id", "left").join(scores.select("hot_cluster_id", "total_score"), "hot_cluster_id", "left")
    rows = rows.where(((F.coalesce(F.size("source_types"), F.lit(0)) <= 0) | F.coalesce(F.arrays_overlap("source_types", "sources"), F.lit(False))) & (F.coalesce("total_score", F.lit(0.0)) >= F.coalesce("min_score", F.lit(0.0))))
    return rows.select("rule_id", "hot_cluster_id", F.array_join(F.transform("hits", lambda h: h["keyword"]), ",").alias("matched"), "suppress_window_hours")


def alerts(clusters: DataFrame, members: DataFrame, scores: DataFrame, rules: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """alert_matches() as alerts of one run."""
    return alerts_of(alert_matches(clusters, members, scores, rules), existing, now)


def alerts_of(matches: DataFrame, existing: DataFrame, now: Column) -> DataFrame:
    """Matches as alerts of a run at `now`, each with its suppression key. `created` is false where the key is there already."""
    key = F.sha2(F.concat_ws(":", "rule_id", "hot_cluster_id", bucket(now, F.col("suppress_window_hours") * 3600)).cast("binary"), 256)
    rows = matches.select("rule_id", "hot_cluster_id", "matched", key.alias("suppression_key")).dropDuplicates(["suppression_key"])
    known = existing.select("suppression_key", F.lit(True).alias("known")).distinct()
    return rows.join(known, "suppression_key", "left").withColumn("created", F.col("known").isNull()).drop("known")


def alert_counts(found: DataFrame, clusters: DataFrame) -> DataFrame:
    scanned = clusters.where("status = 'ACTIVE'").agg(F.count("*").alias("scanned"))
    return found.agg(F.count("*").alias("matched"), F.count_if("created").alias("created"), F.count_if(~F.col("created")).alias("suppressed")).crossJoin(scanned)


def daily_top(clusters: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """Active clusters with report_date, the UTC day that they were last seen on, and place: the n with the best scores of each day. No task keeps more than n of its own."""
    rows = clusters.where("status = 'ACTIVE'").withColumn("report_date", F.to_date("last_seen_at")).join(scores.select("hot_cluster_id", "total_score"), "hot_cluster_id", "left")
    w = Window.partitionBy("report_date").orderBy(F.coalesce("total_score", F.lit(0.0)).desc(), F.desc("last_seen_at"), F.desc("hot_cluster_id"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def daily_reports(clusters: DataFrame, membership: DataFrame, items: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """For each UTC day, the active clusters last seen on it: number, ids of the n with the best scores, title and summary."""
    top = daily_top(clusters, scores, n)
    active = membership.where("removed_at is null").join(items.select("hot_item_id", "source_type"), "hot_item_id")
    sources = ordered_sources(active.join(top.select("hot_cluster_id"), "hot_cluster_id"))
    told = top.join(sources, "hot_cluster_id", "left").groupBy("report_date").agg(F.array_sort(F.collect_list(F.struct("place", "hot_cluster_id", "title", F.coalesce("sources", F.lit("")).alias("sources")))).alias("t"))
    counts = clusters.where("status = 'ACTIVE'").groupBy(F.to_date("last_seen_at").alias("report_date")).agg(F.count("*").alias("cluster_count"))
    day = F.col("report_date").cast("string")
    covered = F.array_join(F.array_distinct(F.filter(F.flatten(F.transform("t", lambda s: F.split(s["sources"], ","))), lambda x: x != "")), ", ")
    summary = F.concat(F.lit("Tracked "), F.col("cluster_count").cast("string"), F.lit(" active clusters on "), day, F.lit(". Top cluster: "), F.col("t")[0]["title"], F.lit(". Sources covered: "), covered, F.lit("."))
    return counts.join(told, "report_date").select("report_date", "cluster_count", F.array_join(F.transform("t", lambda s: s["hot_cluster_id"].cast("string")), ",").alias("top_cluster_ids"), F.concat(F.lit("Daily Report for "), day).alias("title"), summary.alias("summary"))


#: Ids that one digest of an analysis' input covers.
BLOCK = 1024


def input_hashes(members: DataFrame) -> DataFrame:
    """(hot_cluster_id, input_hash): SHA-256 of the digests, joined by commas and in order, of the distinct member ids (in order, joined by commas) of each BLOCK neighbouring numbers. A block's ids, at most BLOCK of them, are all that is ever gathered of a cluster, besides digests."""
    blocks = members.groupBy("hot_cluster_id", F.expr(f"hot_item_id div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_set("hot_item_id")).alias("ids"))
    text = lambda a: F.array_join(a, ",").cast("binary")
    blocks = blocks.select("hot_cluster_id", F.struct("block", F.sha2(text(F.col("ids").cast("array<string>")), 256).alias("sha")).alias("b"))
    return blocks.groupBy("hot_cluster_id").agg(F.sha2(text(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["sha"])), 256).alias("input_hash"))


def analyses(members: DataFrame) -> DataFrame:
    """A deterministic analysis of each cluster from its evidence: confidence, signals, risks, and a hash of the input."""
    rows = members.groupBy("hot_cluster_id").agg(F.count("*").alias("n"), F.count_distinct("source_type").alias("sources"), F.max_by("source_type", F.struct("published_at", "hot_item_id")).alias("latest"))
    rows = rows.join(input_hashes(members), "hot_cluster_id")
    confidence = F.when((F.col("sources") >= 2) & (F.col("n") >= 2), "HIGH").when(F.col("n") >= 2, "MEDIUM").otherwise("LOW")
    one, few = F.when(F.col("sources") <= 1, "This signal still depends on a single source family."), F.when(F.col("n") < 3, "Evidence density is still light, so the narrative may shift after the next crawl.")
    risks = F.array_compact(F.array(one, few))
    risks = F.when(F.size(risks) > 0, risks).otherwise(F.array(F.lit("Cross-source clustering should still be spot-checked against raw evidence.")))
    return rows.select(
        "hot_cluster_id", confidence.alias("confidence"), F.concat(F.lit("The cluster currently aggregates "), F.col("n").cast("string"), F.lit(" evidence item(s).")).alias("first_signal"),
        F.concat(F.lit("Latest evidence came from "), "latest", F.lit(".")).alias("last_signal"), F.array_join(risks, " ").alias("risks"), "input_hash",
    )


def due_sources(sources: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """What to do with each source: DISABLED, IN_FLIGHT, NOT_YET_DUE or RUN, with the key of its time bucket."""
    last = tasks.groupBy("source_id").agg(F.max("requested_at").alias("last"), F.bool_or(F.col("status").isin("PENDING", "RUNNING")).alias("busy"))
    every = F.col("crawl_interval_minutes") * 60
    rows = sources.join(last, "source_id", "left")
    what = F.when(~F.col("enabled") | (F.col("crawl_interval_minutes") <= 0), "DISABLED").when(F.col("busy"), "IN_FLIGHT").when(F.unix_seconds("last") + every > F.unix_seconds(now), "NOT_YET_DUE").otherwise("RUN")
    return rows.select("source_id", what.alias("decision"), F.when(what == "RUN", F.concat_ws(":", F.lit("scheduled"), "source_id", bucket(now, every))).alias("idempotency_key"))


def scheduled_counts(due: DataFrame) -> DataFrame:
    """Candidates (sources that aren't disabled), and how many of them were started, skipped or failed."""
    rows = due.where("decision <> 'DISABLED'")
    return rows.agg(F.count("*").alias("candidates"), F.count_if(F.col("decision") == "RUN").alias("triggered"), F.count_if(~F.col("decision").isin("RUN", "ERROR")).alias("skipped"), F.count_if(F.col("decision") == "ERROR").alias("failed"))


def latest_analyses(clusters: DataFrame, analyses: DataFrame) -> DataFrame:
    """clusters with the last SUCCEEDED analysis of each, by created_at, then id; null where there is none."""
    rest = [c for c in analyses.columns if c != "hot_cluster_id"]
    last = analyses.where("status = 'SUCCEEDED'").groupBy("hot_cluster_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("analysis"))
    return clusters.join(last, "hot_cluster_id", "left")


def newest(rows: DataFrame, at: str, key: str = "id", page: int = 1, size: int = 20, most: int = 100, **equal) -> DataFrame:
    """A page of reports, tasks, runs, reviews, history or a cluster's scores: newest first, of equal times the larger key. `equal`: see matching()."""
    check_page(page, size, most)
    return matching(rows, **equal).orderBy(F.desc(at), F.desc(key)).offset((page - 1) * size).limit(size)


def reviews(tasks: DataFrame, decisions: DataFrame, status: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page of review tasks with their decisions; tasks whose decision is gone stay. Up to 200 a page."""
    rows = newest(tasks, "created_at", page=page, size=size, most=200, status=status)
    told = decisions.select(F.col("id").alias("cluster_match_decision_id"), F.struct(*(c for c in decisions.columns if c != "id")).alias("match"))
    return rows.join(told, "cluster_match_decision_id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def query_filters(query: dict) -> dict:
    """Filters of a cluster list from an address's parameters: wrong values count as missing. Of a list of values the first counts."""
    one = {k: (v[0] if v else None) if isinstance(v, (list, tuple)) else v for k, v in query.items()}
    text = lambda k: str(one[k]).strip() or None if one.get(k) is not None else None

    def number(k: str, least: int, default: int) -> int:
        try:
            x = float(one[k])
        except (KeyError, TypeError, ValueError):
            return default
        return int(x // 1) if x == x and abs(x) != float("inf") and (x > 0 or x == least) else default

    source = one.get("sourceType")
    return {
        "page": number("page", 1, 1), "size": number("size", 1, 20), "sort": "LATEST" if one.get("sort") == "LATEST" else "SCORE_DESC", "source": source if source in SOURCES else None,
        "since": text("from"), "until": text("to"), "needle": text("q") or "", "least": number("minScore", 0, 0),
    }
