"""Queries of what changes: streams, versions of tables, governance of clusters, and lists of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import clusters as C
from ..operators import evaluation as E
from ..operators import ingest as I
from ..operators import matching as M
from ..operators import scoring as S
from ..operators import serving as V
from ..sources import sinks
from ..sources import tables as D
from ..sources.versioned import Table
from ..streaming import ingest as L
from . import batch as B
from .oracles import _ROLE, _W, MATCHES, SNAPSHOTS
from .oracles import ORACLES as OTHERS
from .queries import _active, _scores, _v1

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _folder(spark) -> str:
    return f"{sinks.root(spark)}/stored-{uuid.uuid4().hex}"


def _stream(spark, sf_dir, name):
    """A driver table, a file or a folder of files, as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    # a pattern, as a stream's path can't be one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


@query
def stream_upsert(spark, sf_dir):
    """Events as a stream of records that come again: the table that the stream keeps."""
    e = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("source_type"), F.col("user_id").alias("external_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("fetched_at"), "value")
    at = _folder(spark)
    L.upsert_stream(e, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return L.current(spark, f"{at}/table").select("source_type", "external_id", "id", F.round("value", 6).alias("value"), F.unix_seconds("first_seen_at").alias("first_seen"), F.unix_seconds("last_seen_at").alias("last_seen"))


ORACLES["stream_upsert"] = OTHERS["item_upsert"]


@query
def stream_trends(spark, sf_dir):
    """Snapshots as a stream: trends of all its items, each looked back from."""
    at = _folder(spark)
    L.trend_stream(D.snapshots_of(_stream(spark, sf_dir, "events")), f"{at}/history", f"{at}/trends", f"{at}/checkpoint").awaitTermination()
    r = spark.read.parquet(f"{at}/trends")
    # an item of several batches has the trends of the last one
    r = r.join(r.groupBy("hot_item_id").agg(F.max("v").alias("v")), ["hot_item_id", "v"])
    return r.select("hot_item_id", "window", *(F.round(f"{d}_delta", 6).alias(f"{d}_delta") for d in ("attention", "discussion", "adoption", "relevance")), "rank_delta", F.round("momentum", 6).alias("momentum"), F.round("velocity", 6).alias("velocity"), "confidence", F.round("growth_rate", 6).alias("growth_rate"), F.round("acceleration", 6).alias("acceleration"))


ORACLES["stream_trends"] = OTHERS["item_trends"]


@query
def appended_keys(spark, sf_dir):
    """Line items appended by order, twice and in two parts: each order once, by whichever part had it first."""
    li = D.read(spark, sf_dir, "lineitem").select("l_orderkey", F.pmod("l_suppkey", F.lit(2)).alias("part"))
    path = f"{_folder(spark)}/table"
    for part in (0, 1, 0):
        sinks.append_new(li.where(F.col("part") == part), path, ["l_orderkey"])
    return Table(spark, path).read().groupBy("part").agg(F.count("*").alias("orders"), F.sum("l_orderkey").cast("long").alias("keys"))


ORACLES["appended_keys"] = "SELECT part, count(*) AS orders, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM (SELECT l_orderkey, min(l_suppkey % 2) AS part FROM lineitem GROUP BY 1) GROUP BY 1"


@query
def status_changes(spark, sf_dir):
    """Customers as alerts of a versioned table: two are changed, a third caller has seen an old version."""
    t = Table(spark, f"{_folder(spark)}/table")
    rows = D.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("NEW").alias("status"), F.lit(1).alias("version"))
    t.commit(t.version(), [(t.write(rows), 0)])
    B.commit_status(t, "id", 3, 1, "status", "ACKED")
    B.commit_status(t, "id", 4, 1, "status", "DISMISSED")
    try:
        B.commit_status(t, "id", 3, 1, "status", "DISMISSED")
    except ValueError:
        pass
    return t.read()


ORACLES["status_changes"] = "SELECT c_custkey AS id, CASE c_custkey WHEN 3 THEN 'ACKED' WHEN 4 THEN 'DISMISSED' ELSE 'NEW' END AS status, CASE WHEN c_custkey IN (3, 4) THEN 2 ELSE 1 END AS version FROM customer"


@query
def raw_records(spark, sf_dir):
    """Documents as raw records, kept with a hash, and as dead letters where they are no JSON."""
    raw = D.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.pmod("doc_id", F.lit(3)) > 0, F.to_json(F.struct("lang", "source"))).otherwise(F.concat(F.lit("{"), "text")).alias("raw_payload"))
    kept = I.with_payload_hash(raw)
    good, dead = I.split_errors(kept, F.when(F.try_parse_json("raw_payload").isNull(), F.concat(F.lit("no JSON: "), "raw_payload")), "NORMALIZE")
    return good.select("id", "payload_hash", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("long").alias("message_chars")).unionByName(dead.select("id", "payload_hash", "stage", F.char_length("error_message").cast("long").alias("message_chars")))


ORACLES["raw_records"] = """
WITH r AS (SELECT doc_id AS id, doc_id % 3 = 0 AS bad, CASE WHEN doc_id % 3 > 0 THEN '{"lang":"' || lang || '","source":"' || source || '"}' ELSE '{' || text END AS p FROM documents)
SELECT id, sha256(p) AS payload_hash, CASE WHEN bad THEN 'NORMALIZE' END AS stage, CASE WHEN bad THEN CAST(least(1000, length('no JSON: ' || p)) AS BIGINT) END AS message_chars FROM r"""


@query
def merged_and_split(spark, sf_dir):
    """Cluster 1 merged into cluster 0, then the items of cluster 2 with an odd id split off: memberships and history."""
    items, membership, clusters, _ = _active(spark, sf_dir)
    c = clusters.select("hot_cluster_id", "status", "last_seen_at", F.lit(None).cast("long").alias("merged_into_cluster_id"))
    after, joined, first = C.merge(c, membership, 0, 1, "same event", "me", items)
    joined, second = C.split(joined, 2, [9, 11], 1_000_000, "two events")
    rows = joined.select("hot_item_id", "hot_cluster_id", "is_primary", F.lit(None).cast("string").alias("action"))
    return rows.unionByName(first.unionByName(second).select("hot_item_id", F.col("to_cluster_id").alias("hot_cluster_id"), F.lit(None).cast("boolean").alias("is_primary"), "action"))


_ROLE_RANK = "CASE source_type WHEN 'ARXIV' THEN 5 WHEN 'GITHUB' THEN 4 WHEN 'HUGGING_FACE' THEN 4 WHEN 'HACKER_NEWS' THEN 2 WHEN 'HACKER_NEWS_SEARCH' THEN 2 WHEN 'WEIBO_HOT_SEARCH' THEN 2 WHEN 'TWITTER' THEN 2 ELSE 1 END"
ORACLES["merged_and_split"] = f"""{_W},
p AS (SELECT arg_min(hot_item_id, (-{_ROLE_RANK}, hot_item_id)) AS best FROM members WHERE hot_cluster_id IN (0, 1))
SELECT hot_item_id, CASE WHEN removed_at IS NULL AND hot_cluster_id = 1 THEN 0 WHEN removed_at IS NULL AND hot_item_id IN (9, 11) THEN 1000000 ELSE hot_cluster_id END AS hot_cluster_id,
  CASE WHEN removed_at IS NULL AND hot_cluster_id IN (0, 1) THEN hot_item_id = best ELSE is_primary END AS is_primary, NULL AS action FROM membership, p
UNION ALL SELECT hot_item_id, 0, NULL, 'MERGE' FROM members WHERE hot_cluster_id = 1
UNION ALL SELECT hot_item_id, 1000000, NULL, 'SPLIT' FROM members WHERE hot_item_id IN (9, 11)"""


@query
def rematched(spark, sf_dir):
    """Some items of cluster 40 matched anew with all earlier items."""
    feats = M.features(D.spread(D.items(spark, sf_dir)))
    at = D.memberships(feats.select("hot_item_id", F.col("event_time").alias("published_at")))
    return C.recluster_anew(feats, at, 40, [161, 162, 163], "look again")[0].select("hot_item_id", "other_id", "signal", "hot_cluster_id", "layer", "score", "decision")


ORACLES["rematched"] = f"{MATCHES} SELECT hot_item_id, other_id, signal, hot_cluster_id, layer, score, decision FROM kept WHERE hot_item_id IN (161, 162, 163)"


@query
def assignment_quality(spark, sf_dir):
    """First clusters against groups that must be one, and pairs that must not."""
    items = D.items(spark, sf_dir)
    i = F.col("hot_item_id")
    groups = items.select(F.pmod(i, F.lit(300)).alias("group_id"), "hot_item_id").where("hot_item_id % 6 = 3")
    apart = items.select(i.alias("a"), (i + 1).alias("b"))
    return E.fixture_metrics(groups, apart, C.v1_assign(items)).select("merged", "groups", "kept_apart", "pairs", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


ORACLES["assignment_quality"] = f"""{_W},
v AS (SELECT hot_item_id, min(hot_item_id) OVER (PARTITION BY source_url) AS c FROM items),
g AS (SELECT hot_item_id % 300 AS k, count(DISTINCT c) AS n FROM v WHERE hot_item_id % 6 = 3 GROUP BY 1),
p AS (SELECT count(*) FILTER (x.c <> y.c) AS kept_apart, count(*) AS pairs FROM v x JOIN v y ON y.hot_item_id = x.hot_item_id + 1)
SELECT (SELECT count(*) FILTER (n = 1) FROM g) AS merged, (SELECT count(*) FROM g) AS groups, kept_apart, pairs, round((SELECT count(*) FILTER (n = 1) / count(*)::DOUBLE FROM g), 6) AS recall, round(kept_apart / pairs::DOUBLE, 6) AS precision FROM p"""


@query
def source_ranks(spark, sf_dir):
    """The best rank, and the greatest signal, of each cluster of users by role."""
    from .queries import _event_members

    m = _event_members(spark, sf_dir)
    return m.groupBy("hot_cluster_id", "role").agg(F.min("rank").alias("best_rank"), F.count_distinct("url").alias("urls"), F.round(F.max("signal.attention"), 6).alias("attention"))


ORACLES["source_ranks"] = f"""WITH {SNAPSHOTS}
SELECT hot_item_id % 40 AS hot_cluster_id, {_ROLE} AS role, min(rank) AS best_rank, count(DISTINCT hot_item_id % 3) AS urls, round(max(attention), 6) AS attention FROM last WHERE turn = 1 GROUP BY 1, 2"""


@query
def score_history(spark, sf_dir):
    """Scores of one customer's orders as a cluster's history, newest first, and the last one of any version."""
    rows = _scores(spark, sf_dir)
    last = S.latest_scores(rows.withColumn("scoring_version", F.lit("any"))).select("hot_cluster_id", F.col("id").alias("last_id"))
    return V.newest(rows, "calculated_at", page=1, size=100, hot_cluster_id=7).select("id", "hot_cluster_id", "scoring_version", "total_score").join(last, "hot_cluster_id")


ORACLES["score_history"] = "SELECT id, hot_cluster_id, scoring_version, total_score, first_value(id) OVER (ORDER BY d DESC, id DESC) AS last_id FROM (SELECT o_orderkey AS id, o_custkey AS hot_cluster_id, CASE WHEN o_orderkey % 3 = 0 THEN 'cross-source-score-v2' ELSE 'hn-score-v1' END AS scoring_version, o_totalprice AS total_score, o_orderdate AS d FROM orders WHERE o_custkey = 7) ORDER BY d DESC, id DESC LIMIT 100"


@query
def request_settings(spark, sf_dir):
    """Customers as searches: what a request says of direction, what a tweet search asks, which pages there are, and a day's bounds."""
    c, i = D.read(spark, sf_dir, "customer"), F.col("c_custkey")
    from ..sources.payloads import sort_direction

    said = F.when(F.pmod(i, F.lit(4)) == 0, " ASC ").when(F.pmod(i, F.lit(4)) == 1, "desc").when(F.pmod(i, F.lit(4)) == 2, "").otherwise("up")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(i, F.lit(50)).cast("int"))
    low, high = N.day_bounds(day)
    return c.select(i.alias("id"), sort_direction(said).cast("long").alias("direction"), I.tweet_query(F.concat(F.lit("ai "), i.cast("string")), low, 5).alias("query"), V.total_pages(i, 20).cast("long").alias("pages"), F.unix_seconds(low).alias("day_start"), F.unix_seconds(high).alias("day_end"))


ORACLES["request_settings"] = """
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 3 THEN NULL ELSE -1 END AS direction, 'ai ' || c_custkey || ' -filter:retweets -filter:replies since:' || strftime(DATE '2024-01-01' + CAST(c_custkey % 50 AS INT), '%Y-%m-%d') || ' min_faves:5' AS query,
  CAST(ceil(c_custkey / 20.0) AS BIGINT) AS pages, CAST(epoch(DATE '2024-01-01') + 86400 * (c_custkey % 50) AS BIGINT) AS day_start, CAST(epoch(DATE '2024-01-01') + 86400 * (c_custkey % 50 + 1) AS BIGINT) AS day_end FROM customer"""


@query
def publishers(spark, sf_dir):
    """Who publishes each item: its address's host, else its author; and its text without tags."""
    i = D.items(spark, sf_dir)
    html = F.concat(F.lit("<p>"), "author", F.lit("&amp;&lt;b&gt; <i>x</i>\n\ty</p>"))
    return i.select("hot_item_id", T.publisher(F.when(F.pmod("hot_item_id", F.lit(5)) > 0, F.col("source_url")), F.col("author")).alias("publisher"), T.clean_html(html, " ").alias("said"))


ORACLES["publishers"] = f"""{_W}
SELECT hot_item_id, CASE WHEN hot_item_id % 5 = 0 THEN lower(author) WHEN hot_item_id % 6 = 5 THEN 'example.com' ELSE regexp_extract(source_url, '^https://([^/]+)', 1) END AS publisher, author || '&<b> x y' AS said FROM items"""


@query
def suppressed_alerts(spark, sf_dir):
    """Alerts of a second run, an hour later and on the next day: those that the first run created stay suppressed within their rule's window."""
    from .queries import _rules

    _, _, clusters, members = _active(spark, sf_dir)
    none = spark.createDataFrame([], "suppression_key string")
    # what matches is the same in all three runs
    matches = sinks.stored(V.alert_matches(clusters, members, _v1(members), _rules(spark)))
    first = sinks.stored(V.alerts_of(matches, none, D.now()))
    out = []
    for hours in (1, 24):
        later = F.lit(D.NOW).cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))
        found = V.alerts_of(matches, first.select("suppression_key"), later)
        out.append(found.groupBy("rule_id").agg(F.count("*").alias("matched"), F.count_if(F.col("created")).alias("created")).select(F.lit(hours).alias("hours"), "rule_id", "matched", "created"))
    return out[0].unionByName(out[1])


ORACLES["suppressed_alerts"] = f"""WITH first AS ({OTHERS["alert_matching"]}), n AS (SELECT rule_id, count(*) AS matched FROM first GROUP BY 1)
SELECT 1 AS hours, rule_id, matched, CAST(0 AS BIGINT) AS created FROM n UNION ALL SELECT 24, rule_id, matched, matched FROM n"""


@query
def sample_lines(spark, sf_dir):
    """Items as lines of an export, read back: cluster, both scores with a component each, and a metric."""
    items = D.items(spark, sf_dir).withColumn("metrics", F.create_map(F.lit("points"), F.col("points").cast("double"))).drop("summary")
    parts = F.create_map(F.lit("half"), F.col("total_score").cast("double") / 2)
    rows = E.samples(items, D.memberships(items), _scores(spark, sf_dir).withColumn("components", parts), (S.V1, S.V2))
    j = lambda k: F.get_json_object("line", f"$.{k}")
    return E.sample_lines(rows).select("hot_item_id", j("clusterId").cast("long").alias("cluster_id"), j("sourceType").alias("source_type"), j("metrics.points").cast("double").alias("points"), F.round(j("scoreV1.total").cast("double"), 4).alias("score_v1"), F.round(j("scoreV2.components.half").cast("double"), 4).alias("half_v2"))


ORACLES["sample_lines"] = f"""{_W},
s AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS v, CAST(arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS DOUBLE) AS total FROM orders GROUP BY 1, 2)
SELECT i.hot_item_id, m.hot_cluster_id AS cluster_id, i.source_type, CAST(i.points AS DOUBLE) AS points, round(a.total, 4) AS score_v1, round(b.total / 2, 4) AS half_v2 FROM items i LEFT JOIN members m USING (hot_item_id) LEFT JOIN s a ON a.c = m.hot_cluster_id AND a.v = 1 LEFT JOIN s b ON b.c = m.hot_cluster_id AND b.v = 2"""


@query
def spaced_requests(spark, sf_dir):
    """Orders as requests to their customers' sources, three seconds apart each."""
    from ..sources.connector import spaced

    o = D.read(spark, sf_dir, "orders").select(F.pmod("o_custkey", F.lit(11)).alias("source"), "o_orderkey")
    return spaced(o, "source", ["o_orderkey"], 3.0)


ORACLES["spaced_requests"] = "SELECT o_custkey % 11 AS source, o_orderkey, 3.0::DOUBLE * (row_number() OVER (PARTITION BY o_custkey % 11 ORDER BY o_orderkey) - 1) AS not_before FROM orders"


@query
def report_upsert(spark, sf_dir):
    """Reports of all days, then some days' again: one a day stays."""
    from .queries import daily_reports

    path = f"{_folder(spark)}/table"
    rows = sinks.stored(daily_reports(spark, sf_dir).select("report_date", "title", "cluster_count"))
    sinks.upsert_reports(rows, path)
    sinks.upsert_reports(rows.where("day(report_date) % 2 = 0").withColumn("title", F.concat(F.lit("Again: "), "title")), path)
    return Table(spark, path).read()


ORACLES["report_upsert"] = f"SELECT report_date, CASE WHEN day(CAST(report_date AS DATE)) % 2 = 0 THEN 'Again: ' ELSE '' END || title AS title, cluster_count FROM ({OTHERS['daily_reports']})"


@query
def latest_page(spark, sf_dir):
    """The first page of clusters last seen within some days, newest first, and how many pages there are."""
    items, membership, clusters, members = _active(spark, sf_dir)
    since, until = (F.lit(d).cast("timestamp") for d in ("2024-01-01 12:00:00", "2024-01-05 12:30:00"))
    r = V.cluster_page(clusters, membership, items, _v1(members), sort="LATEST", size=10, since=since, until=until)
    n = clusters.where((F.col("status") == "ACTIVE") & F.col("last_seen_at").between(since, until)).agg(V.total_pages(F.count("*"), 10).cast("long").alias("pages"))
    return r.select("hot_cluster_id", "total_score", "item_count", "sources").crossJoin(n)


ORACLES["latest_page"] = f"""{OTHERS["cluster_page"].split("SELECT c.hot_cluster_id, s.total_score", 1)[0]},
c AS (SELECT * FROM clusters WHERE status = 'ACTIVE' AND last_seen_at BETWEEN TIMESTAMP '2024-01-01 12:00:00' AND TIMESTAMP '2024-01-05 12:30:00')
SELECT c.hot_cluster_id, s.total_score, cnt.item_count, srcs.sources, (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM c) AS pages FROM c LEFT JOIN scores s USING (hot_cluster_id) LEFT JOIN srcs USING (hot_cluster_id) LEFT JOIN cnt USING (hot_cluster_id) ORDER BY c.last_seen_at DESC, c.hot_cluster_id DESC LIMIT 10"""


@query
def named_pairs(spark, sf_dir):
    """Labelled pairs that name their items by source and external id, placed by their last accepted decision where there is one."""
    items, l = D.items(spark, sf_dir), D.read(spark, sf_dir, "labels")
    i, none = F.col("doc_id"), F.lit(None).cast("long")
    source = lambda x: F.element_at(F.array(*map(F.lit, D.SOURCES)), (F.pmod(x, F.lit(10)) + 1).cast("int"))
    kinds = F.element_at(F.array(*map(F.lit, ("MUST_MERGE", "MUST_NOT_MERGE", "REVIEW_IF_AMBIGUOUS"))), (F.pmod(i, F.lit(3)) + 1).cast("int"))
    cases = l.select(i, F.lit("OTHER").alias("category"), kinds.alias("expectation"), none.alias("item_a"), none.alias("item_b"), source(i).alias("source_a"), i.cast("string").alias("external_a"), source(i + 1).alias("source_b"), (i + 1).cast("string").alias("external_b"))
    h = F.col("hot_item_id")
    decided = items.select("hot_item_id", F.when(F.pmod(h, F.lit(4)) < 2, "ACCEPTED").otherwise("REJECTED").alias("decision"), F.floor(h / 6).alias("hot_cluster_id"), F.col("published_at").alias("decided_at"), h.alias("id"))
    m = E.pair_metrics(E.placed_pairs(cases, items, D.memberships(items), decided))
    return m.select("category", "tp", "fp", "tn", "fn", "review", "missing", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("review_rate", 6).alias("review_rate"))


ORACLES["named_pairs"] = f"""{_W},
spot AS (SELECT i.hot_item_id, CASE WHEN i.hot_item_id % 4 < 2 THEN i.hot_item_id // 6 ELSE m.hot_cluster_id END AS c FROM items i LEFT JOIN members m USING (hot_item_id)),
p AS (SELECT doc_id % 3 AS k, a.c AS ca, b.c AS cb FROM labels LEFT JOIN spot a ON a.hot_item_id = doc_id LEFT JOIN spot b ON b.hot_item_id = doc_id + 1),
g AS (SELECT count(*) FILTER (k = 0 AND ca = cb) AS tp, count(*) FILTER (k = 1 AND ca = cb) AS fp, count(*) FILTER (k = 1 AND ca <> cb) AS tn, count(*) FILTER (k = 0 AND ca <> cb) AS fn, count(*) FILTER (k = 2) AS review, count(*) FILTER (ca IS NULL OR cb IS NULL) AS missing, count(*) AS n FROM p)
SELECT category, tp, fp, tn, fn, review, missing, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(review / n::DOUBLE, 6) AS review_rate FROM g, (VALUES ('OTHER'), (NULL)) c(category)"""
