"""Analyses, details, reports, match reasons and shadow scores."""

import datetime as dt
import json

from pyspark.sql import functions as F

from trendlake.operators import clusters as C
from trendlake.operators import details as L
from trendlake.operators import ingest as I
from trendlake.operators import matching as M
from trendlake.plans import batch as B
from trendlake.sources import payloads as P
from trendlake.sources import sinks

T0 = dt.datetime(2024, 1, 10)
HOUR = dt.timedelta(hours=1)


def setup(spark):
    clusters = spark.createDataFrame([(1, "A  title", None, T0), (2, " ", "s", T0), (3, "alone", "", None), (4, "one", " its own\nsummary ", T0)], "hot_cluster_id long, title string, summary string, last_seen_at timestamp")
    rows = [(1, 10, 1, "GITHUB", "t10", " ", T0), (1, 11, 2, "ARXIV", "t11", "said  this", T0 + HOUR), (1, 12, 3, "GITHUB", "t12", "later", T0 + HOUR), (1, 13, 4, "TWITTER", "t13", None, None), (2, 20, 1, "GITHUB", "t20", "x", None), (4, 40, 1, "WEIBO_HOT_SEARCH", "t40", None, None)]
    placed = spark.createDataFrame([(*r, f"u{r[1]}") for r in rows], "hot_cluster_id long, hot_item_id long, place long, source_type string, title string, summary string, published_at timestamp, source_url string")
    return clusters, placed, spark.createDataFrame([(1, 12.5), (4, 30.0)], "hot_cluster_id long, total_score double")


def test_analyses(spark):
    got = {r.hot_cluster_id: r for r in L.analysis_results(*setup(spark)).collect()}
    a = got[1].result
    assert (got[1].status, a.headline, a.brief, a.confidence) == ("SUCCEEDED", "A title", "said this", "HIGH") and a.risks == [L.ENOUGH]
    assert a.key_signals == ["The cluster currently aggregates 4 evidence item(s).", "Source coverage includes GITHUB, ARXIV, TWITTER.", "The cluster remains active with score 12.5.", "Latest evidence came from ARXIV."]
    assert [r.hotItemId for r in a.evidence_refs] == [10, 11, 12] and a.evidence_refs[0].sourceUrl == "u10"
    assert (got[2].status, got[2].failure_code, got[2].failure_message, got[2].result) == ("FAILED", L.FAILURE, "Structured analysis field headline is required.", None)
    assert got[3].failure_message == "At least one evidence reference is required."
    one = got[4].result
    assert (one.brief, one.confidence, one.risks) == ("its own summary", "LOW", [L.ONE_SOURCE, L.FEW]) and one.key_signals[2].endswith("score 30.") and len(one.key_signals) == 3


def test_details_and_report_contents(spark):
    clusters, placed, scores = setup(spark)
    got = {r.hot_cluster_id: r for r in L.details(clusters, placed, scores).collect()}
    assert [x.hotItemId for x in got[1]["items"]] == [10, 11, 12, 13] and got[1].sources == ["GITHUB", "ARXIV", "TWITTER"] and got[3].item_count == 0 and got[3]["items"] is None
    top = clusters.withColumns({"report_date": F.lit("2024-01-10").cast("date"), "place": 5 - F.col("hot_cluster_id"), "first_seen_at": F.col("last_seen_at")})
    (r,) = L.report_contents(top, placed, scores, L.analysis_results(clusters, placed, scores)).collect()
    content = json.loads(r.content)
    assert [c["hotClusterId"] for c in content] == [4, 3, 2, 1] and content[3]["analysis"]["headline"] == "A title" and content[2]["analysis"] is None and content[1]["sourceTypes"] == [] and content[0]["score"] == 30.0


KIND = "hot_item_id long, title string, summary string, source_url string, external_id string, author string, source_type string, published_at timestamp, first_seen_at timestamp, last_seen_at timestamp"


def test_match_reasons_times_and_matching_anew(spark):
    rows = [
        (1, "OpenAI launches GPT-5", "", "https://a.example/1", "1", "x", "GITHUB", T0, None, None), (2, "OpenAI launches GPT-5 today", "", "https://a.example/1", "2", "x", "GITHUB", None, T0 + HOUR, None),
        (3, "GPT-5 by OpenAI announced", "", "https://b.example/3", "3", "x", "GITHUB", None, None, T0 + 2 * HOUR), (4, "see arxiv 2401.00001", "", "https://c.example/", "4", "x", "ARXIV", T0, None, None),
        (5, "a paper", "", "https://arxiv.org/abs/2401.00001", "5", "x", "ARXIV", T0 + HOUR, None, None), (6, "words about nothing", "", "https://d.example/", "6", "x", "GITHUB", T0 + HOUR, None, None), (7, "words about something", "", "https://e.example/", "7", "x", "GITHUB", T0 + 3 * HOUR, None, None),
    ]
    feats = sinks.stored(M.features(spark.createDataFrame(rows, KIND)))
    assert {r.hot_item_id: r.event_time for r in feats.collect()} == {1: T0, 2: T0 + HOUR, 3: T0 + 2 * HOUR, 4: T0, 5: T0 + HOUR, 6: T0 + HOUR, 7: T0 + 3 * HOUR}
    own = feats.select("hot_item_id", F.floor(F.col("hot_item_id") / 4).alias("hot_cluster_id"), F.lit(None).cast("timestamp").alias("removed_at"))
    said = {(r.hot_item_id, r.other_id): json.loads(r.reason) for r in M.decide(M.candidates(feats, own), feats).withColumn("reason", M.match_reason()).collect()}
    assert said[2, 1] == {"layer": "L1", "method": "CANONICAL_URL", "score": 0.97, "reason": "canonical URL match: https://a.example/1"}
    assert (said[5, 4]["method"], said[5, 4]["reason"]) == ("ARXIV_ID", "arxiv id match: 2401.00001") and said[3, 1]["method"] == "ENTITY_TIME"
    third = said[7, 6]
    assert third["method"] == "SIMILARITY" and third["reason"] == "L3 similarity below reject threshold" and set(third["components"]) == {*M.COMPONENTS, "weightedTotal"} and third["components"]["weightedTotal"] == third["score"]
    decisions, history = C.recluster_anew(feats, own, 1, [5, 6], "look again")
    got = sorted((r.hot_item_id, r.other_id, r.decision) for r in decisions.where("hot_item_id = 5 or other_id is null").collect())
    assert (5, 4, "ACCEPTED") in got and history.count() == 2 and {r.hot_item_id for r in decisions.collect()} <= {5, 6}


def test_a_shadow_score_fails_alone(spark):
    v1 = spark.createDataFrame([(1, 2.0, "hn-score-v1")], "hot_cluster_id long, total_score double, scoring_version string")
    good, error = B.scored(v1, lambda: v1.withColumn("scoring_version", F.lit("cross-source-score-v2")))
    assert good.count() == 2 and error is None
    bad, error = B.scored(v1, lambda: v1.withColumn("total_score", F.raise_error(F.lit("no trends")).cast("double")))
    assert [r.hot_cluster_id for r in bad.collect()] == [1] and "no trends" in error


def test_text_metrics_and_directions(spark):
    raw = spark.createDataFrame([(1, "ARXIV", "1", json.dumps({"title": "t", "arxivId": "1", "url": "https://arxiv.org/abs/1", "pdfUrl": "http://www.arxiv.org/pdf/1"})), (2, "HUGGING_FACE", "2", json.dumps({"modelId": "o/m", "url": "https://h/", "libraryName": " ", "private": "true"})), (3, "GITHUB", "3", json.dumps({"fullName": "o/r", "url": "https://g/"})), (4, "SOGOU_SEARCH", "4", json.dumps({"title": "t", "url": "https://s/", "score": 12.5, "site": "x  y"}))], "id int, source_type string, external_id string, raw_payload string").withColumn("fetched_at", F.lit(T0))
    got = {r.id: r for r in I.normalize(raw).collect()}
    assert got[1].text_metrics == {"pdfUrl": "https://arxiv.org/pdf/1"} and got[2].text_metrics == {"private": "true"} and got[3].text_metrics == {} and got[4].text_metrics == {"site": "x y"} and got[4].metrics["score"] == 12.5
    d = spark.createDataFrame([(" Asc",), ("desc",), ("",), (None,), ("up",)], "d string")
    assert [r.x for r in d.select(P.sort_direction(F.col("d")).alias("x")).collect()] == [1, -1, -1, -1, None]


def test_the_cap_loses_no_accepted_pair(spark):
    """On the smallest tables: what is accepted within 72 hours with 50 candidates an item, and with all."""
    import os

    import pytest

    from trendlake.sources import tables as D

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    feats = sinks.stored(M.features(D.items(spark, sf)))
    at = D.memberships(feats.select("hot_item_id", F.col("event_time").alias("published_at")))

    def accepted(**how):
        rows = M.decide(M.candidates(feats, at, **how), feats).where("decision = 'ACCEPTED'")
        return {(r.hot_item_id, r.other_id) for r in rows.select("hot_item_id", "other_id").collect()}

    few, every = accepted(), accepted(most=None)
    assert few == every and len(every) > 500 and all(b < a for a, b in every)
