"""Candidates that are found and compared by blocks of neighbouring items, against those that are found by value and decided."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from trendlake import constants
from trendlake.functions import text as T
from trendlake.operators import matching as M
from trendlake.sources import sinks

T0, HOUR = datetime(2024, 1, 1, tzinfo=timezone.utc), timedelta(hours=1)
FEATURES = "hot_item_id long, event_time timestamp, canonical_url string, external_ids map<string,string>, entities array<struct<type:string,value:string>>, keywords array<string>, event_type string, normalized_title string, publisher_domain string"


def features(spark, n, hours, seed=1):
    """Items with and without each signal; equal times; some without a time."""
    rnd = random.Random(seed)
    pick = lambda *values: rnd.choice(values)
    rows = []
    for i in range(n):
        entities = [(k, f"{k}{v}") for k, v in {(pick("ORG", "PRODUCT"), rnd.randrange(6)) for _ in range(rnd.randrange(3))}]
        ids = pick(None, {}, {"external": str(i % 9)}, {"arxiv": f"24{rnd.randrange(30)}", "external": "1"}, {"github": f"o/{rnd.randrange(30)}", "tweet": None})
        words = pick([], [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(6))], ["common", "w1"])
        rows.append((rnd.randrange(10**6) * 1000 + i, None if i % 31 == 30 else T0 + rnd.randrange(hours * 2) * HOUR / 2, pick("", " ", None, f"https://e.com/{rnd.randrange(20)}"), ids, entities, words, pick("FUNDING", "POLICY", "UNKNOWN"), pick("", "a b c", "a b", f"x {rnd.randrange(9)}"), pick(None, "e.com", "f.com")))
    return sinks.stored(spark.createDataFrame(rows, FEATURES))


def told(rows):
    return sorted((r.hot_item_id, r.other_id, r.signal, r.hot_cluster_id, r.layer, r.method, round(r.score, 6), r.decision, r.shared or "", str(r.components)) for r in rows.collect())


@pytest.mark.parametrize("block, near, hours", [(1024, 2, 200), (8, 2, 300), (8, 9, 600)])
def test_matched_as_decided(spark, monkeypatch, block, near, hours):
    """One block; windows of more blocks than one task takes, but for the first; windows of several blocks that it takes."""
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "NEAR", near)
    feats = features(spark, 240, hours)
    i = F.col("hot_item_id")
    # every fifth item's membership has ended, every seventh has two
    own = feats.select(i, i.alias("hot_cluster_id"), F.when(i % 5 == 0, F.lit(T0)).alias("removed_at"))
    own = own.union(feats.where(i % 7 == 0).select(i, i + 1, F.lit(None).cast("timestamp")))
    some = feats.where(i % 3 == 0).select("hot_item_id")
    for how in ({}, {"most": 3, "only": some}, {"most": None, "hours": 40, "signals": M.ACCEPTING}):
        want = told(M.decide(M.candidates(feats, own, **how), feats))
        assert told(M.matched(feats, own, **how)) == want and len(want) > 100, how


def test_no_value_is_shuffled(spark):
    """300 items with 300 keywords each: what tasks write for others is a fraction of what their keywords, dealt by value, take in one round."""
    rnd = random.Random(5)
    rows = [(i, T0 + i * HOUR / 6, "", {}, [], [f"word{rnd.randrange(3000)}" for _ in range(300)], "UNKNOWN", "", None) for i in range(300)]
    feats = sinks.stored(spark.createDataFrame(rows, FEATURES))
    own = feats.select("hot_item_id", F.col("hot_item_id").alias("hot_cluster_id"), F.lit(None).cast("timestamp").alias("removed_at"))
    kept = []
    got = M.matched(feats, own, stored=lambda df: kept.append(sinks.stored(df)) or kept[-1])
    plan = got._jdf.queryExecution().toString()
    assert got.count() > 0 and "Generate explode(keywords" not in plan and all("v" not in df.columns for df in kept)


def test_names_and_event_types_in_odd_texts(spark):
    """Names at either end, side by side, within other words and across titles and summaries; types by substrings; against plain Python. Neither searches a text once for each of them."""
    rnd, bits = random.Random(3), ["gpt", "5", "GPT-5", " ", "-", "hf", "Hugging", "Face", "open", "AI", "Llama", "3.1", "metaverse", "meta", "Claude", "code", "\n", ".", "é", "stable", "leak", " cve", "fee", "apache 2.0", "apache 2x0", "buys "]
    said = lambda n: "".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randrange(n)))
    rows = [(i, None if i % 17 == 0 else said(9), None if i % 13 == 0 else said(12)) for i in range(3000)]
    rows += [(3000, "", ""), (3001, "GPT", "5"), (3002, "x", "apache 2x0")]
    t, s = F.col("title"), F.col("summary")
    df = spark.createDataFrame(rows, "id long, title string, summary string").select("id", "title", "summary", T.entities(t, s).alias("names"), T.event_type(t, s).alias("kind"))
    for r in df.collect():
        text = f" {T._plain(' '.join(x for x in (r.title, r.summary) if x is not None))} "
        assert sorted(e["value"] for e in r.names) == sorted(v for _, v, names in constants.ENTITIES if any(f" {T._plain(a)} " in text for a in (*names, v))), r
        low = "".join(" " + x.strip(" ") for x in (r.title or "", r.summary or "") if x.strip(" ")).lower()
        assert r.kind == next((k for k, parts in constants.EVENT_TYPES if any(p in low for p in parts)), "UNKNOWN"), r
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "vulnerab" not in plan
