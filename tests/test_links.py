"""Links of accepted pairs against all pairs, made one by one."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trendlake import catalog
from trendlake.operators import clusters as C
from trendlake.operators import links as K
from trendlake.operators import matching as M
from trendlake.sources import sinks

HEADS = ("OpenAI launches GPT-5: ", "Anthropic ships Claude Code - ", "Meta open-source Llama 3. ", "NVIDIA raises funding: ", "")
SAID = "alpha beta gamma delta model weights run fast on small chips while others wait for a longer context today".split()


def made(n, seed):
    """(id, title, summary, url, minutes, active): families of near copies, some on the same address, over forty days."""
    r, rows = random.Random(seed), []
    for i in range(n):
        head, start, k = r.choice(HEADS), " ".join(r.choices(SAID[:6], k=r.choice((0, 1, 1, 2, 5)))), r.choice((0, 0, 2, 5, 14))
        body = [w for j, w in enumerate(SAID) if (j * 7 + k) % 15]
        for _ in range(r.choice((0, 0, 1, 3))):
            body[r.randrange(len(body))] = f"word{r.randrange(30)}"
        url = f"https://arxiv.org/abs/2401.{r.randrange(5):05}" if r.random() < 0.1 else f"https://site{r.randrange(3)}.example/{i if r.random() < 0.8 else i % 5}"
        rows.append((i, head + start, " ".join(body), url, r.randrange(0, 40 * 1440, 60) if r.random() < 0.97 else None, r.random() < 0.6))
    return rows


def closure(n, edges):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("seed, dealt", [(1, 1024), (2, 4)])
def test_links_of_items_far_apart(spark, monkeypatch, seed, dealt):
    """Later items by any time, and ended memberships: the same clusters as of all pairs."""
    monkeypatch.setattr(K, "DEALT", dealt)
    rows = made(150, seed)
    items = spark.createDataFrame([(i, "RSS", t, s, u, None, str(i), m) for i, t, s, u, m, _ in rows], "hot_item_id long, source_type string, title string, summary string, source_url string, author string, external_id string, m long")
    feats = sinks.stored(M.features(items.withColumn("published_at", F.timestamp_micros(F.col("m") * 60_000_000))))
    membership = spark.createDataFrame([(i, i, None if on else 1) for i, *_, on in rows], "hot_cluster_id long, hot_item_id long, removed_at int")
    pairs = spark.createDataFrame([(x, y) for x in range(150) for y in range(150) if x < y], "hot_item_id long, other_id long")
    accepted = [(r.hot_item_id, r.other_id) for r in M.decide(pairs, feats).where("decision = 'ACCEPTED'").collect()]
    at, on = {r[0]: r[4] for r in rows}, {r[0]: r[5] for r in rows}
    candidate = lambda x, y: None not in (at[x], at[y]) and on[y] and at[y] >= at[x] - 72 * 60
    good = [(x, y) for x, y in accepted if candidate(x, y) or candidate(y, x)]
    want = closure(150, good)
    got = {r.hot_item_id: r.hot_cluster_id for r in C.merge_linked(K.accepted_links(feats, membership), items, sinks.stored).collect()}
    assert got == want
    # some of them by pairs of the third layer alone that are further apart than the look-back
    assert closure(150, [(x, y) for x, y in good if abs(at[x] - at[y]) <= 72 * 60]) != want


def test_links_of_a_family(spark, monkeypatch):
    """Texts under one title, of whose pairs many are accepted: the same clusters as of all pairs, by few rows."""
    monkeypatch.setattr(K, "FAMILY", 32, raising=False)
    r, n, most = random.Random(4), 120, []
    rows = [(i, "OpenAI launches GPT-5: alpha beta", " ".join(f"word{k}" for k in r.sample(range(400), r.choice((3, 60, 60, 90)))), i * 12 * 60 + r.randrange(720) if i % 9 else None, r.random() < 0.4) for i in range(n)]
    items = spark.createDataFrame([(i, "RSS", t, s, f"https://site.example/{i}", None, str(i), m) for i, t, s, m, _ in rows], "hot_item_id long, source_type string, title string, summary string, source_url string, author string, external_id string, m long")
    feats = sinks.stored(M.features(items.withColumn("published_at", F.timestamp_micros(F.col("m") * 60_000_000))))
    membership = spark.createDataFrame([(i, i, None if on else 1) for i, *_, on in rows], "hot_cluster_id long, hot_item_id long, removed_at int")
    pairs = spark.createDataFrame([(x, y) for x in range(n) for y in range(n) if x < y], "hot_item_id long, other_id long")
    accepted = [(x.hot_item_id, x.other_id) for x in M.decide(pairs, feats).where("decision = 'ACCEPTED'").collect()]
    at, on = {x[0]: x[3] for x in rows}, {x[0]: x[4] for x in rows}
    candidate = lambda x, y: None not in (at[x], at[y]) and on[y] and at[y] >= at[x] - 72 * 60
    want = closure(n, [(x, y) for x, y in accepted if candidate(x, y) or candidate(y, x)])
    assert 1000 < len(accepted) < n * (n - 1) / 2 and len(set(want.values())) > 10

    def counted(df):
        out = sinks.stored(df)
        most.append(out.count())
        return out

    got = C.merge_linked(K.accepted_links(feats, membership, counted), items, sinks.stored)
    assert {x.hot_item_id: x.hot_cluster_id for x in got.collect()} == want
    # neither all pairs nor all accepted ones
    assert max(most) < 1000


def test_merged_clusters_of_items_days_apart(spark, tmp_path):
    """The query on documents with times of weeks, as in SQL."""
    r, path = random.Random(5), str(tmp_path / "documents.parquet")
    texts = [" ".join(r.choices(SAID, k=2)) + ". " + " ".join(r.choices(SAID, k=30)) for _ in range(12)]
    ids = sorted(r.sample(range(9000), 160))
    spark.createDataFrame([(i, r.choice(texts) + " more" * (i % 3 == 0), "en", f"src{i % 3}", 100 + i) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/*.parquet'")
    got = catalog.QUERIES["clusters_merged"](spark, os.path.dirname(path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLES["clusters_merged"]).fetchall())


def test_decisions_of_a_least_score(spark):
    """Those that all decisions hold, with the same scores."""
    rows = made(80, 3)
    items = spark.createDataFrame([(i, "RSS", t, s, u, None, str(i), m) for i, t, s, u, m, _ in rows], "hot_item_id long, source_type string, title string, summary string, source_url string, author string, external_id string, m long")
    feats = sinks.stored(M.features(items.withColumn("published_at", F.timestamp_micros(F.col("m") * 60_000_000))))
    pairs = spark.createDataFrame([(x, y) for x in range(80) for y in range(80) if x != y], "hot_item_id long, other_id long")
    told = lambda df: sorted((r.hot_item_id, r.other_id, r.layer, r.method, r.score, r.decision, r.components) for r in df.collect())
    everything = M.decide(pairs, feats)
    for least in (M.ACCEPT, 0.7):
        want = told(everything.where(F.col("score") >= least))
        assert told(M.decide(pairs, feats, least=least)) == want and {r[2] for r in want} == {"L1", "L2", "L3"}
