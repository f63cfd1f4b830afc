"""Orders, components and other distributed steps against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trendlake.operators import components, evaluation, keyword_search, ordering
from trendlake.sources import sinks

RND = random.Random(4)


def test_positions_and_ranks(spark):
    """A key with most rows, ties and nulls, as one sorted list numbers them."""
    rows = [(RND.choice(["hot"] * 8 + ["a", "b", None]), RND.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = ordering.positions(df, [F.desc("v"), "id"], sinks.stored).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == [i for _, _, i in sorted(rows, key=lambda r: (-r[1], r[2]))] and sorted(r.position for r in got) == list(range(3000))
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    ranked = ordering.ranks(df, ["k"], [F.desc("v"), "id"], sinks.stored)
    assert ranked.columns == ["k", "v", "id", "rank"] and {r.id: r["rank"] for r in ranked.collect()} == want
    assert ordering.ranks(df.where("false"), ["k"], ["id"], sinks.stored).count() == 0


def parts_of(links):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        if a != b and a is not None and b is not None:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top) if find(x) != x}


def test_components(spark):
    star = [(5000, 5001 + i) for i in range(500)] + [(9000, 5000)]
    links = [(RND.randrange(400), RND.randrange(400)) for _ in range(300)] + star + [(7, 7), (None, 3), (3, None), (1, 2), (2, 1)] * 2
    got = components.connected(spark.createDataFrame(links, "a long, b long"), sinks.stored, sinks.drop).collect()
    assert {r.node: r.label for r in got} == parts_of(links) and len(got) == len({r.node for r in got})
    assert components.connected(spark.createDataFrame([], "a long, b long"), sinks.stored).count() == 0


@pytest.mark.parametrize("order", ["descending", "shuffled"])
def test_long_chains(spark, order):
    """100,000 links in a row, in orders of ids that keep the least one far from everything: a few dozen rounds settle them."""
    ids = list(range(100_001))
    ids.sort(reverse=True) if order == "descending" else RND.shuffle(ids)
    kept = []
    chain = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    got = components.connected(chain, lambda df: kept.append(1) or sinks.stored(df), sinks.drop)
    assert got.agg(F.count("*"), F.max("label"), F.count_distinct("node")).first() == (100_000, 0, 100_000)
    assert len(kept) <= 25


def test_keyword_search(spark):
    """Keywords of no, one, two and more code points, in texts of all lengths and scripts; no nested loop in the plan."""
    alphabet = "ab c\n中文é😀-"
    texts = [(i, "".join(RND.choice(alphabet) for _ in range(RND.randrange(40)))) for i in range(300)] + [(300, None), (301, ""), (302, "ab" * 4000 + "zzz end")]
    words = sorted({"".join(RND.choice(alphabet) for _ in range(n)) for n in (1, 2, 2, 3, 3, 3, 4, 5, 6) for _ in range(6)} | {"", "zzz", "zzz end", "never there", "😀", "中文"})
    df = spark.createDataFrame(texts, "id int, said string")
    got = keyword_search.holding(df, ["id"], "said", spark.createDataFrame([(w,) for w in words], "k string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, w) for i, t in texts if t is not None for w in words if w in t)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert keyword_search.holding(df, ["id"], "said", spark.createDataFrame([], "k string")).count() == 0


@pytest.mark.parametrize("dealt", [1, 7, 1 << 16])
def test_pairs_are_dealt_evenly(spark, dealt):
    """A key with a third of all rows and one with two; null keys; every pair once, in ranges of the same size."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}" if i % 7 else None, i % 5) for i in range(200)] + [(1000, "two", 1), (999, "two", 1), (998, "one", 1)]
    df = spark.createDataFrame(rows, "hot_item_id long, d string, c long")
    got = evaluation.group_pairs(df, "d", ["c"], sinks.stored, dealt)
    want = sorted((a, ca, b, cb) for a, da, ca in rows for b, db, cb in rows if a < b and da == db is not None)
    assert sorted(map(tuple, got.select("hot_item_id_a", "c_a", "hot_item_id_b", "c_b").collect())) == want


def test_places_of_great_numbers(spark):
    """The rule that turns a pair's number into places, where a double's root is rounded."""
    b = 2**31 + 12345
    xs = [b * (b - 1) // 2 - 1, b * (b - 1) // 2, b * (b - 1) // 2 + 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long").withColumn("b", F.floor((1 + F.sqrt(1 + 8.0 * F.col("x"))) / 2).cast("long"))
    got = df.selectExpr("case when b * (b - 1) div 2 > x then b - 1 when (b + 1) * b div 2 <= x then b + 1 else b end as b").collect()
    assert [r.b for r in got] == [b - 1, b, b]


def test_pairs_are_not_shuffled_with_sets(spark):
    """Every pair of 60 items of 400 keywords each is compared; their hashes make up 200 kB, those of both sides of all pairs 11 MB."""
    from trendlake.operators import matching as M

    r = random.Random(3)
    words = {i: {f"w{x}" for x in r.sample(range(40_000), 300)} | {f"w{x}" for x in range(i, i + 100)} for i in range(60)}
    rows = [(i, "x.example", None, None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), {}, [], sorted(w), "UNKNOWN") for i, w in words.items()]
    feats = spark.createDataFrame(rows, "hot_item_id long, publisher_domain string, canonical_url string, normalized_title string, event_time timestamp, external_ids map<string,string>, entities array<struct<type:string,value:string>>, keywords array<string>, event_type string")
    pairs = spark.createDataFrame([(i, j) for i in words for j in range(i)], "hot_item_id long, other_id long")
    store = spark.sparkContext._jsc.sc().statusStore()
    sizes = lambda: (lambda s: {s.apply(k).stageId(): s.apply(k).shuffleWriteBytes() for k in range(s.size())})(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    before = max(sizes(), default=-1)
    got = {(x.hot_item_id, x.other_id): x.components.keywordOverlap for x in M.decide(pairs, feats).collect()}
    assert len(got) == 1770 and all(abs(v - len(words[i] & words[j]) / len(words[i] | words[j])) < 1e-9 + 5e-7 for (i, j), v in got.items())
    assert sum(n for s, n in sizes().items() if s > before) < 2_000_000


def test_sets_are_compared_in_parts():
    """The same counts, whatever is held at once; empty sets share nothing."""
    import numpy as np
    import pyarrow as pa

    from trendlake.operators.matching import _shared

    sets = [[], [1, 2, 3], [3, 9], [2, 3, 9, -4], [], [-4]]
    pairs = [(i, j) for i in range(6) for j in range(6)]
    a, b = (np.array(x) for x in zip(*pairs))
    for cells, most in ((1 << 24, 1 << 20), (1, 1), (8, 3), (12, 100)):
        assert _shared(pa.array(sets, pa.list_(pa.int64())), a, b, cells, most).tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in pairs]


def test_few_and_many_keywords_find_the_same(spark, monkeypatch):
    """Few keywords need no shuffle; both ways find the same."""
    texts = spark.createDataFrame([(1, "the license"), (2, ""), (3, None), (4, "undo it"), (5, "th")], "id long, said string")
    words = spark.createDataFrame([("the",), ("und",), ("",), ("zzzz",), ("i",)], "k string")
    few = keyword_search.holding(texts, ["id"], "said", words)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(keyword_search, "FEW", 0)
    many = keyword_search.holding(texts, ["id"], "said", words)
    want = sorted((i, k) for i, t in ((1, "the license"), (2, ""), (4, "undo it"), (5, "th")) for k in ("the", "und", "", "zzzz", "i") if k in t)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want


def test_members_of_one_url_are_reduced_before_they_are_shuffled(spark):
    from trendlake.operators import trend

    rows = [(i % 2, i, "DISCOVERY", f"u{i % 3}", None if i % 5 else 50 - i // 2) for i in range(60)] + [(0, 100, "PRIMARY", "u0", None), (0, 101, "DISCOVERY", " ", None)]
    got = trend.without_repeated_urls(spark.createDataFrame(rows, "hot_cluster_id long, hot_item_id long, role string, url string, rank int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan
    best = {}
    for r in rows[:60]:
        k = (r[0], r[3])
        best[k] = min(best.get(k, r), r, key=lambda x: (x[4] is None, x[4] or 0, x[1]))
    assert {r.hot_item_id for r in got.collect()} == {r[1] for r in best.values()} | {100, 101}


def test_matching_anew_makes_features_of_its_look_back_alone(spark):
    from trendlake.operators import clusters

    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, day(1)), (2, day(9)), (3, day(10)), (4, day(20))]
    feats = spark.createDataFrame([(i, "x.example", "https://x.example/a", "a title", t, {}, [], ["word"], "UNKNOWN") for i, t in rows], "hot_item_id long, publisher_domain string, canonical_url string, normalized_title string, event_time timestamp, external_ids map<string,string>, entities array<struct<type:string,value:string>>, keywords array<string>, event_type string")
    feats = feats.withColumn("keywords", F.when(F.col("hot_item_id").isin(1, 4), F.raise_error(F.lit("made"))).otherwise(F.col("keywords")))
    at = spark.createDataFrame([(i, i, None) for i, _ in rows], "hot_item_id long, hot_cluster_id long, removed_at timestamp")
    got = clusters.recluster_anew(feats, at, 3, [3], "look again")[0].collect()
    assert [(r.hot_item_id, r.other_id, r.signal, r.decision) for r in got] == [(3, 2, "CANONICAL_URL", "ACCEPTED")]
