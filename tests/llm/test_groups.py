"""Similarity joins, spans and mixing against brute force."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendlake.llm import mixing, ngram_jaccard, sentence_spans, vector_join
from trendlake.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, node long"
RND = random.Random(5)
WORDS = ["w%d" % i for i in range(300)]


def docs(spark, texts):
    """Rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in texts], DOCS)


def family(base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(RND.randrange(edits + 1)):
            w[RND.randrange(len(w))] = RND.choice(WORDS)
        out.append(" ".join(w))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def closure(ids, linked):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_jaccard(spark):
    texts = []
    for _ in range(4):
        base = [RND.choice(WORDS) for _ in range(80)]
        texts += family(base, 25, 5)
    texts += [None, "", " \n ", "one two", "ONE  two", "one two three", "é É x y z", "a " * 3000, "a " * 3000 + "b"]
    texts += [" ".join(RND.choice(WORDS) for _ in range(50)) for _ in range(30)]
    texts += texts[:3]
    rows = list(enumerate(texts))
    sets = {i: shingle_set(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = closure(sets, linked)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), top[i]) for i in sets}


def test_jaccard_long_lists_and_heavy_keys(spark, monkeypatch):
    """The paths for long lists and frequent shingles give the same links."""
    monkeypatch.setattr(ngram_jaccard, "LIST", 7)
    monkeypatch.setattr(ngram_jaccard, "HEAVY", 3)
    base = [RND.choice(WORDS) for _ in range(60)]
    rows = list(enumerate(family(base, 60, 6)))
    sets = {i: shingle_set(t) for i, t in rows}
    top = closure(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(docs(spark, rows)).collect()} == top


@pytest.mark.parametrize("f", [ngram_jaccard.jaccard_components, sentence_spans.remove_repeats, mixing.digest, mixing.sequence])
def test_empty_tables(spark, f):
    assert f(docs(spark, [])).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = ngram_jaccard.jaccard_components(docs(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.component_id or 0, r.n_shingles) for r in got) == [(False, 1, 2), (False, 1, 2), (True, 0, 0), (True, 1, 2)]


def units(t):
    """Sentences of a text whose sentences are short, as lists of (start, end) of words."""
    out, at = [], [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
    for k, (s, e) in enumerate(at):
        if k == 0 or re.search(r"[.!?\u2026][\"')\u201d]{0,2}$", t[at[k - 1][0] : at[k - 1][1]]) or "\n" in t[at[k - 1][1] : s]:
            out.append([])
        out[-1].append((s, e))
    return out


def brute_spans(rows, least_words):
    """By all runs of several sentences, of every length."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        u, cover = units(t), set()
        for s in range(len(u)):
            for e in range(s + 2, len(u) + 1):
                key = tuple(t[x:y].lower() for k in range(s, e) for x, y in u[k])
                if len(key) >= least_words:
                    if key in seen:
                        cover |= set(range(s, e))
                    seen.add(key)
        at = [x[0][0] for x in u] + [len(t)]
        out[d] = t[: at[0]] + "".join(t[at[k] : at[k + 1]] for k in range(len(u)) if k not in cover)
    return out


def test_repeated_rows_of_several_batches_keep_the_first(spark):
    text = lambda k: " ".join(f"W{k}x{i}." for i in range(60))
    rows = [(1, text(1)), (None, text(2)), (3, text(3)), (4, text(3))] * 6
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    try:
        for batch in ("1", "5", "1000"):
            spark.conf.set(size, batch)
            got = sentence_spans.remove_repeats(docs(spark, rows).repartition(5)).collect()
            assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, text(1)), (0, text(2)), (3, text(3)), (4, "")] * 6), batch
    finally:
        spark.conf.set(size, old)


def test_spans(spark):
    sentence = lambda: " ".join(RND.choice(WORDS) for _ in range(RND.randrange(2, 17))).capitalize() + RND.choice([".", "!", '."', "\u2026"])
    shared = " ".join(sentence() for _ in range(9))
    rows = []
    for i in range(40):
        t = " ".join(sentence() for _ in range(RND.randrange(1, 8)))
        if i % 3 == 0:
            t += RND.choice([" ", "\n"]) + shared + " " + sentence()
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "  \n"), (103, rows[0][1]), (104, "É. " * 60), (105, "A b. C d. " * 9), (106, "Zz yy. A b. C d. Xx ww.")]
    texts = [r for r in rows if r[1] is not None]
    for words in (sentence_spans.WORDS, 1):
        got = {r.doc_id: r for r in sentence_spans.remove_repeats(docs(spark, rows), words).collect()}
        assert {d: r.text for d, r in got.items()} == brute_spans(texts, words) | {100: None}
        # a passage of over 50 words stays once
        assert sum(shared in r.text for r in got.values() if r.text) == 1 and got[103].text == ""
        assert {d: r.n_sentences for d, r in got.items()} == {d: len(units(t)) for d, t in texts} | {100: 0}


def test_spans_without_marks(spark):
    """A passage that no mark divides is found at any offset, in any script; German nouns divide nothing."""
    plain = lambda n: " ".join(RND.choice(WORDS) for _ in range(n))
    passage, greek = plain(70), " ".join("".join(RND.choice("αβγδεζηθ") for _ in range(5)) for _ in range(70))
    han = lambda n: "".join(chr(0x4E00 + RND.randrange(3000)) for _ in range(n))
    said = "".join(han(12) + "。" for _ in range(6))
    rows = [(i, f"{plain(3 + 5 * i)} {passage if i % 2 else greek} {plain(9)}") for i in range(12)] + [(20 + i, han(15) + "。" + said + han(9)) for i in range(3)]
    rows += [(30, "Die Katze sah den Hund im Garten. Der Hund sah nichts. Alle gingen Heim."), (31, "x " * 5000)]
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(docs(spark, rows)).collect()}
    assert [got[i].n_removed > 0 for i in range(12)] == [False, False] + [True] * 10
    assert all(got[i].text.startswith(rows[i][1].split(" ")[0]) and len(got[i].text) < len(rows[i][1]) - 100 for i in range(2, 12))
    assert got[20].n_removed == 0 and all(said not in got[i].text and got[i].text for i in (21, 22))
    assert got[30].n_sentences == 3 and got[30].text == rows[-2][1]


def test_rows_without_ids_are_told_apart(spark):
    """Texts with one CRC-32 and no id."""
    texts = ["plumless " + "a b c. d e f. " * 10, "buckeroo " + "a b c. d e f. " * 10]
    got = sentence_spans.remove_repeats(docs(spark, [(None, t) for t in texts] + [(None, "plumless"), (None, "buckeroo")])).collect()
    assert sorted(len(r.text) for r in got)[:2] == [8, 8] and len({sentence_spans._sha(t.encode()) for t in ("plumless", "buckeroo")}) == 2
    t = spark.createDataFrame([("é",)], "t string").select(F.conv(F.substring(F.sha2(F.col("t").cast("binary"), 256), 1, 15), 16, 10).cast("long").alias("h")).first().h
    assert t == sentence_spans._sha("é".encode())


def test_vectors(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(12, 16))
    rows = []
    for i in range(150):
        v = base[i % 12] + g.normal(size=16) * g.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] + [1.0] * 15, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, [2 * x for x in rows[0][1]], 0), (207, [1.0, 0.0], 0), (208, [1.0, 0.0], 0), (209, [], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, gid long")
    unit, links = {}, []
    for i, v, lab in rows:
        if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = (np.array(v) / np.linalg.norm(v), lab)
    for a in unit:
        for b in unit:
            if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98:
                links.append((a, b))
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    top = closure([r[0] for r in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_join.near_duplicates(df).collect()}
    assert got == {r[0]: (n[r[0]], top[r[0]], top[r[0]] == r[0]) for r in rows}
    assert vector_join.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("size, tile", [(10, 16), (60, 1024)])
def test_vectors_in_many_cells_and_blocks(spark, monkeypatch, size, tile):
    """Clusters, some of which touch, in cells of their own: the same links, fewer comparisons, few copies."""
    monkeypatch.setattr(vector_join, "TILE", tile)
    g = np.random.default_rng(4)
    base = g.normal(size=(size, 8))
    base[1] = base[0] + g.normal(size=8) * 0.1
    x = np.repeat(base, 600 // size, 0) + g.normal(size=(600, 8)) * 0.08
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.98
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, [float(y) for y in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_join.near_duplicates(df).collect()}
    top = closure(range(600), [(int(a), int(b)) for a, b in zip(*np.nonzero(hit))])
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(hit[i].sum()), top[i]) for i in range(600)}
    groups = spark.createDataFrame([(i, 1, 1, v.tobytes()) for i, v in enumerate(u)], "gid long, label long, copies long, u binary")
    members = vector_join.cells(groups, 0.98).toPandas()
    assert members[members.home].gid.nunique() == 600 == members.home.sum() and len(members) < 2.5 * 600
    homes, all_of = members[members.home].groupby("cell").size(), members.groupby("cell").size()
    assert len(homes) >= 4 and sum(n * (n / 2 + all_of[c] - n) for c, n in homes.items()) < 600**2 / 2 * 0.6
    blocks, pairs = vector_join.compared(vector_join.cells(groups, 0.98), 0.98)
    assert blocks.count() == len(members) and (tile > 600 or pairs.count() < blocks.select("cell", "ring", "sub").distinct().count() ** 2 / 2)


def test_plan_of_a_sample_in_any_order():
    """Rows come from a shuffle in any order: the same pivots, radii and rings."""
    g = np.random.default_rng(4)
    x = np.repeat(g.normal(size=(60, 8)), 10, 0) + g.normal(size=(600, 8)) * 0.08
    u = [v.tobytes() for v in x / np.linalg.norm(x, axis=1)[:, None]]
    plan = lambda order: vector_join._planned(pa.table({"label": [1] * 600, "width": [64] * 600, "u": pa.array([u[i] for i in order], pa.binary()), "n": [600] * 600}), 0.2).to_pydict()
    want = plan(range(600))
    assert len(want["cell"]) > 4 and all(plan(g.permutation(600)) == want for _ in range(5))


def test_mixing(spark):
    texts = [(i, " ".join(["w"] * (i % 37)), "en", None if i % 5 == 4 else "s%d" % (i % 5 if i % 11 else 9), 0) for i in range(300)] + [(300, None, "en", "s9", 0), (None, "a b", "en", "s0", 0)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").withColumn("mix", F.lit(1)).withColumn("size", F.lit("x"))
    rows = mixing.digest(df).collect()
    by = {}
    for r in rows:
        by.setdefault((r.target, r.source_size), []).append(r)
        assert r.taken <= 3 * r.size
    assert sum(r.size for r in rows) == round(sum(t for t, _ in by))
    for (target, _), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= 1 and target <= 3 * own[0].source_size + 1e-6
    seq = mixing.sequence(df.drop("mix")).collect()
    assert sum(len((r.text or "").split()) for r in seq) == sum(r.taken for r in rows)
    assert mixing.sequence(df).columns == df.columns


def test_curriculum_positions(spark):
    """Positions invert the integrated schedule."""
    share = [0.0, 0.1, 0.5, 0.9]
    pieces = mixing._segments({1: ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0))})
    got = [r.x for r in spark.createDataFrame([(1, s) for s in share], "weight int, s double").select(mixing.position(F.col("s"), pieces).alias("x")).collect()]
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, [0, 0.5, 1], [2, 1, 0])
    c = np.cumsum(w) / w.sum()
    assert np.allclose(got, [grid[np.searchsorted(c, s)] for s in share], atol=1e-4)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    r = con.sql(Q.ORACLES[name])
    names, want = r.columns, r.fetchall()
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    key = lambda t: tuple((v is None, str(v)) for v in t)
    assert sorted((tuple(norm(x[c]) for c in cols) for x in df.collect()), key=key) == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in want), key=key)
