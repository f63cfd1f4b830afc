"""Decontamination, fill-in-the-middle and divergence against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from trendlake.llm import divergence, fill_in_middle, winnowing

RND = random.Random(11)
DOCS = "doc_id long, text string, lang string, source string, words array<string>, m int, item string"


def docs(spark, rows):
    """(doc_id, text[, lang, source]) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *("en", "s")[len(r) - 2 :], ["x"], 3, "y") for r in rows], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# ------------------------------------------------------------- decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def contaminated(texts, items, window=10):
    """By comparing every window with every other."""
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[p : p + n])].add("" if i is None else str(i))
    out = []
    for d, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


VOCABULARY = ["w%d" % i for i in range(40)]
LONG = [" ".join(RND.choice(VOCABULARY) for _ in range(n)) for n in (10, 11, 25, 40, 60)]


def mixed_cases():
    items = list(enumerate(LONG, 100))
    items += [(1, "Short item, of SIX words"), (2, "ÉTÉ"), (3, "ÉtÉ"), (4, "a b c"), (5, "a a a a a a a a a a a a a"), (None, "no id has this one of more than ten words in it"), (7, None), (8, ""), (9, " ... "), (100, "the same id, once again, with another text of eleven words here")]
    texts = [None, "", " .,; ", "short ITEM of six_words", "short item of six", "été", "x ÉtÉ y", "a.b-c\x00d", "a " * 3000, "a " * 9, LONG[2], LONG[2], "x" + LONG[2], "# " + LONG[3].upper() + "!!", "No id has this: one of more than ten words, in it.", "the same id once again with another text of eleven words here " + LONG[0]]
    for _ in range(60):
        t = [RND.choice(VOCABULARY) for _ in range(RND.randrange(50))]
        w = RND.choice(LONG).split()
        a = RND.randrange(len(w))
        at = RND.randrange(len(t) + 1)
        texts.append(" ".join(t[:at] + w[a : a + RND.randrange(5, 20)] + t[at:]))
    return [(i, t) for i, t in enumerate(texts)] + [(None, LONG[1]), (None, LONG[1]), (0, "x"), (0, "x")], items


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, low long")


def test_contamination(spark):
    texts, items = mixed_cases()
    assert rows_of(winnowing.digest(docs(spark, texts), items_of(spark, items))) == sorted(contaminated(texts, items), key=str)


def test_contamination_with_a_full_mask(spark, monkeypatch):
    """Fingerprints that pass the mask by chance change nothing."""
    monkeypatch.setattr(winnowing, "_BUCKET", "cast({0} & 0 as int)")
    monkeypatch.setattr(winnowing, "_BIT", "cast({0} & 1 as int)")
    texts, items = mixed_cases()
    assert rows_of(winnowing.digest(docs(spark, texts), items_of(spark, items))) == sorted(contaminated(texts, items), key=str)


@pytest.mark.parametrize("window,k", [(5, 2), (13, 4), (3, 3)])
def test_contamination_of_other_windows(spark, window, k):
    texts, items = mixed_cases()
    got, sets = winnowing.contamination(docs(spark, texts), items_of(spark, items), window, k)
    ids = {r.item_set: r.item_ids for r in sets.collect()}
    rows = [(r.doc_id, r.n_words, sum(s.length for s in r.spans), len(ids.get(r.item_set, [])), sha(",".join(ids.get(r.item_set, []))), bool(r.spans)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(contaminated(texts, items, window), key=str)


def test_contamination_without_items_or_documents(spark):
    none = rows_of(winnowing.digest(docs(spark, [(1, "a b")]), items_of(spark, [])))
    assert none == [(1, 2, 0, 0, sha(""), False)] == rows_of(winnowing.digest(docs(spark, [(1, "a b")]), items_of(spark, [(1, None), (2, "-")])))
    assert winnowing.digest(docs(spark, []), items_of(spark, [(1, "a b")])).count() == 0


def test_equal_item_sets_are_made_once(spark):
    """Items that share a window are one list, and documents with the same lists one set."""
    shared = " ".join(VOCABULARY[:10])
    got, sets = winnowing.contamination(docs(spark, [(i, f"{i}x {shared} {i}y") for i in range(30)]), items_of(spark, [(i, shared) for i in range(50)]))
    (one,) = sets.collect()
    assert one.item_ids == sorted(map(str, range(50))) and {tuple(map(tuple, r.spans)) for r in got.collect()} == {((1, 10),)} and got.count() == 30


# ------------------------------------------------------------- fill in the middle


def units(t):
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)


def filled(d, t):
    t = t or ""
    h = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = units(t)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return d, len(u), "plain", None, None, sha(t), sha(t)
    if h4 % 100 < 80:
        return d, len(u), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)
    return d, len(u), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)


TEXTS = [None, "", " ", " \t\n", "a", " a", "a ", "a  b", "😀 😀😀\n\n x y z\x0b\x0c\r end ", "x <P> y", "<S>", "a<M>", "< P> <", "<P", "S> <S", "a" * 5000, " " * 5000, "ab c\n" * 4000, "tail <", "<<S", "\x00 \x1f x", "é́ ñ"]


def test_fill_in_middle(spark):
    rows = [(i, t) for i in range(0, 400, 23) for t in TEXTS] + [(None, "a b c d"), (5, "x y"), (5, "x y")]
    assert rows_of(fill_in_middle.digest(docs(spark, rows))) == sorted((filled(d, t) for d, t in rows), key=str)
    assert fill_in_middle.digest(docs(spark, [])).count() == 0


BY_HAND = {
    "word": units,
    "line": lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
    "character": list,
    "sentence": lambda t: re.findall(r"(?s).+?(?:(?<=[.!?。！？])(?=[ \t-\r])|(?<=[。！？])(?=[^ \t-\r.!?。！？])|\Z)", t),
    "run": lambda t: re.findall(r"[0-9]+|[A-Za-z]+|[ \t-\r]+|[^0-9A-Za-z \t-\r]+", t),
}


@pytest.mark.parametrize("unit", sorted(BY_HAND))
def test_units_are_whole(spark, unit):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate([*TEXTS, "One. Two?! Three 3.5 x。四！五 six7eight\nnine\n\nten", "😀1a 2。😀"])]
    for r in docs(spark, rows).select("text", fill_in_middle.pieces(F.col("text"), unit).alias("u")).where("text is not null").collect():
        assert r.u == BY_HAND[unit](r.text), (unit, r.text[:40])


def test_every_cut_form_comes_back(spark):
    got = fill_in_middle.transform(docs(spark, [(i, "α β <\n😀 γ> S> δ" * (i % 4)) for i in range(200)]), "character", rate=100, spm_rate=50)
    rows = got.withColumn("again", fill_in_middle.restored(got.output, got.form)).collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and all(r.again == r.text and (r.form == "plain") == (r.text == "") for r in rows)
    assert all(r.prefix + r.middle + r.suffix == r.text for r in rows if r.form != "plain")


# ------------------------------------------------------------- divergence


def divergent(rows, least, top):
    by, df = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, source in rows:
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
        by[lang or "", source or ""].update(w)
        df[lang or ""].update(set(w))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        own = {s: c for (x, s), c in by.items() if x == lang}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        for s in own:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, rs in (("pair", pair), ("term", term)) for k, (v, i) in enumerate(rs, 1)]
    return sorted(out)


def test_divergence(spark):
    words = ["w%s" % chr(97 + i) for i in range(12)] + ["É", "é", "Ab", "aB", "x1y", "\U0001f600", "￮"]
    rows = []
    for i in range(240):
        lang, source = RND.choice(["en", "fr", "", None]), RND.choice(["s", "t", "u", None, "", "￮", "\U0001f600"])
        rows.append((i, " ".join(RND.choice(words[: 6 + i % 14]) for _ in range(RND.randrange(30))), lang, source))
    rows += [(1, None, "de", "s"), (2, "", "de", "t"), (3, "12 34", "nl", "s"), (4, "wa " * 4000, "en", "s"), (4, "wa " * 4000, "en", "s"), (None, "wa wb", None, None)]
    for least, top in ((30, 50), (5, 3)):
        assert sorted(map(tuple, divergence.audit(docs(spark, rows), least, top).collect())) == divergent(rows, least, top)
    assert divergence.audit(docs(spark, [])).count() == 0
    one = divergence.audit(docs(spark, rows[:1]))
    assert one.count() == 0


def test_shares_of_great_counts_are_exact(spark):
    """10^9 times such counts does not fit in 64 bits."""
    c, n, v = 3 * 10**11, 10**13 + 7, 10**6
    p = "1L + (cast(1000000000 as decimal(10,0)) * cast(c + 5 as decimal(20,0))) div (cast(n as decimal(20,0)) + cast(5 as decimal(1,0)) * cast(v as decimal(17,0)))"
    assert spark.createDataFrame([(c, n, v)], "c long, n long, v long").selectExpr(f"{p} as p").first().p == 1 + 10**9 * (c + 5) // (n + 5 * v)
