"""How far the sources of a language differ in the terms they use: wide vectors of counts, a term's in all sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import NO_LETTER, ascii_lower, words
from .common import Scratch

#: A term counts in a language with so many documents; what every count gets beside; the whole; ranks kept of terms.
LEAST_DOCS, SMOOTH, WHOLE, TOP_TERMS = 30, 5, 1_000_000_000, 50


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text), nulls read as ''.

    Terms are runs of ASCII letters and of code points beyond ASCII, A-Z lower-cased; a language keeps those in `least_docs` of its documents. Each source of a language gives each of V kept terms p = 1 + floor(10^9 * (count + 5) / (N + 5 V)), with N its number of kept terms, and so does the language as a whole. Part `pair`: value is the sum of |p - q| over kept terms, against each other source. Part `term`: the terms of which the source has more than its language, value p - q, to rank `top_terms`. Ranks start at 1 for each source and part, greater values first, of equal ones the lesser item by UTF-8. A language without kept terms has pairs of value 0; one with a single source has none. Repeated rows count each; an empty table gives no row; further columns are ignored.

    Counts leave each task already summed by language, source and term. Each kept term is one row with an array of its counts by source, of the same length for all terms of a language, so memory grows with the number of sources (as pairs do, which are the result), never with documents. Each term then emits what it adds to each pair, which is summed before it is shuffled. All arithmetic is of whole numbers.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    base = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    w = Window.partitionBy("lang").orderBy("source")
    groups = base.select("lang", "source").distinct().withColumn("place", F.row_number().over(w) - 1)
    groups = scratch.keep(groups.withColumn("sources", F.count("*").over(Window.partitionBy("lang")).cast("int")))

    # equal terms of a document stand side by side, so the first of each tells the number of documents
    terms = base.select("lang", "source", F.sort_array(words(ascii_lower(F.col("text")), NO_LETTER)).alias("terms")).select("lang", "source", "terms", F.posexplode("terms").alias("i", "term"))
    first = (F.col("i") == 0) | (F.col("term") != F.get("terms", F.col("i") - 1))
    counts = terms.select("lang", "source", "term", first.cast("long").alias("first")).groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))
    counts = counts.join(groups, ["lang", "source"])
    sparse = counts.groupBy("lang", "term", "sources").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("place", "n"))).alias("at")).where(F.col("docs") >= least_docs)
    # zeros between the sources that have the term
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    before = lambda k: F.when(k > 0, F.get("at", k - 1)["place"]).otherwise(-1)
    dense = F.flatten(F.transform("at", lambda e, k: F.concat(zeros(e["place"] - before(k) - 1), F.array(e["n"]))))
    wide = scratch.keep(sparse.select("lang", "term", F.concat(dense, zeros(F.col("sources") - 1 - F.element_at("at", -1)["place"])).alias("counts")))

    totals = wide.select("lang", F.posexplode("counts").alias("place", "n")).groupBy("lang", "place").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    totals = scratch.keep(totals.groupBy("lang").agg(F.max("v").alias("v"), F.transform(F.sort_array(F.collect_list(F.struct("place", "n"))), lambda e: e["n"]).alias("all")))
    share = "1L + (cast({whole} as decimal(10,0)) * cast({c} + {smooth} as decimal(20,0))) div (cast({n} as decimal(20,0)) + cast({smooth} as decimal(1,0)) * cast(v as decimal(17,0)))"
    p = share.format(whole=WHOLE, smooth=SMOOTH, c="c", n="`all`[k]")
    vectors = wide.join(totals, "lang").select("lang", "term", "counts", "v", "all", F.expr(f"transform(counts, (c, k) -> {p})").alias("p"), *(F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b).alias(f"sum_{x}") for x in ("counts", "all")))
    vectors = vectors.select("lang", "term", "counts", "p", F.expr(share.format(whole=WHOLE, smooth=SMOOTH, c="sum_counts", n="sum_all")).alias("q"))

    each = vectors.select("lang", "p", F.posexplode("p").alias("i", "own"))
    adds = each.select("lang", "i", F.posexplode(F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda q: F.abs(F.col("own") - q))).alias("k", "f"))
    half = adds.select("lang", "i", (F.col("i") + F.col("k") + 1).alias("j"), "f").groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    both = half.select("lang", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "value").select("lang", "e.i", "e.j", "value")
    names = groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("names"))
    pairs = groups.select("lang", "source", F.col("place").alias("i")).join(names, "lang").select("lang", "source", "i", F.posexplode("names").alias("j", "item")).where("i <> j")
    pairs = pairs.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    more = vectors.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "p")).alias("place", "x")).where("x.counts > 0 and x.p > q")
    more = more.select("lang", "place", F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))
    by_value = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    more = more.withColumn("rank", by_value("lang", "place")).where(F.col("rank") <= top_terms)
    more = more.join(groups, ["lang", "place"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", by_value("lang", "source")).unionByName(more)


_P = "1 + (1000000000 * (CAST(c AS HUGEINT) + 5)) // (n + 5 * v)"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c FROM g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM t GROUP BY 1, 2, 3) x USING (lang, source, term)),
lc AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY 1, 2),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
p AS (SELECT lang, source, term, c, {_P} AS p FROM c JOIN v USING (lang) JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2) USING (lang, source)),
q AS (SELECT lang, term, {_P} AS q FROM lc JOIN v USING (lang) JOIN (SELECT lang, sum(c) AS n FROM lc GROUP BY 1) USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM ranked)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM r WHERE part = 'pair' OR rank <= 50"""
