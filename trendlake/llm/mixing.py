"""Mixing sources to target weights, with a curriculum that changes over training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights that the sources take in turn, and the schedule of each: knots (part of training, relative weight). A schedule is scaled so that its integral over training is the source's target.
WEIGHTS = (5, 2, 1)
SCHEDULES = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (1.0, 1.5))}
#: Most times that a document's words are taken.
REPEATS = 3
#: Hexadecimal digits of the document hash that split a source's running sum: 4096 parts a source.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, skey, weight, source_size, target double) from (source, skey, source_size), one row a source.

    Targets share all words by weight; one that exceeds `repeats` times its source stops there, and the excess goes to the others by weight. In the order of size over weight those that stop come first, so running sums find the level at once.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", w.cast("long"))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("stopped", F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("open", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    left = (F.col("all_size") - repeats * F.col("stopped")).cast("double")
    fits = left * F.col("weight") <= (repeats * F.col("source_size")).cast("double") * F.col("open")
    rows = rows.withColumn("level", F.when(fits, F.struct(left.alias("left"), F.col("open").cast("double").alias("open"))))
    rows = rows.withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.col("level.left") * F.col("weight") / F.col("level.open")
    return rows.select("source", "skey", "weight", "source_size", F.coalesce(share, (repeats * F.col("source_size")).cast("double")).alias("target"))


def _segments(schedules) -> Column:
    """By weight, the pieces of the integrated schedule: (t0, slope, w0, c0), whose integral over [0, 1] is 1."""
    out = F.lit(None)
    for weight, knots in schedules.items():
        area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
        c, parts = 0.0, []
        for (t0, a), (t1, b) in zip(knots, knots[1:]):
            parts.append(F.struct(F.lit(t0).alias("t0"), F.lit((b - a) / (t1 - t0) / area).alias("slope"), F.lit(a / area).alias("w0"), F.lit(c).alias("c0")))
            c += (t1 - t0) * (a + b) / 2 / area
        out = F.when(F.col("weight") == weight, F.array(*parts)) if out is None else F.coalesce(F.when(F.col("weight") == weight, F.array(*parts)), out)
    return out


def position(share: Column, pieces: Column) -> Column:
    """When, from 0 to 1, a source has spent this share of its target: the inverse of its integrated schedule."""
    s = F.element_at(F.filter(pieces, lambda p: p["c0"] <= share), -1)
    rest = share - s["c0"]
    return s["t0"] + F.when(s["slope"] == 0, rest / s["w0"]).otherwise((F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * s["slope"] * rest)) - s["w0"]) / s["slope"])


def _counted() -> Column:
    """Size of a document, the hash that orders it within its source, and a key of the source that null has too."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return F.struct(word_count(F.col("text")).alias("size"), h.alias("h"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey")).alias("mix")


def plan(docs: DataFrame, weights=WEIGHTS, schedules=None, repeats: int = REPEATS) -> DataFrame:
    """Each row of docs(doc_id, text, source, ...) as a struct `row`, and a struct `mix` of size, source_size, target, taken, passes (whole times that it is taken), part (words of one more, cut pass) and first_position.

    Sources in code point order (null last, as a source of its own) take the weights in turn. A source's words count off in the order of md5(doc_id): its target is spent on whole passes over the source, then on a prefix of one more, whose last document is cut. Running sums go over parts of a source, by leading digits of the hash, so a source with most rows is no hot task; the only tables that sit in one task have a row for each source. Null text: size 0. Null doc_id: hashed as ''. Rows with equal doc_id are in order of size. An empty table gives no rows.
    """
    schedules = schedules or SCHEDULES
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", _counted())
    return _placed(rows, weights, schedules, repeats)


def _placed(rows: DataFrame, weights, schedules, repeats) -> DataFrame:
    rows = rows.withColumn("mix", F.col("mix").withField("part", F.substring("mix.h", 1, DIGITS)))
    parts = rows.groupBy(F.col("source").alias("p_source"), F.col("mix.skey").alias("p_skey"), F.col("mix.part").alias("p_part")).agg(F.sum("mix.size").alias("p_size"))
    before = parts.withColumn("p_before", F.coalesce(F.sum("p_size").over(Window.partitionBy("p_skey").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goal = targets(parts.groupBy(F.col("p_source").alias("source"), F.col("p_skey").alias("skey")).agg(F.sum("p_size").alias("source_size")), weights, repeats)
    goal = goal.select(F.col("skey").alias("g_skey"), "weight", "source_size", "target", _segments(schedules).alias("pieces"))
    known = before.join(goal, F.col("p_skey") == F.col("g_skey")).select("p_skey", "p_part", F.struct("p_before", "weight", "source_size", "target", "pieces").alias("p"))
    out = rows.join(known, (F.col("mix.skey") == F.col("p_skey")) & (F.col("mix.part") == F.col("p_part")))
    w = Window.partitionBy("mix.skey", "mix.part").orderBy("mix.h", F.col("mix.size")).rowsBetween(Window.unboundedPreceding, -1)
    size, own = F.col("mix.size"), F.col("p.source_size")
    before = F.col("p.p_before") + F.coalesce(F.sum("mix.size").over(w), F.lit(0))
    out = out.withColumn("mix", F.col("mix").withField("before", before))
    demand = F.round(F.col("p.target")).cast("long")
    passes = F.when(own > 0, F.expr("cast(round(p.target) as bigint) div p.source_size")).otherwise(F.lit(0).cast("long"))
    rest = F.greatest(F.lit(0).cast("long"), F.least(size, demand - passes * own - F.col("mix.before")))
    first = F.when((size > 0) & (passes * size + rest > 0), position(F.col("mix.before") / F.col("p.target"), F.col("p.pieces")))
    mix = F.struct(size.alias("size"), own.alias("source_size"), F.col("p.target").alias("target"), (passes * size + rest).alias("taken"), passes.alias("passes"), rest.alias("part"), F.col("mix.before").alias("before"), F.col("p.pieces").alias("pieces"), first.alias("first_position"))
    return out.withColumn("mix", mix).drop("p_skey", "p_part", "p")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_position) without moving texts."""
    rows = docs.select("doc_id", "source", _counted())
    out = _placed(rows, WEIGHTS, SCHEDULES, REPEATS)
    return out.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.round("mix.first_position", 9).alias("first_position"))


def sequence(docs: DataFrame, **how) -> DataFrame:
    """The training sequence: the rows of docs in order of position, each as often as the mix takes it, with the columns of docs; the last pass of a source's last document keeps its first words only. Sorted by ranges of position over all tasks."""
    rows, names = plan(docs, **how), docs.columns
    m = F.col("mix")
    n = m["passes"].cast("int") + (m["part"] > 0).cast("int")
    rows = rows.where(m["taken"] > 0).select("row", "mix", F.explode(F.sequence(F.lit(0), n - 1)).alias("turn"))
    at = position((F.col("turn") * m["source_size"] + m["before"]) / m["target"], m["pieces"])
    cut = (F.col("turn") == m["passes"]) & (m["part"] < m["size"])
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), m["part"].cast("int"))), "")).otherwise(F.col("row.text"))
    rows = rows.select("row", text.alias("text"), at.alias("at")).orderBy("at", "row.source", "row.doc_id")
    return rows.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         coalesce('s' || source, 'n') AS skey FROM documents),
s AS (SELECT skey, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS stopped,
         CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM w),
f AS (SELECT *, CAST(total - 3 * stopped AS DOUBLE) AS l, CAST(total - 3 * stopped AS DOUBLE) * weight <= CAST(3 * source_size AS DOUBLE) * open AS fits FROM c),
lv AS (SELECT l, CAST(open AS DOUBLE) AS open FROM f WHERE fits ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
t AS (SELECT f.skey, f.weight, f.source_size, CASE WHEN f.fits THEN lv.l * f.weight / lv.open ELSE CAST(3 * f.source_size AS DOUBLE) END AS target FROM f, lv),
b AS (
  SELECT d.*, t.weight, t.source_size, t.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CASE WHEN t.source_size > 0 THEN CAST(round(t.target) AS BIGINT) // t.source_size ELSE 0 END AS passes FROM d JOIN t USING (skey)),
k AS (SELECT *, CAST(passes * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken, before / target AS q FROM b)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE weight WHEN 5 THEN (sqrt(2.25 - 2.0 * q) - 1.5) / -1.0 WHEN 2 THEN q ELSE (sqrt(0.25 + 2.0 * q) - 0.5) / 1.0 END, 9) END AS first_position
FROM k
"""
