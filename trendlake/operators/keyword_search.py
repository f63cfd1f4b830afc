"""Which texts hold which of many keywords, as substrings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of the gram that a keyword is found by; shorter keywords are their own.
GRAM = 3
#: A mask of the grams has 2^17 rows of 64 bits at most, whatever the number of keywords.
BUCKET_BITS = 17
#: Share of the texts on which the rarest gram of a keyword is guessed. It decides what a keyword costs, never what it finds.
SAMPLE = 0.01
#: So few keywords are held against every text directly: grams cost more than that.
FEW = 32
_BUCKET, _BIT = f"cast(g & {(1 << BUCKET_BITS) - 1} as int)", f"cast(shiftright(g, {BUCKET_BITS}) & 63 as int)"


def _grams(text: Column, lengths: list[int]) -> Column:
    """Distinct hashes of the runs of so many code points; that of 0 is in every text."""
    chars = F.split(text, "")

    def runs(chars: Column, q: int) -> Column:
        if q == 0:
            return F.array(F.xxhash64(F.lit("")))
        last = F.size(chars) - q
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(chars, i + j) for j in range(q))))).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.transform(F.array(chars), lambda c: F.concat(*(runs(c, q) for q in lengths)))[0])


def holding(texts: DataFrame, ids: list[str], text: str, words: DataFrame) -> DataFrame:
    """(ids, k): which rows of `texts`, whose `ids` are unique, hold which keywords (column k of `words`, distinct, not null) as a substring; the empty one is in every text, null texts hold none.

    Up to FEW keywords are held against every text, in one pass without a shuffle. Of more, each keyword is found by one of its grams, the rarest in a sample, and each text gives its distinct grams; those that are not in a mask of the keywords' end in the task that made them. What meets by a gram is held against the whole text, once. So a text is read once, whatever the number of keywords, and no text meets all keywords.
    """
    few = [r["k"] for r in words.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return texts.select(*ids, F.explode(F.array_compact(F.array(*(F.when(F.col(text).contains(F.lit(k)), F.lit(k)) for k in few)).cast("array<string>"))).alias("k"))
    q = F.least(F.char_length("k"), F.lit(GRAM))
    lengths = sorted(r["q"] for r in words.select(q.alias("q")).distinct().collect())  # four values at most
    if not lengths:
        return texts.select(*ids, F.lit(None).cast("string").alias("k")).where("false")
    of_word = reduce(DataFrame.unionByName, (words.where(q == n).select("k", F.explode(_grams(F.col("k"), [n])).alias("g")) for n in lengths))
    seen = texts.sample(SAMPLE, 1).select(F.explode(_grams(F.col(text), lengths)).alias("g")).join(F.broadcast(_mask(of_word)), F.expr(_BUCKET) == F.col("bucket")).where(_in_mask()).groupBy("g").agg(F.count("*").alias("n"))
    key = of_word.join(seen, "g", "left").groupBy("k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))["g"].alias("g"))
    grams = texts.select(*ids, F.explode(_grams(F.col(text), lengths)).alias("g")).join(F.broadcast(_mask(key)), F.expr(_BUCKET) == F.col("bucket")).where(_in_mask()).select(*ids, "g")
    met = grams.join(key, "g").select(*ids, "k")
    return met.join(texts.select(*ids, text), ids).where(F.col(text).contains(F.col("k"))).select(*ids, "k")


def _mask(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.expr(_BUCKET).alias("bucket")).agg(F.expr(f"bit_or(shiftleft(1L, {_BIT}))").alias("mask"))


def _in_mask() -> Column:
    return F.expr(f"(shiftright(mask, {_BIT}) & 1) = 1")
