"""Benchmark decontamination by winnowing: documents and items share a fingerprint wherever they share a window of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import NO_LETTER_OR_DIGIT, ascii_lower, words
from .common import Scratch

#: Words of a window, and of the grams that are hashed.
WINDOW, K = 10, 4
#: The mask of the items' fingerprints has 2^19 rows of 64 bits at most, whatever the number of items; where it is full, more fingerprints pass it, and the join that follows stays exact.
BUCKET_BITS = 19


def _range(n: Column) -> Column:
    """0 to n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(k: int) -> Column:
    """Hashes of all runs of k words."""
    return F.transform(_range(F.size("words") - (k - 1)), lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(k))))


def _least(hashes: str, wide: int) -> Column:
    """The least of each `wide` hashes in a row."""
    if wide == 1:
        return F.col(hashes)
    return F.transform(_range(F.size(hashes) - (wide - 1)), lambda i: F.least(*(F.get(hashes, i + j) for j in range(wide))))


def _starts(hashes: str) -> Column:
    """Where a run of equal hashes starts."""
    return F.filter(_range(F.size(hashes)), lambda i: (i == 0) | (F.get(hashes, i) != F.get(hashes, i - 1)))


def _runs(m: int) -> Column:
    """(m, low, p, last) of each run of windows of m words with the same least hash."""
    end = lambda j: F.coalesce(F.get(f"from{m}", j + 1), F.size(f"low{m}")) - 1
    return F.transform(f"from{m}", lambda p, j: F.struct(F.lit(m).alias("m"), F.get(f"low{m}", p).alias("low"), p.alias("p"), end(j).alias("last")))


def _winnowed(rows: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """rows, which have `words`, with a column low<m> for each length m: the least hash of the k-word grams (of m words, where m < k) within each window of m words."""
    if not lengths:
        return rows
    rows = rows.withColumns({f"grams{n}": _grams(n) for n in {min(k, m) for m in lengths}})
    return rows.withColumns({f"low{m}": _least(f"grams{min(k, m)}", m - min(k, m) + 1) for m in lengths}).drop(*(f"grams{n}" for n in range(1, k + 1)))


_BUCKET = f"cast({{0}} & {(1 << BUCKET_BITS) - 1} as int)"
_BIT = f"cast(shiftright({{0}}, {BUCKET_BITS}) & 63 as int)"


def _mask(hashes: DataFrame) -> DataFrame:
    """(bucket, mask): a bitmap of the hashes, of fixed size at most."""
    return hashes.groupBy(F.expr(_BUCKET.format("low")).alias("bucket")).agg(F.expr(f"bit_or(shiftleft(1L, {_BIT.format('low')}))").alias("mask"))


def _item_windows(items: DataFrame, window: int, k: int, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """(item, m, low, said): each distinct window of each item, of `window` words, or all words of a shorter one; and which lengths m there are."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(ascii_lower(F.col("text")), NO_LETTER_OR_DIGIT).alias("words")).where(F.size("words") > 0)
    rows = scratch.keep(rows.withColumn("m", F.least(F.size("words"), F.lit(window))))
    lengths = sorted(r["m"] for r in rows.select("m").distinct().collect())  # `window` values at most
    if not lengths:
        return rows.select("item", "m", F.lit(0).cast("long").alias("low"), F.lit("").alias("said")), []
    low = F.coalesce(*(F.when(F.col("m") == m, F.col(f"low{m}")) for m in lengths))
    rows = _winnowed(rows, lengths, k).select("item", "m", "words", F.posexplode(low).alias("p", "low"))
    return scratch.keep(rows.select("item", "m", "low", F.concat_ws(" ", F.expr("slice(words, p + 1, m)")).alias("said")).distinct()), lengths


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Where documents (doc_id, text) hold windows of items (item_id, text): `window` consecutive words of an item, or all words of one that has fewer. Words are runs of ASCII letters and digits and of all code points beyond ASCII, with A-Z lower-cased.

    First result, a row for each document: doc_id, n_words, `spans` (array of (first, length), in words: the longest stretches that windows cover, apart from each other, in order) and `item_set`, null without hits. Second result: (item_set, item_ids), sorted as strings. Item sets that many documents share are made once.

    A window's fingerprint is the least hash of its k-word grams; of neighbouring windows with the same one a document keeps one row. As equal windows have equal least hashes, every shared window is found. Rows whose fingerprint is not in the mask of the items' end in the task that made them; what is left is extended to its windows, and these are joined with the items' windows as text, so no hash decides. No fingerprint meets more than itself, however many items or documents hold it: items with the same window count as one list, known by a sum of hashes, until their ids are written.

    Null texts have no words, items without words have no windows, items without an id have the id '', those with the same id are one. Repeated documents count each; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "winnowing")
    of_items, lengths = _item_windows(items, window, k, scratch)
    lists = of_items.groupBy("said").agg(F.concat_ws(":", F.count("*"), *(F.sum(F.xxhash64("item", F.lit(s)).cast("decimal(38,0)")) for s in (1, 2))).alias("list"))
    lists = scratch.keep(lists)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), words(ascii_lower(text), NO_LETTER_OR_DIGIT).alias("words"))
    rows = _winnowed(rows, lengths, k)
    rows = rows.withColumns({f"from{m}": _starts(f"low{m}") for m in lengths}) if lengths else rows
    row_itself = F.array(F.struct(F.lit(0).alias("m"), F.lit(0).cast("long").alias("low"), F.lit(-1).alias("p"), F.lit(-1).alias("last")))
    rows = rows.select("doc_id", "sha", "words", F.explode(F.concat(row_itself, *map(_runs, lengths))).alias("r")).select("doc_id", "sha", "words", "r.*")
    rows = rows.withColumn("bucket", F.expr(_BUCKET.format("low"))).join(F.broadcast(_mask(of_items)), "bucket", "left")
    rows = rows.where(f"m = 0 or (shiftright(mask, {_BIT.format('low')}) & 1) = 1")
    rows = rows.select("doc_id", "sha", "words", "m", F.explode(F.sequence("p", "last")).alias("p"))
    found = scratch.keep(rows.select("doc_id", "sha", F.size("words").alias("n_words"), "m", "p", F.when(F.col("m") > 0, F.concat_ws(" ", F.expr("slice(words, p + 1, m)"))).alias("said")))

    hits = found.where("m > 0").select("sha", "m", "p", "said").join(lists, "said")
    texts = hits.groupBy("sha").agg(F.sort_array(F.collect_set(F.struct("p", "m"))).alias("hits"), F.sort_array(F.collect_set("list")).alias("lists"))
    # hits in order of place: each one lengthens the last span, or starts one
    none = F.array().cast("array<struct<first:int,length:int>>")
    one = F.struct(F.col("hits")[0]["p"].alias("first"), F.col("hits")[0]["m"].alias("length"))
    state = F.struct(none.alias("done"), one.alias("now"))
    end = lambda s: s["now"]["first"] + s["now"]["length"]
    grow = lambda s, x: F.when(x["p"] <= end(s), F.struct(s["done"].alias("done"), F.struct(s["now"]["first"].alias("first"), F.greatest(s["now"]["length"], x["p"] + x["m"] - s["now"]["first"]).alias("length")).alias("now"))).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.struct(x["p"].alias("first"), x["m"].alias("length")).alias("now")))
    spans = F.aggregate("hits", state, grow, lambda s: F.concat(s["done"], F.array(s["now"])))
    texts = scratch.keep(texts.select("sha", spans.alias("spans"), "lists", F.sha2(F.array_join("lists", ",").cast("binary"), 256).alias("item_set")))

    members = of_items.join(lists, "said").select("list", "item").distinct()
    sets = texts.select("item_set", "lists").dropDuplicates(["item_set"]).select("item_set", F.explode("lists").alias("list"))
    sets = sets.join(members, "list").select("item_set", "item").distinct().groupBy("item_set").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    out = found.where("m = 0").select("doc_id", "sha", "n_words").join(texts.select("sha", "spans", "item_set"), "sha", "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), "item_set"), sets


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What the query returns of contamination()."""
    rows, sets = contamination(docs, items)
    ids = sets.select("item_set", F.size("item_ids").cast("long").alias("n"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("ids"))
    # documents without hits have no set: keys of their own, that no set has, keep them from meeting in one task
    spread = F.concat(F.lit("no "), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)).cast("string"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    rows = rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("item_set", spread).alias("item_set")).join(ids, "item_set", "left")
    return rows.select("doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("ids", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The contract without fingerprints: all windows of all items held against all windows of all documents.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS said FROM (SELECT item, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, m, p, array_to_string(w[p : p + m - 1], ' ') AS said FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT r, m, p, item FROM dw JOIN iw USING (m, said)),
places AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + m - 1)) AS x FROM (SELECT DISTINCT r, m, p FROM hit)) GROUP BY r),
of_doc AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places USING (r) LEFT JOIN of_doc USING (r)"""
