"""Language ID with language-bitmask n-gram filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, mix, slices

#: N-gram sizes in bytes of lower-cased UTF-8, whose bytes other than letters count as spaces.
SIZES = (3, 4)
#: Slots of the filters and hash functions of each n-gram.
SLOTS, HASHES = 1 << 18, 3
#: Documents a language that training reads (about, chosen by hash), share of them that must hold an n-gram, and n-grams a language at most.
PER_LANGUAGE, SHARE, GRAMS = 2_000, 0.02, 20_000
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _lower(texts: list[str | None]) -> pa.Array:
    return pa.array([(t or "").lower() for t in texts], pa.string())


def _grams(raw: np.ndarray, off: np.ndarray):
    """(n-gram hash, row) of every n-gram that begins and ends in one row, with a space before and after each row."""
    raw = _FOLD[raw]
    n = len(off) - 1
    rows = np.repeat(np.arange(n), np.diff(off))
    # a space before each row, and one after the last
    wide = np.full(len(raw) + n + 1, 32, np.uint64)
    at = np.arange(len(raw)) + rows + 1
    wide[at] = raw
    owner = np.full(len(wide), n, np.int64)
    owner[at] = rows
    owner[off[:-1] + np.arange(n)] = np.arange(n)
    hashes, owners = [], []
    for k in SIZES:
        if len(wide) < k:
            continue
        m = len(wide) - k + 1
        code = np.full(m, k, np.uint64)
        for j in range(k):
            code = (code << U(8)) | wide[j : j + m]
        # the row's first letter decides; a last space belongs to the next row, or to none
        first, last = owner[:m], owner[k - 2 : k - 2 + m]
        inside = (first == last) & (first < n)
        hashes.append(mix(code[inside]))
        owners.append(first[inside])
    return hashes, owners


def _counts(batches):
    """(lang, gram, documents) of each batch."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        low = pa.RecordBatch.from_arrays([_lower(batch.column("text").to_pylist()), batch.column("lang")], names=["text", "lang"])
        for part, raw, off in slices(low):
            hashes, owners = _grams(raw, off)
            langs = part.column("lang").to_pylist()
            for h, o in zip(hashes, owners):
                bounds = np.searchsorted(o, np.arange(len(langs) + 1))
                for i, lang in enumerate(langs):
                    by.setdefault(lang, []).append(np.unique(h[bounds[i] : bounds[i + 1]]))
        for lang, parts in by.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


class Filters:
    """One Bloom filter a language, stored bit-sliced: a slot holds one bit of each language, 64 languages a plane."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        self.planes = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
        for k, g in enumerate(grams):
            for at in _slots(g):
                self.planes[k // 64][at] |= U(1 << (k % 64))
        # chance that an n-gram that a language lacks seems to be there
        self.wrong = np.array([np.mean((self.planes[k // 64] >> U(k % 64)) & U(1)) ** HASHES for k in range(len(languages))])

    def found(self, hashes, owners, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row, n-grams found in each language, corrected for false positives, and n-grams in all."""
        hits, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for h, o in zip(hashes, owners):
            total += np.bincount(o, minlength=n)
            slots = _slots(h)
            for p, plane in enumerate(self.planes):
                mask = plane[slots[0]]
                for at in slots[1:]:
                    mask &= plane[at]
                for k in range(p * 64, min(len(self.languages), p * 64 + 64)):
                    hits[:, k] += np.bincount(o[((mask >> U(k % 64)) & U(1)).astype(bool)], minlength=n)
        return np.maximum(0, hits - total[:, None] * self.wrong) / np.maximum(1e-9, 1 - self.wrong), total


def _slots(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> U(32)) | U(1)
    with np.errstate(over="ignore"):
        return [((h + U(j) * step) % U(SLOTS)).astype(np.int64) for j in range(HASHES)]


def train(labelled: DataFrame) -> Filters:
    """Filters from labelled(doc_id, text string, lang string): about PER_LANGUAGE documents of each language, by a hash of text and id; the n-grams that SHARE of a language's documents hold, the GRAMS most frequent at most. Rows with null lang or text don't count. The tables that reach the driver have a row for each language, and GRAMS rows a language."""
    rows = labelled.where("lang is not null and text is not null").select("text", "lang", (F.pmod(F.xxhash64("text", "doc_id"), F.lit(1_000_003)) / 1_000_003.0).alias("u"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Filters([], [])
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, PER_LANGUAGE / n))))
    chosen = rows.where(F.col("u") < F.element_at(share, F.col("lang"))).select("text", "lang")
    docs = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    least = F.create_map(*(F.lit(x) for lang, n in docs.items() for x in (lang, SHARE * n)))
    counts = chosen.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= F.element_at(least, F.col("lang")))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    got = counts.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= GRAMS).select("lang", "gram", "n").toArrow().to_pandas()
    languages = sorted(docs)
    grams = []
    for lang in languages:
        own = got[got["lang"] == lang].sort_values(["n", "gram"], ascending=[False, True])["gram"].to_numpy()[:GRAMS]
        grams.append(own.astype(np.int64).view(np.uint64))
    return Filters(languages, grams)


def _predict(batches, filters: Filters):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        low = pa.RecordBatch.from_arrays([batch.column("doc_id"), _lower(texts)], names=["doc_id", "text"])
        done = 0
        for part, raw, off in slices(low):
            n = part.num_rows
            lang, score = ["und"] * n, np.zeros(n)
            if filters.languages:
                hits, total = filters.found(*_grams(raw, off), n)
                best, all_hits = hits.argmax(1), hits.sum(1)
                score = np.where(all_hits > 0, hits.max(1) / np.maximum(all_hits, 1e-9), 1 / len(filters.languages))
                for i, t in enumerate(texts[done : done + n]):
                    if t is not None and any(map(str.isalpha, t)):
                        lang[i] = filters.languages[best[i]]
                    else:
                        score[i] = 0.0
            done += n
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.minimum(1.0, score))], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id long, text string, ...), from the whole text alone.

    Each n-gram's slots are looked up once and ANDed: the bits that remain are the languages that hold it. A language's score is its number of n-grams, less the false positives that its filter's fill makes likely. lang_pred is the language with most, the first by name of equal ones, also where none has any; 'und' (score 0) where the text is null or has no letter, or nothing was learned. score is the winner's share of all languages' n-grams. Repeated rows stay, other columns are ignored, an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _predict(it, model.value), "doc_id long, lang_pred string, score double")
