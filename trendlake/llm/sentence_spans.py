"""Substring dedup by sliding sentence spans."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _STEP, U, mix, partitions, powers, slices, word_spans

#: Sentences and words that a span has at least; words of a sentence beyond which it counts as several; words to either side that decide where it is cut; pieces longer than LONG times MOST are cut by count.
SENTENCES, WORDS, MOST, SIDE, LONG = 2, 25, 16, 3, 4
_STEP_INVERSE = pow(int(_STEP), -1, 1 << 64)
#: UTF-8 forms of marks that end a sentence, and of those that may follow them.
_STOPS = [x.encode() for x in ".!?\u2026\u3002\uff01\uff1f\uff0e\u061f\u06d4\u0964\u0589"]
_CLOSERS = [x.encode() for x in "\"')]}\u00bb\u2019\u201d\u300d\u300f\uff09"]


def _inverse_powers(n: int, cache=[np.ones(1, np.uint64)]) -> np.ndarray:
    if len(cache[0]) < n:
        with np.errstate(over="ignore"):
            cache[0] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(2 * n, _STEP_INVERSE, np.uint64))])
    return cache[0]


def _ends_in(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Bytes of the one of `marks` that each word ends in, 0 where there is none."""
    out = np.zeros(len(ends), np.int64)
    for mark in marks:
        n = len(mark)
        hit = ends - starts >= n
        for k in range(n):
            hit &= raw[np.maximum(ends - n + k, 0)] == mark[k]
        out[hit] = n
    return out


def _chosen(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words whose hash, with that of the word before, is the least among SIDE words to either side (the first of equal ones). It depends on these words alone, so a passage is cut alike wherever it stands."""
    with np.errstate(over="ignore"):
        g = mix(h + np.append(U(0), h[:-1] * _STEP) * np.append(False, row[1:] == row[:-1]).astype(np.uint64))
    out = np.ones(len(h), bool)
    for d in range(1, min(SIDE, len(h) - 1) + 1):
        same = row[d:] == row[:-d]
        out[d:] &= ~same | (g[d:] < g[:-d])
        out[:-d] &= ~same | (g[:-d] <= g[d:])
    return out


def sentences(raw: np.ndarray, off: np.ndarray):
    """(hash of each word, first word of each sentence, row of each sentence, first byte of each sentence).

    A sentence starts a row, follows a line break or a word that ends in a full stop, exclamation or question mark of any script (and closing quotes or brackets). One of more than MOST words counts as several, cut at words that _chosen() finds; what is still longer than LONG * MOST words is cut by count. Ideographs and kana count as words.
    """
    wide = np.flatnonzero((raw >= 0xE3) & (raw <= 0xE9))
    # no character takes more than three bytes there; a mark that follows an ideograph is its own word
    h, row, starts, ends = word_spans(raw, off, np.concatenate([wide, np.minimum(wide + 3, len(raw))]) if len(wide) else None)
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    tail = ends.copy()
    for _ in range(2):
        tail -= _ends_in(raw, starts, tail, _CLOSERS)
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (_ends_in(raw, starts, tail, _STOPS)[:-1] > 0) | (lines[starts[1:]] > lines[ends[:-1]])
    for most, also in ((MOST, _chosen(h, row)), (LONG * MOST, None)):
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        if (size > most).any():
            at = np.repeat(size > most, size)
            new |= at & (also if also is not None else (np.arange(len(h)) - np.repeat(first, size)) % MOST == 0)
    first = np.flatnonzero(new)
    return h, first, row[first], starts[first]


def _spans(h, first, row, words: int, least: int):
    """(start, end, hash) of each span, in sentences: from each sentence on, and up to each sentence."""
    n = len(first)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.append(first, len(h))
    begin = np.searchsorted(row, row, "left")
    stop = np.searchsorted(row, row, "right")
    i = np.arange(n)
    e = np.maximum(i + least, np.searchsorted(at, at[:-1] + words))
    ahead = np.stack([i, e])[:, e <= stop]
    s = np.minimum(i + 1 - least, np.searchsorted(at, at[1:] - words, "right") - 1)
    back = np.stack([s, i + 1])[:, s >= begin]
    s, e = np.unique(np.concatenate([ahead, back], 1), axis=1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h))[: len(h)], dtype=np.uint64)])
        value = mix((total[at[e]] - total[at[s]]) * _inverse_powers(len(h) + 1)[at[s]] + (at[e] - at[s]).astype(np.uint64))
    return s, e, value


_NAMES = ["span", "doc_id", "sha", "s", "e", "later"]
_SCHEMA = "span long, doc_id long, sha long, s int, e int, later boolean"


def _sha(raw: bytes) -> int:
    """60 bits of the text's SHA-256, which tell rows of one doc_id (or none) apart."""
    return int(hashlib.sha256(raw).hexdigest()[:15], 16)


def _emit(batches, words, least):
    """All spans of a batch. Of equal ones, all but the batch's first are marked: they are surely not the first of all, need no comparison, and go to any task."""
    for batch in batches:
        parts = []
        for part, raw, off in slices(batch):
            h, first, row, _ = sentences(raw, off)
            s, e, value = _spans(h, first, row, words, least)
            doc = np.array([-(1 << 63) if d is None else d for d in part.column("doc_id").to_pylist()], np.int64)
            sha = np.array([_sha(raw[off[k] : off[k + 1]].tobytes()) for k in range(part.num_rows)], np.int64)
            if not len(s):
                continue
            r = row[s]
            base = np.searchsorted(row, r, "left")
            parts.append((value, doc[r], sha[r], (s - base).astype(np.int32), (e - base).astype(np.int32)))
        if not parts:
            continue
        value, doc, sha, s, e = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((e, s, sha, doc, value))
        value, doc, sha, s, e = (x[order] for x in (value, doc, sha, s, e))
        later = np.zeros(len(value), bool)
        later[1:] = value[1:] == value[:-1]
        again = later.copy()
        again[1:] &= (doc[1:] == doc[:-1]) & (sha[1:] == sha[:-1]) & (s[1:] == s[:-1]) & (e[1:] == e[:-1])  # the same row once more
        value[later] = mix(value[later] + np.flatnonzero(later).astype(np.uint64))
        keep = ~again
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (value.view(np.int64), doc, sha, s, e, later)], names=_NAMES)


def _not_first(batches):
    """Of rows sorted by span and place, those that differ from the first of their span, and the marked ones. Holds that first row across batches: rows equal to it are one document that is there several times, wherever batches end."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        *place, later = (batch.column(c).to_numpy(zero_copy_only=False) for c in _NAMES)
        plain = np.flatnonzero(~later)
        repeat = later.copy()
        if len(plain):
            keys = [x[plain] if held is None else np.append(held[k], x[plain]) for k, x in enumerate(place)]
            new = np.append(True, keys[0][1:] != keys[0][:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            other = np.any([x != x[first] for x in keys[1:]], axis=0)
            repeat[plain] = other[len(other) - len(plain) :]
            held = [x[first[-1]] for x in keys]
        if repeat.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[repeat]) for x in place[1:]], names=_NAMES[1:5])


def _union(batches):
    """Joins overlapping ranges of sorted rows, for one (doc_id, sha) after the other."""
    held, out = None, []
    for batch in batches:
        for d, c, s, e in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "sha", "s", "e"))):
            if held and held[:2] == [d, c] and s <= held[3]:
                held[3] = max(held[3], e)
                continue
            if held:
                out.append(held)
            held = [d, c, s, e]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "sha", "s", "e"])
            out = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held[k]], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "sha", "s", "e"])


def _rest(batches, schema):
    """Texts without the sentences in `cut`, a list of alternating starts and ends."""
    for batch in batches:
        texts, total, gone = [], [], []
        for part, raw, off in slices(batch):
            _, first, row, at = sentences(raw, off)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            for k, (text, cut) in enumerate(zip(part.column("text").to_pylist(), part.column("cut").to_pylist())):
                n = int(bounds[k + 1] - bounds[k])
                total.append(n)
                if not cut:
                    texts.append(text)
                    gone.append(0)
                    continue
                places = np.append(at[bounds[k] : bounds[k + 1]], off[k + 1])
                data, kept, last = raw[off[k] : off[k + 1]].tobytes(), [], 0
                for s, e in sorted((c["s"], c["e"]) for c in cut):
                    kept.append(data[last : places[s] - off[k]])
                    last = int(places[e] - off[k])
                kept.append(data[last:])
                texts.append(b"".join(kept).decode())
                gone.append(sum(c["e"] - c["s"] for c in cut))
        cols = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "cut", "sha")}
        cols |= {"text": pa.array(texts, pa.string()), "n_sentences": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
        yield pa.RecordBatch.from_arrays([cols[c] for c in schema], names=schema)


def remove_repeats(docs: DataFrame, words: int = WORDS, least: int = SENTENCES) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) for every row of docs(doc_id long, text string, ...).

    Of all runs of `least` or more consecutive sentences with `words` words or more that have the same words (A-Z lower-cased, white space apart), the one with the smallest doc_id, then place, stays; sentences covered by any other one go, with the white space after them, so a text repeated as a whole leaves nothing. It is enough to hash the shortest such run from each sentence on and up to each sentence: every longer run is a union of these, and where it is repeated, so are they, in the same documents. words=1 takes runs of any words. What a batch repeats within itself is settled there, and only the first goes to the shuffle: a passage in a third of all rows sends a row for each batch. After that, sorted rows stream by, one held back.

    Null text: stays null, no sentences. Empty or blank text: as it is. A null doc_id counts as the smallest. Rows equal in doc_id and text count as one document (each keeps the first's sentences); rows with equal doc_id and other text are told apart by 60 bits of the text's SHA-256. n_sentences and n_removed count an over-long sentence as several, see sentences(). Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = docs.mapInArrow(lambda it: _emit(it, words, least), _SCHEMA)
    n = partitions(spark)
    later = spans.repartition(n, "span").sortWithinPartitions("span", "doc_id", "sha", "s", "e").mapInArrow(_not_first, "doc_id long, sha long, s int, e int")
    ranges = later.repartition(n, "doc_id", "sha").sortWithinPartitions("doc_id", "sha", "s").mapInArrow(_union, "doc_id long, sha long, s int, e int")
    cuts = ranges.groupBy(F.col("doc_id").alias("d"), F.col("sha").alias("c")).agg(F.collect_list(F.struct("s", "e")).alias("cut"))
    keyed = docs.withColumn("sha", F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("long"))
    at = (F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")) == F.col("d")) & (F.col("sha") == F.col("c"))
    names = ["doc_id", "text", "n_sentences", "n_removed"]
    return keyed.join(cuts, at, "left").select("doc_id", "text", "cut").mapInArrow(lambda it: _rest(it, names), "doc_id long, text string, n_sentences long, n_removed long")
