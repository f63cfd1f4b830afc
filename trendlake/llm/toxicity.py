"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

#: The kernel: subsequences of three symbols that span WIDTH symbols at most, each weighing DECAY to the power of its span less one.
WIDTH, DECAY = 6, 0.5
#: Labelled documents of either class that training reads (about, chosen by hash), windows that start it, landmarks, and rounds.
PER_CLASS, WINDOWS, LANDMARKS, ROUNDS = 3_000, 6_000, 192, 3
#: How far, in standard deviations, a word's share of toxic documents exceeds chance to start training.
SURE = 4.2
#: Windows shorter than this many letters have no score; best windows of a document that its probability depends on.
LETTERS, TOP = 3, 3

_SYMBOLS = 29  # 1-26 letters, 27 and 28 either end of a window
_PATTERNS = [(j, k) for k in range(2, WIDTH) for j in range(1, k)]
_CODES = _SYMBOLS**3


def _tables() -> tuple[bytes, bytes]:
    """Which letter each byte of UTF-8 counts as, and the bytes that don't count. The second byte of an accented Latin letter counts as its plain letter, that of other scripts as some letter; digits in place of letters as those."""
    to = bytearray(range(256))
    for b in range(65, 91):
        to[b] = b + 32
    for digit, letter in zip(b"013457", b"oieast"):
        to[digit] = letter
    for b in range(0x80, 0xC0):
        to[b] = 97 + (b & 31) % 26
    for low, letters in ((0x80, b"aaaaaaaceeeeiiii"), (0x91, b"nooooo"), (0x99, b"uuuuy"), (0x9F, b"saaaaaaaceeeeiiii"), (0xB1, b"nooooo"), (0xB9, b"uuuuy")):
        to[low : low + len(letters)] = letters
    kept = {*range(97, 123), *range(65, 91), *b"013457", *range(0x80, 0xC0), *b" \t\n\x0b\f\r"}
    return bytes(to), bytes(b for b in range(256) if b not in kept)


_TO, _DROP = _tables()


def letters(raw: bytes) -> bytes:
    """Text as words of plain letters: characters inserted into a word, and marks around it, are gone."""
    return raw.translate(_TO, _DROP)


def windows(text: str) -> list[bytes]:
    """The words of a text, as plain letters; single letters in a row are one word."""
    out: list[bytes] = []
    run = False
    for w in letters(text.encode()).split():
        if len(w) == 1 and run:
            out[-1] += w
        else:
            out.append(w)
        run = len(w) == 1
    return [w for w in out if len(w) >= LETTERS]


def _norms(n: int) -> np.ndarray:
    """Length of the feature vector of a window of each number of symbols, as if no subsequence came twice."""
    size = np.arange(n + 1)
    return np.sqrt(np.maximum(1e-9, sum(DECAY ** (2 * k) * np.maximum(0, size - k) for _, k in _PATTERNS)))


def _features(word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of a window's subsequences."""
    s = np.concatenate([[27], np.frombuffer(word, np.uint8).astype(np.int64) - 96, [28]])
    codes = [s[:-k] * _SYMBOLS**2 + s[j : len(s) - k + j] * _SYMBOLS + s[k:] for j, k in _PATTERNS if len(s) > k]
    weights = [np.full(len(s) - k, DECAY**k) for _, k in _PATTERNS if len(s) > k]
    return np.concatenate(codes), np.concatenate(weights) / _norms(len(s))[len(s)]


@dataclass
class Model:
    """score(window) = table . features + bias; probability(document) = logistic(curve . evidence(document))."""

    table: np.ndarray
    bias: float
    curve: np.ndarray | None = None

    def best(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Score of the best window of each row, -4 where there is none."""
        return self.top(raw, off)[0][:, 0]

    def top(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the TOP best windows of each row, -4 where there are fewer, and the number of its windows."""
        parts = [letters(raw[off[i] : off[i + 1]].tobytes()) for i in range(len(off) - 1)]
        size = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        out, many = np.full((len(parts), TOP), -4.0), np.zeros(len(parts), np.int64)
        solid = data > 32
        if not solid.any():
            return out, many
        row = np.repeat(np.arange(len(parts)), size)
        start = solid.copy()
        start[1:] &= ~solid[:-1] | (row[1:] != row[:-1])
        at = np.flatnonzero(start)
        length = np.diff(np.append(np.cumsum(start)[solid].searchsorted(np.arange(1, len(at) + 1)), solid.sum()))
        # single letters in a row are one window
        alone = length == 1
        joined = np.zeros(len(at), bool)
        joined[1:] = alone[1:] & alone[:-1] & (row[at[1:]] == row[at[:-1]])
        head = np.flatnonzero(~joined)
        n = np.add.reduceat(length, head)
        total = n + 2
        first = np.concatenate([[0], np.cumsum(total)[:-1]])
        s = np.zeros(int(total.sum()), np.int32)
        body = np.ones(len(s), bool)
        body[first], body[first + total - 1] = False, False
        s[first], s[first + total - 1] = 27, 28
        s[body] = data[solid].astype(np.int32) - 96
        window = np.repeat(np.arange(len(head), dtype=np.int32), total)
        value = np.zeros(len(s), np.float32)
        for k in range(2, WIDTH):
            if len(s) <= k:
                break
            ends = s[:-k] * np.int32(_SYMBOLS**2) + s[k:]
            part = np.zeros(len(ends), np.float32)
            for j in range(1, k):
                part += self.table[ends + s[j : len(s) - k + j] * np.int32(_SYMBOLS)]
            part[window[:-k] != window[k:]] = 0
            value[:-k] += part * np.float32(DECAY**k)
        score = np.add.reduceat(value, first) / _norms(int(total.max()))[total] + self.bias
        real = n >= LETTERS
        score, owner = score[real], row[at[head]][real]
        many = np.bincount(owner, minlength=len(parts))
        order = np.lexsort((-score, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        first = order[place < TOP]
        out[owner[first], place[place < TOP]] = score[first]
        return out, many

    def probability(self, top: np.ndarray, many: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(top, many) @ self.curve, -40, 40)))


def evidence(top: np.ndarray, many: np.ndarray) -> np.ndarray:
    """What a document's probability is a function of: its best windows' scores, as far as they tell, and how many windows these are the best of."""
    return np.concatenate([np.clip(top, -2, 3), np.log1p(many)[:, None], np.ones((len(top), 1))], 1)


def _dense(words: list[bytes]) -> np.ndarray:
    out = np.zeros((len(words), _CODES), np.float32)
    for r, w in enumerate(words):
        np.add.at(out[r], *_features(w))
    return out


def _spread(words: list[bytes], n: int) -> list[bytes]:
    """n of the words, each in turn the farthest from those before in the kernel's metric."""
    x = _dense(words[:400])
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        if far.max() < 1e-6:
            break
        chosen.append(int(far.argmax()))
    return [words[i] for i in chosen]


def fit(bad: dict[bytes, float], good: dict[bytes, float], hard: dict[bytes, float], c: float = 200.0) -> Model:
    """The SVM (squared hinge, classes of equal weight in all) from weighted windows of either class, among the good those that are hard to tell. Landmarks come from either class, half of the good ones from the hard."""
    top = lambda d: sorted(d, key=lambda w: (-d[w], w))
    marks = _spread(top(bad), LANDMARKS // 2) + _spread(top(hard)[:200] + top(good)[:200], LANDMARKS // 2)
    good = {w: v for w, v in (good | hard).items() if w not in bad}
    phi = _dense(marks)
    value, vector = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = value > 1e-6 * value.max()
    project = (phi.T @ (vector[:, keep] / np.sqrt(value[keep]))).astype(np.float64)  # codes x rank
    words = list(bad) + list(good)
    x = np.zeros((len(words), project.shape[1] + 1))
    for r, w in enumerate(words):
        codes, weights = _features(w)
        x[r, :-1] = weights @ project[codes]
    x[:, -1] = 1
    y = np.array([1.0] * len(bad) + [-1.0] * len(good))
    weight = np.sqrt(np.array([*bad.values(), *(min(v, 4.0) if w not in hard else v for w, v in good.items())]))
    weight[y > 0] /= weight[y > 0].sum()
    weight[y < 0] /= weight[y < 0].sum()
    weight *= c * 100
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):  # Newton steps on the active rows
        on = y * (x @ w) < 1
        a = x[on] * weight[on][:, None]
        new = np.linalg.solve(ridge + 2 * x[on].T @ a, 2 * a.T @ y[on])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return Model((project @ w[:-1]).astype(np.float32), float(w[-1]))


def _logistic(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Coefficients of the logistic curve from evidence to labels, with smoothed targets and equal class weights."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    goal = np.where(toxic == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(x)
    small = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6]) * len(x) * 0.01
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + small, x.T @ (weight * (p - goal)) + small @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def _parts(batches):
    for batch in batches:
        rows = [(x.strip(), toxic) for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()) for x in _SENTENCE.findall(text)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["sentence", "toxic"])


def _words(batches):
    """(window, sentences of either class) of each batch."""
    for batch in batches:
        count: dict[bytes, list[int]] = {}
        for text, toxic in zip(batch.column("sentence").to_pylist(), batch.column("toxic").to_pylist()):
            for w in set(windows(text)):
                count.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array([v[1] for v in count.values()], pa.int64()), pa.array([v[0] for v in count.values()], pa.int64())], names=["w", "bad", "good"])


def _sentences(batches, model: Model, most: int = 5):
    """Of each document, best window and score of its best sentences. A batch's distinct windows are scored at once."""
    for batch in batches:
        docs = [[windows(x) for x in _SENTENCE.findall(t)] for t in batch.column("text").to_pylist()]
        words = sorted({w for d in docs for x in d for w in x})
        off = np.cumsum([0] + [len(w) for w in words])
        score = dict(zip(words, model.best(np.frombuffer(b"".join(words), np.uint8), off).tolist()))
        rows = []
        for d, toxic in zip(docs, batch.column("toxic").to_pylist()):
            best = {max(x, key=lambda w: (score[w], w)) for x in d if x}
            top = sorted(best, key=lambda w: (-score[w], w))[:most]
            rows += [(toxic, n, w.decode(), score[w]) for n, w in enumerate(top)] or [(toxic, 0, "", -4.0)]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["toxic", "place", "w", "score"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from docs(doc_id, text string) and labels(doc_id, toxic 0/1): about PER_CLASS labelled documents of either class, by a hash of the id. Only these few labels meet the documents, in a broadcast of that bounded size, so texts are read once and not shuffled. Rows with null text, id or label don't count; None unless both classes are there.

    Labels are those of documents, and training labels their sentences: all of a clean document are clean, and of a toxic one the best is toxic if it scores above 0, and others above 0.5. A sentence's score is that of its best window (a word). The first model learns from the words that distinct sentences of toxic documents hold oftener than chance allows; each round then takes the sentences as the last model ranks them, and those words. Only WINDOWS words of either class and five sentences a document reach the driver.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0).alias("u"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    some = labels.where(F.col("u") < F.when(F.col("toxic") == 1, min(1.0, PER_CLASS / sizes[1])).otherwise(min(1.0, PER_CLASS / sizes[0]))).select("doc_id", "toxic")
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.keep(rows.repartition(max(1, min(12, sum(sizes.values()) // 100))))
    # each sentence once: near copies would make a text's words look like many documents'
    sentences = scratch.keep(rows.mapInArrow(_parts, "sentence string, toxic int").groupBy("sentence").agg(F.min("toxic").alias("toxic")))
    n = {r["toxic"]: r["count"] for r in sentences.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    words = sentences.mapInArrow(_words, "w string, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    both = F.col("bad") + F.col("good")
    words = words.withColumn("z", (F.col("bad") - both * share) / F.sqrt(both * share * (1 - share) + 0.5))
    words = scratch.keep(words)
    first = words.where("bad > 1 and z > 2").orderBy(F.desc("z"), "w").limit(WINDOWS).collect()
    clean = words.where("good > 0 and z < 1").orderBy(F.desc("good"), "w").limit(WINDOWS // 2).collect() + words.where("good > 0 and z < 1").orderBy(F.xxhash64("w")).limit(WINDOWS // 2).collect()
    if not first or not clean:
        return None
    top = first[0]["z"]
    bad = {r["w"].encode(): float(r["z"]) for r in first if r["z"] >= min(top, max(SURE, 0.15 * top))}
    good = {r["w"].encode(): float(r["good"]) for r in clean}
    extra: dict[bytes, float] = {}
    # common words may pass for toxic by chance: those that clean sentences hold often don't stay
    rare = {r["w"].encode() for r in first if 4 * r["good"] <= r["bad"]}
    start, model = [w for w in bad if w in rare], fit(bad, good, {})
    for _ in range(ROUNDS):
        got = rows.mapInArrow(lambda it, m=model: _sentences(it, m), "toxic int, place int, w string, score double").collect()
        clear = {r["w"].encode() for r in got if not r["toxic"] and r["w"]}
        # words that chance doesn't explain stay examples, whatever the last model makes of them
        bad = dict.fromkeys(start, 1.0)
        for r in got:
            w = r["w"].encode()
            if r["toxic"] and w and r["score"] > (0.5 if r["place"] else 0.0) and w not in clear:
                bad[w] = bad.get(w, 0.0) + 1
            elif not r["toxic"] and w:
                extra[w] = extra.get(w, 0.0) + 10
        if not bad:
            break
        model = fit(bad, good, extra)
    got = rows.mapInArrow(lambda it, m=model: _evidence(it, m), "toxic int, top array<double>, many long").collect()
    model.curve = _logistic(evidence(np.array([r["top"] for r in got]), np.array([r["many"] for r in got])), np.array([r["toxic"] for r in got]))
    return model


def _evidence(batches, model):
    for batch in batches:
        for part, raw, off in slices(batch):
            top, many = model.top(raw, off)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(top.tolist(), pa.list_(pa.float64())), pa.array(many)], names=["toxic", "top", "many"])


def _scored(batches, model):
    for batch in batches:
        for part, raw, off in slices(batch):
            p = model.probability(*model.top(raw, off)) if model else np.full(part.num_rows, 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names), pa.array(p)], names=[*part.schema.names, "score"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score double) for every row of docs(doc_id, text, ...): how likely its whole text is toxic, by its TOP best windows and their number. Null, empty and blank texts have no window and get the lowest score; so does every row without a model. Repeated rows stay, other columns are ignored, an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: (b.select(["doc_id", "score"]) for b in _scored(it, held.value)), "doc_id long, score double")


def scored_rows(docs: DataFrame, model: Model | None, name: str = "toxicity") -> DataFrame:
    """The rows of docs with all their columns and their score in a column `name`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(lambda it: (b.rename_columns([*b.schema.names[:-1], name]) for b in _scored(it, held.value)), ", ".join([*fields, f"`{name}` double"]))
