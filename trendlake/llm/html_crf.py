"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training_pages import MARK, pages as training_pages

#: Pages to train on, steps and their size, and the weight of the penalty on squared weights.
PAGES, STEPS, RATE, PENALTY = 500, 200, 0.15, 1e-3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|style|aria-label|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements that break a line of text, have no end, hold no text to read, or whose start ends an open one.
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template iframe textarea canvas head title".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
_FENCES = frozenset("ul ol dl table select".split())
_CLOSES_P = _BLOCKS - {"br", "body", "html", "button", "option"}


def _marks(attributes: str) -> tuple[str, ...]:
    """Words in class, id and such attributes."""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "style":
            out += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        elif name == "hidden":
            out.append("hidden")
        else:
            out += [p.lower() for p in _PART.findall(value)][:12]
    return tuple(dict.fromkeys(out))


def blocks(page: str) -> list[tuple[tuple, str, int]]:
    """(path, text, characters in links) of each leaf block: text between two block-level tags, in page order, character references decoded and white space turned into single spaces. A path is the open elements, each (tag, words of its attributes). Scripts, styles and the head are skipped; unclosed and stray tags are put up with."""
    out: list[tuple[tuple, str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((tuple(stack), text, linked))
            parts.clear()
        linked = 0

    def say(raw: str):
        nonlocal linked
        if raw:
            parts.append(raw)
            if links:
                linked += len(raw.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in _BLOCKS or any(t in _BLOCKS for t, _ in stack[k:]):
                        flush()
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in ("table", "td", "article", "body") and tag not in _BLOCKS:
                    break
            continue
        if tag in _SILENT:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                body = re.compile(r"<body\b", re.I).search(page, at) if tag == "head" else None
                # an unclosed head ends where the body starts
                at = body.start() if body and (not end or body.start() < end.start()) else end.end() if end else n
            continue
        if tag in _BLOCKS:
            flush()
            if tag in _CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        links -= sum(t == "a" for t, _ in stack[k:])
                        # formatting left open in a paragraph does not frame what follows
                        del stack[k:]
                        break
                    if stack[k][0] in _BLOCKS:
                        break
            for k in range(len(stack) - 1, -1, -1) if tag in _ENDS else ():
                if stack[k][0] in _FENCES:
                    break
                if stack[k][0] in _ENDS[tag]:
                    links -= sum(t == "a" for t, _ in stack[k:])
                    del stack[k:]
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        if tag == "a":
            if any(t == "a" for t, _ in stack):
                k = max(i for i, (t, _) in enumerate(stack) if t == "a")
                if not any(t in _BLOCKS for t, _ in stack[k:]):
                    del stack[k:]
                    links -= 1
            links += 1
        stack.append((tag, _marks(m[3]) if m[3] else ()))
    flush()
    return out


def path_features(path: tuple) -> list[str]:
    out = []
    for tag, marks in path:
        if tag in _BLOCKS and tag not in ("html", "body", "br"):
            out.append("in:" + tag)
        out += ["mark:" + m for m in marks]
    last = next((t for t, _ in reversed(path) if t in _BLOCKS), "none")
    depth = sum(t in _BLOCKS for t, _ in path)
    return [*dict.fromkeys(out), "last:" + last, f"depth:{min(depth, 8)}"]


_STOP = re.compile(r"[.!?…。]")


def text_features(text: str, linked: int, place: float) -> list[str]:
    size = len(text)
    words = text.count(" ") + 1
    share = min(1.0, linked / size)
    long = "0" if size < 15 else "1" if size < 40 else "2" if size < 80 else "3" if size < 160 else "4" if size < 400 else "5"
    link = "0" if share == 0 else "1" if share < 0.34 else "2" if share < 0.8 else "3"
    out = ["one", "size:" + long, "links:" + link, "size,links:" + long + link, f"words:{min(words, 5)}", f"place:{int(place * 5)}"]
    stops = len(_STOP.findall(text))
    out.append("stops:" + ("0" if not stops else "1" if stops == 1 else "2"))
    if text[-1] in ".!?…:。\"”»":
        out.append("ends")
    if "©" in text or "(c)" in text.lower() or "copyright" in text.lower():
        out.append("rights")
    if "," in text:
        out.append("comma")
    if sum(c.isdigit() for c in text[:200]) * 4 > min(size, 200):
        out.append("digits")
    if text.isupper():
        out.append("upper")
    if "·" in text or "|" in text or "»" in text or "›" in text:
        out.append("bars")
    return out


@dataclass
class Field:
    """Weights of the features for main text over other text, and of neighbouring labels, by whether the blocks share their parent."""

    weights: dict[str, float]
    steps: np.ndarray
    _paths: dict = field(default_factory=dict)

    def emission(self, path, text, linked, place) -> float:
        known = self._paths.get(path)
        if known is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            known = self._paths[path] = sum(self.weights.get(f, 0.0) for f in path_features(path))
        return known + sum(self.weights.get(f, 0.0) for f in text_features(text, linked, place))

    def decode(self, found: list) -> list[bool]:
        """Viterbi's best labels."""
        n, back = len(found), []
        other = main = 0.0
        before = None
        s = self.steps.tolist()
        for k, (path, text, linked) in enumerate(found):
            e = self.emission(path, text, linked, k / n)
            if k:
                t = s[path[:-1] == before]
                a, b, c, d = other + t[0][0], main + t[1][0], other + t[0][1], main + t[1][1]
                back.append((b > a, d > c))
                other, main = max(a, b), max(c, d) + e
            else:
                main = e
            before = path[:-1]
        label, out = main > other, []
        for choice in reversed(back):
            out.append(label)
            label = choice[label]
        out.append(label)
        return out[::-1] if n else []


@lru_cache(maxsize=4)
def train(pages: int = PAGES, steps: int = STEPS, seed: int = 7) -> Field:
    """The field of highest penalised likelihood of `pages` generated, labelled pages, by gradient ascent with Adam; forward and backward sums go over all pages at once. Needs no data; the same at every call."""
    names: dict[str, int] = {}
    rows, cols, labels, same, lengths = [], [], [], [], []
    n = 0
    for page in training_pages(pages, seed):
        found = blocks(page)
        lengths.append(len(found))
        before = None
        for k, (path, text, linked) in enumerate(found):
            labels.append(MARK in text)
            text = text.replace(MARK, "") or "x"
            for f in path_features(path) + text_features(text, linked, k / len(found)):
                rows.append(n)
                cols.append(names.setdefault(f, len(names)))
            same.append(path[:-1] == before)
            before = path[:-1]
            n += 1
    rows, cols, y, same, lengths = np.array(rows), np.array(cols), np.array(labels, int), np.array(same, int), np.array(lengths)
    p, longest = len(lengths), lengths.max()
    at = np.full((p, longest), n)  # block of each page and place; n where there is none
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for k in range(longest):
        at[:, k] = np.where(k < lengths, start + k, n)
    there = at < n
    step_of = np.append(same, 0)[at]
    y_at = np.append(y, 0)[at]
    w, t = np.zeros(len(names)), np.zeros((2, 2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    seen_t = np.zeros_like(t)
    for k in range(1, longest):
        ok = there[:, k]
        np.add.at(seen_t, (step_of[ok, k], y_at[ok, k - 1], y_at[ok, k]), 1)
    for i in range(1, steps + 1):
        e = np.append(np.bincount(rows, w[cols], n), 0)[at]
        e = np.stack([np.zeros_like(e), e], 2)  # pages, places, labels
        a = np.zeros((p, longest, 2))
        b = np.zeros((p, longest, 2))
        a[:, 0] = e[:, 0]
        for k in range(1, longest):
            x = a[:, k - 1, :, None] + t[step_of[:, k]]
            a[:, k] = np.where(there[:, k, None], np.logaddexp(x[:, 0], x[:, 1]) + e[:, k], a[:, k - 1])
        total = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        expect_t = np.zeros_like(t)
        for k in range(longest - 1, 0, -1):
            x = t[step_of[:, k]] + (e[:, k] + b[:, k])[:, None, :]
            b[:, k - 1] = np.where(there[:, k, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), b[:, k])
            ok = there[:, k]
            both = np.exp(a[ok, k - 1, :, None] + x[ok] - total[ok, None, None])
            np.add.at(expect_t, step_of[ok, k], both)
        main = np.exp(a[..., 1] + b[..., 1] - total[:, None])[there]
        order = at[there]
        diff = np.zeros(n)
        diff[order] = y[order] - main
        for j, (g, x) in enumerate(((np.bincount(cols, diff[rows], len(names)) / p - PENALTY * w, w), ((seen_t - expect_t) / p - PENALTY * t, t))):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            x += RATE * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.99**i)) + 1e-8) * min(1.0, 2 * (1 - i / (steps + 1)))
    return Field({f: float(w[k]) for f, k in names.items()}, t)


def main_text(page: str | None, model: Field) -> str:
    """The blocks labelled main text, joined by spaces."""
    found = blocks(page) if page else []
    return " ".join(text for (_, text, _), main in zip(found, model.decode(found)) if main) if found else ""


def _extracted(batches, model: Field):
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            text = [main_text(h, model) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id long, url string, html string, ...): the main text of the whole page.

    Null, empty and text-free html: '' and 0. Html without tags is one block, and kept if it reads like text. Repeated rows stay; other columns are ignored; an empty table gives no rows. A page is parsed in one go, in memory of a few times its size.
    """
    held = pages.sparkSession.sparkContext.broadcast(model or train())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda it: _extracted(it, held.value), "page_id long, url string, text string, n_chars long")
