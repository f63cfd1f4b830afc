"""SentencePiece encoding and decoding by a shared-prefix Viterbi search."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Where the model is, unless told otherwise.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words that a worker keeps coded.
REMEMBERED = 400_000


class Pieces:
    """A model's pieces: ids, scores, byte pieces and kind (unigram or BPE)."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = sp.unk_id()
        self.ids, self.scores, self.bytes, self.text, self.control = {}, {}, {}, {}, set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text[i] = piece
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.control.add(i)
            else:
                self.ids[piece] = i
                self.scores[piece] = sp.get_score(i)
        byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.stands_for = [byte.get(i, b"" if i in self.control else self.text[i].encode()) for i in range(sp.get_piece_size())]
        # the same as arrays, a mark as a space
        spoken = [b.replace(MARK.encode(), b" ") for b in self.stands_for]
        self.width = np.array([len(b) for b in spoken], np.int64)
        self.place = np.cumsum(self.width) - self.width
        self.bytes_of = np.frombuffer(b"".join(spoken), np.uint8)
        self.merges = _is_bpe(model)
        # pieces by their characters from the last on; None holds the piece that ends there
        self.ends: dict = {}
        for piece, i in self.ids.items():
            node = self.ends
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[None] = i
        self.known: dict[int, bool] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE can end a text with `right` when the text before ends with `left` (negative: nothing, or a character without a piece, that no merge reaches over): it makes `right` of its characters, and leaves the border, for merging the characters of both, best score first, gives just the two. A sequence is what BPE makes of its text if and only if this holds all along."""
        if len(self.known) > 3_000_000:
            self.known.clear()
        want = [self.text[right]]
        out = merged(want[0], self.scores) == want
        if out and left >= 0:
            want.insert(0, self.text[left])
            out = merged("".join(want), self.scores) == want
        self.known[left << 20 | right] = out
        return out


def _is_bpe(model: bytes) -> bool:
    """Reads trainer_spec.model_type (2 is BPE) from the serialized model."""

    def fields(data):
        at = 0

        def number():
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(data):
            tag = number()
            if tag & 7 == 2:
                size = number()
                yield tag >> 3, data[at : at + size]
                at += size
            elif tag & 7 == 0:
                yield tag >> 3, number()
            else:
                yield tag >> 3, None
                at += 4 if tag & 7 == 5 else 8

    for name, value in fields(model):
        if name == 2:
            return dict(fields(value)).get(3, 1) == 2
    return False


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Plain BPE of a short text."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = scores.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def marked_words(text: str) -> list[str]:
    """The text, spaces as marks and one in front, cut before each mark that follows another character: no piece has a mark after one, so words are coded on their own. Each word's first mark is left out here."""
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" not in words:
        return words
    # split() leaves '' between neighbouring spaces: such marks lead the next word
    out, lead = [], ""
    for w in words:
        if w:
            out.append(lead + w)
            lead = ""
        else:
            lead += MARK
    return out + [lead[1:]] if lead else out


class Search:
    """Forward states of the prefix in hand: by position, the last piece of the best path that ends there, where it starts, and the path's score. Sorted words visit the trie of all words depth-first, so a word keeps the states of the prefix that it shares with the one before."""

    def __init__(self, pieces: Pieces):
        self.p, self.word = pieces, ""
        self.last, self.start, self.score = [-1], [0], [0.0]
        self.reused = self.made = 0

    def encode(self, word: str) -> list[int]:
        """Ids of the word's pieces; a character without a piece gives minus its code point, less one."""
        last, start, old = self.last, self.start, self.word
        shared, most = 0, min(len(old), len(word))
        while shared < most and old[shared] == word[shared]:
            shared += 1
        del last[shared + 1 :], start[shared + 1 :], self.score[shared + 1 :]
        self.word = word
        self.reused += shared
        self.made += len(word) - shared
        if self.p.merges:
            self._merge_steps(word, shared)
        else:
            for end in range(shared + 1, len(word) + 1):
                self._score_step(word, end)
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at = start[at]
        out.reverse()
        return out

    def _merge_steps(self, word: str, shared: int) -> None:
        """One path alone survives, that which BPE takes: its last piece stays beside the last one of the prefix before it."""
        ends, known, last, start = self.p.ends, self.p.known, self.last, self.start
        for end in range(shared, len(word)):
            node, at = ends, end
            while (node := node.get(word[at])) is not None:
                piece = node.get(None)
                if piece is not None:
                    before = last[at]
                    ok = known.get(before << 20 | piece)
                    if ok is None:
                        ok = self.p.follows(before, piece)
                    if ok:
                        break
                at -= 1
                if at < 0:
                    node = None
                    break
            if node is None:
                piece, at = -2 - ord(word[end]), end
            last.append(piece)
            start.append(at)
        self.score = [0.0] * len(last)

    def _score_step(self, word: str, end: int) -> None:
        """Viterbi's step: the best of all pieces that end here."""
        node, at = self.p.ends, end
        best, piece, start = self.score[end - 1] - 1e6, -2 - ord(word[end - 1]), end - 1
        while at and (node := node.get(word[at - 1])) is not None:
            at -= 1
            i = node.get(None)
            if i is not None and (s := self.score[at] + self.p.scores[self.p.text[i]]) > best:
                best, piece, start = s, i, at
        self.last.append(piece)
        self.start.append(start)
        self.score.append(best)


class Coded:
    """Distinct words coded so far, at most about `most`: each one's number, and where its ids begin in one array of ids."""

    def __init__(self, pieces: Pieces, most: int = REMEMBERED):
        self.p, self.most, self.search = pieces, most, Search(pieces)
        self.number: dict[str, int] = {}
        self.flat, self.off = array("i"), array("q", [0])

    def add(self, words: set[str]) -> None:
        """Codes words, given without the first mark, that are new. A character without a piece gives its bytes' pieces, or the unknown one."""
        p, number, flat, off = self.p, self.number, self.flat, self.off
        if len(number) + len(words) > self.most:
            number.clear()
            del flat[:], off[1:]
        for w in sorted(words - number.keys()):
            ids = self.search.encode(MARK + w)
            if min(ids) < 0:
                ids = [y for x in ids for y in ([x] if x >= 0 else [p.bytes[b] for b in chr(-2 - x).encode()] if p.bytes else [p.unknown])]
            number[w] = len(off) - 1
            flat.extend(ids)
            off.append(len(flat))


def decode_ids(ids, pieces: Pieces) -> str:
    text = b"".join(map(pieces.stands_for.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


_loaded: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Pieces(model)
    return _loaded[model]


def _encoded(batches, model: bytes, check: bool) -> Iterator[pa.RecordBatch]:
    pieces = _pieces(model)
    coded = Coded(pieces)
    for batch in batches:
        rest = [c for c in batch.schema.names if c != "text"]
        for part, raw, at_byte in slices(batch, most=1 << 22):
            docs = [None if t is None else marked_words(t) if t else [] for t in part.column("text").to_pylist()]
            coded.add(set().union(*(d for d in docs if d)))
            flat, off = np.array(coded.flat, np.int32), np.array(coded.off, np.int64)
            at = np.fromiter(map(coded.number.__getitem__, chain.from_iterable(d for d in docs if d)), np.int64)
            size = off[at + 1] - off[at]
            ends = np.cumsum(size)
            ids = flat[np.repeat(off[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate([[0], np.cumsum([len(d or ()) for d in docs])])
            offsets = np.concatenate([[0], ends])[bounds].astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.array([d is None for d in docs] + [False])), pa.array(ids, pa.int32()))
            words = pa.array([None if d is None else len(d) for d in docs], pa.int64())
            more = [pa.array(_same(ids, offsets, raw, at_byte, pieces))] if check else []
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), words, tokens, *more], names=[*rest, "n_words", "tokens", *(["round_trip"] if check else [])])


def _same(ids: np.ndarray, offsets: np.ndarray, raw: np.ndarray, at: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Whether each row's tokens stand for its text."""
    size = pieces.width[ids]
    ends = np.cumsum(size)
    said = pieces.bytes_of[np.repeat(pieces.place[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    cut = np.concatenate([[0], ends])[offsets]
    # one space leads each text that isn't empty
    lead = (np.diff(at) > 0).astype(np.int64)
    fits = np.diff(cut) == np.diff(at) + lead
    same = np.zeros(len(fits), bool)
    for i in np.flatnonzero(fits):
        same[i] = np.array_equal(said[cut[i] + lead[i] : cut[i + 1]], raw[at[i] : at[i + 1]])
    return same


def _model(docs: DataFrame, path: str):
    """The model's bytes, read by Spark, sent to the executors once."""
    spark = docs.sparkSession
    if "://" not in path:
        with open(path, "rb") as f:
            return spark.sparkContext.broadcast(f.read())
    return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def encode(docs: DataFrame, path: str = MODEL, *also: str, check: bool = False) -> DataFrame:
    """(doc_id, also, n_words, tokens array<int>, with `check` also round_trip: whether the tokens, decoded, give the text) for every row of docs(doc_id long, text string, ...), as the model's own encoder gives them: no normalization, a mark in front, bytes where no piece fits.

    The text's marked words are coded once each, in sorted order, for every 4 MB of text or so; words coded before are remembered, up to REMEMBERED of them. For unigram models the search is Viterbi's, by scores. For BPE models its transitions are limited to borders that merging leaves, which leaves one path, the merges' own. Null text: null. Empty text: no tokens. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    model = _model(docs, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *also)
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(lambda it: _encoded(it, model.value, check), f"doc_id long{fields}, n_words long, tokens array<int>{', round_trip boolean' if check else ''}")


def _decoded(batches, model: bytes, column: str):
    pieces = _pieces(model)
    for batch in batches:
        text = [None if t is None else decode_ids(t, pieces) for t in batch.column(column).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "text"])


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows (doc_id, n_words, tokens), with the text that the tokens stand for. Null tokens give null; tokens that aren't a text's bytes give replacement characters."""
    model = _model(rows, path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lambda it: _decoded(it, model.value, "tokens"), f"{fields}, text string")
