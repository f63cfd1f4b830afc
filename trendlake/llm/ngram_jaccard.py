"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, U, components, merge_sketch, mix, partitions, shingles, sketch_rows, slices

#: Cells of the frequency sketch (4 MB after rounding) and of the filter of wanted sets (2 MB): fixed, whatever the input.
CELLS, WANTED = 1 << 22, 1 << 21
#: Estimated document frequency from which a shingle surely occurs twice, and rows of a posting list that one task pairs up.
HEAVY, LIST = 20_000, 20_000
#: Marks a set's last posted shingle, in the column of positions.
LAST = 1 << 30


def _prefix(n):
    """Shingles that a set of n posts: a set that shares none of them has a similarity below 0.75."""
    return n - (3 * n + 3) // 4 + 1


def _node(s: np.ndarray) -> int:
    """Identity of a shingle set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0])


def _ranges(s: np.ndarray) -> bytes | None:
    """Set members in each of 128 ranges of hash values; null for sets too large for a byte each."""
    c = np.bincount((s >> U(57)).astype(np.int64), minlength=128)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else None


_PROFILE = ["doc_id", "n", "node", "ranges", "block", "cells"]


def _profile(batches, k):
    """A row for each document, then this task's part of the frequency sketch."""
    cells = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for part, raw, off in slices(batch):
            sets = list(shingles(raw, off, k))
            cells += np.bincount((np.concatenate(sets) >> U(20)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.uint32)
            out = [(doc, len(s), _node(s) if len(s) else None, _ranges(s)) for doc, s in zip(part.column("doc_id").to_pylist(), sets)]
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.binary()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())], names=_PROFILE)
    if rows := list(sketch_rows(cells, lambda x: zlib.compress(x, 1))):
        n = len(rows)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 3, pa.nulls(n, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=_PROFILE)


def _postings(batches, k, rank):
    """(key, node, pos) of each prefix shingle, rarest first. A set seen before in this task is left out."""
    seen: set[int] = set()
    for batch in batches:
        for part, raw, off in slices(batch):
            keys, nodes, pos = [], [], []
            for s in shingles(raw, off, k):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                n = len(s)
                p = _prefix(n)
                key = (rank[(s >> U(20)).astype(np.int64) % CELLS].astype(np.uint64) << U(56)) | (s >> U(8))
                key = np.sort(np.partition(key, p - 1)[:p]) if p < n else np.sort(key)
                keys.append(key)
                nodes.append(np.full(p, node, np.int64))
                at = np.arange(p, dtype=np.int32)
                at[-1] |= LAST
                pos.append(at)
            if keys:
                key = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(pos))], names=["key", "node", "pos"])


def _repeated(batches, heavy):
    """Rows sorted by key and node, each (key, node) once, as far as their key has several nodes or is heavy (live), or they are the last of their set. Holds one row back, so a long list needs no memory."""

    def told(rows, live):
        keep = live | ((rows[2] & LAST) != 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*rows, live)], names=[*names, "live"])

    names, held = ["key", "node", "pos"], None  # the last row, and whether its key has had another node
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        several = np.zeros(batch.num_rows, bool)
        if held:
            rows, several = [np.concatenate(x) for x in zip(held[0], rows)], np.concatenate([held[1], several])
        new = np.ones(len(several), bool)
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        rows, several = [x[new] for x in rows], several[new]
        same = rows[0][1:] == rows[0][:-1]
        several[1:] |= same
        several[:-1] |= same
        several |= rows[0].view(np.uint64) >> U(56) >= U(heavy)
        held = [x[-1:] for x in rows], several[-1:]
        yield told([x[:-1] for x in rows], several[:-1])
    if held:
        yield told(*held)


#: What the filters need to know of a set: members, live shingles among those posted, the last one posted (in signed order), and in the last stage members by range.
_SET = ["node", "n", "alive", "bar"]
#: Earlier live shingles of its set that a row names.
BEFORE = 4
#: Lists of a set, those of its rarest live shingles, in which the first stage pairs it with the next set.
NEAR = 16


_MORE = ["ranges", *(f"p{k}" for k in range(1, BEFORE + 1))]


def _columns(batch, names):
    """Columns as arrays, ranges as a matrix with a first column of 1 where they are known."""
    out = {}
    for k in names:
        x = batch.column(k)
        if k.endswith("ranges"):
            none = bytes(128)
            m = np.frombuffer(b"".join(none if v is None else v for v in x.to_pylist()), np.uint8).reshape(-1, 128)
            out[k] = np.concatenate([np.array(x.is_valid(), np.uint8)[:, None], m], 1)
        else:
            out[k] = x.to_numpy(zero_copy_only=False)
    return out


def _possible(c, a, b):
    """Length, positional, prefix and suffix filters for pairs of sets, at a and b, that share the shingle of these rows. 7 * overlap >= 3 * (n + m) is what similarity 0.75 takes."""
    (na, pa_, la, wa), (nb, pb, lb, wb) = ([c[k][i] for k in ("n", "pos", "alive", "bar")] for i in (a, b))
    need = 3 * (na + nb)
    ok = (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (7 * (1 + np.minimum(na - pa_ - 1, nb - pb - 1) + np.minimum(pa_, pb)) >= need)
    # what the set whose prefix ends first shares of it is in the other's prefix too, so it is live there
    rest = np.where(wa <= wb, na - _prefix(na), nb - _prefix(nb))
    ok &= 7 * (np.minimum(la, lb) + rest) >= need
    # ranges in which the sets differ: overlap <= (na + nb - differ) / 2
    if "ranges" not in c:
        return ok
    left = np.flatnonzero(ok)
    for k in np.array_split(left, len(left) // 20_000 + 1):
        x, y = c["ranges"][a[k]], c["ranges"][b[k]]
        differ = np.abs(x[:, 1:].astype(np.int16) - y[:, 1:]).sum(1, dtype=np.int64)
        ok[k] = ((x[:, 0] & y[:, 0]) == 0) | (7 * (na[k] + nb[k] - differ) >= 2 * need[k])
    # a pair with an earlier shingle in common is found there
    left = np.flatnonzero(ok)
    x, y = ([c[f"p{k}"][i[left]] for k in range(1, BEFORE + 1)] for i in (a, b))
    ok[left] = ~np.any([(u == v) & (u != 0) for u in x for v in y], axis=0)
    return ok


def _pairs(batches, near):
    """Candidate pairs with different labels of each (key, bi, bj) list of rows sorted by list and size; with `near`, for each row only the first that passes. A list has at most about 2 * LIST rows."""

    def emit(c):
        alive = np.arange(len(c["key"]) - 1)
        d, found = 1, []
        while len(alive):
            alive = alive[alive + d < len(c["key"])]
            j = alive + d
            same = (c["key"][alive] == c["key"][j]) & (c["bi"][alive] == c["bi"][j]) & (c["bj"][alive] == c["bj"][j]) & (4 * c["n"][alive] >= 3 * c["n"][j])
            alive, j = alive[same], j[same]
            go = (c["label"][alive] != c["label"][j]) & ((c["bi"][alive] == c["bj"][alive]) | (c["blk"][alive] != c["blk"][j]))
            a, b = alive[go], j[go]
            ok = _possible(c, a, b)
            if ok.any():
                found.append((c["node"][a[ok]], c["node"][b[ok]]))
                if near:
                    alive = np.setdiff1d(alive, a[ok], assume_unique=True)
            d += 1
            if sum(len(x[0]) for x in found) > 500_000:
                yield found
                found = []
        if found:
            yield found

    def batch_of(found):
        a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        p = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    names = ["key", "bi", "bj", "blk", "pos", "label", *_SET, *([] if near else _MORE)]
    rest = None
    for batch in batches:
        c = _columns(batch, names)
        if rest is not None:
            c = {k: np.concatenate([rest[k], c[k]]) for k in names}
        if not len(c["key"]):
            continue
        last = (c["key"] == c["key"][-1]) & (c["bi"] == c["bi"][-1]) & (c["bj"] == c["bj"][-1])
        rest = {k: v[last] for k, v in c.items()}
        for found in emit({k: v[~last] for k, v in c.items()}):
            yield batch_of(found)
    if rest is not None:
        for found in emit(rest):
            yield batch_of(found)


def _sets(batches, k, wanted):
    """(node, members) of the sets that the filter may want, each once a task."""
    seen: set[int] = set()
    for batch in batches:
        for part, raw, off in slices(batch):
            out = {}
            for s in shingles(raw, off, k):
                if len(s):
                    node = _node(s)
                    at = (node & 0xFFFFFFFFFFFFFFFF) % (WANTED * 8)
                    if wanted[at >> 3] >> (at & 7) & 1 and node not in seen:
                        if len(seen) < 200_000:
                            seen.add(node)
                        out[node] = s.tobytes()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["node", "members"])


def _bits(batches):
    bits = np.zeros(WANTED, np.uint8)
    for b in batches:
        at = b.column("node").to_numpy(zero_copy_only=False).view(np.uint64) % U(WANTED * 8)
        np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), (U(1) << (at & U(7))).astype(np.uint8))
    if rows := list(sketch_rows(bits, lambda x: zlib.compress(x, 1))):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "cells"])


def _linked(batches):
    for batch in batches:
        out = []
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            # suffix filter on the halves around the median, then the overlap itself
            h = int(np.searchsorted(x, y[len(y) // 2]))
            most = min(h, len(y) // 2) + min(len(x) - h, len(y) - len(y) // 2)
            if 7 * most < 3 * (len(x) + len(y)):
                continue
            at = np.searchsorted(x, y)
            at[at == len(x)] = len(x) - 1
            if 7 * int((x[at] == y).sum()) >= 3 * (len(x) + len(y)):
                out.append((a, b))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])


def _fits(n, i, la, wa, m, j, lb, wb):
    """_possible() but for its last filters, as an expression over columns' names."""
    n, i, la, wa, m, j, lb, wb = map(F.col, (n, i, la, wa, m, j, lb, wb))
    need = 3 * (n + m)
    rest = F.when(wa <= wb, F.floor((3 * n + 3) / 4)).otherwise(F.floor((3 * m + 3) / 4)) - 1
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * (1 + F.least(n - i - 1, m - j - 1) + F.least(i, j)) >= need) & (7 * (F.least(la, lb) + rest) >= need)


def _verify(scratch: Scratch, docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, from their whole sets. Only sets named by a pair move; text does not."""
    spark = docs.sparkSession
    named = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = spark.sparkContext.broadcast(merge_sketch(named.mapInArrow(_bits, "block int, cells binary"), WANTED, "uint8", "or"))
    sets = docs.select("text").mapInArrow(lambda it: _sets(it, k, wanted.value), "node long, members binary").dropDuplicates(["node"])
    x = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return scratch.keep(pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long"))


def _apart(rows: DataFrame, labels: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a, b) of rows that share a key: without labels, each row with the next that passes; with labels (node, label), all whose labels differ. Lists with one label are never gathered, and long ones are cut into blocks, each pair of which is a task's work."""
    n, near = partitions(rows.sparkSession), labels is None
    label = F.col("node") if near else F.coalesce("label", "node")
    slim = rows.select("key", "node") if near else rows.select("key", "node").join(labels, "node", "left")
    mixed = slim.groupBy("key").agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("key", F.ceil(F.col("c") / LIST).cast("int").alias("nb"))
    cut = rows.join(mixed, "key")
    if not near:
        cut = cut.join(labels, "node", "left").join(ranges, "node")
    cut = cut.withColumn("label", label).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cut = cut.withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o")).select("key", "bi", "bj", "blk", "pos", "label", *_SET, *([] if near else _MORE))
    return cut.repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "n", "node").mapInArrow(lambda it: _pairs(it, near), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id long, text string, ...).

    Two rows link when their sets of k-word shingles have a Jaccard similarity of 0.75 or more; component_id is the smallest doc_id reachable over links. Every shingle gets a rank from a document-frequency sketch of all rows, and each set posts its rarest shingles only, as many as two similar sets cannot both do without. Lists of several sets yield candidates: first every set with its list's smallest (linear in the list), then, among sets that these links leave in different components, all pairs that pass the filters. Pairs inside a component need no check, so groups of near copies never make all their pairs, yet no link between components is lost. Copies count as one set.

    Null, empty and blank texts: n_shingles 0, own component. Repeated rows: one result row each. Other columns of docs are ignored; a null doc_id keeps a row, whose component_id is the smallest non-null one. Sets are told apart by 64-bit hashes. An empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = scratch.keep(docs.mapInArrow(lambda it: _profile(it, k), "doc_id long, n long, node long, ranges binary, block int, cells binary"))
    profiles = made.where("block is null").select("doc_id", "n", "node", "ranges")
    counts = merge_sketch(made.where("block is not null").select("block", "cells"), CELLS, "uint32", "add")
    # one byte a cell: eight steps for each doubling
    rank = np.minimum(255, np.round(8 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)
    ground = float(np.median(counts))
    heavy = min(256, int(np.ceil(8 * np.log2(ground + 8 * np.sqrt(ground) + HEAVY))) + 1)
    ranks = spark.sparkContext.broadcast(rank)
    posted = docs.select("text").mapInArrow(lambda it: _postings(it, k, ranks.value), "key long, node long, pos int")
    # the rows of a heavy key go to many tasks
    salt = F.when(F.shiftrightunsigned("key", 56) >= heavy, F.pmod(F.xxhash64("node"), F.lit(64))).otherwise(0)
    lists = posted.repartition(partitions(spark), "key", salt).sortWithinPartitions("key", "node").mapInArrow(lambda it: _repeated(it, heavy), "key long, node long, pos int, live boolean")
    lists = scratch.keep(lists)
    nodes = profiles.where("node is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("ranges").alias("ranges"))
    posts = lists.groupBy("node").agg(F.count_if("live").alias("alive"), F.max(F.when(F.col("pos").bitwiseAND(LAST) != 0, F.col("key").bitwiseXOR(F.lit(-(1 << 63))))).alias("bar"))
    own = Window.partitionBy("node").orderBy("pos")
    rows = lists.where("live").select("key", "node", F.col("pos").bitwiseAND(LAST - 1).alias("pos")).join(nodes.select("node", "n").join(posts, "node"), "node")
    rows = rows.select("key", "pos", *_SET, F.row_number().over(own).alias("turn"), *(F.coalesce(F.lag("key", k).over(own), F.lit(0)).alias(f"p{k}") for k in range(1, BEFORE + 1)))
    rows = scratch.keep(rows)
    scratch.drop(lists)

    # every set with the smallest of its list, and with the next of about its size in the lists of its rarest shingles
    low = rows.groupBy("key").agg(F.min(F.struct("node", "pos", *_SET[1:])).alias("l"))
    stars = rows.join(low, "key").where("node <> l.node").where(_fits("n", "pos", "alive", "bar", "l.n", "l.pos", "l.alive", "l.bar")).select(F.greatest("node", "l.node").alias("a"), F.least("node", "l.node").alias("b"))
    nexts = _apart(rows.where(F.col("turn") <= NEAR))
    tried = scratch.keep(stars.unionByName(nexts).distinct())
    links = _verify(scratch, docs, tried, k)
    labels = components(scratch, links)

    # all pairs that are still apart; their links join components
    pairs = _apart(rows, labels, nodes.select("node", "ranges")).distinct().join(tried, ["a", "b"], "left_anti")
    more = _verify(scratch, docs, scratch.keep(pairs), k)
    for c in ("a", "b"):
        of = labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
        more = more.join(of, c, "left").withColumn(c, F.coalesce(f"of_{c}", c)).drop(f"of_{c}")
    whole = components(scratch, more).select(F.col("node").alias("label"), F.col("label").alias("top"))

    placed = profiles.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(whole, "label", "left").withColumn("label", F.coalesce("top", "label"))
    first = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("first"))
    return placed.join(first, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
