"""Embedding near-dedup: an exact metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, partitions

#: Rows of a block, two of which a task compares; vectors of a label that choose its pivots; vectors tried for each pivot; most pivots, rings of a cell by distance, and tasks that a label's vectors are dealt to.
TILE, SAMPLE, TRIED, PIVOTS, RINGS, SALTS = 2048, 1024, 24, 32, 8, 64
#: A label of fewer vectors is one cell. What moving a vector costs, in comparisons; copies a vector that boundaries may make, by the sample; and the part of a cell's comparisons that a pivot has to save.
LEAST_ROWS, COPY, COPIES, SAVES = 32, 64, 2.0, 0.02


def _unit(batches, names):
    """Directions in double precision; null where a vector is null, zero, or has null or non-finite parts."""
    for batch in batches:
        out = []
        for v in batch.column("v").to_pylist():
            x = None
            if v and all(p is not None for p in v):
                x = np.array(v, np.float64)
                top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                x = x / top / np.linalg.norm(x / top) if top > 0 else None
            out.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], names=names)


def _matrix(column) -> np.ndarray:
    raw = [np.frombuffer(x, np.float64) for x in column]
    return np.stack(raw) if raw else np.zeros((0, 0))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))


def _plan(x: np.ndarray, n: int, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots, radii, and edges of rings by distance from each pivot, for a label of n vectors with the sample x.

    One ball after the other is taken out of what is left: of TRIED pivots and some radii, the one that saves most. With a inside, g outside but within r of the ball, and b outside, it takes a (a / 2 + g) + b b / 2 comparisons in place of (a + b) squared / 2, and copies g vectors.
    """
    left, scale, budget = np.arange(len(x)), n / max(1, len(x)), COPIES * len(x)
    pivots, radii = [], []
    while len(left) > 4 and len(pivots) < PIVOTS and n >= LEAST_ROWS:
        best = None
        for p in left[:: max(1, len(left) // TRIED)][:TRIED]:
            d = np.sort(_distances(x[left], x[p : p + 1])[:, 0])
            a = np.unique(np.linspace(2, len(left) - 1, 24).astype(int))
            # a ball ends halfway to the next vector
            m = (d[a - 1] + d[a]) / 2
            g = np.searchsorted(d, m + r, "right") - a
            b = len(left) - a
            saved = (len(left) ** 2 / 2 - (a * (a / 2 + g) + b * b / 2)) * scale**2 - COPY * g * scale
            saved[g > budget] = -1
            k = int(saved.argmax())
            if best is None or saved[k] > best[0]:
                best = saved[k], p, m[k], g[k]
        if best is None or best[0] < SAVES * (len(left) * scale) ** 2 / 2:
            break
        pivots.append(x[best[1]])
        radii.append(best[2])
        budget -= best[3]
        left = left[_distances(x[left], x[best[1] : best[1] + 1])[:, 0] > best[2]]
    # the rest is a cell too, around the first of the sample
    pivots.append(x[left[0]] if len(left) else x[0])
    radii.append(4.0)
    p = np.stack(pivots)
    home, d = _homes(x, p, np.array(radii))
    rings = [np.quantile(own, np.arange(1, RINGS) / RINGS) if len(own := d[home == k, k]) else np.full(RINGS - 1, 4.0) for k in range(len(p))]
    return p, np.array(radii), np.stack(rings)


def _homes(x: np.ndarray, p: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, the first ball that it is in, and its distances from all pivots."""
    d = _distances(x, p)
    return (d <= radii).argmax(1), d


def _planned(t: pa.Table, r: float) -> pa.Table:
    """The plan of one label, by its sample: a row for each pivot. The sample is sorted, as rows come from a shuffle in any order and pivots are tried by place."""
    t = t.sort_by("u")
    x = _matrix(t.column("u").to_pylist())
    p, radii, rings = _plan(x, t.column("n")[0].as_py(), r)
    k = len(p)
    return pa.table({"label": t.column("label").take([0] * k), "width": t.column("width").take([0] * k), "cell": pa.array(range(k), pa.int32()), "pivot": pa.array([v.tobytes() for v in p], pa.binary()), "radius": pa.array(radii), "rings": pa.array([v.tobytes() for v in rings], pa.binary())})


_CELL = "gid long, label long, width int, copies long, u binary, cell int, ring int, far double, home boolean"


def _cells(batches, r: float):
    """Vectors of each (label, width, salt), which follow its plan's rows, with their cells: home, and every ball taken out before whose boundary is within r. By the triangle inequality a vector within r of one that is at home in a ball is in that cell, or was at home in an earlier one that has the other as a guest; so each pair within r meets in the earlier of its home cells, and there alone."""
    names = [c.split()[0] for c in _CELL.split(", ")]
    held, plan = None, []
    for batch in batches:
        key = [batch.column(c).to_pylist() for c in ("label", "width", "salt")]
        bounds = [k for k in range(batch.num_rows) if k == 0 or any(c[k] != c[k - 1] for c in key)] + [batch.num_rows]
        for i, j in zip(bounds, bounds[1:]):
            part = batch.slice(i, j - i)
            if (now := tuple(c[i] for c in key)) != held:
                held, plan = now, []
            of_plan = part.column("gid").is_null().to_numpy(zero_copy_only=False)
            n = int(of_plan.sum())
            plan += zip(*(part.slice(0, n).column(c).to_pylist() for c in ("cell", "u", "radius", "rings")))
            part = part.slice(n)
            if not part.num_rows:
                continue
            radii = np.array([c[2] for c in plan])
            rings = _matrix([c[3] for c in plan])
            home, d = _homes(_matrix(part.column("u").to_pylist()), _matrix([c[1] for c in plan]), radii)
            member = (d <= radii + r) & (np.arange(len(plan)) < home[:, None])
            member[np.arange(len(home)), home] = True
            row, cell = np.nonzero(member)
            ring = (d[row, cell][:, None] > rings[cell]).sum(1)
            yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(row)) for c in names[:5]] + [pa.array(cell.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(d[row, cell]), pa.array(home[row] == cell)], names=names)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row linked with each row, over any number of links."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tile(t: pa.Table, least: float) -> pa.Table:
    """Links between a block's rows, or the rows of two, one of either at home at least: their number, and enough edges to connect what is linked."""
    gid, copies, home, side = (t.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "copies", "home", "side"))
    x = _matrix(t.column("u").to_pylist())
    alone = t.column("alone")[0].as_py()
    a = np.arange(len(gid)) if alone else np.flatnonzero(side == 0)
    b = a if alone else np.flatnonzero(side == 1)
    hit = (x[a] @ x[b].T >= least) & (home[a][:, None] | home[b][None, :])
    if alone:
        np.fill_diagonal(hit, False)
    own = np.zeros(len(gid), np.int64)
    own[a] = hit @ copies[b]
    if not alone:
        own[b] += copies[a] @ hit
    # numbered by id, so that every link's lower end is the lower id
    order = np.argsort(gid, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    i, j = np.nonzero(hit)
    low = _forest(place[a[i]], place[b[j]], len(gid))
    ids, own = gid[order], own[order]
    keep = own > 0
    return pa.table({"gid": pa.array(ids[keep]), "links": pa.array(own[keep]), "low": pa.array(ids[low[keep]])})


def cells(groups: DataFrame, least: float) -> DataFrame:
    """(gid, label, width, copies, u, cell, ring, far, home) of groups(gid, label, copies, u): the cells that each vector is in, its ring and distance from the pivot there.

    Every label (of vectors of one length) has pivots of its own, chosen on about SAMPLE of its vectors by hash, in one task of that size a label. Vectors are dealt to SALTS tasks a label, each of which has the label's plan first; nothing is broadcast.
    """
    r = _radius(least)
    groups = groups.withColumn("width", F.length("u"))
    sizes = groups.groupBy("label", "width").agg(F.count("*").alias("n"))
    chosen = groups.join(sizes, ["label", "width"]).where(F.pmod(F.xxhash64("gid", F.lit(3)), F.lit(1 << 20)) * F.col("n") < SAMPLE << 20)
    plan = chosen.select("label", "width", "u", "n").groupBy("label", "width").applyInArrow(lambda t: _planned(t, r), "label long, width int, cell int, pivot binary, radius double, rings binary")
    # a label whose sample is empty is small: any vector will do
    some = groups.groupBy("label", "width").agg(F.min_by("u", "gid").alias("pivot")).join(plan.select("label", "width").distinct(), ["label", "width"], "left_anti")
    some = some.select("label", "width", F.lit(0).alias("cell"), "pivot", F.lit(4.0).alias("radius"), F.lit(np.full(RINGS - 1, 4.0).tobytes()).alias("rings"))
    plan = plan.unionByName(some).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    none = lambda kind: F.lit(None).cast(kind)
    plan = plan.select("label", "width", "salt", none("long").alias("gid"), none("long").alias("copies"), F.col("pivot").alias("u"), "cell", "radius", "rings")
    rows = groups.select("label", "width", F.pmod(F.xxhash64("gid", F.lit(5)), F.lit(SALTS)).cast("int").alias("salt"), "gid", "copies", "u", none("int").alias("cell"), none("double").alias("radius"), none("binary").alias("rings"))
    dealt = plan.unionByName(rows).repartition(partitions(groups.sparkSession), "label", "width", "salt")
    return dealt.sortWithinPartitions("label", "width", "salt", F.asc_nulls_last("cell"), "gid").mapInArrow(lambda it: _cells(it, r), _CELL)


def _radius(least: float) -> float:
    """cosine >= least is a distance of at most sqrt(2 - 2 least); a little more for rounding."""
    return math.sqrt(2 - 2 * least) + 1e-6


def compared(members: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(members with a block each, the pairs of blocks to compare). A ring's vectors are dealt to blocks of about TILE; blocks are compared where some vector is at home and the distances of their rings from the pivot differ by the radius at most (the triangle inequality again)."""
    key = ["label", "width", "cell"]
    # a small cell has fewer rings, of about TILE vectors
    sizes = members.groupBy(*key).agg(F.least(F.lit(RINGS), F.ceil(F.count("*") / TILE)).cast("int").alias("nr"))
    members = members.join(sizes, key).withColumn("ring", F.floor(F.col("ring") * F.col("nr") / RINGS).cast("int")).drop("nr")
    rings = members.groupBy(*key, "ring").agg(F.ceil(F.count("*") / TILE).cast("int").alias("nb"), F.count("*").alias("n"), F.bool_or("home").alias("homes"), F.min("far").alias("lo"), F.max("far").alias("hi"))
    blocks = rings.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    side = lambda x: blocks.select(*key, *(F.col(c).alias(f"{c}_{x}") for c in ("ring", "sub", "homes", "lo", "hi")))
    pairs = side("a").join(side("b"), key).where("(ring_a < ring_b or ring_a = ring_b and sub_a <= sub_b) and (homes_a or homes_b)")
    pairs = pairs.where((F.col("lo_b") - F.col("hi_a") <= _radius(least)) & (F.col("lo_a") - F.col("hi_b") <= _radius(least)))
    members = members.join(rings.select(*key, "ring", "nb"), [*key, "ring"]).withColumn("sub", F.pmod(F.xxhash64("gid", F.lit(7)), F.col("nb")).cast("int")).drop("nb")
    return members, pairs.select(*key, "ring_a", "sub_a", "ring_b", "sub_b", ((F.col("ring_a") == F.col("ring_b")) & (F.col("sub_a") == F.col("sub_b"))).alias("alone"))


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id long, embedding array, label int).

    Rows with equal, non-null labels link when their cosine, in double precision, is `least` or more. Equal directions of a label count as one vector with a number of copies. Each label's pivots cut it into balls and a rest (see _plan() and _cells()); a vector near a ball's boundary is a guest there too, and cells are compared independently, in blocks of about TILE vectors, so no task holds more than two blocks. A block sends connecting edges only, never all pairs.

    In many dimensions, vectors without clusters are nearly equally far from any pivot: then no ball saves comparisons, a label is one cell, and only blocks bound its tasks. Null, zero or non-finite vectors, null labels: n_links 0, component_id = vec_id, kept. Vectors of other lengths than their partner's don't link. Repeated rows are vectors of their own, linked with each other. A null vec_id is kept as a row and never a component_id unless alone. Other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = scratch.keep(rows.mapInArrow(lambda it: _unit(it, ["vec_id", "label", "u"]), "vec_id long, label long, u binary"))
    key = F.when(F.col("label").isNotNull() & F.col("u").isNotNull(), F.xxhash64("label", "u", F.sha2("u", 256)))
    rows = rows.withColumn("gid", key)
    groups = scratch.keep(rows.where("gid is not null").groupBy("gid").agg(F.count("*").alias("copies"), F.first("label").alias("label"), F.first("u").alias("u"), F.min("vec_id").alias("first")))
    members, pairs = compared(scratch.keep(cells(groups, least)), least)
    pairs = scratch.keep(pairs)
    key = ["label", "width", "cell"]
    task = [*key, "ring_a", "sub_a", "ring_b", "sub_b"]
    one = members.withColumnsRenamed({"ring": "ring_a", "sub": "sub_a"}).join(pairs, [*key, "ring_a", "sub_a"]).withColumn("side", F.lit(0))
    two = members.withColumnsRenamed({"ring": "ring_b", "sub": "sub_b"}).join(pairs.where("not alone"), [*key, "ring_b", "sub_b"]).withColumn("side", F.lit(1))
    both = one.unionByName(two).select(*task, "gid", "copies", "u", "home", "side", "alone")
    found = scratch.keep(both.groupBy(*task).applyInArrow(lambda t: _tile(t, least), "gid long, links long, low long"))
    labels = components(scratch, found.select(F.col("gid").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    parts = labels.select(F.col("node").alias("gid"), F.col("label").alias("part"))
    groups = groups.join(links, "gid", "left").join(parts, "gid", "left").select("gid", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("part", "gid").alias("part"))
    first = groups.groupBy("part").agg(F.min("first").alias("component_id"))
    groups = groups.join(first, "part").select("gid", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.join(groups, "gid", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
