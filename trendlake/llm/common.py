"""Helpers shared by the operators: stored intermediate tables, fixed-size sketches, vectorised word hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary folder, in local mode only."""
    sc = spark.sparkContext
    set_to = sc.getConf().get("spark.checkpoint.dir", None) or sc._jvm.scala.jdk.javaapi.OptionConverters.toJava(sc._jsc.sc().getCheckpointDir()).orElse(None)
    if set_to:
        return set_to.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="trendlake-"))
    return shared_dir(spark)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once, written and reread."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables that nothing needs any more."""
        for df in kept:
            for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if at.startswith(("file:", "hdfs:", "s3", "viewfs:", "/")) and self.root.split(":/", 1)[-1].lstrip("/") in at:
                    p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                    p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- fixed-size sketches

BLOCK = 1 << 14
SKETCH_SCHEMA = "block int, cells binary"


def sketch_rows(cells: np.ndarray, compress) -> Iterator[tuple[int, bytes]]:
    """The non-empty blocks of a sketch."""
    for k in range(0, len(cells), BLOCK):
        part = cells[k : k + BLOCK]
        if part.any():
            yield k // BLOCK, compress(part.tobytes())


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum, at most what the type holds: counts never wrap around."""
    out = a + b
    out[out < a] = np.iinfo(a.dtype).max
    return out


def merge_sketch(rows: DataFrame, size: int, dtype: str, how: str) -> np.ndarray:
    """Adds or ORs the partial sketches (block, cells) of all tasks; each task streams over its blocks, and the driver gets the one merged sketch, of fixed size."""
    import zlib

    blocks = -(-size // BLOCK)

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("block").to_pylist(), b.column("cells").to_pylist()):
                x = np.frombuffer(zlib.decompress(raw), dtype=dtype)
                held[k] = x.copy() if k not in held else (_added(held[k], x) if how == "add" else held[k] | x)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int32()), "cells": pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())})

    out = np.zeros(size, dtype=dtype)
    # two levels, so that no task reads the block of every input task
    salted = rows.withColumn("salt", F.floor(F.rand(7) * 8).cast("int")).repartition(partitions(rows.sparkSession), "block", "salt").drop("salt").mapInArrow(merge, SKETCH_SCHEMA)
    for r in salted.repartition(min(blocks, partitions(rows.sparkSession)), "block").mapInArrow(merge, SKETCH_SCHEMA).collect():
        x = np.frombuffer(zlib.decompress(bytes(r["cells"])), dtype=dtype)
        part = out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)]
        part[:] = _added(part, x) if how == "add" else part | x
    return out


# ---------------------------------------------------------------- words

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = U(0x9E3779B97F4A7C15)
_MULT = (_rng.integers(1, 1 << 63, 8, dtype=np.uint64) << U(1)) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 2 * len(_powers)), _STEP, np.uint64))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a batch of about `most` bytes of text (or one longer row), with their bytes and offsets."""
    if not batch.num_rows:
        return
    raw, off = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(raw: np.ndarray, off: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first byte and end of every word [^\\x20\\x09-\\x0D]+, A-Z lower-cased. `cuts`: bytes before which a word ends in any case."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), none, none, none
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    if cuts is not None:
        edge[cuts] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    at = np.flatnonzero(solid)
    with np.errstate(over="ignore"):
        value = _BYTE[raw[at]] * powers(int(lens.max()))[at - np.repeat(starts, lens)]
        h = mix(np.add.reduceat(value, first) + lens.astype(np.uint64))
    return h, np.searchsorted(off, starts, "right") - 1, starts, ends


def shingles(raw: np.ndarray, off: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles; a row of 1 to k - 1 words has one shingle, of all its words."""
    h, row, _, _ = word_spans(raw, off)
    bounds = np.searchsorted(row, np.arange(len(off)))
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            runs += h[j : len(h) - k + 1 + j] * _MULT[j] if len(runs) else runs
        runs = mix(runs + U(k))
        for i in range(len(off) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _MULT[: b - a]).sum(dtype=np.uint64) + U(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


# ---------------------------------------------------------------- components


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable over edges (a, b). Alternates large-star and small-star steps, whose hubs Spark's skew join splits; nothing goes through the driver but a count and a checksum."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, last = scratch.keep(edges), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        step = scratch.keep(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        now = step.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
        scratch.drop(edges)
        edges = step
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
