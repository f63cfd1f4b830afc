"""The same operators over streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import WINDOWS
from ..operators import trend
from ..operators.ingest import upsert
from ..sources.versioned import Table


def deduplicated_snapshots(stream: DataFrame, late: str = "84 hours") -> DataFrame:
    """A stream of snapshots, each id once within the longest look-back and its deviation."""
    return stream.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["id"])


def activity(stream: DataFrame, length: str = "24 hours", late: str = "84 hours") -> DataFrame:
    """Snapshots and mean attention by source and tumbling window; a window is final when it is `late` past."""
    return stream.withWatermark("observed_at", late).groupBy(F.window("observed_at", length), "source_type").agg(F.count("*").alias("n"), F.avg("signal.attention").alias("attention")).select(F.col("window.start").alias("start"), "source_type", "n", "attention")


def _folded(rows: DataFrame) -> DataFrame:
    """Items of several batches as upsert() would have them of one."""
    first = rows.groupBy("source_type", "external_id").agg(F.min("first_seen_at").alias("first_seen_at"))
    return upsert(rows.drop("first_seen_at", "last_seen_at")).drop("first_seen_at").join(first, ["source_type", "external_id"])


def add_batch(table: Table, name: str, number: int, rows: DataFrame, merge, partition: str | None = None, notes: dict | None = None) -> bool:
    """Commits a stream's batch as a run of its own, unless that batch, or a later one, is there already; then folds runs."""
    if table.version().notes.get(name, -1) >= number:
        return False
    run = table.write(rows, partition)
    table.change(lambda seen: None if seen.notes.get(name, -1) >= number else ([(run, 0)], [], {name: number, **(notes or {})}))
    table.fold(merge, partition)
    return True


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, name: str = "items"):
    """Keeps a versioned table of items (first seen, last seen, latest content) under path up to date with a stream of normalized items. A batch writes its own items alone; runs are merged by levels as they come, so what current() reads is bounded by the logarithm of the number of batches, and nobody needs to fold. One that runs twice is committed once."""

    def write(batch: DataFrame, number: int) -> None:
        add_batch(Table(batch.sparkSession, path), name, number, upsert(batch), _folded)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_stream() keeps: one row a (source_type, external_id). A reader keeps its version while writers go on."""
    return _folded(Table(spark, path).read())


def compact(spark: SparkSession, path: str) -> None:
    """Folds all runs into one, beside writers and readers."""
    table = Table(spark, path)
    seen = table.version()
    if len(seen.runs) > 1:
        took, level = [n for n, _ in seen.runs], max(k for _, k in seen.runs) + 1
        new = table.write(_folded(table.read(seen)))
        table.change(lambda v: ([(new, level)], took, {}) if set(took) <= {n for n, _ in v.runs} else None)


#: The longest window twice (a trend compares with what was before the snapshot that it compares with), and its greatest deviation.
LOOK_BACK = dt.timedelta(seconds=2 * max(w[1] for w in WINDOWS) + max(w[2] for w in WINDOWS))


def trend_stream(stream: DataFrame, history: str, path: str, checkpoint: str, late: dt.timedelta = dt.timedelta(hours=84)):
    """Looks back from each item of a stream of snapshots: a batch adds its snapshots to the versioned table `history`, by day, and writes the trends of its items to a folder named by its number.

    A batch reads of the history the days from LOOK_BACK before its earliest snapshot (or, of older ones, before `late` before the latest of the batches before) and no others, however long the history is. Snapshots that come late, by `late` at most behind those of batches before, count as soon as they are there: their items are looked at again as of their latest snapshot. Those that are later still are kept, and have no trends of their own. A batch that runs twice is added once, and ids are distinct.
    """

    def look(batch: DataFrame, number: int) -> None:
        spark, table = batch.sparkSession, Table(batch.sparkSession, history)
        day = F.to_date("observed_at")
        span = batch.agg(F.min("observed_at").alias("first"), F.max("observed_at").alias("last")).first()
        if span["last"] is None:
            return
        ever = table.version().notes.get("latest")
        latest = max(span["last"], dt.datetime.fromisoformat(ever)) if ever else span["last"]
        add_batch(table, "snapshots", number, batch.withColumn("day", day), lambda rows: rows.dropDuplicates(["id"]), "day", {"latest": latest.isoformat()})
        # late is what comes so long after others that came before: a first batch, whatever its span, has no late ones
        since = max(span["first"], dt.datetime.fromisoformat(ever) - late) if ever else span["first"]
        asked = batch.where(F.col("observed_at") >= F.lit(since)).select("hot_item_id").distinct()
        rows = table.read().where(F.col("day") >= F.lit((since - LOOK_BACK).date())).drop("day")
        rows = rows.join(asked, "hot_item_id", "left_semi").dropDuplicates(["id"])
        trend.trends(rows).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
