"""From raw records to scored clusters, a batch at a time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import ingest as I
from ..operators import scoring as S
from ..operators import signals as G
from ..sources.versioned import Table


def run(raw: DataFrame, now: Column, stored=None) -> dict[str, DataFrame]:
    """raw: see normalize(). items (one a source and id, with signals), membership, scores, the raw records as they are kept (with a hash), dead letters, and counts of the batch with its status. A record that is no JSON has failed; one that no normalizer takes is filtered.

    Raw records are read and parsed once: stored(df) keeps each with what became of it, and counts read that column alone. (Counters in passing, as Dataset.observe has them, count a task's rows again when an executor is lost.)
    """
    from ..sources import sinks

    stored = stored or sinks.stored
    error = F.when(F.try_parse_json("raw_payload").isNull(), F.substring(F.concat(F.lit("no JSON: "), F.coalesce("raw_payload", F.lit(""))), 1, 1000))
    parsed = stored(I.normalize(raw.withColumn("error_message", error), ("error_message",), every=True))
    fine = parsed.where("error_message is null")
    dead = parsed.where("error_message is not null").select("id", "source_type", "external_id", "fetched_at", "error_message", F.lit("NORMALIZE").alias("stage"))
    items = stored(G.signals(I.upsert(fine.where("ok").drop("ok", "error_message"))).withColumnRenamed("id", "hot_item_id"))
    membership = C.v1_assign(items)
    members = membership.join(items, "hot_item_id")
    failed = F.col("error_message").isNotNull()
    counts = parsed.agg(F.count("*").alias("fetched"), F.count_if(~failed & F.col("ok")).alias("matched"), F.count_if(failed).alias("failed")).crossJoin(items.agg(F.count("*").alias("persisted")))
    counts = counts.withColumn("filtered", F.col("fetched") - F.col("matched") - F.col("failed")).withColumn("status", task_status(F.col("failed"), F.col("persisted")))
    counts = counts.select("fetched", "matched", "persisted", "failed", "filtered", "status")
    return {"raw": I.with_payload_hash(raw), "items": items, "membership": membership, "scores": S.v1_scores(members, now), "dead": dead, "counts": counts}


def both_versions(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Scores of both versions: the one that is online ranks, the other shadows it."""
    keep = ["hot_cluster_id", "total_score", "scoring_version"]
    return v1.select(*keep).unionByName(v2.select(*keep))


def scored(v1: DataFrame, second, stored=None) -> tuple[DataFrame, str | None]:
    """(scores of both versions, None), or those of the first alone and what went wrong where the second, second(), fails: a shadow never stops the score that ranks. Either is computed here, once."""
    from ..sources import sinks

    stored = stored or sinks.stored
    first = stored(v1)
    try:
        return both_versions(first, stored(second())), None
    except Exception as e:  # whatever the shadow does
        return first.select("hot_cluster_id", "total_score", "scoring_version"), f"{type(e).__name__}: {e}"[:1000]


def task_status(failed: Column, persisted: Column) -> Column:
    return F.when(failed == 0, "SUCCEEDED").when(persisted > 0, "PARTIAL_FAILED").otherwise("FAILED")


def report_day(today: dt.date, offset: int, existing: set[dt.date], refresh: bool) -> dt.date | None:
    """The day to report on; None where its report is there and need not be made again."""
    day = today - dt.timedelta(days=offset)
    return None if day in existing and not refresh else day


def set_status(rows: DataFrame, key: str, value: int, version: int, column: str, status, allowed: tuple = ("ACKED", "DISMISSED")) -> DataFrame:
    """rows with one's status set to an allowed one and version raised, if it still has the version that the caller saw; else ValueError."""
    if status not in allowed:
        raise ValueError(f"the status must be one of {', '.join(map(str, allowed))}")
    hit = (F.col(key) == value) & (F.col("version") == version)
    if rows.where(hit).isEmpty():
        raise ValueError("gone, or changed by another")
    return rows.withColumn(column, F.when(hit, F.lit(status)).otherwise(F.col(column))).withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version")))


def commit_status(table: Table, key: str, value: int, version: int, column: str, status, allowed: tuple = ("ACKED", "DISMISSED")) -> None:
    """set_status() of a stored table, as one commit: of two callers that saw the same version of a row the second gets ValueError, whichever rows others change meanwhile."""

    def changed(seen):
        rows = table.read(seen)
        if rows is None:
            raise ValueError("gone, or changed by another")
        return [(table.write(set_status(rows, key, value, version, column, status, allowed)), 0)], [n for n, _ in seen.runs], {}

    table.change(changed)
