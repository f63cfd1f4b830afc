"""Writes: partitions that replace themselves, JSON lines, report files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versioned import Table


def write_daily(reports: DataFrame, path: str) -> None:
    """Replaces the days that are in reports, and no other."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)


def upsert_reports(reports: DataFrame, path: str, key: str = "report_date") -> None:
    """Puts reports in a versioned table, in place of those of the same days: one commit, so readers see the day before or after it, and of two writers neither loses the other's days."""
    table = Table(reports.sparkSession, path)

    def put(seen):
        there = table.read(seen)
        rows = reports if there is None else there.join(reports.select(key).distinct(), key, "left_anti").unionByName(reports)
        return [(table.write(rows), 0)], [n for n, _ in seen.runs], {}

    table.change(put)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends the rows whose keys the versioned table under path does not have, one for each key, and returns them. Where another writer commits first, what it added is looked up again, so that no key comes twice."""
    table = Table(rows.sparkSession, path)
    wrote = []

    def new(seen):
        table.discard(*wrote[-1:])  # of a try that came too late
        there = table.read(seen)
        some = rows if there is None else rows.join(there.select(*keys), keys, "left_anti")
        wrote.append(table.write(some.dropDuplicates(keys)))
        return [(wrote[-1], 0)], [], {}

    table.change(new)
    return table.read(runs=wrote[-1:])


def report_markdown(metrics: dict) -> str:
    """A summary of a few metrics; NaN and missing values are a dash."""
    lines = ["# Evaluation", "", "| metric | value |", "| --- | --- |"]
    for k, v in metrics.items():
        lines.append(f"| {k} | {'-' if v is None or v != v else round(v, 4) if isinstance(v, float) else v} |")
    return "\n".join(lines) + "\n"


#: What quality on labelled data should reach.
GATES = {"precision": (0.90, 1), "recall": (0.75, 1), "false_merge": (0.05, -1)}


def gates(metrics: dict) -> dict[str, str]:
    """PASS, FAIL or UNKNOWN for each gate: precision and recall at least, false merges at most, and the second version's NDCG not below and misses of major events not above the first's."""

    def told(ok, *values):
        return "UNKNOWN" if any(v is None or v != v for v in values) else "PASS" if ok(*values) else "FAIL"

    out = {k: told(lambda v, b=bound, s=sign: (v - b) * s >= 0, metrics.get(k)) for k, (bound, sign) in GATES.items()}
    out["ndcg_v2_not_below_v1"] = told(lambda a, b: b >= a, metrics.get("ndcg_v1"), metrics.get("ndcg_v2"))
    out["major_miss_v2_not_above_v1"] = told(lambda a, b: b <= a, metrics.get("major_miss_v1"), metrics.get("major_miss_v2"))
    return out


def write_report(spark, metrics: dict, path: str) -> None:
    """Folders report.json and report.md under path: metrics and gates, by Spark, so in any store."""
    import json

    found = gates(metrics)
    text = report_markdown(metrics) + "\n" + "\n".join(f"* {k}: {v}" for k, v in found.items()) + "\n"
    body = json.dumps({"metrics": {k: None if v != v else v for k, v in metrics.items()}, "gates": found})
    for name, content in (("report.json", body), ("report.md", text)):
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def root(spark) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    set_to = sc.getConf().get("spark.checkpoint.dir", None)
    if not set_to:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="trendlake-")
    return set_to.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage: a table in the folder of root()."""
    path = f"{root(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, where nothing reads it any more; leaves all other files alone."""
    for df in tables:
        spark = df.sparkSession
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if at.rsplit("/", 1)[-1].startswith("stored-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
