"""Versioned tables and the streams that write them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendlake.plans import batch as B
from trendlake.sources import sinks, versioned
from trendlake.sources.versioned import Conflict, Table
from trendlake.streaming import ingest as S

T0 = dt.datetime(2024, 1, 10)
HOUR = dt.timedelta(hours=1)


def numbers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x long")


def test_of_two_writers_of_a_version_one_fails(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    seen = t.version()
    assert seen.number == 0 and t.read() is None
    t.commit(seen, [(t.write(numbers(spark, 1)), 0)])
    with pytest.raises(Conflict):
        t.commit(seen, [(t.write(numbers(spark, 2)), 0)])
    assert [r.x for r in t.read().collect()] == [1] and t.version().number == 1
    assert [p.name for p in (tmp_path / "t" / "log").iterdir() if not p.name.startswith(".")] == ["000000000001.json"]


def test_append_new_never_repeats_a_key(spark, tmp_path, monkeypatch):
    """Another writer commits the same keys between our look and our commit."""
    path = str(tmp_path / "t")
    assert sinks.append_new(numbers(spark, 1, 2, 2), path, ["x"]).count() == 2
    real, other = Table.commit, []

    def slow(self, seen, *args):
        if not other:
            other.append(1)
            sinks.append_new(numbers(spark, 3), path, ["x"])
        return real(self, seen, *args)

    monkeypatch.setattr(Table, "commit", slow)
    assert [r.x for r in sinks.append_new(numbers(spark, 2, 3, 4), path, ["x"]).collect()] == [4]
    assert sorted(r.x for r in Table(spark, path).read().collect()) == [1, 2, 3, 4]


def test_status_changes_are_commits(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.commit(t.version(), [(t.write(spark.createDataFrame([(1, "NEW", 3), (2, "NEW", 1)], "id long, status string, version int")), 0)])
    B.commit_status(t, "id", 1, 3, "status", "ACKED")
    B.commit_status(t, "id", 2, 1, "status", "DISMISSED")
    with pytest.raises(ValueError):
        B.commit_status(t, "id", 1, 3, "status", "DISMISSED")
    assert sorted(map(tuple, t.read().collect())) == [(1, "ACKED", 4), (2, "DISMISSED", 2)]


def test_runs_are_merged_by_levels(spark, tmp_path, monkeypatch):
    """Fifty batches are read from a few runs, readers of an older version still read it, and old folders go."""
    monkeypatch.setattr(versioned, "FAN", 3)
    monkeypatch.setattr(versioned, "KEPT_VERSIONS", 4)
    t = Table(spark, str(tmp_path / "t"))
    most = 0
    for k in range(30):
        if k == 27:
            old = t.read()
        assert S.add_batch(t, "s", k, numbers(spark, k % 7), lambda rows: rows.distinct())
        assert not S.add_batch(t, "s", k, numbers(spark, 100), lambda rows: rows.distinct())
        most = max(most, len(t.version().runs))
    assert most <= 8 and {r.x for r in t.read().collect()} == set(range(7)) and t.version().notes == {"s": 29}
    assert {r.x for r in old.collect()} == set(range(7))
    assert len(list((tmp_path / "t" / "data").iterdir())) < 20


def test_fold_keeps_what_others_add(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "FAN", 2)
    t = Table(spark, str(tmp_path / "t"))
    for x in (1, 2):
        t.change(lambda v, x=x: ([(t.write(numbers(spark, x)), 0)], [], {}))

    def merge(rows):
        t.change(lambda v: ([(t.write(numbers(spark, 9)), 5)], [], {}))
        return rows

    t.fold(merge)
    assert sorted(r.x for r in t.read().collect()) == [1, 2, 9] and sorted(k for _, k in t.version().runs) == [1, 5]


SNAPSHOT = "id long, hot_item_id long, observed_at timestamp, source_type string, signal struct<attention:double,discussion:double,adoption:double,relevance:double,rank:int>, raw_metrics map<string,double>"


def snapshot(i, item, at, v):
    return (i, item, at, "GITHUB", (float(v), 0.0, 0.0, 0.0, None), {"stargazersCount": float(v)})


def test_look_back_reads_few_days_and_late_rows_count(spark, tmp_path):
    """A batch reads two windows and a deviation; a late snapshot changes the trend of its item's latest one."""
    src, h, out = (str(tmp_path / n) for n in ("in", "h", "out"))

    def go(*rows):
        spark.createDataFrame(rows, SNAPSHOT).coalesce(1).write.mode("append").parquet(src)
        S.trend_stream(spark.readStream.schema(SNAPSHOT).parquet(src), h, out, str(tmp_path / "c")).awaitTermination()
        n = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
        return {(r.hot_item_id, r.window): r for r in spark.read.parquet(f"{out}/v={n}").collect()}

    go(snapshot(1, 1, T0 - 400 * HOUR, 1), snapshot(2, 2, T0 - 300 * HOUR, 5))
    one = go(snapshot(3, 1, T0, 50), snapshot(3, 1, T0, 50))
    assert one[1, "24h"].confidence == "UNKNOWN"
    late = go(snapshot(4, 1, T0 - 24 * HOUR, 20))
    assert {k[0] for k in late} == {1} and late[1, "24h"].attention_delta == 30.0
    # later than allowed: kept, but no trend
    assert go(snapshot(5, 2, T0 - 200 * HOUR, 7)) == {}
    assert Table(spark, h).read().where("hot_item_id = 2").count() == 2

    days = [F.lit((T0 - S.LOOK_BACK).date())]
    plan = Table(spark, h).read().where(F.col("day") >= days[0])
    assert plan.select("id").distinct().count() == 2 and "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().toString()


def test_first_batch_has_trends_of_all_items(spark, tmp_path):
    """Items last seen long before others of the same batch have trends as well."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([snapshot(1, 1, T0 - 324 * HOUR, 1), snapshot(2, 1, T0 - 300 * HOUR, 5), snapshot(3, 2, T0, 50)], SNAPSHOT).coalesce(1).write.parquet(src)
    S.trend_stream(spark.readStream.schema(SNAPSHOT).parquet(src), str(tmp_path / "h"), out, str(tmp_path / "c")).awaitTermination()
    got = {(r.hot_item_id, r.window): r.attention_delta for r in spark.read.parquet(out).collect()}
    assert len(got) == 8 and got[1, "24h"] == 4.0 and got[2, "24h"] is None


def test_reports_replace_their_days_alone(spark, tmp_path, monkeypatch):
    """Another writer's day, committed in between, stays."""
    path = str(tmp_path / "t")
    day = lambda d, t: spark.createDataFrame([(d, t)], "report_date string, title string")
    sinks.upsert_reports(day("a", "1").union(day("b", "1")), path)
    real, other = Table.commit, []

    def slow(self, seen, *args):
        if not other:
            other.append(1)
            sinks.upsert_reports(day("c", "2"), path)
        return real(self, seen, *args)

    monkeypatch.setattr(Table, "commit", slow)
    sinks.upsert_reports(day("b", "3"), path)
    assert sorted(map(tuple, Table(spark, path).read().collect())) == [("a", "1"), ("b", "3"), ("c", "2")]


def test_requests_keep_their_distance(spark):
    from trendlake.sources.connector import spaced

    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 4)], "s string, i int")
    assert sorted((r.s or "", r.i, r.not_before) for r in spaced(df, "s", ["i"], 3).collect()) == [("", 4, 0.0), ("a", 1, 0.0), ("a", 3, 3.0), ("b", 2, 0.0)]
