"""Growth and trends: nearest as-of joins of signal snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONFIDENCE, GROWTH_WEIGHTS, METRICS, WINDOWS
from ..functions.numbers import clamp

DIMENSIONS = ("attention", "discussion", "adoption", "relevance")


def latest_snapshots(snapshots: DataFrame, n: int = 1) -> DataFrame:
    """The n latest snapshots of each item, the larger id first of equal times."""
    w = Window.partitionBy("hot_item_id").orderBy(F.desc("observed_at"), F.desc("id"))
    return snapshots.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)


def nearest(probes: DataFrame, history: DataFrame, keys: list[str], at: str, target: str, deviation: str, deviations: tuple[int, ...]) -> DataFrame:
    """The rows of probes with `h`, the row of history of the same item whose time is nearest to `target`, at most `deviation` seconds off (one of `deviations`), the earlier of equally near ones; null where there is none.

    Time is cut into stretches twice as long as a deviation, of which a probe needs two at most: the join is on item, deviation and stretch, so a probe meets what is near it alone, and an item with a long history is many keys. The choice is an aggregate.
    """
    stretch = lambda t, d: F.floor(t / (d.cast("long") * 2_000_000))
    h = history.select(F.col("hot_item_id").alias("h_item"), F.struct("id", "observed_at", "signal", "raw_metrics").alias("h"), F.explode(F.array(*map(F.lit, sorted(set(deviations))))).alias("h_dev"))
    h = h.withColumn("h_stretch", stretch(F.unix_micros("h.observed_at"), F.col("h_dev")))
    goal, most = F.unix_micros(target), F.col(deviation).cast("long") * 1_000_000
    p = probes.where(F.col(target).isNotNull()).withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(goal - most, F.col(deviation)), stretch(goal + most, F.col(deviation))))))
    off = F.abs(F.unix_micros("h.observed_at") - goal)
    near = p.join(h, (F.col("hot_item_id") == F.col("h_item")) & (F.col(deviation) == F.col("h_dev")) & (F.col("stretch") == F.col("h_stretch"))).where(off <= most)
    best = near.groupBy(*keys).agg(F.min_by("h", F.struct(off, F.col("h.observed_at"), F.col("h.id"))).alias(at))
    return probes.join(best, keys, "left")


def _deltas(now: Column, then: Column) -> list[Column]:
    return [(F.coalesce(now[d], F.lit(0.0)) - F.coalesce(then[d], F.lit(0.0))) for d in DIMENSIONS]


def momentum(deltas: list[Column], rank: Column) -> Column:
    gains = reduce(lambda a, b: a + b, (F.greatest(F.lit(0.0), d) for d in deltas))
    return clamp(0.25 * gains + F.when(rank > 0, F.least(rank, F.lit(20)).cast("double")).otherwise(0.0), 0, 100)


def velocity(deltas: list[Column], rank: Column) -> Column:
    return 0.25 * reduce(lambda a, b: a + b, deltas) + F.coalesce(clamp(rank.cast("double"), -20, 20), F.lit(0.0))


def _rank(now: Column, then: Column) -> Column:
    return then["rank"] - now["rank"]


def raw_deltas(source: Column, now: Column, then: Column) -> Column:
    """(metric, previous, current, delta, growth, kind, anomaly) of the source's raw metrics, by name, where either value is there. Empty if either map is null."""
    out = F.array().cast("array<struct<metric:string,previous:double,current:double,delta:double,growth:double,kind:string,anomaly:boolean>>")
    for s, kinds in METRICS.items():
        parts = []
        for name, kind in sorted(kinds.items()):
            a, b = F.try_element_at(then, F.lit(name)), F.try_element_at(now, F.lit(name))
            delta = b - a
            parts.append(
                F.when(
                    a.isNotNull() | b.isNotNull(),
                    F.struct(F.lit(name).alias("metric"), a.alias("previous"), b.alias("current"), delta.alias("delta"), F.when((a > 0) & delta.isNotNull(), F.greatest(F.lit(-1.0), delta / a)).alias("growth"), F.lit(kind).alias("kind"), F.coalesce((F.lit(kind) == "MONO") & (delta < 0), F.lit(False)).alias("anomaly")),
                )
            )
        out = F.when((source == s) & now.isNotNull() & then.isNotNull(), F.array_compact(F.array(*parts))).otherwise(out)
    return out


def growth_rate(raw: Column) -> Column:
    """Mean growth of the raw metrics, weighted by kind; null without any, -1 at least."""
    weight = F.create_map(*(F.lit(x) for pair in GROWTH_WEIGHTS.items() for x in pair))
    used = F.filter(raw, lambda r: r["growth"].isNotNull() & (F.element_at(weight, r["kind"]) > 0))
    total = F.aggregate(used, F.lit(0.0), lambda a, r: a + F.element_at(weight, r["kind"]))
    return F.when(F.size(used) > 0, F.greatest(F.lit(-1.0), F.aggregate(used, F.lit(0.0), lambda a, r: a + r["growth"] * F.element_at(weight, r["kind"])) / total))


def _confidence(off: Column, high: Column, medium: Column) -> Column:
    return F.when(off <= high.cast("long") * 1_000_000, "HIGH").when(off <= medium.cast("long") * 1_000_000, "MEDIUM").otherwise("LOW")


def trends(snapshots: DataFrame, windows: tuple = WINDOWS) -> DataFrame:
    """For each item and window: deltas of the latest snapshot against the nearest one a window before, confidence, momentum, velocity, raw deltas, growth rate, and acceleration against the window before that. UNKNOWN where nothing is near enough."""
    table = F.array(*(F.struct(F.lit(c).alias("code"), *(F.lit(v).alias(n) for n, v in zip(("target_s", "most_s", "high_s", "medium_s"), rest))) for c, *rest in windows))
    cur = latest_snapshots(snapshots).select("hot_item_id", "source_type", F.struct("id", "observed_at", "signal", "raw_metrics").alias("cur"), F.explode(table).alias("w"))
    cur = cur.select("hot_item_id", "source_type", "cur", "w.*").withColumn("target", F.col("cur.observed_at") - F.make_dt_interval(secs=F.col("target_s")))
    keys = ["hot_item_id", "code"]
    deviations = tuple(w[2] for w in windows)
    one = nearest(cur, snapshots, keys, "hist", "target", "most_s", deviations).withColumn("target2", F.col("hist.observed_at") - F.make_dt_interval(secs=F.col("target_s")))
    two = nearest(one, snapshots, keys, "prev", "target2", "most_s", deviations)
    now, then, before = F.col("cur.signal"), F.col("hist.signal"), F.col("prev.signal")
    deltas, rank = _deltas(now, then), _rank(now, then)
    known = F.col("hist").isNotNull()
    late = F.col("cur.observed_at") < F.col("hist.observed_at")
    two = two.withColumn("raw", F.when(known, raw_deltas(F.col("source_type"), F.col("cur.raw_metrics"), F.col("hist.raw_metrics"))))
    reset = F.exists("raw", lambda r: r["anomaly"])
    level = _confidence(F.abs(F.unix_micros("hist.observed_at") - F.unix_micros("target")), F.col("high_s"), F.col("medium_s"))
    step = momentum(deltas, rank) - momentum(_deltas(then, before), _rank(then, before))
    good = known & ~late
    return two.select(
        "hot_item_id",
        F.col("code").alias("window"),
        *(F.when(good, d).alias(f"{n}_delta") for n, d in zip(DIMENSIONS, deltas)),
        F.when(good, rank).alias("rank_delta"),
        F.when(good, momentum(deltas, rank)).alias("momentum"),
        F.when(good, velocity(deltas, rank)).alias("velocity"),
        F.when(~known, "UNKNOWN").when(late, "DATA_ANOMALY").when(reset, "METRIC_RESET").otherwise(level).alias("confidence"),
        F.when(good, level).alias("level"),
        F.when(good, growth_rate(F.col("raw"))).alias("growth_rate"),
        F.when(good & F.col("prev").isNotNull() & (F.col("hist.observed_at") >= F.col("prev.observed_at")), step).alias("acceleration"),
        F.when(good, F.col("raw")).alias("raw"),
        F.col("hist.observed_at").alias("previous_at"),
    )


def growth_24h(snapshots: DataFrame) -> DataFrame:
    """The day's growth alone, in which any falling dimension is a reset."""
    rows = trends(snapshots, tuple(w for w in WINDOWS if w[0] == "24h"))
    fell = reduce(lambda a, b: a | b, (F.col(f"{d}_delta") < 0 for d in DIMENSIONS))
    cur = F.col("confidence")
    return rows.withColumn("confidence", F.when(cur.isin("UNKNOWN", "DATA_ANOMALY"), cur).when(fell, "METRIC_RESET").otherwise(F.col("level"))).select("hot_item_id", *(f"{d}_delta" for d in DIMENSIONS), "rank_delta", "momentum", "confidence")


def without_repeated_urls(members: DataFrame) -> DataFrame:
    """Members with role, url, rank: of discovery items of a cluster with one canonical URL, the one with the lowest rank (none last), then id; all others pass. Each task keeps one row of a cluster and URL before any are shuffled, so many members of one cost no task more."""
    same = (F.col("role") == "DISCOVERY") & (F.trim("url") != "")
    order = F.struct(F.col("rank").isNull().alias("none"), "rank", "hot_item_id")
    one = members.where(same).groupBy("hot_cluster_id", "url").agg(F.min_by(F.struct(*members.columns), order).alias("m")).select("m.*")
    return one.unionByName(members.where(~F.coalesce(same, F.lit(False))))


def cluster_trends(members: DataFrame, trends: DataFrame, windows: tuple = WINDOWS, clusters: DataFrame | None = None) -> DataFrame:
    """For each cluster and window, what its contributing items' trends sum to, and its state. members: active ones (hot_cluster_id, hot_item_id, role, url, rank). A cluster of `clusters` without any has the state UNKNOWN."""
    rows = without_repeated_urls(members).join(trends, "hot_item_id", "left")
    rows = rows.withColumn("confidence", F.coalesce("confidence", F.lit("UNKNOWN")))
    ok = ~F.col("confidence").isin("UNKNOWN", "DATA_ANOMALY")
    codes = F.array(*(F.lit(w[0]) for w in windows))
    own = members.select("hot_cluster_id").distinct().withColumn("any", F.lit(True))
    every = (own if clusters is None else clusters.select("hot_cluster_id").distinct().join(own, "hot_cluster_id", "left")).withColumn("window", F.explode(codes))
    level = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    some = rows.where(ok).groupBy("hot_cluster_id", "window").agg(
        F.count("*").alias("contributing"),
        clamp(F.sum(F.coalesce("momentum", F.lit(0.0))) / F.count("*"), 0, 100).alias("momentum"),
        F.when(F.count("growth_rate") > 0, F.greatest(F.lit(-1.0), F.avg("growth_rate"))).alias("growth_rate"),
        F.avg("acceleration").alias("acceleration"),
        F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.max(level).cast("int")).alias("confidence"),
        *(F.sum(F.coalesce(f"{d}_delta", F.lit(0.0))).alias(f"{d}_delta") for d in DIMENSIONS),
    )
    total = reduce(lambda a, b: a + b, (F.col(f"{d}_delta") for d in DIMENSIONS))
    state = F.when(F.col("any").isNull(), "UNKNOWN").when(F.col("contributing").isNull(), "NEW").when(total > 5, F.when(F.col("acceleration") < 0, "PEAKING").otherwise("RISING")).when(total < -5, "COOLING").otherwise("STABLE")
    return every.join(some, ["hot_cluster_id", "window"], "left").withColumn("state", state).withColumn("confidence", F.coalesce("confidence", F.lit("UNKNOWN"))).drop("any")


def cluster_raw_deltas(members: DataFrame, trends: DataFrame) -> DataFrame:
    """By cluster, window and raw metric: sums, mean growth, any anomaly; previous and current of the last member."""
    rows = without_repeated_urls(members).join(trends.where(~F.col("confidence").isin("UNKNOWN", "DATA_ANOMALY")), "hot_item_id").select("hot_cluster_id", "window", "hot_item_id", F.explode("raw").alias("r"))
    return rows.groupBy("hot_cluster_id", "window", F.col("r.metric").alias("metric")).agg(
        F.sum("r.delta").alias("delta"), F.avg("r.growth").alias("growth"), F.max_by("r.previous", "hot_item_id").alias("previous"), F.max_by("r.current", "hot_item_id").alias("current"), F.bool_or("r.anomaly").alias("anomaly"), F.min("r.kind").alias("semantics"),
    )
