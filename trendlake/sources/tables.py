"""The domain's tables, made of the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ROLES, SOURCES

#: What every ninth item's title starts with, in turn, so that known names and event types occur; the other titles start with nothing.
HEADLINES = ("OpenAI launches GPT-5: ", "Anthropic ships Claude Code - ", "Breaking: Meta open-source Llama 3. ", "NVIDIA raises funding: ", "", "", "", "", "")

#: The instant that queries take as now.
NOW = "2024-03-15 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it is smaller than what their scans take at once: a file with one group of rows is read by one task, whatever its rows cost afterwards. Larger tables stay as they are read."""
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < cores * split and len(df.inputFiles()) < cores
    return df.repartition(cores) if small else df


def role(source: Column) -> Column:
    """Role of a source; PRIMARY where there is none."""
    out = None
    for s, r in ROLES.items():
        out = F.when(source == s, r) if out is None else out.when(source == s, r)
    return out.otherwise("PRIMARY")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hot item for each document: its whole text is the summary; the title is a headline and the text's first sentence or line."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    number = lambda n: F.pmod(i, F.lit(n)).cast("string")
    url = (
        F.when(F.pmod(i, F.lit(6)) == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(number(500), 5, "0")))
        .when(F.pmod(i, F.lit(6)) == 1, F.concat(F.lit("https://github.com/org"), number(20), F.lit("/repo"), number(50)))
        .when(F.pmod(i, F.lit(6)) == 2, F.concat(F.lit("https://huggingface.co/org"), number(20), F.lit("/model"), number(50)))
        .when(F.pmod(i, F.lit(6)) == 3, F.concat(F.lit("https://news.ycombinator.com/item?id="), number(300)))
        .when(F.pmod(i, F.lit(6)) == 4, F.concat(F.lit("https://twitter.com/u"), number(30), F.lit("/status/"), number(400)))
        .otherwise(F.concat(F.lit("HTTPS://Example.COM:443/p/"), number(100), F.lit("?utm_source=x&b=2&a=1#frag")))
    )
    return d.select(
        i.alias("hot_item_id"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.pmod(i, F.lit(10)) + 1).cast("int")).alias("source_type"),
        i.cast("string").alias("external_id"),
        F.concat(F.element_at(F.array(*map(F.lit, HEADLINES)), (F.pmod(i, F.lit(len(HEADLINES))) + 1).cast("int")), F.regexp_extract("text", r"^[^.!?\n]*[.!?]?", 0)).alias("title"),
        F.col("text").alias("summary"),
        url.alias("source_url"),
        F.col("source").alias("author"),
        F.array("lang", "source").alias("tags"),
        F.pmod("n_chars", F.lit(700)).alias("points"),
        F.pmod(i, F.lit(250)).alias("comments_count"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + i * 600_000_000).alias("published_at"),
    )


def memberships(items: DataFrame) -> DataFrame:
    """Four items a cluster, the first one primary; every seventh membership has ended."""
    i = F.col("hot_item_id")
    return items.select(F.floor(i / 4).alias("hot_cluster_id"), "hot_item_id", (F.pmod(i, F.lit(4)) == 0).alias("is_primary"), F.col("published_at").alias("assigned_at"), F.when(F.pmod(i, F.lit(7)) == 6, F.col("published_at")).alias("removed_at"))


def clusters(items: DataFrame) -> DataFrame:
    """A cluster for each four items, every eleventh archived."""
    c = F.floor(F.col("hot_item_id") / 4)
    rows = items.groupBy(c.alias("hot_cluster_id")).agg(F.min_by("title", "hot_item_id").alias("title"), F.min_by("summary", "hot_item_id").alias("summary"), F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_seen_at"))
    return rows.withColumn("status", F.when(F.pmod("hot_cluster_id", F.lit(11)) == 10, "ARCHIVED").otherwise("ACTIVE"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_of(read(spark, sf_dir, "events"))


def snapshots_of(e: DataFrame) -> DataFrame:
    """A signal snapshot for each event: its type tells the source, its value the signal in the source's dimension, k the raw metric."""
    t = F.col("event_type")
    source = F.when(t == "view", "BING_SEARCH").when(t == "click", "HACKER_NEWS").when(t == "purchase", "GITHUB").when(t == "signup", "HUGGING_FACE").otherwise("TWITTER")
    v = F.least(F.abs("value"), F.lit(100.0))
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("hot_item_id"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        source.alias("source_type"),
        F.struct(
            F.when(t.isin("click", "signup", "error"), v).otherwise(0.0).alias("attention"),
            F.when(t.isin("click", "error"), v / 2).otherwise(0.0).alias("discussion"),
            F.when(t.isin("purchase", "signup"), v).otherwise(0.0).alias("adoption"),
            F.when(t == "view", v).otherwise(0.0).alias("relevance"),
            F.when(t == "view", F.pmod("event_id", F.lit(20)).cast("int") + 1).alias("rank"),
        ).alias("signal"),
        F.when(t == "view", F.create_map(F.lit("rank"), k))
        .when(t == "click", F.create_map(F.lit("points"), k, F.lit("commentsCount"), k + 1))
        .when(t == "purchase", F.create_map(F.lit("stargazersCount"), k, F.lit("openIssuesCount"), k * 2))
        .when(t == "signup", F.create_map(F.lit("downloads"), k))
        .otherwise(F.create_map(F.lit("likeCount"), k))
        .alias("raw_metrics"),
    )
