"""A training corpus from documents: toxic ones go, near copies go, personal data is replaced, sources are mixed, texts are tokenized."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.llm import mixing, ngram_jaccard, pii, sentencepiece_trie, toxicity
from trendlake.llm.common import Scratch, table

#: A document goes if it is toxic with this probability or more.
TOXIC = 0.7
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from all labelled documents among them, is below TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored_rows(docs.select(*COLUMNS), model, "toxicity").where(F.col("toxicity") < TOXIC).select(*COLUMNS)


#: Keys of rows without a doc_id start here, above all ids.
NO_ID = 1 << 62


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.75 or more, the one with the smallest id; documents without an id count by a hash of their text, after all others. doc_id is a key: of rows that repeat one with other texts, the one whose text has the smallest SHA-256 stays."""
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2))
    keyed = docs.select(*COLUMNS, key.alias("key"))
    groups = ngram_jaccard.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    one = keyed.join(first, "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *COLUMNS)).alias("r"))
    return one.select(*(f"r.{c}" for c in COLUMNS))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars is that of the new text."""
    return pii.surrogates(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: each document as often as its source's target takes it, in order of position."""
    return mixing.sequence(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document in the sequence."""
    rows = sentencepiece_trie.encode(docs, sentencepiece_trie.MODEL, "lang", "source")
    return rows.select("doc_id", "lang", "source", F.size("tokens").alias("n_tokens"), "tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("pii", replace_private),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]
#: No SQL expresses the kernel machine, the surrogates or the tokens; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one written to the shared folder before the next reads it; what the next has read is deleted."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
            if k:
                scratch.drop(before)
    return docs
