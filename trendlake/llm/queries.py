"""The queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import divergence, fill_in_middle, html_crf, langid, mixing, ngram_jaccard, ogg, pii, sentence_spans, sentencepiece_trie, toxicity, vector_join, winnowing
from .common import table

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


ORACLES["op1_ngram_jaccard_join"] = ngram_jaccard.ORACLE


@query
def op5_source_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


ORACLES["op5_source_mixing"] = mixing.ORACLE


@query
def op7_embedding_range_join(spark, sf_dir):
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op7_embedding_range_join"] = vector_join.ORACLE


@query
def op10_sentence_span_dedup(spark, sf_dir):
    return sentence_spans.remove_repeats(table(spark, sf_dir, "documents"))


def _held_out(parts: int, rest: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == rest, F.lit(False))


@query
def op6_language_bitmask_filters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    filters = langid.train(docs.where(~_held_out(5, 0)).select("doc_id", "text", "lang"))
    return langid.predict(docs, filters).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


@query
def op8_ogg_media_columns(spark, sf_dir):
    return ogg.digest(ogg.media_column(table(spark, sf_dir, "documents")))


@query
def op3_subsequence_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = toxicity.score(docs, toxicity.train(docs, labels.where(~_held_out(3, 1))))
    return scores.select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_sentencepiece_trie(spark, sf_dir):
    rows = sentencepiece_trie.encode(table(spark, sf_dir, "documents"), check=True)
    return rows.select("doc_id", "n_words", F.size("tokens").alias("n_tokens"), "tokens", "round_trip")


@query
def op2_pii_surrogates(spark, sf_dir):
    rows = pii.surrogates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "text", F.col("pii.n").cast("long").alias("n_replaced"), F.array_join("pii.kinds", ",").alias("kinds"))


@query
def op4_html_block_crf(spark, sf_dir):
    return html_crf.extract(table(spark, sf_dir, "pages"))


@query
def op11_winnowing_decontamination(spark, sf_dir):
    return winnowing.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_winnowing_decontamination"] = winnowing.ORACLE


@query
def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digest(table(spark, sf_dir, "documents"))


ORACLES["op12_fill_in_middle"] = fill_in_middle.ORACLE


@query
def op13_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = divergence.ORACLE
