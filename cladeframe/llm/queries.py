"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, fill_in_middle, html_text, language_id, quality, sentencepiece_scan, simhash, spelling, toxicity
from .common import crc_mod, table
from .mixing import op5_proportional_fitting, op5_sql
from .secrets import op10_random_forest
from .warc import OP1_SQL, op1_revisit_resolution

NAMES = ["op1_revisit_resolution", "op2_error_correcting_codes", "op3_recurrent_toxicity", "op4_stable_projections", "op5_proportional_fitting", "op6_simhash_ball", "op7_tree_scoring", "op8_max_plus_scan", "op9_projection_forest", "op10_random_forest", "op11_naive_bayes_svm", "op12_learned_rank_index", "op13_bit_sliced_index"]

SQL = {"op1_revisit_resolution": OP1_SQL, "op5_proportional_fitting": op5_sql(), "op12_learned_rank_index": fill_in_middle.OP12_SQL}


def op2_error_correcting_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, crc_mod("doc_id", 5) != 0, "text", "lang")
    found = language_id.predict(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    found = toxicity.score(docs, net)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, words=3)


def op7_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_max_plus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part of a document (ordinary documents have one): ids, their count and hash, and the round trip."""
    docs = table(spark, sf_dir, "documents")
    parts = sentencepiece_scan.encode(docs, sentencepiece_scan.load_model(spark))
    return parts.select("doc_id", "part", "ids", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "n_chars", "exact")


def op9_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    found = quality.score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op12_learned_rank_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"))


def op13_bit_sliced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))
