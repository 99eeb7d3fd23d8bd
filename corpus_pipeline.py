"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are masked, sources
are mixed to target weights, and what remains is encoded to tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeframe.llm import mixing, secrets, sentencepiece_scan, shingle_join, toxicity
from cladeframe.llm.common import crc_mod, cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the recurrent network scores below 0.7; it learns from labelled rows outside the held-out fold.

    Null and wordless texts stay, and so do all documents where there are no labels of both kinds. Whole texts are scored,
    equal texts alike; repeated rows stay repeated. Columns are unchanged, whatever their names; an empty table stays empty.
    """
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return toxicity.keep_clean(docs, net, least=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked by SimHash (2 bits) or five-word similarity of 0.8 or more.

    Null and wordless texts are copies of each other. Rows without an id stay, as do rows that repeat a kept id and text.
    Columns are unchanged, whatever their names; an empty table stays empty.
    """
    return shingle_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in whole texts and n_chars brought up to date where a text changed.

    Null and empty texts stay as they are; repeated rows are masked alike. An empty table stays empty.
    """
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target shares of tokens.

    Null sources and languages count as `unknown`; documents without tokens share their cell's fate; rows of one id share
    one fate. Columns are unchanged, whatever their names; an empty table stays empty.
    """
    return mixing.keep_sampled(docs, exact=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per part of every document: ids of its pieces, their characters, and whether they decode to its very text.

    Null and empty texts give one part without ids; repeated rows are repeated. An empty table gives an empty result.
    """
    return sentencepiece_scan.encode(docs, sentencepiece_scan.load_model(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]
ORACLE_SQL = None  # the network, the forest and the encoder have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
