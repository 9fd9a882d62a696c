"""The training corpus: junk out, one document of each near-duplicate group, mixed to target weights, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import mixing, ngram_join, piece_transducer, quality_cnn
from tallyloom.llm.common import stored, table
from tallyloom.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, mix_levels, vocabulary

SHARE = (4, 5)
WORDS, PERCENT = 5, 80  # near duplicates: runs of so many words, and their least Jaccard similarity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is scored as padding and goes or stays by its score; long texts are scored whole; equal texts
    fare alike, so repeated rows go or stay together, as do rows without a doc_id by their text.  Without labels of
    both kinds nothing goes.  All columns stay, whatever their names; an empty table stays empty.
    """
    return quality_cnn.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id.

    Texts of under five words link with equal ones; null and empty texts, and texts without words, with nothing, and
    stay.  Of repeated rows one stays.  Texts of any length are compared whole.  All columns stay.
    """
    return ngram_join.keep_one(docs, width=WORDS, percent=PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in target proportions; one that comes for several epochs is as many rows.

    Null and empty texts have no tokens and come along with the prefix that reaches them; a null language or source
    counts as one of its own; rows of one doc_id (or without one) come or go together.  Columns of the stage's own are
    gone again, so all others stay as they were.
    """
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, share=SHARE, epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixing.repeated(mixed, docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of each row, in no order; a null or empty text has no ids, repeated rows repeat, and long texts are
    encoded whole.  Other columns end here."""
    return piece_transducer.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mixture),
    ("SentencePiece encoding", encoding),
]

# A trained classifier and a transducer are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
