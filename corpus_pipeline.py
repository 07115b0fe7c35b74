"""A training-corpus pipeline over documents: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and returns rows with the columns of documents; the last returns packed
pieces.  Every stage's rows are written as Parquet to the shared folder and
read again as the next one's documents; what the stages before have written is
removed then.

Defined results, of all stages: any column may be null; texts go through as a
whole, however long; extra columns go along unchanged, whatever their names
(the last stage has columns of its own); an empty table stays empty.  What each
stage does with texts that are null or empty, ties and repeated rows is told
there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm.common import mark, release, table, written
from scanweave.llm.mixing import mixed_texts
from scanweave.llm.neardup import deduplicated
from scanweave.llm.packing import pack
from scanweave.llm.rules import filtered
from scanweave.llm.secrets import findings, redact, scan_unseen

#: SQL can't express the draws, the sketches and the packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts have fewer than 50 words, so they go.  A value
    equal to a cutoff is kept.  Repeated rows get the same verdict each; of
    several labels of one id the least counts; labels without a text, or of a
    text that the base rules reject, have no part in the cutoffs.
    """
    return filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near duplicates (five-word shingles, similarity of 0.8 or more).

    Texts without words are near nothing and stay, repeated or not; repeated
    rows with words are near duplicates of each other, so one stays; rows
    without an id are compared like others and stay only in groups without any
    id; of equal ids one row stays.
    """
    return deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars counts anew.

    A null text stays null, an empty one empty; secrets that overlap are one
    mark; repeated rows are marked each, their text is scanned once.
    """
    spans = findings(docs, scan_unseen(docs, "doc_id", "text"), "doc_id", "text")
    return redact(docs, spans).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix to target weights reads of each document: a row for each round that reads some of it, with n_chars anew.

    Texts without words are read 0 times, so they go; the null source is a
    source, the last one; repeated rows are documents each; at most three rows
    come of one.
    """
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its ids and its place in a sequence.

    A null or empty text is a piece of its end id alone; repeated rows, and the
    rows of one document's rounds, are packed each; among pieces of equal length
    it doesn't matter which goes where.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents.  The tables that the last stage reads stay until release() is called."""
    docs, first = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, first, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
