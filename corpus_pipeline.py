"""A corpus made ready for training: quality rules, near-duplicates, repeated passages, mixing, pieces.

Each stage gets what the one before it kept, as Parquet written and read again, so that a lost executor costs a part of one
stage only. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import BLANKS
from tidegauge.llm.mixing import mix
from tidegauge.llm.pieces import encode
from tidegauge.llm.rules import accepted
from tidegauge.llm.simhash import keep_dissimilar
from tidegauge.llm.suffixes import remove_repeats
from tidegauge.session import scratch


#: Words of a shingle, and the least Jaccard similarity of near duplicates.
NEAR_WORDS, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or fall below the log-likelihood ratio's threshold go; the others stay as they are.

    Null and empty texts have too few words and go. Repeated rows are judged alike and all stay or go. Without labels all
    ratios are 0 and the base rules decide. An empty table gives an empty one; further columns, whatever their names, pass.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, labels)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays: that of the least doc_id, a null one being the largest.

    Links are pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found at the anchors of
    48 fingerprints and verified. Null and empty texts are alike; of rows alike in doc_id and text one stays; texts that share
    a doc_id are judged each by itself. An empty table gives an empty one; further columns, whatever their names, pass.
    """
    return keep_dissimilar(docs, NEAR_WORDS, SIMILARITY)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that start in a document of smaller doc_id are taken out of the texts; no document goes, unless nothing of it is left.

    Null and empty texts stay as they are. Rows of one doc_id don't take from each other, and a null doc_id is the largest.
    Long texts are judged whole. An empty table gives an empty one; further columns, whatever their names, pass.
    """
    left = remove_repeats(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row_")))
    left = left.filter((F.col("n_removed") == 0) | (F.length(F.btrim("kept_text", F.lit(BLANKS))) > 0))
    text = F.when(F.col("n_removed") == 0, F.col("row_.text")).otherwise(F.col("kept_text"))
    own = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("row_.n_chars")).otherwise(F.length("kept_text")) if "n_chars" in docs.columns else None}
    return left.select(*(own[c].cast(docs.schema[c].dataType).alias(c) if c in own else F.col(f"row_.{c}") for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each whole copy of a document and for each further block of its words.

    Null and empty texts have no words and are not taken; a null source is a source. Reruns agree, repeated rows included. An
    empty table gives an empty one; further columns, whatever their names, pass.
    """
    return mix(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's pieces under seeded merge-dropout, with the proof that they decode to the row's text; null and empty texts have none, an empty table gives an empty one. Repeated rows give a row each, very long texts are encoded whole, and other columns are left out."""
    return encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentence_pieces),
]

#: Hashes and byte strings of several stages have no counterpart in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other over documents; each stage's result is written and read again."""
    folder, docs = scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
