"""A corpus pipeline of five operators over documents: each stage works on all rows that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm import op2_jaccard, op4_lines, op7_language, op8_pieces, op10_decontaminate
from lithoframe.llm.common import cut, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's centroids are near go; so do null texts and texts without a letter."""
    model = op7_language.train(docs.where(~op7_language.held_out()))
    return op7_language.identify(docs, model).where("not rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from texts (n_chars follows); a document goes if all its lines stand in others."""
    done = op4_lines.dedup_lines(docs)
    done = done.where("n_removed_lines = 0 or n_removed_lines < n_lines")
    return done.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays, once; rows with a null id stay."""
    found = op2_jaccard.near_duplicates(docs)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or edited, go."""
    return op10_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with parity and round trip checked."""
    return op8_pieces.encode(docs, op8_pieces.read_model())


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", pieces),
]

#: Centroids, sketches, alignment and tokenization are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
