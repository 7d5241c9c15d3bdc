"""Language ID: normalised TF-IDF byte n-grams, several clustered centroids per language, cosine, rejection by distance.

Texts become counts of hashed byte bigrams and trigrams within words (letters in lower case; bytes above 127 count as
letters). Document frequencies come from every training row. Centroids are fitted on PER_LANGUAGE distinct texts of each
language at most, those with the smallest hashes, by spherical k-means; each language is one group of bounded size. A text
gets the language of its nearest centroid; it is also marked as rejected if its cosine is under REJECT_BELOW, or under a
share of that in proportion for texts of fewer than FULL_GRAMS n-grams, which can't come near any centroid.

Defined cases: null texts and texts without a letter get `und`, score 0, and are rejected; so is everything if no row is
labelled. Ties go to the language that sorts first. Rows with a null language don't train. Repeated rows are each
answered. Columns of the same names as the new ones are replaced; all others may pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import frugal, small_batches, table, text_views

DIM = 4096
PER_LANGUAGE, CENTROIDS, ROUNDS = 400, 3, 10
MAX_LANGUAGES = 1000
PARTS = 64  # in which a language's texts are ranked
REJECT_BELOW, FULL_GRAMS = 0.2, 400
ROWS_AT_ONCE = 256

_FOLD = np.zeros(256, np.uint32)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams (rows, DIM) of a slice's rows."""
    rows = len(offsets) - 1
    x = np.concatenate([_FOLD[data], np.zeros(3, np.uint32)])
    n = len(data)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    same2, same3 = np.zeros(n, bool), np.zeros(n, bool)  # the gram ends within its row
    if n > 1:
        same2[:-1] = row[:-1] == row[1:]
    if n > 2:
        same3[:-2] = row[:-2] == row[2:]
    a, b, c = x[:n], x[1 : n + 1], x[2 : n + 2]
    two = same2 & ((a > 0) | (b > 0))
    three = same3 & (b > 0)
    h2 = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + np.uint32(7)) >> np.uint32(20)
    h3 = (a * np.uint32(0xC2B2AE3D) + b * np.uint32(0x27D4EB2F) + c * np.uint32(0x165667B1)) >> np.uint32(20)
    at = np.concatenate([row[two] * DIM + h2[two], row[three] * DIM + h3[three]])
    return np.bincount(at, minlength=rows * DIM).reshape(rows, DIM)


def count_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and counts, at most ROWS_AT_ONCE rows at a time."""
    for first, end, data, offsets in text_views(column):
        for k in range(0, end - first, ROWS_AT_ONCE):
            part = offsets[k : min(k + ROWS_AT_ONCE, end - first) + 1]
            yield first + k, counts_of(data[part[0] : part[-1]], part - part[0])


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]  # of each centroid, in order
    centroids: np.ndarray  # (n, DIM)
    idf: np.ndarray


@frugal
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for _, counts in count_blocks(batch.column(0)):
            df += (counts > 0).sum(axis=0)
            n += len(counts)
    yield pa.record_batch({"dim": pa.array(np.arange(-1, DIM), pa.int32()), "n": pa.array(np.concatenate([[n], df]), pa.int64())})


def clusters(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; the first centres are the mean's nearest row and then always the row farthest from all centres."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    centres = x[[int(np.argmax(x @ x.mean(axis=0)))]]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[int(np.argmin((x @ centres.T).max(axis=1)))]])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.vstack([unit(x[own == j].mean(axis=0)) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """Fit on all rows with a text and a language; the driver gets DIM counts and k centroids a language."""
    spark = labelled.sparkSession
    small_batches(labelled)
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    found = {r.dim: r.n for r in rows.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(-1, 0)
    df = np.array([found.get(i, 0) for i in range(DIM)], np.float64)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    hashed = rows.withColumn("h", F.xxhash64("text"))
    ranked = lambda df, *by: df.withColumn("rn", F.row_number().over(W.Window.partitionBy(*by).orderBy("h"))).where(F.col("rn") <= per_language)
    # a language may hold most rows, so its least hashes are found in PARTS parts first
    first = ranked(ranked(hashed.select("lang", "h").distinct().withColumn("part", F.spark_partition_id() % PARTS), "lang", "part"), "lang")
    limits = first.groupBy("lang").agg(F.max("h").alias("most")).limit(MAX_LANGUAGES + 1).collect()
    if len(limits) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not limits:
        return Model([], np.zeros((0, DIM), np.float32), idf)
    small = spark.createDataFrame([(r.lang, r.most) for r in limits], "lang string, most long")
    sample = hashed.join(F.broadcast(small), "lang").where("h <= most").drop("most").dropDuplicates(["lang", "h"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        x = np.vstack([vectors(c, idf) for _, c in count_blocks(pa.array(group["text"], pa.string()))])
        x = x[np.linalg.norm(x, axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "i": [], "v": []})
        centres = clusters(x, k).astype(np.float32)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "i": range(len(centres)), "v": [c.tobytes() for c in centres]})

    got = sorted(sample.groupBy("lang").applyInPandas(fit, "lang string, i int, v binary").collect(), key=lambda r: (r.lang, r.i))
    return Model([r.lang for r in got], np.array([np.frombuffer(r.v, np.float32) for r in got]).reshape(-1, DIM), idf)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The columns of docs named by keep (all if None), with lang_pred, score and rejected."""
    new = ["lang_pred", "score", "rejected"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # k * languages * DIM floats, with MAX_LANGUAGES checked

    @frugal
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.column(at)
            pred, score, least = np.zeros(len(text), np.int64), np.zeros(len(text)), np.zeros(len(text))
            if m.languages:
                for first, counts in count_blocks(text):
                    cosine = vectors(counts, m.idf) @ m.centroids.T
                    pred[first : first + len(counts)] = np.argmax(cosine, axis=1)
                    score[first : first + len(counts)] = np.clip(cosine.max(axis=1), 0, 1)
                    least[first : first + len(counts)] = reject_below * np.minimum(1, counts.sum(axis=1) / FULL_GRAMS)
            lettered = np.fromiter(map(has_letter, text.to_pylist()), bool, len(text)) & bool(m.languages)
            score[~lettered] = 0
            name = [m.languages[p] if ok else "und" for p, ok in zip(pred, lettered, strict=True)]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(name, pa.string()), pa.array(score), pa.array((score < least) | ~lettered)], names=[*keep, *new])

    inside = text_col in keep and docs.schema[text_col].dataType == T.StringType()  # then the text travels once
    at = keep.index(text_col) if inside else len(keep)
    return docs.select(*keep, *([] if inside else [F.col(text_col).cast("string").alias("_lf_text")])).mapInArrow(judge, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs.where("not held_out"))
    return identify(docs, model, keep=["doc_id", "held_out"])
