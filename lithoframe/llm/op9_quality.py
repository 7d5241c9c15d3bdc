"""Quality classifier by co-training: a text view and a metadata view teach each other, and their calibrated scores combine.

The text view is logistic regression on hashed words and word beginnings (present or not, weighted by rarity, of unit
length) and on the strongest single ones; the metadata view is logistic regression on layout and provenance: length, lines, shares of kinds of characters, repeated
words and lines, language, source. In each round either view scores all unlabelled rows and labels those that it is surest
of, SHARE of POOL_ROWS (or of all, if those are fewer) in proportion to the classes, and they join the other view's training
rows; equal texts count once. On labelled rows held back for it, a logistic
regression on both views' outputs calibrates and combines them. Two targets are learned alike: quality and toxic.

Document frequencies of words, and mean and deviation of the metadata, are counted over all documents. Views are fitted on
TRAIN_ROWS labelled rows at most, those with the smallest hashes of their ids (a documented bound; fewer rows are all
taken), and on the rows that the views label; their features, not their texts, reach the driver. Features are taken once
and written to the shared folder, where counts, rounds and scores read them. Every document is scored, whole. What is sent
to the executors is a fixed number of weights.

Defined cases: null and empty texts are scored on features of an empty text; null metadata has a value of its own; labels
with nulls and labels without a document don't train; a document with several labels trains with each; with one class or
none in the labels every score is that class's share (0.5 without labels); repeated rows are each answered; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import PLAIN_WORD, cut, frugal, mix, small_batches, table, text_views, words_of

DIM, PLACES = 1 << 18, 64  # hashed words; hashed places of source and language
TRAIN_ROWS, POOL_ROWS = 5000, 3000
ROUNDS, SHARE, STEPS, RIDGE, WORD_RIDGE, PRIOR, CLEAR = 3, 0.05, 120, 1e-4, 3e-3, 4, 1.8
LAYOUT, STEM = 13, 6  # figures of layout; bytes of a longer word that count as a word too
TOXIC_BELOW = 0.3  # a toxic document that stays does more harm than a clean one that goes
OFTEN = (2, 3, 5)  # so many words of one stem in a text count as further words


@dataclass
class Features:
    """Hashed words of rows as a sparse matrix (row starts, columns), and dense metadata."""

    starts: np.ndarray
    words: np.ndarray
    meta: np.ndarray

    def rows(self, at: np.ndarray) -> Features:
        sizes = np.diff(self.starts)[at]
        pick = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return Features(np.concatenate([[0], np.cumsum(sizes)]), self.words[pick], self.meta[at])


_KIND = np.zeros(256, np.int64)  # 0 other, 1 letters, 2 digits, 3 separators, 4 upper case
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 4
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3


_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)


def _place(kind: str, value: str | None) -> int:
    return zlib.crc32(f"{kind}={value}".encode()) % PLACES


def extract(text: pa.Array, lang: list, source: list) -> Features:
    """Features of a batch: distinct hashed words of each row, and metadata."""
    n = len(text)
    meta = np.zeros((n, LAYOUT + PLACES), np.float32)
    words, sizes = [], np.zeros(n, np.int64)
    for first, end, data, offsets in text_views(text):
        starts, ends, hashes, at = words_of(data, offsets, PLAIN_WORD)
        count = np.diff(at)
        row = np.repeat(np.arange(end - first), count)
        longer = ends - starts > STEM
        stems = np.full(int(longer.sum()), 7, np.uint64)
        for k in range(STEM):
            stems = mix(stems + _FOLD[data[starts[longer] + k]])
        # a stem that a row has often says more than one that it has once: each of OFTEN times is a word too
        each, times = np.unique((row[longer].astype(np.uint64) << np.uint64(40)) | (stems >> np.uint64(24)), return_counts=True)
        often = [each[times >= k] ^ np.uint64(k << 8) for k in OFTEN]
        rows = [row, row[longer], *((x >> np.uint64(40)).astype(np.int64) for x in often)]
        found = [hashes, stems, *(mix(x & np.uint64((1 << 40) - 1)) for x in often)]
        pairs = np.unique(np.concatenate(rows) * DIM + (np.concatenate(found) >> np.uint64(46)).astype(np.int64))
        distinct = np.bincount(pairs // DIM, minlength=end - first)
        words.append((pairs % DIM).astype(np.int32))
        sizes[first:end] = distinct
        size = np.diff(offsets)
        byte_row = np.repeat(np.arange(end - first), size)
        kinds = np.bincount(byte_row * 5 + _KIND[data], minlength=5 * (end - first)).reshape(-1, 5)
        lines = np.bincount(byte_row[data == 10], minlength=end - first) + 1
        pipes = np.bincount(byte_row[data == 124], minlength=end - first)
        follows = np.zeros(len(hashes), bool)
        follows[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        repeats = np.bincount(row[follows], minlength=end - first)
        some, word = np.maximum(size, 1), np.maximum(count, 1)
        layout = [np.log1p(size), np.log1p(lines), np.log1p(count), *(kinds[:, k] / some for k in range(5)), distinct / word, repeats / word, pipes / word, np.log1p(size / lines), kinds[:, 0] / word]
        meta[first:end, :LAYOUT] = np.stack(layout, axis=1)
    at = np.arange(n)
    np.add.at(meta, (at, LAYOUT + np.array([_place("lang", x) for x in lang], np.int64)), 1)
    np.add.at(meta, (at, LAYOUT + np.array([_place("source", x) for x in source], np.int64)), 1)
    return Features(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(words) if words else np.zeros(0, np.int32), meta)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def descend(margin, gradient, size: int, y: np.ndarray, steps: int = STEPS, ridge: np.ndarray | float = RIDGE) -> np.ndarray:
    """Logistic regression by full-batch Adam; margin(w) and gradient(errors) are the view's products. The last weight is the intercept."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        error = (sigmoid(margin(w[:-1]) + w[-1]) - y) / len(y)
        g = np.concatenate([gradient(error) + ridge * w[:-1], [error.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class TextView:
    def __init__(self, df: np.ndarray, n: int) -> None:
        self.idf = np.where(df > 0, np.log((1 + n) / (1 + df)), np.log(1 + n)).astype(np.float32)
        self.idf[df < 3] = 0  # words that too few documents have say nothing

    def values(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(x.starts) - 1), np.diff(x.starts))
        value = self.idf[x.words]
        norm = np.sqrt(np.bincount(row, value * value, minlength=len(x.starts) - 1))
        return row, value / np.maximum(norm, 1e-9)[row]

    def evidence(self, x: Features, y: np.ndarray) -> np.ndarray:
        """Log odds of the class where a word stands against the class's share, drawn to zero as by PRIOR rows without evidence."""
        row, share = np.repeat(np.arange(len(x.starts) - 1), np.diff(x.starts)), np.clip(y.mean(), 1e-6, 1 - 1e-6)
        here, there = np.bincount(x.words, y[row], minlength=DIM), np.bincount(x.words, 1 - y[row], minlength=DIM)
        return np.where(self.idf > 0, np.log((here + PRIOR * share) / (there + PRIOR * (1 - share))) - np.log(share / (1 - share)), 0)

    def fit(self, x: Features, y: np.ndarray) -> None:
        row, value = self.values(x)
        n = len(y)
        # figures of single words are three more features; for fitting, each half's evidence comes from the other half
        extra = np.zeros((n, 3))
        for half in (0, 1):
            at, rest = np.arange(half, n, 2), np.arange(1 - half, n, 2)
            if len(rest):
                extra[at] = self.extremes(x.rows(at), self.evidence(x.rows(rest), y[rest]))
        self.odds = self.evidence(x, y)
        margin = lambda w: np.bincount(row, w[x.words] * value, minlength=n) + extra @ w[DIM:]
        self.w = descend(margin, lambda e: np.concatenate([np.bincount(x.words, e[row] * value, minlength=DIM), e @ extra]), DIM + 3, y, ridge=np.concatenate([np.full(DIM, WORD_RIDGE), np.full(3, RIDGE)]))

    def extremes(self, x: Features, odds: np.ndarray) -> np.ndarray:
        """Of each row the strongest word's evidence, the weakest one's, and the sum of what is over CLEAR."""
        out = np.zeros((len(x.starts) - 1, 3))
        some = np.flatnonzero(np.diff(x.starts))
        if len(some):
            own = odds[x.words]
            out[some, 0], out[some, 1] = np.maximum.reduceat(own, x.starts[some]), np.minimum.reduceat(own, x.starts[some])
            out[some, 2] = np.minimum(np.add.reduceat(np.where(own > CLEAR, own, 0), x.starts[some]), 50) / 5
        return out

    def score(self, x: Features) -> np.ndarray:
        row, value = self.values(x)
        return np.bincount(row, self.w[x.words] * value, minlength=len(x.starts) - 1) + self.extremes(x, self.odds) @ self.w[DIM : DIM + 3] + self.w[-1]


class MetaView:
    def __init__(self, mean: np.ndarray, std: np.ndarray) -> None:
        self.mean, self.std = mean, std + 1e-3

    def fit(self, x: Features, y: np.ndarray) -> None:
        z = self._scaled(x)
        self.w = descend(lambda w: z @ w, lambda e: e @ z, z.shape[1], y)

    def _scaled(self, x: Features) -> np.ndarray:
        z = np.clip((x.meta - self.mean) / self.std, -8, 8)
        return np.concatenate([z, z[:, :LAYOUT] ** 2 / 4], axis=1)

    def score(self, x: Features) -> np.ndarray:
        return self._scaled(x) @ self.w[:-1] + self.w[-1]


@dataclass
class Model:
    """Both views of one target and the weights that combine them; or a constant."""

    text: TextView | None
    meta: MetaView | None
    mix: np.ndarray

    def scores(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(x.starts) - 1
        if self.text is None:
            return (np.full(n, self.mix[0]),) * 3
        a, b = self.text.score(x), self.meta.score(x)
        return sigmoid(a), sigmoid(b), sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[-1])


def joined(parts: list[Features]) -> Features:
    sizes = np.concatenate([np.diff(p.starts) for p in parts])
    return Features(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p.words for p in parts]), np.concatenate([p.meta for p in parts]))


class Learner:
    """Views of one target, the labelled rows that fit them, a fifth that calibrates, and what each view taught the other."""

    def __init__(self, x: Features, y: np.ndarray, stats: Stats) -> None:
        self.share = y[0] if len(y) else 0.5
        self.views = None
        if not len(y) or y.min() == y.max():
            return
        held = np.arange(len(y)) % 5 == 4
        if not held.any() or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
            held[:] = False
        self.x, self.y = x.rows(np.flatnonzero(~held)), y[~held]
        self.check, self.check_y = (x.rows(np.flatnonzero(held)), y[held]) if held.any() else (x, y)
        self.views = [TextView(stats.df, stats.n), MetaView(stats.mean, stats.std)]
        self.taught = [[], []]  # (features, labels, keys) that each view gets from the other

    def fit(self) -> None:
        for view, own in zip(self.views or [], self.taught if self.views else [], strict=True):
            view.fit(joined([self.x, *(f for f, _, _ in own)]), np.concatenate([self.y, *(y for _, y, _ in own)]))

    def wants(self, pool: int) -> tuple[int, int]:
        """Rows of class 0 and of class 1 that a view labels in a round."""
        return int(SHARE * pool * (1 - self.y.mean())), int(SHARE * pool * self.y.mean())

    def model(self) -> Model:
        if self.views is None:
            return Model(None, None, np.array([self.share]))
        z = np.stack([v.score(self.check) for v in self.views], axis=1)
        return Model(*self.views, descend(lambda w: z @ w, lambda e: e @ z, 2, self.check_y, 400))


_FEATURES = "id long, key long, low binary, high binary, meta binary"
_WIDTH = LAYOUT + PLACES


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Rows of bytes from items of an array."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


@frugal
def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a row ascend: low has the lower 16 bits of each, high how many have each value of the upper two."""
    for batch in batches:
        x = extract(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())
        n = len(x.meta)
        row = np.repeat(np.arange(n), np.diff(x.starts))
        high = np.bincount(row * 4 + (x.words >> 16), minlength=4 * n).astype(np.int32)
        yield pa.record_batch({"id": batch.column(0), "key": batch.column(4), "low": _binary((x.words & 0xFFFF).astype(np.uint16), x.starts), "high": _binary(high, 4 * np.arange(n + 1)), "meta": _binary(x.meta, _WIDTH * np.arange(n + 1))})


def _unpacked(low: pa.Array, high: pa.Array, meta: pa.Array) -> Features:
    flat = lambda a, kind: np.frombuffer(b"".join(a.to_pylist()), kind)
    each = flat(high, np.int32)
    words = np.repeat(np.tile(np.arange(4) << 16, len(low)), each) + flat(low, np.uint16)
    return Features(np.concatenate([[0], np.cumsum(each.reshape(-1, 4).sum(axis=1))]).astype(np.int64), words, flat(meta, np.float32).reshape(-1, _WIDTH))


def features(docs: DataFrame) -> DataFrame:
    """Features of every row of docs(id, text, lang, source), and its text's hash, in the shared folder."""
    small_batches(docs)
    return cut(docs.select("id", "text", "lang", "source", F.xxhash64("text").alias("key")).mapInArrow(_feature_rows, _FEATURES), "quality-features")


@dataclass
class Stats:
    """Counts over all documents: rows, those with an id, documents of each word, mean and deviation of the metadata."""

    n: int
    named: int
    df: np.ndarray
    mean: np.ndarray
    std: np.ndarray


_UNIT = 1 << 20  # metadata is summed in integers, so sums don't depend on the order


def corpus_stats(feats: DataFrame) -> Stats:
    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 2 * _WIDTH + 2, np.int64)
        for batch in batches:
            x = _unpacked(batch.column(1), batch.column(2), batch.column(3))
            meta = x.meta.astype(np.float64)
            total[:DIM] += np.bincount(x.words, minlength=DIM)
            total[DIM : DIM + _WIDTH] += np.rint(meta * _UNIT).astype(np.int64).sum(axis=0)
            total[DIM + _WIDTH : -2] += np.rint(meta * meta * _UNIT).astype(np.int64).sum(axis=0)
            total[-2:] += batch.num_rows, batch.num_rows - batch.column(0).null_count
        some = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    got = feats.select("id", "low", "high", "meta").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # DIM rows or so at most
    total = np.zeros(DIM + 2 * _WIDTH + 2, np.int64)
    total[got["k"].to_numpy()] = got["n"].to_numpy()
    n = int(total[-2])
    mean, square = (total[DIM:-2] / _UNIT / max(1, n)).reshape(2, -1)
    return Stats(n, int(total[-1]), total[:DIM], mean, np.sqrt(np.maximum(square - mean * mean, 0)))


def surest(feats: DataFrame, learners: list[Learner], labelled: np.ndarray, pool: int) -> DataFrame:
    """Of all rows outside labelled, those that each view is surest of and the other one has not: target * 4 + view * 2 + class as g, how sure (in log odds), and the row."""
    groups = {}
    for t, learner in enumerate(learners):
        for v in (0, 1) if learner.views else ():
            had = np.concatenate([np.zeros(0, np.int64), *(k for _, _, k in learner.taught[1 - v])])
            groups |= {(t, v, label): (want, had) for label, want in enumerate(learner.wants(pool)) if want}
    shared = feats.sparkSession.sparkContext.broadcast(([x.views for x in learners], groups, labelled))
    first = lambda x: (-x[0], x[2], x[1])

    @frugal
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, groups, labelled = shared.value
        best = {g: [] for g in groups}
        for batch in batches:
            x = _unpacked(*batch.columns[2:])
            ids, keys = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            free = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & ~np.isin(ids, labelled)
            odds = {(t, v): views[t][v].score(x) for t, v in {g[:2] for g in groups}}
            for g, (want, had) in groups.items():
                sure = odds[g[:2]] if g[2] else -odds[g[:2]]
                least = best[g][-1][0] if len(best[g]) == want else np.log(9)  # 0.9 at least
                at = np.flatnonzero(free & (sure >= least) & ~np.isin(keys, had))
                if not len(at):
                    continue
                distinct, merged = set(), []
                for y in sorted(best[g] + [(float(sure[k]), int(ids[k]), int(keys[k]), *(c[int(k)].as_py() for c in batch.columns[2:])) for k in at], key=first):
                    if y[2] not in distinct:
                        distinct.add(y[2])
                        merged.append(y)
                best[g] = merged[:want]
        out = [(t * 4 + v * 2 + label, *y) for (t, v, label), found in best.items() for y in found]
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["g", "sure", "id", "key", "low", "high", "meta"])

    found = cut(feats.mapInArrow(pick, f"g int, sure double, {_FEATURES}"), "quality-surest")
    # equal texts once, by the surest of them
    each = found.groupBy("g", "key").agg(F.max(F.struct("sure", "id")).alias("m")).select("g", "key", "m.sure", "m.id")
    most = F.element_at(F.create_map(*[F.lit(x) for (t, v, label), (want, _) in groups.items() for x in (t * 4 + v * 2 + label, want)]), F.col("g")) if groups else F.lit(0)
    won = each.withColumn("rn", F.row_number().over(W.Window.partitionBy("g").orderBy(F.desc("sure"), "key"))).where(F.col("rn") <= most)
    return found.join(F.broadcast(won.select("g", "key", "id")), ["g", "key", "id"]).dropDuplicates(["g", "key"])  # at most SHARE * POOL_ROWS a view and target


def train(feats: DataFrame, labels: DataFrame) -> tuple[Model, Model]:
    """Models of quality and toxic from features and labels(id, quality, toxic)."""
    spark = feats.sparkSession
    usable = labels.where("id is not null and quality is not null and toxic is not null").select("id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("id"), "id", "quality", "toxic").limit(TRAIN_ROWS).collect()
    ids = sorted({r.id for r in chosen})
    got = feats.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "id long")), "id").toArrow().sort_by([("id", "ascending"), ("key", "ascending")])
    every = _unpacked(*(got[c] for c in ("low", "high", "meta")))
    place = {}
    for k, i in enumerate(got["id"].to_pylist()):
        place.setdefault(i, k)
    own = [r for r in chosen if r.id in place]
    x, stats = every.rows(np.array([place[r.id] for r in own], np.int64)), corpus_stats(feats)
    learners = [Learner(x, np.array([r[c] for r in own]), stats) for c in ("quality", "toxic")]
    pool = min(POOL_ROWS, stats.named - len(place))
    for r in range(ROUNDS + 1):
        for learner in learners:
            learner.fit()
        if r == ROUNDS or pool <= 0 or not any(learner.views and any(learner.wants(pool)) for learner in learners):
            break
        rows = surest(feats, learners, np.array(ids, np.int64), pool).toArrow().sort_by([("g", "ascending"), ("key", "ascending")])
        if rows.num_rows:
            found, g, keys = _unpacked(*(rows[c] for c in ("low", "high", "meta"))), rows["g"].to_numpy(), rows["key"].to_numpy()
            for k in np.unique(g):
                at = np.flatnonzero(g == k)
                learners[k // 4].taught[1 - k // 2 % 2].append((found.rows(at), np.full(len(at), float(k % 2)), keys[at]))
    return tuple(learner.model() for learner in learners)


def score(feats: DataFrame, models: tuple[Model, Model]) -> DataFrame:
    """(doc_id, quality_text, quality_meta, quality, toxic_score, keep) of every row of features."""
    shared = feats.sparkSession.sparkContext.broadcast(models)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, toxic = shared.value
        for batch in batches:
            x = _unpacked(*batch.columns[1:])
            a, b, q = quality.scores(x)
            t = toxic.scores(x)[2]
            yield pa.record_batch({"doc_id": batch.column(0), "quality_text": a, "quality_meta": b, "quality": q, "toxic": t, "keep": (q >= 0.5) & (t < TOXIC_BELOW)})

    return feats.select("id", "low", "high", "meta").mapInArrow(run, "doc_id long, quality_text double, quality_meta double, quality double, toxic double, keep boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    feats = features(rows)
    return score(feats, train(feats, labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
