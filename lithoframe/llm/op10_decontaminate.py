"""Benchmark decontamination: rare n-gram seeds find passages near test items, Smith-Waterman alignment scores them.

Words are runs of letters and digits in lower case. Every item's SEED_WORDS-grams (a shorter item: all of its words) are
counted over all documents. Where a document holds a gram of an item, a window of the item's length on either side is cut
around it; windows of one item that overlap are joined. An item's seeds are its grams that occur in RARE_DOCS documents or
fewer, and in any case the rarer half of those that occur at all. Windows with a seed are aligned with the item (match,
mismatch and gap scores below). So are those that hold frequent grams only, unless too few of the item's words stand in
them for any alignment to reach MIN_SCORE and MIN_WORDS; so counts decide on the work, never on the result. The score is
the alignment's over that of the item with itself. A document is contaminated by an item at MIN_SCORE or more, if
MIN_WORDS words match or the whole item does.

Items are taken in blocks of a bounded number of items and words, and a block is what is sent to the executors; each block
is held against all documents. There is no shuffle but that of the counts. Alignment runs on 64-bit word hashes.

Defined cases: null or empty items and items without a word match nothing; null or empty documents are clean; equal items
are each reported; repeated documents are each answered; other columns pass through decontaminate unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN_WORD, frugal, shingles_of, small_batches, table, text_views, words_of

SEED_WORDS, RARE_DOCS = 4, 20
MATCH, MISMATCH, GAP = 2.0, -1.0, -1.5
MIN_SCORE, MIN_WORDS = 0.5, 8
BLOCK_ITEMS, BLOCK_WORDS = 5000, 1_000_000
CELLS = 2_000_000  # cells of alignment matrices held at once
PAIRS = 200_000  # pairs of a gram in a slice and its place in an item held at once; one row's go together

_BITS = 20


@dataclass
class Block:
    """Items as word hashes, and their grams: sorted hashes with the item and the place of each; all words, sorted."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    vocabulary: np.ndarray

    def distinct(self) -> np.ndarray:
        return np.unique(self.grams)

    def lengths(self) -> list[int]:
        return sorted({min(SEED_WORDS, len(w)) for w in self.words})


def item_words(text: str) -> np.ndarray:
    for _, _, data, offsets in text_views(pa.array([text], pa.string())):
        return words_of(data, offsets, PLAIN_WORD)[2]
    return np.zeros(0, np.uint64)


def make_block(items: list[tuple[int, np.ndarray]]) -> Block:
    grams = [shingles_of(w, SEED_WORDS) for _, w in items]
    flat = np.concatenate(grams)
    item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(flat, kind="stable")
    return Block([i for i, _ in items], [w for _, w in items], flat[order], item[order], place[order], np.unique(np.concatenate([w for _, w in items])))


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    held, words = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        own = item_words(row.t)
        if not len(own):
            continue
        if held and (len(held) >= BLOCK_ITEMS or words + len(own) > BLOCK_WORDS):
            yield make_block(held)
            held, words = [], 0
        held.append((row.i, own))
        words += len(own)
    if held:
        yield make_block(held)


class Sieve:
    """Whether 64-bit hashes are among given ones: a bitmap first, then a binary search on what passes."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that are among the keys, and which key each is."""
        near = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[near]), max(len(self.keys) - 1, 0))
        good = self.keys[at] == hashes[near] if len(self.keys) else np.zeros(0, bool)
        return near[good], at[good]


def seed_hits(data: np.ndarray, offsets: np.ndarray, sieve: Sieve, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: word hashes, rows' first words, and the row, word and key of every gram that the sieve has."""
    _, _, hashes, first = words_of(data, offsets, PLAIN_WORD)
    rows, places, keys = [], [], []
    for size in lengths:
        if len(hashes) < size:
            continue
        at, key = sieve.find(shingles_of(hashes, size))  # over the whole slice; those across rows go next
        row = np.searchsorted(first, at, side="right") - 1
        own = at + size <= first[row + 1] if len(at) else np.zeros(0, bool)
        rows.append(row[own])
        places.append(at[own])
        keys.append(key[own])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return hashes, first, join(rows), join(places), join(keys)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman over pairs of word sequences: best score over the item's own, and words matched on the best path.

    All pairs go row by row together; the gaps along a row come from a running maximum.
    """
    n, m, w = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((n, m), np.uint64), np.zeros((n, w), np.uint64)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    size, wide = np.array([len(x) for x in items]), np.array([len(y) for y in windows])
    inside = np.arange(w) < wide[:, None]
    # the matched words ride along below the score
    scale = 1 << 20
    match, mismatch, gap = (np.int64(2 * x * scale) for x in (MATCH, MISMATCH, GAP))
    ramp = gap * np.arange(w)
    up = np.zeros((n, w), np.int64)
    best = np.zeros(n, np.int64)
    for i in range(m):
        live = i < size
        same = (a[:, i, None] == b) & inside
        diagonal = np.zeros((n, w), np.int64)
        diagonal[:, 1:] = up[:, :-1]
        h = np.maximum(np.maximum(diagonal + np.where(same, match + 1, mismatch), up + gap), 0)
        h = np.maximum(h, np.maximum.accumulate(h - ramp, axis=1) + ramp)
        h = np.where(live[:, None] & inside, h, 0)
        best = np.maximum(best, h.max(axis=1))
        up = h
    return best // scale / 2 / (MATCH * size), best % scale


def passages(row: np.ndarray, place: np.ndarray, key: np.ndarray, first: np.ndarray, block: Block, sieve: Sieve, seed: np.ndarray) -> np.ndarray:
    """Windows (row, item, start word, end word, whether a seed is in it) around grams; overlapping ones of the same row and item are joined."""
    lo, hi = np.searchsorted(block.grams, sieve.keys[key]), np.searchsorted(block.grams, sieve.keys[key], side="right")
    times = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    row, place, item, seeded = np.repeat(row, times), np.repeat(place, times), block.item[at], np.repeat(seed[key], times)
    size = np.array([len(w) for w in block.words])[item]
    start = np.maximum(place - block.place[at] - size // 2 - 2, first[row])
    end = np.minimum(place - block.place[at] + size + size // 2 + 2, first[row + 1])
    order = np.lexsort((start, item, row))
    row, item, start, end = row[order], item[order], start[order], end[order]
    new = np.ones(len(row), bool)
    same = (row[1:] == row[:-1]) & (item[1:] == item[:-1])
    groups = np.concatenate([[0], np.cumsum(~same)])
    wide = int(end.max()) + 1 if len(end) else 1
    reach = np.maximum.accumulate(end + groups * wide) - groups * wide  # the farthest end so far within the row and item
    new[1:] = ~same | (start[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return np.stack([row[heads], item[heads], start[heads], np.maximum.reduceat(end, heads), np.logical_or.reduceat(seeded[order], heads)], axis=1) if len(heads) else np.zeros((0, 5), np.int64)


def possible(found: np.ndarray, hashes: np.ndarray, block: Block) -> np.ndarray:
    """Whether a window can score at all: as many of the item's words as MIN_SCORE and MIN_WORDS ask for stand in it."""
    out = np.zeros(len(found), bool)
    at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    held = np.flatnonzero(block.vocabulary[at] == hashes)
    wide = len(hashes) + 1
    stands = np.concatenate([np.sort(at[held] * wide + held), [np.iinfo(np.int64).max]])
    sizes = np.array([len(block.words[i]) for i in found[:, 1]])
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1
    for part in np.split(np.arange(len(found)), cuts):
        n = sizes[part]
        words = np.searchsorted(block.vocabulary, np.concatenate([block.words[i] for i in found[part, 1]]))
        start, end = np.repeat(found[part, 2], n), np.repeat(found[part, 3], n)
        inside = stands[np.searchsorted(stands, words * wide + start)] < words * wide + end
        same = np.add.reduceat(inside.astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        out[part] = (same >= MIN_SCORE * n) & (same >= np.minimum(MIN_WORDS, n))
    return out


def candidates(row: np.ndarray, place: np.ndarray, key: np.ndarray, hashes: np.ndarray, first: np.ndarray, block: Block, sieve: Sieve, seed: np.ndarray) -> np.ndarray:
    """Windows of a slice that are to be aligned, rows with PAIRS pairs or so at a time."""
    order = np.argsort(row, kind="stable")
    row, place, key = row[order], place[order], key[order]
    times = np.searchsorted(block.grams, sieve.keys[key], side="right") - np.searchsorted(block.grams, sieve.keys[key])
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    before = (np.cumsum(times) - times)[heads]
    cuts = heads[1:][np.diff(before // PAIRS) > 0]
    parts = []
    for part in np.split(np.arange(len(row)), cuts):
        found = passages(row[part], place[part], key[part], first, block, sieve, seed)
        frequent = np.flatnonzero(found[:, 4] == 0)
        keep = np.ones(len(found), bool)
        if len(frequent):
            keep[frequent] = possible(found[frequent], hashes, block)
        parts.append(found[keep])
    return np.concatenate(parts)


def judge(column: pa.Array, block: Block, sieve: Sieve, seed: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item, score, matched words, window's first word and end in the row) of every contaminated pair.

    sieve holds all grams of the block; seed says of each whether it is a seed.
    """
    lengths = block.lengths()
    for offset, _, data, offsets in text_views(column):
        hashes, first, row, place, key = seed_hits(data, offsets, sieve, lengths)
        if not len(row):
            continue
        found = candidates(row, place, key, hashes, first, block, sieve, seed)
        found = found[np.argsort(found[:, 3] - found[:, 2], kind="stable")]
        k = 0
        best: dict[tuple[int, int], tuple] = {}
        while k < len(found):
            # windows of like width go together, as many as CELLS allows
            width = found[k, 3] - found[k, 2]
            n = max(1, min(len(found) - k, int(CELLS // max(width * 2, 1)), int(np.searchsorted(found[k:, 3] - found[k:, 2], 2 * width + 16, side="right"))))
            part = found[k : k + n]
            score, matched = align([block.words[i] for i in part[:, 1]], [hashes[s:e] for s, e in part[:, 2:4]])
            for (r, i, s, e), x, m in zip(part[:, :4].tolist(), score.tolist(), matched.tolist(), strict=True):
                if x >= MIN_SCORE and m >= min(MIN_WORDS, len(block.words[i])) and (x, m) > best.get((r, i), (0, 0))[:2]:
                    best[r, i] = (x, m, s - int(first[r]), e - int(first[r]))
            k += n
        for (r, i), (x, m, s, e) in sorted(best.items()):
            yield offset + r, i, x, m, s, e


def _counted(docs: DataFrame, block: Block) -> np.ndarray:
    """Documents that hold each distinct gram of the block, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_ITEMS and BLOCK_WORDS bound it

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, lengths = Sieve(shared.value.grams), shared.value.lengths()
        total = np.zeros(len(sieve.keys), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_views(batch.column(0)):
                _, _, row, _, key = seed_hits(data, offsets, sieve, lengths)
                pairs = np.unique(row * len(sieve.keys) + key)
                total += np.bincount(pairs % len(sieve.keys), minlength=len(total)) if len(pairs) else 0
        some = np.flatnonzero(total)
        yield pa.record_batch({"k": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    small_batches(docs)
    out = np.zeros(len(block.distinct()), np.int64)
    for r in docs.select(F.col("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


def rare(block: Block, counts: np.ndarray) -> np.ndarray:
    """The block's seeds: rare grams, and of each item the rarer half of those that any document holds."""
    n = counts[np.searchsorted(block.distinct(), block.grams)]
    live = np.flatnonzero(n)
    order = live[np.lexsort((n[live], block.item[live]))]
    sizes = np.bincount(block.item[live], minlength=len(block.ids))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    middle = np.zeros(len(block.ids), np.int64)
    some = np.flatnonzero(sizes)
    middle[some] = n[order][starts[some] + (sizes[some] - 1) // 2]
    return block.grams[(n <= RARE_DOCS) | (n <= middle[block.item])]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, matched_words, from_word, to_word) of every pair of a document and an item that it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, matched_words long, from_word long, to_word long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast((block, rare(block, _counted(rows, block))))

        @frugal
        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, seeds = shared.value
            sieve = Sieve(block.grams)
            seed = np.isin(sieve.keys, seeds)
            for batch in batches:
                got = list(judge(batch.column(1), block, sieve, seed))
                take = lambda k, got=got: [x[k] for x in got]
                yield pa.record_batch({
                    "doc_id": batch.column(0).take(pa.array(take(0), pa.int64())), "item_id": pa.array([block.ids[i] for i in take(1)], pa.int64()), "score": pa.array(take(2), pa.float64()),
                    "matched_words": pa.array(take(3), pa.int64()), "from_word": pa.array(take(4), pa.int64()), "to_word": pa.array(take(5), pa.int64()),
                })

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    out = docs
    for block in blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast((block, rare(block, _counted(rows, block))))

        @frugal
        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, seeds = shared.value
            sieve = Sieve(block.grams)
            seed = np.isin(sieve.keys, seeds)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in judge(batch.column(at), block, sieve, seed)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
