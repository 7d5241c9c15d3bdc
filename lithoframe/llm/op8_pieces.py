"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field; from it come the normaliser (character map, marker before the text, blanks as
markers), the piece model (unigram with scores, or BPE with merges in the order of scores) and byte fallback. As no piece
of such a model has a marker after another character, a text falls apart before blanks without changing its ids, so each
distinct part is encoded once, those of TEXT_AT_ONCE bytes of texts in one multithreaded call, and kept for the rest of the task.
With verify, every part is also encoded by the sentencepiece library, and the row says whether the two agree; the ids are
always those of the tokenizers library. Decoding is a table of bytes for each id.

The model file is read by the driver at the path that is passed, and its bytes (MAX_MODEL_BYTES at most) are sent to the
executors; nothing is trained. What a task keeps beside a batch is bounded by KEEP_PARTS parts and KEEP_CHARS characters,
and goes when the task ends.

Defined cases: null and empty texts have no ids; a text of blanks only has ids; the marker character in a text counts as a
blank, as in the original library, so decoding gives a blank for it; repeated rows are each answered; other columns are
ignored. A model whose pieces do hold a marker inside, or that has a character map, is encoded by whole texts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, small_batches, table, text_views

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KEEP_PARTS, KEEP_CHARS, GROUP = 200_000, 4_000_000, 256
MAX_MODEL_BYTES = 64 << 20
TEXT_AT_ONCE = 1 << 19  # bytes of texts that are taken apart at once; a longer text is taken alone

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers of kind 0, bytes of kinds 1, 2 and 5."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    """What the model file says."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @property
    def unk(self) -> int:
        return self.types.index(UNKNOWN)


def parse(model: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(model):
        if number == 1:
            own = dict(_fields(value))
            spec.pieces.append(own.get(1, b"").decode())
            spec.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            spec.types.append(own.get(3, NORMAL))
        elif number == 2:
            own = dict(_fields(value))
            if own.get(3, 1) not in (1, 2):
                raise ValueError("only unigram and BPE models are read")
            spec.unigram, spec.byte_fallback = own.get(3, 1) == 1, bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            spec.charsmap, spec.dummy_prefix, spec.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
    return spec


def build(spec: Spec, prefix: bool | None = None):
    """A tokenizers.Tokenizer for whole texts; with prefix=False for parts that have their marker."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    ids = {p: i for i, p in enumerate(spec.pieces)}
    if spec.unigram:
        model = models.Unigram(list(zip(spec.pieces, spec.scores, strict=True)), spec.unk, spec.byte_fallback)
    else:
        usable = {p for p, t in zip(spec.pieces, spec.types, strict=True) if t in (NORMAL, USER)}
        merges = [(p[:k], p[k:]) for p in sorted(usable, key=lambda p: (-spec.scores[ids[p]], ids[p])) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        model = models.BPE(ids, merges, unk_token=spec.pieces[spec.unk], fuse_unk=True, byte_fallback=spec.byte_fallback)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix if prefix is None else prefix:
        steps.append(normalizers.Prepend(MARK))
    out = Tokenizer(model)
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    return out


def piece_bytes(spec: Spec) -> list[bytes]:
    """The bytes that each id decodes to; control pieces have none."""
    out = []
    for p, t in zip(spec.pieces, spec.types, strict=True):
        out.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
    return out


_PART = re.compile("\n| *[^ \n]+| +")


class _Numbers(dict):
    """Numbers keys in the order they first come, and holds those that are new."""

    def __init__(self, first: dict[str, int]) -> None:
        super().__init__(first)
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = n = len(self)
        return n

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new


class Encoder:
    """Encodes lists of texts to flat ids and lengths, and decodes them."""

    def __init__(self, model: bytes, verify: bool = True) -> None:
        self.spec = parse(model)
        plain = not (self.spec.charsmap or self.spec.squeeze) and self.spec.dummy_prefix
        held = any(MARK in p.lstrip(MARK) or "\n" in p for p in self.spec.pieces)
        self.by_parts = plain and not held and "<0x0A>" in self.spec.pieces
        self.line = self.spec.pieces.index("<0x0A>") if self.by_parts else 0
        self.tokenizer = build(self.spec, prefix=False if self.by_parts else None)
        self.check = None
        if verify:
            import sentencepiece

            self.check = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = piece_bytes(self.spec)
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.byte_len = np.array([len(b) for b in table])
        self.byte_at = np.concatenate([[0], np.cumsum(self.byte_len)[:-1]])
        self.forget()

    def forget(self) -> None:
        self.known, self.held = _Numbers({"\n": 0}), 0
        self.flat, self.at, self.size, self.same, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.ones(1 << 14, bool), 1
        self.flat[0], self.size[0] = self.line, 1

    def _true(self, texts: list[str]) -> list[list[int]]:
        """The original library's ids of texts that carry their own marker: behind a line end, whose ids are dropped."""
        if not self.by_parts:
            return self.check.encode(texts, num_threads=1)
        return [ids[2:] for ids in self.check.encode(["\n" + t for t in texts], num_threads=1)]

    def encode_texts(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of each text as one, all in one call, and whether both libraries agree."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        same = np.ones(len(texts), bool)
        if self.check is not None:
            for k, true in enumerate(self._true(texts)):
                same[k] = ids[k] == true
        return ids, same

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, lengths and agreement of parts. A line end stands between them, GROUP parts at a time, as no piece holds one."""
        groups = ["\n".join([*parts[k : k + GROUP], ""]) for k in range(0, len(parts), GROUP)]
        ids, same = self.encode_texts(groups)
        flat = np.concatenate([np.asarray(x, np.int32) for x in ids])
        ends = np.flatnonzero(flat == self.line)
        return flat[flat != self.line], np.diff(ends, prepend=-1) - 1, np.repeat(same, GROUP)[: len(parts)]

    def _learn(self, parts: list[str]) -> None:
        flat, lengths, same = self.encode_parts(parts)
        base, need = len(self.known) - len(parts), len(flat)
        while self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(parts) > len(self.at):
            self.at, self.size, self.same = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size]), np.concatenate([self.same, self.same])
        self.flat[self.used : self.used + need] = flat
        self.size[base : base + len(parts)], self.same[base : base + len(parts)] = lengths, same
        self.at[base : base + len(parts)] = self.used + np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.used += need
        self.held += sum(map(len, parts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, the number of ids of each text, and whether both libraries agreed on it."""
        if not self.by_parts:
            ids, same = self.encode_texts(texts)
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64), same
        if len(self.known) > KEEP_PARTS or self.held > KEEP_CHARS:
            self.forget()
        parts, counts = [], []
        for t in texts:
            own = _PART.findall(" " + t.replace(MARK, " ")) if t else []
            counts.append(len(own))
            parts += own
        k = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        if new := self.known.take_new():
            self._learn(new)
        size, start = self.size[k], self.at[k]
        total = int(size.sum())
        ids = self.flat[np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)] if total else np.zeros(0, np.int32)
        edge = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        sums, bad = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(~self.same[k])])
        return ids, sums[edge[1:]] - sums[edge[:-1]], bad[edge[1:]] == bad[edge[:-1]]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the number of bytes of each id."""
        size = self.byte_len[ids]
        total = int(size.sum())
        return self.bytes[np.repeat(self.byte_at[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)] if total else np.zeros(0, np.uint8), size

    def decode(self, ids: np.ndarray) -> str:
        """The text of one list of ids, without the marker before it."""
        text = self.decode_flat(np.asarray(ids, np.int64))[0].tobytes()
        return (text[1:] if self.spec.dummy_prefix and text[:1] == b" " else text).decode("utf-8", "replace")


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of over {MAX_MODEL_BYTES} bytes")
    return model


_MADE: dict[tuple[int, bool], Encoder] = {}


def encoder_of(model: bytes, verify: bool) -> Encoder:
    """One encoder for each worker process and model, as a tokenizer takes long to build."""
    key = (hash(model), verify)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(model, verify)
    return _MADE[key]


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, parity, round_trip): whether both libraries agree, and whether the ids decode to the text (markers as blanks)."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, verify)
        try:
            yield from coded(encoder, batches)
        finally:
            encoder.forget()

    def coded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in text_views(batch.column(1), TEXT_AT_ONCE):
                texts = [t or "" for t in batch.column(1).slice(first, end - first).to_pylist()]
                ids, n, same = encoder.encode(texts)
                edge = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
                data, size = encoder.decode_flat(ids)
                ends = np.concatenate([[0], np.cumsum(size)])[edge]
                data = data.tobytes()
                prefix = b" " if encoder.spec.dummy_prefix else b""
                back = [data[a:b] == (prefix + t.replace(MARK, " ").encode() if t else b"") for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids, pa.int32()))  # a batch has fewer than 2^31 bytes
                yield pa.record_batch({"doc_id": batch.column(0).slice(first, end - first), "ids": lists, "n_tokens": pa.array(n.astype(np.int64)), "parity": pa.array(same), "round_trip": pa.array(back)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, parity boolean, round_trip boolean")


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, False)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array([None if x is None else encoder.decode(x) for x in batch.column(1).to_pylist()], pa.string())})

    return encoded.select("doc_id", ids_col).mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), read_model())
