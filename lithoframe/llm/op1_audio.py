"""Media columns: a row's bytes as 8-bit audio, with polyphase resampling, log-mel frames and energy segments.

The stored form is a mono WAV file of unsigned 8-bit samples, which holds the bytes as they are. Features are read from
the stored bytes: a rational polyphase resampler, overlapping windowed frames, a mel filterbank in decibels, and segments
found by a two-threshold (hysteresis) rule on frame energy. Log-mel frames are packed into fixed-shape Arrow tensors of
TENSOR_FRAMES x MELS, each with its time span, as an Arrow IPC stream; a row's feature is computed from that stream, read
back. Frames are made in blocks of BLOCK frames, and a batch of results goes on at OUT_BYTES, so memory doesn't follow the
length of a text beyond a small multiple of its own bytes.

Defined cases: a null or empty text is one unit of padding; equal texts give equal values whatever stands around them;
rows are independent, so ties and repeated rows are each answered; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, small_batches, table

UNIT, FILL = 576, 255
RATE, UP, DOWN = 16_000, 2, 3
FRAME, HOP, MELS = 256, 128, 32
TENSOR_FRAMES, BLOCK, OUT_BYTES = 16, 2048, 8 << 20
HEAR_DB, LOSE_DB = 1.5, -1.5
TAPS = 12  # for each phase


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of unsigned 8-bit mono samples."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(payload), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of such a file; the chunks are walked, not assumed."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def low_pass(up: int, down: int) -> np.ndarray:
    """Windowed-sinc taps, one row for each phase; each row sums to one."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    phases = h.reshape(TAPS, up).T
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, first: int, end: int, up: int = 1, down: int = 2) -> np.ndarray:
    """Samples first to end of x at up/down times its rate; only the needed inputs are touched, and x counts as zero outside."""
    out = np.zeros(end - first, np.float32)
    taps = low_pass(up, down)
    for phase in range(up):
        n = np.arange(first, end)
        pick = np.flatnonzero(n * down % up == phase)
        if not len(pick):
            continue
        centre = n[pick] * down // up + TAPS // 2
        lo, hi = int(centre[0]) - TAPS + 1, int(centre[-1]) + 1
        part = np.zeros(hi - lo, np.float32)
        a, b = max(lo, 0), min(hi, len(x))
        if a < b:
            part[a - lo : b - lo] = x[a:b]
        step, total = down, np.zeros(len(pick), np.float32)
        for k in range(TAPS):
            at = TAPS - 1 - k
            total += taps[phase, k] * part[at : at + step * (len(pick) - 1) + 1 : step]
        out[pick] = total
    return out


@lru_cache
def mel_bank(rate: int, frame: int, mels: int) -> np.ndarray:
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    rise = (bins[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-mel frames (n, MELS), each frame's energy in decibels, and the seconds from one frame to the next."""
    x = np.frombuffer(samples, np.uint8)
    n = -(-len(x) * UP // DOWN)
    frames = 1 + max(0, -(-(n - FRAME) // HOP))
    bank, window = mel_bank(rate * UP // DOWN, FRAME, MELS), np.hanning(FRAME).astype(np.float32)
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    centred = (x.astype(np.float32) - 128) / 128
    for f in range(0, frames, BLOCK):
        e = min(frames, f + BLOCK)
        y = resample(centred, f * HOP, (e - 1) * HOP + FRAME, UP, DOWN)
        each = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(each, axis=1)).astype(np.float32) ** 2
        mels[f:e] = 10 * np.log10(power @ bank + 1e-6)
        energy[f:e] = 10 * np.log10((each * each).mean(axis=1) + 1e-9)
    return mels, energy, HOP * DOWN / (rate * UP)


def segments(energy: np.ndarray) -> np.ndarray:
    """Frames [start, end) of runs that stay above the lower threshold and reach the upper one at least once; thresholds stand around the median."""
    middle = np.median(energy)
    held = np.concatenate([[False], energy >= middle + LOSE_DB, [False]])
    edges = np.flatnonzero(held[1:] != held[:-1]).reshape(-1, 2)
    if not len(edges):
        return edges
    heard = np.concatenate([[0], np.cumsum(energy >= middle + HEAR_DB)])
    return edges[heard[edges[:, 1]] > heard[edges[:, 0]]]


def tensors(mels: np.ndarray, seconds: float) -> bytes:
    """An Arrow IPC stream of (start_s, end_s, tensor); the last tensor is filled up with -60 dB."""
    n = -(-len(mels) // TENSOR_FRAMES)
    full = np.full((n * TENSOR_FRAMES, MELS), -60, np.float32)
    full[: len(mels)] = mels
    values = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR_FRAMES, MELS))
    start = np.arange(n) * TENSOR_FRAMES * seconds
    end = np.minimum((np.arange(n) + 1) * TENSOR_FRAMES, len(mels)) * seconds
    batch = pa.record_batch({"start_s": start, "end_s": end, "tensor": values})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(n, TENSOR_FRAMES, MELS) values and (n, 2) time spans of such a stream."""
    got = pa.ipc.open_stream(pa.py_buffer(stream)).read_all().combine_chunks()
    return got.column("tensor").combine_chunks().to_numpy_ndarray(), np.stack([got.column("start_s").to_numpy(), got.column("end_s").to_numpy()], axis=1)


def describe(text: bytes) -> dict:
    """Everything about one row, from its stored forms."""
    padded = text + bytes([FILL]) * (-len(text) % UNIT or UNIT * (not text))
    media = to_wav(padded)
    payload, rate = from_wav(media)
    mels, energy, seconds = log_mel(payload, rate)
    frames, stream = len(mels), tensors(mels, seconds)
    spans = segments(energy)
    del mels, energy
    values, times = read_tensors(stream)
    means = ",".join(f"{v + 0.0:.1f}" for v in np.round(values.reshape(-1, MELS)[:frames].mean(axis=0, dtype=np.float64), 1))
    return {
        "n_bytes": len(text), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"frames={frames};tensors={len(values)};seconds={times[-1, 1]:.3f};segments={len(spans)};held={int((spans[:, 1] - spans[:, 0]).sum())};mel={means}",
        "n_frames": frames, "n_segments": len(spans), "media": media, "tensors": stream, "segments": [{"start_s": a * seconds, "end_s": b * seconds} for a, b in spans.tolist()],
    }


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long, "
    "media binary, tensors binary, segments array<struct<start_s: double, end_s: double>>"
)
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
_ARROW = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in MEDIA_SCHEMA.split(", ")[:12]] + [("segments", _SPANS)])


@frugal
def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            rows.append({"doc_id": doc_id.as_py()} | describe((text.as_py() or "").encode()))
            held += len(rows[-1]["media"]) + len(rows[-1]["tensors"])
            if held > OUT_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def audio_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: digests, the WAV file, the tensors and the segments."""
    small_batches(docs)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_run, MEDIA_SCHEMA)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests, with those of the tensors and the segments' time spans; media and tensors themselves stay in the operator's output."""
    found = audio_media(table(spark, sf_dir, "documents"))
    span = lambda x: F.format_string("%.3f-%.3f", x["start_s"], x["end_s"])
    new = {"tensor_bytes": F.length("tensors").cast("long"), "tensor_sha256": F.sha2("tensors", 256), "time_spans": F.array_join(F.transform("segments", span), ",")}
    return found.withColumns(new).drop("media", "tensors", "segments")
