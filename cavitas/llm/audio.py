"""Operator 8, audio columns: lossless 8-bit samples and features as fixed-shape Arrow tensors.

A payload is stored as a WAV file of unsigned 8-bit samples at RATE. The
features come from the stored bytes: a polyphase resampler takes the samples to UP / DOWN of
the rate, overlapping windows give log-mel bands, and an energy gate with
two thresholds (on above the higher, off below the lower) gives voiced segments.
Log-mel frames are stored in patches of a fixed shape as an Arrow fixed-shape-tensor
array of half floats, with each patch's span of time, beside the spans of the voiced
segments. The digest's `feature` is computed from those stored tensors and spans.

Edge cases: a null or empty text is one padding block of 576 bytes; texts of
any length are worked through in pieces of PIECE samples, whose frames continue one
another; equal texts give equal values; repeated rows are treated each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cavitas.llm.shared import slices, stored, utf8

RATE = 8000
BLOCK = 576
#: Up- and downsampling factors and the resampler's taps per phase.
UP, DOWN, TAPS = 3, 4, 12
#: At the resampled rate: window, step, transform size, bands.
WINDOW, STEP, FFT, BANDS = 192, 96, 256, 16
#: Frames in a patch.
PATCH = 32
#: Energy gate, in dB below the loudest frame.
GATE_ON, GATE_OFF = 6.0, 12.0
#: Samples transformed at once; a multiple of DOWN * STEP.
PIECE = 1 << 18
PIECE -= PIECE % (DOWN * STEP)
#: Seconds from frame to frame.
SECONDS = STEP * DOWN / (RATE * UP)


def wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono PCM: a 44-byte header and the samples as they are."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file, chunk by chunk."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    size = struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + size]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The resampler's taps, the window and the mel filters."""
    most = max(UP, DOWN)
    n = TAPS * most + 1
    taps = np.sinc((np.arange(n) - n // 2) / most) * np.hamming(n) * UP / most
    top = RATE * UP / DOWN / 2
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), BANDS + 2) / 2595) - 1) / top * (FFT // 2)
    k = np.arange(FFT // 2 + 1)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return taps, np.hanning(WINDOW), np.maximum(0, np.minimum((k - low) / (mid - low), (high - k) / (high - mid))).T


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN of its rate: what zeros between the samples, the filter and leaving out would give.

    The output's phases go round every UP samples; each meets every UP-th tap and no zero.
    """
    taps, _, _ = _tables()
    half = len(taps) // 2
    out = np.zeros(-(-len(x) * UP // DOWN))
    edge = len(taps) // UP + DOWN
    padded = np.concatenate([np.zeros(edge), x, np.zeros(edge + DOWN)])
    for r in range(UP):
        own = out[r::UP]
        first = (r * DOWN + half) % UP
        at = edge + (r * DOWN + half - first) // UP
        for k, tap in enumerate(taps[first::UP]):
            own += tap * padded[at - k :: DOWN][: len(own)]
    return out


def log_mel(payload: bytes) -> np.ndarray:
    """Frames x bands, float32, of all the payload's samples."""
    _, window, filters = _tables()
    raw, found = np.frombuffer(payload, np.uint8), []
    margin = TAPS * max(UP, DOWN) * 2
    margin += -margin % (DOWN * STEP)
    for i in range(0, len(raw), PIECE):
        low, high = max(0, i - margin), min(len(raw), i + PIECE + margin + DOWN * WINDOW)
        y = resample((raw[low:high].astype(float) - 128) / 128)
        first = (i - low) * UP // DOWN
        frames = -(-min(PIECE, len(raw) - i) * UP // DOWN // STEP)
        need = first + (frames - 1) * STEP + WINDOW
        y = np.pad(y, (0, max(0, need - len(y))))
        view = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[first : first + (frames - 1) * STEP + 1 : STEP]
        power = np.abs(np.fft.rfft(view * window, FFT, axis=1)) ** 2
        found.append(np.log(power @ filters + 1e-6).astype(np.float32))
    return np.concatenate(found)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frames (from, to) of the voiced segments, by a gate with two thresholds."""
    db = 10 / np.log(10) * mel.astype(float).max(axis=1)
    top = db.max()
    state = np.where(db >= top - GATE_ON, 1, np.where(db < top - GATE_OFF, 0, -1))
    known = np.flatnonzero(state >= 0)
    held = np.zeros(len(state), int)
    if len(known):
        last = np.searchsorted(known, np.arange(len(state)), side="right") - 1
        held = np.where(last >= 0, state[known[np.maximum(last, 0)]], 0)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], held, [0]])))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream: one row per patch with its span in milliseconds and its tensor (PATCH, BANDS)."""
    n = -(-len(mel) // PATCH)
    data = np.zeros((n * PATCH, BANDS), np.float16)
    data[: len(mel)] = mel
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(data.reshape(n, PATCH, BANDS))
    start = np.arange(n) * PATCH * SECONDS * 1000
    end = np.minimum(start + PATCH * SECONDS * 1000, len(mel) * SECONDS * 1000)
    batch = pa.record_batch([pa.array(start), pa.array(end), tensor], names=["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = utf8(batch["text"])
        media = [wav(t + b"\xff" * (-len(t) % BLOCK if t else BLOCK)) for t in texts]
        yield pa.record_batch([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_audio(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the WAV file of the padded text."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


def frames_of(stream: bytes, n: int) -> tuple[np.ndarray, int]:
    """The n frames of a stored stream of tensors, and its number of patches."""
    table = pa.ipc.open_stream(stream).read_all()
    patches = table["log_mel"].combine_chunks().to_numpy_ndarray()
    return patches.reshape(-1, BANDS)[:n], len(patches)


SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", 1 << 20):
        rows = []
        for media in batch["media"].to_pylist():
            payload = samples_of(media)
            mel = log_mel(payload)
            spans = [{"start_s": a * SECONDS, "end_s": b * SECONDS} for a, b in segments(mel)]
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), spans, tensors(mel)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), SPANS, pa.binary()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "spans", "tensors"]
        kept = [c for c in batch.schema.names if c != "media"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*kept, *names])


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, spans array<struct<start_s: double, end_s: double>>, tensors binary"


def features(media: DataFrame) -> DataFrame:
    """For each row of media what was read back (payload, media), n_frames, spans (voiced segments) and tensors (an Arrow stream)."""
    kept = "".join(f"`{c}` {t}, " for c, t in media.dtypes if c != "media")
    return media.mapInArrow(_features, kept + FEATURES)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "tensors"):
        found = []
        for n, spans, stream in zip(*(batch[c].to_pylist() for c in ("n_frames", "spans", "tensors")), strict=True):
            frames, patches = frames_of(stream, n)
            voiced = sum(s["end_s"] - s["start_s"] for s in spans)
            found.append(f"frames={n};patches={patches}x{PATCH}x{BANDS};segments={len(spans)};voiced_s={voiced:.3f};log_mel=" + ",".join(f"{x:.2f}" for x in frames.mean(axis=0, dtype=float)))
        kept = [c for c in batch.schema.names if c not in ("n_frames", "spans", "tensors")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(found, pa.string())], names=[*kept, "feature"])


def digest(docs: DataFrame) -> DataFrame:
    """Store every text as audio and its features as tensors in the shared folder; describe both as read back, per document."""
    found = stored(features(stored(to_audio(docs), "media")), "features")
    kept = "".join(f"`{c}` {t}, " for c, t in found.dtypes if c not in ("n_frames", "spans", "tensors"))
    return found.mapInArrow(_described, kept + "feature string")
