"""Media columns: audio features of samples stored losslessly as 8-bit WAV.

The stored bytes are parsed back; the samples pass a polyphase resampler (12 kHz to 8 kHz), overlapped Hann frames, a log-mel
filterbank and an energy segmentation with hysteresis. Each segment becomes a fixed-shape tensor (slots x bands) with a time
span; tensors are kept as an Arrow IPC stream whose column has the fixed-shape tensor type. A clip is resampled and framed in
blocks of ``BLOCK`` frames; what grows with its length is the resampled signal (some 3 bytes a byte) and the frames' bands.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches

RATE_IN, RATE, UP, DOWN = 12_000, 8_000, 2, 3
PAD_TO, PAD_BYTE = 192, b"\x20"
TAPS = 24  # a phase of the resampling filter
FRAME, HOP, BANDS, SLOTS = 256, 128, 24, 4
BLOCK = 512
#: Segmentation: a segment opens above the clip's mean energy plus ENTER_DB and closes below it plus LEAVE_DB.
ENTER_DB, LEAVE_DB, LEAST_FRAMES = 0.5, -0.5, 8


def wav_bytes(payload: bytes, rate: int = RATE_IN) -> bytes:
    """Mono 8-bit PCM; a sample is a byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(payload) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) % 2)


def wav_payload(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _polyphase() -> np.ndarray:
    """(UP, TAPS) windowed-sinc low-pass, each phase of unit gain."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(UP * TAPS)
    phases = h.reshape(TAPS, UP).T[:, ::-1]
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def _mel() -> np.ndarray:
    """(FRAME // 2 + 1, BANDS) triangles, even in mel."""
    mel = np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), BANDS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(FRAME // 2 + 1)[:, None] * RATE / FRAME
    up, down = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


PHASES, MEL, HANN = _polyphase(), _mel(), np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """8-bit samples at RATE_IN as RATE, between -1 and 1: output n * UP + p is phase p of the filter over the input that ends there."""
    n = -(-len(x) * UP // DOWN)
    out = np.empty(n, dtype=np.float32)
    silence = np.full(TAPS // 2 + DOWN, 128, np.uint8)
    padded = np.concatenate([silence[DOWN:], x, silence])
    size = BLOCK * HOP // UP * UP
    for at in range(0, n, size):
        stop = min(n, at + size)
        first = at * DOWN // UP
        part = (padded[first : (stop - 1) * DOWN // UP + TAPS].astype(np.float32) - 128) / 128
        windows = np.lib.stride_tricks.sliding_window_view(part, TAPS)
        for p in range(UP):  # output m lies at input m * DOWN / UP
            m = np.arange(at + p, stop, UP)
            out[at + p : stop : UP] = windows[m * DOWN // UP - first] @ PHASES[(p * DOWN) % UP]
    return out


def log_mel(y: np.ndarray) -> np.ndarray:
    """(frames, BANDS); a clip shorter than a frame is padded with silence."""
    if len(y) < FRAME:
        y = np.pad(y, (0, FRAME - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), BANDS), dtype=np.float32)
    for i in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[i : i + BLOCK] * HANN, axis=1)) ** 2
        out[i : i + BLOCK] = np.log10(power.astype(np.float32) @ MEL + 1e-6)
    return out


def segments(energy_db: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [start, end): opened above the upper, closed below the lower threshold, at least LEAST_FRAMES long.

    A clip in which none opens is one segment.
    """
    mean = float(energy_db.mean())
    state = np.where(energy_db > mean + ENTER_DB, 1, np.where(energy_db < mean + LEAVE_DB, -1, 0))
    known = np.flatnonzero(state)
    held = np.zeros(len(state), dtype=bool)
    if len(known):
        last = np.searchsorted(known, np.arange(len(state)), side="right") - 1
        held = (last >= 0) & (state[known[np.maximum(last, 0)]] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], held.astype(np.int8), [0]])))
    spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= LEAST_FRAMES]
    return spans or [(0, len(state))]


def pooled(mel: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """(segments, SLOTS, BANDS): means over SLOTS equal parts of each segment, rounded to 1/64 so that sums' order can't show."""
    total = np.concatenate([np.zeros((1, mel.shape[1])), np.cumsum(mel, axis=0, dtype=np.float64)])
    cuts = np.array([[a + (b - a) * k // SLOTS for k in range(SLOTS + 1)] for a, b in spans])
    lo, hi = cuts[:, :-1], np.maximum(cuts[:, 1:], cuts[:, :-1] + 1)
    hi = np.minimum(hi, len(mel))
    lo = np.minimum(lo, hi - 1)
    return (np.round((total[hi] - total[lo]) / (hi - lo)[..., None] * 64) / 64).astype(np.float32)


def tensor_stream(tensors: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """Arrow IPC: start_s, end_s and a fixed-shape tensor column."""
    second = HOP / RATE
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))
    batch = pa.record_batch({"start_s": [a * second for a, _ in spans], "end_s": [b * second for _, b in spans], "log_mel": column})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def features(payload: bytes) -> tuple[list[tuple[int, int]], np.ndarray]:
    mel = log_mel(resample(np.frombuffer(payload, np.uint8)))
    spans = segments(10 * np.log10((10.0 ** mel.astype(np.float64)).sum(axis=1)))
    return spans, pooled(mel, spans)


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_segments int, seconds double, tensors binary"
)


def _clip(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + PAD_BYTE * ((-len(raw)) % PAD_TO if raw else PAD_TO)
    media = wav_bytes(payload)
    back = wav_payload(media)
    spans, tensors = features(back)
    mean = tensors.mean(axis=(0, 1), dtype=np.float64)
    told = f"{len(spans)}:{hashlib.sha256(tensors.tobytes()).hexdigest()[:16]}:" + ",".join(f"{v:.2f}" for v in mean[:: BANDS // 6])
    return (
        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(),
        told, len(spans), len(back) / RATE_IN, tensor_stream(tensors, spans),
    )


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.binary()]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows = [_clip(x.as_py()) for x in part.column(1)]
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names=names)


def audio_features(docs: DataFrame) -> DataFrame:
    """One row a document: what is stored of its bytes as sound, and the features read back from there.

    A null or empty text is one block of padding. Rows with a null doc_id or repeated rows stay as they are; other columns of
    ``docs`` are left out. ``tensors`` is the Arrow stream of the segments. Equal texts give equal values.
    """
    return bounded_batches(docs).select("doc_id", "text").mapInArrow(_clips, SCHEMA)
