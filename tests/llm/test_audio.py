from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from emulsion.llm import audio
from pyspark.sql import functions as F

from . import corpus


def test_payload_survives_and_wave_reads_it():
    for raw in (b"", b"a", bytes(range(256)) * 3, b"x" * 192):
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        media = audio.wav_bytes(payload)
        assert audio.wav_payload(media) == payload
        with wave.open(io.BytesIO(media)) as w:
            assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == payload


def test_resampler_matches_direct_sum(monkeypatch):
    raw = np.random.default_rng(0).integers(0, 256, 192 * 3).astype(np.uint8)
    x = (raw.astype(float) - 128) / 128
    padded = np.concatenate([np.zeros(audio.TAPS // 2), x, np.zeros(audio.TAPS)])
    for block in (512, 1):  # one block, and several
        monkeypatch.setattr(audio, "BLOCK", block)
        y = audio.resample(raw)
        assert len(y) == len(x) * audio.UP // audio.DOWN
        for m in (*range(0, 300, 7), len(y) - 1):
            at, phase = divmod(m * audio.DOWN, audio.UP)
            assert np.isclose(y[m], padded[at : at + audio.TAPS] @ audio.PHASES[phase], atol=1e-5)
    tone = (128 + 100 * np.sin(2 * np.pi * 500 * np.arange(12_000) / audio.RATE_IN)).astype(np.uint8)
    got = audio.resample(tone)[100:-100]
    spectrum = np.abs(np.fft.rfft(got * np.hanning(len(got))))
    assert abs(np.argmax(spectrum) * audio.RATE / len(got) - 500) < 3  # a tone keeps its pitch


def plain_features(payload: bytes):
    """The features once more, with sums written out."""
    x = [(b - 128) / 128 for b in payload]
    at = lambda i: x[i] if 0 <= i < len(x) else 0.0
    cut = np.sinc((np.arange(48) - 23.5) / 3) * np.hamming(48)
    phases = []
    for p in range(2):  # every second tap, backwards, of unit gain
        taps = [cut[2 * k + p] for k in range(24)][::-1]
        phases.append([t / sum(taps) for t in taps])
    y = [sum(phases[m * 3 % 2][k] * at(m * 3 // 2 + k - 12) for k in range(24)) for m in range(-(-len(x) * 2 // 3))]
    y += [0.0] * max(0, 256 - len(y))
    edges = [700 * (10 ** (2595 * np.log10(1 + 4000 / 700) * i / 25 / 2595) - 1) for i in range(26)]
    mel = []
    for f in range(0, len(y) - 255, 128):
        frame = np.array(y[f : f + 256]) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255))
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(256) / 256))) ** 2 for k in range(129)]
        row = []
        for b in range(24):
            lo, mid, hi = edges[b : b + 3]
            row.append(np.log10(sum(p * max(0.0, min((k * 31.25 - lo) / (mid - lo), (hi - k * 31.25) / (hi - mid))) for k, p in enumerate(power)) + 1e-6))
        mel.append(row)
    energy = [10 * np.log10(sum(10.0**v for v in row)) for row in mel]
    mean, on, spans = sum(energy) / len(energy), False, []
    for i, e in enumerate([*energy, -1e9]):
        if not on and e > mean + 0.5:
            on, first = True, i
        elif on and e < mean - 0.5:
            on = False
            spans += [(first, i)] * (i - first >= 8)
    spans = spans or [(0, len(mel))]
    cells = lambda a, b, k: mel[min(a + (b - a) * k // 4, len(mel) - 1) : max(a + (b - a) * (k + 1) // 4, a + (b - a) * k // 4 + 1)]
    return spans, np.array([[np.mean(cells(a, b, k), axis=0) for k in range(4)] for a, b in spans])


def test_features_match_a_plain_version():
    for text in (corpus.sentence(3, 300), "A" * 700 + "zz~ " * 500 + " " * 900, "short"):
        raw = text.encode()
        payload = raw + b" " * (-len(raw) % 192)
        spans, tensors = audio.features(payload)
        want_spans, want = plain_features(payload)
        assert spans == want_spans and np.abs(tensors - want).max() < 0.02, text[:20]  # kept in steps of 1/64


def test_log_mel_peaks_at_the_tone():
    t = np.sin(2 * np.pi * 1000 * np.arange(8000) / audio.RATE)
    band = int(audio.log_mel(t.astype(np.float32)).mean(axis=0).argmax())
    assert audio.MEL[round(1000 * audio.FRAME / audio.RATE), band] > 0


def test_hysteresis():
    e = np.array([0] * 20 + [10] * 12 + [5.2] * 6 + [10] * 4 + [0] * 20 + [10] * 3 + [0] * 20, dtype=float)
    mean = e.mean()
    spans = audio.segments(e)
    assert spans == [(20, 42)] and mean - 0.5 < 5.2  # the dip doesn't close it, the short burst is dropped
    assert audio.segments(np.zeros(5)) == [(0, 5)]


def test_documents(spark):
    docs = corpus.documents(spark).withColumn("feature", F.lit("x"))
    got = audio.audio_features(docs).collect()
    assert len(got) == docs.count()
    want = {}
    for i, t, *_ in corpus.rows():
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        want.setdefault(i, set()).add((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(audio.wav_bytes(payload)).hexdigest()))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) in want[r["doc_id"]]
        table = pa.ipc.open_stream(r["tensors"]).read_all()
        assert table.schema.field("log_mel").type.shape == [audio.SLOTS, audio.BANDS] and table.num_rows == r["n_segments"]
        assert all(a < b <= r["seconds"] + 0.1 for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
    same = {r["feature"] for r in got if r["doc_id"] in (1, 2)}
    assert len(same) == 1 and audio.audio_features(corpus.empty(spark)).count() == 0


def test_text_of_ten_megabytes(spark):
    text = "loud and QUIET ~~~~ " * 500_000
    row = audio.audio_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    raw = text.encode()
    payload = raw + b" " * (-len(raw) % 192)
    assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert row["tail_crc32"] == zlib.crc32(payload[-16:])
