"""Media columns: texts' bytes as 8-bit WAV samples, and spectral-peak pair fingerprints of such samples.

A WAV column is built and read by the wave module. A short-time Fourier transform (512 samples, a Hann window,
a hop of 256; the end is filled with 128, silence, to a whole frame) gives magnitudes; each frame keeps the strongest bin of each of four bands, if it stands above the
frame's mean; a peak pairs with the next band's peak in the same frame and in the following one. A pair is stored as one
time-coded long: frame << 32 | lag << 18 | bin << 9 | partner's bin.

Cases: null text is empty; an empty text is one block of 64 zero bytes (a constant signal: no peaks, no pairs);
equal texts give equal bytes and equal fingerprints; very long texts are transformed block by block; rows with equal ids
stay separate rows; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import map_batches, texts

RATE, BLOCK = 8000, 64
FRAME, HOP, FRAMES_AT_ONCE = 512, 256, 2048
#: First bins of the bands and the end of the last one.
BANDS = (2, 20, 50, 110, 257)


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of BLOCK."""
    return data + b"\0" * (-len(data) % BLOCK if data else BLOCK)


def wav_bytes(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Bin of the strongest peak by frame and band, -1 where none stands out."""
    x = np.frombuffer(samples, np.uint8)
    short = FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP
    x = np.concatenate([x, np.full(short, 128, np.uint8)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    hann = np.hanning(FRAME).astype(np.float32)
    out = np.full((len(frames), len(BANDS) - 1), -1, np.int64)
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        block = frames[i : i + FRAMES_AT_ONCE].astype(np.float32)
        block -= block.mean(axis=1, keepdims=True)
        spectrum = np.fft.rfft(block * hann, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        floor = power.mean(axis=1) + 1e-3
        rows = np.arange(len(block))
        for b, (lo, hi) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            best = power[:, lo:hi].argmax(axis=1) + lo
            out[i : i + len(block), b] = np.where(power[rows, best] > floor, best, -1)
    return out


def pair_codes(samples: bytes) -> np.ndarray:
    """Time-coded pairs in ascending order."""
    p = peaks(samples)
    found = []
    for lag in (0, 1):
        a, b = p[: len(p) - lag], np.roll(p[lag:], -1, axis=1)
        t, band = np.nonzero((a >= 0) & (b >= 0))
        found.append(t << 32 | lag << 18 | a[t, band] << 9 | b[t, band])
    return np.sort(np.concatenate(found))


def to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text alone), media (a whole WAV file)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(1).cast(pa.binary()).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav_bytes(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


def fingerprint(media: DataFrame) -> DataFrame:
    """Reads each WAV back: doc_id, n_bytes, media, payload (its samples), pairs (time-coded spectral-peak pairs)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = [wav_samples(x) for x in batch.column("media").to_pylist()]
        codes = [pair_codes(x) for x in read]
        at = np.concatenate([[0], np.cumsum([len(x) for x in codes])]).astype(np.int32)
        pairs = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(codes), pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), batch.column("media"), pa.array(read, pa.binary()), pairs], ["doc_id", "n_bytes", "media", "payload", "pairs"])

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, media binary, payload binary, pairs array<long>")
