"""Operator 2, media columns: 8-bit WAV samples, short-time Fourier transform, peak-pair fingerprints.

A text becomes mono unsigned 8-bit samples through the ``wave`` module; the stored bytes are
read back before anything is computed from them. Each STFT frame keeps its strongest local
maxima; a peak is paired with peaks of the next frames, and every pair is one landmark
``(frame, f1, f2, dt)`` packed as an integer that starts with the frame (time-coded).

Defined results: null text counts as empty; an empty text is one padded unit of bytes 255 and
its landmarks are those of silence (none). Equal texts give equal values in every column.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_type, map_batches

UNIT, RATE = 576, 8000
WINDOW, HOP, PEAKS, AHEAD = 256, 128, 3, 4


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def spectrum(samples: np.ndarray, window: int = WINDOW, hop: int = HOP) -> np.ndarray:
    """Magnitudes, frames x bins, of Hann-windowed frames; the mean of each frame is taken off."""
    x = samples.astype(np.float32) - 128.0
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
    frames = (frames - frames.mean(axis=1, keepdims=True)) * np.hanning(window).astype(np.float32)
    return np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)


def landmarks(samples: np.ndarray, peaks: int = PEAKS, ahead: int = AHEAD) -> np.ndarray:
    """Sorted int64 landmarks ``frame << 20 | f1 << 12 | f2 << 4 | dt``."""
    if len(samples) < WINDOW:
        return np.zeros(0, np.int64)
    found = []
    for at in range(0, max(1, (len(samples) - WINDOW) // HOP + 1), 4096):  # bounded blocks of frames
        lo, hi = at * HOP, (at + 4096 + ahead - 1) * HOP + WINDOW
        mag = spectrum(samples[lo:hi])
        n, inner = len(mag), mag[:, 1:-1]
        top = np.where((inner > mag[:, :-2]) & (inner >= mag[:, 2:]) & (inner > 1.0), inner, 0.0)
        order = np.argsort(-top, axis=1, kind="stable")[:, :peaks]
        bins, real = order + 1, np.take_along_axis(top, order, axis=1) > 0
        for dt in range(1, ahead + 1):
            m = min(n - dt, 4096)
            if m <= 0:
                continue
            ok = real[:m, :, None] & real[dt : dt + m, None, :]
            t, i, j = np.nonzero(ok)
            found.append(((t + at).astype(np.int64) << 20) | (bins[t, i] << 12) | (bins[t + dt, j] << 4) | dt)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def media_columns(df: DataFrame, text: str = "text", key: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """Per row: the key, sizes and digests, the time-coded ``landmarks`` and, if asked, the WAV itself."""
    fields = [
        T.StructField(key, id_type(df, key)), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()), T.StructField("landmarks", T.ArrayType(T.LongType())),
    ]
    if keep_media:
        fields.append(T.StructField("media", T.BinaryType()))

    def make():
        def step(cols):
            out = {f.name: [] for f in fields}
            for k, value in zip(cols[key], cols[text]):
                data = (value or "").encode("utf-8")
                stored = to_wav(pad(data))
                back = from_wav(stored)
                row = [k, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), landmarks(np.frombuffer(back, np.uint8)), stored]
                for f, v in zip(fields, row):
                    out[f.name].append(v)
            return out

        return step

    return map_batches(df, [key, text], T.StructType(fields), make)
