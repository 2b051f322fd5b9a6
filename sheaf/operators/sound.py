"""Sound in WAV bytes: decoding, level, framewise energy, MFCC statistics and clips by speaker."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sheaf.runtime import ship


def decode_channels(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples in -1..1 by channel) of PCM WAV bytes of 8 to 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (raw.astype(np.float32) - 128) / 128
    else:  # shorter samples are the upper bytes of 32-bit ones
        full = np.zeros((len(raw) // width, 4), np.uint8)
        full[:, 4 - width :] = raw.reshape(-1, width)
        x = full.view("<i4")[:, 0].astype(np.float64).astype(np.float32) / np.float32(1 << 31)
    return rate, x.reshape(-1, channels)


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples in -1..1) of PCM WAV bytes."""
    rate, x = decode_channels(data)
    return rate, x.mean(axis=1)


def encode(rate: int, samples: np.ndarray, bits: int = 16) -> bytes:
    """PCM WAV bytes of 16, 24 or 32 bits; samples are mono or have a column for each channel."""
    if bits not in (16, 24, 32):
        raise ValueError("bits are 16, 24 or 32")
    out = io.BytesIO()
    x = np.round(np.clip(samples, -1, 1).astype(np.float64) * ((1 << (bits - 1)) - 1)).astype("<i4").reshape(len(samples), -1)
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(bits // 8)
        w.setframerate(rate)
        w.writeframes(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes())
    return out.getvalue()


def leveled(x: np.ndarray, target_dbfs: float = -20.0) -> np.ndarray:
    """Without its mean, at the target level as far as the headroom allows."""
    x = x - x.mean() if len(x) else x
    rms = float(np.sqrt((x**2).mean())) if len(x) else 0.0
    if rms <= 0:
        return x
    return x * min(10 ** (target_dbfs / 20) / rms, 1.0 / max(float(np.abs(x).max()), 1e-9))


def frame_energy(x: np.ndarray, rate: int, hop_s: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Times and levels in decibels of frames of one hop."""
    hop = max(1, int(rate * hop_s))
    n = -(-len(x) // hop)
    padded = np.pad(x, (0, n * hop - len(x))).reshape(n, hop)
    return np.arange(n) * hop / rate, 10 * np.log10((padded**2).mean(axis=1) + 1e-12)


def mfcc_stats(x: np.ndarray, rate: int, count: int = 14, size: int = 2048, hop: int = 512, bands: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of each mel-cepstral coefficient."""
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hanning(size)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    hz = np.arange(size // 2 + 1) * rate / size
    up = (hz[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - hz[None]) / (edges[2:] - edges[1:-1])[:, None]
    energy = 10 * np.log10(power @ np.clip(np.minimum(up, down), 0, None).T + 1e-10)
    k = np.arange(count)[:, None]
    basis = np.cos(np.pi * k * (np.arange(bands)[None] + 0.5) / bands) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    cepstra = energy @ basis.T
    return cepstra.mean(axis=0), cepstra.var(axis=0)


def speaker_clips(rate: int, x: np.ndarray, segments: list[tuple[str, int, int]], silence_ms: int = 1000) -> dict[str, np.ndarray]:
    """Each speaker's segments one after another, silence around each."""
    gap = np.zeros(rate * silence_ms // 1000, dtype=np.float32)
    out: dict[str, list[np.ndarray]] = {}
    for who, a, b in segments:
        out.setdefault(who, []).extend([gap, x[a * rate // 1000 : b * rate // 1000], gap])
    return {k: np.concatenate(v) for k, v in out.items()}


def acoustics(files: DataFrame) -> DataFrame:
    """path, duration, level and MFCC statistics of WAV files ``path, content``."""
    ship(files.sparkSession)
    names = [f"mfcc{k}_{s}" for k in range(14) for s in ("mean", "var")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                rate, x = decode(bytes(content))
                x = leveled(x)
                mean, var = mfcc_stats(x, rate)
                rows.append((path, len(x) / rate, float(frame_energy(x, rate)[1].mean()), *np.stack((mean, var), axis=1).ravel()))
            yield pd.DataFrame(rows, columns=["path", "duration_s", "loudness_db", *names])

    return files.select("path", "content").mapInPandas(run, "path string, duration_s double, loudness_db double, " + ", ".join(f"{n} double" for n in names))
