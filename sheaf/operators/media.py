"""Recordings as tables of bytes: conversion to WAV, streams, and embeddings of segments.

PCM WAV is read here; other media go through the ``ffmpeg`` program where the executors have
one, and are an error in their row where not. Encoders are functions that a caller gives:
``encode(samples, rate)`` returns a vector, or None for a segment that has none.
"""

from __future__ import annotations

import json
import shutil
import subprocess
import tempfile
import wave
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import sound, voice
from sheaf.runtime import ship

Encode = Callable[[np.ndarray, int], "np.ndarray | None"]


def to_wav(content: bytes, rate: int | None = 16000, bits: int = 16, channels: int = 1, stream: int = 0) -> bytes:
    """Media bytes as PCM WAV of a rate, sample size and number of channels."""
    try:
        own, x = sound.decode_channels(content)
    except (wave.Error, EOFError):
        return _by_program(content, rate, bits, channels, stream)
    if channels == 1:
        x = x.mean(axis=1, keepdims=True)
    elif x.shape[1] != channels:
        x = np.repeat(x.mean(axis=1, keepdims=True), channels, axis=1)
    if rate and rate != own:
        x = np.column_stack([voice.resample(c, own, rate) for c in x.T])
    return sound.encode(rate or own, x, bits)


def _program(name: str) -> str:
    found = shutil.which(name)
    if found is None:
        raise ValueError(f"not a PCM WAV file, and {name} is not installed")
    return found


def _by_program(content: bytes, rate: int | None, bits: int, channels: int, stream: int) -> bytes:
    program = _program("ffmpeg")
    with tempfile.TemporaryDirectory() as folder:  # of this one conversion, by this process only
        source, target = Path(folder, "in"), Path(folder, "out.wav")
        source.write_bytes(content)
        wanted = ["-ac", str(channels)] if channels else []
        wanted += ["-ar", str(rate)] if rate else []
        done = subprocess.run([program, "-v", "error", "-y", "-i", str(source), "-map", f"0:a:{stream}", *wanted, "-c:a", f"pcm_s{bits}le", str(target)], capture_output=True, text=True)
        if done.returncode:
            raise ValueError(done.stderr.strip()[-300:] or "the conversion failed")
        return target.read_bytes()


def audio_streams(content: bytes) -> int:
    """How many audio streams media bytes have."""
    try:
        sound.decode_channels(content)
        return 1
    except (wave.Error, EOFError):
        program = _program("ffprobe")
        with tempfile.TemporaryDirectory() as folder:
            source = Path(folder, "in")
            source.write_bytes(content)
            done = subprocess.run([program, "-v", "error", "-select_streams", "a", "-show_entries", "stream=index", "-of", "json", str(source)], capture_output=True, text=True)
        return len(json.loads(done.stdout or "{}").get("streams", []))


def _rows(files: DataFrame, work: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """``work`` gives rows after the path, an error being the last of each."""
    ship(files.sparkSession)
    names, width = [c.split()[0] for c in schema.split(", ")], schema.count(", ") + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                try:
                    rows = [(path.as_py(), *r) for r in work(content.as_py())] if content.is_valid else []
                except ValueError as e:
                    rows = [(path.as_py(), *[None] * (width - 2), str(e))]
                for r in rows:  # one recording at a time, however large
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r))], schema=pa.schema(list(zip(names, kinds))))

    kinds = [{"string": pa.string(), "binary": pa.binary(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]
    return files.select("path", "content").mapInArrow(run, schema)


def convert(files: DataFrame, *, sample_rate: int | None = 16000, bit_depth: int = 16, channels: int = 1) -> DataFrame:
    """path, content as PCM WAV, and error; null contents give no row."""
    return _rows(files, lambda c: [(to_wav(c, sample_rate, bit_depth, channels), None)], "path string, content binary, error string")


def split_streams(files: DataFrame, *, sample_rate: int = 48000, bit_depth: int = 16) -> DataFrame:
    """path, stream from 0, content as PCM WAV of each audio stream, and error."""

    def work(content: bytes) -> list[tuple]:
        return [(k, to_wav(content, sample_rate, bit_depth, 1, k), None) for k in range(audio_streams(content))]

    return _rows(files, work, "path string, stream int, content binary, error string")


def segments(x: np.ndarray, rate: int, *, strategy: str = "windows", window_s: float = 30.0, hop_s: float = 15.0, least_s: float = 1.0, top_db: float = 30.0) -> list[tuple[int, int]]:
    """Sample ranges of a recording: fixed windows up to the first that reaches the end, or the
    loud stretches cut into windows, or else all of it."""
    n = len(x)
    window, hop, least = (max(1, round(s * rate)) for s in (window_s, hop_s, least_s))
    if strategy == "windows":
        starts = range(0, n, hop)
        return [(s, min(n, s + window)) for s in starts if s == 0 or s - hop + window < n] or [(0, n)]
    if strategy != "nonsilent":
        raise ValueError("strategy is windows or nonsilent")
    loud = [(a, b) for a, b in voice.loud_intervals(x, top_db) if b - a >= least]
    cut = [(s, min(b, s + window)) for a, b in loud for s in range(a, b, window)]
    return [(a, b) for a, b in cut if b - a >= least] or [(0, n)]


VECTORS = "path string, start_time string, end_time string, speaker string, vector array<double>"


def _unit(v: np.ndarray) -> np.ndarray:
    size = float(np.linalg.norm(v))
    return v / size if size > 1e-12 else v


def segment_embeddings(files: DataFrame, encode: Encode, *, aggregate: str = "none", normalize: bool = False, rate: int = 16000, **how) -> DataFrame:
    """VECTORS for the segments of each recording, named ``SEGMENT_0`` and on; a segment without
    a vector keeps its number and has no row. ``aggregate="mean"`` gives one row named
    ``GLOBAL_MEAN`` for a recording instead; ``how`` goes to :func:`segments`."""
    if aggregate not in ("none", "mean"):
        raise ValueError("aggregate is none or mean")
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                if content is None:
                    continue
                own, x = sound.decode(bytes(content))
                x = voice.resample(x, own, rate)
                rows, vectors = [], []
                for k, (a, b) in enumerate(segments(x, rate, **how)):
                    v = encode(x[a:b], rate)
                    if v is not None:
                        vectors.append(np.asarray(v, dtype=np.float64))
                        rows.append((path, f"{a / rate:.3f}", f"{b / rate:.3f}", f"SEGMENT_{k}", vectors[-1].tolist()))
                if aggregate == "mean":
                    mean = np.mean(vectors, axis=0) if vectors else None
                    rows = [(path, "0.000", f"{len(x) / rate:.3f}", "GLOBAL_MEAN", (_unit(mean) if normalize else mean).tolist())] if vectors else []
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in VECTORS.split(", ")])

    return files.select("path", "content").mapInPandas(run, VECTORS)


def turn_embeddings(files: DataFrame, turns: DataFrame, encode: Encode, *, unit: str = "auto", normalize: bool = False, rate: int = 16000) -> DataFrame:
    """VECTORS for the turns ``path, start_time, end_time, speaker`` of each recording, times as
    they were given. The unit of time is guessed from a recording's latest end. Turns that
    are not in order, or have under two samples in the recording, have no row."""
    if unit not in ("auto", "ms", "s", "samples"):
        raise ValueError("unit is auto, ms, s or samples")
    ship(files.sparkSession)
    names = [c.split()[0] for c in VECTORS.split(", ")]

    def run(key: tuple, sounds: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        if not len(sounds) or not len(spans) or sounds["content"].iloc[0] is None:
            return pd.DataFrame(columns=names)
        own, x = sound.decode(bytes(sounds["content"].iloc[0]))
        x = voice.resample(x, own, rate)
        begin, end = (pd.to_numeric(spans[c], errors="coerce") for c in ("start_time", "end_time"))
        seconds, latest = len(x) / rate, end.max()
        guess = "s" if latest <= 1.1 * seconds else "ms" if latest <= 1.1 * seconds * 1000 else "samples" if latest <= 1.1 * len(x) else "s"
        scale = {"s": rate, "ms": rate / 1000, "samples": 1.0}[guess if unit == "auto" else unit]
        rows = []
        for k in np.argsort(begin.to_numpy(), kind="stable"):
            a, b = begin.iloc[k], end.iloc[k]
            if not b > a:
                continue
            p, q = (max(0, min(len(x), int(round(t * scale)))) for t in (a, b))
            v = encode(x[p:q], rate) if q - p >= 2 else None
            if v is None:
                continue
            v = np.asarray(v, dtype=np.float64)
            who = spans["speaker"].iloc[k]
            rows.append((key[0], str(spans["start_time"].iloc[k]), str(spans["end_time"].iloc[k]), "SPEAKER_0" if who is None else who, (_unit(v) if normalize else v).tolist()))
        return pd.DataFrame(rows, columns=names)

    chosen = turns.select("path", F.col("start_time").cast("string").alias("start_time"), F.col("end_time").cast("string").alias("end_time"), F.col("speaker").cast("string").alias("speaker"))
    return files.select("path", "content").groupBy("path").cogroup(chosen.groupBy("path")).applyInPandas(run, VECTORS)


def device(wanted: str = "auto") -> str:
    """``cuda`` or ``cpu``; ``auto`` takes the first where the driver of a card answers."""
    if wanted not in ("auto", "cuda", "cpu"):
        raise ValueError("device is auto, cuda or cpu")
    if wanted != "auto":
        return wanted
    asked = shutil.which("nvidia-smi")
    return "cuda" if asked and subprocess.run([asked, "-L"], capture_output=True).returncode == 0 else "cpu"
