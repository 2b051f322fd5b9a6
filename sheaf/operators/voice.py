"""Voice analysis in numpy: pitch, harmonicity, intensity, formants, and what sums them up.

Pitch and harmonicity come from the autocorrelation of windowed frames divided by the
window's own (Boersma 1993), without a path search over frames; formants from Burg's linear
prediction; jitter, shimmer and cepstral peak prominence from their published definitions.
Numbers are close to those of common phonetics programs, not equal to them. Tremor, glottal
and glottal-to-noise measures need backends (``sheaf.operators.speech.register_backend``).

Defined cases: null or undecodable content gives no rows; a sound shorter than the analysis
needs is padded with silence on both sides; a silent sound is unvoiced throughout, and
measures without a voiced frame are null; recordings are read whole, one at a time in a task.
"""

from __future__ import annotations

import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators import sound
from sheaf.runtime import ship

FLOOR, CEILING, STEP = 75.0, 500.0, 0.01
TRACKS = ["f0_hz", "f1_hz", "f2_hz", "f3_hz", "f4_hz", "loudness_db", "hnr_db"]


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited, by cutting or extending the spectrum."""
    if rate == target or not len(x):
        return x
    n = round(len(x) * target / rate)
    spectrum = np.fft.rfft(x)[: n // 2 + 1]
    return (np.fft.irfft(spectrum, n) * (n / len(x))).astype(np.float32)


def load(content: bytes, *, preprocess: bool = True, target_rate: int = 44100, target_dbfs: float = -20.0) -> tuple[int, np.ndarray]:
    """(rate, mono samples): resampled, without its mean, at the target level."""
    rate, x = sound.decode(content)
    if not preprocess:
        return rate, x
    return target_rate, sound.leveled(resample(x, rate, target_rate), target_dbfs)


def padded(x: np.ndarray, rate: int, floor: float = FLOOR) -> np.ndarray:
    """At least as long as pitch and intensity windows need, with silence around."""
    lack = round(max(0.064, 6.4 / floor) * rate) - len(x)
    return x if lack <= 0 else np.pad(x, (lack // 2, lack - lack // 2))


def _frames(x: np.ndarray, rate: int, size: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(times of centres, first samples) of frames, as many as fit, in the middle of the sound."""
    length = len(x) / rate
    count = max(1, int((length - size / rate) / step + 1e-9) + 1)
    times = (length - (count - 1) * step) / 2 + np.arange(count) * step
    first = np.clip(np.round(times * rate).astype(int) - size // 2, 0, max(0, len(x) - size))
    return times, first


def pitch(x: np.ndarray, rate: int, floor: float = FLOOR, ceiling: float = CEILING, step: float = STEP, *, silence: float = 0.03,
          voicing: float = 0.45, octave: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, f0 with 0 for unvoiced frames, harmonics-to-noise ratio in decibels)."""
    size = min(len(x), round(3 / floor * rate))
    times, first = _frames(x, rate, size, step)
    taper = np.hanning(size + 2)[1:-1]
    width = 1 << int(np.ceil(np.log2(1.5 * size)))
    own = np.fft.irfft(np.abs(np.fft.rfft(taper, width)) ** 2)
    lags = np.arange(max(2, int(rate / ceiling)), min(size // 2 * 2 - 2, int(np.ceil(rate / floor)) + 1))
    peak = float(np.abs(x - x.mean()).max()) if len(x) else 0.0
    f0, ratio = np.zeros(len(times)), np.full(len(times), -200.0)
    if not peak or len(lags) < 3:
        return times, f0, ratio
    for at in range(0, len(times), 256):
        block = x[first[at : at + 256, None] + np.arange(size)].astype(np.float64)
        block -= block.mean(axis=1, keepdims=True)
        loud = np.abs(block).max(axis=1) / peak
        power = np.fft.irfft(np.abs(np.fft.rfft(block * taper, width, axis=1)) ** 2, axis=1)
        zero = np.maximum(power[:, :1], 1e-30)
        r = (power[:, lags[0] - 1 : lags[-1] + 2] / zero) / (own[lags[0] - 1 : lags[-1] + 2] / own[0])
        left, mid, right = r[:, :-2], r[:, 1:-1], r[:, 2:]
        top = (mid > left) & (mid >= right)
        score = np.where(top, mid - octave * np.log2(floor * lags / rate), -np.inf)
        best = score.argmax(axis=1)
        row = np.arange(len(block))
        a, b, c = left[row, best], mid[row, best], right[row, best]
        bend = a - 2 * b + c
        shift = np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(np.abs(bend) > 1e-12, bend, 1), 0.0)
        strength = np.minimum(b - 0.25 * (a - c) * shift, 0.999999)
        hush = voicing + np.maximum(0.0, 2 - loud / (silence / (1 + voicing)))
        voiced = np.isfinite(score[row, best]) & (score[row, best] > hush)
        f0[at : at + 256] = np.where(voiced, rate / (lags[best] + shift), 0.0)
        clear = np.isfinite(score[row, best]) & (strength > 1e-6) & (loud > 1e-6)
        kept = np.where(clear, strength, 0.5)
        ratio[at : at + 256] = np.where(clear, 10 * np.log10(kept / (1 - kept)), -200.0)
    return times, f0, ratio


def intensity(x: np.ndarray, rate: int, times: np.ndarray, lowest: float = 100.0) -> np.ndarray:
    """Level at the given times, in decibels over 20 micropascal, by a bell-shaped window."""
    size = min(len(x), round(6.4 / lowest * rate))
    bell = np.kaiser(size, 20.24)
    bell /= bell.sum()
    first = np.clip(np.round(times * rate).astype(int) - size // 2, 0, max(0, len(x) - size))
    out = np.empty(len(times))
    for at in range(0, len(times), 512):
        block = x[first[at : at + 512, None] + np.arange(size)].astype(np.float64)
        block -= block.mean(axis=1, keepdims=True)
        out[at : at + 512] = 10 * np.log10((block**2) @ bell / 4e-10 + 1e-30)
    return out


def _burg(frames: np.ndarray, order: int) -> np.ndarray:
    """Prediction coefficients of each frame, by Burg's recursion."""
    forward, backward = frames[:, 1:].copy(), frames[:, :-1].copy()
    found = np.zeros((len(frames), 0))
    for _ in range(order):
        top = 2 * (forward * backward).sum(axis=1)
        k = top / np.maximum((forward**2 + backward**2).sum(axis=1), 1e-30)
        found = np.concatenate((found - k[:, None] * found[:, ::-1], k[:, None]), axis=1)
        forward, backward = (forward - k[:, None] * backward)[:, 1:], (backward - k[:, None] * forward)[:, :-1]
    return found


def formants(x: np.ndarray, rate: int, times: np.ndarray, highest: float = 5500.0, count: int = 4, window: float = 0.025) -> np.ndarray:
    """(times, count) frequencies of the lowest resonances; not-a-number where there are fewer."""
    half = resample(x, rate, int(2 * highest)).astype(np.float64)
    rate = int(2 * highest)
    half = np.append(half[:1], half[1:] - np.exp(-2 * np.pi * 50 / rate) * half[:-1])
    size = min(len(half), round(2 * window * rate))
    out = np.full((len(times), count), np.nan)
    if size < 4 * count:
        return out
    edge = np.exp(-12.0)
    bell = (np.exp(-12 * (2 * np.arange(size) / (size - 1) - 1) ** 2) - edge) / (1 - edge)
    first = np.clip(np.round(times * rate).astype(int) - size // 2, 0, max(0, len(half) - size))
    for at in range(0, len(times), 256):
        block = half[first[at : at + 256, None] + np.arange(size)] * bell
        sounding = np.flatnonzero((block**2).sum(axis=1) > 1e-20)
        if not len(sounding):
            continue
        order = 2 * count
        matrix = np.zeros((len(sounding), order, order))
        matrix[:, 0] = _burg(block[sounding], order)
        matrix[:, np.arange(1, order), np.arange(order - 1)] = 1
        hz = np.angle(np.linalg.eigvals(matrix)) * rate / (2 * np.pi)
        hz = np.sort(np.where((hz > 50) & (hz < rate / 2 - 50), hz, np.inf), axis=1)[:, :count]
        out[at + sounding] = np.where(np.isfinite(hz), hz, np.nan)
    return out


def tracks(x: np.ndarray, rate: int, floor: float = FLOOR, ceiling: float = CEILING, step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(times, one column for each of TRACKS)."""
    x = padded(x, rate, floor)
    times, f0, ratio = pitch(x, rate, floor, ceiling, step)
    return times, np.column_stack((f0, formants(x, rate, times), intensity(x, rate, times), ratio))


def voiced_runs(times: np.ndarray, f0: np.ndarray, shortest: float = 0.0) -> list[tuple[float, float]]:
    """From the first frame of a run to halfway to the frame after it; an open run ends half a
    frame after its last."""
    on = np.concatenate(([False], f0 > 0, [False])).astype(int)
    edges = np.flatnonzero(np.diff(on)).reshape(-1, 2)
    hop = float(np.median(np.diff(times))) if len(times) > 1 else STEP
    ends = [(times[b - 1] + times[b]) / 2 if b < len(times) else times[-1] + hop / 2 for _, b in edges]
    return [(float(times[a]), float(e)) for (a, _), e in zip(edges, ends) if e - times[a] >= shortest]


def _spread(values: np.ndarray) -> tuple[float, float, float]:
    v = values[np.isfinite(values)]
    return (float(v.mean()), float(v.std()), float(v.max() - v.min())) if len(v) else (np.nan,) * 3


def track_summary(times: np.ndarray, values: np.ndarray, voiced_s: float | None = 0.1) -> dict[str, float]:
    """Mean, population deviation and range of each track. Pitch counts inside voiced runs;
    the others too, if these have a least length ``voiced_s``, else everywhere."""
    f0 = values[:, 0]
    inside = np.zeros(len(times), dtype=bool)
    for a, b in voiced_runs(times, f0, voiced_s or 0.0):
        inside |= (times >= a) & (times <= b)
    out: dict[str, float] = {}
    for k, name in enumerate(["f0", "f1", "f2", "f3", "f4", "loudness", "hnr"]):
        chosen = values[inside, k] if k == 0 or voiced_s is not None else values[:, k]
        out |= dict(zip((f"{name}_{s}" for s in ("mean", "std", "range")), _spread(chosen)))
    out["silence_ratio"] = float((f0 <= 0).mean()) if len(f0) else np.nan
    return out


def loud_intervals(x: np.ndarray, top_db: float = 30.0, frame: int = 2048, hop: int = 512) -> list[tuple[int, int]]:
    """Runs of samples whose frames are within ``top_db`` of the loudest."""
    if not len(x):
        return []
    around = np.pad(x, frame // 2)
    total = np.concatenate(([0.0], np.cumsum(around.astype(np.float64) ** 2)))
    first = np.arange(0, len(around) - frame + 1, hop)
    power = (total[first + frame] - total[first]) / frame
    if power.max() <= 0:
        return []
    on = np.concatenate(([False], 10 * np.log10(np.maximum(power, 1e-20) / power.max()) > -top_db, [False])).astype(int)
    return [(int(a) * hop, min(int(b) * hop, len(x))) for a, b in np.flatnonzero(np.diff(on)).reshape(-1, 2)]


def pauses(x: np.ndarray, rate: int, *, top_db: float = 30.0, frame: int = 2048, hop: int = 512, shortest: float = 0.05, longest: float = 2.0) -> dict[str, float]:
    """Pauses for each second of speech, their median and median absolute deviation."""
    runs = [(a / rate, b / rate) for a, b in loud_intervals(x, top_db, frame, hop)]
    gaps = np.diff(np.array([0.0, *(t for r in runs for t in r), len(x) / rate]))[::2]
    gaps = gaps[(gaps >= shortest) & (gaps <= longest)]
    spoken = sum(b - a for a, b in runs)
    middle = float(np.median(gaps)) if len(gaps) else 0.0
    return {"spir": len(gaps) / spoken if spoken > 0 else 0.0, "dur_med": middle, "dur_mad": float(np.median(np.abs(gaps - middle))) if len(gaps) else 0.0}


def pulses(x: np.ndarray, rate: int, times: np.ndarray, f0: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(moments, heights) of one peak for each period, for every voiced run: from the highest
    peak of the run outwards, the highest sample around one period away."""
    found = []
    for a, b in voiced_runs(times, f0):
        lo, hi = max(1, int(a * rate)), min(len(x) - 2, int(b * rate))
        if hi - lo < 3:
            continue
        sign = 1.0 if x[lo:hi].max() >= -x[lo:hi].min() else -1.0
        y = sign * x
        period = lambda s: rate / np.interp(s / rate, times[f0 > 0], f0[f0 > 0])  # noqa: B023, E731
        start = lo + int(y[lo:hi].argmax())
        marks = [start]
        for way in (1, -1):
            at = start
            while True:
                t = period(at)
                near = sorted((at + way * 0.8 * t, at + way * 1.25 * t))
                p, q = int(np.ceil(near[0])), int(near[1]) + 1
                if p < lo or q > hi or q - p < 1:
                    break
                at = p + int(y[p:q].argmax())
                marks.append(at)
        s = np.array(sorted(set(marks)))
        l, m, r = y[s - 1], y[s], y[s + 1]
        bend = l - 2 * m + r
        shift = np.where(np.abs(bend) > 1e-12, 0.5 * (l - r) / np.where(np.abs(bend) > 1e-12, bend, 1), 0.0)
        found.append(((s + np.clip(shift, -1, 1)) / rate, m - 0.25 * (l - r) * np.clip(shift, -1, 1)))
    return found


def _perturbation(values: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Each value's distance from the mean of the ``size`` around it."""
    return [np.abs(v[size // 2 : len(v) - size // 2] - np.convolve(v, np.full(size, 1 / size), "valid")) for v in values if len(v) >= size]


def phonation(x: np.ndarray, rate: int, times: np.ndarray, f0: np.ndarray, floor: float = FLOOR, ceiling: float = CEILING) -> dict[str, float]:
    """Jitter and shimmer over periods between 1/ceiling and 1/floor whose neighbours differ by
    at most 1.3 times, heights by at most 1.6 times."""
    lengths, heights = [], []
    for at, height in pulses(x, rate, times, f0):
        t = np.diff(at)
        fine = (t >= 1 / ceiling) & (t <= 1 / floor)
        step = np.ones(len(t), dtype=bool)
        if len(t) > 1:
            step[1:] = np.maximum(t[1:], t[:-1]) <= 1.3 * np.minimum(t[1:], t[:-1])
        cut = np.flatnonzero(~(fine & step))
        lengths += [p for p in np.split(t, cut) if len(p) > 1]
        h = np.maximum(height, 1e-9)
        near = np.flatnonzero(np.maximum(h[1:], h[:-1]) > 1.6 * np.minimum(h[1:], h[:-1])) + 1
        heights += [p for p in np.split(h, near) if len(p) > 1]
    mean = lambda parts: float(np.concatenate(parts).mean()) if parts else np.nan
    t, h = mean(lengths), mean(heights)
    share = lambda parts, by: mean(parts) / by if parts else np.nan
    rap, apq3 = share(_perturbation(lengths, 3), t), share(_perturbation(heights, 3), h)
    return {
        "jitter_local": share([np.abs(np.diff(p)) for p in lengths], t), "jitter_rap": rap,
        "jitter_ppq5": share(_perturbation(lengths, 5), t), "jitter_ddp": 3 * rap,
        "shimmer_local": share([np.abs(np.diff(p)) for p in heights], h),
        "shimmer_local_db": mean([np.abs(20 * np.log10(p[1:] / p[:-1])) for p in heights]) if heights else np.nan,
        "shimmer_apq3": apq3, "shimmer_apq5": share(_perturbation(heights, 5), h), "shimmer_apq11": share(_perturbation(heights, 11), h),
        "shimmer_dda": 3 * apq3,
    }


def cepstral_peak(x: np.ndarray, rate: int, floor: float = FLOOR, ceiling: float = CEILING, step: float = STEP) -> float:
    """Smoothed cepstral peak prominence: how far the mean cepstrum's peak within the pitch
    range stands over a straight line through the cepstrum."""
    y = resample(x, rate, 10_000).astype(np.float64)
    size = min(len(y), 512)
    if size < 512 or not np.abs(y).max():
        return float("nan")
    first = np.arange(0, len(y) - size + 1, max(1, round(step * 10_000)))
    total = np.zeros(size // 2)
    for at in range(0, len(first), 512):
        block = y[first[at : at + 512, None] + np.arange(size)] * np.hanning(size)
        spectrum = 10 * np.log10(np.abs(np.fft.fft(block, axis=1)) ** 2 + 1e-12)
        total += (np.abs(np.fft.ifft(spectrum, axis=1)[:, : size // 2]) ** 2).sum(axis=0)
    level = 10 * np.log10(total / len(first) + 1e-12)
    level = np.convolve(level, np.full(3, 1 / 3), "same")
    quefrency = np.arange(size // 2) / 10_000
    line = np.polyfit(quefrency[10:], level[10:], 1)
    inside = np.flatnonzero((quefrency >= 1 / ceiling) & (quefrency <= 1 / floor))
    best = inside[level[inside].argmax()]
    return float(level[best] - np.polyval(line, quefrency[best]))


SUMMARY = [
    *(f"{n}_{s}" for n in ("f0", "f1", "f2", "f3", "f4", "loudness", "hnr") for s in ("mean", "std", "range")), "silence_ratio",
    "spir", "dur_med", "dur_mad", *(f"mfcc{k}_{s}" for k in range(1, 15) for s in ("mean", "var")), "cpps",
    "jitter_local", "jitter_rap", "jitter_ppq5", "jitter_ddp", "shimmer_local", "shimmer_local_db", "shimmer_apq3", "shimmer_apq5", "shimmer_apq11", "shimmer_dda",
]


def summary(x: np.ndarray, rate: int, *, floor: float = FLOOR, ceiling: float = CEILING, voiced_s: float | None = 0.1, top_db: float = 30.0,
            frame: int = 2048, hop: int = 512) -> dict[str, float]:
    """Every measure of SUMMARY for a sound."""
    x = padded(x, rate, floor)
    times, values = tracks(x, rate, floor, ceiling)
    mean, var = sound.mfcc_stats(x, rate)
    cepstra = {f"mfcc{k + 1}_{s}": float(v[k]) for k in range(14) for s, v in (("mean", mean), ("var", var))}
    return {
        **track_summary(times, values, voiced_s), **pauses(x, rate, top_db=top_db, frame=frame, hop=hop), **cepstra,
        "cpps": cepstral_peak(x, rate, floor, ceiling), **phonation(x, rate, times, values[:, 0], floor, ceiling),
    }


def _sounds(batch: pa.RecordBatch, load_args: dict) -> Iterator[tuple[str, int, np.ndarray]]:
    for path, content in zip(batch.column(0), batch.column(1)):
        if content.as_py() is None:
            continue
        try:
            yield path.as_py(), *load(content.as_py(), **load_args)
        except (wave.Error, EOFError, ValueError):
            continue


def framewise(files: DataFrame, **how) -> DataFrame:
    """path, frame from 0, time_s and TRACKS of the recordings ``path, content``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rate, x in _sounds(batch, how):
                times, values = tracks(x, rate)
                values = np.where(np.isfinite(values), values, np.nan)
                cols = [pa.array([path] * len(times), pa.string()), pa.array(np.arange(len(times))), pa.array(times)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, from_pandas=True) for v in values.T.copy())], names=["path", "frame", "time_s", *TRACKS])

    return files.select("path", F.col("content")).mapInArrow(run, "path string, frame bigint, time_s double, " + ", ".join(f"{t} double" for t in TRACKS))


def analyze(files: DataFrame, *, voiced_ms: int | None = 100, top_db: float = 30.0, frame: int = 2048, hop: int = 512, **how) -> DataFrame:
    """path, duration_s and SUMMARY of the recordings ``path, content``."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rate, x in _sounds(batch, how):
                found = summary(x, rate, voiced_s=None if voiced_ms is None else voiced_ms / 1000, top_db=top_db, frame=frame, hop=hop)
                values = [pa.array([found[n] if np.isfinite(found[n]) else None], pa.float64()) for n in SUMMARY]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(x) / rate]), *values], names=["path", "duration_s", *SUMMARY])

    return files.select("path", "content").mapInArrow(run, "path string, duration_s double, " + ", ".join(f"{n} double" for n in SUMMARY))
