"""Transcripts beside their recordings: columns, labels, valid turns, clips and turn acoustics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators import sound, voice
from sheaf.runtime import quoted, ship

# Other names under which a transcript may have its columns.
START_NAMES = ["start", "from", "t0", "start_ms", "start_sec"]
END_NAMES = ["end", "to", "t1", "end_ms", "end_sec"]
SPEAKER_NAMES = ["speaker_label", "spk", "speaker_id", "speaker_name"]
UNKNOWN = "SPEAKER_0"
#: Milliseconds in a unit of time.
UNITS = {"ms": 1.0, "s": 1000.0}


def transcript_columns(columns: list[str], start: str = "start_time", end: str = "end_time", speaker: str = "speaker") -> tuple[str, str, str]:
    """The names of start, end and speaker: the given ones, else the first known other name."""
    found = []
    for what, given, others in (("start", start, START_NAMES), ("end", end, END_NAMES), ("speaker", speaker, SPEAKER_NAMES)):
        names = [n for n in [given, *others] if n in columns]
        if not names:
            raise ValueError(f"no column of the {what}; there are {columns}")
        found.append(names[0])
    return found[0], found[1], found[2]


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def speaker_key(name: Column) -> Column:
    """A speaker's key: spaces and runs of anything but letters, digits, ``_`` and ``-`` as ``_``."""
    known = F.when(name != "", name).otherwise(UNKNOWN)
    return F.regexp_replace(F.replace(_stripped(known), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9_\-]+", "_")


def file_label(name: Column) -> Column:
    """A speaker's name as part of a readable file name."""
    flat = F.translate(_stripped(F.coalesce(name, F.lit(""))), '/\\<>:"|?*', "__")
    shown = F.regexp_replace(flat, r"(?U)\s+", " ")
    return F.when(shown != "", shown).otherwise(UNKNOWN)


def plain_label(value: Column) -> Column:
    """Letters and digits, anything else between them as ``_``; ``x`` if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")
    return F.when(text != "", text).otherwise("x")


def valid_turns(df: DataFrame, start: str, end: str, *, unit: str = "ms", length: Column | None = None, least: int = 1) -> DataFrame:
    """Turns in whole milliseconds ``start_ms``, ``end_ms``, within 0 and ``length``.

    Times that are no numbers, and turns shorter than ``least`` before or after they are
    clamped, go; halves are rounded to even.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    made = {k: F.bround(F.col(quoted(c)).try_cast("double") * UNITS[unit]).cast("bigint") for k, c in (("start_ms", start), ("end_ms", end))}
    long_enough = F.col("end_ms") - F.col("start_ms") >= max(1, least)
    rows = df.withColumns(made).where(long_enough)
    low = F.lit(0).cast("bigint")
    inside = (lambda c: F.greatest(low, F.least(c, length.cast("bigint")))) if length is not None else (lambda c: F.greatest(low, c))
    return rows.withColumns({k: inside(F.col(k)) for k in made}).where(long_enough)


def _pairs(files: DataFrame, turns: DataFrame, work, schema: str) -> DataFrame:
    """``work(path, rate, samples, turns in order)`` for each recording that has turns; one
    recording and its turns are one group."""
    ship(files.sparkSession)
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(key: tuple, sounds: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        if not len(sounds) or not len(spans) or sounds["content"].iloc[0] is None:
            return pd.DataFrame(columns=names)
        rate, x = sound.decode(bytes(sounds["content"].iloc[0]))
        order = spans.sort_values(["start_ms", "end_ms"], kind="stable")
        return pd.DataFrame(work(key[0], rate, x, order), columns=names)

    return files.select("path", "content").groupBy("path").cogroup(turns.groupBy("path")).applyInPandas(run, schema)


def speaker_sounds(files: DataFrame, turns: DataFrame, *, silence_ms: int = 1000, least_ms: int = 50) -> DataFrame:
    """One WAV per recording and speaker: ``path, speaker, segments, content``.

    ``turns``: path, start_ms, end_ms, speaker. A speaker's turns that follow each other are
    one segment, from the first start to the last end; segments under ``least_ms`` go.
    """

    def work(path: str, rate: int, x: np.ndarray, order: pd.DataFrame) -> list[tuple]:
        whole = len(x) * 1000 // rate
        runs: list[list] = []
        for a, b, who in zip(order["start_ms"], order["end_ms"], order["speaker"]):
            a, b = max(0, min(int(a), whole)), max(0, min(int(b), whole))
            if b <= a:
                continue
            if runs and runs[-1][0] == who:
                runs[-1][2] = max(runs[-1][2], b)
            else:
                runs.append([who, a, b])
        kept = [(w, a, b) for w, a, b in runs if b - a >= least_ms]
        clips = sound.speaker_clips(rate, x, kept, silence_ms)
        return [(path, w, sum(k[0] == w for k in kept), sound.encode(rate, c)) for w, c in clips.items()]

    rows = turns.select("path", "start_ms", "end_ms", speaker_key(F.col("speaker")).alias("speaker"))
    return _pairs(files, rows, work, "path string, speaker string, segments bigint, content binary")


def turn_acoustics(files: DataFrame, turns: DataFrame, *, least_ms: int = 20) -> DataFrame:
    """Level and cepstral statistics of each turn's slice of its recording, by path, speaker,
    start_ms and end_ms; ``intervals.turn_summary`` sums them up. Turns whose slice is under
    ``least_ms`` go."""
    names = [f"mfcc{k}_{s}" for k in range(14) for s in ("mean", "var")]

    def work(path: str, rate: int, x: np.ndarray, order: pd.DataFrame) -> list[tuple]:
        out = []
        for a, b, who in zip(order["start_ms"], order["end_ms"], order["speaker"]):
            part = x[max(0, int(a)) * rate // 1000 : max(0, int(b)) * rate // 1000]
            if len(part) * 1000 < least_ms * rate:
                continue
            mean, var = sound.mfcc_stats(part, rate)
            out.append((path, who, int(a), int(b), float(sound.frame_energy(part, rate)[1].mean()), *np.stack((mean, var), axis=1).ravel().tolist()))
        return out

    schema = "path string, speaker string, start_ms bigint, end_ms bigint, loudness_db double, " + ", ".join(f"{n} double" for n in names)
    return _pairs(files, turns.select("path", "start_ms", "end_ms", "speaker"), work, schema)


def turn_voices(files: DataFrame, turns: DataFrame, *, least_ms: int = 20, voiced_ms: int | None = 100, top_db: float = 30.0, frame: int = 2048, hop: int = 512,
                preprocess: bool = True, target_rate: int = 44100, target_dbfs: float = -20.0) -> DataFrame:
    """Every voice measure of each turn's slice of its recording; the turns' other columns
    come back. ``turns``: path, start_ms, end_ms and others. Turns whose slice is under
    ``least_ms`` go."""
    others = [c for c in turns.columns if c not in ("path", "start_ms", "end_ms")]
    kinds = dict(turns.dtypes)

    def work(path: str, rate: int, x: np.ndarray, order: pd.DataFrame) -> list[tuple]:
        if preprocess:
            x, rate = sound.leveled(voice.resample(x, rate, target_rate), target_dbfs), target_rate
        out = []
        for row in order.to_dict("records"):
            a, b = int(row["start_ms"]), int(row["end_ms"])
            part = x[max(0, round(a * rate / 1000)) : max(0, round(b * rate / 1000))]
            if len(part) * 1000 < least_ms * rate:
                continue
            found = voice.summary(part, rate, voiced_s=None if voiced_ms is None else voiced_ms / 1000, top_db=top_db, frame=frame, hop=hop)
            out.append((path, a, b, *(row[c] for c in others), *(found[n] for n in voice.SUMMARY)))
        return out

    schema = "path string, start_ms bigint, end_ms bigint, " + "".join(f"`{c}` {kinds[c]}, " for c in others) + ", ".join(f"{n} double" for n in voice.SUMMARY)
    return _pairs(files, turns, work, schema)
