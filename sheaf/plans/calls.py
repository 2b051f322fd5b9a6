"""Calls on files, for presets and the command line: each reads its inputs, writes its result
and returns where that is. A result that exists is returned as it is unless
``overwrite_existing``; encoders and signal programs are registered by name beforehand."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import dictionary, features, gather, lexical, media, readability, speech, transcripts, vectors, voice
from sheaf.operators.intervals import turn_summary
from sheaf.plans import runner
from sheaf.runtime import quoted
from sheaf.sources import files, subtitles

_encoders: dict[str, Callable] = {}


def register_encoder(name: str, encode: Callable) -> None:
    """Offer an encoder: of sentences (``list`` to array) or of sound (samples and rate)."""
    _encoders[name] = encode


def encoder(name: str) -> Callable:
    if name not in _encoders:
        raise KeyError(f"no encoder {name!r} is registered; there are {sorted(_encoders)}")
    return _encoders[name]


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _kept(path: str | None, overwrite: bool) -> bool:
    return path is not None and not overwrite and os.path.exists(path)


def call(f: Callable) -> Callable:
    """Register as ``sheaf.theme.name``, the theme being that of THEMES."""
    runner.register(f"sheaf.{THEMES[f.__name__]}.{f.__name__}", f)
    return f


THEMES = {
    "convert_to_wav": "audio", "split_streams_to_wav": "audio", "diarize": "audio", "split_wav_by_speaker": "audio", "analyze_vocal_acoustics": "audio",
    "extract_sound_embeddings": "audio", "analyze_with_dictionaries": "text", "analyze_readability": "text", "analyze_lexical_richness": "text",
    "analyze_with_archetypes": "text", "analyze_with_sentence_embeddings": "text", "convert_subtitles": "text", "text_gather": "helpers",
    "txt_gather": "helpers", "feature_gather": "helpers", "find_files": "helpers",
}


# ---- texts

def _ready(csv_path: str | None, txt_dir: str | None, text_cols: list[str], id_cols: list[str] | None, group_by: list[str] | None, order_by: list[str] | None,
           mode: str, joiner: str, delimiter: str | None, encoding: str, pattern: str, recursive: bool, id_from: str) -> DataFrame:
    """text_id, text and the id or group columns of a CSV file or a folder of texts."""
    spark = _spark()
    if (csv_path is None) == (txt_dir is None):
        raise ValueError("give either csv_path or txt_dir")
    if txt_dir is not None:
        return files.read_texts(spark, os.path.abspath(txt_dir), pattern=pattern, recursive=recursive, id_from=id_from).select("text_id", "text")
    df = files.read_csv(spark, csv_path, delimiter=delimiter, encoding=encoding)
    if group_by:
        if not order_by:  # as the file has them
            df, order_by = df.withColumn("__line", F.monotonically_increasing_id()), ["__line"]
        return gather.gather_groups(df, text_cols, group_by, order_by, mode=mode, joiner=joiner)
    if id_cols:
        return gather.gather_rows(df, text_cols, id_cols, mode=mode, joiner=joiner)
    numbered = gather.with_row_ids(df.withColumn("__line", F.monotonically_increasing_id()), ["__line"])
    return gather.gather_rows(numbered, text_cols, [], mode=mode, joiner=joiner, text_id=F.col("row_id"))


def _measured(work: Callable[[DataFrame, list[str]], DataFrame], out: str | None, kind: str, overwrite_existing: bool, *, csv_path: str | None = None, txt_dir: str | None = None,
              text_cols: list[str] | None = None, id_cols: list[str] | None = None, group_by: list[str] | None = None, order_by: list[str] | None = None,
              mode: str = "concat", joiner: str = " ", delimiter: str | None = None, encoding: str = "utf-8-sig", pattern: str = "*.txt", recursive: bool = True,
              id_from: str = "stem") -> str:
    source = Path(csv_path or txt_dir or "")
    out = out or str(Path("features", kind, f"{source.stem}.csv"))
    if _kept(out, overwrite_existing):
        return out
    ready = _ready(csv_path, txt_dir, text_cols or ["text"], id_cols, group_by, order_by, mode, joiner, delimiter, encoding, pattern, recursive, id_from)
    return files.write_csv_file(work(ready, [c for c in ready.columns if c != "text"]), out, overwrite=True)


@call
def text_gather(csv_path: str, out_csv: str | None = None, *, text_cols: list[str], id_cols: list[str] | None = None, group_by: list[str] | None = None,
                order_by: list[str] | None = None, mode: str = "concat", joiner: str = " ", delimiter: str | None = None, encoding: str = "utf-8-sig",
                overwrite_existing: bool = False) -> str:
    """A CSV file's texts, one for a row or a group."""
    how = {"csv_path": csv_path, "text_cols": text_cols, "id_cols": id_cols, "group_by": group_by, "order_by": order_by, "mode": mode, "joiner": joiner, "delimiter": delimiter, "encoding": encoding}
    return _measured(lambda df, keep: df, out_csv, "texts", overwrite_existing, **how)


@call
def txt_gather(root_dir: str, out_csv: str | None = None, *, pattern: str = "*.txt", recursive: bool = True, id_from: str = "stem", overwrite_existing: bool = False) -> str:
    """A folder's text files, one text for each."""
    return _measured(lambda df, keep: df, out_csv, "texts", overwrite_existing, txt_dir=root_dir, pattern=pattern, recursive=recursive, id_from=id_from)


@call
def analyze_with_dictionaries(out_features_csv: str | None = None, *, dict_paths: list[str], relative_freq: bool = True, drop_punct: bool = True, rounding: int = 4,
                              retain_captures: bool = False, overwrite_existing: bool = False, **texts) -> str:
    """Dictionary categories of texts."""
    lexicons = dictionary.load_lexicons(dict_paths)

    def work(df: DataFrame, keep: list[str]) -> DataFrame:
        out = dictionary.code(df, lexicons, keep=keep, relative=relative_freq, rounding=rounding, drop_punct=drop_punct, retain_captures=retain_captures)
        return out.withColumn("captures", F.to_json("captures")) if retain_captures else out

    return _measured(work, out_features_csv, "dictionary", overwrite_existing, **texts)


@call
def analyze_readability(out_features_csv: str | None = None, *, easy_words: list[str] | None = None, overwrite_existing: bool = False, **texts) -> str:
    """Readability indices of texts."""
    return _measured(lambda df, keep: readability.readability(df, keep=keep, easy_words=easy_words), out_features_csv, "readability", overwrite_existing, **texts)


@call
def analyze_lexical_richness(out_features_csv: str | None = None, *, metrics: list[str] | None = None, msttr_window: int = 100, mattr_window: int = 100, mtld_threshold: float = 0.72,
                             hdd_draws: int = 42, vocd_ntokens: int = 50, vocd_within_sample: int = 100, vocd_iterations: int = 3, vocd_seed: int = 42,
                             overwrite_existing: bool = False, **texts) -> str:
    """Lexical richness of texts."""
    how = {"metrics": metrics, "msttr_window": msttr_window, "mattr_window": mattr_window, "mtld_threshold": mtld_threshold, "hdd_draws": hdd_draws, "vocd_ntokens": vocd_ntokens,
           "vocd_within_sample": vocd_within_sample, "vocd_iterations": vocd_iterations, "vocd_seed": vocd_seed}
    return _measured(lambda df, keep: lexical.lexical_richness(df, keep=keep, **how), out_features_csv, "lexical-richness", overwrite_existing, **texts)


@call
def analyze_with_archetypes(out_features_csv: str | None = None, *, archetype_csvs: list[str], model_name: str, mean_center_vectors: bool = True, fisher_z_transform: bool = False,
                            rounding: int | None = 4, overwrite_existing: bool = False, **texts) -> str:
    """Archetype scores of texts, by a registered encoder of sentences."""
    blocks = {vectors.file_prefix(p): vectors.load_archetypes(p) for p in vectors.archetype_paths(archetype_csvs)}
    how = {"center": mean_center_vectors, "fisher_z": fisher_z_transform, "rounding": rounding}
    work = lambda df, keep: vectors.score_archetypes(df, blocks, encoder(model_name), pass_through=keep, **how)
    return _measured(work, out_features_csv, "archetypes", overwrite_existing, **texts)


@call
def analyze_with_sentence_embeddings(out_features_csv: str | None = None, *, model_name: str, batch_size: int = 32, normalize_l2: bool = True, rounding: int | None = None,
                                     overwrite_existing: bool = False, **texts) -> str:
    """Mean sentence vectors of texts as ``e0`` and on, by a registered encoder of sentences."""
    encode = encoder(model_name)
    width = len(encode(["one"])[0])

    def work(df: DataFrame, keep: list[str]) -> DataFrame:
        out = vectors.sentence_embeddings(df, encode, pass_through=keep, normalize=normalize_l2, rounding=rounding, batch=batch_size)
        return vectors.expand(out, "vector", width)

    return _measured(work, out_features_csv, "sentence-embeddings", overwrite_existing, **texts)


@call
def convert_subtitles(input: str, to: str, output: str | None = None, *, include_name: bool = False, encoding: str | None = None) -> str:
    """A subtitle file as ``csv``, ``srt`` or ``vtt``."""
    out = output or str(Path("features", "subtitles", f"{Path(input).stem}.{to}"))
    found = subtitles.convert(_spark(), os.path.abspath(input), to, encoding=encoding)
    if to == "csv":
        rows = found.orderBy("cue")
        rows = rows.withColumn("name", F.lit("")).select("start_time", "end_time", "name", "text") if include_name else rows.select("start_time", "end_time", "text")
        return files.write_csv_file(rows, out, overwrite=True)
    os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
    Path(out).write_text(found.first()["content"], encoding="utf-8")
    return out


# ---- feature tables and files

@call
def feature_gather(root_dir: str, out_csv: str | None = None, *, pattern: str = "*.csv", recursive: bool = True, delimiter: str | None = None, add_source_path: bool = False,
                   aggregate: bool = False, group_by: list[str] | None = None, per_file: bool = True, stats: list[str] | None = None, exclude_cols: list[str] | None = None,
                   include_regex: str | None = None, exclude_regex: str | None = None, dropna: bool = False, overwrite_existing: bool = False) -> str:
    """The union of a folder's feature tables, or their statistics by group."""
    out = out_csv or str(Path(root_dir).with_suffix(".csv"))
    if _kept(out, overwrite_existing):
        return out
    df, _ = files.gather_csvs(_spark(), root_dir, pattern=pattern, recursive=recursive, delimiter=delimiter, add_source_path=add_source_path)
    if aggregate:
        if not group_by:
            raise ValueError("statistics need group_by")
        plan = features.AggregationPlan(group_by, per_file=per_file, stats=stats or ["mean", "std"], exclude_cols=exclude_cols or [], include_regex=include_regex, exclude_regex=exclude_regex, dropna=dropna)
        df = features.aggregate_features(df, plan)
    return files.write_csv_file(df, out, overwrite=True)


@call
def find_files(root_dir: str, *, file_type: str = "video", extensions: list[str] | None = None, recursive: bool = True, include_hidden: bool = False, follow_symlinks: bool = False,
               include_globs: list[str] | None = None, exclude_globs: list[str] | None = None, absolute: bool = True, ffprobe_verify: bool = False) -> list[str]:
    """Media files below a folder."""
    return files.find_files(root_dir, file_type=file_type, extensions=extensions, recursive=recursive, include_hidden=include_hidden, follow_symlinks=follow_symlinks,
                            include_globs=include_globs, exclude_globs=exclude_globs, absolute=absolute, verify=ffprobe_verify)


# ---- recordings

def _contents(path: str) -> DataFrame:
    return _spark().read.format("binaryFile").load(os.path.abspath(path)).select(F.lit(path).alias("path"), "content")


def _written(rows: list, target: Callable) -> list[str]:
    out = []
    for r in rows:
        if "error" in r.__fields__ and r["error"]:
            raise ValueError(f"{r['path']}: {r['error']}")
        path = Path(target(r))
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes(r["content"]))
        out.append(str(path))
    return out


@call
def convert_to_wav(input_path: str, output_path: str | None = None, *, output_dir: str | None = None, sample_rate: int = 16000, bit_depth: int = 16, channels: int = 1,
                   overwrite_existing: bool = False) -> str:
    """A recording as PCM WAV."""
    out = output_path or str(Path(output_dir or "audio", f"{Path(input_path).stem}.wav"))
    if _kept(out, overwrite_existing):
        return out
    return _written(media.convert(_contents(input_path), sample_rate=sample_rate, bit_depth=bit_depth, channels=channels).collect(), lambda r: out)[0]


@call
def split_streams_to_wav(input_path: str, output_dir: str = "audio", *, sample_rate: int = 48000, bit_depth: int = 16) -> list[str]:
    """Every audio stream of a media file as PCM WAV."""
    rows = media.split_streams(_contents(input_path), sample_rate=sample_rate, bit_depth=bit_depth).collect()
    return _written(rows, lambda r: Path(output_dir, f"{Path(input_path).stem}_stream{r['stream']}.wav"))


@call
def diarize(audio_path: str, out_dir: str = "transcripts", *, backend: str = "diarization", overwrite_existing: bool = False) -> dict:
    """Speakers' utterances of a recording by a registered backend, which gives start_time and
    end_time in milliseconds, speaker and text; written as CSV, SRT and text."""
    stem = Path(audio_path).stem
    paths = {kind: str(Path(out_dir, stem, f"{stem}.{kind}")) for kind in ("csv", "srt", "txt")}
    if not _kept(paths["csv"], overwrite_existing):
        rows = speech.run_backend(backend, _contents(audio_path)).select("start_time", "end_time", "speaker", "text")
        files.write_csv_file(rows.orderBy("start_time", "end_time"), paths["csv"], overwrite=True)
        from pyspark.sql import Window

        cue = F.row_number().over(Window.partitionBy("path").orderBy("start_time", "end_time"))
        cues = rows.select(F.lit(stem).alias("path"), F.col("start_time").cast("long").alias("start_time"), F.col("end_time").cast("long").alias("end_time"), "speaker", "text").withColumn("cue", cue)
        cues = cues.withColumnsRenamed({"start_time": "start_ms", "end_time": "end_ms"})
        for kind, made in (("srt", subtitles.to_lines(cues, "srt", name="speaker")), ("txt", subtitles.transcript_text(cues, "speaker"))):
            first = made.first()
            Path(paths[kind]).write_text(first["content"] if first else "", encoding="utf-8")
    return {"work_dir": str(Path(out_dir, stem)), "raw_files": paths}


def _turns(path: str, transcript_csv: str, start_col: str, end_col: str, speaker_col: str) -> DataFrame:
    table = files.read_csv(_spark(), transcript_csv)
    a, b, who = transcripts.transcript_columns(table.columns, start_col, end_col, speaker_col)
    rest = [F.col(quoted(c)) for c in table.columns if c not in (a, b, who, "path")]
    return table.select(F.lit(path).alias("path"), F.col(quoted(a)).alias("start_time"), F.col(quoted(b)).alias("end_time"), F.col(quoted(who)).alias("speaker"), *rest)


@call
def split_wav_by_speaker(source_wav: str, transcript_csv_path: str, output_dir: str | None = None, *, start_col: str = "start_time", end_col: str = "end_time",
                         speaker_col: str = "speaker", time_unit: str = "ms", silence_ms: int = 1000, min_dur_ms: int = 50, sr: int = 16000,
                         overwrite_existing: bool = False) -> list[str]:
    """Each speaker's segments of a recording as one WAV file."""
    folder = Path(output_dir or Path("audio_split", Path(source_wav).stem))
    if not overwrite_existing and folder.is_dir() and (there := sorted(map(str, folder.glob("*.wav")))):
        return there
    turns = transcripts.valid_turns(_turns(source_wav, transcript_csv_path, start_col, end_col, speaker_col), "start_time", "end_time", unit=time_unit, least=1)
    sounds = media.convert(_contents(source_wav), sample_rate=sr).where("error is null").select("path", "content")
    rows = transcripts.speaker_sounds(sounds, turns, silence_ms=silence_ms, least_ms=min_dur_ms).collect()
    return _written(rows, lambda r: folder / f"{Path(source_wav).stem}_{r['speaker']}.wav")


@call
def analyze_vocal_acoustics(wav_path: str, transcript_csv: str | None = None, *, time_unit: str = "ms", group_by: list[str] | None = None, out_dir: str = "features/acoustics",
                            start_col: str = "start_time", end_col: str = "end_time", speaker_col: str = "speaker", include_framewise: bool = False,
                            summarize_on_voiced_segments_ms: int | None = 100, preprocess: bool = True, target_sr: int = 44100, target_dbfs: float = -20.0,
                            pause_top_db: float = 30.0, pause_frame_length: int = 2048, pause_hop_length: int = 512, overwrite_existing: bool = False) -> dict:
    """Voice measures of a recording, or of each turn of its transcript and their means and
    deviations by ``group_by``; frame by frame too if asked for."""
    stem, out = Path(wav_path).stem, {}
    how = {"preprocess": preprocess, "target_rate": target_sr, "target_dbfs": target_dbfs}
    sums = {"voiced_ms": summarize_on_voiced_segments_ms, "top_db": pause_top_db, "frame": pause_frame_length, "hop": pause_hop_length}
    name = lambda kind: str(Path(out_dir, f"{stem}_{kind}.csv"))
    sounds = _contents(wav_path)
    if include_framewise:
        out["framewise"] = name("framewise")
        if not _kept(out["framewise"], overwrite_existing):
            files.write_csv_file(voice.framewise(sounds, **how).orderBy("frame").drop("path", "frame"), out["framewise"], overwrite=True)
    if transcript_csv is None:
        out["summary"] = name("summary")
        if not _kept(out["summary"], overwrite_existing):
            files.write_csv_file(voice.analyze(sounds, **sums, **how), out["summary"], overwrite=True)
        return out
    out["turns"] = name("turns")
    if not _kept(out["turns"], overwrite_existing):
        turns = transcripts.valid_turns(_turns(wav_path, transcript_csv, start_col, end_col, speaker_col), "start_time", "end_time", unit=time_unit, least=20)
        each = transcripts.turn_voices(sounds, turns, voiced_ms=summarize_on_voiced_segments_ms, top_db=pause_top_db, frame=pause_frame_length, hop=pause_hop_length, **how)
        files.write_csv_file(each, out["turns"], overwrite=True)
    if group_by:
        out["summary"] = name("summary_by_" + "_".join(group_by))
        if not _kept(out["summary"], overwrite_existing):
            each = files.read_csv(_spark(), out["turns"], delimiter=",")
            numbers = [F.col(quoted(c)).try_cast("double").alias(c) for c in each.columns if c in voice.SUMMARY]
            files.write_csv_file(turn_summary(each.select(*[F.col(quoted(g)) for g in group_by], *numbers), group_by), out["summary"], overwrite=True)
    return out


@call
def extract_sound_embeddings(source_wav: str, transcript_csv: str | None = None, *, model_name: str, out_dir: str = "features/sound-embeddings", time_unit: str = "auto",
                             strategy: str = "windows", window_s: float = 30.0, hop_s: float = 15.0, min_seg_s: float = 1.0, top_db: float = 30.0, aggregate: str = "none",
                             apply_l2_normalization: bool = False, start_col: str = "start_time", end_col: str = "end_time", speaker_col: str = "speaker",
                             overwrite_existing: bool = False) -> str:
    """Vectors of a recording's segments or turns as ``e0`` and on, by a registered encoder of sound."""
    out = str(Path(out_dir, f"{Path(source_wav).stem}_embeddings.csv"))
    if _kept(out, overwrite_existing):
        return out
    sounds, encode = media.convert(_contents(source_wav)).where("error is null").select("path", "content"), encoder(model_name)
    if transcript_csv is None:
        how = {"strategy": strategy, "window_s": window_s, "hop_s": hop_s, "least_s": min_seg_s, "top_db": top_db}
        found = media.segment_embeddings(sounds, encode, aggregate=aggregate, normalize=apply_l2_normalization, **how)
    else:
        found = media.turn_embeddings(sounds, _turns(source_wav, transcript_csv, start_col, end_col, speaker_col), encode, unit=time_unit, normalize=apply_l2_normalization)
    first = found.first()
    width = len(first["vector"]) if first else 0
    return files.write_csv_file(vectors.expand(found.drop("path"), "vector", width), out, overwrite=True)
