"""Sources: CSV and text folders, file discovery, delimiters; and sinks."""

from __future__ import annotations

import csv
import fnmatch
import os
import shutil
import subprocess
from pathlib import Path

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.features import add_source, union_by_name
from sheaf.runtime import quoted

# File extensions by kind of media.
KINDS = {
    "audio": [".wav", ".flac", ".alac", ".aiff", ".aif", ".aifc", ".mp3", ".m4a", ".aac", ".ogg", ".oga", ".opus", ".wma", ".mka"],
    "video": [".mp4", ".m4v", ".mov", ".avi", ".mkv", ".webm", ".wmv", ".flv", ".mpeg", ".mpg", ".m2ts", ".ts", ".3gp", ".3g2", ".ogv"],
    "image": [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp", ".gif", ".heic", ".heif"],
    "subtitle": [".srt", ".vtt", ".ass", ".ssa", ".sub"],
    "archive": [".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar"],
}
# What a preset's inputs are found by; fewer than the kinds above.
INPUTS = {
    "video": [".mp4", ".mov", ".mkv", ".avi", ".m4v", ".wmv", ".flv", ".webm", ".mpg", ".mpeg", ".3gp"],
    "audio": [".wav", ".mp3", ".m4a", ".aac", ".flac", ".ogg", ".opus", ".wma", ".aiff", ".aif", ".aifc"],
}
# What the reader of feature tables takes for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def sniff_delimiter(sample: str, default: str = ",") -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return default


def _head(spark: SparkSession, path: str, size: int = 8192) -> str:
    """The first bytes of a file, by the reader Spark uses for its store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(b & 255 for b in stream.readNBytes(size)).decode("utf-8", "ignore")
    finally:
        stream.close()


def read_csv(spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings; quoted cells may hold line ends and doubled quotes."""
    path = os.path.abspath(path) if os.path.exists(path) else path  # Spark may run in another folder
    sep = delimiter or sniff_delimiter(_head(spark, path))
    return (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("sep", sep).option("encoding", "UTF-8" if encoding.lower().startswith("utf-8") else encoding).csv(path)
    )


def list_files(root: str, pattern: str = "*", recursive: bool = True) -> list[str]:
    base = Path(root)
    if base.is_file():
        return [str(base)]
    if not base.exists():
        return []
    return sorted(str(p) for p in (base.rglob(pattern) if recursive else base.glob(pattern)) if p.is_file())


def without_missing(df: DataFrame) -> DataFrame:
    """A table of text whose cells that stand for a missing value are null."""
    return df.select(*[F.when(~F.col(quoted(c)).isin(MISSING), F.col(quoted(c))).alias(c) for c in df.columns])


def gather_csvs(spark: SparkSession, root: str, *, pattern: str = "*.csv", recursive: bool = True, delimiter: str | None = None,
                add_source_path: bool = False) -> tuple[DataFrame, list[str]]:
    """The union of all readable CSV files under all their columns, with ``source`` first; and
    the files that could not be read."""
    frames, bad = [], []
    for path in list_files(root, pattern, recursive):
        try:
            frame = without_missing(read_csv(spark, path, delimiter=delimiter))
            frames.append(add_source(frame, Path(path).stem, path if add_source_path else None))
        except (AnalysisException, PySparkException, OSError, UnicodeError):
            bad.append(path)
    if not frames:
        raise FileNotFoundError(f"no readable {pattern} below {root}")
    return union_by_name(frames), bad


def read_texts(spark: SparkSession, root: str, *, pattern: str = "*.txt", recursive: bool = False, id_from: str = "stem") -> DataFrame:
    """text_id, text and source_path of each file; bytes that are no UTF-8 are dropped."""
    if id_from not in ("stem", "name", "path"):
        raise ValueError("id_from is stem, name or path")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)

    @F.pandas_udf("string")
    def decoded(content):
        return content.map(lambda b: bytes(b).decode("utf-8", "ignore").removeprefix("﻿"))

    path = F.regexp_replace("path", "^file:(//)?", "")
    name = F.element_at(F.split(path, "/"), -1)
    ident = {"stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "name": name, "path": F.regexp_replace(path, "^" + _regex(os.path.abspath(root)) + "/?", "")}[id_from]
    return files.select(ident.alias("text_id"), decoded("content").alias("text"), path.alias("source_path"))


def _regex(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in text)


def find_files(root: str, *, file_type: str = "video", extensions: list[str] | None = None, recursive: bool = True, include_hidden: bool = False,
               include_globs: list[str] | None = None, exclude_globs: list[str] | None = None, absolute: bool = True, follow_symlinks: bool = False, verify: bool = False) -> list[str]:
    """Media files by kind or extension, hidden ones pruned, sorted without regard to case.
    With ``verify`` audio and video files without such a stream go, if a prober is installed."""
    if extensions is None:
        if file_type == "any":
            extensions = [e for k, v in KINDS.items() if k != "archive" for e in v]
        elif file_type in KINDS:
            extensions = KINDS[file_type]
        else:
            raise ValueError(f"file_type is any or one of {sorted(KINDS)}")
    wanted = {("." + e.lstrip(".")).lower() for e in extensions}
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    found = []
    for folder, folders, names in os.walk(root, followlinks=follow_symlinks):
        folders[:] = [d for d in folders if recursive and (include_hidden or not d.startswith("."))]
        for n in names:
            rel = os.path.relpath(os.path.join(folder, n), root)
            if not include_hidden and n.startswith(".") or os.path.splitext(n)[1].lower() not in wanted:
                continue
            match = lambda globs: any(fnmatch.fnmatch(rel, g) or fnmatch.fnmatch(n, g) for g in globs)  # noqa: E731, B023
            if include_globs and not match(include_globs) or exclude_globs and match(exclude_globs):
                continue
            found.append(os.path.abspath(os.path.join(root, rel)) if absolute else rel)
    if verify and file_type in ("audio", "video"):
        found = [f for f in found if has_stream(f if absolute else os.path.join(root, f), file_type) is not False]
    return sorted(found, key=str.lower)


def discover_inputs(root: str, kind: str = "any") -> list[str]:
    """A preset's inputs below a folder: all files of a kind, or any files, sorted."""
    if kind != "any" and kind not in INPUTS:
        raise ValueError(f"kind is any or one of {sorted(INPUTS)}")
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    found = (str(p.resolve()) for p in Path(root).rglob("*") if p.is_file())
    return sorted(f for f in found if kind == "any" or os.path.splitext(f)[1].lower() in INPUTS[kind])


def has_stream(path: str, kind: str) -> bool | None:
    """Whether a media file has a stream of this kind; None where there is no prober."""
    prober = shutil.which("ffprobe")
    if prober is None:
        return None
    asked = [prober, "-v", "error", "-select_streams", kind[0], "-show_entries", "stream=index", "-of", "csv=p=0", path]
    done = subprocess.run(asked, capture_output=True, text=True)
    return done.returncode == 0 and bool(done.stdout.strip())


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def write_csv(df: DataFrame, path: str, *, overwrite: bool = False, single_file: bool = False, order_by: list[str] | None = None) -> str:
    """A folder of CSV parts, in any store that Spark writes. An existing result is returned
    unread unless ``overwrite``. ``single_file`` moves the finished rows, not their
    computation, to one task."""
    if not overwrite and _exists(df.sparkSession, f"{path}/_SUCCESS"):
        return path
    out = df.orderBy(*[F.col(quoted(c)).asc_nulls_last() for c in order_by]) if order_by else df
    if single_file:
        out = out.repartition(1).sortWithinPartitions(*[F.col(quoted(c)).asc_nulls_last() for c in order_by]) if order_by else out.repartition(1)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_csv_file(df: DataFrame, path: str, *, overwrite: bool = False, bom: bool = True) -> str:
    """One CSV file with a byte order mark, for programs that want a file: the parts that
    Spark wrote, joined by the driver one after another. For results, not for corpora."""
    if not overwrite and os.path.exists(path):
        return path
    folder = f"{os.path.abspath(path)}.parts"
    os.makedirs(os.path.dirname(folder), exist_ok=True)
    write_csv(df, folder, overwrite=True)
    with open(path, "wb") as out:
        out.write(b"\xef\xbb\xbf" if bom else b"")
        for k, part in enumerate(sorted(Path(folder).glob("part-*.csv"))):
            with part.open("rb") as f:
                head = f.readline()
                if k == 0:
                    out.write(head)
                shutil.copyfileobj(f, out)
        if not list(Path(folder).glob("part-*.csv")):
            out.write((",".join(df.columns) + "\n").encode())
    shutil.rmtree(folder)
    return path
