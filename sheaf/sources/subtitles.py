"""Subtitles: SubRip and WebVTT to cues and back, and transcripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import format_ms
from sheaf.runtime import ship

_TIME = re.compile(r"(\d{1,2}):([0-5]\d):([0-5]\d)[,.](\d{3})")
_LINE = re.compile(rf"\s*{_TIME.pattern}\s*-->\s*{_TIME.pattern}(.*)$")
Cue = tuple[int | None, int, int, str]


def _span(line: str) -> tuple[int, int]:
    m = _LINE.match(line)
    if not m:
        raise ValueError(f"no time line: {line!r}")
    g = [int(x) for x in m.groups()[:8]]
    a, b = (((x[0] * 60 + x[1]) * 60 + x[2]) * 1000 + x[3] for x in (g[:4], g[4:]))
    return a, b


def _blocks(text: str) -> Iterator[list[str]]:
    block: list[str] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.strip():
            block.append(line)
        elif block:
            yield block
            block = []
    if block:
        yield block


def parse_srt(text: str) -> list[Cue]:
    cues: list[Cue] = []
    for block in _blocks(text.removeprefix("﻿")):
        number = int(block[0]) if block[0].strip().isdigit() else None
        body = block[1:] if number is not None else block
        if not body:
            raise ValueError(f"a cue without a time line after {block[0]!r}")
        cues.append((number, *_span(body[0]), "\n".join(body[1:])))
    return cues


def parse_vtt(text: str) -> list[Cue]:
    cues: list[Cue] = []
    for k, block in enumerate(_blocks(text.removeprefix("﻿"))):
        head = block[0].strip()
        if k == 0 and head.startswith("WEBVTT") or head.startswith(("NOTE", "STYLE", "REGION")) and "-->" not in head:
            continue
        body = block[1:] if "-->" not in block[0] and len(block) > 1 and "-->" in block[1] else block
        number = int(head) if body is not block and head.isdigit() else None
        cues.append((number, *_span(body[0]), "\n".join(body[1:])))
    return cues


CUES = "path string, cue int, number int, start_ms bigint, end_ms bigint, text string"


def decoded(content: bytes, encoding: str | None = None) -> str:
    """Text of a file: in the given encoding, else in what its byte order mark or a detector,
    if one is installed, says, else UTF-8; stray bytes are replaced."""
    if encoding is None:
        if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
            encoding = "utf-16"
        else:
            try:
                content.decode("utf-8")
            except UnicodeDecodeError:
                try:
                    import chardet

                    encoding = chardet.detect(content)["encoding"]
                except ImportError:
                    pass
    return content.decode(encoding or "utf-8", "replace").removeprefix("\ufeff")


def parse_contents(files: DataFrame, *, encoding: str | None = None) -> DataFrame:
    """One row per cue of each of the files ``path, content``; paths that end in ``.vtt`` as
    WebVTT, all others as SubRip."""
    ship(files.sparkSession)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, content in zip(frame["path"], frame["content"]):
                text = decoded(bytes(content), encoding)
                cues = parse_vtt(text) if p.lower().endswith(".vtt") else parse_srt(text)
                rows += [(p, k, *c) for k, c in enumerate(cues, 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CUES.split(", ")]).astype({"number": "Int32"})

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(parse, CUES)


def read_subtitles(spark: SparkSession, path: str, *, encoding: str | None = None) -> DataFrame:
    """The cues of a file or of the files of a folder."""
    return parse_contents(spark.read.format("binaryFile").load(path), encoding=encoding)


def to_lines(cues: DataFrame, kind: str, *, name: str | None = None) -> DataFrame:
    """path and ``content`` of a whole subtitle file: ``srt`` numbers cues anew, ``vtt`` has
    its header; ``name`` is a column of speakers to put before the text."""
    mark = {"srt": ",", "vtt": "."}[kind]
    said = F.concat(F.col(name), F.lit(": "), F.col("text")) if name else F.col("text")
    span = F.concat(format_ms(F.col("start_ms"), mark), F.lit(" --> "), format_ms(F.col("end_ms"), mark))
    each = cues.select("path", "cue", F.concat(span, F.lit("\n"), F.regexp_replace(said, "-->", "->")).alias("b"))
    body = F.sort_array(F.collect_list(F.struct("cue", "b")))
    grouped = each.groupBy("path").agg(body.alias("l"))
    block: Column = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), x["b"]) if kind == "srt" else x["b"])
    head = F.lit("WEBVTT\n\n" if kind == "vtt" else "")
    return grouped.select("path", F.concat(head, F.array_join(block, "\n\n"), F.lit("\n")).alias("content"))


def to_table(cues: DataFrame, *, name: str | None = None) -> DataFrame:
    """path, cue, and the columns of a transcript table: whole milliseconds as text."""
    times = [F.col(f"{k}_ms").cast("bigint").cast("string").alias(f"{k}_time") for k in ("start", "end")]
    return cues.select("path", "cue", *times, *([F.coalesce(F.col(name), F.lit("")).alias("name")] if name else []), "text")


def convert(spark: SparkSession, path: str, to: str, *, name: str | None = None, encoding: str | None = None) -> DataFrame:
    """Subtitle files as ``csv`` rows, or as one ``srt`` or ``vtt`` content a file."""
    if to not in ("csv", "srt", "vtt"):
        raise ValueError("to is csv, srt or vtt")
    cues = read_subtitles(spark, path, encoding=encoding)
    return to_table(cues, name=name) if to == "csv" else to_lines(cues, to, name=name)


def transcript_text(cues: DataFrame, speaker: str) -> DataFrame:
    """path and ``content``: a paragraph for every run of one speaker."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("cue")
    change = (~F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) | (F.row_number().over(w) == 1)).cast("int")
    runs = cues.withColumn("n", change).withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = runs.groupBy("path", "run").agg(F.first(speaker).alias("s"), F.sort_array(F.collect_list(F.struct("cue", "text"))).alias("l"))
    para = said.select("path", "run", F.concat(F.col("s"), F.lit(": "), F.array_join(F.transform("l", lambda x: F.regexp_replace(x["text"], "-->", "->")), " ")).alias("p"))
    return para.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("run", "p"))).alias("l")).select("path", F.array_join(F.transform("l", lambda x: x["p"]), "\n\n").alias("content"))
