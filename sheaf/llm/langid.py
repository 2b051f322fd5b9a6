"""Language identification by rank-order profiles of character n-grams.

A profile is a list of the most frequent n-grams (one to three characters over letters,
words joined by single spaces) in order of frequency, ties by code. A text's profile is
compared to each language's: every n-gram counts the distance between its two ranks, or
the profile length if the language lacks it. The language of least total distance wins,
ties go to the smaller name.

Training reads at most about ``train_docs`` documents of each language, chosen by a hash
of their id; that bound is the only sampling. Counting is spread over the tasks, and only
the profiles come to the driver: ``profile`` rows for each language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null or
repeated document id keeps its row, and a null id is never trained on; no training rows at
all gives ``und`` everywhere; an empty table gives no rows; other columns are ignored;
texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import workercache
from sheaf.runtime import quoted, ship

UNKNOWN = "und"
_SPACE = 32
_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a space."""
    global _table
    if _table is None:
        table = np.full(0x110000, _SPACE, dtype=np.int64)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _table = table
    return _table


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as packed code points, ascending, and their counts."""
    empty = np.zeros(0, dtype=np.int64)
    if not text:
        return empty, empty
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    padded = np.concatenate(([_SPACE], points, [_SPACE]))
    gap = padded == _SPACE
    padded = padded[~(gap & np.concatenate(([False], gap[:-1])))]
    if len(padded) < 3:  # nothing but the spaces around
        return empty, empty
    two = padded[:-1] << 21 | padded[1:]
    three = two[:-1] << 21 | padded[2:]
    codes = np.concatenate((padded[padded != _SPACE], two, three))
    codes.sort()
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.append(at, len(codes)))


class Profiles:
    def __init__(self, ranked: dict[str, list[int]], length: int):
        self.length = length
        self.names = sorted(ranked)
        self.codes, self.ranks = [], []
        for name in self.names:
            codes = np.array(ranked[name][:length], dtype=np.int64)
            order = np.argsort(codes)
            self.codes.append(codes[order])
            self.ranks.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = codes[np.argsort(-counts, kind="stable")[: self.length]]
        own = np.arange(len(top))
        best, least = UNKNOWN, None
        for name, known, ranks in zip(self.names, self.codes, self.ranks):
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            out = np.where(known[at] == top, np.abs(ranks[at] - own), self.length).sum()
            if least is None or out < least:
                best, least = name, int(out)
        return best, 1.0 - least / (self.length * len(top))


def train(rows: DataFrame, *, train_docs: int = 400, length: int = 300) -> dict[str, list[int]]:
    """Profiles of rows ``doc_id, text, lang``; rows without id or language are left out."""
    spark = rows.sparkSession
    ship(spark)
    known = rows.where("lang is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    shares = spark.createDataFrame([(k, min(1.0, train_docs / n)) for k, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = total.setdefault(lang, {})
                codes, counts = ngrams(text)
                for c, n in zip(codes.tolist(), counts.tolist()):
                    mine[c] = mine.get(c, 0) + n
                if len(mine) > 500_000:
                    yield _counted(lang, total.pop(lang))
        for lang, mine in total.items():
            yield _counted(lang, mine)

    totals = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = totals.withColumn("rank", rank).where(F.col("rank") <= length).select("lang", "code", "rank").collect()
    found: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["code"])
    return found


def _counted(lang: str, counts: dict[int, int]) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
        names=["lang", "code", "n"],
    )


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def predict(docs: DataFrame, ranked: dict[str, list[int]], length: int = 300) -> DataFrame:
    """doc_id, lang_pred, score of rows ``doc_id, text``."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workercache.clear()
        profiles = Profiles(ranked, length)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [profiles.predict(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.mapInArrow(scan, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             train_docs: int = 400, length: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents of fold 0 of 5 are never trained on."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"),
                       F.col(quoted(lang_col)).alias("lang"))
    ranked = train(rows.where(fold(F.col("doc_id"), 5) != 0), train_docs=train_docs, length=length)
    found = predict(rows.select("doc_id", "text"), ranked, length)
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def only_known(docs: DataFrame, ranked: dict[str, list[int]], text_col: str, length: int = 300) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language among
    ``ranked``; without any learned language, those with a letter."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workercache.clear()
        profiles = Profiles(ranked, length)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(place).to_pylist()
                found = [profiles.predict(t)[0] != UNKNOWN if ranked else len(ngrams(t)[0]) > 0 for t in texts]
                yield part.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
