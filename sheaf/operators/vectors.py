"""Vectors: pooling, normalising, sentence embeddings and archetype scores."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions.text import sentences
from sheaf.runtime import quoted, require, ship


def l2(vector: Column) -> Column:
    """Length one; a vector shorter than 1e-12 stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm < 1e-12, vector).otherwise(F.transform(vector, lambda x: x / norm))


def mean_pool(df: DataFrame, keys: list[str], vector: str, *, normalize: bool = True, held: int = 2000) -> DataFrame:
    """Mean vector of each group, over the components that are there.

    Each task adds its vectors up in Arrow batches and gives one row of sums for a group, or
    more if it meets over ``held`` groups; only these are shuffled.
    """
    ship(df.sparkSession)
    chosen = df.select(*[F.col(quoted(k)) for k in keys], F.col(quoted(vector)).cast("array<double>").alias("__v")).where("__v is not null")
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("__s", T.ArrayType(T.DoubleType())), T.StructField("__n", T.ArrayType(T.LongType()))])
    width = len(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def given() -> pa.RecordBatch:
            names = list(zip(*held_sums)) or [()] * width
            kinds = [batch.schema.field(k).type for k in range(width)]
            cols = [pa.array(n, kind) for n, kind in zip(names, kinds)]
            cols += [pa.array([x[part].tolist() for x in held_sums.values()], kind) for part, kind in ((0, pa.list_(pa.float64())), (1, pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

        batch = None
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(width)))) if width else [()] * batch.num_rows
            rows: dict[tuple, list[int]] = {}
            for at, key in enumerate(names):
                rows.setdefault(key, []).append(at)
            lists = batch.column(width)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
            for key, at in rows.items():
                longest = int(sizes[at].max(initial=0))
                total, count = held_sums.get(key, (np.zeros(0), np.zeros(0, dtype=np.int64)))
                if longest > len(total):
                    total, count = (np.pad(x, (0, longest - len(x))) for x in (total, count))
                for n in np.unique(sizes[at]):
                    some = np.asarray(at)[sizes[at] == n]
                    block = flat[starts[some][:, None] + np.arange(n)]
                    there = ~np.isnan(block)
                    total[:n] += np.where(there, block, 0).sum(axis=0)
                    count[:n] += there.sum(axis=0)
                held_sums[key] = total, count
            if len(held_sums) > held:
                yield given()
                held_sums = {}
        if held_sums:
            yield given()

    sums = chosen.mapInArrow(partial, schema)
    by = [F.col(quoted(k)) for k in keys]
    parts = sums.select(*by, F.posexplode(F.arrays_zip("__s", "__n")).alias("__d", "__x"))
    means = parts.groupBy(*by, "__d").agg((F.sum("__x.__s") / F.nullif(F.sum("__x.__n"), F.lit(0))).alias("__m"))
    pooled = means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__d", "__m"))), lambda x: x["__m"]).alias(vector))
    return pooled.withColumn(vector, l2(F.col(quoted(vector)))) if normalize else pooled


#: An encoder turns a list of sentences into an array of one vector for each.
Encoder = Callable[[list[str]], np.ndarray]


def sentence_vectors(df: DataFrame, encode: Encoder, *, text_col: str = "text", keep: list[str] | None = None, batch: int = 32) -> DataFrame:
    """``keep`` columns, ``sentence`` from 1, ``wc`` words and ``vector`` of every sentence."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    kept = [F.col(quoted(k)) for k in keep]
    rows = df.select(*kept, F.posexplode(sentences(F.col(quoted(text_col)))).alias("__k", "__s"))

    @F.pandas_udf("array<double>")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found = [np.asarray(encode(texts.iloc[at : at + batch].tolist()), dtype=np.float64) for at in range(0, len(texts), batch)]
            yield pd.Series([v.tolist() for block in found for v in block], dtype=object)

    wc = F.size(F.split(F.col("__s"), r"(?U)\s+")).cast("long")
    return rows.select(*kept, (F.col("__k") + 1).cast("long").alias("sentence"), wc.alias("wc"), encoded("__s").alias("vector"))


def sentence_embeddings(df: DataFrame, encode: Encoder, *, text_col: str = "text", id_col: str = "text_id", pass_through: list[str] | None = None,
                        normalize: bool = True, rounding: int | None = None, batch: int = 32) -> DataFrame:
    """``id_col``, the columns ``pass_through`` and ``vector``: the mean of a text's sentence
    vectors. A text without sentences has a null vector; a missing column is empty text.

    Rows are told apart by their place, so repeated ids stay rows of their own. A text's
    sentences are encoded where the text is; nothing is shuffled.
    """
    ship(df.sparkSession)
    require(df, [id_col, text_col])
    given = [c for c in dict.fromkeys(pass_through or []) if c != id_col]
    kept = [F.col(quoted(id_col)), *[F.col(quoted(c)) if c in df.columns else F.lit("").alias(c) for c in given]]

    @F.pandas_udf("array<double>")
    def pooled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in parts:
            out = []
            for said in lists:
                said = [] if said is None else list(said)
                blocks = [np.asarray(encode(said[at : at + batch]), dtype=np.float64) for at in range(0, len(said), batch)]
                out.append(np.concatenate(blocks).mean(axis=0).tolist() if blocks else None)
            yield pd.Series(out, dtype=object)

    made = df.select(*kept, pooled(sentences(F.coalesce(F.col(quoted(text_col)), F.lit("")))).alias("vector"))
    if normalize:
        made = made.withColumn("vector", l2(F.col("vector")))
    return made.withColumn("vector", F.transform("vector", lambda x: F.round(x, rounding))) if rounding is not None else made


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def archetype_scores(df: DataFrame, archetypes: list[tuple[str, list[float]]], vector: str, *, prefix: str = "arch", mean: list[float] | None = None,
                     fisher_z: bool = False) -> DataFrame:
    """Add ``prefix__name``, the cosine to each archetype, after taking off ``mean``; Fisher's
    z of it if asked for. Archetypes are a few vectors given by the caller and sit in the plan."""
    base = F.col(vector).cast("array<double>")
    if mean is not None:
        base = F.zip_with(base, F.array(*[F.lit(float(m)) for m in mean]), lambda x, y: x - y)
    out = df.withColumn("__unit", l2(base))
    for name, v in archetypes:
        shifted = [x - (mean[k] if mean is not None else 0.0) for k, x in enumerate(v)]
        size = sum(x * x for x in shifted) ** 0.5 or 1.0
        score = dot(F.col("__unit"), F.array(*[F.lit(float(x / size)) for x in shifted]))
        if fisher_z:
            score = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), score)))
        out = out.withColumn(f"{prefix}__{name}", score)
    return out.drop("__unit")


def archetype_paths(paths: list[str]) -> list[str]:
    """Archetype files: those given and the CSV files in folders that are given, each once,
    in order of their paths."""
    found: set[str] = set()
    for p in map(Path, paths):
        if not p.exists():
            raise FileNotFoundError(p)
        found |= {str(f.resolve()) for f in p.glob("*.csv")} if p.is_dir() else {str(p.resolve())}
    if not found:
        raise ValueError("no archetype files found")
    return sorted(found)


def load_archetypes(path: str, *, headers: bool = True) -> dict[str, list[str]]:
    """Archetypes of a CSV file with a name and a sentence in each row."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = [r for r in csv.reader(f) if len(r) > 1 and r[0].strip() and r[1].strip()]
    found: dict[str, list[str]] = {}
    for name, sentence, *_ in rows[1:] if headers else rows:
        found.setdefault(name.strip(), []).append(sentence.strip())
    return found


def archetype_vectors(archetypes: dict[str, list[str]], encode: Encoder) -> list[tuple[str, list[float]]]:
    """Each archetype's mean vector over its sentences."""
    return [(name, np.asarray(encode(said), dtype=np.float64).mean(axis=0).tolist()) for name, said in archetypes.items()]


def score_archetypes(df: DataFrame, blocks: dict[str, dict[str, list[str]]], encode: Encoder, *, text_col: str = "text", id_col: str = "text_id",
                     pass_through: list[str] | None = None, center: bool = True, fisher_z: bool = False, rounding: int | None = 4) -> DataFrame:
    """``id_col``, the columns ``pass_through``, ``WC`` and ``prefix__name`` for the archetypes
    of each block: the mean of a text's sentence scores, weighted by their words. ``center``
    takes the mean of a block's archetype vectors off both sides first. A text without
    sentences has no words and scores of 0.
    """
    ship(df.sparkSession)
    require(df, [id_col, text_col])
    made: list[tuple[str, np.ndarray, np.ndarray]] = []  # column, unit vector, what is taken off
    for prefix, archetypes in blocks.items():
        found = archetype_vectors(archetypes, encode)
        off = np.mean([v for _, v in found], axis=0) if center and len(found) > 1 else np.zeros(len(found[0][1]))
        for name, v in found:
            x = np.asarray(v) - off
            made.append((f"{prefix}__{name}", x / max(float(np.linalg.norm(x)), 1e-12), off))
    names = ["WC", *(m[0] for m in made)]
    given = [c for c in dict.fromkeys(pass_through or []) if c != id_col]
    kept = [F.col(quoted(id_col)), *[F.col(quoted(c)) if c in df.columns else F.lit("").alias(c) for c in given]]

    @F.pandas_udf("wc bigint, scores array<double>")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in parts:
            rows = []
            for said in lists:
                said = [] if said is None else list(said)
                words = np.array([len(s.split()) for s in said], dtype=np.float64)
                if not words.sum():
                    rows.append((0, [0.0] * len(made)))
                    continue
                vectors = np.asarray(encode(said), dtype=np.float64)
                scores = []
                for _, unit, off in made:
                    x = vectors - off
                    cosine = x @ unit / np.maximum(np.linalg.norm(x, axis=1), 1e-12)
                    if fisher_z:
                        cosine = np.arctanh(np.clip(cosine, -0.999999, 0.999999))
                    scores.append(float((cosine * words).sum() / words.sum()))
                rows.append((int(words.sum()), scores))
            yield pd.DataFrame(rows, columns=["wc", "scores"])

    out = df.select(*kept, scored(sentences(F.coalesce(F.col(quoted(text_col)), F.lit("")))).alias("__s"))
    score = lambda k: F.get(F.col("__s.scores"), k)
    return out.select(*kept, F.col("__s.wc").alias("WC"), *[(F.round(score(k), rounding) if rounding is not None else score(k)).alias(n) for k, n in enumerate(names[1:])])


def file_prefix(path: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", Path(path).stem).strip("_") or "archetypes"


def expand(df: DataFrame, vector: str, dimensions: int) -> DataFrame:
    """``e0..`` instead of the array; for sinks that hold scalars only."""
    return df.select(*[c for c in df.columns if c != vector], *[F.get(F.col(vector), k).alias(f"e{k}") for k in range(dimensions)])
