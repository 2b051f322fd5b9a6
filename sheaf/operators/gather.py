"""Text gathering: rows to one text each, columns to rows, groups to ordered texts."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import composed_id
from sheaf.runtime import materialize, quoted, require


def _col(name: str) -> Column:
    return F.col(quoted(name))


def with_row_ids(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Add ``row_n``, n from 1 in the given order, before any filter.

    Rows are dealt by ranges of the order and written with their place; a number is a row's
    place in its range plus the rows of the ranges before, whose counts, one for a task, are
    all that passes through the driver. Rows that the order leaves equal are told apart by
    nothing, and one of equal rows may come before or after another."""
    order = [_col(n) for n in order_by]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = materialize(placed, "rows")
    part = F.shiftright("__place", 33)
    counts = sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect())
    before = list(accumulate((n for _, n in counts), initial=1))
    bases = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "__part long, __base long")
    number = F.col("__base") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("__part", part).join(F.broadcast(bases), "__part")  # one row for a task
    return joined.select(*[_col(c) for c in df.columns], F.concat(F.lit("row_"), number).alias("row_id"))


def gather_rows(df: DataFrame, text_cols: list[str], id_cols: list[str], *, mode: str = "concat", joiner: str = " ",
                text_id: Column | None = None) -> DataFrame:
    """``text_id``, ids and ``text`` of every row; rows without text go.

    ``concat`` joins a row's non-empty text columns; ``separate`` gives one row for each of
    them, with ``source_col``. Blank but non-empty values count as text.
    """
    require(df, [*text_cols, *id_cols])
    name = composed_id(*[_col(c) for c in id_cols]) if text_id is None else text_id
    base = df.select(name.alias("text_id"), *[_col(c) for c in id_cols], *[_col(c).cast("string").alias(f"__t{k}") for k, c in enumerate(text_cols)])
    ids = [_col(c) for c in id_cols]
    if mode == "concat":
        text = F.concat_ws(joiner, *[F.when(F.col(f"__t{k}") != "", F.col(f"__t{k}")) for k in range(len(text_cols))])
        return base.select("text_id", *ids, text.alias("text")).where("text <> ''")
    if mode != "separate":
        raise ValueError("mode is concat or separate")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("source_col"), F.col(f"__t{k}").alias("text")) for k, c in enumerate(text_cols)]))
    return base.select("text_id", *ids, pairs.alias("__p")).select("text_id", *ids, "__p.source_col", "__p.text").where("text <> ''")


def gather_groups(df: DataFrame, text_cols: list[str], group_by: list[str], order_by: list[str], *, mode: str = "concat",
                  joiner: str = " ") -> DataFrame:
    """``text_id``, the keys, ``text`` in the given order and ``group_count`` of each group.

    Only keys, order and text are shuffled. ``separate`` groups by the source column too. A
    group's text is one value, so a group is bounded by what one value may hold (2 GB); groups
    beyond that belong under a finer key.
    """
    require(df, [*text_cols, *group_by, *order_by])
    keys = [_col(g) for g in group_by]
    order = [_col(o).alias(f"__o{k}") for k, o in enumerate(order_by)]
    values = [_col(c).cast("string") for c in text_cols]
    if mode == "concat":
        joined = F.concat_ws(joiner, *[F.when(v != "", v) for v in values])
        rows = df.select(*keys, *order, joined.alias("__t"))
        by = list(group_by)
    elif mode == "separate":
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("source_col"), v.alias("t")) for c, v in zip(text_cols, values)]))
        rows = df.select(*keys, *order, each.alias("__e")).select(*keys, *[f"__o{k}" for k in range(len(order))], "__e.source_col", F.col("__e.t").alias("__t"))
        by = [*group_by, "source_col"]
    else:
        raise ValueError("mode is concat or separate")
    rows = rows.where("__t <> ''")
    place = F.struct(*[f"__o{k}" for k in range(len(order))], "__t")
    # an array of (order, text) sorted in the task that holds the group
    out = rows.groupBy(*[_col(b) for b in by]).agg(F.sort_array(F.collect_list(place)).alias("__l"), F.count("*").alias("group_count"))
    text = F.array_join(F.transform("__l", lambda x: x["__t"]), joiner)
    name = F.when(composed_id(*keys) == "", F.lit("group")).otherwise(composed_id(*keys))
    tail = ["source_col"] if mode == "separate" else []
    return out.select(name.alias("text_id"), *keys, *tail, text.alias("text"), "group_count")
