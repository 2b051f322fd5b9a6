"""The row-wise text operators on streams, and gathering within event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.lexical import basic_metrics, counted
from sheaf.runtime import quoted


def stream_metrics(stream: DataFrame, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The frequency metrics of each arriving text; stateless."""
    base = counted(stream.select(*[F.col(quoted(k)) for k in keep], F.col(quoted(text_col)).alias("__x")), F.col("__x"))
    return base.select(*keep, *[m.alias(n) for n, m in basic_metrics().items()])


def stream_gather(stream: DataFrame, *, keys: list[str], time_col: str, text_col: str, window: str, late: str, joiner: str = " ") -> DataFrame:
    """One ordered text per key and event-time window; rows later than ``late`` are dropped."""
    rows = stream.withWatermark(time_col, late).where(F.length(text_col) > 0)
    place = F.sort_array(F.collect_list(F.struct(F.col(time_col).alias("o"), F.col(text_col).alias("t"))))
    out = rows.groupBy(F.window(time_col, window).alias("w"), *keys).agg(place.alias("l"), F.count("*").alias("group_count"))
    return out.select(F.col("w.start").alias("window_start"), *keys, F.array_join(F.transform("l", lambda x: x["t"]), joiner).alias("text"), "group_count")
