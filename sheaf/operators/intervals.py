"""Intervals and framewise series: turns, words and speakers, voiced runs, pauses, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_turns(df: DataFrame, item: list[str], order: list[str], speaker: str, start: str, end: str, *, min_dur: float = 50,
                length: Column | None = None) -> DataFrame:
    """Consecutive turns of one speaker in the given order become one segment.

    Turns that end before they start are left out first; ``length`` clamps to 0..length;
    segments shorter than ``min_dur`` go. ``segment`` numbers an item's segments from 1.
    """
    s, e = F.col(start), F.col(end)
    rows = df.where(e > s)
    if length is not None:
        rows = rows.withColumns({start: F.greatest(F.lit(0), F.least(s, length)), end: F.greatest(F.lit(0), F.least(e, length))}).where(e > s)
    w = Window.partitionBy(*item).orderBy(*order)
    new = (~F.lag(speaker).over(w).eqNullSafe(F.col(speaker)) | (F.row_number().over(w) == 1)).cast("int")
    runs = rows.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*item, "segment").agg(F.first(speaker).alias(speaker), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("turns"))
    return out.where(F.col(end) - F.col(start) >= min_dur)


def word_speakers(words: DataFrame, turns: DataFrame, item: str, *, anchor: str = "start") -> DataFrame:
    """Each word's turn: the first that ends at or after the word's anchor, else the last.

    ``words``: item, word_id, word_start, word_end. ``turns``: item, turn_start, turn_end,
    speaker. A union of both is ordered by time within the item and looked at backwards, so
    words and turns are never paired up.
    """
    at = {"start": F.col("word_start"), "end": F.col("word_end"), "mid": (F.col("word_start") + F.col("word_end")) / 2}[anchor]
    w = Window.partitionBy(item).orderBy("turn_start", "turn_end", "speaker")
    numbered = turns.select(item, "turn_start", "turn_end", "speaker", F.row_number().over(w).alias("__k"))
    # a turn whose end is no later than an earlier one's is never the first; the others end in order
    before = F.max("turn_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    reach = numbered.withColumn("__b", before).where("__b is null or turn_end > __b")
    last = numbered.groupBy(item).agg(F.max_by("speaker", "__k").alias("__last"))
    points = words.select(item, "word_id", "word_start", "word_end", at.cast("double").alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast("string").alias("__s"), F.lit(None).cast("int").alias("__k"))
    ends = reach.select(item, F.lit(None).cast("long").alias("word_id"), F.lit(None).cast("double").alias("word_start"), F.lit(None).cast("double").alias("word_end"), F.col("turn_end").cast("double").alias("__t"), F.lit(1).alias("__kind"), F.col("speaker").cast("string").alias("__s"), "__k")
    ahead = Window.partitionBy(item).orderBy(F.col("__t"), F.col("__kind")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = points.unionByName(ends).withColumn("speaker", F.first("__s", ignorenulls=True).over(ahead)).where("__kind = 0")
    return found.join(last, item, "left").select(item, "word_id", "word_start", "word_end", F.coalesce("speaker", F.col("__last").cast("string")).alias("speaker"))


def fill_word_times(df: DataFrame, item: str, order: str, start: str = "start", end: str = "end") -> DataFrame:
    """A missing start is the last known end before, a missing end the next known start."""
    w = Window.partitionBy(item).orderBy(order)
    known_end = F.last(end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    next_start = F.first(start, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumns({start: F.coalesce(F.col(start), known_end, F.lit(0)), end: F.coalesce(F.col(end), next_start, F.col(start))})


def merge_untimed(df: DataFrame, item: str, order: str, word: str = "word", start: str = "start", end: str = "end", *,
                  initial: float = 0.0, final: Column | None = None) -> DataFrame:
    """Words without a start that follow each other become one, joined by spaces, from the end
    of the word before to the start of the word after.

    The first word of an item starts at ``initial``; a run that reaches the item's end ends at
    ``final``, and a single last word where it starts. ``order`` is that of a run's first word.
    """
    w = Window.partitionBy(item).orderBy(order)
    untimed = F.col(start).isNull()
    opens = (~untimed | ~F.coalesce(F.lag(untimed).over(w), F.lit(False))).cast("int")
    runs = df.withColumn("__open", opens).withColumn("__run", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w")))), lambda x: x["w"]), " ")
    one = runs.groupBy(item, "__run").agg(F.min(order).alias(order), said.alias(word), F.min(start).alias(start), F.min_by(end, order).alias(end), F.count("*").alias("__n"))
    by = Window.partitionBy(item).orderBy("__run")
    first = F.coalesce(F.col(start), F.lag(end).over(by), F.lit(initial))
    open_end = F.when(F.col("__n") == 1, first).otherwise(final if final is not None else F.lit(None).cast("double"))
    last = F.when(~untimed, F.col(end)).when(F.lead("__run").over(by).isNull(), open_end).otherwise(F.lead(start).over(by))
    return one.select(item, order, word, first.alias(start), last.alias(end))


def voiced_segments(frames: DataFrame, item: str, index: str, time: str, f0: str, *, min_dur: float = 0.0) -> DataFrame:
    """Runs of frames with a positive value, from the first frame's time to halfway towards
    the frame after the run; an open run ends half a hop after its last frame."""
    w = Window.partitionBy(item).orderBy(index)
    v = F.coalesce((F.col(f0) > 0).cast("int"), F.lit(0))
    x = frames.select(item, F.col(index).alias("__i"), F.col(time).alias("__t"), v.alias("__v"))
    w = Window.partitionBy(item).orderBy("__i")
    x = x.withColumns({"__nt": F.lead("__t").over(w), "__pt": F.lag("__t").over(w), "__pv": F.lag("__v", 1, 0).over(w)})
    starts = ((F.col("__v") == 1) & (F.col("__pv") == 0)).cast("int")
    hop = F.coalesce(F.median(F.col("__t") - F.col("__pt")).over(Window.partitionBy(item)), F.lit(0.01))
    x = x.withColumn("__hop", hop).withColumn("segment", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__v = 1")
    end = F.max_by(F.coalesce((F.col("__t") + F.col("__nt")) / 2, F.col("__t") + F.col("__hop") / 2), F.col("__i"))
    out = x.groupBy(item, "segment").agg(F.min("__t").alias("seg_start"), end.alias("seg_end"))
    return out.where(F.col("seg_end") - F.col("seg_start") >= min_dur)


def segment_stats(frames: DataFrame, item: str, index: str, time: str, f0: str, values: list[str], *, min_dur: float = 0.0) -> DataFrame:
    """Mean, population deviation and range of each value inside voiced runs, and the share
    of frames that are not voiced."""
    w = Window.partitionBy(item).orderBy(index)
    voiced = F.coalesce(F.col(f0) > 0, F.lit(False))
    x = frames.withColumns({"__v": voiced, "__pv": F.lag(voiced, 1, False).over(w), "__nt": F.lead(time).over(w)})
    x = x.withColumn("__g", F.sum((F.col("__v") & ~F.col("__pv")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(item, "__g", "__v")
    length = F.max(F.coalesce((F.col(time) + F.col("__nt")) / 2, F.col(time))).over(run) - F.min(time).over(run)
    x = x.withColumn("__in", F.col("__v") & (length >= min_dur))
    stats = []
    for c in values:
        v = F.when(F.col("__in") & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        stats += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"), (F.max(v) - F.min(v)).alias(f"{c}_range")]
    return x.groupBy(item).agg(*stats, F.avg((~F.col("__v")).cast("double")).alias("silence_ratio"))


def pause_metrics(speech: DataFrame, items: DataFrame, item: str, *, start: str = "s", end: str = "e", duration: str = "dur",
                  shortest: float = 0.05, longest: float = 2.0) -> DataFrame:
    """Pauses per second of speech, their median and median absolute deviation.

    Pauses are the gaps before, between and after an item's speech intervals, bounds
    inclusive; an item without any gets zeros.
    """
    marks = speech.select(item, F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"))
    marks = marks.unionByName(items.select(item, F.col(duration).cast("double").alias("s"), F.col(duration).cast("double").alias("e")))
    gap = F.col("s") - F.lag("e", 1, 0.0).over(Window.partitionBy(item).orderBy("s", "e"))
    pauses = marks.select(item, gap.alias("d")).where((F.col("d") >= shortest) & (F.col("d") <= longest))
    middle = pauses.withColumn("md", F.median("d").over(Window.partitionBy(item)))
    per = middle.groupBy(item).agg(F.count("*").alias("n"), F.first("md").alias("md"), F.median(F.abs(F.col("d") - F.col("md"))).alias("mad"))
    spoken = speech.groupBy(item).agg(F.sum(F.col(end) - F.col(start)).cast("double").alias("st"))
    rate = F.when(F.col("st") > 0, F.col("n") / F.col("st"))
    zero = F.lit(0.0)
    return items.select(item).join(per, item, "left").join(spoken, item, "left").select(
        item, F.coalesce(rate, zero).alias("spir"), F.coalesce("md", zero).alias("dur_med"), F.coalesce("mad", zero).alias("dur_mad")
    )


def fixed_windows(df: DataFrame, n: Column, window: int, hop: int) -> DataFrame:
    """Windows of ``window`` samples every ``hop``, up to the first that reaches the end."""
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long")), F.lit(hop).cast("long")))
    out = df.withColumn("win_start", F.explode(starts))
    s = F.col("win_start")
    return out.where((s == 0) | (s - hop + window < n)).withColumn("win_end", F.least(n.cast("long"), s + window))


def chopped_windows(df: DataFrame, start: str, end: str, window: int, shortest: int) -> DataFrame:
    """Intervals cut into windows; pieces shorter than ``shortest`` go."""
    starts = F.sequence(F.col(start).cast("long"), F.greatest(F.col(start), F.col(end) - 1).cast("long"), F.lit(window).cast("long"))
    out = df.withColumn("win_start", F.explode(F.when(F.col(end) > F.col(start), starts)))
    out = out.withColumn("win_end", F.least(F.col("win_start") + window, F.col(end).cast("long")))
    return out.where(F.col("win_end") - F.col("win_start") >= shortest)


def embedding_windows(df: DataFrame, n: Column, rate: int, *, intervals: DataFrame | None = None, item: str = "path", window_s: float = 30.0,
                      hop_s: float = 15.0, least_s: float = 1.0) -> DataFrame:
    """Sample windows of recordings, ``segment`` counting an item's from 0.

    Without ``intervals`` fixed windows; with them (item, ``a``, ``b`` in samples) the loud
    intervals cut into windows, and the whole recording where none is long enough."""
    window, hop, least = (max(1, round(s * rate)) for s in (window_s, hop_s, least_s))
    base = df.withColumn("__n", n.cast("long"))
    if intervals is None:
        cut = base.withColumns({"win_start": F.lit(0).cast("long"), "win_end": F.col("__n")}).where("__n = 0")
        cut = cut.unionByName(fixed_windows(base, F.col("__n"), window, hop))
    else:
        loud = intervals.where(F.col("b") - F.col("a") >= least)
        pieces = chopped_windows(base.join(loud, item), "a", "b", window, least).drop("a", "b")
        whole = base.join(pieces.select(item).distinct(), item, "left_anti").withColumns({"win_start": F.lit(0).cast("long"), "win_end": F.col("__n")})
        cut = pieces.unionByName(whole)
    number = F.row_number().over(Window.partitionBy(item).orderBy("win_start")) - 1
    return cut.withColumn("segment", number.cast("long")).drop("__n")


def guess_time_unit(max_end: Column, seconds: Column, samples: Column) -> Column:
    """s, ms or samples: the first under which the latest end fits the sound."""
    return F.when(max_end <= 1.1 * seconds, "s").when(max_end <= 1.1 * seconds * 1000, "ms").when(max_end <= 1.1 * samples, "samples").otherwise("s")


def turn_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sample deviation of every numeric column by keys; other columns go."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    values = [c for c, t in df.dtypes if c not in keys and t.startswith(kinds)]
    return df.groupBy(*keys).agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
