"""Readability indices from documented counters.

Words are runs without white space that hold a letter or digit; sentences end at runs of
``.!?`` before white space or the end, at least one; syllables of a word are its groups of
vowels, less a final silent e, at least one. The two indices of word lists take as difficult
the words of three or more syllables, unless a list of easy words is given: then those that
are not on it. The counters come from one pass over a text's words in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import quoted, require, ship

_VOWELS = re.compile("[aeiouyáàâäãåæéèêëíìîïóòôöõøúùûüýœ]+")
_SILENT = re.compile(r"[^aeiouy]e[\W\d_]*$")
_STOP = re.compile(r"[.!?]$")


def syllables(word: str) -> int:
    groups = len(_VOWELS.findall(word))
    return max(1, groups - (groups > 1 and _SILENT.search(word) is not None))


def with_counts(df: DataFrame, text: Column, easy_words: list[str] | None = None) -> DataFrame:
    """Add lexicon, sentence, syllable, character, letter, polysyllable and difficult counts."""
    ship(df.sparkSession)
    easy = frozenset(w.lower() for w in easy_words or ())
    fields = ["lexicon_count", "syllable_count", "polysyllable_count", "difficult_words", "__ls", "__ln"]

    @F.pandas_udf(", ".join(f"{f} bigint" for f in fields))
    def counted(texts: pd.Series) -> pd.DataFrame:
        known: dict[str, int] = {}
        rows = []
        for text in texts:
            words = text.split(" ") if text else []
            found = []
            for w in words:
                n = known.get(w)
                if n is None:
                    n = known[w] = syllables(w)
                found.append(n)
            if len(known) > 200_000:
                known = {}
            poly = sum(n >= 3 for n in found)
            hard = sum("".join(c for c in w if c.isalpha() or c == "'") not in easy for w in words) if easy else poly
            rows.append((len(words), sum(found), poly, hard, sum(3 if n >= 3 else 1 for n in found[:100]), max(1, sum(_STOP.search(w) is not None for w in words[:100]))))
        return pd.DataFrame(rows, columns=fields, dtype="int64")

    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(F.lower(t), r"[ \t\r\n\f]+"), lambda x: x.rlike(r"[\p{L}0-9]"))
    made = df.withColumn("__t", t).withColumn("__c", counted(F.array_join(words, " ")))
    return made.withColumns({
        **{f: F.col(f"__c.{f}") for f in fields},
        "sentence_count": F.greatest(F.lit(1), F.regexp_count("__t", F.lit(r"[.!?]+([ \t\r\n\f]|$)"))).cast("long"),
        "char_count": F.length(F.regexp_replace("__t", r"[ \t\r\n\f]+", "")).cast("long"),
        "letter_count": F.length(F.regexp_replace("__t", r"[^\p{L}]+", "")).cast("long"),
    }).drop("__t", "__c")


def indices() -> dict[str, Column]:
    """The published formulas over the counters; null for a text without words."""
    c = lambda n: F.col(n).cast("double")
    w, s, y, p, h = (c(n) for n in ("lexicon_count", "sentence_count", "syllable_count", "polysyllable_count", "difficult_words"))
    letters, chars = c("letter_count"), c("char_count")
    some = F.col("lexicon_count") > 0
    per = lambda e: F.when(some, e)
    linsear = F.col("__ls").cast("double") / F.col("__ln")  # both of the first hundred words
    return {
        "flesch_reading_ease": per(206.835 - 1.015 * w / s - 84.6 * y / w),
        "smog_index": per(1.0430 * F.sqrt(30 * p / s) + 3.1291),
        "flesch_kincaid_grade": per(0.39 * w / s + 11.8 * y / w - 15.59),
        "coleman_liau_index": per(0.0588 * (100 * letters / w) - 0.296 * (100 * s / w) - 15.8),
        "automated_readability_index": per(4.71 * chars / w + 0.5 * w / s - 21.43),
        "dale_chall_readability_score": per(0.1579 * (100 * h / w) + 0.0496 * w / s + F.when(100 * h / w > 5, 3.6365).otherwise(0.0)),
        "linsear_write_formula": per(F.when(linsear > 20, linsear / 2).otherwise((linsear - 2) / 2)),
        "gunning_fog": per(0.4 * (w / s + 100 * p / w)),
        "spache_readability": per(0.121 * w / s + 0.082 * (100 * h / w) + 0.659),
        "avg_sentence_length": per(w / s),
        "avg_syllables_per_word": per(y / w),
        "avg_letter_per_word": per(letters / w),
    }


def _half_away(x: Column) -> Column:
    """Rounded to a whole number, halves away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.floor(x - 0.5)).cast("int")


def _ordinal(n: Column) -> Column:
    teen = n % 100
    end = F.when((teen >= 11) & (teen <= 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def consensus() -> Column:
    """The school grade that most indices give, as a label; of equals the one given first.

    Each index of a grade gives it rounded and rounded up; the ease score gives a grade, or
    two, by tens of points."""
    graded = ["flesch_kincaid_grade", "smog_index", "coleman_liau_index", "automated_readability_index", "dale_chall_readability_score",
              "linsear_write_formula", "gunning_fog"]
    two = lambda c: F.array(_half_away(F.col(c)), F.ceil(c).cast("int"))
    ease = F.col("flesch_reading_ease")
    by_ease = F.lit(None).cast("array<int>")
    for least, most, grades in [(90, 100, [5]), (80, 90, [6]), (70, 80, [7]), (60, 70, [8, 9]), (50, 60, [10]), (40, 50, [11]), (30, 40, [12])]:
        by_ease = F.when((ease >= least) & (ease < most), F.array(*map(F.lit, grades))).otherwise(by_ease)
    by_ease = F.coalesce(by_ease, F.array(F.lit(13)))
    votes = F.concat(two(graded[0]), by_ease, *[two(g) for g in graded[1:]])
    places = F.transform(votes, lambda g, i: F.struct(F.size(F.filter(votes, lambda o: o == g)).alias("n"), (-i).alias("i"), g.alias("g")))
    grade = F.array_max(places)["g"]
    return F.when(F.col("lexicon_count") > 0, F.concat(_ordinal(grade - 1), F.lit(" and "), _ordinal(grade), F.lit(" grade")))


def readability(df: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, easy_words: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the nineteen readability columns."""
    keep = [n for n in df.columns if n != text_col] if keep is None else keep
    require(df, [text_col, *keep])
    base = with_counts(df.select(*[F.col(quoted(k)) for k in keep], F.col(quoted(text_col)).alias("__text")), F.col("__text"), easy_words)
    made = base.withColumns(indices()).withColumn("text_standard", consensus())
    made = made.withColumn("readability_consensus", F.col("text_standard"))
    names = [*list(indices())[:6], "difficult_words", "linsear_write_formula", "gunning_fog", "text_standard", "spache_readability",
             "readability_consensus", "syllable_count", "lexicon_count", "sentence_count", "char_count", "avg_sentence_length",
             "avg_syllables_per_word", "avg_letter_per_word"]
    return made.select(*[F.col(quoted(k)) for k in keep], *names)
