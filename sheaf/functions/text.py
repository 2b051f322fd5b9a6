"""Column expressions over text: tokens, sentences, ids and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def spaced(text: Column) -> Column:
    """Lower case, digits deleted, punctuation to spaces: what tokens are cut from. Python's
    ``str.split()`` cuts it at the same white space as :func:`tokens`."""
    return F.translate(F.regexp_replace(F.lower(text), "[0-9]+", ""), PUNCTUATION, " " * len(PUNCTUATION))


def tokens(text: Column) -> Column:
    """Lower case, digits deleted, punctuation to spaces, split at Unicode white space."""
    return F.filter(F.split(spaced(text), _SPACE), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Split after a full stop, question or exclamation mark before white space; no blanks."""
    parts = F.transform(F.split(F.trim(text), r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def composed_id(*columns: Column) -> Column:
    """The non-empty values joined by `` | ``."""
    return F.concat_ws(" | ", *[F.when(c.cast("string") != "", c.cast("string")) for c in columns])


def timestamp_ms(text: Column) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm`` or with a dot; null for anything else."""
    pattern = r"^(\d{1,2}):([0-5]\d):([0-5]\d)[,.](\d{3})$"
    good = text.rlike(pattern)
    number = lambda k: F.when(good, F.regexp_extract(text, pattern, k)).otherwise("0").cast("bigint")
    return F.when(good, ((number(1) * 60 + number(2)) * 60 + number(3)) * 1000 + number(4))


def format_ms(ms: Column, mark: str = ",") -> Column:
    """``HH:MM:SS,mmm`` (or another ``mark`` before the milliseconds)."""
    n = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    s = F.floor(n / 1000)
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, n % 1000)
