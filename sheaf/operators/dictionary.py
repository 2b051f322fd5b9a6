"""Dictionary coding: counts and shares of words by category.

Every word is looked up once, among exact terms and among prefixes by their lengths, and the
categories it belongs to are added up; phrases are looked up by their first word. So a text
costs its words, however many categories and terms the dictionaries have. Lookups run in
Arrow batches; dictionaries are driver-sized and travel with the function.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import PUNCTUATION
from sheaf.runtime import quoted, require, ship

# The columns that stand once for all dictionaries.
GLOBALS = ["WC", "BigWords", "Numbers", "AllPunct", "Period", "Comma", "QMark", "Exclam", "Apostro"]
#: Extensions of dictionary files.
EXTENSIONS = (".dic", ".dicx", ".csv")


@dataclass
class Lexicon:
    """A named set of categories of terms; a term that ends in ``*`` is a prefix."""

    name: str
    categories: dict[str, list[str]]

    @property
    def prefix(self) -> str:
        return re.sub(r"[^0-9A-Za-z]+", "_", self.name)


def load_lexicon(path: str) -> Lexicon:
    """A ``.dic`` file (categories between percent signs, then terms with their numbers) or a
    ``.dicx``/``.csv`` table of terms by categories with marks."""
    p = Path(path)
    text = p.read_text(encoding="utf-8-sig")
    found: dict[str, list[str]] = {}
    if p.suffix == ".dic":
        _, head, body = text.split("%", 2)
        names = dict(line.split(None, 1) for line in head.strip().splitlines() if line.strip())
        found = {n.strip(): [] for n in names.values()}
        for line in body.strip().splitlines():
            term, *numbers = line.split("\t") if "\t" in line else line.split()
            for n in " ".join(numbers).split():
                found[names[n].strip()].append(term.strip().lower())
        return Lexicon(p.stem, found)
    rows = list(csv.reader(text.splitlines()))
    for k, name in enumerate(rows[0][1:], 1):
        found[name] = [r[0].strip().lower() for r in rows[1:] if len(r) > k and r[k].strip()]
    return Lexicon(p.stem, found)


def expand_paths(paths: list[str]) -> list[str]:
    """Dictionary files: those given, and those below folders that are given, each once, in
    order."""
    from sheaf.sources.files import find_files

    found: dict[str, None] = {}
    for p in map(Path, paths):
        if not p.exists():
            raise FileNotFoundError(p)
        if p.is_dir():
            found |= dict.fromkeys(str(Path(f).resolve()) for f in find_files(str(p), extensions=list(EXTENSIONS)))
        elif p.suffix.lower() in EXTENSIONS:
            found[str(p.resolve())] = None
        else:
            raise ValueError(f"{p.name}: dictionaries are {', '.join(EXTENSIONS)} files")
    if not found:
        raise ValueError("no dictionary files found")
    return list(found)


def load_lexicons(paths: list[str]) -> list[Lexicon]:
    return [load_lexicon(p) for p in expand_paths(paths)]


def words_of(text: Column, drop_punct: bool = True) -> Column:
    """Lower-case words; punctuation but apostrophes and hyphens parts them. Without
    ``drop_punct`` each of these marks is a word of its own."""
    parted = PUNCTUATION.replace("'", "").replace("-", "").replace("*", "")
    low = F.lower(F.coalesce(text, F.lit("")))
    if drop_punct:
        return F.filter(F.split(F.translate(low, parted, " " * len(parted)), r"[ \t\r\n\f]+"), lambda x: x.rlike(r"[\p{L}0-9]"))
    marks = "([" + re.escape(parted) + "])"
    return F.filter(F.split(F.regexp_replace(low, marks, " $1 "), r"[ \t\r\n\f]+"), lambda x: x != "")


class Coder:
    """The terms of several lexicons by word. Category 0 of each lexicon is all of it."""

    def __init__(self, lexicons: list[Lexicon]):
        self.width = 0
        self.exact: dict[str, set[int]] = {}
        self.starts: dict[str, set[int]] = {}
        self.phrases: dict[str, list[tuple[list[str], bool, set[int]]]] = {}
        known: dict[str, set[int]] = {}
        for lex in lexicons:
            base = self.width
            for k, terms in enumerate(lex.categories.values(), 1):
                for t in terms:
                    known.setdefault(t, set()).update((base, base + k))
            self.width += 1 + len(lex.categories)
        for term, codes in known.items():
            words, open_end = term.rstrip("*").split(), term.endswith("*")
            if not words:
                continue
            if len(words) > 1:
                self.phrases.setdefault(words[0], []).append((words[1:], open_end, codes))
            else:
                (self.starts if open_end else self.exact).setdefault(words[0], set()).update(codes)
        self.lengths = sorted({len(s) for s in self.starts})
        self.cache: dict[str, tuple[int, ...]] = {}

    def codes(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            codes = set(self.exact.get(word, ()))
            for n in self.lengths:
                if n > len(word):
                    break
                codes |= self.starts.get(word[:n], set())
            if len(self.cache) > 200_000:
                self.cache.clear()
            found = tuple(codes)
            if len(word) <= 64:
                self.cache[word] = found
        return found

    def count(self, words: list[str], captured: list[Counter] | None = None) -> list[int]:
        """Hits of every category; ``captured`` collects what hit each."""
        hits = [0] * self.width
        for word, n in Counter(words).items():
            for c in self.codes(word):
                hits[c] += n
                if captured is not None:
                    captured[c][word] += n
        if self.phrases:
            ended: dict[int, int] = {}
            for at, word in enumerate(words):
                for tail, open_end, codes in self.phrases.get(word, ()):
                    run = words[at + 1 : at + 1 + len(tail)]
                    if run[: len(tail) - 1] != tail[:-1] or len(run) < len(tail) or ended.get(id(tail), 0) > at:
                        continue
                    if run[-1].startswith(tail[-1]) if open_end else run[-1] == tail[-1]:
                        ended[id(tail)] = at + 1 + len(tail)
                        for c in codes:
                            hits[c] += 1
                            if captured is not None:
                                captured[c][" ".join([word, *run])] += 1
        return hits


def header(lexicons: list[Lexicon]) -> list[str]:
    """The result columns: the global ones, then each lexicon's share and categories."""
    return GLOBALS + [f"{lex.prefix}__{c}" for lex in lexicons for c in ("Dic", *lex.categories)]


def code(df: DataFrame, lexicons: list[Lexicon], *, text_col: str = "text", keep: list[str] | None = None, relative: bool = True,
         rounding: int | None = 4, drop_punct: bool = True, retain_captures: bool = False) -> DataFrame:
    """``keep`` columns, the global columns, and for each lexicon the share of words in it
    (``prefix__Dic``) and in each category; counts if not ``relative``, else percentages.

    ``retain_captures`` adds ``captures``, a map from each category column that was hit to
    the words that hit it with their counts.
    """
    if not lexicons:
        raise ValueError("no dictionaries given")
    ship(df.sparkSession)
    keep = [n for n in df.columns if n != text_col] if keep is None else keep
    require(df, [text_col, *keep])
    t = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    names = header(lexicons)[len(GLOBALS) :]
    schema = "wc bigint, big bigint, numbers bigint, hits array<bigint>" + (", captures map<string, map<string, bigint>>" if retain_captures else "")
    coder = Coder(lexicons)

    @F.pandas_udf(schema)
    def coded(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = text.split(" ") if text else []
            caught = [Counter() for _ in names] if retain_captures else None
            row = [len(words), sum(len(w) >= 7 for w in words), sum(w.isascii() and w.isdigit() for w in words), coder.count(words, caught)]
            if caught is not None:
                row.append({n: dict(c) for n, c in zip(names, caught) if c})
            rows.append(row)
        return pd.DataFrame(rows, columns=["wc", "big", "numbers", "hits", *(["captures"] if retain_captures else [])])

    kept = [F.col(quoted(k)) for k in keep]
    base = df.select(*kept, t.alias("__t"), coded(F.array_join(words_of(t, drop_punct), " ")).alias("__c"))
    wc = F.col("__c.wc")
    share = lambda c: F.when(wc > 0, 100.0 * c / wc).otherwise(0.0) if relative else c.cast("double")
    shown = lambda c: F.round(share(c), rounding) if rounding is not None else share(c)
    without = lambda marks: F.length("__t") - F.length(F.translate("__t", marks, ""))
    made = [wc, shown(F.col("__c.big")), shown(F.col("__c.numbers")), *(shown(without(m)) for m in (PUNCTUATION, ".", ",", "?", "!", "'"))]
    made += [shown(F.get(F.col("__c.hits"), k)) for k in range(len(names))]
    more = [F.col("__c.captures").alias("captures")] if retain_captures else []
    return base.select(*kept, *[c.alias(n) for n, c in zip(header(lexicons), made)], *more)


def code_text(spark: SparkSession, text: str, lexicons: list[Lexicon], *, text_id: str | None = None, **how) -> tuple[list[str], list]:
    """(header, row) of one text; with its id in front if one is given."""
    row = code(spark.createDataFrame([(text,)], "text string"), lexicons, keep=[], **how).first()
    first = ([], []) if text_id is None else (["text_id"], [text_id])
    return first[0] + list(row.__fields__), first[1] + list(row)
