"""Feature tables: unions of differing schemas, column choice, coercion, group statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import quoted

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass
class AggregationPlan:
    """What to group by and which statistics of which columns to compute. ``first`` and
    ``last`` follow ``order_by``, or else the order in which the table is read."""

    group_by: list[str]
    per_file: bool = True
    stats: list[str] = field(default_factory=lambda: ["mean", "std"])
    exclude_cols: list[str] = field(default_factory=list)
    include_regex: str | None = None
    exclude_regex: str | None = None
    dropna: bool = False
    keep_empty: bool = False
    order_by: list[str] = field(default_factory=list)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns; a type conflict widens to string."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for n, t in f.dtypes:
            kinds.setdefault(n, set()).add(t)
    mixed = {n for n, t in kinds.items() if len(t) > 1}
    frames = [f.select(*[F.col(quoted(n)).cast("string").alias(n) if n in mixed else F.col(quoted(n)) for n in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def add_source(df: DataFrame, source: str, path: str | None = None) -> DataFrame:
    """``source`` (and ``source_path``) first; columns of these names become ``name.N``."""
    new = {"source": source} | ({"source_path": path} if path is not None else {})
    names, taken = [], set(df.columns) | set(new)
    for c in df.columns:
        if c in new:
            n = 1
            while f"{c}.{n}" in taken:
                n += 1
            taken.add(f"{c}.{n}")
            names.append(f"{c}.{n}")
        else:
            names.append(c)
    return df.toDF(*names).select(*[F.lit(v).alias(k) for k, v in new.items()], *[F.col(quoted(n)) for n in names])


def promote_inner_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first ``k.N`` by number becomes ``k``; what was ``k`` becomes ``file_k``."""
    names = list(df.columns)
    for k in keys:
        inner = sorted((n for n in names if re.fullmatch(re.escape(k) + r"\.\d+", n)), key=lambda n: int(n.rsplit(".", 1)[1]))
        if inner:
            names = [f"file_{k}" if n == k else n for n in names]
            names = [k if n == inner[0] else n for n in names]
    return df.toDF(*names)


def resolve_keys(columns: list[str], keys: list[str]) -> list[str]:
    found = []
    for k in keys:
        inner = sorted(c for c in columns if c.startswith(f"{k}."))
        if k in columns:
            found.append(k)
        elif inner:
            found.append(inner[0])
        else:
            raise ValueError(f"group key {k!r} not found; there are {columns}")
    return found


def choose_columns(columns: list[str], *, exclude_cols: list[str] | None = None, include_regex: str | None = None,
                   exclude_regex: str | None = None, must_keep: list[str] | None = None) -> list[str]:
    """Leave out names, keep what one pattern finds, leave out what another finds; keys first."""
    rest = [c for c in columns if c not in set(exclude_cols or [])]
    if include_regex:
        rest = [c for c in rest if re.search(include_regex, c)]
    if exclude_regex:
        rest = [c for c in rest if not re.search(exclude_regex, c)]
    return list(dict.fromkeys([*(must_keep or []), *rest]))


def numeric(c: Column, kind: str) -> Column:
    """A number, or null for what is none; not-a-number is null too."""
    if kind == "boolean":
        return c.cast("int").cast("double")
    if kind == "string":
        text = F.trim(c)
        return F.when(text.rlike(_NUMBER), F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double"))
    if kind.startswith(("array", "map", "struct", "binary", "date", "timestamp", "interval", "void", "variant")):
        return F.lit(None).cast("double")
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def _skew(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.coalesce(F.skewness(c), F.lit(0.0)) * F.sqrt(n * (n - 1.0)) / (n - 2))


PLACE = "__place"


def stat(name: str, c: Column) -> Column:
    made = {
        "mean": lambda: F.avg(c), "std": lambda: F.stddev_samp(c), "var": lambda: F.var_samp(c), "median": lambda: F.median(c),
        "min": lambda: F.min(c), "max": lambda: F.max(c), "sum": lambda: F.coalesce(F.sum(c), F.lit(0.0)), "count": lambda: F.count(c),
        "nunique": lambda: F.count_distinct(c), "size": lambda: F.count(F.lit(1)), "prod": lambda: F.coalesce(F.product(c), F.lit(1.0)),
        "sem": lambda: F.stddev_samp(c) / F.sqrt(F.nullif(F.count(c).cast("double"), F.lit(0.0))), "skew": lambda: _skew(c),
        "first": lambda: F.min_by(c, F.when(c.isNotNull(), F.col(PLACE))), "last": lambda: F.max_by(c, F.when(c.isNotNull(), F.col(PLACE))),
    }
    if name not in made:
        raise ValueError(f"unknown statistic {name!r}; there are {sorted(made)}")
    return made[name]()


def aggregate_features(df: DataFrame, plan: AggregationPlan) -> DataFrame:
    """Statistics ``col__stat`` of the chosen numeric columns for each group.

    A null key is a group unless ``dropna``. Columns without any number are left out unless
    ``keep_empty``; strings are looked at only if there are any.
    """
    if not plan.per_file:
        df = promote_inner_keys(df, plan.group_by)
    keys = resolve_keys(df.columns, plan.group_by)
    if plan.per_file and "source" in df.columns:
        keys = list(dict.fromkeys(["source", *keys]))
    chosen = choose_columns(df.columns, exclude_cols=plan.exclude_cols, include_regex=plan.include_regex,
                            exclude_regex=plan.exclude_regex, must_keep=keys)
    kinds = dict(df.dtypes)
    values = [c for c in chosen if c not in keys]
    if not values:
        raise ValueError("no columns left after the filters")
    place = []
    if {"first", "last"} & set(plan.stats):
        place = [(F.struct(*[F.col(quoted(o)) for o in plan.order_by]) if plan.order_by else F.monotonically_increasing_id()).alias(PLACE)]
    rows = df.select(*place, *[F.col(quoted(k)) for k in keys], *[numeric(F.col(quoted(c)), kinds[c]).alias(c) for c in values])
    doubtful = [c for c in values if kinds[c] == "string"]
    values = [c for c in values if kinds[c] in ("string", "boolean") or not numeric_absent(kinds[c])] if not plan.keep_empty else values
    if doubtful and not plan.keep_empty:
        seen = rows.agg(*[F.count(F.col(quoted(c))).alias(f"c{k}") for k, c in enumerate(doubtful)]).first()
        values = [c for c in values if c not in doubtful or seen[f"c{doubtful.index(c)}"]]
        if not values:
            raise ValueError("no numeric columns left")
    if plan.dropna:
        rows = rows.dropna(subset=keys)
    return rows.groupBy(*[F.col(quoted(k)) for k in keys]).agg(*[stat(s, F.col(quoted(c))).alias(f"{c}__{s}") for c in values for s in plan.stats])


def numeric_absent(kind: str) -> bool:
    return kind.startswith(("array", "map", "struct", "binary", "date", "timestamp", "interval", "void", "variant"))


def weighted_mean(df: DataFrame, keys: list[str], weight: str, scores: list[str]) -> DataFrame:
    """Weight total and weighted means; weights of zero or less are skipped, no weight gives 0."""
    w = F.when(F.col(quoted(weight)) > 0, F.col(quoted(weight)).cast("double"))
    total = F.sum(w)
    means = [F.coalesce(F.sum(w * F.col(quoted(s))) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias(s) for s in scores]
    return df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.coalesce(total, F.lit(0.0)).cast("bigint").alias(weight), *means)
