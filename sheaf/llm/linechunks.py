"""Content-defined line chunks: passages of several lines that repeat anywhere are removed.

Every line has a hash, and a rolling hash over the hashes of two neighbouring lines runs down
the text. Where it turns from a value that the corpus has once to one that it has again, or
back, is a boundary: boundaries follow the content, so lines added above or around a passage
do not move them, and a repeated passage of two lines or more is a chunk from its first line
to its last, in whatever surroundings. Blank lines end a chunk.

Hashes only find candidates. The lines under each repeated rolling hash are grouped by their
bytes; they are kept where they occur first, by document id and then by position, and
removed everywhere else, so every line that goes is still there where it came first.

Runs on built-in expressions only. Rolling hashes are counted with a combine before the
shuffle; only lines under a hash that repeats carry their bytes on. Small sides are
broadcast after the sizes of their rows have been added up, larger ones are joined by a
shuffle that splits skewed keys. All documents' texts are never regrouped: places to remove
come back to the documents by id.

Defined cases: a null text stays null and an empty one empty; a document that loses all
its lines has the empty text; rows that repeat an id and a text are one document, each row
coming back the same; rows that share an id but not a text are different documents; a null
id sorts last; an empty table gives no rows; other columns pass through, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import materialize, quoted, small

_P = "__sheaf_"
_MODULUS = 2147483647
_FACTORS = (16807, 48271)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once for each row, however often lambdas read them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _half(line_hash: Column, k: int) -> Column:
    """The upper or lower 31 bits of a line's hash."""
    return F.shiftrightunsigned(line_hash, 33 * (1 - k)).bitwiseAND(F.lit(_MODULUS))


def rolling_hash(before: Column, line: Column) -> Column:
    """Of two neighbouring lines' hashes: two polynomials of 31 bits side by side."""
    high, low = ((_half(before, k) * factor + _half(line, k)) % _MODULUS for k, factor in enumerate(_FACTORS))
    return F.shiftleft(high, 31).bitwiseOR(low)


def with_rolls(df: DataFrame, text: Column) -> DataFrame:
    """Add ``__sheaf_lines`` and ``__sheaf_rolls``: for every line but the first the rolling
    hash of it and the one before, or null where one of them is blank."""
    lined = _once(df, **{f"{_P}lines": lines_of(text)})
    hashed = _once(lined, **{f"{_P}h": F.transform(f"{_P}lines", lambda x: F.when(F.length(F.trim(x)) > 0, F.xxhash64(x)))})
    h = F.col(f"{_P}h")
    rolls = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), rolling_hash)  # one longer than there are neighbours, ended by a null
    return _once(hashed, **{f"{_P}rolls": rolls}).drop(f"{_P}h")


def repeated_places(docs: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> DataFrame:
    """(id, th, idx): the pairs of lines idx and idx + 1, from 0, to remove. ``th`` is the
    text's hash."""
    own = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("t")).where("t is not null")
    own = own.withColumn("th", F.xxhash64("t"))
    rolled = with_rolls(own, F.col("t"))
    counted = rolled.select(F.explode(f"{_P}rolls").alias("h")).where("h is not null").groupBy("h").count()
    again = materialize(counted.where("count > 1").select("h"), "hashes")
    both = lambda h, i: F.struct(i.alias("idx"), h.alias("h"), F.concat_ws("\n", F.get(f"{_P}lines", i), F.get(f"{_P}lines", i + 1)).alias("lines"))
    pairs = F.filter(F.transform(f"{_P}rolls", both), lambda x: x["h"].isNotNull())
    rows = rolled.select("id", "th", F.inline(pairs))
    shared = materialize(rows.join(small(again, 16, broadcast_bytes), "h"), "candidates")
    first = shared.groupBy("h", "lines").agg(
        F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th", "idx")).alias("first"), F.count("*").alias("n")
    )
    kept = materialize(first.where("n > 1").select("h", "lines", "first"), "kept")  # apart, so that a skewed join can be split
    other = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("idx") == F.col("first.idx")))
    return shared.join(kept, ["h", "lines"]).where(other).select("id", "th", "idx")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None,
                broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text_col``; every row comes back.

    ``count_col`` names an added column with the number of lines removed.
    """
    names = docs.columns
    places = repeated_places(docs, id_col, text_col, broadcast_bytes)
    gone = materialize(places.groupBy("id", "th").agg(F.collect_set("idx").alias("gone")), "places")
    gone = gone.select(F.col("id").alias(f"{_P}id"), F.col("th").alias(f"{_P}th"), F.col("gone").alias(f"{_P}gone"))
    text = F.col(quoted(text_col))
    rows = docs.withColumn(f"{_P}key", F.xxhash64(text))
    on = F.col(quoted(id_col)).eqNullSafe(F.col(f"{_P}id")) & (F.col(f"{_P}key") == F.col(f"{_P}th")) & text.isNotNull()
    met = rows.join(small(gone, 64 + 8 * F.size(f"{_P}gone"), broadcast_bytes), on, "left")
    lined = _once(met, **{f"{_P}lines": F.when(F.col(f"{_P}gone").isNotNull(), lines_of(text))})
    both = F.concat(f"{_P}gone", F.transform(f"{_P}gone", lambda i: i + 1))
    left = _once(lined, **{f"{_P}left": F.array_except(F.sequence(F.lit(0), F.size(f"{_P}lines") - 1), both)})
    found = F.when(F.col(f"{_P}gone").isNull(), text).otherwise(F.array_join(F.transform(f"{_P}left", lambda i: F.get(f"{_P}lines", i)), "\n"))
    out = [found.alias(n) if n == text_col else F.col(quoted(n)) for n in names]
    if count_col:
        out.append(F.coalesce(F.size(f"{_P}lines") - F.size(f"{_P}left"), F.lit(0)).cast("long").alias(count_col))
    return left.select(*out)


ORACLE_DEDUP = """
lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), pairs AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM lines
), gone AS (
  SELECT doc_id, i FROM pairs WHERE trim(line, ' ') <> '' AND trim(after, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1
), deduped AS (
  SELECT lines.doc_id, coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (a.i IS NULL AND b.i IS NULL), '') AS text,
    CAST(count(*) FILTER (a.i IS NOT NULL OR b.i IS NOT NULL) AS BIGINT) AS lines_removed
  FROM lines LEFT JOIN gone a ON a.doc_id = lines.doc_id AND a.i = lines.i LEFT JOIN gone b ON b.doc_id = lines.doc_id AND b.i + 1 = lines.i GROUP BY lines.doc_id
)
"""
