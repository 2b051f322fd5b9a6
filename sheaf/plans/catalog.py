"""Registered queries over the operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators import dictionary, features, gather, intervals, lexical, readability, transcripts, vectors
from sheaf.runtime import spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "lex_gathered"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# The ASCII punctuation characters, for SQL.
_PUNCT = X.PUNCTUATION.replace("'", "''")
_TOKENS = f"""list_filter(regexp_split_to_array(translate(regexp_replace(lower(coalesce(text, '')), '[0-9]+', '', 'g'), '{_PUNCT}', repeat(' ', 32)),
  '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+'), lambda x: x <> '')"""
_METRICS = """round(CASE WHEN n > 0 THEN v / n END, 6) AS ttr, round(CASE WHEN n > 0 THEN v / sqrt(n) END, 6) AS rttr, round(CASE WHEN n > 0 THEN v / sqrt(2 * n) END, 6) AS cttr,
  round(CASE WHEN n > 1 AND v > 1 THEN ln(v) / ln(n) END, 6) AS herdan_c, round(CASE WHEN n > 2 AND v > 2 THEN ln(ln(v)) / ln(ln(n)) END, 6) AS summer_s,
  round(CASE WHEN n > 1 AND v > 1 AND n <> v THEN ln(n) * ln(n) / (ln(n) - ln(v)) END, 6) AS dugast, round(CASE WHEN n > 1 AND v > 1 THEN (ln(n) - ln(v)) / (ln(n) * ln(n)) END, 6) AS maas,
  round(CASE WHEN n > 1 THEN 10000 * (s2 / (n * n) - 1 / n) END, 6) AS yule_k, round(CASE WHEN n > 0 AND s2 > v THEN v * v / (s2 - v) END, 6) AS yule_i,
  round(CASE WHEN n > 0 THEN sqrt(greatest(0, s2 / (n * n) - 1 / v)) END, 6) AS herdan_vm, round(CASE WHEN n > 1 THEN (s2 - n) / (n * (n - 1)) END, 6) AS simpson_d"""
_COUNTED = f"""tok AS (SELECT id, {_TOKENS} AS t FROM src),
words AS (SELECT id, w, count(*) AS k FROM (SELECT id, unnest(t) AS w FROM tok) GROUP BY id, w),
c AS (SELECT tok.id, CAST(len(t) AS DOUBLE) AS n, CAST(coalesce(x.v, 0) AS DOUBLE) AS v, CAST(coalesce(x.s2, 0) AS DOUBLE) AS s2
  FROM tok LEFT JOIN (SELECT id, count(*) AS v, sum(k * k) AS s2 FROM words GROUP BY id) x USING (id))"""


def _metrics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = lexical.counted(df, F.col(text_col))
    return _rounded(base.select(id_col, *[m.alias(k) for k, m in lexical.basic_metrics().items()]))


@query(f"""WITH src AS (SELECT conv_id || ' | ' || role AS id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE text <> '' GROUP BY conv_id, role), {_COUNTED}
SELECT id AS text_id, {_METRICS} FROM c""")
def lex_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speaker's turns of a conversation in order, then the frequency metrics of them."""
    return _metrics(gather.gather_groups(table(spark, sf_dir, "conversations"), ["text"], ["conv_id", "role"], ["turn"]), "text_id", "text")


@query(f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_COUNTED} SELECT id AS doc_id, {_METRICS} FROM c")
def lex_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query(f"""WITH src AS (SELECT doc_id AS id, text FROM documents), tok AS (SELECT id, {_TOKENS} AS t FROM src),
words AS (SELECT id, w, count(*) AS freq FROM (SELECT id, unnest(t) AS w FROM tok) GROUP BY id, w) SELECT id, freq, count(*) AS types FROM words GROUP BY id, freq""")
def lex_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.frequency_spectrum(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query(f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
win AS (SELECT doc_id, list_avg(list_transform(range(0, len(t) - 99), lambda i: len(list_distinct(t[i + 1:i + 100])) / 100)) AS m,
  CASE WHEN len(t) > 100 THEN list_avg(list_transform(range(0, CAST(floor(len(t) / 100) AS BIGINT)), lambda i: len(list_distinct(t[i * 100 + 1:i * 100 + 100])) / 100)) END AS s, len(t) AS n FROM tok),
k AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(t) AS w FROM tok) GROUP BY doc_id, w),
h AS (SELECT k.doc_id, sum((1 - list_product(list_transform(range(0, 42), lambda i: greatest(n - k - i, 0) / (n - i)))) / 42) AS h FROM k JOIN win USING (doc_id) WHERE n >= 42 GROUP BY k.doc_id)
SELECT doc_id, round(s, 9) AS msttr_100, round(CASE WHEN n >= 100 THEN m END, 9) AS mattr_100, round(h, 9) AS hdd_42 FROM win LEFT JOIN h USING (doc_id)""")
def lex_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _rounded(lexical.lexical_richness(docs, metrics=["msttr", "mattr", "hdd"]), 9)


@query()
def lex_mtld_vocd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen metrics; the sampled one has no SQL form."""
    return _rounded(lexical.lexical_richness(lexical.lengths_together(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))))


@query("SELECT concat_ws(' | ', nullif(source, ''), nullif(CAST(doc_id AS VARCHAR), '')) AS text_id, source, doc_id, concat_ws(' ', nullif(lang, ''), nullif(text, '')) AS text FROM documents WHERE concat_ws(' ', nullif(lang, ''), nullif(text, '')) <> ''")
def gather_concat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gather.gather_rows(table(spark, sf_dir, "documents"), ["lang", "text"], ["source", "doc_id"])


@query("""SELECT CAST(doc_id AS VARCHAR) AS text_id, doc_id, 'lang' AS source_col, lang AS text FROM documents WHERE lang <> ''
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id, 'text', text FROM documents WHERE text <> ''""")
def gather_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gather.gather_rows(table(spark, sf_dir, "documents"), ["lang", "text"], ["doc_id"], mode="separate")


@query("SELECT conv_id || ' | ' || role AS text_id, conv_id, role, string_agg(text, ' ' ORDER BY turn, text) AS text, count(*) AS group_count FROM conversations WHERE text <> '' GROUP BY conv_id, role")
def gather_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gather.gather_groups(table(spark, sf_dir, "conversations"), ["text"], ["conv_id", "role"], ["turn"])


@query("""WITH u AS (SELECT conv_id, turn, 'role' AS source_col, role AS t FROM conversations UNION ALL SELECT conv_id, turn, 'text', text FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS text_id, conv_id, source_col, string_agg(t, ' ' ORDER BY turn, t) AS text, count(*) AS group_count FROM u WHERE t <> '' GROUP BY conv_id, source_col""")
def gather_group_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gather.gather_groups(table(spark, sf_dir, "conversations"), ["role", "text"], ["conv_id"], ["turn"], mode="separate")


@query("SELECT c_custkey, c_name, c_acctbal, NULL::BIGINT AS s_suppkey, NULL::VARCHAR AS s_name FROM customer UNION ALL SELECT NULL, NULL, NULL, s_suppkey, s_name FROM supplier")
def feat_concat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.union_by_name([table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")])


_STATS = {"mean": "avg({c})", "std": "stddev_samp({c})", "var": "var_samp({c})", "median": "median({c})", "min": "min({c})", "max": "max({c})", "sum": "sum({c})", "count": "count({c})", "nunique": "count(DISTINCT {c})", "size": "count(*)", "sem": "stddev_samp({c}) / sqrt(count({c}))", "skew": "skewness({c})"}
_AGG_COLS = ["l_quantity", "l_tax"]


def _agg_sql(stats: list[str], cols: list[str]) -> str:
    parts = []
    for c in cols:
        for s in stats:
            e = _STATS[s].format(c=f"CAST({c} AS DOUBLE)")
            parts.append(f"{e if s in ('count', 'nunique', 'size') else f'round({e}, 4)'} AS {c}__{s}")
    return f"SELECT l_returnflag, l_linestatus, {', '.join(parts)} FROM lineitem GROUP BY l_returnflag, l_linestatus"


def _aggregated(spark: SparkSession, sf_dir: str, stats: list[str], cols: list[str]) -> DataFrame:
    plan = features.AggregationPlan(["l_returnflag", "l_linestatus"], stats=stats, include_regex="^(" + "|".join(cols) + ")$")
    return _rounded(features.aggregate_features(table(spark, sf_dir, "lineitem"), plan), 4)


@query(_agg_sql(["mean", "std"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def feat_agg_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregated(spark, sf_dir, ["mean", "std"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(_agg_sql(list(_STATS), _AGG_COLS))
def feat_agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregated(spark, sf_dir, list(_STATS), _AGG_COLS)


@query("""SELECT event_id, CAST(CASE WHEN regexp_matches(s, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN s END AS DOUBLE) AS guarded
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE ' ' || CAST(user_id AS VARCHAR) || '.5 ' END AS raw, trim(CASE WHEN event_id % 3 = 0 THEN event_type ELSE ' ' || CAST(user_id AS VARCHAR) || '.5 ' END) AS s FROM events)""")
def feat_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".5 ")))
    return table(spark, sf_dir, "events").select("event_id", features.numeric(mixed, "string").alias("guarded"))


_T = "epoch_us(ts)"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_micros(cast(ts as timestamp))").alias("t"), F.col("value").cast("double").alias("value"))


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, {_T} AS t FROM events),
x AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM x)
SELECT user_id, CAST(segment AS BIGINT) AS segment, min(event_type) AS event_type, min(t) AS t, max(t + 1000000) AS t_end, count(*) AS turns FROM y GROUP BY user_id, segment""")
def turn_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).withColumn("t_end", F.col("t") + 1000000)
    return intervals.merge_turns(rows, ["user_id"], ["t", "event_id"], "event_type", "t", "t_end")


_MERGED = f"""e AS (SELECT user_id, event_id, event_type, {_T} AS t FROM events),
x AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM x),
t AS (SELECT user_id, min(t) AS turn_start, max(t + 1000000) AS turn_end, min(event_type) AS speaker FROM y GROUP BY user_id, segment)"""


@query(f"""WITH {_MERGED}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY turn_start, turn_end, speaker) AS k FROM t),
w AS (SELECT user_id, event_id AS word_id, {_T} + 700000 AS a FROM events),
f AS (SELECT w.user_id, w.word_id, min(n.k) AS k FROM w JOIN n ON w.user_id = n.user_id AND n.turn_end >= w.a GROUP BY 1, 2),
l AS (SELECT user_id, max(k) AS k FROM n GROUP BY 1)
SELECT w.user_id, w.word_id, n.speaker FROM w LEFT JOIN f ON w.user_id = f.user_id AND w.word_id = f.word_id LEFT JOIN l ON w.user_id = l.user_id LEFT JOIN n ON n.user_id = w.user_id AND n.k = coalesce(f.k, l.k)""")
def word_speaker_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a word, and runs of one kind of event are the turns."""
    rows = _timed(spark, sf_dir)
    turns = intervals.merge_turns(rows.withColumn("t_end", F.col("t") + 1000000), ["user_id"], ["t", "event_id"], "event_type", "t", "t_end")
    turns = turns.select("user_id", F.col("t").alias("turn_start"), F.col("t_end").alias("turn_end"), F.col("event_type").alias("speaker"))
    at = (F.col("t") + 700000).cast("double")
    words = rows.select("user_id", F.col("event_id").alias("word_id"), at.alias("word_start"), at.alias("word_end"))
    return intervals.word_speakers(words, turns, "user_id").select("user_id", "word_id", "speaker")


_FRAMES = f"fw AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS i, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS DOUBLE) / 100 AS t, CAST(value AS DOUBLE) - 50 AS f0 FROM events)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    return _timed(spark, sf_dir).select(F.col("user_id").alias("item"), i.cast("long").alias("i"), (i.cast("double") / 100).alias("t"), (F.col("value") - 50).alias("f0"))


@query(f"""WITH {_FRAMES}, a AS (SELECT *, lead(t) OVER w AS nt, lag(t) OVER w AS pt, CASE WHEN f0 > 0 THEN 1 ELSE 0 END AS v, lag(CASE WHEN f0 > 0 THEN 1 ELSE 0 END, 1, 0) OVER w AS pv FROM fw WINDOW w AS (PARTITION BY item ORDER BY i)),
h AS (SELECT item, coalesce(median(t - pt), 0.01) AS hop FROM a GROUP BY 1),
b AS (SELECT *, sum(CASE WHEN v = 1 AND pv = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT item, CAST(g AS BIGINT) AS segment, round(min(t), 6) AS seg_start, round(arg_max(coalesce((t + nt) / 2, t + hop / 2), i), 6) AS seg_end FROM b JOIN h USING (item) WHERE v = 1 GROUP BY 1, 2""")
def voiced_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intervals.voiced_segments(_frames(spark, sf_dir), "item", "i", "t", "f0"))


@query(f"""WITH {_FRAMES} SELECT item, round(avg(f0) FILTER (f0 > 0), 5) AS f0_mean, round(stddev_pop(f0) FILTER (f0 > 0), 5) AS f0_std, round(max(f0) FILTER (f0 > 0) - min(f0) FILTER (f0 > 0), 5) AS f0_range,
round(avg(CASE WHEN f0 > 0 THEN 0.0 ELSE 1.0 END), 5) AS silence_ratio FROM fw GROUP BY item""")
def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intervals.segment_stats(_frames(spark, sf_dir), "item", "i", "t", "f0", ["f0"]), 5)


_SPEECH = "SELECT user_id AS item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + (event_id % 10) / 10.0 AS e FROM events"


@query(f"""WITH iv AS ({_SPEECH}), it AS (SELECT item, max(e) + 1.5 AS dur FROM iv GROUP BY 1),
x AS (SELECT item, s, e FROM iv UNION ALL SELECT item, dur, dur FROM it), g AS (SELECT item, s - lag(e, 1, 0) OVER (PARTITION BY item ORDER BY s, e) AS d FROM x),
p AS (SELECT * FROM g WHERE d >= 0.05 AND d <= 2), m AS (SELECT item, count(*) AS n, median(d) AS md FROM p GROUP BY 1),
mm AS (SELECT p.item, median(abs(d - md)) AS mad FROM p JOIN m USING (item) GROUP BY 1), sp AS (SELECT item, sum(e - s) AS st FROM iv GROUP BY 1)
SELECT it.item, round(coalesce(CASE WHEN st > 0 THEN n / st END, 0), 4) AS spir, round(coalesce(md, 0), 4) AS dur_med, round(coalesce(mad, 0), 4) AS dur_mad FROM it LEFT JOIN m USING (item) LEFT JOIN mm USING (item) LEFT JOIN sp USING (item)""")
def pause_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    iv = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), k.cast("double").alias("s"), (k + (F.col("event_id") % 10) / 10.0).cast("double").alias("e"))
    items = iv.groupBy("item").agg((F.max("e") + 1.5).alias("dur"))
    return _rounded(intervals.pause_metrics(iv, items, "item"), 4)


@query("SELECT doc_id, s AS win_start, least(n, s + 1000) AS win_end FROM (SELECT doc_id, n_chars AS n, unnest(range(0, n_chars, 500)) AS s FROM documents) WHERE s = 0 OR s - 500 + 1000 < n")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return intervals.fixed_windows(rows, F.col("n_chars"), 1000, 500).select("doc_id", "win_start", "win_end")


_CLOCK = "lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0')"


@query(f"SELECT conv_id, turn, {_CLOCK} AS shown, ms AS parsed FROM (SELECT conv_id, turn, CAST(turn AS BIGINT) * 61001 AS ms FROM conversations)")
def ts_format_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.format_ms(F.col("turn").cast("long") * 61001).alias("shown"))
    return rows.withColumn("parsed", X.timestamp_ms(F.col("shown")))


@query("""SELECT doc_id, k AS sentence, s AS text FROM (SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS k FROM
(SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("k", "text"))
    return rows.select("doc_id", (F.col("k") + 1).cast("long").alias("sentence"), "text")


_LEX = dictionary.Lexicon("demo", {"function": ["the", "of", "and", "der", "le", "la"], "tion": ["tion*", "ti"], "pair": ["of the", "to the*"]})
_W = "list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{p}', repeat(' ', {n})), '[ \\t\\r\\n\\f]+'), lambda x: regexp_matches(x, '[\\pL0-9]'))".format(
    p=X.PUNCTUATION.replace("'", "").replace("-", "").replace("*", ""), n=len(X.PUNCTUATION) - 3)


@query(f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_W} AS w FROM documents),
c AS (SELECT doc_id, len(w) AS wc, text, len(list_filter(w, lambda x: length(x) >= 7)) AS big,
 len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'der', 'le', 'la'))) AS f, len(list_filter(w, lambda x: x = 'ti' OR starts_with(x, 'tion'))) AS t,
 len(regexp_extract_all(' ' || array_to_string(list_transform(w, lambda x: x || ' '), ' ') || ' ', ' of  the ')) + len(regexp_extract_all(' ' || array_to_string(list_transform(w, lambda x: x || ' '), ' ') || ' ', ' to  the[^ ]* ')) AS p FROM w)
SELECT doc_id, wc AS "WC", round(CASE WHEN wc > 0 THEN 100.0 * big / wc ELSE 0 END, 4) AS "BigWords", round(CASE WHEN wc > 0 THEN 100.0 * (length(text) - length(replace(text, ',', ''))) / wc ELSE 0 END, 4) AS "Comma",
 round(CASE WHEN wc > 0 THEN 100.0 * (f + t + p) / wc ELSE 0 END, 4) AS "demo__Dic", round(CASE WHEN wc > 0 THEN 100.0 * f / wc ELSE 0 END, 4) AS "demo__function", round(CASE WHEN wc > 0 THEN 100.0 * t / wc ELSE 0 END, 4) AS "demo__tion", round(CASE WHEN wc > 0 THEN 100.0 * p / wc ELSE 0 END, 4) AS "demo__pair" FROM c""")
def dict_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dictionary.code(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), [_LEX])
    return out.select("doc_id", "WC", "BigWords", "Comma", "demo__Dic", "demo__function", "demo__tion", "demo__pair")


_READ = """t AS (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents), w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[ \\t\\r\\n\\f]+'), lambda x: regexp_matches(x, '[\\pL0-9]')) AS w FROM t),
y AS (SELECT doc_id, t, w, list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouyáàâäãåæéèêëíìîïóòôöõøúùûüýœ]+')) - CASE WHEN regexp_matches(x, '[^aeiouy]e[^\\pL]*$') AND len(regexp_extract_all(x, '[aeiouyáàâäãåæéèêëíìîïóòôöõøúùûüýœ]+')) > 1 THEN 1 ELSE 0 END)) AS y FROM w),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS wn, CAST(greatest(1, len(regexp_extract_all(t, '[.!?]+([ \\t\\r\\n\\f]|$)'))) AS BIGINT) AS sn, CAST(coalesce(list_sum(y), 0) AS BIGINT) AS yn, CAST(len(list_filter(y, lambda k: k >= 3)) AS BIGINT) AS pn,
 CAST(length(regexp_replace(t, '[ \\t\\r\\n\\f]+', '', 'g')) AS BIGINT) AS cn, CAST(length(regexp_replace(t, '[^\\pL]+', '', 'g')) AS BIGINT) AS ln,
 CAST(coalesce(list_sum(list_transform(y[1:100], lambda k: CASE WHEN k >= 3 THEN 3 ELSE 1 END)), 0) AS DOUBLE) AS hw, CAST(greatest(1, len(list_filter(w[1:100], lambda x: regexp_matches(x, '[.!?]$')))) AS DOUBLE) AS hs FROM y)"""


@query(f"""WITH {_READ} SELECT doc_id, wn AS lexicon_count, sn AS sentence_count, yn AS syllable_count, cn AS char_count, round(CASE WHEN wn > 0 THEN 206.835 - 1.015 * wn / sn - 84.6 * yn / wn END, 9) AS flesch_reading_ease, round(CASE WHEN wn > 0 THEN 0.39 * wn / sn + 11.8 * yn / wn - 15.59 END, 9) AS flesch_kincaid_grade,
 round(CASE WHEN wn > 0 THEN 1.0430 * sqrt(30.0 * pn / sn) + 3.1291 END, 9) AS smog_index, round(CASE WHEN wn > 0 THEN 0.0588 * (100.0 * ln / wn) - 0.296 * (100.0 * sn / wn) - 15.8 END, 9) AS coleman_liau_index, round(CASE WHEN wn > 0 THEN 4.71 * cn / wn + 0.5 * wn / sn - 21.43 END, 9) AS automated_readability_index,
 round(CASE WHEN wn > 0 THEN 0.4 * (1.0 * wn / sn + 100.0 * pn / wn) END, 9) AS gunning_fog FROM c""")
def read_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readability.readability(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return _rounded(out.select("doc_id", "lexicon_count", "sentence_count", "syllable_count", "char_count", "flesch_reading_ease", "flesch_kincaid_grade", "smog_index", "coleman_liau_index", "automated_readability_index", "gunning_fog"), 9)


_POOL = """u AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings), m AS (SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1)"""


@query(f"WITH {_POOL} SELECT label, CAST(d AS INTEGER) AS d, round(CASE WHEN n < 1e-12 THEN m ELSE m / n END, 5) AS x FROM m JOIN n USING (label)")
def embed_meanpool_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return _rounded(out.select("label", F.posexplode("embedding").alias("d", "x")), 5)


def _basis(k: int) -> list[float]:
    return [1.0 if (i + k) % 4 == 0 else -0.5 if (i + k) % 4 == 1 else 0.0 for i in range(64)]


@query("""WITH u AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings)
SELECT vec_id, round(sum(x * CASE WHEN d % 4 = 0 THEN 1.0 WHEN d % 4 = 1 THEN -0.5 ELSE 0 END) / sqrt(sum(CAST(x AS DOUBLE) * x)) / sqrt(16 * 1.25), 4) + 0.0 AS arch__a,
round(sum(x * CASE WHEN (d + 1) % 4 = 0 THEN 1.0 WHEN (d + 1) % 4 = 1 THEN -0.5 ELSE 0 END) / sqrt(sum(CAST(x AS DOUBLE) * x)) / sqrt(16 * 1.25), 4) + 0.0 AS arch__b FROM u GROUP BY vec_id""")
def archetype_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.archetype_scores(table(spark, sf_dir, "embeddings"), [("a", _basis(0)), ("b", _basis(1))], "embedding")
    return out.select("vec_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("arch__a", "arch__b")])  # no negative zero


@query("SELECT l_returnflag, CAST(coalesce(sum(w), 0) AS BIGINT) AS l_quantity, round(coalesce(sum(w * l_discount) / nullif(sum(w), 0), 0), 4) AS l_discount, round(coalesce(sum(w * l_tax) / nullif(sum(w), 0), 0), 4) AS l_tax FROM (SELECT *, CASE WHEN l_quantity > 0 THEN CAST(l_quantity AS DOUBLE) END AS w FROM lineitem) GROUP BY l_returnflag")
def wc_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.weighted_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", ["l_discount", "l_tax"]), 4)


@query("SELECT event_type, round(avg(CAST(value AS DOUBLE)), 4) AS value_mean, round(stddev_samp(CAST(value AS DOUBLE)), 4) AS value_std FROM events GROUP BY event_type")
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intervals.turn_summary(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"]), 4)


@query("""WITH w AS (SELECT user_id, event_id, CASE WHEN event_id % 4 <> 0 THEN event_id * 1.0::DOUBLE END AS s, CASE WHEN event_id % 3 <> 0 THEN event_id + 0.5::DOUBLE END AS e FROM events)
SELECT user_id, event_id, coalesce(s, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS word_start,
coalesce(e, first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), s) AS word_end FROM w""")
def word_time_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("double")
    words = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 != 0, n).alias("word_start"), F.when(F.col("event_id") % 3 != 0, n + 0.5).alias("word_end"))
    return intervals.fill_word_times(words, "user_id", "event_id", "word_start", "word_end")


@query("""WITH r AS (SELECT event_id, CAST(round_even(CAST(value AS DOUBLE) * 1000.0::DOUBLE, 0) AS BIGINT) AS a, CAST(round_even((CAST(value AS DOUBLE) + (event_id % 7 - 1)) * 1000.0::DOUBLE, 0) AS BIGINT) AS b FROM events),
c AS (SELECT event_id, greatest(0, least(a, 60000)) AS start_ms, greatest(0, least(b, 60000)) AS end_ms FROM r WHERE b - a >= 20)
SELECT event_id, start_ms, end_ms FROM c WHERE end_ms - start_ms >= 20""")
def turn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns given in seconds of recordings of one minute."""
    value = F.col("value").cast("double")
    rows = table(spark, sf_dir, "events").select("event_id", value.alias("a"), (value + (F.col("event_id") % 7 - 1)).alias("b"))
    return transcripts.valid_turns(rows, "a", "b", unit="s", length=F.lit(60000), least=20).select("event_id", "start_ms", "end_ms")


@query("""SELECT doc_id, s AS win_start, least(s + 300, n) AS win_end FROM (SELECT doc_id, n_chars AS n, unnest(range(0, n_chars, 300)) AS s FROM documents) WHERE least(s + 300, n) - s >= 50""")
def chopped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).cast("long").alias("a"), F.col("n_chars").alias("b"))
    return intervals.chopped_windows(rows, "a", "b", 300, 50).select("doc_id", "win_start", "win_end")


@query("""SELECT event_id, CASE WHEN m <= 1.1::DOUBLE * 60 THEN 's' WHEN m <= 1.1::DOUBLE * 60 * 1000 THEN 'ms' WHEN m <= 1.1::DOUBLE * 960000 THEN 'samples' ELSE 's' END AS unit
FROM (SELECT event_id, CAST(value AS DOUBLE) * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 16000 ELSE 1000000 END AS m FROM events)""")
def time_unit_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(16000), F.lit(1000000)), (F.col("event_id") % 4 + 1).cast("int"))
    m = F.col("value").cast("double") * by
    return table(spark, sf_dir, "events").select("event_id", intervals.guess_time_unit(m, F.lit(60.0), F.lit(960000.0)).alias("unit"))


@query("""SELECT p_partkey, regexp_replace(replace(trim(n), ' ', '_'), '[^A-Za-z0-9_\\-]+', '_', 'g') AS speaker,
regexp_replace(translate(trim(n), '/\\<>:"|?*', '__'), '\\s+', ' ', 'g') AS label, trim(regexp_replace(n, '[^0-9A-Za-z]+', '_', 'g'), '_') AS plain
FROM (SELECT p_partkey, ' ' || p_name || ' /  "' || p_brand || '" <' || CAST(p_size AS VARCHAR) || '> ' AS n FROM part)""")
def label_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat(F.lit(" "), "p_name", F.lit(' /  "'), "p_brand", F.lit('" <'), F.col("p_size").cast("string"), F.lit("> "))
    rows = table(spark, sf_dir, "part").select("p_partkey", n.alias("n"))
    return rows.select("p_partkey", transcripts.speaker_key(F.col("n")).alias("speaker"), transcripts.file_label(F.col("n")).alias("label"), transcripts.plain_label(F.col("n")).alias("plain"))
