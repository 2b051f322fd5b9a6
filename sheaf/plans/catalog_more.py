"""Further registered queries with their SQL twins: sources and sinks, subtitles, speech,
readability in full, folds, dictionaries and encoders. Tables are written to the shared
folder and read back where a query is about reading or writing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.operators import dictionary, features, gather, intervals, lexical, readability, speech, transcripts, vectors
from sheaf.plans.catalog import _LEX, _READ, _TOKENS, _W, _basis, _rounded, query
from sheaf.runtime import new_path, spread, table
from sheaf.sources import files, subtitles


# ---- sources and sinks

def _strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || chr(10) || '"' || p_brand || '", ' || p_type AS said, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def src_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file of cells with line ends, quotes and commas, read back as text."""
    said = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", '), "p_type")
    rows = _strings(table(spark, sf_dir, "part").select("p_partkey", said.alias("said"), "p_size"))
    path = files.write_csv(rows, new_path(spark, "csv-scan"), overwrite=True)
    return files.read_csv(spark, path, delimiter=",")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name || ', Ltd' AS named FROM supplier")
def src_csv_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with semicolons, whose delimiter is found from its first bytes."""
    rows = _strings(table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit(", Ltd")).alias("named")))
    path = f"{new_path(spark, 'csv-sniff')}/parts"
    rows.coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    part = [f for f in spark.read.text(path).inputFiles() if f.endswith(".csv")]
    return files.read_csv(spark, part[0])


@query("""SELECT 'nation' AS source, CAST(n_nationkey AS VARCHAR) AS "source.1", nullif(n_name, 'NATION_3') AS n_name, NULL AS r_name FROM nation
UNION ALL SELECT 'region', NULL, NULL, r_name FROM region""")
def src_csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with provenance under all their columns; a column named like it is renamed, and
    what stands for a missing value is null."""
    name = F.when(F.col("n_name") == "NATION_3", "NA").otherwise(F.col("n_name"))
    nation = _strings(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), name.alias("n_name")))
    region = table(spark, sf_dir, "region").select("r_name")
    frames = []
    for stem, df in (("nation", nation), ("region", region)):
        frame = files.read_csv(spark, files.write_csv(df, f"{new_path(spark, 'csv-union')}/{stem}.csv", overwrite=True), delimiter=",")
        frames.append(features.add_source(files.without_missing(frame), stem))
    return features.union_by_name(frames)


@query("SELECT 'text_' || CAST(n_nationkey AS VARCHAR) AS text_id, n_name || chr(10) || CAST(n_regionkey AS VARCHAR) AS text FROM nation")
def src_text_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files, one for each nation."""
    folder = new_path(spark, "texts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in table(spark, sf_dir, "nation").collect():
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/text_{r['n_nationkey']}.txt")
        out = p.getFileSystem(conf).create(p)
        out.write(bytearray(f"{r['n_name']}\n{r['n_regionkey']}".encode()))
        out.close()
    return files.read_texts(spark, folder).select("text_id", "text")


@query("SELECT 'row_' || CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) AS text_id, text FROM documents QUALIFY text <> ''")
def gather_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are numbered before those without text go."""
    rows = gather.with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return gather.gather_rows(rows, ["text"], [], text_id=F.col("row_id"))


@query("SELECT concat_ws(' | ', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS text_id, CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, text FROM conversations WHERE text <> ''")
def sink_analysis_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gathered texts as a CSV table, sorted when written, and read back."""
    ready = gather.gather_rows(table(spark, sf_dir, "conversations"), ["text"], ["conv_id", "turn"])
    return files.read_csv(spark, files.write_csv(ready, new_path(spark, "ready"), overwrite=True, order_by=["text_id"]), delimiter=",")


@query("""SELECT l_returnflag AS source, CAST(l_linestatus AS VARCHAR) AS file_source, round(avg(l_tax), 6) AS tax__mean, count(l_tax) AS tax__count FROM lineitem GROUP BY 1, 2""")
def feat_promoted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that provenance renamed becomes the key, and provenance ``file_source``."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("source"), F.col("l_returnflag").alias("source.1"), F.col("l_tax").alias("tax"))
    promoted = features.promote_inner_keys(rows, ["source"])
    plan = features.AggregationPlan(["source", "file_source"], stats=["mean", "count"])
    return _rounded(features.aggregate_features(promoted, plan))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def feat_choose_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    chosen = features.choose_columns(rows.columns, exclude_cols=["o_custkey"], include_regex="^o_(order|total)", exclude_regex="date|priority", must_keep=["o_orderkey"])
    return rows.select(*chosen)


@query("""SELECT l_returnflag, round(skewness(l_tax), 4) AS l_tax__skew, round(product(1 + l_tax / 1e5), 8) AS l_tax1__prod, arg_min(l_tax, (l_orderkey, l_linenumber, l_partkey)) AS l_tax__first, arg_max(l_tax, (l_orderkey, l_linenumber, l_partkey)) AS l_tax__last
FROM lineitem GROUP BY l_returnflag""")
def feat_agg_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_tax", (1 + F.col("l_tax") / 1e5).alias("l_tax1"))
    plan = features.AggregationPlan(["l_returnflag"], stats=["skew", "prod", "first", "last"], include_regex="^l_tax", order_by=["l_orderkey", "l_linenumber", "l_partkey"])
    out = features.aggregate_features(rows, plan)
    return out.select("l_returnflag", F.round("l_tax__skew", 4).alias("l_tax__skew"), F.round("l_tax1__prod", 8).alias("l_tax1__prod"), "l_tax__first", "l_tax__last")


# ---- subtitles and transcripts

_SAID = "regexp_replace(text, chr(10) || '+', chr(10), 'g')"


def _cues(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    ms = F.col("turn").cast("long") * 7001
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("." + kind)).alias("path"), (F.col("turn") + 1).cast("int").alias("cue"),
        ms.alias("start_ms"), (ms + 6500).alias("end_ms"), F.col("role").alias("speaker"), F.regexp_replace("text", "\n+", "\n").alias("text"),
    )


@query(f"SELECT 'c' || CAST(conv_id AS VARCHAR) || '.srt' AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS number, CAST(turn AS BIGINT) * 7001 AS start_ms, CAST(turn AS BIGINT) * 7001 + 6500 AS end_ms, role || ': ' || {_SAID} AS text FROM conversations")
def sub_srt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as SubRip files with speakers, parsed back."""
    return subtitles.parse_contents(subtitles.to_lines(_cues(spark, sf_dir, "srt"), "srt", name="speaker")).select("path", "number", "start_ms", "end_ms", "text")


@query(f"SELECT 'c' || CAST(conv_id AS VARCHAR) || '.vtt' AS path, CAST(turn AS BIGINT) * 7001 AS start_ms, CAST(turn AS BIGINT) * 7001 + 6500 AS end_ms, {_SAID} AS text FROM conversations")
def sub_vtt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as WebVTT files, parsed back."""
    return subtitles.parse_contents(subtitles.to_lines(_cues(spark, sf_dir, "vtt"), "vtt")).select("path", "start_ms", "end_ms", "text")


@query(f"SELECT 'c' || CAST(conv_id AS VARCHAR) || '.srt' AS path, CAST(turn + 1 AS INTEGER) AS cue, CAST(CAST(turn AS BIGINT) * 7001 AS VARCHAR) AS start_time, CAST(CAST(turn AS BIGINT) * 7001 + 6500 AS VARCHAR) AS end_time, role AS name, {_SAID} AS text FROM conversations")
def sub_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.to_table(_cues(spark, sf_dir, "srt"), name="speaker")


@query(f"""WITH r AS (SELECT conv_id, turn, role, {_SAID} AS text, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r),
p AS (SELECT conv_id, run, min(role) || ': ' || string_agg(text, ' ' ORDER BY turn) AS p FROM g GROUP BY conv_id, run)
SELECT 'c' || CAST(conv_id AS VARCHAR) || '.txt' AS path, string_agg(p, chr(10) || chr(10) ORDER BY run) AS content FROM p GROUP BY conv_id""")
def sub_transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.transcript_text(_cues(spark, sf_dir, "txt"), "speaker")


@query("SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS start_ms, CAST(round_even(value + 100, 0) AS BIGINT) AS end_ms, event_type AS speaker FROM events")
def turn_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript whose columns have other names."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("from"), (F.col("value") + 100).alias("end_sec"), F.col("event_type").alias("spk"))
    a, b, who = transcripts.transcript_columns(rows.columns)
    return transcripts.valid_turns(rows, a, b).select("event_id", "start_ms", "end_ms", F.col(who).alias("speaker"))


_SPOKEN = """w AS (SELECT conv_id, CAST(turn * 1000 + k - 1 AS DOUBLE) AS o, word, {who} AS speaker FROM (SELECT conv_id, turn, role, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS k FROM (SELECT conv_id, turn, role, string_split(text, ' ') AS l FROM conversations))),
s AS (SELECT *, CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END AS fin FROM w),
i AS (SELECT *, coalesce(sum(fin) OVER (PARTITION BY conv_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM s),
c AS (SELECT conv_id, sentence, speaker, count(*) AS n, min(o) AS first FROM i GROUP BY ALL),
m AS (SELECT conv_id, sentence, arg_max(speaker, (n, -first)) AS most, max(n) AS n, sum(n) AS len FROM c GROUP BY ALL),
r AS (SELECT i.conv_id, o, word, CASE WHEN len <= 50 AND m.n >= len // 2 THEN most ELSE speaker END AS speaker FROM i JOIN m USING (conv_id, sentence))"""


_MIXED = "CASE WHEN (k - 1) // 7 % 2 = 0 THEN role ELSE 'other' END"


@query(f"WITH {_SPOKEN.format(who=_MIXED)} SELECT conv_id, o, word, speaker FROM r")
def word_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations, every other seven of them given to another speaker, realigned by
    their sentences."""
    words = _words(spark, sf_dir)
    words = words.withColumn("speaker", F.when(F.floor(F.col("o") % 1000 / 7) % 2 == 0, F.col("speaker")).otherwise("other"))
    return speech.realigned_words(words, "conv_id", "o").select("conv_id", "o", "word", "speaker")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.posexplode(F.split("text", " ")).alias("k", "word"))
    at = F.col("turn") * 1000.0 + F.col("k")
    return words.select("conv_id", at.alias("o"), "word", "speaker", at.alias("start"), (at + 1).alias("end"))


@query(f"""WITH {_SPOKEN.format(who="role")}, b AS (SELECT *, lag(word) OVER w AS before, lag(speaker) OVER w AS who FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY o)),
n AS (SELECT *, CASE WHEN who IS NOT DISTINCT FROM speaker AND NOT (right(before, 1) IN ('?', '!') OR right(before, 1) = '.' AND right(before, 2) <> '..'
  AND NOT (regexp_matches(before, '^\\pL[.]$') AND regexp_matches(word, '^\\p{{Lu}}'))) THEN 0 ELSE 1 END AS new FROM b),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY o) AS utterance FROM n)
SELECT conv_id, CAST(utterance AS BIGINT) AS utterance, min(speaker) AS speaker, CAST(min(o) AS DOUBLE) AS start, CAST(max(o) + 1 AS DOUBLE) AS "end", string_agg(word, ' ' ORDER BY o) || ' ' AS text FROM g GROUP BY conv_id, utterance""")
def speaker_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations as a transcript, realigned and grouped into utterances."""
    return speech.speaker_utterances(_words(spark, sf_dir), "conv_id", "o")


@query("""WITH w AS (SELECT user_id, event_id, 'w' || CAST(event_id AS VARCHAR) AS word, CASE WHEN event_id % 5 < 2 THEN CAST(event_id AS DOUBLE) END AS s, CAST(event_id AS DOUBLE) + 0.5 AS e FROM events),
o AS (SELECT *, CASE WHEN s IS NOT NULL OR coalesce(lag(s IS NULL) OVER q, false) = false THEN 1 ELSE 0 END AS new FROM w WINDOW q AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM o),
r AS (SELECT user_id, run, min(event_id) AS event_id, string_agg(word, ' ' ORDER BY event_id) AS word, min(s) AS s, arg_min(e, event_id) AS e, count(*) AS n FROM g GROUP BY user_id, run),
f AS (SELECT *, coalesce(s, lag(e) OVER q, 0) AS a, lead(s) OVER q AS ns, lead(run) OVER q AS nr FROM r WINDOW q AS (PARTITION BY user_id ORDER BY run))
SELECT user_id, event_id, word, a AS start, CASE WHEN s IS NOT NULL THEN e WHEN nr IS NULL THEN CASE WHEN n = 1 THEN a ELSE 1e6 END ELSE ns END AS "end" FROM f""")
def word_merge_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("double")
    words = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("word"),
                                                  F.when(F.col("event_id") % 5 < 2, n).alias("start"), (n + 0.5).alias("end"))
    return intervals.merge_untimed(words, "user_id", "event_id", final=F.lit(1e6))


@query("""WITH d AS (SELECT doc_id AS path, n_chars AS n FROM documents), l AS (SELECT path, unnest([0, n // 2]) AS a, unnest([n // 3, n]) AS b FROM d),
p AS (SELECT path, s AS win_start, least(s + 300, b) AS win_end FROM (SELECT path, a, b, unnest(range(a, b, 300)) AS s FROM l WHERE b - a >= 100) WHERE least(s + 300, b) - s >= 100),
u AS (SELECT * FROM p UNION ALL SELECT path, 0, n FROM d WHERE path NOT IN (SELECT path FROM p))
SELECT path, win_start, win_end, row_number() OVER (PARTITION BY path ORDER BY win_start) - 1 AS segment FROM u""")
def embedding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud stretches cut into windows; a whole recording where none is long enough."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").cast("long").alias("n"))
    cut = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.floor(F.col("n") / 3).alias("b")), F.struct(F.floor(F.col("n") / 2).alias("a"), F.col("n").alias("b")))
    loud = rows.select("path", F.inline(cut))
    return intervals.embedding_windows(rows, F.col("n"), 100, intervals=loud, window_s=3, least_s=1).select("path", "win_start", "win_end", "segment")


# ---- texts

_NEW = "CASE WHEN list_contains(a.seen, x.seen[1]) THEN 0 ELSE 1 END"
_FACTORS = """list_reduce(list_transform({l}, lambda x: {{'seen': [x], 'n': 0, 'size': 0, 'closed': 0.0::DOUBLE}}),
 lambda a, x: CASE WHEN (a.n + NEW) / (a.size + 1)::DOUBLE <= 0.72::DOUBLE THEN {{'seen': x.seen[1:0], 'n': 0, 'size': 0, 'closed': a.closed + 1}}
 ELSE {{'seen': CASE WHEN list_contains(a.seen, x.seen[1]) THEN a.seen ELSE list_append(a.seen, x.seen[1]) END, 'n': a.n + NEW, 'size': a.size + 1, 'closed': a.closed}} END,
 {{'seen': {l}[1:0], 'n': 0, 'size': 0, 'closed': 0.0::DOUBLE}})""".replace("NEW", _NEW)
_FACTOR = "coalesce(nullif({f}.closed + CASE WHEN {f}.size > 0 THEN (1 - {f}.n / {f}.size::DOUBLE) / (1 - 0.72::DOUBLE) ELSE 0 END, 0), 1)"


@query(f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), f AS (SELECT doc_id, len(t) AS n, {_FACTORS.format(l='t')} AS a, {_FACTORS.format(l='list_reverse(t)')} AS b FROM tok)
SELECT doc_id, round(CASE WHEN n > 0 THEN (n / {_FACTOR.format(f='a')} + n / {_FACTOR.format(f='b')}) / 2 END, 6) AS mtld_0_72 FROM f""")
def lex_mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _rounded(lexical.lexical_richness(docs, metrics=["mtld"]))


_INDEX = """i AS (SELECT doc_id, wn, sn, yn, cn, pn, 206.835::DOUBLE - 1.015::DOUBLE * wn / sn - 84.6::DOUBLE * yn / wn AS fre, 0.39::DOUBLE * wn / sn + 11.8::DOUBLE * yn / wn - 15.59::DOUBLE AS fk, 1.0430::DOUBLE * sqrt(30.0::DOUBLE * pn / sn) + 3.1291::DOUBLE AS smog,
 0.0588::DOUBLE * (100.0::DOUBLE * ln / wn) - 0.296::DOUBLE * (100.0::DOUBLE * sn / wn) - 15.8::DOUBLE AS cli, 4.71::DOUBLE * cn / wn + 0.5::DOUBLE * wn / sn - 21.43::DOUBLE AS ari,
 0.1579::DOUBLE * (100.0::DOUBLE * pn / wn) + 0.0496::DOUBLE * wn / sn + CASE WHEN 100.0::DOUBLE * pn / wn > 5 THEN 3.6365::DOUBLE ELSE 0 END AS dc, CASE WHEN hw / hs > 20 THEN hw / hs / 2 ELSE (hw / hs - 2) / 2 END AS lw,
 0.4::DOUBLE * (wn::DOUBLE / sn + 100.0::DOUBLE * pn / wn) AS fog, 0.121::DOUBLE * wn / sn + 0.082::DOUBLE * (100.0::DOUBLE * pn / wn) + 0.659::DOUBLE AS sp, ln::DOUBLE / wn AS al FROM c WHERE wn > 0)"""
_HALF = "CAST(CASE WHEN {x} >= 0 THEN floor({x} + 0.5) ELSE floor({x} - 0.5) END AS INTEGER), CAST(ceil({x}) AS INTEGER)"
_VOTES = "list_concat([" + _HALF.format(x="fk") + "], CASE " + " ".join(
    f"WHEN fre >= {a} AND fre < {a + 10} THEN {g}" for a, g in [(90, "[5]"), (80, "[6]"), (70, "[7]"), (60, "[8, 9]"), (50, "[10]"), (40, "[11]"), (30, "[12]")]
) + " ELSE [13] END, [" + ", ".join(_HALF.format(x=x) for x in ("smog", "cli", "ari", "dc", "lw", "fog")) + "])"
_SUFFIX = "CASE WHEN {g} % 100 IN (11, 12, 13) THEN 'th' WHEN {g} % 10 = 1 THEN 'st' WHEN {g} % 10 = 2 THEN 'nd' WHEN {g} % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(f"""WITH {_READ}, {_INDEX}, v AS (SELECT doc_id, unnest(votes) AS g, unnest(range(len(votes))) AS k FROM (SELECT doc_id, {_VOTES} AS votes FROM i)),
n AS (SELECT doc_id, g, count(*) AS n, min(k) AS k FROM v GROUP BY doc_id, g), b AS (SELECT doc_id, arg_max(g, (n, -k)) AS g FROM n GROUP BY doc_id),
x AS (SELECT doc_id, CAST(g - 1 AS VARCHAR) || {_SUFFIX.format(g='(g - 1)')} || ' and ' || CAST(g AS VARCHAR) || {_SUFFIX.format(g='g')} || ' grade' AS label FROM b)
SELECT c.doc_id, round(fre, 6) AS flesch_reading_ease, round(smog, 6) AS smog_index, round(fk, 6) AS flesch_kincaid_grade, round(cli, 6) AS coleman_liau_index, round(ari, 6) AS automated_readability_index, round(dc, 6) AS dale_chall_readability_score,
 c.pn AS difficult_words, round(lw, 6) AS linsear_write_formula, round(fog, 6) AS gunning_fog, label AS text_standard, round(sp, 6) AS spache_readability, label AS readability_consensus, c.yn AS syllable_count, c.wn AS lexicon_count, c.sn AS sentence_count,
 c.cn AS char_count, round(c.wn::DOUBLE / c.sn / (c.wn > 0)::INTEGER, 6) AS avg_sentence_length, round(i.yn::DOUBLE / i.wn, 6) AS avg_syllables_per_word, round(al, 6) AS avg_letter_per_word FROM c LEFT JOIN i USING (doc_id) LEFT JOIN x USING (doc_id)""")
def read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(readability.readability(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def _share(e: str) -> str:
    return f"round(CASE WHEN wc > 0 THEN 100.0 * ({e}) / wc ELSE 0 END, 4)"


def _without(marks: str) -> str:
    quoted = marks.replace("'", "''")
    return f"length(text) - length(translate(text, '{quoted}', ''))"


@query(f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_W} AS w FROM documents), c AS (SELECT *, len(w) AS wc FROM w)
SELECT doc_id, wc AS "WC", {_share("len(list_filter(w, lambda x: length(x) >= 7))")} AS "BigWords", {_share("len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$')))")} AS "Numbers", {_share(_without(X.PUNCTUATION))} AS "AllPunct",
 {_share(_without("."))} AS "Period", {_share(_without(","))} AS "Comma", {_share(_without("?"))} AS "QMark", {_share(_without("!"))} AS "Exclam", {_share(_without("'"))} AS "Apostro" FROM c""")
def dict_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that stand once for all dictionaries."""
    out = dictionary.code(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), [_LEX])
    return out.select("doc_id", *dictionary.GLOBALS)


@query("""WITH m AS (SELECT list_transform(range(64), lambda d: CAST(d AS DOUBLE) / 640) AS mean),
u AS (SELECT vec_id, unnest(embedding)::DOUBLE - unnest(mean) AS x, unnest(range(64)) AS d FROM embeddings, m),
a AS (SELECT d, CASE WHEN d % 4 = 0 THEN 1.0::DOUBLE WHEN d % 4 = 1 THEN -0.5::DOUBLE ELSE 0 END - CAST(d AS DOUBLE) / 640 AS y FROM (SELECT unnest(range(64)) AS d)),
c AS (SELECT vec_id, sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)) AS r FROM u JOIN a USING (d) GROUP BY vec_id)
SELECT vec_id, round(atanh(greatest(-0.999999::DOUBLE, least(0.999999::DOUBLE, r))), 4) + 0.0 AS arch__a FROM c""")
def archetype_centered_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines after a mean vector is taken off, by Fisher's z."""
    mean = [d / 640 for d in range(64)]
    out = vectors.archetype_scores(table(spark, sf_dir, "embeddings"), [("a", _basis(0))], "embedding", mean=mean, fisher_z=True)
    return out.select("vec_id", (F.round("arch__a", 4) + F.lit(0.0)).alias("arch__a"))


def _letter_counts():
    """A stand-in for an encoder of sentences: counts of five letters, and one."""
    return lambda said: np.array([[float(s.count(c)) for c in "aeiou"] + [1.0] for s in said])


_SENTENCES = """s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, s, list_concat(list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: CAST(length(s) - length(replace(s, c, '')) AS DOUBLE)), [1.0::DOUBLE]) AS v FROM (SELECT doc_id, unnest(l) AS s FROM s))"""


@query(f"""WITH {_SENTENCES}, m AS (SELECT doc_id, d, avg(x) AS x FROM (SELECT doc_id, unnest(v) AS x, unnest(range(6)) AS d FROM e) GROUP BY doc_id, d), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM m GROUP BY doc_id)
SELECT s.doc_id, CAST(m.d AS INTEGER) AS d, round(x / n, 6) AS x FROM s LEFT JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""")
def sentence_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean sentence vectors of length one, by a stand-in for an encoder."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = vectors.sentence_embeddings(docs, _letter_counts(), id_col="doc_id")
    return _rounded(out.select("doc_id", F.posexplode_outer("vector").alias("d", "x")))


_ARCHETYPES = {"warm": ["a good day at last", "all is calm"], "cold": ["no hope in gloom", "out of luck"]}


@query(f"""WITH {_SENTENCES}, k AS (SELECT unnest([{", ".join(f"'{n}'" for n, said in _ARCHETYPES.items() for _ in said)}]) AS name, unnest([{", ".join(f"'{t}'" for said in _ARCHETYPES.values() for t in said)}]) AS t),
kv AS (SELECT name, list_concat(list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: CAST(length(t) - length(replace(t, c, '')) AS DOUBLE)), [1.0::DOUBLE]) AS v FROM k),
ka AS (SELECT name, d, avg(x) AS x FROM (SELECT name, unnest(v) AS x, unnest(range(6)) AS d FROM kv) GROUP BY name, d), off AS (SELECT d, avg(x) AS o FROM ka GROUP BY d),
kc AS (SELECT name, d, x - o AS y FROM ka JOIN off USING (d)), ev AS (SELECT doc_id, id, wc, unnest(v) AS x, unnest(range(6)) AS d FROM (SELECT doc_id, row_number() OVER () AS id, len(regexp_split_to_array(s, '\\s+')) AS wc, v FROM e)),
c AS (SELECT doc_id, id, wc, name, sum((x - o) * y) / sqrt(sum((x - o) * (x - o))) / sqrt(sum(y * y)) AS r FROM ev JOIN off USING (d) JOIN kc USING (d) GROUP BY ALL),
r AS (SELECT doc_id, CAST(sum(wc) FILTER (name = 'warm') AS BIGINT) AS w, sum(wc * r) FILTER (name = 'warm') / sum(wc) FILTER (name = 'warm') AS warm, sum(wc * r) FILTER (name = 'cold') / sum(wc) FILTER (name = 'cold') AS cold FROM c GROUP BY doc_id)
SELECT s.doc_id, coalesce(w, 0) AS "WC", round(coalesce(warm, 0), 4) + 0.0 AS mood__warm, round(coalesce(cold, 0), 4) + 0.0 AS mood__cold FROM s LEFT JOIN r USING (doc_id)""")
def archetype_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archetypes of texts: sentence scores weighted by their words, by the same stand-in."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = vectors.score_archetypes(docs, {"mood": _ARCHETYPES}, _letter_counts(), id_col="doc_id")
    return out.select("doc_id", "WC", *[(F.col(f"mood__{n}") + F.lit(0.0)).alias(f"mood__{n}") for n in _ARCHETYPES])
