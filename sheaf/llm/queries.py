"""The registered queries over this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.runtime import spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.repair import encode_documents

    return encode_documents(spread(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.json"))


@query
def op5_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.packing import pack_documents

    return pack_documents(spread(table(spark, sf_dir, "documents")), tokenizer("byte_bpe_50k.json"))


@query
def op8_simhash_byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.simhash import near_duplicates

    return near_duplicates(spread(table(spark, sf_dir, "documents")))


@query
def op10_piece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.piecebpe import encode_documents

    return encode_documents(spread(table(spark, sf_dir, "documents")), tokenizer("piece_bpe_32k.model"))


@query
def op7_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.langid import identify

    return identify(spread(table(spark, sf_dir, "documents")))


@query
def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.toxicity import classify

    return classify(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


@query
def op6_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.maxscore import top_k

    return top_k(spread(table(spark, sf_dir, "embeddings")))


ORACLE_SQL["op6_maxscore_top_k"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.place <> c.place
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op3_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.llm.linechunks import dedup_lines

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup_lines(docs, count_col="lines_removed")


@query
def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from sheaf.llm.licenses import scan

    found = scan(spread(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.size("sentence_ids").cast("long").alias("n_sentences"),
    )


def _sql_twins() -> None:
    from sheaf.llm import licenses, linechunks

    ORACLE_SQL["op3_line_chunk_dedup"] = (
        f"WITH {linechunks.ORACLE_DEDUP} SELECT d.doc_id, x.text, coalesce(x.lines_removed, 0) AS lines_removed "
        "FROM documents d LEFT JOIN deduped x USING (doc_id)"
    )
    ORACLE_SQL["op4_license_rules"] = licenses.oracle()


_sql_twins()


@query
def op2_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no sound, so each embedding is played as a melody."""
    from sheaf.llm.chroma import recordings, render

    found = recordings(spread(table(spark, sf_dir, "embeddings")), id_col="vec_id", media_col="embedding", decode=render)
    return found.withColumnRenamed("id", "vec_id")
