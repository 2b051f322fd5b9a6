"""A training corpus from raw documents, in five stages that each keep what they may.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``; what a stage returns is written as Parquet and read again as the
next one's docs. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import langid, linechunks, packing, simhash, toxicity
from sheaf.llm.queries import tokenizer
from sheaf.runtime import materialize, spread, table

#: A document goes at this probability of being toxic.
TOXIC_AT = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Trained on all labels outside the held-out fold. A null,
    empty or blank text has no toxic word and stays; repeated rows and null ids are judged by
    their texts like others; without labels of both kinds nothing goes unless the labels'
    own rate reaches the threshold; an empty table stays empty; other columns come back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    model = toxicity.train(rows, labels.where(langid.fold(F.col("doc_id"), 4) != 2))
    return toxicity.with_scores(docs, model, "text", lambda p: p < TOXIC_AT)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that was learned go: null, empty and blank texts and all
    others without a letter. Where no row has a language to learn, texts with a letter stay.
    Repeated rows and null ids stay or go by their texts; an empty table stays empty; other
    columns come back, ``lang`` as it was."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    ranked = langid.train(rows.where(langid.fold(F.col("doc_id"), 5) != 0))
    return langid.only_known(docs, ranked, "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occur earlier in the corpus are taken out; no row goes. A null text
    stays null, a document that loses all lines becomes empty, rows equal in id and text
    change alike, a null id comes last; ``n_chars`` follows the text, other columns stay."""
    out = linechunks.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of smallest id stays; of rows that share this
    id, the one of smallest text hash, and of equal texts the first by its columns. Rows are
    told apart by id and text, so an id that repeats with another text is a document of its
    own. Null and blank texts are near duplicates of each other; a row without an id stays
    where its group has no other; an empty table stays empty; other columns come back."""
    return simhash.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, as the packing operator returns them. A null or empty
    text is its end id; null ids and repeated rows are packed like others; an empty table
    gives no pieces."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The models of the first stages have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
