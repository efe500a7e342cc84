"""The corpus pipeline: language ID, near-duplicates, repeated passages, packing.

Each stage takes the documents that the one before it left and, but for the last, returns documents of the same
columns; every stage is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table, released, written
from tidemark.llm.language_id import fit_on_corpus, identify
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import best_fit_packing
from tidemark.llm.repeats import cut_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; those without letters (or without text) go."""
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("doc")  # so that no name of a column matters
    tagged = identify(docs.select("text", rest), fit_on_corpus(docs)).filter("lang_pred <> 'und'")
    return tagged.select(*("text" if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 or more) the document with the least id; documents without an id stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that documents with smaller ids hold; documents of which nothing is left go.

    Where a cut goes through a character, the rest of that character goes too. ``n_chars`` follows the text.
    """
    cut = cut_documents(docs).filter("n_removed = 0 or kept_text <> ''")
    follows = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("doc")["n_chars"])}
    return cut.select(*(follows.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit-decreasing packing of all that is left."""
    return best_fit_packing(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("suffix_array_dedup", repeats), ("packing", packing)]
#: Tokenisers, sketches and models can't be said in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = written(out, f"pipeline-{name}")
        if before is not None:
            released(before)
        before = docs
