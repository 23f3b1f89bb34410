"""A corpus pipeline of five stages over ``documents``.

Language ID, line dedup, n-gram Jaccard join, benchmark decontamination, and
SentencePiece encoding, in this order.  Every stage works on what the stage
before it kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, language_id, line_dedup, ngram_jaccard, sentencepiece_bpe
from weftline.llm.queries import tokenizer_path
from weftline.session import ready, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told, with the language found; texts without a letter go.

    The models learn from the rows of the input that have a language.  Where no row has one, nothing
    can be told, and all documents with a letter stay as they are.  Null and empty texts have no letter;
    a null id or a null other column is no reason to go; repeated rows get equal results.
    """
    if not docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).head(1):
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    model = language_id.train(docs, F.lit(True))
    found = language_id.predict(docs.select(*COLUMNS), model)
    return found.where(F.col("lang_pred") != language_id.UNDETERMINED).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share; documents of which nothing but white space is left go.

    Rows with a null id count as one document; repeated rows lose the same lines; documents that lose no
    line stay as they are, empty ones included.
    """
    kept = line_dedup.dedup(docs.select(*COLUMNS))
    return kept.where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(line_dedup.SPACE))) > 0)).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near duplicates (five words, 0.8).

    Documents without words or without an id are in no group and stay; rows of one id stay or go together.
    """
    found = ngram_jaccard.near_duplicates(docs.select("doc_id", "text"), words=5, num=80, den=100)
    gone = found.where((F.col("n_shingles") > 0) & (F.col("component_id") != F.col("doc_id"))).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none, repeated rows stay or go together."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of every document, and digests of its ids and of the text decoded from them.

    Null texts are empty; a null id is no reason to go; repeated rows give repeated rows; long texts are encoded whole.
    """
    return sentencepiece_bpe.encode(docs.select(*COLUMNS), tokenizer_path("piece_bpe_32k.model"), digest=True, carry=["doc_id", "lang", "source"])


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage under the session settings that bound a task's memory."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ready(spark), docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", _bounded(identify_language)),
    ("line_dedup", _bounded(drop_lines)),
    ("ngram_jaccard", _bounded(drop_near_duplicates)),
    ("decontaminate", _bounded(drop_benchmark)),
    ("sentencepiece", _bounded(encode_pieces)),
]

#: A linear classifier, locality-sensitive search and a tokenizer's model are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
