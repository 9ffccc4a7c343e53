"""The corpus pipeline: quality, boilerplate lines, near duplicates, leaks, token ids."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontaminate, line_dedup, near_dedup, quality_knn
from loomgraph.llm.common import Stage, bound_arrow, crc_mod, read
from loomgraph.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts get the vote of
    the whole sample."""
    bound_arrow(spark)
    docs = docs.select(*COLUMNS)
    rows = quality_knn.training_rows(docs, read(spark, sf_dir, "labels"), "quality", "doc_id", "text", crc_mod("doc_id", 3) != 1)
    score = quality_knn.score_column(spark, quality_knn.fit(*rows), F.col("text"))
    return docs.where(score >= 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are boilerplate on their source; n_chars follows. Every row
    stays: a null text stays null, one of boilerplate alone becomes empty, rows that repeat
    count as pages each, and a null source is a source of its own."""
    out = line_dedup.drop_boilerplate(docs.select(*COLUMNS))
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id. Null and blank
    texts and rows without an id stay; rows that repeat the kept id stay too."""
    docs = docs.select(*COLUMNS)
    dropped = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item; null, empty and short texts leak none. An id that
    occurs on several rows goes with all of them if one leaks; rows without an id stay."""
    bound_arrow(spark)
    docs = docs.select(*COLUMNS)
    leaked = decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of each text, and digests of its ids and of what they decode to; null counts
    as empty, and repeated rows give a row each."""
    bound_arrow(spark)
    path = tokenizer("byte_bpe_50k.json")
    return bpe.encode_decode(docs.select("doc_id", "text"), path, bpe.build_lexicon(docs, path), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("leaks", leaks), ("encode", encode),
]

#: SQL expresses neither the classifier nor the encoder; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again; a table
    goes once the next one stands."""
    tables, docs = Stage(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            tables.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
