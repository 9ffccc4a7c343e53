"""Concepts of documents from an injected model."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import recovery
from ..functions import text as tx
from ..functions.models import asked

EXCERPT, SHORTEST = 6000, 200
ANSWER = "summary string, topics array<string>, methods array<string>, named_entities array<string>, domain string"
#: What a model says when it will not answer.
REFUSAL = r"(?i)^\s*(?:i'?m sorry|i cannot|i can'?t|i am unable|as an ai)"


def prompt(excerpt: Column) -> Column:
    return F.concat(F.lit("Give a JSON object with summary (string), topics, methods, named_entities (lists of strings) and domain (string) for this text:\n\n"), excerpt)


def extract_concepts(docs: DataFrame, answer: Callable[[str], str], known: DataFrame | None = None, force: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, status, summary, topics, methods, named_entities, domain) of each document.

    ``known`` documents and excerpts under 200 characters are skipped, a refusal is skipped,
    an error, an answer that holds no object, or one without a summary has failed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.substring(text_col, 1, EXCERPT).alias("excerpt"))
    has = F.lit(False)
    if known is not None and not force:
        rows = rows.join(known.select(F.col("doc_id"), F.lit(True).alias("known")).distinct(), "doc_id", "left")
        has = F.col("known").isNotNull()

    short = F.length(F.coalesce("excerpt", F.lit(""))) < SHORTEST
    told = rows.withColumn("skip", has | short).withColumn("answer", asked(answer, F.when(~F.col("skip"), prompt(F.col("excerpt")))))
    parsed = told.withColumn("c", F.from_json(recovery.recovered_json("answer"), ANSWER))
    status = (F.when(F.col("skip"), "skipped").when(F.col("answer").rlike(REFUSAL), "skipped")
              .when(F.coalesce(tx.strip(F.col("c.summary")), F.lit("")) == "", "failed").otherwise("extracted"))
    fine = status == "extracted"
    lists = [F.when(fine, tx.clean_list(F.coalesce(F.col(f"c.{n}"), F.array().cast("array<string>")))).alias(n) for n in ("topics", "methods", "named_entities")]
    return parsed.select("doc_id", status.alias("status"), F.when(fine, tx.strip(F.col("c.summary"))).alias("summary"), *lists, F.when(fine, F.col("c.domain")).alias("domain"))


def rag_turn(retrieved: DataFrame, answer: Callable[[str], str], question_col: str = "question", text_col: str = "text", rank_col: str = "rank") -> DataFrame:
    """(question, contexts, answer): the retrieved texts in order, put to a model."""
    grouped = retrieved.groupBy(question_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank_col, text_col))), lambda x: x[text_col]).alias("contexts"))
    numbered = F.transform("contexts", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    told = F.concat(F.lit("Answer from the numbered texts.\n\n"), F.array_join(numbered, "\n\n"), F.lit("\n\nQuestion: "), F.col(question_col))
    return grouped.withColumn("answer", asked(answer, told, strict=True))


def make_examples(chunks: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """(question, ground_truth, seed_chunk, seed_doc) from a model that answers with a JSON
    object of question and answer; others are left out."""
    rows = chunks.select("chunk_id", "doc_id", F.from_json(recovery.recovered_json(asked(answer, F.col("text"), strict=True)), "question string, answer string").alias("a"))
    return rows.where("a.question is not null and a.answer is not null").select("a.question", F.col("a.answer").alias("ground_truth"), F.col("chunk_id").alias("seed_chunk"), F.col("doc_id").alias("seed_doc"))
