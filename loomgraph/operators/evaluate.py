"""Retrieval metrics, samples, judged means."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import asked


def rank_of(retrieved: Column, wanted: Column) -> Column:
    """1-based rank of a value in a list; 0 if it is not there."""
    return F.coalesce(F.array_position(retrieved, wanted), F.lit(0))


def retrieval_metrics(results: DataFrame, k: int) -> DataFrame:
    """One row n, hit_at_k_chunk, hit_at_k_doc, mrr. ``results``: seed_chunk, seed_doc,
    chunks and docs (ranked lists). The rank is the seed chunk's, else that of the first
    chunk of its document."""
    c, d = rank_of(F.slice("chunks", 1, k), F.col("seed_chunk")), rank_of(F.slice("docs", 1, k), F.col("seed_doc"))
    rank = F.when(c > 0, c).otherwise(d)
    return results.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((c > 0).cast("double")), 6).alias("hit_at_k_chunk"), F.round(F.avg((d > 0).cast("double")), 6).alias("hit_at_k_doc"),
                       F.round(F.avg(F.when(rank > 0, 1.0 / rank).otherwise(0.0)), 6).alias("mrr"))


def rerank_delta(results: DataFrame, k: int) -> DataFrame:
    """One row n, mean_delta, median_delta, new_hits, lost_hits of ranks before and after
    re-ranking (seed, before, after); a missing rank is k + 1."""
    rank = lambda c: F.when(rank_of(F.col(c), F.col("seed")) > 0, rank_of(F.col(c), F.col("seed"))).otherwise(k + 1)
    rows = results.select(rank("before").alias("b"), rank("after").alias("a")).withColumn("delta", F.col("b") - F.col("a"))
    hist = rows.groupBy("delta").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy(F.lit(0)))
    median = (hist.withColumns({"upto": F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("delta")), "n": n}).where(F.col("upto") > F.floor(F.col("n") / 2))
              .agg(F.min("delta").alias("median_delta")))
    means = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.sum(((F.col("b") > k) & (F.col("a") <= k)).cast("long")).alias("new_hits"),
                     F.sum(((F.col("b") <= k) & (F.col("a") > k)).cast("long")).alias("lost_hits"))
    return means.crossJoin(median)


def failures(questions: DataFrame, results: DataFrame, question_col: str = "question") -> DataFrame:
    """Questions whose seed chunk was not retrieved."""
    hit = results.where(F.array_contains("chunks", F.col("seed_chunk"))).select(question_col)
    return questions.join(hit, question_col, "left_anti")


def stratified_sample(rows: DataFrame, stratum: str, order: Column, cap: int = 3, size: int | None = None) -> DataFrame:
    """At most ``cap`` rows of each stratum in the given order, ``size`` in all. The first rows
    of a stratum come from partial lists of ``cap``, so no task holds a stratum."""
    cols = rows.columns
    keyed = rows.withColumn("__o", order)
    pre = keyed.withColumn("__p", F.spark_partition_id())
    first = pre.withColumn("__r", F.row_number().over(Window.partitionBy(stratum, "__p").orderBy("__o"))).where(F.col("__r") <= cap)
    out = first.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__o"))).where(F.col("__r") <= cap)
    return out.orderBy("__o").limit(size).select(*cols) if size is not None else out.select(*cols)


def load_test_set(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Examples without repeated questions (the first stays), with the text of their chunk."""
    cols = [c for c in rows.columns if c != "question"]
    first = rows.groupBy("question").agg(F.min_by(F.struct(*cols), "position").alias("r")).select("question", "r.*")
    return first.join(chunks.select(F.col("chunk_id").alias("seed_chunk"), F.col("text").alias("context")), "seed_chunk", "left")


def judged_means(judgements: DataFrame, cols: list[str]) -> DataFrame:
    return judgements.agg(*[F.round(F.avg(c), 4).alias(c) for c in cols])


def number(text: str) -> float:
    """The first number of an answer, held to 0 and 1."""
    found = re.search(r"-?\d+(?:\.\d+)?", text)
    if found is None:
        raise ValueError("no number")
    return min(1.0, max(0.0, float(found[0])))


def judge(rows: DataFrame, prompt: Column, answer, parse) -> DataFrame:
    """Rows with a score from an injected model; an error or an odd answer is null."""
    return rows.withColumn("judged", asked(lambda text: float(parse(answer(text))), prompt, "double"))


#: What a judge is asked about a turn: (name, question).
JUDGED = (
    ("faithfulness", "Which share of the answer's claims do the texts support?"), ("answer_relevancy", "How well does the answer meet the question?"),
    ("context_precision", "Which share of the texts helps to answer?"), ("context_recall", "Which share of the expected answer do the texts hold?"),
    ("answer_correctness", "How far does the answer agree with the expected one?"))


def judged_turns(turns: DataFrame, answer, parse) -> DataFrame:
    """(question, answer, contexts, ground_truth) turns with a score from 0 to 1 for each of
    JUDGED, from an injected judge; a failed call is null."""
    body = F.concat(F.lit("\n\nQuestion: "), "question", F.lit("\n\nTexts:\n"), F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), "\n"), F.lit("\n\nAnswer: "),
                    F.coalesce("answer", F.lit("")), F.lit("\n\nExpected: "), F.coalesce("ground_truth", F.lit("")))
    for name, question in JUDGED:
        turns = judge(turns, F.concat(F.lit(f"{question} Reply with a number from 0 to 1."), body), answer, parse).withColumnRenamed("judged", name)
    return turns
