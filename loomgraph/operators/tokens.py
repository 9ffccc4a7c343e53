"""Token accounting: served tokens against what the naive way would cost."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

TOKENIZER = "chars_per_4"
GROUPS = ("tool", "day", "surface")


def filtered(log: DataFrame, since: str | None = None, until: str | None = None, tool: str | None = None, surface_id: str | None = None) -> DataFrame:
    """Log rows within inclusive dates; rows whose time is no date pass the date filters."""
    day = tx.iso_date(F.col("ts").cast("string"))
    out = log
    for bound, test in ((since, lambda b: day >= F.to_date(F.lit(b))), (until, lambda b: day <= F.to_date(F.lit(b)))):
        if bound:
            out = out.where(day.isNull() | test(bound))
    if tool:
        out = out.where(F.col("tool") == tool)
    return out.where(F.col("surface_id") == surface_id) if surface_id else out


def _key(group_by: str) -> Column:
    if group_by == "day":
        return F.coalesce(tx.iso_date(F.col("ts").cast("string")).cast("string"), F.lit("unknown"))
    return F.col("surface_id" if group_by == "surface" else "tool").cast("string")


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("served"), F.lit(0)).alias("served"), F.coalesce(F.sum("counterfactual"), F.lit(0)).alias("counterfactual")]


def report(log: DataFrame, group_by: str = "tool") -> DataFrame:
    """(group, n_calls, served, counterfactual, ratio); an unknown grouping is by tool."""
    key = _key(group_by if group_by in GROUPS else "tool")
    return log.groupBy(key.alias("group")).agg(*_sums()).withColumn("ratio", tx.ratio(F.col("served"), F.col("counterfactual")))


def totals(log: DataFrame) -> DataFrame:
    """One row: n_calls, served, counterfactual, saved, ratio, saved_pct."""
    some = F.col("served") > 0
    saved = F.col("counterfactual") - F.col("served")
    return log.agg(*_sums()).withColumns({
        "saved": F.when(some, saved).otherwise(0), "ratio": tx.ratio(F.col("served"), F.col("counterfactual")),
        "saved_pct": F.when(some, F.round(100.0 * saved / F.greatest(F.col("counterfactual"), F.lit(1)), 1)).otherwise(0.0)})


def record(tool: str, surface_id: str, served: int, counterfactual: int, ts: str, extras: dict[str, str] | None = None) -> tuple:
    return (ts, tool, surface_id, served, counterfactual, round(counterfactual / served, 2) if served else 1.0, TOKENIZER, extras or {})


def card_tokens(cards: DataFrame) -> DataFrame:
    return cards.select(F.col("doc_id").cast("string").alias("doc_id"), tx.count_tokens(F.col("markdown")).alias("tokens"))


def tokens_of(doc_ids: DataFrame, cards: DataFrame) -> DataFrame:
    """One row ``tokens``: the cards of the documents; a missing card counts 0."""
    return doc_ids.select(F.regexp_replace("node_id", "^doc::", "").alias("doc_id")).join(card_tokens(cards), "doc_id", "left").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def community_cost(partition: DataFrame, cards: DataFrame) -> DataFrame:
    """(community_id, tokens): the cards of all members."""
    p = partition.select("community_id", F.regexp_replace("node_id", "^doc::", "").alias("doc_id"))
    return p.join(card_tokens(cards), "doc_id", "left").groupBy("community_id").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def total_cost(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    return chunks.agg(F.coalesce(F.sum(tx.count_tokens(F.col(text_col))), F.lit(0)).alias("tokens"))
