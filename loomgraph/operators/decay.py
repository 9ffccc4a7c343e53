"""Relevance decay, supersession, archive candidates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import backlinks

HALF_LIFE_DAYS, TOLERANCE, DIGITS, SUPERSEDED_FACTOR, ARCHIVE_BELOW = 365.0, 1e-4, 4, 0.1, 0.1


def relevance(links: Column, last_touched: Column, half_life: Column, today: Column) -> Column:
    """max(backlinks, 1) halved every half-life since the last touch. A null half-life is
    pinned; a missing or future date has age 0; one at or under 0 is an error."""
    base = F.greatest(F.coalesce(links, F.lit(0)), F.lit(1)).cast("double")
    age = F.greatest(F.coalesce(F.datediff(today, last_touched), F.lit(0)), F.lit(0))
    checked = F.when(half_life <= 0, F.raise_error(F.lit("half_life_days must be positive")).cast("double")).otherwise(half_life.cast("double"))
    return F.when(half_life.isNull(), base).otherwise(base * F.pow(F.lit(0.5), age / checked))


def supersession_pairs(cards: DataFrame) -> DataFrame:
    """(newer, older, reason): what each card supersedes; reason tells why a pair is skipped
    and is null for those that hold."""
    pairs = cards.select(F.col("doc_id").alias("newer"), F.explode("supersedes").alias("older")).where(F.coalesce("older", F.lit("")) != "").distinct()
    known = cards.select(F.col("doc_id").alias("older"), F.lit(True).alias("known"))
    return pairs.join(known, "older", "left").select("newer", "older", F.when(F.col("known").isNull(), "unknown_card").when(F.col("newer") == F.col("older"), "self").alias("reason"))


def supersede(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cards with status and relevance of superseded ones, each once however often named."""
    old = pairs.where("reason is null").select(F.col("older").alias("doc_id"), F.lit(True).alias("gone")).distinct()
    return cards.join(old, "doc_id", "left").withColumns({
        "relevance": F.when(F.col("gone"), F.round(F.col("relevance") * SUPERSEDED_FACTOR, DIGITS)).otherwise(F.col("relevance")),
        "status": F.when(F.col("gone"), F.lit("superseded")).otherwise(F.col("status"))}).drop("gone")


def supersession_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with one ``supersedes`` edge a pair, however often the pass runs."""
    from ..ids import doc_node

    new = pairs.where("reason is null").select(doc_node(F.col("newer")).alias("src"), doc_node(F.col("older")).alias("dst"), F.lit("supersedes").alias("relation"))
    kept = edges.join(new, ["src", "dst", "relation"], "left_anti")
    return kept.unionByName(new.withColumn("confidence", F.lit("EXTRACTED")), allowMissingColumns=True)


def archive_candidates(cards: DataFrame, below: float = ARCHIVE_BELOW) -> DataFrame:
    return cards.where(F.col("relevance") < below).orderBy("relevance", "doc_id")


def decay_pass(cards: DataFrame, edges: DataFrame, today: Column) -> DataFrame:
    """Cards after a pass, with ``decayed`` for those whose relevance was rewritten. A pinned
    card (status or null half-life) keeps its own; a change within the tolerance is none."""
    from ..ids import doc_node

    links = backlinks(edges)
    pinned = (F.col("status") == "pinned") | F.col("half_life_days").isNull()
    joined = cards.withColumn("node_id", doc_node(F.col("doc_id"))).join(links, "node_id", "left").drop("node_id")
    value = relevance(F.col("backlinks"), F.try_to_date(F.substring("last_touched", 1, 10)), F.when(~pinned, F.col("half_life_days")), today)
    changed = ~F.coalesce(pinned, F.lit(False)) & (F.abs(value - F.coalesce("relevance", F.lit(0.0))) > TOLERANCE)
    out = joined.withColumns({"decayed": changed, "relevance": F.when(changed, F.round(value, DIGITS)).otherwise(F.col("relevance"))}).drop("backlinks")
    return supersede(out, supersession_pairs(cards))
