"""Retrieval: dense, re-ranked, with keyword overlay, BM25."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import vectors as vx

OVERFETCH, OVERLAY_FETCH, OVERLAY_LEAST = 4, 3, 10
# Fixed constants of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25


def dense_search(vectors: DataFrame, query_vec: Column, k: int, id_col: str, vec_col: str, where: Column | None = None) -> DataFrame:
    return vx.top_k(vectors, query_vec, k, id_col, vec_col, where)


def rerank_search(vectors: DataFrame, query_vec: Column, k: int, id_col: str, vec_col: str, score: Column | None, where: Column | None = None) -> DataFrame:
    """``k`` of the nearest 4k by (rerank score, dense score); without a reranker the
    plain search."""
    if score is None:
        return dense_search(vectors, query_vec, k, id_col, vec_col, where)
    pool = vx.top_k(vectors, query_vec, OVERFETCH * k, id_col, vec_col, where)
    return pool.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), F.desc("score"), id_col).limit(k)


def overlap(query: str, title: Column) -> Column:
    """Share of the query's words in the title, and 1 more if it holds the whole query."""
    q = tx.query_tokens(F.lit(query))
    shared = F.size(F.array_intersect(q, tx.query_tokens(F.coalesce(title, F.lit("")))))
    whole = F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(query.lower().strip()))
    return F.when(F.size(q) > 0, shared / F.size(q)).otherwise(0.0) + F.when(whole & (F.lit(query.strip()) != ""), 1.0).otherwise(0.0)


def overlay(ranked: DataFrame, query: str, k: int, title_col: str, rank_col: str) -> DataFrame:
    """Ranked hits with those whose titles overlap the query first, by overlap; the dense
    order breaks ties and orders the rest."""
    o = F.round(overlap(query, F.col(title_col)), 6)
    return ranked.withColumn("overlap", o).orderBy(F.desc(F.col("overlap") > 0), F.desc("overlap"), rank_col).limit(k)


def keyword_search(vectors: DataFrame, query: str, query_vec: Column, k: int, id_col: str, vec_col: str, title_col: str) -> DataFrame:
    pool = vx.top_k(vectors, query_vec, max(OVERLAY_FETCH * k, OVERLAY_LEAST), id_col, vec_col)
    ranked = pool.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # at most max(3k, 10) rows
    return overlay(ranked, query, k, title_col, "dense_rank")


def bm25(docs: DataFrame, query_terms: Sequence[str], id_col: str, tokens: Column) -> DataFrame:
    """(id, score) of the documents that score above 0. Terms repeated in the query count
    again. Statistics cover all documents; only the query's terms are counted."""
    rows = docs.select(F.col(id_col).alias("id"), tokens.alias("t"))
    base = rows.select("id", F.size("t").alias("dl"), F.col("t"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # df of every term: idf below zero is replaced by a share of the mean idf of all terms
    df = base.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("raw").alias("mean"))
    wanted = docs.sparkSession.createDataFrame([(t,) for t in query_terms], "term string").groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    weights = (idf.join(F.broadcast(wanted), "term").crossJoin(F.broadcast(mean))
               .select("term", (F.col("times") * F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))).alias("w")))
    tf = (base.select("id", "dl", F.explode(F.filter("t", lambda x: x.isin(*query_terms))).alias("term")).groupBy("id", "dl", "term")
          .agg(F.count(F.lit(1)).alias("tf")))
    scored = tf.join(F.broadcast(weights), "term").crossJoin(F.broadcast(stats.select("avgdl")))
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0").withColumnRenamed("id", id_col)


def bm25_tables(docs: DataFrame, id_col: str, tokens: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, terms, stats) to keep: (term, id, tf, dl), (term, df) and one row (n, avgdl,
    mean_idf). A query then reads the postings of its own terms alone."""
    base = docs.select(F.col(id_col).alias("id"), tokens.alias("t")).withColumn("dl", F.size("t"))
    postings = base.select("id", "dl", F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    mean = terms.crossJoin(F.broadcast(stats)).agg(F.avg(F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("mean_idf"))
    return postings, terms, stats.crossJoin(mean)


def bm25_kept(postings: DataFrame, terms: DataFrame, stats: DataFrame, query: str, k: int, id_col: str = "id", digits: int = 6) -> DataFrame:
    """As ``bm25_top``, from kept tables."""
    wanted = [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) > 1]
    times = F.create_map(*[F.lit(x) for t in sorted(set(wanted)) for x in (t, wanted.count(t))]) if wanted else None
    if times is None:
        return postings.select(F.col("id").alias(id_col), F.lit(0.0).alias("score")).where("false")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weights = terms.where(F.col("term").isin(*wanted)).crossJoin(F.broadcast(stats)).select(
        "term", "avgdl", (times[F.col("term")] * F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw)).alias("w"))  # a row for each term of the query
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = postings.where(F.col("term").isin(*wanted)).join(F.broadcast(weights), "term").groupBy(F.col("id").alias(id_col)).agg(F.sum(part).alias("score")).where("score > 0")
    return scored.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), id_col).limit(k)


def bm25_top(docs: DataFrame, query: str, k: int, id_col: str = "doc_id", text_col: str = "text", digits: int = 6) -> DataFrame:
    terms = [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) > 1]
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    return bm25(docs, terms, id_col, tx.lexical_tokens(F.col(text_col))).withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), id_col).limit(k)


def with_community(hits: DataFrame, partition: DataFrame, communities: DataFrame, id_col: str) -> DataFrame:
    """Hits with community_id, path and label. Both tables meet the few hits."""
    bare = partition.select(F.regexp_replace(F.col("node_id").cast("string"), "^doc::", "").alias("__id"), "community_id", "path")
    hits = hits.withColumn("__id", F.regexp_replace(F.col(id_col).cast("string"), "^doc::", ""))
    return hits.join(bare, "__id", "left").join(communities.select("community_id", "label", "n_members"), "community_id", "left").drop("__id")


def hit_payload(hits: DataFrame, text_col: str = "text", size: int = 500) -> DataFrame:
    return hits.withColumn(text_col, F.substring(text_col, 1, size))


def community_search(centroid_table: DataFrame, communities: DataFrame, query_vec: Column, k: int) -> DataFrame:
    best = vx.top_k(centroid_table, query_vec, k, "community_id", "vec").select("community_id", "score")
    return best.join(communities.select("community_id", "label", "n_members"), "community_id", "left").orderBy(F.desc("score"), "community_id")
