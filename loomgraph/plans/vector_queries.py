"""Queries over embeddings: search, communities, pairs, bands, retrieval metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import retrieve as rt
from ..operators import vector_index as vi
from ..operators import vectors as vx
from ..stage import Stage
from .base import DOT, Registry, read

R = Registry()
PAIR_TAU, NEAR, BORDER = 0.30, 0.45, 0.35


def query_of(emb: DataFrame, vec_id: int):
    """The vector of one row as a literal: one row comes to the driver."""
    row = emb.where(F.col("vec_id") == vec_id).select("embedding").first()
    return vx.query_vector(row[0] if row else [0.0])


def _partition(emb: DataFrame) -> DataFrame:
    return emb.select(F.col("vec_id").alias("node_id"), F.col("label").alias("community_id"), F.array("label").alias("path"))


def _communities(emb: DataFrame) -> DataFrame:
    return emb.groupBy(F.col("label").alias("community_id")).agg(F.count(F.lit(1)).alias("n_members")).withColumn(
        "label", F.concat(F.lit("community "), F.col("community_id").cast("string")))


_Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = f"CASE WHEN {DOT('v', 'v')} = 0 OR {DOT('q', 'q')} = 0 THEN 0.0 ELSE {DOT('v', 'q')} / sqrt({DOT('v', 'v')} * {DOT('q', 'q')}) END"


@R.add(f"""SELECT vec_id, label, round({_COS}, 4) AS score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), {_Q0}
ORDER BY score DESC, vec_id LIMIT 5""")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return rt.dense_search(emb, query_of(emb, 0), 5, "vec_id", "embedding").select("vec_id", "label", "score")


@R.add(f"""SELECT vec_id, label, round({_COS}, 4) AS score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 3), {_Q0}
ORDER BY score DESC, vec_id LIMIT 5""")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return rt.dense_search(emb, query_of(emb, 0), 5, "vec_id", "embedding", F.col("label") == 3).select("vec_id", "label", "score")


@R.add(f"""WITH h AS (SELECT vec_id, label, round({_COS}, 4) AS score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), {_Q0}
ORDER BY score DESC, vec_id LIMIT 5), c AS (SELECT label, count(*) AS n_members FROM embeddings GROUP BY label)
SELECT vec_id, score, label AS community_id, 'community ' || label AS label, n_members FROM h JOIN c USING (label)""")
def search_with_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    hits = rt.dense_search(emb, query_of(emb, 0), 5, "vec_id", "embedding").select("vec_id", "score")
    return rt.with_community(hits, _partition(emb), _communities(emb), "vec_id").select("vec_id", "score", "community_id", "label", "n_members")


_CENTROIDS = """c AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)"""


@R.add(f"""WITH {_CENTROIDS} SELECT label AS community_id, pos - 1 AS pos, round(x, 6) AS x FROM c""")
def community_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = vx.centroids(read(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return table.select(F.col("label").alias("community_id"), F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6)).withColumn("pos", F.col("pos").cast("long"))


@R.add(f"""WITH {_CENTROIDS}, v AS (SELECT label, list(x ORDER BY pos) AS v FROM c GROUP BY label),
n AS (SELECT label, count(*) AS n_members FROM embeddings GROUP BY label)
SELECT label AS community_id, round({_COS}, 4) AS score, 'community ' || label AS label, n_members FROM v JOIN n USING (label), {_Q0} ORDER BY score DESC, community_id LIMIT 5""")
def community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    table = vx.centroids(emb, ["label"], "embedding").withColumnRenamed("label", "community_id")
    return rt.community_search(table, _communities(emb), query_of(emb, 0), 5)


_PAIRS = f"""p AS (SELECT a.vec_id AS a, b.vec_id AS b, {DOT('x', 'y')} / sqrt({DOT('x', 'x')} * {DOT('y', 'y')}) AS s
FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings) b ON a.vec_id <> b.vec_id)"""


@R.add(f"WITH {_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM p WHERE a < b AND s >= {PAIR_TAU}")
def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vx.similar_pairs(read(spark, sf_dir, "embeddings"), PAIR_TAU, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@R.add(f"""WITH {_PAIRS}, t AS (SELECT a AS vec_id, arg_max(b, round(s, 12) * 1e9 - b * 1e-6) AS neighbour, max(s) AS s FROM p GROUP BY a)
SELECT vec_id, neighbour, round(s, 6) AS similarity, CASE WHEN s >= {NEAR} THEN 'near_duplicate' WHEN s >= {BORDER} THEN 'borderline' ELSE 'unique' END AS outcome FROM t""")
def dedup_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return vx.classify_duplicates(emb, emb, "vec_id", "embedding", NEAR, BORDER).withColumn("similarity", F.round("similarity", 6))


@R.add(f"""WITH h AS (SELECT vec_id, label, round({_COS}, 4) AS score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), {_Q0}
ORDER BY score DESC, vec_id LIMIT 20) SELECT vec_id, score, (vec_id % 7)::DOUBLE AS rerank_score FROM h ORDER BY rerank_score DESC, score DESC, vec_id LIMIT 5""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return rt.rerank_search(emb, query_of(emb, 0), 5, "vec_id", "embedding", (F.col("vec_id") % 7).cast("double")).select("vec_id", "score", "rerank_score")


def _retrieved(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest others of each vector whose id is divisible by 100, ranked."""
    emb = read(spark, sf_dir, "embeddings")
    queries = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pairs = vx.top_k_joined(emb, queries, k + 1, "vec_id", "embedding").where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


_RETRIEVED = f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, label, round({_COS}, 4) AS score FROM q, (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s QUALIFY r <= 10)"""


@R.add(f"""WITH {_RETRIEVED}, g AS (SELECT query_id, max(CASE WHEN vec_id % 50 = query_id % 50 THEN 1.0 ELSE 0 END) AS c, coalesce(min(CASE WHEN vec_id % 50 = query_id % 50 THEN r END), 0) AS rc,
coalesce(min(CASE WHEN vec_id % 10 = (query_id / 10)::BIGINT % 10 THEN r END), 0) AS rd FROM r GROUP BY query_id)
SELECT count(*) AS n, round(avg((rc > 0)::INT::DOUBLE), 6) AS hit_at_k_chunk, round(avg((rd > 0)::INT::DOUBLE), 6) AS hit_at_k_doc,
round(avg(CASE WHEN rc > 0 THEN 1.0::DOUBLE / rc WHEN rd > 0 THEN 1.0::DOUBLE / rd ELSE 0 END), 6) AS mrr FROM g""")
def hit_rate_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _retrieved(spark, sf_dir, 10).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id"))).alias("x"))
    lists = rows.select(F.col("query_id") % 50, F.transform("x", lambda v: v["vec_id"] % 50).alias("chunks"), F.transform("x", lambda v: v["vec_id"] % 10).alias("docs"),
                        (F.col("query_id") % 50).alias("seed_chunk"), (F.floor(F.col("query_id") / 10) % 10).alias("seed_doc"))
    return ev.retrieval_metrics(lists, 10)


@R.add(f"""WITH {_RETRIEVED}, a AS (SELECT query_id, r AS b, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 7 DESC, r) AS a FROM r),
d AS (SELECT query_id, coalesce(min(CASE WHEN b <= 5 AND vec_id % 25 = query_id % 25 THEN b END), 6) AS b, coalesce(min(CASE WHEN a <= 5 AND vec_id % 25 = query_id % 25 THEN a END), 6) AS a FROM a GROUP BY query_id)
SELECT count(*) AS n, round(avg((b - a)::DOUBLE), 6) AS mean_delta, list_sort(list(b - a))[count(*) // 2 + 1] AS median_delta,
count(*) FILTER (b > 5 AND a <= 5) AS new_hits, count(*) FILTER (b <= 5 AND a > 5) AS lost_hits FROM d""")
def rerank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _retrieved(spark, sf_dir, 10).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("r", "vec_id"))).alias("x"), F.array_sort(F.collect_list(F.struct((-(F.col("vec_id") % 7)).alias("m"), F.col("r"), F.col("vec_id")))).alias("y"))
    lists = rows.select((F.col("query_id") % 25).alias("seed"), F.transform(F.slice("x", 1, 5), lambda v: v["vec_id"] % 25).alias("before"), F.transform(F.slice("y", 1, 5), lambda v: v["vec_id"] % 25).alias("after"))
    return ev.rerank_delta(lists, 5)


@R.add(f"""WITH {_RETRIEVED} SELECT query_id FROM r GROUP BY query_id HAVING count(*) FILTER (vec_id % 25 = query_id % 25) = 0""")
def retrieval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _retrieved(spark, sf_dir, 10).groupBy("query_id").agg(F.collect_list(F.col("vec_id") % 25).alias("chunks")).withColumn("seed_chunk", F.col("query_id") % 25)
    return ev.failures(rows.select("query_id"), rows, "query_id")


@R.add("SELECT label AS community_id, list_sort(list(vec_id))[1:5] AS representatives, count(*) AS n_members FROM embeddings GROUP BY label")
def community_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.community import members

    table = members(_partition(read(spark, sf_dir, "embeddings")))
    return table.select("community_id", F.slice("members", 1, 5).alias("representatives"), "n_members")


@R.add("""WITH z AS (SELECT list_sort(list(s)) AS z FROM (SELECT count(*) AS s FROM embeddings GROUP BY label)), t AS (SELECT z, len(z) AS n, list_sum(z) AS total FROM z)
SELECT n AS n_communities, len(list_filter(z, lambda x: x = 1)) AS n_singletons, z[n] AS biggest, z[1] AS smallest, round(total / n, 6) AS mean_size, z[n // 2 + 1] AS median_size,
z[n // 4 + 1] AS q1_size, z[3 * n // 4 + 1] AS q3_size, round(z[n] / total, 6) AS largest_fraction, round(len(list_filter(z, lambda x: x = 1)) / n, 6) AS singleton_fraction FROM t""")
def partition_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import partition_shape as shape

    return shape(_partition(read(spark, sf_dir, "embeddings")))


@R.add()
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.community import remap_to_previous

    emb = read(spark, sf_dir, "embeddings")
    new = emb.select(F.col("vec_id").cast("string").alias("node_id"), F.col("label").alias("community_id"))
    old = emb.select(F.col("vec_id").cast("string").alias("node_id"), (F.col("vec_id") % 10).cast("int").alias("community_id"))
    return remap_to_previous(new, old)


@R.add()
def kmeans_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.community import KMeansBackend

    emb = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), F.col("embedding").alias("vec"))
    return KMeansBackend().cluster(emb, emb.limit(0), emb).partition


@R.add("""SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS n_queries, count(*) AS n_indexed, true AS recall_reached FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0""")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in the approximate index, and whether the ten nearest of each hundredth vector that it
    finds are 0.9 at least of those that brute force finds."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = f"{Stage(spark, 'index').root}/index"
    vi.build(rows, path, id_col="vec_id", vec_col="embedding")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    found = vi.search_many(queries, path, 10, "q", "v", "vec_id", "embedding").select("q", F.col("vec_id").alias("id"), F.lit(1).alias("hit"))
    told = vi.nearest(queries, rows, 10, "vec_id", "embedding").join(found, ["q", "id"], "left")
    indexed = spark.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("n_indexed"))
    reached = told.agg((F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))  # a query without a vector has no neighbours
    return queries.agg(F.count(F.lit(1)).alias("n_queries")).crossJoin(indexed).crossJoin(reached)
