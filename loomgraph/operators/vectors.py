"""Cosine scores, nearest neighbours, similar pairs, centroids."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stage, bound_arrow

BLOCK = 1024
TAU = 0.55
NEAR, BORDER, PROMOTE = 0.95, 0.80, 0.85


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where either vector is zero."""
    a, b = doubles(a), doubles(b)
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def query_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def usable(v: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, query: Column, k: int, id_col: str, vec_col: str, where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to a query vector, with ``score`` (4 digits). ``where`` filters
    before anything is scored; ties go to the smaller id."""
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("score", F.round(cosine(F.col(vec_col), query), 4)).orderBy(F.desc("score"), id_col).limit(k)


def _unit(values: pd.Series) -> np.ndarray:
    v = np.stack(values.to_numpy()).astype(float)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size == 0, np.inf, size)


def _packed(rows: DataFrame, stage: Stage, name: str, n_blocks: int | None = None) -> DataFrame:
    """(d, block, ids, mat) of (id, v) rows: blocks of about BLOCK usable vectors of d dimensions in order of their ids, ``mat``
    their unit vectors. Each vector is shuffled and written once."""
    n = n_blocks or max(1, -(-rows.count() // BLOCK))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"d": pdf["d"].iloc[:1].to_numpy(), "block": pdf["block"].iloc[:1].to_numpy(), "ids": [pdf["id"].tolist()], "mat": [_unit(pdf["v"]).tobytes()]})

    good = rows.where(usable(F.col("v"))).select("id", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    return stage.write(good.groupBy("d", "block").applyInPandas(pack, f"d int, block int, ids array<{kind}>, mat binary"), name)


def _tiles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(d, i, a, x, e, j, b, y): every block of the left beside every block of the right of its dimensions. A product of the
    stored blocks, so nothing is shuffled: the condition is none that a join would hash."""
    bound_arrow(left.sparkSession)
    return left.toDF("d", "i", "a", "x").crossJoin(right.toDF("e", "j", "b", "y")).where("d - e = 0")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, np.ndarray, np.ndarray, np.ndarray]]:
    """((d, i), j, a, b, cosines) of the tiles."""
    for batch in batches:
        for r in range(batch.num_rows):
            d, i, j = (batch.column(c)[r].as_py() for c in ("d", "i", "j"))
            x, y = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(-1, d) for c in ("x", "y"))
            a, b = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("a", "b"))
            yield (d, i), j, a, b, x @ y.T


def top_k_joined(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, query_col: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """(query, id, score, rank): the ``k`` nearest rows of each query of a table of queries.

    Queries and rows meet in tiles, one matrix product each, and a tile keeps ``k`` rows a
    query; neither side is broadcast. Vectors that are null, empty or hold null or non-finite components
    have no neighbours, and only vectors of equal lengths meet."""
    stage = Stage(vectors.sparkSession, "nearest")
    left = _packed(queries.select(F.col(query_col).alias("id"), F.col(query_vec).alias("v")), stage, "queries")
    right = _packed(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), stage, "rows")
    kinds = f"q {queries.schema[query_col].dataType.simpleString()}, id {vectors.schema[id_col].dataType.simpleString()}, score double"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, a, b, sims in _met(batches):
            best = np.argsort(-np.round(sims, 4), axis=1, kind="stable")[:, :k]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, best.shape[1])), pa.array(b[best.ravel()]), pa.array(np.take_along_axis(sims, best, axis=1).ravel())], names=["q", "id", "score"])

    found = _tiles(left, right).mapInArrow(nearest, kinds).withColumn("score", F.round("score", 4))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score", "rank")


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str, vec_col: str, n_blocks: int | None = None) -> DataFrame:
    """(a, b, similarity) with a < b and cosine of ``threshold`` or more.

    Vectors are hashed to blocks of about a thousand; each two blocks meet in one row and
    are compared by one matrix product, so a task holds few blocks whatever the table's
    size. Only pairs over the threshold leave it. Vectors that are null, empty or hold null or non-finite
    components are in no pair, and only vectors of equal lengths meet."""
    blocks = _packed(vectors.select(F.col(id_col).alias("id"), doubles(F.col(vec_col)).alias("v")), Stage(vectors.sparkSession, "pairs"), "blocks", n_blocks)
    kind = vectors.schema[id_col].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i), j, left, right, sims in _met(batches):
            r, c = np.nonzero(sims >= threshold)
            a, b, s = left[r], right[c], sims[r, c]
            keep = a < b if i == j else a != b
            a, b, s = a[keep], b[keep], s[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b)), pa.array(np.where(a < b, b, a)), pa.array(s)], names=["a", "b", "similarity"])

    return _tiles(blocks, blocks).where("i <= j").mapInArrow(compare, f"a {kind}, b {kind}, similarity double")


def band(score: Column, near: float = NEAR, border: float = BORDER) -> Column:
    return F.when(score >= near, F.lit("near_duplicate")).when(score >= border, F.lit("borderline")).otherwise(F.lit("unique"))


def classify_duplicates(candidates: DataFrame, existing: DataFrame, id_col: str, vec_col: str, near: float = NEAR, border: float = BORDER,
                        rerank: Column | None = None, promote: float = PROMOTE) -> DataFrame:
    """(id, neighbour, similarity, outcome): each candidate's nearest other vector - of equals
    the one with the smallest id, whatever the ids' type - and its band. A vector that is null, empty, or holds null or non-finite
    components, and one that meets none of its length, is unique. ``rerank``, a score over (id, neighbour) columns, lifts borderline ones."""
    stage = Stage(candidates.sparkSession, "duplicates")
    left = candidates.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    blocks = _packed(left, stage, "candidates")
    others = blocks if existing is candidates else _packed(existing.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), stage, "existing")
    kinds = f"id {candidates.schema[id_col].dataType.simpleString()}, neighbour {existing.schema[id_col].dataType.simpleString()}, similarity double"

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            some = best > -np.inf
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(near[some]), pa.array(best[some])], names=["id", "neighbour", "similarity"])

        own = ids = near = best = None  # the block at hand: its tiles follow each other
        for key, _, a, b, sims in _met(batches):
            sims = np.round(sims, 12)
            sims[a[:, None] == b[None]] = -np.inf
            at = sims.argmax(axis=1)  # of equals the smallest id, as blocks are in order
            s, n = sims[np.arange(len(a)), at], b[at]
            if key != own:
                if own is not None:
                    yield told()
                own, ids, near, best = key, a, n, s
            else:
                better = (s > best) | ((s == best) & (n < near))
                near, best = np.where(better, n, near), np.where(better, s, best)
        if own is not None:
            yield told()

    best = _tiles(blocks, others).mapInArrow(nearest, kinds)
    best = best.groupBy("id").agg(F.min_by(F.struct("neighbour", "similarity"), F.struct((-F.col("similarity")).alias("s"), "neighbour")).alias("t")).select("id", "t.neighbour", "t.similarity")
    out = best.withColumn("outcome", band(F.col("similarity"), near, border))
    if rerank is not None:
        out = out.withColumn("outcome", F.when((F.col("outcome") == "borderline") & (rerank >= promote), F.lit("near_duplicate")).otherwise(F.col("outcome")))
    return left.select("id").join(out, "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("unique"))).withColumnRenamed("id", id_col)


def centroids(vectors: DataFrame, group_cols: list[str], vec_col: str, out_col: str = "vec") -> DataFrame:
    """The mean vector of each group: averages by position, with partial sums."""
    parts = vectors.select(*group_cols, F.posexplode(doubles(F.col(vec_col))).alias("pos", "x")).groupBy(*group_cols, "pos").agg(F.avg("x").alias("x"))
    rows = parts.groupBy(*group_cols).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return rows.select(*group_cols, F.transform("p", lambda e: e["x"]).alias(out_col))


def community_centroids(chunk_vectors: DataFrame, partition: DataFrame, doc_col: str = "doc_id", vec_col: str = "vec") -> DataFrame:
    """Mean of the documents' mean vectors for each community; ids meet without prefix."""
    docs = centroids(chunk_vectors, [doc_col], vec_col, "vec")
    bare = partition.select(F.regexp_replace("node_id", "^doc::", "").alias(doc_col), "community_id")
    return centroids(docs.join(bare, doc_col), ["community_id"], "vec", "vec")


def hashing_embedder(dim: int = 64):
    """A deterministic unit-norm stand-in for an embedding model: signed word hashing."""
    def encode(texts: pd.Series) -> pd.Series:
        import zlib

        def one(t: str | None) -> np.ndarray:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h >> 31 else -1
            size = np.linalg.norm(v)
            return (v / size if size else v).astype(np.float32)

        return texts.map(one)

    encode.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(encode, "array<float>")


# --- the vector table -----------------------------------------------------------------------

def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The table with rows of the same key replaced."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete_documents(existing: DataFrame, doc_ids: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    return existing.join(doc_ids.select(doc_col).distinct(), doc_col, "left_anti")


def not_embedded(docs: DataFrame, chunk_vectors: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    return docs.join(chunk_vectors.select(doc_col).distinct(), doc_col, "left_anti")
