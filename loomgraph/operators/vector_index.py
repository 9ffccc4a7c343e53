"""An approximate index of vectors for nearest neighbours by cosine.

Unit vectors are dealt to coarse cells, and what a vector differs from its cell's centre is
coded by product quantisation: the centre nearest in each block of dimensions. Centres are
trained on a bounded sample; every vector is indexed. The table is stored by cell, so a
search reads the files of the cells nearest to its query alone, orders their rows by the
codes and settles the best of them by their exact cosine. Where the cells searched hold
fewer rows than were asked for, all cells are.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import tables as tb
from ..stage import Stage, bound_arrow
from . import vectors as vx

#: Rows that centres are trained on, cells and codes at most, dimensions of a block.
SAMPLE, CELLS, CODES, BLOCK_DIMS = 20_000, 1024, 64, 4
#: Distances held at once.
DISTANCES = 1 << 20
#: Cells that the first search tries, and rows settled by their exact cosine for each row asked for.
PROBES, DEPTH = 8, 20
#: The recall that an index is tuned to, at so many results and with so many of its own vectors as queries.
RECALL, RESULTS, TRIALS = 0.95, 10, 100
#: Rows of a chunk of a cell, and queries of a block, that meet in a tile.
CHUNK, QUERIES = 1024, 256


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of a bounded sample; one that loses its rows starts anew at the row farthest from its own."""
    k = max(1, min(k, len(rows)))
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own, d = _closest(rows, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        far = iter(np.argsort(-d))
        for empty in np.flatnonzero(n == 0):
            centres[empty] = rows[next(far)]
    return centres


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T


def _closest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a its closest row of b and their squared distance, a slice of DISTANCES at a time."""
    own, d = np.empty(len(a), np.int64), np.empty(len(a))
    step = max(1, DISTANCES // len(b))
    for i in range(0, len(a), step):
        part = _squares(a[i : i + step], b)
        own[i : i + step], d[i : i + step] = part.argmin(axis=1), part.min(axis=1)
    return own, d


@dataclass
class Model:
    """Centres of the cells (cells x dim), and for each block of dimensions the centres of its codes."""
    cells: np.ndarray
    codes: list[np.ndarray]
    probes_set: int = PROBES

    @property
    def dim(self) -> int:
        return self.cells.shape[1]

    def blocks(self) -> list[tuple[int, int]]:
        return [(i, min(i + BLOCK_DIMS, self.dim)) for i in range(0, self.dim, BLOCK_DIMS)]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _closest(rows, self.cells)[0]
        rest = rows - self.cells[cell]
        return cell, np.stack([_closest(rest[:, a:b], c)[0] for (a, b), c in zip(self.blocks(), self.codes, strict=True)], axis=1)

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The n cells with the largest cosine bound for each query: those whose centres are nearest."""
        return np.argsort(_squares(queries, self.cells), axis=1, kind="stable")[:, :n]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query its products with every code of every block, CODES a block."""
        out = np.zeros((len(queries), len(self.codes), CODES))
        for j, ((a, b), c) in enumerate(zip(self.blocks(), self.codes, strict=True)):
            out[:, j, : len(c)] = queries[:, a:b] @ c.T
        return out.reshape(len(queries), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def _fine(vec: Column) -> Column:
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)


def train(vectors: DataFrame, vec_col: str = "vec", sample: int = SAMPLE, cells: int | None = None) -> Model | None:
    """A model from at most ``sample`` vectors of the most frequent length, drawn by a hash; None without any."""
    good = vectors.where(_fine(F.col(vec_col))).select(vx.doubles(F.col(vec_col)).alias("vec"))
    dims = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return None
    drawn = good.where(F.size("vec") == dims["d"]).orderBy(F.xxhash64("vec")).limit(sample).toArrow()  # numbers, not Python objects
    rows = _unit(drawn.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims["d"]))
    centres = k_means(rows, cells or min(CELLS, math.ceil(dims["count"] ** 0.5)))
    rest = rows - centres[_closest(rows, centres)[0]]
    return Model(centres, [k_means(rest[:, i : i + BLOCK_DIMS], CODES) for i in range(0, dims["d"], BLOCK_DIMS)])


def build(vectors: DataFrame, path: str, model: Model | None = None, id_col: str = "chunk_id", vec_col: str = "vec") -> None:
    """Write the index of all vectors to ``path``: ``rows`` by cell, and the model. Null, zero and
    non-finite vectors and those of another length than the model's are left out, as they
    have no cosine with a query; other columns are kept for filters."""
    spark = vectors.sparkSession
    model = model or train(vectors, vec_col)
    if model is None:
        raise ValueError("no vector to index")
    table = [("cell", k, row.tolist()) for k, row in enumerate(model.cells)] + [(f"code-{j}", k, row.tolist()) for j, c in enumerate(model.codes) for k, row in enumerate(c)]
    kept = [c for c in vectors.columns if c not in ("cell", "codes", "unit")]
    good = vectors.where(_fine(F.col(vec_col)) & (F.size(vec_col) == model.dim)).select(*kept, vx.doubles(F.col(vec_col)).alias("unit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(-1, model.dim))
            cell, codes = model.encode(unit)
            at = batch.schema.get_field_index("unit")
            out = batch.set_column(at, "unit", pa.array(unit.astype(np.float32).tolist(), pa.list_(pa.float32())))
            yield out.append_column("codes", pa.array(codes.astype(np.int16).tolist(), pa.list_(pa.int16()))).append_column("cell", pa.array(cell.astype(np.int32)))

    kinds = {f.name: f.dataType.simpleString() for f in good.schema}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "unit array<float>, codes array<smallint>, cell int"])
    # dealt by cell, so that a cell is a few files; a large one is split over tasks by a hash
    rows = good.mapInArrow(run, ddl)
    rows.repartition("cell", F.pmod(F.xxhash64(id_col), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame(table, "part string, k int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    told = spark.createDataFrame([tune(spark, path, id_col, vec_col)], "probes int, recall double, trials long")
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """(q, id) of the k nearest by brute force: queries (q, v) against all rows, in tiles. What has no cosine is left out on either side."""
    asked = queries.where(_fine(F.col("v"))).select(F.col("q").alias("query_id"), F.col("v").alias("query_vec"))
    told = vx.top_k_joined(rows.where(_fine(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).alias("x")), asked, k, "id", "x")
    return told.select(F.col("query_id").alias("q"), "id")


def tune(spark: SparkSession, path: str, id_col: str, vec_col: str) -> tuple[int, float, int]:
    """(cells to search, recall, queries): the cells are doubled until a sample of the index finds RECALL of what brute force finds."""
    rows, cells = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/model").where("part = 'cell'").count()
    sample = rows.orderBy(F.xxhash64(id_col), id_col).limit(TRIALS).select(F.col(id_col).alias("q"), F.col(vec_col).alias("v"))
    stage = Stage(spark, "tune")
    queries, chunks = stage.write(sample, "queries"), stage.write(chunked(spark, path, id_col, vec_col), "chunks")
    want = {(r["q"], r["id"]) for r in nearest(queries, rows, RESULTS, id_col, vec_col).collect()}  # TRIALS x RESULTS at most
    probes = min(PROBES, cells)
    while True:
        got = search_many(queries, path, RESULTS, "q", "v", id_col, vec_col, probes=probes, chunks=chunks).select("q", id_col).collect()
        recall = len(want & {(r[0], r[1]) for r in got}) / max(1, len(want))
        if recall >= RECALL or probes >= cells:
            stage.drop("chunks")
            return probes, recall, len({q for q, _ in want})
        probes = min(cells, 2 * probes)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("part", "k").collect()
    of = lambda part: np.array([r["centre"] for r in rows if r["part"] == part])
    probes = spark.read.parquet(f"{path}/settings").first()["probes"] if tb.exists(spark, f"{path}/settings") else PROBES
    return Model(of("cell"), [of(f"code-{j}") for j in range(len({r["part"] for r in rows}) - 1)], probes)


def _estimate(codes: Column, table: Column, blocks: int) -> Column:
    out = F.lit(0.0)
    for j in range(blocks):
        out = out + F.element_at(table, F.element_at(codes, j + 1).cast("int") + (j * CODES + 1))
    return out


def search(spark: SparkSession, path: str, query: Sequence[float], k: int, id_col: str = "chunk_id", vec_col: str = "vec", where: Column | None = None,
           probes: int | None = None, depth: int = DEPTH) -> DataFrame:
    """The k rows nearest to a query, with ``score`` (4 digits), as ``vectors.top_k`` gives them; which
    rows are looked at is approximate, their scores are exact. Ties go to the smaller id."""
    model = load(spark, path)
    q = _unit(np.asarray(query, float)[None])
    if q.shape[1] != model.dim:
        raise ValueError(f"a query of {q.shape[1]} dimensions for an index of {model.dim}")
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows if where is None else rows.where(where)
    for n in (min(probes or model.probes_set, len(model.cells)), len(model.cells)):
        cells = model.probes(q, n)[0]
        near = rows if n == len(model.cells) else rows.where(F.col("cell").isin(*cells.tolist()))
        if n == len(model.cells) or near.limit(k).count() >= k:
            break
    centre = F.array(*(F.lit(float(x)) for x in (model.cells @ q[0])))
    table = F.array(*(F.lit(float(x)) for x in model.tables(q)[0]))
    told = near.withColumn("__about", F.element_at(centre, F.col("cell") + 1) + _estimate(F.col("codes"), table, len(model.codes)))
    best = told.orderBy(F.desc("__about"), id_col).limit(k * depth)
    score = F.round(vx.cosine(F.col(vec_col), vx.query_vector(query)), 4)
    return best.withColumn("score", score).drop("__about", "unit", "codes", "cell").orderBy(F.desc("score"), id_col).limit(k)


def chunked(spark: SparkSession, path: str, id_col: str = "chunk_id", vec_col: str = "vec") -> DataFrame:
    """(cell, ids, mat, codes): the rows of an index in chunks of about CHUNK rows of a cell, in order of their ids; ``mat`` their unit vectors."""
    rows = spark.read.parquet(f"{path}/rows").select(F.col(id_col).alias("id"), vx.doubles(F.col(vec_col)).alias("x"), "codes", "cell")
    kind = rows.schema["id"].dataType.simpleString()
    cuts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("cuts"))  # a row a cell

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        codes, mat = np.stack(pdf["codes"].to_numpy()).astype(np.int16), _unit(np.stack(pdf["x"].to_numpy()).astype(float))
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1].to_numpy(), "ids": [pdf["id"].tolist()], "mat": [mat.tobytes()], "codes": [codes.tobytes()]})

    dealt = rows.join(F.broadcast(cuts), "cell").withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")))
    return dealt.groupBy("cell", "cut").applyInPandas(pack, f"cell int, ids array<{kind}>, mat binary, codes binary")


def search_many(queries: DataFrame, path: str, k: int, query_id: str = "query_id", query_vec: str = "query", id_col: str = "chunk_id", vec_col: str = "vec",
                probes: int | None = None, depth: int = DEPTH, chunks: DataFrame | None = None) -> DataFrame:
    """(query, id, score, rank): the k rows nearest to each query. Queries that are null, zero, non-finite or of another
    length find nothing. Blocks of QUERIES queries meet ``chunks`` of cells, those of ``chunked``, in tiles: a tile orders the rows
    of a cell that some of its queries search by their codes, and what leaves it can be among a query's best. Tables of
    products are made where they are used, so neither they nor vectors are broadcast or shuffled."""
    spark = queries.sparkSession
    model, stage = load(spark, path), Stage(spark, "search")
    good = queries.where(_fine(F.col(query_vec)) & (F.size(query_vec) == model.dim)).select(F.col(query_id).alias("id"), F.col(query_vec).alias("v"))
    blocks = vx._packed(good, stage, "queries", max(1, -(-good.count() // QUERIES))).select("block", F.col("ids").alias("qs"), F.col("mat").alias("qmat"))
    if chunks is None:
        chunks = stage.write(chunked(spark, path, id_col, vec_col), "chunks")
    searched, most = min(probes or model.probes_set, len(model.cells)), k * depth
    shifts = np.arange(len(model.codes)) * CODES

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None  # the block at hand: its tiles follow each other
        for batch in batches:
            of = lambda name, r: batch.column(batch.schema.get_field_index(name))[r]  # noqa: B023, E731
            for r in range(batch.num_rows):
                if own != (block := of("block", r).as_py()):
                    own, v = block, np.frombuffer(of("qmat", r).as_buffer()).reshape(-1, model.dim)
                    tables, centre, best = model.tables(v), v @ model.cells.T, np.full((len(v), most), -np.inf)
                    hit = np.zeros((len(v), len(model.cells)), bool)
                    np.put_along_axis(hit, model.probes(v, searched), True, axis=1)
                cell = of("cell", r).as_py()
                some = np.flatnonzero(hit[:, cell])
                if not len(some):
                    continue
                q, ids = (of(name, r).values.to_numpy(zero_copy_only=False) for name in ("qs", "ids"))
                codes, x = np.frombuffer(of("codes", r).as_buffer(), np.int16).reshape(len(ids), -1) + shifts, np.frombuffer(of("mat", r).as_buffer()).reshape(len(ids), -1)
                about = centre[some, cell][:, None] + sum(tables[some[:, None], codes[None, :, j]] for j in range(codes.shape[1]))
                at = np.argsort(-about, axis=1, kind="stable")[:, :most]  # ties by id, as chunks are in order
                about = np.take_along_axis(about, at, axis=1)
                row, col = np.nonzero(about >= best[some, -1:])
                best[some] = -np.sort(-np.concatenate([best[some], about], axis=1), axis=1)[:, :most]
                found, one = at[row, col], some[row]
                yield pa.RecordBatch.from_arrays([pa.array(q[one]), pa.array(ids[found]), pa.array(about[row, col]), pa.array((v[one] * x[found]).sum(axis=1))], names=["q", "id", "about", "score"])

    kinds = f"q {queries.schema[query_id].dataType.simpleString()}, id {spark.read.parquet(f'{path}/rows').schema[id_col].dataType.simpleString()}, about double, score double"
    bound_arrow(spark)
    near = blocks.crossJoin(chunks.hint("shuffle_replicate_nl")).mapInArrow(settle, kinds)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("about"), "id"))).where(F.col("n") <= most)
    exact = near.select("q", "id", F.round("score", 4).alias("score"))
    out = exact.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")
