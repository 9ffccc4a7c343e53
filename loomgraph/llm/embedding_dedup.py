"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors cos >= t means a squared distance of at most 2 - 2t. After a fixed
rotation the dimensions are cut to blocks; the squared distance is the sum over the
blocks, so in one block at least it is within that block's share of it. Each block is
range-joined under its share: its first coordinates - as many as keep the cells small, by
the counted rows of the largest label - give a grid cell. A vector is at home in one cell
and visits those later in the order of the cells that its range touches, so a pair within
the share meets exactly once, in the later of its home cells. A pair is taken from the
first block whose share it keeps and is then verified by its cosine in double precision on
the values as given, so the union of the blocks needs no shuffle and lists no pair twice.

Vectors alike in every value are one class before the join. Cells with more rows than
``CELL_ROWS`` are cut to tiles by a hash, and every two tiles are a group of their own, so
no task gathers a hot cell. A group gives a count of links for each vector and a spanning
forest of its links, never all pairs.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, spanning
from .common import Stage, bound_arrow, id_kind

THRESHOLD = 0.98
BLOCK_DIMS = 8
CELL = 0.2
CELL_ROWS = 2000
SLACK = 1e-5
#: Coordinates of a cell at most, and cells that a coordinate may tell apart (from -1 to 1).
CELL_DIMS, CELL_BASE = 5, 64


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240229).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[tuple[int, int]]:
    return [(i, min(i + BLOCK_DIMS, dim)) for i in range(0, dim, BLOCK_DIMS)]


def _matrix(vec: pa.ListArray, dim: int) -> np.ndarray:
    return vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def cell_dims(rows: int, dim: int) -> int:
    """Coordinates that leave about CELL_ROWS of the rows of a label in a cell, if they lie as
    on a sphere; any number gives the same links."""
    k, spread = 2, max(1.5, 3.5 / max(dim, 1) ** 0.5 / CELL)
    while k < CELL_DIMS and rows / spread**k > CELL_ROWS:
        k += 1
    return k


def _cells(turned: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, home) of points: their home cell, and the later cells they touch."""
    scale = CELL_BASE ** np.arange(turned.shape[1], dtype=np.int64)
    low, high, own = (np.floor((turned + d) / CELL).astype(np.int64) + CELL_BASE // 2 for d in (-reach, reach, 0))
    home = own @ scale
    out = [(np.arange(len(turned)), home, True)]
    for step in np.ndindex(*(int(n) + 1 for n in (high - low).max(axis=0, initial=0))):
        at = low + step
        cell = at @ scale
        rows = np.flatnonzero((at <= high).all(axis=1) & (cell > home))
        out.append((rows, cell[rows], False))
    return out


def _placed(reps: DataFrame, threshold: float, coordinates: int, cells_only: bool = False) -> DataFrame:
    """(label, dim, block, cell, home, rep, size, vec): a row for each block's home cell
    and each cell visited; with ``cells_only`` no rep, size and vec."""
    kept = ["label"] if cells_only else ["label", "rep", "size", "vec"]
    kinds = {f.name: f.dataType.simpleString() for f in reps.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                turned = _unit(_matrix(part.column("vec"), dim)) @ rotation(dim)
                for b, (lo, hi) in enumerate(blocks_of(dim)):
                    reach = ((2 - 2 * threshold) * (hi - lo) / dim) ** 0.5 + SLACK
                    for rows, cells, home in _cells(turned[:, lo : min(hi, lo + coordinates)], reach):
                        if len(rows):
                            own = part.select(kept).take(pa.array(rows))
                            yield pa.RecordBatch.from_arrays(
                                [own.column(0), pa.array(np.full(len(rows), dim), pa.int32()), pa.array(np.full(len(rows), b), pa.int32()), pa.array(cells, pa.int64()), pa.array(np.full(len(rows), home)),
                                 *own.columns[1:]], names=["label", "dim", "block", "cell", "home", *kept[1:]])
    return reps.select("label", "rep", "size", "vec").mapInArrow(run, ", ".join([f"label {kinds['label']}, dim int, block int, cell long, home boolean", *(f"{c} {kinds[c]}" for c in kept[1:])]))


def _group(threshold: float):
    """Links of a tile: (0, id, null, links) for each id, and (1, id, id, null) for the forest."""
    def run(table: pa.Table) -> pa.Table:
        rep, none = table.column("rep"), lambda n, kind: pa.nulls(n, kind)
        made = lambda k, a, b, n: pa.table({"kind": pa.array([k] * len(a), pa.int32()), "a": a, "b": b, "n": n})
        empty = made(0, none(0, rep.type), none(0, rep.type), none(0, pa.int64()))
        dim, block, i, j = (table.column(c)[0].as_py() for c in ("dim", "block", "i", "j"))
        left = table.column("left").to_numpy()
        order = np.argsort(~left, kind="stable")  # those of the left side first
        n_left, table = int(left.sum()), table.take(pa.array(order))
        skip = 0 if i == j else n_left  # a tile of the diagonal compares its left side with itself too
        if not n_left or len(order) - skip < 2 - (i != j):
            return empty
        turn, blocks = rotation(dim), blocks_of(dim)
        x = _unit(_matrix(table.column("vec").combine_chunks(), dim))
        turned, rep = x @ turn, table.column("rep").combine_chunks()
        lo, hi = blocks[block]
        share = lambda k: (2 - 2 * threshold) * (blocks[k][1] - blocks[k][0]) / dim + 1e-9
        part, found = turned[:, lo:hi], []
        square = (part**2).sum(axis=1)
        for at in range(0, n_left, 512):
            to = min(at + 512, n_left)
            begin = max(skip, at + 1) if i == j else skip
            d = square[at:to, None] + square[None, begin:] - 2 * part[at:to] @ part[begin:].T
            p, q = np.nonzero(d <= share(block) + 1e-9)
            p, q = p + at, q + begin
            later = (q >= n_left) | (q > p)
            found.append((p[later], q[later]))
        p, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(p), 20_000):
            a, b = p[at : at + 20_000], q[at : at + 20_000]
            first = np.ones(len(a), bool)
            for k in range(block):  # an earlier block that the pair keeps has it already
                s, e = blocks[k]
                first &= ((turned[a, s:e] - turned[b, s:e]) ** 2).sum(axis=1) > share(k)
            a, b = a[first], b[first]
            near = (x[a] * x[b]).sum(axis=1) >= threshold
            links.append((a[near], b[near]))
        p, q = (np.concatenate([f[k] for f in links]) for k in (0, 1)) if links else (np.zeros(0, int), np.zeros(0, int))
        if not len(p):
            return empty
        size = table.column("size").to_numpy()
        others = np.bincount(p, size[q], len(x)) + np.bincount(q, size[p], len(x))
        linked, forest = np.flatnonzero(others), spanning(p.tolist(), q.tolist())
        at = lambda rows: rep.take(pa.array(rows))
        return pa.concat_tables([made(0, at(linked), none(len(linked), rep.type), pa.array(others[linked].astype(np.int64))),
                                 made(1, at(p[forest]), at(q[forest]), none(len(forest), pa.int64()))])
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors link only within a label. Null, empty and zero vectors, those with null or
    non-finite values and those without a label link with nothing and are their own
    component; so are rows without an id (component_id is null). Vectors of different lengths never link. Ids are whole numbers or
    strings, and expected to be distinct; rows that share one get the same component. A cosine is
    rounded as the values' order of summation gives it; at the threshold itself that decides.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    stage = Stage(spark, "near-vectors")
    kind = id_kind(vectors, id_col)
    base = vectors.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    fine = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("vec", lambda x: x != 0))
    key = F.when(fine, F.sha2(F.concat_ws(",", F.transform("vec", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))), 256))
    keyed = stage.write(base.select("id", "label", key.alias("key"), F.when(fine, F.col("vec")).alias("vec")), "keyed")
    # classes of equal vectors; the vector of a class is that of its smallest id
    classes = (keyed.where("key is not null").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    classes = stage.write(classes, "classes")
    reps = (classes.alias("c").join(keyed.alias("k"), (F.col("c.rep") == F.col("k.id")) & (F.col("c.key") == F.col("k.key")) & (F.col("c.label") == F.col("k.label")))
            .select(F.col("k.label").alias("label"), "rep", "size", "vec").dropDuplicates(["rep", "label"]))
    reps = stage.write(reps, "reps")
    cell = ["label", "dim", "block", "cell"]
    largest = reps.groupBy("label", F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "dim"))).first()[0]
    coordinates = cell_dims(largest["n"], largest["dim"]) if largest else 2
    # a cell with one row, or with visitors alone, has no pair
    sizes = _placed(reps, threshold, coordinates, True).groupBy(*cell).agg(F.sum(F.col("home").cast("int")).alias("homes"), F.sum((~F.col("home")).cast("int")).alias("visits")).where(
        "homes > 0 and homes + visits > 1").select(*cell, F.ceil(F.col("homes") / CELL_ROWS).cast("int").alias("th"), F.greatest(F.lit(1), F.ceil(F.col("visits") / CELL_ROWS)).cast("int").alias("tv"))
    # tile (i, j): homes of part i beside homes of a later part j and visitors of part j
    mix = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    last = F.greatest("th", "tv") - 1
    as_left = F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(mix(F.col("th")).alias("i"), j.alias("j"), F.lit(True).alias("left")))
    as_right = F.transform(F.sequence(F.lit(0), mix(F.col("th"))), lambda i: F.struct(i.alias("i"), mix(F.col("th")).alias("j"), F.lit(False).alias("left")))
    visiting = F.transform(F.sequence(F.lit(0), F.col("th") - 1), lambda i: F.struct(i.alias("i"), mix(F.col("tv")).alias("j"), F.lit(False).alias("left")))
    tiles = _placed(reps, threshold, coordinates).join(sizes, cell)
    tiles = tiles.withColumn("pair", F.explode(F.when(F.col("home"), F.concat(as_left, F.filter(as_right, lambda x: x["i"] < x["j"]))).otherwise(visiting)))
    tiles = tiles.select(*cell, "rep", "size", "vec", "pair.i", "pair.j", "pair.left")
    found = stage.write(tiles.groupBy(*cell, "i", "j").applyInArrow(_group(threshold), f"kind int, a {kind}, b {kind}, n long"), "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comps = stage.write(components(found.where("kind = 1").select("a", "b"), stage), "components")
    stage.drop("reps")
    of_class = (classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
                .select(F.col("label").alias("cl"), F.col("key").alias("ck"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    out = keyed.join(of_class, (keyed["label"] == of_class["cl"]) & (keyed["key"] == of_class["ck"]), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"))
