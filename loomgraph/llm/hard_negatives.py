"""Hard-negative mining by a Voronoi-partition kNN join.

A row's score for an anchor is their inner product. With M the largest norm, a row x becomes
(x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0); then

    score = (|q|^2 + M^2 - d^2) / 2

for their distance d, so the best scores are the nearest neighbours. Rows are dealt to the
cells of a bounded sample of pivots, and within a cell to bands by their distance from the
pivot. Anchors of near cells make a group. A band is replicated to a group only if it
might serve one of its anchors: the distance of anchor and pivot with the band's least and
largest distance, and the distance to the hyperplane between the anchor's own pivot and
the band's, bound every score in the band, and these bounds are held against what the anchor
still needs. A group and some blocks of rows then meet in one task, which computes the
exact scores as matrix products.

Each search visits the group's own cells first; their k-th best score is what the other cells
have to reach. Positives are found so, and then the negatives for each positive's score,
whose band of scores bounds the cells from both sides.

Rows alike in label and vector are one class with its smallest ids, as many as a list may
take, since ties go by id. No list depends on the number of pivots, bands or groups.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, bound_arrow, id_kind

#: The scale of components, and positives and negatives of a list.
SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Percentages of the positive's score between which a negative's lies.
LOW, HIGH = 30, 90

#: Pivots at most; rows of a block, anchors of a group, blocks that meet a group in one task.
PIVOTS, BLOCK, GROUP, AT_ONCE = 2048, 2048, 256, 8
BANDS = 4
#: Scores beyond this count as this, so that a hundred times a score is a long.
LARGEST = 1 << 56


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    if a.size and b.size and a.shape[1] * np.abs(a).max() * np.abs(b).max() >= 2.0**53:
        ints = lambda m: [[int(x) for x in row] for row in m]
        right = ints(b)
        return np.array([[max(-LARGEST, min(LARGEST, sum(x * y for x, y in zip(p, q, strict=True)))) for q in right] for p in ints(a)], np.int64)
    return (a @ b.T).astype(np.int64)


def best(s: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest of s[among], and of ties the first ones."""
    if len(among) > k:
        values = s[among]
        least = np.partition(values, len(values) - k)[len(values) - k]
        above = among[values > least]
        among = np.concatenate([above, among[values == least][: k - len(above)]])
    return among


class Pivots:
    """The pivots of one vector length, with the augmented space they stand in."""

    def __init__(self, rows: np.ndarray, largest: float) -> None:
        self.square = largest
        self.at = self.raised(rows)

    def raised(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([rows, np.sqrt(np.maximum(self.square - (rows**2).sum(axis=1), 0))[:, None]])

    def distances(self, points: np.ndarray) -> np.ndarray:
        d = (points**2).sum(axis=1)[:, None] + (self.at**2).sum(axis=1)[None] - 2 * points @ self.at.T
        return np.sqrt(np.maximum(d, 0))

    def reach(self, anchors: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each anchor may have in each band (cell, low, high)."""
        points = np.hstack([anchors, np.zeros((len(anchors), 1))])
        to = self.distances(points)
        own = to.argmin(axis=1)
        square = (points**2).sum(axis=1)[:, None] + self.square
        d = to[:, cells]
        between = self.distances(self.at[own])[:, cells]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (d**2 - (to.min(axis=1)[:, None]) ** 2) / (2 * between), 0)
        near = np.maximum.reduce([d - high, low - d, plane, np.zeros_like(d)])
        slack = 1e-9 * (square + 1) + 1e-6
        return (square - (d + high) ** 2) / 2 - slack, (square - near**2) / 2 + slack


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _place(pivots: Pivots, dim: int, anchors: bool):
    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column("vec"), dim)
            d = pivots.distances(np.hstack([rows, np.zeros((len(rows), 1))]) if anchors else pivots.raised(rows))
            cell = d.argmin(axis=1) if len(rows) else np.zeros(0, int)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("rho", pa.array(d[np.arange(len(rows)), cell]))
    return run


def _pack(table: pa.Table) -> pa.Table:
    """A block of rows as one row, by their first ids."""
    first = [x[0] for x in table.column("ids").to_pylist()]
    table = table.take(pa.array(sorted(range(len(first)), key=first.__getitem__), pa.int64()))
    one = lambda c: pa.array([table.column(c).combine_chunks().to_pylist()], pa.list_(table.schema.field(c).type))
    vec = table.column("vec").combine_chunks().flatten()
    head = table.select(["cell", "band", "salt"]).slice(0, 1)
    return head.append_column("labels", one("label")).append_column("ids", one("ids")).append_column("vecs", pa.ListArray.from_arrays(pa.array([0, len(vec)], pa.int32()), vec))


def _route(pivots: Pivots, dim: int, bands: np.ndarray, own: bool):
    """The bands (cell, band) that a group's anchors need: those of their own cells, or of the others all that may serve."""
    cells, low, high = bands[:, 0].astype(int), bands[:, 2], bands[:, 3]

    def run(table: pa.Table) -> pa.Table:
        mine = np.isin(cells, table.column("cell").to_numpy())
        if own:
            need = mine
        else:
            least, most = pivots.reach(_matrix(table.column("vec"), dim), cells, low, high)
            need = np.zeros(len(cells), bool)
            for k, wants in enumerate(table.column("wants").to_pylist()):
                for w in wants:
                    need |= (most[k] >= w["low"]) & (least[k] <= w["high"])
            need &= ~mine
        rows = np.flatnonzero(need)
        group = table.column("group")[0].as_py()
        return pa.table({"group": pa.array([group] * len(rows), pa.int64()), "cell": pa.array(cells[rows], pa.int32()), "band": pa.array(bands[rows, 1].astype(np.int32))})
    return run


def _meet(dim: int, same: bool, k: int, low: int, high: int, kinds: pa.Schema):
    """The best k rows of some blocks for each want of a group's anchors."""
    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in kinds.names}
        labels = [x for row in blocks.column("labels").to_pylist() for x in row]
        ids = [x for row in blocks.column("ids").to_pylist() for x in row]
        if not ids or not anchors.num_rows:
            return pa.table(out, kinds)
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])
        ids = [ids[i] for i in order]
        found = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        label = np.array([found[labels[i]] for i in order])
        rows = np.vstack([np.asarray(v.as_py(), np.float64).reshape(-1, dim) for v in blocks.column("vecs")])[order]
        s = scores(_matrix(anchors.column("vec"), dim), rows)
        for i, (a, own, wants) in enumerate(zip(anchors.column("a").to_pylist(), anchors.column("label").to_pylist(), anchors.column("wants").to_pylist(), strict=True)):
            fits = (label == found.get(own, -1)) == same
            for w in wants:
                among = np.flatnonzero(fits & (s[i] >= w["low"]) & (s[i] <= w["high"]))
                if not same:
                    p = w["of"]
                    among = among[(low * p <= 100 * s[i][among]) & (100 * s[i][among] <= high * p)]
                for j in best(s[i], among, k):
                    for values, x in zip(out.values(), (a, w["of"], int(s[i][j]), ids[j]), strict=True):
                        values.append(x)
        return pa.table(out, kinds)
    return run


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as doubles that hold whole numbers."""
    def one(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    return F.transform(vec, one)


class _Join:
    """The join of one vector length: rows dealt to blocks, anchors to groups, and searches between them."""

    def __init__(self, stage: Stage, classes: DataFrame, anchors: DataFrame, dim: int, count: int, square: float, ratios: tuple[int, int]) -> None:
        self.stage, self.dim, self.n, self.ratios = stage, dim, 0, ratios
        sample = classes.orderBy(F.xxhash64("vec"), "vec").limit(min(PIVOTS, math.ceil(count**0.5))).select("vec").collect()
        self.pivots = Pivots(np.array([r["vec"] for r in sample]), square)
        kinds = {f.name: f.dataType.simpleString() for f in (*classes.schema, *anchors.schema)}
        self.kinds, self.id_kind = kinds, kinds["ids"][6:-1]
        placed = lambda df, names, of_anchors: stage.write(
            df.select(*names).mapInArrow(_place(self.pivots, dim, of_anchors), ", ".join([*(f"{c} {kinds[c]}" for c in names), "cell int, rho double"])), f"placed-{of_anchors}-{dim}")
        rows, own = placed(classes, ["label", "ids", "vec"], False), placed(anchors, ["a", "label", "vec"], True)
        # bands by quarters of the distances in a cell, salted so that no block grows with its cell
        cut = [k / BANDS for k in range(1, BANDS)]
        cells = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("rho", cut).alias("cuts")).collect()}
        size = max(len(sample), 1)
        cuts = F.array(*(F.array(*(F.lit(float(x)) for x in (cells[c]["cuts"] if c in cells else cut))) for c in range(size)))
        salts = F.array(*(F.lit(math.ceil(cells[c]["n"] / BLOCK) if c in cells else 1) for c in range(size)))
        band = sum(((F.col("rho") > cuts[F.col("cell")][k]).cast("int") for k in range(BANDS - 1)), F.lit(0))
        rows = rows.withColumn("band", band).withColumn("salt", F.pmod(F.xxhash64("vec", "label"), salts[F.col("cell")]).cast("int"))
        told = rows.groupBy("cell", "band").agg(F.min("rho").alias("low"), F.max("rho").alias("high")).collect()
        self.bands = np.array([(r["cell"], r["band"], r["low"], r["high"]) for r in told], np.float64).reshape(-1, 4)
        self.blocks = stage.write(rows.select("cell", "band", "salt", "label", "ids", "vec").groupBy("cell", "band", "salt").applyInArrow(
            _pack, f"cell int, band int, salt int, labels array<{kinds['label']}>, ids array<{kinds['ids']}>, vecs array<double>"), f"blocks-{dim}")
        # near cells' anchors make a group: each pivot follows the nearest of the first few
        many = {r["cell"]: r["count"] for r in own.groupBy("cell").count().collect()}
        centres = max(1, min(size, math.ceil(sum(many.values()) / GROUP)))
        group_of = self.pivots.distances(self.pivots.at)[:, :centres].argmin(axis=1).tolist() if len(sample) else [0]
        weight = [0] * centres
        for c, n in many.items():
            weight[group_of[c]] += n
        salted = F.array(*(F.lit(math.ceil(n / GROUP) or 1) for n in weight))[F.col("group")]
        own = own.withColumn("group", F.array(*map(F.lit, group_of))[F.col("cell")])
        self.anchors = stage.write(own.withColumn("group", (F.pmod(F.xxhash64("a"), salted) * size + F.col("group")).cast("long")).select("a", "group", "cell", "label", "vec"), f"anchors-{dim}")

    def search(self, wants: DataFrame, same: bool, k: int) -> DataFrame:
        """(a, of, score, id): the best k for each want (a, of, low, high) of the anchors, among rows of the same label or of others."""
        most = Window.partitionBy("a", "of").orderBy(F.desc("score"), "id")
        top = lambda df: df.withColumn("place", F.row_number().over(most)).where(F.col("place") <= k).drop("place")
        first = self._visit(wants, same, k, own=True)
        reached = first.groupBy("a", "of").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("a", "of", F.col("s")[k - 1].alias("least"))
        left = wants.join(reached, ["a", "of"], "left").select("a", "of", F.greatest("low", F.coalesce("least", "low")).alias("low"), "high")
        return self._write(top(first.unionByName(self._visit(left, same, k, own=False))))

    def _write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return self.stage.write(df, f"found-{self.dim}-{self.n}")

    def _visit(self, wants: DataFrame, same: bool, k: int, own: bool) -> DataFrame:
        listed = wants.groupBy("a").agg(F.collect_list(F.struct("of", "low", "high")).alias("wants"))
        state = self._write(self.anchors.join(listed, "a").select("group", "a", "label", "cell", "vec", "wants"))
        pairs = state.groupBy("group").applyInArrow(_route(self.pivots, self.dim, self.bands, own), "group long, cell int, band int")
        keys = pairs.join(self.blocks.select("cell", "band", "salt"), ["cell", "band"])
        keys = self._write(keys.withColumn("turn", F.floor((F.row_number().over(Window.partitionBy("group").orderBy("cell", "band", "salt")) - 1) / AT_ONCE)))
        met = keys.join(self.blocks, ["cell", "band", "salt"]).select(F.col("group").alias("g"), F.col("turn").alias("t"), "labels", "ids", "vecs")
        here = state.join(keys.select("group", F.col("turn").alias("at")).distinct(), "group").select(F.col("group").alias("of_group"), "at", "a", "label", "vec", "wants")
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        ddl = f"a string, of long, score long, ids {self.kinds['ids']}"
        kinds = to_arrow_schema(_parse_datatype_string(ddl))
        found = here.groupBy("of_group", "at").cogroup(met.groupBy("g", "t")).applyInArrow(_meet(self.dim, same, k, *self.ratios, kinds), ddl)
        found = found.select("a", "of", "score", F.explode("ids").alias("id"))
        most = Window.partitionBy("a", "of").orderBy(F.desc("score"), "id")
        return self._write(found.withColumn("place", F.row_number().over(most)).where(F.col("place") <= k).drop("place"))


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of
    ``vectors`` for which ``anchor`` holds.

    An anchor's positives are its best ``positives`` other rows of the same label, and each
    positive's negatives the best ``negatives`` rows of other labels whose score is ``low`` to
    ``high`` per cent of the positive's. Ties go to the smaller id; an anchor without a positive and a
    positive without a negative give no row. Rows without id or label and vectors that are
    null, empty or hold null or non-finite components take no part; vectors meet only those of
    their own length (at most 64 lengths, else an error). Rows alike in id, label and vector
    count once; rows that share an id with other values are rows of their own, but never
    positives of each other. Scores beyond 2^56 count as 2^56.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    stage = Stage(spark, "hard-negatives")
    kind = id_kind(vectors, id_col)
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = vectors.select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    base = stage.write(base.where(fine).withColumn("vec", quantised(F.col("vec"), scale)), "rows")
    # ties go by id, so of equal rows only the smallest ids can be on a list
    keep = max(positives + 1, negatives)
    alike = Window.partitionBy("label", "vec").orderBy("id")
    classes = base.withColumn("place", F.dense_rank().over(alike)).where(F.col("place") <= keep).groupBy("label", "vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    classes = stage.write(classes.withColumn("dim", F.size("vec")), "classes")
    named = base.where("anchor").withColumn("a", F.concat(F.hex(F.xxhash64("label", "vec")), F.lit("-"), F.hex(F.hash("vec", "label"))))
    anchors = stage.write(named.groupBy("a", "label", "vec").agg(F.lit(1)).select("a", "label", "vec", F.size("vec").alias("dim")), "anchors")
    of_row = stage.write(named.select("id", "a").distinct(), "anchor-rows")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    dims = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square")).orderBy("dim").limit(65).collect()
    if len(dims) > 64:
        raise ValueError("vectors of more than 64 lengths")
    out = []
    for d in dims:
        join = _Join(stage, classes.where(F.col("dim") == d["dim"]).drop("dim"), anchors.where(F.col("dim") == d["dim"]).drop("dim"), d["dim"], d["n"], d["square"], (low, high))
        near = join.search(join.anchors.select("a", F.lit(0).cast("long").alias("of"), F.lit(-LARGEST).alias("low"), F.lit(LARGEST).alias("high")), True, positives + 1)
        lists = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("p"))
        chosen = of_row.join(lists, "a").select("id", "a", F.posexplode(F.slice(F.filter("p", lambda x: x["id"] != F.col("id")), 1, positives)).alias("at", "x"))
        chosen = stage.write(chosen.select("id", "a", F.col("x.id").alias("positive_id"), (-F.col("x.s")).alias("of")), f"chosen-{d['dim']}")
        wants = chosen.select("a", "of").distinct().select("a", "of", F.expr(f"of * {low} div 100 - 1").alias("low"), F.expr(f"of * {high} div 100 + 1").alias("high")).where("low <= high")
        far = join.search(wants, False, negatives)
        ranked = far.groupBy("a", "of").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("n"))
        out.append(chosen.join(ranked, ["a", "of"]).select(F.col("id").alias("anchor_id"), "positive_id", F.posexplode("n").alias("rank", "x"), "of").select(
            "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("negative_id"), F.col("of").alias("positive_score"), (-F.col("x.s")).alias("negative_score")))
    if not out:
        return spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made
