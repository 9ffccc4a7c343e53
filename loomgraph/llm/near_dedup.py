"""Near-duplicate documents: ProbMinHash sketches, banding, exact verification.

A document is the set of its five-word shingles. ProbMinHash lets every shingle start a
Poisson process whose rate is its weight; each arrival falls on a random register, and a
register keeps the shingle that reached it first. A shingle stops once its next arrival is
later than every register, so few arrivals are drawn beyond the first. Two registers agree
with the probability Jaccard similarity of the weighted sets, and that same similarity
decides: registers are grouped to bands, documents that share a band are candidates, and
the probability Jaccard similarity of a candidate pair is computed exactly. A shingle's
weight is 1, however often a document repeats it - the similarity is then the Jaccard
similarity of the sets - or, ``weighted``, the number of times that it occurs.

Copies with the same words are one class before banding, and the pairs of a bucket are not
listed. All buckets with the same smallest member - their leader - form a group. (1) Each
member is compared with the leader; verified links give components. (2) Members that stay
outside the leader's component are compared with all others of the group, in tiles of at
most ``TILE`` by ``TILE`` documents; a tile gives a spanning forest of the links it finds,
not the pairs it looks at. Two members of one bucket are thus either joined by their leader
or compared, so the components are those of all candidate pairs.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, spanning
from .common import Stage, bound_arrow, id_kind

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Documents and, about, shingles on a side of a tile.
TILE, TILE_SHINGLES = 256, 1 << 20
#: Candidate ids are broadcast up to this many (8 bytes each), and shuffled beyond it.
BROADCAST_IDS = 2_000_000
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser: equal inputs, equal outputs; else as good as random."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def tokens(text: str | None) -> list[str]:
    """The words; a text of marks alone is one word, a blank one has none."""
    if not text:
        return []
    return _WORD.findall(text.lower()) or ([text.strip()] if text.strip() else [])


def shingles(words: list[str], n: int = WORDS) -> np.ndarray:
    """Hashes of the shingles, repeats included; a text of fewer words is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _GOLDEN + h[k : len(h) - n + 1 + k])
    return out


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers, a row for each (elements, weights); empty sets give zeros."""
    sizes = [len(e) for e, _ in sets]
    q, z = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    if not sum(sizes):
        return z.reshape(len(sets), m)
    elem = np.concatenate([e for e, _ in sets])
    rate = 1.0 / np.concatenate([w for _, w in sets]).astype(np.float64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    time, arrival = np.zeros(len(elem)), 0
    while len(elem):
        arrival += 1
        r = _mix(elem + _U(arrival * int(_GOLDEN) % 2**64))
        time = time - np.log(((r >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) * rate
        register = doc * m + (_mix(r) % _U(m)).astype(np.int64)
        np.minimum.at(q, register, time)
        won = q[register] == time
        z[register[won]] = elem[won]
        latest = q.reshape(len(sets), m).max(axis=1)
        alive = time < latest[doc]  # early termination: later arrivals win nothing
        elem, rate, doc, time = elem[alive], rate[alive], doc[alive], time[alive]
    return z.reshape(len(sets), m)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    out = np.zeros((len(registers), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(registers), b + 1, np.uint64)
        for r in range(ROWS):
            key = _mix(key * _GOLDEN + registers[:, b * ROWS + r])
        out[:, b] = key
    return out.view(np.int64)


def weighted_set(words: list[str], weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, sorted, and their weights."""
    elem, n = np.unique(shingles(words), return_counts=True)
    return elem, n.astype(np.float64) if weighted else np.ones(len(elem))


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The chance that the sketches of two weighted sets agree in a register: the sum over common
    elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i). The inner sums come from
    running sums in the order of x_j / y_j."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    ratio = x[1][i] / y[1][j]
    order = np.argsort(ratio)
    ratio, xs, ys = ratio[order], x[1][i][order], y[1][j][order]
    only_x, only_y = x[1].sum() - xs.sum(), y[1].sum() - ys.sum()
    # those at or above the own ratio count by x, those under it by y
    first = np.searchsorted(ratio, ratio, side="left")
    above = xs.sum() - np.r_[0.0, np.cumsum(xs)][first] + only_x
    under = np.r_[0.0, np.cumsum(ys)][first] + only_y
    return float((xs / (above + ratio * under)).sum())


def _sketches(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                lists = [tokens(t) for t in texts[at : at + 256]]
                keys = [xxhash.xxh128_digest("\x1f".join(w)) if w else None for w in lists]
                bands = band_keys(sketch([weighted_set(w, weighted) for w in lists]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(lists)), pa.array(keys, pa.binary()),
                     pa.array([row.tolist() if w else None for row, w in zip(bands, lists, strict=True)], pa.list_(pa.int64()))],
                    names=["id", "key", "bands"])
    return run


def _sets(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [tokens(t) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh128_digest("\x1f".join(w)) if w else None for w in lists]
            sets = [weighted_set(w, weighted) for w in lists]
            offsets = pa.array(np.cumsum([0, *(len(e) for e, _ in sets)]), pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([e.view(np.int64) for e, _ in sets]) if sets else [], pa.int64()))]
            if weighted:
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([w for _, w in sets]) if sets else [], pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *columns], names=["id", "key", "shingles", *(["weights"] if weighted else [])])
    return run


def _similar(x: pd.Series, wx: pd.Series, y: pd.Series, wy: pd.Series) -> pd.Series:
    return pd.Series([probability_jaccard((a, v), (b, w)) for a, v, b, w in zip(x, wx, y, wy, strict=True)], dtype="float64")


_similar.__annotations__ = dict.fromkeys(("x", "wx", "y", "wy", "return"), pd.Series)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) pairs whose shingle sets have the similarity asked for."""
    if "weights" in sets.columns:
        left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"), F.col("weights").alias("wx")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"), F.col("weights").alias("wy"))
        same = F.pandas_udf(_similar, "double")("x", "wx", "y", "wy")
        return pairs.join(right, "b").join(left, "a").where(same >= F.lit(threshold) - 1e-9).select("a", "b")
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(right, "b").join(left, "a")
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    return (joined.where(small >= F.lit(threshold) * large - 1e-9)
            .withColumn("common", common)
            .where(F.col("common") >= F.lit(threshold) * (F.size("x") + F.size("y") - F.col("common")) - 1e-9).select("a", "b"))


def _tile(threshold: float, kind: str):
    made = lambda a, b: pd.DataFrame({"a": a, "b": b}, dtype="int64" if kind == "bigint" else "object")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        outside, every = pdf[pdf["outside"]], pdf[~pdf["outside"]]
        if outside.empty or every.empty:
            return made([], [])
        sizes = every["shingles"].map(len).to_numpy()
        vocab, where = np.unique(np.concatenate(every["shingles"].to_numpy()), return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        ids, comps = every["rep"].to_numpy(), every["component"].to_numpy()
        flags, found = np.zeros(len(vocab), np.int32), ([], [])
        others, weights = every["shingles"].to_numpy(), every["weights"].to_numpy() if "weights" in every else None
        for rep, comp, own, mine in zip(outside["rep"], outside["component"], outside["shingles"], outside["weights"] if weights is not None else outside["rep"], strict=True):
            at = np.searchsorted(vocab, own)
            at = at[(at < len(vocab))]
            at = at[np.isin(vocab[at], own)]
            flags[at] = 1
            common = np.add.reduceat(flags[where], starts)  # with each of the others, exactly
            flags[at] = 0
            if weights is None:
                near = (common >= threshold * (len(own) + sizes - common) - 1e-9) & (comps != comp)
            else:
                near = (common > 0) & (comps != comp)
                for k in np.flatnonzero(near).tolist():
                    near[k] = probability_jaccard((own, mine), (others[k], weights[k])) >= threshold - 1e-9
            found[0].extend([rep] * int(near.sum()))
            found[1].extend(ids[near].tolist())
        kept = spanning(*found)
        return made([found[0][i] for i in kept], [found[1][i] for i in kept])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """(id, class_id, kept), one row per row of ``docs``.

    class_id is the smallest id of the documents linked to this one by Jaccard similarity
    of five-word shingles (lower-cased words of letters and digits) of ``threshold`` or
    more, directly or through others; kept is true for that document alone. Null and blank
    texts are classes of their own, and so are rows without an id (class_id is null). Rows of equal
    words share a class; rows that repeat an id with other texts have each text's class, and are
    kept where it is their id. Ids may be whole numbers or strings. Texts of any length are
    read whole; an empty table gives an empty table. Other columns of ``docs`` are not read.

    ``weighted`` counts a shingle as often as a text repeats it, in the sketch and in what
    decides alike: two texts that differ by one passage said a hundred times are then far apart,
    which without it they are not.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    stage = Stage(spark, "near-documents")
    kind = id_kind(docs, id_col)
    base = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"))
    sketched = stage.write(base.mapInArrow(_sketches(weighted), f"id {kind}, key binary, bands array<long>"), "sketches")
    # classes of equal words, each with the bands of its smallest id
    classes = stage.write(sketched.where("key is not null and id is not null").groupBy("key").agg(F.min(F.struct("id", "bands")).alias("first"))
                          .select("key", F.col("first.id").alias("rep"), F.col("first.bands").alias("bands")), "classes")
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where("n > 1")
    members = stage.write(rows.join(buckets, "bucket"), "members")
    needed = stage.write(members.select(F.col("rep").alias("id")).distinct(), "needed")
    few = needed.count() <= BROADCAST_IDS
    held = base.join(F.broadcast(needed) if few else needed, "id", "left_semi")
    # an id has a set for each of its texts; repeats of a set link nothing more
    more = ["weights"] if weighted else []
    held = held.mapInArrow(_sets(weighted), f"id {kind}, key binary, shingles array<long>" + ", weights array<double>" * weighted)
    sets = stage.write((held if few else held.dropDuplicates(["id", "key"])).select("id", "shingles", *more), "sets")
    stars = stage.write(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    stage.drop("members")
    links = stage.write(_verified(stars, sets, threshold), "links-of-leaders")
    comps = stage.write(components(links, stage), "components-1")
    # groups of a leader, with the component of each member
    component = comps.select(F.col("node").alias("n"), "component")
    group = stars.select("a", F.col("b").alias("rep")).unionByName(stars.select("a", F.col("a").alias("rep")).distinct())
    group = group.join(component, F.col("rep") == F.col("n"), "left").select("a", "rep", F.coalesce("component", "rep").alias("component"))
    group = stage.write(group, "groups")
    heads = group.where("a = rep").select(F.col("a").alias("h"), F.col("component").alias("own"))
    told = stage.write(group.join(heads, F.col("a") == F.col("h")).select("a", "rep", "component", (F.col("component") != F.col("own")).alias("outside")), "told")
    open_groups = told.join(told.where("outside").select(F.col("a").alias("h")).distinct(), F.col("a") == F.col("h"), "left_semi")
    weight = sets.groupBy("id").agg(F.sum(F.size("shingles")).alias("shingled"))
    open_groups = stage.write(open_groups.join(weight, F.col("rep") == F.col("id")).drop("id"), "open")
    parts = lambda n, w: F.ceil(F.greatest(n / TILE, w / TILE_SHINGLES)).cast("int")
    sizes = open_groups.groupBy("a").agg(F.sum(F.col("outside").cast("int")).alias("n_out"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("outside"), F.col("shingled"))).alias("w_out"),
                                         F.sum("shingled").alias("w")).where("n_out > 0 and n > 2").select(
        F.col("a").alias("h"), parts(F.col("n_out"), F.col("w_out")).alias("ti"), parts(F.col("n"), F.col("w")).alias("tj"))
    open_groups = open_groups.join(sizes, F.col("a") == F.col("h")).drop("h").where("rep <> a")  # all are compared with the leader
    spot = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    rows = open_groups.where("outside").select("a", "rep", "component", "outside", spot(F.col("ti")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("tj") - 1)).alias("j")).unionByName(
        open_groups.select("a", "rep", "component", F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), F.col("ti") - 1)).alias("i"), spot(F.col("tj")).alias("j")))
    tiles = rows.join(sets, F.col("rep") == F.col("id")).select("a", "i", "j", "rep", "component", "outside", "shingles", *more)
    found = stage.write(tiles.groupBy("a", "i", "j").applyInPandas(_tile(threshold, kind), f"a {kind}, b {kind}"), "links-across")
    final = stage.write(components(links.unionByName(found), stage), "components-2")
    of_class = classes.select("key", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("key").alias("ck"), F.coalesce("component", "rep").alias("class_id"))
    for name in ("needed", "sets", "stars", "links-of-leaders", "components-1", "groups", "told", "open", "links-across"):
        stage.drop(name)  # the result reads sketches, classes and components-2
    out = sketched.select("id", "key").join(of_class, (F.col("key") == F.col("ck")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
                      F.coalesce(F.col("id") == F.coalesce("class_id", "id"), F.lit(True)).alias("kept"))
