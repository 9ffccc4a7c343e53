"""Communities: back ends, router, stable ids, hierarchy, labels, core nodes, tables."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.models import asked
from ..stage import Stage
from . import blockmodel as sbm
from . import graph as gx
from .leiden import Leiden, choices, lists, quality, symmetric
from .names import ranked


class Rigor(IntEnum):
    EMBEDDINGS_ONLY = 0
    HEURISTIC = 1
    PRINCIPLED = 2


@dataclass
class Result:
    """A partition (node_id, community_id, path) and how it was made."""
    partition: DataFrame
    backend: str
    rigor: Rigor
    notes: list[str] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)


class KMeansBackend:
    """k-means over document vectors; k = int(sqrt(n / 2)) within 2 to 20 and at most n."""
    name, rigor = "embeddings", Rigor.EMBEDDINGS_ONLY

    def __init__(self, k: int | None = None, seed: int = 42) -> None:
        self.k, self.seed = k, seed

    def available(self) -> bool:
        return True

    def pick_k(self, n: int) -> int:
        return max(1, min(n, self.k or max(2, min(20, int(math.sqrt(n / 2))))))

    def cluster(self, nodes: DataFrame, projection: DataFrame, vectors: DataFrame | None = None) -> Result:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        if vectors is None:
            raise ValueError("k-means needs document vectors")
        data = vectors.select("node_id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
        model = KMeans(k=self.pick_k(data.count()), seed=self.seed, featuresCol="features", predictionCol="community_id").fit(data)
        part = model.transform(data).select("node_id", "community_id", F.array("community_id").alias("path"))
        return Result(part, self.name, self.rigor)


def by_rank(stage: Stage, nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, id) of the nodes and the links' ends, and the links (a, b, w) between ids. Ranks keep the order of the
    names, and rounds over them hash, compare and send numbers."""
    named = stage.write(links, "named")
    every = nodes.select("node_id").union(named.select("a")).union(named.select("b")).where("node_id is not null").distinct()
    ids = stage.write(ranked(every, F.asc("node_id")).select("node_id", F.col("rank").alias("id")), "ids")
    links = named.join(ids.toDF("a", "ia"), "a").join(ids.toDF("b", "ib"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "w")
    return ids, stage.write(links, "numbered")


class LouvainBackend:
    """Local moving by modularity gain in rounds, then aggregation; the levels are the
    nested path. In a round every node finds its best neighbouring community; moves are
    made by one half of the nodes at a time (a hash of node and round), so neighbours do not
    swap for ever. Ties go to the lowest id. Every round is a few grouped joins and is
    written to the shared folder; nothing but two counts a level comes to the driver. A
    note of the result says where ``rounds`` or ``levels`` stopped it before its end."""
    name, rigor = "louvain", Rigor.HEURISTIC

    def __init__(self, resolution: float = 1.0, rounds: int = 8, levels: int = 3, weighted: bool = True) -> None:
        self.resolution, self.rounds, self.levels, self.weighted = resolution, rounds, levels, weighted

    def available(self) -> bool:
        return True

    def _level(self, stage: Stage, links: DataFrame, turns: DataFrame, level: int, notes: list[str]) -> DataFrame:
        """(n, c) of the nodes of (a, b, w) links in both directions, loops included; (n, turns): a
        node's bit for each round says whether it may move then."""
        k = stage.write(links.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("k")), f"{level}-strength")
        total = k.agg(F.sum("k")).first()[0] or 0.0
        part = k.select("n", F.col("n").alias("c"))
        if not total:
            return part
        to, part = stage.write(lists(links, k), f"{level}-lists"), part.join(k, "n")
        for r in range(self.rounds):
            better = F.col("s") > F.col("s0") + 1e-9
            told = Observation()
            now = choices(to, part, total, self.resolution).observe(told, F.count_if(better).alias("willing"))
            part = stage.write(now.join(turns, "n").select("n", "k", F.when(F.col("turns")[r] & better, F.col("best")).otherwise(F.col("own")).alias("c")), f"{level}-{r}")
            if not told.get["willing"]:
                break
        else:
            notes.append(f"louvain: level {level} stopped after {self.rounds} rounds with nodes still willing to move")
        return part.select("n", "c")

    def cluster(self, nodes: DataFrame, projection: DataFrame, vectors: DataFrame | None = None) -> Result:
        stage = Stage(nodes.sparkSession, "louvain")
        w = F.col("weight").cast("double") if self.weighted else F.lit(1.0)
        half = projection.where("a <> b").select("a", "b", w.alias("w"))
        ids, half = by_rank(stage, nodes, half)
        turns = ids.select(F.col("id").alias("n"), F.array(*(F.pmod(F.xxhash64("node_id", F.lit(r)), F.lit(2)) == 0 for r in range(self.rounds))).alias("turns"))
        links = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        paths = nodes.select("node_id").join(ids, "node_id", "left").select("node_id", F.col("id").alias("at"), F.array().cast("array<long>").alias("names"))
        notes: list[str] = []
        for level in range(self.levels):
            part = self._level(stage, links, turns, level, notes)
            before, after = part.count(), part.select("c").distinct().count()
            if before == after and level:
                break
            paths = stage.write(paths.join(part.withColumnRenamed("n", "at"), "at", "left").select(
                "node_id", F.coalesce("c", "at").alias("at"), F.concat("names", F.array(F.coalesce("c", "at"))).alias("names")), f"paths-{level}")
            links = stage.write(links.join(part.select(F.col("n").alias("a"), F.col("c").alias("ca")), "a").join(part.select(F.col("n").alias("b"), F.col("c").alias("cb")), "b")
                                .groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), f"links-{level + 1}")
            if before == after:
                break
        else:
            notes.append(f"louvain: stopped after {self.levels} levels while communities still merged")
        return Result(numbered(paths.select("node_id", "names")), self.name, self.rigor, notes)


class LeidenBackend:
    """Leiden: every community is connected, and no node's move to another raises the quality."""
    name, rigor = "leiden", Rigor.HEURISTIC

    def __init__(self, resolution: float = 1.0, weighted: bool = True) -> None:
        self.resolution, self.weighted = resolution, weighted

    def available(self) -> bool:
        return True

    def cluster(self, nodes: DataFrame, projection: DataFrame, vectors: DataFrame | None = None) -> Result:
        stage = Stage(nodes.sparkSession, "leiden")
        ids, links = by_rank(stage, nodes, symmetric(projection, self.weighted))
        out = Leiden(stage, self.resolution).run(ids.select(F.col("id").alias("node_id")), links)
        named = nodes.join(ids, "node_id", "left").select("node_id", F.col("id").alias("__id"))
        out = named.join(out.withColumnRenamed("node_id", "__id"), "__id", "left")
        return Result(numbered(out.select("node_id", F.array("c").alias("names"))), self.name, self.rigor)


class BlockModelBackend:
    """The nested, degree-corrected block model over the links without their weights. Its lowest level starts
    at Leiden's refined parts; nodes without links are a block of their own. ``metrics`` of the
    result has the description length in parts, modularity, degree assortativity, global
    clustering and, after ``sweeps`` steps of a Markov chain, the spread of the posterior."""
    name, rigor = "sbm", Rigor.PRINCIPLED

    def __init__(self, sweeps: int = 0) -> None:
        self.sweeps = sweeps

    def available(self) -> bool:
        return True

    def cluster(self, nodes: DataFrame, projection: DataFrame, vectors: DataFrame | None = None) -> Result:
        stage = Stage(nodes.sparkSession, "block-model")
        links = symmetric(projection, weighted=False).join(nodes.select(F.col("node_id").alias("a")), "a", "left_semi").join(nodes.select(F.col("node_id").alias("b")), "b", "left_semi")
        ids, links = by_rank(stage, nodes, links)
        linked = stage.write(links.select(F.col("a").alias("node_id")).distinct(), "linked")
        if not linked.limit(1).count():
            return Result(numbered(nodes.select("node_id", F.array(F.lit("")).alias("names"))), self.name, self.rigor, metrics={"mdl_nats": 0.0})
        levels, metrics = sbm.nested(stage, linked.select(F.col("node_id").alias("n")), links, stage.write(Leiden(stage).start(links), "start"))
        metrics |= {"modularity": quality(links, levels[0]), "degree_assortativity": sbm.assortativity(links), "global_clustering": sbm.global_clustering(links)}
        if self.sweeps:
            metrics |= sbm.posterior(sbm.Fit(stage, "posterior", links, linked.select(F.col("node_id").alias("n")), True), levels[0], self.sweeps)
        paths = cascade([level.select(F.col("n").alias("node_id"), F.col("c").alias("block")) for level in levels])
        alone = F.array(*(F.lit(-1).cast("long") for _ in levels))
        paths = nodes.select("node_id").join(ids, "node_id", "left").join(paths.select(F.col("node_id").alias("id"), "path"), "id", "left").select("node_id", F.coalesce("path", alone).alias("names"))
        notes = [f"nested=True, degree_corrected=True, n_levels={len(levels)}"]
        return Result(numbered(paths), self.name, self.rigor, notes, metrics)


def numbered(paths: DataFrame) -> DataFrame:
    """(node_id, community_id, path) of named paths: the communities of each level are
    numbered from 0 by size, largest first, then name."""
    depth = paths.agg(F.max(F.size("names"))).first()[0] or 0
    out = paths
    for level in range(depth):
        name = F.col("names").getItem(level)
        sizes = paths.groupBy(name.alias(f"name{level}")).agg(F.count(F.lit(1)).alias("s"))
        ids = ranked(sizes, F.desc("s"), F.asc(f"name{level}")).select(f"name{level}", F.col("rank").cast("int").alias(f"id{level}"))
        out = out.join(ids, name == F.col(f"name{level}"), "left").drop(f"name{level}")
    path = F.array(*[F.col(f"id{level}") for level in range(depth)]) if depth else F.array().cast("array<int>")
    return out.select("node_id", F.element_at(path, 1).alias("community_id"), path.alias("path"))


class Router:
    """The best back end that is there, up to a ceiling."""

    def __init__(self, backends: Sequence | None = None) -> None:
        self.backends = list(backends) if backends is not None else [BlockModelBackend(), LeidenBackend(), KMeansBackend()]

    def pick(self, ceiling: Rigor = Rigor.PRINCIPLED):
        there = [b for b in self.backends if b.rigor <= ceiling and b.available()]
        if not there:
            raise RuntimeError("no clustering back end is available")
        return max(there, key=lambda b: b.rigor)

    def cluster(self, nodes: DataFrame, projection: DataFrame, vectors: DataFrame | None = None, ceiling: Rigor = Rigor.PRINCIPLED) -> Result:
        chosen = self.pick(ceiling)
        out = chosen.cluster(nodes, projection, vectors)
        if chosen.rigor < ceiling:
            out.notes.append(f"asked for {ceiling.name.lower()}, ran {chosen.name} ({chosen.rigor.name.lower()})")
        return out


# --- stable ids -----------------------------------------------------------------------------

#: Pairs of a new and an old community that the driver may settle (about 100 bytes each).
CLAIMS = 5_000_000


def greedy_ids(sizes: list[tuple[int, int, str]], overlaps: dict[tuple[int, int], int], reserved: list[int]) -> dict[int, int]:
    """new id -> stable id. ``sizes``: (new id, members, smallest member). By size, each
    claims the unclaimed old id with most members in common, ties to the lower; the rest
    get ids above all old ones, in order of their new ids."""
    taken: dict[int, int] = {}
    claimed: set[int] = set()
    wishes: dict[int, list[tuple[int, int]]] = {}
    for (new, old), n in overlaps.items():
        if n > 0:
            wishes.setdefault(new, []).append((-n, old))
    for new, _, _ in sorted(sizes, key=lambda s: (-s[1], s[2])):
        options = [w for w in wishes.get(new, ()) if w[1] not in claimed]
        if options:
            taken[new] = min(options)[1]
            claimed.add(taken[new])
    fresh = max(reserved, default=-1) + 1
    for i, new in enumerate(sorted(s[0] for s in sizes if s[0] not in taken)):
        taken[new] = fresh + i
    return taken


def remap_to_previous(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new partition under the old partition's ids. Overlaps are counted in Spark; the
    claims hang on each other and are settled on the driver, over a row a community and a row
    for each two that share members. More than CLAIMS of those are an error."""
    both = new.join(old.select("node_id", F.col("community_id").alias("old_id")), "node_id").groupBy("community_id", "old_id").agg(F.count(F.lit(1)).alias("n")).limit(CLAIMS + 1).collect()
    if len(both) > CLAIMS:
        raise ValueError(f"over {CLAIMS} pairs of old and new communities share members")
    sizes = [tuple(r) for r in new.groupBy("community_id").agg(F.count(F.lit(1)), F.min("node_id")).collect()]
    reserved = [r[0] for r in old.select("community_id").distinct().collect()]
    ids = greedy_ids(sizes, {(r[0], r[1]): r[2] for r in both}, reserved)
    table = new.sparkSession.createDataFrame(list(ids.items()) or [(0, 0)], "community_id int, stable_id int")
    return new.withColumn("community_id", F.col("community_id").cast("int")).join(F.broadcast(table), "community_id").select(
        *[F.col("stable_id").alias("community_id") if c == "community_id" else F.col(c) for c in new.columns])


# --- tables of communities ------------------------------------------------------------------

def members(partition: DataFrame) -> DataFrame:
    return partition.groupBy("community_id").agg(F.array_sort(F.collect_list("node_id")).alias("members"), F.count(F.lit(1)).alias("n_members"))


def core_nodes(partition: DataFrame, edges: DataFrame, percentile: float = 75.0, least: int = 3, src: str = "src", dst: str = "dst") -> DataFrame:
    """(community_id, node_id, degree) of the most linked nodes within each community of at
    least ``least`` members."""
    p = partition.select("node_id", "community_id")
    inside = (edges.join(p.select(F.col("node_id").alias(src), F.col("community_id").alias("cs")), src)
              .join(p.select(F.col("node_id").alias(dst), F.col("community_id").alias("cd")), dst).where("cs = cd"))
    deg = gx.degrees(p, inside, "node_id", src, dst).join(p, "node_id")
    return gx.percentile_core(deg, percentile, ["community_id"], least)


def labels(partition: DataFrame, titles: DataFrame, max_words: int = 6) -> DataFrame:
    """(community_id, label): the most frequent content words of the titles (node_id, title),
    ties to the word seen first in order of node ids; without one, the first member."""
    p = partition.select("node_id", "community_id").join(titles.select("node_id", "title"), "node_id", "left")
    words = p.select("community_id", "node_id", F.posexplode(tx.label_words(F.col("title"))).alias("pos", "word"))
    counted = words.groupBy("community_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node_id", "pos")).alias("seen"))
    # one row a distinct word of a community
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("n"), "seen"))).where(F.col("r") <= max_words)
    best = ranked.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " ").alias("label"))
    first = p.groupBy("community_id").agg(F.min("node_id").alias("first"))
    return first.join(best, "community_id", "left").select("community_id", F.coalesce("label", F.col("first").cast("string")).alias("label"))


def community_table(partition: DataFrame, edges: DataFrame, titles: DataFrame, result: Result | None = None) -> DataFrame:
    core = core_nodes(partition, edges).groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "node_id"))), lambda x: x["node_id"]).alias("core_nodes"))
    sizes = partition.groupBy("community_id").agg(F.count(F.lit(1)).alias("n_members"))
    return (sizes.join(labels(partition, titles), "community_id").join(core, "community_id", "left")
            .select("community_id", "label", "n_members", F.coalesce("core_nodes", F.array().cast("array<string>")).alias("core_nodes"),
                    F.lit(result.rigor.name.lower() if result else "given").alias("rigor"), F.lit(result.backend if result else "given").alias("backend")))


def cascade(assignments: list[DataFrame]) -> DataFrame:
    """(node_id, community_id, path) of nested levels: the first maps node_id to block, each
    further one block to the block above."""
    out = assignments[0].select("node_id", F.col("block").alias("b"), F.array("block").alias("path"))
    for level in assignments[1:]:
        above = level.select(F.col("node_id").alias("b"), F.col("block").alias("up"))
        out = out.join(above, "b", "left").select("node_id", F.col("up").alias("b"), F.concat("path", F.array("up")).alias("path"))
    return out.select("node_id", F.element_at("path", 1).alias("community_id"), "path")


def relabel(communities: DataFrame, partition: DataFrame, cards: DataFrame, answer: Callable[[str], str], max_members: int = 12, max_tags: int = 5) -> DataFrame:
    """Communities with labels from a model. ``answer`` gets each community's block of titles
    and tags; an error or an empty answer keeps the old label."""
    c = cards.select(F.col("doc_id").cast("string").alias("d"), "title", "tags")
    rows = partition.select("community_id", "node_id", F.regexp_replace("node_id", "^doc::", "").alias("d"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("node_id"))).where(F.col("r") <= max_members)
    tags = F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, max_tags), ", ")
    line = F.concat(F.lit("- "), F.coalesce(F.nullif(tx.strip(F.col("title")), F.lit("")), F.col("d")), F.when(tags != "", F.concat(F.lit(" ("), tags, F.lit(")"))).otherwise(""))
    block = (rows.join(c, "d", "left").groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))).alias("x"))
             .join(communities.select("community_id", "n_members"), "community_id")
             .select("community_id", F.concat(F.array_join(F.transform("x", lambda v: v["l"]), "\n"), F.when(
                 F.col("n_members") > max_members, F.format_string("\n(and %d more)", F.col("n_members") - max_members)).otherwise("")).alias("block")))

    new = block.select("community_id", F.nullif(tx.clean_label(asked(lambda text: answer(text) or None, F.col("block"))), F.lit("")).alias("new"))
    return communities.join(new, "community_id", "left").withColumn("label", F.coalesce("new", "label")).drop("new")
