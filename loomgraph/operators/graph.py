"""Entities, the typed multigraph, its projection, degrees, paths and metrics."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import ids
from ..functions import text as tx
from ..stage import Stage
from .components import components as _components

SUMMARY_WEIGHT, CITE_WEIGHT = 10.0, 5.0
#: Documents of one entity that one task pairs.
HOT = 5000
#: Pairs that one task makes, about.
PAIRS = 1_000_000
#: Entities of a document that stand beside it in the lists of all of them.
WIDE = 256
RELATION = {"author": "authored_by", "citation": "cites", "topic": "about"}


# --- entities ---------------------------------------------------------------------------

def extract_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", authors: str | None = "authors", topics: str | None = "topics",
                     ner: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, type, name, key, confidence, source): authors, topics, bracketed
    citations and DOIs of each document, each citation once. ``ner`` adds rows of the same
    shape from a recogniser."""
    def listed(col: str, kind: str, key) -> Column:
        items = F.col(col) if dict(docs.dtypes)[col].startswith("array") else (F.array(F.col(col)) if kind == "author" else F.split(F.col(col), ","))
        items = F.filter(F.transform(items, lambda x: tx.strip(x.cast("string"))), lambda x: x != "")
        return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.struct(
            F.lit(kind).alias("type"), x.alias("name"), key(x).alias("key"), F.lit(f"metadata.{kind}s").alias("source")))

    surnames = F.regexp_extract_all(F.col(text_col), F.lit(tx.CITATION), F.lit(1))
    years = F.regexp_extract_all(F.col(text_col), F.lit(tx.CITATION), F.lit(2))
    cited = F.zip_with(surnames, years, lambda s, y: F.struct(F.lit("citation").alias("type"), F.concat(s, F.lit(" "), y).alias("name"),
                                                              ids.citation_key(s, y).alias("key"), F.lit("body.bracketed_citation").alias("source")))
    dois = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(tx.DOI), F.lit(1)), lambda d: F.struct(
        F.lit("citation").alias("type"), d.alias("name"), ids.doi_key(d).alias("key"), F.lit("body.doi").alias("source")))
    refs = F.coalesce(F.concat(cited, dois), F.array().cast("array<struct<type:string,name:string,key:string,source:string>>"))
    keys = F.transform(refs, lambda r: r["key"])
    once = F.filter(refs, lambda r, i: F.array_position(keys, r["key"]) == i + 1)
    parts = [listed(authors, "author", ids.author_key)] if authors else []
    parts += [listed(topics, "topic", ids.topic_key)] if topics else []
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.concat(*parts, once)).alias("pos", "e")).select(
        "doc_id", "pos", "e.type", "e.name", "e.key", F.lit("EXTRACTED").alias("confidence"), "e.source")
    return out if ner is None else out.unionByName(ner)


def deduplicate_entities(entities: DataFrame, by: list[str] | None = None, rank: dict[str, int] | None = None) -> DataFrame:
    """One entity a key (within ``by``): the most confident, then the first."""
    order = rank or {"EXTRACTED": 0, "INFERRED": 1, "AMBIGUOUS": 2}
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("confidence")), F.lit(len(order)))
    keys = [*(by or []), "key"]
    rest = [c for c in entities.columns if c not in keys]
    first = entities.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(level.alias("l"), F.col("doc_id"), F.col("pos"))).alias("r"))
    return first.select(*keys, "r.*").select(*entities.columns)


# --- the graph --------------------------------------------------------------------------

def _edges(df: DataFrame, src: Column, dst: Column, relation: Column, confidence: Column, provenance: Column | None = None, similarity: Column | None = None) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), relation.alias("relation"), confidence.alias("confidence"), F.lit(None).cast("double").alias("score"),
                     (F.lit(None) if similarity is None else similarity).cast("double").alias("similarity"),
                     (F.create_map() if provenance is None else provenance).cast("map<string,string>").alias("provenance"))


def relation_of(kind: Column) -> Column:
    out = F.concat(F.lit("mentions_"), kind)
    for name, relation in RELATION.items():
        out = F.when(kind == name, F.lit(relation)).otherwise(out)
    return out


def co_mentions(entities: DataFrame) -> DataFrame:
    """(doc_id, a, b) of the distinct entity keys that a document mentions, a < b.

    The pairs come out of a document's own array, one key at a time, without a self-join's
    shuffle; a document's entities are its own few, and the pairs are asked for."""
    sets = entities.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("k"))
    each = sets.select("doc_id", "k", F.posexplode("k").alias("i", "a"))  # a row a key, then its pairs: no row holds all of them
    return each.select("doc_id", "a", F.explode(F.slice("k", F.col("i") + 2, F.size("k"))).alias("b"))


def build_graph(docs: DataFrame, entities: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): document and entity nodes, typed edges, co-mention edges. Edges may
    be parallel."""
    has = set(docs.columns)
    attr = lambda c, kind: (F.nullif(F.col(c).cast(kind), F.lit("")) if kind == "string" else F.col(c).cast(kind)) if c in has else F.lit(None).cast(kind)
    doc_nodes = docs.select(ids.doc_node(F.col(id_col)).alias("node_id"), F.lit("document").alias("node_type"), F.lit(None).cast("string").alias("entity_type"),
                            F.lit(None).cast("string").alias("name"), attr("title", "string").alias("title"), attr("year", "int").alias("year"),
                            attr("doi", "string").alias("doi"), attr("arxiv_id", "string").alias("arxiv_id"))
    own = deduplicate_entities(entities, ["doc_id"])  # the pairs' keys are a set already
    first = deduplicate_entities(entities)
    null = lambda kind: F.lit(None).cast(kind)
    entity_nodes = first.select(F.col("key").alias("node_id"), F.lit("entity").alias("node_type"), F.col("type").alias("entity_type"), "name", null("string").alias("title"),
                                null("int").alias("year"), null("string").alias("doi"), null("string").alias("arxiv_id"))
    typed = _edges(own, ids.doc_node(F.col("doc_id")), F.col("key"), relation_of(F.col("type")), F.col("confidence"), F.create_map(F.lit("source"), F.col("source")))
    pairs = _edges(co_mentions(entities), F.col("a"), F.col("b"), F.lit("co_mentioned_in"), F.lit("INFERRED"), F.create_map(F.lit("doc"), ids.doc_node(F.col("doc_id"))))
    return doc_nodes.unionByName(entity_nodes), typed.unionByName(pairs)


def augment_with_concepts(nodes: DataFrame, edges: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes for topics, methods and named entities of ``concepts`` (doc_id, summary, domain,
    topics, methods, named_entities), a ``mentions`` edge for each item listed, and summary
    and domain on the documents."""
    parts = [concepts.select("doc_id", F.explode(col).alias("name")).select(
        "doc_id", "name", F.lit(kind).alias("kind"), ids.concept_key(kind, F.col("name")).alias("key")).where("key is not null")
        for kind, col in (("topic", "topics"), ("method", "methods"), ("named_entity", "named_entities"))]
    items = parts[0].unionByName(parts[1]).unionByName(parts[2])
    known = nodes.select("node_id", F.regexp_replace("node_id", "^doc::", "").alias("d")).where(F.col("node_id").startswith(ids.DOC))
    items = items.withColumn("doc_id", F.col("doc_id").cast("string")).join(known.select(F.col("d").alias("doc_id")), "doc_id", "left_semi")
    new = items.groupBy(F.col("key").alias("node_id")).agg(F.min_by("kind", "doc_id").alias("entity_type"), F.min_by("name", F.struct("doc_id", "name")).alias("name"))
    new = new.join(nodes.select("node_id"), "node_id", "left_anti").select("node_id", F.lit("entity").alias("node_type"), "entity_type", "name")
    more = _edges(items, ids.doc_node(F.col("doc_id")), F.col("key"), F.lit("mentions"), F.lit("EXTRACTED"))
    told = concepts.select(ids.doc_node(F.col("doc_id")).alias("node_id"), "summary", "domain")
    return nodes.unionByName(new, allowMissingColumns=True).join(told, "node_id", "left"), edges.unionByName(more)


def semantic_edges(pairs: DataFrame) -> DataFrame:
    """Edges of (a, b, similarity) document pairs."""
    return _edges(pairs, ids.doc_node(F.col("a")), ids.doc_node(F.col("b")), F.lit("shares_summary_with"), F.lit("INFERRED"), None, F.round("similarity", 4))


# --- projection -------------------------------------------------------------------------

def project(edges: DataFrame, max_df: int | None = None) -> DataFrame:
    """(a, b, weight): documents linked by shared entities (1 each) and by direct edges.

    A document stands in the list of each of its entities with the numbers of the others, and the direct edges of two
    documents are an entity of those two. So a pair is made where the smallest number lies that both have, with the
    weight of all that they share: pairs are not shuffled, and what is shuffled grows as the documents' own lists. An entity of
    more than HOT documents is cut to lists of about that many, and every two lists meet by themselves. Documents of more than
    WIDE entities would be long rows in many lists: pairs with one of those are summed by key. ``max_df`` leaves out entities
    of more documents; by default none is."""
    stage, parallel = Stage(edges.sparkSession, "project"), int(edges.sparkSession.sparkContext.defaultParallelism)
    is_doc = lambda c: F.col(c).startswith(ids.DOC)
    touch = edges.where(is_doc("src") != is_doc("dst")).select(F.when(is_doc("src"), F.col("src")).otherwise(F.col("dst")).alias("d"), F.when(is_doc("src"), F.col("dst")).otherwise(F.col("src")).alias("e"))
    if max_df is not None:
        touch = touch.distinct()
        touch = touch.join(touch.groupBy("e").count().where(F.col("count") <= max_df).select("e"), "e", "left_semi")
    w = (F.when(F.col("relation") == "shares_summary_with", SUMMARY_WEIGHT * F.coalesce("similarity", F.lit(1.0)))
         .when(F.col("relation") == "cites", F.lit(CITE_WEIGHT)).otherwise(F.lit(1.0)))
    direct = edges.where(is_doc("src") & is_doc("dst") & (F.col("src") != F.col("dst"))).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w"))
    direct = stage.write(direct.groupBy("a", "b").agg(F.sum("w").alias("w")).select((-1 - F.monotonically_increasing_id()).alias("e"), F.array("a", "b").alias("z"), "w"), "direct")  # the smallest numbers
    hot = touch.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("e", F.ceil(F.col("n") / HOT).cast("int").alias("n"))  # a row HOT rows at most
    hot = stage.write(hot.withColumn("id", F.monotonically_increasing_id() + (1 << 62)), "hot")
    cut = touch.join(F.broadcast(hot), "e", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("k", F.when(F.col("n") > 1, F.pmod(F.xxhash64("d"), F.col("n"))).otherwise(0).cast("int"))
    made = cut.repartition("e", "k").groupBy("e", "k").agg(F.collect_set("d").alias("z"), F.first("n").alias("n"), F.first("id").alias("id")).where((F.size("z") > 1) | (F.col("n") > 1))  # a lone document makes no pair
    made = stage.write(made.select(F.coalesce("id", F.monotonically_increasing_id()).alias("e"), "k", "n", "z"), "lists")
    links = made.select(F.explode("z").alias("d"), "e", "k", "n", F.lit(1.0).alias("w")).unionByName(direct.select(F.explode("z").alias("d"), "e", F.lit(0).alias("k"), F.lit(1).alias("n"), "w"))
    wide = touch.select("d").unionByName(direct.select(F.explode("z").alias("d"))).groupBy("d").agg(F.count(F.lit(1)).alias("c"))  # where a document's rows lie together, one each is sent
    wide = stage.write(wide.where(F.col("c") > WIDE).select("d"), "wide")
    some_wide, some_hot = bool(wide.limit(1).count()), bool(hot.limit(1).count())
    cuts = ["k", "n"] if some_hot else []
    if some_wide:
        narrow = links.join(wide.select("d"), "d", "left_anti")
        lone = links.join(wide.select("d"), "d", "left_semi").select("e", "w", *cuts, F.struct("d", F.lit(None).cast("array<bigint>").alias("es")).alias("m"))
    else:
        narrow = links
    of = narrow.repartition("d").groupBy("d").agg(F.collect_list(F.struct("e", "w", *cuts)).alias("at"))
    total = made.agg(F.sum(F.col("n") * F.size("z").cast("long") * F.size("z"))).first()[0] or 0
    of = stage.write(of, "documents")
    rows = of.select("d", F.transform("at", lambda x: x["e"]).alias("es"), F.explode("at").alias("x")).select("x.*", "d", "es")
    rows = rows.select("e", "w", *cuts, F.struct("d", F.array_remove("es", F.col("e")).alias("es")).alias("m"))
    if some_wide:
        rows = rows.unionByName(lone)
    else:
        stage.drop("lists")
        stage.drop("direct")
    rows = rows.repartition(max(parallel, math.ceil(total / 2 / PAIRS)), "e", *cuts[:1]).groupBy("e", *cuts).agg(F.collect_list("m").alias("z"), F.first("w").alias("w"))
    if some_wide or some_hot:
        rows = stage.write(rows, "members")
    met = rows.select("e", "w", "z", F.posexplode("z").alias("i", "m")).select("e", "w", "m", F.explode(F.slice("z", F.col("i") + 2, F.size("z"))).alias("o"))
    if some_hot:
        far = rows.where("n > 1").select("e", "k", "z", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")).where("j > k").join(rows.where("n > 1").select("e", F.col("k").alias("j"), F.col("z").alias("y")), ["e", "j"])
        far = far.repartition("e", "k", "j").select("e", "w", "y", F.explode("z").alias("m")).select("e", "w", "m", F.explode("y").alias("o"))
        met = met.unionByName(far)
    ends = F.least("m.d", "o.d").alias("a"), F.greatest("m.d", "o.d").alias("b")
    both = met.select("e", "w", *ends, F.array_intersect("m.es", "o.es").alias("both"))  # null if one is wide
    out = both.where((F.size("both") == 0) | (F.array_min("both") > F.col("e"))).select("a", "b", (F.col("w") + F.size("both")).alias("weight"))
    if some_wide:
        out = out.unionByName(met.where("m.es is null or o.es is null").select(*ends, "w").groupBy("a", "b").agg(F.sum("w").alias("weight")))
    return out


# --- degrees and hubs -------------------------------------------------------------------

def degrees(nodes: DataFrame, edges: DataFrame, node_col: str = "node_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, degree): in and out, parallel edges counted, 0 for isolated nodes."""
    ends = edges.select(F.explode(F.array(src, dst)).alias(node_col)).groupBy(node_col).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(node_col).join(ends, node_col, "left").select(node_col, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def backlinks(edges: DataFrame, dst: str = "dst") -> DataFrame:
    return edges.groupBy(F.col(dst).alias("node_id")).agg(F.count(F.lit(1)).alias("backlinks"))


def percentile_core(deg: DataFrame, percentile: float, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """Rows of (by..., node, degree) at or above the degree at index round_half_even(p/100 *
    (n - 1)) of the sorted degrees of their group; groups under ``least`` give none.

    Degrees are few distinct values, so the cut comes from their histogram: no task sorts a
    group's nodes."""
    if not 0 <= percentile <= 100:
        raise ValueError("percentile must be within [0, 100]")
    by = by or []
    hist = deg.groupBy(*by, "degree").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = F.sum("c").over(w.orderBy("degree"))
    at = F.bround(F.lit(percentile / 100.0) * (F.sum("c").over(w) - 1), 0)
    cut = hist.select(*by, "degree", run.alias("upto"), F.sum("c").over(w).alias("n"), at.alias("at")).where((F.col("upto") > F.col("at")) & (F.col("n") >= least)).groupBy(*by).agg(F.min("degree").alias("cut"))
    joined = deg.join(F.broadcast(cut) if not by else cut, by) if by else deg.crossJoin(F.broadcast(cut))
    return joined.where(F.col("degree") >= F.col("cut")).drop("cut")


def without_nodes(edges: DataFrame, nodes: DataFrame, node_col: str = "node_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """The subgraph without some nodes."""
    out = edges
    for end in (src, dst):
        out = out.join(nodes.select(F.col(node_col).alias(end)), end, "left_anti")
    return out


def majority_reattach(hubs: DataFrame, edges: DataFrame, partition: DataFrame, node_col: str = "node_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, community_id): each hub to the community of most of its neighbours that have
    one; ties to the lowest id, none to fresh ids above all in order of the hub. A neighbour
    votes once as successor and once as predecessor, parallel edges apart. One round: hubs do
    not vote for each other."""
    ends = F.explode(F.array(F.struct(F.col(src).alias(node_col), F.col(dst).alias("o"), F.lit(True).alias("out")), F.struct(F.col(dst).alias(node_col), F.col(src).alias("o"), F.lit(False).alias("out"))))
    both = edges.select(ends.alias("x")).select("x.*").join(hubs.select(node_col), node_col, "left_semi").distinct()  # the edges are read once, and those of hubs alone are compared
    votes = (both.join(partition.select(F.col(node_col).alias("o"), "community_id"), "o")
             .groupBy(node_col, "community_id").agg(F.count(F.lit(1)).alias("v")))
    won = votes.groupBy(node_col).agg(F.max_by("community_id", F.struct(F.col("v"), (-F.col("community_id")).alias("n"))).alias("community_id"))
    top = partition.agg(F.coalesce(F.max("community_id"), F.lit(-1)).alias("top"))
    lone = hubs.select(node_col).join(won, node_col, "left_anti").crossJoin(F.broadcast(top))
    lone = lone.select(node_col, (F.col("top") + F.row_number().over(Window.orderBy(node_col))).cast("int").alias("community_id"))
    return won.select(node_col, F.col("community_id").cast("int")).unionByName(lone)


# --- paths, components, metrics -----------------------------------------------------------

def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int | None = None, src: str = "src", dst: str = "dst", node_col: str = "node_id") -> tuple[DataFrame, DataFrame, bool]:
    """(nodes with level, edges walked, truncated). Successors only; the cap is looked at
    after each whole level; seeds are always there. Each level is one join of the frontier
    and one anti-join, written to the shared folder."""
    stage = Stage(edges.sparkSession, "bfs")
    seen = stage.write(seeds.select(node_col).distinct().withColumn("level", F.lit(0)), "seen-0")
    walked, truncated = edges.limit(0), False
    frontier = seen
    for level in range(1, max(depth, 0) + 1):
        step = edges.join(frontier.select(F.col(node_col).alias(src)), src, "left_semi")
        walked = stage.write(walked.unionByName(step.select(*edges.columns)), f"edges-{level}")
        fresh = step.select(F.col(dst).alias(node_col)).distinct().join(seen.select(node_col), node_col, "left_anti").withColumn("level", F.lit(level))
        frontier = stage.write(fresh, f"frontier-{level}")
        seen = stage.write(seen.unionByName(frontier), f"seen-{level}")
        if max_nodes is not None and seen.count() >= max_nodes:
            truncated = True
            break
        if frontier.isEmpty():
            break
    return seen, walked, truncated


def connected_components(nodes: DataFrame, edges: DataFrame, node_col: str = "node_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable, whatever the edges' direction."""
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    found = _components(links, Stage(edges.sparkSession, "components"))
    return nodes.select(node_col).join(found.withColumnRenamed("node", node_col), node_col, "left").select(node_col, F.coalesce("component", node_col).alias("component"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, node_col: str = "node_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """One row: n_nodes, n_edges (simple, undirected), density, avg_degree, max_degree,
    n_isolated. Loops count twice in a degree."""
    simple = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    deg = degrees(nodes, simple, node_col, "a", "b")
    counts = deg.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("total"), F.max("degree").alias("max_degree"), F.sum((F.col("degree") == 0).cast("long")).alias("n_isolated"))
    m = simple.agg(F.count(F.lit(1)).alias("n_edges"))
    n = F.col("n_nodes")
    return counts.crossJoin(m).select("n_nodes", "n_edges", F.round(F.when(n > 1, 2.0 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0), 6).alias("density"),
                                      F.round(F.when(n > 0, F.col("total") / n).otherwise(0.0), 6).alias("avg_degree"), "max_degree", "n_isolated")


def component_metrics(nodes: DataFrame, edges: DataFrame, node_col: str = "node_id", src: str = "src", dst: str = "dst") -> DataFrame:
    """One row: n_components and the share of the nodes in the largest."""
    sizes = connected_components(nodes, edges, node_col, src, dst).groupBy("component").agg(F.count(F.lit(1)).alias("s"))
    return sizes.agg(F.count(F.lit(1)).alias("n_components"), F.round(F.coalesce(F.max("s") / F.sum("s"), F.lit(0.0)), 6).alias("largest_fraction"))


def by_type(nodes: DataFrame) -> DataFrame:
    """(node_type, entity_type, n) of the nodes."""
    return nodes.groupBy("node_type", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def modularity(projection: DataFrame, partition: DataFrame, node_col: str = "node_id") -> DataFrame:
    """One row ``modularity``: sum over communities of W_in/m - (K/2m)^2; null if a node has
    no community or nothing is linked."""
    part = partition.select(node_col, "community_id")
    e = (projection.join(part.select(F.col(node_col).alias("a"), F.col("community_id").alias("ca")), "a", "left")
         .join(part.select(F.col(node_col).alias("b"), F.col("community_id").alias("cb")), "b", "left"))
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("i"), F.col("weight").alias("k")),
                                      F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("i"), F.col("weight").alias("k")))).alias("x")).select("x.*")
    sums = ends.groupBy("c").agg(F.sum("i").alias("i"), F.sum("k").alias("k"))
    total = sums.agg((F.sum("k") / 2).alias("m"), F.max(F.col("c").isNull()).alias("partial"))
    q = sums.crossJoin(F.broadcast(total)).agg(F.sum(F.col("i") / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), F.lit(2.0))).alias("q"), F.first("partial").alias("partial"))
    return q.select(F.when(~F.col("partial"), F.round("q", 6)).alias("modularity"))


def surprise_of(n: int, m: int, f: int, inside: int) -> float | None:
    """-log10 of the chance that at least ``inside`` of ``m`` edges fall within communities:
    a hypergeometric tail, summed by log-sum-exp. ``f``: pairs within communities."""
    pairs = n * (n - 1) // 2
    if n < 2 or m == 0 or f == 0:
        return None
    if inside == 0:
        return 0.0
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    logs = [choose(f, x) + choose(pairs - f, m - x) for x in range(max(inside, m - (pairs - f)), min(f, m) + 1)]
    if not logs:
        return math.inf
    top = max(logs)
    return -(top + math.log(sum(math.exp(v - top) for v in logs)) - choose(pairs, m)) / math.log(10)


def surprise(nodes: DataFrame, projection: DataFrame, partition: DataFrame, node_col: str = "node_id") -> DataFrame:
    """One row ``surprise`` of the unweighted projection: counts in Spark, the tail from four
    numbers on the driver."""
    part = nodes.select(node_col).join(partition.select(node_col, "community_id"), node_col, "left")
    sizes = part.groupBy("community_id").agg(F.count(F.lit(1)).alias("s"))
    n, f, lost = sizes.agg(F.sum("s"), F.sum(F.col("s") * (F.col("s") - 1) / 2), F.max(F.col("community_id").isNull())).first()
    e = projection.join(part.select(F.col(node_col).alias("a"), F.col("community_id").alias("ca")), "a").join(part.select(F.col(node_col).alias("b"), F.col("community_id").alias("cb")), "b")
    m, inside = e.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("ca") == F.col("cb")).cast("long")), F.lit(0))).first()
    value = None if lost or not n else surprise_of(int(n), int(m), int(f), int(inside))
    return nodes.sparkSession.createDataFrame([(None if value is None else round(value, 4),)], "surprise double")


def partition_shape(partition: DataFrame) -> DataFrame:
    """One row of the communities' sizes: quartiles are the sorted sizes at n//4, n//2, 3n//4."""
    sizes = partition.groupBy("community_id").agg(F.count(F.lit(1)).alias("s"))
    every = sizes.agg(F.array_sort(F.collect_list("s")).alias("z"))  # one number a community
    n = F.size("z")
    at = lambda i: F.try_element_at("z", (i + 1).cast("int"))
    total = F.aggregate("z", F.lit(0).cast("long"), lambda a, x: a + x)
    lone = F.size(F.filter("z", lambda x: x == 1))
    return every.select(n.cast("long").alias("n_communities"), lone.cast("long").alias("n_singletons"), F.array_max("z").alias("biggest"), F.array_min("z").alias("smallest"),
                        F.round(total / n, 6).alias("mean_size"), at(F.floor(n / 2)).alias("median_size"), at(F.floor(n / 4)).alias("q1_size"), at(F.floor(F.lit(3) * n / 4)).alias("q3_size"),
                        F.round(F.array_max("z") / total, 6).alias("largest_fraction"), F.round(lone / n, 6).alias("singleton_fraction"))
