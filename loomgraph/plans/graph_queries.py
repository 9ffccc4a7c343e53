"""Queries over the graph of the star schema: orders are documents, customers authors,
parts topics; suppliers and parts form the graph whose communities are measured."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blockmodel as sbm
from ..operators import community as cm
from ..operators import graph as gx
from ..operators.leiden import connected, proposals, symmetric
from ..stage import Stage
from .base import Registry, read

R = Registry()


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's author and topics, in the shape of extracted entities."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    row = lambda doc, pos, kind, name: (F.col(doc).alias("doc_id"), pos.alias("pos"), F.lit(kind).alias("type"), name.alias("name"))
    authors = orders.select(*row("o_orderkey", F.lit(0), "author", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))))
    topics = items.select(*row("l_orderkey", F.col("l_linenumber"), "topic", F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))))
    both = authors.unionByName(topics)
    key = F.when(F.col("type") == "author", gx.ids.author_key(F.col("name"))).otherwise(gx.ids.topic_key(F.col("name")))
    return both.select("doc_id", "pos", "type", "name", key.alias("key"), F.lit("EXTRACTED").alias("confidence"), F.lit("table").alias("source"))


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("year"))


_ENT = """e AS (SELECT o_orderkey AS doc_id, 'author' AS type, 'Customer ' || o_custkey AS name, 'author::customer_' || o_custkey AS key FROM orders
UNION SELECT l_orderkey, 'topic', 'Part ' || l_partkey, 'topic::part_' || l_partkey FROM lineitem)"""


@R.add(f"""WITH {_ENT} SELECT 'doc::' || o_orderkey AS node_id, 'document' AS node_type, NULL AS entity_type, NULL AS name, nullif(o_orderpriority, '') AS title, year(o_orderdate)::INT AS year FROM orders
UNION ALL SELECT DISTINCT key, 'entity', type, name, NULL, NULL FROM e""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = gx.build_graph(order_docs(spark, sf_dir), entities(spark, sf_dir))
    return nodes.select("node_id", "node_type", "entity_type", "name", "title", "year")


@R.add(f"""WITH {_ENT} SELECT 'doc::' || doc_id AS src, key AS dst, CASE type WHEN 'author' THEN 'authored_by' ELSE 'about' END AS relation, 'EXTRACTED' AS confidence FROM e
UNION ALL SELECT a.key, b.key, 'co_mentioned_in', 'INFERRED' FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.key < b.key""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = gx.build_graph(order_docs(spark, sf_dir), entities(spark, sf_dir))
    return edges.select("src", "dst", "relation", "confidence")


@R.add(f"""WITH {_ENT}, k AS (SELECT doc_id, list_sort(list(key)) AS k FROM e GROUP BY doc_id), p AS (SELECT doc_id, k, unnest(range(1, len(k) + 1)) AS i FROM k)
SELECT doc_id, k[i] AS a, unnest(k[i + 1:]) AS b FROM p""")
def co_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gx.co_mentions(entities(spark, sf_dir))


@R.add("""WITH t AS (SELECT DISTINCT l_orderkey AS d, l_partkey AS e FROM lineitem), w AS (
SELECT 'doc::' || a.d AS x, 'doc::' || b.d AS y, 1.0 AS w FROM t a JOIN t b ON a.e = b.e AND a.d <> b.d AND 'doc::' || a.d < 'doc::' || b.d
UNION ALL SELECT least(s, p), greatest(s, p), 5.0 FROM (SELECT 'doc::' || o_orderkey AS s, 'doc::' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NOT NULL)
SELECT x AS a, y AS b, sum(w)::DOUBLE AS weight FROM w GROUP BY ALL""")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked by the parts they share, and by a citation of the customer's last order."""
    from pyspark.sql import Window

    touch = read(spark, sf_dir, "lineitem").select(gx.ids.doc_node(F.col("l_orderkey")).alias("src"), F.concat(F.lit("topic::"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("about").alias("relation"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    cites = read(spark, sf_dir, "orders").select(gx.ids.doc_node(F.col("o_orderkey")).alias("src"), gx.ids.doc_node(F.lag("o_orderkey").over(w)).alias("dst"), F.lit("cites").alias("relation")).where("dst is not null")
    return gx.project(touch.unionByName(cites).withColumn("similarity", F.lit(None).cast("double")))


# --- suppliers and parts ------------------------------------------------------------------

def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges with weight, partition) of parts and the suppliers that ship them."""
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("p::"), F.col("p_partkey").cast("string")).alias("node_id"), (F.col("p_size") % 25).cast("int").alias("community_id"))
    suppliers = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s::"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_nationkey").cast("int").alias("community_id"))
    part = parts.unionByName(suppliers)
    counted = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return part.select("node_id"), counted.select(*_ends(), "weight"), part


def _ends() -> tuple[Column, Column]:
    """The part and the supplier of a row of lineitem, as nodes; rows are counted by their numbers, which are shorter."""
    node = lambda kind, col: F.concat(F.lit(f"{kind}::"), F.col(col).cast("string"))
    return node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst")


_TRADE = """p AS (SELECT 'p::' || p_partkey AS node_id, (p_size % 25)::INT AS community_id FROM part UNION ALL SELECT 's::' || s_suppkey, s_nationkey::INT FROM supplier),
g AS (SELECT 'p::' || l_partkey AS src, 's::' || l_suppkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
u AS (SELECT src AS a, dst AS b, weight FROM g UNION ALL SELECT dst, src, weight FROM g),
d AS (SELECT p.node_id, count(u.a) AS degree FROM p LEFT JOIN u ON u.a = p.node_id GROUP BY p.node_id)"""
_HUBS = "h AS (SELECT d.* FROM d, (SELECT list_sort(list(degree)) AS z FROM d) WHERE degree >= z[round_even(0.99 * (len(z) - 1), 0)::BIGINT + 1])"


@R.add(f"WITH {_TRADE} SELECT node_id, degree FROM d")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = trade(spark, sf_dir)
    return gx.degrees(nodes, edges)


@R.add(f"WITH {_TRADE}, {_HUBS} SELECT node_id, degree FROM h")
def hubs_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = trade(spark, sf_dir)
    return gx.percentile_core(gx.degrees(nodes, edges), 99.0).select("node_id", "degree")


@R.add(f"""WITH {_TRADE}, i AS (SELECT g.* FROM g JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst WHERE a.community_id = b.community_id),
x AS (SELECT src AS n FROM i UNION ALL SELECT dst FROM i), k AS (SELECT community_id, p.node_id, count(x.n) AS degree FROM p LEFT JOIN x ON x.n = p.node_id GROUP BY ALL),
z AS (SELECT community_id, list_sort(list(degree)) AS z FROM k GROUP BY ALL)
SELECT community_id, node_id, degree FROM k JOIN z USING (community_id) WHERE len(z) >= 3 AND degree >= z[round_even(0.75 * (len(z) - 1), 0)::BIGINT + 1]""")
def core_nodes_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, part = trade(spark, sf_dir)
    return cm.core_nodes(part, edges).select("community_id", "node_id", "degree")


@R.add(f"""WITH {_TRADE}, {_HUBS}, v AS (SELECT h.node_id, p.community_id, count(*) AS v FROM h JOIN u ON u.a = h.node_id JOIN p ON p.node_id = u.b WHERE p.node_id NOT IN (SELECT node_id FROM h) GROUP BY ALL),
w AS (SELECT node_id, arg_max(community_id, v * 1000000 - community_id) AS community_id FROM v GROUP BY node_id)
SELECT * FROM w UNION ALL SELECT node_id, (SELECT max(community_id) FROM p WHERE node_id NOT IN (SELECT node_id FROM h)) + (row_number() OVER (ORDER BY node_id))::INT FROM h WHERE node_id NOT IN (SELECT node_id FROM w)""")
def reattach(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, part = trade(spark, sf_dir)
    stage = Stage(spark, "reattach")
    edges = stage.write(edges.select("src", "dst"), "edges")
    hubs = stage.write(gx.percentile_core(stage.write(gx.degrees(nodes, edges), "degrees"), 99.0).select("node_id"), "hubs")
    return gx.majority_reattach(hubs, edges, part.join(hubs, "node_id", "left_anti"))


@R.add(f"WITH {_TRADE}, {_HUBS} SELECT src, dst, weight FROM g WHERE src NOT IN (SELECT node_id FROM h) AND dst NOT IN (SELECT node_id FROM h)")
def hub_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = trade(spark, sf_dir)
    hubs = gx.percentile_core(gx.degrees(nodes, edges), 99.0).select("node_id")
    return gx.without_nodes(edges, hubs).select("src", "dst", "weight")


@R.add(f"""WITH {_TRADE} SELECT (SELECT count(*) FROM p) AS n_nodes, (SELECT count(*) FROM g) AS n_edges, round(2.0 * (SELECT count(*) FROM g) / ((SELECT count(*) FROM p) * ((SELECT count(*) FROM p) - 1)), 6) AS density,
round((SELECT sum(degree) FROM d) / (SELECT count(*) FROM p), 6) AS avg_degree, (SELECT max(degree) FROM d) AS max_degree, (SELECT count(*) FROM d WHERE degree = 0) AS n_isolated""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = trade(spark, sf_dir)
    return gx.graph_metrics(nodes, edges)


@R.add("""WITH s AS (SELECT n_regionkey, 1 + count(DISTINCT n_nationkey) + count(c_custkey) AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT count(*) AS n_components, round(max(s) / sum(s), 6) AS largest_fraction FROM s""")
def component_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gx.component_metrics(*places(spark, sf_dir))


@R.add(f"""WITH {_ENT} SELECT 'document' AS node_type, NULL AS entity_type, count(*) AS n FROM orders UNION ALL SELECT 'entity', type, count(DISTINCT key) FROM e GROUP BY type""")
def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gx.by_type(gx.build_graph(order_docs(spark, sf_dir), entities(spark, sf_dir))[0])


@R.add(f"""WITH {_ENT}, x AS (SELECT doc_id, count(*) AS k FROM e GROUP BY doc_id) SELECT CASE type WHEN 'author' THEN 'authored_by' ELSE 'about' END AS relation, count(*) AS n FROM e GROUP BY type
UNION ALL SELECT 'co_mentioned_in', sum(k * (k - 1) // 2)::BIGINT FROM x""")
def edges_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gx.by_relation(gx.build_graph(order_docs(spark, sf_dir), entities(spark, sf_dir))[1])


@R.add(f"""WITH {_TRADE}, m AS (SELECT sum(weight) AS m FROM g), k AS (SELECT community_id, sum(weight) AS k FROM u JOIN p ON node_id = a GROUP BY 1),
i AS (SELECT a.community_id, sum(weight) AS i FROM g JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst WHERE a.community_id = b.community_id GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / m - (k / (2 * m)) ** 2), 6) AS modularity FROM k LEFT JOIN i USING (community_id), m""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sale is a link of its own; the sums are those of the counted ones, and no task holds pairs."""
    _, _, part = trade(spark, sf_dir)
    sales = read(spark, sf_dir, "lineitem").select(*_ends())
    return gx.modularity(sales.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight")), part)


@R.add(f"""WITH {_TRADE}, n AS (SELECT (SELECT count(*) FROM p)::DOUBLE AS n, (SELECT count(*) FROM g)::BIGINT AS m,
(SELECT sum(s * (s - 1) / 2) FROM (SELECT count(*) AS s FROM p GROUP BY community_id))::BIGINT AS f,
(SELECT count(*) FROM g JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst WHERE a.community_id = b.community_id)::BIGINT AS k),
q AS (SELECT (n * (n - 1) / 2)::BIGINT AS big, m, f, k FROM n), x AS (SELECT big, m, f, unnest(range(k, least(f, m) + 1)) AS x FROM q),
l AS (SELECT lgamma(f + 1) - lgamma(x + 1) - lgamma(f - x + 1) + lgamma(big - f + 1) - lgamma(m - x + 1) - lgamma(big - f - (m - x) + 1) - (lgamma(big + 1) - lgamma(m + 1) - lgamma(big - m + 1)) AS l FROM x)
SELECT round(-((SELECT max(l) FROM l) + ln(sum(exp(l - (SELECT max(l) FROM l))))) / ln(10), 4) AS surprise FROM l""")
def surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, part = trade(spark, sf_dir)
    return gx.surprise(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), part)


@R.add()
def louvain_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = trade(spark, sf_dir)
    return cm.LouvainBackend().cluster(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")).partition


@R.add("""WITH t AS (SELECT 'nation::' || s_nationkey AS a, 'part::' || l_partkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT count(DISTINCT x)::BIGINT AS n_nodes, 0::BIGINT AS n_disconnected, 0::BIGINT AS n_movable FROM (SELECT a AS x FROM t UNION ALL SELECT b FROM t)""")
def leiden_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and the parts that their suppliers sold, partitioned by Leiden: every node has a
    community, every community is connected, and no node's move raises the quality."""
    nodes, edges = sales(spark, sf_dir)
    stage = Stage(spark, "leiden-query")
    links = stage.write(symmetric(edges), "links")
    part = cm.LeidenBackend().cluster(nodes, edges).partition
    part = stage.write(part.select("node_id", F.col("community_id").alias("c")), "part")
    apart = connected(part, links, stage)
    pieces = part.select("node_id", F.col("c").alias("of")).join(apart, "node_id").groupBy("of").agg(F.count_distinct("c").alias("n")).where("n > 1")
    k = links.groupBy(F.col("a").alias("n")).agg(F.sum("w").alias("k"))
    movable = proposals(links, k, part.withColumnRenamed("node_id", "n"), links.agg(F.sum("w")).first()[0], 1.0).where("gain > 1e-6")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(part, "n_nodes").crossJoin(count(pieces, "n_disconnected")).crossJoin(count(movable, "n_movable"))


@R.add("""WITH t AS (SELECT DISTINCT 'nation::' || s_nationkey AS a, 'part::' || l_partkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
SELECT count(DISTINCT x)::BIGINT AS n_nodes, true AS nested, true AS shorter, true AS sums FROM (SELECT a AS x FROM t UNION ALL SELECT b FROM t)""")
def block_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph under the nested block model: every node has a path of blocks, each block lies in
    one block of the level above up to a single one, the description length is below that of
    one block over all and is the sum of its levels."""
    nodes, edges = sales(spark, sf_dir)
    stage = Stage(spark, "block-query")
    links = stage.write(symmetric(edges, weighted=False), "links")
    out = cm.BlockModelBackend().cluster(nodes, edges)
    part = stage.write(out.partition, "part")
    depth = len(out.metrics["blocks_per_level"])
    ups = part.select(F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col("path")[k].alias("b"), F.col("path")[k + 1].alias("up")) for k in range(depth - 1)))).alias("x")).select("x.*") if depth > 1 else None
    nested = ups is None or not ups.groupBy("level", "b").agg(F.count_distinct("up").alias("n")).where("n > 1").limit(1).count()
    whole = stage.write(nodes.select(F.col("node_id").alias("n")).join(links.select(F.col("a").alias("n")), "n", "left_semi"), "linked")
    flat, _ = sbm.Fit(stage, "flat", links, whole, True).length(whole.withColumn("c", F.lit("all")))
    m = out.metrics
    return part.where(F.size("path") == depth).agg(F.count(F.lit(1)).alias("n_nodes")).withColumns({
        "nested": F.lit(bool(nested and m["blocks_per_level"][-1] == 1)), "shorter": F.lit(m["mdl_nats"] <= flat + 1e-6), "sums": F.lit(abs(m["mdl_nats"] - sum(m["mdl_per_level"])) < 1e-6)})


@R.add()
def routed_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A router held below the block model; it takes the best that is allowed."""
    nodes, edges, _ = trade(spark, sf_dir)
    router = cm.Router([cm.BlockModelBackend(), cm.LouvainBackend(), cm.KMeansBackend()])
    out = router.cluster(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight"), ceiling=cm.Rigor.HEURISTIC)
    return out.partition.groupBy("community_id").agg(F.count(F.lit(1)).alias("n_members")).withColumns({"backend": F.lit(out.backend), "note": F.lit("; ".join(out.notes))})


def sales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links with weights): nations and the parts that their suppliers sold."""
    sold = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    node = lambda kind, col: F.concat(F.lit(f"{kind}::"), F.col(col).cast("string"))
    edges = sold.select(node("nation", "s_nationkey").alias("a"), node("part", "l_partkey").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    edges = Stage(spark, "sales").write(edges, "edges")
    return edges.select(F.col("a").alias("node_id")).unionByName(edges.select(F.col("b").alias("node_id"))).distinct(), edges


# --- regions, nations, customers ----------------------------------------------------------

def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): region to nation to customer."""
    node = lambda kind, col: F.concat(F.lit(f"{kind}::"), F.col(col).cast("string"))
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    edges = nation.select(node("region", "n_regionkey").alias("src"), node("nation", "n_nationkey").alias("dst")).unionByName(
        customer.select(node("nation", "c_nationkey").alias("src"), node("customer", "c_custkey").alias("dst")))
    nodes = read(spark, sf_dir, "region").select(node("region", "r_regionkey").alias("node_id")).unionByName(nation.select(node("nation", "n_nationkey").alias("node_id"))).unionByName(
        customer.select(node("customer", "c_custkey").alias("node_id")))
    return nodes, edges


@R.add("""WITH t AS (SELECT 'customer::' || c_custkey AS node_id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'nation::' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'region::' || r_regionkey, r_regionkey FROM region)
SELECT node_id, min(node_id) OVER (PARTITION BY r) AS component FROM t""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gx.connected_components(*places(spark, sf_dir))


@R.add("""SELECT 'region::0' AS node_id, 0 AS level UNION ALL SELECT 'nation::' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0
UNION ALL SELECT 'customer::' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0""")
def bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, _, _ = gx.bfs(places(spark, sf_dir)[1], spark.createDataFrame([("region::0",)], "node_id string"), 2)
    return seen


@R.add("""SELECT 'region::0' AS node_id, 0 AS level UNION ALL SELECT 'nation::' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0""")
def bfs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is looked at after a whole level, so the first level stays whole."""
    seen, _, _ = gx.bfs(places(spark, sf_dir)[1], spark.createDataFrame([("region::0",)], "node_id string"), 2, max_nodes=3)
    return seen


@R.add("""SELECT 'customer::' || c_custkey AS node_id, c_nationkey::INT AS community_id, [c_nationkey::INT, n_regionkey::INT] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def hierarchy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = read(spark, sf_dir, "customer").select(F.concat(F.lit("customer::"), F.col("c_custkey").cast("string")).alias("node_id"), F.col("c_nationkey").cast("int").alias("block"))
    up = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("node_id"), F.col("n_regionkey").cast("int").alias("block"))
    return cm.cascade([leaf, up])


@R.add("""SELECT 'customer::' || c_custkey AS node_id, c_nationkey::INT AS community_id, n_name AS label, c_mktsegment AS title FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def publish_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.publish import merge_communities

    c = read(spark, sf_dir, "customer")
    key = F.concat(F.lit("customer::"), F.col("c_custkey").cast("string")).alias("node_id")
    tables = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("community_id"), F.col("n_name").alias("label"))
    part = c.select(key, F.col("c_nationkey").cast("int").alias("community_id"), F.array(F.col("c_nationkey").cast("int")).alias("path"))
    return merge_communities(c.select(key, F.col("c_mktsegment").alias("title")), part, tables).select("node_id", "community_id", "label", "title")


# --- decay and supersession ------------------------------------------------------------------

_NOW = "1999-01-01"


def order_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.lit("active").alias("status"), F.lit(1.0).alias("relevance"),
                                                F.lit(365.0).alias("half_life_days"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_touched"),
                                                F.array(F.lag("o_orderkey").over(w).cast("string")).alias("supersedes"))


def first_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every order to the first of its customer."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(gx.ids.doc_node(F.col("o_orderkey")).alias("src"), gx.ids.doc_node(F.first("o_orderkey").over(w)).alias("dst"))


_CARDS = "c AS (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders)"
_LINKED = "b AS (SELECT f, count(*) AS b FROM (SELECT first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f FROM orders) GROUP BY f)"
_DECAYED = f"round(greatest(coalesce(b, 0), 1) * pow(0.5::DOUBLE, greatest(date_diff('day', o_orderdate::DATE, DATE '{_NOW}'), 0) / 365.0::DOUBLE), 4)"


@R.add(f"""WITH o AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS t FROM orders GROUP BY 1)
SELECT c_custkey, round(greatest(coalesce(n, 0), 1) * pow(0.5::DOUBLE, greatest(coalesce(date_diff('day', t::DATE, DATE '{_NOW}'), 0), 0) / 365.0::DOUBLE), 4) AS relevance FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def decay_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.decay import relevance

    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("t"))
    joined = read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return joined.select("c_custkey", F.round(relevance(F.col("n"), F.to_date("t"), F.lit(365.0), F.to_date(F.lit(_NOW))), 4).alias("relevance"))


@R.add(f"WITH {_CARDS} SELECT o_orderkey::VARCHAR AS newer, old::VARCHAR AS older FROM c WHERE old IS NOT NULL")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.decay import supersession_pairs

    return supersession_pairs(order_cards(spark, sf_dir)).where("reason is null").select("newer", "older")


@R.add(f"""WITH {_CARDS}, {_LINKED}, d AS (SELECT o_orderkey, {_DECAYED} AS r FROM c LEFT JOIN b ON b.f = o_orderkey), s AS (SELECT DISTINCT old FROM c WHERE old IS NOT NULL)
SELECT o_orderkey::VARCHAR AS doc_id, CASE WHEN s.old IS NULL THEN 'active' ELSE 'superseded' END AS status, CASE WHEN s.old IS NULL THEN r ELSE round((r * 0.1::DOUBLE)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE END AS relevance FROM d LEFT JOIN s ON s.old = o_orderkey""")
def decay_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.decay import decay_pass as run

    return run(order_cards(spark, sf_dir), first_cited(spark, sf_dir), F.to_date(F.lit(_NOW))).select("doc_id", "status", "relevance")


@R.add(f"""WITH {_CARDS}, {_LINKED}, d AS (SELECT o_orderkey, {_DECAYED} AS r FROM c LEFT JOIN b ON b.f = o_orderkey), s AS (SELECT DISTINCT old FROM c WHERE old IS NOT NULL),
x AS (SELECT o_orderkey, CASE WHEN s.old IS NULL THEN r ELSE round((r * 0.1::DOUBLE)::VARCHAR::DECIMAL(38, 20), 4)::DOUBLE END AS relevance FROM d LEFT JOIN s ON s.old = o_orderkey)
SELECT o_orderkey::VARCHAR AS doc_id, relevance FROM x WHERE relevance < 0.1""")
def archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.decay import archive_candidates as scan

    return scan(decay_pass(spark, sf_dir)).select("doc_id", "relevance")
