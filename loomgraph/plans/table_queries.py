"""Queries over stored tables: upserts, pruning, inventories, answers, cards."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recovery
from ..functions import text as tx
from ..operators import decay as dk
from ..operators import evaluate as ev
from ..operators import graph as gx
from ..operators import ingest as ig
from ..operators import publish as pb
from ..operators import render as rd
from ..operators import tokens as tk
from ..operators import vectors as vx
from .base import Registry, read
from .graph_queries import _CARDS, _TRADE, order_cards, trade

R = Registry()


@R.add("SELECT vec_id, CASE WHEN label = 3 THEN 103 ELSE label END AS label FROM embeddings")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return vx.upsert(emb, emb.where("label = 3").withColumn("label", F.lit(103)), "vec_id").select("vec_id", "label")


@R.add("SELECT vec_id, label FROM embeddings WHERE label <> 3")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    return vx.delete_documents(emb, emb.where("label = 3"), "label").select("vec_id", "label")


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vx.not_embedded(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"))


@R.add(f"""WITH {_TRADE}, k AS (SELECT node_id FROM d ORDER BY degree DESC, node_id LIMIT 400)
SELECT src, dst FROM g WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k)""")
def viz_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the 400 most linked nodes: the drawing's pruning."""
    nodes, edges, _ = trade(spark, sf_dir)
    _, inside = pb.graph_payload(nodes.withColumns({"entity_type": F.lit(None).cast("string"), "node_type": F.lit("x")}), edges, 400)
    return inside.select("src", "dst")


@R.add("""SELECT 'region' AS "table", count(*) AS n_rows, 'r_regionkey,r_name' AS columns FROM region UNION ALL SELECT 'nation', count(*), 'n_nationkey,n_name,n_regionkey' FROM nation
UNION ALL SELECT 'labels', count(*), 'doc_id,quality,toxic' FROM labels""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pb.inventory(**{t: read(spark, sf_dir, t) for t in ("region", "nation", "labels")})


@R.add("SELECT 'cards/' || doc_id || '.md' AS path, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def publish_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("cards/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return pb.manifest(d)


@R.add("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE source END AS topic FROM documents""")
def answer_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of answers: plain, fenced, inside prose, and none."""
    obj = F.concat(F.lit('{"topics": ["'), F.col("source"), F.lit('"]}'))
    said = F.when(F.col("doc_id") % 4 == 0, obj).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(
        F.col("doc_id") % 4 == 2, F.concat(F.lit("Here it is: "), obj, F.lit(" - done"))).otherwise(F.lit("no answer"))
    d = read(spark, sf_dir, "documents").select("doc_id", recovery.recovered_json(said).alias("j"))
    return d.select("doc_id", F.from_json("j", "topics array<string>")["topics"][0].alias("topic"))


@R.add("SELECT c_custkey, c_name AS title, c_mktsegment AS tag FROM customer")
def card_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards written and parsed again."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"), F.array("c_mktsegment").alias("tags"))
    parsed = c.select("c_custkey", rd.split_card(rd.card_markdown(c)).alias("s"))
    return parsed.select("c_custkey", rd.front_value(F.col("s.front"), "title").alias("title"), rd.front_list(F.col("s.front"), "tags")[0].alias("tag"))


@R.add(f"""WITH {_CARDS}, e AS (SELECT o_orderkey::VARCHAR AS newer, old::VARCHAR AS older FROM c WHERE old IS NOT NULL)
SELECT 'doc::' || newer AS src, 'doc::' || older AS dst, 'supersedes' AS relation FROM e""")
def supersession_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a pass that runs twice: each pair once."""
    pairs = dk.supersession_pairs(order_cards(spark, sf_dir))
    none = spark.createDataFrame([], "src string, dst string, relation string, confidence string")
    return dk.supersession_edges(dk.supersession_edges(none, pairs), pairs).select("src", "dst", "relation")


@R.add(f"WITH {_TRADE} SELECT dst AS node_id, count(*) AS backlinks FROM g GROUP BY dst")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gx.backlinks(trade(spark, sf_dir)[1])


@R.add("""WITH q AS (SELECT text AS question, min(conv_id * 1000 + turn) AS position FROM conversations WHERE role = 'user' GROUP BY text)
SELECT question, position, min(c.text) AS context FROM q LEFT JOIN conversations c ON c.role <> 'user' AND c.conv_id * 1000 + c.turn = position + 1 GROUP BY ALL""")
def test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of conversations, repeated ones once, the first kept, with the answer that follows."""
    c = read(spark, sf_dir, "conversations").withColumn("position", F.col("conv_id") * 1000 + F.col("turn"))
    rows = c.where("role = 'user'").select("position", F.col("text").alias("question"), (F.col("position") + 1).cast("string").alias("seed_chunk"))
    chunks = c.where("role <> 'user'").groupBy(F.col("position").cast("string").alias("chunk_id")).agg(F.min("text").alias("text"))
    return ev.load_test_set(rows, chunks).select("question", "position", "context")


@R.add("SELECT round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM labels")
def judged_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.judged_means(read(spark, sf_dir, "labels"), ["quality", "toxic"])


@R.add("SELECT event_id, CASE WHEN v >= 3000 THEN 'digital' WHEN g AND q THEN 'slow_ocr' WHEN g THEN 'vlm' ELSE 'ocr' END AS strategy FROM (SELECT event_id, value * 10 AS v, user_id % 2 = 0 AS g, user_id % 3 = 0 AS q FROM events)")
def extraction_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", ig.strategy(F.col("value") * 10, F.col("user_id") % 2 == 0, F.col("user_id") % 3 == 0, F.lit(False)).alias("strategy"))


@R.add("SELECT sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents")
def total_chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.total_cost(read(spark, sf_dir, "documents"))


@R.add("SELECT doc_id, list_transform(range(0, 3), lambda i: 'd' || (doc_id + i)) AS links FROM documents")
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(*[F.concat(F.lit(" [[d"), (F.col("doc_id") + i).cast("string"), F.lit("|title]] [[folder/x]]")) for i in range(3)])
    return read(spark, sf_dir, "documents").select("doc_id", tx.wikilinks(F.concat(F.col("text"), text)).alias("links"))


@R.add("""SELECT doc_id, CASE WHEN l IN (0, 1) THEN 'A B C D E F' WHEN l = 2 THEN 'A B' ELSE 'plain' END AS label FROM (SELECT doc_id, doc_id % 4 AS l FROM documents)""")
def label_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("doc_id") % 4
    raw = F.when(m == 0, F.lit('Name: "A B C D E F G"\nwhy')).when(m == 1, F.lit("topical name:  A B C D E F G H")).when(m == 2, F.lit("`A B`")).otherwise(F.lit(" plain "))
    return read(spark, sf_dir, "documents").select("doc_id", tx.clean_label(raw).alias("label"))


@R.add("SELECT page_id, length(html) AS n FROM pages")
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped into pages and unescaped again keep their lengths."""
    p = read(spark, sf_dir, "pages").select("page_id", rd.html_page(F.col("url"), [("url", F.col("url"))], F.col("html")).alias("page"))
    body = F.regexp_extract("page", r"(?s)<pre>(.*)</pre>", 1)
    for mark, code in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("&", "&amp;")):
        body = F.replace(body, F.lit(code), F.lit(mark))
    return p.select("page_id", F.length(body).cast("long").alias("n"))
