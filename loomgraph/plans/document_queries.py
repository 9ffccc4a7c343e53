"""Queries over texts, files, URLs, logs: ingest, chunks, tokens, labels, BM25."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ids
from ..functions import chunking as ch
from ..functions import text as tx
from ..operators import community as cm
from ..operators import evaluate as ev
from ..operators import graph as gx
from ..operators import ingest as ig
from ..operators import profiles as px
from ..operators import retrieve as rt
from ..operators import tokens as tk
from ..sources import files as sf
from .base import Registry, read

R = Registry()
#: A contract that asks for nothing; the driver's documents have no records.
NOTHING = {"internal_doc": px.Profile("internal_doc", (px.FieldSpec("title", False),))}


def filename():
    """A file name for each document: a preprint's, another server's, or neither."""
    n = F.lpad(F.col("doc_id").cast("string"), 5, "0")
    return (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2401."), n, F.lit("v2.pdf")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("2023.05.06.1"), n, F.lit(".full.pdf"))).otherwise(F.concat(F.lit("note_"), n, F.lit(".md"))))


_FILE = """CASE doc_id % 3 WHEN 0 THEN '2401.' || lpad(doc_id::VARCHAR, 5, '0') || 'v2.pdf' WHEN 1 THEN '2023.05.06.1' || lpad(doc_id::VARCHAR, 5, '0') || '.full.pdf'
ELSE 'note_' || lpad(doc_id::VARCHAR, 5, '0') || '.md' END"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, in the shape that ingest takes."""
    return read(spark, sf_dir, "documents").select(
        F.format_string("%09d", "doc_id").alias("path"), F.format_string("note_%d.md", "doc_id").alias("filename"), F.col("source").alias("subdir"), F.lit(".md").alias("suffix"),
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("content_hash"), "text")


@R.add("SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1")
def exact_dedup_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a folder: each content, its first file and its copies."""
    raw = read(spark, sf_dir, "documents").select(F.format_string("/corpus/%s/%d.md", "source", "doc_id").alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    number = F.regexp_extract("filename", r"^(\d+)\.md$", 1).cast("long")
    return sf.describe(raw, "/corpus").groupBy("content_hash").agg(F.min(number).alias("first_doc"), F.count(F.lit(1)).alias("n"))


@R.add("""WITH k AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
d AS (SELECT sha256(text) IN (SELECT h FROM k) AS known, length(text) >= 200 AS ok, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents)
SELECT CASE WHEN known THEN 'duplicate' WHEN NOT ok THEN 'quarantined' WHEN r = 1 THEN 'ingested' ELSE 'duplicate' END AS status, count(*) AS n FROM d GROUP BY 1""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of ingest over all documents, under a contract that asks for nothing: the
    cascade's order decides between duplicate and quarantined. The toxic ones were there before."""
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    known = read(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi").select(F.sha2("text", 256).alias("hash"))
    return ig.status_counts(ig.ingest(files(spark, sf_dir), known, profiles=NOTHING, whole=False))


@R.add("SELECT doc_id, 'extract_yield_too_low:' || length(text) || '<200' AS reason FROM documents WHERE length(text) < 200")
def qc_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ig.extract_yield(F.length("text")).alias("reason")).where("reason is not null")


@R.add("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN n_chars < 200 THEN 'extract_yield_too_low:' || n_chars || '<200' WHEN n_chars / (doc_id % 4 * 7) < 50.0
THEN printf('extract_yield_per_page_too_low:%.1f<50.0', n_chars / (doc_id % 4 * 7)) END AS reason FROM documents""")
def qc_yield_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    pages = F.col("doc_id") % 4 * 7
    return d.select("doc_id", F.when(F.col("doc_id") % 4 != 0, ig.extract_yield(F.col("n_chars"), pages)).alias("reason"))


@R.add(f"SELECT doc_id, {_FILE} AS filename, CASE doc_id % 3 WHEN 0 THEN 'arxiv_paper' WHEN 1 THEN 'biorxiv_paper' ELSE 'internal_doc' END AS profile FROM documents")
def profile_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", filename().alias("filename")).withColumn("profile", px.route(F.col("filename")))


@R.add(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2401.' || lpad(doc_id::VARCHAR, 5, '0') END AS arxiv_id, CASE WHEN doc_id % 3 = 1 THEN '10.1101/2023.05.06.1' || lpad(doc_id::VARCHAR, 5, '0') END AS doi,
CASE WHEN doc_id % 3 = 1 THEN 2023 END AS year FROM documents""")
def id_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", filename().alias("f"))
    return d.select("doc_id", tx.arxiv_id(F.col("f")).alias("arxiv_id"), tx.biorxiv_doi(F.col("f")).alias("doi"), tx.doi_year(tx.biorxiv_doi(F.col("f"))).alias("year"))


@R.add("""SELECT doc_id, q IS NOT NULL AND source <> '' AS passed, nullif(concat_ws(',', CASE WHEN q IS NULL THEN 'quality' END, CASE WHEN source = '' THEN 'source' END), '') AS missing
FROM (SELECT d.doc_id, d.source, l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id))""")
def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    contract = px.Profile("labelled", (px.FieldSpec("title", False), px.FieldSpec("quality", True, "int"), px.FieldSpec("source", True, "str")))
    v = px.validate(d, contract)
    return d.select("doc_id", v["passed"].alias("passed"), F.nullif(F.array_join(v["missing"], ","), F.lit("")).alias("missing"))


@R.add("""WITH p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^./](\\.[^./]+)$', 1)) AS s FROM pages)
SELECT page_id, CASE WHEN s NOT IN ('.pdf', '.html', '.htm', '.txt', '.md') THEN 'unsupported_format:' || CASE s WHEN '' THEN 'none' ELSE s END END AS reason FROM p""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    name = F.regexp_replace("url", "[?#].*$", "")
    sfx = F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))
    return p.select("page_id", ig.preflight(sfx, F.octet_length("html")).alias("reason"))


@R.add("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ftp://x.example.com/a' WHEN 1 THEN 'http://192.168.' || page_id % 256 || '.7/a' WHEN 2 THEN 'http://LOCALHOST:80/' ELSE url END AS url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'disallowed_scheme:ftp' WHEN 1 THEN 'blocked_ip:192.168.' || page_id % 256 || '.7' WHEN 2 THEN 'blocked_host_literal:localhost' END AS reason, page_id % 5 > 2 AS allowed FROM p""")
def url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("page_id") % 5
    url = F.when(m == 0, F.lit("ftp://x.example.com/a")).when(m == 1, F.format_string("http://192.168.%d.7/a", F.col("page_id") % 256)).when(m == 2, F.lit("http://LOCALHOST:80/")).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", tx.url_gate(url).alias("g")).select("page_id", "g.reason", "g.allowed")


@R.add(r"""WITH b AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[2:], chr(10)) AS b FROM documents), f AS (SELECT doc_id,
regexp_matches(b, '(?m)^\s*(?:\d+\s+)?(?:Title:\s*)?[A-Z][^\n]{15,200}$') AS t,
regexp_matches(b, '\b[A-Z][a-z][\p{L}\p{N}_''.-]*(?:\s+[A-Z][a-z][\p{L}\p{N}_''.-]*)*\s*[,\d*]*\s*,\s*[A-Z][a-z][\p{L}\p{N}_''.-]*(?:\s+[A-Z][a-z][\p{L}\p{N}_''.-]*)*\b')
OR regexp_matches(b, '\b[A-Z][a-z][\p{L}\p{N}_''.-]*(?:\s+[A-Z][a-z][\p{L}\p{N}_''.-]*)*\d+') OR regexp_matches(b, '\b[A-Z][a-z][\p{L}\p{N}_''.-]*\s+[A-Z][a-z][\p{L}\p{N}_''.-]*\b[^\n]*@') AS a,
regexp_matches(b, '\b[Aa]bstract\b|\bSUMMARY\b') OR regexp_matches(b, '\n\s*\n([^\n]{250,})') AS s FROM b)
SELECT doc_id, CASE WHEN t AND a AND s THEN 'pass' WHEN t AND a THEN 'flag' ELSE 'defer' END AS class, t AS has_title, s AS has_abstract FROM f""")
def triage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ig.triage(F.col("text"), skip_lines=1).alias("t")).select("doc_id", "t.class", "t.has_title", "t.has_abstract")


@R.add("""SELECT doc_id, coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'unknown') AS reason_slug FROM documents""")
def quarantine_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ids.reason_slug(F.col("text")).alias("reason_slug"))


@R.add(r"""WITH s AS (SELECT doc_id, text AS t FROM documents)
SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(lower(regexp_replace(t, '^\s+|\s+$', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_'), 100), ''), 'unknown') AS graph_slug,
coalesce(nullif(rtrim(left(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), 64), '-'), ''), 'untitled') AS vault_slug FROM s""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", ids.slug(t).alias("graph_slug"), ids.vault_slug(t).alias("vault_slug"))


@R.add("""SELECT doc_id AS n, source || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || (row_number() OVER w - 1) END AS doc_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), F.concat("source", F.lit(".md")).alias("filename"))
    return ig.doc_ids(d, "filename", "n").select("n", "doc_id")


@R.add("""WITH w AS (SELECT doc_id AS n, CASE WHEN doc_id % 50 = 0 THEN source || '-' || (1 + doc_id % 7) ELSE source END AS stem FROM documents),
r AS (SELECT n, stem, row_number() OVER (PARTITION BY stem ORDER BY n) - 1 AS r FROM w),
u AS (SELECT DISTINCT stem FROM w),
g AS (SELECT stem, unnest(range(1, k + 1)) AS i FROM (SELECT stem, count(*) + (SELECT count(*) FROM u) AS k FROM w GROUP BY stem)),
f AS (SELECT g.stem, i, row_number() OVER (PARTITION BY g.stem ORDER BY i) AS r FROM g LEFT JOIN u ON u.stem = g.stem || '-' || i WHERE u.stem IS NULL)
SELECT n, CASE WHEN r.r = 0 THEN r.stem ELSE r.stem || '-' || i END AS doc_id FROM r LEFT JOIN f ON f.stem = r.stem AND f.r = r.r""")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from names some of which look like another name with a suffix."""
    n = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select(n.alias("n"), F.when(n % 50 == 0, F.concat("source", F.lit("-"), (1 + n % 7).cast("string"))).otherwise(F.col("source")).alias("stem"))
    return ig.doc_ids(d.withColumn("filename", F.concat("stem", F.lit(".md"))), "filename", "n").select("n", "doc_id")


@R.add("""WITH RECURSIVE d AS (SELECT doc_id, repeat('a', 3 * length(text)) AS t FROM documents), k AS (SELECT doc_id, length(t) AS n, unnest(range(0, greatest(1, ((length(t) - 400 + 2599) // 2600)))) AS i FROM d)
SELECT doc_id, i::INT AS ordinal, (i * 2600)::INT AS start_offset, least(i * 2600 + 3000, n)::INT AS end_offset FROM k WHERE n > 0""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without break points: chunks begin at multiples of 2600."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.expr("repeat('a', 3 * length(text))").alias("text"))
    return ch.chunk_documents(d).select("doc_id", "ordinal", "start_offset", "end_offset")


@R.add()
def chunk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chunk_documents(read(spark, sf_dir, "documents")).drop("text")


@R.add("SELECT doc_id, length(text) AS total_chars, length(text) AS covered_chars, 0::BIGINT AS n_gaps, true AS passed FROM documents")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return ch.coverage(ch.chunk_documents(d), d.select("doc_id", F.length("text").alias("total_chars"))).drop("coverage_pct")


@R.add("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


@R.add()
def math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.math_spans(F.col("text")).alias("m")).select("doc_id", "m.real", "m.broken", tx.math_retry(F.col("m.real"), F.col("m.broken")).alias("retry"))


@R.add("""SELECT doc_id, 'citation::smith_' || (1990 + doc_id % 30) AS key, 'Smith ' || (1990 + doc_id % 30) AS name FROM documents
UNION ALL SELECT doc_id, 'citation::doi_10_1234_x' || doc_id % 7, '10.1234/X' || doc_id % 7 FROM documents""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, doi = (F.lit(1990) + F.col("doc_id") % 30).cast("string"), F.concat(F.lit("10.1234/X"), (F.col("doc_id") % 7).cast("string"))
    cited = F.concat(F.col("text"), F.lit(" see [Smith "), year, F.lit("] and [Smith "), year, F.lit("a], doi "), doi, F.lit(" end"))
    d = read(spark, sf_dir, "documents").select("doc_id", cited.alias("text"))
    return gx.extract_entities(d, authors=None, topics=None).select("doc_id", "key", "name")


@R.add()
def metadata_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.metadata import extract

    return read(spark, sf_dir, "documents").select("doc_id", extract("text").alias("r")).select("doc_id", "r.*")


@R.add(r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) AS w FROM documents),
dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
n AS (SELECT count(*)::DOUBLE AS n, (SELECT sum(dl) FROM dl)::DOUBLE / count(*) AS avgdl FROM documents), i AS (SELECT w, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
x AS (SELECT w, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM i) ELSE raw END AS idf FROM i WHERE w IN ('licensed', 'version', 'token')),
s AS (SELECT doc_id, sum(CASE w WHEN 'token' THEN 2 ELSE 1 END * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN x USING (w) JOIN dl USING (doc_id), n GROUP BY doc_id)
SELECT doc_id, round(s, 6) AS score FROM s WHERE s > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.bm25_top(read(spark, sf_dir, "documents"), "licensed version token token", 10)


@R.add(r"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents), o AS (SELECT doc_id, lower(title) AS t, list_distinct(list_filter(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+'), lambda w: length(w) > 1)) AS w FROM d)
SELECT doc_id, round(len(list_intersect(w, ['than', 'thon', 'was'])) / 3.0::DOUBLE + CASE WHEN contains(t, 'the than was thon') THEN 1 ELSE 0 END, 6) AS overlap FROM o
ORDER BY overlap > 0 DESC, overlap DESC, doc_id LIMIT 10""")
def keyword_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").getItem(0).alias("title"))
    return rt.overlay(d, "the than was thon", 10, "title", "doc_id").select("doc_id", "overlap")


@R.add("""WITH l AS (SELECT source, doc_id, string_split(text, chr(10))[1] AS title FROM documents), w AS (SELECT source, doc_id, unnest(list_transform(regexp_split_to_array(lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')), '\\s+'),
lambda x: regexp_replace(x, '[^\\p{L}\\p{N}-]', '', 'g'))) AS w, generate_subscripts(regexp_split_to_array(lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')), '\\s+'), 1) AS p FROM l),
c AS (SELECT source, w, count(*) AS n, min(doc_id * 100000 + p) AS seen FROM w WHERE length(w) >= 4 AND w NOT IN ('with', 'from', 'using', 'been', 'being', 'their', 'this', 'that', 'these', 'those', 'approach', 'method', 'study', 'paper', 'analysis', 'based', 'novel', 'towards', 'toward')
AND NOT regexp_matches(w, '^\\p{Nd}+$') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS r FROM c QUALIFY r <= 6)
SELECT source AS community_id, string_agg(w, ' ' ORDER BY r) AS label FROM r GROUP BY source""")
def community_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    part = d.select(F.col("doc_id").alias("node_id"), F.col("source").alias("community_id"))
    return cm.labels(part, d.select(F.col("doc_id").alias("node_id"), F.split("text", "\n").getItem(0).alias("title")))


@R.add("""SELECT source AS community_id, list_sort(list(doc_id)) AS members, count(*) AS n_members FROM documents GROUP BY source""")
def community_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cm.members(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("source").alias("community_id")))


@R.add("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) <= 3")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stratified_sample(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", F.md5(F.col("doc_id").cast("string").cast("binary")))


@R.add(r"""WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
f AS (SELECT doc_id, lower(x) AS k, arg_min(x, p) AS x, min(p) AS p FROM u WHERE x <> '' GROUP BY ALL) SELECT doc_id, coalesce(list(x ORDER BY p), []) AS items FROM f GROUP BY doc_id""")
def clean_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each text, of those alike but for case the first."""
    # a text with something else than white space has an item; the list is made once
    d = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S"))
    return d.select("doc_id", tx.clean_list(F.split("text", " ")).alias("items"))


@R.add("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS tag FROM orders) GROUP BY tag")
def tags_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.render import tag_list

    return tag_list(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.split("o_orderpriority", "-").alias("tags")))


@R.add("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ingested, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def dashboard_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.render import recent

    cards = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ingested"), "o_totalprice", "o_orderdate")
    return recent(cards, "o_orderdate", "o_orderkey").select("o_orderkey", "ingested", "o_totalprice")


@R.add("SELECT c_mktsegment AS community, count(*) AS n_members FROM customer GROUP BY 1 ORDER BY n_members DESC, community")
def dashboard_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.render import largest_communities

    part = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_mktsegment").alias("community_id"))
    out = largest_communities(cm.members(part).withColumn("label", F.col("community_id")))
    return out.select(F.col("community_id").alias("community"), "n_members")


@R.add("SELECT c_custkey AS doc_id, c_acctbal AS relevance FROM customer ORDER BY relevance DESC, doc_id LIMIT 25")
def dashboard_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.render import top_relevance

    return top_relevance(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_acctbal").alias("relevance")))


@R.add("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS ingested FROM orders WHERE o_orderstatus = 'O'")
def dashboard_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.render import pending

    status = F.when(F.col("o_orderstatus") == "O", F.lit("exploratory")).otherwise(F.lit("active"))
    return pending(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ingested"))).drop("status")


@R.add("SELECT c_custkey AS doc_id, c_nationkey AS community_id, 1990 + c_custkey % 30 AS year FROM customer WHERE c_nationkey < 20")
def dashboard_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.render import by_community

    c = read(spark, sf_dir, "customer")
    return by_community(c.select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("community_id"), (F.col("c_custkey") % 30 + 1990).alias("year")))


@R.add("SELECT p_partkey AS part_id, replace(replace(replace(replace(replace(p_name || ' <' || p_type || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS html FROM part")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), tx.escape_html(F.concat("p_name", F.lit(" <"), "p_type", F.lit(">"))).alias("html"))


_PALETTE = "['" + "', '".join(tx.PALETTE) + "']"


@R.add(f"SELECT n_nationkey, c AS colour, ('0x' || c[2:])::INT AS rgb FROM (SELECT n_nationkey, {_PALETTE}[n_nationkey % 14 + 1] AS c FROM nation)")
def community_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tx.community_colour(F.col("n_nationkey"))
    return read(spark, sf_dir, "nation").select("n_nationkey", c.alias("colour"), tx.packed_rgb(c).alias("rgb"))


@R.add("""SELECT customer.c_custkey, '---' || chr(10) || 'title: ' || c_name || chr(10) || '---' || chr(10) || chr(10) || '# ' || c_name || chr(10) || chr(10) || '**Year:** ' || 2020 || chr(10) AS head FROM customer""")
def card_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.render import card_markdown

    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("title"), F.lit(2020).alias("year"))
    return c.select("c_custkey", card_markdown(c, F.concat(F.lit("title: "), F.col("title"))).alias("head"))


# --- the token log ---------------------------------------------------------------------------

def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("surface_id"),
                                                F.floor("value").cast("long").alias("served"), F.get_json_object("props", "$.k").cast("long").alias("counterfactual"))


_LOG = "l AS (SELECT ts, event_type AS tool, user_id::VARCHAR AS surface_id, floor(value)::BIGINT AS served, json_extract_string(props, '$.k')::BIGINT AS counterfactual FROM events)"
_SUMS = "count(*) AS n_calls, sum(served)::BIGINT AS served, sum(counterfactual)::BIGINT AS counterfactual, CASE WHEN sum(served) > 0 THEN round(sum(counterfactual)::DOUBLE / sum(served), 2) ELSE 1.0 END AS ratio"


@R.add(f'WITH {_LOG} SELECT tool AS "group", {_SUMS} FROM l GROUP BY 1')
def token_report_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.report(log(spark, sf_dir), "tool")


@R.add(f"""WITH {_LOG} SELECT strftime(ts, '%Y-%m-%d') AS "group", {_SUMS} FROM l GROUP BY 1""")
def token_report_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.report(log(spark, sf_dir), "day")


@R.add(f'WITH {_LOG} SELECT surface_id AS "group", {_SUMS} FROM l GROUP BY 1')
def token_report_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.report(log(spark, sf_dir), "surface")


@R.add(f"""WITH {_LOG} SELECT {_SUMS}, sum(counterfactual)::BIGINT - sum(served)::BIGINT AS saved, round(100.0::DOUBLE * (sum(counterfactual) - sum(served)) / greatest(sum(counterfactual), 1), 1) AS saved_pct FROM l""")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.totals(log(spark, sf_dir))


@R.add(f"""WITH {_LOG} SELECT tool AS "group", {_SUMS} FROM l WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-06' AND tool = 'view' GROUP BY 1""")
def token_report_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.report(tk.filtered(log(spark, sf_dir), "2024-01-03", "2024-01-06", "view"), "anything")


@R.add("SELECT source AS community_id, sum(greatest(1, length(text) // 4))::BIGINT AS tokens FROM documents GROUP BY source")
def community_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    part = d.select(ids.doc_node(F.col("doc_id")).alias("node_id"), F.col("source").alias("community_id"))
    return tk.community_cost(part, d.select("doc_id", F.col("text").alias("markdown")))


@R.add("""WITH d AS (SELECT length(text) >= 200 AS ok, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents)
SELECT CASE WHEN NOT ok THEN 'quarantined' WHEN r = 1 THEN 'ingested' ELSE 'duplicate' END AS status, count(*) AS n FROM d GROUP BY 1""")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, ingested until none is left."""
    from ..stage import Stage
    from ..streaming.ingest import stream_texts

    stage = Stage(spark, "stream")
    stage.write(files(spark, sf_dir), "in")
    manifest = stream_texts(spark, f"{stage.root}/in", f"{stage.root}/manifest", f"{stage.root}/progress", profiles=NOTHING)
    return ig.status_counts(manifest)
