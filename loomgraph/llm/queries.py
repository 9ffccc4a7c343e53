"""The queries of the training-data operators, with SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, fill_middle, fingerprints, hard_negatives, language_id, license_scan, line_dedup, near_dedup, pii, quality_knn, token_counts
from .common import bound_arrow, crc_mod, read, whole


def tokenizer(name: str) -> str:
    """The place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"),
                      F.length(whole()).cast("long").alias("kept_chars"), F.sha2(whole(), 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_arrow(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language_id.training_rows(docs, "doc_id", "text", "lang", crc_mod("doc_id", 5) != 0)
    out = language_id.identify(docs, language_id.fit(rows))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_arrow(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = quality_knn.training_rows(docs, labels, "quality", "doc_id", "text", crc_mod("doc_id", 3) != 1)
    out = quality_knn.classify(docs.select("doc_id", "text"), quality_knn.fit(*rows))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_arrow(spark)
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_arrow(spark)
    docs = read(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(texts=pii.training_texts(docs)))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_arrow(spark)
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_arrow(spark)
    docs, path = read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.json")
    return bpe.encode_decode(docs, path, bpe.build_lexicon(docs, path), digests=True)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_arrow(spark)
    out = fill_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_dedup, op2_language_id, op3_license_scan, op4_quality, op5_near_dedup, op6_decontaminate,
        op7_token_counts, op8_pii, op9_embedding_dedup, op10_bpe, op11_fill_middle, op12_hard_negatives, op13_fingerprints)
}

_SHINGLED = """
d AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w0 FROM documents),
w AS (SELECT doc_id, CASE WHEN len(w0) > 0 THEN w0 WHEN trim(coalesce(text, ''), E' \\t\\n\\r') <> '' THEN [trim(text, E' \\t\\n\\r')] ELSE [] END AS w FROM d),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE n >= 0.8::DOUBLE * (len(x.s) + len(y.s) - n) - 1e-9)"""

_REACHED = """
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(n, c) AS (SELECT {id}, {id} FROM {table} UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n)"""

#: Tokens are cut by one expression, so SQL lists them; the places are sums of their lengths.
_FILL_MIDDLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{fill_middle.PATTERN}') AS w, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j, w,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fill_middle.RATE} THEN 'plain'
           WHEN h4 % 100 < {fill_middle.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, array_to_string(w[1:i], '') AS p, array_to_string(w[i + 1:j], '') AS m, array_to_string(w[j + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

_HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {
    "op12_hard_negatives": _HARD_NEGATIVES,
    "op11_fill_middle": _FILL_MIDDLE,
    "op1_line_dedup": line_dedup.SQL.format(docs="documents", max_ratio=line_dedup.MAX_RATIO, min_pages=line_dedup.MIN_PAGES) + """
SELECT doc_id, coalesce(len(list_filter(lines, lambda x: trim(x, ' ') <> '')), 0) AS n_lines,
       coalesce(len(lines) - len(kept), 0) AS n_dropped, length(coalesce(array_to_string(kept, chr(10)), '')) AS kept_chars,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
""",
    "op5_near_dedup": f"""
WITH RECURSIVE {_SHINGLED}, {_REACHED.format(id="doc_id", table="documents")}
SELECT n AS doc_id, c AS class_id, n = c AS kept FROM m
""",
    "op9_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
                     AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id < b.vec_id
      WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98), {_REACHED.format(id="vec_id", table="embeddings")}
SELECT m.n AS vec_id, coalesce(k, 0) AS n_links, c AS component_id, m.n = c AS kept FROM m LEFT JOIN (SELECT a AS n, count(*) AS k FROM u GROUP BY a) USING (n)
""",
}
