"""Line dedup by site-relative frequency.

A line is boilerplate on a site if the pages of the site that hold it, divided by
all pages of the site, exceed ``max_ratio``. Only DataFrame expressions are used.

Plan: (1) explode the distinct lines of each page to (site, 128-bit line hash) and
count, with partial sums before the shuffle, so a hot site or line costs no more than
one row a task; (2) keep the lines over the ratio: at most (lines a page) / ratio for
each site, written to the shared folder; (3) join that set to the pages by site and filter
each page's lines in its own row. The set is broadcast if its counted size is under
``BROADCAST_LINES``, and texts then move nowhere; beyond it the join is a sort-merge join
that AQE splits where a site is hot. Texts are never regrouped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

MAX_RATIO = 0.1
MIN_PAGES = 3
#: Boilerplate lines of all sites together (about 50 bytes each) that may be broadcast.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("salt"), line).alias("b"))


def site_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text",
                     max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, lines): hashes of each site's boilerplate lines, with counts folded in.

    Every row is a page, repeated rows included; a line counts once a page. Blank lines
    and null texts count nothing. A null site is a site of its own.
    """
    pages = docs.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    lines = (pages.where(F.col("text").isNotNull())
             .select("site", F.explode(F.array_distinct(F.transform(
                 F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), _key))).alias("k"))
             .groupBy("site", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    return (lines.alias("l").join(totals.alias("t"), F.col("l.site").eqNullSafe(F.col("t.site")))
            .where(F.col("n") > F.lit(float(max_ratio)) * F.col("n_pages"))
            .groupBy(F.col("l.site").alias("site")).agg(F.collect_set("k").alias("boilerplate")))


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text",
                     max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` less its site's boilerplate lines, and
    ``n_lines`` and ``n_dropped`` (non-blank lines before, and lines dropped).

    Blank lines stay. A null text stays null, with 0 lines; an empty table gives an
    empty table; texts of any length are filtered whole, each in its own row. Columns of
    ``docs`` that are not named here pass through; columns named ``n_lines`` or
    ``n_dropped`` are replaced.
    """
    site, marked_by, left = (next(n for k in range(len(docs.columns) + 1) if (n := f"{c}_{k}") not in docs.columns) for c in ("site", "marks", "kept"))
    marks = site_boilerplate(docs, site_col, text_col, max_ratio, min_pages).select(
        F.col("site").alias(site), F.col("boilerplate").alias(marked_by))
    marks = Stage(docs.sparkSession, "boilerplate").write(marks, "lines")
    n = marks.agg(F.coalesce(F.sum(F.size(marked_by)), F.lit(0))).first()[0]
    side = F.broadcast(marks) if n <= BROADCAST_LINES else marks
    joined = docs.join(side, docs[site_col].eqNullSafe(marks[site]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    marked = F.coalesce(F.col(marked_by), F.array().cast(marks.schema[marked_by].dataType))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(marked, _key(x)))
    out = joined.withColumn(left, kept).withColumns({
        "n_lines": F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)),
        "n_dropped": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines) - F.size(left)),
    })
    return out.withColumn(text_col, F.array_join(left, "\n")).drop(left, marked_by, site)


#: The result of op1 in DuckDB SQL over {docs}.
SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM {docs}),
u AS (SELECT DISTINCT rid, source, trim(line, ' ') AS line FROM (SELECT rid, source, unnest(lines) AS line FROM d)
      WHERE trim(line, ' ') <> ''),
t AS (SELECT source, count(*) AS n_pages FROM d GROUP BY source),
b AS (SELECT u.source, u.line FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source
      GROUP BY u.source, u.line, t.n_pages HAVING count(*) >= {min_pages} AND count(*) > {max_ratio}::DOUBLE * t.n_pages),
m AS (SELECT source, list(line) AS marks FROM b GROUP BY source),
k AS (SELECT d.*, list_filter(lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(marks, []), trim(x, ' '))) AS kept
      FROM d LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source)
"""
