"""Source files of a corpus."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ingest import RESERVED

GENERATED = ("dashboard.md", "index.md", "log.md")


def binary_schema() -> str:
    return "path string, modificationTime timestamp, length long, content binary"


def describe(files: DataFrame, root: str) -> DataFrame:
    """(path, filename, subdir, suffix, size, content_hash, content) of binary files under a
    root. Left out: files whose first folder is reserved, hidden files and folders, pages
    that rendering leaves at the root."""
    clean = F.regexp_replace(F.lit(root), "^file:/*", "/")
    rel = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), r"^\Q" + root.removeprefix("file://").rstrip("/") + r"\E/*", ""), "^/+", "")
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = files.withColumns({"rel": rel, "filename": name, "folders": folders, "root": clean}).where(
        ~(F.size("folders") > 0) | ~F.element_at(F.concat("folders", F.array(F.lit(""))), 1).isin(*RESERVED))
    kept = kept.where(~F.col("filename").startswith(".") & ~F.exists("folders", lambda x: x.startswith(".")) & ~((F.size("folders") == 0) & F.col("filename").isin(*GENERATED)))
    return kept.select(F.col("rel").alias("path"), "filename", F.array_join("folders", "/").alias("subdir"), tx.suffix(F.col("filename")).alias("suffix"), F.col("length").alias("size"),
                       F.sha2("content", 256).alias("content_hash"), "content")


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows for files without content, which Spark's reader leaves out. They are found by
    listing the folders on the driver, one call a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    walk, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while walk.hasNext():
        f = walk.next()
        if f.getLen() == 0:
            found.append((f.getPath().toString(), 0, bytearray()))
    return spark.createDataFrame(found, "path string, length long, content binary")


def scan(spark: SparkSession, root: str, with_empty: bool = True) -> DataFrame:
    """All source files under a root, at any depth. ``with_empty`` is for corpora whose
    folders can be listed on the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    return describe(files.unionByName(empty_files(spark, root)) if with_empty else files, root)
