"""Reading and writing the tables of a corpus."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import metadata as md
from ..functions import text as tx


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> DataFrame:
    """Overwrite a table, even one that ``df`` reads: through a table beside it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    fs.rename(fs_path(f"{path}.new"), fs_path(path))
    return spark.read.schema(df.schema).parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    spark = nodes.sparkSession
    replace(nodes, f"{path}/nodes")
    replace(edges, f"{path}/edges")
    replace(spark.createDataFrame([(schemas.GRAPH_VERSION, "property_graph")], "schema_version int, graph_type string"), f"{path}/about")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; another version or kind of graph is an error."""
    about = spark.read.parquet(f"{path}/about").first()
    if about["schema_version"] != schemas.GRAPH_VERSION or about["graph_type"] != "property_graph":
        raise ValueError(f"not a graph of version {schemas.GRAPH_VERSION}: {about.asDict()}")
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines and what is no record are left out."""
    raw = spark.read.text(path).where(tx.strip(F.col("value")) != "")
    parsed = raw.select(F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    return parsed.where("_corrupt is null").drop("_corrupt")


def token_log(spark: SparkSession, path: str) -> DataFrame:
    return json_records(spark, path, schemas.TOKEN_LOG)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def concept_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, summary, topics, methods, named_entities, domain) of sidecars, one object a
    file named by its document; what is no object is left out."""
    raw = spark.read.option("wholetext", "true").text(path).select("value", F.input_file_name().alias("file"))
    kind = "summary string, topics array<string>, methods array<string>, named_entities array<string>, domain string"
    parsed = raw.select(F.regexp_extract("file", r"([^/]+?)(?:\.concepts)?\.json$", 1).alias("doc_id"), F.from_json("value", kind, {"mode": "PERMISSIVE"}).alias("c"))
    return parsed.where("c.summary is not null").select("doc_id", "c.*")


def publisher_records(table: DataFrame, filename_col: str = "filename", body_col: str = "body") -> DataFrame:
    """(filename, record) of answers kept from publishers; the file's name tells which."""
    f, b = F.col(filename_col), F.col(body_col)
    record = F.when(tx.arxiv_id(f).isNotNull(), md.from_atom(b, tx.arxiv_id(f))).when(tx.biorxiv_doi(f).isNotNull(), md.from_details(b, tx.biorxiv_doi(f)))
    return table.select(f.alias("filename"), record.alias("record")).where("record is not null")
