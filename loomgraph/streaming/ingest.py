"""Continuous ingest: new files to outcomes, batch by batch."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import ingest as ig
from ..sources.files import binary_schema, describe

TEXT_FILES = "path string, filename string, subdir string, suffix string, size long, content_hash string, text string"


def ingest_batch(manifest_path: str, profiles: dict | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. What earlier batches ingested is read from the manifest, so
    state lives in the table and is as large as it; a batch writes its rows under its own
    number, so a batch that runs again replaces them."""
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_manifest(spark, manifest_path).where(F.col("batch") != number)
        out = ig.ingest(batch, ig.known_hashes(before), profiles=profiles, whole=sink is not None).persist()
        try:
            ig.manifest_rows(out).write.mode("overwrite").parquet(f"{manifest_path}/batch={number}")
            if sink is not None:
                sink(out, number)
        finally:
            out.unpersist()
    return run


def read_manifest(spark: SparkSession, manifest_path: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(manifest_path)
    schema = f"{schemas.MANIFEST}, batch long"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(manifest_path)


def stream_texts(spark: SparkSession, source: str, manifest_path: str, progress: str, profiles: dict | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Ingest a folder of Parquet tables of texts until nothing new is left; the manifest."""
    stream = spark.readStream.schema(TEXT_FILES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(ingest_batch(manifest_path, profiles)).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_manifest(spark, manifest_path)


def watch(spark: SparkSession, root: str, manifest_path: str, progress: str, interval: str = "1 second", once: bool = False, profiles: dict | None = None,
          sink: Callable[[DataFrame, int], None] | None = None):
    """A running query over the files under ``root``; files of one interval are one pass.
    Reserved folders and hidden files are left out."""
    stream = spark.readStream.format("binaryFile").schema(binary_schema()).option("recursiveFileLookup", "true").load(root)
    writer = describe(stream, root).writeStream.foreachBatch(ingest_batch(manifest_path, profiles, sink)).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
