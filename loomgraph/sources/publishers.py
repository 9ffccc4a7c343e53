"""Publishers' records behind an injected fetcher: cache, checks, back-off."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import text as tx

CACHE = "key string, body string"
RETRIES, FIRST_WAIT = 3, 2.0


class TooManyRequests(Exception):
    """What a fetcher raises to be called again later."""


def wanted(files: DataFrame, name_col: str = "filename") -> DataFrame:
    """(filename, kind, key) of the files whose name tells a publisher's id; each name once."""
    arxiv, doi = tx.arxiv_id(F.col(name_col)), tx.biorxiv_doi(F.col(name_col))
    rows = files.select(F.col(name_col).alias("filename"), F.when(arxiv.isNotNull(), F.lit("arxiv")).when(doi.isNotNull(), F.lit("biorxiv")).alias("kind"), F.coalesce(arxiv, doi).alias("key"))
    return rows.where("key is not null").distinct()


def fetched(keys: DataFrame, fetch: Callable[[str, str], str | None], url: Callable[[Column, Column], Column] | None = None, check: Callable[[Column], Column] = tx.url_gate,
            wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, body) of (kind, key) rows: ``fetch(kind, key)`` on the executors, called again after
    2, 4 and 8 seconds while it says TooManyRequests; what fails otherwise has no row. With
    ``url``, only keys whose URL passes ``check`` are fetched."""
    if url is not None:
        keys = keys.where(check(url(F.col("kind"), F.col("key")))["allowed"])

    def one(kind: str, key: str) -> str | None:
        for n in range(RETRIES + 1):
            try:
                return fetch(kind, key)
            except TooManyRequests:
                if n < RETRIES:
                    wait(FIRST_WAIT * 2**n)
            except Exception:
                return None
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [one(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(bodies, pa.string())], names=["key", "body"])

    return keys.select("kind", "key").distinct().mapInArrow(run, CACHE).where("body is not null")


def records(asked: DataFrame, bodies: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """(filename, record) from (key, body) answers; of those that the cache held, the record's
    source ends with ``_cache``. A body that does not parse has no row."""
    every = bodies.select("key", "body", F.lit("").alias("from"))
    if cached is not None:
        every = cached.select("key", "body", F.lit("_cache").alias("from")).join(bodies.select("key"), "key", "left_anti").unionByName(every)
    rows = asked.join(every, "key")
    record = F.when(F.col("kind") == "arxiv", md.from_atom(F.col("body"), F.col("key"))).otherwise(md.from_details(F.col("body"), F.col("key")))
    rows = rows.select("filename", "from", record.alias("record")).where("record is not null")
    return rows.select("filename", F.col("record").withField("source", F.concat(F.col("record.source"), F.col("from"))).alias("record"))
