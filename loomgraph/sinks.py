"""Files written and moved by the executors, through Arrow's file systems.

A root is a path or URI that driver and executors reach alike. Both jobs give the same files
when a task runs twice: a file is written beside its place and then renamed, and a source
that is gone while its target stands counts as moved.
"""
from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ids
from .operators.names import before_suffix, unique_names

WRITTEN = "path string, bytes long, sha256 string"
MOVED = "source string, target string, error string"


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def write_texts(rows: DataFrame, root: str, path_col: str = "path", content_col: str = "markdown") -> DataFrame:
    """A file for each row at its path below ``root``; (path, bytes, sha256) of each. Nothing is
    written before the result is computed. Null contents are empty files, rows without a path
    are left out, and rows that share a path leave one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        made: set[str] = set()
        for batch in batches:
            out: list[tuple[str, int, str]] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, place = (text or "").encode(), posixpath.join(base, path)
                if (folder := posixpath.dirname(place)) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                beside = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as f:
                    f.write(data)
                system.move(beside, place)
                out.append((path, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "bytes", "sha256"])

    return rows.where(F.col(path_col).isNotNull()).select(F.col(path_col).cast("string"), F.col(content_col).cast("string")).mapInArrow(run, WRITTEN)


def move_files(moves: DataFrame, root: str, source_col: str = "source", target_col: str = "target") -> DataFrame:
    """(source, target, error): each file moved below ``root``; error tells why one stayed.
    Targets are expected to differ (see ``targets``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        there = lambda p: system.get_file_info(p).type == pafs.FileType.File
        for batch in batches:
            errors: list[str | None] = []
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = posixpath.join(base, source), posixpath.join(base, target)
                try:
                    if there(a):
                        if there(b):
                            raise FileExistsError(target)
                        system.create_dir(posixpath.dirname(b), recursive=True)
                        system.move(a, b)
                    elif not there(b):
                        raise FileNotFoundError(source)
                    errors.append(None)
                except OSError as e:
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(errors, pa.string())], names=["source", "target", "error"])

    return moves.where(F.col(target_col).isNotNull()).select(F.col(source_col).alias("source"), F.col(target_col).alias("target")).mapInArrow(run, MOVED)


def routed(outcomes: DataFrame) -> Column:
    """Where a file goes: ``processed`` mirrors its folder, ``quarantine`` has a folder for
    each reason; null for files that stay."""
    processed = F.concat_ws("/", F.lit("processed"), F.nullif(F.col("subdir"), F.lit("")), F.col("filename"))
    refused = F.concat_ws("/", F.lit("quarantine"), ids.reason_slug(F.col("reason")), F.col("filename"))
    return F.when(F.col("status") == "ingested", processed).when(F.col("status") == "quarantined", refused)


def targets(moves: DataFrame, taken: DataFrame | None = None, wanted_col: str = "wanted", order: str = "path") -> DataFrame:
    """With ``target``: the place wanted, on clashes with the smallest free -1, -2 ... before the
    suffix, in the order of paths. ``taken``: (path) of the places given before. Files without a
    place wanted get none."""
    going = moves.where(F.col(wanted_col).isNotNull()).select(F.col(order).alias("__path"), F.col(wanted_col).alias("__wanted"))
    given = unique_names(going, "__wanted", "__path", "target", taken, before_suffix).select("__path", "target")
    return moves.join(given, F.col(order) == F.col("__path"), "left").drop("__path")
