"""Structure-aware chunks that cover every character, and the check that they do."""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ids import chunk_id
from ..stage import bound_arrow

MAX_CHARS, OVERLAP_CHARS = 3000, 400
#: Bytes of the texts that are cut at once.
PART_BYTES = 1 << 20
# Fixed patterns of the places where a chunk may end.
BREAKS = re.compile(r"\n#{1,6}\s+[^\n]+\n"), re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


def chunk_spans(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int]]:
    """(start, end) of the chunks. A chunk ends at the last break in the final fifth of its
    window, else at the window's end; the next begins ``overlap`` before that end."""
    if max_chars <= 0 or not 0 <= overlap < max_chars:
        raise ValueError("max_chars must be positive and overlap within [0, max_chars)")
    n = len(text)
    if n <= max_chars:
        return [(0, n)] if n else []
    breaks = sorted({m.start() for rx in BREAKS for m in rx.finditer(text)})
    out, start = [], 0
    while True:
        target = min(start + max_chars, n)
        end = target
        if target < n:
            at = bisect_right(breaks, target) - 1
            if at >= bisect_left(breaks, start + int(0.8 * (target - start))):
                end = breaks[at]
            if end <= start:
                end = target
        out.append((start, end))
        if end >= n:
            return out
        start = max(end - overlap, end - max_chars + 1)


def chunk_documents(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, id_col: str = "doc_id",
                    text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(chunk_id, id, ordinal, start_offset, end_offset, text, total_chunks). A title is put
    before the text, and offsets refer to both together. Map only."""
    chunk_spans("", max_chars, overlap)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if title_col:
        text = F.when(F.coalesce(F.col(title_col), F.lit("")) != "", F.concat(F.col(title_col), F.lit("\n\n"), text)).otherwise(text)
    kind = docs.schema[id_col].dataType.simpleString()

    bound_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a few texts at a time: about PART_BYTES of them as Python objects, with their chunks
            size, at = pc.cumulative_sum(pc.fill_null(pc.binary_length(whole.column(1)), 0).cast(pa.int64())).to_numpy(), 0
            while at < whole.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, side="right")))
                batch, at = whole.slice(at, upto - at), upto
                rows = [(i, k, s, e, t[s:e], len(spans)) for i, t in enumerate(batch.column(1).to_pylist())
                        for spans in [chunk_spans(t, max_chars, overlap)] for k, (s, e) in enumerate(spans)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int32())],
                    names=["id", "ordinal", "start_offset", "end_offset", "text", "total_chunks"])

    out = docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(
        run, f"id {kind}, ordinal int, start_offset int, end_offset int, text string, total_chunks int")
    return out.select(chunk_id(F.col("id"), F.col("ordinal")).alias("chunk_id"), F.col("id").alias(id_col), "ordinal", "start_offset", "end_offset", "text", "total_chunks")


def coverage(chunks: DataFrame, lengths: DataFrame, id_col: str = "doc_id", length_col: str = "total_chars") -> DataFrame:
    """(id, total_chars, covered_chars, n_gaps, coverage_pct, passed) from the union of the
    chunks' intervals: running maximum of the ends before each start, islands and gaps."""
    w = Window.partitionBy(id_col).orderBy("start_offset", "end_offset")
    before = F.coalesce(F.max("end_offset").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    islands = (chunks.select(id_col, "start_offset", "end_offset", before.alias("reached"))
               .withColumns({"new": F.greatest(F.lit(0), F.col("end_offset") - F.greatest("start_offset", "reached")),
                             "gap": (F.col("start_offset") > F.col("reached")).cast("int")})
               .groupBy(id_col).agg(F.sum("new").alias("covered"), F.sum("gap").alias("gaps"), F.max("end_offset").alias("last")))
    out = lengths.join(islands, id_col, "left")
    total, covered = F.col(length_col), F.coalesce(F.col("covered"), F.lit(0))
    gaps = F.coalesce(F.col("gaps"), F.lit(0)) + (F.coalesce(F.col("last"), F.lit(0)) < total).cast("int")
    return out.select(id_col, total.cast("long").alias("total_chars"), covered.cast("long").alias("covered_chars"), gaps.cast("long").alias("n_gaps"),
                      F.when(total == 0, 100.0).otherwise(100.0 * covered / total).alias("coverage_pct"), (gaps == 0).alias("passed"))
