"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are character bigrams over 64 symbols that keep case, line ends and each ASCII
punctuation mark apart, weighted by log frequency and idf, and a few shares that describe
the layout (repeated neighbours, capitals, marks). A truncated SVD of the labelled sample
gives the latent space. The labelled vectors are broadcast - their number is a parameter -
and every text is compared with all of them by blocked exact cosine products; the nearest
vote with their similarity as weight.
"""
from __future__ import annotations

import operator
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 64
PER_CLASS = 600
LATENT = 48
NEIGHBOURS = 15
#: Cosines that differ by less are equal.
TIE = 1e-6
LAYOUT_WEIGHT = 1.5
#: How far votes are reweighted from the sample's balance to the odds of the labels: 0 not at
#: all, 1 fully. Full odds let close rows of the rarer class pass.
PRIOR_POWER = 0.3


def _symbols() -> np.ndarray:
    """Code point -> symbol: a-z each, other small letters, capitals, digits, space, line
    end, each ASCII mark, the rest."""
    out = np.full(0x110000, 27, np.uint8)
    out[0xC0:0xDF] = 28
    out[:0xC0] = 63
    out[97:123] = np.arange(1, 27)
    out[65:91] = 28
    out[48:58] = 29
    out[[9, 32, 0xA0]] = 30
    out[[10, 13]] = 31
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = 32 + np.arange(len(marks)) % 31
    return out


SYMBOLS = _symbols()
TERMS = N * N
LAYOUT = 6


def raw_vector(text: str | None) -> np.ndarray:
    """Bigram counts, then layout shares. Null and empty texts give zeros."""
    out = np.zeros(TERMS + LAYOUT, np.float32)
    if not text:
        return out
    s = SYMBOLS[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")].astype(np.int32)
    out[:TERMS] = np.bincount(s[:-1] * N + s[1:], minlength=TERMS)
    n = len(s)
    one = np.bincount(s, minlength=N)
    words = text.split()
    same = sum(map(operator.eq, words, words[1:])) / (len(words) + 10)  # few words tell little
    out[TERMS:] = (same**0.5, (one[28] / n) ** 0.5, (one[32:63].sum() / n) ** 0.5, one[30] / n, one[29] / n, (one[27] + one[1:27].sum()) / n)
    return out


def _weighted(x: np.ndarray, idf: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Raw vectors, weighted in place: unit-length terms beside centred layout shares."""
    terms = x[:, :TERMS]
    np.log1p(terms, out=terms)
    terms *= idf
    terms /= np.maximum(1e-9, np.linalg.norm(terms, axis=1, keepdims=True))
    x[:, TERMS:] = LAYOUT_WEIGHT * (x[:, TERMS:] - mean)
    return x


def fit(rows: list[tuple[int, np.ndarray]], share: float | None = None, latent: int = LATENT) -> dict:
    """The model of (label, raw vector) rows. ``share`` is that of label 1 among all labelled
    rows: votes of a class that the sample holds too much of count less. Without rows
    every text scores 0.5."""
    if not rows:
        return {"y": np.zeros(0, np.float32), "prior": 0.5}
    x = np.empty((len(rows), TERMS + LAYOUT), np.float32)
    for i, (_, v) in enumerate(rows):
        x[i] = v
    y = np.array([k for k, _ in rows], np.float32)
    idf = np.log((1 + len(x)) / (1 + (x[:, :TERMS] > 0).sum(axis=0))).astype(np.float32) + 0.1
    mean = x[:, TERMS:].mean(axis=0)
    w = _weighted(x, idf, mean)
    centre = w.mean(axis=0)
    w -= centre
    values, vectors = np.linalg.eigh((w @ w.T).astype(np.float64))
    order = np.argsort(values)[::-1][: min(latent, len(x))]
    order = order[values[order] > 1e-6]
    basis = w.T @ (vectors[:, order] / np.sqrt(values[order])).astype(np.float32)
    z = w @ basis
    z /= np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))
    mean_y = float(y.mean())
    share = mean_y if share is None else share
    value = np.where(y == 1, share / max(mean_y, 1e-9), (1 - share) / max(1 - mean_y, 1e-9)).astype(np.float32) ** PRIOR_POWER
    return {"y": y, "value": value, "prior": share, "idf": idf, "mean": mean, "centre": centre, "basis": basis, "z": z}


def score(model: dict, texts: list[str | None], neighbours: int = NEIGHBOURS) -> list[float]:
    """Share of label 1 among the nearest labelled vectors, weighted by squared cosine. Those as
    near as the last of them (within TIE) share the places left, so ties hang on no order. An
    empty text, or one like none of them, gets the sample's share."""
    out = [model["prior"]] * len(texts)
    y = model["y"]
    if not len(y):
        return out
    k = min(neighbours, len(y))
    for at in range(0, len(texts), 256):
        ids = [i for i in range(at, min(at + 256, len(texts))) if texts[i]]
        if not ids:
            continue
        x = _weighted(np.array([raw_vector(texts[i]) for i in ids]), model["idf"], model["mean"]) - model["centre"]
        z = x.astype(np.float32) @ model["basis"]
        z /= np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))
        sims = z @ model["z"].T
        last = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        above, tied = sims > last + TIE, np.abs(sims - last) <= TIE
        places = above + tied * ((k - above.sum(axis=1)) / tied.sum(axis=1))[:, None]
        weight = np.maximum(0, sims).astype(np.float64) ** 2 * model["value"] * places
        total = weight.sum(axis=1)
        vote = weight @ y.astype(np.float64)
        for r, i in enumerate(ids):
            if total[r] > 1e-9:
                out[i] = float(vote[r] / total[r])
    return out


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, use: Column,
                  per_class: int = PER_CLASS) -> tuple[list[tuple[int, np.ndarray]], float | None]:
    """About ``per_class`` labelled rows of each class by a hash of the id, and the share of
    label 1 among all of them; the chosen ids are few, so the join that fetches their texts
    broadcasts them."""
    known = labels.where(use & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], None
    place = F.pmod(F.xxhash64(F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bound = F.lit(0.0)
    for k, n in counts.items():
        bound = F.when(F.col("y") == k, F.lit(min(1.0, 1.1 * per_class / n))).otherwise(bound)
    chosen = [(r["id"], r["y"]) for r in known.where(place < bound).withColumn("p", place).orderBy("p", "id", "y").limit(3 * per_class).collect()]
    spark = docs.sparkSession
    few = spark.createDataFrame(chosen, known.schema)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [raw_vector(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "y", "v"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
             .join(F.broadcast(few), "id").select("id", "y", "text").mapInArrow(vectors, f"id {kind}, y int, v binary")
             .orderBy(F.xxhash64("id", "v"), "id", "v").limit(3 * per_class).collect())
    return [(r["y"], np.frombuffer(r["v"], np.float32)) for r in found], counts.get(1, 0) / sum(counts.values())


def score_column(spark: SparkSession, model: dict, text: Column) -> Column:
    """The score of a text. Only texts go to Python and only scores come back; what else a
    row holds stays where it is."""
    shared = spark.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pickle.loads(shared.value)
        for batch in batches:
            yield pa.array(score(own, batch.to_pylist()), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
             passthrough: list[str] | None = None) -> DataFrame:
    """(id, score, predicted), one row per row of ``docs``; ``passthrough`` columns come
    along. Map only; scores read the text alone, so equal texts have equal scores, a null or
    empty one the sample's share, and one of any length is read whole. A null id stays null; an
    empty table gives an empty table. Other columns of ``docs`` are not read."""
    kept = list(dict.fromkeys([id_col, *(passthrough or [])]))
    scored = docs.select(*kept, score_column(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
