"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1 to 3, the blended
spectrum; letters of every script, case aside) present in both, divided by the root of the product of their numbers of
n-grams. It is taken against a fixed set of landmark texts; the Nyström map makes these
kernel values the coordinates of a kernel ridge regression, one against the rest for each
language. Both are linear in a text's n-grams, so a text is scored by the sum of its
n-grams' weights.

The fit uses at most ``per_language`` texts of a language, chosen by a hash of the id; the
bound is a parameter, and each text comes to the driver as a compressed bit set.
"""
from __future__ import annotations

import pickle
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the hashed n-grams; a text of 3000 n-grams loses about 4 to shared places.
GRAMS = 1 << 20
#: Cells of the table that one product gathers, about.
PRODUCT_CELLS = 1 << 21
PER_LANGUAGE = 200
LANDMARKS = 32
#: Training rows in all: with very many languages each has fewer.
MOST_ROWS = 4000
MOST_LANDMARKS = 1024
#: More values of lang are an error.
MOST_LANGUAGES = 1000
RIDGE = 1e-3
#: Rows and n-grams unpacked at once in the fit.
FIT_ROWS, FIT_GRAMS = 256, 1 << 15

_U = np.uint64


def _symbols() -> np.ndarray:
    """Code point -> symbol: a letter or mark of any script is its lower-case code point;
    blanks, digits and everything else are a symbol each."""
    out = np.arange(0x110000, dtype=np.uint64)
    for cp in range(0x20000):  # ideographs and private characters beyond stay as they are
        kind = unicodedata.category(chr(cp))
        if kind[0] in "LM":
            low = chr(cp).lower()
            out[cp] = ord(low) if len(low) == 1 else cp
        else:
            out[cp] = 32 if kind[0] == "Z" or chr(cp).isspace() else 48 if kind[0] == "N" else 33
    return out


SYMBOLS = _symbols()


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of a text as numbers below GRAMS, repeats included. An n-gram is the
    number of 63 bits that its symbols make, hashed to its place."""
    s = SYMBOLS[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    two = s[:-1] << _U(21) | s[1:]
    three = two[:-1] << _U(21) | s[2:]
    x = np.concatenate((s, two, three))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return ((x ^ (x >> _U(31))) & _U(GRAMS - 1)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _flags(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8)).astype(bool)


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """The model of (language, n-gram bits) rows: a weight for each language of each n-gram
    that a landmark has. Rows are unpacked ``FIT_ROWS`` at a time."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return {"langs": []}
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(langs)))
    y = np.array([[lang == k for k in langs] for lang, _ in rows], np.float64)
    picked = [i for k in langs for i in [j for j, (lang, _) in enumerate(rows) if lang == k][:landmarks]]
    used = np.zeros(GRAMS, bool)
    for i in picked:
        used |= _flags(rows[i][1])
    used = np.flatnonzero(used)
    marks = np.array([_flags(rows[i][1])[used] for i in picked])
    parts = [slice(at, at + FIT_GRAMS) for at in range(0, len(used), FIT_GRAMS)]
    kernel, size = np.zeros((len(rows), len(picked))), np.empty(len(rows))
    for at in range(0, len(rows), FIT_ROWS):
        x = np.empty((len(rows[at : at + FIT_ROWS]), len(used)), bool)
        for i, (_, bits) in enumerate(rows[at : at + FIT_ROWS]):
            flags = _flags(bits)
            x[i], size[at + i] = flags[used], np.sqrt(flags.sum())
        for p in parts:
            kernel[at : at + FIT_ROWS] += x[:, p].astype(np.float32) @ marks[:, p].astype(np.float32).T
    kernel = kernel / size[:, None] / size[picked][None]
    values, vectors = np.linalg.eigh(kernel[picked])
    keep = values > 1e-8 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ nystrom
    weights = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
    # the kernel is linear in a text's flags, so landmarks and weights fold into one table
    folded = ((nystrom @ weights) / size[picked][:, None]).astype(np.float32)
    table = np.concatenate([*[marks[:, p].astype(np.float32).T @ folded for p in parts], np.zeros((1, len(langs)), np.float32)])
    column = np.full(GRAMS, len(used), np.int32)
    column[used] = np.arange(len(used))
    return {"langs": langs, "column": column, "table": table}


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` and 0 without a letter or a model."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model["langs"]:
        return names, scores
    column, table, seen = model["column"], model["table"], np.zeros(GRAMS, bool)
    sums, sizes = np.zeros((len(texts), len(model["langs"]))), np.zeros(len(texts))
    most = max(1, PRODUCT_CELLS // len(model["langs"]))
    owners: list[int] = []
    parts: list[np.ndarray] = []

    def multiply() -> None:
        """Add the gathered flags, a sparse matrix, times the table."""
        if parts:
            heads = np.cumsum([0, *map(len, parts)])[:-1]
            np.add.at(sums, owners, np.add.reduceat(table[np.concatenate(parts)], heads, axis=0, dtype=np.float64))
        owners.clear()
        parts.clear()

    held = 0
    for i, t in enumerate(texts):
        if not has_letter(t):
            continue
        codes = gram_codes(t)
        seen[codes] = True
        own = np.flatnonzero(seen)
        seen[codes] = False
        sizes[i] = len(own)
        for at in range(0, len(own), most):  # a very long text takes several products
            owners.append(i)
            parts.append(column[own[at : at + most]])
            held += len(parts[-1])
            if held >= most:
                multiply()
                held = 0
    multiply()
    for i in np.flatnonzero(sizes).tolist():
        f = sums[i] / np.sqrt(sizes[i])
        names[i], scores[i] = model["langs"][int(f.argmax())], float(min(1.0, max(0.0, f.max())))
    return names, scores


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, use: Column,
                  per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """About ``per_language`` rows of each language, those with the smallest hashes of the
    id: the languages' counts give each a hash bound, so the sample needs no sort. Fewer
    of each past ``MOST_ROWS`` in all; over ``MOST_LANGUAGES`` languages are an error."""
    rows = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
              .limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of {lang_col}: a model of so many languages is not supported")
    if not counts:
        return []
    per_language = max(1, min(per_language, MOST_ROWS // len(counts)))
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    bound = F.lit(0.0)
    for lang, n in counts.items():
        bound = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.3 * per_language / n))).otherwise(bound)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                seen = np.zeros(GRAMS, bool)
                seen[gram_codes(t)] = True
                out.append(zlib.compress(np.packbits(seen).tobytes(), 1) if has_letter(t) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["lang", "place", "bits"])

    found = (rows.where(place < bound).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
             .mapInArrow(bits, "lang string, place double, bits binary").where(F.col("bits").isNotNull())
             .orderBy("place", "lang", "bits").limit(2 * per_language * len(counts)).collect())
    out, taken = [], dict.fromkeys(counts, 0)
    for r in found:
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            out.append((r["lang"], bytes(r["bits"])))
    return out


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row per row of ``docs``. Texts are read whole, equal ones are
    scored alike, and of languages that score the same the first by name stays; null, empty
    and letterless texts are ``und`` with 0. A null id stays null; an empty table gives an empty
    table. Map only; reads id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in batches:
            names, scores = predict(own, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
