"""Benchmark decontamination: BM25 over an inverted index of test items.

The queries are all passages of the training texts: windows of words that overlap by
half and are at least twice as long as the longest item, so that an item lies whole in
some window. The index has, for each term, postings in the order of the items and,
for each block of items, the largest impact in the block. As in block-max WAND a block is
scored for a passage only if its block maxima, summed over the passage's terms, can reach
the block's lowest threshold; here the bounds of many passages are summed at once. An item
is retrieved if it scores at least ``share`` of what its own text scores, with no cap on
how many; the passage is then verified: it must hold the question's and the answer's word
n-grams to the shares asked for.

The index is broadcast in shards of ``SHARD_ITEMS`` items, each cut to ``SHARD_WORDS``
words at most by starting a new shard, so no broadcast grows with the benchmark. Shards of
``SHARD_WORDS`` words together share one map over the texts, which splits each text once for
all of them, and a process builds a shard's index once. Document frequencies, mean length and the window are those
of the whole benchmark, so no score depends on which items share a shard.
"""
from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage

K1, B = 1.2, 0.75
SHARE = 0.5
QUESTION, ANSWER = 0.6, 0.6
QUESTION_N, ANSWER_N = 5, 3
SHARD_ITEMS, SHARD_WORDS = 4000, 1_000_000

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?:])\s+|\n+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence, and those of the last; an item of one sentence
    is a question whose last quarter (3 words at least) is the answer."""
    parts = [w for w in map(words, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    all_words = parts[0] if parts else []
    return all_words, all_words[-max(3, len(all_words) // 4) :]


def _ngrams(w: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


class Index:
    """BM25 impacts of one shard of items: (id, text) rows. Items without words are left out.
    ``of_all``: the benchmark's number of items, words and words of the longest item, and the
    document frequency of each of the shard's terms; without it the shard is the benchmark."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = SHARE, of_all: tuple[int, int, int, dict[str, int]] | None = None) -> None:
        rows = [(i, t, w) for i, t in items if (w := words(t))]
        n_items, n_words, longest = of_all[:3] if of_all else (len(rows), sum(len(w) for _, _, w in rows), max([0, *(len(w) for _, _, w in rows)]))
        mean = n_words / max(1, n_items)
        self.vocab: dict[str, int] = {}
        counts = []
        for _, _, w in rows:
            tf: dict[int, int] = {}
            for x in w:
                t = self.vocab.setdefault(x, len(self.vocab))
                tf[t] = tf.get(t, 0) + 1
            counts.append(tf)
        df = np.zeros(max(1, len(self.vocab)))
        for tf in counts:
            df[list(tf)] += 1
        if of_all:
            df[: len(self.vocab)] = [of_all[3][x] for x in self.vocab]
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        impact = [{t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(rows[k][2]) / mean)) for t, n in tf.items()} for k, tf in enumerate(counts)]
        own = np.array([sum(x.values()) for x in impact])
        order = np.argsort(own, kind="stable")  # blocks of items with like thresholds
        self.items = [rows[k] for k in order]
        self.threshold = share * own[order] - 1e-9
        size = max(8, len(rows) // 64)
        self.block = np.arange(len(rows)) // size
        self.n_blocks = int(self.block[-1]) + 1 if rows else 0
        self.lowest = np.array([self.threshold[self.block == b].min() for b in range(self.n_blocks)], np.float32)
        self.upper = np.zeros((len(self.vocab), self.n_blocks), np.float32)
        posts = sorted((t, pos, v) for pos, k in enumerate(order) for t, v in impact[k].items())
        self.post_item = np.array([p for _, p, _ in posts], np.int64)
        self.post_impact = np.array([v for _, _, v in posts])
        if posts:
            term = np.array([t for t, _, _ in posts])
            np.maximum.at(self.upper, (term, self.block[self.post_item]), self.post_impact.astype(np.float32) * np.float32(1.000001))
            self.start = np.searchsorted(term * self.n_blocks + self.block[self.post_item], np.arange(len(self.vocab) * self.n_blocks + 1))
        self.best = self.upper.max(axis=1, initial=0)
        self.window = 2 * max(32, longest)
        self.parts = [tuple(_ngrams(w, n) for w, n in zip(question_answer(t), (QUESTION_N, ANSWER_N), strict=True)) for _, t, _ in self.items]
        self.row_words = len(rows)

    def retrieve(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(text, first word, item position, score) of every item at or above its threshold
        in some passage. ``docs``: the term of each word, -1 outside the vocabulary."""
        half = self.window // 2
        passage, term, where = [], [], []
        n = 0
        for k, t in enumerate(docs):
            at = np.flatnonzero(t >= 0)
            if not len(at):
                continue
            last = max(0, (len(t) - 1) // half - 1)  # windows 0..last begin at multiples of half
            cell = at // half
            first, second = np.minimum(cell, last), np.minimum(np.maximum(cell - 1, 0), last)
            both = first != second
            passage += [n + first, n + second[both]]
            term += [t[at], t[at][both]]
            where += [(k, w) for w in range(last + 1)]
            n += last + 1
        if not n:
            return []
        key = np.unique(np.concatenate(passage).astype(np.int64) * len(self.vocab) + np.concatenate(term))
        p, t = key // len(self.vocab), key % len(self.vocab)
        live = np.bincount(p, self.best[t], n) >= self.lowest.min()
        p, t = p[live[p]], t[live[p]]
        if not len(p):
            return []
        out = []
        heads = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        bound = np.add.reduceat(self.upper[t], heads, axis=0)
        rows, blocks = np.nonzero(bound >= self.lowest[None])
        if not len(rows):
            return []
        ends = np.r_[heads[1:], len(p)]
        # the terms of each (passage, block) left, then their postings inside the block
        size = ends[rows] - heads[rows]
        pair = np.repeat(np.arange(len(rows)), size)
        tt = t[np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(heads[rows], size)]
        cell = tt * self.n_blocks + blocks[pair]
        lo, count = self.start[cell], self.start[cell + 1] - self.start[cell]
        post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        scored = np.repeat(pair, count) * len(self.items) + self.post_item[post]
        distinct, inverse = np.unique(scored, return_inverse=True)
        total = np.bincount(inverse, self.post_impact[post])
        item = distinct % len(self.items)
        hit = total >= self.threshold[item]
        for d, s, i in zip(distinct[hit] // len(self.items), total[hit], item[hit], strict=True):
            k, w = where[p[heads[rows[d]]]]
            out.append((k, w * half, int(i), float(s)))
        return out

    def find(self, texts: list[str | None]) -> list[tuple[int, int, float, float, float]]:
        """(text, item id, score, question share, answer share) of every verified leak: the
        best passage of each."""
        return self.find_words([words(t) for t in texts])

    def find_words(self, lists: list[list[str]]) -> list[tuple[int, int, float, float, float]]:
        """As ``find``, of texts split to words."""
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        get, at = self.vocab.get, 0
        while at < len(lists):
            batch, size, begin = [], 0, at
            while at < len(lists) and (not batch or size < 200_000):
                batch.append(lists[at])
                size += len(batch[-1])
                at += 1
            terms = [np.array([get(w, -1) for w in ws], np.int64) for ws in batch]
            for k, first, i, s in self.retrieve(terms):
                ws = batch[k][first : first + self.window]
                q, a = self.parts[i]
                shares = [len(x & _ngrams(ws, len(next(iter(x))))) / len(x) if x else 1.0 for x in (q, a)]
                if shares[0] >= QUESTION and shares[1] >= ANSWER:
                    key = (begin + k, self.items[i][0])
                    found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (s, *shares))
        return [(k, i, *v) for (k, i), v in sorted(found.items())]


_BUILT: dict[bytes, Index] = {}


def _indexes(blobs: list[bytes]) -> list[Index]:
    """The index of each shard, built once a process; those of other shards go."""
    keys = [hashlib.sha256(b).digest() for b in blobs]
    for old in set(_BUILT) - set(keys):
        del _BUILT[old]
    for key, blob in zip(keys, blobs, strict=True):
        if key not in _BUILT:
            items, of_all = pickle.loads(blob)
            _BUILT[key] = Index(items, of_all=of_all)
    return [_BUILT[k] for k in keys]


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str | None]]]:
    """The items, a bounded number of items and words at a time."""
    part, size = [], 0
    for r in benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
            F.col("text").isNotNull() & F.col("id").isNotNull()).toLocalIterator():
        n = len(words(r["text"]))
        if part and (len(part) >= SHARD_ITEMS or size + n > SHARD_WORDS):
            yield part
            part, size = [], 0
        part.append((r["id"], r["text"]))
        size += n
    if part:
        yield part


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [words(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(map(len, lists), pa.int64()), pa.array([sorted(set(w)) for w in lists], pa.list_(pa.string()))], names=["n", "terms"])


def frequencies(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[tuple[int, int, int], DataFrame]:
    """(items, words, words of the longest item) of the benchmark, and its (term, df)."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    items = items.mapInArrow(_terms, "n long, terms array<string>").where("n > 0")
    n_items, n_words, longest = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    df = items.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (n_items, n_words, longest), Stage(benchmark.sparkSession, "benchmark-terms").write(df, "df")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, score, question_share, answer_share): one row per row of ``docs`` and
    item that it leaks. Null or empty texts leak nothing; an empty benchmark gives no rows;
    items alike give a row each; repeated rows of ``docs`` give repeated rows. Texts of any length
    are searched whole, in windows; of an item's passages with the same score the one with the
    larger shares is told."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, score double, question_share double, answer_share double"
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def mapper(shared: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [x for x in _indexes([b.value for b in shared]) if x.items]
            for batch in batches:
                lists = [words(t) for t in batch.column(1).to_pylist()] if indexes else []
                found = [f for index in indexes for f in index.find_words(lists)]
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array([f[1] for f in found]).cast(pa.int64() if item_kind in ("bigint", "int") else pa.string()) if found else pa.array([], pa.int64() if item_kind in ("bigint", "int") else pa.string()),
                     *[pa.array([f[c] for f in found], pa.float64()) for c in (2, 3, 4)]],
                    names=["id", "item_id", "score", "question_share", "answer_share"])
        return run

    out, parts = None, shards(benchmark, item_col, item_text_col)
    first = list(islice(parts, 2))  # a benchmark of one shard has its own frequencies
    total, table = frequencies(benchmark, item_col, item_text_col) if len(first) > 1 else (None, None)
    shared: list = []
    held_words = 0

    def scan(out: DataFrame | None) -> DataFrame:
        one = own.mapInArrow(mapper(list(shared)), schema)
        return one if out is None else out.unionByName(one)

    for part in chain(first, parts):
        of_all = None
        if total:
            held = spark.createDataFrame([(x,) for x in {x for _, t in part for x in words(t)}], "term string")
            of_all = (*total, {r["term"]: r["df"] for r in table.join(F.broadcast(held), "term", "left_semi").collect()})
        size = sum(len(words(t)) for _, t in part)
        if shared and held_words + size > SHARD_WORDS:
            out, held_words = scan(out), 0
            shared.clear()
        shared.append(spark.sparkContext.broadcast(pickle.dumps((part, of_all))))
        held_words += size
    if shared:
        out = scan(out)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)
