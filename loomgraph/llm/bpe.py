"""Byte-level BPE: a minimal acyclic transducer for frequent words, exact merges for the rest.

``build_lexicon`` counts words over the whole corpus and compiles the frequent ones, with
the ids that the merges give them, into a minimal automaton that shares prefixes and
suffixes. Each edge carries the number of accepted words that sort before it, so walking
a word gives its rank, and the rank its ids. The automaton is flat arrays in one file that
each executor memory-maps; its workers share the pages. Words outside it are merged by
rank, exactly, so the lexicon decides speed and never the result. Decoding joins the bytes
of the ids.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is frequent where it makes up this share of the words of some partition. A word
#: with the share over the whole corpus has it in one partition at least, so none is missed.
SHARE = 2e-6
#: Words in the automaton at most: the most frequent. The others are merged, exactly.
LEXICON_WORDS = 60_000
#: Words a process remembers at most; beyond that it starts anew.
CACHE_WORDS = 500_000

NEVER = 1 << 62

#: Within these characters Python's classes are those of the tokenizer's pattern.
_COMMON = re.compile(r"[\n\t\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xbb\xbf-ɏ]*")
_WORDS = re.compile(r"'(?:[sdmt]|ll|re|ve)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _byte_chars() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for: printable ones are
    themselves, the others are numbered from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """The vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_chars()
        raw = lambda s: bytes(to_byte[c] for c in s)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(w): i for w, i in model["vocab"].items() if w not in self.special}
        self.bytes = {i: w for w, i in self.ids.items()} | {i: w.encode() for w, i in self.special.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.code: dict[tuple[int, int], int] = {}  # of a pair of ids: its rank and the id that it gives, as one number
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(a), raw(b)
            self.code[self.ids[a], self.ids[b]] = r << 32 | self.ids[a + b]
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        from tokenizers import Tokenizer

        self._pre = Tokenizer.from_file(path).pre_tokenizer

    def words(self, text: str) -> list[str]:
        """The words that merges never cross; special strings are words of their own."""
        if self._split and any(s in text for s in self.special):
            out: list[str] = []
            for part in self._split.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if _COMMON.fullmatch(text):
            return _WORDS.findall(text)
        return [text[s:e] for _, (s, e) in self._pre.pre_tokenize_str(text)] if text else []

    def merge(self, word: str) -> list[int]:
        """The ids of one word: the pair of lowest rank merges first, the leftmost on ties."""
        if word in self.special:
            return [self.special[word]]
        return self._merge_heap(word) if len(word) > 64 else self._merge_scan(word)

    def _merge_scan(self, word: str) -> list[int]:
        single, get = self.single, self.code.get
        ids = [single[b] for b in word.encode()]
        codes = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while codes and (best := min(codes)) != NEVER:
            i = codes.index(best)
            ids[i : i + 2] = [new] = [best & 0xFFFFFFFF]
            del codes[i]
            if i:
                codes[i - 1] = get((ids[i - 1], new), NEVER)
            if i < len(codes):
                codes[i] = get((new, ids[i + 1]), NEVER)
        return ids

    def _merge_heap(self, word: str) -> list[int]:
        """As _merge_scan, in n log n for very long words."""
        ids = [self.single[b] for b in word.encode()]
        n = len(ids)
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (code := self.code.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (code >> 32, i, ids[i], ids[j], code & 0xFFFFFFFF))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = new, False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


# --- the automaton -------------------------------------------------------------------

def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words, built from their sorted list: states
    that nothing can be added to any more are replaced by an equal one if there is one."""
    words = sorted(w for w in entries if w)
    states: list[tuple[list[tuple[int, int]], bool]] = []  # edges, accepts
    known: dict[tuple, int] = {}

    def settle(node: list) -> int:
        key = (node[1], tuple(node[0]))
        if key not in known:
            known[key] = len(states)
            states.append((node[0], node[1]))
        return known[key]

    path: list[list] = [[[], False]]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            done = settle(path.pop())
            path[-1][0].append((last[len(path) - 1], done))

    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(common)
        for _ in range(common, len(w)):
            path.append([[], False])
        path[-1][1] = True
        last = w
    close(0)
    root = settle(path[0])
    total = [0] * len(states)
    for i, (edges, ok) in enumerate(states):  # targets come before their sources
        total[i] = ok + sum(total[t] for _, t in edges)
    first, label, target, skip = [0], [], [], []
    for edges, ok in states:
        before = int(ok)
        for c, t in edges:
            label.append(c)
            target.append(t)
            skip.append(before)
            before += total[t]
        first.append(len(label))
    ids = [entries[w] for w in words]
    arrays = [np.array(x, "<i4") for x in (first, target, skip, [ok for _, ok in states],
              np.cumsum([0, *map(len, ids)]), [i for x in ids for i in x])]
    return struct.pack("<8i", root, *map(len, arrays), len(label)) + b"".join(a.tobytes() for a in arrays) + bytes(label)


class Lexicon:
    """A compiled automaton over a buffer."""

    def __init__(self, buffer) -> None:
        head = struct.unpack_from("<8i", buffer)
        self.root, at, parts = head[0], 32, []
        for n in head[1:7]:
            parts.append(memoryview(buffer)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.skip, self.ok, self.start, self.ids = parts
        self.labels, self.find = at, buffer.find  # the labels of the edges, a byte each

    def get(self, word: bytes) -> list[int] | None:
        state, rank, first, labels, find = self.root, 0, self.first, self.labels, self.find
        for k in range(len(word)):
            edge = find(word[k : k + 1], labels + first[state], labels + first[state + 1]) - labels
            if edge < 0:
                return None
            rank += self.skip[edge]
            state = self.target[edge]
        return self.ids[self.start[rank] : self.start[rank + 1]].tolist() if self.ok[state] and word else None


def mapped(blob: bytes) -> Lexicon:
    """The automaton as a memory-mapped file of this machine, named by its content. It is a copy of
    the broadcast blob for the mapping's sake, checked when a process opens it and made again where
    it is gone or not whole."""
    digest = hashlib.sha256(blob).hexdigest()
    path = os.path.join(tempfile.gettempdir(), f"lexicon-{digest[:20]}.bin")
    whole = False
    if os.path.exists(path):
        with open(path, "rb") as f:
            whole = hashlib.file_digest(f, "sha256").hexdigest() == digest
    if not whole:
        with tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as f:
            f.write(blob)
        os.replace(f.name, path)
    with open(path, "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


_PROCESS: dict = {}


def _bpe(path: str) -> ByteBPE:
    if ("bpe", path) not in _PROCESS:
        _PROCESS["bpe", path] = ByteBPE(path)
    return _PROCESS["bpe", path]


class _Encoded(dict):
    """word -> its ids as bytes; at most CACHE_WORDS of them at a time."""

    def __init__(self, bpe: ByteBPE, lexicon: Lexicon | None) -> None:
        super().__init__()
        self.bpe, self.lexicon = bpe, lexicon

    def __missing__(self, word: str) -> bytes:
        ids = self.lexicon.get(word.encode()) if self.lexicon else None
        if ids is None:
            ids = self.bpe.merge(word)
        out = array("I", ids).tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out
        return out


def frequent_words(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                   share: float = SHARE, top: int = LEXICON_WORDS) -> DataFrame:
    """The ``top`` most frequent words of all texts, as far as one partition at least has
    them with the given share. Each partition sends its frequent words only."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, total = _bpe(tokenizer_path), Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    words = bpe.words(t)
                    total += len(words)
                    seen.update(words)
            if len(seen) > 3 * CACHE_WORDS:  # what cannot reach the share of what was read goes
                seen = Counter({w: n for w, n in seen.items() if n > share * total})
        out = [(w, n) for w, n in seen.items() if n >= max(2, share * total)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())],
                                         names=["word", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(top).select("word")


def build_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> bytes:
    """The compiled lexicon of the frequent words. Their ids are made by an executor too, so the
    driver holds words and ids, and no tokenizer."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if w not in bpe.special]
            yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary()), pa.array([bpe.merge(w) for w in words], pa.list_(pa.int64()))], names=["word", "ids"])

    rows = frequent_words(docs, tokenizer_path, text_col).mapInArrow(merged, "word binary, ids array<long>").toArrow()
    return compile_lexicon(dict(zip(rows.column("word").to_pylist(), rows.column("ids").to_pylist(), strict=True)))


def encode_decode(docs: DataFrame, tokenizer_path: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text",
                  digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded), one row per row of ``docs``; with ``digests`` the
    SHA-256 of the ids (little-endian, 32 bits each) and of the decoded text instead.

    Null counts as empty: no ids, empty text. Texts of any length are encoded whole, repeated rows
    each; an empty table gives an empty table. ``lexicon`` is bounded by LEXICON_WORDS, so
    its broadcast does not grow with the corpus. Map only; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(tokenizer_path)
        if (key := ("cache", tokenizer_path, hashlib.sha256(shared.value).digest())) not in _PROCESS:
            _PROCESS[key] = _Encoded(bpe, mapped(shared.value))
        cache = _PROCESS[key]
        pieces = [bpe.bytes.get(i, b"") for i in range(max(bpe.bytes) + 1)]
        for batch in batches:
            counts, ids, back = [], [], []
            for t in batch.column(1).to_pylist():
                code = b"".join(map(cache.__getitem__, bpe.words(t))) if t else b""
                numbers = memoryview(code).cast("I")
                plain = b"".join(map(pieces.__getitem__, numbers))
                counts.append(len(numbers))
                if digests:
                    ids.append(hashlib.sha256(code).hexdigest())
                    back.append(hashlib.sha256(plain.decode("utf-8", "replace").encode()).hexdigest())
                else:
                    ids.append(numbers.tolist())
                    back.append(plain.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int64())), pa.array(back, pa.string())],
                names=["id", "n_tokens", "a", "b"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, a {'string' if digests else 'array<long>'}, b string")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("a").alias(names[0]), F.col("b").alias(names[1]))
