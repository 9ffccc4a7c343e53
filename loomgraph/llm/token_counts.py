"""Token counts with overlap resynchronisation for huge texts.

A text of at most ``chunk`` characters is cut at its white space, where the same argument
holds as below: its pieces are counted one by one and remembered, so a piece that occurs
in many texts is encoded once a process. A longer text is cut to chunks that overlap; each
is encoded with offsets, and neighbours are spliced in the overlap at a place that is proven
stable and on whose right, up to the last stable place, the two encodings agree.

A place is stable if the tokenizer splits there whatever stands around it: before white
space, which is dropped; and between two characters that the split pattern never puts in
one piece - a digit and anything, a letter and a mark - where neither is changed by its
neighbour in the normal form (plain letters, kana, common ideographs, ASCII and a few wide
marks). An apostrophe before a letter may begin a contraction, and what lies inside a
special string is one token: neither is stable. Where an overlap has no two such places it
is widened to the left, at most to the last splice; where that has none either, the chunk is
encoded again from the last splice up to the next stable places on its right, which are
looked up in the text. A run of letters without any is thus encoded once more, at its whole
length, and the work grows with the text.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16384
OVERLAP = 256
LIMIT = 2048
#: Pieces that a process remembers at most, and the characters of each.
PIECES, PIECE = 600_000, 64

#: Letters and marks that no normal form joins with a neighbour of this table, and that are
#: letters, or neither letters, digits nor white space, to the split pattern.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u0418\u041a-\u0438\u043a-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5"
_M = "!\"#$%&()*+,\\-./:;<=>?@\\[\\]\\\\^_`{|}~\u3001\u3002\u300c\u300d\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_STABLE = re.compile(rf"(?=[ \n\t\r])|(?<=[{_L}])(?=[0-9'{_M}])|(?<=[0-9])(?=[{_L}0-9'{_M}])|(?<=[{_M}])(?=[{_L}0-9])|(?<=')(?=[0-9])")

_LOADED: dict = {}


def load(path: str):
    """The tokenizer of a file, once a process, without truncation or padding."""
    if path not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def _encode(tok, text: str, base: int) -> list[tuple[int, int, int]]:
    e = tok.encode(text, add_special_tokens=False)
    return [(base + s, base + t, i) for i, (s, t) in zip(e.ids, e.offsets, strict=True)]


def stable_places(text: str, lo: int, hi: int, special: tuple[str, ...] = ()) -> list[int]:
    """The stable places p in [lo, hi), that is between text[p - 1] and text[p]."""
    return [p for m in _STABLE.finditer(text, lo, hi) if 0 < (p := m.start()) < hi and not _inside(text, p, special)]


def _inside(text: str, p: int, special: tuple[str, ...]) -> bool:
    return any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in special)


def _agreed(left: list, right: list, places: list[int]) -> int | None:
    """The first of the places from which both encodings agree up to the last of them."""
    end = places[-1]
    crossed = {p for x in (*left, *right) if x[1] - x[0] > 1 for p in range(max(x[0] + 1, places[0]), min(x[1], end + 1))}
    for p in places[:-1]:
        if p not in crossed and end not in crossed and [x for x in left if p <= x[0] and x[1] <= end] == [x for x in right if p <= x[0] and x[1] <= end]:
            return p
    return None


def encode_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text of any length, as encoding it at once gives them."""
    n = len(text)
    if n <= chunk:
        return tok.encode(text, add_special_tokens=False).ids
    special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    done: list[int] = []
    at, stop, width = 0, chunk, overlap  # what is left of ``at`` is done; ``left`` encodes [at, stop) as it is
    left = _encode(tok, text[:stop], 0)
    while stop < n:
        lo = max(at, stop - width)
        places = stable_places(text, lo, stop, special)
        if len(places) > 1:
            nxt = min(n, stop + chunk)
            right = _encode(tok, text[lo:nxt], lo)
            p = _agreed([x for x in left if x[1] > lo], [x for x in right if x[0] < stop], places)
            if p is not None:
                done += [i for s, _, i in left if s < p]
                left, at, stop, width = [x for x in right if x[0] >= p], p, nxt, overlap
                continue
        if lo > at:
            width *= 2
            continue
        more, to = [], stop
        while len(more) < 2 and to < n:
            to = min(n, to + max(chunk, to - stop))
            more = [p for p in stable_places(text, stop, to, special) if p > stop][:2]
        stop = max(more[1] + 1, min(n, stop + overlap)) if len(more) > 1 else n
        if len(places) > 1:
            stop = min(n, max(stop, 2 * stop - at))  # places where the encodings differed: leave them far behind
        left, width = _encode(tok, text[at:stop], at), overlap
    return done + [i for _, _, i in left]


class PieceCounts:
    """Tokens of white-space-free pieces; those of at most PIECE characters are remembered, PIECES at a time."""

    def __init__(self, tok) -> None:
        self.tok, self.known = tok, {"": 0}

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = list({p for ps in pieces for p in ps if p not in self.known})
        if len(self.known) + len(new) > PIECES:
            self.known = {"": 0}
            new = list({p for ps in pieces for p in ps if p})
        long: dict[str, int] = {}
        for k in range(0, len(new), 1024):
            part = new[k : k + 1024]
            for p, n in zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False)), strict=True):
                (self.known if len(p) <= PIECE else long)[p] = n
        if long:
            return [sum(self.known[p] if p in self.known else long[p] for p in ps) for ps in pieces]
        return [sum(map(self.known.__getitem__, ps)) for ps in pieces]


def _counter(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        pieces = _LOADED.setdefault(("pieces", path), PieceCounts(tok))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if t and len(t) <= chunk]
            for k in range(0, len(short), 64):
                part = short[k : k + 64]
                for i, n in zip(part, pieces.counts([texts[i] for i in part]), strict=True):
                    counts[i] = n
            for i, t in enumerate(texts):
                if t and len(t) > chunk:
                    counts[i] = len(encode_long(tok, t, chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    Null counts as empty: 0 bytes, 0 tokens. Texts of any length are counted whole, repeated
    rows each; an empty table gives an empty table. Map only; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        _counter(tokenizer_path, chunk, overlap), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
