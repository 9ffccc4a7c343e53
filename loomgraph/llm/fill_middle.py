"""Fill-in-the-middle transformation of documents.

The Split pre-tokenizer of the tokenizers library, with isolated matches of one expression,
gives the code-point offsets of a text's tokens; nothing is trained. The length of the
offset array is the number n of tokens, and two places among 0 to n, ranked, give prefix,
middle and suffix as slices of the text at those offsets. All choices come from a hash of
seed and id, so a lost task gives the same rows again.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The token pattern, the sentinels and the shares.
PATTERN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80

#: Code points that the library cuts at a time; a longer text is parted where a token must begin.
PART = 1 << 18
_BEGIN = re.compile(r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")
_RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"
_SPLIT: dict[str, object] = {}


def splitter(pattern: str = PATTERN):
    """The Split pre-tokenizer, made once a process."""
    if pattern not in _SPLIT:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        _SPLIT[pattern] = Split(Regex(pattern), behavior="isolated")
    return _SPLIT[pattern]


def offsets(text: str, part: int = PART) -> np.ndarray:
    """0 and the end of each token of the text, in code points. Where white space follows
    something else a token begins whatever stands around it, so a long text is cut in
    parts there; a part without such a place grows until it has one."""
    split, ends, at = splitter(), [np.zeros(1, np.int64)], 0
    while at < len(text):
        found = _BEGIN.search(text, at + part) if len(text) - at > part else None
        to = found.start() if found else len(text)
        pieces = split.pre_tokenize_str(text[at:to])
        ends.append(np.fromiter((end for _, (_, end) in pieces), np.int64, len(pieces)) + at)
        at = to
    return np.concatenate(ends)


def transform(text: str, h1: int, h2: int, h3: int, h4: int, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text under its four hashes."""
    at = offsets(text)
    n = len(at) - 1
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (int(at[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_rate:
        return n, "spm", low, high - low, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", low, high - low, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def hashes(id_col: str, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of sha256 of ``seed:id``; a null id is written as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from output and form alone. The text holds no
    sentinel, so the first of each kind is the one that was put in."""
    out = F.col(output)
    between = lambda a, b: F.substring_index(F.substring(out, len(a) + 1, 2**31 - 1), b, 1)
    rest = lambda mark, to: F.substring(out, F.locate(mark, out) + len(mark), to)
    middle = rest(MIDDLE, 2**31 - 1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, rest(SUFFIX, F.locate(MIDDLE, out) - F.locate(SUFFIX, out) - len(SUFFIX)))
    spm = F.concat(rest(PREFIX, F.locate(MIDDLE, out) - F.locate(PREFIX, out) - len(PREFIX)), middle, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output (the transformed text).

    Map only: whole texts reach a worker in batches bounded by bytes, everything else stays
    in the JVM. A null or empty text is plain with 0 tokens and an empty output; a text that
    holds a sentinel stays plain; a null id is hashed as an empty one; repeated rows give
    equal results; an empty table gives an empty one. Columns of ``docs`` that have the
    name of a result are replaced by it.
    """
    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [transform(*row, rate, spm_rate) for row in zip(*(s.tolist() for s in batch), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"n": n, "form": form, "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"), "output": output})

    names = [part.split()[0] for part in _RESULT.split(", ")]
    made = run(F.coalesce(F.col(text_col), F.lit("")), *hashes(id_col, seed))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, made.alias("made__")).select(*kept, *(F.col(f"made__.{c}").alias(c) for c in names))
