"""Fill-in-middle, hard negatives and fingerprints against brute force, and their edge cases."""
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fill_middle, fingerprints, hard_negatives
from loomgraph.llm.common import bound_arrow
from loomgraph.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.helpers import agrees, connect
from tests.llm.test_operators import ODD, docs, rows, text


# --- 11 fill in the middle ------------------------------------------------------------------

def test_offsets_are_the_matches_of_the_pattern():
    r = random.Random(5)
    for _ in range(2000):
        t = "".join(r.choice([" ", "\t", "\n", "\x0b", "a", "é", "🙂", "\x00", " ", " ", "<"]) for _ in range(r.randint(0, 40)))
        want = [m.end() for m in re.finditer(fill_middle.PATTERN, t)]
        assert fill_middle.offsets(t)[1:].tolist() == want
        assert fill_middle.offsets(t, 3)[1:].tolist() == want


def test_long_texts_are_cut_in_parts():
    t = "x" * 600_000 + " y  z" * 100_000 + " " * 600_000
    assert fill_middle.offsets(t)[1:].tolist() == [m.end() for m in re.finditer(fill_middle.PATTERN, t)]


def test_fill_in_middle_edges(spark):
    bound_arrow(spark)
    d = docs(spark, [*ODD, "a <P> b", "x<S>", "<M>", "< P> <", "<<<P", "a b c <", "S> <S >"] + ["p q r s <"] * 40)
    got = rows(fill_middle.fill_in_middle(d.withColumn("form", F.lit("clash"))).withColumn("back", fill_middle.restored()))
    whole = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    for k, r in got.items():
        assert r["back"] == whole[k] and r["id"] == "clash" and r["n"] == len(re.findall(fill_middle.PATTERN, whole[k]))
        if any(m in whole[k] for m in ("<P>", "<S>", "<M>")) or not whole[k]:
            assert r["form"] == "plain" and r["output"] == whole[k]
        if r["form"] == "plain":
            assert r["prefix_chars"] is None and r["middle_chars"] is None
        else:
            p, m = r["prefix_chars"], r["middle_chars"]
            a, b, c = whole[k][:p], whole[k][p : p + m], whole[k][p + m :]
            assert r["output"] == (f"<S>{c}<P>{a}<M>{b}" if r["form"] == "spm" else f"<P>{a}<S>{c}<M>{b}")
    assert {r["form"] for r in got.values()} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(d.limit(0)).count() == 0
    same = fill_middle.fill_in_middle(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert same[0] == same[1] and len(same) == 4


# --- 12 hard negatives ----------------------------------------------------------------------

def mined(data, anchor, positives=5, negatives=10):
    """Brute force over (id, label, whole-number components)."""
    out = []
    for i, (a, la, x) in enumerate(data):
        if not anchor(a):
            continue
        s = [(-int(np.dot(x, y)), b, lb) for j, (b, lb, y) in enumerate(data) if j != i and len(y) == len(x) and b != a]
        for ps, p, _ in sorted(t for t in s if t[2] == la)[:positives]:
            fits = sorted(t for t in s if t[2] != la and 30 * -ps <= 100 * -t[0] <= 90 * -ps)[:negatives]
            out += [(a, p, k + 1, b, -ps, -ns) for k, (ns, b, _) in enumerate(fits)]
    return sorted(out)


def vectors(spark, data):
    return spark.createDataFrame([(i, lab, [float(v) for v in x] if x is not None else None) for i, lab, x in data], "vec_id long, label int, embedding array<double>").repartition(3)


@pytest.mark.parametrize("kind", ["clusters", "ties", "norms"])
def test_hard_negatives_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "GROUP", 8)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    r = np.random.default_rng(7)
    n, dim = 400, 5
    if kind == "ties":
        x = r.integers(0, 2, (n, dim))
    elif kind == "norms":
        x = r.integers(-3, 4, (n, dim)) * r.integers(0, 30, (n, 1))
    else:
        x = r.integers(-40, 40, (8, dim))[r.integers(0, 8, n)] + r.integers(-3, 4, (n, dim))
    data = [(i, int(r.integers(0, 3)), row) for i, row in enumerate(x)]
    data += [(1000 + i, 1, x[0]) for i in range(60)]  # one vector many times
    got = hard_negatives.hard_negatives(vectors(spark, data), F.col("vec_id") % 7 == 0, scale=1)
    assert sorted(tuple(t) for t in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined(data, lambda i: i % 7 == 0)


def test_bounds_hold():
    r = np.random.default_rng(3)
    rows_, anchors = np.floor(r.normal(size=(300, 6)) * 50), np.floor(r.normal(size=(40, 6)) * 50)
    pivots = hard_negatives.Pivots(rows_[:12], (rows_**2).sum(axis=1).max())
    d = pivots.distances(pivots.raised(rows_))
    cell, rho = d.argmin(axis=1), d.min(axis=1)
    least, most = pivots.reach(anchors, cell, rho, rho)
    s = anchors @ rows_.T
    assert (least <= s).all() and (s <= most).all()


def test_hard_negatives_edges(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, []), (6, 2, [nan, 1.0]), (7, 2, [inf, 0.0]), (8, 2, [1.0]), (9, 1, [2.0]), (10, 1, [3.0]), (None, 2, [0.5, 0.6])]
    d = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").withColumn("a", F.lit("clash"))
    holed = d.unionByName(spark.createDataFrame([(11, 2, [0.5, None], "x")], "vec_id long, label int, embedding array<double>, a string"))
    got = {tuple(t) for t in hard_negatives.hard_negatives(holed, F.col("vec_id") >= 0).select("anchor_id", "positive_id", "negative_id").collect()}
    assert got == {(0, 1, 2), (1, 0, 2), (9, 10, 8), (10, 9, 8)}
    assert hard_negatives.hard_negatives(d.limit(0), F.col("vec_id") >= 0).count() == 0


def test_scores_are_exact_for_large_components():
    a, b = np.array([[2.0**40, 1.0, -(2.0**40)]]), np.array([[1.0, 3.0, 1.0]])
    assert hard_negatives.scores(a, b).tolist() == [[3]]
    assert hard_negatives.scores(np.array([[2.0**60]]), np.array([[2.0**3]])).tolist() == [[hard_negatives.LARGEST]]


# --- 13 fingerprints ------------------------------------------------------------------------

def bag(t):
    words = re.findall(r"[a-zà-ÿ0-9]+", t.lower())
    return collections.Counter(words or ([t.strip()] if t.strip() else []))


def likeness(a, b):
    a, b = bag(a), bag(b)
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def test_fingerprints_estimate_the_generalised_jaccard_similarity(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefgh") * r.choice([1, 1, 2]) for _ in range(r.choice([3, 12, 60, 300]))) for _ in range(50)] + ["one two three", "one two three", "ONE, two; three"]
    got = rows(fingerprints.fingerprint_documents(docs(spark, texts), samples=512))
    errors = []
    for i, t in enumerate(texts):
        nxt, half = texts[(i + 1) % len(texts)], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[i]["near_edited"] - likeness(t, edited), got[i]["near_next"] - likeness(t, nxt)]
    assert max(map(abs, errors)) < 0.12 and abs(sum(errors) / len(errors)) < 0.01 and math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.03
    assert got[50]["fingerprint"] == got[51]["fingerprint"] == got[52]["fingerprint"] and got[50]["near_next"] == 1.0


def test_fingerprints_edges(spark):
    texts = [*ODD, "a" * 7, "🙂é " * 5, text(random.Random(1), 50)]
    got = rows(fingerprints.fingerprint_documents(docs(spark, texts)))
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert (got[i]["fingerprint"] == "") == (not t.strip())
    d = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "p q r s"), (3, "u v"), (3, "w")], "doc_id long, text string").withColumn("slot", F.lit(1))
    out = fingerprints.fingerprint_documents(d)
    assert out.count() == 5 and out.where("doc_id = 1").distinct().count() == 1
    assert [r["near_next"] for r in out.where("doc_id is null").collect()] == [0.0]
    assert out.where("doc_id is null").first()["edited_sha256"] == hashlib.sha256(b"p q ").hexdigest()
    alone = fingerprints.fingerprint_documents(d.limit(1)).first()
    assert alone["near_next"] == 1.0
    assert fingerprints.fingerprint_documents(d.limit(0)).count() == 0
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in out._jdf.queryExecution().toString()]


# --- queries --------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_hard_negatives"])
def test_new_query_equals_sql(spark, name):
    assert agrees(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
