"""The approximate index against brute force."""
import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import vector_index as vi
from loomgraph.operators import vectors as vx
from loomgraph.plans import ORACLES, QUERIES
from tests.conftest import SF
from tests.helpers import agrees, connect

ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] + [1.0] * 7), (9005, [1.0] * 7), (9006, [None] + [1.0] * 7)]


def table(spark, n=600, dim=8):
    r = np.random.default_rng(1)
    x = r.normal(size=(12, dim))[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, dim))
    data = [(i, row.tolist()) for i, row in enumerate(x)]
    return data, spark.createDataFrame([*data, *ODD], "chunk_id long, vec array<double>").withColumn("codes", F.lit("clash"))


def exact(data, q, k):
    x = np.array([v for _, v in data])
    s = np.round(x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 4)
    return [(i, float(s[i])) for i in np.lexsort((np.arange(len(s)), -s))[:k]]


def test_search_prunes_and_finds(spark, tmp_path):
    data, df = table(spark)
    vi.build(df, str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix" / "rows")).count() == len(data)
    assert spark.read.parquet(str(tmp_path / "ix" / "settings")).first()["recall"] >= vi.RECALL
    hits = 0
    for i in range(0, 600, 60):
        q = np.array(data[i][1])
        found = vi.search(spark, str(tmp_path / "ix"), q.tolist(), 5, probes=4)
        assert "cell#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "PartitionFilters: [cell" in plan
        want = exact(data, q, 5)
        got = [(r["chunk_id"], r["score"]) for r in found.collect()]
        assert got[0] == want[0]
        hits += len(set(got) & set(want))
    assert hits >= 45


def test_all_cells_give_the_exact_answer(spark, tmp_path):
    data, df = table(spark, 200)
    vi.build(df, str(tmp_path / "ix"))
    q = np.array(data[3][1]) + 0.1
    got = vi.search(spark, str(tmp_path / "ix"), q.tolist(), 7, probes=10_000, depth=100)
    assert [(r["chunk_id"], r["score"]) for r in got.collect()] == exact(data, q, 7)
    only = vi.search(spark, str(tmp_path / "ix"), q.tolist(), 3, where=F.col("chunk_id") % 50 == 0, probes=1)
    assert {r["chunk_id"] for r in only.collect()} <= {0, 50, 100, 150} and only.count() == 3  # one cell is not enough, so all are read
    asked = spark.createDataFrame([(1, q.tolist()), (2, None), (3, [1.0])], "query_id long, query array<double>")
    many = vi.search_many(asked, str(tmp_path / "ix"), 7, probes=10_000, depth=100).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in many] == exact(data, q, 7)


def test_no_vector_is_an_error(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        vi.build(spark.createDataFrame([x for x in ODD if x[0] != 9005], "chunk_id long, vec array<double>"), str(tmp_path / "ix"))


def test_index_recall_equals_sql(spark):
    assert agrees(QUERIES["index_recall"](spark, SF), connect(SF), ORACLES["index_recall"])


def test_the_index_agrees_with_the_scan(spark):
    q = [1.0] + [0.5] * 63
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    assert vx.top_k(rows, vx.query_vector(q), 5, "chunk_id", "vec").count() == 5


def test_pairs_with_odd_vectors_and_mixed_lengths(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", None), ("d", []), ("e", [nan, 1.0]), ("f", [1.0, None]), ("g", [1.0, 0.0, 0.0]), ("h", [3.0, 0.0, 0.0]), ("i", [0.0, 0.0])],
                                 "k string, vec array<double>")
    assert {(r["a"], r["b"]) for r in vx.similar_pairs(rows, 0.9, "k", "vec").collect()} == {("a", "b"), ("g", "h")}
    out = {r["k"]: (r["neighbour"], r["outcome"]) for r in vx.classify_duplicates(rows, rows, "k", "vec").collect()}
    assert out["a"] == ("b", "near_duplicate") and out["h"] == ("g", "near_duplicate") and len(out) == 9
    assert all(out[k] == (None, "unique") for k in "cdef")
    near = vx.top_k_joined(rows, rows.toDF("query_id", "query_vec"), 1, "k", "vec").collect()
    assert {r["query_id"] for r in near} == {"a", "b", "g", "h", "i"}


def test_training_holds_few_distances_at_once():
    """A sample of 20,000 and 1,024 centres would be 164 MB of distances, several times over."""
    import tracemalloc

    r = np.random.default_rng(3)
    rows, centres = r.normal(size=(20_000, 4)), r.normal(size=(1024, 4))
    own, d = vi._closest(rows[:50], centres)
    want = ((rows[:50, None] - centres[None]) ** 2).sum(axis=2)
    assert (own == want.argmin(axis=1)).all() and np.allclose(d, want.min(axis=1))
    tracemalloc.start()
    vi.k_means(rows, 1024, rounds=1)
    assert tracemalloc.get_traced_memory()[1] < 80e6
    tracemalloc.stop()


def test_tiles_are_not_shuffled(spark):
    """Blocks are stored once and meet as they are; before, a vector was shuffled once for each block it met."""
    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 4)))], "k long, vec array<double>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = vx.similar_pairs(rows, 0.9, "k", "vec", n_blocks=7)
    assert "hashpartitioning" not in plan(got)
    x = np.array([v["vec"] for v in rows.orderBy("k").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert {(p["a"], p["b"]) for p in got.collect()} == {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if a < b}


def test_tables_of_queries_are_not_sent(spark, tmp_path):
    """Queries meet cells in tiles; before, each query stood once for every cell that it searched, with its table of products,
    in a broadcast by way of the driver. Ties at the end go by id, also among copies."""
    r = np.random.default_rng(4)
    data = [*((i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 8)))), *((300 + i, [1.0] * 8) for i in range(50))]
    vi.build(spark.createDataFrame(data, "chunk_id long, vec array<double>"), str(tmp_path / "ix"))
    asked = spark.createDataFrame([(i, v) for i, v in data[:20]] + [(1, data[300][1]), (2, [0.0] * 8)], "query_id long, query array<double>").withColumn("query_id", F.monotonically_increasing_id())
    found = vi.search_many(asked, str(tmp_path / "ix"), 5, probes=10_000, depth=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "lookup" not in plan
    got = {}
    for x in found.orderBy("rank").collect():
        got.setdefault(x["query_id"], []).append((x["chunk_id"], x["score"]))
    want = {x["query_id"]: exact(data, np.array(x["query"]), 5) for x in asked.collect() if any(x["query"])}
    assert got == want and [(300 + i, 1.0) for i in range(5)] in got.values()


def test_queries_without_a_vector_count_as_queries(spark, tmp_path):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(301, 4)))]
    rows[100] = (100, None)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tuple(QUERIES["index_recall"](spark, str(tmp_path)).select("n_queries", "n_indexed", "recall_reached").first()) == (4, 300, True)
