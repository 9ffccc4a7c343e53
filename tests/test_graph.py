import datetime as dt
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import community as cm
from loomgraph.operators import decay as dk
from loomgraph.operators import evaluate as ev
from loomgraph.operators import graph as gx
from loomgraph.operators import publish as pb
from loomgraph.operators import retrieve as rt
from loomgraph.operators import tokens as tk
from loomgraph.operators import vectors as vx
from loomgraph.plans import QUERIES
from tests.conftest import SF

KARATE = [(1, b) for b in (2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 18, 20, 22, 32)] + [(2, b) for b in (3, 4, 8, 14, 18, 20, 22, 31)] + [(3, b) for b in (4, 8, 9, 10, 14, 28, 29, 33)] + [
    (4, 8), (4, 13), (4, 14), (5, 7), (5, 11), (6, 7), (6, 11), (6, 17), (7, 17), (9, 31), (9, 33), (9, 34), (10, 34), (14, 34), (15, 33), (15, 34), (16, 33), (16, 34), (19, 33), (19, 34), (20, 34),
    (21, 33), (21, 34), (23, 33), (23, 34), (24, 26), (24, 28), (24, 30), (24, 33), (24, 34), (25, 26), (25, 28), (25, 32), (26, 32), (27, 30), (27, 34), (28, 34), (29, 32), (29, 34), (30, 33),
    (30, 34), (31, 33), (31, 34), (32, 33), (32, 34), (33, 34)]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def star(spark, leaves):
    nodes = table(spark, [("hub",)] + [(f"n{i}",) for i in range(leaves)], "node_id string")
    return nodes, table(spark, [("hub", f"n{i}") for i in range(leaves)], "src string, dst string")


def test_entities_and_graph(spark):
    docs = table(spark, [("d1", "T", "See [Smith 2010] and [Smith 2010b], 10.1234/ABC.", ["Ann Lee"], ["x", "y"]), ("d2", "U", "", ["ann lee"], [])],
                 "doc_id string, title string, text string, authors array<string>, topics array<string>")
    e = gx.extract_entities(docs)
    assert [r["key"] for r in e.where("doc_id = 'd1'").orderBy("pos").collect()] == ["author::ann_lee", "topic::x", "topic::y", "citation::smith_2010", "citation::doi_10_1234_abc"]
    nodes, edges = gx.build_graph(docs, e)
    assert nodes.where("entity_type = 'author'").count() == 1  # shared by both documents
    assert edges.where("relation = 'co_mentioned_in' and confidence = 'INFERRED'").count() == 10
    assert {r["relation"] for r in edges.collect()} == {"authored_by", "about", "cites", "co_mentioned_in"}


def test_entity_dedup_prefers_confidence_then_order(spark):
    e = table(spark, [("d", 0, "topic", "late", "k", "INFERRED", "s"), ("d", 1, "topic", "first", "k", "EXTRACTED", "s"), ("d", 2, "topic", "second", "k", "EXTRACTED", "s")],
              "doc_id string, pos int, type string, name string, key string, confidence string, source string")
    assert [r["name"] for r in gx.deduplicate_entities(e).collect()] == ["first"]


def test_concepts_keep_repeats(spark):
    nodes = table(spark, [("doc::d", "document", None, None)], "node_id string, node_type string, entity_type string, name string")
    c = table(spark, [("d", "s", "dom", ["A b", "a-b"], [], ["!!"])], "doc_id string, summary string, domain string, topics array<string>, methods array<string>, named_entities array<string>")
    n, e = gx.augment_with_concepts(nodes, table(spark, [], "src string, dst string, relation string, confidence string, score double, similarity double, provenance map<string,string>"), c)
    assert n.count() == 2 and e.count() == 2
    assert n.where("node_type = 'document'").first()["summary"] == "s"


def test_projection_weights(spark):
    rows = [("doc::a", "t::1", "about", None), ("doc::b", "t::1", "about", None), ("doc::b", "t::2", "about", None), ("doc::a", "t::2", "about", None), ("doc::b", "doc::a", "cites", None),
            ("doc::a", "doc::c", "shares_summary_with", 0.6), ("doc::a", "doc::a", "cites", None), ("t::1", "t::2", "co_mentioned_in", None)]
    got = {(r["a"], r["b"]): r["weight"] for r in gx.project(table(spark, rows, "src string, dst string, relation string, similarity double")).collect()}
    assert got == {("doc::a", "doc::b"): 7.0, ("doc::a", "doc::c"): 6.0}


def test_hub_is_core_and_leaves_are_not(spark):
    nodes, edges = star(spark, 20)
    hubs = gx.percentile_core(gx.degrees(nodes, edges), 99.0)
    assert [r["node_id"] for r in hubs.collect()] == ["hub"]
    assert gx.without_nodes(edges, hubs).count() == 0
    with pytest.raises(ValueError, match="percentile"):
        gx.percentile_core(gx.degrees(nodes, edges), 101.0)


@pytest.mark.parametrize(("votes", "expected"), [([0, 0, 0, 1, 1], 0), ([5, 3], 3), ([], 8)])
def test_majority_vote(spark, votes, expected):
    edges = table(spark, [("hub", f"n{i}") for i in range(max(1, len(votes)))], "src string, dst string")
    part = table(spark, [(f"n{i}", c) for i, c in enumerate(votes)] + [("z", 7)], "node_id string, community_id int")
    got = gx.majority_reattach(table(spark, [("hub",)], "node_id string"), edges, part).first()
    assert got["community_id"] == expected


def test_bfs_cap_and_missing_seed(spark):
    edges = table(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "src string, dst string")
    seeds = table(spark, [("a",), ("ghost",)], "node_id string")
    seen, walked, cut = gx.bfs(edges, seeds, 2)
    assert sorted(r["node_id"] for r in seen.collect()) == ["a", "b", "c", "ghost"] and walked.count() == 2 and not cut
    seen, _, cut = gx.bfs(edges, seeds, 3, max_nodes=3)
    assert cut and seen.count() == 3
    assert gx.bfs(edges, seeds, 0)[0].count() == 2


def test_components(spark):
    nodes = table(spark, [(c,) for c in "abcdefg"], "node_id string")
    edges = table(spark, [("b", "a"), ("c", "b"), ("e", "f")], "src string, dst string")
    got = {r["node_id"]: r["component"] for r in gx.connected_components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e", "g": "g"}


def test_karate_club_louvain(spark):
    nodes = table(spark, [(f"{i:02d}",) for i in range(1, 35)], "node_id string")
    proj = table(spark, [(f"{a:02d}", f"{b:02d}", 1.0) for a, b in KARATE], "a string, b string, weight double")
    out = cm.LouvainBackend().cluster(nodes, proj)
    assert out.partition.count() == 34
    assert 2 <= out.partition.select("community_id").distinct().count() <= 10
    assert gx.modularity(proj, out.partition).first()[0] > 0.3


def test_louvain_says_where_a_bound_stopped_it(spark):
    nodes = table(spark, [(f"{i:02d}",) for i in range(1, 35)], "node_id string")
    proj = table(spark, [(f"{a:02d}", f"{b:02d}", 1.0) for a, b in KARATE], "a string, b string, weight double")
    notes = cm.LouvainBackend(rounds=1, levels=1).cluster(nodes, proj).notes
    assert any("1 rounds" in n for n in notes) and any("1 levels" in n for n in notes)
    assert cm.LouvainBackend(rounds=60, levels=20).cluster(nodes, proj).notes == []


def test_kmeans_and_router(spark):
    v = table(spark, [(f"n{i}", [float(i // 3), 1.0, 0.0, float(i % 3) / 10]) for i in range(8)], "node_id string, vec array<double>")
    assert cm.KMeansBackend(3).cluster(v, v, v).partition.agg(F.max("community_id")).first()[0] < 3
    assert [cm.KMeansBackend().pick_k(n) for n in (1, 8, 200, 10_000)] == [1, 2, 10, 20]
    assert cm.Router().pick().name == "sbm" and cm.Router().pick(cm.Rigor.HEURISTIC).name == "leiden"
    assert cm.Router().pick(cm.Rigor.EMBEDDINGS_ONLY).name == "embeddings"
    with pytest.raises(RuntimeError, match="available"):
        cm.Router([cm.BlockModelBackend()]).pick(cm.Rigor.HEURISTIC)


def test_stable_ids_small():
    assert cm.greedy_ids([(0, 3, "a"), (1, 2, "d")], {(0, 7): 3, (1, 4): 2}, [4, 7]) == {0: 7, 1: 4}
    assert cm.greedy_ids([(0, 2, "a")], {}, [0, 1]) == {0: 2}
    assert cm.greedy_ids([(0, 5, "a"), (1, 3, "b")], {(0, 9): 1, (1, 9): 3}, [9]) == {0: 9, 1: 10}


@given(st.lists(st.integers(0, 4), min_size=1, max_size=30), st.permutations(range(5)))
def test_stable_ids_ignore_renaming(labels, renaming):
    from collections import Counter

    def remap(new):
        sizes = [(c, n, min(f"{i:02d}" for i, x in enumerate(new) if x == c)) for c, n in Counter(new).items()]
        overlaps = Counter(zip(new, labels, strict=True))
        ids = cm.greedy_ids(sizes, overlaps, sorted(set(labels)))
        return [ids[c] for c in new]

    assert remap(labels) == labels
    assert remap([renaming[c] for c in labels]) == labels


def test_labels_and_tables(spark):
    part = table(spark, [("doc::a", 0), ("doc::b", 0), ("doc::c", 1)], "node_id string, community_id int")
    titles = table(spark, [("doc::a", "Graph methods for corpora"), ("doc::b", "Corpora and Graph 2020"), ("doc::c", None)], "node_id string, title string")
    got = {r["community_id"]: r["label"] for r in cm.labels(part, titles).collect()}
    assert got == {0: "graph corpora methods", 1: "doc::c"}


def test_relabel_keeps_old_on_error(spark):
    comms = table(spark, [(0, "old", 2), (1, "kept", 1)], "community_id int, label string, n_members long")
    part = table(spark, [("doc::a", 0), ("doc::b", 0), ("doc::c", 1)], "node_id string, community_id int")
    cards = table(spark, [("a", "A title", ["x"]), ("b", "B", None), ("c", "bad", [])], "doc_id string, title string, tags array<string>")

    def answer(block):
        if "bad" in block:
            raise RuntimeError
        return f"Name: {block.splitlines()[0][2:]}"

    got = {r["community_id"]: r["label"] for r in cm.relabel(comms, part, cards, answer).collect()}
    assert got == {0: "A title (x)", 1: "kept"}


def test_surprise_values():
    assert gx.surprise_of(1, 0, 0, 0) is None and gx.surprise_of(4, 3, 2, 0) == 0.0
    # 4 nodes, 2 edges, both inside two pairs: C(2,2) C(4,0) / C(6,2) = 1/15
    assert gx.surprise_of(4, 2, 2, 2) == pytest.approx(1.1760912590556811)


def test_modularity_of_partial_partition_is_null(spark):
    proj = table(spark, [("a", "b", 1.0)], "a string, b string, weight double")
    assert gx.modularity(proj, table(spark, [("a", 0)], "node_id string, community_id int")).first()[0] is None


# --- vectors ----------------------------------------------------------------------------

@pytest.mark.parametrize(("cos", "outcome"), [(1.0, "near_duplicate"), (0.95, "near_duplicate"), (0.94, "borderline"), (0.80, "borderline"), (0.79, "unique"), (0.10, "unique"), (-0.5, "unique")])
def test_bands(spark, cos, outcome):
    assert spark.range(1).select(vx.band(F.lit(cos)).alias("b")).first()["b"] == outcome


def test_hot_entities_are_cut(spark, monkeypatch):
    edges = spark.createDataFrame([(f"doc::{i:02d}", f"topic::{t}", "about", None) for i in range(25) for t in range(4) if t == 0 or i % (t + 1) == 0], "src string, dst string, relation string, similarity double")
    whole = {(r["a"], r["b"]): r["weight"] for r in gx.project(edges).collect()}
    monkeypatch.setattr(gx, "HOT", 4)
    cut = {(r["a"], r["b"]): r["weight"] for r in gx.project(edges).collect()}
    assert cut == whole and len(whole) == 300


def test_ranks_by_ranges(spark):
    rows = [(i * 7919 % 501, f"n{i % 13}") for i in range(500)]
    df = spark.createDataFrame(rows, "s int, name string").repartition(9)
    got = sorted((r["rank"], r["s"], r["name"]) for r in cm.ranked(df, F.desc("s"), F.asc("name")).collect())
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(s, n) for _, s, n in got] == want and [r for r, _, _ in got] == list(range(500))


def test_duplicates_of_string_ids(spark):
    v = spark.createDataFrame([("c", [1.0, 0.0]), ("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("d", [0.0, 1.0])], "id string, vec array<double>")
    got = {r["id"]: (r["neighbour"], r["outcome"]) for r in vx.classify_duplicates(v, v, "id", "vec").collect()}
    assert got["b"] == ("c", "near_duplicate") and got["c"] == ("b", "near_duplicate") and got["a"] == ("b", "near_duplicate") and got["d"] == ("a", "unique")


def test_component_metrics(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert tuple(gx.component_metrics(nodes, edges).first()) == (3, 0.6)


def test_zero_vectors_and_rerank(spark):
    v = table(spark, [(1, [1.0, 0.0]), (2, [0.9, 0.4359]), (3, [0.0, 0.0])], "id long, vec array<double>")
    got = {r["id"]: r["outcome"] for r in vx.classify_duplicates(v, v, "id", "vec").collect()}
    assert got == {1: "borderline", 2: "borderline", 3: "unique"}
    lifted = {r["id"]: r["outcome"] for r in vx.classify_duplicates(v, v, "id", "vec", rerank=F.when(F.col("id") == 1, 0.9).otherwise(0.1)).collect()}
    assert lifted[1] == "near_duplicate" and lifted[2] == "borderline"


def test_similar_pairs_over_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(40, 3))
    v = table(spark, [(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if u[i] @ u[j] >= 0.8}
    assert {(r["a"], r["b"]) for r in vx.similar_pairs(v, 0.8, "id", "vec", 3).collect()} == want


def test_upsert_and_delete(spark):
    old = table(spark, [("a", "d1", 1), ("b", "d1", 2)], "chunk_id string, doc_id string, x int")
    new = table(spark, [("b", "d1", 9), ("c", "d2", 3)], "chunk_id string, doc_id string, x int")
    both = vx.upsert(old, new)
    assert {r["chunk_id"]: r["x"] for r in both.collect()} == {"a": 1, "b": 9, "c": 3}
    assert vx.delete_documents(both, table(spark, [("d1",)], "doc_id string")).count() == 1


def test_overlay_promotes_titles(spark):
    ranked = table(spark, [(1, "other"), (2, "graph of words"), (3, "words")], "rank int, title string")
    assert [r["rank"] for r in rt.overlay(ranked, "graph of words", 3, "title", "rank").collect()] == [2, 3, 1]


def test_bm25(spark):
    d = table(spark, [("a", "cats and dogs"), ("b", "dogs dogs dogs"), ("c", "fish swim here")], "doc_id string, text string")
    assert [r["doc_id"] for r in rt.bm25_top(d, "fish", 3).collect()] == ["c"]
    assert rt.bm25_top(d, " ", 3).count() == 0


# --- decay, tokens, evaluation ------------------------------------------------------------

@pytest.mark.parametrize(("links", "days", "half", "expected"), [(1, 365, 365.0, 0.5), (4, 730, 365.0, 1.0), (0, 0, 365.0, 1.0), (3, 900, None, 3.0), (2, -5, 365.0, 2.0), (2, None, 365.0, 2.0)])
def test_relevance(spark, links, days, half, expected):
    today = dt.date(2024, 1, 1)
    touched = None if days is None else today - dt.timedelta(days=days)
    row = table(spark, [(links, touched, half)], "l int, t date, h double")
    assert row.select(dk.relevance(F.col("l"), F.col("t"), F.col("h"), F.lit(today)).alias("r")).first()["r"] == pytest.approx(expected)


def test_relevance_rejects_half_life(spark):
    with pytest.raises(Exception, match="half_life_days"):
        spark.range(1).select(dk.relevance(F.lit(1), F.lit(None).cast("date"), F.lit(0.0), F.current_date())).collect()


def cards(spark):
    rows = [("a", "active", 1.0, 365.0, "2023-01-01", None), ("b", "pinned", 1.0, 365.0, "2020-01-01", None), ("c", "active", 1.0, None, "2020-01-01", ["a", "ghost"])]
    return table(spark, rows, "doc_id string, status string, relevance double, half_life_days double, last_touched string, supersedes array<string>")


def test_decay_pass_and_supersession(spark):
    edges = table(spark, [], "src string, dst string")
    out = dk.decay_pass(cards(spark), edges, F.lit(dt.date(2024, 1, 1)))
    got = {r["doc_id"]: (r["status"], r["relevance"], r["decayed"]) for r in out.collect()}
    assert got == {"a": ("superseded", 0.05, True), "b": ("pinned", 1.0, False), "c": ("active", 1.0, False)}
    pairs = dk.supersession_pairs(cards(spark))
    assert {(r["older"], r["reason"]) for r in pairs.collect()} == {("a", None), ("ghost", "unknown_card")}
    e = table(spark, [], "src string, dst string, relation string, confidence string")
    once = dk.supersession_edges(e, pairs)
    assert dk.supersession_edges(once, pairs).count() == once.count() == 1
    assert [r["doc_id"] for r in dk.archive_candidates(out).collect()] == ["a"]


def test_token_report(spark):
    log = table(spark, [("2024-01-01T00:00:00", "search", "x", 50, 1000), ("bad", "search", "x", 100, 1000), ("2024-01-03T00:00:00", "card", "y", 200, 1000)], "ts string, tool string, surface_id string, served long, counterfactual long")
    t = tk.totals(log).first()
    assert (t["n_calls"], t["served"], t["counterfactual"], t["saved"]) == (3, 350, 3000, 2650)
    assert {r["group"]: r["served"] for r in tk.report(log, "nonsense").collect()} == {"search": 150, "card": 200}
    assert tk.filtered(log, since="2024-01-02").count() == 2  # the odd timestamp passes
    assert tk.totals(log.limit(0)).first()["ratio"] == 1.0


def test_retrieval_metrics(spark):
    r = table(spark, [("c1", "d1", ["c1", "c2"], ["d1", "d2"]), ("c9", "d2", ["c1", "c2"], ["d1", "d2"]), ("c9", "d9", ["c1"], ["d1"])], "seed_chunk string, seed_doc string, chunks array<string>, docs array<string>")
    m = ev.retrieval_metrics(r, 2).first()
    assert (m["n"], m["hit_at_k_chunk"], m["hit_at_k_doc"], m["mrr"]) == (3, 0.333333, 0.666667, 0.5)


def test_test_set_keeps_first_question(spark):
    rows = table(spark, [(1, "q", "a", "c1"), (2, "q", "b", "c2"), (3, "r", "c", "none")], "position int, question string, answer string, seed_chunk string")
    chunks = table(spark, [("c1", "text")], "chunk_id string, text string")
    got = {r["question"]: (r["answer"], r["context"]) for r in ev.load_test_set(rows, chunks).collect()}
    assert got == {"q": ("a", "text"), "r": ("c", None)}


def test_publish(spark):
    assert pb.canonical(["embeddings", "louvain"]) == "louvain" and pb.canonical([]) is None
    flat = table(spark, [("a", 1.0, 2.0), ("b", 3.0, 2.0)], "id string, x double, y double")
    assert {r["id"]: (r["x"], r["y"]) for r in pb.normalised(flat).collect()} == {"a": (-1.0, 0.0), "b": (1.0, 0.0)}
    assert '"t":2' in pb.capabilities(t=flat).first()["json"]


def test_projection_sums_pairs_where_they_are_made(spark, monkeypatch):
    """No pair is shuffled, and documents of many pairs are summed by several tasks; the pairs stay the same."""
    rows = [(f"doc::{i % 12}", f"topic::{i % 5}", "about", None) for i in range(60)] + [(f"doc::{i}", f"topic::{i % 3}", "about", None) for i in range(0, 40, 3)]
    rows += [("topic::1", "doc::77", "about", None), ("doc::3", "doc::1", "cites", None), (None, "topic::1", "about", None)]
    edges = table(spark, rows, "src string, dst string, relation string, similarity double")
    of = {}
    for s, d, _, _ in rows:
        if s and not (s.startswith("doc") and d.startswith("doc")):
            of.setdefault(max(s, d), set()).add(min(s, d))
    want = {("doc::1", "doc::3"): 5.0}
    for docs in of.values():
        for a in docs:
            for b in docs:
                if a < b:
                    want[a, b] = want.get((a, b), 0.0) + 1.0
    whole = gx.project(edges)
    text = whole._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(a#\d+, b#\d+", text[text.index("== Physical Plan =="):])
    assert {(r["a"], r["b"]): r["weight"] for r in whole.collect()} == want
    for hot, pairs in ((4, 1000), (5000, 6), (4, 6)):
        monkeypatch.setattr(gx, "HOT", hot)
        monkeypatch.setattr(gx, "PAIRS", pairs)
        assert {(r["a"], r["b"]): r["weight"] for r in gx.project(edges).collect()} == want


def test_hubs_are_found_over_stored_edges(spark):
    """The plan that reattaches them does not read the items again for every use of edges and hubs."""
    plan = QUERIES["reattach"](spark, SF)._jdf.queryExecution().toString()
    assert "l_partkey" not in plan[plan.index("== Physical Plan =="):]


def test_modularity_counts_no_pairs(spark):
    """Sales are links of their own, so no task holds a row for every part and supplier."""
    plan = QUERIES["modularity"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search(r"Aggregate\(keys=\[[^\]]*l_partkey", plan[plan.index("== Physical Plan =="):])


def test_clean_list_is_made_once(spark):
    """One evaluation of the list a text, and no comparison by expressions; blank texts give no row."""
    plan = QUERIES["clean_list"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") <= 2 and "array_sort(" not in plan
    from loomgraph.functions import text as tx

    got = spark.createDataFrame([(["\x0b b\t", "a", "B", "", " \n", "A", "c d\f", None],)], "x array<string>").select(tx.clean_list(F.col("x")).alias("x")).first()["x"]
    assert got == ["b", "a", "c d"]


def test_pairs_of_a_document_need_no_sorting_out_first(spark):
    """Entities are made distinct for the typed edges alone; a name without a slug is unknown."""
    plan = QUERIES["graph_edges"](spark, SF)._jdf.queryExecution().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, key#", plan[plan.index("== Physical Plan =="):])) == 1
    names = spark.createDataFrame([(" ?! ",), (None,), ("A b",), ("",)], "x string")
    assert [r[0] for r in names.select(gx.ids.slug(F.col("x"))).collect()] == ["unknown", "unknown", "a_b", "unknown"]


def test_outcomes_alone_keep_no_texts(spark):
    from loomgraph.operators import ingest as ig
    from loomgraph.plans.document_queries import NOTHING, files

    out = ig.ingest(files(spark, SF), spark.createDataFrame([], "hash string"), profiles=NOTHING, whole=False)
    assert not {"text", "record", "abstract"} & set(out.columns) and {"status", "reason"} <= set(out.columns)


def test_pairs_are_not_shuffled_and_wide_documents_are_summed(spark, monkeypatch):
    """Pairs come out of the last deal of the documents' own lists; documents of many entities give the same pairs."""
    rows = [(f"doc::{i % 12}", f"topic::{i % 5}", "about", None) for i in range(60)] + [(f"doc::{i}", f"topic::{i % 3}", "about", None) for i in range(0, 40, 3)]
    rows += [("doc::3", "doc::1", "cites", None), ("doc::1", "doc::3", "cites", None), ("doc::3", "doc::39", "cites", None), ("doc::0", "doc::50", "cites", None)]
    edges = table(spark, rows, "src string, dst string, relation string, similarity double")
    whole = gx.project(edges)
    text = whole._jdf.queryExecution().toString()
    steps = text[text.index("== Physical Plan =="):]
    assert "Exchange" not in steps[:steps.rindex("Generate explode(slice")] and not re.search(r"hashpartitioning\(a#", steps)
    want = {(r["a"], r["b"]): r["weight"] for r in whole.collect()}
    assert want["doc::1", "doc::3"] == 15.0 and want["doc::0", "doc::50"] == 5.0 and want["doc::3", "doc::39"] == 6.0
    for wide, hot in ((0, 5000), (4, 5000), (4, 4), (256, 4)):
        monkeypatch.setattr(gx, "WIDE", wide)
        monkeypatch.setattr(gx, "HOT", hot)
        assert {(r["a"], r["b"]): r["weight"] for r in gx.project(edges).collect()} == want
