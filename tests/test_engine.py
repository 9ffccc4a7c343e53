"""The chain over a small corpus, stage by stage, and the tools over its tables."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomgraph.corpus import Config, Corpus, Registry
from loomgraph.engine import Engine
from loomgraph.operators import ingest as ig
from loomgraph.operators import profiles as px
from loomgraph.operators import render as rd
from loomgraph.sources import tables as tb
from loomgraph.streaming.ingest import read_manifest, watch

FREE = {"internal_doc": px.Profile("internal_doc")}
TEXT = "We look at [Smith 2010] and [{who} 2012] once more. " + "Filler sentence of no import. " * 12


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    corpus = Corpus.init(root)
    for i, who in enumerate(("Jones", "Brown", "Green")):
        (root / "inbox" / f"doc{i}.md").write_text(f"# Title number {i} about graphs\n\n" + TEXT.format(who=who))
    (root / "inbox" / "copy.md").write_bytes((root / "inbox" / "doc0.md").read_bytes())
    (root / "inbox" / "short.md").write_text("# short")
    (root / "inbox" / "empty.txt").write_text("")
    (root / "inbox" / "pic.png").write_bytes(b"x")
    (root / "cards" / "skipped.md").write_text("reserved")
    return Engine(spark, corpus, clock=lambda: dt.datetime(2024, 1, 1, tzinfo=dt.UTC))


def counts(df):
    return {r["status"]: r["n"] for r in df.collect()}


def test_chain(engine):
    assert counts(engine.ingest(profiles=FREE)) == {"ingested": 3, "duplicate": 1, "quarantined": 3}
    reasons = {r["filename"]: r["reason"] for r in engine.read("quarantine").collect()}
    assert reasons["pic.png"] == "unsupported_format:.png" and reasons["empty.txt"] == "empty_file" and reasons["short.md"].startswith("extract_yield_too_low")
    assert counts(engine.ingest(profiles=FREE)) == {"duplicate": 4, "quarantined": 3}
    assert engine.embed() == 3 and engine.embed() == 0
    nodes, edges = engine.build_graph()
    assert nodes.where("node_type = 'document'").count() == 3
    assert edges.where("relation = 'cites' and dst = 'citation::smith_2010'").count() == 3
    out = engine.cluster()
    assert out.backend == "sbm" and out.notes and out.partition.count() == 3
    cards = engine.render()
    assert cards.count() == 3 and cards.where("markdown like '%community_label:%'").count() == 3
    assert engine.publish().count() == 3

    hits = engine.corpus_search("graphs title", 2).collect()
    assert len(hits) == 2 and hits[0]["label"] is not None
    doc = hits[0]["doc_id"]
    assert engine.card_get(doc).startswith("---\ntitle:")
    path = engine.community_hierarchy(doc)
    cid = path["leaf_community_id"]
    assert engine.community_brief(cid)["n_members"] == 3
    assert "## Members" in engine.community_get(cid)
    assert engine.community_search("graphs").count() >= 1
    assert "core_nodes" in engine.community_core_nodes(cid)
    sub = engine.subgraph_extract([f"doc::{doc}"])
    assert "citation::smith_2010" in sub["nodes"] and sub["edges"]

    answer = engine.handle({"id": 1, "method": "tools/call", "params": {"name": "corpus_search", "arguments": {"query": "graphs"}}})
    assert json.loads(answer["result"]["content"][0]["text"])
    report = engine.token_econ_report()
    assert report["totals"]["n_calls"] == 1 and report["groups"][0]["group"] == "corpus_search"
    for tool, args in (("corpus_search", {"query": " "}), ("card_get", {"doc_id": "ghost"}), ("community_brief", {"community_id": "x"}), ("nothing", {}), ("subgraph_extract", {"seed_nodes": []})):
        assert engine.call_tool(tool, args)["isError"]
    assert len(engine.handle({"id": 2, "method": "tools/list"})["result"]["tools"]) == 9
    assert engine.handle({"method": "notifications/initialized"}) is None
    assert engine.decay().where("decayed").count() == 0
    assert engine.export_vault() == 4 and engine.export_vault() == 4
    log = (engine.corpus.root / "log.md").read_text()
    assert log.count("pages written") == 2 and (engine.corpus.root / "cards" / f"{doc}.md").exists()
    assert "<canvas" in engine.draw(max_nodes=5)
    said = engine.extract_concepts(lambda p: '{"summary": "S", "topics": ["a", "A"], "domain": "d"}' if "number 0" in p else "I cannot" if "number 1" in p else "{}")
    assert counts(said) == {"extracted": 1, "skipped": 1, "failed": 1}
    concepts = engine.read("concepts")
    assert concepts.first()["topics"] == ["a"]
    nodes, _ = engine.build_graph(concepts)
    assert nodes.where("node_id = 'topic::a'").count() == 1


def test_reports_and_evaluation(engine, spark):
    chunks = engine.read("chunks")
    first = chunks.orderBy("chunk_id").first()
    asked = engine.make_test_set(lambda t: json.dumps({"question": t[:60], "answer": "A"}), 10)
    assert asked.count() == 3
    path = engine.evaluate_retrieval(2, rerank=lambda q, t: F.length(t).cast("double"), answer=lambda p: "said", judge=lambda p: "0.5 of it")
    text = open(path).read()
    assert "| n | hit_at_k_chunk |" in text and "## Re-ranking" in text and "| 0.5 | 0.5 | 0.5 | 0.5 | 0.5 |" in text
    assert "n_components" in open(engine.evaluate_graph(lambda p: "1")).read() and "## sbm" in open(engine.evaluate_clusters()).read()
    assert "Decay report" in open(engine.report_decay(engine.decay(True), True)).read() and "Token report" in open(engine.report_tokens()).read()
    for q in ("graphs title number", "jones", "  ", "graphs graphs 1"):
        want = [(r["chunk_id"], r["score"]) for r in engine.lexical_search(q, 3).collect()]
        from loomgraph.operators import retrieve as rt
        assert want == [(r["chunk_id"], r["score"]) for r in rt.bm25_top(chunks, q, 3, "chunk_id").collect()]
    old = {r["community_id"]: r["label"] for r in engine.read("communities").collect()}
    new = {r["community_id"]: r["label"] for r in engine.relabel(lambda b: "Label: new name").collect()}
    assert set(new) == set(old) and set(new.values()) == {"new name"} and first["doc_id"]


def test_publish_copy(engine, tmp_path):
    import hashlib

    target = tmp_path / "out"
    manifest = {r["path"]: (r["bytes"], r["sha256"]) for r in engine.publish_to(str(target), "kb", archive=True).collect()}
    for path, (size, digest) in manifest.items():
        data = (target / path).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (size, digest), path
    assert {"README.md", "AGENTS.md", "OVERVIEW.md", "capabilities.json", ".obsidian/app.json", "vectors.tar"} <= set(manifest)
    assert sum(p.startswith("cards/") for p in manifest) == 3 and any(p.startswith("communities/") for p in manifest)
    assert json.loads((target / "capabilities.json").read_text())["tables"]["chunks"] >= 3
    assert not (target / "tables" / "manifest").exists() and not (target / "quarantine").exists()
    assert not [p for p in target.rglob(".*") if p.is_file() and len(p.name) == 33]  # nothing half written


def test_files_move(spark, tmp_path):
    corpus = Corpus.init(tmp_path / "c")
    box = corpus.root / "inbox"
    for sub, who in (("a", "Jones"), ("b", "Brown")):
        (box / sub).mkdir()
        (box / sub / "same.md").write_text(f"# T {who}\n\n" + TEXT.format(who=who))
        (box / sub / "bad.md").write_text(f"# {who}")
    (box / "x.pdf").write_bytes(b"\n" * 6 + b"nothing here")
    (box / "y.pdf").write_bytes(b"%PDF-1.4 bytes")
    engine = Engine(spark, corpus, clock=lambda: dt.datetime(2024, 1, 1, tzinfo=dt.UTC))
    probe = lambda content: None if bytes(content).startswith(b"%PDF") else bytes(content).decode()
    assert {r["path"]: r["class"] for r in engine.triage(probe, defer=True).collect()} == {"inbox/x.pdf": "defer", "inbox/y.pdf": "unknown"}
    assert (corpus.root / "defer" / "inbox" / "x.pdf").exists() and not (box / "x.pdf").exists() and (box / "y.pdf").exists()
    (box / "y.pdf").unlink()
    assert counts(engine.ingest(profiles=FREE, move=True)) == {"ingested": 2, "quarantined": 2}
    assert (corpus.root / "processed" / "inbox" / "a" / "same.md").exists() and (corpus.root / "processed" / "inbox" / "b" / "same.md").exists()
    bad = sorted(p.name for p in (corpus.root / "quarantine").rglob("bad*"))
    assert bad == ["bad-1.md", "bad-1.md.reason.json", "bad.md", "bad.md.reason.json"]
    (box / "a" / "bad.md").write_text("# Jones")
    (box / "a" / "same.md").write_text("# T other\n\n" + TEXT.format(who="Other"))
    assert counts(engine.ingest(profiles=FREE, move=True)) == {"ingested": 1, "quarantined": 1}
    assert (corpus.root / "processed" / "inbox" / "a" / "same-1.md").exists() and len(list((corpus.root / "quarantine").rglob("bad-2.md"))) == 1
    assert not [p for p in box.rglob("*") if p.is_file()]
    assert engine.read("manifest").where("destination is null").count() == 0


def test_moves_say_what_went_wrong(spark, tmp_path):
    from loomgraph.sinks import move_files, write_texts

    assert [r["path"] for r in write_texts(spark.createDataFrame([("a/b.md", "x"), (None, "y")], "path string, markdown string"), str(tmp_path)).collect()] == ["a/b.md"]
    (tmp_path / "t.md").write_text("there")
    moves = spark.createDataFrame([("a/b.md", "t.md"), ("gone", "new"), ("a/b.md", "c/d.md")], "source string, target string").coalesce(1)
    errors = {r["target"]: r["error"] for r in move_files(moves, str(tmp_path)).collect()}
    assert "FileExistsError" in errors["t.md"] and "FileNotFoundError" in errors["new"] and errors["c/d.md"] is None
    again = move_files(moves.where("target = 'c/d.md'"), str(tmp_path)).collect()
    assert again[0]["error"] is None and (tmp_path / "c" / "d.md").read_text() == "x"


def test_publishers_are_asked_once(spark, tmp_path):
    from loomgraph.sources import publishers as pu

    files = spark.createDataFrame([("2401.00001v1.pdf",), ("2401.00002.pdf",), ("2023.05.06.123456.full.pdf",), ("note.md",)], "filename string")
    asked = pu.wanted(files)
    assert {(r["kind"], r["key"]) for r in asked.collect()} == {("arxiv", "2401.00001"), ("arxiv", "2401.00002"), ("biorxiv", "10.1101/2023.05.06.123456")}
    calls = tmp_path / "calls"

    def fetch(kind, key):
        with calls.open("a") as f:
            f.write(f"{key}\n")
        if key == "2401.00001" and calls.read_text().count(key) < 3:
            raise pu.TooManyRequests
        if key == "2401.00002":
            raise OSError
        return '{"collection": [{"title": "T", "authors": "A B;", "date": "2023-01-01"}]}' if kind == "biorxiv" else "<feed><entry><title>X</title></entry></feed>"

    waits = tmp_path / "waits"

    def wait(seconds):
        with waits.open("a") as f:
            f.write(f"{seconds} ")

    bodies = pu.fetched(asked.coalesce(1), fetch, lambda kind, key: F.concat(F.lit("https://x.org/"), key), wait=wait).cache()
    got = {r["filename"]: (r["record"]["title"], r["record"]["source"]) for r in pu.records(asked, bodies).collect()}
    assert got == {"2401.00001v1.pdf": ("X", "arxiv"), "2023.05.06.123456.full.pdf": ("T", "biorxiv")} and waits.read_text().split() == ["2.0", "4.0"]
    cached = {r["record"]["source"] for r in pu.records(asked, bodies.where("false"), bodies).collect()}
    assert cached == {"arxiv_cache", "biorxiv_cache"}
    assert pu.fetched(asked, fetch, lambda kind, key: F.lit("http://localhost/"), wait=wait).count() == 0


def test_command_line(tmp_path, capsys, monkeypatch):
    from loomgraph import cli

    monkeypatch.chdir(tmp_path)
    assert cli.main(["init", str(tmp_path / "c")]) == 0
    capsys.readouterr()
    assert cli.main(["semantic-extract", "--corpus", str(tmp_path / "c")]) == 2 and "--model" in capsys.readouterr().err
    assert cli.main(["eval", "graph", "--corpus", str(tmp_path / "c"), "--judge", "no.such:thing"]) == 2 and "no such function" in capsys.readouterr().err
    assert cli.named("json:dumps") is json.dumps
    with pytest.raises(SystemExit):
        cli.main(["eval"])
    assert cli.parser().parse_args(["eval", "ragas", "--k", "3"]).what == "ragas" and cli.parser().parse_args(["publish", "--to", "x", "--archive"]).archive


def test_graph_version_is_checked(spark, tmp_path):
    n = spark.createDataFrame([("a",)], "node_id string")
    tb.save_graph(n, n, str(tmp_path / "g"))
    assert tb.load_graph(spark, str(tmp_path / "g"))[0].count() == 1
    tb.replace(spark.createDataFrame([(99, "property_graph")], "schema_version int, graph_type string"), str(tmp_path / "g" / "about"))
    with pytest.raises(ValueError, match="version"):
        tb.load_graph(spark, str(tmp_path / "g"))


def test_watcher_equals_batch(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for i in range(3):
        (tmp_path / "a" / f"d{i}.md").write_text(f"# T{i % 2}\n\n" + TEXT.format(who="Jones"))
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "x.md").write_text("reserved")
    where = str(tmp_path / "out")
    watch(spark, str(tmp_path / "a"), f"{where}/m", f"{where}/p", once=True, profiles=FREE).awaitTermination()
    assert counts(ig.status_counts(read_manifest(spark, f"{where}/m"))) == {"ingested": 2, "duplicate": 1}
    (tmp_path / "a" / "d9.md").write_text("# T9\n\n" + TEXT.format(who="Jones"))
    watch(spark, str(tmp_path / "a"), f"{where}/m", f"{where}/p", once=True, profiles=FREE).awaitTermination()
    assert counts(ig.status_counts(read_manifest(spark, f"{where}/m"))) == {"ingested": 3, "duplicate": 1}


def test_cards_round_trip(spark):
    c = spark.createDataFrame([("d", "A: title", ["Ann Lee"], 2020, ["graph_theory"], "Abs.")], "doc_id string, title string, authors array<string>, year int, topics array<string>, abstract string")
    md = c.select(rd.card_markdown(c).alias("m")).first()["m"]
    assert "## Topics\n\n- [[Graph Theory]]" in md and "**Authors:** Ann Lee" in md and "## Methods" not in md
    back = spark.createDataFrame([(md,)], "m string").select(rd.split_card(F.col("m")).alias("s")).select(
        rd.front_value(F.col("s.front"), "title").alias("t"), rd.front_list(F.col("s.front"), "authors").alias("a"), "s.body").first()
    assert (back["t"], back["a"]) == ("A: title", ["Ann Lee"]) and back["body"].lstrip().startswith("# A: title")
    yaml = pytest.importorskip("yaml")
    assert yaml.safe_load(md.split("---")[1])["title"] == "A: title"


def test_reports(spark):
    from loomgraph.operators import concepts as cc
    from loomgraph.operators import reports as rp
    from loomgraph.operators import tokens as tk

    log = spark.createDataFrame([("2024-01-01", "t", "s", 10, 20)], "ts string, tool string, surface_id string, served long, counterfactual long")
    text = rp.token_report(tk.totals(log), tk.report(log))
    assert "1 calls served 10 tokens against 20: 2.0x" in text and "| t | 1 | 10 | 20 | 2.0 |" in text
    assert rp.prepended_log(rp.prepended_log("", "one"), "two").index("two") < rp.prepended_log(rp.prepended_log("", "one"), "two").index("one")
    xy = rp.layout(["a", "b", "c"], [("a", "b"), ("b", "c")])
    assert xy.shape == (3, 2) and abs(xy).max() == 1.0 and rp.layout([], []).shape == (0, 2)
    hits = spark.createDataFrame([("q", 2, "second"), ("q", 1, "first")], "question string, rank int, text string")
    turn = cc.rag_turn(hits, lambda p: p.split("Question: ")[1].upper()).first()
    assert turn["contexts"] == ["first", "second"] and turn["answer"] == "Q"
    chunks = spark.createDataFrame([("c", "d", "x"), ("e", "f", "bad")], "chunk_id string, doc_id string, text string")
    made = cc.make_examples(chunks, lambda t: "no" if t == "bad" else '{"question": "Q?", "answer": "A"}').collect()
    assert [(r["question"], r["seed_chunk"]) for r in made] == [("Q?", "c")]


def test_hooks_run_in_order(spark):
    h = ig.Hooks()
    h.register("post_extract", lambda d: d.withColumn("x", F.col("x") * 2), 50)
    h.register("post_extract", lambda d: d.withColumn("x", F.col("x") + 1), 10)
    assert h.run("post_extract", spark.range(1).withColumn("x", F.lit(1))).first()["x"] == 4
    with pytest.raises(ValueError, match="place"):
        h.register("nowhere", lambda d: d)


def test_extract_cache(spark):
    c = spark.createDataFrame([("h", "v1", "p", "old"), ("i", "v2", "p", "x")], "hash string, extractor_version string, profile string, text string")
    c = ig.cache_put(c, spark.createDataFrame([("h", "v1", "p", "new")], c.schema))
    assert ig.cache_get(c, c.where("hash = 'h'")).first()["text"] == "new"
    assert ig.cache_invalidate(c, extractor_version="v1").count() == 1


def test_registry_and_config(tmp_path):
    r = Registry.load(tmp_path / "r.json")
    r.add("a", tmp_path)
    r.set_default("a")
    r.save()
    again = Registry.load(tmp_path / "r.json")
    assert again.names() == ["a"] and again.resolve() == tmp_path.resolve()
    with pytest.raises(KeyError):
        again.set_default("b")
    assert again.remove("a") and again.default is None and not again.remove("a")
    (tmp_path / "c.yaml").write_text("embedding: {max_chars: '100', overlap_chars: odd}\nother: 1\n")
    cfg = Config.load(tmp_path / "c.yaml")
    assert (cfg.max_chars, cfg.overlap_chars, cfg.raw["other"]) == (100, 400, 1)
    assert Config.load(tmp_path / "none.yaml") == Config()
