"""Names that no two files share, and files that move."""
import random

from loomgraph import sinks
from loomgraph.operators import ingest as ig
from loomgraph.operators import names as nm
from loomgraph.operators import profiles as px
from tests.conftest import SF
from tests.helpers import agrees, connect


def given(wanted, taken=()):
    """The rule in a loop: first come first served, then the smallest free number."""
    used, out, first = set(taken) | set(wanted), [], set(taken)
    for w in wanted:
        name, n = w, 0
        if w in first:
            while (name := f"{w}-{(n := n + 1)}") in used:
                pass
            used.add(name)
        first.add(w)
        out.append(name)
    return out


def test_three_files_get_three_ids(spark):
    d = spark.createDataFrame([("x/a.md", "a.md"), ("y/a.md", "a.md"), ("z/a-1.md", "a-1.md")], "path string, filename string")
    assert {r["path"]: r["doc_id"] for r in ig.doc_ids(d).collect()} == {"x/a.md": "a", "y/a.md": "a-2", "z/a-1.md": "a-1"}


def test_names_are_those_of_the_loop(spark):
    r = random.Random(4)
    wanted = [r.choice(["a", "a", "a", "b", "a-1", "a-2", "a-4", "a-01", "a-1-1", "c-", "-1", "é"]) for _ in range(80)]
    taken = ["a", "a-7", "b-1", "b-2", "zz"]
    d = spark.createDataFrame([(f"{i:03d}", w) for i, w in enumerate(wanted)] + [("999", None)], "path string, w string").repartition(3)
    out = {x["path"]: x["name"] for x in nm.unique_names(d, "w", "path", "name", spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    assert out.pop("999") is None and [out[f"{i:03d}"] for i in range(80)] == given(wanted, taken)
    assert nm.unique_names(d.limit(0), "w", "path", "name").count() == 0


def test_targets_keep_suffixes_and_leave_rows_without_a_place(spark):
    d = spark.createDataFrame([("x/a.md", "q/a.md"), ("y/a.md", "q/a.md"), ("z/a-1.md", "q/a-1.md"), ("n", None), ("h", "q/.env"), ("i", "q/.env")], "path string, wanted string")
    got = {r["path"]: r["target"] for r in sinks.targets(d, spark.createDataFrame([("q/a-3.md",)], "path string")).collect()}
    assert got == {"x/a.md": "q/a.md", "y/a.md": "q/a-2.md", "z/a-1.md": "q/a-1.md", "n": None, "h": "q/.env", "i": "q/.env-1"}


def test_free_names_equals_sql(spark):
    from loomgraph.plans import ORACLES, QUERIES

    assert agrees(QUERIES["free_names"](spark, SF), connect(SF), ORACLES["free_names"])


FREE = {"internal_doc": px.Profile("internal_doc")}
PAPER = "# Title about graphs\n\nWe look at [Smith 2010] once more. " + "Filler sentence of no import. " * 12


def engine(spark, tmp_path):
    from loomgraph.corpus import Corpus
    from loomgraph.engine import Engine

    return Engine(spark, Corpus.init(str(tmp_path)))


def test_documents_of_one_name_stay_apart_end_to_end(spark, tmp_path):
    e = engine(spark, tmp_path)
    for k, name in enumerate(["x/a.md", "y/a.md", "z/a-1.md"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(PAPER + f"\nNumber {k}.\n")
    counts = {r["status"]: r["n"] for r in e.ingest(move=True, profiles=FREE).collect()}
    assert counts == {"ingested": 3}
    ids = [r["doc_id"] for r in e.read("docs").collect()]
    assert sorted(ids) == ["a", "a-1", "a-2"]
    e.embed()
    chunks = [r["chunk_id"] for r in e.read("chunks").collect()]
    assert len(chunks) == len(set(chunks)) and {c.split("::")[0] for c in chunks} == set(ids)
    moved = [r["destination"] for r in e.read("manifest").collect()]
    assert len(set(moved)) == 3 and all((tmp_path / m).exists() for m in moved)


def test_a_pass_that_broke_between_move_and_manifest_is_done_again(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text(PAPER)
    with monkeypatch.context() as m:
        m.setattr(ig, "manifest_rows", lambda out: 1 / 0)
        try:
            e.ingest(move=True, profiles=FREE)
        except ZeroDivisionError:
            pass
    assert not (tmp_path / "x" / "a.md").exists()
    counts = {r["status"]: r["n"] for r in e.ingest(move=True, profiles=FREE).collect()}
    assert counts == {"ingested": 1}
    assert [r["doc_id"] for r in e.read("docs").collect()] == ["a"]
    assert (tmp_path / e.read("manifest").first()["destination"]).exists()


def test_a_file_that_cannot_move_fails(spark, tmp_path):
    e = engine(spark, tmp_path)
    (tmp_path / "a.md").write_text(PAPER)
    (tmp_path / "processed").mkdir(exist_ok=True)
    (tmp_path / "processed" / "a.md").write_text("in the way")
    out = {r["status"]: r["n"] for r in e.ingest(move=True, profiles=FREE).collect()}
    assert out == {"failed": 1} and (tmp_path / "a.md").exists()
    row = e.read("manifest").first()
    assert row["reason"].startswith("move_error:") and row["destination"] is None
    assert e.read("docs").count() == 0
