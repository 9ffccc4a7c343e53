import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph import ids
from loomgraph.functions import chunking as ch
from loomgraph.functions import metadata as md
from loomgraph.functions import recovery
from loomgraph.functions import text as tx
from loomgraph.operators import ingest as ig
from loomgraph.operators import profiles as px


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(col.alias("v")).first()["v"]


# --- chunks ---------------------------------------------------------------------------

def test_chunk_edges():
    assert ch.chunk_spans("") == []
    assert ch.chunk_spans("short") == [(0, 5)]
    spans = ch.chunk_spans("A" * 10_000)
    assert len(spans) >= 4 and all(e - s <= 3000 for s, e in spans)
    assert ch.chunk_spans("x" * 5000) == [(0, 3000), (2600, 5000)]


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (-1, 0), (10, 10), (10, -1)])
def test_chunk_rejects(size, overlap):
    with pytest.raises(ValueError, match="max_chars"):
        ch.chunk_spans("text", size, overlap)


def test_chunk_prefers_breaks():
    text = "a" * 2800 + "\n\n" + "b" * 2000
    assert ch.chunk_spans(text)[0] == (0, 2800)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\nAB#", max_size=400), st.integers(1, 60), st.integers(0, 59))
def test_chunks_cover_everything(text, size, overlap):
    if overlap >= size:
        return
    spans = ch.chunk_spans(text, size, overlap)
    covered = 0
    for s, e in spans:
        assert s <= covered and 0 < e - s <= size
        covered = max(covered, e)
    assert covered == len(text)


def test_coverage_finds_a_gap(spark):
    chunks = spark.createDataFrame([("d", 0, 40), ("e", 0, 100)], "doc_id string, start_offset int, end_offset int")
    lengths = spark.createDataFrame([("d", 100), ("e", 100), ("f", 0)], "doc_id string, total_chars int")
    got = {r["doc_id"]: (r["covered_chars"], r["coverage_pct"], r["passed"]) for r in ch.coverage(chunks, lengths).collect()}
    assert got == {"d": (40, 40.0, False), "e": (100, 100.0, True), "f": (0, 100.0, True)}


# --- scalars --------------------------------------------------------------------------

@pytest.mark.parametrize(("name", "profile"), [("2401.01234v2.pdf", "arxiv_paper"), ("2401.01234.full.pdf", "arxiv_paper"), ("2023.05.06.123456v1.full.pdf", "biorxiv_paper"), ("note.md", "internal_doc")])
def test_routing(spark, name, profile):
    assert one(spark, px.route(F.col("f")), f=name) == profile


def test_ids_of_file_names(spark):
    assert one(spark, tx.arxiv_id(F.col("f")), f="2401.01234v2.pdf") == "2401.01234"
    assert one(spark, tx.biorxiv_doi(F.col("f")), f="2023.05.06.123456v1.full.pdf") == "10.1101/2023.05.06.123456"
    assert one(spark, tx.doi_year(F.lit("10.1101/2023.05.06.123456"))) == 2023


def test_slugs(spark):
    assert one(spark, ids.slug(F.col("t")), t="  José  Ñ-1 ") == "jos_1"
    assert one(spark, ids.slug(F.col("t")), t="***") == "unknown"
    assert one(spark, ids.vault_slug(F.lit(""))) == "untitled"
    assert one(spark, ids.card_slug(F.col("t")), t="A b_C: d!") == "a_b_c_d"
    assert one(spark, ids.reason_slug(F.col("t")), t="missing:a,b") == "missing_a_b"


@pytest.mark.parametrize(("text", "real", "broken"), [("$x+y$ and $a=b$", 2, 0), (r"$\_{s}$ $^{6}$ $_{ab}$", 0, 3), ("$x$", 0, 1), ("$$x+y$$", 0, 0), ("$ab$", 1, 0), ("cost $5", 0, 0)])
def test_math(spark, text, real, broken):
    m = one(spark, tx.math_spans(F.col("t")), t=text)
    assert (m["real"], m["broken"]) == (real, broken)


def test_math_retry(spark):
    retry = lambda r, b: one(spark, tx.math_retry(F.lit(r), F.lit(b)))
    assert retry(5, 5) and not retry(6, 5) and not retry(0, 4) and not retry(0, 0)


@pytest.mark.parametrize(("url", "reason"), [
    ("", "empty_url"), ("no-scheme", "missing_scheme"), ("ftp://a.org/x", "disallowed_scheme:ftp"), ("http:///x", "missing_host"), ("http://localhost/x", "blocked_host_literal:localhost"),
    ("http://10.0.0.8/x", "blocked_ip:10.0.0.8"), ("http://169.254.169.254/", "blocked_ip:169.254.169.254"), ("http://[::1]/", "blocked_ip:::1"), ("https://example.org/a", None), ("https://8.8.8.8/a", None)])
def test_url_gate(spark, url, reason):
    g = one(spark, tx.url_gate(F.col("u")), u=url)
    assert (g["reason"], g["allowed"]) == (reason, reason is None)


def test_url_gate_allows_named_hosts(spark):
    assert one(spark, tx.url_gate(F.lit("http://10.0.0.8/x"), allowed_hosts=("10.0.0.8",)))["allowed"]


def test_lists_labels_tokens(spark):
    assert one(spark, tx.clean_list(F.array(*map(F.lit, (" A", "a", "", "b", "B ", "c"))))) == ["A", "b", "c"]
    assert one(spark, tx.clean_label(F.lit('Name: "one two three four five six seven"\nmore'))) == "one two three four five six"
    assert [one(spark, tx.count_tokens(F.lit(t))) for t in ("", "abc", "a" * 9)] == [0, 1, 2]
    assert one(spark, tx.wikilinks(F.lit("[[a|b]] [[c]] [[d/e]]"))) == ["a", "c"]


def test_yield_and_preflight(spark):
    assert one(spark, ig.extract_yield(F.lit(10))) == "extract_yield_too_low:10<200"
    assert one(spark, ig.extract_yield(F.lit(210), F.lit(10))) == "extract_yield_per_page_too_low:21.0<50.0"
    assert one(spark, ig.extract_yield(F.lit(210), F.lit(0))) is None
    assert one(spark, ig.preflight(F.lit(""), F.lit(1))) == "unsupported_format:none"
    assert one(spark, ig.preflight(F.lit(".md"), F.lit(0))) == "empty_file"


def test_profile_contract(spark):
    df = spark.createDataFrame([("t", ["a"], "abs", "1", 2020), ("", [], None, "1", None)], "title string, authors array<string>, abstract string, arxiv_id string, year int")
    a, b = [r["v"] for r in df.select(px.validate(df, px.ARXIV).alias("v")).collect()]
    assert a["passed"] and a["reason"] is None
    assert not b["passed"] and b["reason"] == "missing:title,abstract,year"
    wrong = spark.createDataFrame([("t", "2020")], "title string, year string")
    v = wrong.select(px.validate(wrong, px.Profile("p", (px.FieldSpec("year", True, "int"),))).alias("v")).first()["v"]
    assert v["reason"] == "bad_type:year(int)"


def test_json_recovery():
    assert recovery.parse_answer('```json\n{"a": 1}\n```') == {"a": 1}
    assert recovery.parse_answer('Sure: {"a": [1, 2,],} done') == {"a": [1, 2]}
    assert recovery.parse_answer("none here") is None and recovery.parse_answer(None) is None


@pytest.mark.parametrize(("url", "reason"), [
    ("http://[::ffff:10.0.0.1]/", "blocked_ip:::ffff:10.0.0.1"), ("http://[::ffff:7f00:1]/", "blocked_ip:::ffff:7f00:1"), ("http://2130706433/", "blocked_ip:2130706433"), ("http://0x7f000001/x", "blocked_ip:0x7f000001"),
    ("http://[::ffff:8.8.8.8]/", None), ("http://134744072/", None), ("http://8.8.8.8/", None), ("http://[2606:4700::1111]/", None), ("http://10.1.2.3/", "blocked_ip:10.1.2.3")])
def test_addresses_in_other_forms(spark, url, reason):
    got = one(spark, tx.url_gate(F.col("u")), u=url)
    assert (got["allowed"], got["reason"]) == (reason is None, reason)


def test_clean_list_of_any_length(spark):
    r = one(spark, tx.clean_list(F.split("t", ",")), t=" b ,A,a,, B,c, A")
    assert r == ["b", "A", "c"]
    words = ",".join(f"w{i % 5000}" for i in range(60_000))
    assert len(one(spark, tx.clean_list(F.split("t", ",")), t=words)) == 5000


# --- metadata -------------------------------------------------------------------------

PAPER = """# Results

## 1 On the growth of lattices 12

Ada Byron$^{1}$, Carl Gauss2 and Emmy Noether*

## Abstract

We count things.
Twice.

## Introduction
arXiv: 2401.01234v2 in 2021, doi 10.1000/xyz.1 and US1234567B2
"""


def record(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(md.extract("t").alias("v")).first()["v"]


def test_heuristic_record(spark):
    got = record(spark, PAPER)
    assert got["title"] == "On the growth of lattices"
    assert got["authors"] == ["Ada Byron", "Carl Gauss", "Emmy Noether"]
    assert got["abstract"] == "We count things. Twice."
    assert (got["arxiv_id"], got["doi"], got["patent_number"], got["year"]) == ("2401.01234v2", "10.1000/xyz.1", "US1234567B2", 2021)


@pytest.mark.parametrize(("front", "authors"), [
    ("Authors: Ann Lee; Bo Li and Cy Fox", ["Ann Lee", "Bo Li", "Cy Fox"]),
    ("# T\n[Ann Lee](https://orcid.org/0)\n[Bo Li](mailto:b@x.org)\n", ["Ann Lee", "Bo Li"]),
    ("# T\nAnn Lee KAIST ann@x.org\nBo Li * Lab bo@y.org\n", ["Ann Lee", "Bo Li"]),
    ("# T\n- Ann Lee1,2, Bo\nLi2 and Cy Fox\n", ["Ann Lee", "Bo Li", "Cy Fox"]),
    ("# T\nAnn Lee\nof some place\nmail a.lee@x.org\n", ["Ann Lee"]),
    ("# T\nNobody here\n", None)])
def test_authors(spark, front, authors):
    assert record(spark, front)["authors"] == authors


def test_abstract_without_heading(spark):
    long = "word " * 60
    assert record(spark, f"# T\n\nbioRxiv preprint {long}\n\n{long}\n\n")["abstract"] == long.strip()


def test_title_sources(spark):
    assert record(spark, "Title: Plain one\n# Other")["title"] == "Plain one"
    assert record(spark, "| 1 | A title inside of a table cell |\n|---|---|\n")["title"] == "A title inside of a table cell"
    assert record(spark, "## Methods 10:\n## Real title")["title"] == "Real title"


LONG = "We count lattices that grow in a field of stones and ask how they do so, which nobody has asked before us, as far as is known to us today. " * 3


@pytest.mark.parametrize(("text", "title", "authors"), [
    ("## T: a study\n\n## [Ann Lee](https://orcid.org/0)\n\nann@x.org\n\n[Bo Li](https://orcid.org/1)\n\n## Abstract\n\nSee [Cy Fox](https://orcid.org/2)\n", "T: a study", ["Ann Lee", "Bo Li"]),
    ("# Of names\n\nAuthors: Ann Lee, Bo Li\n\n[Cy Fox](https://orcid.org/0)\n", "Of names", ["Ann Lee", "Bo Li"]),
    ("## Of mail\n\nAnn Lee ETHZ a@x.org\n\nBo Li MIT b.li@y.org\n\n## Abstract\n", "Of mail", ["Ann Lee", "Bo Li"]),
    ("## On rows\n\nAnn Lee, Bo Li, Cy Fox, and Di Wu\n\nInstitute of things\n", "On rows", ["Ann Lee", "Bo Li", "Cy Fox", "Di Wu"]),
    ("## On body\n\n## Abstract\n\nWe compare Adam, Bert, and Cora. Others are Dan, Eve, and so on.\n", "On body", None),
    ("## Abstract 10\n\nx\n\n## The title proper\n\nAnn M. Lee, Hans-Peter Fox\n", "The title proper", None),
    ("## digits\n\nAnn Lee1,2,3 , Bo Li2,3 , Cy Fox2,3,* , and Di Wu2,3,*\n", "digits", ["Ann Lee", "Bo Li", "Cy Fox", "Di Wu"]),
    ("## daggers\n\nAnn S.A. Lee† 1 , Bo C. Li† 1 , and Cy F. DeFox1\n", "daggers", ["Ann S.A. Lee", "Bo C. Li", "Cy F. DeFox"]),
    ("## On lists 1\n\n- Ann Lee, 1 Bo Li, 1 Cy Fox, 1 and Di-An Wu 1, * 2\n\n## SUMMARY\n", "On lists", ["Ann Lee", "Bo Li", "Cy Fox", "Di-An Wu"]),
    ("## A line 1\n\n2 Ann Lee1, Bo Li1*\n\n## ABSTRACT\n", "A line", ["Ann Lee", "Bo Li"]),
    ("## scripts\n\nAnn Lee$^{1}$, Bo Li$^{2}$, Cy Fox$^{3*}$\n", "scripts", ["Ann Lee", "Bo Li", "Cy Fox"]),
    ("## 1 Loss of lines\n\nAnn Lee, Bo M. Li\n", "Loss of lines", ["Ann Lee", "Bo M. Li"]),
    ("## Title: of labels\n\nAuthor A, Author B\n", "of labels", None),
    ("## hashes\n\nAnn Lee 1#, Bo Li 1#, Cy Fox 1, Di Wu 2, Ed Xu 1,2\n", "hashes", ["Ann Lee", "Bo Li", "Cy Fox", "Di Wu", "Ed Xu"]),
    ("## A wrap\n\nAnn Lee1,2,3*, Bo Li1,3*,\nCy Fox1,2*,\nDi Quan Wu1,2, Ed Xu1,\nFu Yi1,3\n", "A wrap", ["Ann Lee", "Bo Li", "Cy Fox", "Di Quan Wu", "Ed Xu", "Fu Yi"]),
    ("## of one\n\nHana Seo\n\nInstitute of things\n\nwrite to H.S. (Hana.Seo@x.ca)\n\n## Abstract\n", "of one", ["Hana Seo"]),
    ("## A paper\n\nSome Stray Header\n\n## Abstract\n", "A paper", None),
    ("## heat in hosts\n\n2 Ann Lee1* (ORCID iD: 0009-0000-4698-6432) and Bo Li1 (ORCID iD: 0000-\n0002-0867-4953)\n", "heat in hosts", ["Ann Lee", "Bo Li"]),
    ("| 1   | Using Deep Things of Stones to Guide Us |\n|-----|----|\n| 2   | Ann Lee 1 , Bo Li 1 *     |\n| 3   |     |\n\n## Abstract\n", "Using Deep Things of Stones to Guide Us", ["Ann Lee", "Bo Li"]),
    ("My Paper\n\nBy Ann Lee & Bo Li\n", None, ["Ann Lee", "Bo Li"]),
    ("## My Paper\nAnn Lee, Bo Li\n", "My Paper", ["Ann Lee", "Bo Li"]), ("", None, None), (None, None, None)])
def test_front_matter(spark, text, title, authors):
    got = record(spark, text)
    assert (got["title"], got["authors"]) == (title, authors)


def test_watermarks_are_no_abstract(spark):
    mark = "bioRxiv preprint doi: https://doi.org/10.1101/2026.01.01.123456; this version posted. All rights reserved. No reuse allowed. " * 3
    got = record(spark, f"{mark}\r\n\r\n## A title\r\n\r\nAnn, Bo\r\n\r\n{LONG}\r\n")
    assert got["abstract"] == LONG.strip() and got["doi"] == "10.1101/2026.01.01.123456" and got["title"] == "A title"


def test_long_fronts_are_read(spark):
    many = ", ".join(f"Ann{chr(97 + i % 26)} Lee{chr(97 + i // 26)}" for i in range(150))
    assert len(record(spark, f"# T\n\n{many}\n\n## Abstract\nx")["authors"]) == 150
    got = record(spark, "word, and " * 200_000 + "in 2020")
    assert got["year"] == 2020 and got["authors"] is None


def test_publisher_records(spark):
    atom = ("<feed xmlns='http://www.w3.org/2005/Atom' xmlns:arxiv='http://arxiv.org/x'><entry><title> A\n b </title><summary>S</summary><published>2024-01-02T00:00:00Z</published>"
            "<author><name>Ann Lee</name></author><author><name>Bo Li</name></author><arxiv:doi>10.1/x</arxiv:doi></entry></feed>")
    r = one(spark, md.from_atom(F.col("x"), F.lit("2401.1")), x=atom)
    assert (r["title"], r["authors"], r["year"], r["doi"]) == ("A b", ["Ann Lee", "Bo Li"], 2024, "10.1/x")
    details = '{"collection": [{"title": "old"}, {"title": "new", "abstract": "s", "authors": "A B; C D;", "date": "2023-04-05"}]}'
    r = one(spark, md.from_details(F.col("x"), F.lit("10.1/y")), x=details)
    assert (r["title"], r["authors"], r["year"]) == ("new", ["A B", "C D"], 2023)
    assert one(spark, md.from_details(F.lit("nonsense"), F.lit("d"))) is None


def test_triage(spark):
    head = "\n" * 5 + "A study of many things here\nAnn Lee, Bo Li\n"
    assert one(spark, ig.triage(F.col("t")), t=head + "Abstract\n")["class"] == "pass"
    assert one(spark, ig.triage(F.col("t")), t=head)["class"] == "flag"
    assert one(spark, ig.triage(F.col("t")), t="\n" * 5 + "nothing")["reason"] == "missing: title, authors, abstract"


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    """Texts are cut a few at a time, and batches into Python are bounded by bytes."""
    from loomgraph.functions import chunking
    from loomgraph.stage import ARROW_BYTES

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(chunking, "PART_BYTES", 5000)
    texts = [("x" * (i * 700)) if i else None for i in range(20)]
    got = chunking.chunk_documents(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= ARROW_BYTES
    want = {(i, k, s, e) for i, t in enumerate(texts) for k, (s, e) in enumerate(chunking.chunk_spans(t or ""))}
    assert {(r["doc_id"], r["ordinal"], r["start_offset"], r["end_offset"]) for r in got.collect()} == want


def test_patterns_are_named_once(spark):
    """A pattern that a plan names several times is looked for several times in each text."""
    from loomgraph import ids
    from loomgraph.operators import ingest as ig

    df = spark.createDataFrame([(1, "__a b__"), (2, "???"), (3, None), (4, "")], "i int, text string")
    slugs = df.select("i", ids.reason_slug(F.col("text")).alias("s"))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert plan(slugs).count("A-Za-z0-9._-") == 1
    assert [r["s"] for r in slugs.orderBy("i").collect()] == ["a_b", "unknown", "unknown", "unknown"]
    flags = df.select("i", ig.triage(F.col("text"), skip_lines=0).alias("t")).select("t.class", "t.has_title", "t.has_abstract")
    assert plan(flags).count("[Aa]bstract") == 1
