"""The pipeline's stages, one by one, against brute force on the smallest tables."""
import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from loomgraph.llm.queries import QUERIES, tokenizer  # noqa: E402
from tests.conftest import SF  # noqa: E402
from tests.llm.test_operators import brute_classes  # noqa: E402


def test_stages_take_effect(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "leaks", "encode"]
    scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op4_quality"](spark, SF).collect()}
    kept = stages["quality"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, p in scores.items() if p}
    lines = stages["lines"](spark, kept, SF).cache()
    assert lines.columns == docs.columns and lines.count() == kept.count()
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    unique = stages["near_duplicates"](spark, lines, SF).cache()
    texts = sorted((r["doc_id"], r["text"]) for r in lines.collect())
    classes = brute_classes([t for _, t in texts])
    assert {r["doc_id"] for r in unique.collect()} == {texts[c][0] for c in set(classes.values())}
    clean = stages["leaks"](spark, unique, SF).cache()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in unique.collect() if not any(i in r["text"] for i in items)}
    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    last = stages["encode"](spark, clean, SF).collect()
    assert {r["doc_id"] for r in last} == set(text)
    for r in last:
        assert r["n_tokens"] == len(tok.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run_gives_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_take_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "y"), (3, "a b c d e f", "en", "s", 11, None)]
    for data in ([], rows):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(data, schema), SF)
            assert out.count() <= len(data), name
