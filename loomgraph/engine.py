"""The engine over one corpus: stages that write tables, tools that read them."""
from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ids, schemas
from . import sinks as sk
from .corpus import Corpus
from .functions import chunking as ch
from .functions import models as md_models
from .functions import text as tx
from .operators import community as cm
from .operators import concepts as cc
from .operators import decay as dk
from .operators import evaluate as ev
from .operators import graph as gx
from .operators import ingest as ig
from .operators import publish as pb
from .operators import render as rd
from .operators import reports as rp
from .operators import retrieve as rt
from .operators import tokens as tk
from .operators import vector_index as vi
from .operators import vectors as vx
from .sources import files as sf
from .sources import tables as tb
from .stage import Stage

Json = dict[str, Any]


class ToolError(ValueError):
    """A tool was asked for what it cannot give."""


class Engine:
    def __init__(self, spark: SparkSession, corpus: Corpus, embedder=None, clock: Callable[[], dt.datetime] | None = None) -> None:
        self.spark, self.corpus = spark, corpus
        self.embedder = embedder or vx.hashing_embedder()
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC))

    # --- tables -----------------------------------------------------------------------
    def read(self, name: str, schema: str | None = None) -> DataFrame:
        path = self.corpus.table(name)
        return tb.read_or_empty(self.spark, path, schema) if schema else self.spark.read.parquet(path)

    def has(self, name: str) -> bool:
        return tb.exists(self.spark, self.corpus.table(name))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return tb.replace(df, self.corpus.table(name))

    # --- stages -----------------------------------------------------------------------
    def ingest(self, publisher: DataFrame | None = None, extractor=None, hooks: ig.Hooks | None = None, profiles: dict | None = None, move: bool = False) -> DataFrame:
        """One pass over the source files; counts by status. With ``move``, ingested files go to
        ``processed`` and refused ones to ``quarantine``, each with a note of the reason beside it."""
        self._put_back()
        seen, old = self.read("manifest", schemas.MANIFEST), self.read("docs", schemas.DOCS)
        out = ig.ingest(sf.scan(self.spark, str(self.corpus.root)), ig.known_hashes(seen), publisher, extractor, hooks, F.lit(self.clock()).cast("timestamp"), profiles=profiles, taken=old.select("doc_id"))
        stage = Stage(self.spark, "moves")
        out = stage.write(out, "found")
        if move:
            taken = seen.where("destination is not null").select(F.col("destination").alias("path"))
            out = stage.write(sk.targets(out.withColumn("wanted", sk.routed(out)), taken), "outcomes")
            moves = out.where("target is not null").select(F.col("path").alias("source"), "target")
            moves.write.mode("append").parquet(self.corpus.table("intents"))
            failed = stage.write(sk.move_files(moves, str(self.corpus.root)), "moved").where("error is not null").select(F.col("source").alias("path"), "error")
            # a file that could not be moved is not ingested
            out = out.drop("error").join(failed, "path", "left").withColumns({
                "status": F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")), "reason": F.when(F.col("error").isNotNull(), F.concat(F.lit("move_error:"), "error")).otherwise(F.col("reason")),
                "target": F.when(F.col("error").isNull(), F.col("target"))})
            out = stage.write(out, "settled")
            notes = out.where("status = 'quarantined'").select(F.concat("target", F.lit(".reason.json")).alias("path"), F.to_json(F.struct("reason", F.col("path").alias("original"), "content_hash")).alias("markdown"))
            stage.write(sk.write_texts(notes, str(self.corpus.root)), "notes")
        ig.document_rows(out).write.mode("append").parquet(self.corpus.table("docs"))
        ig.quarantine_rows(out).write.mode("append").partitionBy("reason_slug").parquet(self.corpus.table("quarantine"))
        ig.math_retry_rows(out.where("status = 'ingested'")).write.mode("append").parquet(self.corpus.table("math_retry"))
        # last: a file counts as done once the manifest has it
        ig.manifest_rows(out).write.mode("append").parquet(self.corpus.table("manifest"))
        return ig.status_counts(out)

    def _put_back(self) -> None:
        """Files that a broken pass moved but did not enter in the manifest go back to their places, and
        what it wrote of them goes; the next pass finds them again."""
        if not self.has("intents"):
            return
        seen = self.read("manifest", schemas.MANIFEST)
        lost = self.read("intents", "source string, target string").join(seen.select(F.col("destination").alias("target")), "target", "left_anti").distinct()
        stage = Stage(self.spark, "put-back")
        lost = stage.write(lost, "lost")
        if lost.limit(1).count():
            stage.write(sk.move_files(lost, str(self.corpus.root), "target", "source"), "moved")
            docs = self.read("docs", schemas.DOCS)
            self.write(docs.join(seen.where("status = 'ingested'").select("hash").distinct(), "hash", "left_semi").select(*docs.columns), "docs")
        self.write(self.read("intents", "source string, target string").limit(0), "intents")

    def status(self) -> DataFrame:
        return ig.status_counts(self.read("manifest", schemas.MANIFEST))

    def triage(self, probe: Callable[[bytes], str | None] | None = None, defer: bool = False) -> DataFrame:
        """(path, class, reason) of the PDF files. ``probe`` gives the text of a file's content,
        None or an error if it can't; without one only content that is plain text is read. With
        ``defer``, files of that class go to ``defer``, under their own folders."""
        files = sf.scan(self.spark, str(self.corpus.root)).where("suffix = '.pdf'")
        text = md_models.asked(probe, F.col("content")) if probe else F.when(~F.col("content").startswith(F.lit(b"%PDF")), ig.decode(F.col("content")))
        out = files.select("path", ig.triage(text).alias("t")).select("path", "t.*")
        if defer:
            stage = Stage(self.spark, "triage")
            out = stage.write(out, "classes")
            moves = out.where("class = 'defer'").select(F.col("path").alias("source"), F.concat(F.lit("defer/"), "path").alias("target"))
            stage.write(sk.move_files(moves, str(self.corpus.root)), "moved")
        return out

    def embed(self, force: bool = False) -> int:
        """Chunk and embed documents that have no vectors yet; their number."""
        cfg, docs = self.corpus.config, self.read("docs")
        vectors, chunks = self.read("chunk_vectors", schemas.CHUNK_VECTORS), self.read("chunks", schemas.CHUNKS)
        todo = docs if force else vx.not_embedded(docs, vectors)
        n = todo.count()
        if n:
            made = ch.chunk_documents(todo, cfg.max_chars, cfg.overlap_chars, title_col="title").join(todo.select("doc_id", "title", "year"), "doc_id")
            made = made.select("chunk_id", "doc_id", "ordinal", "start_offset", "end_offset", "text", "title", "year", "total_chunks")
            if force:
                chunks, vectors = chunks.limit(0), vectors.limit(0)
            chunks = self.write(vx.upsert(chunks, made), "chunks")
            new = chunks.join(todo.select("doc_id"), "doc_id", "left_semi").select("chunk_id", "doc_id", self.embedder("text").alias("vec"))
            self.write(vx.upsert(vectors, new), "chunk_vectors")
            for name, table in zip(("postings", "terms", "term_stats"), rt.bm25_tables(chunks, "chunk_id", tx.lexical_tokens(F.col("text"))), strict=True):
                self.write(table, name)
            if self.has("vector_index"):
                self.index_vectors()
        return n

    def index_vectors(self) -> None:
        """Build the approximate index that ``corpus_search`` then uses; ``embed`` keeps it up to date."""
        vi.build(self.read("chunk_vectors"), self.corpus.table("vector_index"))

    def lexical_search(self, query: str, k: int = 5) -> DataFrame:
        """The best chunks by BM25, from the postings that ``embed`` keeps."""
        if not self.has("postings"):
            return rt.bm25_top(self.read("chunks"), query, k, "chunk_id")
        return rt.bm25_kept(self.read("postings"), self.read("terms"), self.read("term_stats"), query, k, "chunk_id")

    def build_graph(self, concepts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        docs = self.read("docs")
        nodes, edges = gx.build_graph(docs, gx.extract_entities(docs))
        if concepts is not None:
            nodes, edges = gx.augment_with_concepts(nodes, edges, concepts)
            summaries = concepts.where("summary is not null").select("doc_id", self.embedder("summary").alias("vec"))
            edges = edges.unionByName(gx.semantic_edges(vx.similar_pairs(summaries, self.corpus.config.semantic_edge_threshold, "doc_id", "vec")))
        tb.save_graph(nodes, edges, self.corpus.table("graph"))
        return tb.load_graph(self.spark, self.corpus.table("graph"))

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return tb.load_graph(self.spark, self.corpus.table("graph"))

    def cluster(self, ceiling: cm.Rigor = cm.Rigor.PRINCIPLED, router: cm.Router | None = None) -> cm.Result:
        """Partition the projection; ids stay those of the last run where members agree."""
        nodes, edges = self.graph()
        doc_nodes = nodes.where("node_type = 'document'").select("node_id")
        vectors = self.read("chunk_vectors", schemas.CHUNK_VECTORS)
        doc_vectors = vx.centroids(vectors, ["doc_id"], "vec").select(ids.doc_node(F.col("doc_id")).alias("node_id"), "vec")
        projection = self.write(gx.project(edges), "projection")
        result = (router or cm.Router()).cluster(doc_nodes, projection, doc_vectors, ceiling)
        part = result.partition
        if self.has("partition"):
            part = cm.remap_to_previous(part, self.read("partition"))
        part = self.write(part.select("node_id", F.col("community_id").cast("int").alias("community_id"), F.col("path").cast("array<int>").alias("path")), "partition")
        titles = nodes.select("node_id", "title")
        named = projection.withColumnsRenamed({"a": "src", "b": "dst"})
        self.write(cm.community_table(part, named, titles, result), "communities")
        self.write(vx.community_centroids(vectors, part), "community_centroids")
        self.write(part.withColumn("backend_tag", F.lit(result.backend)), f"partition_{result.backend}")
        result.partition = part
        return result

    def render(self) -> DataFrame:
        """The cards table, with community fields where there are communities."""
        docs = self.read("docs")
        chunks = self.read("chunks", schemas.CHUNKS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
        now = self.clock().strftime("%Y-%m-%d %H:%M")
        base = docs.join(chunks, "doc_id", "left").withColumns({
            "id": F.col("doc_id"), "type": F.lit("paper"), "date": F.lit(now[:10]), "status": F.lit("exploratory"), "tags": F.col("topics"), "title": F.coalesce("title", "doc_id"),
            "relevance": F.lit(1.0), "half_life_days": F.lit(365), "ingested": F.lit(now), "last_touched": F.lit(now)})
        if self.has("partition"):
            place = self.read("partition").select(ids.bare_id(F.col("node_id")).alias("doc_id"), "community_id", F.col("path").alias("community_path"))
            base = base.join(place, "doc_id", "left").join(self.read("communities").select("community_id", F.col("label").alias("community_label")), "community_id", "left")
        old = self.read("cards", schemas.CARDS).select("doc_id", "supersedes")
        cards = base.withColumn("markdown", rd.card_markdown(base)).join(old, "doc_id", "left")
        return self.write(cards.select("doc_id", "title", "status", "relevance", F.col("half_life_days").cast("double").alias("half_life_days"), "last_touched", "tags", "supersedes", "markdown"), "cards")

    def decay(self, dry_run: bool = False) -> DataFrame:
        cards = self.read("cards", schemas.CARDS)
        nodes, edges = self.graph()
        out = dk.decay_pass(cards, edges, F.lit(self.clock().date()))
        if not dry_run:
            stage = Stage(self.spark, "decay")  # both results are whole before either table goes
            kept = stage.write(out.select(*[f.split()[0] for f in schemas.CARDS.split(", ")], "decayed"), "cards")
            edges = stage.write(dk.supersession_edges(edges, dk.supersession_pairs(cards)), "edges")
            out = self.write(kept, "cards")
            tb.save_graph(nodes, edges, self.corpus.table("graph"))
        return out

    def publish(self) -> DataFrame:
        """The published nodes with communities of the canonical partition, and a manifest of
        the cards."""
        nodes, _ = self.graph()
        tags = [t for t in pb.ORDER if self.has(f"partition_{t}")]
        best = pb.canonical(tags)
        part = self.read(f"partition_{best}") if best else self.read("partition", schemas.PARTITION)
        merged = pb.merge_communities(nodes, part, self.read("communities", schemas.COMMUNITIES))
        self.write(merged, "published_nodes")
        cards = self.read("cards", schemas.CARDS)
        return self.write(pb.manifest(cards.select(F.concat(F.lit("cards/"), "doc_id", F.lit(".md")).alias("path"), F.col("markdown").alias("content"))), "published_manifest")

    def publish_to(self, target: str, name: str | None = None, archive: bool = False) -> DataFrame:
        """A copy of what the corpus gives, below ``target``: cards and community pages as files,
        tables of the graph, communities and vectors, reports, and pages that explain it; and
        ``manifest``, (path, bytes, sha256) of each file. Sources, manifests of ingest and the
        quarantine stay behind. With ``archive``, the vector table is one tar as well."""
        self.publish()
        name, root = name or self.corpus.root.name, target.rstrip("/")
        stage, shown = Stage(self.spark, "publish"), {t: self.read(t) for t in ("published_nodes", "communities", "partition", "chunk_vectors", "chunks") if self.has(t)}
        shown["edges"] = self.graph()[1]
        for table, df in shown.items():
            df.write.mode("overwrite").parquet(f"{root}/tables/{table}")
        pages = self.read("cards", schemas.CARDS).select(F.concat(F.lit("cards/"), "doc_id", F.lit(".md")).alias("path"), "markdown")
        if self.has("communities"):
            pages = pages.unionByName(self.community_pages().select(F.concat(F.lit("communities/"), "slug", F.lit("-"), F.col("community_id").cast("string"), F.lit(".md")).alias("path"), "markdown"))
        figures = {r["table"]: r["n_rows"] for r in pb.inventory(**shown).collect()}
        colours = self.read("communities", schemas.COMMUNITIES).select("community_id").orderBy(F.desc("n_members"), "community_id").limit(pb.COLOURED)
        texts = pb.pages(name, figures, [r[0] for r in colours.collect()], self.clock()) | {f"reports/{p.name}": p.read_text(encoding="utf-8") for p in sorted((self.corpus.root / "reports").glob("*.md"))}
        pages = pages.unionByName(self.spark.createDataFrame(list(texts.items()), "path string, markdown string"))
        manifest = stage.write(sk.write_texts(pages, root), "manifest")
        if archive:
            manifest = manifest.unionByName(self.spark.createDataFrame([pb.archived(f"{root}/tables/chunk_vectors", f"{root}/vectors.tar")], sk.WRITTEN))
        manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
        return manifest

    # --- reports ------------------------------------------------------------------------
    def report(self, name: str, text: str) -> str:
        """A report kept below ``reports``; its path."""
        path = self.corpus.root / "reports" / f"{name}.md"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text, encoding="utf-8")
        return str(path)

    def report_decay(self, cards: DataFrame, dry_run: bool = False) -> str:
        pairs = dk.supersession_pairs(cards)
        return self.report("decay", rp.decay_report(cards, pairs, dk.archive_candidates(cards), dry_run))

    def report_tokens(self) -> str:
        log = self.read("token_log", schemas.TOKEN_LOG)
        return self.report("tokens", rp.token_report(tk.totals(log), tk.report(log, "tool").orderBy("group")))

    def relabel(self, answer: Callable[[str], str]) -> DataFrame:
        """Communities with labels from a model, kept."""
        cards = self.read("docs").select("doc_id", "title", F.col("topics").alias("tags"))
        stage = Stage(self.spark, "labels")
        return self.write(stage.write(cm.relabel(self.read("communities"), self.read("partition"), cards, answer), "communities"), "communities")

    def evaluate_graph(self, judge: Callable[[str], str] | None = None, sample: int = 100) -> str:
        nodes, edges = self.graph()
        judged = None
        if judge is not None:
            picked = edges.orderBy(F.xxhash64("src", "dst", "relation")).limit(sample)
            prompt = F.concat(F.lit("Is this link right? Reply with a number from 0 to 1.\n"), "src", F.lit(" "), "relation", F.lit(" "), "dst")
            judged = ev.judged_means(ev.judge(picked, prompt, judge, ev.number), ["judged"])
        metrics = gx.graph_metrics(nodes, edges).crossJoin(gx.component_metrics(nodes, edges))
        return self.report("eval-graph", rp.graph_report(metrics, gx.by_relation(edges).orderBy("relation"), judged) + "\n## Types\n\n" + rp.table(gx.by_type(nodes).orderBy("node_type", "entity_type")) + "\n")

    def evaluate_clusters(self) -> str:
        nodes = self.graph()[0].where("node_type = 'document'").select("node_id")
        projection, shapes = self.read("projection"), []
        for tag in [t for t in pb.ORDER if self.has(f"partition_{t}")]:
            part = self.read(f"partition_{tag}")
            shapes.append((tag, gx.partition_shape(part).crossJoin(gx.modularity(projection, part)).crossJoin(gx.surprise(nodes, projection, part))))
        return self.report("eval-cluster", rp.cluster_report(shapes))

    def make_test_set(self, answer: Callable[[str], str], size: int = 100, per_doc: int = 3) -> DataFrame:
        """Questions of an injected model on sampled chunks, kept as the table ``test_set``."""
        picked = ev.stratified_sample(self.read("chunks"), "doc_id", F.xxhash64("chunk_id"), per_doc, size)
        return self.write(cc.make_examples(picked, answer).withColumn("position", F.xxhash64("question")), "test_set")

    def evaluate_retrieval(self, k: int = 5, rerank: Callable[[Column, Column], Column] | None = None, answer: Callable[[str], str] | None = None, judge: Callable[[str], str] | None = None) -> str:
        """Hits and ranks of the test set's chunks, the effect of a reranker (a score of question
        and text), and the judge's means over answered questions; the report's path."""
        stage, chunks = Stage(self.spark, "retrieval"), self.read("chunks")
        tests = ev.load_test_set(self.read("test_set"), chunks)
        asked_for = stage.write(tests.select("question", "seed_chunk", "seed_doc", "ground_truth", self.embedder("question").alias("qvec")), "questions")
        fetch = rt.OVERFETCH * k if rerank else k
        hits = stage.write(vx.top_k_joined(self.read("chunk_vectors").select("chunk_id", "vec"), asked_for.select("question", "qvec"), fetch, "chunk_id", "vec", "question", "qvec"), "hits")
        hits = hits.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
        if rerank is not None:
            hits = hits.withColumn("again", rerank(F.col("question"), F.col("text")))
        order = lambda by: F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), "chunk_id", "doc_id"))), lambda x: F.struct(x["chunk_id"].alias("c"), x["doc_id"].alias("d")))
        lists = hits.groupBy("question").agg(order(F.col("rank").cast("double")).alias("before"), *([order(-F.col("again")).alias("after")] if rerank else []))
        final = "after" if rerank else "before"
        results = stage.write(asked_for.drop("qvec").join(lists, "question", "left").select(
            "question", "seed_chunk", "seed_doc", "ground_truth", *[F.coalesce(F.col(final)[f], F.array().cast("array<string>")).alias(n) for n, f in (("chunks", "c"), ("docs", "d"))],
            *[F.col(n)["c"].alias(n) for n in (("before", "after") if rerank else ())], F.col("seed_chunk").alias("seed")), "results")
        cut = results.withColumns({c: F.slice(c, 1, k) for c in ("chunks", "docs")})
        text = rp.retrieval_report(ev.retrieval_metrics(results, k), ev.rerank_delta(results.withColumns({c: F.slice(c, 1, k) for c in ("before", "after")}), k) if rerank else None, ev.failures(cut.select("question"), cut))
        if answer is not None:
            texts = cut.select("question", F.posexplode("chunks").alias("rank", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
            turns = stage.write(cc.rag_turn(texts, answer).join(cut.select("question", "ground_truth"), "question"), "turns")
            if judge is not None:
                scored = stage.write(ev.judged_turns(turns, judge, ev.number), "judged")
                text += "\n## Judged\n\n" + rp.table(ev.judged_means(scored, [n for n, _ in ev.JUDGED])) + "\n"
        return self.report("eval-rag", text)

    def export_vault(self) -> int:
        """Cards and community pages as files below the corpus, pages of communities that are
        gone removed, and dashboard, index and log at its root; the number of files."""
        root, files, stage = self.corpus.root, 0, Stage(self.spark, "vault")
        parts = [("cards", self.read("cards", schemas.CARDS).select(F.col("doc_id").alias("name"), "markdown"))]
        if self.has("communities"):
            parts.append(("communities", self.community_pages().select("slug", "community_id", "markdown").select(F.concat_ws("-", "slug", F.col("community_id").cast("string")).alias("name"), "markdown")))
        for folder, rows in parts:
            (root / folder).mkdir(exist_ok=True)
            written = stage.write(sk.write_texts(rows.select(F.concat("name", F.lit(".md")).alias("path"), "markdown"), str(root / folder)), folder)
            files += written.count()
            if folder == "communities":  # a page a community: few
                wanted = {r[0] for r in written.select("path").collect()}
                for old in (root / folder).glob("*.md"):
                    if old.name not in wanted:
                        old.unlink()
        (root / "dashboard.md").write_text(rp.dashboard(), encoding="utf-8")
        (root / "index.md").write_text(rp.index(), encoding="utf-8")
        log = root / "log.md"
        entry = f"## {self.clock():%Y-%m-%d %H:%M}\n\n{files} pages written"
        log.write_text(rp.prepended_log(log.read_text(encoding="utf-8") if log.exists() else "", entry), encoding="utf-8")
        return files

    def extract_concepts(self, answer: Callable[[str], str], force: bool = False) -> DataFrame:
        """Counts by status; what was extracted joins the concepts table."""
        known = self.read("concepts", "doc_id string, summary string, topics array<string>, methods array<string>, named_entities array<string>, domain string")
        stage = Stage(self.spark, "concepts")
        out = stage.write(cc.extract_concepts(self.read("docs"), answer, known, force), "new")
        self.write(vx.upsert(known, out.where("status = 'extracted'").drop("status"), "doc_id"), "concepts")
        return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def draw(self, max_nodes: int = 3000, types: list[str] | None = None) -> str:
        nodes, edges = self.graph()
        shown, inside = pb.graph_payload(nodes, edges, max_nodes, types)
        return rp.drawing(shown, inside, self.corpus.root.name)

    # --- tools ------------------------------------------------------------------------
    def query_values(self, query: str) -> list[float]:
        return list(self.spark.createDataFrame([(query,)], "q string").select(self.embedder("q").alias("v")).first()["v"])

    def query_vector(self, query: str):
        return vx.query_vector(self.query_values(query))

    def _community(self, community_id: Any) -> Json:
        try:
            cid = int(community_id)
        except (TypeError, ValueError):
            raise ToolError("community_id (int) is required") from None
        row = self.read("communities", schemas.COMMUNITIES).where(F.col("community_id") == cid).first()
        if row is None:
            raise ToolError(f"community not found: {cid}")
        return row.asDict(recursive=True)

    def _members(self, cid: int) -> list[str]:
        return [r[0] for r in self.read("partition").where(F.col("community_id") == cid).select("node_id").orderBy("node_id").collect()]

    def corpus_search(self, query: str, k: int = 5, where=None) -> DataFrame:
        if not (query or "").strip():
            raise ToolError("query is required")
        if self.has("vector_index"):
            hits = vi.search(self.spark, self.corpus.table("vector_index"), self.query_values(query), k, where=where)
        else:
            hits = rt.dense_search(self.read("chunk_vectors"), self.query_vector(query), k, "chunk_id", "vec", where)
        hits = hits.drop("vec", "doc_id").join(self.read("chunks"), "chunk_id")
        part = self.read("partition", schemas.PARTITION)
        out = rt.with_community(rt.hit_payload(hits), part, self.read("communities", schemas.COMMUNITIES), "doc_id")
        return out.select("chunk_id", "score", "doc_id", "title", "ordinal", "text", "community_id", "path", "label").orderBy(F.desc("score"), "chunk_id")

    def subgraph_extract(self, seed_nodes: list[str], depth: int = 1, max_nodes: int | None = None) -> Json:
        if not isinstance(seed_nodes, list) or not seed_nodes:
            raise ToolError("seed_nodes (non-empty list) is required")
        seeds = self.spark.createDataFrame([(s,) for s in seed_nodes], "node_id string")
        seen, walked, truncated = gx.bfs(self.graph()[1].select("src", "dst", "relation", "confidence"), seeds, depth, max_nodes)
        out: Json = {"nodes": [r[0] for r in seen.select("node_id").orderBy("node_id").collect()],
                     "edges": [list(r) for r in walked.orderBy("src", "dst", "relation").collect()]}
        return out | {"truncated": True} if truncated else out

    def card_get(self, doc_id: str) -> str:
        row = self.read("cards", schemas.CARDS).where(F.col("doc_id") == doc_id).select("markdown").first()
        if row is None:
            raise ToolError(f"card not found: {doc_id}")
        return row[0]

    def community_pages(self) -> DataFrame:
        return rd.community_page(self.read("communities"), self.read("partition"), self.read("docs"))

    def community_get(self, community_id: Any) -> str:
        """The page of a community by id, else by the slug of its label."""
        pages, key = self.community_pages(), str(community_id)
        row = pages.where(F.col("community_id").cast("string") == key).first() or pages.where(F.col("slug") == key).first()
        if row is None:
            raise ToolError(f"community not found: {community_id}")
        return row["markdown"]

    def community_brief(self, community_id: Any, top_n: int = 5) -> Json:
        c = self._community(community_id)
        reps = (c["core_nodes"] or self._members(c["community_id"]))[:top_n]
        return {"community_id": c["community_id"], "label": c["label"], "n_members": c["n_members"], "representatives": reps, "rigor": c["rigor"], "backend": c["backend"]}

    def community_search(self, query: str, k: int = 5) -> DataFrame:
        if not (query or "").strip():
            raise ToolError("query is required")
        return rt.community_search(self.read("community_centroids"), self.read("communities"), self.query_vector(query), k)

    def community_core_nodes(self, community_id: Any) -> Json:
        c = self._community(community_id)
        if c["core_nodes"]:
            return {"community_id": c["community_id"], "label": c["label"], "core_nodes": c["core_nodes"]}
        return {"community_id": c["community_id"], "core_nodes": [], "note": "too small to rank; all members follow", "members": self._members(c["community_id"])}

    def community_hierarchy(self, doc_id: str) -> Json:
        if not doc_id:
            raise ToolError("doc_id is required")
        row = self.read("partition").where(ids.bare_id(F.col("node_id")) == str(doc_id).removeprefix(ids.DOC)).select("path").first()
        if row is None or not row[0]:
            raise ToolError(f"doc_id not in any community: {doc_id}")
        return {"doc_id": doc_id, "leaf_community_id": row[0][0], "path": list(row[0]), "n_levels": len(row[0])}

    def token_econ_report(self, group_by: str = "tool", since: str | None = None, until: str | None = None, tool: str | None = None, surface_id: str | None = None) -> Json:
        log = tk.filtered(self.read("token_log", schemas.TOKEN_LOG), since, until, tool, surface_id)
        rows = [r.asDict() for r in tk.report(log, group_by).orderBy("group").collect()]
        return {"groups": rows, "totals": tk.totals(log).first().asDict()}

    # --- accounting -------------------------------------------------------------------
    def counterfactual(self, tool: str, args: Json, served: str) -> int | None:
        """What the naive way would have cost; None where nothing compares."""
        cards, one = self.read("cards", schemas.CARDS), lambda df: int(df.first()[0])
        if tool == "corpus_search":
            best = self.lexical_search(args["query"], int(args.get("k", 5)))
            return one(tk.total_cost(self.read("chunks").join(best, "chunk_id", "left_semi")))
        if tool == "community_search":
            return one(tk.total_cost(self.read("chunks")))
        if tool == "subgraph_extract":
            nodes = [n for n in json.loads(served)["nodes"] if n.startswith(ids.DOC)]
            return one(tk.tokens_of(self.spark.createDataFrame([(n,) for n in nodes], "node_id string"), cards))
        if tool in ("community_get", "community_core_nodes"):
            cid = int(args["community_id"])
            return one(tk.tokens_of(self.read("partition").where(F.col("community_id") == cid), cards))
        if tool == "community_brief":
            return max(1, len(self.community_get(args["community_id"])) // 4)
        if tool == "community_hierarchy":
            return one(tk.total_cost(self.read("partition").select(F.to_json(F.struct("*")).alias("text")))) or None
        if tool == "card_get":
            row = self.read("docs").where(F.col("doc_id") == args["doc_id"]).select("text").first()
            return None if row is None else max(1, len(row[0]) // 4)
        return None

    TOOLS = {
        "corpus_search": ("query", "k"), "subgraph_extract": ("seed_nodes", "depth", "max_nodes"), "card_get": ("doc_id",), "community_get": ("community_id",),
        "community_brief": ("community_id", "top_n"), "community_search": ("query", "k"), "community_core_nodes": ("community_id",), "community_hierarchy": ("doc_id",),
        "token_econ_report": ("group_by", "since", "until", "tool", "surface_id"),
    }

    def call_tool(self, name: str, args: Json | None = None) -> Json:
        """A tool's answer in the envelope of the protocol; successful calls are logged."""
        args = args or {}
        if name not in self.TOOLS:
            return {"isError": True, "content": [{"type": "text", "text": f"unknown tool: {name}"}]}
        try:
            out = getattr(self, name)(**{k: v for k, v in args.items() if k in self.TOOLS[name]})
            text = out if isinstance(out, str) else json.dumps([r.asDict(recursive=True) for r in out.collect()] if isinstance(out, DataFrame) else out, indent=2, default=str)
        except (ToolError, TypeError) as e:
            return {"isError": True, "content": [{"type": "text", "text": str(e)}]}
        cost = self.counterfactual(name, args, text)
        if cost is not None:
            row = tk.record(name, str(next(iter(args.values()), "")), max(1, len(text) // 4) if text else 0, cost, self.clock().isoformat())
            self.spark.createDataFrame([row], schemas.TOKEN_LOG).write.mode("append").parquet(self.corpus.table("token_log"))
        return {"content": [{"type": "text", "text": text}]}

    def handle(self, request: Json) -> Json | None:
        """One JSON-RPC request of the tool protocol."""
        method, params = request.get("method"), request.get("params") or {}
        if "id" not in request:
            return None
        if method == "initialize":
            result: Json = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {a: {} for a in names}}} for n, names in self.TOOLS.items()]}
        elif method == "tools/call":
            try:
                result = self.call_tool(params.get("name", ""), params.get("arguments"))
            except Exception as e:
                result = {"isError": True, "content": [{"type": "text", "text": f"{type(e).__name__}: {e}"[:2000]}]}
        else:
            return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": f"unknown method: {method}"}}
        return {"jsonrpc": "2.0", "id": request["id"], "result": result}
