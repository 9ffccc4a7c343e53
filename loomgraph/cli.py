"""The command line: one subcommand a stage."""
from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from .corpus import Corpus, Registry, resolve

CEILINGS = ("principled", "heuristic", "embeddings_only")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--version", action="version", version="loomgraph 0.2.0")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init", help="make a corpus")
    init.add_argument("path")
    init.add_argument("--register-as")
    init.add_argument("--set-default", action="store_true")
    for name in ("corpora", "corpus"):
        listed = sub.add_parser(name, help="list the registered corpora")
        if name == "corpus":
            listed.add_argument("action", choices=("list",))

    def command(name: str, text: str, within=sub) -> argparse.ArgumentParser:
        one = within.add_parser(name, help=text)
        one.add_argument("--corpus")
        return one

    def model(one: argparse.ArgumentParser, *names: str) -> None:
        for n in names:
            one.add_argument(f"--{n}", metavar="MODULE:FUNCTION", help="a function from a prompt to an answer")

    one = command("ingest", "read new files")
    one.add_argument("--keep", action="store_true", help="leave files where they are")
    one.add_argument("--triage", action="store_true", help="put off PDFs without title, authors and abstract first")
    command("watch", "read files as they come")
    one = command("triage", "class PDFs by their text")
    one.add_argument("--defer", action="store_true", help="move those to put off")
    model(one, "probe")
    command("status", "outcomes so far")
    one = command("embed", "chunks and vectors")
    one.add_argument("--force", action="store_true")
    one = command("semantic-extract", "concepts of documents by a model")
    model(one, "model")
    one.add_argument("--force", action="store_true")
    one = command("graph", "build the graph")
    one.add_argument("--no-concepts", action="store_true")
    one = command("cluster", "communities")
    one.add_argument("--ceiling", choices=CEILINGS, default="principled")
    model(one, "label-model")
    evaluated = sub.add_parser("eval", help="reports on quality").add_subparsers(dest="what", required=True)
    for within, prefix in ((evaluated, ""), (sub, "eval-")):  # "eval graph" and "eval-graph"
        one = command(f"{prefix}graph", "metrics of the graph", within)
        one.add_argument("--sample", type=int, default=100)
        model(one, "judge")
        command(f"{prefix}cluster", "shape and quality of communities", within)
        one = command(f"{prefix}ragas", "retrieval over a test set", within)
        one.add_argument("--n-questions", type=int, default=100)
        one.add_argument("--per-doc-cap", type=int, default=3)
        one.add_argument("--k", type=int, default=5)
        one.add_argument("--reuse-testset", action="store_true")
        model(one, "model", "judge", "rerank")
    one = command("viz", "draw the graph")
    one.add_argument("--max-nodes", type=int, default=3000)
    one.add_argument("--types", nargs="+")
    command("render", "cards and pages as files")
    one = command("decay", "age the cards")
    one.add_argument("--dry-run", action="store_true")
    one = command("token-report", "what the tools saved")
    for opt in ("group-by", "since", "until", "tool", "surface-id"):
        one.add_argument(f"--{opt}")
    command("serve", "answer tool calls on standard input")
    one = command("publish", "publish nodes, or a whole copy")
    one.add_argument("--to")
    one.add_argument("--name")
    one.add_argument("--archive", action="store_true")
    return p


def named(spec: str | None) -> Callable | None:
    """The function that MODULE:FUNCTION names."""
    if spec is None:
        return None
    module, _, function = spec.partition(":")
    try:
        return getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise LookupError(f"no such function: {spec} ({e})") from None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    command = f"eval-{args.what}" if args.command == "eval" else args.command
    if command == "init":
        corpus = Corpus.init(args.path)
        if args.register_as:
            registry = Registry.load()
            registry.add(args.register_as, corpus.root)
            if args.set_default:
                registry.set_default(args.register_as)
            registry.save()
        print(corpus.root)
        return 0
    if command in ("corpora", "corpus"):
        registry = Registry.load()
        for name in registry.names():
            print(f"{name}\t{registry.corpora[name]}" + "\t(default)" * (name == registry.default))
        return 0
    try:
        corpus = resolve(args.corpus)
        models = {n: named(getattr(args, n, None)) for n in ("probe", "model", "judge", "rerank", "label_model")}
    except LookupError as e:
        print(e, file=sys.stderr)
        return 2
    if command == "semantic-extract" and models["model"] is None:
        print("semantic-extract needs --model", file=sys.stderr)
        return 2
    from .engine import Engine
    from .operators import community as cm
    from .operators import graph as gx
    from .session import get_session

    engine = Engine(get_session(), corpus)
    rows = lambda df: [print(json.dumps(r.asDict(recursive=True), default=str)) for r in df.collect()]
    if command == "ingest":
        if args.triage:
            engine.triage(defer=True)
        rows(engine.ingest(move=not args.keep))
    elif command == "watch":
        from .streaming.ingest import watch

        watch(engine.spark, str(corpus.root), corpus.table("stream_manifest"), corpus.table("stream_progress")).awaitTermination()
    elif command == "triage":
        rows(engine.triage(models["probe"], args.defer))
    elif command == "status":
        rows(engine.status())
    elif command == "embed":
        print(engine.embed(args.force))
    elif command == "semantic-extract":
        rows(engine.extract_concepts(models["model"], args.force))
    elif command == "graph":
        concepts = engine.read("concepts") if engine.has("concepts") and not args.no_concepts else None
        rows(gx.graph_metrics(*engine.build_graph(concepts)))
    elif command == "cluster":
        out = engine.cluster(cm.Rigor[args.ceiling.upper()])
        if models["label_model"]:
            engine.relabel(models["label_model"])
        rows(gx.partition_shape(out.partition))
        print("\n".join(out.notes), file=sys.stderr)
    elif command == "render":
        engine.render()
        print(engine.export_vault())
    elif command == "decay":
        out = engine.decay(args.dry_run)
        print(engine.report_decay(out, args.dry_run), file=sys.stderr)
        rows(out.where("decayed").select("doc_id", "relevance", "status"))
    elif command == "token-report":
        print(json.dumps(engine.token_econ_report(args.group_by or "tool", args.since, args.until, args.tool, args.surface_id), default=str, indent=2))
    elif command == "eval-graph":
        print(engine.evaluate_graph(models["judge"], args.sample))
    elif command == "eval-cluster":
        print(engine.evaluate_clusters())
    elif command == "eval-ragas":
        if not (args.reuse_testset and engine.has("test_set")):
            if models["model"] is None:
                print("a new test set needs --model", file=sys.stderr)
                return 2
            engine.make_test_set(models["model"], args.n_questions, args.per_doc_cap)
        print(engine.evaluate_retrieval(args.k, models["rerank"], models["model"], models["judge"]))
    elif command == "viz":
        out = corpus.root / "exports" / "graph.html"
        out.write_text(engine.draw(args.max_nodes, args.types), encoding="utf-8")
        print(out)
    elif command == "serve":
        for line in sys.stdin:
            if line.strip():
                answer = engine.handle(json.loads(line))
                if answer is not None:
                    print(json.dumps(answer, default=str), flush=True)
    elif command == "publish":
        rows(engine.publish_to(args.to, args.name, args.archive) if args.to else engine.publish())
    return 0


if __name__ == "__main__":
    sys.exit(main())
