"""Publishing: the canonical partition, communities on nodes, inventories, manifests."""
from __future__ import annotations

import datetime as dt
import hashlib
import json
import tarfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PALETTE

#: Which partition is the canonical one, best first.
ORDER = ("sbm", "louvain", "leiden", "embeddings")


#: Communities whose colour a published vault states.
COLOURED = 200


def canonical(tags: list[str]) -> str | None:
    """The best of the back ends that left a partition."""
    return next((t for t in ORDER if t in tags), tags[0] if tags else None)


def merge_communities(nodes: DataFrame, partition: DataFrame, communities: DataFrame) -> DataFrame:
    """Nodes with community_id, path and label; nodes without one keep nulls."""
    p = partition.select("node_id", "community_id", "path").join(communities.select("community_id", "label"), "community_id", "left")
    return nodes.drop("community_id", "path", "label").join(p, "node_id", "left")


def inventory(**tables: DataFrame) -> DataFrame:
    """(table, n_rows, columns) of the tables given."""
    spark = next(iter(tables.values())).sparkSession
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(",".join(df.columns)).alias("columns")) for name, df in tables.items()]
    out = parts[0] if parts else spark.createDataFrame([], "table string, n_rows long, columns string")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def capabilities(**tables: DataFrame) -> DataFrame:
    """One row ``json``: the inventory as an object."""
    rows = inventory(**tables)
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n_rows"))))).alias("json"))


def manifest(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, bytes, sha256) of what is published; what cannot be read has a null digest."""
    return files.select(path_col, F.octet_length(content_col).cast("long").alias("bytes"), F.sha2(F.col(content_col).cast("binary"), 256).alias("sha256"))


def graph_payload(nodes: DataFrame, edges: DataFrame, max_nodes: int = 3000, types: list[str] | None = None, node_col: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for a drawing: of the types asked for, the most linked ones."""
    from .graph import degrees

    kept = nodes if types is None else nodes.where(F.col("entity_type").isin(types) | F.col("node_type").isin(types))
    best = degrees(kept, edges).orderBy(F.desc("degree"), node_col).limit(max_nodes)
    shown = kept.join(best, node_col)
    ids = best.select(node_col)
    inside = edges.join(ids.withColumnRenamed(node_col, "src"), "src", "left_semi").join(ids.withColumnRenamed(node_col, "dst"), "dst", "left_semi")
    return shown, inside


def normalised(layout: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Coordinates scaled to [-1, 1]; a flat axis becomes 0."""
    ends = layout.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), 2 * (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) - 1).otherwise(0.0)
    return layout.crossJoin(F.broadcast(ends)).withColumns({x: scaled(x), y: scaled(y)}).select(*layout.columns)


def payload_json(nodes: DataFrame, *cols: str) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})


# --- pages of a published corpus ------------------------------------------------------------

def pages(name: str, figures: dict[str, int], communities: Sequence[int], now: dt.datetime) -> dict[str, str]:
    """Path and text of the pages and settings that go with a published corpus: what it holds,
    how to read it by hand or by a tool, and a vault's settings with the communities' colours."""
    rows = "\n".join(f"| {table} | {n} |" for table, n in sorted(figures.items()))
    listing = f"| table | rows |\n|-|-|\n{rows}\n"
    settings = lambda value: json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    css = "\n".join(f".community-{c} {{ color: {PALETTE[c % len(PALETTE)]}; }}" for c in communities)
    return {
        "README.md": f"# {name}\n\nA collection of documents as a graph, published {now:%Y-%m-%d}.\n\n* `cards/`: a page a document\n* `communities/`: a page a community\n* `tables/`: Parquet tables\n"
                     f"* `reports/`: reports on graph, communities and retrieval\n* `manifest/`: path, size and SHA-256 of each file\n\n{listing}",
        "AGENTS.md": f"# Reading {name} by a tool\n\n1. `capabilities.json` tells which tables there are.\n2. `tables/published_nodes` has the nodes with their community; `tables/edges` the links between them.\n"
                     "3. A node `doc::x` is the document of `cards/x.md`; the text of its parts is in `tables/chunks`, their vectors in `tables/chunk_vectors`.\n"
                     "4. Begin a broad question with `communities/`, a narrow one with a search over the chunks, and cite cards.\n",
        "OVERVIEW.md": f"# Overview of {name}\n\nBuilt {now:%Y-%m-%d %H:%M}.\n\n{listing}",
        "capabilities.json": settings({"name": name, "published": now.isoformat(), "tables": figures}),
        "tools.json": settings({"servers": {name: {"command": "python", "args": ["-m", "loomgraph.cli", "serve", "--corpus", "."]}}}),
        ".obsidian/app.json": settings({"alwaysUpdateLinks": True, "showLineNumber": False, "userIgnoreFilters": ["tables/", "manifest/"]}),
        ".obsidian/appearance.json": settings({"enabledCssSnippets": ["communities"]}),
        ".obsidian/core-plugins.json": settings({"graph": True, "backlink": True, "global-search": True, "outline": True, "tag-pane": True}),
        ".obsidian/community-plugins.json": settings(["dataview"]),
        ".obsidian/snippets/communities.css": f"{css}\n",
    }


def archived(folder: str, target: str) -> tuple[str, int, str]:
    """(path, bytes, sha256) of one tar of a table's files, made on the driver a file at a time:
    for corpora on a disk that the driver reaches."""
    root = Path(folder.removeprefix("file://"))
    place = Path(target.removeprefix("file://"))
    with tarfile.open(place, "w") as tar:
        for p in sorted(root.rglob("*.parquet")):
            tar.add(p, arcname=f"{root.name}/{p.relative_to(root)}")
    digest = hashlib.sha256()
    with place.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return place.name, place.stat().st_size, digest.hexdigest()
