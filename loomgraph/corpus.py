"""A corpus on disk: its folders, registry and configuration (driver side)."""
from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .operators.ingest import RESERVED

MARKER = ".kg"
FOLDERS = (MARKER, f"{MARKER}/tables", f"{MARKER}/audit", "inbox", "processed", "quarantine", "rejected", "cards", "html", "notes", "graph", "exports", "reports")


class Corpus:
    """Places below a root. Tables are Parquet folders under ``.kg/tables``."""

    def __init__(self, root: str | Path) -> None:
        self.root = Path(root).resolve()

    @classmethod
    def init(cls, root: str | Path) -> Corpus:
        """Make the folders; those that exist stay as they are."""
        made = cls(root)
        for name in FOLDERS:
            (made.root / name).mkdir(parents=True, exist_ok=True)
        return made

    @classmethod
    def discover(cls, start: str | Path | None = None) -> Corpus | None:
        """The corpus that a folder lies in, looking up to the home folder."""
        at, home = Path(start or os.getcwd()).resolve(), Path.home().resolve()
        for folder in (at, *at.parents):
            if (folder / MARKER).is_dir():
                return cls(folder)
            if folder == home:
                break
        return None

    def table(self, name: str) -> str:
        return str(self.root / MARKER / "tables" / name)

    @property
    def config(self) -> Config:
        return Config.load(self.root / MARKER / "config.yaml")

    def source_files(self) -> list[Path]:
        """Files that a scan reads, for small corpora without a session."""
        found = []
        for p in sorted(self.root.rglob("*")):
            parts = p.relative_to(self.root).parts
            if p.is_file() and parts[0] not in RESERVED and not any(x.startswith(".") for x in parts):
                found.append(p)
        return found


def _write_whole(path: Path, text: str) -> None:
    """Replace a file at once: a reader sees the old or the new."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=path.parent, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


@dataclass
class Registry:
    """Names of corpora and a default, in one JSON file."""
    path: Path = field(default_factory=lambda: Path.home() / ".config" / "loomgraph" / "registry.json")
    corpora: dict[str, str] = field(default_factory=dict)
    default: str | None = None

    @classmethod
    def load(cls, path: str | Path | None = None) -> Registry:
        out = cls(Path(path)) if path else cls()
        if out.path.exists():
            kept = json.loads(out.path.read_text(encoding="utf-8"))
            out.corpora, out.default = dict(kept.get("corpora", {})), kept.get("default")
        return out

    def save(self) -> None:
        _write_whole(self.path, json.dumps({"corpora": self.corpora, "default": self.default}, indent=2, sort_keys=True))

    def add(self, name: str, root: str | Path) -> None:
        self.corpora[name] = str(Path(root).resolve())

    def remove(self, name: str) -> bool:
        if self.default == name:
            self.default = None
        return self.corpora.pop(name, None) is not None

    def set_default(self, name: str) -> None:
        if name not in self.corpora:
            raise KeyError(name)
        self.default = name

    def resolve(self, name: str | None = None) -> Path | None:
        found = self.corpora.get(name if name is not None else self.default or "")
        return Path(found) if found else None

    def names(self) -> list[str]:
        return sorted(self.corpora)


def resolve(arg: str | None = None, registry: Registry | None = None) -> Corpus:
    """A path, else a registered name, else the corpus around the current folder, else the
    default."""
    registry = registry or Registry.load()
    if arg:
        if (Path(arg) / MARKER).is_dir():
            return Corpus(arg)
        if (named := registry.resolve(arg)) is not None:
            return Corpus(named)
        raise LookupError(f"no corpus at or named {arg}")
    found = Corpus.discover()
    if found is None and (default := registry.resolve()) is not None:
        found = Corpus(default)
    if found is None:
        raise LookupError("no corpus here, and no default is registered")
    return found


def _cast(value: Any, kind: type) -> Any:
    """A value of the kind, or None for what is none."""
    if value is None or isinstance(value, bool):
        return None
    try:
        return kind(value)
    except (TypeError, ValueError):
        return None


@dataclass(frozen=True)
class Config:
    """Typed settings; odd values fall back to the defaults. ``raw`` is all that was there."""
    max_chars: int = 3000
    overlap_chars: int = 400
    batch_size: int = 32
    embedding_model: str | None = None
    extract_model: str | None = None
    semantic_edge_threshold: float = 0.55
    raw: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Never raises: what cannot be read gives the defaults."""
        try:
            import yaml

            raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except Exception:
            raw = None
        raw = raw if isinstance(raw, dict) else {}
        section = lambda n: raw.get(n) if isinstance(raw.get(n), dict) else {}
        embedding, semantic = section("embedding"), section("semantic_extract")
        values = {"max_chars": _cast(embedding.get("max_chars"), int), "overlap_chars": _cast(embedding.get("overlap_chars"), int), "batch_size": _cast(embedding.get("batch_size"), int),
                  "embedding_model": _cast(embedding.get("model"), str), "extract_model": _cast(semantic.get("model"), str),
                  "semantic_edge_threshold": _cast(semantic.get("semantic_edge_threshold"), float)}
        return cls(raw=raw, **{k: v for k, v in values.items() if v is not None})
