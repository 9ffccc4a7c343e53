"""Document contracts, compiled to column expressions."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass(frozen=True)
class FieldSpec:
    name: str
    required: bool = True
    kind: str = "any"  # any, str, int, number, list


_WHOLE = ("int", "bigint", "smallint", "tinyint", "boolean")
SHARED = (FieldSpec("title", True, "str"), FieldSpec("date", False, "str"), FieldSpec("status", False, "str"), FieldSpec("tags", False, "list"),
          FieldSpec("committee_member", False, "list"), FieldSpec("relevance", False, "number"), FieldSpec("half_life_days", False, "int"),
          FieldSpec("aim_ref", False, "str"), FieldSpec("parents", False, "list"), FieldSpec("supersedes", False, "list"))


@dataclass(frozen=True)
class Profile:
    """A named contract: the shared fields, overridden by its own of the same name."""
    name: str
    own: tuple[FieldSpec, ...] = field(default_factory=tuple)

    @property
    def fields(self) -> tuple[FieldSpec, ...]:
        return tuple(({f.name: f for f in SHARED} | {f.name: f for f in self.own}).values())

    def validate(self, record: dict[str, Column], kinds: dict[str, str]) -> Column:
        """struct(passed, missing, bad, reason) of a row. ``record``: a column for each field
        there is; ``kinds``: its Spark type. Null and empty strings are missing, empty lists
        are not; a boolean passes as a whole number."""
        missing, bad = [], []
        for f in self.fields:
            col, kind = record.get(f.name), kinds.get(f.name, "void")
            absent = F.lit(True) if col is None else col.isNull() | (col == "" if kind == "string" else F.lit(False))
            if f.required:
                missing.append(F.when(absent, F.lit(f.name)))
            fits = {"any": True, "str": kind == "string", "list": kind.startswith("array"), "int": kind in _WHOLE, "number": kind in (*_WHOLE, "float", "double")}[f.kind]
            if col is not None and not fits:
                bad.append(F.when(~absent, F.struct(F.lit(f.name).alias("name"), F.lit(f.kind).alias("kind"))))
        missing_names = F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")
        bad_fields = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<struct<name:string,kind:string>>")
        told = F.transform(bad_fields, lambda b: F.concat(b["name"], F.lit("("), b["kind"], F.lit(")")))
        reason = F.concat_ws(";", F.when(F.size(missing_names) > 0, F.concat(F.lit("missing:"), F.array_join(missing_names, ","))),
                             F.when(F.size(bad_fields) > 0, F.concat(F.lit("bad_type:"), F.array_join(told, ","))))
        return F.struct((reason == "").alias("passed"), missing_names.alias("missing"), bad_fields.alias("bad"), F.nullif(reason, F.lit("")).alias("reason"))


_REQUIRED = lambda *names: tuple(FieldSpec(n) for n in names)
_OPTIONAL = lambda *names: tuple(FieldSpec(n, False) for n in names)
ARXIV = Profile("arxiv_paper", (*_REQUIRED("authors", "abstract", "arxiv_id"), FieldSpec("year", True, "int"), *_OPTIONAL("categories", "doi")))
BIORXIV = Profile("biorxiv_paper", (*_REQUIRED("authors", "abstract", "doi"), FieldSpec("year", True, "int"), *_OPTIONAL("affiliations", "posted_date")))
PATENT = Profile("patent", (*_REQUIRED("patent_number", "inventors", "filing_date", "publication_date", "abstract"), *_OPTIONAL("assignee", "claims", "classifications")))
INTERNAL = Profile("internal_doc", (FieldSpec("author", True, "str"), FieldSpec("date", True, "str"), *_OPTIONAL("doc_type", "project", "confidentiality")))
PROFILES = {p.name: p for p in (ARXIV, BIORXIV, PATENT, INTERNAL)}


def route(filename: Column, fallback: str = INTERNAL.name) -> Column:
    """The profile's name for a file name."""
    return F.when(tx.arxiv_id(filename).isNotNull(), F.lit(ARXIV.name)).when(tx.biorxiv_doi(filename).isNotNull(), F.lit(BIORXIV.name)).otherwise(F.lit(fallback))


def validate(df: DataFrame, profile: Profile, columns: dict[str, str] | None = None) -> Column:
    """The contract over the columns of ``df``; ``columns`` maps fields to other columns."""
    where = {f.name: f.name for f in profile.fields if f.name in df.columns} | (columns or {})
    return profile.validate({f: F.col(c) for f, c in where.items()}, {f: df.schema[c].dataType.simpleString() for f, c in where.items()})


def validate_routed(df: DataFrame, profile_col: str = "profile", profiles: dict[str, Profile] | None = None) -> Column:
    """The contract that each row's profile names; a name without one passes."""
    out = None
    for name, profile in (profiles or PROFILES).items():
        out = F.when(F.col(profile_col) == name, validate(df, profile)) if out is None else out.when(F.col(profile_col) == name, validate(df, profile))
    free = F.struct(F.lit(True).alias("passed"), F.array().cast("array<string>").alias("missing"),
                    F.array().cast("array<struct<name:string,kind:string>>").alias("bad"), F.lit(None).cast("string").alias("reason"))
    return out.otherwise(free)
