"""Node ids and slugs. Every id that the engine makes or takes apart goes through here."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOC = "doc::"


def _trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def doc_node(doc_id: Column) -> Column:
    return F.concat(F.lit(DOC), doc_id.cast("string"))


def bare_id(node_id: Column) -> Column:
    """The id without ``doc::``; other ids as they are."""
    return F.regexp_replace(node_id, "^doc::", "")


def slug(text: Column) -> Column:
    """Graph slug: lower case, runs of anything but a-z and 0-9 to "_", at most 100."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_trim_ws(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.substring(s, 1, 100), "^$", "unknown")  # named once, so that the text is gone over once


def concept_slug(text: Column) -> Column:
    """As slug, uncut; null where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_trim_ws(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.nullif(s, F.lit(""))


def card_slug(text: Column) -> Column:
    """Card file slug: word characters, blanks and dashes only, blanks to "_", at most 80."""
    s = F.regexp_replace(F.lower(_trim_ws(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "_"), "^_+|_+$", ""), 1, 80)


def vault_slug(text: Column, max_len: int = 64) -> Column:
    """Vault file slug: dashes, at most ``max_len``, never empty."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, max_len), "-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def reason_slug(text: Column) -> Column:
    """Quarantine slug: runs outside A-Za-z0-9._- to "_"."""
    s = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    # named once, so that the text is gone over once
    return F.transform(F.array(s), lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.lit("unknown")).otherwise(x))[0]


def author_key(name: Column) -> Column:
    return F.concat(F.lit("author::"), slug(name))


def topic_key(name: Column) -> Column:
    return F.concat(F.lit("topic::"), slug(name))


def citation_key(surname: Column, year: Column) -> Column:
    return F.concat(F.lit("citation::"), slug(surname), F.lit("_"), year)


def doi_key(doi: Column) -> Column:
    return F.concat(F.lit("citation::doi_"), slug(doi))


def concept_key(kind: str, name: Column) -> Column:
    """``topic``, ``method`` or ``named_entity``; null for a name without a slug."""
    return F.concat(F.lit(f"{kind}::"), concept_slug(name))


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("::chunk_"), ordinal.cast("string"))
