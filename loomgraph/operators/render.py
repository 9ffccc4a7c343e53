"""Cards, community pages, vault files: markdown as columns, files by partition."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

FIELDS = ("title", "id", "type", "date", "status", "tags", "doc_id", "authors", "year", "doi", "arxiv_id", "topics", "community_id", "community_path", "community_label",
          "relevance", "half_life_days", "ingested", "last_touched", "n_chunks")


def _yaml(value: Column, kind: str) -> Column:
    """A value as YAML, null for what is left out."""
    if kind.startswith("array"):
        items = F.transform(value, lambda x: F.concat(F.lit("\n- "), x.cast("string")))
        return F.when(F.size(value) > 0, F.array_join(items, "")).when(value.isNotNull(), F.lit(" []"))
    plain = F.nullif(value.cast("string"), F.lit(""))
    if kind == "string":
        odd = plain.rlike(r"""^[\s'"&*!|>%@`\[\]{},#?-]|: |:$| #|\n|\s$|^(?:[0-9.eE+-]+|true|false|null|yes|no|on|off|~)$""")
        plain = F.when(odd, F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(plain)
    return F.concat(F.lit(" "), plain)


def front_matter(cards: DataFrame) -> Column:
    """The front matter in the fixed order of fields; null and empty ones are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in cards.schema}
    lines = [F.concat(F.lit(f"{f}:"), _yaml(F.col(f), kinds[f])) for f in FIELDS if f in kinds]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def card_markdown(cards: DataFrame, front: Column | None = None) -> Column:
    """The card of each row; sections whose columns are absent or empty are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in cards.schema}
    has = lambda c: c in kinds
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if has(c) else F.lit(None).cast("string")
    title = F.coalesce(text("title"), text("doc_id"))
    authors = F.when(F.size("authors") > 0, F.array_join("authors", ", ")) if has("authors") and kinds["authors"].startswith("array") else text("authors")
    named = lambda label, v: F.concat(F.lit(f"**{label}:** "), v)
    head = F.concat_ws("\n", named("Authors", authors), named("Year", text("year")), named("DOI", text("doi")), named("arXiv", text("arxiv_id")))

    def section(name: str, body: Column) -> Column:
        return F.concat(F.lit(f"## {name}\n\n"), body)

    def bullets(c: str, each) -> Column:
        return F.when(F.size(c) > 0, F.array_join(F.transform(F.col(c), lambda x: F.concat(F.lit("- "), each(x))), "\n")) if has(c) else F.lit(None).cast("string")

    concept = lambda x: F.concat(F.lit("[["), F.initcap(F.replace(x, F.lit("_"), F.lit(" "))), F.lit("]]"))
    same = lambda x: x
    parts = F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.nullif(head, F.lit("")), section("Abstract", tx.strip(text("abstract"))), section("Key Claims", bullets("key_claims", same)),
                        section("Methods", bullets("methods", same)), section("Topics", bullets("topics", concept)), section("Relevance", tx.strip(text("relevance_note"))),
                        section("Excerpt", tx.strip(text("excerpt"))))
    return F.concat(F.lit("---\n"), front if front is not None else front_matter(cards), F.lit("\n---\n\n"), parts, F.lit("\n"))


def split_card(markdown: Column) -> Column:
    """struct(front, body); without a fence the whole is body."""
    fenced = r"(?s)\A---\n(.*?)\n---\n?(.*)\z"
    return F.when(markdown.rlike(fenced), F.struct(F.regexp_extract(markdown, fenced, 1).alias("front"), F.regexp_extract(markdown, fenced, 2).alias("body"))).otherwise(
        F.struct(F.lit("").alias("front"), markdown.alias("body")))


def front_value(front: Column, field: str) -> Column:
    """One scalar of a front matter."""
    value = tx.strip(F.regexp_extract(front, rf"(?m)^{field}:[ \t]*([^\n]*)$", 1))
    bare = F.regexp_replace(value, r"""^(['"])(.*)\1$""", "$2")
    return F.nullif(bare, F.lit(""))


def front_list(front: Column, field: str) -> Column:
    """One list of a front matter, in either of its two forms."""
    block = F.regexp_extract(front, rf"(?m)^{field}:[ \t]*\n((?:[ \t]*- [^\n]*\n?)+)", 1)
    inline = F.regexp_extract(front, rf"(?m)^{field}:[ \t]*\[([^\]\n]*)\]", 1)
    items = F.when(block != "", F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\s*- ", ""))).otherwise(F.split(inline, ","))
    return F.filter(F.transform(items, tx.strip), lambda x: x != "")


def with_fields(cards: DataFrame, updates: dict[str, Column]) -> DataFrame:
    """Cards with fields replaced; nulls are written through."""
    return cards.withColumns(updates)


def community_page(communities: DataFrame, partition: DataFrame, docs: DataFrame) -> DataFrame:
    """(community_id, slug, markdown): core papers, then members, as wikilinks with title and
    year."""
    from ..ids import vault_slug

    d = docs.select(F.col("doc_id").cast("string").alias("d"), "title", "year")
    bare = lambda c: F.regexp_replace(c, "^doc::", "")
    link = F.concat(F.lit("- [["), F.col("d"), F.lit("|"), F.coalesce("title", "d"), F.when(F.col("year").isNotNull(), F.format_string(" (%d)", "year")).otherwise(""), F.lit("]]"))

    def lines(rows: DataFrame, name: str) -> DataFrame:
        linked = rows.join(d, "d", "left").select("community_id", "o", link.alias("l"))
        return linked.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n").alias(name))

    members = partition.select("community_id", F.col("node_id").alias("o"), bare(F.col("node_id")).alias("d"))
    core = communities.select("community_id", F.posexplode("core_nodes").alias("o", "n")).select("community_id", "o", bare(F.col("n")).alias("d"))
    joined = communities.join(lines(members, "ml"), "community_id").join(lines(core, "cl"), "community_id", "left")
    head = F.format_string('---\ntitle: "%s"\nid: community_%d\ntype: community\ncommunity_id: %d\nn_members: %d\ntags: [community, %s]\nbackend: %s\n---\n\n# %s\n',
                           "label", "community_id", "community_id", "n_members", F.replace("backend", F.lit("_"), F.lit("-")), "backend", "label")
    body = F.concat(head, F.coalesce(F.concat(F.lit("\n## Core papers\n\n"), F.col("cl"), F.lit("\n")), F.lit("")), F.lit("\n## Members\n\n"), F.col("ml"), F.lit("\n"))
    return joined.select("community_id", vault_slug(F.col("label")).alias("slug"), body.alias("markdown"))


def recent(cards: DataFrame, date_col: str = "ingested", id_col: str = "doc_id", n: int = 25) -> DataFrame:
    return cards.orderBy(F.desc(date_col), id_col).limit(n)


def top_relevance(cards: DataFrame, n: int = 25) -> DataFrame:
    return cards.orderBy(F.desc("relevance"), "doc_id").limit(n)


def by_community(cards: DataFrame) -> DataFrame:
    return cards.where("community_id is not null").orderBy("community_id", "year")


def largest_communities(communities: DataFrame) -> DataFrame:
    return communities.select("community_id", "label", "n_members").orderBy(F.desc("n_members"), "community_id")


def pending(cards: DataFrame) -> DataFrame:
    return cards.where("status = 'exploratory'").orderBy("ingested", "doc_id")


def tag_list(cards: DataFrame) -> DataFrame:
    return cards.select(F.explode("tags").alias("tag"), "doc_id").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy("tag")


def colour_groups(communities: DataFrame) -> DataFrame:
    """One row ``json``: a query and a colour for each community, for a vault's graph view."""
    group = F.struct(F.concat(F.lit("[\"community_id\":"), F.col("community_id").cast("string"), F.lit("]")).alias("query"),
                     F.struct(F.lit(1).alias("a"), tx.packed_rgb(tx.community_colour(F.col("community_id"))).alias("rgb")).alias("color"))
    return communities.agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("community_id", group.alias("g")))), lambda x: x["g"]).alias("colorGroups"))).alias("json"))


def html_page(title: Column, rows: list[tuple[str, Column]], body: Column) -> Column:
    """A page with an escaped table of metadata and the escaped text."""
    cells = [F.concat(F.lit(f"<tr><th>{k}</th><td>"), tx.escape_html(v.cast("string")), F.lit("</td></tr>")) for k, v in rows]
    return F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), tx.escape_html(title), F.lit("</title></head><body><h1>"), tx.escape_html(title), F.lit("</h1><table>"),
                    F.concat_ws("", *cells), F.lit("</table><pre>"), tx.escape_html(F.coalesce(body, F.lit(""))), F.lit("</pre></body></html>"))
