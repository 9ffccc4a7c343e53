"""Ingest: files to outcomes, records and tables."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ids
from ..functions import metadata as md
from ..functions import text as tx
from ..sinks import routed
from ..stage import Stage
from . import profiles as px
from .names import unique_names

SUPPORTED = (".pdf", ".html", ".htm", ".txt", ".md")
MIN_CHARS, MIN_CHARS_PER_PAGE, DIGITAL_CHARS_PER_PAGE = 200, 50.0, 3000
EXTRACTOR = "plain-1"
RESERVED = (".kg", "processed", "quarantine", "rejected", "cards", "html", "communities", "graph", "exports", "reports", "defer", "benchmark_test")


def preflight(suffix: Column, size: Column) -> Column:
    """Null for a file that may be read, else why not."""
    return (F.when(~suffix.isin(*SUPPORTED), F.concat(F.lit("unsupported_format:"), F.when(suffix == "", "none").otherwise(suffix)))
            .when(size == 0, F.lit("empty_file")))


def extract_yield(n_chars: Column, n_pages: Column | None = None, min_chars: int = MIN_CHARS, per_page: float = MIN_CHARS_PER_PAGE) -> Column:
    """Null for a text that yields enough, else why not."""
    out = F.when(n_chars < min_chars, F.format_string(f"extract_yield_too_low:%d<{min_chars}", n_chars))
    if n_pages is not None:
        rate = n_chars / n_pages
        out = out.when((n_pages > 0) & (rate < per_page), F.format_string(f"extract_yield_per_page_too_low:%.1f<{per_page:.1f}", rate))
    return out


def strategy(chars_per_page: Column, gpu: Column, quality: Column, skip_slow: Column) -> Column:
    return F.when(chars_per_page >= DIGITAL_CHARS_PER_PAGE, "digital").when(gpu & quality & ~skip_slow, "slow_ocr").when(gpu, "vlm").otherwise("ocr")


# Fixed patterns of the flags.
_NAME = r"[A-Z][a-z][\p{L}\p{N}_'.-]*"
_NAMES = rf"{_NAME}(?:\s+{_NAME})*"
TITLE_LINE = r"(?m)^\s*(?:\d+\s+)?(?:Title:\s*)?[A-Z][^\n]{15,200}$"
AUTHOR_LINES = (rf"\b{_NAMES}\s*[,\d*]*\s*,\s*{_NAMES}\b", rf"\b{_NAMES}\d+", rf"\b{_NAME}\s+{_NAME}\b[^\n]*@")
ABSTRACT_MARKS = (r"\b[Aa]bstract\b|\bSUMMARY\b", r"\n\s*\n([^\n]{250,})")


def triage(text: Column, readable: Column | None = None, skip_lines: int = 5) -> Column:
    """struct(class, reason, has_title, has_authors, has_abstract) of a probe's text."""
    # the text's lines and each mark are named once, so that they are looked for once
    body = F.array_join(F.slice(F.split(text, "\n", -1), skip_lines + 1, 1 << 30), "\n")
    marks = F.transform(F.array(body), lambda b: F.struct(
        b.rlike(TITLE_LINE).alias("title"), (b.rlike(AUTHOR_LINES[0]) | b.rlike(AUTHOR_LINES[1]) | b.rlike(AUTHOR_LINES[2])).alias("authors"),
        (b.rlike(ABSTRACT_MARKS[0]) | b.rlike(ABSTRACT_MARKS[1])).alias("abstract")))

    def told(m: Column) -> Column:
        title, authors, abstract = m["title"], m["authors"], m["abstract"]
        missing = F.concat_ws(", ", F.when(~title, "title"), F.when(~authors, "authors"), F.when(~abstract, "abstract"))
        ok = F.lit(True) if readable is None else readable
        label = F.when(~ok | text.isNull(), "unknown").when(title & authors & abstract, "pass").when(title & authors, "flag").otherwise("defer")
        reason = F.when(label == "unknown", "text unavailable").when(label == "pass", "title, authors and abstract found").when(
            label == "flag", "no abstract mark; the paragraph fallback applies").otherwise(F.concat(F.lit("missing: "), missing))
        return F.struct(label.alias("class"), reason.alias("reason"), F.coalesce(title, F.lit(False)).alias("has_title"),
                        F.coalesce(authors, F.lit(False)).alias("has_authors"), F.coalesce(abstract, F.lit(False)).alias("has_abstract"))

    return F.transform(marks, told)[0]


def doc_ids(rows: DataFrame, name_col: str = "filename", order: str = "path", taken: DataFrame | None = None) -> DataFrame:
    """With doc_id: the stem of the file name, on clashes with the smallest free suffix -1, -2 ... in
    order of paths; none is an id of ``taken`` (doc_id) or another file's stem."""
    return unique_names(rows.withColumn("__stem", tx.stem(F.col(name_col))), "__stem", order, "doc_id", taken).drop("__stem")


@dataclass
class Hooks:
    """Functions DataFrame -> DataFrame at four places, lower priority first."""
    places: tuple[str, ...] = ("pre_extract", "post_extract", "post_metadata", "post_ingest")
    kept: dict[str, list[tuple[int, int, Callable[[DataFrame], DataFrame]]]] = field(default_factory=dict)

    def register(self, place: str, fn: Callable[[DataFrame], DataFrame], priority: int = 100) -> None:
        if place not in self.places:
            raise ValueError(f"no such place: {place}")
        own = self.kept.setdefault(place, [])
        own.append((priority, len(own), fn))

    def hooks(self, place: str) -> list[Callable[[DataFrame], DataFrame]]:
        return [fn for _, _, fn in sorted(self.kept.get(place, []), key=lambda h: h[:2])]

    def run(self, place: str, df: DataFrame) -> DataFrame:
        for fn in self.hooks(place):
            df = df.transform(fn)
        return df

    def clear(self, place: str | None = None) -> None:
        self.kept = {} if place is None else {k: v for k, v in self.kept.items() if k != place}


def decode(content: Column) -> Column:
    """Bytes as UTF-8; what is not is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def ingest(files: DataFrame, known: DataFrame, publisher: DataFrame | None = None, extractor: Callable[[DataFrame], DataFrame] | None = None,
           hooks: Hooks | None = None, ts: Column | None = None, alias_author: bool = False,
           profiles: dict[str, px.Profile] | None = None, taken: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """One row a file with its outcome: status, reason, profile, record, doc_id. Without ``whole`` the outcome
    alone, all that a manifest needs: no text, record or doc_id is kept, and a record is made only as
    far as the contracts look at it.

    ``files``: path, filename, subdir, suffix, size, content_hash, content (or text).
    ``known``: hashes of files ingested before. The order is that of the cascade: known hash,
    preflight, extractor error (``failed``), yield, contract. A file whose content another
    one before it brings in is a duplicate; two bad ones alike are both quarantined. No doc_id
    is one of ``taken`` (doc_id).
    """
    hooks = hooks or Hooks()
    before = known.select(F.col("hash").alias("content_hash"), F.lit(True).alias("known")).distinct()
    base = files.join(before, "content_hash", "left")
    base = base.withColumn("flight", preflight(F.col("suffix"), F.col("size")))
    base = hooks.run("pre_extract", base)
    if extractor is not None:
        base = extractor(base)
    elif "text" not in base.columns:
        base = base.withColumn("text", F.when(F.col("flight").isNull() & F.col("known").isNull(), decode(F.col("content"))))
    base = hooks.run("post_extract", base)
    pages = F.col("n_pages") if "n_pages" in base.columns else None
    error = F.col("error") if "error" in base.columns else F.lit(None).cast("string")
    base = base.withColumns({"yield": extract_yield(F.coalesce(F.length("text"), F.lit(0)), pages), "profile": px.route(F.col("filename")),
                             "body": md.extract(F.coalesce("text", F.lit("")))})
    if publisher is not None:
        base = base.join(publisher.select("filename", F.col("record").alias("pub")), "filename", "left")
    else:
        base = base.withColumn("pub", F.lit(None).cast("struct<title:string,authors:array<string>,abstract:string,year:int,doi:string,arxiv_id:string,source:string>"))
    named = F.coalesce(F.col("pub.arxiv_id"), tx.arxiv_id(F.col("filename")))
    base = base.withColumn("record", md.merge(F.col("body"), F.col("pub"))).withColumn("record", F.col("record").withField("arxiv_id", F.coalesce(named, F.col("record.arxiv_id"))))
    base = hooks.run("post_metadata", base)
    flat = base.select("*", *[F.col(f"record.{c}").alias(c) for c in ("title", "authors", "year", "doi", "arxiv_id", "patent_number", "abstract")])
    if alias_author:
        flat = flat.withColumn("author", F.try_element_at("authors", F.lit(1)))
    flat = flat.withColumn("contract", px.validate_routed(flat, profiles=profiles))
    fine = error.isNull() & F.col("known").isNull() & F.col("flight").isNull() & F.col("yield").isNull() & F.col("contract.passed")
    # Copies may be many: their first path comes from partial minima and meets the rows in a
    # join that splits where one hash is hot. The rows, texts read and records made, are
    # written once in between.
    flat = flat.withColumn("fine", F.coalesce(fine, F.lit(False)))
    if not whole:
        flat = flat.select(*(c for c in ("path", "filename", "subdir", "suffix", "size", "content_hash", "known", "flight", "yield", "error", "profile", "contract", "fine") if c in flat.columns))
    flat = Stage(files.sparkSession, "ingest").write(flat, "read")
    fine = F.col("fine")
    error = F.col("error") if "error" in flat.columns else F.lit(None).cast("string")
    first = flat.where(fine).groupBy(F.col("content_hash").alias("h")).agg(F.min("path").alias("first_path"))
    flat = flat.join(first, F.col("content_hash") == F.col("h"), "left").drop("h")
    again = F.col("first_path") < F.col("path")
    status = (F.when(F.col("known").isNotNull() | again, "duplicate").when(F.col("flight").isNotNull(), "quarantined").when(error.isNotNull(), "failed")
              .when(F.col("yield").isNotNull() | ~F.col("contract.passed"), "quarantined").otherwise("ingested"))
    reason = (F.when(F.col("known").isNotNull() | again, F.concat(F.lit("existing_hash:"), F.substring("content_hash", 1, 12))).when(F.col("flight").isNotNull(), F.col("flight"))
              .when(error.isNotNull(), F.concat(F.lit("extractor_error:"), error)).when(F.col("yield").isNotNull(), F.col("yield")).otherwise(F.col("contract.reason")))
    out = flat.withColumns({"status": status, "reason": reason, "ts": ts if ts is not None else F.current_timestamp(), "extractor_version": F.lit(EXTRACTOR)})
    if not whole:
        return hooks.run("post_ingest", out.drop("known", "first_path", "contract", "flight", "yield", "fine"))
    named = doc_ids(out.where("status = 'ingested'").select("path", "filename"), taken=taken).select("path", "doc_id")
    out = out.join(named, "path", "left")
    return hooks.run("post_ingest", out.drop("known", "body", "pub", "first_path", "contract", "flight", "yield", "fine"))


def manifest_rows(outcomes: DataFrame) -> DataFrame:
    where = F.col("target") if "target" in outcomes.columns else routed(outcomes)
    return outcomes.select(F.col("content_hash").alias("hash"), F.col("filename").alias("source_filename"), where.alias("destination"), "status", "reason", "extractor_version", "ts")


def quarantine_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'quarantined'").select(
        F.col("content_hash").alias("hash"), "filename", F.col("subdir").alias("original_subdir"), "reason", ids.reason_slug(F.col("reason")).alias("reason_slug"),
        F.to_json(F.struct("size", "suffix")).alias("details"), "ts")


def document_rows(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'ingested'").select(
        "doc_id", "filename", F.col("content_hash").alias("hash"), "profile", "text", "title", "authors", "year", "doi", "arxiv_id", "patent_number", "abstract",
        F.array().cast("array<string>").alias("topics"), F.col("record.source").alias("metadata_source"))


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def known_hashes(manifest: DataFrame) -> DataFrame:
    return manifest.where("status = 'ingested'").select("hash").distinct()


def math_retry_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    m = docs.select(id_col, tx.math_spans(F.col(text_col)).alias("m"))
    return m.where(tx.math_retry(F.col("m.real"), F.col("m.broken"))).select(id_col, "m.real", "m.broken", F.slice("m.broken_spans", 1, 50).alias("samples"))


# --- the cache of extracted texts -----------------------------------------------------------

CACHE_KEY = ["hash", "extractor_version", "profile"]


def cache_put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    return cache.join(rows.select(*CACHE_KEY), CACHE_KEY, "left_anti").unionByName(rows)


def cache_get(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select(*CACHE_KEY).distinct().join(cache, CACHE_KEY)


def cache_invalidate(cache: DataFrame, extractor_version: str | None = None, key: tuple[str, str, str] | None = None) -> DataFrame:
    if extractor_version is not None:
        cache = cache.where(F.col("extractor_version") != extractor_version)
    if key is not None:
        cache = cache.where(~((F.col("hash") == key[0]) & (F.col("extractor_version") == key[1]) & (F.col("profile") == key[2])))
    return cache
