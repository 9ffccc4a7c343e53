"""Scalar functions as column expressions; they stay in the JVM."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that decide results: formats of ids, citations and mathematics.
ARXIV_FILE = r"(?i)^(\d{4}\.\d{4,5})(v\d+)?(?:\.full)?(?:\.pdf)?$"
BIORXIV_FILE = r"(?i)^(\d{4}\.\d{2}\.\d{2}\.\d{6,7})(v\d+)?(?:\.full)?(?:\.pdf)?$"
ARXIV_ID = r"(?i)arXiv\s*[:=]?\s*(\d{4}\.\d{4,5}(?:v\d+)?)"
DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b"
YEAR = r"\b((?:19|20)\d{2})\b"
PATENT = r"(?i)\b((?:US|EP|WO)\d{6,10}[A-Z]?\d?)\b"
CITATION = r"\[([A-Z][A-Za-z_'-]+?)\s+(\d{4})[a-z]?\]"
INLINE_MATH = r"(?<!\$)\$(?!\$)([^$\n]{1,200}?)\$(?!\$)"
MATH_OPERATOR = r"[=+\-*/^<>≤≥≈]"
BARE_SCRIPT = r"^(?:\\_|_|\^)\{[^}]+\}$"
WIKILINK = r"\[\[([^\]|#]+)(?:\|[^\]]*)?\]\]"
# Fixed word lists.
QUERY_STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "how", "in", "into", "is", "it", "of", "on",
              "or", "the", "to", "vs", "with", "what", "which", "why", "when", "do", "does")
LABEL_STOP = ("the", "a", "an", "and", "or", "of", "for", "in", "on", "with", "to", "from", "via", "by", "using", "is", "are", "be", "been", "being",
              "we", "our", "their", "this", "that", "these", "those", "approach", "method", "study", "paper", "analysis", "based", "novel", "new",
              "towards", "toward")
# Fixed palette of community colours.
PALETTE = ("#89B4FA", "#FAB387", "#A6E3A1", "#F38BA8", "#94E2D5", "#F9E2AF", "#CBA6F7", "#EBA0AC", "#74C7EC", "#F5C2E7", "#179299", "#89DCEB",
           "#F5E0DC", "#A6ADC8")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, ends stripped."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The stripped group of the first match, or null."""
    found = F.regexp_extract(c, pattern, group)
    return F.when(c.rlike(pattern), strip(found))


# --- file names -------------------------------------------------------------------------

def arxiv_id(filename: Column) -> Column:
    return F.nullif(F.regexp_extract(filename, ARXIV_FILE, 1), F.lit(""))


def biorxiv_doi(filename: Column) -> Column:
    tail = F.nullif(F.regexp_extract(filename, BIORXIV_FILE, 1), F.lit(""))
    return F.concat(F.lit("10.1101/"), tail)


def doi_year(doi: Column) -> Column:
    """The year that a preprint DOI begins with."""
    return F.try_to_number(F.nullif(F.regexp_extract(doi, r"^10\.1101/(\d{4})\.", 1), F.lit("")), F.lit("9999")).cast("int")


def suffix(filename: Column) -> Column:
    """Lower-cased suffix with its dot; empty without one, and for dot files."""
    return F.lower(F.regexp_extract(filename, r"[^.](\.[^.]+)$", 1))


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?<=.)\.[^.]+$", "")


# --- tokens -----------------------------------------------------------------------------

def count_tokens(c: Column) -> Column:
    """Four characters a token: at least 1, and 0 for an empty or null text."""
    n = F.length(c)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).cast("long")


def ratio(served: Column, counterfactual: Column) -> Column:
    return F.when(served > 0, F.round(counterfactual / served, 2)).otherwise(F.lit(1.0))


def lexical_tokens(c: Column) -> Column:
    """[a-z0-9]+ of the lower-cased text, longer than one."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 1)


def query_tokens(c: Column) -> Column:
    """Distinct word tokens longer than one that are no stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*QUERY_STOP)))


def label_words(title: Column) -> Column:
    """Words of a title that may name a community, in order, repeats kept."""
    words = F.transform(F.split(F.lower(strip(title)), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}-]", ""))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*LABEL_STOP) & ~w.rlike(r"^\p{Nd}+$"))


# --- mathematics ------------------------------------------------------------------------

def math_spans(c: Column) -> Column:
    """(real, broken, broken_spans) of the inline mathematics of a text."""
    spans = F.transform(F.regexp_extract_all(c, F.lit(INLINE_MATH), F.lit(1)), strip)

    def real(s):
        letters = F.size(F.array_distinct(F.regexp_extract_all(s, F.lit("([A-Za-z])"), F.lit(1))))
        return (s != "") & ~s.rlike(BARE_SCRIPT) & (s.rlike(MATH_OPERATOR) | (letters >= 2))

    good, bad = F.filter(spans, real), F.filter(spans, lambda s: ~real(s))
    return F.struct(F.size(good).alias("real"), F.size(bad).alias("broken"), bad.alias("broken_spans"))


def math_retry(real: Column, broken: Column, min_broken: int = 5, min_ratio: float = 0.5) -> Column:
    total = real + broken
    return (broken >= min_broken) & (F.when(total == 0, 0.0).otherwise(broken / total) >= min_ratio)


# --- lists, labels, colours -------------------------------------------------------------

def clean_list(items: Column) -> Column:
    """Stripped items without empty ones; of those alike but for case the first stays."""
    stripped = F.filter(F.transform(items, lambda x: F.btrim(x.cast("string"), F.lit(" \t\n\x0b\f\r"))), lambda x: x.isNotNull() & (x != ""))
    # alike items are neighbours once sorted by key and place: n log n, for lists of any length; sort_array compares
    # without the expressions that array_sort evaluates for every two items
    placed = F.sort_array(F.transform(stripped, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = lambda s: F.filter(s, lambda e, n: (n == 0) | (e["k"] != F.get(s, n - 1)["k"]))
    kept = let(placed, first)
    return F.transform(F.sort_array(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def split_authors(c: Column) -> Column:
    parts = F.split(c, r"\s*(?:,|;|\band\b|&)\s*")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def clean_label(c: Column, max_words: int = 6) -> Column:
    """A label without lead-ins and quotes: first line, at most six words."""
    s = strip(c)
    for lead in ("Topical name:", "Name:", "Label:", "Cluster:"):
        s = strip(F.regexp_replace(s, f"(?i)^{lead}", ""))
    s = F.regexp_replace(s, "^[\"'`]+|[\"'`]+$", "")
    s = strip(F.split(s, r"\r\n|\n|\r").getItem(0))
    words = F.split(s, r"\s+")
    return F.when(F.size(words) > max_words, F.array_join(F.slice(words, 1, max_words), " ")).otherwise(s)


def community_colour(cid: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(cid, F.lit(len(PALETTE))) + 1).cast("int"))


def packed_rgb(colour: Column) -> Column:
    """"#RRGGBB" as one number."""
    return F.conv(F.regexp_replace(colour, "^#", ""), 16, 10).cast("int")


def wikilinks(c: Column) -> Column:
    """Targets of wikilinks without a folder."""
    found = F.transform(F.regexp_extract_all(c, F.lit(WIKILINK), F.lit(1)), strip)
    return F.filter(found, lambda x: (x != "") & ~F.contains(x, F.lit("/")))


def iso_date(c: Column) -> Column:
    """The date of an ISO date or timestamp string; null where it is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def utc_tag(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def escape_html(c: Column) -> Column:
    steps = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), steps, c)


# --- URLs -------------------------------------------------------------------------------

BLOCKED_HOSTS = ("localhost", "ip6-localhost", "ip6-loopback", "metadata", "metadata.google.internal")


def _private_v4(parts: Column) -> Column:
    """Loopback, private, link-local, multicast, reserved and unspecified IPv4 addresses."""
    a, b, c = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)))


def _v4_of(host: Column) -> Column:
    """The dotted IPv4 address that a host stands for: written so, mapped into IPv6, or as one
    whole number; null for other hosts."""
    mapped = r"^\[?::ffff:(\d{1,3}(?:\.\d{1,3}){3})\]?$"
    pair = r"^\[?::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\]?$"
    word = lambda g: F.conv(F.regexp_extract(host, pair, g), 16, 10).cast("long")
    number = (F.when(host.rlike(r"^\d{1,10}$"), host.try_cast("long")).when(host.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(host, 3, 8), 16, 10).cast("long"))
              .when(host.rlike(pair), word(1) * 65536 + word(2)))
    dotted = F.concat_ws(".", *[F.shiftrightunsigned(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
    return (F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), host).when(host.rlike(mapped), F.regexp_extract(host, mapped, 1))
            .when(number < 2**32, dotted))


def _private_v6(host: Column) -> Column:
    return host.rlike(r"^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*)\]?$")


def url_gate(url: Column, schemes: tuple[str, ...] = ("http", "https"), allowed_hosts: tuple[str, ...] = (), addresses: Column | None = None) -> Column:
    """(allowed, reason) of a URL. ``addresses`` are those that a resolver found, if any;
    without it host literals alone decide, as nothing here resolves names."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return let(F.struct(url.alias("url"), scheme.alias("scheme"), host.alias("host")), lambda u: _judged(u, schemes, allowed_hosts, addresses))


def _judged(u: Column, schemes: tuple[str, ...], allowed_hosts: tuple[str, ...], addresses: Column | None) -> Column:
    url, scheme, host = u["url"], u["scheme"], u["host"]
    bad = lambda h: let(_v4_of(h), lambda a: F.coalesce(let(F.split(a, r"\."), _private_v4), F.lit(False))) | _private_v6(h)
    blocked = F.when(bad(host), F.regexp_replace(host, r"[\[\]]", ""))
    if addresses is not None:
        blocked = F.coalesce(blocked, F.try_element_at(F.filter(addresses, bad), F.lit(1)))
    reason = (F.when(F.coalesce(url, F.lit("")) == "", F.lit("empty_url")).when(scheme == "", F.lit("missing_scheme"))
              .when(~F.lower(scheme).isin(*schemes), F.concat(F.lit("disallowed_scheme:"), F.lower(scheme))).when(host == "", F.lit("missing_host"))
              .when(host.isin(*BLOCKED_HOSTS), F.concat(F.lit("blocked_host_literal:"), host)))
    if allowed_hosts:
        reason = reason.when(host.isin(*map(str.lower, allowed_hosts)), F.lit(None))
    reason = reason.when(blocked.isNotNull(), F.concat(F.lit("blocked_ip:"), blocked))
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))
