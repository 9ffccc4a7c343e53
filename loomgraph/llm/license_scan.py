"""License scan: ordered signature rules, gated by keywords, overlaps suppressed.

Everything is one projection of built-in expressions: no shuffle, no join, no Python.
For each text, (1) ``contains`` on a few gate words decides whether any rule can match;
(2) the rules whose own keyword occurs are tried; (3) their regular expressions, constants of the plan, give
(start, end) intervals; (4) a detection inside the interval of a better one (higher
priority, then longer, then earlier rule) is suppressed. The base phrases are counted
as words in a normal form where every word has a space on either side of its own, so
consecutive places never share a separator.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What no word has: ASCII but for digits and letters.
MARKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

#: Hits whose places are summed in a row, and detections of a slice of the sweep.
SUMMED, SWEPT = 256, 32

#: (label, phrase) of the base.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: label: (spdx ids, name regex, url regex or None). Lower case; "_" stands for white space.
_LICENSES = {
    "mit": ("mit", r"(?:the_)?(?:mit|expat|x11)(?:/x11)?_licen[sc]e", r"opensource\.org/licen[sc]es/mit"),
    "mit-0": ("mit-0", r"mit_no_attribution_licen[sc]e", None),
    "apache-2": ("apache-2\\.0", r"apache_(?:software_)?licen[sc]e,?_(?:version_|v\.?_?)?2(?:\.0)?", r"apache\.org/licen[sc]es/licen[sc]e-2\.0"),
    "apache-1": ("apache-1\\.[01]", r"apache_(?:software_)?licen[sc]e,?_(?:version_|v\.?_?)?1\.[01]", None),
    "bsd-2": ("bsd-2-clause", r"(?:simplified_bsd|bsd_2[- ]clause|freebsd)_licen[sc]e", r"opensource\.org/licen[sc]es/bsd-2-clause"),
    "bsd-3": ("bsd-3-clause", r"(?:new_bsd|modified_bsd|revised_bsd|bsd_3[- ]clause|3[- ]clause_bsd)_licen[sc]e", r"opensource\.org/licen[sc]es/bsd-3-clause"),
    "bsd": ("bsd", r"bsd(?:[- ]style)?_licen[sc]e", None),
    "gpl-2": ("gpl-2\\.0(?:-only|-or-later|\\+)?", r"(?:gnu_)?(?:general_public_licen[sc]e|gpl),?_?(?:version_|v\.?_?)2(?:\.0)?", r"gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?gpl-2\.0"),
    "gpl-3": ("gpl-3\\.0(?:-only|-or-later|\\+)?", r"(?:gnu_)?(?:general_public_licen[sc]e|gpl),?_?(?:version_|v\.?_?)3(?:\.0)?", r"gnu\.org/licen[sc]es/gpl-3\.0"),
    "gpl": ("gpl", r"gnu_(?:general_public_licen[sc]e|gpl)", r"gnu\.org/licen[sc]es/gpl\.(?:html|txt)"),
    "lgpl-2.1": ("lgpl-2\\.1(?:-only|-or-later|\\+)?", r"(?:gnu_)?(?:lesser|library)_(?:general_public_licen[sc]e|gpl),?_?(?:version_|v\.?_?)2(?:\.[01])?", r"gnu\.org/licen[sc]es/(?:old-licen[sc]es/)?lgpl-2\.1"),
    "lgpl-3": ("lgpl-3\\.0(?:-only|-or-later|\\+)?", r"(?:gnu_)?lesser_(?:general_public_licen[sc]e|gpl),?_?(?:version_|v\.?_?)3(?:\.0)?", r"gnu\.org/licen[sc]es/lgpl-3\.0"),
    "lgpl": ("lgpl", r"(?:gnu_)?lesser_general_public_licen[sc]e", None),
    "agpl-3": ("agpl-3\\.0(?:-only|-or-later|\\+)?", r"(?:gnu_)?affero_general_public_licen[sc]e(?:,?_?(?:version_|v\.?_?)3(?:\.0)?)?", r"gnu\.org/licen[sc]es/agpl-3\.0"),
    "fdl": ("gfdl-1\\.[123](?:-only|-or-later)?", r"(?:gnu_)?free_documentation_licen[sc]e", r"gnu\.org/licen[sc]es/fdl"),
    "mpl-2": ("mpl-2\\.0", r"mozilla_public_licen[sc]e,?_(?:version_|v\.?_?)2(?:\.0)?", r"mozilla\.org/mpl/2\.0"),
    "mpl-1.1": ("mpl-1\\.1", r"mozilla_public_licen[sc]e,?_(?:version_|v\.?_?)1\.1", r"mozilla\.org/mpl/mpl-1\.1"),
    "mpl": ("mpl", r"mozilla_public_licen[sc]e", None),
    "epl-1": ("epl-1\\.0", r"eclipse_public_licen[sc]e,?_(?:-_)?(?:version_|v\.?_?)1(?:\.0)?", None),
    "epl-2": ("epl-2\\.0", r"eclipse_public_licen[sc]e,?_(?:-_)?(?:version_|v\.?_?)2(?:\.0)?", r"eclipse\.org/legal/epl-(?:2\.0|v20)"),
    "cddl": ("cddl-1\\.[01]", r"common_development_and_distribution_licen[sc]e", None),
    "cpl": ("cpl-1\\.0", r"common_public_licen[sc]e", None),
    "isc": ("isc", r"isc_licen[sc]e", r"opensource\.org/licen[sc]es/isc"),
    "zlib": ("zlib", r"zlib(?:/libpng)?_licen[sc]e", None),
    "bsl-1": ("bsl-1\\.0", r"boost_software_licen[sc]e", r"boost\.org/licen[sc]e_1_0"),
    "unlicense": ("unlicense", r"(?:the_)?unlicen[sc]e_licen[sc]e", r"unlicense\.org"),
    "wtfpl": ("wtfpl", r"do_what_the_fuck_you_want_to_public_licen[sc]e", None),
    "artistic-2": ("artistic-2\\.0", r"artistic_licen[sc]e,?_(?:version_|v\.?_?)?2(?:\.0)?", None),
    "artistic": ("artistic-1\\.0", r"artistic_licen[sc]e", None),
    "python": ("psf-2\\.0|python-2\\.0", r"python_software_foundation_licen[sc]e", None),
    "php": ("php-3\\.01?", r"php_licen[sc]e", None),
    "ofl-1.1": ("ofl-1\\.1", r"(?:sil_)?open_font_licen[sc]e", r"scripts\.sil\.org/ofl"),
    "eupl": ("eupl-1\\.[12]", r"european_union_public_licen[sc]e", None),
    "odbl": ("odbl-1\\.0", r"open_(?:data_commons_open_)?database_licen[sc]e", r"opendatacommons\.org/licen[sc]es/odbl"),
    "postgresql": ("postgresql", r"postgresql_licen[sc]e", None),
    "cc0": ("cc0-1\\.0", r"(?:creative_commons_zero|cc0)(?:_licen[sc]e|_1\.0)?", r"creativecommons\.org/publicdomain/zero"),
    "cc-by-nc-nd": ("cc-by-nc-nd-[1234]\\.\\d", r"(?:cc|creative_commons)[- ]+(?:by|attribution)[- ]+(?:nc|noncommercial|non-commercial)[- ]+(?:nd|noderivatives|no_?derivs)", r"creativecommons\.org/licen[sc]es/by-nc-nd"),
    "cc-by-nc-sa": ("cc-by-nc-sa-[1234]\\.\\d", r"(?:cc|creative_commons)[- ]+(?:by|attribution)[- ]+(?:nc|noncommercial|non-commercial)[- ]+(?:sa|sharealike|share_alike)", r"creativecommons\.org/licen[sc]es/by-nc-sa"),
    "cc-by-nc": ("cc-by-nc-[1234]\\.\\d", r"(?:cc|creative_commons)[- ]+(?:by|attribution)[- ]+(?:nc|noncommercial|non-commercial)", r"creativecommons\.org/licen[sc]es/by-nc/"),
    "cc-by-nd": ("cc-by-nd-[1234]\\.\\d", r"(?:cc|creative_commons)[- ]+(?:by|attribution)[- ]+(?:nd|noderivatives|no_?derivs)", r"creativecommons\.org/licen[sc]es/by-nd"),
    "cc-by-sa": ("cc-by-sa-[1234]\\.\\d", r"(?:cc|creative_commons)[- ]+(?:by|attribution)[- ]+(?:sa|sharealike|share_alike)", r"creativecommons\.org/licen[sc]es/by-sa"),
    "cc-by": ("cc-by-[1234]\\.\\d", r"(?:cc[- ]+by|creative_commons_attribution)", r"creativecommons\.org/licen[sc]es/by/"),
}

#: Words of which one occurs in any form of the name; a label not listed: its head.
_NAME_WORDS = {
    "mit": ("licen",), "mit-0": ("attribution",), "gpl-2": ("gpl", "general"), "gpl-3": ("gpl", "general"), "gpl": ("gnu",),
    "lgpl-2.1": ("lesser", "library"), "lgpl-3": ("lesser",), "lgpl": ("lesser",), "agpl-3": ("affero",), "fdl": ("documentation",),
    "mpl-2": ("mozilla",), "mpl-1.1": ("mozilla",), "mpl": ("mozilla",), "epl-1": ("eclipse",), "epl-2": ("eclipse",),
    "cddl": ("distribution",), "cpl": ("common",), "bsl-1": ("boost",), "unlicense": ("unlicen",), "wtfpl": ("fuck",),
    "ofl-1.1": ("font",), "eupl": ("european",), "odbl": ("database",), "cc0": ("cc0", "zero"),
}

#: (priority, rule template, words of which one occurs; None: those of the name).
#: "{n}" is the name, "{i}" the ids, "{u}" the URL, "{host}" its host.
_TEMPLATES = (
    (95, r"spdx-licen[sc]e-identifier:_?(?:{i})(?![a-z0-9.-])", ("spdx",)),
    (90, r"(?:re)?licen[sc]ed_(?:to_you_)?under_(?:the_)?(?:terms_of_)?(?:the_)?{n}", None),
    (85, r"(?:released|distributed|available|provided|published|redistributed|covered)_under_(?:the_)?(?:terms_of_)?(?:the_)?{n}", None),
    (80, r"licen[sc]e:_?(?:the_)?(?:{i})(?![a-z0-9.-])", ("licence:", "license:")),
    (60, r"https?://(?:www\.)?{u}", ("{host}",)),
    (40, r"{n}", None),
)

#: Statements that no family covers: (label, priority, keyword, regex).
_SINGLE = (
    ("all-rights-reserved", 30, "reserved", r"all_rights_reserved"),
    ("copyright", 20, "copyright", r"copyright_(?:\(c\)_|©_)?(?:19|20)[0-9][0-9](?:_?[-,]_?(?:19|20)?[0-9][0-9])*"),
    ("public-domain", 50, "domain", r"(?:dedicated|released|placed)_(?:in)?to_the_public_domain"),
    ("public-domain", 35, "domain", r"(?:is|are)_in_the_public_domain"),
    ("mit", 92, "charge", r"permission_is_hereby_granted,_free_of_charge,_to_any_person_obtaining_a_copy"),
    ("bsd", 91, "redistribution", r"redistribution_and_use_in_source_and_binary_forms"),
    ("isc", 91, "purpose", r"permission_to_use,_copy,_modify,_and(?:/or)?_distribute_this_software_for_any_purpose_with_or_without_fee"),
    ("zlib", 91, "as-is", r"this_software_is_provided_'as-is',_without_any_express_or_implied_warranty"),
    ("unlicense", 91, "domain", r"this_is_free_and_unencumbered_software_released_into_the_public_domain"),
    ("proprietary", 45, "proprietary", r"(?:this_software_is_)?proprietary_(?:and_confidential|licen[sc]e)"),
    ("source-available", 45, "licen", r"(?:business_source|server_side_public|elastic)_licen[sc]e"),
)


def rules() -> list[tuple[str, int, tuple[str, ...], str]]:
    """(label, priority, words of which one occurs in any match, regex), best first."""
    out = [(label, p, (k,), rx) for label, p, k, rx in _SINGLE]
    for label, (ids, name, url) in _LICENSES.items():
        words = _NAME_WORDS.get(label) or (("cc", "creative") if label.startswith("cc-") else (label.split("-")[0],))
        for priority, template, kind in _TEMPLATES:
            if url or "{u}" not in template:
                body = template.replace("{i}", ids).replace("{n}", f"(?:{name})").replace("{u}", f"(?:{url})")
                host = (url or "").split("/")[0].replace("\\", "")
                out.append((label, priority, tuple(k.replace("{host}", host) for k in kind or words), body))
    return [(label, p, k, r"(?<![a-z0-9])" + rx.replace("_?", r"\s*").replace("_", r"\s+"))
            for label, p, k, rx in sorted(out, key=lambda r: -r[1])]


#: A text with none of these matches no rule and no base phrase.
GATE = ("licen", "spdx", "reserved", "copyright", "domain", "permission", "redistribution", "proprietary", "warrant",
        "gpl", "cc", "creative", "http")


def lowered(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _quoted(regex: str) -> str:
    """A raw SQL literal."""
    return f'r"{regex}"' if "'" in regex else f"r'{regex}'"


def _tried() -> Column:
    """An array of the rules that match the column ``low``: rule, label, priority, the matched
    strings and the strings between them. Every regex is a constant, compiled once a task, and
    rules are grouped by their keywords, so a text is searched for a keyword once."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for i, (label, priority, keys, rx) in enumerate(rules()):
        r = _quoted(rx)
        groups.setdefault(keys, []).append(
            f"CASE WHEN rlike(low, {r}) THEN named_struct('rule', {i}, 'label', '{label}', 'priority', {priority}, "
            f"'hits', regexp_extract_all(low, {r}, 0), 'gaps', split(low, {r}, -1)) END")
    gated = (f"CASE WHEN {' OR '.join(f"contains(low, '{k}')" for k in keys)} THEN array_compact(array({', '.join(own)})) END"
             for keys, own in groups.items())
    return F.expr(f"flatten(array_compact(array({', '.join(gated)})))")


def _walked(sizes: Column) -> Column:
    """(at, out): the length of all gaps and hits, and the hits' places from the first gap's start."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    return F.aggregate(sizes, none, lambda a, s: F.struct(
        (a["at"] + s["g"] + s["h"]).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + s["g"]).alias("start"), (a["at"] + s["g"] + s["h"]).alias("stop")))).alias("out")))


def _cut(items: Column, size: int) -> Column:
    """A non-empty array as an array of slices of ``size``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int")), lambda b: F.slice(items, b * size + 1, size))


def _places(r: Column) -> Column:
    """The detections of a tried rule. Places are sums over slices and then over the slices'
    totals, so the work grows with the hits and not with their square."""
    sizes = F.zip_with(r["hits"], F.slice(r["gaps"], 1, F.size(r["hits"])), lambda h, g: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))

    def joined(parts: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(parts, none, lambda a, w: F.struct((a["at"] + w["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(parts, before, lambda w, at: F.transform(w["out"], lambda x: F.struct(
            (x["start"] + at).alias("start"), (x["stop"] + at).alias("stop"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")))))

    return _let(sizes, lambda s: _let(F.transform(_cut(s, SUMMED), _walked), joined))


def _surviving(found: Column) -> Column:
    """The detections inside no better one, by start. Sorted by start they are cut to slices; a
    slice is compared with those that reach over it, not with all."""
    def beaten(d, o):
        size = o["stop"] - o["start"]
        own = d["stop"] - d["start"]
        better = (o["priority"] > d["priority"]) | ((o["priority"] == d["priority"]) & (
            (size > own) | ((size == own) & (o["rule"] < d["rule"]))))
        return (o["start"] <= d["start"]) & (o["stop"] >= d["stop"]) & better

    def reach(own: Column) -> Column:
        stops = F.transform(own, lambda d: d["stop"])
        return F.struct(own[0]["start"].alias("first"), F.element_at(own, -1)["start"].alias("last"),
                        F.array_min(stops).alias("least"), F.array_max(stops).alias("most"), own.alias("own"))

    def swept(parts: Column) -> Column:
        def slice_of(b: Column) -> Column:
            over = F.filter(parts, lambda o: (o["first"] <= b["last"]) & (o["most"] >= b["least"]))
            return _let(F.flatten(F.transform(over, lambda o: o["own"])), lambda near: F.filter(b["own"], lambda d: ~F.exists(near, lambda o: beaten(d, o))))
        return F.flatten(F.transform(parts, slice_of))

    return F.when(F.size(found) > 0, _let(F.array_sort(found), lambda s: _let(F.transform(_cut(s, SWEPT), reach), swept)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and ``detections`` (start, stop, priority, rule, label;
    code points of the text).

    A null text counts as empty: no words, no labels (empty strings), score 0. Equal
    detections of two rules leave the earlier rule's, repeated rows are scanned each, and
    an empty table gives an empty table. Texts of any length are scanned whole; the work
    grows with the detections, not with their square. Other columns of ``docs`` are not
    read, so clashing names do no harm.
    """
    spaced = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER + MARKS, LOWER + " " * len(MARKS))
    rows = docs.select(F.col(id_col), lowered(text_col).alias("low"), F.array_remove(F.split(spaced, " "), "").alias("words"))
    low = F.col("low")
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(low, F.lit(word))
    # Every word as " word ": phrases are then plain substrings.
    normal = F.when(gate, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "normal": normal,
        "found": F.when(gate, F.transform(_tried(), _places)),
    })
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for label, phrase in BASE:
        needle = " " + phrase.replace(" ", "  ") + " "
        size = len(phrase.split())
        n = F.coalesce((F.length("normal") - F.length(F.replace(F.col("normal"), F.lit(needle), F.lit("")))) / F.lit(len(needle)), F.lit(0.0)).cast("long")
        has = n > 0
        counts.append(n)
        labels.append(F.when(has, F.lit(label)))
        before = F.substring_index("normal", needle, 1)
        after = F.substring_index("normal", needle, -1)
        firsts.append(F.when(has, (spaces(before) / 2).cast("long")))
        lasts.append(F.when(has, (spaces(F.col("normal")) / 2).cast("long") - (spaces(after) / 2).cast("long") - F.lit(size)))
    base = F.array_compact(F.array(*labels))
    rows = rows.withColumn("found", F.flatten("found")).withColumn("detections", F.coalesce(_surviving(F.col("found")), F.array().cast(
        "array<struct<start:int,stop:int,priority:int,rule:int,label:string>>")))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0))
    n_base = counts[0] + counts[1] + counts[2]
    return rows.select(
        id_col, "n_words", n_base.alias("n_base"),
        F.array_min(F.array(*firsts)).alias("first_word"), F.array_max(F.array(*lasts)).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(best / F.lit(100.0), F.when(n_base > 0, 0.9).otherwise(0.0)).alias("score"), "detections")
