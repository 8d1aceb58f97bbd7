"""Licence detection by ordered signature rules, in DataFrame operations alone.

A rule is a regular expression with a keyword, a label, a weight and a
priority. Of all rules only those whose keyword is in a text are run on it.
Their detections are intervals: one that lies within another is suppressed (of
equal ones the rule that comes first stays), and of two that overlap in part
the one of better priority stays. A detection is suppressed only by one that
stands itself. Any white space, with line breaks and comment marks in it,
counts as one space, so wrapped notices are found like others.

The rules are written down compactly: each licence is a line with its names,
identifiers and versions, and each form of words in which licences are named
makes a rule of every name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.llm.common import free_name, lower_ascii, without
from profilekit.llm.spans import matches
from profilekit.runtime import quoted

#: Phrases of consecutive words and their labels. Fixed values.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, keyword, name pattern and versions ("" for none) of each licence.
NAMED = [
    ("gpl", "general public licen", r"(?:gnu )?general public licen[sc]e", "1.0 2.0 3.0"),
    ("lgpl", "general public licen", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "2.0 2.1 3.0"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", "1.0 3.0"),
    ("gfdl", "free documentation licen", r"(?:gnu )?free documentation licen[sc]e", "1.1 1.2 1.3"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", "1.0 1.1 2.0"),
    ("mpl", "mozilla public licen", r"mozilla public licen[sc]e", "1.0 1.1 2.0"),
    ("epl", "eclipse public licen", r"eclipse public licen[sc]e", "1.0 2.0"),
    ("eupl", "european union public licen", r"european union public licen[sc]e", "1.0 1.1 1.2"),
    ("cddl", "common development and distribution", r"common development and distribution licen[sc]e", "1.0 1.1"),
    ("cpl", "common public licen", r"common public licen[sc]e", "1.0"),
    ("afl", "academic free licen", r"academic free licen[sc]e", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", "open software licen", r"open software licen[sc]e", "1.0 1.1 2.0 2.1 3.0"),
    ("artistic", "artistic licen", r"artistic licen[sc]e", "1.0 2.0"),
    ("bsl", "boost software licen", r"boost software licen[sc]e", "1.0"),
    ("busl", "business source licen", r"business source licen[sc]e", "1.1"),
    ("ofl", "open font licen", r"(?:sil )?open font licen[sc]e", "1.0 1.1"),
    ("odbl", "open database licen", r"open (?:data commons )?open database licen[sc]e|open database licen[sc]e", "1.0"),
    ("sspl", "server side public licen", r"server side public licen[sc]e", "1.0"),
    ("php", "php licen", r"php licen[sc]e", "3.0 3.01"),
    ("python", "python software foundation", r"python software foundation licen[sc]e", "2.0"),
    ("qpl", "q public licen", r"q public licen[sc]e", "1.0"),
    ("zpl", "zope public licen", r"zope public licen[sc]e", "1.1 2.0 2.1"),
    ("npl", "netscape public licen", r"netscape public licen[sc]e", "1.0 1.1"),
    ("lppl", "latex project public licen", r"latex project public licen[sc]e", "1.0 1.1 1.2 1.3"),
    ("ecl", "educational community licen", r"educational community licen[sc]e", "1.0 2.0"),
    ("ms-pl", "microsoft public licen", r"microsoft public licen[sc]e", ""),
    ("ms-rl", "microsoft reciprocal licen", r"microsoft reciprocal licen[sc]e", ""),
    ("mit", "mit licen", r"(?:the )?mit licen[sc]e", ""),
    ("x11", "x11 licen", r"x11 licen[sc]e", ""),
    ("isc", "isc licen", r"isc licen[sc]e", ""),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd[- ]2[- ]clause|2[- ]clause bsd)(?: licen[sc]e)?", ""),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd[- ]3[- ]clause|3[- ]clause bsd)(?: licen[sc]e)?", ""),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd[- ]4[- ]clause|4[- ]clause bsd)(?: licen[sc]e)?", ""),
    ("bsd", "bsd licen", r"bsd licen[sc]e", ""),
    ("zlib", "zlib licen", r"zlib licen[sc]e", ""),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "what the", r"do what the f\w* you want to public licen[sc]e", ""),
    ("openssl", "openssl licen", r"openssl licen[sc]e", ""),
    ("ruby", "ruby licen", r"ruby licen[sc]e", ""),
    ("vim", "vim licen", r"vim licen[sc]e", ""),
    ("postgresql", "postgresql licen", r"postgresql licen[sc]e", ""),
    ("beerware", "beer-?ware", r"beer-?ware licen[sc]e", ""),
    ("ntp", "ntp licen", r"ntp licen[sc]e", ""),
    ("w3c", "w3c software", r"w3c software (?:notice and )?licen[sc]e", ""),
    ("json", "json licen", r"json licen[sc]e", ""),
    ("hpnd", "historical permission notice", r"historical permission notice and disclaimer", ""),
    ("elastic", "elastic licen", r"elastic licen[sc]e", "2.0"),
    ("unicode", "unicode licen", r"unicode licen[sc]e", "3.0"),
]
COMMONS = {"by": "attribution", "by-sa": "attribution[- ]share ?alike", "by-nc": "attribution[- ]non ?commercial", "by-nd": "attribution[- ]no ?deriv(?:ative)?s", "by-nc-sa": "attribution[- ]non ?commercial[- ]share ?alike", "by-nc-nd": "attribution[- ]non ?commercial[- ]no ?deriv(?:ative)?s"}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0".split()
#: Label, keyword, pattern and weight of notices that are not a licence's name.
NOTICES = [
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 0.8),
    ("copyright", "copyright", r"copyright (?:\(c\)|©|[0-9]{4})[^\n]{0,80}", 0.5),
    ("copyright", "©", r"© ?[0-9]{4}[^\n]{0,80}", 0.5),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.8),
    ("cc0-1.0", "cc0", r"(?:cc0(?:[- ]1\.0)?)(?: universal)?", 0.8),
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0.95),
    ("isc", "permission to use, copy", r"permission to use, copy, modify,? and(?:/or)? distribute this software", 0.9),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification", 0.9),
    ("gpl", "free software", r"this (?:program|library) is free software[;:,]? you can redistribute it", 0.9),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.7),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|distribution)[^\n]{0,60}prohibited", 0.7),
]
#: How a name stands in a text: around the name, weight. The longest form contains the others and suppresses them.
FORMS = [
    (r"(?:licen[sc]ed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?{}", 0.95),
    (r"(?:subject to|governed by|see) (?:the )?(?:terms of )?(?:the )?{}", 0.85),
    (r"{}", 0.7),
]
GAP = r"(?:,|;)? (?:\()?(?:version |ver\. ?|v\.? ?)?"


#: What a space of a rule stands for: white space, with comment marks that stand by themselves in it.
SPACE = r"(?:\s++(?:[#*/;%!>]++\s++)*+)"


def spaced(pattern: str) -> str:
    return pattern.replace("[- ]", "(?:-| )").replace(" ", SPACE)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    weight: float


def versioned(label: str, pattern: str, version: str) -> tuple[str, str]:
    """Label and pattern of a name with a version; ``2.0`` also stands as ``2``."""
    short = version.removesuffix(".0").replace(".", r"\.")
    tail = r"(?:\.0)?" if version.endswith(".0") else ""
    later = r"(?: or (?:any )?later(?: version)?|\+)?"
    return f"{label}-{version}", rf"(?:{pattern}){GAP}{short}{tail}(?![0-9.]*[0-9]){later}"


def rules() -> list[Rule]:
    """All rules, best priority first: tags, then names with versions, then bare names, each in its forms, then notices."""
    exact, named, bare = [], [], []
    for label, keyword, pattern, versions in NAMED:
        keyword = keyword.replace("-?", "") if label != "beerware" else "ware"
        for version in versions.split():
            full, with_version = versioned(label, pattern, version)
            named += [Rule(full, keyword, form.format(with_version), weight) for form, weight in FORMS]
            exact.append(Rule(full, "spdx", rf"spdx-license-identifier: ?{label}-{version.replace('.', chr(92) + '.')}(?:-only|-or-later|\+)?", 0.99))
        bare += [Rule(label, keyword, form.format(f"(?:{pattern})"), weight - 0.1) for form, weight in FORMS]
        if not versions:
            exact.append(Rule(label, "spdx", rf"spdx-license-identifier: ?{label}\b", 0.99))
    for kind, words in COMMONS.items():
        name = rf"(?:cc[- ]{kind.replace('-', '[- ]')}|creative commons {words})(?![- ](?:sa|nc|nd)\b)(?:(?: international| unported)? licen[sc]e)?"
        for keyword in ("cc", "creative commons"):
            for version in COMMONS_VERSIONS:
                full, with_version = versioned(f"cc-{kind}", name, version)
                named.append(Rule(full, keyword, rf"(?:licen[sc]ed under (?:a |the )?)?{with_version.replace(GAP, '[- ](?:version |v)?')}", 0.9))
            bare.append(Rule(f"cc-{kind}", keyword, rf"(?:licen[sc]ed under (?:a |the )?)?\b{name}", 0.6))
        exact += [Rule(f"cc-{kind}-{v}", "creativecommons.org", rf"creativecommons\.org/licenses/{kind}/{v.replace('.', chr(92) + '.')}", 0.95) for v in COMMONS_VERSIONS]
    return [*exact, *named, *bare, *(Rule(*n) for n in NOTICES)]


#: Any of these must be in a text for any rule to be tried on it.
GATE = r"licen[sc]e|copyright|©|spdx|cc0|\bcc[- ]by|creative ?commons|public domain|rights reserved|bsd|permission|redistribution|free software|proprietary|unauthori"


def standing(found: Column) -> Column:
    """Of detections those that stand, by start.

    They are decided in the order of how many others they lie in, then of
    priority; each stands if it meets none that stands already. What contains a
    detection lies in fewer, so it is decided before.
    """

    def holds(c: Column, d: Column) -> Column:
        within = (c["start"] <= d["start"]) & (c["neg_end"] <= d["neg_end"])
        same = (c["start"] == d["start"]) & (c["neg_end"] == d["neg_end"])
        return within & (~same | (c["priority"] < d["priority"]))

    def ranked(d: Column) -> Column:
        depth = F.size(F.filter(found, lambda c: holds(c, d)))
        return F.struct(depth.alias("depth"), d["priority"].alias("rank"), d["start"].alias("first"), d.alias("d"))

    def decide(kept: Column, r: Column) -> Column:
        d = r["d"]
        met = F.exists(kept, lambda k: (k["start"] < -d["neg_end"]) & (d["start"] < -k["neg_end"]))
        return F.when(met, kept).otherwise(F.concat(kept, F.array(d)))

    return F.array_sort(F.aggregate(F.array_sort(F.transform(found, ranked)), F.array().cast(DETECTIONS), decide))


DETECTIONS = "array<struct<start:int,neg_end:int,priority:int,label:string,weight:double>>"


def detections(low: Column, flat: Column) -> Column:
    """All detections, as ``array<struct<start, neg_end, priority, label, weight>>``, in a lower-cased text.

    ``flat`` is the text with one space for each ``SPACE``, which keywords are looked up in.
    """
    # One literal: hundreds of nested literals would take the optimiser long.
    listed = [{"keyword": r.keyword, "pattern": spaced(r.pattern), "priority": i, "label": r.label, "weight": r.weight} for i, r in enumerate(rules())]
    table = F.from_json(F.lit(json.dumps(listed)), "array<struct<keyword:string,pattern:string,priority:int,label:string,weight:double>>")
    tried = F.filter(table, lambda r: F.contains(flat, r["keyword"]))
    found = F.flatten(
        F.transform(
            tried,
            lambda r: F.transform(
                matches(low, r["pattern"]),
                lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("neg_end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")),
            ),
        )
    )
    return F.when(flat.rlike(GATE), found.cast(DETECTIONS)).otherwise(F.array().cast(DETECTIONS))


def phrase_places(words: Column) -> Column:
    """Start (in words) and label of each base phrase, by phrase."""

    def of(parts: list[str], label: str) -> Column:
        def stands(i: Column) -> Column:
            return reduce(and_, [F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])

        span = F.size(words) - len(parts)
        starts = F.when(span >= 0, F.filter(F.sequence(F.lit(0), F.greatest(span, F.lit(0))), stands)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    return F.concat(*[of(phrase.split(), label) for phrase, label in PHRASES.items()])


#: No base phrase occurs in a text without one of these.
PHRASE_GATE = r"license|cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``detections``.

    Columns of these names are replaced, others stay. A null text counts as empty: no words,
    no labels, score 0. Every row stays, repeated rows included. The score is
    the noisy-or of the weights of the detections that stand. No shuffle.
    """
    out = without(docs, ADDED)
    columns = out.columns
    low, flat, words, places, found = (free_name(docs, n) for n in ("low text", "flat text", "its words", "places", "found"))
    out = out.withColumn(low, lower_ascii(F.coalesce(F.col(quoted(text)), F.lit(""))))
    out = out.withColumn(words, F.regexp_extract_all(low, F.lit(WORDS), F.lit(0))).withColumn(flat, F.regexp_replace(low, SPACE, " "))
    none = F.array().cast("array<struct<at:int,label:string>>")
    out = out.withColumn(places, F.when(F.col(low).rlike(PHRASE_GATE), phrase_places(F.col(words))).otherwise(none))
    out = out.withColumn(found, detections(F.col(low), F.col(flat)))
    out = out.withColumn("detections", standing(F.col(found)))
    at = F.transform(places, lambda p: p["at"])
    base = F.transform(places, lambda p: p["label"])
    own = F.transform("detections", lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = 1.0 - F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1.0 - d["weight"]))
    shown = F.transform("detections", lambda d: F.struct(d["start"].alias("start"), (-d["neg_end"]).alias("end"), d["label"].alias("label"), d["weight"].alias("weight")))
    return out.select(
        *[F.col(quoted(c)) for c in columns],
        F.size(words).cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        score.alias("score"),
        shown.alias("detections"),
    )
