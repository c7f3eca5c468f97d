r"""License scan by ordered signature rules, in DataFrame functions only.

Base: a text is lower-cased (A–Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``;
the places where a phrase's words stand one after the other give the base labels.

Signature rules: regexes over the words joined by single spaces, hundreds of them, made
from families (a license's names × the ways it is granted). Each has a keyword, a
priority tier, a confidence and a label. Two gates keep them off most texts: one
alternation finds which keywords a text holds at all, and only rules of these keywords
run. A keyword is a word that every match of its rules holds, alone or with a version
joined to its end (gplv3). A rule's matches are intervals of the joined text. A match is suppressed if another
match of an equal or better tier contains it; of equal intervals in one tier the earlier
rule stays. Matches that merely overlap all stay.

Everything is computed inside the row, on arrays: no shuffle at all, so neither copies
nor frequent licenses meet in one task. Work on a text grows with its length and with n log n
of its n matches: running totals place the matches and find those that are covered.

score: the best confidence among the matches that stay, 0 without one.

Edge cases: a null or empty text has no words, no places and empty label strings; rows
that repeat are scanned each; empty tables give empty results. Only A–Z are folded: the
lower-casing of other letters cannot make or break a phrase, and words are counted on the
text as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# Families: keyword, label, names (single-spaced lower-case words), and version tails. Names without the
# keyword are gated by their longest word.
_FAMILIES = [
    ("apache", "apache", ["apache", "apache software", "asl"], ["1 0", "1 1", "2 0", "2"]),
    ("gnu", "gpl", ["gnu general public", "gnu gpl"], ["1", "2", "3", "2 0", "3 0"]),
    ("gpl", "gpl", ["gpl", "general public"], ["1", "2", "3", "2 0", "3 0"]),
    ("lesser", "lgpl", ["gnu lesser general public", "lesser general public"], ["2 1", "3", "3 0"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("affero", "agpl", ["gnu affero general public", "affero general public"], ["3", "3 0"]),
    ("agpl", "agpl", ["agpl", "gnu agpl"], ["1 0", "3", "3 0"]),
    ("mit", "mit", ["mit", "mit x11", "mit expat"], []),
    ("expat", "mit", ["expat"], []),
    ("bsd", "bsd", ["bsd", "new bsd", "modified bsd", "simplified bsd", "berkeley software distribution bsd"],
     ["2 clause", "3 clause", "4 clause", "0 clause"]),
    ("isc", "isc", ["isc", "internet systems consortium"], []),
    ("mozilla", "mpl", ["mozilla public"], ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 0", "1 1", "2 0"]),
    ("eclipse", "epl", ["eclipse public", "eclipse distribution"], ["1 0", "2 0"]),
    ("epl", "epl", ["epl"], ["1 0", "2 0"]),
    ("boost", "bsl", ["boost software"], ["1 0"]),
    ("unlicense", "unlicense", ["the unlicense"], []),
    ("zlib", "zlib", ["zlib", "zlib libpng"], []),
    ("artistic", "artistic", ["artistic", "perl artistic"], ["1 0", "2 0"]),
    ("cddl", "cddl", ["cddl", "common development and distribution"], ["1 0", "1 1"]),
    ("ofl", "ofl", ["sil ofl", "ofl", "sil open font ofl"], ["1 0", "1 1"]),
    ("wtfpl", "wtfpl", ["wtfpl"], ["1", "2"]),
    ("eupl", "eupl", ["eupl", "european union public licence eupl"], ["1 0", "1 1", "1 2"]),
    ("cecill", "cecill", ["cecill", "cecill b", "cecill c"], ["1 0", "2 0", "2 1"]),
    ("odbl", "odbl", ["odbl", "open database odbl"], ["1 0"]),
    ("postgresql", "postgresql", ["postgresql"], []),
    ("python", "psf", ["python software foundation"], ["2", "2 0"]),
    ("openssl", "openssl", ["openssl"], []),
    ("gfdl", "gfdl", ["gfdl", "gnu free documentation gfdl"], ["1 1", "1 2", "1 3"]),
]
_CC = [("by", "cc-by"), ("by sa", "cc-by-sa"), ("by nd", "cc-by-nd"), ("by nc", "cc-by-nc"),
       ("by nc sa", "cc-by-nc-sa"), ("by nc nd", "cc-by-nc-nd")]
# Ways to state a license: (tier, confidence, regex around {name} and the version clause {v}).
_TAG, _GRANT, _NAME = 0, 1, 2
_FORMS = [
    (_TAG, 0.99, "spdx license identifier {name}{v}(?: only| or later)?"),
    (_GRANT, 0.95, "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?{name} licen[sc]e{v}"),
    (_NAME, 0.8, "{name} licen[sc]ed?{v}"),
    (_NAME, 0.6, "{name}{v}"),  # only with a version: a bare name says nothing
]
_TEXTS = [
    ("permission", "mit", 1, 0.97, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("redistribution", "bsd", 1, 0.97, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("permission", "isc", 1, 0.97, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("warranty", "zlib", 1, 0.9, r"this software is provided as is without any express or implied warranty"),
    ("gnu", "gpl", 1, 0.95, r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("unencumbered", "unlicense", 1, 0.97, r"this is free and unencumbered software released into the public domain"),
    ("reserved", "proprietary", 2, 0.5, r"all rights reserved"),
    ("domain", "public-domain", 2, 0.6, r"(?:dedicated to|in|into) the public domain"),
]


_JOINED = r"(?= |$|v?[0-9])"  # end of a keyword: of its word, or a version
_FOUND = "array<struct<start:int,back:int,tier:int,number:int,confidence:double,label:string>>"


def signature_rules() -> list[tuple[str, str, int, float, str]]:
    """(keyword, label, tier, confidence, regex), in rule order."""
    rules = []
    for keyword, label, names, versions in _FAMILIES:
        for tier, confidence, form in _FORMS:
            for name in names:
                words = name.split(" ")
                gate = keyword if keyword in words else max(words, key=len)
                for version in [*versions, ""]:
                    if version or "licen" in form:
                        v = rf"(?: version)? ?v?{version}" if version else ""
                        rules.append((gate, label, tier, confidence, form.format(name=name, v=v)))
    for code, label in _CC:
        tail = r"(?: [1-4] 0)?(?: international)?"
        end = r"(?! (?:nc|nd|sa)\b)"
        rules += [("cc", label, _TAG, 0.99, rf"spdx license identifier cc {code}{end}{tail}"),
                  ("cc", label, _GRANT, 0.95, rf"licensed under (?:a |the )?cc {code}{end}{tail}"),
                  ("cc", label, _NAME, 0.8, rf"cc {code}{end}{tail}"),
                  ("creative", label, _GRANT, 0.9, {"by": r"creative commons attribution(?! (?:non|share|no))",
                   "by sa": r"creative commons attribution share ?alike", "by nd": r"creative commons attribution no ?deriv\w*",
                   "by nc": r"creative commons attribution non ?commercial(?! (?:share|no))",
                   "by nc sa": r"creative commons attribution non ?commercial share ?alike",
                   "by nc nd": r"creative commons attribution non ?commercial no ?deriv\w*"}[code])]
    rules.append(("cc0", "cc0", _NAME, 0.9, r"cc0(?: 1 0)?(?: universal)?"))
    rules += [(k, label, tier, c, rx) for k, label, tier, c, rx in _TEXTS]
    return rules


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression named inside a lambda runs again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join) -> Column:
    """Running total of an array under ``join`` (associative), by steps of doubled width: n log n for n elements."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda acc, s: F.transform(
        acc, lambda x, i: F.when(i < s, x).otherwise(join(F.get(acc, i - s), x))))


def _matches(text: Column, rule: Column) -> Column:
    """All matches of one rule as (start, -end, tier, number, confidence, label): ends are the running total of
    the lengths of what stands between matches and of the matches."""
    between = F.transform(F.split(text, rule["regex"], -1), lambda g: F.length(g))
    found = F.transform(F.regexp_extract_all(text, rule["regex"], F.lit(0)), lambda m: F.length(m))
    both = F.zip_with(found, between, lambda m, g: F.struct(m.alias("m"), (m + g).alias("step")))
    both = F.filter(both, lambda x: x["m"].isNotNull())  # what follows the last match

    def intervals(pairs: Column) -> Column:
        ends = _let(F.transform(pairs, lambda x: x["step"]), lambda v: _running(v, lambda a, x: a + x))
        return F.zip_with(pairs, ends, lambda x, end: F.struct(
            (end - x["m"]).alias("start"), (-end).alias("back"), rule["tier"].alias("tier"), rule["number"].alias("number"),
            rule["confidence"].alias("confidence"), rule["label"].alias("label")))

    return _let(both, intervals)


def _uncovered(found: Column, tiers: list[int]) -> Column:
    """The matches that no match before them (in order of start, longest first, tier, number) covers at an equal or
    better tier: the smallest ``back`` so far is the largest end so far."""
    def least(tier: int) -> Column:
        return _let(F.transform(found, lambda m: F.when(m["tier"] <= tier, m["back"])),
                    lambda v: _running(v, lambda a, x: F.least(a, x)))

    def keep(so_far: Column) -> Column:
        def stays(m: Column, i: Column) -> Column:
            covered = [(m["tier"] == t) & (i > 0) & F.coalesce(F.get(so_far[f"t{t}"], i - 1) <= m["back"], F.lit(False))
                       for t in tiers]
            return ~reduce(lambda a, b: a | b, covered)
        return F.filter(found, stays)

    return _let(F.struct(*[least(t).alias(f"t{t}") for t in tiers]), keep)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases: list[tuple[str, str]] | None = None,
                  rules: list[tuple[str, str, int, float, str]] | None = None) -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score,
    and found: the matches that stay (start, end, label, confidence) in the joined words."""
    phrases = PHRASES if phrases is None else phrases
    rules = signature_rules() if rules is None else rules
    split = [(p.split(" "), label) for p, label in phrases]
    keywords = sorted({k for k, *_ in rules}, key=lambda k: (-len(k), k))
    any_word = "|".join(sorted({w[0] for w, _ in split} | set(keywords), key=lambda k: (-len(k), k)))

    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("joined", F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")))
    n_words = F.when(F.col("joined") == "", 0).otherwise(
        F.length("joined") - F.length(F.replace("joined", F.lit(" "), F.lit(""))) + 1).cast("long")
    d = d.select("id", n_words.alias("n_words"), F.lower("joined").alias("joined"))

    hit = F.col("joined").rlike(rf"(?:^| )(?:{any_word}){_JOINED}")
    d = d.withColumn("joined", F.when(hit, F.col("joined")))  # from here null for texts without any keyword
    d = d.withColumn("words", F.split("joined", " "))
    places = []
    for ws, label in split:
        starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), _stands(ws))
        gate = F.concat(F.lit(" "), F.col("joined"), F.lit(" ")).contains(" " + " ".join(ws) + " ")
        places.append((F.when(gate, starts).otherwise(F.array().cast("array<int>")), label))
    d = d.select("id", "n_words", "joined", *[p.alias(f"p{k}") for k, (p, _) in enumerate(places)])
    spots = [F.coalesce(F.col(f"p{k}"), F.array().cast("array<int>")) for k in range(len(places))]
    base = F.array_compact(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(spots, places)]))
    every = F.concat(*spots)

    rule_array = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(label).alias("label"), F.lit(tier).alias("tier"),
                                    F.lit(float(c)).alias("confidence"), F.lit(i).alias("number"),
                                    F.lit(rf"(?<![^ ])(?:{rx.strip()})(?![^ ])").alias("regex"))
                           for i, (k, label, tier, c, rx) in enumerate(rules)])
    held = F.array_distinct(F.regexp_extract_all("joined", F.lit(rf"(?<![^ ])(?:{'|'.join(keywords)}){_JOINED}"), F.lit(0)))
    d = d.select("id", "n_words", "joined", F.size(every).cast("long").alias("n_base"),
                 F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                 F.array_sort(F.array_distinct(base)).alias("base_labels"), held.alias("held"))
    found = F.flatten(F.transform(F.filter(rule_array, lambda r: F.array_contains("held", r["keyword"])),
                                  lambda r: _matches(F.col("joined"), r)))
    tiers = sorted({r[2] for r in rules})
    stays = _let(F.sort_array(found), lambda every: _uncovered(every, tiers))
    d = d.withColumn("found", F.coalesce(F.when(F.size("held") > 0, stays), F.array().cast(_FOUND))).drop("joined", "held")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce(
        F.transform("found", lambda m: m["label"]), F.array().cast("array<string>"))))
    best = F.coalesce(F.array_max(F.transform("found", lambda m: m["confidence"])), F.lit(0.0))
    spans = F.transform("found", lambda m: F.struct(m["start"].alias("start"), (-m["back"]).alias("end"),
                                                    m["label"].alias("label"), m["confidence"].alias("confidence")))
    return d.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                    F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                    best.alias("score"), spans.alias("found"))


def _stands(ws: list[str]):
    return lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get("words", i + j) == F.lit(w), F.lit(False))
                                                for j, w in enumerate(ws)])
