"""License scans by ordered signature rules, in built-in functions only.

A text is lower-cased and reduced to its words, one space between them. A document in which none of STEMS stands is done,
as every rule needs one. On the others, the rules whose keyword the text holds are run; each detection is an interval of
the reduced text with the rule's priority. A detection that lies within another of the same or a higher priority is
suppressed; of equal intervals the higher priority stays, then the earlier rule. Labels are those of the detections left
and of the base phrases, which are never suppressed.

Everything happens within a row: nothing is shuffled, whatever the texts' lengths or copies.

Cases: a missing or empty text has no words, no labels and score 0; repeated rows give repeated results; a missing
doc_id stays missing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import text_of
from folio.llm.native import placed

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Hand-written: label, keyword, pattern of the name in reduced text, versions ("" is none).
FAMILIES = (
    ("gpl", "gnu", r"(?:gnu )?general public licen[sc]e", ("1", "2", "3")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lesser", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2", "2.1", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2.1", "3")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", ("1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", ("1.1", "1.2", "1.3")),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", r"mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", r"eclipse public licen[sc]e", ("1.0", "2.0")),
    ("cddl", "distribution", r"common development and distribution licen[sc]e", ("1.0", "1.1")),
    ("cpl", "common", r"common public licen[sc]e", ("1.0",)),
    ("eupl", "european", r"european union public licen[sc]e", ("1.0", "1.1", "1.2")),
    ("ecl", "educational", r"educational community licen[sc]e", ("1.0", "2.0")),
    ("artistic", "artistic", r"artistic licen[sc]e", ("1.0", "2.0")),
    ("psf", "python", r"python software foundation licen[sc]e", ("2",)),
    ("zpl", "zope", r"zope public licen[sc]e", ("1.1", "2.0", "2.1")),
    ("osl", "open", r"open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic", r"academic free licen[sc]e", ("1.1", "2.0", "2.1", "3.0")),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e", ("1.0", "1.1")),
    ("bsl", "boost", r"boost software licen[sc]e", ("1.0",)),
    ("busl", "business", r"business source licen[sc]e", ("1.0", "1.1")),
    ("sspl", "server", r"server side public licen[sc]e", ("1",)),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ()),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", ()),
    ("odbl", "database", r"open(?: data commons open)? database licen[sc]e", ("1.0",)),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e", ("1.0",)),
    ("pddl", "public", r"public domain dedication and licen[sc]e", ("1.0",)),
    ("cecill", "cecill", r"cecill(?: free software)?(?: licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1")),
    ("mit", "mit", r"(?:the )?mit licen[sc]e", ()),
    ("x11", "x11", r"x11 licen[sc]e", ()),
    ("isc", "isc", r"isc licen[sc]e", ()),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e", ()),
    ("bsd-2-clause", "bsd", r"(?:2|two) clause(?: simplified)? bsd(?: licen[sc]e)?|bsd (?:2|two) clause(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd", r"(?:3|three) clause(?: new| revised)? bsd(?: licen[sc]e)?|bsd (?:3|three) clause(?: licen[sc]e)?", ()),
    ("bsd-4-clause", "bsd", r"(?:4|four) clause bsd(?: licen[sc]e)?|bsd (?:4|four) clause(?: licen[sc]e)?", ()),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ()),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("1", "2")),
    ("beerware", "beer", r"beer ?ware licen[sc]e", ()),
    ("cc0", "cc0", r"cc0", ("1.0",)),
    ("cc-by", "cc", r"cc by", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc", r"cc by sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc", r"cc by nd", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc", r"cc by nc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by", "creative", r"creative commons attribution(?: licen[sc]e)?", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: licen[sc]e)?", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: licen[sc]e)?", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?", ("2.0", "2.5", "3.0", "4.0")),
)

#: Hand-written rules of sentences: label, keyword, pattern, priority.
SENTENCES = (
    ("mit", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 4),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 4),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 4),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 4),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 4),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", 4),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 4),
    ("public-domain", "domain", r"(?:released into|placed in|dedicated to) the public domain", 3),
    ("proprietary", "reserved", r"all rights reserved", 1),
    ("proprietary", "confidential", r"proprietary and confidential", 2),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}", 1),
    ("unknown-license", "license", r"see the license file", 1),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0", 3),
    ("gpl", "gnu", r"www gnu org licenses gpl(?: [0-9])*", 3),
    ("mit", "opensource", r"opensource org licenses mit", 3),
    ("bsd-3-clause", "opensource", r"opensource org licenses bsd 3 clause", 3),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0", 3),
    ("unlicense", "unlicense", r"unlicense org", 3),
)


#: Every rule's pattern has one of these in it.
STEMS = ("license", "licence", "gpl", "wtfpl", "mpl", "cc by", "cc0", "creative", "clause", "cecill", "domain", "reserved", "confidential", "copyright", "granted", "permitted", "misrepresented", "redistribute", " org")


@dataclass(frozen=True)
class Rule:
    no: int
    label: str
    keyword: str
    pattern: str
    priority: int


def rules() -> tuple[Rule, ...]:
    """All rules in order: the sentences, then each family's identifier, notice and name, with each version and without."""
    out = [*SENTENCES]
    for label, keyword, name, versions in FAMILIES:
        for version in (*versions, ""):
            number = version.replace(".", " ")
            number = rf" (?:version |v)?{number.removesuffix(' 0')}" + ("(?: 0)?" if number.endswith(" 0") or " " not in number else "") if version else ""
            full = f"{label}-{version}" if version else label
            out.append((full, "identifier", rf"spdx license identifier {label.replace('-', ' ')}{number}", 4))
            out.append((full, keyword, rf"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:{name}){number}", 3))
            out.append((full, keyword, rf"(?:{name}){number}", 2))
    return tuple(Rule(i, label, keyword, rf"(?<= )(?:{pattern})(?= )", priority) for i, (label, keyword, pattern, priority) in enumerate(out))


PRIORITIES = (1, 2, 3, 4)


def reduced(text: Column) -> Column:
    """The words of a text, one space before, between and after them; no word: one space."""
    # Lower-casing letters beyond A-Z too moves no separator and, as no base phrase has a k, makes no base phrase.
    words = F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def words_in(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) - 1).cast("long")


def rule_array(found: tuple[Rule, ...]) -> Column:
    one = [F.struct(F.lit(r.no).alias("no"), F.lit(r.label).alias("label"), F.lit(f" {r.keyword} ").alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority")) for r in found]
    return F.array(*one)


def detections(words: Column, found: tuple[Rule, ...]) -> Column:
    """Every match of every rule whose keyword stands in the words: sorted structs (start, -end, -priority, no, label)."""

    def of(rule: Column) -> Column:
        between = F.transform(F.split(words, rule["pattern"]), F.length)
        lengths = F.transform(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), F.length)
        gaps = F.arrays_zip(between.alias("gap"), F.concat(lengths, F.array(F.lit(0))).alias("size"))
        all_ = F.filter(placed(gaps, lambda x: x["gap"] + x["size"], "struct<gap:int,size:int>"), lambda p: p["x"]["size"] > 0)

        def one(p: Column) -> Column:
            at, end = p["at"] + p["x"]["gap"], p["at"] + p["x"]["gap"] + p["x"]["size"]
            return F.struct(at.alias("start"), (-end).alias("till"), (-rule["priority"]).alias("rank"), rule["no"].alias("no"), rule["label"].alias("label"))

        return F.transform(all_, one)

    fitting = F.filter(rule_array(found), lambda r: F.contains(words, r["keyword"]))
    return F.array_sort(F.flatten(F.transform(fitting, of)))


def resolved(found: Column) -> Column:
    """The detections left: one falls if an earlier one in the order, of its priority or higher, ends where it ends or after."""

    start = F.struct(*(F.lit(0).alias(f"end{p}") for p in PRIORITIES), F.array().cast("array<struct<label:string,priority:int>>").alias("kept"))

    def add(state: Column, d: Column) -> Column:
        end, priority = -d["till"], -d["rank"]
        over = F.greatest(*(F.when(priority <= p, state[f"end{p}"]).otherwise(0) for p in PRIORITIES))
        ends = (F.when(priority == p, F.greatest(state[f"end{p}"], end)).otherwise(state[f"end{p}"]).alias(f"end{p}") for p in PRIORITIES)
        one = F.array(F.struct(d["label"].alias("label"), priority.alias("priority")))
        return F.struct(*ends, F.when(over < end, F.array_union(state["kept"], one)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(found, start, add, lambda s: s["kept"])


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is that of the surest detection left: a quarter of its priority.
    """
    found = rules()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), reduced(text_of(docs)).alias("_w"))
    words = F.col("_w")
    # The pieces between a phrase's places; one piece: no place.
    pieces = {p: F.when(F.contains(words, F.lit(f" {p} ")), F.split(words, rf"(?<= ){p}(?= )")).otherwise(F.array(words)) for p in BASE}
    gate = reduce(or_, (F.contains(words, F.lit(x)) for x in STEMS))
    kept = F.when(gate, resolved(detections(words, found))).otherwise(F.array().cast("array<struct<label:string,priority:int>>"))
    rows = rows.withColumns({"n_words": words_in(words), **{f"_p{i}": x for i, x in enumerate(pieces.values())}, "_kept": kept})
    some = {f"_p{i}": (F.size(f"_p{i}") > 1, len(p.split()), label) for i, (p, label) in enumerate(BASE.items())}
    base = F.array_sort(F.array_compact(F.array(*(F.when(yes, F.lit(label)) for yes, _, label in some.values()))))
    first = F.array_min(F.array(*(F.when(yes, words_in(F.element_at(c, 1))) for c, (yes, _, _) in some.items())))
    last = F.array_max(F.array(*(F.when(yes, F.col("n_words") - n - words_in(F.element_at(c, -1))) for c, (yes, n, _) in some.items())))
    own = F.transform("_kept", lambda d: d["label"])
    best = F.array_max(F.transform("_kept", lambda d: d["priority"]))
    return rows.select(
        "doc_id",
        "n_words",
        sum((F.size(c) - 1 for c in some), F.lit(0)).cast("long").alias("n_base"),
        first.cast("long").alias("first_word"),
        last.cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        (F.coalesce(best, F.lit(0)) / F.lit(4.0)).alias("score"),
    )
