"""License detection by ordered signature rules.

A rule is a regular expression over the normalised words of a text (lower case,
single blanks).  A keyword gate skips rules whose rarest word is absent.  Found
intervals are taken by priority; an interval contained in a taken one is
suppressed, and so is one that overlaps a taken one of the same family.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.text import WORD_BYTES, map_slices

#: Phrases whose words stand consecutively, and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families of licenses: (family, gate word, ways to write the name, versions).
FAMILIES = (
    ("mit", "mit", ("mit", "mit x11"), ()),
    ("mit", "expat", ("expat",), ()),
    ("apache", "apache", ("apache", "apache software"), ("1", "1 0", "1 1", "2", "2 0")),
    ("apache", "asl", ("asl",), ("1", "1 0", "1 1", "2", "2 0")),
    ("gpl", "gpl", ("gpl", "gnu gpl"), ("1", "2", "2 0", "3", "3 0")),
    ("gpl", "general", ("gnu general public", "general public"), ("1", "2", "2 0", "3", "3 0")),
    ("lgpl", "lgpl", ("lgpl", "gnu lgpl"), ("2", "2 1", "3", "3 0")),
    ("lgpl", "lesser", ("gnu lesser general public", "lesser general public"), ("2", "2 1", "3", "3 0")),
    ("agpl", "affero", ("gnu affero general public", "affero general public"), ("3", "3 0")),
    ("agpl", "agpl", ("agpl", "gnu agpl"), ("3", "3 0")),
    ("bsd", "bsd", ("bsd", "new bsd", "modified bsd", "simplified bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause"), ()),
    ("mpl", "mozilla", ("mozilla public",), ("1", "1 1", "2", "2 0")),
    ("mpl", "mpl", ("mpl",), ("1", "1 1", "2", "2 0")),
    ("epl", "eclipse", ("eclipse public", "eclipse distribution"), ("1", "1 0", "2", "2 0")),
    ("cddl", "cddl", ("cddl",), ("1", "1 0", "1 1")),
    ("isc", "isc", ("isc",), ()),
    ("zlib", "zlib", ("zlib", "zlib libpng"), ()),
    ("boost", "boost", ("boost software", "boost"), ("1", "1 0")),
    ("artistic", "artistic", ("artistic", "perl artistic"), ("1", "1 0", "2", "2 0")),
    ("unlicense", "unlicense", ("unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("2",)),
    ("eupl", "eupl", ("eupl",), ("1 1", "1 2")),
    ("ofl", "font", ("sil open font", "open font"), ("1", "1 1")),
    ("odbl", "database", ("open database", "odc open database"), ("1", "1 0")),
    ("python", "python", ("python software foundation", "python"), ("2", "3")),
    ("php", "php", ("php",), ("3", "3 0", "3 01")),
    ("postgresql", "postgresql", ("postgresql",), ()),
    ("cc-by-nc-sa", "noncommercial", ("creative commons attribution noncommercial sharealike", "attribution noncommercial sharealike"), ("2", "2 0", "3", "3 0", "4", "4 0")),
    ("cc-by-nc-nd", "noncommercial", ("creative commons attribution noncommercial noderivatives", "attribution noncommercial noderivatives"), ("3", "3 0", "4", "4 0")),
    ("cc-by-nc", "noncommercial", ("creative commons attribution noncommercial", "attribution noncommercial"), ("2", "2 0", "3", "3 0", "4", "4 0")),
    ("cc-by-nd", "noderivatives", ("creative commons attribution noderivatives",), ("3", "3 0", "4", "4 0")),
    ("cc-by-sa", "sharealike", ("creative commons attribution sharealike", "attribution sharealike"), ("2", "2 0", "3", "3 0", "4", "4 0")),
    ("cc-by", "creative", ("creative commons attribution",), ("2", "2 0", "3", "3 0", "4", "4 0")),
    ("cc-by-nc-sa", "cc", ("cc by nc sa",), ("2", "2 0", "3", "3 0", "4", "4 0")),
    ("cc-by-nc-nd", "cc", ("cc by nc nd",), ("3", "3 0", "4", "4 0")),
    ("cc-by-nc", "cc", ("cc by nc",), ("2", "2 0", "3", "3 0", "4", "4 0")),
    ("cc-by-nd", "cc", ("cc by nd",), ("3", "3 0", "4", "4 0")),
    ("cc-by-sa", "cc", ("cc by sa",), ("2", "2 0", "3", "3 0", "4", "4 0")),
    ("cc-by", "cc", ("cc by",), ("2", "2 0", "3", "3 0", "4", "4 0")),
    ("cc0", "cc0", ("cc0",), ("1", "1 0")),
    ("cc0", "zero", ("creative commons zero",), ("1", "1 0")),
    ("public-domain", "domain", ("public domain dedication",), ()),
)
#: Families whose name alone says enough.
SELF_EVIDENT = ("gpl", "lgpl", "agpl", "cddl", "eupl", "wtfpl", "unlicense", "cc-by", "cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by-nc-sa", "cc-by-nc-nd", "cc0", "public-domain")
#: Notices that name no family: (label, gate word, expression, weight).
NOTICES = (
    ("all-rights-reserved", "reserved", "all rights reserved", 0.5),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 0.4),
    ("public-domain", "domain", "(?:released|placed|dedicated) (?:in)?to the public domain", 0.8),
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 0.9),
    ("proprietary", "proprietary", "proprietary and confidential", 0.6),
)


@dataclass(frozen=True)
class Rule:
    label: str
    family: str
    gate: bytes
    pattern: re.Pattern
    priority: int
    weight: float


def signature_rules() -> tuple[Rule, ...]:
    """All rules, the most specific first: a grant with name and version, a name with version, a grant, a name."""
    rules: list[Rule] = []
    grant = r"(?:(?:re|dual )?licensed|released|distributed|available|published|provided|made available) (?:to you )?(?:under|by|with) (?:the terms of )?(?:the |a |an )?(?:terms of the )?"

    def add(label, family, gate, expression, priority, weight):
        rules.append(Rule(label, family, gate.encode(), re.compile(f" {expression}(?= )".encode()), priority, weight))

    for family, gate, names, versions in FAMILIES:
        for name in names:
            kind = "licen[cs]e" if family not in SELF_EVIDENT else "(?:licen[cs]e)?"
            tail = f"{name} {kind}" if family not in SELF_EVIDENT else f"{name}(?: licen[cs]e)?"
            for version in versions:
                joined = f"{tail}(?: version| v)? {version}(?: or later| only)?"
                label = f"{family}-{'.'.join(version.split())}"
                add(label, family, gate, grant + joined, 4 * 10 + len(version), 0.95)
                add(label, family, gate, joined, 3 * 10 + len(version), 0.85)
            add(family, family, gate, grant + tail, 20, 0.9)
            add(family, family, gate, tail, 10, 0.7)
            add(family, family, gate, f"spdx licen[cs]e identifier {name}", 45, 0.99)
    for label, gate, expression, weight in NOTICES:
        add(label, label, gate, expression, 15, weight)
    return tuple(sorted(rules, key=lambda r: -r.priority))


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Take intervals by priority, then length, then place; drop contained ones and overlaps within a family."""
    taken: list[tuple[int, int, Rule]] = []
    by_start: list[tuple[int, int, str]] = []
    widest = 0
    for start, end, rule in sorted(found, key=lambda f: (-f[2].priority, f[0] - f[1], f[0], f[2].label)):
        low = bisect.bisect_left(by_start, (start - widest, -1, ""))
        high = bisect.bisect_left(by_start, (end, -1, ""))
        near = by_start[low:high]
        if any(s <= start and end <= e or (family == rule.family and s < end and start < e) for s, e, family in near):
            continue
        taken.append((start, end, rule))
        bisect.insort(by_start, (start, end, rule.family))
        widest = max(widest, end - start)
    return taken


_RULES: dict[str, tuple] = {}


def _rules() -> tuple[tuple[bytes, tuple[Rule, ...]], ...]:
    if "rules" not in _RULES:
        by_gate: dict[bytes, list[Rule]] = {}
        for rule in signature_rules():
            by_gate.setdefault(b" " + rule.gate, []).append(rule)
        _RULES["rules"] = tuple((g, tuple(r)) for g, r in by_gate.items())
    return _RULES["rules"]


def normalised(text: bytes) -> tuple[bytes, int]:
    """The words between single blanks, with one before and one after, and their number."""
    words = text.translate(WORD_BYTES).split()
    return b" " + b" ".join(words) + b" ", len(words)


def places(text: bytes, phrase: bytes) -> list[int]:
    """Byte offsets at which the blank-enclosed phrase stands; two places may share a blank."""
    found, at = [], text.find(phrase)
    while at >= 0:
        found.append(at)
        at = text.find(phrase, at + 1)
    return found


def detections(text: bytes) -> list[tuple[int, int, Rule]]:
    """Resolved (start, end, rule) intervals of a normalised text."""
    found = []
    for gate, rules in _rules():
        if gate in text:
            for rule in rules:
                found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(text)]
    return resolve(found) if found else []


RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words, no labels (empty strings), null places
    and score 0.  Equal rows are scanned one by one; other columns are ignored.
    """
    phrases = [(f" {p} ".encode(), label) for p, label in BASE_PHRASES]

    def work(rows, texts):
        made = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for raw in texts:
            text, n_words = normalised(raw)
            base = [(at, label) for phrase, label in phrases for at in places(text, phrase)]
            own = detections(text)
            starts = [at for at, _ in base]
            base_labels = {label for _, label in base}
            made["n_words"].append(n_words)
            made["n_base"].append(len(base))
            made["first_word"].append(text.count(b" ", 0, min(starts)) if base else None)
            made["last_word"].append(text.count(b" ", 0, max(starts)) if base else None)
            made["base_labels"].append(",".join(sorted(base_labels)))
            made["labels"].append(",".join(sorted(base_labels | {rule.label for _, _, rule in own})))
            weights = [0.9] * len(base_labels) + [rule.weight for _, _, rule in own]
            made["score"].append(float(1 - np.prod([1 - w for w in weights])) if weights else 0.0)
        return {"doc_id": rows.column(0)} | {n: pa.array(v) if n == "score" else v for n, v in made.items()}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), work, f"doc_id {kind}, {RESULT}")
