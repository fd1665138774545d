"""License scans: ordered signature rules over normalised words, gated by keywords, with suppression.

A rule has a label, a priority and a confidence. Signatures are literal phrases, generated from sentence frames and
names; written rules are regexes with optional words, fused versions (GPLv2) and tags (license: MIT). A rule is tried on
a text only if its keywords occur in it. Detections are word intervals. A detection that lies within the interval of a kept
one of the same or a higher priority is suppressed.

Defined results: a null or blank text has no words, no detections, null positions, empty labels and score 0; rows are
scanned one by one, so repeated rows give repeated results; an empty table gives an empty result; columns besides the
id and the text aren't read. Texts are scanned whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from sieveline.llm.text import arrow_rows, keep_columns, ship_package, small_batches

# The phrases and labels of the base scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, names as they are written out, short names that follow a license word or tag, versions.
FAMILIES = (
    ("apache", ("apache software license", "apache license"), ("apache",), ("1.0", "1.1", "2.0")),
    ("agpl", ("gnu affero general public license", "affero general public license"), ("agpl", "gnu agpl"), ("1", "3", "3.0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "lesser general public license"), ("lgpl", "gnu lgpl"), ("2", "2.0", "2.1", "3", "3.0")),
    ("gpl", ("gnu general public license", "general public license"), ("gpl", "gnu gpl"), ("1", "2", "2.0", "3", "3.0")),
    ("gfdl", ("gnu free documentation license", "free documentation license"), ("gfdl", "gnu fdl"), ("1.1", "1.2", "1.3")),
    ("mit", ("mit license", "expat license", "x11 license"), ("mit", "expat"), ()),
    ("bsd", ("bsd license", "berkeley software distribution license", "simplified bsd license", "new bsd license"), ("bsd", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause"), ()),
    ("mpl", ("mozilla public license",), ("mpl",), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public license",), ("epl",), ("1.0", "2.0")),
    ("cddl", ("common development and distribution license",), ("cddl",), ("1.0", "1.1")),
    ("cpl", ("common public license", "ibm public license"), ("cpl",), ("1.0",)),
    ("eupl", ("european union public license", "european union public licence"), ("eupl",), ("1.1", "1.2")),
    ("isc", ("isc license", "internet systems consortium license"), ("isc",), ()),
    ("zlib", ("zlib license", "zlib libpng license"), ("zlib",), ()),
    ("bsl", ("boost software license",), ("bsl", "boost"), ("1.0",)),
    ("artistic", ("artistic license", "perl artistic license"), ("artistic",), ("1.0", "2.0")),
    ("unlicense", ("the unlicense",), ("unlicense",), ()),
    ("wtfpl", ("do what the fuck you want to public license",), ("wtfpl",), ("2",)),
    ("psf", ("python software foundation license", "python license"), ("psf",), ("2",)),
    ("ofl", ("sil open font license", "open font license"), ("ofl",), ("1.0", "1.1")),
    ("odbl", ("open database license", "open data commons open database license"), ("odbl",), ("1.0",)),
    ("pddl", ("public domain dedication and license",), ("pddl",), ("1.0",)),
    ("cc0", ("creative commons zero", "cc0 public domain dedication"), ("cc0", "cc 0"), ("1.0",)),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderivs", "creative commons attribution noncommercial noderivatives"), ("cc by nc nd",), ("2.0", "3.0", "4.0")),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike",), ("cc by nc sa",), ("2.0", "3.0", "4.0")),
    ("cc-by-nc", ("creative commons attribution noncommercial", "creative commons attribution non commercial"), ("cc by nc",), ("2.0", "3.0", "4.0")),
    ("cc-by-nd", ("creative commons attribution noderivs", "creative commons attribution noderivatives"), ("cc by nd",), ("2.0", "3.0", "4.0")),
    ("cc-by-sa", ("creative commons attribution sharealike", "creative commons attribution share alike"), ("cc by sa",), ("2.0", "3.0", "4.0")),
    ("cc-by", ("creative commons attribution",), ("cc by",), ("2.0", "3.0", "4.0")),
)

# Sentence frames around a license's name or short name; priority and confidence of each.
FRAMES = (
    ("licensed under the {name} version {version}", 90, 1.0),
    ("licensed under the {name}", 80, 0.97),
    ("licensed under {short} {version}", 80, 0.97),
    ("licensed under {short}", 75, 0.93),
    ("released under the {name}", 80, 0.97),
    ("released under {short}", 75, 0.93),
    ("distributed under the {name}", 80, 0.97),
    ("available under the {name}", 80, 0.95),
    ("under the terms of the {name}", 85, 0.98),
    ("spdx license identifier {short} {version}", 95, 1.0),
    ("spdx license identifier {short}", 92, 1.0),
    ("license {short} {version}", 60, 0.85),
    ("{name} version {version}", 70, 0.95),
    ("{name} {version}", 65, 0.9),
    ("{name}", 50, 0.85),
    ("{short} license", 45, 0.8),
    ("{short} {version}", 40, 0.7),
    ("{short} licence", 45, 0.8),
)

# Phrases that speak of rights without a family; label, priority, confidence.
NOTICES = (
    ("all rights reserved", "proprietary", 30, 0.7),
    ("no part of this publication may be reproduced", "proprietary", 40, 0.9),
    ("for personal use only", "proprietary", 25, 0.6),
    ("not for redistribution", "proprietary", 25, 0.7),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 85, 1.0),
    ("redistribution and use in source and binary forms", "bsd", 85, 1.0),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 85, 1.0),
    ("this is free and unencumbered software released into the public domain", "unlicense", 85, 1.0),
    ("released into the public domain", "public-domain", 60, 0.9),
    ("dedicated to the public domain", "public-domain", 60, 0.9),
    ("this work is in the public domain", "public-domain", 60, 0.9),
    ("provided as is without warranty of any kind", "warranty-disclaimer", 20, 0.5),
)

#: Bytes of a word: digits, lower-case ASCII letters and all bytes of other characters.
WORD_BYTES = rb"0-9a-z\x80-\xff"
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

#: A keyword must be in the text before its rules are tried; the longest word of a phrase is the rarest as a rule.
GATE_WORDS = 2


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    confidence: float
    words: tuple[str, ...]

    @property
    def keywords(self) -> tuple[bytes, ...]:
        return tuple(w.encode() for w in sorted(set(self.words), key=lambda w: (-len(w), w))[:GATE_WORDS])

    @property
    def pattern(self) -> re.Pattern[bytes]:
        gap = rb"[^" + WORD_BYTES + rb"]+"
        return re.compile(rb"(?<![" + WORD_BYTES + rb"])" + gap.join(re.escape(w.encode()) for w in self.words) + rb"(?![" + WORD_BYTES + rb"])")


@dataclass(frozen=True)
class Rule:
    """A written rule: tried if of each of its gates one keyword is in the text."""

    label: str
    priority: int
    confidence: float
    gates: tuple[tuple[bytes, ...], ...]
    pattern: re.Pattern[bytes]


def written(pattern: str) -> re.Pattern[bytes]:
    """A regex of words in which a space is any gap between words and ~ a gap or none."""
    gap = "[^0-9a-z\\x80-\\xff]+"
    body = pattern.replace("~", f"(?:{gap})?").replace(" ", gap)
    return re.compile(f"(?<![0-9a-z\\x80-\\xff])(?:{body})(?![0-9a-z\\x80-\\xff])".encode())


# Written rules of each family: {s} short names, {x} any name, {v} a version with its optional words.
VERSIONED = "(?:~(?:version|ver|v)~| ){number}(?: 0)?(?: only| (?:or|and) (?:at your option )?(?:any |a )?(?:later|newer|above|greater)(?: versions?)?)?"
RULES = (
    ("(?:re)?(?:licen[sc]ed|released|distributed|distributable|available|published|provided|covered|issued|shared) under (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?{x}(?: licen[sc]e)?{v}?", 80, 0.97, (b"under",)),
    ("under (?:the )?(?:same )?terms (?:and conditions )?of (?:an? |the )?{x}(?: licen[sc]e)?{v}?", 85, 0.98, (b"under",)),
    ("{x}(?: licen[sc]e)?{v}", 66, 0.9, (b"0", b"1", b"2", b"3", b"4")),
    ("licen[sc]es?[\"']?[\\x20\\t]*[:=][\\x20\\t]*[\"'(\\[]*{s}{v}?", 62, 0.9, (b"licen",)),
)

def family_rules() -> list[Rule]:
    out = []
    for label, names, shorts, versions in FAMILIES:
        s = "(?:" + "|".join(sorted(shorts, key=len, reverse=True)) + ")"
        x = "(?:" + "|".join(sorted((*names, *shorts), key=len, reverse=True)).replace("license", "licen[sc]e") + ")"
        numbers = {v.replace(".", " ") for v in versions} | {v.split(".")[0] for v in versions} | ({"2 5"} if label.startswith("cc-") else set())
        v = "(?:" + VERSIONED.format(number="(?:" + "|".join(sorted(numbers, key=len, reverse=True)) + ")") + ")" if numbers else ""
        anchors = tuple(sorted({max(words_in(n), key=len).encode() if n in shorts else words_in(n)[0].encode() for n in (*names, *shorts)}))
        for rule, priority, confidence, gate in RULES:
            if "{v}" in rule and rule.endswith("{v}") and not v:
                continue
            text = rule.replace("{v}?", v + "?" if v else "").replace("{v}", v).replace("{s}", s).replace("{x}", x)
            out.append(Rule(label, priority, confidence, (anchors, gate), written(text)))
        # Short names that say a license alone; cc-by needs its hyphen, as "cc by" is also plain English.
        if label in ("gpl", "lgpl", "agpl"):
            out.append(Rule(label, 35, 0.6, ((label.encode(),),), written(label)))
        elif label.startswith("cc-by-"):
            out.append(Rule(label, 42, 0.75, ((b"cc",),), written(label.replace("-", " "))))
        elif label == "cc-by":
            out.append(Rule(label, 42, 0.75, ((b"cc-by",),), written("cc-by")))
    return out


def words_in(phrase: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[0-9a-z]+", phrase.lower()))


@cache
def signatures() -> tuple[Signature, ...]:
    """All rules, highest priority first, then the longest: the frames filled in with each family's names and versions."""
    rules = {}
    for (label, names, shorts, versions), (frame, priority, confidence) in product(FAMILIES, FRAMES):
        for name, short, version in product(names, shorts, versions or ("",)):
            if "{version}" in frame and not version:
                continue
            words = words_in(frame.format(name=name, short=short, version=version))
            rules.setdefault((label, words), Signature(label, priority, confidence, words))
    for phrase, label, priority, confidence in NOTICES:
        rules.setdefault((label, words_in(phrase)), Signature(label, priority, confidence, words_in(phrase)))
    return tuple(sorted(rules.values(), key=lambda r: (-r.priority, -len(r.words), r.label, r.words)))


@cache
def written_rules() -> tuple[Rule, ...]:
    return tuple(family_rules())


@cache
def gated() -> tuple[tuple[bytes, tuple[tuple[Signature, tuple[bytes, ...], re.Pattern[bytes]], ...]], ...]:
    """Rules with their further keywords, by the first keyword."""
    groups: dict[bytes, list] = {}
    for rule in signatures():
        first, *rest = rule.keywords
        groups.setdefault(first, []).append((rule, tuple(rest), rule.pattern))
    return tuple((k, tuple(v)) for k, v in groups.items())


@cache
def base_patterns() -> tuple[tuple[re.Pattern[bytes], str], ...]:
    return tuple((Signature(label, 0, 1.0, words_in(phrase)).pattern, label) for phrase, label in BASE)


def word_starts(body: bytes) -> np.ndarray:
    inside = IS_WORD[np.frombuffer(body, np.uint8)]
    return np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Signature | Rule


def suppress(found: list[Detection]) -> list[Detection]:
    """By priority, then length, then place: what lies within a kept detection goes."""
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label)):
        if not any(k.start <= d.start and d.end <= k.end for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end, d.rule.label))


def detect(body: bytes, starts: np.ndarray) -> list[Detection]:
    """Kept detections in word positions, end exclusive, of a text in lower case."""
    found = []
    for first, rules in gated():
        if first in body:
            for rule, rest, pattern in rules:
                if all(k in body for k in rest):
                    found += [Detection(at := int(np.searchsorted(starts, m.start())), at + len(rule.words), rule) for m in pattern.finditer(body)]
    for rule in written_rules():
        if all(any(k in body for k in gate) for gate in rule.gates):
            found += [Detection(int(np.searchsorted(starts, m.start())), int(np.searchsorted(starts, m.end())), rule) for m in rule.pattern.finditer(body)]
    return suppress(found)


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of one text."""
    body = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: only A-Z change
    starts = word_starts(body)
    places, labels = [], set()
    if b"license" in body:
        for pattern, label in base_patterns():
            at = [int(np.searchsorted(starts, m.start())) for m in pattern.finditer(body)]
            places += at
            labels |= {label} if at else set()
    kept = detect(body, starts)
    all_labels = labels | {d.rule.label for d in kept}
    score = max([1.0 if labels else 0.0, *(d.rule.confidence for d in kept)])
    spans = [(d.rule.label, d.start, d.end, d.rule.confidence) for d in kept]
    return len(starts), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(all_labels)), score, spans


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,start:bigint,end:bigint,confidence:double>>"


def scan_licenses(documents: DataFrame) -> DataFrame:
    """Licenses in the whole text of each document (doc_id, text), with the kept detections as word intervals."""
    ship_package(documents.sparkSession)
    small_batches(documents.sparkSession)

    def describe(text: str | None) -> tuple:
        *counts, spans = scan(text)
        return *counts, [{"label": a, "start": b, "end": c, "confidence": d} for a, b, c, d in spans]

    return arrow_rows(keep_columns(documents, "doc_id", "text"), "text", describe, SCHEMA)


def license_verdicts(documents: DataFrame) -> DataFrame:
    return scan_licenses(documents).drop("detections")
