"""License detection by ordered signature rules.

A rule is a regular expression with a label, a priority and keywords. Most rules are made from licence families times phrase forms
and from identifiers; grants and other phrases are written out. A rule's expression is tried only on texts that hold one of its keywords. Overlapping
detections are resolved in order: higher priority first, then longer, then earlier, then rule number; a detection inside the
interval of an accepted one is suppressed, one that only overlaps at an edge stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerlens.llm.common import ASCII_LOWER, texts

#: Phrases of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Label, keywords (any of them), name as an expression, address as an expression. More specific ones come first.
FAMILIES = (
    ("agpl-3.0", "affero|agpl", r"(?:gnu )?affero general public licen[sc]e(?:,? ?v(?:ersion)? ?3(?:\.0)?)?|\bagpl(?:[ -]?v?3(?:\.0)?)?\b", r"gnu\.org/licenses/agpl"),
    ("lgpl-3.0", "lesser|lgpl", r"(?:gnu )?lesser general public licen[sc]e,? ?v(?:ersion)? ?3(?:\.0)?|\blgpl[ -]?v?3(?:\.0)?\b", r"gnu\.org/licenses/lgpl-3"),
    ("lgpl-2.1", "lesser|lgpl", r"(?:gnu )?lesser general public licen[sc]e,? ?v(?:ersion)? ?2\.1|\blgpl[ -]?v?2\.1\b", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-2.0", "library|lgpl", r"(?:gnu )?library general public licen[sc]e,? ?v(?:ersion)? ?2(?:\.0)?|\blgpl[ -]?v?2(?:\.0)?\b(?!\.\d)", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl", "lesser|library|lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|\blgpl\b", r"gnu\.org/(?:copyleft/lesser|licenses/lgpl)"),
    ("gpl-3.0", "general public|gpl", r"(?:gnu )?general public licen[sc]e,? ?v(?:ersion)? ?3(?:\.0)?|\bgpl[ -]?v?3(?:\.0)?\b", r"gnu\.org/licenses/gpl-3"),
    ("gpl-2.0", "general public|gpl", r"(?:gnu )?general public licen[sc]e,? ?v(?:ersion)? ?2(?:\.0)?|\bgpl[ -]?v?2(?:\.0)?\b", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl", "gnu g|gpl", r"gnu (?:general public licen[sc]e|gpl)|\bgpl(?:v[123])?\b", r"gnu\.org/(?:licenses/gpl|copyleft/gpl)"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[sc]e,? ?v(?:ersion)? ?2(?:\.0)?|\bapache[ -](?:v(?:ersion)? ?)?2\.0\b(?: licen[sc]e\b)?|\bapache 2 licen[sc]e\b", r"apache\.org/licenses/license-2\.0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e,? ?v(?:ersion)? ?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", r"apache\.org/licenses"),
    ("mit", "mit licen|mit/x11|mit/expat", r"\bmit(?:/x11)? licen[sc]e|\bmit/expat\b", r"opensource\.org/licenses/mit"),
    ("isc", "isc licen", r"\bisc licen[sc]e", r"opensource\.org/licenses/isc"),
    ("bsd-2-clause", "bsd", r"(?:2-clause|simplified|freebsd) bsd licen[sc]e|\bbsd[ -]2-clause\b", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:3-clause|new|revised|modified) bsd licen[sc]e|\bbsd[ -]3-clause\b", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd", "bsd", r"\bbsd(?:-style)? licen[sc]e", r"opensource\.org/licenses/bsd"),
    ("mpl-2.0", "mozilla|mpl-2|mpl 2|mpl2|mplv2|mpl v2", r"mozilla public licen[sc]e,? ?v(?:ersion)?\.? ?2\.0|\bmpl(?: ?v|-)? ?2\.0\b", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"mozilla\.org/mpl"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", r"eclipse\.org/(?:legal/epl|org/documents/epl)"),
    ("eupl", "european union public", r"european union public licen[sc]e", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cddl", "common development", r"common development and distribution licen[sc]e", r"opensource\.org/licenses/cddl"),
    ("cecill", "cecill", r"cecill(?:-[abc])?(?: licen[sc]e)?", r"cecill\.info"),
    ("artistic", "artistic", r"artistic licen[sc]e", r"opensource\.org/licenses/artistic"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[sc]e", r"opensource\.org/licenses/zlib"),
    ("boost", "boost", r"boost software licen[sc]e", r"boost\.org/license"),
    ("unlicense", "unlicense", r"\bthe unlicense\b", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", r"wtfpl\.net"),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", r"scripts\.sil\.org/ofl"),
    ("odbl", "open database", r"open database licen[sc]e", r"opendatacommons\.org/licenses/odbl"),
    ("cc0", "cc0", r"\bcc0(?:[ -]1\.0)?\b", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", "-nc-nd|attribution-non", r"\bcc[ -]by-nc-nd\b|attribution-noncommercial-noderiv\w*", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "-nc-sa|attribution-non", r"\bcc[ -]by-nc-sa\b|attribution-noncommercial-sharealike", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", "by-nc|attribution-noncommercial", r"\bcc[ -]by-nc\b|attribution-noncommercial", r"creativecommons\.org/licenses/by-nc"),
    ("cc-by-sa", "by-sa|attribution-share|attribution share", r"\bcc[ -]by-sa\b|attribution[ -]share ?alike", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nd", "by-nd|attribution-nod", r"\bcc[ -]by-nd\b|attribution-noderiv\w*", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by", "cc by|cc-by|creative commons", r"\bcc[ -]by\b(?!-(?:nc|nd|sa)\b)|creative commons attribution(?!-)", r"creativecommons\.org/licenses/by/"),
    ("cc", "creative commons", r"creative commons(?: licen[sc]e)?", r"creativecommons\.org"),
)
#: Phrase form around a name, priority, confidence.
FORMS = (
    ("spdx", r"spdx-license-identifier:[ \t]*(?:{name}|{label}(?:-only|-or-later)?)", 90, 1.0),
    ("granted", r"(?:licen[sc]ed|released|distributed|made available|published|provided|covered) (?:by|under)(?: the)?(?: terms of)?(?: (?:a|the))? (?:{name})", 80, 0.95),
    ("governed", r"(?:subject to|governed by|under|pursuant to|according to)(?: the)? (?:terms (?:and conditions )?of )?(?:the )?(?:{name})", 70, 0.85),
    ("address", r"(?:https?://)?(?:www\.)?(?:{address})\S*", 60, 0.9),
    ("copy", r"(?:copy of|see|read) the (?:{name})", 50, 0.75),
    ("header", r"(?m:^[ \t#*/;-]*(?:the )?(?:{name})[ \t,.:;*/]*$)", 40, 0.7),
    ("name", r"(?:{name})", 20, 0.6),
)
#: Rules that are no licence name: label, keyword, expression, priority, confidence.
PHRASES = (
    ("reserved", "rights reserved", r"all rights reserved", 30, 0.8),
    ("reserved", "some rights", r"some rights reserved", 30, 0.5),
    ("copyright", "copyright", r"copyright (?:\(c\)|©|by)? ?\d{4}", 25, 0.6),
    ("copyright", "©", r"© ?\d{4}", 25, 0.6),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 35, 0.8),
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 75, 1.0),
    ("isc", "permission to use", r"permission to use, copy, modify, and/or distribute this software for any purpose", 75, 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms", 75, 0.95),
    ("proprietary", "proprietary and|and proprietary", r"proprietary and confidential|confidential and proprietary", 45, 0.8),
    ("no-redistribution", "not be copied|not be reproduced|not be redistributed", r"(?:may|must) not be (?:copied|reproduced|redistributed)", 45, 0.7),
    ("no-warranty", "without warrant", r"without warranties or conditions of any kind|without warranty of any kind", 15, 0.4),
)
#: Grants of the GNU licences: label, what stands before "general public", version.
GNU_GRANTS = (("gpl-2.0", "", "2"), ("gpl-3.0", "", "3"), ("lgpl-2.0", "(?:lesser|library) ", "2"), ("lgpl-2.1", "(?:lesser|library) ", "2\\.1"), ("lgpl-3.0", "(?:lesser|library) ", "3"), ("agpl-3.0", "affero ", "3"))
#: Identifiers of the SPDX list that are no family's name, with the family's label where there is one.
IDENTIFIERS = (
    ("0bsd", "0bsd"), ("afl-3.0", "afl-3.0"), ("apache-1.0", "apache"), ("apache-1.1", "apache-1.1"), ("artistic-1.0", "artistic"),
    ("artistic-2.0", "artistic"), ("bsd-2-clause-patent", "bsd-2-clause"), ("bsd-4-clause", "bsd"), ("bsl-1.0", "boost"), ("busl-1.1", "busl-1.1"),
    ("cddl-1.0", "cddl"), ("cddl-1.1", "cddl"), ("epl-1.0", "epl"), ("epl-2.0", "epl"), ("eupl-1.1", "eupl"), ("eupl-1.2", "eupl"),
    ("gfdl-1.1", "gfdl"), ("gfdl-1.2", "gfdl"), ("gfdl-1.3", "gfdl"), ("mit-0", "mit-0"), ("mpl-1.0", "mpl"), ("mpl-1.1", "mpl"), ("ms-pl", "ms-pl"),
    ("ms-rl", "ms-rl"), ("odbl-1.0", "odbl"), ("ofl-1.0", "ofl"), ("ofl-1.1", "ofl"), ("osl-3.0", "osl-3.0"), ("psf-2.0", "psf-2.0"),
    ("sspl-1.0", "sspl-1.0"), ("upl-1.0", "upl-1.0"),
)
#: Grants that name a licence by a short name: label, short name.
SHORT_NAMES = (("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("bsd", "bsd"), ("apache", "apache"))
#: Sentences of licence texts: label, keyword, expression.
SENTENCES = (
    ("boost", "person or organization obtaining", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    ("zlib", "without any express or implied warranty", r"this software is provided .as-is., without any express or implied warranty"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("cc0", "waived all copyright", r"waived all copyright and related or neighbou?ring rights"),
    ("bsd-3-clause", "neither the name", r"neither the names? of [^.]{1,120} may be used to endorse or promote products"),
    ("mpl", "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("gfdl", "modify this document", r"permission is granted to copy, distribute and/or modify this document"),
    ("artistic", "standard version", r"distribute verbatim copies of the source form of the standard version"),
    ("wtfpl", "you just do what", r"you just do what the \w+ you want to"),
    ("epl", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("gpl", "is free software", r"this program is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "is free software", r"this library is free software[:;,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
)


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    confidence: float


def spaced(expression: str) -> str:
    """The expression with every literal space as white space of any length: phrases are wrapped at line ends. A character class
    with a space is left as it is, but for those that stand for the space inside a name."""
    out, at = [], 0
    while at < len(expression):
        char = expression[at]
        if char == "\\":
            out.append(expression[at : at + 2])
            at += 2
            continue
        if char == "[":
            close = expression.index("]", at + 2)
            block = expression[at : close + 1]
            out.append(r"(?:\s++|-)" if block == "[ -]" else block)
            at = close + 1
            continue
        optional = expression[at : at + 2] == " ?"
        # Possessive: long runs of white space are passed once.
        out.append(r"\s*+" if optional else r"\s++" if char == " " else char)
        at += 1 + optional
    return "".join(out)


def rules() -> tuple[Rule, ...]:
    """All rules in order of number."""
    made = []
    for label, keyword, name, address in FAMILIES:
        for form, shape, priority, confidence in FORMS:
            pattern = re.compile(spaced(shape.format(name=name, label=re.escape(label), address=address)))
            host = re.match(r"[a-z.]+", address.replace("\\", ""))[0]
            word = {"spdx": "spdx-license", "address": host}.get(form, keyword)
            made.append((label, word, pattern, priority, confidence))
    made += [(label, keyword, re.compile(spaced(shape)), priority, confidence) for label, keyword, shape, priority, confidence in PHRASES]
    for label, kind, version in GNU_GRANTS:
        grant = rf"(?:gnu )?{kind}general public licen[sc]e,? as published by the free software foundation[;,:]?(?: either)? version {version}(?:\.0)?(?!\.?\d)(?: of the licen[sc]e)?"
        made.append((label, "as published by", re.compile(spaced(grant)), 85, 1.0))
    for identifier, label in IDENTIFIERS:
        made.append((label, identifier, re.compile(rf"(?<![\w.-]){re.escape(identifier)}(?![\w-]|\.\w)"), 65, 0.85))
    for label, name in SHORT_NAMES:
        gates = "|".join(f"under {article}{name}" for article in ("", "the ", "an ", "a "))
        grant = rf"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:(?:the|an?) )?{name}\b(?!-)"
        made.append((label, gates, re.compile(spaced(grant)), 22, 0.8))
    made += [(label, keyword, re.compile(spaced(shape)), 76, 0.95) for label, keyword, shape in SENTENCES]
    return tuple(Rule(number, *rest) for number, rest in enumerate(made))


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) that stand, by start."""
    kept: list[tuple[int, int, Rule]] = []
    # Accepted intervals that lie in no other one: both their starts and their ends ascend, so one search finds what holds an interval.
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].number)):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low:high], ends[low:high] = [start], [end]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].number))


class Scanner:
    """detect(text): detections in a text whose A-Z are lower case already."""

    def __init__(self):
        self.by_keyword: dict[str, list[Rule]] = {}
        for rule in rules():
            for keyword in rule.keyword.split("|"):
                self.by_keyword.setdefault(keyword, []).append(rule)

    def detect(self, text: str) -> list[tuple[int, int, Rule]]:
        # Keywords hold single spaces; the text they are looked up in holds those only, too.
        plain = " ".join(text.split())
        due = {rule.number: rule for keyword, group in self.by_keyword.items() if keyword in plain for rule in group}
        found = [(*match.span(), rule) for rule in due.values() for match in rule.pattern.finditer(text)]
        return resolve(found)


#: UTF-8 bytes of ASCII characters that are no word characters, to a space.
_NO_WORD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def base_places(text: str) -> list[tuple[int, str]]:
    """(first word, label) of every base phrase in a text whose A-Z are lower case already."""
    phrases = [(phrase.split(), label) for phrase, label in BASE]
    if not any(all(word in text for word in words) for words, _ in phrases):
        return []
    found, words = [], WORD.findall(text)
    for phrase, label in phrases:
        size = len(phrase)
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at : at + size] == phrase:
                    found.append((at, label))
        except ValueError:
            pass
    return found


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (label, start, end, rule, confidence).

    Offsets of detections are code points of the whole text. The score is 1 - product of (1 - confidence) over the distinct
    labels' best detections; 0 without any. Null and empty texts have no words and no labels. Nulls in doc_id stay.
    """

    def scan(batches):
        import pyarrow as pa

        scanner = Scanner()
        for batch in batches:
            out = {name: [] for name in OUT.names}
            for doc_id, text in texts([batch], ["doc_id", "text"], 200):
                low = (text or "").translate(ASCII_LOWER) if text and not text.islower() else text or ""
                base = base_places(low)
                found = scanner.detect(low)
                best: dict[str, float] = {label: 0.6 for _, label in base}
                for _, _, rule in found:
                    best[rule.label] = max(best.get(rule.label, 0.0), rule.confidence)
                miss = 1.0
                for label in sorted(best):
                    miss *= 1 - best[label]
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(low.encode().translate(_NO_WORD).split()))
                out["n_base"].append(len(base))
                out["first_word"].append(min((at for at, _ in base), default=None))
                out["last_word"].append(max((at for at, _ in base), default=None))
                out["base_labels"].append(",".join(sorted({label for _, label in base})))
                out["labels"].append(",".join(sorted(best)))
                out["score"].append(1 - miss)
                out["detections"].append([{"label": r.label, "start": a, "end": b, "rule": r.number, "confidence": r.confidence} for a, b, r in found])
            yield pa.RecordBatch.from_pydict(out, schema=OUT)

    import pyarrow as pa

    DETECTION = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int32()), ("confidence", pa.float64())])
    OUT = pa.schema(
        [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(DETECTION))]
    )
    return docs.select("doc_id", "text").mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "detections array<struct<label: string, start: long, end: long, rule: int, confidence: double>>",
    )
