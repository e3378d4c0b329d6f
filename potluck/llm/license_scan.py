"""License detection by ordered signature rules.

A text is reduced to its words (A-Z lower-cased; runs of digits, letters and anything
beyond ASCII) joined by one space, so a rule never sees punctuation or line breaks. Rules
are regular expressions over that form, each with a label, a priority and a gate that every
match passes: a keyword, and sets of words of each of which the text must hold one. A rule's
expression runs only in texts that pass its gate. A detection that lies inside another one of
a higher priority, or of the same priority and more words, or that covers the same words as
one of an earlier rule, is suppressed; what is left gives the labels.

Rules come from three lists, in order of priority: base phrases (never suppressed), known
passages of license texts, and license names in the contexts of ``CONTEXTS``.

Defined cases: null and empty texts have no words and no labels; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from potluck.llm.common import doc_input
from potluck.llm.words import text_buffers

BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# label, SPDX words, name in running text
NAMES = [
    ("mit", "mit", r"(?:mit|expat|x11)"),
    ("mit-0", "mit 0", r"mit (?:0|no attribution)"),
    ("apache-2", "apache 2 0", r"apache (?:software )?(?:licen[cs]e )?(?:version |v)?2(?: 0)?"),
    ("apache-1.1", "apache 1 1", r"apache (?:software )?(?:licen[cs]e )?(?:version |v)?1 1"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd 3 clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd 4 clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("0bsd", "0bsd", r"(?:0bsd|zero clause bsd|bsd 0 clause)"),
    ("bsd", "bsd", r"(?:bsd|berkeley software distribution)"),
    ("gpl-1", "gpl 1 0", r"(?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?1(?: 0)?"),
    ("gpl-2", "gpl 2 0", r"(?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?2(?: 0)?"),
    ("gpl-3", "gpl 3 0", r"(?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu (?:gpl|general public)|gplv?|general public)"),
    ("lgpl-2.1", "lgpl 2 1", r"(?:gnu )?(?:lgpl|lesser general public licen[cs]e) ?(?:version |v)?2 1"),
    ("lgpl-3", "lgpl 3 0", r"(?:gnu )?(?:lgpl|lesser general public licen[cs]e) ?(?:version |v)?3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?(?:lgpl|lesser general public|library general public)"),
    ("agpl-3", "agpl 3 0", r"(?:gnu )?(?:agpl|affero general public licen[cs]e) ?(?:version |v)?3(?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?(?:agpl|affero general public)"),
    ("gfdl", "gfdl 1 3", r"(?:gnu )?(?:fdl|gfdl|free documentation)"),
    ("mpl-1.1", "mpl 1 1", r"(?:mpl|mozilla public licen[cs]e) ?(?:version |v)?1 1"),
    ("mpl-2", "mpl 2 0", r"(?:mpl|mozilla public licen[cs]e) ?(?:version |v)?2(?: 0)?"),
    ("mpl", "mpl", r"(?:mpl|mozilla public)"),
    ("epl-1", "epl 1 0", r"(?:epl|eclipse public licen[cs]e) ?(?:version |v)?1(?: 0)?"),
    ("epl-2", "epl 2 0", r"(?:epl|eclipse public licen[cs]e) ?(?:version |v)?2(?: 0)?"),
    ("epl", "epl", r"(?:epl|eclipse public)"),
    ("cddl", "cddl 1 0", r"(?:cddl|common development and distribution)"),
    ("cpl", "cpl 1 0", r"(?:cpl|common public)"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"(?:zlib(?: libpng)?|libpng)"),
    ("boost", "bsl 1 0", r"boost(?: software)?"),
    ("artistic-1", "artistic 1 0", r"artistic (?:licen[cs]e )?(?:version |v)?1(?: 0)?"),
    ("artistic-2", "artistic 2 0", r"artistic (?:licen[cs]e )?(?:version |v)?2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("unlicense", "unlicense", r"(?:the )?unlicen[cs]e"),
    ("wtfpl", "wtfpl", r"(?:wtfpl|do what the fuck you want to public)"),
    ("cc0", "cc0 1 0", r"(?:cc0|cc zero|creative commons (?:zero|0))"),
    ("cc-by", "cc by 4 0", r"(?:cc by|creative commons attribution)(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa 4 0", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd 4 0", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives|ative works))(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc 4 0", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa 4 0", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd 4 0", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))(?: [1-4] [05])?"),
    ("odbl", "odbl 1 0", r"(?:odbl|open (?:data commons open )?database)"),
    ("odc-by", "odc by 1 0", r"(?:odc by|open data commons attribution)"),
    ("pddl", "pddl 1 0", r"(?:pddl|public domain dedication and)"),
    ("ofl", "ofl 1 1", r"(?:sil )?(?:ofl|open font)"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python", "python 2 0", r"(?:psf|python software foundation)"),
    ("php", "php 3 01", r"php"),
    ("ruby", "ruby", r"ruby"),
    ("openssl", "openssl", r"openssl"),
    ("eupl", "eupl 1 2", r"(?:eupl|european union public)"),
    ("ms-pl", "ms pl", r"(?:ms pl|microsoft public)"),
    ("ms-rl", "ms rl", r"(?:ms rl|microsoft reciprocal)"),
    ("upl", "upl 1 0", r"(?:upl|universal permissive)"),
    ("bsl-business", "busl 1 1", r"(?:busl|business source)"),
    ("sspl", "sspl 1 0", r"(?:sspl|server side public)"),
    ("elastic", "elastic 2 0", r"elastic"),
    ("llama", "llama2", r"llama(?: [23])? community"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?open ?rail(?: m)?"),
]

# context of a name: expression, priority, keyword, words of which a match holds one
CONTEXTS = [
    (r"spdx license identifier {spdx}(?: only| or later)?", 80, "spdx license", ""),
    (r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|redistributed|shared) "
     r"(?:it )?(?:under|by|as) (?:a |the |an )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?"
     r"{name}(?: (?:public )?licen[cs]e)?(?: (?:version |v)?\d(?: \d)?)?", 70, "",
     "licensed licenced released distributed published available provided covered redistributed shared"),
    (r"(?:subject to|governed by|under|see|agree to) (?:the )?(?:terms of (?:the )?)?{name} (?:public )?licen[cs]e", 60, "licen", ""),
    (r"{name} licen[cs]e(?:d)?(?: (?:version |v)?\d(?: \d)?)?", 50, "licen", ""),
    (r"licen[cs]e(?:d)?(?: is| type| name)? (?:the )?{name}", 40, "licen", ""),
]

# known passages: label, expression, keyword
PASSAGES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied", "provided as is"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "any purpose"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "source and binary"),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors", "neither the name"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising materials"),
    ("apache-2", r"you may not use this file except in compliance with the licen[cs]e", "except in compliance"),
    ("apache-2", r"www apache org licenses license 2 0", "apache org"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "free software"),
    ("gpl-2", r"either version 2 of the licen[cs]e or at your option any later version", "version 2 of"),
    ("gpl-3", r"either version 3 of the licen[cs]e or at your option any later version", "version 3 of"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "library is free"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form"),
    ("epl", r"this program and the accompanying materials are made available under", "accompanying materials"),
    ("cddl", r"the contents of this file are subject to the terms of the common development", "contents of this file"),
    ("zlib", r"this software is provided as is without any express or implied warranty", "provided as is"),
    ("boost", r"boost org license 1 0", "boost org"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies", "verbatim or modified"),
    ("public-domain", r"(?:dedicated|placed|released|put) (?:in|in to|into|to) the public domain", "public domain"),
    ("public-domain", r"no copyright reserved|no rights reserved", "reserved"),
    ("proprietary", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"(?:proprietary and )?confidential(?: and proprietary)? (?:information|material)", "confidential"),
    ("proprietary", r"may not be (?:reproduced|copied|distributed|redistributed) (?:or \w+ )?without (?:the )?(?:prior )?(?:written )?permission",
     "without"),
    ("non-commercial", r"for (?:non ?commercial|personal|academic|research) use only", "use only"),
    ("cc-by", r"creativecommons org licenses by 4 0", "creativecommons"),
    ("cc-by-sa", r"creativecommons org licenses by sa", "creativecommons"),
    ("cc-by-nc", r"creativecommons org licenses by nc(?! (?:sa|nd))", "creativecommons"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa", "creativecommons"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd", "creativecommons"),
    ("cc-by-nd", r"creativecommons org licenses by nd", "creativecommons"),
    ("cc0", r"creativecommons org publicdomain zero", "creativecommons"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern
    words: tuple[frozenset[bytes], ...] = ()


def forms(expression: str) -> list[str]:
    """All texts that a name's expression matches."""
    def walk(parsed) -> list[str]:
        out = [""]
        for op, arg in parsed:
            kind = str(op)
            if kind == "LITERAL":
                parts = [chr(arg)]
            elif kind == "IN":
                parts = [chr(c) for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
            elif kind == "SUBPATTERN":
                parts = walk(arg[3])
            elif kind == "BRANCH":
                parts = [f for branch in arg[1] for f in walk(branch)]
            elif kind == "MAX_REPEAT" and arg[:2] == (0, 1):
                parts = ["", *walk(arg[2])]
            else:
                raise ValueError(f"{kind} in the name {expression}")
            out = [x + y for x in out for y in parts]
        return out
    return walk(_parser.parse(expression))


def cover(expression: str) -> frozenset[bytes]:
    """Words of which every match of a name holds one; a name stands between spaces in all contexts."""
    left = [set(f.split()) for f in forms(expression)]
    every, chosen = list(left), []
    while left:
        held = Counter(w for f in left for w in f)
        chosen.append(max(held, key=lambda w: (not w.isdigit(), held[w], len(w), w)))
        left = [f for f in left if chosen[-1] not in f]
    for word in list(chosen):
        if all(f & (set(chosen) - {word}) for f in every):
            chosen.remove(word)
    return frozenset(w.encode() for w in chosen)


def build_rules() -> list[Rule]:
    """All rules, highest priority first."""
    whole = lambda x: re.compile(rb"(?<![^ ])(?:" + x.encode() + rb")(?![^ ])")
    rules = [Rule(label, 100, phrase.encode(), whole(re.escape(phrase).replace(r"\ ", " "))) for phrase, label in BASE]
    rules += [Rule(label, 90, key.encode(), whole(x)) for label, x, key in PASSAGES]
    for label, spdx, name in NAMES:
        for context, priority, key, words in CONTEXTS:
            gate = [cover(spdx if "{spdx}" in context else name), *([frozenset(words.encode().split())] if words else [])]
            rules.append(Rule(label, priority, key.encode(),
                              whole(context.replace("{spdx}", spdx).replace("{name}", name)), tuple(gate)))
    return sorted(rules, key=lambda r: -r.priority)


RULES = build_rules()
_KEYWORDS = {r.keyword for r in RULES}
_WORD_SETS = {s for r in RULES for s in r.words}
_LOWER = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass
class Detection:
    label: str
    priority: int
    start: int
    end: int
    order: int = 0               # of the rule


def reduced(text: bytes) -> bytes:
    """The words of a text joined by one space."""
    return b" ".join(text.translate(_LOWER).split())


def detect(text: bytes) -> list[Detection]:
    """Detections in a reduced text that no other one suppresses, in order of position."""
    own = set(text.split(b" "))
    present = {k for k in _KEYWORDS if k in text}
    held = {s for s in _WORD_SETS if not s.isdisjoint(own)}
    found = [Detection(r.label, r.priority, m.start(), m.end(), i)
             for i, r in enumerate(RULES) if r.keyword in present and held.issuperset(r.words)
             for m in r.pattern.finditer(text)]
    return suppress(found)


def suppress(found: list[Detection]) -> list[Detection]:
    """Drop detections inside another one that comes before: by priority, length, rule."""
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d.priority, d.start - d.end, d.order, d.start)):
        inside = any(k.start <= d.start and d.end <= k.end for k in kept)
        if d.priority == 100 or not inside:
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end, d.order))


def base_places(text: bytes) -> tuple[list[int], set[str]]:
    """Word positions of all base phrases in a reduced text, and their labels."""
    padded, places, labels = b" " + text + b" ", [], set()
    for phrase, label in BASE:
        needle = f" {phrase} ".encode()
        at = padded.find(needle)
        while at >= 0:
            places.append(padded.count(b" ", 0, at))
            labels.add(label)
            at = padded.find(needle, at + 1)
    return places, labels


FIELDS = [("doc_id", T.LongType(), pa.int64()), ("n_words", T.LongType(), pa.int64()),
          ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()),
          ("last_word", T.LongType(), pa.int64()), ("base_labels", T.StringType(), pa.string()),
          ("labels", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())]
_DETECTION = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()),
                                 ("n_words", pa.int64())]))


def scan(text: bytes) -> dict:
    """All results of one text."""
    text = reduced(text)
    places, base = base_places(text)
    hits = detect(text)
    labels = sorted(base | {d.label for d in hits})
    return {"n_words": text.count(b" ") + 1 if text else 0, "n_base": len(places),
            "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(labels),
            "score": max((d.priority / 100 for d in hits), default=0.0),
            "detections": [{"label": d.label, "priority": d.priority, "first_word": text.count(b" ", 0, d.start),
                            "n_words": text.count(b" ", d.start, d.end) + 1} for d in hits]}


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        found = [scan(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        out = {"doc_id": batch.column("doc_id")}
        for name, _, kind in FIELDS[1:]:
            out[name] = pa.array([f[name] for f in found], kind)
        out["detections"] = pa.array([f["detections"] for f in found], _DETECTION)
        yield pa.RecordBatch.from_pydict(out)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score and detections (label, priority, first_word, n_words)."""
    detection = T.StructType([T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType()),
                              T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
    schema = T.StructType([*[T.StructField(n, t) for n, t, _ in FIELDS],
                           T.StructField("detections", T.ArrayType(detection))])
    return doc_input(docs, id_col, text_col).mapInArrow(_scan_batches, schema)
