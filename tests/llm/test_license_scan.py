from __future__ import annotations

import re
from re import _parser

from potluck.llm.license_scan import BASE, RULES, Detection, detect, license_scan, reduced, scan, suppress

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    "Licensed under CC BY-NC 4.0.", "under the MIT License under the mit license", "Unter the MIT-License",
    "Licensed under the Apache License, Version 2.0 (the License)", "apache license version 2.0 cc by nc cc-by-nc-sa",
    "é under the MIT license é", "plain words", "SPDX-License-Identifier: GPL-3.0-or-later", "cc by ncx", "xcc by nc",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
]


def test_base_against_brute_force(make_docs, edge_rows):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)] + [r[:2] for r in edge_rows if r[0] is not None]
    got = {r.doc_id: r for r in license_scan(make_docs(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_labels():
    labels = {t: scan(t.encode())["labels"] for t in TEXTS}
    assert labels["SPDX-License-Identifier: GPL-3.0-or-later"] == "gpl-3"
    assert labels["plain words"] == labels["cc by ncx"] == ""
    assert labels[TEXTS[10]] == "gpl"
    assert scan(b"released under the terms of the GNU Lesser General Public License v2.1")["labels"] == "lgpl-2.1"


def test_keywords_never_hide_a_match():
    texts = [reduced(t.encode()) for t in TEXTS] + [reduced(f"see the {n} license".encode()) for n in ("MIT", "ISC", "BSD", "Artistic 2.0")]
    for text in texts:
        every = [Detection(r.label, r.priority, m.start(), m.end(), i) for i, r in enumerate(RULES) for m in r.pattern.finditer(text)]
        assert detect(text) == suppress(every)


def least(parsed):
    """The matches of an expression without any optional part."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            parts = [chr(arg)]
        elif kind == "IN":
            parts = [{"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: "1"}[str(k)](v) for k, v in arg]
        elif kind == "SUBPATTERN":
            parts = least(arg[3])
        elif kind == "BRANCH":
            parts = [x for branch in arg[1] for x in least(branch)]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            parts = [x * arg[0] for x in least(arg[2])] if arg[0] else [""]
        elif kind == "ANY":
            parts = ["x"]
        else:
            assert kind in ("ASSERT", "ASSERT_NOT")
            parts = [""]
        out = [x + y for x in out for y in parts]
    return out


def test_every_rule_runs_on_its_least_matches():
    for i, r in enumerate(RULES):
        for x in least(_parser.parse(r.pattern.pattern.decode())):
            text = x.encode()
            assert r.pattern.search(text), (r, x)
            every = [Detection(o.label, o.priority, m.start(), m.end(), k) for k, o in enumerate(RULES)
                     for m in o.pattern.finditer(text)]
            assert i in [d.order for d in every] and detect(text) == suppress(every), (r, x)


def test_names_without_the_word_licence():
    found = {t: scan(t.encode())["labels"] for t in (
        "released under the GPL v3", "distributed under the BSD", "available under CC BY-SA 4.0", "shared under GPLv2")}
    assert list(found.values()) == ["gpl-3", "bsd", "cc-by-sa", "gpl-2"]
    assert scan(b"released under the GPL v3")["score"] == 0.7


def test_suppression():
    inner, outer, beside = Detection("a", 50, 5, 9), Detection("b", 60, 0, 10), Detection("c", 50, 8, 20)
    assert suppress([inner, beside, outer]) == [outer, beside]
    assert suppress([Detection("a", 60, 5, 9), Detection("b", 50, 0, 10)]) == [Detection("b", 50, 0, 10), Detection("a", 60, 5, 9)]
    base = Detection("mit", 100, 2, 4)
    assert base in suppress([base, Detection("mit", 100, 0, 10)])


def test_rules_are_many_and_empty_table(make_docs):
    assert len(RULES) > 200 and license_scan(make_docs([])).collect() == []
