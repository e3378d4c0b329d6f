from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from potluck.llm.substring_dedup import GROUP, factors, substring_dedup

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, ws in split:
        for a in range(len(ws) - window + 1):
            key = tuple(ws[a:a + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for a in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[a:a + window])] < i:
                gone.update(range(a, a + window))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_edge_cases_against_brute_force(make_docs, edge_rows):
    assert result(substring_dedup(make_docs(edge_rows))) == brute([r[:2] for r in edge_rows])


def test_empty_table(make_docs):
    assert substring_dedup(make_docs([])).collect() == []


def test_passages_across_groups_and_factor_borders(make_docs, words_pool):
    rng = random.Random(3)
    passages = [rng.choices(words_pool, k=rng.randint(10, 40)) for _ in range(12)]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 8)
            ws += rng.choices(words_pool, k=rng.randint(0, 6)) + p[a:] + (p[:5] if rng.random() < .3 else [])
        rows.append((i * (GROUP // 7) - 2000, rng.choice([" ", "\n ", "\t"]).join(ws)))
    assert result(substring_dedup(make_docs(rows))) == brute(rows)


def test_few_words_repeat_often(make_docs):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    assert result(substring_dedup(make_docs(rows))) == brute(rows)


def test_factors_and_kept_text(make_docs, words_pool):
    passage = " ".join(words_pool[:30])
    rows = [(1, f"x1 x2 {passage} x3"), (2, f"y1\n{passage}   y2 y3"), (3, "left  as\tit is")]
    got = {r.doc_id: r for r in substring_dedup(make_docs(rows), carry=["lang", "source"], with_text=True).collect()}
    assert got[2].kept_text == "y1 y2 y3"
    assert [f.asDict() for f in got[2].factors] == [{"start": 1, "length": 30, "ref_doc": 1}]
    assert got[3].kept_text == "left  as\tit is" and got[1].factors == []
    assert got[1].carry.lang is None


def test_factor_borders():
    import numpy as np
    hit = np.array([0, 1, 1, 1, 0, 1], bool)
    assert [(f["start"], f["length"], f["ref_doc"]) for f in factors(np.array([0, 4, 4, 7, 0, 7]), hit, 13)] == [
        (1, 14, 4), (3, 13, 7), (5, 13, 7)]
