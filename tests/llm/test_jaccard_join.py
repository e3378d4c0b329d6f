from __future__ import annotations

import random
import re
from itertools import combinations

from potluck.llm import jaccard_join as J

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[a:a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """{doc_id: (class_id, n_links)} for rows with distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    group, links = {i: i for i in sets}, dict.fromkeys(sets, 0)
    linked = [(a, b) for a, b in combinations(sorted(sets), 2)
              if sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return {i: (group[i], links[i]) for i in sets}


def result(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def edited(words, pool, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(pool)
    return " ".join(words)


def corpus(pool, rng, n=150):
    bases = [rng.choices(pool, k=rng.randint(3, 150)) for _ in range(25)]
    return [(i, edited(rng.choice(bases), pool, rng, rng.choice([0, 0, 1, 1, 2, 3, 5]))) for i in range(n)]


def test_against_brute_force(make_docs, words_pool):
    rows = corpus(words_pool, random.Random(2))
    assert result(J.jaccard_join(make_docs(rows))) == brute(rows)


def test_large_nodes_are_cut_into_blocks(make_docs, words_pool, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(4)
    base = rng.choices(words_pool, k=120)
    rows = [(i, edited(base, words_pool, rng, rng.randint(0, 3))) for i in range(70)] + corpus(words_pool, rng, 30)[:0]
    assert result(J.jaccard_join(make_docs(rows))) == brute(rows)


def test_edge_cases(make_docs, edge_rows):
    got = J.jaccard_join(make_docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by_id = {r.doc_id: r for r in got}
    distinct = {i: t for i, t, *_ in edge_rows if i is not None}
    for i, (group, links) in brute(distinct.items()).items():
        assert by_id[i].class_id == group and by_id[i].n_links == links
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 2 and all(r.class_id is None and r.n_links == 0 for r in nulls)


def test_repeated_rows_count_once(make_docs, words_pool, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(8)
    base = rng.choices(words_pool, k=100)
    rows = [(1, " ".join(base)), (2, edited(base, words_pool, rng, 1)), (3, " ".join(rng.choices(words_pool, k=50)))]
    expected = brute(rows)
    assert expected[1] == expected[2] == (1, 1)
    got = J.jaccard_join(make_docs(rows + [rows[0]] * 20 + [rows[1]] * 3)).collect()
    assert len(got) == 26 and all((r.class_id, r.n_links) == expected[r.doc_id] for r in got)


def test_rows_of_one_id_with_other_texts(make_docs, words_pool):
    rng = random.Random(6)
    a, b = (" ".join(rng.choices(words_pool, k=40)) for _ in range(2))
    got = J.jaccard_join(make_docs([(3, b), (7, a), (7, b), (9, a + " tail")])).collect()
    assert sorted((r.doc_id, r.copy_class, r.class_id, r.n_links) for r in got) == [
        (3, 3, 3, 1), (7, 3, 3, 1), (7, 7, 7, 1), (9, 9, 7, 1)]


def test_empty_table(make_docs):
    assert J.jaccard_join(make_docs([])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + rng.randint(1, 30)) for _ in range(40)] + [(300, 7), (5, 5)]
    got = {r.id: r.root for r in J.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[300] == 0
    assert all(v == 100 for k, v in got.items() if 100 < k < 140)


def test_depth_shortens_until_recall():
    assert J.depth_for(0.8, 0.9999) == 4 and J.depth_for(0.99, 0.9999) == J.DEPTH
    assert J.depth_for(0.8, 0.999999) < 4
