from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from potluck.llm import spotsigs as S


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        out.append(t[:len(t) - half] + texts[(i + 1) % len(texts)][:half])
    return out


def brute_set(text, anchors=frozenset(S.ANCHORS)):
    """Signatures as tuples of words."""
    import regex
    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
    at = lambda i: tuple(x for x in w[i + 1:i + 1 + S.REACH] if x not in anchors)[:S.CHAIN]
    found = [(w[i], at(i)) for i in range(len(w)) if w[i] in anchors and at(i)]
    if len(found) < S.FEW:
        found = [(w[i], at(i)) for i in range(len(w))]
    return frozenset(found) if found else frozenset([text] if text else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(make_docs, words_pool):
    import random
    rng = random.Random(6)
    pool = words_pool[:300] + S.ANCHORS * 3
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 90))) for _ in range(80)] + ["", "É été, the END. of IT"]
    rows = [(i * 300 - 900, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in S.spotsigs(make_docs(rows)).collect()}
    for (i, t), e, following in zip(rows, edited(texts), texts[1:] + texts[:1]):
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(brute_set(t))
        for ours, other in ((r.near_edited, e), (r.near_next, following)):
            exact = jaccard(brute_set(t), brute_set(other))
            assert abs(ours - exact) < 1e-9 or (ours == 0 and exact < S.FLOOR)


def test_edge_cases(make_docs, edge_rows):
    got = S.spotsigs(make_docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    known = sorted([(i, t or "") for i, t, *_ in edge_rows if i is not None and i != 9])
    by_id = {r.doc_id: r for r in got}
    for i, t in known:
        assert by_id[i].n_chars == len(t)
    ids = [i for i, _ in known]
    texts = dict(known)
    for a, b in zip(ids, ids[1:]):
        if b - a == 1:
            t, half = texts[a], len(texts[a]) // 2
            assert by_id[a].edited == t[:len(t) - half] + texts[b][:half]
    assert by_id[2].fingerprint == "" == by_id[3].fingerprint and by_id[2].near_next == 1.0
    assert by_id[1].fingerprint == by_id[5].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_single_row_and_empty_table(make_docs):
    (one,) = S.spotsigs(make_docs([(5, "the cat and the dog")])).collect()
    assert one.edited == "the cat and" [:10] + "the cat a" and one.near_next == 1.0
    assert S.spotsigs(make_docs([])).collect() == []


def test_no_python_in_the_plan(make_docs):
    plan = S.spotsigs(make_docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_likeness_prunes_by_length(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("a"), F.sequence(F.lit(1), F.lit(3)).alias("b"),
                               F.array().cast("array<int>").alias("c"))
    r = df.select(S.likeness("a", "b").alias("far"), S.likeness("a", "a").alias("same"),
                  S.likeness("b", "c").alias("one_empty"), S.likeness("c", "c").alias("both_empty")).first()
    assert tuple(r) == (0.0, 1.0, 0.0, 1.0)
