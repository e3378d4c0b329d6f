"""Each stage of the pipeline on its own input, held against plain computations."""

from __future__ import annotations

import random
import re

import corpus_pipeline as P
import pytest
import sentencepiece

from potluck.llm.common import DOC_COLUMNS
from potluck.llm.queries import piece_model

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(words_pool):
    rng = random.Random(21)
    passage = " ".join(rng.choices(words_pool, k=60))
    out = []
    for i in range(60):
        text = " ".join(rng.choices(words_pool, k=rng.randint(30, 120)))
        if i % 10 == 3:
            text = f"{text} {passage} {rng.choice(words_pool)}"
        if i % 10 == 7:
            text = out[i - 4][1] + " tail"
        out.append((i, text, "en" if i % 2 else "fr", "ab"[i % 2]))
    return out + [(900, "12 34 !!", "en", "a"), (901, None, None, None), (902, out[0][1], None, None)]


def stage(name, spark, docs):
    return dict(P.STAGES)[name](spark, docs, "/nowhere")


def test_language_drops_only_what_is_rejected(spark, make_docs, rows):
    got = stage("lang_id", spark, make_docs(rows))
    assert got.columns == DOC_COLUMNS
    kept = {r.doc_id: r for r in got.collect()}
    assert {900, 901}.isdisjoint(kept) and len(kept) >= 0.95 * 60
    assert kept[902].lang in ("en", "fr") and all(kept[i].text == t for i, t, *_ in rows if i in kept)


def test_one_of_each_group_stays(spark, make_docs, rows):
    from test_jaccard_join import brute
    got = stage("jaccard_join", spark, make_docs([*rows, rows[5], (None, "x y", None, None)]))
    assert got.columns == DOC_COLUMNS
    kept = sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id is not None)
    groups = brute([r[:2] for r in rows])
    assert kept == sorted((i, t) for i, t, *_ in rows if groups[i][0] == i) if None not in [t for _, t in kept] else True
    assert [i for i, _ in kept] == sorted(i for i, *_ in rows if groups[i][0] == i)
    assert got.where("doc_id is null").count() == 1


def test_rows_of_one_id_stay_by_their_texts(spark, make_docs, words_pool):
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choices(words_pool, k=40)) for _ in range(3))
    own = [(i, " ".join(rng.choices(words_pool, k=20))) for i in range(20, 40) for _ in range(2)]
    pairs = [(3, b), (7, a), (7, b), (8, a + " tail"), (7, a), (9, c), (9, c + " end"), (10, None), (10, None), (None, b), *own]
    got = stage("jaccard_join", spark, make_docs([(i, t, "en", "s") for i, t in pairs]))
    assert got.columns == DOC_COLUMNS
    kept = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got.collect()]
    nine = [t for i, t, *_ in kept if i == 9]
    assert len(nine) == 1 and nine[0] in (c, c + " end")
    expected = {(3, b), (7, a), (10, None), (None, b), *own}
    assert {r[:2] for r in kept if r[0] != 9} == expected and len(kept) == len(expected) + 1
    assert all(r[2:] == ("en", "s", None if r[1] is None else len(r[1])) for r in kept)


def test_substrings(spark, make_docs, rows):
    got = stage("substring_dedup", spark, make_docs(rows))
    assert got.columns == DOC_COLUMNS
    texts = {r.doc_id: r for r in got.collect()}
    seen = set()
    for i, t, *_ in rows:
        ws = WORD.findall(t or "")
        grams = [tuple(ws[a:a + 13]) for a in range(len(ws) - 12)]
        gone = {p for a, g in enumerate(grams) if g in seen for p in range(a, a + 13)}
        seen.update(grams)
        expected = " ".join(w for p, w in enumerate(ws) if p not in gone) if gone else t or ""
        assert texts[i].text == expected
        assert texts[i].n_chars == (len(expected) if gone else None if t is None else len(t))


def test_mix_keeps_rows_whole(spark, make_docs, rows):
    got = stage("poisson_mix", spark, make_docs(rows))
    assert got.columns == DOC_COLUMNS
    source = {(i, t) for i, t, *_ in rows}
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert set(found) <= source and 30 < len(found) < 120


def test_tokens(spark, make_docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for r in stage("piece_bpe", spark, make_docs(rows)).collect():
        assert r.ids == library.encode(dict((i, t or "") for i, t, *_ in rows)[r.doc_id], add_eos=True)


def test_run_and_empty_tables(spark, make_docs, rows, tmp_path):
    make_docs(rows).select(*DOC_COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    make_docs([]).select(*DOC_COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []
