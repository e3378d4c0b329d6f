"""Language identification and toxicity: held-out accuracy, and defined edge cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from potluck.llm import lang_id, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.train(docs, lang_id.fold("doc_id", 4) != 2)
    got = {r.doc_id: r for r in lang_id.identify(docs, model).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in got.values()) / len(got) < 0.01
    assert model.langs == ["de", "en", "es", "fr"]


def test_language_edge_cases(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    model = lang_id.train(docs, lang_id.fold("doc_id", 4) != 9)
    got = lang_id.identify(docs, model, carry=["grp"], keep_text=True).collect()
    assert len(got) == len(edge_rows) and all(r.carry.grp == "x" for r in got)
    by_id = {r.doc_id: r for r in got}
    for i in (2, 3, 4, 12):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[11].lang_pred in model.langs and all(0 <= r.score <= 1 for r in got)
    untrained = lang_id.train(docs, lang_id.fold("doc_id", 4) == 9)
    assert untrained is None and {r.lang_pred for r in lang_id.identify(docs, untrained).collect()} == {"und"}
    assert lang_id.identify(make_docs([]), model).collect() == []


def test_language_does_not_read_other_columns(make_docs):
    docs = make_docs([(1, "the same words", "en", "a"), (2, "the same words", "fr", "b")])
    model = lang_id.train(docs, lang_id.fold("doc_id", 4) != 9)
    a, b = lang_id.identify(docs, model).collect()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score)


def test_subwords_against_brute_force():
    texts = ["Ab c-d", "", "éa", "x"]
    column = pa.array(texts)
    (_, bounds, grams), = lang_id.subwords(column)
    table = lang_id._TABLE
    for i, t in enumerate(texts):
        raw = bytes(table[b] for b in t.encode())
        for k, (_, good) in zip((2, 3, 4), grams):
            own = good[bounds[i]:bounds[i + 1]]
            assert own.tolist() == [p + k <= len(raw) and raw[p:p + k].count(32) <= 1 for p in range(len(raw))]


@pytest.fixture(scope="module")
def bags(words_pool):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choices(words_pool, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 12))]
        toxic = int(rng.random() < .4)
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(["zzgrub", "zzgrubs", "qqvile", "qqviler"])
        rows.append((i, ". ".join(sentences) + ".", None, None, toxic))
    return rows


def test_toxicity_learns_from_documents_and_locates_sentences(spark, make_docs, bags):
    docs = make_docs([r[:4] for r in bags])
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in bags], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, lang_id.fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in bags if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[r[0]].predicted == r[4] for r in held) / len(held) > 0.95
    for i, text, _, _, toxic in held:
        if toxic and got[i].sentences:
            raw = text.encode()
            worst = max(got[i].sentences, key=lambda s: s.score)
            assert b"zzgrub" in raw[worst.start:worst.end] or b"qqvile" in raw[worst.start:worst.end]


def test_noisy_or_against_brute_force():
    model = toxicity.MilModel(np.random.default_rng(3).normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -3.0)
    whole, _ = toxicity.score_texts(pa.array(["Bad words. Other words!\nMore"]), model)
    parts = [toxicity.score_texts(pa.array([s]), model)[0][0] for s in ("Bad words", "Other words", "More")]
    assert abs(whole[0] - (1 - np.prod([1 - p for p in parts]))) < 1e-9


def test_toxicity_edge_cases(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (5, 1, 1), (9, 1, None), (7, 0, 3), (None, 0, 1), (8, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, lang_id.fold("doc_id", 3) != 5)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .7) for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert toxicity.train(docs, labels.limit(0), lang_id.fold("doc_id", 3) != 5) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(make_docs([]), model).collect() == []


def test_hash_sample_of_hot_ids_and_groups(spark):
    """The smallest hashes of each group, each id once, however often it is repeated."""
    from pyspark.sql import functions as F

    from potluck.llm.common import hash_sample, one_text
    rows = [(i, "hot") for i in range(20_000)] + [(7, "hot")] * 10_000 + [(i, "few") for i in range(40)] + [(7, "few")] * 3
    df = spark.createDataFrame(rows, "doc_id long, label string").repartition(6)
    got = hash_sample(df, "label", {"hot": 300, "few": 100}).collect()
    hashes = {r.doc_id: r.h for r in spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).collect()}
    best = sorted(range(20_000), key=hashes.get)[:300]
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.label == "hot"] == best
    assert sorted(r.doc_id for r in got if r.label == "few") == list(range(40))
    assert hash_sample(df.limit(0), "label", 5).count() == 0
    plan = hash_sample(df, "label", {"hot": 300, "few": 100})._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    texts = spark.createDataFrame([(1, "a")] * 5000 + [(1, "b")] * 5000 + [(2, "c")], "doc_id long, text string").repartition(5)
    chosen = one_text(texts, "doc_id").collect()
    assert sorted(r.doc_id for r in chosen) == [1, 2] and {r.text for r in chosen} < {"a", "b", "c"}


def test_toxicity_does_not_depend_on_repeats_or_partitions(spark, make_docs):
    from pyspark.sql import functions as F

    from potluck.llm import toxicity
    bad, good = "you filthy vermin crawl away now", "the garden is quiet in the morning"
    rows = [(i, f"{bad if i % 2 else good}. word{i % 5} stays here.") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1)] * 500, "doc_id long, toxic int")
    once = toxicity.train(make_docs(rows), labels, F.lit(True))
    more = toxicity.train(make_docs(rows + [rows[3]] * 2000).repartition(7), labels.repartition(5), F.lit(True))
    assert (once.weights == more.weights).all() and once.bias == more.bias


def test_toxicity_sample_is_bounded_by_bytes(spark, make_docs, monkeypatch):
    from pyspark.sql import functions as F

    from potluck.llm import toxicity
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda ids, labels, *_: seen.append((ids, labels)))
    rows = [(i, f"some words of number{i} and more") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", {1: 30, 0: 30})
    toxicity.train(make_docs(rows), labels, F.lit(True))
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 4_000)
    toxicity.train(make_docs(rows), labels, F.lit(True))
    assert len(seen[0][0]) == 60 and 0 < len(seen[1][0]) < 60 and 0 < sum(seen[1][1]) < len(seen[1][1])
