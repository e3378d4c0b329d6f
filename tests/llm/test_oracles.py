"""The registered queries: against their DuckDB SQL, and against brute force over whole tables."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as E
from potluck.llm.oracle_sql import QUERIES as SQL
from potluck.llm.queries import QUERIES, piece_model

SF = "/root/testdata/sf0.001"


def rows(pdf):
    return sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r)
                  for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(SQL[name]).df())


def test_registration():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 11)) and "pipeline" in E.queries()
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_op2_whole_table(spark, texts):
    from test_jaccard_join import brute
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op2_jaccard_join"](spark, SF).collect()}
    assert got == brute(texts.items())


def test_op3_whole_table(spark, texts):
    from test_spotsigs import edited
    got = {r.doc_id: r for r in QUERIES["op3_spotsigs"](spark, SF).collect()}
    ordered = [texts[i] for i in sorted(texts)]
    assert [got[i].edited_sha256 for i in sorted(got)] == [hashlib.sha256(e.encode()).hexdigest() for e in edited(ordered)]
    assert len({(t, got[i].fingerprint) for i, t in texts.items()}) == len(set(texts.values()))
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_op5_whole_table(spark, texts):
    from potluck.llm.trie_counts import zipf_scores
    from test_tokens import brute
    scores, seen = zipf_scores(piece_model()), {}
    for r in QUERIES["op5_trie_counts"](spark, SF).collect():
        words = texts[r.doc_id].split()
        if len(words) <= 300:
            for w in words:
                if w not in seen:
                    seen[w] = brute("▁" + w, scores)
            found = [seen[w] for w in words]
            assert (r.n_words, r.n_tokens) == (len(words), sum(f[0] for f in found))


def test_op6_whole_table(spark, texts):
    from test_license_scan import brute
    for r in QUERIES["op6_license_scan"](spark, SF).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])


def test_op7_and_op9_whole_tables(spark, texts):
    toxic = QUERIES["op7_toxicity"](spark, SF).collect()
    langs = QUERIES["op9_lang_id"](spark, SF).collect()
    assert len(toxic) == len(langs) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in toxic)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in langs)


def test_op8_whole_table(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for r in QUERIES["op8_piece_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.matches_library and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
