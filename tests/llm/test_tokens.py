"""Trie counts and agenda BPE, held against brute force and the sentencepiece library."""

from __future__ import annotations

import hashlib
import math
import random

import public_tokenizers
import pytest
import sentencepiece

from potluck.llm.piece_bpe import PieceBpe, piece_decode, piece_encode
from potluck.llm.trie_counts import UNKNOWN, TrieCounter, token_counts, zipf_scores

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return PieceBpe(PATH)


ALPHABET = " ▁\n\t aeioust.,éß日🙂ab0123\x00<s>ÑñЖ́"


def test_encode_and_decode_like_the_library(library, model):
    rng = random.Random(1)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "\n", "a" * 3000, "ab " * 500]
    for t in texts:
        ids = model.encode(t)
        assert ids == library.encode(t)
        assert model.decode(ids + [model.end]) == library.decode(ids + [model.end])


def test_decode_any_ids_like_the_library(library, model):
    rng = random.Random(2)
    some = [1, 2, 3, 4, 131, 173, 200, 230, 242, 258, 259, 260, 300, 5000]
    for _ in range(4000):
        ids = [rng.choice(some) if rng.random() < .8 else rng.randrange(3, 32000) for _ in range(rng.randint(0, 7))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_and_short_agendas_agree(model):
    rng = random.Random(3)
    for _ in range(500):
        t = "".join(rng.choices("▁aeinorst", k=rng.randint(2, 40)))
        assert model._merge_short(t) == model._merge_long(t)


def test_verification_sees_cached_parts_and_decoding(monkeypatch):
    import pyarrow as pa

    from potluck.llm import piece_bpe
    own = piece_bpe.PieceBpe(PATH)
    monkeypatch.setitem(piece_bpe._loaded, PATH, own)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3]), "text": pa.array(["a wrong word", "a good one", None])})

    def run():
        return next(piece_bpe.encoder(PATH, True, ())(iter([batch]))).column("matches_library").to_pylist()
    assert run() == [True, True, True]
    place = own.pool.known[b" wrong"]                        # as if an earlier run had left it wrong
    ids = own.pool.columns[0]
    ids.flat[ids.offsets[place]] += 1
    assert run() == [False, True, True]
    ids.flat[ids.offsets[place]] -= 1
    monkeypatch.setattr(own, "decoded", lambda raw, first: b"a good one")
    assert run() == [False, True, False]


def test_encode_edge_cases(make_docs, edge_rows, library):
    got = piece_encode(make_docs(edge_rows), PATH, carry=["grp"], verify=True).collect()
    assert len(got) == len(edge_rows)
    texts = {i: t or "" for i, t, *_ in edge_rows if i is not None}
    for r in got:
        assert r.matches_library and r.carry.grp == "x" and r.n_tokens == len(r.ids)
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id], add_eos=True)
            assert r.ids == ids and r.decoded == library.decode(ids)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert piece_encode(make_docs([]), PATH).collect() == []


def test_piece_decode(make_docs, model):
    df = piece_encode(make_docs([(1, "some words"), (2, None)]), PATH, outputs=("ids",))
    assert {r.doc_id: r.decoded for r in piece_decode(df, PATH).collect()} == {1: "some words", 2: ""}


def brute(word, scores):
    """Best segmentation (score, tokens) and log-probability over all, without sharing."""
    best, forward = [(0.0, 0)], [0.0]
    for end in range(1, len(word) + 1):
        ways = []
        for at in range(end):
            score, many = scores.get(word[at:end]), 1
            if score is None:
                if at < end - 1:
                    continue
                many = len(word[at].encode())
                score = UNKNOWN * many
            ways.append((best[at][0] + score, -(best[at][1] + many), forward[at] + score))
        top = max(w[:2] for w in ways)
        best.append((top[0], -top[1]))
        high = max(w[2] for w in ways)
        forward.append(high + math.log(sum(math.exp(w[2] - high) for w in ways)))
    return best[-1][1], forward[-1]


def test_trie_against_brute_force(words_pool):
    rng = random.Random(4)
    scores = zipf_scores(PATH)
    counter = TrieCounter(scores)
    words = words_pool[:800] + ["日本x", "🙂", "a" * 700, "the", "then", "thenceforth"]
    for text in (" ".join(rng.choices(words, k=50)) for _ in range(40)):
        n, tokens, forward = counter.count([text])[0]
        exact = [brute("▁" + w, scores) for w in text.split()]
        assert (n, tokens) == (50, sum(e[0] for e in exact))
        assert math.isclose(forward, sum(e[1] for e in exact), rel_tol=1e-9)


def test_trie_prefers_fewer_tokens_on_ties():
    counter = TrieCounter({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0})
    assert counter.count(["ab"])[0][1] == 2


def test_trie_edge_cases(make_docs, edge_rows):
    got = token_counts(make_docs(edge_rows), PATH).collect()
    assert len(got) == len(edge_rows)
    by_id = {r.doc_id: r for r in got}
    assert tuple(by_id[2])[1:] == (0, 0, 0.0) == tuple(by_id[3])[1:] == tuple(by_id[4])[1:]
    assert by_id[1].n_tokens == by_id[5].n_tokens > 0
    scores = zipf_scores(PATH)
    assert by_id[13].n_tokens == brute("▁" + "a" * 5000, scores)[0]
    assert token_counts(make_docs([]), PATH).collect() == []
