"""Merkle manifest and pointer-jumping proofs against a plain computation."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from potluck.llm import merkle_manifest as M

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """Digest of the nodes and, for each, its siblings from the bottom up."""
    proofs = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8:k // 8 * 8 + 8]
            proofs[i].append(("".join(run[:k % 8]), "".join(run[k % 8 + 1:])))
        nodes = [sha(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], proofs


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text); a list of (doc_id, leaf, subroot, root, proof)."""
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in langs}
    built = {g: climb([leaf_of(r) for r in rs]) for g, rs in groups.items()}
    root, tops = climb([built[g][0] for g in langs])
    return [(r[0], leaf_of(r), built[g][0], root, proof + top) for g, top in zip(langs, tops)
            for r, proof in zip(groups[g], built[g][1])]


def table(spark, rows):
    extra = [list(r) + ["x", 1, "h", 2] for r in rows]
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx long, hash string, n long"
    return spark.createDataFrame(extra, schema).repartition(3)


def result(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(x.left, x.right) for x in r.proof]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    out = [(i, rng.choice("ab"), rng.choices(["en", "de", None, "", "ß", "z"], [60, 20, 5, 1, 2, 1])[0], i % 7, f"Text {i} 日本") for i in range(700)]
    out += [(1, "a", "en", 1, "Text"), (1, "a", "en", 1, "Text"), (None, None, None, None, None), (None, None, None, None, None),
            (None, "s", "en", 3, ""), (5000, "s", "lone", 3, None), (-7, "s", "en", None, "w" * 50_000)]
    return out


def test_manifest(spark, rows):
    assert result(M.merkle_manifest(table(spark, rows))) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_shuffled_and_broadcast_rounds_agree(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(M, "BROADCAST_BYTES", limit)
    assert result(M.merkle_manifest(table(spark, rows))) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("count, langs", [(0, 1), (1, 1), (2, 1), (8, 1), (9, 1), (65, 1), (3, 3), (30, 30), (200, 70)])
def test_small_shapes(spark, count, langs):
    some = [(i, "s", f"l{i % langs:02}", 1, f"t{i}") for i in range(count)]
    assert result(M.merkle_manifest(table(spark, some))) == sorted(plain(some) if some else [], key=str)


def test_verification(spark, rows):
    changed = M.leaf([F.lower("text") if c == "text" else F.col(c) for c in COLUMNS])
    seen = F.when(F.col("doc_id") % 5 == 0, changed)
    found = M.verify(M.merkle_manifest(table(spark, rows), carry={"seen": seen}), F.coalesce("seen", "leaf")).collect()
    root = plain(rows)[0][3]
    assert all(r.root == root and r.verified == (r.folded_root == root) for r in found)
    touched = {r[0] for r in rows if r[0] is not None and r[0] % 5 == 0 and r[4] and r[4] != r[4].lower()}
    assert {r.doc_id for r in found if not r.verified} == touched


def test_hot_group_of_equal_rows(spark):
    some = [(7, "s", "en", 1, "same")] * 500 + [(i, "s", "en", 1, f"t{i}") for i in range(40)]
    assert result(M.merkle_manifest(table(spark, some))) == sorted(plain(some), key=str)


def test_query_on_a_whole_table(spark):
    from potluck.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).collect()]
    texts = {r[0]: r for r in rows}

    def folded(doc_id, leaf, proof):
        row = texts[doc_id]
        if zlib.crc32(str(doc_id).encode()) % 3 == 0 and row[4] is not None:
            lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
            leaf = leaf_of((*row[:4], lowered))
        for left, right in proof:
            leaf = sha(left, leaf, right)
        return leaf
    want = []
    for doc_id, leaf, subroot, root, proof in plain(rows):
        back = folded(doc_id, leaf, proof)
        want.append((doc_id, leaf, subroot, root, sha(*[x + y for x, y in proof]), back, back == root))
    assert sorted(tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, sf).collect()) == sorted(want)
