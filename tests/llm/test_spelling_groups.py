"""Near words, forms and roots against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest

from potluck.llm import spelling_groups as S

LETTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}


def runs_of(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if c in LETTERS:
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def count_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in runs_of(text):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def group(counts):
    near = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def result(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    words += ["ÀLPHA", "Àlpha", "àlpha", "straße", "strasse", "x×y÷z", "a" * 3000, "a" * 3001, "b" + "a" * 3000]
    return [(i, " ".join(rng.choices(words, k=120)) + f" end{i % 3} ümlaut-{rng.choice(words)}'s") for i in range(40)]


def test_words_and_groups_of_texts(spark, make_docs, texts):
    rows = texts + [(None, "abéab ABÉAB abéab"), (3, None), (3, ""), (4, texts[4][1]), (4, texts[4][1])]
    counts = count_words(rows)
    docs = make_docs(rows)
    assert {r.word: r.n for r in S.corpus_words(docs).collect()} == counts
    assert result(S.spelling_groups(S.corpus_words(docs))) == group(counts)


def test_dense_words_split_nodes_and_shuffled_levels(spark, monkeypatch):
    """Every word of three letters over two, and lone long words: many paths through few nodes."""
    rng = random.Random(3)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 7))): rng.randint(3, 400) for _ in range(400)}
    counts |= {"shared" + "".join(rng.choice("cde") for _ in range(6)): rng.randint(3, 9) for _ in range(300)}
    counts |= {w + "z": 5 for w in list(counts)[:50]}
    monkeypatch.setattr(S, "PER_COPY", 16)
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert result(S.spelling_groups(words)) == group(counts)


def test_equal_counts_and_chains(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaaac": 6, "aabab": 12, "zzzzz": 3, "zzzzy": 5, "äaaaa": 100}
    got = result(S.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == group(counts)
    assert ("zzzzz", None, "zzzzz", 3, 1, None) in got


def test_few_or_no_words(spark, make_docs):
    for rows in ([], [(1, None)], [(1, "short words stay out")], [(1, "hello hello hello")]):
        assert result(S.spelling_groups(S.corpus_words(make_docs(rows)))) == group(count_words(rows))
