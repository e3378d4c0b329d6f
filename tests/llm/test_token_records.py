"""Token records: the format, the tokenizer's ids, and the offset index."""

from __future__ import annotations

import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from potluck.llm import token_records as R
from potluck.llm.crc32c import crc32c, masked

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert plain_crc(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, 400, dtype=np.uint32)
    start, length = np.array([0, 5, 5, 7, 1, 0]), np.array([1, 0, 16, 17, 130, 400])
    want = [plain_crc(words[a:a + n].tobytes()) for a, n in zip(start, length)]
    assert crc32c(words, start, length).tolist() == want
    assert masked(np.array([0x8A9136AA], np.uint32)).tolist() == [((0x8A9136AA >> 15 | 0x8A9136AA << 17) + 0xA282EAD8) % 2**32]


def test_texts_are_encoded_like_the_library(library):
    rng = random.Random(2)
    alphabet = "  \t\n\r\x0b\x1c\x85\xa0aeiouABCZéÉßçñ×÷İſΣ日本🙂0123.,;-'\"<|>_~́‍☃ǅ¼²"
    bits = ["don't", "it's", "'s", "<|endoftext|>", "<|EndOfText|>", "é", "Å", "naïve", "x.'s", "10.5%", "ﬁ", "ΑΣ ", "́"]
    texts = ["".join(rng.choice(bits) if rng.random() < .2 else rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
             for _ in range(6000)] + ["", "a" * 4000, "ab " * 3000, "." * 500, "12" * 300]
    want = [e.ids + [2] for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    got = []
    for _, ids, counts in R.encode_texts(pa.array(texts), PATH, 2):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [t for t, a, b in zip(texts, want, got) if a != b] == [] and len(got) == len(want)


def test_pool_is_emptied_and_goes_on(library, monkeypatch):
    from potluck.llm import parts
    monkeypatch.setattr(parts, "POOL_PARTS", 50)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 90))) for _ in range(30)) for _ in range(30)]
    pool, _ = R.load(PATH)
    for text in texts:
        ids = next(R.encode_texts(pa.array([text]), PATH, 2))[1].tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids + [2]
        assert pool.columns[0].n <= 50 + 30


@pytest.mark.parametrize("wide", [False, True])
def test_frames_and_damage(wide):
    ids, counts = np.array([5, 6, 2, 2, 49000, 2], np.int32), np.array([3, 1, 2])
    words, sizes = R.document_frames(ids, counts, np.array([7, 0, -2**62]), np.array([True, False, True]), wide)
    assert sizes.sum() == words.size
    head = struct.pack("<iqq", 9, 1000, 50)
    block = R.frame([R.BLOCK, *np.frombuffer(head, np.uint32).tolist()])
    data = block + words.tobytes() + R.END_FRAME + block + words.tobytes()
    got = list(R.documents_of(data, "f"))
    once = [(7, [5, 6, 2], 50), (None, [2], 53), (-2**62, [49000, 2], 54)]
    assert [(d, i.tolist(), before) for _, _, _, d, i, before in got] == once + once
    # offsets are those of the file, of which the first block here begins at 1000
    for offset, length, shard, doc_id, token_ids, _ in got[:3]:
        found = R.read_at(io.BytesIO(b"x" * 1000 + data), offset, length)
        assert shard == 9 and found[0] == doc_id and found[1].tolist() == token_ids.tolist()
    for at in range(0, len(data), 3):
        broken = data[:at] + bytes([data[at] ^ 4]) + data[at + 1:]
        with pytest.raises(ValueError):
            list(R.documents_of(broken, "f"))
    for cut in (1, 15, 17, len(block) + 3):
        with pytest.raises(ValueError):
            list(R.documents_of(data[:-cut], "f"))


def test_end_frames_never_occur_in_wide_records():
    pattern = np.frombuffer(R.END_FRAME, np.uint16).astype(np.int32)
    words, _ = R.document_frames(pattern, np.array([pattern.size]), np.array([1]), np.array([True]), False)
    assert R.END_FRAME in words.tobytes()
    words, _ = R.document_frames(pattern, np.array([pattern.size]), np.array([1]), np.array([True]), True)
    assert R.END_FRAME not in words.tobytes()


def test_files_and_index(spark, make_docs, edge_rows, library, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BYTES", 600)
    rows = edge_rows + [(i, f"Text {i}, don't <|endoftext|> " + "né " * (i % 7)) for i in range(100, 400)]
    folder = R.write_records(make_docs(rows), PATH, R.new_folder(spark))
    index = R.with_start(R.index(spark, folder)).collect()
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in index))
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start, by_id = 0, {}
    for s, doc_id, n, crc in got:
        assert s == start
        start += n
        by_id.setdefault(doc_id, []).append((n, crc))
    want = {}
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [2]
        want.setdefault(row[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in want.items()}
    # a record read by its index row, and all of them in a shuffled order
    local = folder.removeprefix("file://")
    for r in index[::25]:
        with open(f"{local}/records/{r.file}", "rb") as f:
            doc_id, ids = R.read_at(f, r.offset, r.length)
        assert doc_id == r.doc_id and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
    read = R.shuffled(spark, folder, 5).collect()
    assert sorted((r.doc_id is not None, r.doc_id, len(r.ids)) for r in read if r.doc_id is not None) == sorted(
        (True, r.doc_id, r.n_tokens) for r in index if r.doc_id is not None)
    assert [r.doc_id for r in read] != [g[1] for g in got] and len(read) == len(rows)
    assert [r.doc_id for r in read] == [r.doc_id for r in R.shuffled(spark, folder, 5).collect()]


def test_empty_table(spark, make_docs):
    folder = R.write_records(make_docs([]), PATH, R.new_folder(spark))
    assert R.with_start(R.index(spark, folder)).collect() == [] and R.records(spark, folder).collect() == []


def test_damaged_file_is_an_error(spark, make_docs):
    folder = R.write_records(make_docs([(1, "some words"), (2, "others")]), PATH, R.new_folder(spark))
    import glob
    name = max(glob.glob(folder.removeprefix("file://") + "/records/part-*"), key=lambda p: len(open(p, "rb").read()))
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 1
    open(name, "wb").write(bytes(data))
    import os
    crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
    if os.path.exists(crc):
        os.remove(crc)                            # the local file system's own check would come first
    with pytest.raises(Exception, match="damaged|does not match|cut off|unknown kind"):
        R.records(spark, folder).collect()


def test_query_matches_the_library_on_whole_tables(spark, library):
    from potluck.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op12_token_records"](spark, sf).collect())
    want, start = [], 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
