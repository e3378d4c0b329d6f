"""Token ids as length-delimited binary records with an offset index.

File format, little-endian, a sequence of frames:

    length of the payload (8 bytes) | masked CRC-32C of the length (4) | payload | masked CRC-32C of the payload (4)

which is the framing of TFRecord files. Payloads start with a word whose low half is the kind:

* ``DOCUMENT``: high half 1 if the row has an id; number of ids (4 bytes); id of the row (8);
  the ids, of 2 bytes each, or 4 where the vocabulary needs them (``WIDE`` in the high half),
  filled up to whole words;
* ``BLOCK``: shard (4 bytes); place of this frame in the file (8); ids of the shard before it (8);
* ``END``: fixed bytes, the last frame of a block. No other frames contain them: with ids of 4
  bytes they cannot, and texts whose ids of 2 bytes would are written with 4.

Documents are encoded in ascending order of their ids: ranges of ids are tasks, and each task
writes one file, of blocks of about ``BLOCK_BYTES``. Spark's text writer puts the blocks out,
as rows, with the END frame as the separator of lines, through any file system and with its
commit protocol, so that lost or repeated tasks leave no files behind; its reader splits files
at END frames, so that large files are read by many tasks.

The index is a separate table, derived from the files by a job that checks every checksum:
file, offset and length of each frame, shard, id, number of ids, and the ids of its shard
before it. ``with_start`` adds those of the shards before; ``read_at`` reads one frame from a
seekable file by its index row; ``shuffled`` reads all records in a random order by a seed.

Encoding: texts are cut where the tokenizer's own splitting always cuts (white space, between
ASCII letters, digits and signs), every distinct part is encoded once by the tokenizers library
and kept by the worker. Parts with other characters, apostrophes, or signs that special tokens
are made of are never cut inside and go to the library as they are.

Defined cases: null and empty texts give the end id alone; rows without an id come first; rows
that share an id stand in input order; an empty table gives no files of documents and an empty
index.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from potluck.llm.common import doc_input
from potluck.llm.crc32c import crc32c, masked
from potluck.llm.parts import PartPool, part_array, per_text
from potluck.llm.words import slices, text_buffers
from potluck.session import shared_path

BLOCK_BYTES = 1 << 20
DOCUMENT, BLOCK, END = 1, 2, 3
HAS_ID, WIDE = 1 << 16, 1 << 17
HEAD_WORDS = 3                   # length and its checksum
DOC_WORDS = 4                    # kind, number of ids, id of the row
_U = np.uint32
INDEX = ("file string, offset long, length int, shard int, doc_id long, n_tokens long, before long, ids_crc32 long")


# ---- frames -----------------------------------------------------------------------------

def _framed(buffer: np.ndarray, at: np.ndarray, payload: np.ndarray) -> None:
    """Fill in lengths and checksums of frames that begin at the words ``at``; ``payload``:
    words of each payload, which are there already."""
    buffer[at] = payload * 4
    buffer[at + 1] = 0
    buffer[at + 2] = masked(crc32c(buffer, at, np.full(at.size, 2)))
    buffer[at + HEAD_WORDS + payload] = masked(crc32c(buffer, at + HEAD_WORDS, payload))


def frame(words: list[int]) -> bytes:
    """One payload of words, framed."""
    buffer = np.zeros(len(words) + HEAD_WORDS + 1, _U)
    buffer[HEAD_WORDS:-1] = words
    _framed(buffer, np.zeros(1, np.int64), np.array([len(words)]))
    return buffer.tobytes()


END_FRAME = frame([0xFFFF << 16 | END])


def document_frames(ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray,
                    wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Frames of documents (``ids`` one after the other, ``counts`` of each) as words, and the
    words of each frame."""
    id_words = counts if wide else (counts + 1) // 2
    size = id_words + (HEAD_WORDS + DOC_WORDS + 1)
    ends = np.cumsum(size)
    at = ends - size
    buffer = np.zeros(int(ends[-1]) if ends.size else 0, _U)
    buffer[at + 3] = DOCUMENT | np.where(has_id, HAS_ID, 0) | (WIDE if wide else 0)
    buffer[at + 4] = counts
    as_words = doc_ids.astype("<i8").view(_U).reshape(-1, 2)
    buffer[at + 5], buffer[at + 6] = as_words[:, 0], as_words[:, 1]
    first = at + HEAD_WORDS + DOC_WORDS
    units = buffer if wide else buffer.view(np.uint16)
    unit = 1 if wide else 2
    total = np.cumsum(counts)
    units[np.arange(ids.size) + np.repeat(first * unit - (total - counts), counts)] = ids
    _framed(buffer, at, id_words + DOC_WORDS)
    return buffer, size


def _ids(payload: memoryview, kind: int, count: int) -> np.ndarray:
    return np.frombuffer(payload, _U if kind & WIDE else np.uint16, count, DOC_WORDS * 4)


def _check(data: np.ndarray, at: np.ndarray, length: np.ndarray, name: str) -> None:
    """All checksums of the frames at the bytes ``at`` of ``data``, which begins with a frame."""
    words, at = data.view(_U), at // 4
    sound = masked(crc32c(words, at, np.full(at.size, 2))) == words[at + 2]
    sound &= masked(crc32c(words, at + HEAD_WORDS, length // 4)) == words[at + HEAD_WORDS + length // 4]
    if not sound.all():
        raise ValueError(f"{name}: checksum of a record does not match")


def _scan(data: bytes, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and payload lengths of the frames of ``data``; everything is checked."""
    at, length, pos, n = [], [], 0, len(data)
    while pos < n:
        size = int.from_bytes(data[pos:pos + 8], "little")
        if n - pos < 16 or size % 4 or size > n - pos - 16:
            raise ValueError(f"{name}: a record is cut off or its length is damaged")
        at.append(pos)
        length.append(size)
        pos += size + 16
    places, lengths = np.array(at, np.int64), np.array(length, np.int64)
    _check(np.frombuffer(data, np.uint8), places, lengths, name)
    return places, lengths


def documents_of(data: bytes, name: str) -> Iterator[tuple[int, int, int, int | None, np.ndarray, int]]:
    """(offset, length of the frame, shard, id or None, ids, ids of the shard before) of the
    documents of one or several blocks."""
    view, shard, base, before = memoryview(data), -1, 0, 0
    for pos, size in zip(*(x.tolist() for x in _scan(data, name))):
        payload = view[pos + 12:pos + 12 + size]
        kind = int.from_bytes(payload[:4], "little")
        if kind & 0xFFFF == BLOCK:
            shard, offset, before = struct.unpack_from("<iqq", payload, 4)
            base = offset - pos
        elif kind & 0xFFFF == DOCUMENT:
            count, doc_id = struct.unpack_from("<Iq", payload, 4)
            yield base + pos, size + 16, shard, doc_id if kind & HAS_ID else None, _ids(payload, kind, count), before
            before += count
        elif kind & 0xFFFF != END:
            raise ValueError(f"{name}: unknown kind of record")


def read_at(stream, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """(id, token ids) of the record at ``offset`` of a seekable binary file; checked."""
    stream.seek(offset)
    data = stream.read(length)
    if len(data) != length:
        raise ValueError("the file ends before the record does")
    _scan(data, "record")
    kind, count, doc_id = struct.unpack_from("<IIq", data, 12)
    return doc_id if kind & HAS_ID else None, _ids(memoryview(data)[12:], kind, count)


# ---- encoding ---------------------------------------------------------------------------

_WHITE, _LETTER, _DIGIT, _SIGN, _WHOLE = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, _WHOLE, np.uint8)
    out[[9, 10, 13, 32]] = _WHITE
    for a, b in ((65, 90), (97, 122)):
        out[a:b + 1] = _LETTER
    out[48:58] = _DIGIT
    out[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = _SIGN
    return out


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_parts(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of the texts ``data[bounds[i]:bounds[i + 1]]``, and the first part of each text
    (one more at the end). ASCII letters are in lower case where a part has nothing else."""
    kind = _CLASS[data]
    # two-byte letters of Latin-1 (all but the signs of multiplication and division)
    lead = np.flatnonzero(data[:-1] == 0xC3) if data.size else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    inside = kind != _WHITE
    cut = np.ones(data.size, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:] = (a == _WHITE) | ((a != _WHOLE) & (b != _WHOLE) & ((a != b) | (b == _DIGIT)))
    cut[bounds[:-1][bounds[:-1] < data.size]] = True
    start = np.flatnonzero(inside & cut)
    last = np.ones(data.size, bool)
    last[:-1] = cut[1:] | ~inside[1:]
    end = np.flatnonzero(inside & last) + 1
    plain = _LOWER[data]
    whole = np.zeros(data.size + 1, np.int64)
    np.cumsum(kind == _WHOLE, out=whole[1:])
    mixed = whole[end] > whole[start]
    if mixed.any():
        step = np.zeros(data.size + 1, np.int8)
        step[start[mixed]] += 1
        step[end[mixed]] -= 1
        as_is = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        plain[as_is] = data[as_is]
    return part_array(plain, start, end), np.searchsorted(start, bounds)


_pools: dict[str, tuple[PartPool, int]] = {}


def load(path: str) -> tuple[PartPool, int]:
    """The pool of a worker for the vocabulary at ``path``, and its number of ids."""
    if path not in _pools:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # a task has one core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        model = library.model

        def whole(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(parts: list[bytes]):
            # lower-case ASCII letters are one word for the normalizer and the splitter: straight to the model
            out = [[t.id for t in model.tokenize(p.decode())] if p.isalpha() and p.islower() else None for p in parts]
            others = iter(whole([p.decode() for p, ids in zip(parts, out) if ids is None]))
            return [[next(others) if ids is None else ids for ids in out]]
        probe = [" A1b--C\n\tzürich12", "a", "1", "b", "--", "c", "zürich", "1", "2"]
        at_once, *each = whole(probe)
        if at_once != [i for ids in each for i in ids] or encode([b"abcdefgh", b"xyz"])[0] != whole(["abcdefgh", "XYZ"]):
            raise ValueError("only tokenizers that lower-case and split at white space, digits and signs are supported")
        _pools[path] = PartPool(encode, [np.int32]), library.get_vocab_size()
    return _pools[path]


def encode_texts(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: number of the first text, ids of all texts with the end id,
    and the number of ids of each."""
    pool, _ = load(path)
    data, offsets = text_buffers(column)
    for at, to in slices(offsets):
        parts, first = word_parts(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        places = pool.places(parts)                        # may renew the columns
        ids, lengths = pool.columns[0].gather(places)
        counts = per_text(lengths, first) + 1
        out = np.full(int(counts.sum()), end_id, np.int32)
        body = np.ones(out.size, bool)
        body[np.cumsum(counts) - 1] = False
        out[body] = ids
        yield at, out, counts


def _writer(path: str, end_id: int) -> Callable:
    """Task function: sorted texts in; blocks of one file out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, offset, before = TaskContext.get().partitionId(), 0, 0
        wide = max(load(path)[1], end_id + 1) > 1 << 16
        for batch in batches:
            for at, ids, counts in encode_texts(batch.column("text"), path, end_id):
                row_ids = batch.column("doc_id").slice(at, counts.size)
                has_id = row_ids.is_valid().to_numpy(zero_copy_only=False)
                row_ids = row_ids.fill_null(0).to_numpy()
                words, sizes = document_frames(ids, counts, row_ids, has_id, wide)
                if not wide and END_FRAME in words.tobytes():
                    words, sizes = document_frames(ids, counts, row_ids, has_id, True)
                ends, tokens = np.cumsum(sizes), np.cumsum(counts)
                row = 0
                while row < counts.size:
                    # rows of one block; at least one
                    start = int(ends[row] - sizes[row])
                    to = max(row + 1, int(np.searchsorted(ends, start + BLOCK_BYTES // 4, side="right")))
                    head = struct.pack("<iqq", shard, offset, before)
                    block = frame([BLOCK, *np.frombuffer(head, _U).tolist()]) + words[start:int(ends[to - 1])].tobytes()
                    offset += len(block) + len(END_FRAME)
                    before += int(tokens[to - 1] - (tokens[row - 1] if row else 0))
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.binary())})
                    row = to
    return run


# ---- files ------------------------------------------------------------------------------

def _lines(io):
    return io.option("lineSep", END_FRAME.decode("iso-8859-1")).option("encoding", "iso-8859-1")


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, id_col: str = "doc_id",
                  text_col: str = "text") -> str:
    """Encode the texts and write ``folder/records`` and ``folder/index``; returns ``folder``."""
    rows = doc_input(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_writer(vocabulary, end_id), "block binary")
    _lines(blocks.select(F.col("block").cast("string").alias("value")).write).text(f"{folder}/records")
    scanned(docs.sparkSession, folder).write.parquet(f"{folder}/index")
    return folder


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark.read).text(f"{folder}/records").select(
        F.col("value").cast("binary").alias("block"), F.col("_metadata.file_name").alias("file"))


def scanned(spark: SparkSession, folder: str) -> DataFrame:
    """The index as the files say; a damaged record is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, file in zip(batch.column("block"), batch.column("file").to_pylist()):
                rows = [(file, offset, length, shard, doc_id, ids.size, before, zlib.crc32(ids.astype("<u4").tobytes()))
                        for offset, length, shard, doc_id, ids, before in documents_of(block.as_py(), file)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)] if rows else [pa.array([], t) for t in _INDEX_TYPES],
                    names=_INDEX_NAMES)
    return _blocks(spark, folder).mapInArrow(run, INDEX)


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in INDEX.split(", ")]


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def with_start(entries: DataFrame) -> DataFrame:
    """The index with ``start``: the ids of all documents before each. Shards are as many as
    tasks that wrote files; only their totals are summed up in one place."""
    totals = entries.groupBy("shard").agg(F.sum("n_tokens").alias("of_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("of_shard").over(before), F.lit(0)).alias("shard_start"))
    return entries.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("before")).drop("shard_start")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of every record, read back from the files; checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, file in zip(batch.column("block"), batch.column("file").to_pylist()):
                rows = [(doc_id, ids) for _, _, _, doc_id, ids, _ in documents_of(block.as_py(), file)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()),
                                                  "ids": pa.array([r[1].astype(np.int64) for r in rows], pa.list_(pa.int64()))})
    return _blocks(spark, folder).mapInArrow(run, "doc_id long, ids array<long>")


def shuffled(spark: SparkSession, folder: str, seed: int = 1) -> DataFrame:
    """All records in a random order that the seed decides, dealt over partitions by it."""
    key: Column = F.xxhash64(F.lit(seed), "doc_id", "ids")
    return records(spark, folder).withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key").drop("key")


def new_folder(spark: SparkSession) -> str:
    """A folder for the files of one run, in the shared folder."""
    return shared_path(spark, "llm", spark.sparkContext.applicationId, f"records-{uuid.uuid4().hex}")
