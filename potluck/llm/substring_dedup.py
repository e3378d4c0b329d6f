"""Substring de-duplication by Relative Lempel-Ziv parsing against an indexed corpus.

Every text is parsed greedily into *factors*: maximal stretches whose words also stand in
an earlier document (one with a smaller id). The reference is the corpus itself, indexed in
blocks by hash: a reference block holds, for the word sequences that hash into it, the
smallest document in which they start. Factors of at least ``window`` words are duplicate
spans. A window that crosses the border of two factors may still stand whole in a third
document, so each of them is looked up by itself; the result is exactly the set of words
covered by a ``window``-word sequence that starts in an earlier document (up to collisions
of 64-bit hashes).

The index is consulted in two rounds, so that few sequences travel:

1. *Anchors.* Of the ``window - ANCHOR + 1`` runs of ANCHOR words in a window, the one with
   the smallest hash is the window's anchor. Equal windows have equal anchors; about two in
   ten words start one. Anchors that stand in one document only rule their windows out.
2. *Windows.* The windows of the remaining anchors are looked up; the parse runs over the
   answers.

Documents are handled in groups of ``GROUP`` consecutive ids. A group sends each sequence
to the index once, however many of its documents hold it: a passage in a third of all
documents costs one entry a group. Entries travel packed, one row for all that a task holds
for a reference block, and are sorted in numpy there.

Defined cases: null and empty texts have no words and lose none; texts shorter than the
window lose none; rows with equal ids never remove from one another; rows without an id are
no reference and lose nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.llm.common import checkpointed, doc_input, partitions
from potluck.llm.words import Words, windows, words

WINDOW = 13
ANCHOR = 5
GROUP = 1024                 # consecutive document ids handled together; a power of two
FLUSH_WORDS = 4_000_000      # sequences gathered by a task before they are packed and sent
_U = np.uint64
_NONE = _U(2**64 - 1)

ENTRY = "bucket int, grps binary, hashes binary, low binary, high binary"
_PACKED = ("grps", "hashes", "low", "high")
ANSWER = "grp long, hashes binary, first binary"


def anchors(w: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: hash of the window from it on, hash of that window's anchor, is it whole."""
    h = w.hashes()
    of_window, whole = windows(h, w.first, window)
    short, fits = windows(h, w.first, min(ANCHOR, window))
    n, span = h.size, window - min(ANCHOR, window) + 1
    padded = np.concatenate([np.where(fits, short, _NONE), np.full(span, _NONE)])
    least = padded[:n].copy()
    for j in range(1, span):
        np.minimum(least, padded[j:j + n], out=least)
    return of_window, least, whole


def _pack(hashes: np.ndarray, docs: np.ndarray, groups: np.ndarray, buckets: int) -> dict:
    """One entry per (group, sequence): the smallest and largest document; packed by block."""
    bucket = (hashes % _U(buckets)).astype(np.int64)
    order = np.lexsort((docs, hashes, groups, bucket))
    hashes, docs, groups, bucket = hashes[order], docs[order], groups[order], bucket[order]
    new = np.ones(hashes.size, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (groups[1:] != groups[:-1])
    at = np.flatnonzero(new)
    low, high = docs[at], docs[np.append(at[1:], hashes.size) - 1]
    hashes, groups, bucket = hashes[at], groups[at], bucket[at]
    cut = np.ones(hashes.size, bool)
    cut[1:] = bucket[1:] != bucket[:-1]
    cut = np.flatnonzero(cut)
    ends = np.append(cut[1:], hashes.size)
    # ids within a group differ by less than GROUP: 16 bits each beside the group's number
    base = groups * GROUP
    low, high = (low - base).astype(np.uint16), (high - base).astype(np.uint16)
    return {"bucket": bucket[cut].astype(np.int32),
            "grps": [groups[a:b].tobytes() for a, b in zip(cut, ends)],
            "hashes": [hashes[a:b].tobytes() for a, b in zip(cut, ends)],
            "low": [low[a:b].tobytes() for a, b in zip(cut, ends)],
            "high": [high[a:b].tobytes() for a, b in zip(cut, ends)]}


def _entry_batch(packed: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(packed["bucket"], pa.int32()), *[pa.array(packed[c], pa.binary()) for c in _PACKED]],
        names=["bucket", *_PACKED])


def _group_of(ids: np.ndarray) -> np.ndarray:
    return np.floor_divide(ids, GROUP)


def anchor_entries(buckets: int, window: int):
    """Task function: texts in, packed index entries of their anchors out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            known = batch.filter(batch.column("doc_id").is_valid())
            ids = known.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for w in words(known.column("text")):
                _, least, whole = anchors(w, window)
                docs = ids[w.row + w.text_of()][whole]
                found = least[whole]
                if not found.size:
                    continue
                new = np.ones(found.size, bool)      # neighbouring windows share an anchor
                new[1:] = (found[1:] != found[:-1]) | (docs[1:] != docs[:-1])
                held.append((found[new], docs[new]))
                count += held[-1][0].size
                if count >= FLUSH_WORDS:
                    yield _entry_batch(_flush(held, buckets))
                    held, count = [], 0
        if held:
            yield _entry_batch(_flush(held, buckets))
    return run


def _flush(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> dict:
    hashes, docs = np.concatenate([h for h, _ in held]), np.concatenate([d for _, d in held])
    return _pack(hashes, docs, _group_of(docs), buckets)


def _unpack(table: pa.Table) -> tuple[np.ndarray, ...]:
    grp, hashes, low, high = [np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
                              for c, kind in zip(_PACKED, (np.int64, _U, np.uint16, np.uint16))]
    return hashes, grp, low + grp * GROUP, high + grp * GROUP


def lookup(later_only: bool):
    """Index block: answer each group with the sequences that other documents hold too.

    ``later_only`` answers only where an earlier document exists for some document of the
    group; otherwise also the earliest holder learns that its sequence is shared.
    """
    def run(table: pa.Table) -> pa.Table:
        hashes, grp, low, high = _unpack(table)
        order = np.lexsort((low, hashes))
        hashes, grp, low, high = hashes[order], grp[order], low[order], high[order]
        at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        sizes = np.diff(np.append(at, hashes.size))
        first, last = low[at], np.maximum.reduceat(high, at)
        first_of = np.repeat(first, sizes)
        wanted = high > first_of if later_only else np.repeat(first < last, sizes)
        hashes, grp, first_of = hashes[wanted], grp[wanted], first_of[wanted]
        order = np.argsort(grp, kind="stable")
        hashes, grp, first_of = hashes[order], grp[order], first_of[order]
        at = np.flatnonzero(np.append(True, grp[1:] != grp[:-1])) if grp.size else np.zeros(0, int)
        ends = np.append(at[1:], grp.size)
        return pa.table({"grp": pa.array(grp[at], pa.int64()),
                         "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                         "first": pa.array([first_of[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())})
    return run


def _answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted sequences and the first document of each, of one group's answers."""
    hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), _U)
    first = np.frombuffer(b"".join(table.column("first").to_pylist()), np.int64)
    order = np.argsort(hashes, kind="stable")
    hashes, first = hashes[order], first[order]
    new = np.ones(hashes.size, bool)                 # a group may have been sent in pieces
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes[new], first[new]


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(known, asked)
    at[at == known.size] = 0
    return at, (known[at] == asked) if known.size else np.zeros(asked.size, bool)


def window_entries(buckets: int, window: int):
    """Group function: the windows whose anchor is shared, as packed index entries."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        shared, _ = _answers(answers)
        held = []
        if shared.size and docs.num_rows:
            docs = docs.filter(docs.column("doc_id").is_valid()).combine_chunks()
            ids = docs.column("doc_id").to_numpy()
            for w in words(docs.column("text").combine_chunks()):
                of_window, least, whole = anchors(w, window)
                ask = np.flatnonzero(whole)
                ask = ask[_find(shared, least[ask])[1]]
                if ask.size:
                    held.append((of_window[ask], ids[w.row + w.text_of()[ask]]))
        if not held:
            return pa.table({"bucket": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in _PACKED}})
        return pa.Table.from_batches([_entry_batch(_flush(held, buckets))])
    return run


def factors(first_doc: np.ndarray, hit: np.ndarray, window: int) -> list[dict]:
    """Greedy parse of one text: stretches of windows that stand in the same earlier document.

    ``hit[i]`` says that the window from word i on was found, ``first_doc[i]`` where.
    """
    at = np.flatnonzero(hit)
    if not at.size:
        return []
    cut = np.append(True, (at[1:] != at[:-1] + 1) | (first_doc[at[1:]] != first_doc[at[:-1]]))
    begins = at[np.flatnonzero(cut)]
    ends = at[np.append(np.flatnonzero(cut)[1:], at.size) - 1]
    return [{"start": int(a), "length": int(b - a + window), "ref_doc": int(first_doc[a])}
            for a, b in zip(begins, ends)]


def kept_text(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each text joined by one space: all bytes, and offsets of the texts."""
    start, size = w.start[keep], w.end[keep] - w.start[keep]
    out_end = np.cumsum(size + 1)
    out_start = out_end - size - 1
    total = int(out_end[-1]) if out_end.size else 0
    source = np.arange(total) + np.repeat(start - out_start, size + 1)
    data = np.append(w.data, np.uint8(32))[np.minimum(source, w.data.size)]
    data[out_end - 1] = 32
    of_text = np.searchsorted(np.flatnonzero(keep), w.first)      # kept words before each text
    bounds = np.append(0, out_end)[of_text]
    return data.tobytes(), bounds


def parse(window: int, carry_type: pa.DataType | None, want_text: bool):
    """Group function: parse the texts against the answers; spans out, texts without them."""
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known, first = _answers(answers)
        docs = docs.combine_chunks()
        ids = docs.column("doc_id")
        id_values = ids.fill_null(0).to_numpy()
        has_id = ids.is_valid().to_numpy()
        n_words, n_removed, digests, texts, spans = [], [], [], [], []
        text_column = docs.column("text")
        text_column = text_column.combine_chunks() if docs.num_rows else pa.array([], pa.string())
        for w in words(text_column):
            hit = np.zeros(w.start.size, bool)
            found = np.zeros(w.start.size, np.int64)
            of = w.text_of()
            if known.size:
                of_window, _, whole = anchors(w, window)
                at, seen = _find(known, of_window)
                hit = seen & whole & has_id[w.row + of]
                found = first[at]
                hit &= found < id_values[w.row + of]
            edge = np.zeros(hit.size + window + 1, np.int32)
            edge[:hit.size] += hit
            edge[window:window + hit.size] -= hit
            removed = np.cumsum(edge)[:hit.size] > 0
            data, bounds = kept_text(w, ~removed)
            lost = np.diff(np.append(0, np.cumsum(removed))[w.first])
            for i in range(w.n):
                a, b = w.first[i], w.first[i + 1]
                own = data[bounds[i]:max(bounds[i], bounds[i + 1] - 1)]
                digests.append(hashlib.sha256(own).hexdigest())
                if want_text:                        # untouched texts stay as they are
                    same = w.raw[w.bounds[i]:w.bounds[i + 1]].tobytes()
                    texts.append((own if lost[i] else same).decode())
                spans.append(factors(found[a:b], hit[a:b], window) if lost[i] else [])
            n_words.append(np.diff(w.first))
            n_removed.append(lost)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        out = {"doc_id": ids, "n_words": pa.array(join(n_words), pa.int64()),
               "n_removed": pa.array(join(n_removed), pa.int64()),
               "kept_sha256": pa.array(digests, pa.string()),
               "factors": pa.array(spans, pa.list_(pa.struct(
                   [("start", pa.int64()), ("length", pa.int64()), ("ref_doc", pa.int64())])))}
        if want_text:
            out["kept_text"] = pa.array(texts, pa.string())
        if carry_type is not None:
            out["carry"] = docs.column("carry")
        return pa.table(out)
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = WINDOW, carry: list[str] | None = None,
                    with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, factors
    (array of start, length, ref_doc in words), and on request ``kept_text`` (the text itself
    where nothing is removed, "" for null) and ``carry``."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    rows = doc_input(docs, id_col, text_col, carry).withColumn("grp", F.call_function("shiftright", "doc_id", F.lit(GROUP.bit_length() - 1)))
    # rows without an id need no answers; spread them by their text
    rows = rows.withColumn("grp", F.coalesce("grp", -1 - F.pmod(F.hash("text"), F.lit(2**20)).cast("long")
                                             - F.lit(2**61)))
    slim = rows.select("doc_id", "text", "grp")

    entries = slim.select("doc_id", "text").mapInArrow(anchor_entries(buckets, window), ENTRY)
    shared = checkpointed(entries.groupBy("bucket").applyInArrow(lookup(False), ANSWER), "rlz-anchors")
    asked = (slim.groupBy("grp").cogroup(shared.groupBy("grp"))
             .applyInArrow(window_entries(buckets, window), ENTRY))
    found = checkpointed(asked.groupBy("bucket").applyInArrow(lookup(True), ANSWER), "rlz-windows")

    out = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
           T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()),
           T.StructField("factors", T.ArrayType(T.StructType([
               T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
               T.StructField("ref_doc", T.LongType())])))]
    if with_text:
        out.append(T.StructField("kept_text", T.StringType()))
    carry_type = None
    if carry is not None:
        out.append(T.StructField("carry", rows.schema["carry"].dataType))
        carry_type = pa.struct([])
    return (rows.groupBy("grp").cogroup(found.groupBy("grp"))
            .applyInArrow(parse(window, carry_type, with_text), T.StructType(out)))
