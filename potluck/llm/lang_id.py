"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are the 2- to 4-byte subwords of its lower-cased words, with a space on
either side of a word, hashed into ``BUCKETS``. The text's vector is the mean of their
embeddings; a linear layer and a softmax give the languages. Embeddings and layer are
trained together by stochastic gradient descent in numpy, on a bounded sample:
``TRAIN_PER_LANG`` labelled rows per language (the smallest hashes of the id), at most
``TRAIN_ROWS`` in all, as subword counts, which are bounded by ``BUCKETS`` a row. A fifth
of them is set aside to calibrate: a temperature that fits the probabilities, and the
score below which a prediction is rejected, ``REJECT_SHARE`` of good rows at most.

Predictions run over all rows where they lie, without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected;
rows without a label or an id are predicted like any other, but not learned from; of rows that
share an id and a label one is learned from, the text with the smallest hash; with no rows to
learn from every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.llm.common import doc_input, hash_sample, limit_batches, one_text
from potluck.llm.words import SLICE_BYTES, letters_only, slices, text_buffers

BUCKETS = 1 << 14
DIM = 16
TRAIN_PER_LANG = 600
TRAIN_ROWS = 6_000
EPOCHS = 6
REJECT_SHARE = 0.001         # of calibration rows that may be rejected
REJECT_BELOW = 0.5           # no prediction with at least this score is rejected
UNKNOWN = "und"
_TABLE = letters_only()
_U = np.uint32


@dataclass
class LangModel:
    langs: list[str]
    weights: np.ndarray          # embeddings times layer: BUCKETS x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


def subwords(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of texts: first row, bounds of the texts in bytes, and for each length the
    bucket of the subword that begins at each byte with a mask of the subwords that count."""
    data, offsets = text_buffers(column)
    for at, to in slices(offsets, SLICE_BYTES):
        own = _TABLE[data[offsets[at]:offsets[to]]]
        bounds = offsets[at:to + 1] - offsets[at]
        n = own.size
        padded = np.concatenate([own, np.full(4, 32, np.uint8)]).astype(_U)
        row_end = np.repeat(bounds[1:], np.diff(bounds))
        code, spaces = padded[:n].copy(), (own == 32).astype(np.int8)
        grams = []
        for k in (2, 3, 4):
            nxt = padded[k - 1:n + k - 1]
            code = code | (nxt << _U(8 * (k - 1)))
            spaces = spaces + (nxt == 32)
            h = (code ^ _U(k * 0x9E3779B1 & 0xFFFFFFFF)) * _U(0x85EBCA6B)
            h ^= h >> _U(15)
            h = (h * _U(0xC2B2AE35)) >> _U(32 - 14)
            # inside one text, and not across a gap between words
            grams.append((h, (spaces <= 1) & (np.arange(n) + k <= row_end)))
        yield at, bounds, grams


def has_letter(column: pa.Array) -> np.ndarray:
    """Per text: does it hold a letter of any script?"""
    data, offsets = text_buffers(column)
    ascii_letter = np.append(0, np.cumsum(((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))))
    found = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: the share of each subword bucket in a text."""
    for batch in batches:
        ids, shares = [], []
        for _, bounds, grams in subwords(batch.column("text")):
            for a, b in zip(bounds[:-1], bounds[1:]):
                total = np.zeros(BUCKETS, np.int64)
                for h, good in grams:
                    total += np.bincount(h[a:b][good[a:b]], minlength=BUCKETS)
                at = np.flatnonzero(total)
                ids.append(at.astype(np.int32).tobytes())
                shares.append((total[at] / max(1, total.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "ids": pa.array(ids, pa.binary()),
                                          "shares": pa.array(shares, pa.binary())})


def train(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> LangModel | None:
    """Fit on a bounded sample of the rows where ``learn_from`` holds; None if there are none."""
    limit_batches(docs.sparkSession)
    labelled = docs.where(learn_from).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                                             F.col(f"`{lang_col}`").alias("lang"),
                                             F.col(f"`{text_col}`").alias("text")).where(
        "lang is not null and text is not null and doc_id is not null")
    # at most TRAIN_ROWS ids: a proven bound for the broadcast
    chosen = (hash_sample(labelled, "lang", TRAIN_PER_LANG).orderBy("rank", F.xxhash64("doc_id"), "lang").limit(TRAIN_ROWS)
              .select("doc_id", "lang"))
    rows = one_text(labelled.join(F.broadcast(chosen), ["doc_id", "lang"]), "doc_id", "lang").select("lang", "text")
    sample = rows.mapInArrow(_counts, "lang string, ids binary, shares binary").toArrow()
    return fit(sample.column("lang").to_pylist(),
               [np.frombuffer(x, np.int32) for x in sample.column("ids").to_pylist()],
               [np.frombuffer(x, np.float32) for x in sample.column("shares").to_pylist()])


def _batch(ids: list[np.ndarray], shares: list[np.ndarray], rows: np.ndarray):
    sizes = np.array([ids[r].size for r in rows])
    return (np.concatenate([ids[r] for r in rows]), np.concatenate([shares[r] for r in rows]),
            np.repeat(np.arange(rows.size), sizes))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labels: list[str], ids: list[np.ndarray], shares: list[np.ndarray]) -> LangModel | None:
    """SGD over embeddings and layer, then temperature and rejection on the rows set aside."""
    order = sorted((r for r in range(len(labels)) if ids[r].size),
                   key=lambda r: (labels[r], ids[r].size, ids[r].tobytes(), shares[r].tobytes()))
    if not order:
        return None
    langs = sorted({labels[r] for r in order})
    target = np.array([langs.index(lab) if lab in langs else -1 for lab in labels])
    rng = np.random.default_rng(7)
    order = rng.permutation(np.array(order))
    aside, used = order[: len(order) // 5], order[len(order) // 5:]
    embed = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    layer, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps = EPOCHS * -(-used.size // 16)
    step = 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(used)
        for a in range(0, mixed.size, 16):
            rows = mixed[a:a + 16]
            at, share, of = _batch(ids, shares, rows)
            mean = np.zeros((rows.size, DIM), np.float32)
            np.add.at(mean, of, embed[at] * share[:, None])
            error = _softmax(mean @ layer + bias)
            error[np.arange(rows.size), target[rows]] -= 1
            rate = 0.5 * (1 - step / steps)
            back = error @ layer.T
            layer -= rate * (mean.T @ error)
            bias -= rate * 0.01 * error.sum(axis=0)
            np.subtract.at(embed, at, rate * 8 * share[:, None] * back[of])
            step += 1
    weights = embed @ layer
    temperature, threshold = 1.0, 0.0
    if aside.size:
        at, share, of = _batch(ids, shares, aside)
        z = np.zeros((aside.size, len(langs)), np.float32)
        np.add.at(z, of, weights[at] * share[:, None])
        z += bias
        truth = target[aside]
        losses = {t: -np.log(_softmax(z / t)[np.arange(aside.size), truth] + 1e-12).mean()
                  for t in np.geomspace(0.05, 5, 40)}
        temperature = float(min(losses, key=losses.get))
        p = _softmax(z / temperature)
        good = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        threshold = float(min(REJECT_BELOW, good[int(REJECT_SHARE * good.size)])) if good.size else 0.0
    return LangModel(langs, weights.astype(np.float32), bias, temperature, threshold)


def classify(column: pa.Array, model: LangModel | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a column."""
    n = len(column)
    found, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    if model is None:
        return found, score, rejected
    lettered = has_letter(column)
    z = np.zeros((n, len(model.langs)))
    for at, bounds, grams in subwords(column):
        if not bounds[-1]:
            continue
        full = np.flatnonzero(np.diff(bounds) > 0)
        total = np.zeros((full.size, len(model.langs)))
        count = np.zeros(full.size)
        for h, good in grams:
            count += np.add.reduceat(good, bounds[full], dtype=np.int64)
            for c in range(len(model.langs)):
                each = model.weights[:, c][h]
                each[~good] = 0
                total[:, c] += np.add.reduceat(each, bounds[full], dtype=np.float64)
        z[at + full] = total / np.maximum(count, 1)[:, None]
    p = _softmax((z + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    score = np.where(lettered, p[np.arange(n), best] if n else score, 0.0)
    rejected = ~lettered | (score < model.reject_below)
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score, rejected


def identify(docs: DataFrame, model: LangModel | None, id_col: str = "doc_id", text_col: str = "text",
             carry: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, rejected; on request carry and text."""
    rows = doc_input(docs, id_col, text_col, carry)
    passed = ["doc_id"] + ["carry"] * (carry is not None) + ["text"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, offsets = text_buffers(whole.column("text"))
            for at, to in slices(offsets, SLICE_BYTES):          # small batches go out as well
                batch = whole.slice(at, to - at)
                found, score, rejected = classify(batch.column("text"), model)
                yield pa.RecordBatch.from_pydict(
                    {c: batch.column(c) for c in ("doc_id", "carry", "text") if c in passed}
                    | {"lang_pred": pa.array(found, pa.string()), "score": pa.array(score, pa.float64()),
                       "rejected": pa.array(rejected, pa.bool_())})

    fields = [T.StructField("doc_id", T.LongType())]
    if carry is not None:
        fields.append(T.StructField("carry", rows.schema["carry"].dataType))
    if keep_text:
        fields.append(T.StructField("text", T.StringType()))
    fields += [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
               T.StructField("rejected", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType(fields))


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary")), F.lit(modulus))
