"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is a bag of sentences. A sentence's probability of being toxic is a logistic
score of its hashed words; the document's is the noisy-or of its sentences,
``1 - prod(1 - p)``. Only documents carry labels: the gradient of the document's likelihood
reaches each sentence through the noisy-or, so the model learns which sentences offend and
can point to them.

The model is fitted in numpy on a bounded sample: of each label the ``TRAIN_ROWS`` labelled
documents with the smallest id hashes, of up to ``TRAIN_WORDS`` words each (longer
ones are not learned from), and of these, in the order of the hashes and in the same
proportion of both labels, as many as fit into ``TRAIN_BYTES``. Scoring covers whole texts of all rows where they lie, without
a shuffle.

A sentence ends at ``. ! ?`` or a line end. Words are runs of letters, A-Z lower-cased.
A word's features are its first 4 to 7 bytes, or the whole of a shorter word: stems, which
inflected forms share, rather than rare words that a model of few documents would memorize.

Defined cases: null and empty texts have no sentences and score 0; repeated label rows
count once; of documents that share an id one is learned from, the text with the smallest
hash; an id with both labels is learned from with both; labels other than 0 and 1, or null, are not learned from; with
nothing to learn from every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.llm.common import checkpointed, doc_input, hash_sample, one_text
from potluck.llm.words import Words, letters_only, words

BITS = 18
PREFIXES = (4, 5, 6, 7)      # bytes
TRAIN_ROWS = {1: 2_500, 0: 7_500}    # training documents of each label at most
TRAIN_WORDS = 20_000
TRAIN_BYTES = 96 << 20       # of the training rows, as the driver receives them
EPOCHS = 20
RATE = 0.1
DECAY = 5e-4                 # of a word's weight, each time a document with it is seen
THRESHOLD = 0.7              # a document with this score is predicted toxic
LOCATE = 0.5                 # a sentence with this score is reported
START_BIAS = -4.0
MIN_DOCS = 4                 # words of fewer training documents get no weight
_TABLE = letters_only()
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


@dataclass
class MilModel:
    weights: np.ndarray          # 2**BITS word weights
    bias: float


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of each word (0: none), the first word of each sentence, and each
    sentence's text. Sentences without words are left out."""
    whole = w.hashes()
    whole[w.end - w.start > PREFIXES[-1]] = 0
    features = np.column_stack([whole, w.prefix_hashes(PREFIXES)])
    buckets = (features >> np.uint64(64 - BITS)).astype(np.int32)
    ends = np.cumsum(_END[w.raw])
    of_text = w.text_of()
    mark = ends[w.start] if w.start.size else np.zeros(0, np.int64)
    new = np.ones(mark.size, bool)
    new[1:] = (mark[1:] != mark[:-1]) | (of_text[1:] != of_text[:-1])
    begin = np.flatnonzero(new)
    return buckets, begin, of_text[begin]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: the buckets of the distinct words, the number of each word among them
    (TRAIN_WORDS fit 16 bits), and the number of words of each sentence."""
    for batch in batches:
        buckets, places, sizes = [], [], []
        for w in words(batch.column("text"), table=_TABLE):
            bucket, begin, text = sentences(w)
            size = np.diff(np.append(begin, w.start.size)).astype(np.int32)
            cut = np.searchsorted(text, np.arange(w.n + 1))
            for i in range(w.n):
                a, b = w.first[i], w.first[i + 1]
                if b - a > TRAIN_WORDS:
                    buckets.append(None)
                    places.append(None)
                    sizes.append(None)
                    continue
                distinct, place = np.unique(bucket[a:b], axis=0, return_inverse=True)
                buckets.append(distinct.tobytes())
                places.append(place.astype(np.uint16).tobytes())
                sizes.append(size[cut[i]:cut[i + 1]].tobytes())
        yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("doc_id", "toxic", "rank")},
                                          "buckets": pa.array(buckets, pa.binary()),
                                          "places": pa.array(places, pa.binary()),
                                          "sizes": pa.array(sizes, pa.binary())})


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> MilModel | None:
    """Fit on a bounded sample of the labelled rows where ``learn_from`` (on the id) holds."""
    known = (labels.where(learn_from)
             .select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
             .where("toxic in (0, 1) and doc_id is not null"))
    chosen = hash_sample(known, "toxic", TRAIN_ROWS)             # two labels: a proven bound
    rows = doc_input(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").where("text is not null")
    bags = checkpointed(one_text(rows, "doc_id", "toxic", "rank").select("doc_id", "text", "toxic", "rank").mapInArrow(
        _bags, "doc_id long, toxic int, rank int, buckets binary, places binary, sizes binary").where("buckets is not null"), "toxicity-bags")
    part = F.col("rank") / F.when(F.col("toxic") == 1, TRAIN_ROWS[1]).otherwise(TRAIN_ROWS[0])
    size = F.length("buckets") + F.length("places") + F.length("sizes")
    end, total = 0.0, 0
    for r in bags.select(part.alias("part"), size.alias("size")).orderBy("part", "size").collect():
        total += r.size
        if total > TRAIN_BYTES:
            break
        end = r.part
    bags = bags.where(part <= end).toArrow()
    return fit(bags.column("doc_id").to_pylist(), bags.column("toxic").to_pylist(),
               [b.reshape(-1, 1 + len(PREFIXES)) for b in _views(bags.column("buckets"), np.int32)],
               list(_views(bags.column("places"), np.uint16)), list(_views(bags.column("sizes"), np.int32)))


def _views(column: pa.ChunkedArray, kind: type) -> Iterator[np.ndarray]:
    """The values of a binary column as arrays over its own memory."""
    for chunk in column.chunks:
        for value in chunk:
            yield np.frombuffer(value.as_buffer(), kind)


def fit(ids: list[int], labels: list[int], buckets: list[np.ndarray], places: list[np.ndarray],
        sizes: list[np.ndarray]) -> MilModel | None:
    """SGD over documents; the noisy-or passes a document's error to sentences and words.

    The words of document r are the rows ``places[r]`` of ``buckets[r]``.

    Weights decay whenever their words occur, so that only words that keep explaining
    labels stay heavy: the stems of insults, not the rare words of single documents."""
    order = sorted((r for r in range(len(ids)) if sizes[r].size), key=lambda r: (ids[r], buckets[r].tobytes(), places[r].tobytes()))
    if not order:
        return None
    rng = np.random.default_rng(11)
    weights, bias = np.zeros(1 << BITS), START_BIAS
    held = {r: np.unique(buckets[r]) for r in order}
    holders = np.zeros(1 << BITS, np.int32)
    for r in order:
        holders[held[r]] += 1
    holders[0] = 0
    learned = holders >= MIN_DOCS
    offsets = {r: np.append(0, np.cumsum(sizes[r]))[:-1].astype(np.int32) for r in order}
    for epoch in range(EPOCHS):
        rate = RATE * (1 - 0.8 * epoch / EPOCHS)
        for r in rng.permutation(np.array(order)):
            at = buckets[r][places[r]]
            z = np.add.reduceat(weights[at].sum(axis=1), offsets[r]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            # d loss / d z of each sentence under the noisy-or
            pull = p if not labels[r] else -p * min(clean / max(1 - clean, 1e-9), 1 / max(p.max(), 1e-9))
            each = rate * np.repeat(pull, sizes[r])
            np.subtract.at(weights, at, each[:, None] * learned[at])
            weights[held[r]] *= 1 - DECAY
            bias = min(bias - 0.02 * float(np.clip(pull.sum(), -1, 1)), START_BIAS / 2)
    return MilModel(weights.astype(np.float32), float(bias))


def score_texts(column: pa.Array, model: MilModel | None) -> tuple[np.ndarray, list[list[dict]]]:
    """Document scores, and for each document the sentences that offend (byte range, score)."""
    n = len(column)
    score, located = np.zeros(n), [[] for _ in range(n)]
    if model is None:
        return score, located
    for w in words(column, table=_TABLE):
        buckets, begin, text = sentences(w)
        if not begin.size:
            continue
        z = np.add.reduceat(model.weights[buckets].sum(axis=1, dtype=np.float64), begin) + model.bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), w.n)
        score[w.row:w.row + w.n] = -np.expm1(quiet)
        last = np.append(begin[1:], w.start.size) - 1
        for s in np.flatnonzero(p >= LOCATE):
            base = w.bounds[text[s]]
            located[w.row + text[s]].append({"start": int(w.start[begin[s]] - base),
                                             "end": int(w.end[last[s]] - base), "score": float(p[s])})
    return score, located


def score(docs: DataFrame, model: MilModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, predicted, and the offending sentences as
    (start, end) byte ranges of the UTF-8 text with their scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, located = score_texts(batch.column("text"), model)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()),
                "predicted": pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32()),
                "sentences": pa.array(located, pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))})

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("score", T.DoubleType())])
    return doc_input(docs, id_col, text_col).mapInArrow(run, T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()), T.StructField("sentences", T.ArrayType(span))]))
