"""Token counts under a unigram vocabulary by dynamic programming over a trie.

A text's pre-tokens are its words with a space sign in front. A task inserts the distinct
ones that a batch brings for the first time into a trie, in sorted order, and walks it depth
first: the walk keeps one state per character of the current path, so the forward scores of
a shared prefix are computed once, however many pre-tokens continue it. A state holds

* the log-probability of the prefix over all its segmentations (forward score),
* the score and the number of tokens of its best segmentation (fewer tokens on ties).

Terminal states, that is the token count and forward score of whole pre-tokens, are kept in
a table of bounded size; texts sum them up over all their pre-tokens. Nothing is shuffled.

Characters that are no piece cost ``UNKNOWN`` and one token for each byte of UTF-8.

Defined cases: null and empty texts have no pre-tokens, 0 tokens and score 0; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from potluck.llm.common import doc_input
from potluck.llm.piece_bpe import SPACE, load
from potluck.llm.words import slices, text_buffers

UNKNOWN = -20.0              # log-probability of each byte of a character that is no piece
KEPT = 300_000               # terminal states kept by a worker
KEPT_CHARS = 60              # longer pre-tokens are computed each time they occur
BATCH_BYTES = 4 << 20
_WORD = re.compile("[^\t-\r ]+")
_tables: dict[str, "TrieCounter"] = {}


def zipf_scores(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a merge-type vocabulary: 1 / (rank + 2), normalized.

    The file has merge ranks and no probabilities; nothing is trained here."""
    rank = load(path).rank
    total = math.log(sum(1 / (r + 2) for r in rank.values()))
    return {p: -math.log(r + 2) - total for p, r in rank.items()}


class TrieCounter:
    """Forward scores and token counts of pre-tokens under piece log-probabilities."""

    def __init__(self, scores: dict[str, float]):
        # every ending of a piece is a key, so that a walk back from a character knows when
        # no longer piece can end there; None marks endings that are no pieces themselves
        self.endings: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))}
        self.endings.update(scores)
        self.terminals: dict[str, tuple[int, float]] = {}

    def insert(self, words: list[str]) -> None:
        """Terminal states of distinct words, by a depth-first walk over their trie.

        A state's forward score is kept as ``base + log(ratio)``."""
        endings, terminals, exp = self.endings, self.terminals, math.exp
        best, count, base, ratio = [0.0], [0], [0.0], [1.0]      # along the path; depth 0 first
        last = ""
        for plain in sorted(words):
            word = SPACE + plain
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], count[shared + 1:], base[shared + 1:], ratio[shared + 1:]
            for depth in range(shared + 1, len(word) + 1):
                top, tokens, ways = -math.inf, 0, []
                for at in range(depth - 1, -1, -1):
                    score, many = endings.get(word[at:depth], 0.0), 1
                    if score is None or score == 0.0:
                        if at < depth - 1:
                            if score is None:
                                continue
                            break
                        many = len(word[at].encode("utf-8", "surrogatepass"))
                        unknown = score == 0.0
                        score = UNKNOWN * many
                    else:
                        unknown = False
                    total = best[at] + score
                    if total > top or total == top and count[at] + many < tokens:
                        top, tokens = total, count[at] + many
                    ways.append((at, score))
                    if unknown:
                        break
                best.append(top)
                count.append(tokens)
                if len(ways) == 1:
                    at, score = ways[0]
                    base.append(base[at] + score)
                    ratio.append(ratio[at])
                else:
                    r = 0.0
                    for at, score in ways:
                        r += ratio[at] * exp(base[at] + score - top)
                    if r > 1e100:
                        base.append(top + math.log(r))
                        ratio.append(1.0)
                    else:
                        base.append(top)
                        ratio.append(r)
            terminals[plain] = count[-1], base[-1] + math.log(ratio[-1])
            last = word

    def count(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, forward score) of each text."""
        if len(self.terminals) > KEPT:
            self.terminals.clear()
        terminals = self.terminals
        cut = [_WORD.findall(t) for t in texts]
        new = set().union(*cut).difference(terminals)
        self.insert(list(new))
        out = []
        for words in cut:
            found = [terminals[w] for w in words]
            out.append((len(found), sum([f[0] for f in found]), math.fsum([f[1] for f in found])))
        for w in new:
            if len(w) > KEPT_CHARS:
                del terminals[w]
        return out


def counter(path: str) -> TrieCounter:
    """The counter of the vocabulary at ``path``; one for each worker process."""
    if path not in _tables:
        _tables[path] = TrieCounter(zipf_scores(path))
    return _tables[path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens, forward_score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(model_path)
        for batch in batches:
            column = batch.column("text").fill_null("")
            _, offsets = text_buffers(column)
            for at, to in slices(offsets, BATCH_BYTES):
                found = table.count(column.slice(at, to - at).to_pylist())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(at, to - at),
                    "n_words": pa.array([f[0] for f in found], pa.int64()),
                    "n_tokens": pa.array([f[1] for f in found], pa.int64()),
                    "forward_score": pa.array([f[2] for f in found], pa.float64())})
    return doc_input(docs, id_col, text_col).mapInArrow(run, T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("forward_score", T.DoubleType())]))
