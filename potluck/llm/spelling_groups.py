"""Spelling variants of a corpus' words: near words by a relational trie frontier.

Words are counted over all texts. Two words are near if they differ by exactly one inserted,
deleted or replaced code point. A word's form is its near word of the largest count (equal
counts: the smallest in code-point order), where that is at least twice the word's own; its
root is where the forms lead to.

The words, and the words read backwards, are held as an edge table of compressed tries: nodes
are prefixes at which words branch, end or begin to be searched, an edge has the code points
between two nodes. A search is a table of states (word, position, node, edits) that is joined
with the edge table level by level: an edge that continues the word keeps the number of edits,
another first code point spends the one edit (a replacement, or an insertion into the word; a
deletion is an insertion seen from the other word). A state that has spent it goes on along
matching edges only, and is a near word where it ends with a word.

Two words at one edit share their first or their last half, so a state starts at the node of
the first half of the word, in either direction, and only the parts of the tries below such
nodes are built; no state passes the crowded nodes near the root. An edge carries a sieve of
what may follow its child: a bit for each ending of ``AHEAD`` code points and its length, up
to the end of the word; a state that has spent its edit and finds no bit for the rest of its
word cannot end, and is left out at once. Nodes that many words pass have several copies of
their edges (``PER_COPY`` words each), which their states are spread over. Levels are as many as branching nodes lie below each other, whatever the length of the
words. Each level is a written table; a level whose states fit into ``BROADCAST_BYTES``, as
counted, is broadcast to the edges instead of shuffling both.

Nodes are 64-bit hashes of prefixes. A collision only adds paths, as edges are kept by their
text; near words are held against Spark's exact edit distance in the end.

Defined cases: null texts have no words; rows that share an id or have none count like any
others, a missing id is the empty text in the hash of a run; words of any length; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.llm.common import checkpointed, doc_input, limit_batches
from potluck.llm.words import _pow, mix

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT, DROP_EVERY = 5, 3, 97
FACTOR = 2                       # a form occurs so many times as often, at least
PER_COPY = 4096                  # words that pass a node, for each copy of its edges
BROADCAST_BYTES = 2 << 20
AHEAD, SIEVE = 12, 8             # code points looked ahead; 64-bit words of a sieve
LENGTH_STEP = 2654435761         # odd; spreads lengths over the bits
BATCH_CHARS = 200_000            # code points of words whose prefixes are listed at a time
_U = np.uint64


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) over all texts; a run whose hash ``DROP_EVERY`` divides lacks one code point."""
    runs = doc_input(docs, id_col, text_col).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("of"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= min_chars)          # runs only become shorter
    ascii_only = F.octet_length("run") == F.char_length("run")
    low = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    hashed = runs.select(low.alias("run"), "of").select(
        "run", F.crc32(F.concat("of", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % DROP_EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(
        "run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    found = hashed.select(word.alias("word")).where(F.char_length("word") >= min_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# ---- the tries --------------------------------------------------------------------------

def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and direction: the nodes of its prefixes from just before its half on, with
    the code point that follows (-1 at the end)."""
    code = np.arange(0x110000, dtype=_U)
    value = mix(code * _U(0x9E3779B97F4A7C15) + _U(1))
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("wid").to_numpy()
        row = 0
        while row < len(words):
            to, size = row, 0
            while to < len(words) and (to == row or size + len(words[to]) <= BATCH_CHARS):
                size += len(words[to])
                to += 1
            lengths = np.fromiter(map(len, words[row:to]), np.int64, to - row)
            for backwards in (False, True):
                text = "".join(w[::-1] for w in words[row:to]) if backwards else "".join(words[row:to])
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                up, down = _pow(points.size + 1)
                total = np.zeros(points.size + 1, _U)
                np.cumsum(value[points] * up[:points.size], out=total[1:])
                first = np.cumsum(lengths) - lengths
                half = lengths // 2 if backwards else (lengths + 1) // 2
                low = (lengths - 1) // 2 if backwards else lengths // 2
                many = lengths - low + 1
                ends = np.cumsum(many)
                pos = np.arange(int(ends[-1])) - np.repeat(ends - many - low, many)
                start, length = np.repeat(first, many), np.repeat(lengths, many)
                node = mix((total[start + pos] - total[start]) * down[start] + pos.astype(_U) + _U(backwards << 40))
                rest = [text[a:min(a + AHEAD, b)] for a, b in zip((start + pos).tolist(), (start + length).tolist())]
                ahead = np.fromiter((zlib.crc32(r.encode()) for r in rest), np.int64, pos.size)
                ahead = (ahead + (length - pos) * LENGTH_STEP) & 0xFFFFFFFF
                following = np.append(points, -1)[start + pos]
                following[pos == length] = -1
                yield pa.RecordBatch.from_pydict({
                    "wid": pa.array(np.repeat(ids[row:to], many)), "backwards": pa.array(np.full(pos.size, backwards)),
                    "pos": pa.array(pos.astype(np.int32)), "node": pa.array(node.view(np.int64)),
                    "following": pa.array(following.astype(np.int32)),
                    "half": pa.array(pos == np.repeat(half, many)), "ahead": pa.array(ahead)})
            row = to


def _tries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The states at the halves of all words, and the edge table.

    Edges: parent, copy, label, child, child_copies, sieve of the child, target and target_n
    (the word that ends with the child, if one does)."""
    steps = checkpointed(words.select("wid", "word").mapInArrow(
        _prefixes, "wid long, backwards boolean, pos int, node long, following int, half boolean, ahead long"), "spelling-prefixes")
    slot, bit = _bit(F.col("ahead"))
    nodes = steps.groupBy("node").agg(
        F.min("following").alias("a"), F.max("following").alias("b"), F.max("half").alias("half"), F.count("*").alias("n"),
        *[F.bit_or(F.when(slot == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(SIEVE)])
    kept = checkpointed(nodes.where("half or a = -1 or a <> b").select(
        "node", (1 + F.expr(f"n div {PER_COPY}")).alias("copies"), F.array(*[f"s{k}" for k in range(SIEVE)]).alias("sieve")), "spelling-nodes")
    stops = steps.join(kept.select("node", "copies"), "node").groupBy("wid", "backwards").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", "copies", "half"))).alias("stops"))
    lines = checkpointed(stops.join(words, "wid").select(
        F.when(F.col("backwards"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "n", "backwards", "stops"), "spelling-lines")

    at = F.filter("stops", lambda s: s["half"])[0]
    starts = lines.select("word", "n", "backwards", at["pos"].alias("pos"), at["node"].alias("node"),
                          _copy(F.col("word"), at["copies"]).alias("copy"), F.lit(0).alias("edits"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda i: F.struct(
        F.get("stops", i - 1).alias("a"), F.get("stops", i).alias("b")))
    each = lines.where(F.size("stops") > 1).select("word", "n", F.explode(pairs).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    ends = b["pos"] == F.char_length("word")
    edges = each.select(
        a["node"].alias("parent"), a["copies"].alias("copies"), F.substring("word", a["pos"] + 1, b["pos"] - a["pos"]).alias("label"),
        b["node"].alias("child"), b["copies"].alias("child_copies"), F.when(ends, F.col("word")).alias("target"),
        F.when(ends, F.col("n")).alias("target_n"))
    edges = edges.groupBy("parent", "copies", "label", "child", "child_copies").agg(
        F.max("target").alias("target"), F.max("target_n").alias("target_n"))
    edges = edges.join(kept.select(F.col("node").alias("child"), "sieve"), "child")
    edges = edges.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    return starts, checkpointed(edges, "spelling-edges")


def _bit(ahead: Column) -> tuple[Column, Column]:
    """Place in the sieve: number of the word, and the bit as a word."""
    one = F.lit(1).cast("long")
    return (F.shiftright(ahead, 6) % SIEVE).cast("int"), F.call_function("shiftleft", one, (ahead % 64).cast("int"))


def _ahead(word: Column, pos: Column) -> Column:
    """What ``_prefixes`` says of the rest of a word."""
    ends = F.crc32(F.substring(word, pos + 1, F.lit(AHEAD)).cast("binary"))
    return (ends + (F.char_length(word) - pos).cast("long") * LENGTH_STEP) % (1 << 32)


def _copy(word: Column, copies: Column) -> Column:
    return F.pmod(F.xxhash64(word), copies)


# ---- the frontier -----------------------------------------------------------------------

def _level(states: DataFrame, edges: DataFrame, small: bool) -> DataFrame:
    """The states that one edge leads to, with the target where a state has ended."""
    met = (F.broadcast(states) if small else states).join(
        edges, (F.col("node") == F.col("parent")) & (states["copy"] == edges["copy"])).drop("copy")
    word, pos, label = F.col("word"), F.col("pos"), F.col("label")
    length, step = F.char_length(word), F.char_length(label)
    here = F.substring(word, pos + 1, F.lit(1))              # empty at the end of the word
    first, rest = F.substring(label, 1, 1), F.substring(label, F.lit(2), step)
    fresh, other = F.col("edits") == 0, first != here

    def to(when: Column, position: Column, edits: Column) -> Column:
        return F.when(when, F.struct(position.cast("int").alias("pos"), edits.cast("int").alias("edits")))
    moves = F.array(
        to(F.substring(word, pos + 1, step) == label, pos + step, F.col("edits")),
        # a replacement is found from the word with the smaller code point
        to(fresh & (here != "") & (first > here) & (rest == F.substring(word, pos + 2, step - 1)), pos + step, F.lit(1)),
        to(fresh & other & (rest == F.substring(word, pos + 1, step - 1)), pos + step - 1, F.lit(1)))
    moved = met.withColumn("move", F.explode(moves)).where("move is not null")
    spent = F.col("move.edits") == 1
    done = spent & (F.col("move.pos") == length)
    slot, bit = _bit(_ahead(word, F.col("move.pos")))
    may_end = F.get("sieve", slot).bitwiseAND(bit) != 0
    return moved.where(F.when(done, F.col("target").isNotNull()).when(spent, may_end).otherwise(F.lit(True))).select(
        "word", "n", "backwards", F.col("move.pos").alias("pos"), F.col("child").alias("node"),
        _copy(word, F.col("child_copies")).alias("copy"), F.col("move.edits").alias("edits"),
        F.when(done, F.col("target")).alias("target"), F.when(done, F.col("target_n")).alias("target_n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of near words, in both directions, once each."""
    states, edges = _tries(words)
    found = None
    while True:
        rows, chars = states.agg(F.count("*"), F.sum(F.octet_length("word"))).first()    # two numbers
        if not rows:
            break
        level = checkpointed(_level(states, edges, chars + 64 * rows <= BROADCAST_BYTES), "spelling-level")
        hits = level.where("target is not null")
        found = hits if found is None else found.unionByName(hits)
        states = level.where("target is null").drop("target", "target_n")
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    turned = [F.when(F.col("backwards"), F.reverse(c)).otherwise(F.col(c)).alias(c) for c in ("word", "target")]
    pairs = found.select(turned[0], "n", turned[1], "target_n").where(F.levenshtein("word", "target", 2) == 1).distinct()
    return pairs.select("word", "n", F.col("target").alias("near"), F.col("target_n").alias("near_n")).unionByName(
        pairs.select(F.col("target").alias("word"), F.col("target_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last, in doubling steps. Counts
    at least double along a form, so the rounds are few."""
    reached = checkpointed(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = checkpointed(reached.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        reached = further.select("word", "root")
        if further.where("moved").limit(1).count() == 0:
            return reached


def spelling_groups(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n) → word, form, root, n, n_near, form_n; one row per word."""
    limit_batches(words.sparkSession)
    words = checkpointed(words.select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    best_n = -F.col("best.order")
    judged = words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(best_n >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), best_n.alias("form_n"))).alias("to"))
    judged = checkpointed(judged.select("word", "n", "n_near", "to.form", "to.form_n"), "spelling-forms")
    return judged.join(roots(judged.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
