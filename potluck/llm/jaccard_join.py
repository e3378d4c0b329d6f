"""Similarity join on word shingles through a MinHash LSH forest, with exact verification.

A text's shingles are its runs of ``SHINGLE`` words; two documents are linked if the Jaccard
similarity of their shingle sets is at least ``THRESHOLD``.

1. *Classes.* Documents with equal sets form a class; one row of its smallest id stands for
   it and only these rows are compared. Copies count as links of their class. Rows are told
   apart by a number that the table of signatures gives them, since ids may repeat.
2. *Forest.* A signature has ``TREES`` tries; a document's path in a trie is a sequence of
   min-hashes. Matching starts from the full depth and shortens the prefix until documents
   at the threshold meet in some trie with probability ``RECALL`` (``depth_for``). Documents
   that share a prefix of that length are gathered; lone ones drop out.
3. *Screen.* Gathered signatures are compared; pairs whose share of equal min-hashes is more
   than ``SLACK`` standard deviations below the threshold drop out. A pair counts only in
   the first trie where it meets.
4. *Verification.* The texts that are left are compared exactly, within the node where they
   met. Nodes of more than ``BLOCK`` documents are cut into blocks, and each pair of blocks
   is one unit of work. A unit returns the number of links of each document and a spanning
   forest of its links, never the pairs themselves, so that a large group of near copies
   costs rows in proportion to its members.
5. *Groups* are the connected components of the links, found by alternating star contraction.

Defined cases: null and empty texts have no shingles, link to nothing and are groups of
their own; texts of fewer than ``SHINGLE`` words have one shingle, all their words; rows with
the same id and the same shingles are one document: they count once and are not linked to
each other; rows with the same id and other shingles are documents of their own, each with
its own class, group and links; rows without an id are linked to nothing and have null class
and group; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.llm.common import checkpointed, doc_input
from potluck.llm.words import Words, mix, windows, words

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6                    # full depth of a trie
RECALL = 0.9999
SLACK = 4.5
BLOCK = 512
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(5).integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_SHIFTS = np.random.default_rng(6).integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which the forest finds pairs at the threshold often enough."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** TREES < recall:
        depth -= 1
    return depth


def shingles(w: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    h = w.hashes()
    hashed, whole = windows(h, w.first, k)
    short = {n: windows(h, w.first, n)[0] for n in range(1, k)
             if np.any(np.diff(w.first) == n)}
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        n = b - a
        found = hashed[a:b][whole[a:b]] if n >= k else short[n][a:a + 1] if n else hashed[a:a]
        found = np.sort(found)
        if found.size > 1:
            found = found[np.append(True, found[1:] != found[:-1])]
        out.append(found)
    return out


def signatures(sets: list[np.ndarray], depth: int) -> np.ndarray:
    """Min-hashes of non-empty sets: one row each, TREES * depth columns of 32 bits."""
    out = np.empty((len(sets), TREES * depth), np.uint32)
    if sets:
        bounds = np.append(0, np.cumsum([s.size for s in sets]))[:-1]
        values = (np.concatenate(sets) >> _U(32)).astype(np.uint32)
        for c in range(TREES * depth):
            f = (c // depth) * DEPTH + c % depth
            out[:, c] = np.minimum.reduceat((values ^ _SHIFTS[f]) * _MULTIPLIERS[f], bounds)
    return out


def _sign(depth: int):
    """Task function: the rows with digest of the shingle set and signature, where a text has one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column("text")):
                sets = shingles(w)
                some = [i for i, s in enumerate(sets) if s.size]
                sig = signatures([sets[i] for i in some], depth)
                digests, signs = [None] * w.n, [None] * w.n
                for row, i in enumerate(some):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    signs[i] = sig[row].tobytes()
                part = batch.slice(w.row, w.n)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
                    [*part.schema.names, "digest", "sig"])
    return run


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _paths(depth: int):
    """Task function: the node of each representative in every trie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("sig"), TREES * depth).astype(_U)
            row = batch.column("row").to_numpy()
            for tree in range(TREES):
                node = np.full(row.size, tree + 1, _U)
                for c in range(tree * depth, (tree + 1) * depth):
                    node = mix(node ^ sig[:, c]) + _U(c)
                yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(row.size, tree, np.int32)),
                                                  "node": pa.array(node.view(np.int64)), "row": pa.array(row)})
    return run


def _meet(x: np.ndarray, y: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Pairs (rows of x by rows of y) that meet in ``tree`` and in no trie before it."""
    first = np.ones((len(x), len(y)), bool)
    for t in range(tree + 1):
        same = np.ones_like(first)
        for c in range(t * depth, (t + 1) * depth):
            same &= x[:, c][:, None] == y[:, c]
        first &= same if t == tree else ~same
    return first


def _sides(table: pa.Table) -> tuple[int, bool, np.ndarray, np.ndarray]:
    """Trie, whether the unit is one block with itself, and the rows of its two sides."""
    side = table.column("side").to_numpy()
    alone = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    left = np.flatnonzero(side == 0)
    return table.column("tree")[0].as_py(), alone, left, left if alone else np.flatnonzero(side == 1)


UNIT = ["tree", "node", "lo", "hi"]


def _screen(depth: int, threshold: float):
    """Unit function: the documents that may have a link here."""
    width = TREES * depth
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / width)

    def run(table: pa.Table) -> pa.Table:
        tree, alone, left, right = _sides(table)
        sig = _matrix(table.column("sig"), width)
        pairs = _meet(sig[left], sig[right], tree, depth)
        if alone:
            pairs = np.triu(pairs, 1)
        if pairs.any():
            equal = np.zeros(pairs.shape, np.int16)
            for c in range(width):
                equal += sig[left, c][:, None] == sig[right, c]
            pairs &= equal >= least * width
        keep = np.zeros(table.num_rows, bool)
        keep[left[pairs.any(axis=1)]] = True
        keep[right[pairs.any(axis=0)]] = True
        return table.select([*UNIT, "side", "row"]).filter(pa.array(keep))
    return run


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y.

    Products of 0/1 matrices over the values that both sides hold, some columns at a time."""
    out = np.zeros((len(x), len(y)), np.float32)
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    for a in range(0, both.size, 4096):
        part = both[a:a + 4096]
        grids = []
        for side in (x, y):
            grid = np.zeros((len(side), part.size), np.float32)
            for r, s in enumerate(side):
                at = np.searchsorted(part, s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")])
                own = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                grid[r, at[part[np.minimum(at, part.size - 1)] == own]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs (row numbers), by union-find."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i
    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _verify(depth: int, threshold: float):
    """Unit function: exact similarities; links of each document, spanning forest of them."""
    def run(table: pa.Table) -> pa.Table:
        sets: list[np.ndarray] = []
        for w in words(table.column("text").combine_chunks()):
            sets.extend(shingles(w))
        tree, alone, left, right = _sides(table)
        sig = signatures(sets, depth)
        pairs = _meet(sig[left], sig[right], tree, depth)
        if alone:
            pairs = np.triu(pairs, 1)
        size = np.array([s.size for s in sets])
        shared = overlaps([sets[i] for i in left], [sets[i] for i in right])
        either = size[left][:, None] + size[right][None, :] - shared
        # shared / either >= threshold, in whole numbers
        pairs &= np.round(shared).astype(np.int64) * 10**6 >= np.round(threshold * 10**6) * np.round(either)
        weight = table.column("weight").to_numpy()
        links = np.zeros(len(sets), np.int64)
        np.add.at(links, left, pairs @ weight[right])
        np.add.at(links, right, weight[left] @ pairs)
        at = np.argwhere(pairs)
        edges = _forest(np.column_stack([left[at[:, 0]], right[at[:, 1]]]).tolist(), len(sets))
        linked = np.flatnonzero(links)
        one = pa.array([*linked.tolist(), *[a for a, _ in edges]], pa.int64())
        two = pa.array([None] * linked.size + [b for _, b in edges], pa.int64())
        return pa.table({
            "cls": table.column("cls").take(one), "row": table.column("row").take(one),
            "other_cls": table.column("cls").take(two), "other_row": table.column("row").take(two),
            "links": pa.array(np.concatenate([links[linked], np.zeros(len(edges), np.int64)]), pa.int64())})
    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the connected component of every id in ``edges`` (a, b).

    Alternating large-star and small-star contraction; each round is written to the shared
    folder, so lineage stays short."""
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .where("a > b").distinct(), "links")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .where("a > b").distinct()
        large = checkpointed(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x > m") \
            .union(least.select("a", "m")).toDF("a", "b").distinct()
        small = checkpointed(small, "small-star")
        if small.exceptAll(now).isEmpty() and now.exceptAll(small).isEmpty():
            break
        now = small
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _grouped(rows: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The numbered rows with the digests of their sets; and one row per class: digest, me and
    root (smallest id and number of the row that stands for the class, and for its group), n_links."""
    depth = depth_for(threshold, recall)
    schema = T.StructType([*rows.schema.fields, T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    # numbers are fixed once they are written
    signed = checkpointed(rows.mapInArrow(_sign(depth), schema).withColumn("row", F.monotonically_increasing_id()), "signed")
    known = signed.where("doc_id is not null and digest is not null")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("cls"), F.min_by("row", "doc_id").alias("row"),
                                          F.count_distinct("doc_id").alias("weight"))
    reps = checkpointed(known.select("row", "sig").join(classes, "row"), "classes")

    paths = reps.select("row", "sig").mapInArrow(_paths(depth), "tree int, node long, row long")
    shared = paths.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = (paths.join(shared, ["tree", "node"])
           .withColumn("own", F.pmod(F.xxhash64("row"), blocks).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
           .select("tree", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                   F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "row"))
    screened = checkpointed(
        met.join(reps.select("row", "sig"), "row").groupBy(*UNIT)
        .applyInArrow(_screen(depth, threshold), "tree int, node long, lo int, hi int, side int, row long"), "screened")

    texts = screened.join(reps.select("row", "cls", "weight"), "row").join(signed.select("row", "text"), "row")
    verified = checkpointed(texts.groupBy(*UNIT).applyInArrow(
        _verify(depth, threshold), "cls long, row long, other_cls long, other_row long, links long"), "verified")

    links = verified.where("other_row is null").groupBy("row").agg(F.sum("links").alias("linked"))
    groups = components(verified.where("other_row is not null").select(
        F.struct("cls", "row").alias("a"), F.struct(F.col("other_cls").alias("cls"), F.col("other_row").alias("row")).alias("b")))
    return signed, (reps.join(links, "row", "left").withColumn("me", F.struct("cls", "row"))
                    .join(groups, F.col("me") == F.col("id"), "left")
                    .select("digest", "me", F.coalesce("root", "me").alias("root"),
                            (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id; copy_class, the smallest id with the same shingles;
    class_id, the smallest id of the group; n_links, the number of other documents at the
    threshold or above."""
    signed, of_class = _grouped(doc_input(docs, id_col, text_col), threshold, recall)
    return (signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
            .join(of_class, "digest", "left")
            .select("doc_id", F.coalesce("me.cls", "doc_id").alias("copy_class"),
                    F.coalesce("root.cls", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))


def one_per_group(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text and carry of one row per group: a row of its smallest id, and where that id
    has several texts in the group, one of them. Texts without shingles stay once per id; rows
    without an id all stay."""
    signed, of_class = _grouped(doc_input(docs, id_col, text_col, carry), threshold, recall)
    bare = signed.where("doc_id is not null and digest is null").groupBy("doc_id").agg(F.min("row").alias("row"))
    stay = (of_class.where("me = root").select("me.row").union(bare.select("row"))
            .union(signed.where("doc_id is null").select("row")))
    return signed.join(stay, "row", "left_semi").select("doc_id", "text", "carry")
