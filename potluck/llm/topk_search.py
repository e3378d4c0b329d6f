"""Exact top-k inner-product search by Fagin's threshold algorithm.

Vectors are cut into blocks of at most about ``BLOCK`` candidates by a hash of the id. A
block sorts its candidates once along every dimension. A query walks the lists from the
end that its component favours (descending for positive components, ascending for
negative ones; zero components are left out), scores each candidate that turns up for the
first time, and stops as soon as the threshold, the best score that a candidate not yet
seen could reach, lies below its kth best. The lists are walked in steps of growing depth,
so that the arithmetic stays in numpy. A block's results are merged with the other blocks'
by one grouped sort of k rows per block and query.

Components are integers: floor(scale * x). Scores are integer inner products, ties go to
the smaller id, a query never finds its own row.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and
rows without an id, take no part; rows with the same id are separate candidates, none of
which the query of that id finds; query rows that share an id but not a vector are queries of
their own, each with its own ranks, and equal query rows are one; vectors of different lengths only meet their own length;
fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4_096                # candidates of a block, on average
QUERIES = 1_024              # queries of a block, on average
STEP = 64                    # depth of the first step down the lists

FOUND = "query_id long, query_key long, vec_id long, score long"


def usable(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dims, v): integer components of the vectors that take part."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * F.lit(scale)))
    good = F.forall(F.col(f"`{vector_col}`"),
                    lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (df.where(good & (F.size(F.col(f"`{vector_col}`")) > 0) & F.col(f"`{id_col}`").isNotNull())
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
            .withColumn("dims", F.size("v")))


class Block:
    """Candidates with their per-dimension sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")      # ascending, per dimension

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first, ties by id; and none of ``own_id``."""
        n = self.ids.size
        dims = np.flatnonzero(query)
        seen = np.zeros(n, bool)
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, max(STEP, 4 * k)
        up = query[dims] > 0
        while depth < n:
            to = min(n, depth + step)
            if dims.size:
                high, low = self.lists[n - to:n - depth][:, dims[up]], self.lists[depth:to][:, dims[~up]]
                fresh = np.zeros(n, bool)
                fresh[high.ravel()] = True
                fresh[low.ravel()] = True
            else:                                     # every score is 0: the smallest ids win
                fresh = np.ones(n, bool)
                to = n
            fresh &= ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            at = at[self.ids[at] != own_id]
            score = self.vectors[at] @ query
            best_at, best = np.concatenate([best_at, at]), np.concatenate([best, score])
            if best.size > k:
                top = np.lexsort((self.ids[best_at], -best))[:k]
                best_at, best = best_at[top], best[top]
            depth, step = to, step * 2
            if best.size >= k and depth < n and dims.size:
                # values of the entries next in the lists: nothing unseen can score more
                edge = np.where(up, self.vectors[self.lists[n - 1 - depth, dims], dims],
                                self.vectors[self.lists[depth, dims], dims])
                if int(edge @ query[dims]) < best.min():
                    break
        top = np.lexsort((self.ids[best_at], -best))
        return self.ids[best_at[top]], best[top]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dims)


def _search_block(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out_q, out_k, out_v, out_s = [], [], [], []
        if queries.num_rows and candidates.num_rows:
            dims = candidates.column("dims")[0].as_py()
            block = Block(candidates.column("id").to_numpy(), _matrix(candidates.column("v"), dims))
            for own, key, query in zip(queries.column("id").to_numpy(), queries.column("query_key").to_numpy(),
                                       _matrix(queries.column("v"), dims)):
                ids, scores = block.search(own, query, k)
                out_q.append(np.full(ids.size, own))
                out_k.append(np.full(ids.size, key))
                out_v.append(ids)
                out_s.append(scores)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(join(out_q), pa.int64()), "query_key": pa.array(join(out_k), pa.int64()), "vec_id": pa.array(join(out_v), pa.int64()),
                         "score": pa.array(join(out_s), pa.int64())})
    return run


def top_k(df: DataFrame, query_rows, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which the
    condition ``query_rows`` (on column ``id``) holds, against all rows."""
    rows = usable(df, id_col, vector_col, scale)
    n, n_queries = rows.select(F.count("*"), F.count_if(query_rows)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERIES))
    # rows that share an id are told apart by a row of their own; the hash takes the vector too
    candidates = (rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
                  .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    queries = (rows.where(query_rows).dropDuplicates(["id", "v"]).withColumn("query_key", F.xxhash64("v"))
               .withColumn("qblock", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
               .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    key = ["block", "qblock", "dims"]
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(_search_block(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
