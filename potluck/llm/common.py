"""Small shared helpers: clash-free input columns, bucket counts, shared-folder checkpoints."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from potluck.session import shared_path

# Rows go to Python workers in batches of this many bytes at most (one row at least), so that
# neither side holds a whole partition; a smaller setting of the session stays.
ARROW_BATCH_BYTES = 4 << 20
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)", spark.conf.get(key).strip().lower().rstrip("b")).groups()
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if not 0 < now <= ARROW_BATCH_BYTES:
        spark.conf.set(key, f"{ARROW_BATCH_BYTES}b")


def doc_input(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              carry: list[str] | None = None) -> DataFrame:
    """``doc_id`` long, ``text`` string and, if wanted, ``carry``: a struct of further columns.

    Columns that are not asked for are left out, so no name of theirs can clash with an
    operator's own.
    """
    limit_batches(docs.sparkSession)
    cols: list[Column] = [F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                          F.col(f"`{text_col}`").cast("string").alias("text")]
    if carry is not None:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry"))
    return docs.select(*cols)


MAX_GROUPS = 1_000           # groups that a sample is taken from: the most frequent ones


def hash_sample(ids: DataFrame, group: str, limit: int | dict) -> DataFrame:
    """(doc_id, ``group``, rank): of each group the distinct ids with the smallest hashes, ``limit``
    (or ``limit[group]``) at most.

    Ids are counted per group first. Only those are ranked whose hashes lie below the share of
    all hashes that holds the limit with room to spare, so that a window sees little more than
    the limit of a group, however many ids the group has."""
    spark, limits = ids.sparkSession, limit if isinstance(limit, dict) else None
    ids = ids.select("doc_id", group).distinct()
    sizes = ids.groupBy(group).count().orderBy(F.desc("count"), group).limit(MAX_GROUPS).collect()
    most = [(r[0], limits.get(r[0], 0) if limits is not None else limit, r[1]) for r in sizes]
    shares = spark.createDataFrame([(g, n, min(1.0, (1.2 * n + 100) / of)) for g, n, of in most],
                                   f"of {ids.schema[group].dataType.simpleString()}, most long, share double")
    place = F.xxhash64("doc_id").cast("double") / float(2**64) + 0.5
    few = ids.join(F.broadcast(shares), F.col(group) == F.col("of")).where(place <= F.col("share"))   # MAX_GROUPS rows
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= F.col("most")).select("doc_id", group, "rank")


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """One of the texts of rows that share their keys: the one with the smallest hash."""
    best = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text")))
    return rows.groupBy(*keys).agg(best["text"].alias("text"))


def partitions(spark: SparkSession) -> int:
    """The deployment's shuffle width; it is set so that a partition fits a task's memory."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _own_folder(spark: SparkSession) -> str:
    return shared_path(spark, "llm", spark.sparkContext.applicationId)


def drop_checkpoints(spark: SparkSession) -> None:
    """Delete what this application has checkpointed; only when its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder below ``spark.checkpoint.dir`` and read back.

    Cuts the lineage: a lost executor costs the tasks that it held, not the whole job.
    The shuffle files of the writing job are dropped when it ends.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    out = spark.read.schema(df.schema).parquet(path)
    out.checkpoint_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the folder of a checkpointed table that no later job reads."""
    if path := df.__dict__.get("checkpoint_path"):
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
