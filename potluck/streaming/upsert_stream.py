"""Structured Streaming refresh: landed expense documents kept in a versioned document store.

The original refreshes on a timer (default 900 s, floor 30 s) plus a manual trigger, builds
everything from the documents as they are then, and keeps the last good snapshot when a
refresh fails. Here:

* ``readStream`` over a landing directory of expense documents (Parquet or JSON);
* a processing-time trigger for the timer, ``availableNow`` for a manual/catch-up run;
* ``foreachBatch`` merges each micro-batch into the store of latest documents, from which
  ``plans`` derive expenses, shares, exclusions and snapshots like from any documents.

Store layout: documents as Parquet in ``data/id_range=<id div range_size>/version=<batch>``, a
manifest per batch (one row per range: its newest version, rows, smallest and largest id) and
a pointer file with the last finished batch. Per batch:

1. the manifest names the current files of the batch's ranges; only these are read, the batch
   is put beside them, and both are dealt by range and slice: a range has as many slices as
   its documents fill files (``DOCS_PER_FILE``), a key lies in one of them;
2. in that one shuffle the latest document of each key is kept and written under the batch's
   own version; nothing that readers see is touched. For a dashboard, documents that the batch
   touches are marked and have beside them what was stored before;
3. the next manifest is the last one with these ranges replaced;
4. on request the dashboard is brought forward by the marked documents (``dashboard``);
5. the pointer is replaced.

The store holds one document of each key, so readers need not look for the latest again. For
that a store keeps its range size: a batch with another one is refused.

Readers take the files that the pointer's manifest names: they see either all of a batch or
nothing of it, and a failed batch leaves the last good state. A replayed batch rewrites its
own version with the same rows. Work grows with the batch's ranges, and by a row per range
with the store. The driver holds the touched ranges' numbers, and a reader of the whole store
those of all ranges, one path for each million ids. ``drop_superseded`` removes versions that
no reader needs any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from potluck.operators.normalize import document_rank
from potluck.schemas import EXPENSE_DOC, REFRESH_SECONDS_DEFAULT, REFRESH_SECONDS_MIN
from potluck.sinks import writers
from potluck.streaming import dashboard as D

ID_RANGE, VERSION = "id_range", "version"
POINTER = "CURRENT"
DEFAULT_RANGE_SIZE = 1_000_000
DOCS_PER_FILE = 100_000
SLICE, STORED, TOUCHED, BEFORE = "_slice", "_stored", "touched", "before"
MANIFEST = T.StructType([T.StructField(c, T.LongType()) for c in (ID_RANGE, VERSION, "rows", "min_id", "max_id")])

# the documents of a batch that has a dashboard
CHANGES = T.StructType([*EXPENSE_DOC.fields, T.StructField(TOUCHED, T.BooleanType()), T.StructField(BEFORE, EXPENSE_DOC)])


def refresh_seconds(value: int | str | None) -> int:
    """Timer interval: default 900 s, never below 30 s; a non-integer value is an error."""
    if value is None or str(value).strip() == "":
        return REFRESH_SECONDS_DEFAULT
    return max(int(str(value).strip()), REFRESH_SECONDS_MIN)


def _range_of(size: int, of: str = "id") -> Column:
    return F.coalesce(F.call_function("div", F.col(of), F.lit(size)).cast("long"), F.lit(-1))


def current_version(spark: SparkSession, store: str) -> int | None:
    """The last finished batch, ``None`` before the first one."""
    pointer = f"{store}/{POINTER}"
    return int(spark.read.text(pointer).first()[0]) if writers.path_exists(spark, pointer) else None


def manifest(spark: SparkSession, store: str, version: int | None) -> DataFrame:
    """Ranges and their files as of a batch; none before the first one."""
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest/v={version}")


def _documents(spark: SparkSession, store: str, files: DataFrame) -> DataFrame:
    """The documents of the given manifest rows; other files are not even listed."""
    return _read(spark, store, [(r[ID_RANGE], r[VERSION]) for r in files.select(ID_RANGE, VERSION).collect()], EXPENSE_DOC)


def _read(spark: SparkSession, store: str, files: list[tuple[int, int]], schema: T.StructType) -> DataFrame:
    paths = [f"{store}/data/{ID_RANGE}={r}/{VERSION}={v}" for r, v in files]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _sliced(stored: DataFrame, docs: DataFrame, files: DataFrame, size: int) -> DataFrame:
    """Stored and new documents (``STORED``) dealt by range and slice; ``files``: the number of
    each range's slices. Documents without a key of their own go by their content."""
    both = stored.withColumn(STORED, F.lit(True)).unionByName(docs.withColumn(STORED, F.lit(False)))
    spread = F.when(F.col("id").isNull(), F.xxhash64("group_id", "date", "updated_at", "cost", "description")).otherwise(
        F.xxhash64("group_id", "id"))
    known = both.withColumn(ID_RANGE, _range_of(size)).join(F.broadcast(files), ID_RANGE)
    return known.withColumn(SLICE, F.pmod(spread, "files")).drop("files").repartition(ID_RANGE, SLICE)


def _merged(sliced: DataFrame) -> DataFrame:
    """The latest document of each key (``latest_documents``), whether a new one has the key
    (``TOUCHED``), and then the one that was stored (``BEFORE``).

    Slices are whole keys, so that the documents are not shuffled again to be grouped."""
    columns = [f.name for f in EXPENSE_DOC.fields]
    (row, rank), stored = document_rank(columns), F.col(STORED)
    best = sliced.where("id is not null").groupBy(ID_RANGE, SLICE, "group_id", "id").agg(
        F.max_by(row, rank).alias("_d"), F.bool_or(~stored).alias(TOUCHED),
        F.max_by(F.when(stored, row), F.when(stored, rank)).alias("_old"))
    without = sliced.where("id is null").select(*columns, ID_RANGE, (~stored).alias(TOUCHED), F.when(F.lit(False), row).alias(BEFORE))
    return best.select("_d.*", ID_RANGE, TOUCHED, F.when(F.col(TOUCHED), F.col("_old")).alias(BEFORE)).unionByName(without)


def merge_batch(store: str, range_size: int = DEFAULT_RANGE_SIZE,
                dashboard: D.Dashboard | None = None) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: bring one micro-batch into the store."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        docs = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EXPENSE_DOC.fields])
        before = current_version(spark, store)
        if before is not None and before >= batch_id:
            before = _finished_before(spark, store, batch_id)      # a replay: as if the batch had not run
        count = {r[0]: r[1] for r in docs.groupBy(_range_of(range_size)).count().collect()}
        ranges = list(count)
        known = manifest(spark, store, before)
        _same_ranges(known, range_size)
        current = known.where(F.col(ID_RANGE).isin(ranges))
        for r in current.collect():
            count[r[ID_RANGE]] += r["rows"]
        files = spark.createDataFrame([(r, -(-n // DOCS_PER_FILE)) for r, n in count.items()], f"{ID_RANGE} long, files long")
        merged = _merged(_sliced(_documents(spark, store, current), docs, files, range_size))
        if dashboard is None:
            merged = merged.drop(TOUCHED, BEFORE)
        (merged.withColumn(VERSION, F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
         .partitionBy(ID_RANGE, VERSION).parquet(f"{store}/data"))

        now = _read(spark, store, [(r, batch_id) for r in ranges], CHANGES)
        own = now.groupBy(_range_of(range_size).alias(ID_RANGE)).agg(
            F.lit(batch_id).cast("long").alias(VERSION), F.count("*").alias("rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
        writers.write_table(known.where(~F.col(ID_RANGE).isin(ranges)).unionByName(own).coalesce(1), f"{store}/manifest/v={batch_id}")
        if dashboard is not None:
            new = now.where(TOUCHED)
            D.refresh(spark, f"{store}/dashboard", batch_id, before, dashboard,
                      new.where(F.col(BEFORE).isNotNull()).select(f"{BEFORE}.*"), new.drop(TOUCHED, BEFORE),
                      lambda: _documents(spark, store, manifest(spark, store, batch_id)))
        writers.touch(spark, f"{store}/{POINTER}", str(max(batch_id, current_version(spark, store) or 0)))
    return run


def _same_ranges(known: DataFrame, size: int) -> None:
    """A key would have two places in a store whose ranges are of different sizes."""
    other = [_range_of(size, c) != F.col(ID_RANGE) for c in ("min_id", "max_id")]
    if not known.where("min_id is not null").where(other[0] | other[1]).isEmpty():
        raise ValueError(f"the store's ranges are not of {size} ids")


def _finished_before(spark: SparkSession, store: str, batch_id: int) -> int | None:
    """The newest batch before this one that has a manifest."""
    fs, root = writers._fs(spark, f"{store}/manifest")
    found = [int(st.getPath().getName()[2:]) for st in (fs.listStatus(root) if fs.exists(root) else [])]
    return max((v for v in found if v < batch_id), default=None)


def start(spark: SparkSession, landing: str, store: str, checkpoint: str,
          interval_seconds: int | None = None, available_now: bool = False,
          fmt: str = "parquet", max_files_per_trigger: int | None = None,
          range_size: int = DEFAULT_RANGE_SIZE, dashboard: D.Dashboard | None = None) -> StreamingQuery:
    """Start the refresh stream. Exactly one of timer / ``available_now`` applies."""
    reader = spark.readStream.schema(EXPENSE_DOC).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    writer = (reader.load(landing).writeStream.foreachBatch(merge_batch(store, range_size, dashboard))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{refresh_seconds(interval_seconds)} seconds")
    return writer.start()


def current_documents(spark: SparkSession, store: str) -> DataFrame:
    """The latest documents as of the last finished batch; none before the first one."""
    return _documents(spark, store, manifest(spark, store, current_version(spark, store)))


def current_dashboard(spark: SparkSession, store: str, name: str = "snapshot") -> DataFrame | None:
    """A table of the dashboard of the last finished batch (the JSON documents by default);
    ``None`` before the first one."""
    return D.published(spark, f"{store}/dashboard", current_version(spark, store), name)


def drop_superseded(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Delete what the last ``keep`` finished batches do not refer to: versions of ranges, older
    manifests and dashboards; how many folders. A batch that is not finished is left alone."""
    version = current_version(spark, store)
    if version is None:
        return 0
    fs, root = writers._fs(spark, store)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def folders(name: str) -> list[tuple[int, object]]:
        at = path(f"{store}/{name}")
        found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()] if fs.exists(at) else []
        return [(int(p.getName().split("=")[1]), p) for p in found]
    finished = sorted(v for v, _ in folders("manifest") if v <= version)[-keep:]
    used = {(r[ID_RANGE], r[VERSION]) for v in finished for r in manifest(spark, store, v).select(ID_RANGE, VERSION).collect()}
    old = [p for name in ("manifest", "dashboard") for v, p in folders(name) if v <= version and v not in finished]
    for number, at in folders("data"):
        old += [p for v, p in folders(f"data/{at.getName()}") if v <= version and (number, v) not in used]
    return sum(bool(fs.delete(p, True)) for p in old)
