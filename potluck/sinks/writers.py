"""Sinks: versioned, atomically published table sets.

A publish writes every table of a run into a fresh version directory through Spark's
commit protocol (each table gets its ``_SUCCESS`` marker), and only then writes the
version's ``_PUBLISHED`` marker. Readers pick the newest published version, so a path
that is being read is never overwritten and a failed run leaves the last good version
current. Re-running a version id takes its marker away first, writes the tables anew and
removes those that the re-run no longer has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PUBLISHED = "_PUBLISHED"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def touch(spark: SparkSession, path: str, text: str = "") -> None:
    """Create or replace a small marker file (written under another name, then renamed)."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    # one step: a reader finds the old marker or the new one
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(tmp, p, options)


def begin(spark: SparkSession, root: str, version: int) -> None:
    """Before the tables of a version are written: it is not published (any more)."""
    fs, p = _fs(spark, f"{version_path(root, version)}/{PUBLISHED}")
    if fs.exists(p):
        fs.delete(p, False)


def list_versions(spark: SparkSession, root: str) -> list[int]:
    """Published version ids under ``root`` (directories ``v=<id>`` with a marker)."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            try:
                vid = int(name[2:])
            except ValueError:
                continue
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), PUBLISHED)):
                out.append(vid)
    return sorted(out)


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    vs = [v for v in list_versions(spark, root) if before is None or v < before]
    return vs[-1] if vs else None


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version}"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet",
                sort_by: list[str] | None = None) -> None:
    if partition_by:
        # AQE "rebalance": one shuffle by the partition keys that splits hot keys and
        # merges small ones, so each output folder gets a few right-sized files.
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        # after the rebalance, which would undo an earlier order; each file is sorted
        df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def _reader(spark: SparkSession, fmt: str):
    r = spark.read.format(fmt)
    return r.option("header", True) if fmt == "csv" else r


def publish(spark: SparkSession, root: str, version: int, tables: dict[str, DataFrame],
            partition_by: dict[str, list[str]] | None = None, skip_empty: tuple[str, ...] = (),
            formats: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> str:
    """Write ``tables`` as version ``version`` under ``root`` and mark it published.

    Tables named in ``keep`` were written by the caller and belong to the version too.

    Tables named in ``skip_empty`` are dropped from the version when they came out empty
    (the original omits empty sheets). The check runs on the written files (for Parquet a
    row count answered from the footers), so the table's plan is never run twice.
    ``formats`` picks a file format per table (default Parquet; ``csv`` has a header).
    """
    vpath = version_path(root, version)
    begin(spark, root, version)
    for name, df in tables.items():
        path = f"{vpath}/{name}"
        fmt = (formats or {}).get(name, "parquet")
        write_table(df, path, (partition_by or {}).get(name), fmt)
        if name in skip_empty and _reader(spark, fmt).load(path).limit(1).count() == 0:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
    for name in _tables(spark, vpath):
        if name not in tables and name not in keep:
            fs, p = _fs(spark, f"{vpath}/{name}")
            fs.delete(p, True)
    touch(spark, f"{vpath}/{PUBLISHED}", str(version))
    return vpath


def _tables(spark: SparkSession, vpath: str) -> list[str]:
    fs, p = _fs(spark, vpath)
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()] if fs.exists(p) else []


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written table, also where no row and so no file was written."""
    return spark.read.schema(schema).parquet(path)


def read_published(spark: SparkSession, root: str, name: str, schema=None,
                   version: int | None = None, fmt: str = "parquet") -> DataFrame | None:
    """Table ``name`` of the newest (or given) published version, ``None`` if there is none."""
    v = version if version is not None else latest_version(spark, root)
    if v is None:
        return None
    path = f"{version_path(root, v)}/{name}"
    if not path_exists(spark, path):
        return None
    reader = _reader(spark, fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("basePath", path).load(path)
