"""Incremental upsert of expenses into a stored table, keyed by (group_id, expense_id).

Rules: incoming non-null cells overwrite stored ones; stored rows missing upstream stay;
columns are the union of both sides; rows never get deleted. One full outer join on the
key (after de-duplicating the incoming rows on the same key, so the join reuses that
partitioning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.operators.ranking import ranked
from potluck.schemas import NULL_LABEL, UPSERT_SORT

KEY = ["group_id", "expense_id"]


def dedupe_latest(df: DataFrame, order_col: str = "updated_at") -> DataFrame:
    """One row per key: the one with the latest ``updated_at``, a missing stamp lowest (ties:
    the larger row hash).

    An aggregation (``max_by``) rather than a window: each task keeps only its best row
    per key before the shuffle, so even a key repeated millions of times stays cheap.
    """
    cols = [c for c in df.columns if c not in KEY]
    if not cols:
        return df.dropDuplicates(KEY)
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    stamp = F.col(f"`{order_col}`") if order_col in df.columns else F.lit(None).cast("string")
    stamp = F.coalesce(F.when(~stamp.isin("", NULL_LABEL), stamp), F.lit(""))
    rank = F.struct(stamp, F.xxhash64(*[F.col(f"`{c}`") for c in cols]))
    best = df.groupBy(*KEY).agg(F.max_by(row, rank).alias("_r"))
    return best.select(*KEY, *[F.col("_r").getField(c).alias(c) for c in cols]).select(*df.columns)


def upsert(existing: DataFrame | None, incoming: DataFrame, dedupe: bool = True) -> DataFrame:
    """Merge ``incoming`` into ``existing`` (``None`` = no store yet → incoming as is).

    Output columns are sorted by name (as the original writes them).
    """
    inc = dedupe_latest(incoming) if dedupe else incoming
    if existing is None:
        return inc
    ex_cols, inc_cols = set(existing.columns), set(inc.columns)
    all_cols = sorted(ex_cols | inc_cols)
    ex = existing.select(*[F.col(f"`{c}`").alias(f"e__{c}") for c in existing.columns])
    ic = inc.select(*[F.col(f"`{c}`").alias(f"i__{c}") for c in inc.columns])
    cond = [F.col(f"e__{k}") == F.col(f"i__{k}") for k in KEY]
    joined = ex.join(ic, cond, "full")
    types_ex = dict((f.name, f.dataType) for f in existing.schema.fields)
    types_in = dict((f.name, f.dataType) for f in inc.schema.fields)
    out = []
    for c in all_cols:
        if c in ex_cols and c in inc_cols:
            e, i = F.col(f"e__{c}"), F.col(f"i__{c}")
            if types_ex[c] != types_in[c]:
                target = _common_type(types_ex[c], types_in[c])
                e, i = e.try_cast(target), i.try_cast(target)
            out.append(F.coalesce(i, e).alias(c))
        elif c in ex_cols:
            out.append(F.col(f"e__{c}").alias(c))
        else:
            out.append(F.col(f"i__{c}").alias(c))
    return joined.select(*out)


def _common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(a, numeric) and isinstance(b, numeric):
        if isinstance(a, (T.FloatType, T.DoubleType)) or isinstance(b, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            return T.DecimalType(38, 2)
        return T.LongType()
    return T.StringType()


def with_position(merged: DataFrame) -> DataFrame:
    """Each group's rows numbered from 0 by date, category, description (id breaks ties).

    For presentation. A store is written unnumbered, each of its files in this order
    (``sort_keys``). The rows are written once in ranges; a large group lies in several
    (``ranking``)."""
    return ranked(merged, ["group_id"], sort_keys(merged))


def sort_keys(df: DataFrame) -> list[str]:
    return [c for c in UPSERT_SORT if c in df.columns] + ["expense_id"]


def new_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose key the store does not have (left anti join)."""
    return incoming.join(existing.select(*KEY), KEY, "left_anti")


def read_store(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame | None:
    """The stored table, or ``None`` when nothing was stored yet.

    A missing path means "no store", a folder without files an empty one; an unreadable
    store raises instead of silently restarting from empty (which would lose rows).
    """
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return None
    return spark.read.schema(schema).format(fmt).load(path)
