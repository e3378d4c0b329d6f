"""Positions of rows within their group, without gathering a group in one task.

Rows are dealt by ranges of (group, order) and each range is sorted and written once; the
rows of each (range, group) are counted from the written table, the counts of a group are
summed up in the order of the ranges, and each row adds what stands before its range. A
group that is larger than a range lies in several tasks; only counts, one for each range
that a group touches, go through a window.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from potluck.session import shared_path

PART, ROW = "_rank_part", "_rank_row"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new table in the shared checkpoint folder; later jobs read the files."""
    spark = df.sparkSession
    path = shared_path(spark, "tables", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: list[str], order: list[Column | str], pos: str = "pos", size: str | None = None,
           write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """``df`` with ``pos``: each row's place in its group, from 0, in ``order`` (nulls first);
    on request ``size``: the rows of the group.

    ``group`` may be empty (one order of all rows); null is a group like any other. Rows that
    are equal in ``order`` go to one range, so the last key should be unique. Rows that are
    equal in all keys take any of their places.
    """
    keys = [F.col(f"`{g}`").asc_nulls_first() for g in group]
    keys += [F.col(f"`{c}`").asc_nulls_first() if isinstance(c, str) else c for c in order]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = write(ranges.withColumn(PART, F.spark_partition_id()).withColumn(ROW, F.monotonically_increasing_id()),
                 "ranked")
    counts = rows.groupBy(*[F.col(f"`{g}`") for g in group], PART).agg(F.min(ROW).alias("_first"), F.count("*").alias("_n"))
    by_group = Window.partitionBy(*[F.col(f"`{g}`") for g in group]) if group else Window.partitionBy(F.lit(0))
    before = by_group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(f"`{g}`").alias(f"_g{i}") for i, g in enumerate(group)], F.col(PART).alias("_part"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(by_group).alias("_size"))
    same = F.col(PART) == F.col("_part")
    for i, g in enumerate(group):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"_g{i}"))
    out = rows.join(starts, same).withColumn(pos, F.col(ROW) - F.col("_first") + F.col("_before"))
    if size is not None:
        out = out.withColumn(size, F.col("_size"))
    return out.drop(PART, ROW, "_part", "_first", "_before", "_size", *[f"_g{i}" for i in range(len(group))])
