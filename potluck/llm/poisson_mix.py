"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output. Its mean repetition rate is

    rate = share * (rows of the output) / (rows of the source)

and each of its documents is repeated Poisson(rate) times: a uniform number is read from a
hash of the seed and the id, and the Poisson distribution function is inverted by counting
the steps that lie at or below it. The same seed always gives the same mix, whatever the
partitioning. Copies are exploded and shuffled globally by another hash: partitions are
dealt by it, and each is sorted by it.

Counts per source are taken over all rows. Steps are tabulated per source, up to a
probability beyond double precision; sources are grouped by exact counts first, so the
table has a row per source. It joins back with Spark's own choice of a broadcast or a
shuffle.

Defined cases: a null source is a source like any other; rows that share an id are repeated
alike and share their order keys, rows without an id take the hash of their text; weights of sources that do not occur are left out
and the rest shared out in proportion; a source without weight gets none of the output; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
POWER = 0.7                  # default weights: rows of the source to this power
STEPS_ABOVE = 40             # steps tabulated: rate + 12 sqrt(rate) + STEPS_ABOVE


def unit(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of the parts, joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None,
          out_rows: float | None = None) -> DataFrame:
    """(source, n, weight, rate): one row per source. ``weights``: (source, weight)."""
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(POWER)))
    else:
        wanted = weights.select(F.col("source").alias("of"), F.col("weight").cast("double"))
        counts = (counts.join(wanted, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
                  .withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))))
    rows, all_weight = counts.agg(F.sum("n"), F.sum("weight")).first()      # two numbers
    size = float(out_rows if out_rows is not None else rows or 0)
    rate = (F.col("weight") / F.lit(all_weight) * F.lit(size) / F.col("n")) if all_weight else F.lit(0.0)
    return counts.select("source", "n", "weight", rate.alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """The values P(X <= 0), P(X <= 1), ... of a Poisson distribution; large rates in logs."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + F.lit(STEPS_ABOVE)).cast("int")
    start = F.struct(F.lit(0.0).alias("log_k"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        log_k = acc["log_k"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        log_rate = F.when(rate > 0, F.log(rate)).otherwise(0.0)
        p = F.when(rate > 0, F.exp(k * log_rate - rate - log_k)).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
        return F.struct(log_k.alias("log_k"), (acc["sum"] + p).alias("sum"),
                        F.concat(acc["steps"], F.array(acc["sum"] + p)).alias("steps"))
    return F.aggregate(F.sequence(F.lit(0), last), start, step)["steps"]


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                weights: DataFrame | None = None, out_rows: float | None = None, seed: str = SEED,
                columns: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) in a struct ``row``, with copy (from 1),
    copies, rate and order_key, in shuffled order."""
    source, doc_id = F.col(f"`{source_col}`"), F.col(f"`{id_col}`")
    table = rates(docs, source_col, weights, out_rows).select(
        F.col("source").alias("rate_source"), "rate", poisson_steps(F.col("rate")).alias("steps"))
    kept = docs.columns if columns is None else columns
    text = F.col(f"`{text_col}`")
    rows = docs.select(source.alias("mix_source"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                       F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("key"))
    u = unit(F.lit(seed), F.col("key"))
    counted = (rows.join(table, F.col("mix_source").eqNullSafe(F.col("rate_source")))
               .withColumn("copies", F.size(F.filter("steps", lambda s: s <= u)))
               .where("copies > 0"))
    copies = (counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
              .withColumn("order_key", unit(F.lit(seed), F.col("key"), F.col("copy"))))
    dealt = copies.repartition("order_key").sortWithinPartitions("order_key")
    return dealt.select("row", "copy", "copies", "rate", "order_key")
