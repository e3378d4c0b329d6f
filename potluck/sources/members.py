"""Member dimension from per-group JSON configuration (user id → display name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potluck.functions.numbers import lenient_long


def members_from_config(groups: DataFrame, json_col: str = "members_json") -> DataFrame:
    """``group_id, members_json`` → ``group_id, user_id, name, ord`` (``ord`` keeps JSON order).

    A config that is not a JSON object yields no members for that group. Ids that are not
    integers are dropped (the single-group original refuses the whole map instead). A user
    that the map names twice (`"1"` and `" 1 "`) counts once, at its first place.
    """
    parsed = F.from_json(F.col(json_col), "map<string,string>")
    entries = groups.select("group_id", F.posexplode(F.map_entries(parsed)).alias("pos", "e"))
    rows = entries.select(
        F.col("group_id").cast("long").alias("group_id"),
        lenient_long(F.col("e.key")).alias("user_id"),
        F.coalesce(F.col("e.value"), F.lit("None")).alias("name"),
        (F.col("pos") + 1).cast("int").alias("ord"),
    ).where(F.col("user_id").isNotNull())
    return rows.groupBy("group_id", "user_id").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))


def member_lists(members: DataFrame) -> DataFrame:
    """``group_id, names``: the member names of each group in member order, each once.

    One row per group; a list is as long as the group's own configuration."""
    each = members.groupBy("group_id", "name").agg(F.min("ord").alias("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "name")))
    return each.groupBy("group_id").agg(F.transform(ordered, lambda x: x["name"]).alias("names"))
