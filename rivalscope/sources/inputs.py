"""What somebody asks for, derived from the test data: the input of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixtures import Tables


def proposals(t: Tables) -> DataFrame:
    """Seasons that somebody asks for: one a nation, some with blank names, bad dates or no end."""
    i = F.col("n_nationkey")
    day = lambda year, month: F.format_string("%04d-%02d-01", (1992 + year).cast("int"), (1 + month).cast("int"))
    return t.raw("nation").select(
        i.cast("long").alias("id"), F.when(i % 9 != 0, F.concat(F.lit(" "), "n_name")).otherwise("  ").alias("name"),
        F.when(i % 11 != 0, day(i % 11, i % 12)).otherwise("soon").alias("starts_on"), F.when(i % 4 != 0, day(i % 11 + i % 2, (i + 5) % 12)).alias("ends_on"),
    )


def tag_sets(t: Tables) -> DataFrame:
    """(player_id, codes): new sets that somebody asks for, for the players of even ids."""
    return t.raw("supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("player_id"), F.when(F.col("s_suppkey") % 6 == 0, F.array(F.lit("blue"), F.lit("red"))).otherwise(F.array(F.lit("white"), F.lit("pink"), F.lit("white"))).alias("codes"))
