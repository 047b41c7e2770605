"""The match-history tables, derived from the driver's star-schema tables.

Each function returns one table as a DataFrame.  Tables whose size is a fixed small
number (ranks, tags, seasons) or the number of brands or nations are dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..shared import materialize

# The tag vocabulary and the seasons of the fixture.
TAGS = [("tank", "role", 1), ("damage", "role", 2), ("support", "role", 3), ("red", "free", 4), ("pink", "free", 5), ("white", "free", 6)]
SEASONS = [(1, "S1", "1995-01-01", "1996-06-30"), (2, "S2", "1996-07-01", "1998-12-31"), (3, "S3", "2000-01-01", None)]


@dataclass
class Tables:
    """The tables of one data folder, each built once."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def written(self, *names: str) -> Tables:
        """The same tables, with those of ``names`` written (``materialize``) instead of derived again wherever they are read."""
        out = Tables(self.spark, self.sf_dir)
        for name in names:
            out.__dict__[name] = materialize(getattr(self, name), name)  # where cached_property keeps it
        return out

    @cached_property
    def heroes(self) -> DataFrame:
        brands = self.raw("part").select(F.col("p_brand").alias("name")).distinct()
        ranked = brands.withColumn("id", F.row_number().over(W.orderBy("name")).cast("long"))  # a few dozen brands
        return ranked.select("id", "name", F.element_at(F.array(F.lit("tank"), F.lit("damage"), F.lit("support")), (F.col("id") % 3 + 1).cast("int")).alias("role"))

    @cached_property
    def maps(self) -> DataFrame:
        modes = F.array(*map(F.lit, ("control", "escort", "hybrid", "push", "flashpoint")))
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.element_at(modes, F.col("n_regionkey") + 1).alias("mode"))

    @cached_property
    def seasons(self) -> DataFrame:
        return self.spark.createDataFrame(SEASONS, "id long, name string, starts_on string, ends_on string")

    @cached_property
    def tags(self) -> DataFrame:
        return self.spark.createDataFrame(TAGS, "code string, tag_set string, sort_order int")

    @cached_property
    def ranks(self) -> DataFrame:
        """Forty ranks whose ids run against their ordinals."""
        return self.spark.range(1, 41).select("id", (41 - F.col("id")).alias("ordinal"))

    @cached_property
    def players(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("display_name"))

    @cached_property
    def numbered(self) -> DataFrame:
        order = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
        return self.raw("lineitem").withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))

    @cached_property
    def matches(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        n = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("_k")).agg(F.count(F.lit(1)).alias("n"))
        hour = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00+00:00"))
        result = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").when(k % 3 == 0, "draw").when(k % 3 == 1, "win").otherwise("loss")
        day = F.to_date("o_orderdate")
        season = F.when(k % 97 == 0, None).when(day.between("1995-01-01", "1996-06-30"), 1).when(day.between("1996-07-01", "1998-12-31"), 2).when(day >= "2000-01-01", 3)
        return (
            self.raw("orders").join(n, k == n._k, "left").select(
                k.alias("id"), F.when(k % 97 != 0, hour).alias("played_at"), F.when(c % 10 != 0, c % 25).alias("map_id"), F.when(k % 7 == 0, "clash").alias("mode"), result.alias("result"),
                F.when(k % 11 != 0, F.floor((F.coalesce("n", F.lit(0)) + 1) / 2)).cast("int").alias("team_size"), (300 + k % 1200).cast("int").alias("duration_seconds"),
                F.when(k % 5 != 0, 1 + c % 36).alias("rank_range_low"), F.when(k % 5 != 0, 5 + c % 36).alias("rank_range_high"), season.cast("long").alias("season_id"),
            )
        )

    @cached_property
    def lines(self) -> DataFrame:
        """The numbered lines with their parts' heroes: what rosters and bans are made of."""
        part = self.raw("part").select("p_partkey", "p_size", "p_brand")
        hero = self.heroes.select(F.col("id").alias("_hero"), F.col("name").alias("p_brand"))
        rows = self.numbered.join(part, F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(hero), "p_brand")
        return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "rn", "p_size", "_hero")

    @cached_property
    def match_players(self) -> DataFrame:
        odd, rn = F.col("rn") % 2 == 1, F.col("rn")
        return self.lines.select(
            (F.col("l_orderkey") * 100 + rn).alias("id"), F.col("l_orderkey").alias("match_id"),
            F.when(rn == 1, F.lit(0).cast("long")).when((F.col("l_returnflag") == "N") & (F.col("l_partkey") % 3 == 0), None).otherwise(F.col("l_suppkey")).alias("player_id"),
            F.when(odd, "ally").otherwise("enemy").alias("team"), (rn == 1).alias("is_me"), F.when(F.col("l_partkey") % 13 == 0, "tank").alias("role"), F.when(F.col("p_size") % 10 != 0, F.col("_hero")).alias("hero_id"),
            F.when(~(~odd & (F.col("l_linestatus") == "F")), F.col("l_quantity").cast("long")).alias("eliminations"), (F.col("l_partkey") % 20).alias("assists"), F.col("l_linenumber").cast("long").alias("deaths"),
            F.floor("l_extendedprice").alias("damage"), F.when(F.col("l_returnflag") == "A", F.col("l_partkey") % 10000).alias("healing"), (F.col("l_suppkey") * 100).alias("mitigation"), F.floor((rn - 1) / 2).cast("int").alias("row_index"),
        )

    @cached_property
    def match_bans(self) -> DataFrame:
        return self.lines.filter("l_discount >= 0.09").select(F.col("l_orderkey").alias("match_id"), F.col("_hero").alias("hero_id"), (F.col("rn") - 1).alias("slot_index"))

    @cached_property
    def player_tags(self) -> DataFrame:
        k = F.col("s_suppkey")
        first = self.raw("supplier").select(k.alias("player_id"), F.get(F.array(*map(F.lit, ("tank", "damage", "support", "red", "pink", "white"))), (k % 7).cast("int")).alias("tag_code"))
        return first.dropna().union(self.raw("supplier").filter(k % 5 == 0).select(k, F.lit("red"))).distinct()
