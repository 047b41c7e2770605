"""Aggregates of a subject match set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import RELIABLE, tally, wilson
from ..shared import broadcast_if_small, stored
from ..sources.fixtures import Tables
from .running import placed, rates
from .subject import SMALL

STATS = ["eliminations", "assists", "deaths", "damage", "healing", "mitigation"]


def overall(sm: DataFrame) -> DataFrame:
    return sm.agg(*tally())


def totals(sm: DataFrame, t: Tables) -> DataFrame:
    banned = t.match_bans.select("match_id").distinct().withColumn("_banned", F.lit(1))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return sm.join(banned, "match_id", "left").agg(
        F.count(F.lit(1)).cast("long").alias("matches"), n(F.col("map_id").isNotNull()).alias("with_map"), n(F.col("hero_id").isNotNull()).alias("with_hero"),
        n(F.col("_banned").isNotNull()).alias("with_bans"), n(F.col("eliminations").isNotNull()).alias("with_stats"), F.min("played_at").alias("first_played"), F.max("played_at").alias("last_played"),
    )


def by(sm: DataFrame, *keys: str) -> DataFrame:
    """Tallies by non-null keys."""
    return sm.dropna(subset=list(keys)).groupBy(*keys).agg(*tally())


def by_team_size(sm: DataFrame) -> DataFrame:
    return by(sm, "team_size").withColumn("label", F.concat(F.col("team_size").cast("string"), F.lit("v"), F.col("team_size").cast("string")))


def others(sm: DataFrame, t: Tables, same_team: bool, by_hero: bool) -> DataFrame:
    """The set joined with the other rows of its matches: allies or opponents, by player or by hero."""
    o = t.match_players.select(F.col("match_id").alias("_m"), F.col("team").alias("_t"), F.col("id").alias("_i"), F.col("player_id").alias("other_player"), F.col("hero_id").alias("other_hero"))
    o = o.dropna(subset=["other_hero" if by_hero else "other_player"])
    if by_hero and not same_team:
        o = o.dropDuplicates(["_m", "_t", "other_hero"])
    on = (F.col("match_id") == F.col("_m")) & (((F.col("team") == F.col("_t")) & (F.col("subject_row_id") != F.col("_i"))) if same_team else (F.col("team") != F.col("_t")))
    return sm.join(o, on)


def by_player(sm: DataFrame, t: Tables, same_team: bool, min_games: int = 1) -> DataFrame:
    out = others(sm, t, same_team, False).groupBy("other_player").agg(*tally()).filter(F.col("games") >= min_games)
    names = t.players.select(F.col("id").alias("other_player"), F.col("display_name").alias("name"))
    return out.join(names, "other_player").drop("other_player")


def by_other_hero(sm: DataFrame, t: Tables, same_team: bool) -> DataFrame:
    out = others(sm, t, same_team, True).groupBy("other_hero").agg(*tally())
    names = t.heroes.select(F.col("id").alias("other_hero"), "name")
    return out.join(F.broadcast(names), "other_hero").drop("other_hero")


def bans(sm: DataFrame, t: Tables) -> DataFrame:
    """Tallies by banned hero, and the part of the subject's matches with bans in which it was."""
    b = t.match_bans.select("match_id", F.col("hero_id").alias("banned")).distinct()
    with_bans = sm.join(b.select("match_id").distinct(), "match_id", "left_semi").agg(F.count(F.lit(1)).alias("_all"))  # one row
    out = sm.join(b, "match_id").groupBy("banned").agg(*tally()).join(F.broadcast(with_bans))
    names = t.heroes.select(F.col("id").alias("banned"), "name")
    return out.join(F.broadcast(names), "banned").withColumn("ban_rate", F.round(F.try_divide("games", "_all"), 6)).drop("banned", "_all")


def comp_shapes(sm: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tallies by T-D-S shape of the subject's team where every seat is known, and the number of other matches."""
    roles = F.broadcast(t.heroes.select(F.col("id").alias("_h"), F.col("role").alias("_hr")))
    r = t.match_players.join(roles, F.col("hero_id") == F.col("_h"), "left").select(F.col("match_id").alias("_m"), F.col("team").alias("_t"), F.coalesce("role", "_hr").alias("_r"))
    n = lambda k: F.sum((F.col("_r") == k).cast("int"))
    team = r.groupBy("_m", "_t").agg(*(F.coalesce(n(k), F.lit(0)).alias(f"n_{k}") for k in ("tank", "damage", "support")), F.sum(F.col("_r").isNull().cast("int")).alias("unknown"), F.count(F.lit(1)).alias("rostered"))
    rows = sm.join(team, (F.col("match_id") == F.col("_m")) & (F.col("team") == F.col("_t")))
    complete = (F.col("unknown") == 0) & (F.col("team_size").isNull() | (F.col("rostered") == F.col("team_size")))
    shape = F.concat_ws("-", *(F.col(f"n_{k}").cast("string") for k in ("tank", "damage", "support")))
    return rows.filter(complete).withColumn("shape", shape).groupBy("shape").agg(*tally()), rows.filter(~complete).agg(F.count(F.lit(1)).cast("long").alias("unclassified_games"))


def hero_pairs(sm: DataFrame, t: Tables, min_games: int = 2) -> DataFrame:
    h = t.match_players.dropna(subset=["hero_id"]).select("match_id", "team", F.col("hero_id").alias("h"))
    a, b = h.withColumnRenamed("h", "a"), h.withColumnRenamed("h", "b")
    pairs = sm.select("match_id", "team", "outcome").join(a, ["match_id", "team"]).join(b, ["match_id", "team"]).filter("b > a").groupBy("a", "b").agg(*tally()).filter(F.col("games") >= min_games)
    names = t.heroes.select("id", "name")
    n1, n2 = F.broadcast(names.toDF("a", "na")), F.broadcast(names.toDF("b", "nb"))
    return pairs.join(n1, "a").join(n2, "b").withColumn("pair", F.concat(F.least("na", "nb"), F.lit(" + "), F.greatest("na", "nb"))).drop("a", "b", "na", "nb")


def averages(sm: DataFrame, *keys: str) -> DataFrame:
    rows = sm.filter(F.col("eliminations").isNotNull())
    cols = [F.count(F.lit(1)).cast("long").alias("games"), *(F.round(F.avg(c), 6).alias(c) for c in STATS)]
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(*cols) if keys else rows.agg(*cols)


def with_wilson(df: DataFrame) -> DataFrame:
    return df.withColumns({"score": F.round(wilson(F.col("wins"), F.col("losses"), True), 6), "ceiling": F.round(wilson(F.col("wins"), F.col("losses"), False), 6)})


@stored
def trends(t: Tables, window: int = 10, own: bool = False) -> DataFrame:
    """For every other player, or the operator: position, running and rolling win rate of their matches in time order."""
    window = min(100, max(2, window or 10))
    return rates(placed(t, own).select("player_id", "match_id", "x", "wins"), ["player_id"], "x", window).select("player_id", "match_id", "x", "cumulative", "rolling", F.col("size").alias("n"))


@stored
def longest_streaks(t: Tables, own: bool = False) -> DataFrame:
    """For every other player, or the operator: length of the longest run of wins and of losses; a draw breaks a run."""
    # within a run, the place and the number of like outcomes grow alike
    alike = F.when(F.col("outcome") == "win", F.col("wins")).when(F.col("outcome") == "loss", F.col("losses")).otherwise(F.col("draws"))
    runs = placed(t, own).groupBy("player_id", "outcome", (F.col("x") - alike).alias("_run")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    best = lambda k: F.coalesce(F.max(F.when(F.col("outcome") == k, F.col("n"))), F.lit(0)).cast("long")
    return runs.groupBy("player_id").agg(best("win").alias("longest_win"), best("loss").alias("longest_loss"))


def worn_tags(t: Tables) -> DataFrame:
    """(player_id, tag_code, n): the tags that players wear, with their place in the vocabulary; one that it lacks has none."""
    return t.player_tags.select("player_id", "tag_code").join(broadcast_if_small(t.tags.select(F.col("code").alias("tag_code"), F.col("sort_order").alias("n")), SMALL), "tag_code", "left")


def tags_of_players(t: Tables) -> DataFrame:
    """Each player's tag codes in the order of the vocabulary."""
    codes = worn_tags(t).groupBy("player_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "tag_code"))), lambda x: x["tag_code"]), ",").alias("tags"))
    return t.players.join(codes, F.col("id") == F.col("player_id"), "left").select("display_name", F.coalesce("tags", F.lit("")).alias("tags"))


def exact_comps(sm: DataFrame, t: Tables) -> DataFrame:
    """Tallies by the sorted hero names of the subject's team, where every seat has one."""
    named = t.match_players.join(broadcast_if_small(t.heroes.select(F.col("id").alias("hero_id"), F.col("name").alias("_n")), SMALL), "hero_id")
    team = named.groupBy(F.col("match_id").alias("_m"), F.col("team").alias("_t")).agg(F.array_join(F.array_sort(F.collect_list("_n")), " · ").alias("name"), F.count(F.lit(1)).alias("named"))  # the seats of one team
    rows = sm.join(team, (F.col("match_id") == F.col("_m")) & (F.col("team") == F.col("_t"))).filter(F.col("team_size").isNull() | (F.col("named") == F.col("team_size")))
    return rows.groupBy("name").agg(*tally())
