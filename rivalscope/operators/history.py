"""Trends by tag, running streaks, players' pages, seasons, settings and reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, materialize, stored
from ..sources.fixtures import Tables
from .breakdowns import STATS
from .running import placed, rates, running
from .subject import SMALL

# Settings with their defaults and types.
SETTINGS = [("my_display_name", "", "text"), ("confidence_threshold", "0.75", "float"), ("default_team_size", "6", "int"), ("hero_hash_max_distance", "8", "int"), ("nameplate_hash_max_distance", "35", "int"), ("read_unknown_names", "1", "int")]
#: seasons after an edit: the first ends earlier, and one fills the gap
EDITED = [(1, "S1", "1995-01-01", "1996-03-31"), (2, "S2", "1996-04-01", "1998-12-31"), (3, "S3", "2000-01-01", None), (4, "S4", "1999-01-01", "1999-12-31")]


@stored
def tagged(t: Tables, own: bool = False) -> DataFrame:
    """``placed`` for each tag that a team-mate in the match wears."""
    rows = placed(t, own).select("id", "match_id", "player_id", "team", "outcome", "x")  # placed is stored
    mates = t.match_players.dropna(subset=["player_id"]).select("match_id", "team", F.col("id").alias("_mate"), F.col("player_id").alias("_who"))
    tags = t.player_tags.select(F.col("player_id").alias("_who"), "tag_code")
    worn = rows.select("id", "match_id", "player_id", "team").join(mates, ["match_id", "team"]).filter("_mate <> id").join(tags, "_who").select("player_id", "match_id", "tag_code").distinct()
    return rows.join(worn, ["player_id", "match_id"])


@stored
def tagged_trends(t: Tables, window: int = 10, own: bool = False) -> DataFrame:
    """Running and rolling win rate over the matches with each tag; ``x`` keeps the overall place."""
    window = min(100, max(2, window or 10))
    subject = ["player_id", "tag_code"]
    rows = materialize(running(tagged(t, own).select(*subject, "match_id", "x", "outcome"), subject, ["x"], {"n": F.lit(1), "wins": F.col("outcome") == "win"}), "running")
    return rates(rows, subject, "n", window).select(*subject, "match_id", "x", "n", "cumulative", "rolling", "size")


@stored
def tagged_series(t: Tables, own: bool = False) -> DataFrame:
    win = (F.col("outcome") == "win").cast("long")
    return tagged(t, own).groupBy("player_id", "tag_code").agg(F.count(F.lit(1)).cast("long").alias("games"), F.sum(win).alias("wins"), F.round(F.avg(win), 6).alias("win_rate"))


@stored
def current_streaks(t: Tables, own: bool = False) -> DataFrame:
    """Outcome of each subject's latest match, and how many in a row had it."""
    ends = placed(t, own).groupBy("player_id", "outcome").agg(F.max("x").alias("x"))  # the last place of each outcome
    last = ends.groupBy("player_id").agg(F.max_by("outcome", "x").alias("outcome"), F.max("x").alias("_games"))
    other = ends.join(last.select("player_id", F.col("outcome").alias("_o")), "player_id").filter("outcome <> _o").groupBy("player_id").agg(F.max("x").alias("_x"))
    return last.join(other, "player_id", "left").select("player_id", "outcome", (F.col("_games") - F.coalesce("_x", F.lit(0))).alias("length"))


def hero_counts(t: Tables) -> DataFrame:
    """How often each player was seen on each hero."""
    names = F.broadcast(t.heroes.select(F.col("id").alias("hero_id"), F.col("name").alias("hero")))
    return t.match_players.dropna(subset=["player_id"]).groupBy("player_id", "hero_id").agg(F.count(F.lit(1)).cast("long").alias("games")).join(names, "hero_id").drop("hero_id")


def player_averages(t: Tables) -> DataFrame:
    return t.match_players.dropna(subset=["player_id"]).groupBy("player_id").agg(F.count(F.lit(1)).cast("long").alias("games"), *(F.round(F.avg(c), 6).alias(c) for c in STATS))


def spans(seasons: DataFrame) -> DataFrame:
    return broadcast_if_small(seasons.select(F.col("id").alias("new_id"), "name", F.col("starts_on").alias("starts"), F.col("ends_on").alias("ends")), SMALL)


def edited(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(EDITED, "id long, name string, starts_on string, ends_on string")


def reassign(t: Tables, seasons: DataFrame) -> DataFrame:
    """Matches whose season changes when the seasons become ``seasons`` (id, name, starts_on, ends_on), which don't overlap."""
    day = F.date_format(F.to_utc_timestamp(F.to_timestamp("played_at"), F.current_timezone()), "yyyy-MM-dd")
    m, s = t.matches.select(F.col("id").alias("match_id"), "season_id", day.alias("day")), spans(seasons)
    found = m.join(s, (F.col("day") >= F.col("starts")) & (F.col("day") <= F.coalesce("ends", F.lit("9999-12-31"))), "left")
    return found.filter(~F.col("season_id").eqNullSafe(F.col("new_id"))).select("match_id", F.col("season_id").alias("old_season"), F.col("new_id").alias("new_season"))


def clashes(t: Tables) -> DataFrame:
    """Each player's time from first to last match as a proposed season: names of the seasons that it overlaps."""
    m = t.matches.select(F.col("id").alias("match_id"), F.substring("played_at", 1, 10).alias("day"))
    whole = t.match_players.dropna(subset=["player_id"]).select("player_id", "match_id").join(m, "match_id").groupBy("player_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).dropna()
    hit = whole.join(spans(t.seasons), (F.col("a") <= F.coalesce("ends", F.lit("9999-12-31"))) & (F.col("starts") <= F.col("b")))
    return hit.groupBy("player_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("clashes"))  # at most every season


def typed_settings(stored: DataFrame) -> DataFrame:
    """(id, key, value) with the default in place of a value that is missing, empty or of the wrong type."""
    known = F.broadcast(stored.sparkSession.createDataFrame(SETTINGS, "key string, usual string, kind string"))  # a list in the code
    whole = F.col("value").rlike(r"^\s*[+-]?[0-9]+\s*$")
    real = F.trim("value").try_cast("double").cast("string")
    value = F.when(F.col("value") == "", None).when(F.col("kind") == "text", F.col("value")).when(F.col("kind") == "float", real).otherwise(F.when(whole, F.trim("value").try_cast("long").cast("string")))
    return stored.join(known, "key").select("id", "key", F.coalesce(value, "usual").alias("value"))


def stored_settings(t: Tables) -> DataFrame:
    """Customers as users with one stored setting each."""
    k = F.col("c_custkey")
    value = F.when(k % 4 == 0, "").when(k % 4 == 1, (k % 1000).cast("string")).when(k % 4 == 2, F.col("c_mktsegment"))
    return t.raw("customer").select(k.alias("id"), F.get(F.array(*(F.lit(s[0]) for s in SETTINGS)), (k % 6).cast("int")).alias("key"), value.alias("value"))


def team_sizes(t: Tables) -> DataFrame:
    """Rows of the larger team of each match, for where no size is given."""
    n = lambda side: F.sum((F.col("team") == side).cast("long"))
    rows = t.match_players.groupBy("match_id").agg(F.greatest(n("ally"), n("enemy")).alias("seats"))
    return t.matches.select(F.col("id").alias("match_id"), "team_size").join(rows, "match_id", "left").select("match_id", F.coalesce(F.col("team_size").cast("long"), "seats").alias("team_size"))


def reference_lists(t: Tables) -> DataFrame:
    """Heroes by role and maps by mode, by name."""
    heroes, maps = t.heroes.select(F.lit("hero").alias("kind"), F.col("role").alias("part"), "name"), t.maps.select(F.lit("map"), "mode", "name")
    return heroes.union(maps).groupBy("kind", "part").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def learned_counts(t: Tables) -> DataFrame:
    """Portraits taught for each hero: how many, how often matched, first seen (embeddings as portraits)."""
    p = t.raw("embeddings").groupBy((F.col("label").cast("long") + 1).alias("id")).agg(F.count(F.lit(1)).cast("long").alias("portraits"), F.sum(F.col("vec_id") % 7).alias("times_matched"), F.min("vec_id").alias("first_seen"))
    return p.join(t.heroes, "id").select("name", "role", "portraits", "times_matched", "first_seen")
