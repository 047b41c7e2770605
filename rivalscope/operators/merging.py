"""Draft cells: precedence merge, games seen, integrity, and matches as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import Tables

# What an origin counts when cells disagree; others count 0.
ORIGIN_RANK = {"name_suggestion": 0, "in_game_scoreboard": 1, "endgame_report": 2, "manual": 3}
SUGGESTION, TOP = "name_suggestion", 3


def rank_of(origin: Column) -> Column:
    out = F.lit(0)
    for name, n in ORIGIN_RANK.items():
        out = F.when(origin == name, n).otherwise(out)
    return out


def merge_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Merges the cells (keys, seq, value, origin and, if there is one, source) of each key in the order of ``seq``, which is unique in a key.

    The first cell with a value holds until one with another value and a higher rank comes; equal values
    and suggestions leave it as it is.  A value whose source (without that column, whose origin) is manual stays, and each later differing value is a conflict;
    any other losing value is superseded.  Ranks rise with each change, so there are at most four holders,
    found by as many aggregates instead of a fold over a collected list.  Blank values don't take part; a
    key without values gives no row.
    """
    manual = F.coalesce(F.col("source" if "source" in cells.columns else "origin") == "manual", F.lit(False))
    full = cells.filter(F.col("value").rlike(r"(?U)\S")).withColumns({"rank": rank_of(F.col("origin")), "manual": manual})
    full = full.withColumn("holds", F.when(F.col("manual"), TOP).otherwise(F.col("rank")))  # what another value has to outrank
    held = F.struct("seq", "value", "origin", "holds", "manual")
    first = full.groupBy(*keys).agg(F.min_by(held, "seq").alias("h"))
    spans = first.withColumn("level", F.lit(0))
    for level in range(1, TOP + 1):
        after = full.join(first, keys).filter((F.col("seq") > F.col("h.seq")) & (F.col("value") != F.col("h.value")) & (F.col("rank") > F.col("h.holds")) & ~F.coalesce(F.col("origin") == SUGGESTION, F.lit(False)))
        first = after.groupBy(*keys).agg(F.min_by(held, "seq").alias("h"))
        spans = spans.union(first.withColumn("level", F.lit(level)))
    steps = spans.groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias("holders"))  # four at most
    rows = full.join(steps, keys).withColumn("at", F.try_element_at(F.filter("holders", lambda h: h["seq"] < F.col("seq")), F.lit(-1)))
    against = F.col("at").isNotNull() & (F.col("value") != F.col("at.value")) & ~F.coalesce(F.col("origin") == SUGGESTION, F.lit(False))
    manual = F.coalesce(F.col("at.manual"), F.lit(False))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    last = F.element_at(F.first("holders"), -1)
    return rows.groupBy(*keys).agg(last["value"].alias("value"), last["origin"].alias("origin"), n(against & manual).alias("conflicts"), n(against & ~manual).alias("superseded"))


def observations(t: Tables) -> DataFrame:
    return cells_of_events(t.raw("events"))


def cells_of_events(events: DataFrame) -> DataFrame:
    """Events as cells of drafts; some are blank."""
    origins = F.array(*map(F.lit, ORIGIN_RANK))
    value = F.when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k"))
    return events.select(F.col("user_id").alias("draft"), F.col("event_type").alias("path"), F.col("event_id").alias("seq"), value.alias("value"), F.get(origins, (F.col("event_id") % 4).cast("int")).alias("origin"))


def games_seen(t: Tables) -> DataFrame:
    """For each known player: number of roster rows and the latest time seen."""
    rows = t.match_players.dropna(subset=["player_id"]).select("match_id", "player_id").join(t.matches.select(F.col("id").alias("match_id"), "played_at"), "match_id")
    n = rows.groupBy("player_id").agg(F.count(F.lit(1)).cast("long").alias("n"), F.max("played_at").alias("last_seen"))
    return t.players.join(n, F.col("id") == F.col("player_id"), "left").select("id", "display_name", F.coalesce("n", F.lit(0)).alias("games_seen"), "last_seen")


def violations(t: Tables) -> DataFrame:
    """Number of rows that break each rule of the schema."""
    p, m = t.match_players, t.matches
    count = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).cast("long").alias("n"))
    players = t.players.select(F.col("id").alias("player_id"))
    return (
        count("roster row without match", p.join(m.select(F.col("id").alias("match_id")), "match_id", "left_anti"))
        .union(count("roster row of unknown player", p.dropna(subset=["player_id"]).join(players, "player_id", "left_anti")))
        .union(count("match with several own rows", p.filter("is_me").groupBy("match_id").count().filter("count > 1")))
        .union(count("match without own row", m.join(p.filter("is_me").select(F.col("match_id").alias("id")), "id", "left_anti")))
        .union(count("unknown result", m.filter(~F.coalesce(F.col("result").isin("win", "loss", "draw"), F.lit(False)))))
    )


def match_cells(t: Tables) -> DataFrame:
    """A reopened match as cells: one row for each field that has a value."""
    fields = ["played_at", "map_id", "mode", "result", "team_size", "duration_seconds"]
    cells = F.array(*(F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value")) for f in fields))
    return t.matches.select("id", F.explode(cells).alias("c")).select(F.col("id").alias("match_id"), "c.path", "c.value").filter("value IS NOT NULL")
