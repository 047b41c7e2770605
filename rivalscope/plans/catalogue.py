"""The registered queries of the match analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import kind_guess, name_clean
from ..operators import breakdowns as B, history, identify, merging, names
from ..operators.subject import Filters, subject_matches
from ..sources.fixtures import Tables

Query = Callable[[SparkSession, str], DataFrame]
PLAYER = 3  #: the player from whose point of view the ``_player`` queries are

FILTERS = {
    "filter_hero": Filters(hero_id=4),
    "filter_role": Filters(role="tank"),
    "filter_map": Filters(map_id=3),
    "filter_mode": Filters(mode="escort"),
    "filter_team_size": Filters(team_size=2),
    "filter_dates": Filters(date_from="1995-03-01", date_to="1996-09-30"),
    "filter_rank": Filters(rank_min=5, rank_max=30),
    "filter_teammate": Filters(with_player=7),
    "filter_opponent": Filters(against_player=8),
    "filter_season": Filters(season_id=2),
    "filter_unassigned": Filters(season_id="none"),
}


def me(f: Callable[[DataFrame, Tables], DataFrame], filters: Filters | None = None, player: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(spark, sf_dir)
        return f(subject_matches(t, player, filters), t)

    return run


def whole(f: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def export_everything(t: Tables) -> DataFrame:
    """One row for each player of each match, names in place of ids."""
    p, h, m = t.players.toDF("player_id", "player"), F.broadcast(t.heroes.select(F.col("id").alias("hero_id"), F.col("name").alias("hero"))), F.broadcast(t.maps.select(F.col("id").alias("map_id"), F.col("name").alias("map")))
    games = t.matches.select(F.col("id").alias("match_id"), "played_at", "map_id", "result", "team_size").join(m, "map_id", "left")
    rows = t.match_players.select("match_id", "player_id", "team", "row_index", "hero_id", *B.STATS)
    return games.join(rows, "match_id").join(p, "player_id", "left").join(h, "hero_id", "left").select("match_id", "played_at", "map", "result", "team_size", "team", "row_index", "player", "hero", *B.STATS)


def match_list_page(t: Tables) -> DataFrame:
    """The third page of 50 matches, latest first."""
    return t.matches.select("id", "played_at", "result").orderBy(F.desc_nulls_last("played_at"), F.desc("id")).offset(100).limit(50)


def season_counts(t: Tables) -> DataFrame:
    """Every season with its number of matches, and the matches without a season if there are any."""
    n = t.matches.groupBy("season_id").agg(F.count(F.lit(1)).cast("long").alias("matches"))
    listed = t.seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season")).join(n, "season_id", "left").select("season", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"))
    return listed.union(n.filter("season_id IS NULL").select(F.lit("Unassigned"), "matches"))


def duplicate_files(t: Tables) -> DataFrame:
    """Files (documents) whose bytes an earlier file has: id, and the first file's id."""
    f = t.raw("documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha"))
    first = f.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return f.join(first, "sha").filter("doc_id <> first_id").select("doc_id", "first_id")


def latest_by_path(t: Tables) -> DataFrame:
    """Last writer wins for each (draft, path): events as manual edits."""
    e = t.raw("events").select("user_id", "event_type", "event_id", F.get_json_object("props", "$.k").alias("v"))
    return e.groupBy("user_id", "event_type").agg(F.max_by("v", "event_id").alias("value"), F.count(F.lit(1)).cast("long").alias("edits"))


def delete_cascade(t: Tables) -> DataFrame:
    """Rows left in each table after the drawn matches are deleted."""
    gone = t.matches.filter("result = 'draw'").select(F.col("id").alias("match_id"))
    count = lambda name, df: df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).cast("long").alias("n"))
    out = count("matches", t.matches.join(gone.withColumnRenamed("match_id", "id"), "id", "left_anti"))
    for name, df in (("match_players", t.match_players), ("match_bans", t.match_bans)):
        out = out.union(count(name, df.join(gone, "match_id", "left_anti")))
    return out


def relation(t: Tables, same: bool) -> DataFrame:
    """The operator's record with, or against, every other player."""
    mine = t.match_players.filter("is_me").select("match_id", F.col("team").alias("_mt"))
    them = t.match_players.filter(~F.col("is_me")).dropna(subset=["player_id"]).select("match_id", "team", "player_id")
    rows = them.join(mine, "match_id").filter((F.col("team") == F.col("_mt")) if same else (F.col("team") != F.col("_mt"))).join(t.matches.select(F.col("id").alias("match_id"), F.col("result").alias("outcome")), "match_id")
    return rows.groupBy("player_id").agg(*B.tally())


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "overall_me": me(lambda sm, t: B.overall(sm)),
        "overall_player": me(lambda sm, t: B.overall(sm), player=PLAYER),
        "totals_me": me(B.totals),
        "by_map": me(lambda sm, t: B.by(sm, "map")),
        "by_map_player": me(lambda sm, t: B.by(sm, "map"), player=PLAYER),
        "by_hero": me(lambda sm, t: B.by(sm, "hero")),
        "by_role": me(lambda sm, t: B.by(sm, "role")),
        "by_mode": me(lambda sm, t: B.by(sm, "mode")),
        "by_team_size": me(lambda sm, t: B.by_team_size(sm)),
        "by_ally": me(lambda sm, t: B.by_player(sm, t, True)),
        "by_opponent": me(lambda sm, t: B.by_player(sm, t, False, 2)),
        "by_ally_hero": me(lambda sm, t: B.by_other_hero(sm, t, True)),
        "by_opponent_hero": me(lambda sm, t: B.by_other_hero(sm, t, False)),
        "bans": me(B.bans),
        "comp_shapes": me(lambda sm, t: B.comp_shapes(sm, t)[0]),
        "comp_unclassified": me(lambda sm, t: B.comp_shapes(sm, t)[1]),
        "hero_pairs": me(B.hero_pairs),
        "crosstab": me(lambda sm, t: B.by(sm, "map", "hero")),
        "averages": me(lambda sm, t: B.averages(sm)),
        "averages_by_role": me(lambda sm, t: B.averages(sm, "role")),
        "wilson_by_map": me(lambda sm, t: B.with_wilson(B.by(sm, "map"))),
        "most_banned": me(lambda sm, t: B.bans(sm, t).select("name", "games", "ban_rate").orderBy(F.desc("games"), "name").limit(5)),
        "trend_points": whole(B.trends),
        "streak_longest": whole(B.longest_streaks),
        "players_tags": whole(B.tags_of_players),
        "player_with_me": whole(lambda t: relation(t, True)),
        "player_against_me": whole(lambda t: relation(t, False)),
        "export_everything": whole(export_everything),
        "match_list_page": whole(match_list_page),
        "season_counts": whole(season_counts),
        "duplicate_files": whole(duplicate_files),
        "latest_by_path": whole(latest_by_path),
        "delete_cascade": whole(delete_cascade),
        "exact_comps": me(B.exact_comps),
        "merge_drafts": whole(lambda t: merging.merge_cells(merging.observations(t), ["draft", "path"])),
        "games_seen": whole(merging.games_seen),
        "integrity": whole(merging.violations),
        "match_cells": whole(merging.match_cells),
        "hero_identify": whole(identify.hero_identify),
        "tagged_trends": whole(history.tagged_trends),
        "tagged_series": whole(history.tagged_series),
        "streak_current": whole(history.current_streaks),
        "player_hero_counts": whole(history.hero_counts),
        "player_averages": whole(history.player_averages),
        "season_reassign": whole(lambda t: history.reassign(t, history.edited(t))),
        "season_clashes": whole(history.clashes),
        "typed_settings": whole(lambda t: history.typed_settings(history.stored_settings(t))),
        "team_sizes": whole(history.team_sizes),
        "reference_lists": whole(history.reference_lists),
        "learned_counts": whole(history.learned_counts),
        "name_suggestions": whole(lambda t: names.suggestions(*names.part_names(t))),
        "kind_guess": whole(lambda t: t.raw("part").select("p_partkey", kind_guess(F.col("p_name")).alias("kind"))),
        "name_clean": whole(lambda t: t.raw("customer").select("c_custkey", name_clean(F.col("c_name")).alias("clean"))),
    }
    subjects = {"trend_points": B.trends, "streak_longest": B.longest_streaks, "tagged_trends": history.tagged_trends, "tagged_series": history.tagged_series, "streak_current": history.current_streaks}
    out |= {f"{name}_me": whole(lambda t, f=f: f(t, own=True).drop("player_id")) for name, f in subjects.items()}
    return out | {name: me(lambda sm, t: B.by(sm, "team"), f) for name, f in FILTERS.items()}
