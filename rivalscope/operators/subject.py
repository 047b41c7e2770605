"""The subject match set: every match seen from a chosen player's point of view, with filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import outcome
from ..shared import broadcast_if_small
from ..sources.fixtures import Tables

SMALL = 100_000  #: rows of a vocabulary that is broadcast


@dataclass
class Filters:
    hero_id: int | None = None
    role: str | None = None
    map_id: int | None = None
    mode: str | None = None
    team_size: int | None = None
    season_id: int | str | None = None  #: an id, or "none" for matches without a season
    date_from: str | None = None
    date_to: str | None = None
    rank_min: int | None = None  #: ordinals of ``ranks``, whose ids say nothing about the order; a match without a known rank is left out
    rank_max: int | None = None
    with_player: int | None = None
    against_player: int | None = None

    def columns(self) -> list[Column]:
        """Plain predicates; dates compare as text, and an empty text is unset."""
        out = [F.col(c) == v for c, v in (("hero_id", self.hero_id), ("role", self.role), ("map_id", self.map_id), ("mode", self.mode), ("team_size", self.team_size)) if v is not None]
        if self.season_id is not None:
            out.append(F.col("season_id").isNull() if self.season_id == "none" else F.col("season_id") == int(self.season_id))
        if self.date_from:
            out.append(F.col("played_at") >= self.date_from)
        if self.date_to:
            out.append(F.col("played_at") <= self.date_to)
        return out


def subject_matches(t: Tables, player_id: int | None = None, filters: Filters | None = None) -> DataFrame:
    """One row for each row of the subject (the operator where ``player_id`` is None), two rows in a match both counting."""
    filters = filters or Filters()
    rows = t.match_players.filter("is_me" if player_id is None else F.col("player_id") == player_id)
    own = rows.select(F.col("id").alias("subject_row_id"), "match_id", "team", "hero_id", F.col("role").alias("_role"), "eliminations", "assists", "deaths", "damage", "healing", "mitigation")
    heroes = broadcast_if_small(t.heroes.select(F.col("id").alias("hero_id"), F.col("name").alias("hero"), F.col("role").alias("_hero_role")), SMALL)
    maps = broadcast_if_small(t.maps.select(F.col("id").alias("map_id"), F.col("name").alias("map"), F.col("mode").alias("_map_mode")), SMALL)
    m = t.matches.withColumnsRenamed({"id": "match_id", "mode": "_mode"})
    sm = own.join(m, "match_id").join(heroes, "hero_id", "left").join(maps, "map_id", "left")
    sm = sm.withColumns({"role": F.coalesce("_role", "_hero_role"), "mode": F.coalesce("_mode", "_map_mode"), "outcome": outcome(F.col("result"), F.col("team"))})
    for predicate in filters.columns():
        sm = sm.filter(predicate)
    for column, bound, ok in (("rank_range_low", filters.rank_min, lambda c: c >= filters.rank_min), ("rank_range_high", filters.rank_max, lambda c: c <= filters.rank_max)):
        if bound is not None:
            good = t.ranks.filter(ok(F.col("ordinal"))).select(F.col("id").alias(column)).distinct()
            sm = sm.join(broadcast_if_small(good, SMALL), column, "left_semi")
    for who, same in ((filters.with_player, True), (filters.against_player, False)):
        if who is not None:
            other = t.match_players.filter(F.col("player_id") == who).select(F.col("match_id").alias("_m"), F.col("team").alias("_t"), F.col("id").alias("_i"))
            on = (F.col("match_id") == F.col("_m")) & ((F.col("team") == F.col("_t")) & (F.col("subject_row_id") != F.col("_i")) if same else F.col("team") != F.col("_t"))
            sm = sm.join(other, on, "left_semi")
    return sm.drop("_role", "_hero_role", "_mode", "_map_mode")
