"""Column expressions of the match analytics: outcome, tallies, Wilson bounds, Hamming distance, text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054  # fixed value: two-sided 95 percent
RELIABLE = 5  # fixed value: games from which a rate is called reliable


def outcome(result: Column, team: Column) -> Column:
    """The operator's result seen from a team: enemies get the reverse, draws stay."""
    return F.when(result == "draw", "draw").when(team == "ally", result).when(result == "win", "loss").otherwise("win")


def tally(out: str = "outcome") -> list[Column]:
    n = {k: F.coalesce(F.sum(F.when(F.col(out) == k, 1).otherwise(0)), F.lit(0)).cast("long") for k in ("win", "loss", "draw")}
    games = F.count(F.lit(1)).cast("long")
    return [games.alias("games"), n["win"].alias("wins"), n["loss"].alias("losses"), n["draw"].alias("draws"), F.round(F.try_divide(n["win"], games), 6).alias("win_rate"), (games >= RELIABLE).alias("reliable")]


def wilson(wins: Column, losses: Column, lower: bool) -> Column:
    n = (wins + losses).cast("double")
    p = wins / n
    mid, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    x = ((mid - spread) if lower else (mid + spread)) / (1 + Z * Z / n)
    return F.when(wins + losses <= 0, F.lit(0.0 if lower else 1.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def kind_guess(name: Column) -> Column:
    return F.when(F.lower(name).rlike("tab|scoreboard|ingame|in-game|in_game"), "in_game_scoreboard").otherwise("endgame_report")


def name_clean(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}_\-\[\]]", "")
