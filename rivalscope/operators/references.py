"""The schema's rules as a registry, and what follows from it: checking tables, deleting rows with all that hangs off them, clearing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small
from .subject import SMALL


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    to: str
    deleted: str = "refuse"  #: what becomes of a row whose target is deleted: "cascade", "null", or the deletion is refused
    key: str = "id"
    where: str = "true"  #: the rows that refer to this table

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column} is in {self.to}"


# References and what a deletion does, allowed values, uniqueness, columns that can't be null.
REFERENCES = [
    Reference("matches", "map_id", "maps"), Reference("matches", "rank_range_low", "ranks"), Reference("matches", "rank_range_high", "ranks"), Reference("matches", "season_id", "seasons", "null"),
    Reference("match_players", "match_id", "matches", "cascade"), Reference("match_players", "player_id", "players"), Reference("match_players", "hero_id", "heroes"),
    Reference("match_bans", "match_id", "matches", "cascade"), Reference("match_bans", "hero_id", "heroes"), Reference("match_sources", "match_id", "matches", "cascade"),
    Reference("player_nameplates", "player_id", "players", "cascade"), Reference("hero_portraits", "hero_id", "heroes", "cascade"), Reference("player_tags", "player_id", "players", "cascade"),
    Reference("player_tags", "tag_code", "tags", key="code"), Reference("drafts", "committed_match_id", "matches", "null"),
    Reference("field_provenance", "row_id", "matches", "cascade", where="table_name = 'matches'"), Reference("field_provenance", "row_id", "match_players", "cascade", where="table_name = 'match_players'"),
]
ALLOWED = {
    ("heroes", "role"): ["tank", "damage", "support"], ("maps", "mode"): ["control", "escort", "hybrid", "push", "flashpoint", "clash"], ("matches", "result"): ["win", "loss", "draw"], ("match_players", "team"): ["ally", "enemy"],
    ("match_players", "role"): ["tank", "damage", "support"], ("match_sources", "kind"): ["endgame_report", "in_game_scoreboard"], ("field_provenance", "source"): ["template", "manual"], ("drafts", "status"): ["open", "committed", "abandoned"], ("tags", "tag_set"): ["role", "free"],
}
UNIQUE = [("heroes", ["name"], "true"), ("maps", ["name"], "true"), ("ranks", ["ordinal"], "true"), ("players", ["display_name"], "true"), ("seasons", ["name"], "true"), ("match_players", ["match_id"], "is_me"), ("hero_portraits", ["hero_id", "phash"], "true"), ("player_tags", ["player_id", "tag_code"], "true")]
REQUIRED = {"heroes": ["name", "role"], "maps": ["name", "mode"], "players": ["display_name"], "matches": ["result"], "match_players": ["match_id", "team"], "match_bans": ["match_id", "hero_id"], "match_sources": ["match_id", "kind"], "player_nameplates": ["player_id"], "hero_portraits": ["hero_id"], "player_tags": ["player_id", "tag_code"]}
#: What a user has entered or taught; vocabularies, seasons and settings stay when all is cleared.
USER_TABLES = ["field_provenance", "match_bans", "match_sources", "match_players", "player_nameplates", "hero_portraits", "player_tags", "drafts", "matches", "players"]
#: A table comes before those that refer to it.
ORDER = ["heroes", "maps", "ranks", "tags", "seasons", "players", "matches", "match_players"]


def validate(t: Any, tables: Iterable[str]) -> DataFrame:
    """(rule, n): every rule about ``tables`` and the number of rows that break it; of rows that should be unique all but one do.

    References from or to other tables are not looked at.  Values and nulls are counted in one pass over each table.
    """
    tables, out = list(tables), []
    for name in tables:
        rules = {f"{name}.{c} is given": F.col(c).isNull() for c in REQUIRED.get(name, [])} | {f"{name}.{c} is allowed": ~F.col(c).isin(values) for (of, c), values in ALLOWED.items() if of == name}
        if rules:
            counts = F.array(*(F.struct(F.lit(rule).alias("rule"), F.count_if(broken).alias("n")) for rule, broken in rules.items()))
            out.append(getattr(t, name).agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.rule", "c.n"))
    for name, columns, where in UNIQUE:
        if name in tables:
            again = getattr(t, name).filter(where).dropna(subset=columns).groupBy(*columns).agg((F.count(F.lit(1)) - 1).alias("n"))
            out.append(again.agg(F.lit(f"{name}.{'+'.join(columns)} is unique").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))
    for ref in REFERENCES:
        if ref.table in tables and ref.to in tables:
            lost = getattr(t, ref.table).filter(ref.where).select(ref.column).dropna().join(getattr(t, ref.to).select(F.col(ref.key).alias(ref.column)), ref.column, "left_anti")
            out.append(lost.agg(F.lit(ref.name).alias("rule"), F.count(F.lit(1)).alias("n")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.union(part)
    return whole


class Refused(ValueError):
    """Rows are left that refer to what would be deleted: (reference, rows)."""


def delete(t: Any, table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The tables that change when the rows of ``table`` whose key is in ``keys`` (one column) are deleted, as they are afterwards.

    Rows that refer to a deleted one go too, and those that refer to them, or lose the reference, as the registry says.  If a row is left
    whose reference forbids it, ``Refused`` names it and nothing changes.
    """
    own = next((r.key for r in REFERENCES if r.to == table), "id")
    gone = {table: keys.toDF(own).dropna().distinct()}
    out = {table: getattr(t, table).join(broadcast_if_small(gone[table], SMALL), own, "left_anti")}
    forbidden = []
    for name in ORDER:
        for ref in (r for r in REFERENCES if r.to == name and name in gone):
            child = out[ref.table] if ref.table in out else getattr(t, ref.table)
            lost = broadcast_if_small(gone[name].select(F.col(ref.key).alias("_lost")), SMALL)
            hit = (F.col(ref.column) == F.col("_lost")) & F.expr(ref.where)
            if ref.deleted == "cascade":
                if ref.table in ORDER:
                    more = child.join(lost, hit, "left_semi").select("id")
                    gone[ref.table] = gone[ref.table].union(more) if ref.table in gone else more
                out[ref.table] = child.join(lost, hit, "left_anti")
            elif ref.deleted == "null":
                out[ref.table] = child.join(lost, hit, "left").withColumn(ref.column, F.when(F.col("_lost").isNull(), F.col(ref.column))).drop("_lost")
            else:
                forbidden.append((ref, lost, hit))
    left = [(ref.name, n) for ref, lost, hit in forbidden if (n := (out[ref.table] if ref.table in out else getattr(t, ref.table)).join(lost, hit, "left_semi").count())]
    if left:
        raise Refused(left)
    return out


def clear(t: Any) -> tuple[dict[str, DataFrame], DataFrame]:
    """All of a user's tables emptied, and (table_name, n) of the rows that they had."""
    counts = None
    for name in USER_TABLES:
        n = getattr(t, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        counts = n if counts is None else counts.union(n)
    return {name: getattr(t, name).limit(0) for name in USER_TABLES}, counts


def sizes(tables: dict[str, DataFrame], names: Sequence[str]) -> DataFrame:
    """(table_name, n) of some tables."""
    out = None
    for name in names:
        n = tables[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.union(n)
    return out
