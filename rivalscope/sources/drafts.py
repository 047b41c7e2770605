"""Drafts waiting to be committed, and what the tables held before, derived from the match history.

Every fourth match is a draft; of these every second is an edit of the match that is already there.
The rest, and the matches that are edited, are the tables as they were.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import documents as D
from .fixtures import Tables
from .store import SCHEMAS

STATS = ["eliminations", "assists", "deaths", "damage", "healing", "mitigation"]


def phash(n: Column) -> Column:
    """A made-up perceptual hash: sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(n), 16, "0"))


def portrait(hero_id: Column, row_id: Column) -> Column:
    return phash(hero_id * 3 + row_id % 5)


@dataclass
class Drafts:
    t: Tables

    @cached_property
    def meta(self) -> DataFrame:
        """draft_id, editing_match_id and the match fields; some results are blank or unknown, some drafts have open conflicts."""
        i = F.col("id")
        return self.t.matches.filter(i % 4 == 0).select(
            i.alias("draft_id"),
            F.when(i % 8 == 0, i).alias("editing_match_id"),
            F.when(i % 28 == 0, "  ").when(i % 36 == 0, "bad").otherwise(F.col("result")).alias("result"),
            "played_at", "map_id", "mode",
            F.when(i % 12 != 0, F.col("team_size")).alias("team_size"),
            F.when(i % 20 == 0, 1).otherwise(0).alias("conflicts"),
        )

    @cached_property
    def rows(self) -> DataFrame:
        """The rows of the drafts; some are blank, some drafts have no own row or two."""
        i, d = F.col("id"), F.col("match_id")
        names = self.t.players.select(F.col("id").alias("player_id"), "display_name")
        p = self.t.match_players.filter(d % 4 == 0).join(names, "player_id", "left")
        blank = i % 17 == 0
        own = F.when(d % 44 == 0, False).when(d % 52 == 0, F.col("row_index") == 0).otherwise(F.col("is_me"))
        fresh = F.concat(F.lit("  New "), (F.col("player_id") % 50).cast("string"), F.lit(" "))
        name = F.when(F.col("player_id").isNull(), "").when(i % 5 == 0, fresh).when(i % 2 == 1, F.col("display_name"))
        return p.select(
            d.alias("draft_id"), i.alias("row_id"), "team", "row_index", own.alias("is_me"),
            F.when((i % 2 == 0) & (i % 5 != 0) & ~blank, F.col("player_id")).alias("player_id"),
            *(F.when(~blank, c).alias(n) for n, c in (("player_name", name), *((c, F.col(c)) for c in ("role", "hero_id", *STATS)))),
            F.get(F.array(*map(F.lit, ("template", "manual", "default"))), (i % 3).cast("int")).alias("source"),
            F.when(i % 7 == 0, "old").alias("superseded"),
            F.when(i % 3 != 0, phash(F.col("player_id") * 10 + i % 4)).alias("nameplate"),
            F.when(~blank, portrait(F.col("hero_id"), i)).alias("portrait"),
        )

    @cached_property
    def old_matches(self) -> DataFrame:
        return self.t.matches.filter((F.col("id") % 4 != 0) | (F.col("id") % 8 == 0))

    @cached_property
    def old_rows(self) -> DataFrame:
        return self.t.match_players.filter((F.col("match_id") % 4 != 0) | (F.col("match_id") % 8 == 0))

    @cached_property
    def old_bans(self) -> DataFrame:
        return self.t.match_bans.filter((F.col("match_id") % 4 != 0) | (F.col("match_id") % 8 == 0))

    @cached_property
    def old_portraits(self) -> DataFrame:
        """hero_id, phash, times_matched; no hash has two heroes."""
        p = self.t.match_players.filter("match_id % 4 = 1 AND hero_id IS NOT NULL")
        p = p.select("hero_id", portrait(F.col("hero_id"), F.col("id")).alias("phash"))
        owner = p.groupBy("phash").agg(F.min("hero_id").alias("hero_id"))
        return p.join(owner, ["phash", "hero_id"]).groupBy("hero_id", "phash").agg(F.count(F.lit(1)).alias("times_matched"))

    @cached_property
    def old_nameplates(self) -> DataFrame:
        p = self.t.match_players.filter("match_id % 4 = 2 AND player_id IS NOT NULL")
        p = p.select("player_id", phash(F.col("player_id") * 10 + F.col("id") % 4).alias("phash"))
        return p.groupBy("player_id", "phash").agg(F.count(F.lit(1)).alias("times_matched"))


class DraftStore:
    """The tables of a user whose drafts are those above, as documents: what a commit as a whole reads.

    Files, bans, superseded values and stored counters are made up, and so is the provenance of matches that are edited.
    With ``written`` the large tables are written first, as a user's are, for those who read them many times; that is done inside their run (``scratch``).
    """

    def __init__(self, t: Tables, written: bool = False):
        self.t = t.written("matches", "lines") if written else t
        self.d, self.spark = Drafts(self.t), t.spark
        self.heroes, self.maps, self.seasons = t.heroes, t.maps, t.seasons

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        kinds = [f.strip().split(" ") for f in SCHEMAS[name].split(",")]
        rows = getattr(self, f"_{name}")()
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds))

    def _players(self) -> DataFrame:
        return self.t.players.withColumn("games_seen", F.col("id") % 40)

    def _matches(self) -> DataFrame:
        return self.d.old_matches

    def _match_players(self) -> DataFrame:
        return self.d.old_rows

    def _match_bans(self) -> DataFrame:
        return self.d.old_bans.withColumn("id", F.col("match_id") * 10 + F.col("slot_index"))

    def _match_sources(self) -> DataFrame:
        return self.d.old_matches.filter("id % 16 = 0").select("id", F.col("id").alias("match_id"), F.concat(F.lit("screenshots/"), F.col("id").cast("string"), F.lit("/old.png")).alias("file_path"))

    def _field_provenance(self) -> DataFrame:
        of_match = self.d.old_matches.filter("id % 5 = 0").select(F.col("id"), F.lit("matches").alias("table_name"), F.col("id").alias("row_id"), F.lit("mode").alias("column_name"))
        of_row = self.d.old_rows.filter("id % 9 = 0").select(F.col("id"), F.lit("match_players"), F.col("id").alias("row_id"), F.lit("role"))
        return of_match.union(of_row).withColumn("source", F.lit("template"))

    def _player_nameplates(self) -> DataFrame:
        return self.d.old_nameplates.withColumn("id", F.col("player_id"))

    def _hero_portraits(self) -> DataFrame:
        return self.d.old_portraits.withColumn("id", F.col("hero_id"))

    @cached_property
    def documents(self) -> D.Documents:
        cell = lambda v, source, sure: F.struct(v.alias("value"), source.alias("source"), F.when(source == "template", "endgame_report").otherwise(source).alias("origin"), sure.alias("confidence"))
        m = self.d.meta
        of = F.when(F.col("draft_id") % 3 == 0, "template").otherwise("manual")
        meta = m.select("draft_id", "editing_match_id", *(cell((F.col(c) if c in m.columns else F.lit(None)).cast(kind), of, F.lit(0.9)).alias(c) for c, kind in D.META.items()))
        r = self.d.rows
        passed = {"player_id": F.col("player_id"), "nameplate_phash": F.col("nameplate"), "nameplate_width": F.lit(30), "portrait_phash": F.col("portrait")}
        rows = r.select("draft_id", F.col("row_id").alias("place"), "team", F.col("row_index").cast("long").alias("row_index"), "is_me", *(passed.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in D.PASSED.items()), *(cell(F.col(c).cast(kind), F.col("source"), F.lit(0.8)).alias(c) for c, kind in D.CELLS.items()))
        bans = self.t.match_bans.filter("match_id % 4 = 0").select(F.col("match_id").alias("draft_id"), F.col("slot_index").alias("place"), "hero_id", F.col("slot_index").cast("long").alias("slot_index"))
        path = F.concat(F.lit("rows["), "team", F.lit(":"), F.col("row_index").cast("string"), F.lit("].damage"))
        lost = r.filter("superseded IS NOT NULL").select("draft_id", F.col("row_id").alias("place"), path.alias("path"), F.col("superseded").alias("value"))
        file = m.filter("draft_id % 3 = 0").select("draft_id", F.lit(0).alias("place"), F.format_string("drafts/%d/shot.png", "draft_id").alias("path"), F.sha2(F.col("draft_id").cast("string"), 256).alias("sha256"), F.lit("endgame_report").alias("kind"), F.lit(None).cast("string").alias("ingested_at"))
        open_ = m.filter("conflicts > 0").select("draft_id", F.lit(0).alias("place"), F.lit("meta.mode").alias("path"), F.lit("a").alias("mine"), F.lit("b").alias("theirs"), F.lit("endgame_report").alias("theirs_origin"), F.lit(0.5).alias("theirs_confidence"))
        return D.Documents(meta=meta, rows=rows, bans=bans, files=file, conflicts=open_, superseded=lost, rejects=meta.limit(0))

    def _drafts(self) -> DataFrame:
        """One document in thirteen is cut off in the middle, one in seventeen has a word for a number."""
        i = F.col("draft_id")
        broken = F.when(i % 13 == 0, F.expr("left(payload, length(payload) div 2)")).when(i % 17 == 0, F.regexp_replace("payload", r'"deaths":\{"value":\d+', '"deaths":{"value":"many"')).otherwise(F.col("payload"))
        return D.build(self.documents).select(i.alias("id"), F.lit("open").alias("status"), broken.alias("payload"))
