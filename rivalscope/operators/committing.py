"""Committing drafts: each function gives one table as it is after all valid drafts are committed in the order of their ids.

Tables are never changed in place: rows that an edit replaces are left out and the draft's are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import global_rank, heavy_keys, lookup, materialize, stored
from ..sources.drafts import STATS, Drafts
from .publishing import season_of

ROW_FIELDS = ["player_name", "role", "hero_id", *STATS]


def blank(c: str) -> Column:
    """Null, or text without any character but white space."""
    return F.col(c).isNull() | F.col(c).cast("string").rlike(r"(?U)^\s*$")


def populated(d: Drafts) -> DataFrame:
    """Rows with any content, and the operator's own."""
    return d.rows.filter(F.col("is_me") | F.greatest(*(~blank(c) for c in ROW_FIELDS)))


def problems(d: Drafts) -> DataFrame:
    """(draft_id, problem): why a draft can't be committed; none for one that can."""
    own = populated(d).groupBy("draft_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_me").alias("own"))
    facts = d.meta.join(own, "draft_id", "left").fillna(0, ["rows", "own"])
    rules = [
        (blank("result"), "no result"),
        (~blank("result") & ~F.col("result").isin("win", "loss", "draw"), "unknown result"),
        (F.col("conflicts") > 0, "open conflicts"),
        ((F.col("rows") > 0) & (F.col("own") == 0), "no own row"),
        (F.col("own") > 1, "several own rows"),
    ]
    found = F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))
    return facts.select("draft_id", F.explode(found).alias("problem"))


@stored
def valid(d: Drafts) -> DataFrame:
    """The drafts without problems, with the id of their match: that which they edit, or a new one in the order of drafts."""
    good = d.meta.join(problems(d).select("draft_id").distinct(), "draft_id", "left_anti")
    last = d.old_matches.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    fresh = good.filter("editing_match_id IS NULL").select("draft_id", F.lit(1).alias("_one"))
    number = global_rank(fresh, ["draft_id"], "_one", "_new").drop("_one")
    out = good.join(number, "draft_id", "left").join(F.broadcast(last))
    return out.withColumn("match_id", F.coalesce("editing_match_id", F.col("_last") + F.col("_new") + 1)).drop("_last", "_new")


def kept(old: DataFrame, key: str, ok: DataFrame) -> DataFrame:
    """The old rows that no edit replaces."""
    edited = ok.filter("editing_match_id IS NOT NULL").select(F.col("editing_match_id").alias(key))
    return old.join(edited, key, "left_anti")


@stored
def matches_after(d: Drafts) -> DataFrame:
    """A missing team size is that of the larger team, none if there is no row."""
    ok = valid(d)
    seats = populated(d).groupBy("draft_id").agg(F.count_if(F.col("team") == "ally").alias("a"), F.count_if(F.col("team") == "enemy").alias("e"))
    size = F.coalesce(F.nullif("team_size", F.lit(0)), F.nullif(F.greatest("a", "e").cast("int"), F.lit(0)))
    cols = ["id", "played_at", "map_id", "mode", "result", "team_size", "season_id"]
    new = ok.join(seats, "draft_id", "left").withColumns({"id": F.col("match_id"), "team_size": size})
    new = new.join(season_of(new, d.t.seasons), "id", "left")
    return kept(d.old_matches, "id", ok).select(*cols).unionByName(new.select(*cols))


@stored
def resolved(d: Drafts, ok: DataFrame | None = None) -> DataFrame:
    """The rows of valid drafts with ``match_id`` and the player they name: by id, or by exact trimmed name, known or new.

    New players get ids above all old ones, in the order of the first row that names them.
    """
    names = d.t.players.select(F.col("id").alias("_known"), F.col("display_name").alias("_name"))
    rows = populated(d).join((ok or valid(d)).select("draft_id", "match_id"), "draft_id").withColumn("_name", F.when(~blank("player_name"), F.regexp_replace("player_name", r"(?U)^\s+|\s+$", "")))
    rows = materialize(rows, "drafted")
    # rows without a name would all meet in one task, and so would those of a frequent one
    named, unnamed = rows.filter("_name IS NOT NULL"), rows.filter("_name IS NULL")
    hot = heavy_keys(named, ["_name"])
    named = lookup(named, names, ["_name"], "left", hot, stored=True)
    new = named.filter("player_id IS NULL AND _known IS NULL").groupBy("_name").agg(F.min("row_id").alias("_first")).withColumn("_one", F.lit(1))
    number = global_rank(new, ["_first"], "_one", "_new").select("_name", "_new")
    last = d.t.players.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    out = lookup(named, number, ["_name"], "left", hot).unionByName(unnamed, allowMissingColumns=True).join(F.broadcast(last))
    who = F.coalesce("player_id", "_known", F.col("_last") + F.col("_new") + 1)
    return out.withColumns({"is_new": F.col("player_id").isNull() & F.col("_new").isNotNull(), "player_id": who}).drop("_known", "_last", "_new")


@stored
def roster_after(d: Drafts) -> DataFrame:
    ok, cols = valid(d), ["match_id", "team", "row_index", "is_me", "player_id", "role", "hero_id", *STATS]
    return kept(d.old_rows, "match_id", ok).select(*cols).unionByName(resolved(d, ok).select(*cols))


@stored
def bans_after(d: Drafts) -> DataFrame:
    ok = valid(d)
    drafted = d.t.match_bans.withColumnRenamed("match_id", "draft_id").join(ok.select("draft_id", "match_id"), "draft_id")
    cols = ["match_id", "hero_id", "slot_index"]
    return kept(d.old_bans, "match_id", ok).select(*cols).unionByName(drafted.select(*cols))


@stored
def players_after(d: Drafts) -> DataFrame:
    """Games seen: the old count, less the rows of edited matches but not below 0, and one for each new row."""
    ok = valid(d)
    rows = resolved(d, ok)
    n = F.count(F.lit(1))
    edited = ok.filter("editing_match_id IS NOT NULL").select(F.col("editing_match_id").alias("match_id"), F.lit(True).alias("_edited"))
    before = d.old_rows.dropna(subset=["player_id"]).select("match_id", "player_id").join(edited, "match_id", "left").groupBy("player_id").agg(n.alias("_before"), F.count("_edited").alias("_back"))
    more = rows.dropna(subset=["player_id"]).groupBy("player_id").agg(n.alias("_more"))
    new = rows.filter("is_new").select(F.col("player_id").alias("id"), F.col("_name").alias("display_name")).distinct()
    who = d.t.players.unionByName(new).withColumnRenamed("id", "player_id")
    for part in (before, more):
        who = who.join(part, "player_id", "left")
    seen = F.greatest(F.lit(0), F.coalesce("_before", F.lit(0)) - F.coalesce("_back", F.lit(0))) + F.coalesce("_more", F.lit(0))
    return who.select(F.col("player_id").alias("id"), "display_name", seen.cast("long").alias("games_seen"))


@stored
def provenance(d: Drafts) -> DataFrame:
    """One row for each non-blank cell that a template read, with the value it replaced."""
    cells = F.array(*(F.when(~blank(c), F.lit(c)) for c in ROW_FIELDS))
    rows = resolved(d).filter("source = 'template'")
    return rows.select("match_id", "row_id", F.explode(F.array_compact(cells)).alias("column_name"), F.col("superseded").alias("superseded_value"))


def learned(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """(owner, phash, times_matched): the old counts and the new rows together."""
    both = old.select(owner, "phash", "times_matched").unionByName(new.select(owner, "phash", F.lit(1).cast("long").alias("times_matched")))
    return both.groupBy(owner, "phash").agg(F.sum("times_matched").alias("times_matched"))


@stored
def nameplates_after(d: Drafts) -> DataFrame:
    new = resolved(d).dropna(subset=["player_id", "nameplate"]).withColumnRenamed("nameplate", "phash")
    return learned(d.old_nameplates, new, "player_id")


@stored
def portraits_after(d: Drafts) -> DataFrame:
    """A hash that another hero holds is refused: its owner is that of the library, or who came first."""
    new = resolved(d).dropna(subset=["hero_id", "portrait"]).withColumnRenamed("portrait", "phash")
    first = new.groupBy("phash").agg(F.min_by("hero_id", "row_id").alias("_first"))
    held = d.old_portraits.groupBy("phash").agg(F.min("hero_id").alias("_held"))
    owner = first.join(held, "phash", "left").select("phash", F.coalesce("_held", "_first").alias("hero_id"))
    return learned(d.old_portraits, new.join(owner, ["phash", "hero_id"]), "hero_id")
