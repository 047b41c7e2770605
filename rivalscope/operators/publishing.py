"""Committing open drafts as a whole, reopening matches, and publishing what comes of it.

``commit`` reads the drafts' documents once, decides once who can be committed and who the players are, and gives all tables
as they are afterwards.  ``publish`` writes them beside the old ones and then one manifest, which readers follow: they see all of a
commit or nothing of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, global_rank, global_ranks, lookup, materialize, scratch
from ..sources import documents as D
from ..sources.store import SCHEMAS, Store

SMALL = 100_000  #: rows of a table that is broadcast


def blank(c: Column, kind: str = "string") -> Column:
    """A cell without a value, or of white space only; numbers (``kind``) are never white space."""
    return c["value"].isNull() | c["value"].rlike(r"(?U)^\s*$") if kind == "string" else c["value"].isNull()


def filled(row: Column) -> Column:
    """Whether a row of the scoreboard has any value."""
    return F.coalesce(F.greatest(*(~blank(row[c], kind) for c, kind in D.CELLS.items())), F.lit(False))


def told(cells: Column, kinds: dict[str, str]) -> dict[str, Column]:
    """The fields whose values a template read as bits in the order of ``kinds``, and the confidences of all if there are any: no lambdas, which Spark doesn't compile."""
    bits = F.lit(0)
    for k, (c, kind) in enumerate(kinds.items()):
        bits = bits + F.when(~blank(cells[c], kind) & (cells[c]["source"] == "template"), 1 << k).otherwise(0)
    return {"told": bits, "sure": F.when(bits != 0, F.array(*(cells[c]["confidence"] for c in kinds)))}


def season_of(rows: DataFrame, seasons: DataFrame, key: str = "id", played_at: str = "played_at") -> DataFrame:
    """(key, season_id) for the rows whose day of ``played_at`` lies in a season; the one of least id where seasons overlap."""
    s = seasons.select(F.col("id").alias("season_id"), "starts_on", F.coalesce("ends_on", F.lit("9999-12-31")).alias("_to"))
    day = rows.select(key, F.substring(played_at, 1, 10).alias("_day")).dropna()
    return day.join(broadcast_if_small(s, SMALL), F.col("_day").between(F.col("starts_on"), F.col("_to"))).groupBy(key).agg(F.min("season_id").alias("season_id"))


def numbered(rows: DataFrame, keys: list[str], held: DataFrame, out: str = "id") -> DataFrame:
    """Adds ids above all in ``held.id``, in the order of ``keys``, which are unique."""
    last = held.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last"))  # one row
    ranked = global_rank(rows.withColumn("_one", F.lit(1)), keys, "_one", "_number").drop("_one")
    return ranked.join(F.broadcast(last)).withColumn(out, F.col("_last") + F.col("_number") + 1).drop("_last", "_number")


def numbered_within(rows: DataFrame, key: str, order: str, held: DataFrame, out: str = "id") -> DataFrame:
    """``numbered`` by ``key`` and ``order``, where one key has few rows: only the keys are ranked over all, so ``rows`` aren't dealt by ranges."""
    last = held.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last"))  # one row
    before = global_rank(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), [key], "_n", "_before").drop("_n")
    ranked = rows.withColumn("_number", F.row_number().over(W.partitionBy(key).orderBy(order))).join(before, key)
    return ranked.join(F.broadcast(last)).withColumn(out, F.col("_last") + F.col("_before") + F.col("_number")).drop("_last", "_before", "_number")


def problems(docs: D.Documents, rows: DataFrame, counts: DataFrame, t: Store) -> DataFrame:
    """(draft_id, problem): why an open draft can't be committed; ``rows`` are those with content, ``counts`` their numbers by draft."""
    own = counts.select("draft_id", "rows", "own")
    open_ = docs.conflicts.groupBy("draft_id").agg(F.count(F.lit(1)).alias("conflicts"))
    held = t.matches.select(F.col("id").alias("editing_match_id"), F.lit(True).alias("_held"))
    turn = F.when(F.col("editing_match_id").isNotNull(), F.row_number().over(W.partitionBy("editing_match_id").orderBy("draft_id")))
    edits = docs.meta.filter("editing_match_id IS NOT NULL").select("draft_id", "editing_match_id", turn.alias("_turn")).join(held, "editing_match_id", "left")
    facts = docs.meta.join(own, "draft_id", "left").join(open_, "draft_id", "left").join(edits.select("draft_id", "_turn", "_held"), "draft_id", "left").fillna(0, ["rows", "own", "conflicts"])
    result = F.col("result")
    rules = [
        (F.coalesce(blank(result), F.lit(True)), "no result"),
        (~blank(result) & ~result["value"].isin("win", "loss", "draw"), "unknown result"),
        (F.col("conflicts") > 0, "open conflicts"),
        ((F.col("rows") > 0) & (F.col("own") == 0), "no own row"),
        (F.col("own") > 1, "several own rows"),
        (F.col("editing_match_id").isNotNull() & F.col("_held").isNull(), "match is gone"),
        (F.col("_turn") > 1, "edited by an earlier draft"),
    ]
    found = facts.select("draft_id", F.explode(F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))).alias("problem"))
    parts = [found, docs.rejects.select("draft_id", F.col("reason").alias("problem"))]
    for table, column in ((t.players, "player_id"), (t.heroes, "hero_id")):  # what rows refer to
        asked = rows.select("draft_id", (F.col(column) if column == "player_id" else F.col(column)["value"]).alias("id")).dropna()
        parts.append(asked.join(broadcast_if_small(table.select("id"), SMALL), "id", "left_anti").select("draft_id", F.lit(f"unknown {column[:-3]}").alias("problem")).distinct())
    maps = docs.meta.select("draft_id", F.col("map_id")["value"].alias("id")).dropna()
    parts.append(maps.join(t.maps.select("id"), "id", "left_anti").select("draft_id", F.lit("unknown map").alias("problem")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@dataclass
class Commit:
    tables: dict[str, DataFrame]  #: every table that a commit changes, as it is afterwards
    refused: DataFrame  #: draft_id, problem
    moves: DataFrame | None  #: match_id, path, target: files to move to their match's folder; their rows name the target


def commit(t: Store, now: str, ids: Sequence[int] | None = None, only: Sequence[str] | None = None) -> Commit:
    """All open drafts of ``t`` (or those of ``ids``) that have no problem become matches, in the order of their ids.

    A draft that edits a match replaces its fields, roster, bans and provenance under the same id, and gives back the games that the
    old roster counted.  A row's player is the one of its id, else of its exact trimmed name, else new.  Rows without content
    are no players.  With ``only`` (names of tables, ``refused`` or ``moves``) the tables not named may be missing, and the work that they alone need is left out.
    Committed drafts are never committed again.  A portrait that another hero holds is not learned.  Read the results inside the run (``scratch``) that calls this.
    """
    wants = lambda *names: only is None or not set(names).isdisjoint(only)
    drafts = t.drafts.filter("status = 'open'")
    trace = wants("field_provenance")
    passed = ["player_id", *(["nameplate_phash", "nameplate_width"] if wants("player_nameplates") else []), *(["portrait_phash"] if wants("hero_portraits") else [])]
    # what each table takes of a row besides ids
    taken = {"match_players": ["team", "row_index", "is_me", *D.CELLS], "players": [], "player_nameplates": ["nameplate_phash", "nameplate_width"], "hero_portraits": ["hero_id", "portrait_phash"]}
    cells = D.CELLS if wants("match_players") else ["player_name", "hero_id"] if wants(*taken) else ["hero_id"]
    docs = D.parse(
        drafts if ids is None else drafts.filter(F.col("id").isin(list(ids))), parts=["value"], passed=passed, cells=list(cells), read=["value", "source"] if trace else ["value"],
        of_meta={k: lambda m, k=k: told(m, D.META)[k] for k in ("told", "sure") if trace}, of_row={"filled": filled} | {f"row_{k}": lambda r, k=k: told(r, D.CELLS)[k] for k in ("told", "sure") if trace},
    )
    rows = docs.rows.filter("is_me OR filled")
    side = lambda name: F.count_if(F.col("team") == name)
    counts = rows.groupBy("draft_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_me").alias("own"), F.greatest(side("ally"), side("enemy")).alias("_seats"), *([F.sum(F.bit_count("row_told")).alias("_told")] if trace else []))
    counts = materialize(counts, "rows-of-drafts")
    refused = materialize(problems(docs, rows, counts, t), "refused")
    if not wants(*(name for name in (*SCHEMAS, "moves"))):
        return Commit({}, refused, None)

    # ids of matches, rows and provenance go up with the drafts': one pass over narrow rows tells what all before a draft have taken
    good = docs.meta.select("draft_id", "editing_match_id", F.bit_count("told").alias("_meta_told") if trace else F.lit(0).alias("_meta_told")).join(refused.select("draft_id").distinct(), "draft_id", "left_anti").join(counts, "draft_id", "left")
    good = good.select("draft_id", "_seats", F.when(F.col("editing_match_id").isNull(), 1).otherwise(0).alias("_fresh"), F.coalesce("rows", F.lit(0)).alias("_rows"), *([(F.col("_meta_told") + F.coalesce("_told", F.lit(0))).alias("_cells")] if trace else []))
    good = global_ranks(good, ["draft_id"], {"_fresh": "_matches_before", "_rows": "_rows_before"} | ({"_cells": "_cells_before"} if trace else {}))
    last = lambda held, name: F.broadcast(held.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias(name)))  # noqa: E731  one row
    good = good.join(last(t.matches, "_last")).withColumn("_new", F.col("_last") + F.col("_matches_before") + 1).drop("_last", "_matches_before", "_fresh", "_rows", "_cells")
    ok = materialize(docs.meta.join(good, "draft_id").withColumn("match_id", F.coalesce("editing_match_id", "_new")).drop("_new"), "committed-drafts")
    edited = ok.filter("editing_match_id IS NOT NULL").select("match_id")

    # players: names are looked up, as a name may be that of a third of all rows
    if wants(*taken):
        mine, new = resolved(rows, ok, t, dict.fromkeys(c for name, columns in taken.items() if wants(name) for c in columns))

    # matches
    value = lambda c: F.col(c)["value"]
    old = t.matches
    facts = ok.join(old.select(F.col("id").alias("match_id"), F.col("created_at").alias("_created")), "match_id", "left")
    facts = facts.select(
        F.col("match_id").alias("id"), F.coalesce(F.when(value("played_at") != "", value("played_at")), F.lit(now)).alias("played_at"), *(value(c).alias(c) for c in ("map_id", "mode", "result")),
        F.coalesce(F.nullif(value("team_size"), F.lit(0)), F.nullif(F.col("_seats"), F.lit(0))).cast("int").alias("team_size"), value("duration_seconds").cast("int").alias("duration_seconds"),
        *(value(c).alias(c) for c in ("rank_range_low", "rank_range_high", "notes")), F.coalesce("_created", F.lit(now)).alias("created_at"),
    )
    facts = facts.join(season_of(facts, t.seasons), "id", "left")
    left = lambda df, key="match_id": df.join(edited.withColumnRenamed("match_id", key), key, "left_anti")
    cols = lambda name: [c.strip().split(" ")[0] for c in SCHEMAS[name].split(",")]
    out = {"matches": left(old, "id").select(cols("matches")).unionByName(facts.select(cols("matches")))}

    # roster and bans
    if wants("match_players"):
        roster = mine.select("id", "match_id", "player_id", "team", "is_me", *(F.col(c)["value"].alias(c) for c in D.CELLS if c != "player_name"), F.col("row_index").cast("int").alias("row_index"))
        out["match_players"] = left(t.match_players).select(cols("match_players")).unionByName(roster.select(cols("match_players")))
    if wants("match_bans"):
        bans = docs.bans.filter("hero_id IS NOT NULL").join(ok.select("draft_id", "match_id"), "draft_id")
        bans = numbered_within(bans, "draft_id", "place", t.match_bans).withColumn("slot_index", F.col("slot_index").cast("int"))
        out["match_bans"] = left(t.match_bans).select(cols("match_bans")).unionByName(bans.select(cols("match_bans")))

    # stored counters: what the old rosters of edited matches counted is given back, but not below 0
    count = lambda df, name: df.dropna(subset=["player_id"]).groupBy("player_id").agg(F.count(F.lit(1)).alias(name))
    if wants("players"):
        born = new.select(F.col("_new").alias("id"), F.col("_name").alias("display_name"), F.lit(now).alias("first_seen"), F.lit(0).cast("long").alias("games_seen"))
        people = t.players.unionByName(born, allowMissingColumns=True).withColumnRenamed("id", "player_id")
        people = people.join(count(t.match_players.join(edited, "match_id", "left_semi"), "_back"), "player_id", "left").join(count(mine, "_more"), "player_id", "left")
        seen = F.greatest(F.lit(0), F.coalesce("games_seen", F.lit(0)) - F.coalesce("_back", F.lit(0))) + F.coalesce("_more", F.lit(0))
        people = people.withColumns({"games_seen": seen.cast("long"), "last_seen": F.when(F.col("_more").isNotNull(), F.lit(now)).otherwise(F.col("last_seen"))})
        out["players"] = people.withColumnRenamed("player_id", "id").select(cols("players"))

    # provenance of what a template read, the match's own fields and its rows'; of the values that a path replaced the last counts
    if wants("field_provenance"):
        traced = provenance(docs, rows, ok, t.match_players).join(last(t.field_provenance, "_last")).withColumn("id", F.col("_last") + F.col("_number"))
        gone = edited.select(F.lit("matches").alias("table_name"), F.col("match_id").alias("row_id")).union(t.match_players.join(edited, "match_id", "left_semi").select(F.lit("match_players"), "id"))
        out["field_provenance"] = t.field_provenance.join(gone, ["table_name", "row_id"], "left_anti").select(cols("field_provenance")).unionByName(traced.select(cols("field_provenance")))

    # files
    files = docs.files.join(ok.select("draft_id", "match_id"), "draft_id")
    target = F.concat(F.lit("screenshots/"), F.col("match_id").cast("string"), F.lit("/"), F.element_at(F.split("path", "/"), -1))
    files = files.select("draft_id", "place", "match_id", "path", target.alias("file_path"), F.col("sha256").alias("file_sha256"), "kind", F.coalesce("ingested_at", F.lit(now)).alias("ingested_at"))
    if wants("match_sources"):
        out["match_sources"] = t.match_sources.select(cols("match_sources")).unionByName(numbered_within(files, "draft_id", "place", t.match_sources).select(cols("match_sources")))

    # what nameplates and portraits teach
    if wants("player_nameplates"):
        plates = mine.dropna(subset=["player_id", "nameplate_phash"]).groupBy("player_id", F.col("nameplate_phash").alias("phash")).agg(F.count(F.lit(1)).alias("_more"), F.min_by("nameplate_width", "id").cast("int").alias("width_px"))
        out["player_nameplates"] = learned(t.player_nameplates, plates, "player_id", now).select(cols("player_nameplates"))
    if wants("hero_portraits"):
        faces = mine.select("id", F.col("hero_id")["value"].alias("hero_id"), F.col("portrait_phash").alias("phash")).dropna()
        faces = faces.groupBy("hero_id", "phash").agg(F.count(F.lit(1)).alias("_more"), F.min("id").alias("_id"))
        owner = faces.groupBy("phash").agg(F.min_by("hero_id", "_id").alias("_first")).join(t.hero_portraits.groupBy("phash").agg(F.min("hero_id").alias("_held")), "phash", "left")
        faces = faces.join(owner.select("phash", F.coalesce("_held", "_first").alias("hero_id")), ["phash", "hero_id"]).drop("_id")
        out["hero_portraits"] = learned(t.hero_portraits, faces, "hero_id", now).select(cols("hero_portraits"))

    done = t.drafts.join(ok.select(F.col("draft_id").alias("id"), "match_id"), "id", "left")
    done = done.withColumns({"status": F.when(F.col("match_id").isNotNull(), "committed").otherwise(F.col("status")), "updated_at": F.when(F.col("match_id").isNotNull(), now).otherwise(F.col("updated_at")), "committed_match_id": F.coalesce("match_id", "committed_match_id")})
    out["drafts"] = done.select(cols("drafts"))
    return Commit(out, refused, files.select("match_id", "path", F.col("file_path").alias("target")))


def resolved(rows: DataFrame, ok: DataFrame, t: Store, columns: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the drafts ``ok``, of which ``columns`` are kept, with ``id``, ``match_id`` and their players' ids; and the new players, ``_name`` and ``_new``.

    Ids and names are found on narrow rows; what is kept is dealt and written once.
    """
    name = F.when(~blank(F.col("player_name")) & F.col("player_id").isNull(), F.regexp_replace(F.col("player_name")["value"], r"(?U)^\s+|\s+$", ""))
    last = t.match_players.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last"))  # one row
    keys = rows.select("draft_id", "place", name.alias("_name")).join(ok.select("draft_id", "match_id", "_rows_before"), "draft_id").join(F.broadcast(last))
    number = F.row_number().over(W.partitionBy("draft_id").orderBy("place"))
    keys = materialize(keys.select("draft_id", "place", "match_id", "_name", (F.col("_last") + F.col("_rows_before") + number).alias("id")), "committed-rows")
    known = t.players.groupBy(F.col("display_name").alias("_name")).agg(F.min("id").alias("_known"))
    named = materialize(lookup(keys.filter("_name IS NOT NULL").select("id", "draft_id", "place", "_name"), known, ["_name"], "left", stored=True), "named-rows")
    new = named.filter("_known IS NULL").groupBy("_name").agg(F.min("id").alias("_first"))
    new = materialize(numbered(new, ["_first"], t.players, "_new").select("_name", "_new"), "new-players")
    who = lookup(named, new, ["_name"], "left", stored=True).select("draft_id", "place", F.coalesce("_known", "_new").alias("_who"))
    mine = rows.select("draft_id", "place", "player_id", *columns).join(keys.select("draft_id", "place", "id", "match_id"), ["draft_id", "place"]).join(who, ["draft_id", "place"], "left")
    return materialize(mine.withColumn("player_id", F.coalesce("player_id", "_who")).drop("_who"), "resolved-rows"), new


def provenance(docs: D.Documents, rows: DataFrame, ok: DataFrame, held: DataFrame) -> DataFrame:
    """(_number, table_name, row_id, column_name, confidence, source, superseded_value): what a template read in the drafts ``ok``, numbered by draft and path.

    ``held`` are the match's rows so far, above whose ids those of ``rows`` are.  A draft's cells are put together in one line, as its document was, so rows
    and replaced values are dealt once, by draft; of the values that a path replaced the last counts.
    """
    last = F.broadcast(held.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_last")))  # one row
    seats = rows.select("draft_id", F.struct("place", "team", "row_index", "row_told", "row_sure").alias("_row")).groupBy("draft_id").agg(F.array_sort(F.collect_list("_row")).alias("_roster"))
    lost = docs.superseded.filter("path IS NOT NULL").groupBy("draft_id", "path").agg(F.max_by("value", "place").alias("value"))
    lost = lost.groupBy("draft_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("_lost"))
    whole = ok.select("draft_id", "match_id", "told", "sure", "_rows_before", "_cells_before").join(seats, "draft_id", "left").join(lost, "draft_id", "left").join(last)

    def cells(table: str, kinds: dict[str, str], bits: Column, sure: Column, row: Column, path: Column) -> Column:
        one = lambda c, k: F.when(F.getbit(bits, k) == 1, F.struct(F.concat(path, c).alias("path"), F.lit(table).alias("table_name"), row.alias("row_id"), c.alias("column_name"), F.get(sure, k).alias("confidence")))
        return F.when(bits != 0, F.array_compact(F.transform(F.array(*map(F.lit, kinds)), one))).otherwise(F.array())

    own = cells("matches", D.META, F.col("told"), F.col("sure"), F.col("match_id"), F.lit("meta."))
    seat = lambda r: F.concat(F.lit("rows["), r["team"], F.lit(":"), r["row_index"].cast("string"), F.lit("]."))
    of_rows = F.transform("_roster", lambda r, i: cells("match_players", D.CELLS, r["row_told"], r["row_sure"], F.col("_last") + F.col("_rows_before") + i + 1, seat(r)))
    cells_of = F.array_sort(F.concat(own, F.coalesce(F.flatten(of_rows), F.array())))
    out = whole.select("_cells_before", "_lost", F.posexplode(cells_of).alias("_at", "x"))
    return out.select((F.col("_cells_before") + F.col("_at") + 1).alias("_number"), *(f"x.{c}" for c in ("table_name", "row_id", "column_name", "confidence")), F.lit("template").alias("source"), F.col("_lost")[F.col("x.path")].alias("superseded_value"))


def learned(held: DataFrame, new: DataFrame, owner: str, now: str) -> DataFrame:
    """``held`` with the counts of ``new`` (owner, phash, _more, ...) added, and a row for what it lacks."""
    both = held.join(new.select(owner, "phash", "_more"), [owner, "phash"], "left").withColumn("times_matched", F.col("times_matched") + F.coalesce("_more", F.lit(0))).drop("_more")
    more = new.join(held.select(owner, "phash"), [owner, "phash"], "left_anti").withColumnRenamed("_more", "times_matched").withColumn("first_seen", F.lit(now))
    return both.unionByName(numbered(more, [owner, "phash"], held), allowMissingColumns=True)


def reopen(t: Store, ids: Sequence[int], now: str) -> DataFrame:
    """The drafts after matches ``ids`` have been opened for editing: a match that an open draft edits already keeps that one, unknown ones are left out.

    A new draft has every seat of the larger team on both sides, the match's fields and rows as manual cells, names in place of player ids
    (so that a name typed anew finds its player), and the bans in order; files stay with the match.
    """
    open_ = D.parse(t.drafts.filter("status = 'open'")).meta.select("editing_match_id").dropna()
    asked = F.col("match_id").isin(list(ids))
    m = t.matches.filter(F.col("id").isin(list(ids))).join(open_, F.col("id") == F.col("editing_match_id"), "left_anti")
    m = materialize(numbered(m.withColumnRenamed("id", "match_id"), ["match_id"], t.drafts, "draft_id"), "reopened")
    keys = m.select("draft_id", "match_id")
    p = t.match_players.filter(asked).join(keys, "match_id")
    seats = p.groupBy("draft_id").agg(F.greatest(F.count_if(F.col("team") == "ally"), F.count_if(F.col("team") == "enemy")).alias("_n"))
    size = m.join(seats, "draft_id", "left").select("draft_id", F.coalesce(F.nullif(F.col("team_size").cast("long"), F.lit(0)), F.nullif("_n", F.lit(0)), F.lit(6)).alias("_n"))
    meta = m.select("draft_id", F.col("match_id").alias("editing_match_id"), *(D.manual(F.col(c).cast(kind)).alias(c) for c, kind in D.META.items()))
    spots = size.select("draft_id", "_n", F.posexplode(F.sequence(F.lit(1), 2 * F.col("_n"))).alias("place", "_x"))
    spots = spots.select("draft_id", "place", F.when(F.col("place") < F.col("_n"), "ally").otherwise("enemy").alias("team"), (F.col("place") % F.col("_n")).alias("row_index"))
    names = t.players.select(F.col("id").alias("player_id"), F.col("display_name").alias("player_name"))
    filled = p.join(names, "player_id", "left").select("draft_id", "team", F.col("row_index").cast("long").alias("row_index"), "is_me", *D.CELLS)
    filled = filled.groupBy("draft_id", "team", "row_index").agg(F.max("is_me").alias("is_me"), *(F.first(c).alias(c) for c in D.CELLS))
    rows = spots.join(filled, ["draft_id", "team", "row_index"], "left").select(
        "draft_id", "place", "team", "row_index", F.coalesce("is_me", F.lit(False)).alias("is_me"), *(F.lit(None).cast(kind).alias(c) for c, kind in D.PASSED.items()), *(D.manual(F.col(c).cast(kind)).alias(c) for c, kind in D.CELLS.items()))
    bans = t.match_bans.filter(asked).join(keys, "match_id").select("draft_id", F.struct("slot_index", "id").alias("place"), "hero_id", F.col("slot_index").cast("long").alias("slot_index"))
    none = {k: t.spark.createDataFrame([], "draft_id long, place int, " + ", ".join(f"{c} {kind}" for c, kind in D.LISTS[k].items())) for k in ("files", "conflicts", "superseded")}
    made = D.build(D.Documents(meta=meta, rows=rows, bans=bans, rejects=none["files"], **none))
    new = made.select(F.col("draft_id").alias("id"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit("open").alias("status"), "payload", F.lit(None).cast("long").alias("committed_match_id"))
    return t.drafts.unionByName(new)


def commit_store(store: Store, now: str, ids: Sequence[int] | None = None) -> DataFrame:
    """Commits the open drafts of a store and publishes the tables together; returns the refused drafts.  Running it again changes nothing but what is open by then."""
    with scratch(store.spark):
        before = store.version()
        done = commit(store, now, ids)
        store.publish(done.tables, after=before)
        return materialize(done.refused, "refused", keep=True)


def reopen_store(store: Store, ids: Sequence[int], now: str) -> None:
    """Opens matches of a store for editing and publishes its drafts."""
    with scratch(store.spark):
        before = store.version()
        store.publish({"drafts": reopen(store, ids, now)}, after=before)
