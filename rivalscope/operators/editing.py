"""Rules for drafts, seasons, tags and notes, each a transform from tables to a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small
from ..sources.fixtures import Tables
from .merging import observations
from .subject import SMALL


def empty_drafts(t: Tables) -> DataFrame:
    """(match_id, team, row_index): the rows of a blank draft of each match's team size, six where it is unknown."""
    seats = F.sequence(F.lit(0), F.coalesce("team_size", F.lit(6)) - 1)
    some = t.matches.filter("team_size IS NULL OR team_size > 0")
    rows = some.select(F.col("id").alias("match_id"), F.explode(F.array(F.lit("ally"), F.lit("enemy"))).alias("team"), "team_size")
    return rows.select("match_id", "team", F.explode(seats).alias("row_index"))


def conflicts_resolved(t: Tables) -> DataFrame:
    """(draft, path, value, source): 'mine' drops the conflict and the value stays; 'theirs' writes the other value as read by a template.

    The first and the last value of a path are in conflict where they differ, and the number of its values decides.
    """
    cells = observations(t).filter("value IS NOT NULL")
    both = cells.groupBy("draft", "path").agg(F.min_by("value", "seq").alias("mine"), F.max_by("value", "seq").alias("theirs"), F.count(F.lit(1)).alias("n"))
    theirs = (F.col("mine") != F.col("theirs")) & (F.col("n") % 2 == 0)
    return both.select("draft", "path", F.when(theirs, F.col("theirs")).otherwise(F.col("mine")).alias("value"), F.when(theirs, "template").otherwise("kept").alias("source"))


def patched(t: Tables) -> DataFrame:
    """(draft, own_row, names): manual edits in order. The last mark of an own row clears all others; the last name typed in a row holds.

    Purchases mark a row, all other events type a name in one; the row is that of the value.
    """
    e = observations(t).filter("value IS NOT NULL").withColumn("row", F.col("value").cast("int") % 6)
    marks = e.filter("path = 'purchase'").groupBy("draft").agg(F.max_by("row", "seq").alias("own_row"))
    names = e.filter("path <> 'purchase'").groupBy("draft", "row").agg(F.max_by("path", "seq").alias("name"))
    return names.join(marks, "draft", "left").select("draft", "row", "name", F.coalesce(F.col("row") == F.col("own_row"), F.lit(False)).alias("is_me"))


def cleared(t: Tables) -> DataFrame:
    """Cells after what templates read is cleared; manual and default cells stay."""
    c = observations(t).withColumn("source", F.get(F.array(*map(F.lit, ("template", "manual", "default"))), (F.col("seq") % 3).cast("int")))
    return c.select("draft", "path", "seq", F.when(F.col("source") != "template", F.col("value")).alias("value"), "source")


def stamped(t: Tables) -> DataFrame:
    """Template cells without an origin get that of their file's kind."""
    c = observations(t).withColumns({"template": F.col("seq") % 3 == 0, "origin": F.when(F.col("seq") % 2 == 0, F.col("origin"))})
    kind = F.when(F.col("seq") % 5 == 0, "in_game_scoreboard").otherwise("endgame_report")
    stamp = F.col("template") & (F.coalesce("origin", F.lit("")) == "")
    return c.select("draft", "path", "seq", F.when(stamp, kind).otherwise(F.col("origin")).alias("origin"))


def fragments_ok(t: Tables) -> DataFrame:
    """Whether any cell of a draft's path has a value."""
    full = F.coalesce(F.trim("value") != "", F.lit(False))
    return observations(t).groupBy("draft", "path").agg(F.max(full).alias("ok"))


def abandoned(t: Tables) -> DataFrame:
    """Status of each draft after its user gave it up: only open ones change. A draft is committed once it has a manual value."""
    manual = F.max((F.col("origin") == "manual") & F.col("value").isNotNull())
    status = observations(t).groupBy("draft").agg(F.when(manual, "committed").otherwise("open").alias("status"))
    return status.withColumn("after", F.when(F.col("status") == "open", "abandoned").otherwise(F.col("status")))


def new_attachments(t: Tables) -> DataFrame:
    """(source, sha256, doc_id): the files of a draft, each content once, the first of equal ones."""
    f = t.raw("documents").select("source", F.sha2("text", 256).alias("sha256"), "doc_id")
    return f.groupBy("source", "sha256").agg(F.min("doc_id").alias("doc_id"))


def attached(t: Tables, prefix: str) -> DataFrame:
    """Files whose hash starts with the given digits."""
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("sha256")).filter(F.col("sha256").startswith(prefix))


def without_crops(t: Tables) -> DataFrame:
    """Drafts' hashes after one file of each is removed: those cut from it are nulled, found by the first eight digits in the crop's name."""
    c = t.raw("documents").select("doc_id", "source", F.substring(F.sha2("text", 256), 1, 8).alias("marker"))
    gone = c.groupBy("source").agg(F.min("marker").alias("gone"))
    return c.join(gone, "source").select("doc_id", F.when(F.col("marker") != F.col("gone"), F.col("marker")).alias("marker"))


def open_drafts(t: Tables) -> DataFrame:
    """Open drafts that edit a match, by the payload's own field, the latest first: events whose payload's k is even."""
    e = t.raw("events").select("event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("editing"))
    return e.filter("editing IS NOT NULL AND editing % 2 = 0").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "editing")


# ------------------------------------------------------------------ seasons


def season_problems(t: Tables, p: DataFrame) -> DataFrame:
    """(id, problem) of proposed seasons ``p`` (id, name, starts_on, ends_on): what creating each of them beside ``t.seasons`` would be refused for."""
    is_day = lambda c: F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
    wrong = F.array_compact(F.array(
        F.when(F.trim("name") == "", "no name"), F.when(~is_day("starts_on"), "no start"),
        F.when(F.col("ends_on").isNotNull() & is_day("starts_on") & (F.col("ends_on") < F.col("starts_on")), "ends before it starts"),
    ))
    own = p.select("id", F.explode(wrong).alias("problem"))
    sound = p.join(own.select("id").distinct(), "id", "left_anti")
    held = t.seasons.select(F.col("name").alias("season"), F.col("starts_on").alias("a"), F.coalesce("ends_on", F.lit("9999-12-31")).alias("b"))
    clash = sound.join(broadcast_if_small(held, SMALL), (F.col("starts_on") <= F.col("b")) & (F.col("a") <= F.coalesce("ends_on", F.lit("9999-12-31"))))
    return own.union(clash.select("id", F.concat(F.lit("overlaps "), "season")))


def season_overlaps(p: DataFrame) -> DataFrame:
    """(a, b): pairs of seasons with a common day, each pair once; no end means forever.

    Seasons meet by the years that they share, so nothing is held against everything else.
    """
    p = p.filter("starts_on <> 'soon' AND (ends_on IS NULL OR ends_on >= starts_on)").select("id", "starts_on", F.coalesce("ends_on", F.lit("9999-12-31")).alias("end"))
    last = p.agg(F.max(F.substring("starts_on", 1, 4).cast("int")).alias("last"))  # one row: no later year has a start
    years = F.sequence(F.substring("starts_on", 1, 4).cast("int"), F.least(F.substring("end", 1, 4).cast("int"), F.col("last")))
    y = p.join(F.broadcast(last)).select("id", "starts_on", "end", F.explode(years).alias("year"))
    a, b = y.toDF("a", "a_from", "a_to", "year"), y.toDF("b", "b_from", "b_to", "year")
    return a.join(b, "year").filter("a < b AND a_from <= b_to AND b_from <= a_to").select("a", "b").distinct()


def season_deleted(t: Tables, gone: int) -> DataFrame:
    """(id, season_id) of all matches after a season is deleted: its matches have none."""
    return t.matches.select("id", F.when(F.col("season_id") != gone, F.col("season_id")).alias("season_id"))


# ------------------------------------------------------------------ tags and notes


def tags_replaced(t: Tables, ask: DataFrame) -> DataFrame:
    """(player_id, tag_code) after players got new sets (``ask``: player_id, codes), in which a code may be named twice; a code that ``t.tags`` lacks refuses its whole set."""
    each = ask.select("player_id", F.explode("codes").alias("code"))
    wrong = each.join(broadcast_if_small(t.tags.select("code"), SMALL), "code", "left_anti").select("player_id").distinct()
    good = ask.join(wrong, "player_id", "left_anti")
    stay = t.player_tags.select("player_id", "tag_code").join(good.select("player_id"), "player_id", "left_anti")
    return stay.union(good.select("player_id", F.explode(F.array_distinct("codes"))))


def notes_edited(t: Tables) -> DataFrame:
    """Players' notes after an edit: trimmed, blank becomes none, and those without an edit keep theirs."""
    k = F.col("s_suppkey")
    s = t.raw("supplier").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("old "), k.cast("string"))).alias("old"), F.when(k % 4 == 0, F.concat(F.lit("  new "), "s_name")).when(k % 4 == 1, "   ").alias("new"))
    return s.select("id", F.when(F.col("new").isNull(), F.col("old")).otherwise(F.nullif(F.trim("new"), F.lit(""))).alias("notes"))


# ------------------------------------------------------------------ scalar rules


def safe_stem(name: Column) -> Column:
    """At most forty characters of a file's name: spaces become underscores, only letters, digits, - and _ stay, 'shot' if nothing does."""
    kept = F.regexp_replace(F.replace(F.substring(name, 1, 40), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_\-]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("shot"))


def grouped(n: Column) -> tuple[Column, Column]:
    """A whole number with commas by thousands, and how many commas it must have."""
    return F.format_number(n, 0), F.floor((F.length(F.abs(n).cast("string")) - 1) / 3).cast("long")


def clock(seconds: Column) -> Column:
    """m:ss"""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def seconds_of(text: Column) -> Column:
    parts = F.split(text, ":")
    return F.when(text.rlike(r"^\d+:[0-5]\d$"), F.get(parts, F.lit(0)).cast("long") * 60 + F.get(parts, F.lit(1)).cast("long"))


def portable(path: Column) -> Column:
    """A path below the data folder with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^.*?/?data/", "data/")
