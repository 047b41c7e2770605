"""Queries of draft documents and of commits as a whole, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import publishing as P
from ..shared import scratch, stored
from ..sources import documents as D
from ..sources.drafts import DraftStore
from ..sources.fixtures import Tables
from .drafts import BLANK, DRAFTS, FIELDS
from .oracle import BASE, ME

NOW = "2024-01-01T00:00"
BROKEN = "draft_id % 13 = 0 OR draft_id % 17 = 0"


def after(table: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """One table as it is after the fixture's open drafts have been committed together."""

    @stored
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = P.commit(DraftStore(Tables(spark, sf_dir), written=True), NOW, only=[table])
        return (done.refused if table == "refused" else done.moves if table == "moves" else done.tables[table]).select(*columns)

    return run


def documents(f: Callable[[D.Documents], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark):
            return f(D.parse(DraftStore(Tables(spark, sf_dir)).drafts, keep=True))

    return run


def again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the documents that were taken apart, put together and taken apart again."""
    with scratch(spark):
        built = D.build(D.parse(DraftStore(Tables(spark, sf_dir)).drafts))
        return D.cells(D.parse(built.select(F.col("draft_id").alias("id"), "payload"), keep=True)).select("draft_id", "path", "value", "source", "confidence")


@stored
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table after the commit."""
    out = None
    for name, df in P.commit(DraftStore(Tables(spark, sf_dir), written=True), NOW).tables.items():
        n = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.union(n)
    return out


@stored
def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the documents of the first fifty matches without an open draft, opened again."""
    t = DraftStore(Tables(spark, sf_dir))
    ids = [r["id"] for r in t.matches.orderBy("id").limit(50).collect()]
    new = P.reopen(t, ids, NOW).filter(F.col("created_at") == NOW)
    docs = D.parse(new)
    return D.cells(docs).join(docs.meta.select("draft_id", F.col("editing_match_id").alias("match_id")), "draft_id").select("match_id", "path", "value")


BUILD = {
    "draft_documents": documents(lambda d: D.cells(d).select("draft_id", "path", "value", "source", "confidence")),
    "draft_documents_again": again,
    "draft_rejects": documents(lambda d: d.rejects.select("draft_id", F.split("reason", ":")[0].alias("reason"))),
    "draft_lists": documents(lambda d: d.bans.select("draft_id", F.lit("ban").alias("list"), F.col("hero_id").cast("string").alias("value")).union(d.files.select("draft_id", F.lit("file"), "path")).union(d.superseded.select("draft_id", F.lit("superseded"), "path")).union(d.conflicts.select("draft_id", F.lit("conflict"), "path"))),
    "whole_commit_refused": after("refused", "draft_id", "problem"),
    "whole_commit_players": after("players", "id", "display_name", "games_seen", "first_seen", "last_seen"),
    "whole_commit_provenance": after("field_provenance", "table_name", "column_name", "confidence", "superseded_value"),
    "whole_commit_sources": after("match_sources", "match_id", "file_path", "ingested_at"),
    "whole_commit_roster": after("match_players", "match_id", "player_id", "team", "row_index", "is_me", "hero_id", "damage"),
    "whole_commit_drafts": after("drafts", "id", "status", "committed_match_id"),
    "whole_commit_sizes": sizes,
    "reopened_cells": reopened,
}
#: As in the other queries of drafts, but for the documents that can't be read.
OK = DRAFTS.replace("FROM matches WHERE id % 4 = 0\n", "FROM matches WHERE id % 4 = 0 AND id % 13 <> 0 AND (id % 17 <> 0 OR id NOT IN (SELECT match_id FROM match_players WHERE id % 17 <> 0 AND deaths IS NOT NULL))\n").replace(
    "WHERE p.match_id % 4 = 0\n), pop", "WHERE p.match_id IN (SELECT draft_id FROM dm)\n), pop"
)
SEAT = "'rows[' || team || ':' || row_index || '].'"
CELLS = " UNION ALL ".join(f"SELECT draft_id, {SEAT} || '{c}', CAST({c} AS VARCHAR), source, 0.8 FROM dr WHERE NOT {BLANK.format(c)}" for c in FIELDS)
META = " UNION ALL ".join(f"SELECT draft_id, 'meta.{c}' AS path, CAST({c} AS VARCHAR) AS value, CASE WHEN draft_id % 3 = 0 THEN 'template' ELSE 'manual' END AS source, 0.9 AS confidence FROM dm WHERE NOT {BLANK.format(c)}" for c in ("played_at", "map_id", "mode", "result", "team_size"))
ALL_CELLS = f"SELECT draft_id, path, value, source, CAST(confidence AS DOUBLE) AS confidence FROM ({META} UNION ALL {CELLS})"
TRACED = f""", gone AS (SELECT editing_match_id AS id FROM ok WHERE editing_match_id IS NOT NULL),
 trace AS (
  SELECT 'matches' AS table_name, 'mode' AS column_name, NULL AS confidence, NULL AS superseded_value FROM om WHERE id % 5 = 0 AND id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'match_players', 'role', NULL, NULL FROM orow WHERE id % 9 = 0 AND match_id NOT IN (SELECT id FROM gone)
  UNION ALL {" UNION ALL ".join(f"SELECT 'matches', '{c}', 0.9, NULL FROM ok WHERE draft_id % 3 = 0 AND NOT {BLANK.format(c)}" for c in ("played_at", "map_id", "mode", "result", "team_size"))}
  UNION ALL {" UNION ALL ".join(f"SELECT 'match_players', '{c}', 0.8, {'superseded' if c == 'damage' else 'NULL'} FROM res WHERE source = 'template' AND NOT {BLANK.format(c)}" for c in FIELDS)}
 ) """
FILES = """, f AS (SELECT id AS match_id, 'screenshots/' || id || '/old.png' AS file_path, NULL AS ingested_at FROM om WHERE id % 16 = 0 UNION ALL SELECT match_id, 'screenshots/' || match_id || '/shot.png', '2024-01-01T00:00' FROM ok WHERE draft_id % 3 = 0) """
PEOPLE = """, back AS (SELECT player_id, count(*) AS n FROM orow WHERE match_id IN (SELECT editing_match_id FROM ok) GROUP BY 1), more AS (SELECT player_id, count(*) AS m FROM res WHERE player_id IS NOT NULL GROUP BY 1),
 held AS (SELECT id, display_name, id % 40 AS games_seen, NULL AS first_seen FROM players UNION ALL SELECT new_id, name, 0, '2024-01-01T00:00' FROM fresh) """
SQL = {
    "draft_documents": OK + ALL_CELLS,
    "draft_documents_again": OK + ALL_CELLS,
    "draft_rejects": ", bad AS (SELECT id AS draft_id, id % 13 = 0 AS cut FROM matches WHERE id % 4 = 0) SELECT draft_id, CASE WHEN cut THEN 'not a JSON object of this shape' ELSE 'not a number' END AS reason FROM bad WHERE cut OR (draft_id % 17 = 0 AND draft_id IN (SELECT match_id FROM match_players WHERE id % 17 <> 0 AND deaths IS NOT NULL))",
    "draft_lists": OK + f"""SELECT b.match_id AS draft_id, 'ban' AS list, CAST(hero_id AS VARCHAR) AS value FROM match_bans b JOIN dm ON dm.draft_id = b.match_id UNION ALL SELECT draft_id, 'file', 'drafts/' || draft_id || '/shot.png' FROM dm WHERE draft_id % 3 = 0
      UNION ALL SELECT draft_id, 'superseded', {SEAT} || 'damage' FROM dr WHERE superseded IS NOT NULL UNION ALL SELECT draft_id, 'conflict', 'meta.mode' FROM dm WHERE conflict""",
    "whole_commit_refused": OK + """SELECT * FROM problems UNION ALL SELECT id, CASE WHEN id % 13 = 0 THEN 'not a JSON object of this shape' ELSE 'not a number: deaths' END FROM matches WHERE id % 4 = 0 AND id NOT IN (SELECT draft_id FROM dm)""",
    "whole_commit_players": OK + PEOPLE + "SELECT id, display_name, CAST(greatest(0, games_seen - coalesce(n, 0)) + coalesce(m, 0) AS BIGINT) AS games_seen, first_seen, CASE WHEN m IS NOT NULL THEN '2024-01-01T00:00' END AS last_seen FROM held LEFT JOIN back ON back.player_id = id LEFT JOIN more ON more.player_id = id",
    "whole_commit_provenance": OK + TRACED + "SELECT table_name, column_name, CAST(confidence AS DOUBLE) AS confidence, superseded_value FROM trace",
    "whole_commit_sources": OK + FILES + "SELECT * FROM f",
    "whole_commit_roster": OK + """SELECT match_id, player_id, team, row_index, is_me, hero_id, damage FROM orow WHERE match_id NOT IN (SELECT editing_match_id FROM ok WHERE editing_match_id IS NOT NULL) UNION ALL SELECT match_id, player_id, team, row_index, is_me, hero_id, damage FROM res""",
    "whole_commit_drafts": OK + "SELECT id, CASE WHEN ok.match_id IS NULL THEN 'open' ELSE 'committed' END AS status, ok.match_id AS committed_match_id FROM matches LEFT JOIN ok ON ok.draft_id = id WHERE id % 4 = 0",
    "reopened_cells": """, m AS (SELECT * FROM (SELECT * FROM matches WHERE id % 4 <> 0 OR id % 8 = 0 ORDER BY id LIMIT 50) WHERE id NOT IN (SELECT id FROM matches WHERE id % 8 = 0 AND id % 13 <> 0 AND (id % 17 <> 0 OR id NOT IN (SELECT match_id FROM match_players WHERE id % 17 <> 0 AND deaths IS NOT NULL)))),
      p AS (SELECT match_players.*, display_name AS player_name FROM match_players LEFT JOIN players ON players.id = player_id WHERE match_id IN (SELECT id FROM m)),
      n AS (SELECT m.id, coalesce(nullif(team_size, 0), nullif((SELECT greatest(count(*) FILTER (team = 'ally'), count(*) FILTER (team = 'enemy')) FROM p WHERE p.match_id = m.id), 0), 6) AS seats FROM m), """
    + "c AS (" + " UNION ALL ".join(f"SELECT id AS match_id, 'meta.{c}' AS path, CAST({e} AS VARCHAR) AS value FROM m" for c, e in [*((c, c) for c in ("played_at", "map_id", "mode", "result", "team_size", "rank_range_low", "rank_range_high")), ("duration_seconds", "300 + id % 1200")])
    + " UNION ALL " + " UNION ALL ".join(f"SELECT match_id, {SEAT} || '{c}', CAST({c} AS VARCHAR) FROM p JOIN n ON n.id = match_id AND row_index < seats" for c in FIELDS) + ") SELECT * FROM c WHERE value IS NOT NULL AND trim(value) <> ''",
}
SQL["whole_commit_sizes"] = OK + FILES + TRACED + """, base AS (SELECT hero_id, lower(lpad(to_hex(hero_id * 3 + id % 5), 16, '0')) AS phash FROM match_players WHERE match_id % 4 = 1 AND hero_id IS NOT NULL),
 held AS (SELECT min(hero_id) AS hero_id, phash FROM base GROUP BY 2), came AS (SELECT arg_min(hero_id, row_id) AS hero_id, portrait AS phash FROM res WHERE portrait IS NOT NULL AND hero_id IS NOT NULL GROUP BY 2),
 plates AS (SELECT player_id, lower(lpad(to_hex(player_id * 10 + id % 4), 16, '0')) AS phash FROM match_players WHERE match_id % 4 = 2 AND player_id IS NOT NULL UNION SELECT player_id, nameplate FROM res WHERE player_id IS NOT NULL AND nameplate IS NOT NULL)
 SELECT 'matches' AS table_name, (SELECT count(*) FROM om) + (SELECT count(*) FROM ok WHERE editing_match_id IS NULL) AS n
 UNION ALL SELECT 'match_players', (SELECT count(*) FROM orow WHERE match_id NOT IN (SELECT id FROM gone)) + (SELECT count(*) FROM res)
 UNION ALL SELECT 'match_bans', (SELECT count(*) FROM match_bans WHERE (match_id % 4 <> 0 OR match_id % 8 = 0) AND match_id NOT IN (SELECT id FROM gone)) + (SELECT count(*) FROM match_bans JOIN ok ON ok.draft_id = match_bans.match_id)
 UNION ALL SELECT 'players', (SELECT count(*) FROM players) + (SELECT count(*) FROM fresh) UNION ALL SELECT 'field_provenance', (SELECT count(*) FROM trace) UNION ALL SELECT 'match_sources', (SELECT count(*) FROM f)
 UNION ALL SELECT 'player_nameplates', (SELECT count(*) FROM plates) UNION ALL SELECT 'hero_portraits', (SELECT count(*) FROM held) + (SELECT count(*) FROM came WHERE phash NOT IN (SELECT phash FROM held))
 UNION ALL SELECT 'drafts', (SELECT count(*) FROM matches WHERE id % 4 = 0)"""  # fmt: skip


def queries() -> dict:
    return dict(BUILD)


def oracle_sql() -> dict[str, str]:
    return {name: BASE.format(subject=ME) + body for name, body in SQL.items()}
