"""Queries of committed drafts, and their SQL."""

from __future__ import annotations

from ..operators import committing as C
from ..sources.drafts import STATS, Drafts
from ..sources.fixtures import Tables
from .oracle import BASE, ME

FIELDS = ["player_name", "role", "hero_id", *STATS]
BLANK = "regexp_full_match(coalesce(CAST({} AS VARCHAR), ''), '\\s*')"
PHASH = "lower(lpad(to_hex({}), 16, '0'))"


def null_if_blank(c: str) -> str:
    return f"CASE WHEN p.id % 17 <> 0 THEN {c} END"


DRAFTS = f"""
, dm AS (
  SELECT id AS draft_id, CASE WHEN id % 8 = 0 THEN id END AS editing_match_id,
    CASE WHEN id % 28 = 0 THEN '  ' WHEN id % 36 = 0 THEN 'bad' ELSE result END AS result,
    played_at, map_id, mode, CASE WHEN id % 12 <> 0 THEN team_size END AS team_size, id % 20 = 0 AS conflict
  FROM matches WHERE id % 4 = 0
), dr AS (
  SELECT p.match_id AS draft_id, p.id AS row_id, team, row_index,
    CASE WHEN p.match_id % 44 = 0 THEN false WHEN p.match_id % 52 = 0 THEN row_index = 0 ELSE is_me END AS is_me,
    CASE WHEN p.id % 2 = 0 AND p.id % 5 <> 0 AND p.id % 17 <> 0 THEN player_id END AS player_id,
    {null_if_blank("CASE WHEN player_id IS NULL THEN '' WHEN p.id % 5 = 0 THEN '  New ' || player_id % 50 || ' ' WHEN p.id % 2 = 1 THEN display_name END")} AS player_name,
    {", ".join(f"{null_if_blank('p.' + c)} AS {c}" for c in FIELDS[1:])},
    CASE p.id % 3 WHEN 0 THEN 'template' WHEN 1 THEN 'manual' ELSE 'default' END AS source,
    CASE WHEN p.id % 7 = 0 THEN 'old' END AS superseded,
    CASE WHEN p.id % 3 <> 0 THEN {PHASH.format("player_id * 10 + p.id % 4")} END AS nameplate,
    {null_if_blank(PHASH.format("hero_id * 3 + p.id % 5"))} AS portrait
  FROM match_players p LEFT JOIN players ON players.id = p.player_id WHERE p.match_id % 4 = 0
), pop AS (
  SELECT * FROM dr WHERE is_me OR {" OR ".join("NOT " + BLANK.format(c) for c in FIELDS)}
), facts AS (
  SELECT dm.*, coalesce(n, 0) AS n, coalesce(own, 0) AS own
  FROM dm LEFT JOIN (SELECT draft_id, count(*) AS n, count(*) FILTER (is_me) AS own FROM pop GROUP BY 1) USING (draft_id)
), problems AS (
  SELECT draft_id, 'no result' AS problem FROM facts WHERE {BLANK.format("result")}
  UNION ALL SELECT draft_id, 'unknown result' FROM facts WHERE NOT {BLANK.format("result")} AND result NOT IN ('win', 'loss', 'draw')
  UNION ALL SELECT draft_id, 'open conflicts' FROM facts WHERE conflict
  UNION ALL SELECT draft_id, 'no own row' FROM facts WHERE n > 0 AND own = 0
  UNION ALL SELECT draft_id, 'several own rows' FROM facts WHERE own > 1
), good AS (SELECT * FROM dm WHERE draft_id NOT IN (SELECT draft_id FROM problems)),
om AS (SELECT * FROM matches WHERE id % 4 <> 0 OR id % 8 = 0),
orow AS (SELECT * FROM match_players WHERE match_id % 4 <> 0 OR match_id % 8 = 0),
ok AS (
  SELECT *, coalesce(editing_match_id, (SELECT max(id) FROM om) + row_number() OVER (PARTITION BY editing_match_id IS NULL ORDER BY draft_id)) AS match_id FROM good
), named AS (
  SELECT pop.* EXCLUDE (player_id), ok.match_id, pop.player_id AS given, nullif(trim(player_name), '') AS name
  FROM pop JOIN ok USING (draft_id)
), half AS (
  SELECT named.*, players.id AS known FROM named LEFT JOIN players ON players.display_name = name
), fresh AS (
  SELECT name, (SELECT max(id) FROM players) + row_number() OVER (ORDER BY min(row_id)) AS new_id
  FROM half WHERE given IS NULL AND known IS NULL AND name IS NOT NULL GROUP BY name
), res AS (
  SELECT half.*, coalesce(given, known, new_id) AS player_id, given IS NULL AND new_id IS NOT NULL AS is_new FROM half LEFT JOIN fresh USING (name)
)
"""
CELLS = " UNION ALL ".join(
    f"SELECT match_id, row_id, '{c}' AS column_name, superseded AS superseded_value FROM res WHERE source = 'template' AND NOT {BLANK.format(c)}" for c in FIELDS
)
ROSTER = ", ".join(["match_id", "team", "row_index", "is_me", "player_id", "role", "hero_id", *STATS])
SQL = {
    "draft_problems": "SELECT * FROM problems",
    "draft_populated": "SELECT draft_id, row_id, team, row_index, is_me FROM pop",
    "commit_matches": """SELECT id, played_at, map_id, mode, result, team_size, season_id FROM om WHERE id NOT IN (SELECT editing_match_id FROM ok WHERE editing_match_id IS NOT NULL)
      UNION ALL SELECT ok.match_id, played_at, map_id, mode, result, coalesce(nullif(team_size, 0), nullif(greatest(a, e), 0)),
        CASE WHEN left(played_at, 10) BETWEEN '1995-01-01' AND '1996-06-30' THEN 1 WHEN left(played_at, 10) BETWEEN '1996-07-01' AND '1998-12-31' THEN 2 WHEN left(played_at, 10) >= '2000-01-01' THEN 3 END
      FROM ok LEFT JOIN (SELECT draft_id, count(*) FILTER (team = 'ally') AS a, count(*) FILTER (team = 'enemy') AS e FROM pop GROUP BY 1) USING (draft_id)""",
    "commit_roster": f"SELECT {ROSTER} FROM orow WHERE match_id NOT IN (SELECT editing_match_id FROM ok WHERE editing_match_id IS NOT NULL) UNION ALL SELECT {ROSTER} FROM res",
    "commit_bans": """SELECT match_id, hero_id FROM match_bans WHERE (match_id % 4 <> 0 OR match_id % 8 = 0) AND match_id NOT IN (SELECT editing_match_id FROM ok WHERE editing_match_id IS NOT NULL)
      UNION ALL SELECT ok.match_id, b.hero_id FROM match_bans b JOIN ok ON ok.draft_id = b.match_id""",
    "commit_players": """, old AS (SELECT player_id, count(*) AS n, count(*) FILTER (match_id IN (SELECT editing_match_id FROM ok)) AS back FROM orow WHERE player_id IS NOT NULL GROUP BY 1),
      more AS (SELECT player_id, count(*) AS m FROM res WHERE player_id IS NOT NULL GROUP BY 1),
      everyone AS (SELECT id, display_name FROM players UNION SELECT new_id, name FROM fresh)
      SELECT id, display_name, CAST(greatest(0, coalesce(n, 0) - coalesce(back, 0)) + coalesce(m, 0) AS BIGINT) AS games_seen
      FROM everyone LEFT JOIN old ON old.player_id = id LEFT JOIN more ON more.player_id = id""",
    "commit_provenance": CELLS,
    "learn_nameplates": f"""SELECT player_id, phash, count(*) AS times_matched FROM (
      SELECT player_id, {PHASH.format("player_id * 10 + id % 4")} AS phash FROM match_players WHERE match_id % 4 = 2 AND player_id IS NOT NULL
      UNION ALL SELECT player_id, nameplate FROM res WHERE player_id IS NOT NULL AND nameplate IS NOT NULL) GROUP BY 1, 2""",
    "learn_portraits": f""", base AS (SELECT hero_id, {PHASH.format("hero_id * 3 + id % 5")} AS phash FROM match_players WHERE match_id % 4 = 1 AND hero_id IS NOT NULL),
      held AS (SELECT phash, min(hero_id) AS hero_id FROM base GROUP BY 1),
      came AS (SELECT portrait AS phash, arg_min(hero_id, row_id) AS hero_id FROM res WHERE portrait IS NOT NULL AND hero_id IS NOT NULL GROUP BY 1),
      owner AS (SELECT * FROM held UNION ALL SELECT * FROM came WHERE phash NOT IN (SELECT phash FROM held))
      SELECT hero_id, phash, count(*) AS times_matched FROM (
        SELECT * FROM base UNION ALL SELECT hero_id, portrait FROM res WHERE portrait IS NOT NULL AND hero_id IS NOT NULL) JOIN owner USING (hero_id, phash) GROUP BY 1, 2""",
}
BUILD = {
    "draft_problems": C.problems,
    "draft_populated": lambda d: C.populated(d).select("draft_id", "row_id", "team", "row_index", "is_me"),
    "commit_matches": C.matches_after,
    "commit_roster": C.roster_after,
    "commit_bans": lambda d: C.bans_after(d).select("match_id", "hero_id"),
    "commit_players": C.players_after,
    "commit_provenance": C.provenance,
    "learn_nameplates": C.nameplates_after,
    "learn_portraits": C.portraits_after,
}


def queries() -> dict:
    return {name: lambda spark, sf_dir, f=f: f(Drafts(Tables(spark, sf_dir))) for name, f in BUILD.items()}


def oracle_sql() -> dict[str, str]:
    return {name: BASE.format(subject=ME) + DRAFTS + body for name, body in SQL.items()}
