"""Queries of lists, pages and editing rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breakdowns as B, editing as E, lists as L
from ..operators.subject import Filters, subject_matches
from ..sources.drafts import Drafts
from ..sources.fixtures import Tables
from ..sources.inputs import proposals, tag_sets
from .oracle import ALLY, BASE, ME, PLAYER, SHAPES, TALLY, wilson

WHO = 3  #: the player from whose point of view the ``_player`` queries are
BUSY = Filters(mode="escort", date_from="1993-01-01", team_size=2)
PHASH = "lower(lpad(to_hex({}), 16, '0'))"


def whole(f):
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


def me(f, filters=None, player=None):
    def run(spark, sf_dir):
        t = Tables(spark, sf_dir)
        return f(subject_matches(t, player, filters), t)

    return run


def plates(t: Tables):
    return L.plate_matches(*L.signatures(t))


def text_rules(t: Tables):
    text, n = F.col("text"), F.col("n_chars")
    commas, number = E.grouped(n * 977)
    return t.raw("documents").select(
        "doc_id", E.safe_stem(text).alias("stem"), commas.alias("commas"), number.alias("n_commas"), E.clock(n).alias("clock"), E.seconds_of(E.clock(n)).alias("seconds"),
        E.portable(F.concat(F.lit("C:\\x\\data\\"), F.col("source"))).alias("path"), F.nullif(F.trim(F.substring(text, 1, 3)), F.lit("")).alias("short"),
    )


BUILD = {
    "season_list": whole(L.season_list),
    "players_page": whole(L.players_page),
    "recent_matches": whole(lambda t: L.recent_matches(t, WHO)),
    "crosstab_axes": me(lambda sm, t: L.axes(sm)),
    "by_map_ordered": me(lambda sm, t: L.ordered(B.by(sm, "map"), "map")),
    "by_mode_ordered": me(lambda sm, t: L.ordered(B.by(sm, "mode"), "mode")),
    "allies_most_wins": me(lambda sm, t: L.top_allies(sm, t, "wins", 7)),
    "allies_most_losses": me(lambda sm, t: L.top_allies(sm, t, "losses", 20)),
    "roster_preview": whole(L.roster_preview),
    "rosters": whole(L.rosters),
    "filter_rank_ordinals": me(lambda sm, t: B.by(sm, "team"), Filters(rank_min=4, rank_max=30), WHO),
    "filter_many_player": me(lambda sm, t: B.by(sm, "team"), BUSY, WHO),
    "highlights_best": me(lambda sm, t: L.highlights(sm, t)),
    "highlights_worst": me(lambda sm, t: L.highlights(sm, t, best=False)),
    "highlights_delta": me(lambda sm, t: L.highlights(sm, t, "delta"), player=WHO),
    "highlights_some_kinds": me(lambda sm, t: L.highlights(sm, t, "score", False, ["hero", "role"]), player=WHO),
    "trend_filtered": me(lambda sm, t: L.subject_trend(sm), BUSY),
    "trend_player": me(lambda sm, t: L.subject_trend(sm, 4), player=WHO),
    "streaks_filtered": me(lambda sm, t: L.subject_streaks(sm), BUSY),
    "streaks_player": me(lambda sm, t: L.subject_streaks(sm), player=WHO),
    "trend_summary": whole(L.trend_summary),
    "portrait_library": whole(L.library),
    "portrait_summary": whole(L.library_summary),
    "portraits_forgotten": whole(lambda t: L.forget_portraits(t, 4)),
    "rows_before_clear": whole(L.rows_before_clear),
    "nameplate_matches": whole(plates),
    "empty_drafts": whole(E.empty_drafts),
    "conflicts_resolved": whole(E.conflicts_resolved),
    "drafts_patched": whole(E.patched),
    "drafts_cleared": whole(E.cleared),
    "origins_stamped": whole(E.stamped),
    "fragments_ok": whole(E.fragments_ok),
    "drafts_abandoned": whole(E.abandoned),
    "new_attachments": whole(E.new_attachments),
    "attached_by_prefix": whole(lambda t: E.attached(t, "a")),
    "crops_dropped": whole(E.without_crops),
    "open_drafts": whole(E.open_drafts),
    "season_problems": whole(lambda t: E.season_problems(t, proposals(t))),
    "season_overlaps": whole(lambda t: E.season_overlaps(proposals(t))),
    "season_deleted": whole(lambda t: E.season_deleted(t, 2)),
    "tags_replaced": whole(lambda t: E.tags_replaced(t, tag_sets(t))),
    "notes_edited": whole(E.notes_edited),
    "text_rules": whole(text_rules),
    "hero_names_resolved": whole(lambda t: t.raw("part").select("p_partkey", F.col("p_brand").alias("name")).join(F.broadcast(t.heroes), "name", "left").select("p_partkey", F.col("id").alias("hero_id"), "role")),
}
OBS = """WITH e AS (SELECT user_id AS draft, event_type AS path, event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN json_extract_string(props, '$.k') END AS value,
 CASE event_id % 4 WHEN 0 THEN 'name_suggestion' WHEN 1 THEN 'in_game_scoreboard' WHEN 2 THEN 'endgame_report' ELSE 'manual' END AS origin FROM events) """
PROPOSALS = """WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 9 <> 0 THEN ' ' || n_name ELSE '  ' END AS name,
 CASE WHEN n_nationkey % 11 <> 0 THEN printf('%04d-%02d-01', 1992 + n_nationkey % 11, 1 + n_nationkey % 12) ELSE 'soon' END AS starts_on,
 CASE WHEN n_nationkey % 4 <> 0 THEN printf('%04d-%02d-01', 1992 + n_nationkey % 11 + n_nationkey % 2, 1 + (n_nationkey + 5) % 12) END AS ends_on FROM nation) """
LIBRARY = f""", base AS (SELECT hero_id, {PHASH.format("hero_id * 3 + id % 5")} AS phash FROM match_players WHERE match_id % 4 = 1 AND hero_id IS NOT NULL),
 learned AS (SELECT hero_id, phash, count(*) AS times_matched FROM base JOIN (SELECT phash, min(hero_id) AS hero_id FROM base GROUP BY 1) USING (hero_id, phash) GROUP BY 1, 2),
 shipped AS (SELECT DISTINCT CAST(label + 1 AS BIGINT) AS hero_id, {PHASH.format("CAST(label AS BIGINT) * 3 + vec_id % 7")} AS phash FROM embeddings) """
PLACES = """, o AS (SELECT *, row_number() OVER (ORDER BY played_at NULLS FIRST, match_id, subject_row_id) AS x, CASE WHEN outcome = 'win' THEN 1.0 ELSE 0.0 END AS win FROM sm {where}) """
STREAKS = PLACES + """, g AS (SELECT outcome, count(*) AS length, min(x) AS a, max(x) AS z, arg_min(coalesce(played_at, ''), x) AS started, arg_max(coalesce(played_at, ''), x) AS ended
  FROM (SELECT *, x - row_number() OVER (PARTITION BY outcome ORDER BY x) AS run FROM o) GROUP BY outcome, run),
 r AS (SELECT 'current' AS kind, outcome, length, started, ended, 1 AS n FROM g WHERE z = (SELECT max(z) FROM g)
  UNION ALL SELECT 'longest', outcome, length, started, ended, row_number() OVER (PARTITION BY outcome ORDER BY length DESC, a) FROM g WHERE outcome <> 'draw')
 SELECT kind, outcome, length, nullif(started, '') AS started, nullif(ended, '') AS ended FROM r WHERE n = 1"""
WHERE = "WHERE mode = 'escort' AND played_at >= '1993-01-01' AND team_size = 2"


def trend(window: int, where: str = "") -> str:
    return PLACES.format(where=where) + f"""SELECT match_id, x, round(avg(win) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING), 6) AS cumulative,
      round(avg(win) OVER (ORDER BY x ROWS {window - 1} PRECEDING), 6) AS rolling, least(x, {window}) AS n FROM o"""


def highlights(kinds: dict[str, int], order: str) -> str:
    listed = " OR ".join(f"kind = '{k}'" for k in kinds)
    place = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in kinds.items()) + " END"
    return SHAPES + f""", k AS (
      SELECT 'map' AS kind, map AS name, outcome, 0 AS who FROM sm WHERE map IS NOT NULL UNION ALL SELECT 'hero', hero, outcome, 0 FROM sm WHERE hero IS NOT NULL
      UNION ALL SELECT 'role', role, outcome, 0 FROM sm WHERE role IS NOT NULL
      UNION ALL SELECT 'ally', players.display_name, sm.outcome, players.id FROM sm {ALLY} JOIN players ON players.id = o.player_id UNION ALL SELECT 'comp', shape, outcome, 0 FROM shaped WHERE complete
    ), x AS (SELECT kind, name, {TALLY} FROM k WHERE {listed} GROUP BY kind, name, who HAVING count(*) >= 5),
    y AS (SELECT kind, name, games, wins, losses, wins + losses AS decisive, {wilson('-')} AS score, {wilson('+')} AS ceiling FROM x)
    SELECT *, round(score - (SELECT round(avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0 END), 6) FROM sm), 6) AS delta FROM y ORDER BY {order}, {place}, games DESC, name LIMIT 5"""


def of(body: str, subject: str = ME) -> str:
    return BASE.format(subject=subject) + body


SQL = {
    "season_list": of(""", s(id, name, starts_on, ends_on) AS (VALUES (1, 'S1', '1995-01-01', '1996-06-30'), (2, 'S2', '1996-07-01', '1998-12-31'), (3, 'S3', '2000-01-01', NULL))
      SELECT id, name, starts_on, ends_on, ends_on IS NULL AS ongoing, (SELECT count(*) FROM matches WHERE season_id = s.id) AS matches FROM s
      UNION ALL SELECT NULL, 'Unassigned', NULL, NULL, false, count(*) FROM matches WHERE season_id IS NULL HAVING count(*) > 0"""),
    "players_page": of(f""", tags(code, n) AS (VALUES ('tank', 1), ('damage', 2), ('support', 3), ('red', 4), ('pink', 5), ('white', 6)),
      pt AS (SELECT s_suppkey AS player_id, ['tank', 'damage', 'support', 'red', 'pink', 'white'][s_suppkey % 7 + 1] AS code FROM supplier WHERE s_suppkey % 7 < 6 UNION SELECT s_suppkey, 'red' FROM supplier WHERE s_suppkey % 5 = 0)
      SELECT id, display_name, (SELECT count(*) FROM match_players p WHERE p.player_id = players.id) AS games_seen, EXISTS (SELECT 1 FROM match_players p WHERE p.player_id = players.id AND p.is_me) AS is_me,
        (SELECT count(DISTINCT p.player_id * 10 + p.id % 4) FROM match_players p WHERE p.player_id = players.id AND p.match_id % 4 = 2) AS nameplate_count,
        coalesce((SELECT string_agg(code, ',' ORDER BY n) FROM pt JOIN tags USING (code) WHERE pt.player_id = players.id), '') AS tags
      FROM players ORDER BY games_seen DESC, display_name, id LIMIT 200"""),
    "recent_matches": of(f"""SELECT m.id AS match_id, them.id AS row_id, m.played_at, m.result AS my_result, CASE WHEN m.result = 'draw' THEN 'draw' WHEN them.team = me.team THEN m.result WHEN m.result = 'win' THEN 'loss' ELSE 'win' END AS result,
      maps.name AS map_name, h.name AS hero_name, them.team AS their_team, me.team AS my_team
      FROM match_players them JOIN matches m ON m.id = them.match_id LEFT JOIN maps ON maps.id = m.map_id LEFT JOIN heroes h ON h.id = them.hero_id LEFT JOIN match_players me ON me.match_id = m.id AND me.is_me
      WHERE them.player_id = {WHO} ORDER BY m.played_at DESC NULLS LAST, m.id DESC, them.id LIMIT 25"""),
    "crosstab_axes": of("SELECT DISTINCT 'hero' AS axis, hero AS name FROM sm WHERE map IS NOT NULL AND hero IS NOT NULL UNION SELECT DISTINCT 'map', map FROM sm WHERE map IS NOT NULL AND hero IS NOT NULL"),
    "by_map_ordered": of(f"SELECT map, {TALLY} FROM sm WHERE map IS NOT NULL GROUP BY map ORDER BY games DESC, map"),
    "by_mode_ordered": of(f"SELECT mode, {TALLY} FROM sm WHERE mode IS NOT NULL GROUP BY mode ORDER BY games DESC, mode"),
    **{f"allies_most_{c}": of(f"SELECT name, {', '.join(('games', 'wins', 'losses', 'draws', 'win_rate', 'reliable'))} FROM (SELECT players.display_name AS name, {TALLY} FROM sm {ALLY} JOIN players ON players.id = o.player_id GROUP BY players.id, 1) WHERE {c} > 0 ORDER BY {c} DESC, name LIMIT {n}") for c, n in (("wins", 7), ("losses", 20))},
    "roster_preview": of("SELECT players.id, display_name, count(*) AS games, (SELECT count(*) FROM players WHERE id IN (SELECT player_id FROM match_players)) AS total FROM players JOIN match_players p ON p.player_id = players.id GROUP BY 1, 2 ORDER BY games DESC, display_name, players.id LIMIT 50"),
    "rosters": of("SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY team <> 'ally', row_index, id) - 1 AS place, id AS row_id FROM match_players"),
    "filter_rank_ordinals": of(f"SELECT team, {TALLY} FROM sm WHERE 41 - rank_range_low >= 4 AND 41 - rank_range_high <= 30 AND rank_range_low BETWEEN 1 AND 40 AND rank_range_high BETWEEN 1 AND 40 GROUP BY team", PLAYER),
    "filter_many_player": of(f"SELECT team, {TALLY} FROM sm {WHERE} GROUP BY team", PLAYER),
    "highlights_best": of(highlights({"map": 0, "hero": 1, "role": 2, "ally": 3, "comp": 4}, "score DESC")),
    "highlights_worst": of(highlights({"map": 0, "hero": 1, "role": 2, "ally": 3, "comp": 4}, "ceiling")),
    "highlights_delta": of(highlights({"map": 0, "hero": 1, "role": 2, "ally": 3, "comp": 4}, "delta DESC"), PLAYER),
    "highlights_some_kinds": of(highlights({"hero": 1, "role": 2}, "ceiling"), PLAYER),
    "trend_filtered": of(trend(10, WHERE)),
    "trend_player": of(trend(4), PLAYER),
    "streaks_filtered": of(STREAKS.format(where=WHERE)),
    "streaks_player": of(STREAKS.format(where=""), PLAYER),
    "trend_summary": of("SELECT (SELECT count(*) FROM match_players WHERE is_me) AS games, 6 AS tags_defined, (SELECT count(*) FROM (SELECT DISTINCT s_suppkey % 7 AS k FROM supplier WHERE s_suppkey % 7 < 6 UNION SELECT 3 FROM supplier WHERE s_suppkey % 5 = 0)) AS tags_in_use"),
    "portrait_library": of(LIBRARY + "SELECT hero_id, phash, 'shipped' AS origin FROM shipped UNION ALL SELECT hero_id, phash, 'learned' FROM learned WHERE (hero_id, phash) NOT IN (SELECT (hero_id, phash) FROM shipped)"),
    "portrait_summary": of(LIBRARY + "SELECT (SELECT count(DISTINCT hero_id) FROM learned) AS learned, (SELECT count(DISTINCT hero_id) FROM shipped) AS shipped, (SELECT count(*) FROM (SELECT hero_id FROM learned UNION SELECT hero_id FROM shipped)) AS heroes_known"),
    "portraits_forgotten": of(LIBRARY + "SELECT hero_id, phash, times_matched FROM learned WHERE hero_id <> 4"),
    "rows_before_clear": of(""", n AS (SELECT 'matches' AS table_name, count(*) AS n FROM matches UNION ALL SELECT 'match_players', count(*) FROM match_players UNION ALL SELECT 'match_bans', count(*) FROM match_bans
      UNION ALL SELECT 'players', count(*) FROM players UNION ALL SELECT 'player_tags', count(*) FROM (SELECT s_suppkey, s_suppkey % 7 FROM supplier WHERE s_suppkey % 7 < 6 UNION SELECT s_suppkey, 3 FROM supplier WHERE s_suppkey % 5 = 0))
      SELECT * FROM n UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM n"""),
    "nameplate_matches": """WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS owner, embedding FROM embeddings), first AS (SELECT owner, arg_min(embedding, vec_id) AS v FROM e GROUP BY 1),
      lib AS (SELECT owner, [list_sum([CASE WHEN v[(32 * w + b) % 64 + 1] > ((32 * w + b) // 64 - 4) / 16.0 THEN CAST(1 AS BIGINT) << b ELSE 0 END FOR b IN range(32)]) FOR w IN range(15)] AS words FROM first),
      seen AS (SELECT vec_id, [CASE WHEN i = 1 THEN xor(CAST(words[i] AS BIGINT), CAST((vec_id * 2654435761 % 4294967296) & (vec_id * 97 % 4294967296) AS BIGINT)) ELSE CAST(words[i] AS BIGINT) END FOR i IN range(1, 16)] AS words FROM e JOIN lib USING (owner)),
      near AS (SELECT vec_id, lib.owner, list_sum([bit_count(xor(CAST(seen.words[i] AS BIGINT), CAST(lib.words[i] AS BIGINT))) FOR i IN range(1, 16)]) AS distance FROM seen, lib),
      best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, owner) AS n FROM near WHERE distance <= 35)
      SELECT vec_id, owner, CAST(distance AS BIGINT) AS distance, round(1 - distance / 35.0 * 0.5, 6) AS confidence FROM best WHERE n = 1""",
    "empty_drafts": of("SELECT id AS match_id, team, unnest(range(coalesce(team_size, 6))) AS row_index FROM matches, (VALUES ('ally'), ('enemy')) AS x(team)"),
    "conflicts_resolved": OBS + """, b AS (SELECT draft, path, arg_min(value, seq) AS mine, arg_max(value, seq) AS theirs, count(*) AS n FROM e WHERE value IS NOT NULL GROUP BY 1, 2)
      SELECT draft, path, CASE WHEN mine <> theirs AND n % 2 = 0 THEN theirs ELSE mine END AS value, CASE WHEN mine <> theirs AND n % 2 = 0 THEN 'template' ELSE 'kept' END AS source FROM b""",
    "drafts_patched": OBS + """, v AS (SELECT *, CAST(value AS INTEGER) % 6 AS row FROM e WHERE value IS NOT NULL), m AS (SELECT draft, arg_max(row, seq) AS own FROM v WHERE path = 'purchase' GROUP BY 1)
      SELECT n.draft, n.row, n.name, coalesce(n.row = own, false) AS is_me FROM (SELECT draft, row, arg_max(path, seq) AS name FROM v WHERE path <> 'purchase' GROUP BY 1, 2) n LEFT JOIN m USING (draft)""",
    "drafts_cleared": OBS + "SELECT draft, path, seq, CASE WHEN seq % 3 <> 0 THEN value END AS value, CASE seq % 3 WHEN 0 THEN 'template' WHEN 1 THEN 'manual' ELSE 'default' END AS source FROM e",
    "origins_stamped": OBS + "SELECT draft, path, seq, CASE WHEN seq % 3 = 0 AND seq % 2 <> 0 THEN CASE WHEN seq % 5 = 0 THEN 'in_game_scoreboard' ELSE 'endgame_report' END WHEN seq % 2 = 0 THEN origin END AS origin FROM e",
    "fragments_ok": OBS + "SELECT draft, path, bool_or(coalesce(trim(value) <> '', false)) AS ok FROM e GROUP BY 1, 2",
    "drafts_abandoned": OBS + ", s AS (SELECT draft, CASE WHEN bool_or(origin = 'manual' AND value IS NOT NULL) THEN 'committed' ELSE 'open' END AS status FROM e GROUP BY 1) SELECT draft, status, CASE WHEN status = 'open' THEN 'abandoned' ELSE status END AS after FROM s",
    "new_attachments": "SELECT source, sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2",
    "attached_by_prefix": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) LIKE 'a%'",
    "crops_dropped": "WITH c AS (SELECT doc_id, source, left(sha256(text), 8) AS marker FROM documents) SELECT doc_id, CASE WHEN marker <> min(marker) OVER (PARTITION BY source) THEN marker END AS marker FROM c WHERE source IS NOT NULL",
    "open_drafts": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS editing FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0",
    "season_problems": PROPOSALS + """, own AS (SELECT id, 'no name' AS problem FROM p WHERE trim(name) = '' UNION ALL SELECT id, 'no start' FROM p WHERE starts_on = 'soon' UNION ALL SELECT id, 'ends before it starts' FROM p WHERE starts_on <> 'soon' AND ends_on < starts_on)
      SELECT * FROM own UNION ALL SELECT id, 'overlaps ' || season FROM p JOIN (VALUES ('S1', '1995-01-01', '1996-06-30'), ('S2', '1996-07-01', '1998-12-31'), ('S3', '2000-01-01', '9999-12-31')) AS s(season, a, b) ON starts_on <= b AND a <= coalesce(ends_on, '9999-12-31') WHERE id NOT IN (SELECT id FROM own)""",
    "season_overlaps": PROPOSALS + """, q AS (SELECT id, starts_on AS a, coalesce(ends_on, '9999-12-31') AS z FROM p WHERE starts_on <> 'soon' AND (ends_on IS NULL OR ends_on >= starts_on))
      SELECT x.id AS a, y.id AS b FROM q x JOIN q y ON x.id < y.id AND x.a <= y.z AND y.a <= x.z""",
    "season_deleted": of("SELECT id, CASE WHEN season_id <> 2 THEN season_id END AS season_id FROM matches"),
    "tags_replaced": """WITH pt AS (SELECT s_suppkey AS player_id, ['tank', 'damage', 'support', 'red', 'pink', 'white'][s_suppkey % 7 + 1] AS tag_code FROM supplier WHERE s_suppkey % 7 < 6 UNION SELECT s_suppkey, 'red' FROM supplier WHERE s_suppkey % 5 = 0),
      g AS (SELECT s_suppkey AS player_id FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0)
      SELECT * FROM pt WHERE player_id NOT IN (SELECT player_id FROM g) UNION ALL SELECT player_id, 'white' FROM g UNION ALL SELECT player_id, 'pink' FROM g""",
    "notes_edited": "SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'new ' || s_name WHEN 1 THEN NULL ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'old ' || s_suppkey END END AS notes FROM supplier",
    "text_rules": r"""SELECT doc_id, coalesce(nullif(regexp_replace(replace(substring(text, 1, 40), ' ', '_'), '[^\p{L}\p{N}_\-]', '', 'g'), ''), 'shot') AS stem, format('{:,}', n_chars * 977) AS commas,
      CAST((length(CAST(n_chars * 977 AS VARCHAR)) - 1) // 3 AS BIGINT) AS n_commas, (n_chars // 60) || ':' || lpad(CAST(n_chars % 60 AS VARCHAR), 2, '0') AS clock, n_chars AS seconds, 'data/' || source AS path, nullif(trim(substring(text, 1, 3)), '') AS short FROM documents""",
    "hero_names_resolved": of("SELECT p_partkey, heroes.id AS hero_id, heroes.role FROM part LEFT JOIN heroes ON heroes.name = p_brand"),
}


def queries() -> dict:
    return dict(BUILD)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
