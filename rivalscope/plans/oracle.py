"""DuckDB SQL for the registered queries, over the raw tables."""

from __future__ import annotations

BASE = """
WITH heroes AS (
  SELECT id, name, CASE id % 3 WHEN 0 THEN 'tank' WHEN 1 THEN 'damage' ELSE 'support' END AS role
  FROM (SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS id FROM (SELECT DISTINCT p_brand FROM part))
), maps AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'control' WHEN 1 THEN 'escort' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'push' ELSE 'flashpoint' END AS mode FROM nation
), players AS (SELECT s_suppkey AS id, s_name AS display_name FROM supplier),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem
), matches AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00:00+00:00' END AS played_at,
    CASE WHEN o_custkey % 10 <> 0 THEN o_custkey % 25 END AS map_id, CASE WHEN o_orderkey % 7 = 0 THEN 'clash' END AS mode,
    CASE WHEN o_orderstatus = 'F' THEN 'win' WHEN o_orderstatus = 'O' THEN 'loss' WHEN o_orderkey % 3 = 0 THEN 'draw' WHEN o_orderkey % 3 = 1 THEN 'win' ELSE 'loss' END AS result,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor((coalesce(n, 0) + 1) / 2) AS INTEGER) END AS team_size,
    CASE WHEN o_orderkey % 5 <> 0 THEN 1 + o_custkey % 36 END AS rank_range_low, CASE WHEN o_orderkey % 5 <> 0 THEN 5 + o_custkey % 36 END AS rank_range_high,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN CAST(o_orderdate AS DATE) BETWEEN '1995-01-01' AND '1996-06-30' THEN 1 WHEN CAST(o_orderdate AS DATE) BETWEEN '1996-07-01' AND '1998-12-31' THEN 2 WHEN CAST(o_orderdate AS DATE) >= '2000-01-01' THEN 3 END AS season_id
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
), match_players AS (
  SELECT l_orderkey * 100 + rn AS id, l_orderkey AS match_id, CASE WHEN rn = 1 THEN 0 WHEN l_returnflag = 'N' AND l_partkey % 3 = 0 THEN NULL ELSE l_suppkey END AS player_id,
    CASE WHEN rn % 2 = 1 THEN 'ally' ELSE 'enemy' END AS team, rn = 1 AS is_me, CASE WHEN l_partkey % 13 = 0 THEN 'tank' END AS role, CASE WHEN p_size % 10 <> 0 THEN heroes.id END AS hero_id,
    CASE WHEN NOT (rn % 2 = 0 AND l_linestatus = 'F') THEN CAST(l_quantity AS BIGINT) END AS eliminations, l_partkey % 20 AS assists, CAST(l_linenumber AS BIGINT) AS deaths, CAST(floor(l_extendedprice) AS BIGINT) AS damage,
    CASE WHEN l_returnflag = 'A' THEN l_partkey % 10000 END AS healing, l_suppkey * 100 AS mitigation, CAST(floor((rn - 1) / 2) AS INTEGER) AS row_index
  FROM numbered JOIN part ON l_partkey = p_partkey JOIN heroes ON heroes.name = p_brand
), match_bans AS (
  SELECT l_orderkey AS match_id, heroes.id AS hero_id FROM numbered JOIN part ON l_partkey = p_partkey JOIN heroes ON heroes.name = p_brand WHERE l_discount >= 0.09
), sm AS (
  SELECT p.id AS subject_row_id, p.match_id, p.team, p.hero_id, h.name AS hero, coalesce(p.role, h.role) AS role, p.eliminations, p.assists, p.deaths, p.damage, p.healing, p.mitigation,
    m.played_at, m.map_id, maps.name AS map, coalesce(m.mode, maps.mode) AS mode, m.team_size, m.rank_range_low, m.rank_range_high, m.season_id,
    CASE WHEN m.result = 'draw' THEN 'draw' WHEN p.team = 'ally' THEN m.result WHEN m.result = 'win' THEN 'loss' ELSE 'win' END AS outcome
  FROM match_players p JOIN matches m ON m.id = p.match_id LEFT JOIN heroes h ON h.id = p.hero_id LEFT JOIN maps ON maps.id = m.map_id WHERE {subject}
)
"""
ME, PLAYER = "p.is_me", "p.player_id = 3"
TALLY = """CAST(count(*) AS BIGINT) AS games, CAST(coalesce(sum(CASE WHEN outcome = 'win' THEN 1 ELSE 0 END), 0) AS BIGINT) AS wins, CAST(coalesce(sum(CASE WHEN outcome = 'loss' THEN 1 ELSE 0 END), 0) AS BIGINT) AS losses,
 CAST(coalesce(sum(CASE WHEN outcome = 'draw' THEN 1 ELSE 0 END), 0) AS BIGINT) AS draws, round(sum(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0 END) / nullif(count(*), 0), 6) AS win_rate, count(*) >= 5 AS reliable"""
AVERAGES = "CAST(count(*) AS BIGINT) AS games, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("eliminations", "assists", "deaths", "damage", "healing", "mitigation"))
ALLY = "JOIN match_players o ON o.match_id = sm.match_id AND o.team = sm.team AND o.id <> sm.subject_row_id"
FOE = "JOIN match_players o ON o.match_id = sm.match_id AND o.team <> sm.team"
Z = "1.959963984540054"


def wilson(sign: str) -> str:
    n, p = "CAST(wins + losses AS DOUBLE)", "(wins / CAST(wins + losses AS DOUBLE))"
    x = f"({p} + {Z} * {Z} / (2 * {n}) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4 * {n} * {n}))) / (1 + {Z} * {Z} / {n})"
    return f"round(CASE WHEN wins + losses <= 0 THEN {0.0 if sign == '-' else 1.0} ELSE least(greatest({x}, 0.0), 1.0) END, 6)"


def q(body: str, subject: str = ME) -> str:
    return BASE.format(subject=subject) + body


BANS = f""", b AS (SELECT DISTINCT match_id, hero_id FROM match_bans), x AS (SELECT hero_id, {TALLY} FROM (SELECT sm.outcome, b.hero_id FROM sm JOIN b USING (match_id)) GROUP BY 1)
SELECT heroes.name, games, wins, losses, draws, win_rate, reliable, round(games / CAST((SELECT count(*) FROM sm WHERE match_id IN (SELECT match_id FROM b)) AS DOUBLE), 6) AS ban_rate FROM x JOIN heroes ON heroes.id = hero_id"""
SHAPES = """, team AS (SELECT p.match_id, p.team, sum(CASE WHEN coalesce(p.role, h.role) = 'tank' THEN 1 ELSE 0 END) AS t, sum(CASE WHEN coalesce(p.role, h.role) = 'damage' THEN 1 ELSE 0 END) AS d, sum(CASE WHEN coalesce(p.role, h.role) = 'support' THEN 1 ELSE 0 END) AS s,
 sum(CASE WHEN coalesce(p.role, h.role) IS NULL THEN 1 ELSE 0 END) AS unknown, count(*) AS rostered FROM match_players p LEFT JOIN heroes h ON h.id = p.hero_id GROUP BY 1, 2),
 shaped AS (SELECT sm.outcome, t || '-' || d || '-' || s AS shape, unknown = 0 AND (team_size IS NULL OR rostered = team_size) AS complete FROM sm JOIN team USING (match_id, team)) """
OTHERS = """, r AS (SELECT p.id, p.match_id, p.player_id, m.played_at, CASE WHEN m.result = 'draw' THEN 'draw' WHEN p.team = 'ally' THEN m.result WHEN m.result = 'win' THEN 'loss' ELSE 'win' END AS outcome
 FROM match_players p JOIN matches m ON m.id = p.match_id WHERE NOT p.is_me AND p.player_id IS NOT NULL) """
RELATION = ", r AS (SELECT them.player_id, m.result AS outcome FROM match_players them JOIN match_players me ON me.match_id = them.match_id AND me.is_me JOIN matches m ON m.id = them.match_id WHERE NOT them.is_me AND them.player_id IS NOT NULL AND them.team {} me.team) SELECT player_id, " + TALLY + " FROM r GROUP BY 1"
FILTERS = {
    "filter_hero": "hero_id = 4", "filter_role": "role = 'tank'", "filter_map": "map_id = 3", "filter_mode": "mode = 'escort'", "filter_team_size": "team_size = 2", "filter_dates": "played_at >= '1995-03-01' AND played_at <= '1996-09-30'",
    "filter_rank": "41 - rank_range_low >= 5 AND 41 - rank_range_high <= 30 AND rank_range_low BETWEEN 1 AND 40 AND rank_range_high BETWEEN 1 AND 40", "filter_season": "season_id = 2", "filter_unassigned": "season_id IS NULL",
    "filter_teammate": "EXISTS (SELECT 1 FROM match_players o WHERE o.match_id = sm.match_id AND o.team = sm.team AND o.id <> sm.subject_row_id AND o.player_id = 7)", "filter_opponent": "EXISTS (SELECT 1 FROM match_players o WHERE o.match_id = sm.match_id AND o.team <> sm.team AND o.player_id = 8)",
}

CELLS = " UNION ALL ".join(f"SELECT id AS match_id, '{f}' AS path, CAST({f} AS VARCHAR) AS value FROM matches WHERE {f} IS NOT NULL" for f in ("played_at", "map_id", "mode", "result", "team_size"))
CELLS += " UNION ALL SELECT o_orderkey, 'duration_seconds', CAST(300 + o_orderkey % 1200 AS VARCHAR) FROM orders"
MERGE = """WITH RECURSIVE c AS (
  SELECT user_id AS draft, event_type AS path, json_extract_string(props, '$.k') AS v, event_id % 4 AS r, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i
  FROM events WHERE event_id % 11 <> 0 AND trim(json_extract_string(props, '$.k')) <> ''
), f AS (
  SELECT draft, path, i, v, r, 0 AS conflicts, 0 AS superseded FROM c WHERE i = 1
  UNION ALL
  SELECT c.draft, c.path, c.i, CASE WHEN c.v <> f.v AND c.r > f.r THEN c.v ELSE f.v END, CASE WHEN c.v <> f.v AND c.r > f.r THEN c.r ELSE f.r END,
    f.conflicts + CASE WHEN c.v <> f.v AND c.r <> 0 AND f.r = 3 THEN 1 ELSE 0 END, f.superseded + CASE WHEN c.v <> f.v AND c.r <> 0 AND f.r <> 3 THEN 1 ELSE 0 END
  FROM f JOIN c ON c.draft = f.draft AND c.path = f.path AND c.i = f.i + 1
) SELECT draft, path, v AS value, CASE r WHEN 0 THEN 'name_suggestion' WHEN 1 THEN 'in_game_scoreboard' WHEN 2 THEN 'endgame_report' ELSE 'manual' END AS origin, CAST(conflicts AS BIGINT) AS conflicts, CAST(superseded AS BIGINT) AS superseded
FROM f QUALIFY i = max(i) OVER (PARTITION BY draft, path)"""
IDENTIFY = """WITH lib AS (SELECT vec_id, label AS owner, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
cand AS (SELECT vec_id AS id, list_transform(range(1, 65), lambda i: CASE WHEN i <= vec_id % 12 THEN 1 - bits[i] ELSE bits[i] END) AS bits FROM lib),
d AS (SELECT id, owner, min(CAST(list_sum(list_transform(range(1, 65), lambda i: abs(cand.bits[i] - lib.bits[i]))) AS BIGINT)) AS d FROM cand CROSS JOIN lib GROUP BY 1, 2),
n AS (SELECT *, lead(d) OVER w AS next FROM d WINDOW w AS (PARTITION BY id ORDER BY d, owner) QUALIFY row_number() OVER w = 1),
s AS (SELECT id, owner, d, CASE WHEN d > 8 THEN 'none' WHEN next - d < 2 THEN 'ambiguous' ELSE 'match' END AS status FROM n)
SELECT id, status, CAST(CASE WHEN status = 'match' THEN owner END AS BIGINT) AS owner, CASE WHEN d <= 8 THEN d END AS distance FROM s"""

PLACED = OTHERS.replace("p.id, p.match_id", "p.id, p.team, p.match_id") + ", o AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY played_at NULLS FIRST, match_id, id) AS x FROM r) "
TAGGED = PLACED + """, pt AS (SELECT s_suppkey AS player_id, CASE s_suppkey % 7 WHEN 0 THEN 'tank' WHEN 1 THEN 'damage' WHEN 2 THEN 'support' WHEN 3 THEN 'red' WHEN 4 THEN 'pink' ELSE 'white' END AS tag_code FROM supplier WHERE s_suppkey % 7 <> 6 UNION SELECT s_suppkey, 'red' FROM supplier WHERE s_suppkey % 5 = 0),
 worn AS (SELECT DISTINCT o.player_id, o.match_id, pt.tag_code FROM o JOIN match_players mate ON mate.match_id = o.match_id AND mate.team = o.team AND mate.id <> o.id JOIN pt ON pt.player_id = mate.player_id),
 g AS (SELECT o.*, worn.tag_code, CASE WHEN outcome = 'win' THEN 1 ELSE 0 END AS win FROM o JOIN worn ON worn.player_id = o.player_id AND worn.match_id = o.match_id) """
SNAP = r"""WITH p AS (SELECT p_partkey AS id, p_size / 50.0 AS confidence, regexp_replace(upper(p_name), '[^\p{L}\p{N}_\-\[\]]', '', 'g') AS name FROM part),
c AS (SELECT id, CAST(confidence AS DOUBLE) AS confidence, CASE id % 5 WHEN 1 THEN name[2:] WHEN 2 THEN translate(name, 'AE', '43') WHEN 3 THEN 'XY' || name WHEN 4 THEN left(name, length(name) - 2) ELSE name END AS text FROM p),
roster AS (SELECT name, min(id) AS owner FROM p GROUP BY 1),
d AS (SELECT text, owner, CASE WHEN length(text) > 5 THEN least(levenshtein(text, name), levenshtein(text[2:], name), levenshtein(text[3:], name)) ELSE levenshtein(text, name) END AS d FROM (SELECT DISTINCT text FROM c WHERE length(text) >= 4) CROSS JOIN roster),
n AS (SELECT *, lead(d) OVER w AS next FROM d WINDOW w AS (PARTITION BY text ORDER BY d, owner) QUALIFY row_number() OVER w = 1),
s AS (SELECT * FROM n WHERE d <= 2 AND (next IS NULL OR next - d >= 1))
SELECT id, c.text, owner, d AS distance, CASE WHEN owner IS NOT NULL THEN 'known' ELSE 'read' END AS origin, round(CASE WHEN owner IS NOT NULL THEN least(confidence * (1 - d / 3.0), 0.5) ELSE least(confidence, 0.5) * 0.5 END, 6) AS confidence FROM c LEFT JOIN s ON s.text = c.text WHERE c.text <> ''"""
SETTINGS = r"""WITH k(n, key, usual, kind) AS (VALUES (0, 'my_display_name', '', 'text'), (1, 'confidence_threshold', '0.75', 'float'), (2, 'default_team_size', '6', 'int'), (3, 'hero_hash_max_distance', '8', 'int'), (4, 'nameplate_hash_max_distance', '35', 'int'), (5, 'read_unknown_names', '1', 'int')),
s AS (SELECT c_custkey AS id, c_custkey % 6 AS n, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(c_custkey % 1000 AS VARCHAR) WHEN 2 THEN c_mktsegment END AS value FROM customer)
SELECT id, key, coalesce(CASE WHEN value = '' THEN NULL WHEN kind = 'text' THEN value WHEN kind = 'float' THEN CAST(TRY_CAST(value AS DOUBLE) AS VARCHAR) WHEN regexp_full_match(value, '[0-9]+') THEN value END, usual) AS value FROM s JOIN k USING (n)"""


def by(keys: str) -> str:
    return f"SELECT {keys}, {TALLY} FROM sm WHERE {' AND '.join(f'{k.strip()} IS NOT NULL' for k in keys.split(','))} GROUP BY {keys}"


def oracle_sql() -> dict[str, str]:
    people = "SELECT players.display_name AS name, {tally} FROM sm {join} JOIN players ON players.id = o.player_id GROUP BY 1 HAVING count(*) >= {least}"
    out = {
        "overall_me": q(f"SELECT {TALLY} FROM sm"),
        "overall_player": q(f"SELECT {TALLY} FROM sm", PLAYER),
        "totals_me": q("SELECT count(*) AS matches, count(map_id) AS with_map, count(hero_id) AS with_hero, count(CASE WHEN match_id IN (SELECT match_id FROM match_bans) THEN 1 END) AS with_bans, count(eliminations) AS with_stats, min(played_at) AS first_played, max(played_at) AS last_played FROM sm"),
        "by_map": q(by("map")),
        "by_map_player": q(by("map"), PLAYER),
        "by_hero": q(by("hero")),
        "by_role": q(by("role")),
        "by_mode": q(by("mode")),
        "by_team_size": q(f"SELECT team_size, team_size || 'v' || team_size AS label, {TALLY} FROM sm WHERE team_size IS NOT NULL GROUP BY team_size"),
        "by_ally": q(people.format(tally=TALLY, join=ALLY, least=1)),
        "by_opponent": q(people.format(tally=TALLY, join=FOE, least=2)),
        "by_ally_hero": q(f"SELECT h.name, {TALLY} FROM sm {ALLY} JOIN heroes h ON h.id = o.hero_id GROUP BY 1"),
        "by_opponent_hero": q(f"SELECT h.name, {TALLY} FROM sm JOIN (SELECT DISTINCT match_id, team, hero_id FROM match_players) o ON o.match_id = sm.match_id AND o.team <> sm.team JOIN heroes h ON h.id = o.hero_id GROUP BY 1"),
        "bans": q(BANS),
        "most_banned": q(BANS.replace("SELECT heroes.name, games, wins, losses, draws, win_rate, reliable,", "SELECT heroes.name, games,") + " ORDER BY games DESC, name LIMIT 5"),
        "comp_shapes": q(SHAPES + f"SELECT shape, {TALLY} FROM shaped WHERE complete GROUP BY 1"),
        "comp_unclassified": q(SHAPES + "SELECT count(*) AS unclassified_games FROM shaped WHERE NOT complete"),
        "hero_pairs": q(f"SELECT least(ha.name, hb.name) || ' + ' || greatest(ha.name, hb.name) AS pair, {TALLY} FROM sm JOIN match_players a ON a.match_id = sm.match_id AND a.team = sm.team JOIN match_players b ON b.match_id = a.match_id AND b.team = a.team AND b.hero_id > a.hero_id JOIN heroes ha ON ha.id = a.hero_id JOIN heroes hb ON hb.id = b.hero_id GROUP BY a.hero_id, b.hero_id, ha.name, hb.name HAVING count(*) >= 2"),
        "crosstab": q(by("map, hero")),
        "averages": q(f"SELECT {AVERAGES} FROM sm WHERE eliminations IS NOT NULL"),
        "averages_by_role": q(f"SELECT role, {AVERAGES} FROM sm WHERE eliminations IS NOT NULL AND role IS NOT NULL GROUP BY role"),
        "wilson_by_map": q(f", x AS ({by('map')}) SELECT *, {wilson('-')} AS score, {wilson('+')} AS ceiling FROM x"),
        "trend_points": q(OTHERS + "SELECT player_id, match_id, row_number() OVER w AS x, round(avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS cumulative, round(avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0 END) OVER (w ROWS 9 PRECEDING), 6) AS rolling, count(*) OVER (w ROWS 9 PRECEDING) AS n FROM r WINDOW w AS (PARTITION BY player_id ORDER BY played_at NULLS FIRST, match_id, id)"),
        "streak_longest": q(OTHERS + ", c AS (SELECT *, CASE WHEN lag(outcome) OVER w IS DISTINCT FROM outcome THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY player_id ORDER BY played_at NULLS FIRST, match_id, id)), g AS (SELECT *, sum(new) OVER (PARTITION BY player_id ORDER BY played_at NULLS FIRST, match_id, id) AS run FROM c), n AS (SELECT player_id, run, outcome, count(*) AS k FROM g GROUP BY 1, 2, 3) SELECT player_id, CAST(coalesce(max(CASE WHEN outcome = 'win' THEN k END), 0) AS BIGINT) AS longest_win, CAST(coalesce(max(CASE WHEN outcome = 'loss' THEN k END), 0) AS BIGINT) AS longest_loss FROM n GROUP BY 1"),
        "players_tags": "WITH tags AS (SELECT * FROM (VALUES ('tank', 1), ('damage', 2), ('support', 3), ('red', 4), ('pink', 5), ('white', 6)) v(code, n)), pt AS (SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN 'tank' WHEN 1 THEN 'damage' WHEN 2 THEN 'support' WHEN 3 THEN 'red' WHEN 4 THEN 'pink' WHEN 5 THEN 'white' END AS code FROM supplier UNION SELECT s_suppkey, 'red' FROM supplier WHERE s_suppkey % 5 = 0) SELECT s_name AS display_name, coalesce(string_agg(tags.code, ',' ORDER BY tags.n), '') AS tags FROM supplier LEFT JOIN pt ON pt.id = s_suppkey LEFT JOIN tags ON tags.code = pt.code GROUP BY s_suppkey, s_name",
        "player_with_me": q(RELATION.format("=")),
        "player_against_me": q(RELATION.format("<>")),
        "export_everything": q("SELECT p.match_id, m.played_at, maps.name AS map, m.result, m.team_size, p.team, p.row_index, players.display_name AS player, h.name AS hero, p.eliminations, p.assists, p.deaths, p.damage, p.healing, p.mitigation FROM match_players p JOIN matches m ON m.id = p.match_id LEFT JOIN maps ON maps.id = m.map_id LEFT JOIN players ON players.id = p.player_id LEFT JOIN heroes h ON h.id = p.hero_id"),
        "match_list_page": q("SELECT id, played_at, result FROM matches ORDER BY played_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100"),
        "season_counts": q(", s(id, season) AS (VALUES (1, 'S1'), (2, 'S2'), (3, 'S3')) SELECT season, (SELECT count(*) FROM matches WHERE season_id = s.id) AS matches FROM s UNION ALL SELECT 'Unassigned', count(*) FROM matches WHERE season_id IS NULL HAVING count(*) > 0"),
        "duplicate_files": "WITH f AS (SELECT doc_id, sha256(text) AS sha, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents) SELECT doc_id, first_id FROM f WHERE doc_id <> first_id",
        "latest_by_path": "SELECT user_id, event_type, arg_max(json_extract_string(props, '$.k'), event_id) AS value, count(*) AS edits FROM events GROUP BY 1, 2",
        "delete_cascade": q("SELECT 'matches' AS table_name, count(*) AS n FROM matches WHERE result <> 'draw' UNION ALL SELECT 'match_players', count(*) FROM match_players WHERE match_id NOT IN (SELECT id FROM matches WHERE result = 'draw') UNION ALL SELECT 'match_bans', count(*) FROM match_bans WHERE match_id NOT IN (SELECT id FROM matches WHERE result = 'draw')"),
        "exact_comps": q(f", l AS (SELECT p.match_id, p.team, string_agg(h.name, ' · ' ORDER BY h.name) AS name, count(*) AS named FROM match_players p JOIN heroes h ON h.id = p.hero_id GROUP BY 1, 2) SELECT l.name, {TALLY} FROM sm JOIN l USING (match_id, team) WHERE team_size IS NULL OR named = team_size GROUP BY l.name"),
        "merge_drafts": MERGE,
        "games_seen": q("SELECT players.id, display_name, count(x.match_id) AS games_seen, max(x.played_at) AS last_seen FROM players LEFT JOIN (SELECT p.player_id, p.match_id, m.played_at FROM match_players p JOIN matches m ON m.id = p.match_id) x ON x.player_id = players.id GROUP BY 1, 2"),
        "integrity": q("SELECT 'roster row without match' AS rule, count(*) AS n FROM match_players WHERE match_id NOT IN (SELECT id FROM matches) UNION ALL SELECT 'roster row of unknown player', count(*) FROM match_players WHERE player_id NOT IN (SELECT id FROM players) UNION ALL SELECT 'match with several own rows', count(*) FROM (SELECT match_id FROM match_players WHERE is_me GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'match without own row', count(*) FROM matches WHERE id NOT IN (SELECT match_id FROM match_players WHERE is_me) UNION ALL SELECT 'unknown result', count(*) FROM matches WHERE coalesce(result, '') NOT IN ('win', 'loss', 'draw')"),
        "match_cells": q(CELLS),
        "hero_identify": IDENTIFY,
        "tagged_trends": q(TAGGED + "SELECT player_id, tag_code, match_id, x, row_number() OVER w AS n, round(avg(win) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS cumulative, round(avg(win) OVER (w ROWS 9 PRECEDING), 6) AS rolling, count(*) OVER (w ROWS 9 PRECEDING) AS size FROM g WINDOW w AS (PARTITION BY player_id, tag_code ORDER BY x)"),
        "tagged_series": q(TAGGED + "SELECT player_id, tag_code, count(*) AS games, CAST(sum(win) AS BIGINT) AS wins, round(avg(win), 6) AS win_rate FROM g GROUP BY 1, 2"),
        "streak_current": q(PLACED + ", l AS (SELECT player_id, arg_max(outcome, x) AS outcome, max(x) AS n FROM o GROUP BY 1) SELECT player_id, outcome, n - coalesce((SELECT max(x) FROM o WHERE o.player_id = l.player_id AND o.outcome <> l.outcome), 0) AS length FROM l"),
        "player_hero_counts": q("SELECT player_id, h.name AS hero, count(*) AS games FROM match_players p JOIN heroes h ON h.id = p.hero_id WHERE player_id IS NOT NULL GROUP BY 1, 2"),
        "player_averages": q(f"SELECT player_id, {AVERAGES} FROM match_players WHERE player_id IS NOT NULL GROUP BY 1"),
        "season_reassign": q(", s(new_id, a, b) AS (VALUES (1, '1995-01-01', '1996-03-31'), (2, '1996-04-01', '1998-12-31'), (3, '2000-01-01', '9999-12-31'), (4, '1999-01-01', '1999-12-31')) SELECT matches.id AS match_id, season_id AS old_season, new_id AS new_season FROM matches LEFT JOIN s ON left(played_at, 10) BETWEEN a AND b WHERE season_id IS DISTINCT FROM new_id"),
        "season_clashes": q(", s(name, a, b) AS (VALUES ('S1', '1995-01-01', '1996-06-30'), ('S2', '1996-07-01', '1998-12-31'), ('S3', '2000-01-01', '9999-12-31')), x AS (SELECT player_id, min(left(played_at, 10)) AS a, max(left(played_at, 10)) AS b FROM match_players p JOIN matches m ON m.id = p.match_id WHERE player_id IS NOT NULL GROUP BY 1) SELECT player_id, string_agg(name, ',' ORDER BY name) AS clashes FROM x JOIN s ON x.a <= s.b AND s.a <= x.b GROUP BY 1"),
        "typed_settings": SETTINGS,
        "team_sizes": q("SELECT m.id AS match_id, coalesce(m.team_size, x.seats) AS team_size FROM matches m LEFT JOIN (SELECT match_id, greatest(count(*) FILTER (team = 'ally'), count(*) FILTER (team = 'enemy')) AS seats FROM match_players GROUP BY 1) x ON x.match_id = m.id"),
        "reference_lists": q("SELECT kind, part, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT 'hero' AS kind, role AS part, name FROM heroes UNION ALL SELECT 'map', mode, name FROM maps) GROUP BY 1, 2"),
        "learned_counts": q("SELECT h.name, h.role, count(*) AS portraits, CAST(sum(vec_id % 7) AS BIGINT) AS times_matched, min(vec_id) AS first_seen FROM embeddings JOIN heroes h ON h.id = label + 1 GROUP BY 1, 2"),
        "name_suggestions": SNAP,
        "kind_guess": "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'tab|scoreboard|ingame|in-game|in_game') THEN 'in_game_scoreboard' ELSE 'endgame_report' END AS kind FROM part",
        "name_clean": r"SELECT c_custkey, regexp_replace(upper(c_name), '[^\p{L}\p{N}_\-\[\]]', '', 'g') AS clean FROM customer",
    }
    # the same for the operator's own rows, as those of a player 0
    for name in ("trend_points", "streak_longest", "tagged_trends", "tagged_series", "streak_current"):
        out[f"{name}_me"] = f"SELECT * EXCLUDE (player_id) FROM ({out[name].replace('p.player_id, m.played_at', '0 AS player_id, m.played_at').replace('WHERE NOT p.is_me AND p.player_id IS NOT NULL', 'WHERE p.is_me')})"
    return out | {name: q(f"SELECT team, {TALLY} FROM sm WHERE {where} GROUP BY team") for name, where in FILTERS.items()}
