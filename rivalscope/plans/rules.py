"""Queries of the schema's rules, of profiles and of glyphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glyphs as G, profiles as P, references as R
from ..sources.drafts import DraftStore
from ..sources.fixtures import Tables
from .oracle import BASE, ME

CHECKED = ["heroes", "maps", "players", "seasons", "ranks", "matches", "match_players", "match_bans"]
DELETED = ["matches", "match_players", "match_bans", "match_sources", "field_provenance", "drafts"]


def deleted(spark, sf_dir):
    """Rows left in each table after the drawn matches are deleted with all that hangs off them."""
    t = DraftStore(Tables(spark, sf_dir))
    return R.sizes(R.delete(t, "matches", t.matches.filter("result = 'draw'").select("id")), DELETED)


def prices(spark, sf_dir):
    """The orders' prices as one long profile by order number."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(0).alias("series"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("double").alias("value"))


def glyph_matches(spark, sf_dir):
    """Embeddings held against the first one of each label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    atlas = e.groupBy(F.col("label").cast("string").alias("name")).agg(F.min_by("embedding", "vec_id").alias("v"))
    found = G.correlate(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), atlas)
    return found.select("id", "name", F.round("score", 5).alias("score"), "runner_up", F.round("runner_score", 5).alias("runner_score"), "confident")


def boxes_read(spark, sf_dir):
    """Order lines as boxes of a crop."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    boxes = rows.select(F.col("l_orderkey").alias("crop"), F.col("l_linenumber").cast("long").alias("x"), F.col("l_quantity").cast("double").alias("height"), F.col("l_returnflag").alias("text"), F.col("l_discount").cast("double").alias("confidence"))
    return G.read_boxes(boxes)


BUILD = {
    "glyph_matches": glyph_matches,
    "boxes_read": boxes_read,
    "profile_runs": lambda spark, sf_dir: P.runs(prices(spark, sf_dir), 200_000, 3),
    "profile_swings": lambda spark, sf_dir: P.peak_to_trough(prices(spark, sf_dir), 64).select("pos", F.round("swing", 2).alias("swing")),
    "schema_violations": lambda spark, sf_dir: R.validate(Tables(spark, sf_dir), CHECKED),
    "deleted_with_all": deleted,
    "rows_cleared": lambda spark, sf_dir: R.clear(TaggedStore(Tables(spark, sf_dir)))[1].filter(~F.col("table_name").isin("drafts", "field_provenance", "match_sources")),
}


class TaggedStore(DraftStore):
    def _player_tags(self):
        return self.t.player_tags


def rule(name: str, count: str) -> str:
    return f"SELECT '{name}' AS rule, ({count}) AS n"


RULES = [
    *(rule(f"{t}.{c} is given", f"SELECT count(*) FROM {t} WHERE {c} IS NULL") for t in CHECKED for c in R.REQUIRED.get(t, [])),
    *(rule(f"{t}.{c} is allowed", f"SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND NOT list_contains({values}, {c})") for (t, c), values in R.ALLOWED.items() if t in CHECKED),
    *(rule(f"{t}.{'+'.join(cs)} is unique", f"SELECT count(*) - count(DISTINCT {cs[0]}) FROM {t} WHERE {where} AND {cs[0]} IS NOT NULL") for t, cs, where in R.UNIQUE if t in CHECKED),
    *(rule(r.name, f"SELECT count(*) FROM {r.table} x WHERE {r.column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {r.to} y WHERE y.{r.key} = x.{r.column})") for r in R.REFERENCES if r.table in CHECKED and r.to in CHECKED),
]
SQL = {
    "glyph_matches": """, e AS (SELECT vec_id, CAST(label AS VARCHAR) AS name, [CAST(x AS DOUBLE) - list_avg(CAST(embedding AS DOUBLE[])) FOR x IN embedding] AS z FROM embeddings),
      u AS (SELECT vec_id, name, [x / sqrt(list_dot_product(z, z)) FOR x IN z] AS u FROM e), atlas AS (SELECT name, arg_min(u, vec_id) AS t FROM u GROUP BY 1),
      s AS (SELECT vec_id, atlas.name, list_dot_product(u, t) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(u, t) DESC, atlas.name DESC) AS n FROM u, atlas),
      p AS (SELECT vec_id, max(name) FILTER (n = 1) AS a, max(score) FILTER (n = 1) AS x, max(name) FILTER (n = 2) AS b, max(score) FILTER (n = 2) AS y FROM s WHERE n <= 2 GROUP BY 1)
      SELECT vec_id AS id, CASE WHEN x >= 0.8 THEN a END AS name, round(x, 5) AS score, CASE WHEN x >= 0.8 THEN b ELSE a END AS runner_up, round(coalesce(y, 0), 5) AS runner_score, x >= 0.8 AND x - coalesce(y, 0) >= 0.03 AS confident FROM p""",
    "boxes_read": """, b AS (SELECT l_orderkey AS crop, l_linenumber AS x, l_quantity AS h, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top, l_returnflag AS text, CAST(l_discount AS DOUBLE) AS confidence FROM lineitem)
      SELECT crop, coalesce(string_agg(text, '' ORDER BY x, text) FILTER (h >= 0.7 * top), '') AS text, min(confidence) FILTER (h >= 0.7 * top) AS confidence, count(*) FILTER (h < 0.7 * top) AS dropped FROM b GROUP BY crop""",
    "profile_runs": """, q AS (SELECT o_orderkey AS pos, CAST(o_totalprice AS DOUBLE) AS v FROM orders WHERE o_totalprice >= 200000), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (ORDER BY pos) <= 4 THEN 0 ELSE 1 END AS s FROM q),
      r AS (SELECT *, sum(s) OVER (ORDER BY pos) AS run FROM f) SELECT 0 AS series, min(pos) AS start, max(pos) AS "end", count(*) AS n, max(v) AS peak FROM r GROUP BY run""",
    "profile_swings": """, v AS (SELECT o_orderkey AS pos, CAST(o_totalprice AS DOUBLE) AS v FROM orders) SELECT pos, round(max(v) OVER w - min(v) OVER w, 2) AS swing FROM v WINDOW w AS (ORDER BY pos RANGE BETWEEN 63 PRECEDING AND CURRENT ROW)""",
    "schema_violations": ", ranks AS (SELECT unnest(range(1, 41)) AS id, 41 - unnest(range(1, 41)) AS ordinal), seasons(id, name) AS (VALUES (1, 'S1'), (2, 'S2'), (3, 'S3')) " + " UNION ALL ".join(RULES),
    "deleted_with_all": """, m AS (SELECT * FROM matches WHERE id % 4 <> 0 OR id % 8 = 0), k AS (SELECT id FROM m WHERE result <> 'draw'), r AS (SELECT * FROM match_players WHERE match_id IN (SELECT id FROM m)),
      n AS (SELECT 'matches' AS table_name, (SELECT count(*) FROM k) AS n UNION ALL SELECT 'match_players', (SELECT count(*) FROM r WHERE match_id IN (SELECT id FROM k)) UNION ALL SELECT 'match_bans', (SELECT count(*) FROM match_bans WHERE match_id IN (SELECT id FROM k))
      UNION ALL SELECT 'match_sources', (SELECT count(*) FROM k WHERE id % 16 = 0) UNION ALL SELECT 'field_provenance', (SELECT count(*) FROM k WHERE id % 5 = 0) + (SELECT count(*) FROM r WHERE id % 9 = 0 AND match_id IN (SELECT id FROM k))
      UNION ALL SELECT 'drafts', (SELECT count(*) FROM matches WHERE id % 4 = 0)) SELECT * FROM n""",
    "rows_cleared": """, m AS (SELECT * FROM matches WHERE id % 4 <> 0 OR id % 8 = 0), base AS (SELECT hero_id, hero_id * 3 + id % 5 AS phash FROM match_players WHERE match_id % 4 = 1 AND hero_id IS NOT NULL)
      SELECT 'matches' AS table_name, (SELECT count(*) FROM m) AS n UNION ALL SELECT 'match_players', (SELECT count(*) FROM match_players WHERE match_id IN (SELECT id FROM m)) UNION ALL SELECT 'match_bans', (SELECT count(*) FROM match_bans WHERE match_id IN (SELECT id FROM m))
      UNION ALL SELECT 'players', (SELECT count(*) FROM players) UNION ALL SELECT 'player_tags', (SELECT count(*) FROM (SELECT s_suppkey, s_suppkey % 7 FROM supplier WHERE s_suppkey % 7 < 6 UNION SELECT s_suppkey, 3 FROM supplier WHERE s_suppkey % 5 = 0))
      UNION ALL SELECT 'hero_portraits', (SELECT count(DISTINCT phash) FROM base) UNION ALL SELECT 'player_nameplates', (SELECT count(DISTINCT player_id * 10 + id % 4) FROM match_players WHERE match_id % 4 = 2 AND player_id IS NOT NULL)""",
}


def queries() -> dict:
    return dict(BUILD)


def oracle_sql() -> dict[str, str]:
    return {name: BASE.format(subject=ME) + body for name, body in SQL.items()}
