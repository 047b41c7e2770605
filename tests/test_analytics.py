import math

import duckdb
import pytest

from rivalscope.functions.scores import kind_guess, name_clean, outcome, wilson
from rivalscope.operators.identify import identify
from rivalscope.operators.merging import merge_cells
from rivalscope.operators.names import snap
from rivalscope.plans import catalogue, oracle
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ADDED = ["tagged_trends", "tagged_series", "streak_current", "player_hero_counts", "player_averages", "season_reassign", "season_clashes", "typed_settings", "team_sizes", "reference_lists", "learned_counts", "name_suggestions"]


def test_outcome(spark):
    rows = [(r, t) for r in ("win", "loss", "draw") for t in ("ally", "enemy")]
    got = {(x.r, x.t): x.o for x in spark.createDataFrame(rows, "r string, t string").withColumn("o", outcome(F.col("r"), F.col("t"))).collect()}
    assert got == {("win", "ally"): "win", ("win", "enemy"): "loss", ("loss", "ally"): "loss", ("loss", "enemy"): "win", ("draw", "ally"): "draw", ("draw", "enemy"): "draw"}


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (27, 13), (0, 1)], "w long, l long")
    low = [r.x for r in df.select(wilson(F.col("w"), F.col("l"), True).alias("x")).collect()]
    assert low[0] == 0.0 and math.isclose(low[1], 0.342, abs_tol=5e-4) and math.isclose(low[2], 0.520, abs_tol=5e-4) and low[3] == 0.0
    assert df.select(wilson(F.col("w"), F.col("l"), False).alias("x")).first().x == 1.0


def test_text(spark):
    row = spark.createDataFrame([("My Tab_1!é",)], "s string").select(name_clean(F.col("s")).alias("c"), kind_guess(F.col("s")).alias("k")).first()
    assert row.c == "MYTAB_1É" and row.k == "in_game_scoreboard"


def value(v):
    if v is None or v != v:
        return "-"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["by_map", "by_ally", "by_opponent_hero", "bans", "comp_shapes", "comp_unclassified", "hero_pairs", "wilson_by_map", "trend_points", "streak_longest", "players_tags", "filter_teammate", "filter_unassigned", "totals_me", "exact_comps", "merge_drafts", "games_seen", "integrity", "match_cells", "hero_identify", *ADDED])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({oracle.oracle_sql()[name]})").fetchall()
    assert sorted([value(r[c]) for c in cols] for r in got.collect()) == sorted([value(v) for v in r] for r in want)


@pytest.mark.parametrize("name", ["trend_points_me", "streak_longest_me", "tagged_trends_me", "tagged_series_me", "streak_current_me"])
def test_operator_as_subject(spark, name):
    test_against_sql(spark, name)


def test_streaks_and_trend_of_operator(spark):
    """Small tables, by hand: the operator's rows count whether or not they name a player."""
    from types import SimpleNamespace

    from rivalscope.operators import breakdowns as B, history

    results = "win win loss draw loss loss loss win".split()
    t = SimpleNamespace(
        matches=spark.createDataFrame([(i, f"2024-01-{i:02}", r) for i, r in enumerate(results, 1)], "id long, played_at string, result string"),
        match_players=spark.createDataFrame([(100 + i, i, None if i % 2 else 5, "ally", True) for i in range(1, 9)] + [(200 + i, i, 5, "enemy", False) for i in range(1, 9)], "id long, match_id long, player_id long, team string, is_me boolean"),
    )
    assert [tuple(r)[1:] for r in B.longest_streaks(t, own=True).collect()] == [(2, 3)]
    assert [tuple(r)[1:] for r in history.current_streaks(t, own=True).collect()] == [("win", 1)]
    got = sorted((r.x, r.match_id, r.cumulative, r.rolling, r.n) for r in B.trends(t, 3, own=True).collect())
    wins = [r == "win" for r in results]
    assert got == [(i, i, round(sum(wins[:i]) / i, 6), round(sum(wins[max(0, i - 3) : i]) / min(i, 3), 6), min(i, 3)) for i in range(1, 9)]
    assert [tuple(r) for r in B.longest_streaks(t).collect()] == [(5, 3, 2)]


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(oracle.oracle_sql())


def test_merge_cells(spark):
    cells = [(1, "a", "x", "in_game_scoreboard"), (2, "a", "x", "endgame_report"), (3, "a", "y", "endgame_report"), (4, "a", "z", "manual"), (5, "a", "w", "endgame_report"), (6, "a", "q", "name_suggestion"), (7, "a", None, "manual"), (1, "b", " ", None), (1, "c", "u", None), (2, "c", "v", None)]
    got = {r.k: tuple(r)[1:] for r in merge_cells(spark.createDataFrame(cells, "seq long, k string, value string, origin string"), ["k"]).collect()}
    assert got == {"a": ("z", "manual", 1, 2), "c": ("u", None, 0, 1)}


def test_merge_cells_by_source(spark):
    """A typed value stays whatever its origin; one that a template read is outranked."""
    cells = [(1, "a", "x", "in_game_scoreboard", "manual"), (2, "a", "y", "endgame_report", "template"), (1, "b", "x", "in_game_scoreboard", "template"), (2, "b", "y", "endgame_report", "template"), (1, "c", "x", "endgame_report", "template"), (2, "c", "y", None, "manual")]
    got = {r.k: tuple(r)[1:] for r in merge_cells(spark.createDataFrame(cells, "seq long, k string, value string, origin string, source string"), ["k"]).collect()}
    assert got == {"a": ("x", "in_game_scoreboard", 1, 0), "b": ("y", "endgame_report", 0, 1), "c": ("x", "endgame_report", 0, 1)}


def test_identify(spark):
    lib = spark.createDataFrame([(1, 0), (2, -1), (3, 2**9 - 1)], "owner long, hash long")
    cand = spark.createDataFrame([(1, 0), (2, 2**4 - 1), (3, -(2**63)), (4, 2**30 - 1), (5, -(2**9))], "id long, hash long")
    assert {r.id: (r.status, r.owner, r.distance) for r in identify(cand, lib).collect()} == {1: ("match", 1, 0), 2: ("ambiguous", None, 4), 3: ("match", 1, 1), 4: ("none", None, None), 5: ("none", None, None)}


def test_snap_against_all_pairs(spark):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    word = lambda lo, hi: "".join(rng.choice("ABC") for _ in range(rng.randint(lo, hi)))
    roster, texts = [(i, word(1, 9)) for i in range(25)], [(i, word(0, 11)) for i in range(300)]
    want = {}
    for i, text in texts:
        forms = [text, text[1:], text[2:]] if len(text) > 5 else [text]
        near = sorted((min(edits(f, name) for f in forms), owner) for owner, name in roster)
        found = len(text) >= 4 and near[0][0] <= 2 and near[1][0] > near[0][0]
        want[i] = (near[0][1], near[0][0]) if found else (None, None)
    got = snap(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(roster, "owner long, name string"))
    assert {r.id: (r.owner, r.distance) for r in got.collect()} == want and len({v for v in want.values()}) > 5
