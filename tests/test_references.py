"""The registry of the schema's rules on small tables by hand."""

from types import SimpleNamespace

import pytest

from rivalscope.operators.references import ORDER, REFERENCES, Refused, clear, delete, validate
from rivalscope.sources.store import SCHEMAS


def tables(spark, **rows):
    made = {}
    for name, schema in SCHEMAS.items():
        cols = [c.strip().split(" ")[0] for c in schema.split(",")]
        made[name] = spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows.get(name, [])], schema)
    return SimpleNamespace(**made)


@pytest.fixture(scope="module")
def small(spark):
    return tables(
        spark, heroes=[{"id": 1, "name": "A", "role": "tank"}, {"id": 2, "name": "A", "role": "pilot"}], maps=[{"id": 1, "name": "M", "mode": None}], seasons=[{"id": 1, "name": "S"}],
        players=[{"id": 1, "display_name": "K"}, {"id": 2, "display_name": "L"}, {"id": 3, "display_name": None}],
        matches=[{"id": 10, "result": "win", "season_id": 1, "map_id": 1}, {"id": 11, "result": "won", "season_id": 7}, {"id": 12}],
        match_players=[{"id": 100, "match_id": 10, "team": "ally", "is_me": True, "player_id": 1, "hero_id": 1}, {"id": 101, "match_id": 10, "team": "ally", "is_me": True, "player_id": 2}, {"id": 102, "match_id": 11, "team": "us", "is_me": False, "player_id": 2}, {"id": 103, "match_id": 99, "team": "enemy", "is_me": True}],
        match_bans=[{"id": 1, "match_id": 10, "hero_id": 1}, {"id": 2, "match_id": 11, "hero_id": 2}], match_sources=[{"id": 1, "match_id": 10, "kind": "endgame_report"}], player_nameplates=[{"id": 1, "player_id": 1}, {"id": 2, "player_id": 2}],
        player_tags=[{"player_id": 2, "tag_code": "x"}, {"player_id": 2, "tag_code": "x"}], hero_portraits=[{"id": 1, "hero_id": 2, "phash": "f"}], drafts=[{"id": 1, "status": "committed", "committed_match_id": 10}, {"id": 2, "status": "open"}],
        field_provenance=[{"id": 1, "table_name": "matches", "row_id": 10}, {"id": 2, "table_name": "match_players", "row_id": 101}, {"id": 3, "table_name": "match_players", "row_id": 10}, {"id": 4, "table_name": "matches", "row_id": 102}],
    )


def test_validate(small):
    got = {x.rule: x.n for x in validate(small, [n for n in SCHEMAS if n != "settings"]).collect()}
    bad = {
        "heroes.name is unique": 1, "heroes.role is allowed": 1, "maps.mode is given": 1, "players.display_name is given": 1, "matches.result is given": 1, "matches.result is allowed": 1, "matches.season_id is in seasons": 1,
        "match_players.team is allowed": 1, "match_players.match_id is unique": 1, "match_players.match_id is in matches": 1, "player_tags.player_id+tag_code is unique": 1, "player_tags.tag_code is in tags": 2, "field_provenance.row_id is in matches": 1, "field_provenance.row_id is in match_players": 1,
    }
    assert {k: n for k, n in got.items() if n} == bad and len(got) > 40
    assert validate(small, ["maps"]).count() == 4 and {r.to for r in REFERENCES} <= set(ORDER)


def test_delete_goes_on_to_what_hangs_off(spark, small):
    ids = lambda df: sorted(x.id for x in df.collect())
    keys = spark.createDataFrame([(10,), (10,), (None,), (77,)], "k long")
    out = delete(small, "matches", keys)
    assert {k: ids(out[k]) for k in ("matches", "match_players", "match_bans", "match_sources", "field_provenance", "drafts")} == {"matches": [11, 12], "match_players": [102, 103], "match_bans": [2], "match_sources": [], "field_provenance": [3, 4], "drafts": [1, 2]}
    assert {x.id: x.committed_match_id for x in out["drafts"].collect()} == {1: None, 2: None} and "players" not in out
    assert {x.id: x.season_id for x in delete(small, "seasons", keys.selectExpr("1L AS id"))["matches"].collect()} == {10: None, 11: 7, 12: None}
    out = delete(small, "players", spark.createDataFrame([(3,)], "id long"))
    assert ids(out["players"]) == [1, 2] and ids(out["player_nameplates"]) == [1, 2]
    with pytest.raises(Refused, match="match_players.player_id is in players"):
        delete(small, "players", spark.createDataFrame([(2,)], "id long"))
    with pytest.raises(Refused):
        delete(small, "heroes", spark.createDataFrame([(1,)], "id long"))
    assert delete(small, "tags", spark.createDataFrame([("y",)], "code string"))["tags"].count() == 0
    with pytest.raises(Refused):
        delete(small, "tags", spark.createDataFrame([("x",)], "code string"))


def test_clear(small):
    out, counts = clear(small)
    assert all(df.count() == 0 for df in out.values()) and set(out) & {"heroes", "maps", "seasons", "tags", "settings"} == set()
    assert {x.table_name: x.n for x in counts.collect()} == {"field_provenance": 4, "match_bans": 2, "match_sources": 1, "match_players": 4, "player_nameplates": 2, "hero_portraits": 1, "player_tags": 2, "drafts": 2, "matches": 3, "players": 3}
