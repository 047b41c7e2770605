"""Drafts as documents, commits as a whole, reopening and publication, on a small store by hand."""

import json

import pytest
from pyspark.sql import functions as F

from rivalscope.operators.publishing import commit, commit_store, reopen_store
from rivalscope.shared import scratch
from rivalscope.sources import documents as D
from rivalscope.sources.store import SCHEMAS, Store


def cell(value=None, source="manual", origin="manual", confidence=1.0):
    return {"value": value, "source": source, "origin": origin, "confidence": confidence}


def read(value):
    return cell(value, "template", "endgame_report", 0.8)


def row(team, index, me=False, **more):
    out = {"team": team, "row_index": index, "is_me": me, **dict.fromkeys(D.PASSED), **{k: cell() for k in D.CELLS}}
    return out | more


def payload(result="win", rows=(), editing=None, **more):
    meta = {k: cell() for k in D.META} | {"result": cell(result)} | more.pop("meta", {})
    return {"editing_match_id": editing, "meta": meta, "rows": list(rows), "bans": [], "files": [], "conflicts": [], "superseded": []} | more


CONFLICT = [{"path": "meta.mode", "mine": "a", "theirs": "b", "theirs_origin": None, "theirs_confidence": None}]


def drafts(spark, docs):
    rows = [(i, "t0", "t0", "open", x if x is None or isinstance(x, str) else json.dumps(x), None) for i, x in docs.items()]
    return spark.createDataFrame(rows, SCHEMAS["drafts"])


def test_documents_round_trip_and_rejects(spark):
    full = payload(rows=[row("ally", 0, True, player_name=read("Ana"), damage=read(12)), row("enemy", 0, portrait_phash="ff", nameplate_width=20)], editing=4, bans=[{"hero_id": 2, "slot_index": 1}, {"hero_id": None, "slot_index": 0}],
        files=[{"path": "a/b.png", "sha256": "00", "kind": "endgame_report", "ingested_at": None}], superseded=[{"path": "meta.mode", "value": "x"}], conflicts=[{"path": "meta.mode", "mine": "a", "theirs": "b", "theirs_origin": None, "theirs_confidence": 0.5}])
    wrong = payload(rows=[row("ally", 0, damage=read("1O"))])
    docs = {1: full, 2: "{oops", 3: None, 4: "[]", 5: "{}", 6: payload(rows=[row("ally", 0)] * 2), 7: wrong, 8: {"meta": {}, "rows": []}, 9: {"meta": {}}, 10: "", 11: {"meta": 3, "rows": []}, 12: payload(rows=[row("ally", 0, damage=read(" 12 "))])}
    got = D.parse(drafts(spark, docs))
    assert {x.draft_id: x.reason.split(":")[0] for x in got.rejects.collect()} == {k: "not a JSON object of this shape" for k in (2, 3, 4, 10, 11)} | {5: "no meta", 6: "two rows of one seat", 7: "not a number", 9: "no rows"}
    built = D.build(got)
    assert json.loads(built.filter("draft_id = 1").first().payload) == full
    again = D.parse(built.select(F.col("draft_id").alias("id"), "payload"))
    assert D.same(again, D.Documents(**{**got.__dict__, "rejects": got.rejects.limit(0)}))
    assert {(x.draft_id, x.path, x.value) for x in D.cells(got).collect()} >= {(1, "rows[ally:0].damage", "12"), (12, "rows[ally:0].damage", "12"), (1, "meta.result", "win")}
    assert D.parse(drafts(spark, {})).meta.count() == 0 and D.build(D.parse(drafts(spark, {}))).count() == 0


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    tables = {
        "heroes": [(1, "Ana", "support"), (2, "Mei", "damage")], "maps": [(1, "Oasis", "control")], "seasons": [(1, "One", "2024-01-01", "2024-06-30", None, None), (2, "Two", "2024-07-01", None, None, None)],
        "players": [(1, "Kim", "t", "t", 5, "note", None), (2, "Lee", "t", "t", 1, None, None)],
        "matches": [(10, "2024-02-01T10:00", 1, None, "loss", 5, 300, None, None, "old", "c", 1), (11, "2024-02-02T10:00", None, None, "win", None, None, None, None, None, "c", 1)],
        "match_players": [(100, 10, 1, "ally", True, None, 1, 1, 2, 3, 4, 5, 6, 0), (101, 10, 2, "enemy", False, None, 2, 1, 2, 3, 4, 5, 6, 0), (102, 10, 2, "enemy", False, None, 2, 1, 2, 3, 4, 5, 6, 1), (103, 11, None, "ally", True, None, None, *[None] * 6, 0)],
        "match_bans": [(1, 10, 2, 0)], "field_provenance": [(1, "match_players", 100, "damage", "template", 0.5, None), (2, "matches", 10, "mode", "template", 0.5, None), (3, "matches", 11, "mode", "template", 0.5, None), (4, "match_players", 10, "role", "template", 0.5, None)],
        "hero_portraits": [(1, 1, "aa", "t", 3)], "player_nameplates": [(1, 1, "p1", 30, "t", 2)],
    }
    for name, rows in tables.items():
        s.write(name, spark.createDataFrame(rows, SCHEMAS[name]))
    docs = {
        1: payload("win", [row("ally", 0, True, player_name=read(" Kim "), hero_id=read(1), damage=read(9), portrait_phash="bb", nameplate_phash="p1"), row("ally", 1, player_name=cell("New"), hero_id=cell(2), portrait_phash="aa"), row("enemy", 0, player_name=cell("New")), row("enemy", 1)],
            meta={"played_at": cell("2024-08-01T00:00"), "map_id": read(1)}, bans=[{"hero_id": 1, "slot_index": 0}, {"hero_id": None, "slot_index": 1}], files=[{"path": "drafts/1/x.png", "sha256": "ab", "kind": "endgame_report", "ingested_at": None}],
            superseded=[{"path": "rows[ally:0].damage", "value": "7"}, {"path": "rows[ally:0].damage", "value": "8"}, {"path": "meta.map_id", "value": "3"}]),
        2: payload("draw", [row("ally", 0, True, player_name=cell("Lee"), player_id=1)], editing=10),
        3: payload("", []), 4: payload("won", [row("ally", 0, role=cell("tank"))]), 5: payload("win", [row("ally", 0, True), row("ally", 1, True)]), 6: payload("win", editing=99), 7: payload("win", editing=10, conflicts=CONFLICT), 8: "{",
        9: payload("win", [row("ally", 0, True, player_id=77, hero_id=cell(8))], meta={"map_id": cell(5)}), 12: payload("win", conflicts=CONFLICT),
    }
    s.write("drafts", drafts(spark, docs).union(spark.createDataFrame([(20, "t", "t", "committed", json.dumps(payload("win")), 11)], SCHEMAS["drafts"])))
    return s


def test_commit_reopen_commit(spark, store):
    assert store.version() == 0 and store.match_sources.count() == 0
    refused = commit_store(store, "NOW")
    assert {(x.draft_id, x.problem) for x in refused.collect()} == {
        (3, "no result"), (4, "unknown result"), (4, "no own row"), (5, "several own rows"), (6, "match is gone"), (7, "edited by an earlier draft"), (7, "open conflicts"), (8, "not a JSON object of this shape"), (9, "unknown player"), (9, "unknown hero"), (9, "unknown map"), (12, "open conflicts")}
    m = {x.id: x for x in store.matches.collect()}
    assert set(m) == {10, 11, 12} and store.version() == 1
    assert (m[12].played_at, m[12].season_id, m[12].team_size, m[12].map_id, m[12].created_at) == ("2024-08-01T00:00", 2, 2, 1, "NOW")
    assert (m[10].result, m[10].played_at, m[10].season_id, m[10].team_size, m[10].notes, m[10].created_at) == ("draw", "NOW", None, 1, None, "c") and m[11].result == "win"
    roster = {(x.match_id, x.team, x.row_index): x for x in store.match_players.collect()}
    assert {k: x.player_id for k, x in roster.items()} == {(11, "ally", 0): None, (12, "ally", 0): 1, (12, "ally", 1): 3, (12, "enemy", 0): 3, (10, "ally", 0): 1}
    assert min(x.id for k, x in roster.items() if k[0] != 11) > 103 and len({x.id for x in roster.values()}) == 5 and roster[12, "ally", 0].damage == 9
    # counters: given back for match 10, then one for each row
    assert {x.display_name: (x.id, x.games_seen, x.first_seen, x.last_seen) for x in store.players.collect()} == {"Kim": (1, 6, "t", "NOW"), "Lee": (2, 0, "t", "t"), "New": (3, 2, "NOW", "NOW")}
    assert {(x.match_id, x.hero_id) for x in store.match_bans.collect()} == {(12, 1)}
    own = roster[12, "ally", 0].id
    traced = {(x.table_name, x.row_id, x.column_name): (x.confidence, x.superseded_value) for x in store.field_provenance.collect()}
    assert traced == {("matches", 11, "mode"): (0.5, None), ("match_players", 10, "role"): (0.5, None), ("matches", 12, "map_id"): (0.8, "3"), ("match_players", own, "player_name"): (0.8, None), ("match_players", own, "hero_id"): (0.8, None), ("match_players", own, "damage"): (0.8, "8")}
    assert [(x.match_id, x.file_path, x.file_sha256, x.ingested_at) for x in store.match_sources.collect()] == [(12, "screenshots/12/x.png", "ab", "NOW")]
    assert {(x.player_id, x.phash): x.times_matched for x in store.player_nameplates.collect()} == {(1, "p1"): 3}
    assert {(x.hero_id, x.phash): x.times_matched for x in store.hero_portraits.collect()} == {(1, "aa"): 3, (1, "bb"): 1}  # "aa" is another hero's
    assert {x.id: (x.status, x.committed_match_id) for x in store.drafts.collect() if x.status != "open"} == {1: ("committed", 12), 2: ("committed", 10), 20: ("committed", 11)}
    # again: nothing is committed twice
    before = {n: sorted(map(str, store.read(n).collect())) for n in SCHEMAS}
    commit_store(store, "LATER")
    assert {n: sorted(map(str, store.read(n).collect())) for n in SCHEMAS} == before and store.version() == 2

    reopen_store(store, [12, 12, 10, 500], "NOW2")  # 10 has an open draft (7) that edits it
    new = store.drafts.filter("created_at = 'NOW2'").collect()
    assert [(x.id, x.status) for x in new] == [(21, "open")]
    doc = json.loads(new[0].payload)
    assert doc["editing_match_id"] == 12 and [(r["team"], r["row_index"], r["is_me"], r["player_name"]["value"], r["player_id"]) for r in doc["rows"]] == [("ally", 0, True, "Kim", None), ("ally", 1, False, "New", None), ("enemy", 0, False, "New", None), ("enemy", 1, False, None, None)]
    assert doc["meta"]["map_id"] == cell(1) and doc["bans"] == [{"hero_id": 1, "slot_index": 0}] and doc["files"] == []
    reopen_store(store, [12], "NOW3")
    assert store.drafts.filter("created_at = 'NOW3'").count() == 0
    commit_store(store, "NOW4", ids=[21])
    after = {(x.match_id, x.team, x.row_index): (x.player_id, x.hero_id, x.damage, x.is_me) for x in store.match_players.collect()}
    assert after == {k: (x.player_id, x.hero_id, x.damage, x.is_me) for k, x in roster.items()}
    assert {x.display_name: x.games_seen for x in store.players.collect()} == {"Kim": 6, "Lee": 0, "New": 2}
    assert [x.file_path for x in store.match_sources.collect()] == ["screenshots/12/x.png"] and store.field_provenance.count() == 2
    assert {x.id: x.season_id for x in store.matches.collect()} == {10: None, 11: 1, 12: 2}


def test_publication_is_whole_or_nothing(spark, store):
    fail = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        store.publish({"heroes": spark.createDataFrame([], SCHEMAS["heroes"]), "maps": fail})
    assert store.version() == 0 and store.heroes.count() == 2
    with scratch(spark):
        tables = commit(store, "NOW").tables
        store.publish({"maps": store.maps})
        with pytest.raises(RuntimeError):
            store.publish(tables, after=0)
    assert store.version() == 1 and store.matches.count() == 2
    empty = Store(spark, store.folder + "/none")
    assert commit_store(empty, "NOW").count() == 0 and empty.matches.count() == 0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_read_once_and_built_in_one_grouping(spark):
    docs = D.parse(drafts(spark, {1: payload(rows=[row("ally", 0, True)]), 2: payload("loss"), 3: "{"}))
    assert all("from_json" not in plan(x) for x in (docs.meta, docs.rows, docs.bans, docs.superseded, docs.rejects))
    built = D.build(docs)
    assert "Join" not in plan(built) and plan(built).count("Aggregate [") == 1
    assert {x.draft_id: len(json.loads(x.payload)["rows"]) for x in built.collect()} == {1: 1, 2: 0}
    # rows of a draft that isn't there make no document
    docs.meta = docs.meta.filter("draft_id = 2")
    assert [x.draft_id for x in D.build(docs).collect()] == [2]


def test_a_commit_makes_only_what_is_asked_for(spark, store):
    with scratch(spark):
        whole, part = commit(store, "N"), commit(store, "N", only=["drafts"])
        assert "match_players" in whole.tables and not {"match_players", "players", "field_provenance"} & set(part.tables)
        assert sorted(map(str, part.tables["drafts"].collect())) == sorted(map(str, whole.tables["drafts"].collect()))


def test_fixture_tables_are_written_once(spark):
    from rivalscope.sources.fixtures import Tables

    sf = "/root/testdata/sf0.001"
    with scratch(spark):
        t = Tables(spark, sf).written("match_players")
        assert "Window" not in plan(t.match_players)
        assert t.match_players.exceptAll(Tables(spark, sf).match_players).isEmpty() and t.match_players.count() == Tables(spark, sf).match_players.count()


def test_rows_of_documents_are_columns_and_a_commit_reads_few_of_them(spark, store):
    docs = D.parse(drafts(spark, {1: payload(rows=[row("ally", 0, True), row("enemy", 0, hero_id=read(3))], bans=[{"hero_id": 2, "slot_index": 1}]), 2: payload("loss"), 3: "{"}))
    assert "Generate" not in plan(docs.rows) and "withfield" not in plan(docs.rows).lower()
    assert sorted((x.draft_id, x.place, x.team, x.hero_id.value) for x in docs.rows.collect()) == [(1, 0, "ally", None), (1, 1, "enemy", 3)]
    assert sorted(x.draft_id for x in docs.meta.collect()) == [1, 2] and docs.bans.count() == 1 and [x.draft_id for x in docs.rejects.collect()] == [3]
    with scratch(spark):
        assert not commit(store, "N", only=["refused"]).tables
        part, whole = (commit(store, "N", only=only).tables["field_provenance"] for only in (["field_provenance"], None))
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))


def test_rosters_and_bans_come_from_one_numbering(spark):
    from rivalscope.sources.fixtures import Tables

    sf = "/root/testdata/sf0.001"
    with scratch(spark):
        t = Tables(spark, sf).written("lines")
        assert "Window" not in plan(t.match_players) + plan(t.match_bans)
        assert t.match_bans.exceptAll(Tables(spark, sf).match_bans).isEmpty() and t.match_bans.count() == Tables(spark, sf).match_bans.count()


def test_documents_are_read_by_type_and_written_as_far_as_asked_for(spark):
    odd = [read("12"), read(" 12 "), read(""), read(None), read(12.5), read(10**20), read(True), read({"a": 1})]
    docs = {i: payload(rows=[row("ally", 0, damage=x, role=cell(3))]) for i, x in enumerate(odd)} | {20: payload(rows=[row("ally", 0, damage=read(7)), None]), 21: json.dumps(payload(meta={"map_id": read(4)}))[:-1], 22: payload(meta={"map_id": read("x")})}
    got = D.parse(drafts(spark, docs))
    assert {x.draft_id: x.reason for x in got.rejects.collect()} == {4: "not a number: damage", 5: "not a number: damage", 6: "not a number: damage", 7: "not a number: damage", 21: "not a JSON object of this shape", 22: "not a number: map_id"}
    assert {(x.draft_id, x.place): (x.damage and x.damage.value, x.role and x.role.value) for x in got.rows.collect()} == {(0, 0): (12, "3"), (1, 0): (12, "3"), (2, 0): (None, "3"), (3, 0): (None, "3"), (20, 0): (7, None), (20, 1): (None, None)}
    few = D.parse(drafts(spark, docs), parts=["value"], passed=["player_id"])
    assert few.rows.schema["damage"].dataType.names == ["value"] and "portrait_phash" not in few.rows.columns
    assert sorted((x.draft_id, x.place, x.damage and x.damage.value) for x in few.rows.collect()) == sorted((x.draft_id, x.place, x.damage and x.damage.value) for x in got.rows.collect())


def test_documents_are_built_and_read_by_as_many_tasks_as_there_are_partitions(spark):
    docs = D.parse(drafts(spark, {i: payload("loss") for i in range(40)}))
    assert D.build(docs).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.fixture
def written(monkeypatch):
    """The tables that a commit writes on its way, in order."""
    from rivalscope import shared
    from rivalscope.operators import publishing

    out, whole = [], shared.materialize

    def note(df, name, keep=False):
        out.append((name, df))
        return whole(df, name, keep)

    for module in (shared, D, publishing):
        monkeypatch.setattr(module, "materialize", note)
    return out


def test_provenance_needs_no_players_and_is_numbered_by_draft_and_path(spark, store, written):
    with scratch(spark):
        got = commit(store, "N", only=["field_provenance"]).tables["field_provenance"].collect()
        assert [name for name, _ in written] == ["parsed", "rows-of-drafts", "refused", "ranged", "committed-drafts"]
        new = sorted((x for x in got if x.id > 4), key=lambda x: x.id)
        rows = {(x.team, x.row_index): x.id for x in commit(store, "N").tables["match_players"].filter("match_id = 12").collect()}
    own = rows["ally", 0]
    assert [(x.id, x.table_name, x.row_id, x.column_name, x.confidence, x.superseded_value) for x in new] == [
        (5, "matches", 12, "map_id", 0.8, "3"), (6, "match_players", own, "damage", 0.8, "8"), (7, "match_players", own, "hero_id", 0.8, None), (8, "match_players", own, "player_name", 0.8, None)]


def test_a_replaced_value_without_a_path_or_value_is_no_fault(spark, store):
    lost = [{"path": None, "value": "1"}, {"path": "meta.mode", "value": None}, {"path": "meta.map_id", "value": "5"}, {"path": "meta.map_id", "value": "6"}]
    odd = {30: payload("win", [row("ally", 0, True, hero_id=cell(1, "template", None, None))], meta={"map_id": read(1), "mode": read("x")}, superseded=lost), 31: payload("loss", meta={"notes": read(" ")}), 32: payload("loss")}
    store.publish({"drafts": drafts(spark, odd)})
    with scratch(spark):
        got = [x for x in commit(store, "N", only=["field_provenance"]).tables["field_provenance"].collect() if x.id > 4]
    assert sorted((x.id, x.column_name, x.confidence, x.superseded_value) for x in got) == [(5, "map_id", 0.8, "6"), (6, "mode", 0.8, None), (7, "hero_id", None, None)]


def test_a_whole_commit_writes_only_values_and_one_table_of_numbers(spark, store, written):
    with scratch(spark):
        commit(store, "N")
        names = [name for name, _ in written]
        parsed = written[0][1]
    assert names[:6] == ["parsed", "rows-of-drafts", "refused", "ranged", "committed-drafts", "committed-rows"] and "traced" not in names
    assert parsed.schema["damage"].dataType.names == parsed.schema["mode"].dataType.names == ["value"] and {"filled", "row_told", "told"} <= set(parsed.columns)


def test_text_that_nobody_asks_for_is_passed_over_but_judged_alike(spark):
    base = row("ally", 0, damage=cell(3, 7, {"a": 1}, 0.5), portrait_crop=9)
    docs = {1: payload(rows=[base]), 2: payload(rows=[base | {"nameplate_confidence": "x"}]), 3: payload(rows=[base | {"damage": cell(3, "a", "b", "sure")}]), 4: json.dumps(payload(rows=[base]))[:-30]}
    whole = D.parse(drafts(spark, docs))
    few = D.parse(drafts(spark, docs), parts=["value"], passed=["player_id"], cells=["damage"], of_row={"twice": lambda r: r["damage"]["value"] * 2})
    judged = lambda d: {(x.draft_id, x.reason) for x in d.rejects.collect()}
    assert judged(whole) == judged(few) == {(k, "not a JSON object of this shape") for k in (2, 3, 4)}
    assert few.rows.columns == ["draft_id", "place", "team", "row_index", "is_me", "player_id", "damage", "twice"] and few.rows.first().twice == 6
    assert "portrait_crop" not in D.payload_type(True, ["value"], []) and "nameplate_confidence" in D.payload_type(True, ["value"], [])
