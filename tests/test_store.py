"""Operators on a user's own tables."""

import tempfile

import pytest

from rivalscope.operators import breakdowns as B
from rivalscope.operators.subject import Filters, subject_matches
from rivalscope.sources.fixtures import Tables
from rivalscope.sources.store import SCHEMAS, Store, seed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_same_results_as_from_the_fixture(spark, form):
    t = Tables(spark, SF)
    store = Store(spark, tempfile.mkdtemp(prefix="store-", dir="/tmp"), form)
    for name in ("heroes", "maps", "players", "matches", "match_players", "match_bans"):
        store.write(name, getattr(t, name))
    assert [f.name for f in store.matches.schema] == [c.strip().split(" ")[0] for c in SCHEMAS["matches"].split(",")]
    for filters in (None, Filters(mode="escort", date_from="1994-01-01")):
        for f in (lambda x: B.by(subject_matches(x, 3, filters), "map"), lambda x: B.by_player(subject_matches(x, None, filters), x, True)):
            assert sorted(map(str, f(t).collect())) == sorted(map(str, f(store).collect()))
    with pytest.raises(AttributeError):
        store.nothing


def test_seeding_twice_changes_nothing(spark):
    held = spark.createDataFrame([(1, "A", "tank")], SCHEMAS["heroes"])
    offered = spark.createDataFrame([(1, "A", "damage"), (2, "B", "support"), (3, "B", "support")], SCHEMAS["heroes"])
    once = seed(held, offered, "name")
    assert sorted((r.name, r.role) for r in once.collect()) == [("A", "tank"), ("B", "support")]
    assert sorted((r.name, r.role) for r in seed(once, offered, "name").collect()) == [("A", "tank"), ("B", "support")]
