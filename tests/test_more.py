"""Lists, editing rules and committed drafts against SQL, and rules on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rivalscope.operators.editing import clock, portable, safe_stem, seconds_of
from rivalscope.operators.lists import confidence
from rivalscope.plans import documents, drafts, more, rules, streams

from .test_analytics import SF, value

TABLES = "region nation customer supplier part orders lineitem events documents embeddings"


@pytest.mark.parametrize(("module", "name"), [(m, n) for m in (drafts, more, rules, streams) for n in m.oracle_sql()] + [(documents, n) for n in ("draft_documents", "draft_rejects", "draft_lists", "whole_commit_sizes", "reopened_cells")])
def test_against_sql(spark, module, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = module.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({module.oracle_sql()[name]})").fetchall()
    assert sorted([value(r[c]) for c in cols] for r in got.collect()) == sorted([value(v) for v in r] for r in want)


def test_scalar_rules(spark):
    row = spark.range(1).select(
        safe_stem(F.lit("a b:c*" + "x" * 60)), safe_stem(F.lit("::")), clock(F.lit(605)), seconds_of(F.lit("10:05")), seconds_of(F.lit("10:65")), portable(F.lit("C:\\me\\data\\a\\b.png")),
        confidence(F.lit(0), 8), confidence(F.lit(8), 8), confidence(F.lit(9), 8), confidence(F.lit(0), 0), confidence(F.lit(1), 0),
    ).first()
    assert list(row) == ["a_bc" + "x" * 34, "shot", "10:05", 605, None, "data/a/b.png", 1.0, 0.5, 0.0, 1.0, 0.0]


def test_large_libraries_give_the_same_matches(spark, monkeypatch):
    from rivalscope.operators import identify, lists
    from rivalscope.sources.fixtures import Tables

    t = Tables(spark, SF)
    heroes, (seen, library) = identify.hero_identify(t).collect(), lists.signatures(t)
    plates = sorted(lists.plate_matches(seen, library).collect())
    monkeypatch.setattr(identify, "SMALL", 0)
    assert sorted(map(str, identify.hero_identify(t).collect())) == sorted(map(str, heroes))
    assert sorted(lists.plate_matches(seen, library).collect()) == plates
