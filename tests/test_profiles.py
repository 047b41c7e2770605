"""Runs with gaps and sliding swings against loops, with blocks of all sizes."""

import random

from rivalscope.operators import profiles


def brute_runs(rows, least, gap):
    out = []
    for s in sorted({r[0] for r in rows if r[0] is not None}):
        at = sorted((p, v) for x, p, v in rows if x == s and p is not None and v is not None and v >= least)
        run = []
        for p, v in at:
            if run and p - run[-1][0] > gap + 1:
                out.append((s, run[0][0], run[-1][0], len(run), max(x for _, x in run)))
                run = []
            run.append((p, v))
        if run:
            out.append((s, run[0][0], run[-1][0], len(run), max(x for _, x in run)))
    return sorted(out)


def test_runs_and_swings(spark, monkeypatch):
    r = random.Random(8)
    rows = [(0, p, float(r.randint(0, 9))) for p in range(-40, 400) if r.random() < 0.8] + [(s, r.randint(0, 60), float(r.randint(0, 9))) for s in (1, 2) for _ in range(40)]
    rows += [(3, 5, 1.0), (4, None, 9.0), (None, 4, 9.0), (5, 7, None), (6, 7, 9.0), (6, 7, 9.0)]
    df = spark.createDataFrame(rows, "series long, pos long, value double")
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(profiles, "BLOCK", block)
        for gap in (0, 3):
            got = sorted((x.series, x.start, x.end, x.n, x.peak) for x in profiles.runs(df, 6, gap).collect())
            assert got == brute_runs(rows, 6, gap) and len(got) > 20
        for width in (1, 12):
            got = sorted((x.series, x.pos, x.value, x.swing) for x in profiles.peak_to_trough(df, width).collect())
            full = [x for x in rows if None not in x]
            assert got == sorted((s, p, v, max(w := [y for x, q, y in full if x == s and p - width < q <= p]) - min(w)) for s, p, v in full)
    assert profiles.runs(df.limit(0), 6).count() == profiles.peak_to_trough(df.limit(0), 3).count() == 0


def test_rows_are_written_before_they_are_dealt_by_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from rivalscope.operators import running as R
    from rivalscope.shared import scratch

    write, plans = R.materialize, {}
    monkeypatch.setattr(R, "materialize", lambda df, name, keep=False: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, name, keep))
    rows = spark.range(40).selectExpr("id % 3 AS s", "id").dropDuplicates(["id"])
    with scratch(spark):
        got = R.running(rows, ["s"], ["id"], {"n": F.lit(1)}).collect()
    assert {(x.s, x.id, x.n) for x in got} == {(i % 3, i, i // 3 + 1) for i in range(40)}
    assert "Aggregate" not in plans["ranged"]  # what is dealt is read, not made twice
