"""Correlation and boxes against loops."""

import random

import numpy as np

from rivalscope.operators import glyphs


def test_correlate(spark, monkeypatch):
    r = np.random.default_rng(5)
    atlas = [(f"g{k}", r.normal(size=12).tolist()) for k in range(9)] + [("flat", [1.0] * 12), ("twin", None), ("g8copy", None)]
    atlas = [(n, v if v else atlas[8][1]) for n, v in atlas]
    seen = [(k, (np.array(atlas[k % 9][1]) * 3 + 5 + r.normal(size=12) * r.choice([0.1, 0.8, 3])).tolist()) for k in range(40)] + [(90, [2.0] * 12), (91, None), (92, [])]

    def brute(v):
        def flat(x):
            return np.array(x) - np.mean(x)

        found = sorted(((0.0 if not (d := np.linalg.norm(flat(v)) * np.linalg.norm(flat(t))) else float(flat(v) @ flat(t) / d), n) for n, t in atlas), reverse=True) if v else [(0.0, None)] * 2
        (a, x), (b, y) = found[:2]
        return (x if a >= 0.8 else None, round(a, 6), y if a >= 0.8 else x, round(b, 6), bool(a >= 0.8 and a - b >= 0.03))

    want = {k: brute(v) for k, v in seen}
    for block in (256, 2):
        monkeypatch.setattr(glyphs, "BLOCK", block)
        got = glyphs.correlate(spark.createDataFrame(seen, "id long, v array<double>"), spark.createDataFrame(atlas, "name string, v array<double>")).collect()
        clear = {x.id: (x.name, round(x.score, 6), x.runner_up, round(x.runner_score, 6), x.confident) for x in got if x.id < 90 and x.id % 9 != 8}
        assert clear == {k: w for k, w in want.items() if k in clear} and len(clear) > 30 and {x[4] for x in clear.values()} == {True, False}
        rest = {x.id: x for x in got}
        assert all(rest[k].name is None and rest[k].score == 0 and not rest[k].confident for k in (90, 91, 92)) and not any(rest[k].confident for k in range(8, 40, 9))
    assert {x.name for x in glyphs.correlate(spark.createDataFrame(seen, "id long, v array<double>"), spark.createDataFrame([], "name string, v array<double>")).collect()} == {None}


def test_read_boxes(spark):
    r = random.Random(2)
    rows = [(r.randint(1, 6), r.choice([0.0, 1.5, 3.0, 7.0]), r.choice([10.0, 14.0, 20.0]), r.choice("abc"), r.random()) for _ in range(60)] + [(7, None, 9.0, "x", 1.0), (8, 1.0, 9.0, "x", None), (None, 1.0, 9.0, "x", 1.0)]
    got = {x.crop: (x.text, x.confidence, x.dropped) for x in glyphs.read_boxes(spark.createDataFrame(rows, "crop long, x double, height double, text string, confidence double")).collect()}
    want = {}
    for c in range(1, 7):
        mine = [b for b in rows if b[0] == c]
        top = max(b[2] for b in mine)
        kept = sorted((b[1], b[3], b[4]) for b in mine if b[2] >= 0.7 * top)
        want[c] = ("".join(b[1] for b in kept), min(b[2] for b in kept), len(mine) - len(kept))
    assert got == want | {8: ("x", None, 0)}
