"""Spelling variants, ranked search and mixing against brute force, and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from .conftest import EDGE, docs


def edits(w, letters):
    """All strings one edit away."""
    out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def brute_spellings(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    letters = {c for w in n for c in w}
    near = {w: sorted(edits(w, letters) & n.keys(), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_spellings(spk):
    from rivalscope.llm.spelling import group_spellings

    for seed, letters in ((1, "ab"), (2, "abcé"), (3, "aÿ÷×Z")):
        r = random.Random(seed)
        stems = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(12)] + ["aaaaa", "aaaaaa", "Émile", "émile"]
        pool = [s for s in stems for _ in range(r.choice([1, 5, 30]))]
        for s in stems:
            pool += [x for x in r.sample(sorted(edits(s, letters)), 6) for _ in range(r.choice([1, 3, 4]))]
        pool += ["aaaaa" * 60, "x" * 400, "x" * 401] * 3
        rows = [(i, " 1.".join(r.sample(pool, 80))) for i in range(60)] + EDGE + [(None, "aaaab aaaab"), (7, "aaaab Ａaaab"), (7, "aaaab Ａaaab")]
        got = group_spellings(docs(spk, rows)).collect()
        assert {tuple(x) for x in got} == brute_spellings(rows) and len(got) == len({x.word for x in got}) > 20
    # a chain of forms, and a form that many words share
    chain = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("abbbb", 48), *((f"abbbb{c}", 4) for c in "cdefghij")]
    rows = [(i, w) for w, n in chain for i in range(10_000, 10_000 + n)]
    got = group_spellings(docs(spk, rows), one_in=10**9).collect()
    assert {x.word: x.root for x in got} == {w: "abbbb" for w, _ in chain}
    assert group_spellings(docs(spk, [])).count() == 0 and group_spellings(docs(spk, EDGE[:3])).count() == 0


def test_pivots():
    """The pivots are those of the least sum, and a word one edit away offers what is asked for."""
    from rivalscope.llm.spelling import left_of, pivots, prefix, right_of, shapes

    r = random.Random(4)
    for _ in range(400):
        w = "".join(r.choice("abc") for _ in range(r.randint(4, 9)))
        x = r.choice(sorted(edits(w, "abc")))
        if len(x) < 4:
            continue
        weight = {a + b: r.randint(1, 9) for a in "abc" for b in "abc"}
        order = {g: i for i, g in enumerate(sorted(weight, key=lambda g: (weight[g], g)))}
        if prefix(w, order)[0] > prefix(x, order)[0]:
            w, x = x, w
        places = prefix(w, order)[1]
        assert len(places) == 3
        a, b = pivots(w, places, weight)
        cost = lambda p, w=w: weight[w[p : p + 2]]
        assert b - a >= 2 and cost(a) + cost(b) == min(cost(p) + cost(q) for p in places for q in places if q - p >= 2)
        asked = {(i, j, w[:i], w[len(w) - j :]) for p in (a, b) for i, j in (*right_of(len(w), p), *left_of(len(w), p))}
        offered = {(i, j, x[:i], x[len(x) - j :]) for q in prefix(x, order)[2] for i, j in shapes(len(x), q) if max(i, j) <= len(x)}
        assert asked & offered


def test_treap():
    from rivalscope.llm.lexical import Treap

    r = np.random.default_rng(1)
    for shape, number, high in (((40, 300), 2000, 5), ((1, 1), 1, 9), ((300, 20), 900, 10**9), ((7, 500), 1500, 2)):
        cells = np.unique(np.stack([r.integers(0, shape[0], number), r.integers(0, shape[1], number)], 1), axis=0)
        values = r.integers(1, high, len(cells))
        grid = np.zeros((shape[0] + 600, shape[1]), np.int64)
        grid[cells[:, 0], cells[:, 1]] = values
        treap = Treap(cells[:, 0], cells[:, 1], values)
        for _ in range(30):
            rows = np.unique(r.integers(0, shape[0] + 500, r.integers(1, 12)))
            sums = grid[rows].sum(axis=0)
            order = np.lexsort((np.arange(shape[1]), -sums))
            for most, least in ((1, 0), (10, 0), (50, 0), (10, int(np.median(sums)))):
                want = [(int(c), int(sums[c])) for c in order[:most] if sums[c] > least]
                cols, scores = treap.search(rows, most, least, shape[1])
                got = [(int(c), int(s)) for c, s in zip(cols, scores, strict=True) if s > least]
                assert got == want


def brute_search(rows, items, most):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(terms(t))) for i, t in rows]
    bags = [(i, b) for i, b in bags if b]
    total, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in set(terms(text)) if b[w])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, k, i, -s) for k, (s, _, i) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=str)


def test_ranked_search(spk, monkeypatch):
    from rivalscope.llm import lexical

    r = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["Été", "été", "x_y", "天地"]
    rows = [(i, " ".join(r.choice(words[: r.choice([3, 10, 44])]) for _ in range(r.randint(0, 30)))) for i in range(300)]
    rows += [(1000 - i, "w1 w2 common") for i in range(120)] + EDGE + [(None, "w1 w2 common"), (None, "w39"), (3, "w39 w39"), (3, "w39 w39")]
    items = [(1, "w1 w2 W2 common"), (2, "w3"), (3, "ÉTÉ été w30 x y"), (4, "nowhere"), (5, None), (6, ""), (7, "w39 天地"), (7, "w39 天地"), (7, "w20 one"), (None, "w5 w6 w7 w8 w9 w10 w11"), (8, " ".join(words))]
    df, q = docs(spk, rows).repartition(3), docs(spk, items).withColumnRenamed("doc_id", "item_id")
    for most in (1, 7, 50):
        got = lexical.ranked_search(df, q, most=most)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, items, most)
    # small blocks and parts give the same
    monkeypatch.setattr(lexical, "ITEM_TERMS", 20)
    assert sorted(map(tuple, lexical.ranked_search(df, q, most=50).collect()), key=str) == brute_search(rows, items, 50)
    assert lexical.ranked_search(docs(spk, []), q).count() == 0 and lexical.ranked_search(df, q.limit(0)).count() == 0
    assert lexical.ranked_search(docs(spk, [(1, None), (2, "")]), q).count() == 0


def water(sizes, weights, budget, epochs):
    """Rounds of sharing out what is left by weight among sources that aren't full."""
    target, full = [0.0] * len(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = budget - sum(sizes[i] * epochs for i in full)
        for i in open_:
            target[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if target[i] >= sizes[i] * epochs}
        for i in over:
            target[i] = sizes[i] * epochs
        if not over:
            return target
        full |= over


def mixed_rows(spk, rows):
    return spk.createDataFrame([(i, t, s, 1, "z", 2) for i, t, s in rows], "doc_id long, text string, source string, size long, _source string, _u long")


def test_mix(spk):
    from rivalscope.llm.mixing import mix, repeated

    r = random.Random(6)
    text = lambda n: " \n ".join(f"w{k}" for k in range(n))
    rows = [(i, text(r.choice([0, 1, 5, 40])), r.choice(["big"] * 20 + ["b", "a", "Z", "é", "天", ""])) for i in range(600)]
    rows += [(i, text(3), None) for i in range(5)] + [(None, "one two", "nul")] * 9 + [(1, None, "void"), (2, " ", "void"), (3, text(20_000), "long"), (4, text(100), "long"), (5, text(7), "seven"), (5, text(7), "seven")]
    got = mix(mixed_rows(spk, rows), carry=["text", "_u"]).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, water([size[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(size.values()), 2), strict=True))
    assert len(got) == len(rows) and sum(want.values()) > 1.49 * sum(size.values())
    assert any(x.copies == 0 for x in got) and any(x.copies == 2 for x in got)
    for s in names:
        mine = [x for x in got if x.source == s]
        assert all(math.isclose(x.target, want[s], rel_tol=1e-9) and x.source_size == size[s] for x in mine)
        assert abs(sum(x.taken for x in mine) - want[s]) <= 1
        assert sum(0 < x.part_words < x.size for x in mine) <= 1
    assert all(x.taken == x.copies * x.size + x.part_words <= 2 * x.size for x in got)
    # another layout, the same mix
    again = mix(mixed_rows(spk, rows[::-1]).repartition(7)).collect()
    key = lambda x: str((x.doc_id, x.source, x.size, x.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted(map(key, got)) != sorted(map(key, mix(mixed_rows(spk, rows), seed=1).collect()))
    # the texts: as many words as taken
    mixed = mix(mixed_rows(spk, rows), carry=["text"])
    assert sum(len(x.text.split()) for x in repeated(mixed).collect()) == sum(x.taken for x in got)


def test_mix_edges(spk):
    from rivalscope.llm.mixing import mix

    assert mix(mixed_rows(spk, [])).count() == 0
    alone = mix(mixed_rows(spk, [(1, "a b c d", "x"), (2, "a b", "x")])).collect()
    assert sum(x.taken for x in alone) == 9 and {x.target for x in alone} == {9.0}
    nothing = mix(mixed_rows(spk, [(1, None, None), (2, "", "x")])).collect()
    assert [(x.target, x.taken, x.size) for x in nothing] == [(0.0, 0, 0)] * 2
    every = mix(mixed_rows(spk, [(1, "a b", "x"), (2, "a", "y")]), share=9.0).collect()  # more than all sources can give
    assert sorted((x.taken, x.target) for x in every) == [(2, 2.0), (4, 4.0)]
    one = mix(mixed_rows(spk, [(k, "a b c", "x") for k in range(40)]), weights=(1.0,), share=0.5, epochs=1.0).collect()
    assert sum(x.taken for x in one) == 60 and all(x.taken <= 3 for x in one)
