"""Quality rules against brute force."""

import math
import random
from collections import Counter

from .conftest import EDGE, docs, prose


def repeats(w):
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)})


def test_base_facts():
    from rivalscope.llm.rules import base_facts

    r = random.Random(7)
    texts = [" ".join(r.choice(["a", "b", "c é#"]) for _ in range(n)) + "\nx y\nx y\n \n" for n in (0, 5, 30, 80)] + ["", " \n"]
    for t in texts:
        w = t.split()
        lines = [x for x in t.split("\n") if x.strip()]
        assert base_facts(t) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats(w))


def trigrams(t):
    return [("\n\n" + t)[p : p + 3] for p in range(len(t))]


def brute_model(texts):
    """{trigram: probability} of one language, term by term from the formulas of modified Kneser-Ney."""
    n = Counter(g for t in texts for g in trigrams(t))

    def discounts(c):
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        return {k: max(0, k - (k + 1) * y * of[k + 1] / of[k]) if of[k] else 0 for k in (1, 2, 3)}

    kinds2 = Counter(g[1:] for g in n)
    kinds1 = Counter(t[1] for t in kinds2)
    p1 = {c: (kinds1[c] + 0.5) / (sum(kinds1.values()) + len(kinds1) / 2) for c in kinds1}
    d = discounts(kinds2)
    d2 = {t: min(k, d[min(3, k)]) for t, k in kinds2.items()}
    p2 = {}
    for t, k in kinds2.items():
        same = [u for u in kinds2 if u[0] == t[0]]
        total = sum(kinds2[u] for u in same)
        p2[t] = (k - d2[t]) / total + sum(d2[u] for u in same) / total * p1[t[1]]
    d = discounts(n)
    d3 = {g: min(k, d[min(3, k)]) for g, k in n.items()}
    p3 = {}
    for g, k in n.items():
        same = [u for u in n if u[:2] == g[:2]]
        total = sum(n[u] for u in same)
        p3[g] = (k - d3[g]) / total + sum(d3[u] for u in same) / total * p2[g[1:]]
    return p3


def median(values):
    v = sorted(values)
    return v[(len(v) - 1) // 2]


def test_model_and_bands_match_brute_force(spk, monkeypatch):
    """Also with few trigrams broadcast, when most are looked up in the table."""
    from rivalscope.llm import rules

    r = random.Random(17)
    texts = {"en": [prose(r, 40) for _ in range(8)], "zh": ["".join(r.choice("天地玄黃宇宙洪荒") for _ in range(90)) for _ in range(6)], None: ["ABC # | " * 20]}
    rows = [(100 * j + i, t, k) for j, (k, ts) in enumerate(texts.items()) for i, t in enumerate(ts)]
    df = spk.createDataFrame(rows, "doc_id long, text string, lang string")
    own, pool = {k: brute_model(ts) for k, ts in texts.items()}, brute_model([t for _, t, _ in rows])
    ppl = {i: math.exp(sum(-math.log(rules.OWN * own[k][g] + (1 - rules.OWN) * pool[g]) for g in trigrams(t)) / len(t)) for i, t, k in rows}
    held = {k: Counter(g for t in ts for g in set(trigrams(t))) for k, ts in texts.items()}
    rarity = {g: min(-math.log(c[g] / max(c.values())) for c in held.values() if c[g]) for c in held.values() for g in c}
    segs = {}
    for i, t, _ in rows:
        g = [rarity[x] for x in trigrams(t)]
        cut = list(range(0, max(1, len(g) // rules.SEGMENT) * rules.SEGMENT, rules.SEGMENT)) + [len(g)]
        segs[i] = [sum(g[a:b]) / (b - a) for a, b in zip(cut, cut[1:], strict=False)]
    mids = {k: median([x for i, _, j in rows if j == k for x in segs[i]]) for k in texts}
    off = {k: [abs(x - mids[k]) for i, _, j in rows if j == k for x in segs[i]] for k in texts}
    pooled = median([x for v in off.values() for x in v])
    far = {k: mids[k] + rules.ODD * 1.4826 * math.sqrt((len(v) * median(v) ** 2 + rules.POOL * pooled**2) / (len(v) + rules.POOL)) + rules.SMALL / math.sqrt(len(v)) for k, v in off.items()}
    odd = {i: sum(x > far[k] + 1e-6 for x in segs[i]) / len(segs[i]) for i, _, k in rows}
    for hot in (1 << 20, 30, 0):
        monkeypatch.setattr(rules, "HOT", hot)
        got = {x.doc_id: (x.perplexity, x.odd) for x in rules.quality_rules(df).collect()}
        assert got.keys() == ppl.keys() and all(abs(got[i][0] / ppl[i] - 1) < 1e-5 and abs(got[i][1] - odd[i]) < 1e-9 for i in ppl), hot


def test_garbage_and_quotes(spk):
    """Of two hundred plain documents in two languages: those with passages of the other are kept, those of which a third or more is garbage are not, wherever it stands."""
    from rivalscope.llm.rules import quality_rules

    r = random.Random(19)
    other = lambda n: " ".join(r.choice("montagne rivière lumière chapeau fenêtre jardin oiseau".split()) + str(r.randint(0, 40)) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(r.randrange(0x21, 0x7F)) for _ in range(7)) for _ in range(n))
    rows = [(i, prose(r, 120), "en") for i in range(100)] + [(100 + i, other(120), "fr") for i in range(100)]
    rows += [(300 + i, prose(r, 80) + "\n" + other(40), "en") for i in range(4)] + [(310, prose(r, 60) + " " + other(60), "en")]
    bad = {}
    for k, share in enumerate((0.3, 0.4, 0.5, 0.7, 1.0)):
        n = round(240 * share)
        for j, place in enumerate((0, 0.5, 1)):
            w = prose(r, 240 - n).split()
            at = int(place * len(w))
            bad[500 + 10 * k + j] = " ".join([*w[:at], noise(n), *w[at:]])
    rows += [(i, t, "en") for i, t in bad.items()] + [(900, prose(r, 200) + " " + noise(8), "en")]
    got = {x.doc_id: x for x in quality_rules(spk.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not [got[i] for i in (*range(200), 300, 301, 302, 303, 310, 900) if not got[i].kept]
    assert not any(got[i].kept or got[i].base_failed for i in bad)
    # perplexity alone tells those that are mostly garbage
    assert all(got[i].perplexity > got[i].ppl_high for i in bad if i >= 530) and all(got[i].perplexity <= got[i].ppl_high for i in range(200))


def test_verdicts(spk):
    from rivalscope.llm.rules import quality_rules

    r = random.Random(7)
    junk = "@@ ## $$ %% " * 2 + prose(r, 4).upper() + " ".join(chr(0x30A0 + r.randrange(90)) + str(k) + "##" for k in range(40))
    rows = [(i, prose(r, 60)) for i in range(10, 90)] + [(900, junk)] + EDGE
    got = {}
    for x in quality_rules(docs(spk, rows)).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert all(got[i][0].kept for i in range(10, 90)) and not got[900][0].kept
    assert all(x.base_failed and not x.kept for i in (1, 2, 3, 4, None) for x in got[i])
    assert len(got[4]) == 2 and got[4][0].perplexity == got[4][1].perplexity
    assert got[1][0].perplexity is None and got[2][0].perplexity is None and got[5][0].perplexity is not None
    assert quality_rules(docs(spk, [])).count() == 0


def test_every_language_is_treated_alike(spk):
    """Three hundred languages, one of them all capitals, one all markup, most with two documents: each has a verdict of its own."""
    from rivalscope.llm.rules import quality_rules

    r = random.Random(18)
    rows = [(i, prose(r, 60), f"l{i % 300}") for i in range(600)]
    rows += [(1000 + i, prose(r, 60).upper(), "caps") for i in range(30)] + [(2000 + i, "| " + prose(r, 60).replace(" ", " | # | "), "md") for i in range(30)]
    got = quality_rules(spk.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert not [x for x in got if not x.kept] and len(got) == len(rows)
