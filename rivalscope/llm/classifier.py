"""Quality classifier by hierarchical empirical Bayes (operator 3).

A linear classifier gives each document's evidence for "low quality" and "toxic".  It
is fitted on a bounded sample of labelled documents (``SAMPLE`` rows); everything
after it covers all documents: grouped sums of the evidence over hosts and over paths
below them give site posteriors, sparse hosts shrink to the global rate and sparse
paths to their host, and each document's evidence is combined with its site's.  How
strongly they shrink is estimated from the spread between hosts and between paths.

The documents have no URL.  Their host is the first part of ``source`` (up to a slash), and
the path below it is the rest of it together with the language.
"""

from __future__ import annotations

import operator
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, scratch

SAMPLE = 3000  #: labelled documents that the classifier is fitted on, chosen by hash of the id
SEEN = 3  #: a feature needs so many documents of the sample to get a weight
CACHE = 40_000  #: words that the fit, and shapes that a worker remembers; it keeps them while other stages run
TARGETS = ("low", "toxic")
TELLING = 3.5  #: standard deviations by which a feature's documents must differ from the rate
LEAST = 0.02  #: weights nearer to zero are dropped
#: Bounds of an estimated prior's strength in documents: with no spread between sites it would be infinite.
WEAKEST, STRONGEST = 1.0, 1e6

RUN = re.compile(r"(.)\1+")
STRIP = re.compile(r"^\W+|\W+$")


class Kinds(dict):
    """For ``str.translate``: code points as capital, small, digit, or themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


KINDS = Kinds()
STARTS = (4, 5, 6)  #: letters of a longer word's beginnings


def slot(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) >> 1


def bare(word: str) -> str:
    """In small letters, without signs around it."""
    low = word.lower()
    return low if low.isalnum() else STRIP.sub("", low)


def squeezed(shape: str) -> str:
    return RUN.sub(r"\1", shape)[:12]


def word_names(word: str) -> list[str]:
    """Features of a word: the word, its first letters, and its shape."""
    low, out = bare(word), ["s" + squeezed(word.translate(KINDS))]
    if low:
        out += ["w" + low, *("p" + low[:k] for k in STARTS if len(low) > k)]
    return out


def word_features(word: str) -> list[int]:
    """Slots of a word's features."""
    return [slot(x) for x in word_names(word)]


def doc_names(words: list[str], kinds: set[str]) -> list[str]:
    """Features of a whole document: tenths of repeated, capital and symbol words, kinds of words, and its length; ``kinds`` are its distinct words."""
    n = len(words)
    if not n:
        return ["d-empty"]
    times = lambda some: sum(map(some.__contains__, words)) if some else 0
    again = sum(map(operator.eq, words, islice(words, 1, None))) / n
    capital = times({w for w in filter(str.isupper, kinds) if len(w) > 1}) / n
    odd = times({w for w in kinds if not w[-1].isalnum() and w[-1] not in ".,;:!?'\")"}) / n
    return [f"d-{k}-{int(10 * v)}" for k, v in (("again", again), ("capital", capital), ("odd", odd), ("kinds", len(kinds) / n))] + [f"d-length-{n.bit_length()}"]


def features(text: str) -> tuple[set[str], list[str]]:
    """The distinct words of a text, and its features as a whole."""
    words = text.split()
    kinds = set(words)
    return kinds, doc_names(words, kinds)


Model = tuple[np.ndarray, np.ndarray, np.ndarray]  # features' names, weights (targets x features), biases


def fit(texts: list[str], targets: np.ndarray, rounds: int = 400, decay: float = 1e-5) -> Model:
    """Logistic regression on the presence of features, by Adagrad over all rows each round."""
    n, cols = len(texts), []
    known: dict[str, list[int]] = {}
    for text in texts:
        words, whole = features(text)
        own = [slot(x) for x in whole]
        if len(known) > CACHE:
            known.clear()
        for w in words:
            if (f := known.get(w)) is None:
                f = known[w] = word_features(w)
            own += f
        cols.append(np.unique(np.array(own, np.int64)))
    del known
    bias = np.zeros(len(targets))
    if not n:
        return np.zeros(0, object), np.zeros((len(targets), 0)), bias
    owner = np.repeat(np.arange(n), list(map(len, cols)))
    slots, col, seen = np.unique(np.concatenate(cols), return_inverse=True, return_counts=True)
    del cols
    keep = (seen[col] >= SEEN) & (seen[col] <= n - SEEN)
    used, col = np.unique(col[keep], return_inverse=True)
    slots, owner = slots[used], owner[keep]
    weights = np.zeros((len(targets), len(slots)))
    size = np.bincount(col, minlength=len(slots))
    for k, y in enumerate(targets):
        rate = (y.sum() + 0.5) / (n + 1)
        hits = np.bincount(col, y[owner], len(slots))
        telling = np.abs(hits - size * rate) >= TELLING * np.sqrt(size * rate * (1 - rate))
        own, at = np.unique(col[telling[col]], return_inverse=True)
        doc = owner[telling[col]]
        b, w = np.log(rate / (1 - rate)), np.zeros(len(own))
        gw, gb = np.full(len(own), 1e-8), 1e-8
        for _ in range(rounds):
            z = b + np.bincount(doc, w[at], n)
            e = 1 / (1 + np.exp(-z.clip(-30, 30))) - y
            g = np.bincount(at, e[doc], len(own)) / n + decay * w
            gw += g * g
            w -= 0.3 * g / np.sqrt(gw)
            gb += e.mean() ** 2
            b -= 0.3 * e.mean() / np.sqrt(gb)
        bias[k] = b
        weights[k, own] = w
    large = (np.abs(weights) >= LEAST).any(axis=0)
    return names_of(slots[large], texts), weights[:, large], bias


def names_of(slots: np.ndarray, texts: list[str]) -> np.ndarray:
    """The names of features that ``texts`` have."""
    names: dict[int, str | None] = dict.fromkeys(slots.tolist())
    seen: set[str] = set()
    for text in texts:
        words, whole = features(text)
        if len(seen) > CACHE:
            seen.clear()
        for x in (*whole, *(x for w in words - seen for x in word_names(w))):
            if (f := slot(x)) in names:
                names[f] = x
        seen |= words
    return np.array(list(names.values()), object)


class Scorer:
    """Sums the weights of the distinct features of a document.

    Of its words only those and their beginnings that have a weight are met, by name in sets; none are remembered.
    """

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.w, self.b = np.ascontiguousarray(weights.T), bias
        self.at = {x: i for i, x in enumerate(names.tolist())}
        self.words = {x[1:] for x in self.at if x[0] == "w"}
        self.starts = {k: {x[1:] for x in self.at if x[0] == "p" and len(x) == k + 1} for k in STARTS}
        self.shapes: dict[str, int | None] = {}

    def __call__(self, text: str) -> np.ndarray:
        kinds, whole = features(text)
        lows = {low if (low := w.lower()).isalnum() else STRIP.sub("", low) for w in kinds}
        found = [*whole, *("w" + x for x in lows & self.words)]
        for k, held in self.starts.items():
            found += ["p" + x for x in {low[:k] for low in lows if len(low) > k} & held]
        own = {self.at.get(x) for x in found}
        if len(self.shapes) > CACHE:
            self.shapes.clear()
        for shape in {w.translate(KINDS) for w in kinds}:
            if (i := self.shapes.get(shape, -1)) == -1:
                i = self.shapes[shape] = self.at.get("s" + squeezed(shape))
            own.add(i)
        own.discard(None)
        return self.b + self.w[sorted(own)].sum(axis=0)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def priors(paths: DataFrame, hosts: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """Global rates, and the strengths of the priors of hosts and of paths in documents, by the method of moments.

    A strength is the variance within paths over that between hosts, or between the paths of a host:
    what a mean of so many documents varies by as much as the means of sites do.  All from sums by path and host.
    """
    up = hosts.agg(F.sum("h_n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("h_n") * F.col("h_n")).alias("hh"), F.sum(F.col("nn") / F.col("h_n")).alias("nn"), *(
        c for t in TARGETS for c in (F.sum(f"h_{t}").alias(t), F.sum(F.col(f"h_{t}") * F.col(f"h_{t}") / F.col("h_n")).alias(f"host_{t}"), F.sum(f"between_{t}").alias(f"path_{t}")))).first()
    down = paths.agg(F.count(F.lit(1)).alias("paths"), *(F.sum(f"sq_{t}").alias(f"sq_{t}") for t in TARGETS)).first()
    n, rate, at_host, at_path = float(up["n"] or 0), {}, {}, {}
    for t in TARGETS:
        rate[t] = (float(up[t] or 0) + 0.5) / (n + 1)
        if not n:
            at_host[t] = at_path[t] = STRONGEST
            continue
        within = (down[f"sq_{t}"] - up[f"path_{t}"]) / max(1.0, n - down["paths"])
        path = (up[f"path_{t}"] - up[f"host_{t}"] - within * (down["paths"] - up["hosts"])) / max(1.0, n - up["nn"])
        host = (up[f"host_{t}"] - up[t] ** 2 / n - within * (up["hosts"] - 1)) / max(1.0, n - up["hh"] / n)
        strength = lambda between: min(STRONGEST, max(WEAKEST, max(within, 1e-12) / between)) if between > 0 else STRONGEST  # noqa: E731, B023
        at_host[t], at_path[t] = strength(host), strength(path)
    return rate, at_host, at_path


def site(host: str, path: str) -> tuple[Column, Column]:
    """Host and path of a row: the first part of the host column, and the rest of it with the path column; nulls count as empty."""
    whole, below = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host, path))
    first = F.substring_index(whole, "/", 1)
    return first, F.concat(F.substring(whole, F.length(first) + 1, F.length(whole)), F.lit(":"), below)


def verdict_key(id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang") -> list[Column]:
    """Two hashes of what a verdict depends on, and the id; a null site is hashed as the empty one that it counts as."""
    parts = [F.col(id_col), F.col(text), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host, path))]
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit("second"), *parts).alias("_k2")]


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row for each input row: id, _k1, _k2, p_low, p_toxic (evidence), host, path, post_low, post_toxic, kept.

    ``_k1`` and ``_k2`` are ``verdict_key`` of the row, on which alone its verdict depends.

    ``labels`` has ``id_col``, quality (1 good, 0 low) and toxic (0/1); rows with null in
    any of them don't count, and repeated ids count once each.  ``host`` and ``path`` name
    the columns of the site and of the part below it; null is a site of its own.  A null
    text counts as empty.  Without usable labels all evidence is even and all are kept.
    Rows that agree in id, text and site get the same result.  An empty table gives no rows.  Other
    columns are not read.
    """
    with scratch(df.sparkSession):
        return _classify(df, labels, id_col, text, host, path, threshold, sample)


def _classify(df: DataFrame, labels: DataFrame, id_col: str, text: str, host: str, path: str, threshold: float, sample: int) -> DataFrame:
    spark = df.sparkSession
    lab = labels.select(F.col(id_col), F.col("quality").cast("int").alias("_q"), F.col("toxic").cast("int").alias("_t")).dropna().dropDuplicates()
    pick = lab.orderBy(F.xxhash64(id_col), id_col, "_q", "_t").limit(sample)
    pick = F.broadcast(pick)  # at most ``sample`` rows
    rows = df.select(F.col(id_col), F.col(text).alias("_text")).join(pick, id_col).orderBy(F.xxhash64(id_col), id_col, "_q", "_t", F.xxhash64("_text")).limit(sample)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One task has the whole of the bounded sample."""
        texts, low, toxic = [], [], []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            low += [1 - q for q in batch.column(1).to_pylist()]
            toxic += batch.column(2).to_pylist()
        if texts:
            names, weights, bias = fit(texts, np.array([low, toxic], float))
            yield pa.RecordBatch.from_arrays([pa.array([names.tolist()], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in (weights, bias))], names=["names", "weights", "bias"])
        pa.default_memory_pool().release_unused()

    found = rows.select("_text", "_q", "_t").mapInArrow(fitted, "names array<string>, weights binary, bias binary").collect()
    if found:
        names, bias = np.array(found[0]["names"], object), np.frombuffer(found[0]["bias"])
        model = names, np.frombuffer(found[0]["weights"]).reshape(len(bias), len(names)), bias
    else:
        model = fit([], np.zeros((2, 0)))
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, model))  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared)
        for batch in batches:
            z = [scorer(t or "") for t in batch.column(3).to_pylist()]
            p = 1 / (1 + np.exp(-np.array(z).reshape(-1, 2).clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *batch.columns[4:], pa.array(p[:, 0]), pa.array(p[:, 1])], names=["_id", "host", "path", "_k1", "_k2", "p_low", "p_toxic"])
        pa.default_memory_pool().release_unused()

    id_type = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col).alias("_id"), *(c.alias(n) for c, n in zip(site(host, path), ("host", "path"), strict=True)), F.col(text).alias("_text"), *verdict_key(id_col, text, host, path))
    scored = materialize(base.mapInArrow(score, f"_id {id_type}, host string, path string, _k1 long, _k2 long, p_low double, p_toxic double"), "evidence")

    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(f"p_{t}").alias(t) for t in TARGETS), *(F.sum(F.col(f"p_{t}") * F.col(f"p_{t}")).alias(f"sq_{t}") for t in TARGETS)]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = materialize(paths.groupBy("host").agg(*(F.sum(c).alias(f"h_{c}") for c in ("n", *TARGETS)), F.sum(F.col("n") * F.col("n")).alias("nn"), *(F.sum(F.col(t) * F.col(t) / F.col("n")).alias(f"between_{t}") for t in TARGETS)), "hosts")
    rate, at_host, at_path = priors(paths, hosts)
    sites = materialize(lookup(paths.select("host", "path", "n", *TARGETS), hosts.select("host", *(f"h_{c}" for c in ("n", *TARGETS))), ["host"]), "sites")
    out = lookup(scored, sites, ["host", "path"], stored=True)
    for t in TARGETS:
        # the document's own evidence is left out of its site's, so it isn't counted twice
        host_rate = (F.col(f"h_{t}") - F.col(f"p_{t}") + at_host[t] * rate[t]) / (F.col("h_n") - 1 + at_host[t])
        path_rate = (F.col(t) - F.col(f"p_{t}") + at_path[t] * host_rate) / (F.col("n") - 1 + at_path[t])
        z = logit(F.col(f"p_{t}")) + logit(path_rate) - logit(F.lit(rate[t]))
        out = out.withColumn(f"post_{t}", 1 / (1 + F.exp(-z)))
    kept = (F.col("post_low") <= threshold) & (F.col("post_toxic") <= threshold)
    out = out.select(F.col("_id").alias(id_col), "_k1", "_k2", "host", "path", "p_low", "p_toxic", "post_low", "post_toxic", kept.alias("kept"))
    return materialize(out, "verdicts", keep=True)


_scorers: dict[str, Scorer] = {}


def scorer_of(shared) -> Scorer:
    """One scorer per worker process and model."""
    name, model = shared.value
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(*model)
    return _scorers[name]
