"""Near-duplicate groups by min-max hashing (operator 5).

Each set of word shingles is hashed by 64 permutations; both the minimum and the maximum
of each are kept, giving 128 signature values for 64 evaluations.  Bands of so many values
retrieve candidates that a linked pair shares none with probability below 1e-7: of four values, where
links begin at similarity 0.8, as (1 - 0.8**4)**32 < 5e-8.  Candidates are confirmed on their full sets.

Within a bucket no list of all pairs is made.  Members are first compared with the
bucket's centre (the member whose buckets are fullest), then those not joined with it with a second
centre.  Of what then still lies in different components, pairs are compared only where two
exact bounds leave a link possible (``apart``), so no link is given up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, heavy_keys, lookup, materialize, scratch
from .graph import components

PERMUTATIONS = 64
MISSED = 1e-7  #: most that a linked pair may be missed with
#: A shingle is rare if so many texts of a candidate component hold it, at most.
RARE = 16
CACHE = 40_000  #: words whose hashes a task remembers
CHUNK = 4096
_rng = np.random.default_rng(20_240_817)
FACTORS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
MIX = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_size(percent: int) -> int:
    """Values in a band: the most with which a pair of so many percent is missed with probability below MISSED."""
    fit = [b for b in (8, 4, 2, 1) if (1 - (percent / 100) ** b) ** (2 * PERMUTATIONS // b) < MISSED]
    if not fit:
        raise ValueError(f"{2 * PERMUTATIONS} values can't find pairs of {percent} percent")
    return fit[0]


def least_agreement(percent: int) -> float:
    """The part of all values in which a pair of so many percent agrees at least, but with probability below MISSED (binomial)."""
    n, s, below = 2 * PERMUTATIONS, percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * s**k * (1 - s) ** (n - k)
        if below >= MISSED:
            return k / n
    return 1.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        if n < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b"short\0" + b"\0".join(words))], np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        s = np.zeros(n - self.width + 1, np.uint64)
        for k in range(self.width):
            s = s * MIX[0] + _mix(h[k : k + len(s)] + MIX[1])
        return np.unique(_mix(s))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima and maxima of each set (none empty) under each permutation: sets x 128."""
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    out[:, :PERMUTATIONS], out[:, PERMUTATIONS:] = np.uint64(2**64 - 1), np.uint64(0)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for at in range(0, len(flat), CHUNK):
        v = flat[at : at + CHUNK, None] * FACTORS + OFFSETS
        own = owner[at : at + CHUNK]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        who = own[starts]
        out[who, :PERMUTATIONS] = np.minimum(out[who, :PERMUTATIONS], np.minimum.reduceat(v, starts))
        out[who, PERMUTATIONS:] = np.maximum(out[who, PERMUTATIONS:], np.maximum.reduceat(v, starts))
    return out


def band_keys(sig: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit key per band of ``size`` values, the band's number mixed in."""
    number = 2 * PERMUTATIONS // size
    parts = sig.reshape(len(sig), number, size)
    key = np.broadcast_to(np.arange(1, number + 1, dtype=np.uint64) * MIX[8], (len(sig), number)).copy()
    for k in range(size):
        key = _mix(key * MIX[9] + parts[:, :, k])
    return key.view(np.int64)


def describe(df: DataFrame, width: int, band: int) -> DataFrame:
    """(_id, _tk, _text) -> (_id, _tk, k, n, bands, sig): the set's identity and size, its band keys, a byte of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t or "") for t in part.column(2).to_pylist()]
                some = [s for s in sets if len(s)]
                sig = signatures(some)
                keys, low = band_keys(sig, band), _mix(sig).astype(np.uint8)
                k, bands, sigs, j = [], [], [], 0
                for s in sets:
                    k.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    bands.append(keys[j] if len(s) else None)
                    sigs.append(low[j].tobytes() if len(s) else None)
                    j += bool(len(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(k, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["_id", "_tk", "k", "n", "bands", "sig"]
                )
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, f"_id {df.schema['_id'].dataType.simpleString()}, _tk binary, k binary, n long, bands array<long>, sig binary")


def whole_sets(docs: DataFrame, need: DataFrame, width: int) -> DataFrame:
    """(k, set): the full sets of the classes ``need`` (k, _tk), made again from one text of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [shingles(t or "") for t in batch.slice(at, 256).column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["k", "set"])
        pa.default_memory_pool().release_unused()

    need = materialize(need.distinct(), "need")
    texts = docs.join(broadcast_if_small(need.select("_tk").distinct(), 500_000), "_tk", "left_semi").select("_tk", "_text").dropDuplicates(["_tk"])
    return materialize(texts.mapInArrow(sets, "k binary, set array<long>").join(need.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"]), "sets")


def apart(split: DataFrame, sets: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs of different components that may be links, by two bounds that lose none.

    ``split``: key, k, label, main of the buckets with several components; ``sets``: k, set;
    ``bands``: k, bands.  Shingles are counted within candidate components (what buckets join),
    so rarity doesn't fade as a corpus grows.  Take a linked pair x, y, and put the rare shingles
    first, in one order.  Either x and y share a rare shingle: then the first one they share
    lies in the prefix of n - need + 1 shingles of both, need being the least overlap of any link.
    Such pairs meet by the shingle, of which there are RARE holders at most.  Or they share none: then their overlap
    is within what both have besides rare shingles.  Such pairs meet in their bucket, but only
    if that is enough for a link, and in the first bucket they share.
    """
    first = split.groupBy("key").agg(F.min("k").alias("c"))
    cluster = components(lookup(split.select("key", "k"), first, ["key"]), "k", "c")
    facts = materialize(split.select("k", "label").distinct().withColumn("m", F.monotonically_increasing_id()), "apart")
    held = facts.join(sets, "k").join(cluster.select(F.col("node").alias("k"), F.col("label").alias("cluster")), "k")
    held = materialize(held.select("m", F.size("set").alias("n"), "cluster", "set"), "apart-sets")
    tokens = held.select("m", "n", "cluster", F.explode("set").alias("s")).select("m", "n", F.xxhash64("cluster", "s").alias("t"))
    light = tokens.join(F.broadcast(heavy_keys(tokens, ["t"])), "t", "left_anti")  # heavy ones are held by more than RARE
    rare = light.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("t"))).filter(F.col("df") <= RARE)
    own = rare.groupBy("m", "n").agg(F.count(F.lit(1)).alias("r"), F.count_if(F.col("df") == 1).alias("alone"), F.sort_array(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "t")))).alias("p"))
    # the prefix, less the shingles that nobody else holds
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    own = materialize(own.select("m", "r", F.transform(F.slice("p", 1, F.greatest(reach, F.lit(0)).cast("int")), lambda x: x["t"]).alias("p")), "apart-prefixes")
    about = facts.join(held.select("m", "n"), "m").join(own, "m", "left")
    about = materialize(about.select("m", "k", "label", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("c"), "p"), "apart-members")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.toDF(*(f"{c}_{name}" for c in df.columns))

    sizes = (F.col("label_u") != F.col("label_v")) & (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    prefix = materialize(about.select(F.explode("p").alias("t"), "k", "label", "n"), "prefixes")
    x, y = side(prefix, "u"), side(prefix, "v")
    sharing = x.join(y, (x.t_u == y.t_v) & (x.k_u < y.k_v) & sizes).select(F.col("k_u").alias("u"), F.col("k_v").alias("v"))

    able = about.filter(100 * F.col("c") >= percent * F.col("n")).select("k", "n", "c").join(bands, "k")
    buckets = materialize(split.join(able, "k"), "able")
    both = buckets.groupBy("key").agg((F.min("label") != F.max("label")).alias("two")).filter("two").select("key")
    buckets = materialize(buckets.join(both, "key"), "able")
    x, y = side(buckets.filter("label <> main"), "u"), side(buckets, "v")
    enough = (100 + percent) * F.least("c_u", "c_v") >= percent * (F.col("n_u") + F.col("n_v"))
    once = (F.col("k_u") < F.col("k_v")) | (F.col("label_v") == F.col("main_v"))
    common = x.join(y, (x.key_u == y.key_v) & sizes & enough & once & (F.get(F.array_intersect("bands_u", "bands_v"), F.lit(0)) == F.col("key_u")))
    return sharing.union(common.select(F.least("k_u", "k_v").alias("u"), F.greatest("k_u", "k_v").alias("v"))).distinct()


def text_key(text: str) -> Column:
    """128 bits that name a text; null is as an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80, groups: bool = False) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of
    ``width``-word shingles (a shorter text is one shingle; a null or empty text has an empty
    set and no link).  ``component_id`` is the least id reachable over links; ``kept`` marks the
    row whose id it is.  Rows that agree in id share a component only if their texts link.
    A null id is never the least id unless the whole component has none, and is then kept.
    An empty table gives no rows.  Other columns are not read.  With ``groups`` also ``_group``,
    the component's own name (null for an empty set), and ``_tk``, the MD5 of the text (``text_key``).  ``percent`` decides how values are banded;
    one so low that the signature can't find its pairs (below 12) is refused.
    """
    with scratch(df.sparkSession):
        return _near_duplicates(df, id_col, text, width, percent, groups)


def _near_duplicates(df: DataFrame, id_col: str, text: str, width: int, percent: int, groups: bool) -> DataFrame:
    docs = df.select(F.col(id_col).alias("_id"), text_key(text).alias("_tk"), F.col(text).alias("_text"))
    rows = materialize(describe(docs, width, band_size(percent)), "signatures")
    classes = rows.filter("n > 0").groupBy("k").agg(F.min("_tk").alias("_tk"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")

    members = classes.select("k", F.explode("bands").alias("key"))
    full = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    full = broadcast_if_small(materialize(full, "buckets"), 300_000)
    members = materialize(members.join(full, "key"), "members")
    crowded = heavy_keys(members, ["key"])
    degree = materialize(members.groupBy("k").agg(F.sum(F.log2("size")).alias("degree")), "degrees")
    members = materialize(members.select("key", "k").join(degree, "k"), "members")

    facts = classes.select("k", "n", "sig", "_tk")
    pair = F.when(F.col("k") < F.col("c"), F.struct(F.col("k").alias("u"), F.col("c").alias("v"))).otherwise(F.struct(F.col("c").alias("u"), F.col("k").alias("v")))

    least = least_agreement(percent)

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), -1) for v in (a, b))
        return pa.array((x == y).mean(axis=1) >= least)

    def confirm(pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Of candidate pairs (u, v), those that are links; sizes and signatures are looked at before full sets."""
        f = {side: facts.select(F.col("k").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"), F.col("_tk").alias(f"t_{side}")) for side in "uv"}
        hot = {side: heavy_keys(pairs, [side]) for side in "uv"}
        near = lookup(lookup(pairs, f["u"], ["u"], hot=hot["u"]), f["v"], ["v"], hot=hot["v"])
        near = near.filter((100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & alike("sig_u", "sig_v"))
        near = materialize(near.select("u", "v", "n_u", "n_v", "t_u", "t_v"), "near")
        if sets is None:
            sets = whole_sets(docs, near.select(F.col("u").alias("k"), F.col("t_u").alias("_tk")).union(near.select("v", "t_v")), width)
        x = lookup(near.select("u", "v", "n_u", "n_v"), sets.select(F.col("k").alias("u"), F.col("set").alias("a")), ["u"], hot=hot["u"])
        x = lookup(x, sets.select(F.col("k").alias("v"), F.col("set").alias("b")), ["v"], hot=hot["v"])
        both = F.size(F.array_intersect("a", "b"))
        return x.filter(100 * both >= percent * (F.col("n_u") + F.col("n_v") - both)).select("u", "v")

    def labelled(links: DataFrame) -> DataFrame:
        found = components(links)
        return members.join(found, members.k == found.node, "left").select("key", "k", "degree", F.coalesce("label", "k").alias("label"))

    # first: each member against its bucket's centre
    centre = members.groupBy("key").agg(F.max_by("k", F.struct("degree", "k")).alias("c"))
    tried = materialize(lookup(members, centre, ["key"], hot=crowded, stored=True).filter("k <> c").select(pair.alias("p")).select("p.*").distinct(), "pairs")
    links = materialize(confirm(tried), "confirmed")
    # second: those outside the component of the bucket's centre against a centre of their own
    at = materialize(labelled(links), "members")
    main = at.groupBy("key").agg(F.max_by("label", F.struct("degree", "k")).alias("main"), F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b").select("key", "main")
    split = materialize(lookup(at, main, ["key"], hot=crowded, stored=True), "split")
    centre = split.filter("label <> main").groupBy("key").agg(F.max_by(F.struct("k", "label"), F.struct("degree", "k")).alias("s"))
    more = lookup(split, centre.select("key", F.col("s.k").alias("c"), F.col("s.label").alias("c_label")), ["key"], hot=crowded, stored=True).filter("label <> c_label").select(pair.alias("p")).select("p.*").distinct()
    more = materialize(more.join(tried, ["u", "v"], "left_anti"), "pairs")
    links = materialize(links.union(confirm(more)), "confirmed")
    # last: what is still apart, where a link is possible and wasn't looked for
    at = materialize(labelled(links), "members")
    sums = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("key").agg(F.max_by("label", F.struct("_n", "label")).alias("main"), F.count(F.lit(1)).alias("_l")).filter("_l > 1")
    split = materialize(lookup(at, sums.select("key", "main"), ["key"], hot=crowded, stored=True).select("key", "k", "label", "main"), "split")
    sets = whole_sets(docs, classes.join(split.select("k").distinct(), "k").select("k", "_tk"), width)
    rest = materialize(apart(split, sets, classes.select("k", "bands"), percent), "pairs")
    rest = materialize(rest.join(tried.union(more), ["u", "v"], "left_anti"), "pairs")
    links = links.union(confirm(rest, sets))

    label = components(links).withColumnRenamed("node", "k")
    named = rows.filter("k is not null").select("_id", "_tk", "n", "k")
    out = lookup(named, label, ["k"], "left", stored=True).select("_id", "_tk", "n", F.coalesce("label", "k").alias("group"))
    out = materialize(out, "grouped")
    least = materialize(out.groupBy("group").agg(F.min("_id").alias("least")), "least")
    alone = rows.filter("k is null").select("_id", "_tk", "n", F.lit(None).cast("binary").alias("group"), F.col("_id").alias("least"))
    out = lookup(out, least, ["group"], stored=True).select("_id", "_tk", "n", "group", "least").union(alone)
    out = out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("_id").eqNullSafe(F.col("least")).alias("kept"), *([F.col("group").alias("_group"), "_tk"] if groups else []))
    return materialize(out, "near-duplicates", keep=True)
