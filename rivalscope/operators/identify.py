"""Identity by nearest 64-bit hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.fixtures import Tables


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: A library of at most so many hashes is broadcast and held against each candidate.
SMALL = 20_000


def is_small(library: DataFrame) -> bool:
    return library.limit(SMALL + 1).count() <= SMALL


def meeting(candidates: DataFrame, library: DataFrame, reach: int) -> DataFrame:
    """(id, hash, owner, _lib): all pairs at most ``reach`` bits apart, and others.

    A small library is broadcast.  Otherwise hashes are cut in so many bands that two of them within reach differ by one
    bit at most in some band: library hashes are keyed by their bands, candidates by theirs and by all that are one bit off.
    """
    library = library.withColumnRenamed("hash", "_lib")
    if is_small(library):
        return candidates.join(F.broadcast(library), F.bit_count(F.col("hash").bitwiseXOR(F.col("_lib"))) <= reach)
    bands = reach // 2 + 1
    width, wide = divmod(64, bands)
    starts = [i * width + min(i, wide) for i in range(bands + 1)]

    def keys(h: Column, flips: bool) -> Column:
        out = []
        for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            bits = F.shiftrightunsigned(h, a).bitwiseAND(F.lit(2 ** (b - a) - 1).cast("long"))
            masks = [0, *(1 << k for k in range(b - a))] if flips else [0]
            out += [F.struct(F.lit(i).alias("band"), bits.bitwiseXOR(F.lit(m).cast("long")).alias("bits")) for m in masks]
        return F.explode(F.array(*out))

    x = candidates.select("id", "hash", keys(F.col("hash"), True).alias("_p"))
    return x.join(library.select("owner", "_lib", keys(F.col("_lib"), False).alias("_p")), "_p").drop("_p")


def identify(candidates: DataFrame, library: DataFrame, tolerance: int = 8, margin: int = 2) -> DataFrame:
    """Names each candidate (id, hash) by the nearest hash of ``library`` (owner, hash).

    The result is "none" if no owner is within ``tolerance`` bits, "ambiguous" if another owner is less than
    ``margin`` bits farther, else "match".
    """
    pairs = meeting(candidates, library, tolerance + margin - 1)
    near = pairs.groupBy("id", "owner").agg(F.min(distance(F.col("hash"), F.col("_lib"))).cast("long").alias("d")).filter(F.col("d") <= tolerance + margin - 1)
    w = W.partitionBy("id").orderBy("d", "owner")
    best = near.select("id", "owner", "d", F.lead("d").over(w).alias("next"), F.row_number().over(w).alias("n")).filter("n = 1")
    status = F.when(F.col("d").isNull() | (F.col("d") > tolerance), "none").when(F.col("next") - F.col("d") < margin, "ambiguous").otherwise("match")
    return candidates.select("id").join(best, "id", "left").select("id", status.alias("status"), F.when(status == "match", F.col("owner")).alias("owner"), F.when(F.col("d") <= tolerance, F.col("d")).alias("distance"))


def hash_library(t: Tables) -> DataFrame:
    """Sign bits of embeddings, owned by their labels."""
    bit = lambda i: F.when(F.get("embedding", F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = bit(0)
    for i in range(1, 64):
        bits = bits.bitwiseOR(bit(i))
    return t.raw("embeddings").select("vec_id", F.col("label").cast("long").alias("owner"), bits.alias("hash"))


def hero_identify(t: Tables) -> DataFrame:
    """Each library hash with its low ``vec_id % 12`` bits flipped, looked up in the library."""
    lib = hash_library(t)
    flipped = F.col("hash").bitwiseXOR(F.element_at(F.array(*(F.lit(2**i - 1).cast("long") for i in range(12))), (F.col("vec_id") % 12 + 1).cast("int")))
    return identify(lib.select(F.col("vec_id").alias("id"), flipped.alias("hash")), lib.select("owner", "hash"))
