"""Sharding by vector bin packing (operator 10).

Groups of equal texts are placed so that bytes, tokens and rows are balanced jointly: each goes
to the shard whose residual capacity has the highest dot product with the group's size vector.

* Groups above ``HEAVY`` of a shard's fair share in any dimension are placed one by one, the
  largest first.  One that is larger than a whole shard is dealt by a salt into pieces first.
* All other groups fall into classes of nearly equal vectors.  What placing the groups of a class one
  by one would give each shard is found at once, as equal vectors fill the shards like water; the groups
  of a class, numbered in the order of their hash, then take their places in that order.

The driver sees the heavy groups and one row a class, which are bounded whatever the corpus size.
The last ``RESERVE`` of each class is placed with bytes weighing most, so that shards made
uneven by large groups have equal bytes in the end: that is the law.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, global_rank, materialize, scratch, text_of

HEAVY = 0.02  #: a group above this part of a shard's share is placed by itself
FINE = 4  #: classes of sizes, of tokens a byte and of copies are 2 ** (1 / FINE) wide
RESERVE = 0.25  #: the part of each class that is placed last
SLOT_ROWS = 50_000  #: rows that one task numbers


def place(sizes: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each item, the largest first, by the dot product with ``left`` (shards x dimensions, changed here); ties go to the lowest shard."""
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes.max(axis=1), kind="stable"):
        out[i] = best = int(np.argmax(left @ sizes[i]))
        left[best] -= sizes[i]
    return out


def pour(size: np.ndarray, number: int, left: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How many of ``number`` items of one size each shard gets if they are placed one by one as in ``place``; ``left`` is changed."""
    dot, step = left @ (weight * size), float(size @ (weight * size))
    low, high = dot.min() - step * (number + 1), dot.max()
    for _ in range(80):  # the level to which the shards' dot products sink
        mid = (low + high) / 2
        low, high = (low, mid) if np.floor((dot - mid).clip(min=0) / step).sum() <= number else (mid, high)
    got = np.floor((dot - high).clip(min=0) / step).astype(np.int64)
    while rest := number - int(got.sum()):
        best = np.argsort(-(dot - got * step), kind="stable")[: min(rest, len(dot))]
        got[best] += 1
    left -= got[:, None] * size
    return got


def fill(sizes: np.ndarray, numbers: np.ndarray, left: np.ndarray) -> np.ndarray:
    """(classes x shards): how many groups of each class a shard gets.  ``sizes`` are mean vectors."""
    out = np.zeros((len(sizes), len(left)), np.int64)
    order = np.argsort(-sizes.max(axis=1), kind="stable")
    last = np.floor(numbers * RESERVE).astype(np.int64)
    for some, weight in ((numbers - last, np.ones(3)), (last, np.array([100.0, 1.0, 1.0]))):
        for i in order:
            out[i] += pour(sizes[i], int(some[i]), left, weight)
    return out


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """One row for each input row: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 length of the text plus ``overhead``; a null text counts as
    empty.  Law ``bytes``: shards have nearly equal sums of sizes.  Equal texts share a
    shard unless they exceed a whole one in bytes, tokens or rows.  ``slot`` numbers a shard's rows from 0
    without gaps; rows that agree in id and text may swap slots.  An empty table gives
    no rows.  Other columns are not read.
    """
    with scratch(df.sparkSession):
        return materialize(_shard(df, shards, id_col, text, overhead), "shards", keep=True)


def _shard(df: DataFrame, shards: int, id_col: str, text: str, overhead: int) -> DataFrame:
    spark = df.sparkSession
    t = text_of(text)
    rows = df.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(t).alias("_k1"),
        F.xxhash64(F.lit("second"), t).alias("_k2"),
        F.xxhash64(F.lit("row"), F.col(id_col), t).alias("_row"),
        (F.octet_length(t) + overhead).cast("long").alias("size"),
        F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("_tokens"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
    )
    # rows equal in id and text get numbers in a row, so that they are dealt out evenly too
    rows = materialize(rows.withColumn("_u", F.monotonically_increasing_id()), "shard-rows")
    twice = materialize(rows.groupBy("_row").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_row"), "shard-repeated")
    if twice.isEmpty():
        rows = rows.withColumn("_rank", F.lit(0).cast("long"))
    else:
        copies = rows.select("_row", "_u", F.lit(1).alias("_one")).join(broadcast_if_small(twice, 300_000), "_row", "left_semi")
        ranks = materialize(global_rank(copies, ["_row", "_u"], "_one", "_rank").select("_u", "_rank"), "shard-ranks")
        rows = rows.join(broadcast_if_small(ranks, 300_000), "_u", "left").withColumn("_rank", F.coalesce("_rank", F.lit(0).cast("long")))
    # pieces of a group: none holds more than an eighth of a shard's share, if the group is one of many rows
    rows = materialize(rows.drop("_u").withColumn("_salt", F.pmod(F.col("_row") + F.col("_rank"), F.lit(8 * shards)).cast("int")), "shard-salted")
    pieces = rows.groupBy("_k1", "_k2", "_salt").agg(F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    groups = materialize(pieces.groupBy("_k1", "_k2").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")), "shard-groups")
    total = [max(1, x or 0) / shards for x in groups.agg(F.sum("b"), F.sum("t"), F.sum("n")).first()]
    share = F.greatest(*(F.col(c) / x for c, x in zip("btn", total, strict=True)))
    left = np.ones((shards, 3))

    # at most 3 * shards / HEAVY groups can be above HEAVY in one of three dimensions, and 3 * shards above a whole shard
    heavy = materialize(groups.filter(share > HEAVY).select("_k1", "_k2", (share > 1).alias("_split")), "shard-heavy")
    alone = pieces.join(F.broadcast(heavy), ["_k1", "_k2"]).withColumn("_salt", F.when(F.col("_split"), F.col("_salt")).otherwise(-1))
    alone = alone.groupBy("_k1", "_k2", "_split", "_salt").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    found = alone.orderBy("_k1", "_k2", "_salt").toPandas()
    found["shard"] = place(found[["b", "t", "n"]].to_numpy(float) / total, left).astype("int32") if len(found) else np.zeros(0, "int32")
    placed = [(int(k1), int(k2), int(salt), int(s)) for k1, k2, salt, s in found[["_k1", "_k2", "_salt", "shard"]].itertuples(index=False)]
    placed = spark.createDataFrame(placed, "_k1 long, _k2 long, _salt int, shard int")

    # classes: sizes of 2**40, a token a byte or less, and copies bound their number
    of = [F.floor(FINE * F.log2(c)).cast("int") for c in (F.col("b"), F.col("b") / (F.col("t") + 1), F.col("n"))]
    light = groups.join(F.broadcast(heavy), ["_k1", "_k2"], "left_anti").select("_k1", "_k2", "b", "t", "n", *(c.alias(f"_c{i}") for i, c in enumerate(of)), F.lit(1).alias("_one"))
    key = ["_c0", "_c1", "_c2"]
    ranked = materialize(global_rank(light, [*key, "_k1", "_k2"], "_one", "_rank"), "shard-ranked")
    kinds = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("N"), F.min("_rank").alias("_from"), *(F.avg(c).alias(c) for c in "btn")).orderBy(*key).toPandas()
    dealt = fill(kinds[["b", "t", "n"]].to_numpy(float) / total, kinds["N"].to_numpy(np.int64), left).cumsum(axis=1) + kinds["_from"].to_numpy(np.int64)[:, None]
    ends = spark.createDataFrame([(*map(int, k), [int(x) for x in e]) for k, e in zip(kinds[key].itertuples(index=False), dealt, strict=True)], "_c0 int, _c1 int, _c2 int, _ends array<long>")
    # a group's shard is the first whose places in the class reach beyond the group's number
    where = ranked.join(F.broadcast(ends), key).select("_k1", "_k2", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).alias("shard"))

    rows = rows.drop("_tokens")
    some = rows.join(F.broadcast(heavy), ["_k1", "_k2"]).withColumn("_salt", F.when(F.col("_split"), F.col("_salt")).otherwise(-1)).join(F.broadcast(placed), ["_k1", "_k2", "_salt"])
    rest = rows.join(F.broadcast(heavy), ["_k1", "_k2"], "left_anti").join(where, ["_k1", "_k2"])
    keep = ["_id", "_row", "_rank", "size", "text_crc32", "shard"]
    out = materialize(some.select(*keep).union(rest.select(*keep)), "shard-placed")
    n = total[2]

    # slots: each shard is cut by hash and number into parts that one task can number
    parts = max(1, int(n) // SLOT_ROWS + 1)
    out = out.withColumn("_p", F.pmod(F.shiftright("_row", 7) + F.shiftright("_rank", 8), F.lit(parts)).cast("int"))
    counts = out.groupBy("shard", "_p").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "_p", offset.alias("_off"))
    numbered = out.withColumn("_in", F.row_number().over(W.partitionBy("shard", "_p").orderBy("_id", "_row", "_rank")) - 1)
    return numbered.join(counts, ["shard", "_p"]).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_off") + F.col("_in")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
