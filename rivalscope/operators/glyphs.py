"""Marks held against an atlas by normalized correlation, and boxes put together to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import broadcast_if_small

# The least score of a match, its least lead over the next best, the least height of a box beside the tallest.
MIN_SCORE, MIN_MARGIN, LEAST_HEIGHT = 0.80, 0.03, 0.7
BLOCK = 256  #: templates of the atlas that one row holds


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def facts(df: DataFrame) -> DataFrame:
    """Adds ``s``, the sum of ``v``, and ``q``, the square of its length once its mean is taken off, 0 where nothing but rounding is left of it."""
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    df = df.withColumns({"s": total, "_qq": dot(F.col("v"), F.col("v"))})
    left = F.col("_qq") - F.col("s") * F.col("s") / F.size("v")
    return df.withColumn("q", F.when(left > 1e-12 * F.col("_qq"), left).otherwise(0.0)).drop("_qq")


def correlate(seen: DataFrame, atlas: DataFrame, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, name, score, runner_up, runner_score, confident) of each mark in ``seen`` (id, v): the template of ``atlas`` (name, v) with the highest correlation, and the next.

    Of equal scores the later name counts as higher.  Below ``min_score`` ``name`` is null and the best is the runner-up; ``confident`` asks for ``min_margin`` over the
    next score besides. Vectors are of one length.  Null and empty ones have no name and score 0, as has a mark without an atlas.
    The atlas travels as blocks of templates, and each mark keeps two templates a block, so no list of pairs is made.
    """
    known = facts(atlas.filter(F.size("v") > 0).select("name", "v"))
    count = known.count()
    blocks = max(1, -(-count // BLOCK))
    held = known.withColumn("_b", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).groupBy("_b").agg(F.collect_list(F.struct("name", "v", "s", "q")).alias("_t"))  # about BLOCK of them
    marks = facts(seen.filter(F.size("v") > 0).select("id", "v")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    like = lambda t: F.coalesce(F.try_divide(dot(F.col("v"), t["v"]) - F.col("s") * t["s"] / F.size("v"), F.sqrt(F.col("q") * t["q"])), F.lit(0.0))
    best = marks.join(broadcast_if_small(held, 64), "_b").select("id", F.slice(F.sort_array(F.transform("_t", lambda t: F.struct(like(t).alias("score"), t["name"].alias("name"))), False), 1, 2).alias("two"))
    best = best.groupBy("id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("two")), False), 1, 2).alias("two"))  # two a block
    a, b = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    score, second = F.coalesce(a["score"], F.lit(0.0)), F.coalesce(b["score"], F.lit(0.0))
    good = score >= min_score
    return seen.select("id").join(best, "id", "left").select(
        "id", F.when(good, a["name"]).alias("name"), score.alias("score"), F.when(good, b["name"]).otherwise(a["name"]).alias("runner_up"), second.alias("runner_score"), (good & (score - second >= min_margin)).alias("confident")
    )


def read_boxes(boxes: DataFrame, least_height: float = LEAST_HEIGHT) -> DataFrame:
    """(crop, text, confidence, dropped): the texts of each crop's boxes (crop, x, height, text, confidence) from left to right, and the least confidence of those taken.

    Boxes of less than ``least_height`` of the crop's tallest one are dropped and counted, as they are marks beside the text.  Boxes without
    place, height or text take no part; of equal places the text in its own order comes first.
    """
    full = boxes.dropna(subset=["crop", "x", "height", "text"])
    tallest = full.groupBy("crop").agg(F.max("height").alias("_most"))
    rows = full.join(tallest, "crop").withColumn("_in", F.col("height") >= least_height * F.col("_most"))
    read = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("x", "text")))), lambda b: b["text"]), "")  # the boxes of one crop
    return rows.groupBy("crop").agg(read.alias("text"), F.min(F.when(F.col("_in"), F.col("confidence"))).alias("confidence"), F.count_if(~F.col("_in")).alias("dropped"))
