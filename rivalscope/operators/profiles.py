"""Long one-dimensional profiles (series, pos, value), positions whole numbers that may be missing: runs that bear gaps, and sliding peak to trough.

A series is cut into blocks of positions; a block also gets what lies within reach before it, so that windows never
look into another block and a series with most of the rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..shared import stored
from .running import running

BLOCK = 1 << 16  #: positions of a block, at least


def blocked(profile: DataFrame, reach: int) -> DataFrame:
    """``profile`` with ``_block`` and ``_own``: rows in their own block, and those less than ``reach`` before a block's start in that too."""
    size = max(BLOCK, reach)
    own = F.floor(F.col("pos") / size)
    both = F.when(F.floor((F.col("pos") + reach) / size) > own, F.array(own, own + 1)).otherwise(F.array(own))
    return profile.withColumn("_at", own).withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == F.col("_at")).drop("_at")


def behind():
    return W.partitionBy("series", "_block").orderBy(F.col("pos").cast("long"))


@stored
def runs(profile: DataFrame, least: float, gap: int = 0) -> DataFrame:
    """(series, start, end, n, peak): the maximal runs of positions with ``least`` or more, in which up to ``gap`` positions in a row may be lower or missing.

    ``n`` counts the positions that reach it, ``peak`` is their largest value.  A position that occurs more than once counts as often; null positions
    and values take no part.  Series without such a position give no rows.
    """
    high = profile.dropna(subset=["series", "pos", "value"]).filter(F.col("value") >= least).select("series", "pos", "value", F.monotonically_increasing_id().alias("_id"))
    before = behind().rangeBetween(-gap - 1, -1)
    marked = blocked(high, gap + 1).withColumn("_alone", F.count(F.lit(1)).over(before) == 0).filter("_own")
    # equal positions start together: the first of them by number counts
    first = F.row_number().over(W.partitionBy("series", "_block", "pos").orderBy("_id")) == 1
    marked = marked.withColumn("_start", F.col("_alone") & first).drop("_block", "_own", "_alone")
    numbered = running(marked, ["series"], ["pos", "_id"], {"_run": F.col("_start")})
    return numbered.groupBy("series", "_run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).drop("_run")


def peak_to_trough(profile: DataFrame, width: int) -> DataFrame:
    """(series, pos, value, swing): the largest less the smallest value among the ``width`` positions that end at each; rows without series, position or value are left out."""
    around = behind().rangeBetween(1 - width, 0)
    rows = blocked(profile.dropna(subset=["series", "pos", "value"]).select("series", "pos", "value"), width - 1)
    return rows.withColumn("swing", F.max("value").over(around) - F.min("value").over(around)).filter("_own").select("series", "pos", "value", "swing")
