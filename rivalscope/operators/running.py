"""Running sums of a subject's matches in time order; a subject with most of the rows is split by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.scores import outcome
from ..shared import materialize, partitions_for, stored
from ..sources.fixtures import Tables


def running(rows: DataFrame, subject: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over the subject's rows up to this one.

    ``subject`` holds no nulls, and ``order`` is unique within a subject.  Rows are range-partitioned by
    both; across ranges only one sum a subject and range is carried, so no task has more than its range.
    """
    # written first, as dealing by ranges reads its rows twice: once for the bounds
    ranged = materialize(rows.withColumns({k: F.coalesce(c.cast("long"), F.lit(0)) for k, c in sums.items()}), "unranged")
    ranged = materialize(ranged.repartitionByRange(partitions_for(rows), *subject, *order).withColumn("_pid", F.spark_partition_id()), "ranged")
    earlier = W.partitionBy(*subject).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges
    parts = ranged.groupBy(*subject, "_pid").agg(*(F.sum(k).alias(k) for k in sums))
    parts = parts.select(*subject, "_pid", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums))
    within = W.partitionBy(*subject, "_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.withColumns({k: F.sum(k).over(within) for k in sums}).join(parts, [*subject, "_pid"])
    return out.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop("_pid", *(f"_before_{k}" for k in sums))


@stored
def placed(t: Tables, own: bool = False) -> DataFrame:
    """Rows of every other player, or the operator's own as those of player 0: outcome, place ``x`` in time order, and wins, losses and draws up to it."""
    m = t.matches.select(F.col("id").alias("match_id"), "played_at", "result")
    rows = t.match_players.filter("is_me").withColumn("player_id", F.lit(0).cast("long")) if own else t.match_players.filter(~F.col("is_me")).dropna(subset=["player_id"])
    rows = rows.select("id", "match_id", "player_id", "team").join(m, "match_id").withColumn("outcome", outcome(F.col("result"), F.col("team"))).drop("result")
    sums = {"x": F.lit(1), "wins": F.col("outcome") == "win", "losses": F.col("outcome") == "loss", "draws": F.col("outcome") == "draw"}
    return running(rows, ["player_id"], [F.col("played_at").asc_nulls_first(), "match_id", "id"], sums).drop("played_at")


def rates(rows: DataFrame, subject: list[str], n: str, window: int) -> DataFrame:
    """Adds cumulative, rolling and ``size`` from the running ``wins`` at each place ``n``: sums at ``n`` less those at ``n - window``.  ``rows`` should be stored, as they are read twice."""
    old = rows.select(*subject, (F.col(n) + window).alias(n), F.col("wins").alias("_old"))
    size = F.least(F.col(n), F.lit(window)).cast("long")
    return rows.join(old, [*subject, n], "left").withColumns({
        "cumulative": F.round(F.col("wins") / F.col(n), 6),
        "rolling": F.round((F.col("wins") - F.coalesce("_old", F.lit(0))) / size, 6),
        "size": size,
    }).drop("_old")
