"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, heavy_keys, lookup, materialize

SMALL = 300_000  #: rows up to which a table of changed labels is broadcast


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, label) of every node that has a link; the label is the least node of its component.

    Each round a node takes the least label of itself and its neighbours, then the label of
    that label, so paths shrink fast; rounds end when no label changes.  Neighbour minima are
    combined before the shuffle, and the links of a node with very many are dealt to many tasks.
    Labels are looked up once for each distinct label, whatever the size of its component.
    """
    both = links.select(F.col(u).alias("a"), F.col(v).alias("b")).union(links.select(F.col(v), F.col(u))).filter("a is not null and b is not null and a <> b").distinct()
    both = materialize(both, "links")
    hot = heavy_keys(both, ["b"])
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = lookup(both, labels.withColumnRenamed("node", "b"), ["b"], hot=hot).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        low = materialize(low, "labels")
        ups = low.select(F.col("node").alias("label"), F.col("label").alias("up")).filter("up < label")
        ups = materialize(low.select("label").distinct().join(ups, "label"), "label-changes")
        small = broadcast_if_small(ups, SMALL)
        jumped = low.join(small, "label", "left") if small is not ups else lookup(low, ups, ["label"], "left")
        jumped = materialize(jumped.select("node", "old", F.coalesce("up", "label").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
