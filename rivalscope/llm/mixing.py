"""Mixing sources to target weights by capped water-filling (operator 13), DataFrame operations only.

Every source has a weight and a size in words.  The words that the mix shall have are poured over the
sources by weight; a source that would get more than its maximum of epochs is clamped there, and what it
can't take is poured over the others by weight again, until none is above.  A source is then taken in whole
repetitions, and a fraction of one more: its documents in a seeded order, up to the fraction's words, the
last of them in part.  So a source's taken words are its target to within a word.

One row a source is all that water-filling looks at, by sums over that table; a source's documents are
numbered over ranges of (source, order), so one with a third of all rows is many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, global_rank, lookup, materialize, scratch, text_of

WORD = r"[^\x20\x09-\x0D]+"
SOURCES = 300_000  #: rows of a table of sources that is broadcast
SEED = 20_250_114


def level(sources: DataFrame, budget: float, epochs: float) -> float:
    """Words a unit of weight: the level at which the sources, each up to ``epochs`` times its size, take ``budget`` words.

    ``sources``: size, weight.  The level only rises, so a clamped source stays clamped and the rounds end; each is one sum over
    the sources, three numbers for the driver.  Infinite if all sources are clamped.
    """
    found, clamped = 0.0, -1
    cap = F.col("size") * epochs
    while True:
        full = F.col("weight") * found >= cap
        n, taken, rest = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:
            return float("inf")
        if n == clamped:
            return found
        found, clamped = (budget - (taken or 0.0)) / rest, n


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken, source, copies, part_words, then the columns ``carry``.

    ``size`` is the number of words of the text (null: 0).  The sources, in the order of their code points, a null one last, have the
    ``weights``, which repeat; they share ``share`` times the sum of all sizes, and none gets more than ``epochs`` times its size.
    ``target`` and ``source_size`` are of the row's source.  ``taken`` = ``copies`` * ``size`` + ``part_words``: whole repetitions, and the words
    of the fractional one, less than ``size`` in at most one document of a source.  The order in which a source's documents get
    the fractional repetition is that of the MD5 of ``seed`` and id, then of id and size, so reruns agree; rows that agree in id, size and
    source may swap.  Weights are above 0.  Sources without words have target 0.  An empty table gives no rows.  ``carry`` may name any other columns
    than those of the result.
    """
    with scratch(df.sparkSession):
        return materialize(_mix(df, id_col, text, source, weights, share, epochs, seed, carry), "mixture", keep=True)


def _mix(df: DataFrame, id_col: str, text: str, source: str, weights: Sequence[float], share: float, epochs: float, seed: int, carry: Sequence[str]) -> DataFrame:
    name = F.col(f"`{source}`")
    key = ["_null", "_source"]  # no nulls, and sorted as the sources are
    rows = df.select(
        F.col(f"`{id_col}`").alias("_id"), name.isNull().alias("_null"), F.coalesce(name.cast("string"), F.lit("")).alias("_source"),
        F.regexp_count(text_of(f"`{text}`"), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary")).alias("_order"),
        F.monotonically_increasing_id().alias("_u"), F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_carried") if carry else F.lit(None).cast("int").alias("_carried"),
    )
    rows = materialize(rows, "mix-rows")
    sums = materialize(rows.groupBy(*key).agg(F.sum("size").alias("size"), F.lit(1).alias("_one")), "mix-sources")
    placed = materialize(global_rank(sums, key, "_one", "_place").drop("_one"), "mix-places")
    unit = F.array(*(F.lit(float(w)) for w in weights))
    placed = materialize(global_rank(placed.withColumn("weight", F.get(unit, (F.col("_place") % len(weights)).cast("int"))), key, "size", "_before"), "mix-weights")
    total = sums.agg(F.sum("size")).first()[0] or 0
    high = level(placed, share * total, epochs)
    target = F.least(F.col("size") * F.lit(float(epochs)), F.col("weight") * F.lit(high))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("size"))), F.lit(0))
    filled = placed.withColumn("target", F.when(F.col("size") == 0, 0.0).otherwise(target)).withColumn("copies", whole)
    extra = F.round(F.col("target")).cast("long") - F.col("copies") * F.col("size")
    filled = materialize(filled.select(*key, F.col("size").alias("source_size"), "_place", "_before", "target", "copies", extra.alias("_extra")), "mix-targets")

    small = broadcast_if_small(filled, SOURCES)
    told = rows.join(small, key) if small is not filled else lookup(rows, filled, key, stored=True)
    order = ["_place", "_order", "_id_null", "_id", "size", "_u"]
    told = told.withColumn("_id_null", F.col("_id").isNull())
    if small is filled:
        told = materialize(told, "mix-told")
    done = global_rank(told, order, "size", "_rank")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_extra") - (F.col("_rank") - F.col("_before"))))
    return done.select(
        F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size") + part).alias("taken"),
        F.when(~F.col("_null"), F.col("_source")).alias("source"), "copies", part.alias("part_words"), *(["_carried.*"] if carry else []),
    )


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The texts of a mix that carries ``text``: a row for each repetition, with its number ``copy`` from 1.  Of a part only the first ``part_words`` words are left, joined by single spaces."""
    out = mixed.withColumn("_n", F.col("copies") + (F.col("part_words") > 0).cast("int")).filter("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = (F.col("copy") > F.col("copies")) & (F.col("part_words") < F.col("size"))
    return out.withColumn(text, F.when(cut, F.array_join(F.slice(words, 1, F.greatest(F.col("part_words"), F.lit(1)).cast("int")), " ")).otherwise(F.col(text))).drop("_n")
