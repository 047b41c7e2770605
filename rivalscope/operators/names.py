"""Names read from pictures, snapped to the nearest known name by edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.scores import name_clean
from ..sources.fixtures import Tables

# Edits and margin allowed, shortest text, highest confidence of a suggestion.
MAX_EDITS, MARGIN, SHORTEST, TOP_CONFIDENCE = 2, 1, 4, 0.5

#: (length of the name, number of the third, its letters) wherever a text could hold a third of a name up to two edits away
THIRDS_IN_TEXT = """array_distinct(filter(flatten(transform(sequence(greatest(length(c) - 2, 1), length(c) + 2), l -> flatten(transform(array(0, 1, 2), i -> transform(array(-2, -1, 0, 1, 2), s ->
  if((i * l) div 3 + s >= 0 and ((i + 1) * l) div 3 + s <= length(c), named_struct('l', l, 'i', i, 'g', substring(c, cast((i * l) div 3 + s + 1 as int), cast(((i + 1) * l) div 3 - (i * l) div 3 as int))), null)))))), k -> k is not null))"""
THIRDS_OF_NAME = "transform(array(0, 1, 2), i -> named_struct('l', length(r), 'i', i, 'g', substring(r, cast((i * length(r)) div 3 + 1 as int), cast(((i + 1) * length(r)) div 3 - (i * length(r)) div 3 as int))))"


def snap(texts: DataFrame, roster: DataFrame) -> DataFrame:
    """``texts`` (id, text) with the nearest name of ``roster`` (owner, name): adds owner and distance.

    A text is tried whole and, above five letters, without its first one and two.  Both are null
    where it has under four letters, no name is within two edits, or two entries are equally near.  A name two
    edits away leaves one of its thirds whole and moved by two places at most, so an equal-key
    join on thirds finds all names that matter without comparing all with all.
    """
    words = texts.select("text").filter(F.length("text") >= SHORTEST).distinct()
    trims = F.when(F.length("text") > SHORTEST + 1, F.array("text", F.substring("text", 2, 2**30), F.substring("text", 3, 2**30))).otherwise(F.array("text"))
    tries = words.select("text", F.explode(trims).alias("c")).select("text", "c", F.explode(F.expr(THIRDS_IN_TEXT)).alias("k")).select("text", "c", "k.*")
    known = roster.select("owner", F.upper("name").alias("r")).select("owner", "r", F.explode(F.expr(THIRDS_OF_NAME)).alias("k")).select("owner", "r", "k.*")
    near = tries.join(known, ["l", "i", "g"]).select("text", "owner", F.levenshtein("c", "r").cast("long").alias("d")).filter(F.col("d") <= MAX_EDITS)
    w = W.partitionBy("text").orderBy("d", "owner")
    best = near.groupBy("text", "owner").agg(F.min("d").alias("d")).select("text", "owner", "d", F.lead("d").over(w).alias("next"), F.row_number().over(w).alias("n"))
    best = best.filter((F.col("n") == 1) & (F.col("next").isNull() | (F.col("next") - F.col("d") >= MARGIN))).select("text", "owner", F.col("d").alias("distance"))
    return texts.join(best, "text", "left")


def suggestions(reads: DataFrame, roster: DataFrame) -> DataFrame:
    """Reads (id, text, confidence) as suggestions: a known name, or else the cleaned text; none for an empty text."""
    clean = reads.select("id", name_clean(F.col("text")).alias("text"), F.col("confidence").alias("_c")).filter("text <> ''")
    known = F.col("owner").isNotNull()
    confidence = F.when(known, F.least(F.col("_c") * (1 - F.col("distance") / (MAX_EDITS + 1)), F.lit(TOP_CONFIDENCE))).otherwise(F.least(F.col("_c"), F.lit(TOP_CONFIDENCE)) * 0.5)
    return snap(clean, roster).select("id", "text", "owner", "distance", F.when(known, "known").otherwise("read").alias("origin"), F.round(confidence, 6).alias("confidence"))


def part_names(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Part names, damaged by their key, as reads; the whole names, numbered by their first part, as roster."""
    p, k, name = t.raw("part"), F.col("p_partkey"), name_clean(F.col("p_name"))
    cut = F.when(k % 5 == 1, F.substring(name, 2, 2**30)).when(k % 5 == 2, F.translate(name, "AE", "43")).when(k % 5 == 3, F.concat(F.lit("XY"), name)).when(k % 5 == 4, F.expr("left(p, length(p) - 2)")).otherwise(name)
    reads = p.withColumn("p", name).select(k.alias("id"), cut.alias("text"), (F.col("p_size") / 50.0).alias("confidence"))
    return reads, p.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("owner")).select("owner", "name")
