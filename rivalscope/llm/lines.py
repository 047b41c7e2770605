"""Line dedup by a suffix array over line ids (operator 2), DataFrame operations only.

The sequence of a document is its lines that hold a word.  Lines found once can't be part
of a repeat, so only *islands* (unbroken stretches of lines found elsewhere too) that hold
enough words are kept.  Over these, prefix doubling ranks all suffixes by their first
1, 2, 4, ... lines: the rank of a suffix by 2h lines follows from its rank by h lines and
that of the suffix h lines on.

A run counts if it has ``min_words`` words.  The suffixes that share their first L lines
form an LCP interval of depth L; it is named by the rank of the first and of the last
2**k of these lines (2**k <= L < 2**(k+1)).  The depths that matter are, for each suffix,
the shortest that reaches ``min_words``, and for each line the shortest run ending there:
a maximal repeated run is exactly the union of the windows of these depths inside it.  So
doubling ends at ``min_words`` lines at most, whatever the longest repeat.  In each
interval the first occurrence in the order (id, line) stays and the later ones go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import doc_key, global_rank, lookup, materialize, scratch

DOC = ["_k1", "_k2"]


def suffix_ranks(positions: DataFrame, longest: int) -> list[DataFrame]:
    """Prefix doubling.  ``positions``: _k1, _k2, isl, seq, left, depth, h1, h2.

    Returns per level k the table (_k1, _k2, isl, seq, r): r orders the suffixes that have 2**k
    lines left in their island by those lines; equal lines, equal rank.  Only islands with a
    wanted depth of 2**k or more take part.  The levels together are the suffix array cut at
    ``longest`` lines.
    """
    names = positions.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"))
    ranked = materialize(global_rank(names, ["h1", "h2"], "_n", "r").drop("_n"), "names")
    level = lookup(positions, ranked, ["h1", "h2"]).select(*DOC, "isl", "seq", "left", "depth", "r")
    levels = [materialize(level, "ranks")]
    h = 1
    while 2 * h <= longest:
        line = W.partitionBy(*DOC, "isl").orderBy("seq")
        pairs = levels[-1].filter(F.col("depth") >= 2 * h).withColumn("r2", F.lead("r", h).over(line)).filter(F.col("left") >= 2 * h)
        pairs = materialize(pairs, "pairs")
        names = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("_n"))
        ranked = materialize(global_rank(names, ["r", "r2"], "_n", "_new").drop("_n"), "names")
        level = lookup(pairs, ranked, ["r", "r2"]).select(*DOC, "isl", "seq", "left", "depth", F.col("_new").alias("r"))
        levels.append(materialize(level, "ranks"))
        h *= 2
    return levels


def repeated_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(_k1, _k2, seq, size) of the windows of lines that have an earlier copy."""
    again = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    some = lookup(lines, materialize(again, "repeated-lines"), ["h1", "h2"]).dropDuplicates([*DOC, "seq"])
    doc = W.partitionBy(*DOC).orderBy("seq")
    some = some.withColumn("isl", F.col("seq") - F.row_number().over(doc))
    isle = W.partitionBy(*DOC, "isl")
    some = some.withColumns({"total": F.sum("w").over(isle), "last": F.max("seq").over(isle), "head": F.min("seq").over(isle)}).filter(F.col("total") >= min_words)
    through = F.sum("w").over(isle.orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    some = some.withColumn("through", through).withColumn("before", F.col("through") - F.col("w"))
    # end of the shortest window from here, and start of the shortest window to here (null: none)
    after = F.min("seq").over(isle.orderBy("before").rangeBetween(min_words, W.unboundedFollowing))
    end = F.coalesce(after - 1, F.when(F.col("total") - F.col("before") >= min_words, F.col("last")))
    ahead = F.max("seq").over(isle.orderBy("through").rangeBetween(W.unboundedPreceding, -min_words))
    start = F.coalesce(ahead + 1, F.when(F.col("through") >= min_words, F.col("head")))
    some = some.withColumns({"end": end, "start": start, "left": F.col("last") - F.col("seq") + 1})
    some = some.withColumn("depth", F.max(F.greatest(F.coalesce(F.col("end") - F.col("seq") + 1, F.lit(1)), F.coalesce(F.col("seq") - F.col("start") + 1, F.lit(1)))).over(isle))
    some = materialize(some.select(*DOC, "_id", "isl", "seq", "head", "left", "depth", "end", "start", "h1", "h2"), "islands")
    longest = some.agg(F.max("depth")).first()[0] or 1

    named = None
    for k, level in enumerate(suffix_ranks(some, longest)):
        h = 1 << k
        spans = some.filter(F.col("depth") >= h)
        both = F.array(F.struct(F.col("seq").alias("s"), (F.col("end") - F.col("seq") + 1).alias("size")), F.struct(F.col("start").alias("s"), (F.col("seq") - F.col("start") + 1).alias("size")))
        wanted = F.filter(both, lambda x: x["size"].isNotNull() & (x["size"] >= h) & (x["size"] < 2 * h))
        # an island's ranks and windows as arrays: bounded by its document
        rows = spans.select(*DOC, "isl", "_id", "head", "seq", wanted.alias("ws")).join(level.select(*DOC, "isl", "seq", "r"), [*DOC, "isl", "seq"], "left")
        isles = rows.groupBy(*DOC, "isl").agg(F.first("_id").alias("_id"), F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("seq", "r"))).alias("rs"), F.array_distinct(F.flatten(F.collect_list("ws"))).alias("ws"))

        def rank(at):
            return F.get("rs", (at - F.col("head")).cast("int"))["r"]

        found = F.transform("ws", lambda x: F.struct(x["s"].alias("s"), x["size"].alias("size"), rank(x["s"]).alias("a"), rank(x["s"] + x["size"] - h).alias("b")))
        part = isles.select(*DOC, "_id", F.explode(found).alias("x")).select(*DOC, "_id", F.col("x.s").alias("seq"), "x.size", "x.a", "x.b")
        named = part if named is None else named.union(part)
    named = materialize(named, "windows")
    here = F.struct("_id", *DOC, "seq")
    intervals = named.groupBy("size", "a", "b").agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    later = lookup(named, materialize(intervals, "intervals"), ["size", "a", "b"]).filter(~here.eqNullSafe(F.col("_first")))
    return later.select(*DOC, "seq", "size")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """The input's rows with later copies of repeated runs of lines deleted from ``text``.

    Adds n_lines and n_deleted.  Lines are separated by \\n; lines without a word are never
    compared, break no run and stay.  Runs never cross documents.  A null text stays null,
    with no lines.  Rows that agree in id and text are one document and get the same result.
    The first copy in the order (id, line) stays; null ids come first.  All other columns pass
    through; existing columns n_lines and n_deleted are replaced.  Write the result before
    filtering on its text: a filter pushed into it would rebuild the lines once a line.
    """
    with scratch(df.sparkSession):
        return _dedup_lines(df, id_col, text, min_words)


def _dedup_lines(df: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    rest = [c for c in df.columns if c not in ("n_lines", "n_deleted")]
    # the row's own columns travel in one struct, so none can clash with those used here
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(id_col).alias("_id"), F.col(text).alias("_text"), *doc_key(id_col, text))
    # lines that hold a word, with their number among those
    held = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"\S"))
    lines = keyed.select("_id", *DOC, F.posexplode(held).alias("seq", "line"))
    lines = lines.select("_id", *DOC, "seq", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), F.regexp_count("line", F.lit(r"\S+")).cast("long").alias("w"))
    later = repeated_windows(materialize(lines, "lines"), min_words)
    gone = later.groupBy(*DOC).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("seq", F.col("seq") + F.col("size") - 1)))).alias("_gone"))
    gone = materialize(gone, "gone", keep=True).hint("shuffle_hash")
    numbers = F.sequence(F.lit(0), F.size("_l") - 1)
    marked = F.transform("_l", lambda line, i: F.struct(i.alias("i"), line.rlike(r"\S").alias("word")))
    holding = F.transform(F.filter(marked, lambda x: x["word"]), lambda x: x["i"])
    out = keyed.join(gone, DOC, "left").withColumn("_l", F.split("_text", "\n"))
    left = F.array_except(F.col("_n"), F.transform("_gone", lambda q: F.get("_h", q.cast("int"))))
    cut = F.array_join(F.transform(left, lambda i: F.get("_l", i)), "\n")
    out = out.withColumns({"_n": F.when(F.col("_gone").isNotNull(), numbers), "_h": F.when(F.col("_gone").isNotNull(), holding)})
    # a second use of _h keeps it a column of its own, made once a row and not once a line
    out = out.withColumn("_text", F.when(F.col("_gone").isNull() | F.col("_h").isNull(), F.col("_text")).otherwise(cut))
    return out.select(
        *(F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in rest),
        F.coalesce(F.when(F.col("_l").isNotNull(), F.size("_l")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long").alias("n_deleted"),
    )
