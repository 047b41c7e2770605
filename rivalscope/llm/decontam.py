"""Benchmark decontamination by a positional inverted index (operator 1), DataFrame operations only.

The index holds (term, document, position) postings.  A phrase is found by intersecting
the lists of its two rarest terms, shifted by their offsets in the phrase; what is left is
compared word by word.  Only lists that some phrase asks for are stored, which the index
learns from term counts over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, doc_key, lookup, materialize, scratch

#: What lies between words: all ASCII but 0-9, A-Z and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
END = "\u0000"  #: a term that no text holds; its posting has the number of words as its position
DOC = ["_k1", "_k2"]
VOCABULARY_ROWS, DOC_ROWS, WINDOW_ROWS = 500_000, 500_000, 300_000  #: proven bounds of broadcasts


def met(left: DataFrame, right: DataFrame, key: str, most: int) -> DataFrame:
    """``left.join(right, key)``: ``right`` is broadcast up to ``most`` rows; beyond, the rows of keys that ``left`` has very often are dealt to many tasks."""
    small = broadcast_if_small(right, most)
    return left.join(small, key) if small is not right else lookup(materialize(left, "met"), right, [key], stored=True)


def terms(text: Column) -> Column:
    """The words of a text in order, not yet in lower case; an empty first or last entry is no word."""
    return F.split(text, BETWEEN)


def postings(docs: DataFrame, vocabulary: DataFrame, text: str) -> DataFrame:
    """(_id, _k1, _k2, term, pos) of the terms of ``vocabulary`` (term), and an END posting for each row, with its number of words."""
    found = terms(F.coalesce(F.col(text), F.lit("")))
    raw = docs.select("_id", *DOC, found.alias("_w"))
    empty = (F.get("_w", F.lit(0)) == "").cast("int") + ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    raw = raw.select("_id", *DOC, (F.size("_w") - empty).alias("_n"), F.posexplode(F.array_append("_w", F.lit(END))).alias("pos", "raw"))
    keys = vocabulary.union(vocabulary.sparkSession.createDataFrame([(END,)], "term string")).select("term", F.lower("term").alias("_low"))
    # lower() is fast and never parts what ascii_lower() joins; the exact test follows it
    hit = met(raw.withColumn("_low", F.lower("raw")), keys, "_low", VOCABULARY_ROWS)
    return hit.filter((F.col("raw") == F.col("term")) | (ascii_lower(F.col("raw")) == F.col("term"))).select("_id", *DOC, "term", F.when(F.col("term") == END, F.col("_n")).otherwise(F.col("pos")).alias("pos"))


def term_counts(docs: DataFrame, vocabulary: DataFrame, text: str) -> DataFrame:
    """(term, n): occurrences over all documents, of terms that occur."""
    return postings(docs, vocabulary, text).filter(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def item_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, words): every window of ``size`` words of each item, or the whole of a shorter one."""
    words = F.filter(terms(ascii_lower(F.col(text))), lambda w: w != "")
    found = items.select(F.col(item_id).cast("string").alias("item"), words.alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - size + 1))
    return found.select("item", F.explode(F.transform(starts, lambda s: F.slice("_w", s, size))).alias("words"))


def phrase_matches(docs: DataFrame, phrases: DataFrame, bags: DataFrame, text: str, near: int, within: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact matches of ``phrases`` (pid, words) in ``docs`` (_id, _k1, _k2, text), and proximity matches of ``bags`` (item, term).

    Returns (_k1, _k2, pid, start, size); for every row of ``docs`` (_id, _k1, _k2, pos), its number of words; and
    (_k1, _k2, item) of the items whose ``near`` rarest terms of those that occur lie within ``within`` terms somewhere in the document.
    ``start`` counts terms from 0, an empty first entry included.
    """
    spelled = materialize(phrases.select("pid", F.size("words").alias("size"), F.posexplode("words").alias("off", "term")), "phrase-terms")
    vocabulary = materialize(spelled.select("term").distinct(), "vocabulary")
    counts = materialize(term_counts(docs, vocabulary, text), "term-counts")
    # a phrase with a term that no document holds can't occur
    known = spelled.join(broadcast_if_small(counts, VOCABULARY_ROWS), "term")
    order = F.array_sort(F.collect_list(F.struct("n", "off", "term")))
    rarest = known.groupBy("pid", "size").agg(F.count(F.lit(1)).alias("_n"), F.slice(order, 1, 2).alias("ask")).filter("_n = size")
    asked = materialize(rarest.select("pid", "size", F.size("ask").alias("need"), F.explode("ask").alias("x")).select("pid", "size", "need", "x.off", "x.term"), "asked")
    place = W.partitionBy("item").orderBy("n", "term")
    rare = met(bags, counts, "term", VOCABULARY_ROWS).withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= near)
    rare = rare.withColumn("_all", F.count(F.lit(1)).over(W.partitionBy("item"))).filter(F.col("_all") == near)
    rare = materialize(rare.select("item", "term", F.col("_r").alias("no")), "rarest-of-items")
    index = materialize(postings(docs, asked.select("term").union(rare.select("term")).distinct(), text), "postings")
    shifted = met(index, asked, "term", WINDOW_ROWS).select(*DOC, "pid", "size", "need", (F.col("pos") - F.col("off")).alias("start"), "off").filter("start >= 0")
    both = shifted.groupBy(*DOC, "pid", "start", "size", "need").agg((F.min("off") != F.max("off")).alias("_two")).filter("need = 1 or _two")
    candidates = materialize(both.select(*DOC, "pid", "start", "size"), "candidates")
    at = candidates.groupBy(*DOC).agg(F.collect_list(F.struct("pid", "start", "size")).alias("c"))
    at = materialize(at, "candidates-by-document")
    texts = docs.join(broadcast_if_small(at.select(*DOC), DOC_ROWS), DOC, "left_semi").select(*DOC, text).dropDuplicates(DOC)
    lowered = texts.join(at, DOC).select(*DOC, "c", F.transform(terms(F.col(text)), ascii_lower).alias("_w"))
    # each candidate takes its own words along, not the document's
    cut = F.transform("c", lambda x: F.struct(x["pid"].alias("pid"), x["start"].alias("start"), x["size"].alias("size"), F.slice(F.col("_w"), x["start"] + 1, x["size"]).alias("here")))
    seen = lowered.select(*DOC, F.explode(cut).alias("x")).select(*DOC, "x.*")
    hits = met(seen, phrases, "pid", WINDOW_ROWS).filter(F.col("here") == F.col("words")).select(*DOC, "pid", "start", "size")
    ends = index.filter(F.col("term") == END).select("_id", *DOC, "pos")
    # from each posting on: the terms that lie within reach, as many as positions at most
    reach = W.partitionBy(*DOC, "item").orderBy(F.col("pos").cast("long")).rangeBetween(0, within - 1)
    around = met(index, rare, "term", WINDOW_ROWS).select(*DOC, "item", "pos", "no").withColumn("_seen", F.size(F.collect_set("no").over(reach)))
    return hits, ends, around.filter(F.col("_seen") == near).select(*DOC, "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, one_in: int = 20, near: int = 3) -> DataFrame:
    """One row for each row of ``docs``: id, _k1, _k2, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    Words are runs of 0-9, a-z, A-Z (lower-cased) and non-ASCII characters.  A document word
    inside an occurrence of a window of ``window`` consecutive item words (the whole item where
    shorter) is hit; a document is contaminated if one word in ``one_in`` or more is.  Null texts
    have no words; repeated item ids count once; all items with a null id count as one in n_items and
    are left out of the list that items_sha256 is of.  ``n_near`` counts the items, whether or not they have an exact match, whose ``near`` rarest terms
(of those that any document holds; items with fewer have none) lie within ``window`` words of each other; it doesn't make a document contaminated.  Rows that agree in id and text get the same result.  Empty tables: no rows, or no hits.
    """
    with scratch(docs.sparkSession):
        return materialize(_decontaminate(docs, items, id_col, text, item_id, item_text, window, one_in, near), "decontaminated", keep=True)


def _decontaminate(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_id: str, item_text: str, window: int, one_in: int, near: int) -> DataFrame:
    base = docs.select(F.col(id_col).alias("_id"), *doc_key(id_col, text), F.col(text))
    windows = item_windows(items, item_id, item_text, window).distinct()
    windows = materialize(windows.withColumn("pid", F.xxhash64("words")), "windows")
    phrases = windows.select("pid", "words").distinct()
    bags = windows.select("item", F.explode("words").alias("term")).distinct()
    hits, ends, close = phrase_matches(base, phrases, bags, text, near, window)
    hits = materialize(hits, "hits")

    line = W.partitionBy(*DOC).orderBy("start", "end")
    spans = hits.select(*DOC, "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("_new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))).groupBy(*DOC).agg(F.sum("_new").alias("n_hit"))
    owners = windows.select("pid", "item").distinct()
    named = met(hits.select(*DOC, "pid").distinct(), owners, "pid", WINDOW_ROWS).groupBy(*DOC).agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    close = close.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_near"))
    found = covered.join(named, DOC).join(close, DOC, "full")
    found = broadcast_if_small(materialize(found, "contaminated"), 50_000)
    out = ends.join(found, DOC, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("_id").alias(id_col), *DOC, F.col("pos").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce(F.size("items") + F.col("unnamed"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), ((n_hit > 0) & (one_in * n_hit >= F.col("pos"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def proximity_matches(docs: DataFrame, words: list[str], slop: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end): spans in which the given distinct lower-case words occur within ``slop`` more terms than their number.

    Postings of the rarest word are the anchors.  For each, the shortest span around it that has
    all words is taken, the first of equals, from all postings within reach.  One row for each
    anchor that has one.  No words, null or empty texts and an empty table give no rows; a word named twice counts once.
    """
    words = list(dict.fromkeys(words))
    base = docs.select(F.col(id_col).alias("_id"), *doc_key(id_col, text), F.col(text))
    spark = docs.sparkSession
    vocabulary = spark.createDataFrame([(w,) for w in words], "term string")
    index = materialize(postings(base, vocabulary, text).filter(F.col("term") != END).distinct(), "postings")
    counts = {r["term"]: r["n"] for r in index.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a word
    if not words or set(words) - set(counts):
        return index.select(F.col("_id").alias(id_col), F.col("pos").alias("start"), F.col("pos").alias("end")).limit(0)
    rare = min(words, key=lambda w: (counts[w], w))
    reach = len(words) - 1 + slop
    # joined by stretches of a document, so that a long one isn't compared with itself
    stretch = F.floor(F.col("pos") / (reach + 1))
    anchors = index.filter(F.col("term") == rare).select("_id", *DOC, F.col("pos").alias("anchor"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_s"))
    near = anchors.join(index.select(*DOC, stretch.alias("_s"), "pos", "term").distinct(), [*DOC, "_s"]).filter(F.abs(F.col("pos") - F.col("anchor")) <= reach)
    at = near.groupBy("_id", *DOC, "anchor").agg(F.array_sort(F.collect_set(F.struct("pos", "term"))).alias("p"))  # at most 2 * reach + 1
    inside = lambda a, b: F.array_distinct(F.transform(F.filter("p", lambda x: x["pos"].between(a["pos"], b["pos"])), lambda x: x["term"]))
    whole = lambda a, b: (a["pos"] <= F.col("anchor")) & (b["pos"] >= F.col("anchor")) & (b["pos"] - a["pos"] <= reach) & (F.size(inside(a, b)) == len(words))
    spans = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: whole(a, b)), lambda b: F.struct((b["pos"] - a["pos"]).alias("width"), a["pos"].alias("start"), b["pos"].alias("end")))))
    best = at.select("_id", F.array_min(spans).alias("best")).filter("best is not null")
    return best.select(F.col("_id").alias(id_col), "best.start", "best.end").distinct()
