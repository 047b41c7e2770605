"""Quality rules with n-gram perplexity bands (operator 7).

A text has to lie in two bands of its language: the perplexity of the whole text, and the part of its segments that
are odd, which a passage in another language isn't, but one that hardly any document has anything like.

A modified Kneser-Ney character trigram model of each language is counted over all its
documents by Spark aggregation: no characters are folded, no document or language is left
out, and the model grows with the corpus.  Each trigram's log probability lies in a table
sorted by hash.  The HOT most frequent ones are sent to the tasks as sorted hash arrays,
which bounds what is broadcast; the others are looked up in the table by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, lookup, materialize, scratch

WINDOW = 8
SEGMENT = 64  #: characters that are judged together for oddness
HOT = 1 << 20  #: trigrams that are broadcast, 16 MB; the result doesn't depend on it
FLUSH = 1 << 20  #: distinct trigrams that a counting task holds before it passes its sums on
#: Bands: median +- (ABOVE, BELOW or ODD) * spread, spread being 1.4826 times the median absolute
#: deviation, plus LENGTH / sqrt(characters) for perplexity, as short texts scatter more, and SMALL / sqrt(the
#: language's segments) for oddness, as what few documents write is rare by chance.
BELOW, ABOVE, ODD, LENGTH, SMALL = 6.0, 5.0, 6.0, 6.0, 8.0
#: The spread of a language is pooled with that of all as if the latter had been seen on this many documents.
POOL = 50.0
#: The part of odd segments that a text may have, and what is added over the root of their number.
TOLERATED, FEW_SEGMENTS = 0.2, 0.6
#: The part of a language's own model in what its texts are scored by, the rest being the model of all documents:
#: a passage quoted in another language isn't noise.
OWN = 0.5
BITS = 21  #: of a code point
HASH = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """All trigrams of the padded text in order, three code points in one number each."""
    s = np.frombuffer(("\n\n" + text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:]


def counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n, docs) over all documents: occurrences, and documents with one; each task sums its own part before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        held = 0

        def merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            g, n, d = (np.concatenate(parts[i::3]) for i in range(3))
            kinds, at = np.unique(g, return_inverse=True)
            return kinds, np.bincount(at, n, len(kinds)).astype(np.int64), np.bincount(at, d, len(kinds)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for k, parts in sums.items():
                g, n, d = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g), pa.array(n), pa.array(d)], names=["lang", "gram", "n", "docs"])
            sums.clear()

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    kinds, n = np.unique(grams(t), return_counts=True)
                    sums.setdefault(k, []).extend((kinds, n, np.ones(len(n), np.int64)))
                    held += len(kinds)
                    if held > FLUSH:
                        sums = {k: list(merged(parts)) for k, parts in sums.items()}
                        held = sum(len(parts[0]) for parts in sums.values())
                        if held > FLUSH // 2:
                            yield from flush()
                            held = 0
        yield from flush()

    part = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text")).mapInArrow(partial, "lang string, gram long, n long, docs long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def discount(c: str, sums: DataFrame) -> tuple[DataFrame, Column]:
    """The count-of-counts of ``c`` by lang, and the modified Kneser-Ney discount of ``c`` once they are joined."""
    facts = sums.groupBy("lang").agg(*(F.count_if(F.col(c) == k).cast("double").alias(f"_{k}") for k in (1, 2, 3, 4)))
    y = F.when(F.col("_1") > 0, F.col("_1") / (F.col("_1") + 2 * F.col("_2"))).otherwise(0.0)

    def d(k: int) -> Column:
        return F.when(F.col(f"_{k}") > 0, F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"_{k + 1}") / F.col(f"_{k}"))).otherwise(0.0)

    return facts, F.when(F.col(c) == 1, d(1)).when(F.col(c) == 2, d(2)).otherwise(d(3))


def kneser_ney(found: DataFrame) -> DataFrame:
    """(lang, gram, n, logp) from (lang, gram, n): interpolated modified Kneser-Ney of order three.

    The lowest order is add-one-half over the language's characters.  All trigrams of the corpus have a row, so scoring meets no unknown one.
    """
    head, tail, last = F.shiftright("gram", BITS), F.col("gram").bitwiseAND((1 << 2 * BITS) - 1), (1 << BITS) - 1
    third = materialize(found.select("lang", "gram", "n", head.alias("head"), tail.alias("tail")), "trigrams")
    # order two: how many characters come before a pair
    pairs = materialize(third.groupBy("lang", "tail").agg(F.count(F.lit(1)).cast("double").alias("kinds")), "pairs")
    pairs = pairs.withColumns({"b": F.shiftright("tail", BITS), "c": F.col("tail").bitwiseAND(last)})
    ones = pairs.groupBy("lang", "c").agg(F.count(F.lit(1)).cast("double").alias("k1"))
    total = ones.groupBy("lang").agg((F.sum("k1") + F.count(F.lit(1)) / 2).alias("all1"))
    facts, d = discount("kinds", pairs)
    pairs = pairs.join(facts.join(total, "lang"), "lang").withColumn("d", F.least(d, "kinds"))
    by_b = pairs.groupBy("lang", "b").agg(F.sum("kinds").alias("all2"), F.sum("d").alias("left2"))
    low = pairs.join(by_b, ["lang", "b"]).join(ones, ["lang", "c"])
    p2 = (F.col("kinds") - F.col("d")) / F.col("all2") + F.col("left2") / F.col("all2") * (F.col("k1") + 0.5) / F.col("all1")
    low = materialize(low.select("lang", "tail", p2.alias("p2")), "pair-probabilities")
    # order three
    facts, d = discount("n", third)
    third = third.join(broadcast_if_small(facts, 10_000), "lang").withColumn("d", F.least(d, F.col("n").cast("double")))
    by_head = third.groupBy("lang", "head").agg(F.sum("n").alias("all3"), F.sum("d").alias("left3"))
    whole = third.join(by_head, ["lang", "head"]).join(low, ["lang", "tail"])
    p3 = (F.col("n") - F.col("d")) / F.col("all3") + F.col("left3") / F.col("all3") * F.col("p2")
    return whole.select("lang", "gram", "n", F.log(p3).alias("logp"))


def rarities(found: DataFrame) -> DataFrame:
    """(gram, rarity): minus the logarithm of the part of a language's documents that have the trigram, in the language that has it most."""
    most = found.groupBy("lang").agg(F.max("docs").alias("most"))
    part = found.join(broadcast_if_small(most, 10_000), "lang").groupBy("gram").agg(F.max(F.col("docs") / F.col("most")).alias("part"))
    return part.select("gram", (-F.log("part")).alias("rarity"))


def models(found: DataFrame) -> DataFrame:
    """(lang, gram, n, logp, rarity): each language's model, interpolated with that of all documents, and the trigrams' rarities."""
    every = found.groupBy("gram").agg(F.sum("n").alias("n"))
    named = found.select(F.concat(F.lit("="), "lang").alias("lang"), "gram", "n").unionByName(every.withColumn("lang", F.lit("*")))
    both = materialize(kneser_ney(materialize(named, "all-ngrams")), "kneser-ney")
    own = both.filter("lang <> '*'").withColumn("lang", F.expr("substring(lang, 2)"))
    pool = both.filter("lang = '*'").select("gram", F.col("logp").alias("pooled"))
    joined = own.join(pool, "gram").join(rarities(found), "gram")
    return joined.select("lang", "gram", "n", F.log(OWN * F.exp("logp") + (1 - OWN) * F.exp("pooled")).alias("logp"), "rarity")


def keys(lang: str, g: np.ndarray) -> np.ndarray:
    """A hash of language and trigram."""
    seed = np.frombuffer(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64)
    x = (g.astype(np.uint64) ^ seed) * HASH
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def segments(n: int) -> np.ndarray:
    """Where the segments of a text of n characters start; the last has what is left, up to twice the length."""
    return np.arange(max(1, n // SEGMENT)) * SEGMENT


class HashArrays:
    """Log probabilities and rarities in arrays sorted by hash."""

    def __init__(self, table: pa.Table):
        langs, g = table["lang"].to_pylist(), table["gram"].to_numpy()
        key = np.zeros(len(g), np.uint64)
        names = np.array(langs, object)
        for k in set(langs):
            mine = names == k
            key[mine] = keys(k, g[mine])
        order = np.argsort(key)
        key = key[order]
        clash = key[1:] == key[:-1]  # two trigrams of one hash are left to the table
        keep = np.ones(len(key), bool)
        keep[1:] &= ~clash
        keep[:-1] &= ~clash
        self.key = key[keep]
        self.logp, self.rarity = (table[c].to_numpy()[order].astype(np.float32)[keep] for c in ("logp", "rarity"))

    def find(self, lang: str, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities and rarities; nan where the arrays have none."""
        key = keys(lang, g)
        if not len(self.key):
            return np.full(len(g), np.nan), np.full(len(g), np.nan)
        at = np.searchsorted(self.key, key).clip(max=len(self.key) - 1)
        same = self.key[at] == key
        return tuple(np.where(same, x[at].astype(np.float64), np.nan) for x in (self.logp, self.rarity))


def base_facts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits on exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that are found twice or more; equal hashes are compared word by word."""
    n, repeat = len(words), 0
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.uint64, n)
    w = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        w = (w + ids[k : k + len(w)] + np.uint64(1)) * HASH
        w ^= w >> np.uint64(29)
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if same.any():
        a, b = order[:-1][same], order[1:][same]
        if not all((ids[a + k] == ids[b + k]).all() for k in range(WINDOW)):  # a hash of two different windows
            rows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
            _, s = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(s, kind="stable")
            same = s[order][1:] == s[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, order[twice], 1)
        np.add.at(step, order[twice] + WINDOW, -1)
        repeat = int((step.cumsum() > 0).sum())
    return repeat


def quality_rules(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each input row: id, the base facts, base_failed, kept, perplexity and its band, odd (the part of odd segments) and odd_most.

    ``perplexity`` is that of all characters of a text in the model of its language, which every text has that isn't empty.
    A segment is odd if its characters' mean rarity is far above the median of its language's segments.
    Null and empty texts have no words and fail the base rules.
    A null language is a language of its own.  A language's bands lie around the median of its
    documents; the fewer they are, the more the spread is that of all languages.  Rows that agree
    in text and language get the same result.  An empty table gives no rows.  Other columns are not read.
    """
    with scratch(df.sparkSession):
        return _quality_rules(df, id_col, text, lang)


def bands(rows: DataFrame, value: str) -> DataFrame:
    """(_lang, n, mid, spread) of ``value``, from mergeable sketches over all of ``rows``; a language has one row."""
    mid = materialize(rows.groupBy("_lang").agg(F.percentile_approx(value, 0.5, 2000).alias("mid"), F.count(value).alias("n")), "medians")
    off = rows.join(broadcast_if_small(mid, 100_000), "_lang").withColumn("off", F.abs(F.col(value) - F.col("mid")))
    mad = off.groupBy("_lang").agg(F.first("mid").alias("mid"), F.first("n").alias("n"), F.percentile_approx("off", 0.5, 2000).alias("mad"))
    pooled = off.agg(F.percentile_approx("off", 0.5, 2000)).first()[0] or 0.0
    spread = 1.4826 * F.sqrt((F.col("n") * F.pow(F.coalesce("mad", F.lit(0.0)), 2) + POOL * pooled**2) / (F.col("n") + POOL))
    return broadcast_if_small(materialize(mad.select("_lang", "n", "mid", spread.alias("spread")), "bands"), 100_000)


def _quality_rules(df: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    spark = df.sparkSession
    found = materialize(counts(df, lang, text), "ngrams")
    model = materialize(models(found), "models")
    size = model.count()
    hot = model if size <= HOT else model.orderBy(F.desc("n"), "lang", "gram").limit(HOT)
    arrays = HashArrays(hot.select("lang", "gram", "logp", "rarity").toArrow())  # HOT rows at most
    shared = spark.sparkContext.broadcast(arrays)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                langs, texts = part.column(2).to_pylist(), [t or "" for t in part.column(3).to_pylist()]
                cols = list(zip(*map(base_facts, texts), strict=True))
                logs, odd, rare = ([None] * len(texts) for _ in range(3))
                for k in set(langs):
                    mine = [i for i, x in enumerate(langs) if x == k and texts[i]]
                    if not mine:
                        continue
                    each = [grams(texts[i]) for i in mine]
                    kinds, pos = np.unique(np.concatenate(each), return_inverse=True)
                    p, r = arrays.find(k, kinds)
                    absent = np.isnan(p)
                    nats, rarity, absent = np.where(absent, 0.0, -p)[pos], np.where(absent, 0.0, r)[pos], absent[pos]
                    ends = np.cumsum([*map(len, each)])
                    for i, g, end in zip(mine, each, ends, strict=True):
                        here = slice(end - len(g), end)
                        cut = segments(len(g))
                        logs[i] = float(nats[here].sum())
                        odd[i] = (np.add.reduceat(rarity[here], cut) / np.diff([*cut, len(g)])).astype(np.float32)
                        if absent[here].any():
                            rare[i] = [{"seg": int(np.searchsorted(cut, q, "right") - 1), "gram": int(g[q])} for q in np.flatnonzero(absent[here])]
                out = [*part.columns[:3], *(pa.array(c, pa.int64()) for c in cols), pa.array(logs, pa.float64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(odd, pa.list_(pa.float32())), pa.array(rare, pa.list_(pa.struct([("seg", pa.int32()), ("gram", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(out, names=["_id", "_row", "_lang", *BASE, "_nats", "_size", "_odd", "_rare"])

    rows = df.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.col(text).alias("_text"))
    id_type = df.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(score, f"_id {id_type}, _row long, _lang string, {', '.join(f'{c} long' for c in BASE)}, _nats double, _size long, _odd array<float>, _rare array<struct<seg: int, gram: long>>")
    scored = materialize(scored, "perplexity")
    rest = scored.select("_row", F.col("_lang").alias("lang"), F.explode("_rare").alias("x")).select("_row", "lang", "x.*")
    segs = scored.select("_row", "_lang", F.size("_odd").alias("_n"), "_size", F.posexplode("_odd").alias("seg", "value"))
    if not rest.isEmpty():
        more = lookup(materialize(rest, "rare-trigrams"), model.select("lang", "gram", "logp", "rarity"), ["lang", "gram"], stored=True)
        more = materialize(more.groupBy("_row", "seg").agg(F.sum("logp").alias("logp"), F.sum("rarity").alias("rarity")), "rare-segments")
        width = F.when(F.col("seg") == F.col("_n") - 1, F.col("_size") - F.col("seg") * SEGMENT).otherwise(SEGMENT)
        segs = segs.join(more.drop("logp"), ["_row", "seg"], "left").withColumn("value", F.col("value") + F.coalesce(F.col("rarity") / width, F.lit(0.0)))
        late = more.groupBy("_row").agg(F.sum("logp").alias("_late"))
        scored = scored.join(late, "_row", "left").withColumn("_nats", F.col("_nats") - F.coalesce("_late", F.lit(0.0)))
        segs = materialize(segs, "segments")
    scored = scored.withColumn("_lp", F.col("_nats") / F.col("_size")).drop("_rare", "_odd")

    far = bands(segs, "value").select("_lang", (F.col("mid") + ODD * F.col("spread") + SMALL / F.sqrt("n")).alias("_far"))
    odd = segs.join(far, "_lang").groupBy("_row").agg(F.avg((F.col("value") > F.col("_far")).cast("int")).alias("odd"), F.count(F.lit(1)).alias("_segments"))
    scored = scored.join(odd, "_row", "left")
    out = scored.join(bands(scored, "_lp").drop("n"), "_lang")
    slack = LENGTH / F.sqrt(F.greatest(F.col("_size"), F.lit(1)))
    out = out.withColumns({
        "ppl_low": F.exp(F.col("mid") - BELOW * F.col("spread") - slack), "ppl_high": F.exp(F.col("mid") + ABOVE * F.col("spread") + slack),
        "perplexity": F.exp("_lp"), "odd_most": TOLERATED + FEW_SEGMENTS / F.sqrt(F.greatest(F.col("_segments"), F.lit(1))),
    })
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = F.col("perplexity").between(F.col("ppl_low"), F.col("ppl_high")) & (F.col("odd") <= F.col("odd_most"))
    out = out.select(F.col("_id").alias(id_col), *BASE, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"), "perplexity", "ppl_low", "ppl_high", "odd", "odd_most")
    return materialize(out, "quality", keep=True)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
