"""Spelling variants grouped by the pivotal prefix filter for one edit (operator 11).

Grams are a word's pairs of neighbouring characters, ordered from the rarest over all words.  A word's prefix
are its three rarest grams; of these, two that don't overlap are its pivots, chosen by
dynamic programming for the least sum of frequencies.  One edit spoils at most one of two such pivots, and
three grams at most have to be looked at in the other word: of two words an edit apart, that whose prefix ends at the
rarer gram has a pivot that the other holds in its prefix, moved by one place at most.

The edit then lies on one side of that pivot, and on that side in one half; all the rest of the word is the same in both.
So words meet by pivot and rest, which few share, instead of by the pivot alone, which many do: for each word that
asks eight keys at most, for each word that is asked those of its prefix grams at every position within the limit (five at most).  Who meets is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialize, scratch

#: Latin-1 bytes: A-Z become a-z, other letters stay, all else is a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
HELD = 1 << 19  #: distinct words that a counting task holds before it passes its counts on


def word_counts(df: DataFrame, id_col: str, text: str, one_in: int, least_length: int, least_count: int) -> DataFrame:
    """(word, n): maximal runs of a-z, A-Z and U+00C0 to U+00FF, A-Z in lower case, as they are or less a code point.

    What is deleted follows from the CRC-32 of id and run.  Each task sums its part before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in sums], pa.string()), pa.array(sums.values(), pa.int64())], names=["word", "n"])
            sums.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in Counter(t.encode("latin-1", "replace").translate(LETTERS).split()).items():
                    size = len(run)
                    if size >= least_length:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % one_in:
                            sums[run] += n
                        elif size > least_length:
                            sums[run[: h % size] + run[h % size + 1 :]] += n
                if len(sums) > HELD:
                    yield flush()
        if sums:
            yield flush()

    part = df.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).mapInArrow(count, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


@lru_cache(1 << 16)
def right_of(n: int, p: int) -> tuple[tuple[int, int], ...]:
    """What an edit to the right of the pivot at ``p`` leaves of a word of ``n``: (characters from the start, from the end), by the half of the right part that it is in."""
    rest = n - p - 2
    return ((p + 2 + rest // 2, 0), (p + 2, rest - rest // 2)) if p >= 0 and rest >= 0 else ()


@lru_cache(1 << 16)
def left_of(n: int, p: int) -> tuple[tuple[int, int], ...]:
    """As ``right_of``, for an edit to the left."""
    return ((0, n - p // 2), (p // 2, n - p)) if p >= 0 and n - p >= 2 else ()


@lru_cache(1 << 16)
def shapes(n: int, q: int) -> frozenset[tuple[int, int]]:
    """What a word of ``n`` with a prefix gram at ``q`` has to offer to words of one character less, as many and one more, whose pivot is at most one place off."""
    return frozenset(x for d in (-1, 0, 1) for x in (*right_of(n - d, q), *left_of(n - d, q - d)))


def prefix(word: str, order: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """The rank of the third rarest gram, the places of the three rarest, and those of all that another word's pivot can be.

    Equal grams count by place.  An edit makes two new grams at most, so what is among one word's first three is
    among the other's first five; and no pivot ranks behind the third.
    """
    first = sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))[:5]
    last = first[2][0]
    return last, sorted(i for _, i in first[:3]), [i for rank, i in first if rank <= last]


def pivots(word: str, places: list[int], weight: dict[str, int]) -> tuple[int, int]:
    """Two of ``places``, which don't overlap, of the least sum of weights: for each place as the second, the lightest that ends before it is carried along."""
    best, single, waiting = None, None, deque()
    for p in places:
        while waiting and waiting[0][1] <= p - 2:
            single = min(single, waiting.popleft()) if single else waiting.popleft()
        w = weight[word[p : p + 2]]
        if single and (best is None or single[0] + w < best[0]):
            best = (single[0] + w, single[1], p)
        waiting.append((w, p))
    return best[1:]


PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


class Hashes:
    """Hashes of what is left of a word, each in constant time from those of its beginnings; equal hashes of different rests cost a comparison, no more."""

    def __init__(self, word: str):
        self.n, self.at, h = len(word), [0], 0
        for c in word:
            h = (h * BASE + ord(c)) % PRIME
            self.at.append(h)

    def __call__(self, from_start: int, from_end: int) -> int:
        """Of the first and the last so many characters."""
        rest = self.n - from_end
        return (self.at[from_start] * 0x5851F42D4C957F2D + (self.at[self.n] - self.at[rest] * power(from_end)) * 0x14057B7EF767814F + from_start * 31 + from_end) % PRIME


@lru_cache(1 << 16)
def power(n: int) -> int:
    return pow(BASE, n, PRIME)


SHORT = 200  #: a word of more code points isn't repeated with each of its keys, but looked up by number


def keyed(words: DataFrame, weight: dict[str, int], ask: bool) -> DataFrame:
    """(key, id, size, last, word, n) of what words (id, word, n) ask for by their pivots, or of what they offer by their prefixes; no ``word`` if it isn't SHORT."""
    order = {g: i for i, g in enumerate(sorted(weight, key=lambda g: (weight[g], g)))}
    shared = words.sparkSession.sparkContext.broadcast((weight, order))  # pairs of 90 letters: 8100 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, order = shared.value
        for batch in batches:
            sizes, lasts, keys, held = [], [], [], []
            for w in batch.column(1).to_pylist():
                last, rarest, possible = prefix(w, order)
                n = len(w)
                if ask:
                    found = {x for p in pivots(w, rarest, weight) for x in (*right_of(n, p), *left_of(n, p))}
                else:
                    found = {x for x in frozenset().union(*(shapes(n, q) for q in possible)) if max(x) <= n}
                of = Hashes(w)
                sizes.append(n)
                lasts.append(last)
                keys.append([of(*x) for x in found])
                held.append(w if n <= SHORT else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(lasts, pa.int32()), pa.array(held, pa.string()), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["id", "size", "last", "word", "n", "keys"])

    return words.mapInArrow(run, "id long, size int, last int, word string, n long, keys array<long>").select(F.explode("keys").alias("key"), "id", "size", "last", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(id, near, near_n): all ordered pairs of ``words`` (id, word, n), stored, that are one edit apart."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    weight = {r["g"]: r["n"] for r in grams.collect()}  # pairs of 90 letters
    names = ["id", "size", "last", "word", "n"]
    asks = materialize(keyed(words, weight, True), "asks")
    held = keyed(words, weight, False).toDF("key", *(f"near_{c}" for c in names))
    once = F.levenshtein("word", "near_word", 1) == 1
    met = lookup(asks, held, ["key"], stored=True).filter((F.col("last") <= F.col("near_last")) & (F.abs(F.col("size") - F.col("near_size")) <= 1) & (F.col("id") != F.col("near_id")) & F.coalesce(once, F.lit(True)))
    met = materialize(met.select("id", "word", "n", "near_id", "near_word", "near_n"), "near-words")
    both = met.union(met.select("near_id", "near_word", "near_n", "id", "word", "n")).select("id", "word", "near_id", "near_word", "near_n").distinct()
    pairs, blank = both.filter("word is not null and near_word is not null"), both.filter("word is null or near_word is null")
    if not blank.isEmpty():  # words that aren't SHORT
        blank = blank.select("id", "near_id", "near_n").join(words.select("id", "word"), "id").join(words.select(F.col("id").alias("near_id"), F.col("word").alias("near_word")), "near_id")
        pairs = pairs.unionByName(blank.filter(once))
    return pairs.select("id", F.col("near_word").alias("near"), "near_n")


def group_spellings(df: DataFrame, id_col: str = "doc_id", text: str = "text", one_in: int = 97, least_length: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are the runs of letters (Latin-1 ones, A-Z in lower case) of all texts, of ``least_length`` code points
    and ``least_count`` occurrences (``n``) or more; in one run in ``one_in``, by the CRC-32 of id and run, a code point is left out first.
    Words are near if one insertion, deletion or replacement makes one of the other; ``n_near`` is their number.  ``form`` is the near word of
    largest n, the smallest of equals, if its n is ``times`` this word's n or more, else null; ``form_n`` its n.  ``root`` is what forms lead to.
    Null and empty texts have no words; a null id counts as an empty one; rows that are repeated count each time.  An empty table gives no
    rows.  Other columns are not read.  ``least_length`` is 4 or more, ``times`` 2 or more, so that forms can't lead in a circle.
    """
    if least_length < 4 or times < 2:
        raise ValueError("words need three grams, and a form must be more frequent")
    with scratch(df.sparkSession):
        return materialize(_group_spellings(df, id_col, text, one_in, least_length, least_count, times), "spellings", keep=True)


def _group_spellings(df: DataFrame, id_col: str, text: str, one_in: int, least_length: int, least_count: int, times: int) -> DataFrame:
    counted = word_counts(df, id_col, text, one_in, least_length, least_count)
    words = materialize(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = near_words(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("b"))
    full = words.join(near, "id", "left")
    best = -F.col("b.n") >= times * F.col("n")
    full = full.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(best, F.col("b.near")).alias("form"), F.when(best, -F.col("b.n")).alias("form_n"))
    full = materialize(full, "forms")
    # a chain of forms is short, as n at least doubles; each round doubles the step
    ways = materialize(full.filter("form is not null").select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("up"))
        ways = materialize(lookup(ways, further, ["root"], "left", stored=True).select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "ways")
        if ways.filter("moved").isEmpty():
            break
        ways = ways.drop("moved")
    return full.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
