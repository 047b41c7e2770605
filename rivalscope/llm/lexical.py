"""Ranked lexical search by K2-treaps over term-document grids (operator 12).

A grid has a row for each term that is asked for and a column for each document of a block; its cells hold what the
term adds to the document's score.  The treap is a quadtree of the cells that aren't empty: four bits a cell
for its quarters, and the largest value below it, level by level.  A search follows the rows of all of an item's
terms from the root at once.  A range of documents is bounded by the sum of the largest values in the cells that
these rows meet there; the ranges of the best bounds are halved first, until no bound is left above what has
been found.  Bounds are exact integers and none is skipped, so results are those of scoring every document.

Blocks are made where the documents lie, without a shuffle; only term counts and each block's best meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize, scratch, text_of

#: ASCII: A-Z become a-z, 0-9 and a-z stay, all else is a space; bytes of other characters stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK_DOCS, BLOCK_POINTS = 1 << 14, 1 << 20  #: of one treap
ITEM_TERMS = 1_000_000  #: terms of the items that are searched for at once
HALVED = 64  #: ranges that are halved at a time


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split()


class Treap:
    """A quadtree of (row, column, value > 0): ``low`` is the first node of each level, ``mask``, ``child`` and ``top`` are of all nodes."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.depth = depth = max(1, int(max(rows.max(), cols.max())).bit_length())
        code = np.zeros(len(rows), np.int64)
        for b in range(depth):  # of a row and a column the bits by turns
            code |= ((rows >> b) & 1) << (2 * b + 1) | ((cols >> b) & 1) << (2 * b)
        order = np.argsort(code, kind="stable")
        code, top = code[order], values[order]
        levels = [(np.zeros(len(code), np.uint8), top)]
        for _ in range(depth):
            quarter, up = (code & 3).astype(np.uint8), code >> 2
            starts = np.flatnonzero(np.diff(up, prepend=-1))
            levels.append((np.bitwise_or.reduceat(np.uint8(1) << quarter, starts), np.maximum.reduceat(top, starts)))
            code, top = up[starts], levels[-1][1]
        levels.reverse()
        self.mask, self.top = (np.concatenate([x[i] for x in levels]) for i in (0, 1))
        # children lie in order in the next level: the first one's place is how many came before
        self.child = 1 + np.cumsum(COUNT[self.mask], dtype=np.int64) - COUNT[self.mask]

    def search(self, rows: np.ndarray, most: int, least: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the ``most`` highest sums over ``rows`` above ``least``, the lowest columns of equal ones."""
        rows = rows[rows < 1 << self.depth]  # no row above has a cell
        node = np.zeros((1, len(rows)), np.int64)
        level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.full(1, self.top[0] * len(rows))
        found_c, found_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = columns  # an equal score counts in a lower column only
        while len(bound):
            if len(bound) > HALVED:
                pick = np.argpartition(-bound, HALVED)[:HALVED]
                rest = np.ones(len(bound), bool)
                rest[pick] = False
            else:
                pick, rest = slice(None), np.zeros(len(bound), bool)
            nodes, lev, start = node[pick], level[pick], first[pick]
            side = self.depth - 1 - lev
            row_bit = (rows[None, :] >> side[:, None]) & 1
            mask = np.where(nodes >= 0, self.mask[nodes], 0)
            halves = []
            for half in (0, 1):
                quarter = 2 * row_bit + half
                here = (mask >> quarter) & 1
                to = np.where(here, self.child[nodes] + COUNT[mask & ((1 << quarter) - 1)], -1)
                halves.append((to, lev + 1, start + (half << side), np.where(to >= 0, self.top[to], 0).sum(axis=1)))
            to, lev, start, sums = (np.concatenate(x) for x in zip(*halves, strict=True))
            leaf = lev == self.depth
            good = leaf & (sums > least)
            if good.any():
                found_c, found_s = np.concatenate([found_c, start[good]]), np.concatenate([found_s, sums[good]])
                if len(found_c) > most:
                    best = np.lexsort((found_c, -found_s))[:most]
                    found_c, found_s = found_c[best], found_s[best]
                    least, last = max(least, int(found_s[-1]) - 1), int(found_c[-1])
            more = ~leaf
            node, level, first, bound = (np.concatenate([a[rest], b[more]]) for a, b in ((node, to), (level, lev), (first, start), (bound, sums)))
            alive = (bound > least) & ((bound > least + 1) | (first < last))
            node, level, first, bound = node[alive], level[alive], first[alive], bound[alive]
        order = np.lexsort((found_c, -found_s))
        return found_c[order], found_s[order]


COUNT = np.array([bin(i).count("1") for i in range(16)], np.int64)  #: bits that are set


def postings(docs: DataFrame, id_col: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(_id, n, term, tf): of each document its number of terms, and those of the vocabulary with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # ITEM_TERMS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, term, tf = [], [], []
            for t in batch.column(1).to_pylist():
                words = terms(t) if t else []
                n.append(len(words))
                ids, counts = np.unique(np.fromiter((i for i in map(known.get, words) if i is not None), np.int32), return_counts=True)
                term.append(ids)
                tf.append(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["_id", "n", "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_t")).mapInArrow(run, f"_id {kind}, n long, term array<int>, tf array<long>")


def best_of_blocks(found: DataFrame, items: list[np.ndarray], weight: np.ndarray, total: int, length: int, most: int) -> DataFrame:
    """(item, _id, score): the best documents of each task's blocks for each item (row numbers of the weights)."""
    shared = found.sparkSession.sparkContext.broadcast((items, weight))
    kind = found.schema["_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best: list[list[tuple[int, object]]] = [[] for _ in items]
        order = lambda x: (-x[0], x[1] is None, x[1])

        def search(parts: list[pa.RecordBatch]) -> None:
            block = pa.Table.from_batches(parts).combine_chunks()
            ids = block["_id"].to_pylist()
            place = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))  # columns in the order of ids
            block = block.take(pa.array(place, pa.int64()))
            ids = [ids[i] for i in place]
            held = block["term"].combine_chunks()
            rows, tf = held.flatten().to_numpy().astype(np.int64), block["tf"].combine_chunks().flatten().to_numpy()
            cols = np.repeat(np.arange(len(ids)), np.diff(held.offsets.to_numpy()))
            size = 50 + (50 * block["n"].to_numpy() * total) // max(1, length)
            values = weight[rows] * ((1_000_000_000 * tf) // (1000 * tf + 20 * size[cols]))
            some = values > 0
            if not some.any():
                return
            treap = Treap(rows[some], cols[some], values[some])
            for i, wanted in enumerate(items):
                full = len(best[i]) >= most
                got = treap.search(wanted, most, best[i][-1][0] - 1 if full else 0, len(ids)) if len(wanted) else ((), ())
                if len(got[0]):
                    best[i] = sorted([*best[i], *((int(s), ids[c]) for c, s in zip(*got, strict=True))], key=order)[:most]

        parts, docs, points = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                more = len(part.column(2).flatten())
                if parts and (docs + part.num_rows > BLOCK_DOCS or points + more > BLOCK_POINTS):
                    search(parts)
                    parts, docs, points = [], 0, 0
                parts.append(part)
                docs, points = docs + part.num_rows, points + more
        if parts:
            search(parts)
        flat = [(i, d, s) for i, found in enumerate(best) for s, d in found]
        for at in range(0, len(flat), 10_000):
            item, d, s = zip(*flat[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(d, doc_type), pa.array(s, pa.int64())], names=["item", "_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(kind)
    return found.mapInArrow(run, f"item int, _id {kind.simpleString()}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` documents of highest score above 0 for each item, the lowest ids of equal scores first.

    Terms are runs of 0-9, a-z, A-Z (in lower case) and non-ASCII characters, of whole texts.  With N documents that have a term, L terms in
    all, and df documents that hold a term, its weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 50 + 50nN div L and the score
    sum of weight * (10**9 tf div (1000 tf + 20 m)) over the item's distinct terms.  Null and empty texts have no terms: such documents are
    never found, and such items give no rows, as do items none of whose terms occur.  Rows of ``items`` equal in id and text are one item, others with the same id (or
    null) are ranked apart.  Each row of ``docs`` is a document; a null id comes last of equal scores.  Empty tables give no rows; other columns are not read.

    Items are searched for in parts of about ITEM_TERMS terms (a part may have one longer item), each over all documents.
    """
    with scratch(docs.sparkSession):
        return materialize(_ranked_search(docs, items, id_col, text, item_id, item_text, most), "ranked", keep=True)


def _ranked_search(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_id: str, item_text: str, most: int) -> DataFrame:
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("_item"), F.col(f"`{item_text}`").alias("_text")).filter("_text <> ''").distinct()
    asked = materialize(asked.withColumn("_size", (F.octet_length("_text") / 2 + 1).cast("long")), "items")  # no more terms than that
    total_size = asked.agg(F.sum("_size")).first()[0] or 0
    parts = -(-total_size // ITEM_TERMS)
    out = None
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(parts)) == k).orderBy("_item", "_text").collect()  # ITEM_TERMS or so, by hash
        found = _search_part(docs, [r["_text"] for r in rows], id_col, text, most)
        names = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)], f"item int, _item {asked.schema['_item'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").select(F.col("_item").alias(item_id), "rank", F.col("_id").alias(id_col), "score")
        out = found if out is None else out.union(found)
    if out is None:
        kinds = asked.schema["_item"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
        out = spark.createDataFrame([], f"`{item_id}` {kinds[0]}, rank int, `{id_col}` {kinds[1]}, score long")
    return out


def _search_part(docs: DataFrame, texts: list[str], id_col: str, text: str, most: int) -> DataFrame:
    spelled = [sorted(set(terms(t))) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted({w for words in spelled for w in words}))}
    found = materialize(postings(docs, id_col, text, vocabulary), "postings")
    total, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = found.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # of the vocabulary
    weight = np.zeros(len(vocabulary), np.int64)
    for r in held:
        weight[r["t"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["df"] + 1)))
    # rows of the grid: terms that weigh something, those of one item side by side where they can
    wanted = [np.array([i for w in words if weight[i := vocabulary[w]] > 0], np.int64) for words in spelled]
    best = materialize(best_of_blocks(found, wanted, weight, total, length, most), "best-of-blocks")
    # twice: first parts of an item, as there are as many rows as tasks
    order = [F.desc("score"), F.asc_nulls_last("_id")]
    few = best.withColumn("_p", F.pmod(F.xxhash64("_id"), F.lit(64))).withColumn("_r", F.row_number().over(W.partitionBy("item", "_p").orderBy(*order))).filter(F.col("_r") <= most)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= most).select("item", "rank", "_id", "score")
