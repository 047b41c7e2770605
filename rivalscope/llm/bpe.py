"""Byte-pair merging in numpy: length-bucketed padded matrices.

Distinct pre-tokens are put into matrices of equal length.  Each round, every row
finds the rank of each neighbouring pair in a hash table, merges its leftmost pair
of minimum rank, and is compacted by one cell.  Rows with no pair left drop out.

A very long pre-token would take a round for each of its merges.  It is merged in the same
order by a heap over its pairs instead.
"""

from __future__ import annotations

import base64
import gc
import heapq
import json

import numpy as np
import regex

NONE = np.int32(2**31 - 1)
#: Matrices are cut to about this many cells, which bounds memory whatever the batch holds.
CELLS = 1 << 18
#: Pre-tokens of more bytes than this are merged by themselves.
LONG = 1024
#: Entries that a worker remembers before it starts anew; a cache, so results don't depend on it.
CACHE = 100_000


class PairTable:
    """Open-addressing hash table from (left id, right id) to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo = np.arange(len(key))
        slot = self._slot(key)
        while len(todo):  # vectorized insertion: of those that want a free slot, one each gets it
            free = self.keys[slot[todo]] == -1
            want = todo[free]
            _, first = np.unique(slot[want], return_index=True)
            won = want[first]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = key[won], rank[won], merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; the rank at a slot of an absent pair is NONE."""
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slot = self._slot(key)
        seen = self.keys[slot]
        open_ = np.flatnonzero((seen != key) & (seen != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            open_ = open_[(seen != key[open_]) & (seen != -1)]
        return slot.reshape(left.shape)


class Merger:
    """Merges byte strings to ids.  ``byte_ids``: the id of each single byte; ``vocab``: id -> bytes."""

    def __init__(self, byte_ids: np.ndarray, table: PairTable, vocab: list[bytes]):
        self.byte_ids, self.table, self.vocab = byte_ids, table, vocab
        self._pairs: dict[int, tuple[int, int]] | None = None  # made when a long row comes

    @classmethod
    def from_ranks(cls, path: str) -> Merger:
        """A ``.tiktoken`` file: base64 token and rank on each line; any pair whose joint bytes have a rank merges."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pairs = []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a, b, r, r))
        vocab = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            vocab[r] = token
        return cls(np.array([ranks[bytes([i])] for i in range(256)], np.int32), PairTable(*np.array(pairs, np.int64).T), vocab)

    @classmethod
    def from_json(cls, path: str) -> Merger:
        """A byte-level ``tokenizers`` JSON: only listed merges happen, in the order of the list."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        char = byte_chars()
        back = {c: b for b, c in char.items()}
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(ids[a], ids[b], k, ids[a + b]) for k, (a, b) in enumerate(merges)]
        vocab = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            if all(c in back for c in token):
                vocab[i] = bytes(back[c] for c in token)
        return cls(np.array([ids[char[i]] for i in range(256)], np.int32), PairTable(*np.array(pairs, np.int64).T), vocab)

    def merge(self, tokens: list[bytes]) -> list[np.ndarray]:
        """The ids of each byte string."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(tokens)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            # a bucket: neighbouring lengths, so padding is at most a quarter of the longest
            shortest = int(lengths[order[at]])
            if shortest > LONG:
                out[order[at]] = self._long(tokens[order[at]])
                at += 1
                continue
            end = int(np.searchsorted(lengths[order], max(shortest, shortest * 5 // 4), side="right"))
            end = min(end, int(np.searchsorted(lengths[order], LONG, side="right")), at + max(1, CELLS // max(1, shortest * 5 // 4)))
            rows = order[at:end]
            self._bucket(tokens, rows, lengths[rows], out)
            at = end
        return out

    def _long(self, token: bytes) -> np.ndarray:
        """Merges one long row: the heap gives the leftmost pair of minimum rank, of which either side may be gone by then."""
        table, find = self.table, self._pair
        ids = self.byte_ids[np.frombuffer(token, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        row = np.array(ids, np.int32)
        slot = table.find(row[:-1], row[1:])
        rank = table.rank[slot]
        heap = [(int(rank[i]), i, ids[i], ids[i + 1], int(table.merged[slot[i]])) for i in np.flatnonzero(rank != NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if pair := find(merged, ids[after[j]]):
                    heapq.heappush(heap, (pair[0], i, merged, ids[after[j]], pair[1]))
            if before[i] >= 0 and (pair := find(ids[before[i]], merged)):
                heapq.heappush(heap, (pair[0], before[i], ids[before[i]], merged, pair[1]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _pair(self, a: int, b: int) -> tuple[int, int] | None:
        """(rank, merged id) of a pair, or none."""
        if self._pairs is None:
            used = np.flatnonzero(self.table.keys != -1)
            self._pairs = dict(zip(self.table.keys[used].tolist(), zip(self.table.rank[used].tolist(), self.table.merged[used].tolist(), strict=True), strict=True))
        return self._pairs.get(a << 32 | b)

    def _bucket(self, tokens: list[bytes], rows: np.ndarray, lengths: np.ndarray, out: list[np.ndarray]) -> None:
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(tokens[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        ids = self.byte_ids[flat].astype(np.int32)
        used = lengths.copy()
        live = np.arange(len(rows))
        rank = None
        while True:
            width = ids.shape[1]
            if width < 2 or not len(live):
                break
            slot = self.table.find(ids[:, :-1], ids[:, 1:])
            rank = self.table.rank[slot]
            rank[np.arange(1, width)[None, :] >= used[:, None]] = NONE
            col = rank.argmin(axis=1)  # the first of equal minima is the leftmost
            each = np.arange(len(live))
            can = rank[each, col] != NONE
            for i in np.flatnonzero(~can):
                out[rows[live[i]]] = ids[i, : used[i]].copy()
            ids, used, live, col, slot = ids[can], used[can] - 1, live[can], col[can], slot[can]
            if not len(live):
                break
            each = np.arange(len(live))
            ids[each, col] = self.table.merged[slot[each, col]]
            # compaction: all cells right of the merged pair move one to the left
            take = np.arange(width - 1)[None, :]
            ids = np.take_along_axis(ids, take + (take > col[:, None]), axis=1)[:, : int(used.max())]
        for i, row in enumerate(live):
            out[rows[row]] = ids[i, : used[i]].copy()


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Chunks:
    """Remembers a value for each chunk of a text.

    A chunk is what lies between single spaces that have a non-space on both sides.
    No match of the pre-tokenizer crosses such a place, and the space belongs to what
    follows it, so a text's pre-tokens are those of its chunks.  A text with other
    white space around a split is taken as one chunk.  ``value`` gets the list of
    pre-token lists of unseen chunks and returns a value for each.
    """

    def __init__(self, pattern: str, value) -> None:
        self.find = regex.compile(pattern).findall
        self.value = value
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}

    def of_texts(self, texts: list[str]) -> list[list[object]]:
        if len(self.first) + len(self.later) > CACHE:
            self.first, self.later = {}, {}
        first, later = self.first, self.later
        split: list[tuple[str, list[str]] | None] = []
        new: dict[str, None] = {}
        pending: dict[str, None] = {}
        for text in texts:
            rest = text.split(" ")
            head = rest.pop(0)
            unseen = set(rest).difference(later).difference(pending)
            if head not in first and (not head or head[-1].isspace()) or any([not p or p[0].isspace() or p[-1].isspace() for p in unseen]):
                split.append(None)  # not kept in the cache, as it may be long
                new[text] = None
                continue
            split.append((head, rest))
            if head not in first:
                new[head] = None
            pending.update(dict.fromkeys(unseen))
        if new or pending:
            gc.disable()  # many small tuples are made here, and no cycles
            keys = [*new, *[" " + p for p in pending]]
            values = self.value([self.find(k) for k in keys])
            got = dict(zip(new, values, strict=False))
            later.update(zip(pending, values[len(new) :], strict=True))
            gc.enable()
            for parts in split:
                if parts and (v := got.get(parts[0])) is not None:
                    first[parts[0]] = v
        get = later.__getitem__
        return [[got[text]] if parts is None else [first[parts[0]], *map(get, parts[1])] for text, parts in zip(texts, split, strict=True)]
