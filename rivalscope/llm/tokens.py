"""Byte-level BPE encoding and decoding (operator 6) and token counts (operator 8)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Chunks, Merger
from .common import text_of

#: Texts are taken in slices of about this many characters, so a batch of long texts doesn't fill a worker.
SLICE = 1_000_000


def slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


class Encoder:
    """Encodes texts to ids by ranks, and ids back to bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        self.merger = Merger.from_ranks(ranks_path)
        self.chunks = Chunks(pattern, self._value)

    def _value(self, found: list[list[str]]) -> list[tuple[tuple[int, ...], str]]:
        distinct = list(dict.fromkeys(chain.from_iterable(found)))
        ids = {t: x.tolist() for t, x in zip(distinct, self.merger.merge([t.encode() for t in distinct]), strict=True)}
        joined = [tuple(ids[tokens[0]] if len(tokens) == 1 else chain.from_iterable([ids[t] for t in tokens])) for tokens in found]
        return [(x, " ".join(map(str, x))) for x in joined]

    def parts(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str]]]:
        """Per text, for each of its chunks: the ids, and their decimals joined by spaces."""
        return self.chunks.of_texts(texts)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable([p[0] for p in parts])) for parts in self.parts(texts)]

    def decode(self, ids: list[int]) -> bytes:
        vocab = self.merger.vocab
        return b"".join([vocab[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One per worker process."""
    return Encoder(ranks_path, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds ``out`` (array<int>): the ids of each whole text, without special tokens.

    Null and empty texts get an empty array.  Very long texts are encoded whole.
    ``ranks_path`` is a ``.tiktoken`` file that every executor can open; ``pattern``
    splits texts into pre-tokens, which are merged separately; no match of it may cross a single space between two
    characters that aren't blank, as those of GPT-2 and its successors don't.  An existing column
    named ``out`` is replaced.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            rows = [x for _, some in slices(texts) for x in e.encode(some)]
            yield pa.array(rows, pa.list_(pa.int32()))

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds ``out`` (binary): the bytes that the ids stand for.

    Null gives null, and so do ids of which one is null or not in the vocabulary; no ids give no bytes.
    """

    @F.arrow_udf("binary")
    def back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(ranks_path, pattern)
        for batch in batches:
            top = len(e.merger.vocab)
            good = [x is not None and all(i is not None and 0 <= i < top for i in x) for x in batch.to_pylist()]
            yield pa.array([e.decode(x) if ok else None for x, ok in zip(batch.to_pylist(), good, strict=True)], pa.binary())

    return df.withColumn(out, back(F.col(ids)))


def encode_digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of the ids that ``encode`` gives and the bytes ``decode`` gives, and with ``keep_ids`` the ids as token_ids.

    The digests are taken where the ids are made, so ids need not travel back to the JVM.  Null and empty texts have no ids.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["token_ids"] if keep_ids else [])]

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(ranks_path, pattern)
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for _, some in slices([t or "" for t in batch.to_pylist()]):
                for parts in e.parts(some):
                    ids = list(chain.from_iterable([p[0] for p in parts]))
                    n.append(len(ids))
                    if keep_ids:
                        kept.append(np.array(ids, np.int32))
                    a.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                    b.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], names=names)

    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    own = "_digest" + "_" * max(map(len, df.columns))  # longer than any column's name
    return df.select(*rest, digest(F.col(f"`{text}`")).alias(own)).select(*rest, f"{own}.*")


class Counter:
    """Counts tokens of a byte-level BPE given as a ``tokenizers`` JSON file."""

    def __init__(self, json_path: str, pattern: str, whole: frozenset[str] | None = None):
        self.merger = Merger.from_json(json_path)
        self.whole = self.prove() if whole is None else whole
        self.chunks = Chunks(pattern, self._value)
        with open(json_path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        #: Added tokens in a text count as one token each, as the library does by default.
        self.added = sorted(filter(None, added), key=len, reverse=True)

    def prove(self) -> frozenset[str]:
        """The vocabulary strings that, encoded alone, are one token: each is merged, and those that end as one id count."""
        tokens = sorted({t for t in self.merger.vocab if t})
        one = [t for t, ids in zip(tokens, self.merger.merge(tokens), strict=True) if len(ids) == 1]
        found = set()
        for t in one:
            try:
                found.add(t.decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a whole pre-token
        return frozenset(found)

    def _value(self, found: list[list[str]]) -> list[int]:
        whole = self.whole
        rest = [t for t in dict.fromkeys(chain.from_iterable(found)) if t not in whole]
        n = dict(zip(rest, map(len, self.merger.merge([t.encode() for t in rest])), strict=True))
        return [sum(1 if t in whole else n[t] for t in tokens) for tokens in found]

    def count(self, texts: list[str]) -> list[int]:
        segments, owner, counts = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            for a in self.added:
                if a in text:
                    cut = [p.split(a) for p in parts]
                    counts[i] += sum(len(c) - 1 for c in cut)
                    parts = list(chain.from_iterable(cut))
            segments += parts
            owner += [i] * len(parts)
        per = np.fromiter(map(sum, self.chunks.of_texts(segments)), np.int64, len(segments))
        np.add.at(counts, np.array(owner, np.int64), per)
        return counts.tolist()


@lru_cache(maxsize=2)
def counter(json_path: str, pattern: str, whole: frozenset[str]) -> Counter:
    return Counter(json_path, pattern, whole)


def count_tokens(df: DataFrame, json_path: str, pattern: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit of each whole text; null and empty texts have none.

    The set of whole-token strings is proved once, on the driver, from the vocabulary
    file (so its size is bounded by the vocabulary) and shipped with the function.
    """
    whole = Counter(json_path, pattern).whole

    @F.arrow_udf("long")
    def n(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(json_path, pattern, whole)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            yield pa.array([x for _, some in slices(texts) for x in c.count(some)], pa.int64())

    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    return df.select(*rest, F.octet_length(text_of(text)).cast("long").alias("n_bytes"), n(F.col(text)).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
