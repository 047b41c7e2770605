"""The corpus pipeline: five stages over ``documents``, each working on all that the one before kept.

``run`` chains the stages, writing each result as Parquet in the shared folder.  There is no
SQL for it: byte-pair merging and the classifier's fit are not expressible.  tests/llm holds the
line, near-dedup, decontamination and BPE stages' operators against brute force or a library, the
classifier's posteriors against a loop, and the verdicts of the stages against small tables.

For every stage: rows are judged, not ids, so null and repeated ids are safe, and rows that are equal
share their fate (but in near-dedup, which keeps one of them).  Null and empty texts pass through all
stages as they are, unless the classifier rejects them; columns that a stage doesn't name pass through;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalscope.llm import queries as llm
from rivalscope.llm.classifier import classify, verdict_key
from rivalscope.llm.common import broadcast_if_small, doc_key, materialize, scratch
from rivalscope.llm.decontam import decontaminate
from rivalscope.llm.lines import dedup_lines
from rivalscope.llm.neardup import near_duplicates, text_key
from rivalscope.llm.tokens import encode_digests


def whole(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows of ``docs`` as one column ``_row``, so that no column of theirs clashes with ``more``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *more)


def keep(docs: DataFrame, key: list[Column], verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own verdict (_k1, _k2, kept) is to keep; ``key`` gives _k1 and _k2 of a row."""
    good = verdicts.filter("kept").select("_k1", "_k2").distinct()
    return whole(docs, *key).join(good.hint("shuffle_hash"), ["_k1", "_k2"], "left_semi").select("_row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops low-quality and toxic documents."""
    return keep(docs, verdict_key(), classify(docs, llm.table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated passages, and documents of which nothing is left by that."""
    out = materialize(dedup_lines(docs), "deduped")  # before the filter, which would be pushed into the rebuilding of texts
    empty = (F.col("n_deleted") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return out.filter(~empty).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, the one of least id and then least text hash, and rows without words."""
    llm.ship(spark)
    found = near_duplicates(docs, width=5, groups=True).select(F.col("doc_id").alias("_id"), "_tk", "_group")
    rows = found.groupBy("_group", "_id", "_tk").agg(F.count(F.lit(1)).alias("_n"))
    best = rows.filter("_group is not null").groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_tk", "_n")).alias("b")).select("b._id", "b._tk", "b._n")
    winners = materialize(best.union(rows.filter("_group is null").select("_id", "_tk", F.lit(1).alias("_n"))), "winners")
    keyed = whole(docs, F.col("doc_id").alias("_doc"), text_key("text").alias("_key"))

    def of(some: DataFrame) -> DataFrame:
        return keyed.join(some, keyed._doc.eqNullSafe(some._id) & (keyed._key == some._tk), "left_semi")

    once, more = winners.filter("_n = 1"), winners.filter("_n > 1")
    again = of(broadcast_if_small(more, 300_000)).dropDuplicates(["_doc", "_key"])  # rows equal in id and text
    return of(once.hint("shuffle_hash")).union(again).select("_row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = decontaminate(docs, llm.table(spark, sf_dir, "benchmark"))
    return keep(docs, doc_key("doc_id", "text"), found.select("_k1", "_k2", (~F.col("contaminated")).alias("kept")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: doc_id, lang, source, token_ids, their number, and digests of the ids and of the bytes they decode to; other columns end here."""
    llm.ship(spark)
    ranks, pattern = llm.vocabulary("byte_bpe_50k.tiktoken"), llm.pretoken_pattern()
    return encode_digests(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, keep_ids=True).drop("text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; only the last one's table stays in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for i, (_, stage) in enumerate(STAGES, 1):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}", keep=i == len(STAGES))
    return docs
