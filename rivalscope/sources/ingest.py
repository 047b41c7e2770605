"""Files of a folder taken in by rules: kind, size, and whether their bytes are known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import kind_guess
from ..operators.editing import safe_stem
from ..shared import broadcast_if_small

# What can be read, and the most bytes of a file.
SUFFIXES = [".png", ".jpg", ".jpeg", ".bmp", ".webp"]
MOST = 40 * 1024 * 1024


@dataclass
class Ingested:
    accepted: DataFrame  #: path, file_sha256, bytes, name, kind
    rejected: DataFrame  #: path, bytes, reason


def ingest(spark: SparkSession, folder: str, committed: DataFrame, most: int = MOST) -> Ingested:
    """All files below ``folder`` (but hidden and empty ones, which Spark passes over): those that a match may have as sources, and the others with the reason.

    A reason is the first of: unsupported type (by suffix, in any case), too large, already in a match (``committed``: file_sha256), copy of another file
    of the folder, of which the first path is taken. ``name`` is made of the file's own, the first twelve digits of its hash and its suffix, so the same bytes
    under the same name never come twice.  Bytes are read of those files only whose suffix and size allow it, and not kept.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    file = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(file, r"[^.](\.[^.]*)$", 1))  # a leading dot is part of the name
    reason = F.when(~suffix.isin(SUFFIXES), "unsupported type").when(F.col("length") > most, "too large")
    listed = found.select("path", F.col("length").alias("bytes"), reason.alias("reason")).filter("reason IS NOT NULL")
    read = found.filter(suffix.isin(SUFFIXES) & (F.col("length") <= most))
    read = read.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("file_sha256"), file.alias("_file"), suffix.alias("_suffix"))
    first = read.groupBy("file_sha256").agg(F.min("path").alias("_first"))
    known = committed.select("file_sha256", F.lit(True).alias("_known")).dropna().distinct()
    judged = read.join(first, "file_sha256").join(broadcast_if_small(known, 100_000), "file_sha256", "left")
    judged = judged.withColumn("reason", F.when(F.col("_known"), "already in a match").when(F.col("path") != F.col("_first"), "copy of another file"))
    stem = F.expr("left(_file, length(_file) - length(_suffix))")
    name = F.concat(safe_stem(stem), F.lit("-"), F.substring("file_sha256", 1, 12), F.col("_suffix"))
    accepted = judged.filter("reason IS NULL").select("path", "file_sha256", "bytes", name.alias("name"), kind_guess(F.col("_file")).alias("kind"))
    return Ingested(accepted, listed.union(judged.filter("reason IS NOT NULL").select("path", "bytes", "reason")))
