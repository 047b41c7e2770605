"""Files that come in a stream: those that a match has already, or that came before, are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_files(files: DataFrame, committed: DataFrame, sha: str = "file_sha256", at: str = "ingested_at", delay: str = "7 days") -> DataFrame:
    """The rows of a stream of files (``sha``, ``at`` a timestamp) whose bytes neither a committed match nor an earlier file has.

    ``committed`` (file_sha256) is a table, read anew for each batch.  A copy is known for at least ``delay`` after the first, by event time, and forgotten later, so
    state doesn't grow without end; what comes later than ``delay`` behind what earlier batches had is left out.  Files without a hash are left out.
    """
    known = committed.select(F.col("file_sha256").alias(sha)).dropna().distinct()
    fresh = files.filter(F.col(sha).isNotNull()).join(known, sha, "left_anti")
    return fresh.withWatermark(at, delay).dropDuplicatesWithinWatermark([sha])
