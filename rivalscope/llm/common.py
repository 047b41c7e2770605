"""Helpers shared by the corpus operators.

Conventions that hold for every operator of this package:

* A document is identified by ``(id, text)``: rows that agree in both are one
  document and each of them gets that document's result.  The pair is carried as
  two 64-bit hashes (``_k1``, ``_k2``), so null ids and repeated ids are safe.
* A null text is treated as an empty text.
* Only the named columns are read; all other columns of the input pass through
  untouched where an operator returns rows of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, global_rank, heavy_keys, lookup, materialize, partitions_for, scratch, shared_dir  # noqa: F401  used by the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def doc_key(*cols: str) -> list[Column]:
    """Two independent 64-bit hashes of ``cols`` as ``_k1`` and ``_k2``."""
    return [
        F.xxhash64(*(F.col(c) for c in cols)).alias("_k1"),
        F.xxhash64(F.lit("second"), *(F.col(c) for c in cols)).alias("_k2"),
    ]


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def ship(spark: SparkSession) -> None:
    """Give the executors this package (as ``--py-files`` would), once per Spark application."""
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_rivalscope_shipped", False):
        return
    # whole texts travel in these batches, so they are kept short
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp()) / "rivalscope.zip"  # read by the driver's own file server only
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    sc._rivalscope_shipped = True
