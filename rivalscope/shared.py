"""Tables in the folder that driver and executors share, numbering of rows over all partitions, and joins on keys with very many rows."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session in one process (tests) may do without it; tables then lie below its warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return found.rstrip("/")


class Run:
    """One call of an operator: the folder of its tables, and the run that called it."""

    def __init__(self, spark: SparkSession, outer: Run | None):
        self.spark, self.outer = spark, outer
        self.folder = f"{shared_dir(spark)}/rivalscope/{uuid.uuid4().hex}"

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: The innermost run of this thread; other threads have runs of their own.
_run: ContextVar[Run | None] = ContextVar("run", default=None)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives executor loss.

    Inside ``scratch`` the table goes with it at its end.  With ``keep`` it is a result: it lives as long as
    the run that called this one, or, where there is none, until the folder is cleared, as outside ``scratch``.
    """
    spark, run = df.sparkSession, _run.get()
    owner = run.outer if run and keep else run
    path = f"{owner.folder if owner else shared_dir(spark) + '/rivalscope/results'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what ``materialize`` wrote inside it and was not told to keep; runs may nest and go on in several threads."""
    run = Run(spark, _run.get())
    token = _run.set(run)
    try:
        yield
    finally:
        _run.reset(token)
        run.remove()


def stored(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that writes tables on its way: they are removed at its end, and its result is written too, as it would read them."""

    @functools.wraps(operator)
    def whole(*args: object, **named: object) -> DataFrame:
        with scratch(SparkSession.active()):
            return materialize(operator(*args, **named), operator.__name__, keep=True)

    return whole


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, keys: list[str], weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over all rows whose ``keys`` sort strictly before this row's.

    ``keys`` must be unique per row.  Rows are range-partitioned, each partition is
    summed, and only one number per partition (bounded by the partition count) is
    carried across, so no task sees more than its own range.
    """
    return global_ranks(df, keys, {weight: out})


def global_ranks(df: DataFrame, keys: list[str], outs: dict[str, str]) -> DataFrame:
    """``global_rank`` of several weights (``outs``: weight to column) at once."""
    n = partitions_for(df)
    ranged = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    # the sums of all rows before, by order within a partition and by number of the partitions
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = {weight: f"_sum{i}" for i, weight in enumerate(outs)}
    offsets = ranged.groupBy("_pid").agg(*(F.sum(weight).alias(c) for weight, c in sums.items()))
    offsets = offsets.select("_pid", *(before(c, W.orderBy("_pid")).alias(c) for c in sums.values()))
    ranked = ranged.select("*", *(before(weight, W.partitionBy("_pid").orderBy(*keys)).alias(f"_in{c}") for weight, c in sums.items()))
    # one row per partition: the bound of this broadcast is the partition count
    ranked = ranked.join(F.broadcast(offsets), "_pid")
    return ranked.select(*df.columns, *((F.col(c) + F.col(f"_in{c}")).cast("long").alias(outs[weight]) for weight, c in sums.items()))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when a count proves it has at most ``max_rows`` rows, else ``df`` for a shuffled join.

    ``df`` should be materialized or cheap, as the count runs it.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


SLOTS = 1 << 16  #: of the hash counts that find heavy keys
FEW = 1000  #: a key of fewer rows is never heavy


def heavy_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The values of ``keys`` (none null) that hold more than FEW rows and 4 / SLOTS of all: SLOTS / 4 at most, which bounds their broadcast.

    Hash slots are counted first, which shuffles little; only keys in full slots are counted themselves.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    some = df.select(*keys).dropna()
    counts = {r["s"]: r["n"] for r in some.groupBy(slot.alias("s")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).collect()}  # at most SLOTS rows
    # slots of FEW rows or less aren't in the sum; that makes the limit lower only while all is small
    limit = max(FEW, 4 * sum(counts.values()) // SLOTS)
    full = df.sparkSession.createDataFrame([(s,) for s, n in counts.items() if n > limit], "s int")
    found = some.withColumn("s", slot).join(F.broadcast(full), "s").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(*keys)
    return materialize(found, "heavy-keys")


SALTS = 64  #: parts that the rows of a heavy key are dealt to


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """``left.join(right, keys, how)`` (inner or left) for a ``right`` with at most one row a key.

    The rows of heavy keys (``hot``, by default those of ``left``, which is then read twice) are dealt to SALTS parts,
    for each of which their row of ``right`` is repeated: a bounded number of rows.  The part follows from the row's other
    columns, and from its place if ``left`` is ``stored``, where that can't change when a task is run again.
    """
    hot = heavy_keys(left, keys) if hot is None else hot
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = F.broadcast(hot.select(*keys, F.lit(SALTS).alias("_salts")))
    other = [F.col(c) for c in left.columns if c not in keys]
    place = F.xxhash64(*other, *([F.monotonically_increasing_id()] if stored else []))
    many = left.withColumn("_place", place).join(hot, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod("_place", F.lit(SALTS))).otherwise(0).cast("int"))
    one = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return many.drop("_place", "_salts").join(one, [*keys, "_salt"], how).drop("_salt")
