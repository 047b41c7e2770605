"""A portrait library that learns a batch at a time, and streams run to their end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.publishing import learned
from ..shared import scratch, shared_dir
from ..sources.store import SCHEMAS, Store


def learn_portraits(store: Store, name: str = "portraits", now: str = "") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: adds the batch's portraits (hero_id, phash, seq) to the store's library.

    A hash that another hero holds is refused; among heroes of one batch the first by ``seq``, then by id, gets it.  The number of the batch is published together with
    the library, and a batch whose number isn't above the published one is passed over, so one that is replayed changes nothing.
    """

    def learn(batch: DataFrame, number: int) -> None:
        if number <= store.marks().get(name, -1):
            return
        with scratch(batch.sparkSession):
            before, held = store.version(), store.hero_portraits
            seen = batch.select("hero_id", "phash", "seq").dropna(subset=["hero_id", "phash"])
            owner = seen.groupBy("phash").agg(F.min_by("hero_id", F.struct("seq", "hero_id")).alias("_first")).join(held.groupBy("phash").agg(F.min("hero_id").alias("_held")), "phash", "left")
            new = seen.join(owner.select("phash", F.coalesce("_held", "_first").alias("hero_id")), ["phash", "hero_id"]).groupBy("hero_id", "phash").agg(F.count(F.lit(1)).alias("_more"))
            cols = [c.strip().split(" ")[0] for c in SCHEMAS["hero_portraits"].split(",")]
            store.publish({"hero_portraits": learned(held, new, "hero_id", now).select(cols)}, after=before, marks={name: number})

    return learn


def run_to_end(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its rows; with ``keys`` the last row of each.

    Batches are written to folders by number, so one that is replayed overwrites itself.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/rivalscope/results/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/_batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, _batch int").parquet(f"{folder}/rows")
    if not keys:
        return rows.drop("_batch")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("x")).select(*keys, "x.*")
