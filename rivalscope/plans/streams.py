"""Streaming queries over the given tables, run to their end, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lists import shipped
from ..operators.merging import cells_of_events
from ..shared import materialize, shared_dir
from ..sources.drafts import Drafts
from ..sources.fixtures import Tables
from ..sources.store import Store
from ..streaming.cells import merge_stream
from ..streaming.files import new_files
from ..streaming.learning import learn_portraits, run_to_end
from .more import LIBRARY
from .oracle import BASE, ME, MERGE


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, as a stream's path can't be one file


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells that come in a stream."""
    return run_to_end(merge_stream(cells_of_events(stream(spark, sf_dir, "events")), ["draft", "path"]), "update", ["draft", "path"])


def sha(text: str):
    return F.sha2(text, 256)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files, whose bytes are their payload; those of every seventh are committed."""
    held = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 7 = 0").select(sha("props").alias("file_sha256"))
    came = stream(spark, sf_dir, "events").select(sha("props").alias("file_sha256"), F.col("ts").cast("timestamp").alias("ingested_at"))
    return run_to_end(new_files(came, held)).select("file_sha256")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as portraits that a library learns in a stream, beside those it holds."""
    t = Tables(spark, sf_dir)
    store = Store(spark, f"{shared_dir(spark)}/rivalscope/results/library-{uuid.uuid4().hex}")
    store.write("hero_portraits", Drafts(t).old_portraits.withColumn("id", F.col("hero_id")))
    came = shipped(stream(spark, sf_dir, "embeddings")).withColumn("seq", F.col("vec_id"))
    query = came.writeStream.option("checkpointLocation", f"{store.folder}/_checkpoint").trigger(availableNow=True).foreachBatch(learn_portraits(store)).start()
    query.awaitTermination()
    return materialize(store.hero_portraits.select("hero_id", "phash", "times_matched"), "library", keep=True)


BUILD = {"stream_merge_drafts": merged, "stream_new_files": files, "stream_learned_portraits": library}
SQL = {
    "stream_merge_drafts": MERGE,
    "stream_new_files": "SELECT DISTINCT sha256(props) AS file_sha256 FROM events WHERE sha256(props) NOT IN (SELECT sha256(props) FROM events WHERE event_id % 7 = 0)",
    "stream_learned_portraits": BASE.format(subject=ME) + LIBRARY + """, seen AS (SELECT vec_id, CAST(label + 1 AS BIGINT) AS hero_id, lower(lpad(to_hex(CAST(label AS BIGINT) * 3 + vec_id % 7), 16, '0')) AS phash FROM embeddings),
      owner AS (SELECT phash, coalesce((SELECT min(hero_id) FROM learned l WHERE l.phash = s.phash), arg_min(hero_id, vec_id)) AS hero_id FROM seen s GROUP BY phash)
      SELECT hero_id, phash, CAST(sum(n) AS BIGINT) AS times_matched FROM (SELECT hero_id, phash, times_matched AS n FROM learned UNION ALL SELECT hero_id, phash, 1 FROM seen JOIN owner USING (hero_id, phash)) GROUP BY 1, 2""",
}


def queries() -> dict:
    return dict(BUILD)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
