"""Streams against their batch queries, with late and repeated input, and replayed batches."""

import random

from pyspark.sql import functions as F

from rivalscope.operators.merging import merge_cells
from rivalscope.sources.store import SCHEMAS, Store
from rivalscope.streaming.cells import merge_stream
from rivalscope.streaming.files import new_files
from rivalscope.streaming.learning import learn_portraits, run_to_end


def arrive(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{number:03d}")


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_late_cells_give_what_the_batch_merge_gives(spark, tmp_path):
    r = random.Random(3)
    schema = "draft long, path string, seq long, value string, origin string, source string"
    origins = ["name_suggestion", "in_game_scoreboard", "endgame_report", "manual", None, "other"]
    rows = [(r.randint(1, 4), r.choice("ab"), k, r.choice(["x", "y", "z", "", " ", None]), o := r.choice(origins), r.choice([o, "template", "manual", None])) for k in range(240)]
    for n in range(4):  # a draft's later cells come in later batches
        arrive(spark, tmp_path, n, rows[60 * n : 60 * n + 60], schema)
    got = run_to_end(merge_stream(read(spark, tmp_path, schema), ["draft", "path"]), "update", ["draft", "path"])
    want = merge_cells(spark.createDataFrame(rows, schema), ["draft", "path"])
    assert {tuple(x) for x in got.select(want.columns).collect()} == {tuple(x) for x in want.collect()} and got.count() == 8
    # without a column for the source the origin decides
    few = [(1, "a", 0, "x", "manual"), (1, "a", 1, "y", "endgame_report"), (2, "a", 0, None, "manual")]
    arrive(spark, tmp_path / "few", 0, few, schema.rsplit(",", 1)[0])
    got = run_to_end(merge_stream(read(spark, tmp_path / "few", schema.rsplit(",", 1)[0]), ["draft", "path"]), "update", ["draft", "path"])
    assert [tuple(x) for x in got.collect()] == [(1, "a", "x", "manual", 1, 0)]


def test_many_keys_share_a_group_of_the_state(spark, tmp_path, monkeypatch):
    from rivalscope.streaming import cells

    monkeypatch.setattr(cells, "SLOTS", 3)
    day = [__import__("datetime").datetime(2024, 1, 1, 0, 0, 0, x) for x in (123456, 123457)]
    schema = "draft long, day timestamp, seq long, value string, origin string"
    rows = [(k % 20, day[k % 40 // 20], k, str(k % 3), ("manual", "endgame_report", None)[k % 7 % 3]) for k in range(240)]
    for n in range(2):
        arrive(spark, tmp_path / "in", n, rows[120 * n : 120 * n + 120], schema)
    found, keys = {}, ["draft", "day"]
    merged = merge_stream(read(spark, tmp_path / "in", schema), keys)
    query = merged.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, n: found.update({(x.draft, x.day): tuple(x) for x in df.collect()})).start()
    query.awaitTermination()
    want = merge_cells(spark.createDataFrame(rows, schema), keys)
    assert set(found.values()) == {tuple(x) for x in want.select(merged.columns).collect()} and len(found) == 40
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3


def test_committed_and_repeated_files_are_refused(spark, tmp_path):
    schema = "file_sha256 string, ingested_at timestamp, n int"
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    batches = [[("a", day(1), 1), ("a", day(1), 2), ("held", day(1), 3), (None, day(1), 4)], [("a", day(3), 5), ("b", day(3), 6)], [("c", day(28), 7), ("b", day(28), 8)], [("d", day(29), 10)], [("b", day(29), 11), ("late", day(2), 9)]]
    for n, rows in enumerate(batches):
        arrive(spark, tmp_path, n, rows, schema)
    held = spark.createDataFrame([("held",), (None,)], "file_sha256 string")
    got = [x.file_sha256 for x in run_to_end(new_files(read(spark, tmp_path, schema), held)).collect()]
    # the second b comes after the watermark has passed what was known of the first; the late one is behind it
    assert sorted(got) == ["a", "b", "b", "c", "d"]


def test_a_library_learns_a_batch_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("hero_portraits", spark.createDataFrame([(1, 1, "aa", "t", 2)], SCHEMAS["hero_portraits"]))
    learn = learn_portraits(store, now="N")
    batch = lambda *rows: spark.createDataFrame(rows, "hero_id long, phash string, seq long")
    held = lambda: {(x.hero_id, x.phash): x.times_matched for x in store.hero_portraits.collect()}
    first = batch((1, "aa", 0), (2, "aa", 1), (3, "bb", 5), (2, "bb", 4), (2, "bb", 6), (None, "cc", 7), (2, None, 8))
    learn(first, 0)
    assert held() == {(1, "aa"): 3, (2, "bb"): 2} and store.marks() == {"portraits": 0}
    learn(first, 0)
    assert held() == {(1, "aa"): 3, (2, "bb"): 2} and store.version() == 1
    learn(batch((3, "bb", 0), (3, "dd", 1)), 1)
    learn(first, 0)
    assert held() == {(1, "aa"): 3, (2, "bb"): 2, (3, "dd"): 1} and store.marks() == {"portraits": 1}
    learn(batch(), 2)
    assert len({x.id for x in store.hero_portraits.collect()}) == 3
    # the same through a stream
    schema = "hero_id long, phash string, seq long"
    for n in range(3):
        arrive(spark, tmp_path / "in", n, [(4, "ee", n), (5, "ee", n)], schema)
    query = read(spark, tmp_path / "in", schema).writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(learn_portraits(store, "stream")).start()
    query.awaitTermination()
    assert held()[4, "ee"] == 3 and store.marks() == {"portraits": 2, "stream": 2}


def test_runs_in_several_threads_keep_their_tables(spark):
    from threading import Thread

    from rivalscope.shared import global_rank, materialize, scratch, stored

    @stored
    def ranked(n):
        df = materialize(spark.range(n).withColumn("one", F.lit(1)), "rows")
        return global_rank(df, ["id"], "one", "rank")

    found, threads = {}, [Thread(target=lambda n=n: found.update({n: ranked(n).agg(F.sum("rank")).first()[0]})) for n in (50, 60, 70, 80)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert found == {n: n * (n - 1) // 2 for n in (50, 60, 70, 80)}
    import os

    from rivalscope.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file:") + "/rivalscope"
    before = set(os.listdir(folder))
    with scratch(spark):
        inner = ranked(10)
        materialize(inner, "more")
        assert inner.count() == 10
    assert set(os.listdir(folder)) - before == set()
