"""Streams give what the batch gives."""

import os

from pyspark.sql import functions as F

from cueforge.streaming import jobs


def drain(df, tmp_path, mode="append"):
    name = f"m{abs(hash(str(tmp_path)))}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def source(spark, tmp_path, batches, schema):
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        for f in (tmp_path / "in" / f"{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_new_cues(spark, tmp_path):
    s = source(spark, tmp_path, [[("a", 0, 100), ("a", 1, 200)], [("a", 2, 150), ("a", 3, 300), ("b", 0, 50)], [("a", 4, 300), ("b", 1, 60)]], "track_id string, pos int, begin_ms long")
    got = sorted((r.track_id, r.begin_ms) for r in drain(jobs.stream_new_cues(s), tmp_path).collect())
    assert got == [("a", 100), ("a", 200), ("a", 300), ("b", 50), ("b", 60)]


def test_word_counts(spark, tmp_path):
    s = source(spark, tmp_path, [[('["a (x): 1"]',)], [('["a (x): 1", "b (x): 1"]',)]], "pairs_raw string")
    assert {(r.word, r.n) for r in drain(jobs.stream_word_counts(s), tmp_path, "complete").collect()} == {("a", 2), ("b", 1)}


def test_chunks_and_dedupe(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:00:29"), ("a", "2024-01-01 00:00:31"), ("a", "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "track_id string, t string").select("track_id", F.to_timestamp("t").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*"))
    assert sorted(r.cues for r in drain(jobs.stream_chunks(s), tmp_path / "c").collect()) == [1, 2]
    assert drain(jobs.stream_dedupe(s, "track_id"), tmp_path / "d").count() == 1


CUES = "track_id string, pos int, begin_ms long, end_ms long, text string"


def test_marks_of_idle_tracks_are_forgotten(spark, tmp_path):
    import time

    schema = "track_id string, pos int, begin_ms long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:

        def run(k, rows, idle_ms):
            """One more file, taken by a query that goes on from the same checkpoint."""
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
            s = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
            q = jobs.stream_new_cues(s, idle_ms=idle_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(processingTime="1 second").start()
            # State with a time to live has batches without data, so the query ends only when it is told to.
            until = time.time() + 60
            while time.time() < until and not any(p["numInputRows"] for p in q.recentProgress):
                time.sleep(0.2)
            q.stop()
            kept = sorted((r.track_id, r.begin_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect())
            return kept, next(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"])

        kept, n = run(0, [(f"t{k}", 0, 100) for k in range(20)] + [("a", 1, 200), ("a", 0, 200)], 30_000)
        assert len(kept) == 21 and n >= 21
        kept, _ = run(1, [("a", 2, 150), ("a", 3, 300)], 30_000)
        assert ("a", 150) not in kept and ("a", 300) in kept
        time.sleep(31)
        kept, n = run(2, [("b", 0, 5)], 30_000)
        kept, n = run(3, [("a", 4, 120)], 30_000)
        assert ("a", 120) in kept and n < 21
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_aligned_streams_equal_the_batch(spark, tmp_path):
    import random

    from cueforge.operators.align import align_tracks

    r = random.Random(2)

    def cues(seed):
        rows, at = [], 0
        for k in range(80):
            at += r.randrange(0, 30_000)
            rows.append((r.choice("ab"), k, at, at + r.randrange(-50, 6000), f"{seed}{k}"))
        return rows

    streams, batches = [], []
    for name in ("x", "y"):
        rows = cues(name)
        far = rows[-1][2] + 10_000_000
        batches.append(spark.createDataFrame(rows, CUES))
        parts = [rows[k : k + 20] for k in range(0, 80, 20)] + [[("z", 999, far, far + 1, "end")]]
        streams.append(source(spark, tmp_path / name, parts, CUES))
    got = sorted(tuple(x) for x in drain(jobs.stream_align(*streams), tmp_path).collect())
    assert got == sorted(tuple(x) for x in align_tracks(*batches).select("track_id", "pos", "begin_ms", "end_ms", "text", "match").collect())
    assert sum(x[-1] != "N/A" for x in got) > 10
