"""Readers that cut large files, and the writer of one file a track."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cueforge.functions.timecode import ms_to_srt
from cueforge.sources import readers, tracks, writers

CUE = "track_id string, pos long, begin_ms long, end_ms long, text string"


@pytest.fixture
def small_ranges(spark):
    """Files are cut every few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_srt(r, end):
    gap = lambda: end + r.choice(("", " ", "\t", end, end + end + " ")) + end
    blocks = []
    for k in range(r.randrange(1, 60)):
        times = r.choice(("00:00:01,000 --> 00:00:02,500", "00:00:01,000 -> 2", "01:02:03,004 --> 01:02:04,000", "x --> y"))
        lines = [r.choice((str(k), "x", f" {k} ")), times, *(r.choice(("olá", "你好 ", "- a", "<i>b</i>")) for _ in range(r.randrange(4)))]
        blocks.append(end.join(lines))
    return r.choice(("", "﻿", end, "  ")) + "".join(b + gap() for b in blocks) + r.choice(("", end))


def write(folder, files):
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    return "file://" + str(folder)


@pytest.mark.parametrize("strict", [True, False])
def test_cut_srt_files_equal_whole_ones(spark, tmp_path, small_ranges, strict):
    r = random.Random(3)
    path = write(tmp_path, {f"f{k}.srt": odd_srt(r, r.choice(("\n", "\n", "\r\n", "\r"))) for k in range(12)})
    columns = ["track_id", "pos", "idx", "begin_ms", "end_ms", "text"]
    in_order = lambda df: [(x.track_id, *x[2:]) for x in df.select(*columns).orderBy("track_id", "pos").collect()]
    want = in_order(readers.read_srt(spark, path, strict))
    for end in ("\n", "\r\n"):
        cut = readers.read_srt(spark, path, strict, split=True, line_end=end)
        assert cut.rdd.getNumPartitions() > 12
        assert in_order(cut) == want and len(want) > 50
        assert cut.groupBy("track_id", "pos").count().where("count > 1").count() == 0


def test_cut_vtt_and_ttml_files_equal_whole_ones(spark, tmp_path, small_ranges):
    r = random.Random(4)
    (tmp_path / "v").mkdir()
    (tmp_path / "t").mkdir()
    vtt = lambda n: "WEBVTT" + r.choice(("", " - x", "\nKind: captions")) + "\n\n" + "\n\n".join(f"00:{k:02}.000 --> 00:{k:02}.900\nlinha {k}\nb" if k % 5 else f"note {k}\n00:01.000 --> 00:02.000\nx" for k in range(n))
    path = write(tmp_path / "v", {f"f{k}.vtt": vtt(40) for k in range(4)})
    rows = lambda df: sorted(tuple(x) for x in df.drop("pos").collect())
    assert rows(readers.read_vtt(spark, path, split=True)) == rows(readers.read_vtt(spark, path)) != []
    ttml = lambda rate: f'<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttp="x" {rate}><body><div>' + "".join(f'<p begin="{r.randrange(99)}{r.choice("st")}" end="{k}s">a <span>b{k}</span></p>\n' if k % 7 else '<p begin="5s"/>' for k in range(60)) + "</div></body></tt>"
    path = write(tmp_path / "t", {"a.xml": ttml('ttp:tickRate="10"'), "b.xml": ttml(""), "c.xml": ttml("ttp:tickRate='1000'")})
    rows = lambda df: sorted(tuple(x) for x in df.drop("idx", "pos").collect())
    assert rows(readers.read_ttml(spark, path, split=True)) == rows(readers.read_ttml(spark, path)) != []


def test_ttml_characters(spark, tmp_path):
    body = "".join(f'<x:p begin="{k}s">{t}</x:p >' for k, t in enumerate(["&#x4F60;&#22909;&lt;b&gt;", "a<![CDATA[<i>&amp;]]>b", "c<!-- <x:p>no</x:p> -->d", "&amp;lt; &nope; &#0; &#x110000; &#1114111;", "<?pi x?>e<br/>f", "&#128512;"]))
    path = write(tmp_path, {"a.xml": f'<x:tt xmlns:x="http://www.w3.org/ns/ttml"><!-- <x:p begin="9s">no</x:p> -->{body}</x:tt>'})
    assert [x.text for x in readers.read_ttml(spark, path).orderBy("begin_ms").collect()] == ["你好<b>", "a<i>&amp;b", "cd", "&lt; &nope; &#0; &#x110000; \U0010ffff", "ef", "😀"]


def test_srt_files_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        write(source, {f"f{k}.srt": "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},500\nt{k}" for i in range(1, 6))})
    q = readers.stream_srt(spark, "file://" + str(source)).writeStream.format("memory").queryName("srt_stream").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(x) for x in spark.table("srt_stream").collect())
    assert got == sorted((f"f{k}", i, i * 1000, i * 1000 + 500, f"t{k}") for k in range(3) for i in range(1, 6))


def cues(spark, n):
    return spark.createDataFrame([(f"t{k % n}", k, k * 1000, k * 1000 + 500, f"texto {k}\n<b>") for k in range(n * 3)], CUE)


def test_one_named_file_a_track(spark, tmp_path):
    df = cues(spark, 40).unionByName(spark.createDataFrame([("a/b%.c d", 1, 0, 1, "x"), (None, 1, 0, 1, None), ("_h", 2, 0, 1, "y")], CUE))
    for path, scheme in ((tmp_path / "one", "file://"), (tmp_path / "two", "")):
        tracks.write_srt_files(df, scheme + str(path))
        assert sorted(os.listdir(path)) == sorted([*(f"t{k}.srt" for k in range(40)), "a%2Fb%25.c d.srt", "%.srt", "%5Fh.srt"])
        whole = {r.track_id: r.content for r in writers.render_srt(df.where("track_id like 't%'")).collect()}
        assert {f"t{k}": (path / f"t{k}.srt").read_text() for k in range(40)} == whole
        back = readers.read_srt(spark, "file://" + str(path) + "/t*.srt", split=True)
        assert sorted((r.track_id, r.begin_ms, r.text) for r in back.collect()) == sorted((r.track_id, r.begin_ms, r.text.strip()) for r in df.where("track_id like 't%'").collect())
    tracks.write_ttml_files(df.where("track_id = 't1'"), str(tmp_path / "one"))
    assert os.listdir(tmp_path / "one") == ["t1.xml"]
    assert (tmp_path / "one" / "t1.xml").read_text() == writers.render_ttml_secs(df.where("track_id = 't1'")).first().content
    tracks.write_ttml_files(df.where("track_id = 't2'"), str(tmp_path / "one"), mode="append")
    assert sorted(os.listdir(tmp_path / "one")) == ["t1.xml", "t2.xml"]
    assert sorted(os.listdir(tmp_path)) == ["one", "two"]
    tracks.write_srt_files(df.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    path = tmp_path / "out"
    tracks.write_srt_files(cues(spark, 3), str(path))
    before = {f: (path / f).read_text() for f in os.listdir(path)}
    bad = cues(spark, 30).withColumn("text", F.when(F.col("pos") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("text")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tracks.write_srt_files(bad, str(path))
    assert {f: (path / f).read_text() for f in os.listdir(path)} == before
    assert os.listdir(tmp_path) == ["out"]


def test_many_tracks(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("track_id"), F.lit(1).alias("pos"), F.lit(0).alias("begin_ms"), F.lit(1000).alias("end_ms"), ms_to_srt("id").alias("text"))
    tracks.write_srt_files(df, str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 20_000
