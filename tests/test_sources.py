"""Files written, read and parsed."""

from cueforge.sources import readers, writers

CUE = "track_id string, pos int, begin_ms long, end_ms long, text string"


def put(path, name, data):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_srt(spark, tmp_path):
    text = "﻿1\n00:00:01,000 --> 00:00:02,000\nolá\nmundo\n\n2\n00:00:03,000\n\nx\n00:00:03,000 --> 00:00:04,000\nbad index\n\n4\n00:00:05,000 --> 00:00:06,500\r\nfim\n"
    p = put(tmp_path / "s", "ep.srt", text)
    assert [tuple(r) for r in readers.read_srt(spark, p).orderBy("pos").select("track_id", "idx", "begin_ms", "end_ms", "text").collect()] == [("ep", 1, 1000, 2000, "olá\nmundo"), ("ep", 4, 5000, 6500, "fim")]
    assert [r.text for r in readers.read_srt(spark, p, strict=False).orderBy("pos").collect()] == ["olá mundo", "bad index", "fim"]


def test_vtt(spark, tmp_path):
    p = put(tmp_path / "v", "ep.vtt", "WEBVTT\n\n00:01.000 --> 00:02.300\na\nb\n\ncue-1\n00:03.000 --> 00:04.000\nnot read\n\n00:05.000 --> 01:00:06.000 align:start\nc\n")
    assert [tuple(r) for r in readers.read_vtt(spark, p).orderBy("pos").select("begin_ms", "end_ms", "text").collect()] == [(1000, 2300, "a b"), (5000, 3606000, "c")]


def test_ttml(spark, tmp_path):
    doc = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:t="x" t:tickRate="10000"><body><p begin="50000t" end="6.5s">b <span>c</span>\n d</p><t:p begin="1.0s">a &amp; &lt;b&gt;</t:p><p begin="zz">no</p><p begin="9.0s"/></body></tt>'
    p = put(tmp_path / "t", "ep.xml", doc)
    assert [tuple(r) for r in readers.read_ttml(spark, p).orderBy("pos").select("begin_ms", "end_ms", "text").collect()] == [(1000, 1000, "a & <b>"), (5000, 6500, "b c d"), (9000, 9000, "")]


def test_base(spark, tmp_path):
    lines = ["1\t0.000s\t0.100s\t（你好）\tN/A\tN/A", "2\t1.000s\tx\ty", "3\t2.000s\t3.000s\tfirst\t[]\ta", "4\t2.000s\t3.000s\tlast\t[]\tb", "5\t4.000s\t5.000s\tN/A\t[]\tb", "bad"]
    p = put(tmp_path / "b", "ep.tsv", "\n".join(lines) + "\n")
    got = {(r.line_no, r.begin_ms, r.end_ms, r.zht, r.pairs_raw, r.pt, r.layout) for r in readers.read_base(spark, p).collect()}
    assert got == {(1, 0, 500, "你好", "", "", "new"), (2, 1000, 4000, "x", "y", "", "old"), (4, 2000, 3000, "last", "[]", "b", "new")}
    assert readers.read_base(spark, p, min_columns=6).count() == 2


def test_encoding(spark, tmp_path):
    p = put(tmp_path / "e", "a.txt", "ação".encode("latin-1"))
    put(tmp_path / "e", "b.txt", "ação")
    assert {(r.track_id, r.encoding, r.text) for r in readers.read_with_encoding(spark, p).collect()} == {("a", "latin-1", "ação"), ("b", "utf-8", "ação")}


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a b", 0, 0, 1000, "x"), ("a b", 1, 2000, 3500, "y & <z>"), ("c", 0, 5, 6, "w")], CUE)
    for write, read, sub in ((writers.write_srt, readers.read_srt, "srt"), (writers.write_ttml_secs, readers.read_ttml, "ttml")):
        write(df, str(tmp_path / sub))
        back = {(r.track_id, r.begin_ms, r.end_ms, r.text) for r in read(spark, str(tmp_path / sub)).collect()}
        assert back == {(r.track_id, r.begin_ms, r.end_ms, r.text) for r in df.collect()}


def test_episodes(spark, tmp_path):
    df = spark.createDataFrame([(1, "11", "3", "30/09/2024", "t", "u", "episode")], "pos int, id string, episode_number string, chapter_date string, title string, url string, type string")
    writers.write_episodes_json(df, str(tmp_path / "j"), "http://x", "now")
    assert readers.read_episodes(spark, str(tmp_path / "j")).first().id == "11"
    writers.write_episodes_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == list(writers.EPISODE_COLUMNS)


def test_packed_texts_are_read_as_files_are(spark, tmp_path):
    df = spark.createDataFrame([(f"t {k % 40}", k, 1000 * (k * 7 % 50), 1000 * (k * 7 % 50) + 500, f"x & <y>\t{k}") for k in range(200)], CUE)
    for write, read in ((writers.write_srt, readers.read_srt), (writers.write_ttml_secs, readers.read_ttml)):
        one, many = str(tmp_path / f"{read.__name__}-packed"), str(tmp_path / f"{read.__name__}-folders")
        write(df, one, packed=True)
        write(df, many)
        got = read(spark, one, packed=True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, read(spark, many).select(got.columns).collect()))
        assert got.count() == 200
        assert not [x for x in (tmp_path / f"{read.__name__}-packed").iterdir() if x.is_dir()]


def test_ttml_times_and_references(spark, tmp_path):
    body = '<tt ttp:tickRate="10"><p begin="20t" end="1.5s">&amp;lt; &lt;</p><p begin="3t">&amp;#65; &<b/>#65; &#66;&quot;</p><p begin="nott" end="1s">no</p><p begin="2s" end="t">no</p><p end="4s">a<![CDATA[&lt;<b>]]>&lt;</p></tt>'
    p = put(tmp_path / "ttml", "e.xml", body)
    got = [(r.idx, r.begin_ms, r.end_ms, r.text) for r in readers.read_ttml(spark, p).orderBy("idx").collect()]
    assert got == [(1, 0, 4000, "a&lt;<b><"), (2, 300, 300, '&#65; A B"'), (3, 2000, 1500, "&lt; <")]


def test_lines_travel_without_their_file(spark, tmp_path):
    p = put(tmp_path / "lines", "e.tsv", "a\n\nb\n")
    put(tmp_path / "lines", "f.tsv", "c\n\n")
    put(tmp_path / "lines", "g.tsv", "")
    put(tmp_path / "lines", "h.tsv", "\nd")
    lines = readers.read_lines(spark, p)
    assert sorted(map(tuple, lines.collect())) == [("e", 1, "a"), ("e", 2, ""), ("e", 3, "b"), ("f", 1, "c"), ("f", 2, ""), ("h", 1, ""), ("h", 2, "d")]
    assert "), [1], true, [_k" in lines._jdf.queryExecution().optimizedPlan().toString()  # the text, column 1, goes no further
