"""Operators against golden rows and against small models of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from cueforge.functions.pairs import PAIR
from cueforge.operators import align, catalog, dedup, frames, playlist, quality, resume, retime, sanitize, translate, vocab, web
from cueforge.plans import pipelines
from cueforge.sources import readers

CUE = "track_id string, pos int, begin_ms long, end_ms long, text string"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def random_cues(seed, n, spread=40):
    r = random.Random(seed)
    out = []
    for i in range(n):
        b = r.randint(0, spread) * 10
        out.append((r.choice("ab"), i, b, b + r.choice([-15, 0, 5, 20, 60, 300]), f"t{i}"))
    return out


def model_align(src, other):
    out = {}
    for t, p, b, e, _ in src:
        own = sorted((x for x in other if x[0] == t), key=lambda x: (x[2], x[1]))
        hit = next((x for x in own if b <= x[2] <= e), None) or next((x for x in own if x[3] >= b and x[2] <= e), None)
        out[t, p] = hit[4] if hit else "N/A"
    return out


@pytest.mark.parametrize("seed", range(4))
def test_alignment_equals_model(spark, seed):
    src, other = random_cues(seed, 60), random_cues(seed + 100, 60)
    got = align.align_tracks(spark.createDataFrame(src, CUE), spark.createDataFrame(other, CUE), bin_ms=30, wide=4)
    assert {(r.track_id, r.pos): r.match for r in got.collect()} == model_align(src, other)


def test_long_cues_and_chunks_take_a_row(spark):
    far = 10**16
    src = [("a", 0, 5, far, "s"), ("a", 1, far - 3, far + 9, "s"), ("a", 2, far + 8, far + 9, "s"), ("b", 0, 5, 9, "s"), (None, 0, 0, 9, "s"), ("a", 3, None, 9, "s")]
    other = [("a", 0, -far, far, "long"), ("a", 1, far - 2, far + 1, "in"), ("a", 2, 4, far + 8, "later"), (None, 0, 1, 9, "n")]
    got = align.align_tracks(spark.createDataFrame(src, CUE), spark.createDataFrame(other, CUE))
    assert {(r.track_id, r.pos): r.match for r in got.collect()} == {("a", 0): "in", ("a", 1): "in", ("a", 2): "later", ("b", 0): "N/A", (None, 0): "N/A", ("a", 3): "N/A"}
    parts = spark.createDataFrame([("a", 0, far - 5), ("a", 1, 0), ("a", 2, 10), ("b", 0, 5)], "track_id string, chunk_no int, duration_ms long")
    kept = retime.assign_to_chunks(spark.createDataFrame(src, CUE), parts)
    assert rows(kept, "track_id", "pos", "chunk_no", "chunk_start_ms") == [("a", 0, 0, 0), ("a", 1, 2, far - 5)]


@pytest.mark.parametrize("seed", range(2))
def test_islands_equal_model(spark, seed):
    cues = random_cues(seed, 50, spread=3)
    want = []
    for t in "ab":
        last = None
        for _, p, b, e, x in (c for c in sorted(cues, key=lambda c: c[1]) if c[0] == t):
            if last and last[2] == b:
                last[3], last[4] = max(last[3], e), f"{last[4]} {x}"
            else:
                last = [t, p, b, e, x]
                want.append(last)
    got = rows(align.merge_same_begin(spark.createDataFrame(cues, CUE)), "track_id", "pos", "begin_ms", "end_ms", "text")
    assert got == sorted(map(tuple, want))


def test_adjust_end_times(spark):
    lines = spark.createDataFrame([("a", 1, 0, 4000), ("a", 2, 5000, 6000), ("a", 3, None, None), ("a", 4, 9000, 9500), ("a", 5, 9000, 9100)], "track_id string, line_no int, begin_ms long, end_ms long")
    assert rows(retime.adjust_end_times(lines), "line_no", "end_ms") == [(1, 4999), (2, 66000), (4, 9001), (5, 69100)]


def test_windows_and_chunks(spark):
    cues = spark.createDataFrame([("a", 0, 0, 70000, "x"), ("a", 1, 59000, 61000, "y"), ("a", 2, 60000, 61000, "z"), ("a", 3, 1000, 2000, "w")], CUE)
    assert rows(retime.first_window(cues), "pos", "end_ms", "idx") == [(0, 60000, 1), (1, 60000, 2)]
    assert rows(retime.first_window_base(cues, order="pos"), "pos", "end_ms") == [(0, 70000), (1, 61000)]
    long = spark.createDataFrame([("a", 100000), ("b", 10)], "track_id string, duration_ms long")
    got = rows(retime.chunk_fixed(cues, long).select("track_id", "chunk_no", "chunk_end_ms", F.coalesce("pos", F.lit(-1)).alias("p")), "track_id", "chunk_no", "chunk_end_ms", "p")
    assert got == [("a", 0, 30000, 0), ("a", 0, 30000, 3), ("a", 1, 60000, 1), ("a", 2, 90000, 2), ("a", 3, 100000, -1), ("b", 0, 10, -1)]
    placed = retime.chunk_fixed(cues, long).where("pos is not null")
    assert rows(retime.rebase_chunk_times(placed), "pos", "begin_ms", "end_ms") == [(0, 0, 70000), (1, 29000, 31000), (2, 0, 1000), (3, 1000, 2000)]
    twice = retime.rebase_chunk_times(placed, min_ms=100, legacy_double=True)
    assert rows(twice, "pos", "begin_ms", "end_ms") == [(0, 0, 70000), (1, 0, 1000), (2, 0, 100), (3, 1000, 2000)]
    parts = spark.createDataFrame([("a", 1, 1500), ("a", 2, 58000), ("a", 3, 500)], "track_id string, chunk_no int, duration_ms long")
    assert rows(retime.assign_to_chunks(cues, parts), "pos", "chunk_no") == [(0, 1), (1, 2), (3, 1)]
    there = retime.shift_times(retime.shift_times(cues, 500), -500)
    assert rows(there, "pos", "begin_ms") == rows(cues, "pos", "begin_ms")


def test_chunks_with_cues_follow_the_cues(spark):
    far = 4 * 10**15  # over a hundred thousand million chunks before the cue
    cues = spark.createDataFrame([("a", 0, far + 5, far + 9, "x"), ("a", 1, far + 7, far + 9, "late"), ("a", 2, -1, 5, "y"), ("b", 0, 0, 5, "z"), ("b", 1, 29999, 5, "k"), ("b", 2, None, 5, "n"), (None, 0, 1, 5, "n"), ("c", 0, 1, 5, "none")], CUE)
    long = spark.createDataFrame([("a", far + 7), ("b", 40000), (None, 50), ("c", 0)], "track_id string, duration_ms long")
    got = retime.chunk_fixed(cues, long, empty=False)
    near = [x.where("track_id <> 'a'") for x in (cues, long)]
    whole = retime.chunk_fixed(*near).where("pos is not null")
    assert got.columns == whole.columns and got.dtypes == whole.dtypes
    assert rows(got.where("track_id = 'b'"), *whole.columns) == rows(whole, *whole.columns)
    assert rows(got.where("track_id = 'a'"), "pos", "chunk_no", "chunk_end_ms") == [(0, far // 30000, far + 7)]


BASE = f"track_id string, line_no int, begin_ms long, end_ms long, zht string, pairs_raw string, pt string, pairs array<{PAIR}>"


def test_sanitize(spark):
    pair = lambda w: (w, "p", "t")
    df = spark.createDataFrame([("a", 1, 0, 1, "字", "x", "oi", [pair("我"), pair("你")]), ("a", 2, 0, 1, "♪", "x", "N/A", [pair("我")]), ("a", 3, 0, 1, "字", sanitize.REFUSALS[0], "", [pair("新"), pair("你")]), ("a", 4, 0, 1, "字", "N/A", "b", [])], BASE)
    lexicon = spark.createDataFrame([("我", "", "", "3"), ("你", "", "", "abc"), ("他", "", "", "1")], "word string, pinyin string, translation string, confidence_level string")
    assert rows(sanitize.drop_bad_rows(df), "line_no") == [(1,), (4,)]
    assert rows(sanitize.speakable_rows(df), "line_no") == [(1,), (4,)]
    kept = sanitize.filter_known_words(df, lexicon, ["track_id", "line_no"])
    assert {r.line_no: [p.word for p in r.pairs] for r in kept.collect()} == {1: ["你"], 3: ["新", "你"], 4: []}
    new = sanitize.new_lexicon_entries(df, lexicon, ["track_id", "line_no"])
    assert rows(new, "word", "confidence_level") == [("新", 1)]
    assert sanitize.upsert_lexicon(lexicon, new).count() == 4
    assert rows(sanitize.sanitize_summary(df, kept, ["track_id", "line_no"]), "removed", "modified", "pairs_kept", "pairs_dropped") == [(1, 1, 3, 2)]


def test_vocabulary(spark):
    df = spark.createDataFrame([('["b (x): 1", "a (x): 1"]',), ('["a (x): 1", "c: no"]',), ('["c (x): 1"]',)], "pairs_raw string")
    assert [tuple(r) for r in vocab.word_counts(df).collect()] == [("a", 2), ("c", 1), ("b", 1)]
    assert [tuple(r) for r in vocab.word_counts(df, top=1).collect()] == [("a", 2)]
    base = spark.createDataFrame([("t", 7, ["1", "1.000s", "2.000s", "x", '["我 (wǒ): eu", "你 (nǐ hǎo): tu"]', "pt"], "ep"), ("t", 8, ["1", "bad", "2.000s", "x", '["我 (wǒ): eu"]', "pt"], "ep")], "track_id string, line_no int, parts array<string>, asset string")
    words = spark.createDataFrame([(0, "你"), (1, "我")], "word_index int, word string")
    assert rows(vocab.find_words(base, words), "line_no", "word", "mid_ms", "translation", "picture") == [(7, "你", 1500, "pt", "1_ni_hao_line0007_ep.png")]


def test_captions(spark):
    base = spark.createDataFrame([("a", 1, 500, 2600), ("a", 2, 1500, 1600), ("a", 3, 400, 450)], "track_id string, line_no int, begin_ms long, end_ms long")
    seconds = lambda policy, wins="last": {(r.second, r.cue.line_no) for r in frames.cue_seconds(base, policy, wins).collect()}
    assert seconds("begin") == {(0, 3), (2, 2)}
    assert seconds("span") == {(0, 3), (1, 1), (2, 2), (3, 1)}
    assert seconds("onebased") == {(1, 3), (2, 2)}
    assert seconds("floor", "first") == {(0, 1), (1, 2)}


def model_sampled(n, fps, k):
    out, second, frame = [], 1, 1
    for i in range(n):
        if second <= max(1, n // fps) and i >= (second - 1) * fps + (frame - 1) * fps / k:
            out.append((i, second, frame))
            frame += 1
            if frame > k:
                second, frame = second + 1, 1
        if n < fps and out:
            break
    return out


@pytest.mark.parametrize("n,fps", [(10, 24), (24, 24), (100, 25), (61, 30), (50, 7)])
def test_sampled_frames_equal_model(spark, n, fps):
    df = spark.createDataFrame([("v", n, fps)], "track_id string, n_frames long, fps long")
    assert rows(frames.frames_for_video(df, 7), "i", "second", "frame") == model_sampled(n, fps, 7)


def test_frame_names(spark):
    f = spark.createDataFrame([("a", "00072_1.png"), ("a", "2.png"), ("a", "cover.png"), ("a", "00002_3.png")], "track_id string, name string")
    assert [r.name for r in frames.sort_frames(f).collect()] == ["2.png", "00002_3.png", "00072_1.png", "cover.png"]
    base = spark.createDataFrame([("a", 1, 2000, 2900, [("我", "", ""), ("你", "", "")])], f"track_id string, line_no int, begin_ms long, end_ms long, pairs array<{PAIR}>")
    got = {(r.name, r.artifact) for r in frames.frame_artifacts(f, base).collect()}
    assert {x for n, x in got if n == "2.png"} == {"a", "ba", "bb", "c"} and ("cover.png", "resize") in got
    n = spark.createDataFrame([("x", "7.png"), ("x", "12.png"), ("x", "a.png"), ("y", "b.png")], "folder string, name string")
    assert rows(frames.next_index(n), "folder", "next_index") == [("x", 13), ("y", 1)]


def test_playlist(spark):
    base = spark.createDataFrame([("a", 1, 1000, 3000), ("a", 2, 5000, 5500)], "track_id string, line_no int, begin_ms long, end_ms long")
    clips = spark.createDataFrame([("a", 2, 700)], "track_id string, line_no int, clip_ms long")
    got = rows(playlist.playlist(base, clips), "item_no", "kind", "length_ms", "start_ms")
    assert got == [(1, "silence", 1000, 0), (2, "original", 2000, 1000), (3, "slow", 4000, 3000), (4, "translation", 700, 7000), (5, "original", 500, 7700), (6, "slow", 1000, 8200)]
    assert rows(playlist.track_extent(base), "duration_ms", "horizon_s") == [(5500, 35)]


def test_catalog(spark):
    f = spark.createDataFrame([("1", "x_zht.srt"), ("1", "x.pt-BR.srt"), ("1", "x_zht_traditional.srt"), ("1", "x_es.srt"), ("2", "a_pt.srt"), ("2", "b_pt.srt"), ("3", "x_secs.srt"), ("4", "y-zht.srt")], "track_id string, name string")
    assert rows(catalog.choose_track_pair(f), "track_id", "case") == [("1", "both"), ("2", "ambiguous"), ("3", "none"), ("4", "zht_only")]
    p = spark.createDataFrame([("a", "1.png"), ("a", "0001.png"), ("a", "15a.png"), ("a", "cover.png")], "folder string, name string")
    assert rows(catalog.rename_plan(p), "name", "status") == [("0001.png", "right"), ("1.png", "exists"), ("15a.png", "renamed"), ("cover.png", "invalid")]
    c = spark.createDataFrame([("v", f"x_chunk_{n:03d}{s}.mp4") for n, s in ((1, ""), (1, "_processed"), (2, ""), (4, ""), (5, "_temp"), (6, "_processed"))], "folder string, name string")
    assert rows(catalog.merge_manifest(c), "chunk_no", "status") == [(1, "processed"), (2, "promoted"), (3, "missing"), (4, "promoted"), (6, "processed")]
    assert rows(catalog.pending_items(c), "name") == [("x_chunk_002.mp4",), ("x_chunk_004.mp4",)]
    e = spark.createDataFrame([(str(n),) for n in (12, 3, 7, 100)] + [("x",)], "episode_number string")
    assert [r[0] for r in catalog.episodes_from(e, 5, 2).collect()] == ["7", "12"]
    s = spark.createDataFrame([("t", "a.pt-BR.srt", 5), ("t", "b.pt-BR.srt", 6), ("t", "a.zh.vtt", 1), ("t", "a.mp4", 9)], "track_id string, name string, size long")
    assert rows(catalog.subtitle_inventory(s), "ext", "lang", "files", "bytes") == [("srt", "pt-BR", 2, 11), ("vtt", "zh", 1, 1)]
    assert catalog.dedupe_by_id(spark.createDataFrame([("a", 2), ("a", 1)], "id string, pos int")).first().pos == 1
    assert rows(catalog.cjk_lines(spark.createDataFrame([(" 你 ",), ("x",), ("",)], "value string")), "value") == [("你",)]


def test_validation(spark):
    good = '1\t0.000s\t1.000s\tz\t["a (b): c"]\tpt'
    cases = {"ok": good, "cols": "1\t2", "begin": good.replace("0.000s", "0.000"), "end": good.replace("1.000s", "1"), "json": good.replace('["', "["), "shape": good.replace("(b)", "b"), "na": good.replace('["a (b): c"]', "N/A")}
    df = spark.createDataFrame([(k, 1, v) for k, v in cases.items()] + [("late", 6, "bad"), ("late", 1, good)], "track_id string, line_no int, value string")
    got = {r.track_id: r.reason for r in quality.validate_base(df).collect()}
    assert got == {"ok": None, "cols": "columns", "begin": "begin", "end": "end", "json": "pairs_json", "shape": "pairs_shape", "na": None, "late": None}


def test_dictionary(spark):
    d = spark.createDataFrame([(1, "olá", "oi"), (2, "mundo", "world"), (3, "olá mundo", "hi all")], "dict_order int, phrase string, translation string")
    t = spark.createDataFrame([(1, "olá mundo"), (2, "um mundo olá"), (3, "nada"), (4, "mundo")], "k int, text string")
    assert rows(translate.translate_by_dictionary(t, d), "k", "translation") == [(1, "hi all"), (2, "oi"), (3, "[Traduzir: nada]"), (4, "world")]
    assert rows(translate.translate_by_dictionary(t, d, mode="replace"), "k", "translation") == [(1, "hi all"), (2, "um mundo oi"), (3, "[Traduzir: nada]"), (4, "world")]
    assert rows(pipelines.to_traditional(t, [("mundo", "terra"), ("terra", "x")]), "k", "traditional")[0] == (1, "olá x")


def test_enrichment_retries(spark, tmp_path):
    marker = str(tmp_path / "calls")

    def fn(text):
        with open(marker, "a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise ValueError("wrong key")
        if open(marker).read().count(f"{text}\n") < 2:
            raise RuntimeError("again")
        return text.upper()

    t = spark.createDataFrame([(1, "x"), (2, "x"), (3, "bad"), (4, None)], "k int, text string")
    assert rows(translate.distinct_enrichment(t, "text", fn, base_delay=0.0, parallelism=1), "k", "enriched") == [(1, "X"), (2, "X"), (3, None), (4, None)]
    assert open(marker).read().split().count("bad") == 1


def test_resume(spark):
    new = spark.createDataFrame([("a", n, b) for n, b in enumerate((0, 10, 20, 30))], "track_id string, line_no int, begin_ms long").withColumn("idx", F.lit(0))
    old = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 10, 2)], "track_id string, line_no int, begin_ms long, idx int")
    assert rows(resume.resume_filter(new, old), "begin_ms", "idx") == [(20, 3), (30, 4)]
    assert rows(resume.resume_filter(new, old, resume_from_ms=10), "begin_ms", "idx") == [(10, 2), (20, 3), (30, 4)]
    assert rows(resume.resume_lines(spark.createDataFrame([("a",), ("b",)], "text string"), spark.createDataFrame([("a",)], "text string")), "text") == [("b",)]


def model_keep(items, threshold=5):
    kept, out = [], {}
    for n, md5, h in items:
        exact = next((k for k, m, _ in kept if m == md5), None)
        near = next((k for k, _, g in kept if sum(a != b for a, b in zip(h, g, strict=True)) <= threshold), None)
        if exact is not None:
            out[n] = ("exact", exact)
        elif near is not None:
            out[n] = ("similar", near)
        else:
            kept.append((n, md5, h))
            out[n] = ("unique", None)
    return out


@pytest.mark.parametrize("seed,most", [(1, 20_000), (2, 20_000), (3, 0)])
def test_near_duplicates_equal_model(spark, seed, most, monkeypatch):
    monkeypatch.setattr(dedup, "FOLDER_PAIRS", most)
    r = random.Random(seed)
    seeds = ["".join(r.choice("0123456789abcdef") for _ in range(16)) for _ in range(6)]
    items = []
    for n in range(80):
        h = list(r.choice(seeds))
        for _ in range(r.randint(0, 6)):
            h[r.randrange(16)] = r.choice("0123456789abcdef")
        h = "".join(h)
        items.append((n, f"{h}-{r.randint(0, 1)}", h))
    df = spark.createDataFrame([("f", *x) for x in items], "folder string, file_no long, md5 string, ahash string")
    got = {x.file_no: (x.status, x.duplicate_of) for x in dedup.near_duplicates(df).collect()}
    assert got == model_keep(items)


def test_average_hash(spark):
    df = spark.createDataFrame([([0.0] * 32 + [1.0] * 32,), ([1.0] * 64,)], "v array<double>")
    assert [r[0] for r in df.select(dedup.average_hash("v")).collect()] == ["0" * 8 + "f" * 8, "f" * 16]


def test_episodes(spark):
    html = '<div><a href="/v/11/?s=0s" title="Capítulo de 30/09/2024"><img alt="x">3. CAPÍTULO</a> <a href="/v/12/?s=0s">Episódio 9 CAPÍTULO DE 01/10/2024</a> <a href="/v/13/">no</a> <a href="/v/14/?s=0s">nada</a></div>'
    got = rows(web.extract_episodes(spark.createDataFrame([(1, html)], "page_id long, html string")), "pos", "id", "episode_number", "chapter_date")
    assert got == [(0, "11", "3", "30/09/2024"), (1, "12", "9", "01/10/2024"), (2, "14", "3", "Capítulo 14")]


def test_pipelines(spark):
    zht = spark.createDataFrame([("a", 0, 0, 1000, "你"), ("a", 1, 0, 1500, "好"), ("a", 2, 5000, 6000, "嗎")], CUE)
    pt = spark.createDataFrame([("a", 0, 100, 900, "oi")], CUE)
    got = rows(pipelines.build_base(zht, pt, lambda t: f"[{t}]"), "idx", "zht", "pairs_raw", "pt")
    assert got == [(1, "你 好", "[你 好]", "oi"), (2, "嗎", "[嗎]", "N/A")]
    done = spark.createDataFrame([("a", 0)], "track_id string, begin_ms long")
    assert rows(pipelines.translate_track(zht, done, str.upper), "begin_ms", "text") == [(5000, "嗎")]


def test_episode_titles_and_headings(spark):
    html = '<h2>7. Capítulo</h2><a href="/v/1/?s=0s">x</a><h3>8. other</h3><a href="/v/2/?s=0s">Capítulo de 01/02/2024</a>'
    got = rows(web.extract_episodes(spark.createDataFrame([(1, html)], "page_id long, html string")), "pos", "episode_number", "chapter_date", "title")
    assert got == [(0, "7", "Capítulo 1", "Episódio 7"), (1, "2", "01/02/2024", "Episódio 2, 01/02/2024")]


def test_rename_plan_never_gives_a_name_twice(spark):
    names = ["5.png", "05.png", "7.png", "0007.png", "x.png"]
    got = {r.name: r.status for r in catalog.rename_plan(spark.createDataFrame([("f", n) for n in names], "folder string, name string")).collect()}
    assert got == {"05.png": "renamed", "5.png": "exists", "7.png": "exists", "0007.png": "right", "x.png": "invalid"}


@pytest.mark.parametrize("bound", [0, 20_000])
def test_phrases_of_any_length(spark, bound, monkeypatch):
    monkeypatch.setattr(translate, "AUTOMATON_PHRASES", bound)
    phrases = ["a", "bc", "def", "ghij", "klmnop", "qrstuvwx", "qrstuvwxyz", "😀é"]
    texts = [None, "", "zz", "xa", "bcx", "\ndef", "ghijklmnop", "..qrstuvwxyz..", "qrstuvwx", "z😀é z"]
    d = spark.createDataFrame([(len(phrases) - i, p, p.upper()) for i, p in enumerate(phrases)], "dict_order int, phrase string, translation string")
    got = {r.text: r.translation for r in translate.translate_by_dictionary(spark.createDataFrame([(t,) for t in texts], "text string"), d).collect()}
    for t in texts:
        hits = sorted((t != p, len(phrases) - i, p) for i, p in enumerate(phrases) if t and p in t)
        assert got[t] == (None if t is None else hits[0][2].upper() if hits else f"[Traduzir: {t}]")


def test_filter_known_words_keeps_other_columns(spark):
    pairs = lambda *w: [(x, "p", "t") for x in w]
    df = spark.createDataFrame([(1, "a", pairs("x", "y")), (2, "b", pairs("x")), (3, "c", []), (4, None, pairs("y", "", "y")), (5, "e", None), (6, "f", pairs(" "))], "k int, note string, pairs array<struct<word:string,pinyin:string,translation:string>>")
    lexicon = spark.createDataFrame([("x", "3"), ("y", "1"), ("y", "abc")], "word string, confidence_level string")
    got = {r.k: (r.note, None if r.pairs is None else [p.word for p in r.pairs]) for r in sanitize.filter_known_words(df, lexicon, ["k"]).collect()}
    assert got == {1: ("a", ["y"]), 3: ("c", []), 4: (None, ["y", "y"]), 5: ("e", None)}


def test_known_words_meet_no_texts(spark):
    df = spark.createDataFrame([(k, f"note {k}", [(w, "p", "t") for w in ("x", "y") * 3]) for k in range(3)], "k int, note string, pairs array<struct<word:string,pinyin:string,translation:string>>")
    lexicon = spark.createDataFrame([("x", "3")], "word string, confidence_level string")
    kept = sanitize.filter_known_words(df, lexicon, ["k"])
    assert rows(kept.select("k", F.array_join(F.transform("pairs", lambda p: p["word"]), "").alias("w"), "note"), "k", "w", "note") == [(k, "yyy", f"note {k}") for k in range(3)]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line]
    assert made and not any("note" in line or "pinyin" in line for line in made)


def test_lines_travel_without_their_glosses(spark):
    lines = spark.createDataFrame([("a", 1, '1\t["x (p): t", "y (p): t"]')], "track_id string, line_no int, value string")
    kept = sanitize.filter_known_in_lines(lines, spark.createDataFrame([("x", "3")], "word string, confidence_level string"))
    assert [r.value for r in kept.collect()] == ['1\t["y (p): t"]']
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [x for x in plan if "Generate" in x and "posexplode" in x]
    assert made and not any("value" in x or "_parts" in x or "rest" in x for x in made)


def test_base_rows_without_an_end(spark):
    lines = [("t", 1, "1\t1.0s\tx\t字\tN/A\tp"), ("t", 2, "2\t9.0s\t9.1s\t（字）\t[]\t"), ("t", 3, "3\tbad\t9.1s\t字\t[]\tp")]
    got = rows(readers.parse_base_lines(spark.createDataFrame(lines, "track_id string, line_no int, value string")), "begin_ms", "end_ms", "zht", "pt", "layout")
    assert got == [(1000, 4000, "字", "p", "new"), (9000, 9500, "字", "", "new")]


@pytest.mark.parametrize("bound", [1 << 20, 12])
def test_phrase_tables_are_a_chain_of_replaces(spark, bound, monkeypatch):
    monkeypatch.setattr(translate, "AUTOMATON_BYTES", bound)
    table = [(2, "an", "na"), (1, "ba", "an"), (3, "nana", "x"), (None, "q", "ba"), (4, "", "y"), (5, None, "y"), (6, "x", None), (2, "an", "zz")]
    texts = ["banana", None, "", "qq an", "bab nanana", "ban"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    phrases = spark.createDataFrame(table, "dict_order int, phrase string, translation string")
    chain = sorted((-1 if o is None else o, old, new or "") for o, old, new in table if old)
    for given in (phrases, [(old, new) for _, old, new in chain]):
        got = {r.k: r.traditional for r in translate.replace_phrases(df, given).collect()}
        for k, t in enumerate(texts):
            for _, old, new in chain if t else ():
                t = t.replace(old, new)
            assert got[k] == t
    assert translate.replace_phrases(df, phrases.limit(0)).where("not (traditional <=> text)").count() == 0


def test_known_words_go_wherever_the_glosses_stand(spark):
    g = lambda *w: "[" + ", ".join(f'"{x} (p): t"' for x in w) + "]"
    lines = [("a", 1, "[SOM]\tx"), ("a", 2, f"1\tz\t{g('x', 'y')}\tpt"), ("a", 3, f"2\tz\t{g('x')}\tpt"), ("a", 4, "3"), ("a", 5, "4\tz\t[broken\tpt"), ("a", 6, f"{g('x')}\tz\t[]"), ("b", 1, f"{g('x')}\t{g('y')}"), ("b", 2, f"{g('y')}\tk"), ("c", 1, "x"), (None, 1, f"q\t{g('y', 'x')}")]
    df = spark.createDataFrame([(*x, "keep") for x in lines], "track_id string, line_no int, value string, extra string")
    lexicon = spark.createDataFrame([("x", 3), ("y", 1)], "word string, confidence_level int")
    got = {(r.track_id, r.line_no): r.value for r in sanitize.filter_known_in_lines(df, lexicon).collect()}
    want = {(t, n): v for t, n, v in lines} | {("a", 2): f"1\tz\t{g('y')}\tpt", (None, 1): f"q\t{g('y')}"}
    del want["a", 3], want["b", 1]
    assert got == want
    assert sanitize.filter_known_in_lines(df, lexicon).columns == df.columns


def test_subtitle_file_of_a_folder(spark):
    names = [("a", "x.srt"), ("a", "z.vtt"), ("a", "b.vtt"), ("b", "n.srt"), ("b", "m.srt"), ("c", "x.mp4"), ("d", "a.vtt.bak"), ("d", "Q.VTT"), (None, "s.srt")]
    got = {tuple(r) for r in catalog.choose_subtitle_file(spark.createDataFrame(names, "track_id string, name string")).collect()}
    assert got == {("a", "b.vtt", "vtt"), ("b", "m.srt", "srt"), ("d", "Q.VTT", "vtt"), (None, "s.srt", "srt")}


def test_episodes_by_source(spark, tmp_path):
    from cueforge.sources import readers, writers

    rows = [(f"s{k % 3}", k, str(k), "1", "01/01/2024", 'a "t"\nb', f"/v/{k}", "episode") for k in range(20)]
    df = spark.createDataFrame(rows, "source string, pos int, id string, episode_number string, chapter_date string, title string, url string, type string")
    writers.write_episodes_json(df, "file://" + str(tmp_path / "x"), "https://e.org", "2024", source="source")
    got = [tuple(r) for r in readers.read_episodes(spark, "file://" + str(tmp_path / "x")).collect()]
    assert sorted(got) == sorted(r[2:] for r in rows)
    envelopes = {r.source: r for r in writers.episodes_envelope(df, "https://e.org", "2024", source="source").selectExpr("source", "from_json(value, 'metadata struct<source_url:string,total_episodes:int>, episodes array<struct<id:string>>') as v").select("source", "v.*").collect()}
    assert {k: (v.metadata.source_url, v.metadata.total_episodes) for k, v in envelopes.items()} == {"s0": ("https://e.org/s0", 7), "s1": ("https://e.org/s1", 7), "s2": ("https://e.org/s2", 6)}
    assert [e.id for e in envelopes["s1"].episodes] == ["1", "4", "7", "10", "13", "16", "19"]


def test_answers_are_asked_once_in_all_runs(spark, tmp_path):
    calls, cache = spark.sparkContext.accumulator(0), "file://" + str(tmp_path / "answers")

    def fn(text):
        calls.add(1)
        if text.startswith("bad"):
            raise ValueError("never")
        if text.startswith("busy"):
            raise TimeoutError("later")
        return text.upper()

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad"), (6, "busy"), (7, "")], "k int, t string")
    told = lambda df, fn, now, **more: {x.k: x.enriched for x in translate.cached_enrichment(df, "t", fn, cache, "m", now=now, retry_after_s=10, **more).collect()}
    assert told(df, fn, 100.0, rounds=3) == {1: "A", 2: "B", 3: "A", 4: None, 5: None, 6: None, 7: ""}
    assert calls.value == 5
    assert told(df, fn, 105.0)[1] == "A" and calls.value == 5
    assert told(df, fn, 111.0)[6] is None and calls.value == 6
    assert told(df, fn, 125.0)[6] is None and calls.value == 6
    assert told(df, lambda t: t + "!", 131.0) == {1: "A", 2: "B", 3: "A", 4: None, 5: None, 6: "busy!", 7: ""}
    assert told(df.limit(0), fn, 131.0) == {}
    dead = spark.read.parquet(cache).where("answer is null and next_try is null")
    assert [(x.error, x.attempts) for x in dead.collect()] == [("ValueError: never", 1)]


def test_calls_of_all_tasks_are_paced(spark, tmp_path):
    import time

    df = spark.createDataFrame([(str(k),) for k in range(12)], "t string")
    began = time.time()
    assert translate.cached_enrichment(df, "t", str.upper, "file://" + str(tmp_path / "a"), "m", parallelism=2, per_second=6).where("enriched is null").count() == 0
    assert time.time() - began > 0.6


def test_a_killed_run_loses_only_its_share(spark, tmp_path):
    cache = "file://" + str(tmp_path / "answers")
    df = spark.createDataFrame([(str(k),) for k in range(40)], "t string")

    def dies(text):
        if text == "7":
            raise SystemExit("killed")
        return text

    with pytest.raises(Exception):  # noqa: B017, PT011
        translate.cached_enrichment(df, "t", dies, cache, "m", rounds=8)
    kept = spark.read.parquet(cache).count()
    calls = spark.sparkContext.accumulator(0)

    def count(text):
        calls.add(1)
        return text

    assert translate.cached_enrichment(df, "t", count, cache, "m").where("enriched = t").count() == 40
    assert calls.value == 40 - kept < 40


@pytest.mark.parametrize("wins", ["last", "first"])
def test_spans_on_frames_send_no_row_a_second(spark, wins):
    rnd = random.Random(5)
    cue = [(rnd.choice(["a", "b", None]), k, b := rnd.randrange(-9_000, 4_000_000), b + rnd.choice([-900, 0, 3_000, 90_000, 1_500_000]), f"x{k}") for k in range(300)]
    base = spark.createDataFrame(cue, "track_id string, line_no int, begin_ms long, end_ms long, text string")
    asked = spark.createDataFrame([(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(-20, 5600)]), k) for k in range(3000)], "track_id string, second int, n int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)  # blocks go on from batch to batch
    got = frames.attach_cue_to_frame(asked, base, "span", wins)
    want = asked.join(frames.cue_seconds(base, "span", wins), ["track_id", "second"], "left")
    assert got.schema.names == want.schema.names
    try:
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    exchanged = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" in exchanged and "Aggregate" not in exchanged


def test_known_words_need_no_sorted_rows(spark):
    df = spark.createDataFrame([(k, f"note {k}", [(w, "p", "t") for w in ("x", "y")]) for k in range(3)], "k int, note string, pairs array<struct<word:string,pinyin:string,translation:string>>")
    kept = sanitize.filter_known_words(df, spark.createDataFrame([("x", "3")], "word string, confidence_level string"), ["k"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 2
    assert sorted((r.k, [p.word for p in r.pairs]) for r in kept.collect()) == [(k, ["y"]) for k in range(3)]


def test_places_of_known_words_are_not_sorted_where_words_meet(spark):
    known = {0, 62, 63, 64, 127, 128, 200}
    words = ["x" if i in known else f"w{i}" for i in range(201)]
    df = spark.createDataFrame([(k, [(w, "p", "t") for w in words]) for k in (1, None)] + [(2, [("x", "p", "t")] * 130)], "k int, pairs array<struct<word:string,pinyin:string,translation:string>>")
    lexicon = spark.createDataFrame([("x", "3")], "word string, confidence_level string")
    for small in (False, True):
        kept = sanitize.filter_known_words(df, lexicon, ["k"], small_lexicon=small)
        plan = kept._jdf.queryExecution().executedPlan().toString().splitlines()
        join = next(i for i, line in enumerate(plan) if "LeftSemi" in line)
        over = [line for line in plan[:join] if "Aggregate" in line or "Exchange" in line]
        assert "Exchange" in over[-1] and not any("collect_list(_no" in line for line in over)
        assert {r.k: [p.word for p in r.pairs] for r in kept.collect()} == {k: [w for w in words if w != "x"] for k in (1, None)}


def test_summary_compares_texts_by_digests(spark):
    schema = "k int, zht string, pairs array<struct<word:string,pinyin:string,translation:string>>"
    two, one = [("x", "p", "t"), ("y", "p", "t")], [("x", "p", "t")]
    before = spark.createDataFrame([(1, "a", two), (2, None, two), (3, "", two), (4, None, two), (5, "字", two), (6, "b", None), (7, "c", two)], schema)
    after = spark.createDataFrame([(1, "a", two), (2, None, two), (3, None, two), (4, "", two), (5, "子", two), (6, "b", None), (7, "c", one)], schema)
    told = sanitize.sanitize_summary(before, after, ["k"])
    assert rows(told, "removed", "modified", "pairs_kept", "pairs_dropped") == [(0, 4, 11, 1)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2 and "zht" not in plan[: plan.index("sha2(")]


def test_summary_of_a_corpus_sends_no_whole_texts(spark, tmp_path, monkeypatch):
    from cueforge.plans.suite import QUERIES

    spark.createDataFrame([(1, "abc one two xyz three four"), (2, None), (3, "abc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given, plain = [], sanitize.sanitize_summary
    monkeypatch.setattr(sanitize, "sanitize_summary", lambda *a: given.extend(a[:2]) or plain(*a))
    assert [tuple(r) for r in QUERIES["f5_sanitize_summary"](spark, str(tmp_path)).collect()] == [(2, 0, 0, 3)]
    for df in given:
        assert df.schema["pairs"].dataType.elementType.fieldNames() == ["word"]
        assert all(len(r.zht) == 64 for r in df.collect())
