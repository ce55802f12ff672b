"""Column functions against golden values."""

import random

import pytest
from pyspark.sql import functions as F

from cueforge.functions import pairs as P
from cueforge.functions import text as T
from cueforge.functions import timecode as C
from cueforge.functions.wrap import wrap_words


def run(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").select("i", expr.alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_srt_time(spark):
    assert run(spark, ["00:02:17,440", "00:00:26,880", "1:2:3,4", "x", "00:01", None], C.srt_to_ms("c")) == [137440, 26880, 3723400, None, None, None]
    assert run(spark, ["00:02:17.440", "01:05,5", "7", "junk"], C.srt_to_ms("c", lenient=True)) == [137440, 65500, 7000, 0]
    assert run(spark, [137440, 0, 360_000_000], C.ms_to_srt("c"), "long") == ["00:02:17,440", "00:00:00,000", "100:00:00,000"]


def test_vtt_time(spark):
    values = ["00:02.600", "2.600", "00:02.300", "00:00:04.000", "00:04.000 align:start", "x"]
    assert run(spark, values, C.vtt_to_ms("c")) == [2600, 2600, 2300, 4000, 4000, 0]
    assert run(spark, values, C.vtt_to_ms("c", truncate=True, hours=False)) == [2600, 2600, 2299, 0, 0, 0]


def test_seconds_and_ticks(spark):
    assert run(spark, ["72.943s", "72.943", "5.s", "-1s", ""], C.secs_to_ms("c")) == [72943, 72943, 5000, None, None]
    assert run(spark, ["72.943s", "72.943"], C.secs_to_ms("c", True)) == [72943, None]
    assert run(spark, [72943, 5, 0], C.ms_to_secs("c"), "long") == ["72.943s", "0.005s", "0.000s"]
    assert run(spark, ["123456t", "5t", "1.5s"], C.ticks_to_secs("c", 10000)) == ["12.346s", "0.001s", "1.5s"]
    assert run(spark, ["123456t"], C.ticks_to_secs("c", 0)) == [None]


def test_shift_and_seek(spark):
    assert run(spark, [1000, 86_399_000], C.shifted("c", 2000), "long") == [3000, 1000]
    assert run(spark, [1000], C.shifted("c", -2000), "long") == [0]
    want = [t + round(0.001749577141105422 * t + 0.18668641727612567) if t > 250 else t for t in (10.0, 250.0, 251.0, 3000.5)]
    assert run(spark, [10.0, 250.0, 251.0, 3000.5], C.seek_second("c"), "double") == want


def test_cleaning(spark):
    assert run(spark, ["【卡卡】終究abc12é♪ ", "　{x} 你 "], T.clean_zht("c")) == ["卡卡終究♪", "你"]
    assert run(spark, ["<i>♪ Olá</i>  (mundo)… 你好"], T.clean_for_speech("c")) == ["Olá mundo 你好"]
    assert run(spark, ["Olá 你好"], T.clean_for_speech("c", drop_cjk=True)) == ["Olá"]
    assert run(spark, ["你 好（a）.《b》\""], T.strip_punct_for_match("c")) == ["你好ab"]
    assert run(spark, ["rèn zhēn (nǚ):"], T.pinyin_slug("c")) == ["ren_zhen_nü"]
    assert run(spark, ["Coração"], T.strip_accents("c", captions=True)) == ["Coracao"]
    assert run(spark, ["a你", "abc"], T.has_cjk("c")) == [True, False]
    assert run(spark, ["a.pt-BR.srt", "b.ZH.vtt", "c.srt"], T.lang_tag("c")) == ["pt-BR", "ZH", ""]
    assert run(spark, ["<p>a<br>b</p>\n c"], T.html_to_text("c")) == ["a b c"]


def test_lines(spark):
    assert run(spark, ["Oi - tudo bem - sim", "- só", "nada", ""], T.split_dialogue("c")) == [["Oi", "- tudo bem - sim"], ["- só"], ["nada"], []]
    assert run(spark, [["一二三", "四五六"], ["一二三四", "五六七八", "九十一二三"], ["一二三四五六七八九十一", "二三"]], T.balance_two_lines("c"), "array<string>") == [["一二三四五六"], ["一二三四五六七八", "九十一二三"], ["一二三四五六七八九十一", "二三"]]
    assert run(spark, ["1.png", "15a.png", "1234b.png", "12345.png", "cover.png"], T.pad_frame_name("c")) == ["0001.png", "0015a.png", "1234b.png", "12345.png", None]


def test_wrap(spark):
    assert run(spark, ["um dois três quatro", "inacreditavelmente a b", "", None], wrap_words("c", 120)) == [["um dois", "três", "quatro"], ["inacreditavelmente", "a b"], [], None]


SAMPLE = '["認真的 (rèn zhēn de): sério", "我 (wǒ): eu", "超愛 (chāo ài): amo muito"]'


def tuples(rows):
    return [[tuple(p) for p in r] for r in rows]


def test_parse_pairs(spark):
    got = tuples(run(spark, [SAMPLE, '["x: y"]', "['a (b): c']", "N/A", "[]"], P.parse_pairs("c")))
    assert got == [[("認真的", "rèn zhēn de", "sério"), ("我", "wǒ", "eu"), ("超愛", "chāo ài", "amo muito")], [("x:", "", "")], [], [], []]
    strict = tuples(run(spark, ["['a (b): c', \"x: y: z\", 'no']", "[broken"], P.parse_pairs_strict("c")))
    assert strict == [[("a", "b", "c"), ("x", "", "y: z")], []]


def test_pair_text(spark):
    assert run(spark, [SAMPLE], P.format_pairs(P.parse_pairs("c"))) == [SAMPLE]
    assert run(spark, [SAMPLE, '["x: y"]', '["字　(zì): c"]'], P.pair_words("c")) == [["認真的", "我", "超愛"], [], ["字"]]
    assert run(spark, [SAMPLE], P.lookup_pinyin(F.lit("我"), "c")) == ["wǒ"]
    assert run(spark, [SAMPLE], P.lookup_pinyin(F.lit("他"), "c")) == ["他"]
    assert run(spark, ['```json\n["a", "b"]\n```', "a \n b", " ", "[1, 2]"], P.keep_json_string_list("c")) == ['["a","b"]', "a b", "N/A", "[1, 2]"]
    assert run(spark, ['["我(wǒ): eu"]'], P.pair_item_for_word("c", F.lit("我"))) == ["我 (wǒ): eu"]
    assert run(spark, ["", "[x]"], P.pair_item_for_word("c", F.lit("我"))) == ["N/A", "[x]"]


def model_segments(text, words):
    out, at = [], 0
    order = sorted(words, key=len, reverse=True)
    while at < len(text):
        hit = next((w for w in order if text.startswith(w, at)), text[at])
        out.append(hit)
        at += len(hit)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_segmentation_equals_model(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(60):
        words = list(dict.fromkeys("".join(r.choice("ab.\\E|") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 5))))
        rows.append((i, "".join(r.choice("ab.\\E|c\n") for _ in range(20)), [(w, f"p{k}", f"t{k}") for k, w in enumerate(words)]))
    df = spark.createDataFrame(rows, f"i int, t string, p array<{P.PAIR}>")
    got = {r["i"]: [(x["text"], x["pinyin"]) for x in r["s"]] for r in df.select("i", P.segment_longest_match("t", "p").alias("s")).collect()}
    for i, t, p in rows:
        own = {w: g for w, g, _ in reversed(p)}
        assert got[i] == [(x, own.get(x, "")) for x in model_segments(t, [w for w, *_ in p])]


def test_word_spans(spark):
    df = spark.createDataFrame([(1, "我愛我家", '["我 (wǒ): eu", "家 (jiā): casa"]'), (2, "xy", '["z (z): z"]')], "k int, t string, p string")
    got = {(r.k, r.pair_no, r.word, r.span_start, r.span_end) for r in P.word_spans(df, "t", "p").collect()}
    assert got == {(1, 0, "我", 0, 1), (1, 0, "我", 2, 3), (1, 1, "家", 3, 4), (2, -1, "x", 0, 1), (2, -1, "y", 1, 2)}


def test_pairs_column(spark):
    df = spark.createDataFrame([("a", 1, "1\tx\ty"), ("a", 2, f"1\tx\t{SAMPLE}"), ("a", 3, f"{SAMPLE}\tx")], "track_id string, line_no int, value string")
    assert [tuple(r) for r in P.find_pairs_column(df).collect()] == [("a", 2, 2)]


def test_items_of_other_shapes(spark):
    got = spark.createDataFrame([('["三(sān)", " x y", "(a) b", "a b (c): d", "w (p): t"]',)], "s string").select(P.parse_pairs("s").alias("p")).first().p
    assert [tuple(x) for x in got] == [("三", "", ""), ("a", "", ""), ("w", "p", "t")]


def test_long_lines(spark):
    words = [f"w{i % 50}" for i in range(20_000)]
    row = spark.createDataFrame([(" ".join(words), words, "[" + ", ".join(f'"{w}"' for w in words) + "]")], "t string, w array<string>, j string")
    got = row.select(T.balance_two_lines("w").alias("b"), F.length(P.keep_json_string_list("j")).alias("n")).first()
    assert len(got.b) == 2 and "".join(got.b) == "".join(words) and abs(len(got.b[0]) - len(got.b[1])) < 12 and got.n == len(row.first().j) - 19_999
    spans = P.word_spans(row.select("t", F.lit('["w1 (x): y"]').alias("p")), "t", "p")
    starts = sorted(r.span_start for r in spans.collect())
    line = " ".join(words)
    assert starts == [i for i in range(len(line)) if line.startswith("w1", i)]


def test_list_literals_as_python_reads_them(spark):
    import ast

    texts = [r"""['it\'s (x): a', "say \"b\": c", 'd: e',]""", r"""["a\u4f60 (b): c", 'x' ' y: z', "t:\ttab"]""", "[1, None, 'a: b', ['c: d']]", "('a: b',)", '["a: b", true]', "['a: b'", "['''long: q''']", " ['p: q']", "['p: q'] x", "", None, "[]", r"['\ud800: x']", '["a: b"]', "['" + "w (p): t', '" * 3000 + "z: y']"]
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", P.parse_pairs_strict("t").alias("p")).orderBy("i").collect()]
    for text, found in zip(texts, got, strict=True):
        try:
            listed = ast.literal_eval(text) if text and text.strip() else []
        except (SyntaxError, ValueError):
            listed = []
        own = [x.encode("utf-8", "replace").decode() for x in listed if isinstance(x, str) and ":" in x] if isinstance(listed, list) else []
        assert [x.translation for x in found] == [x.split(":", 1)[1].strip() for x in own]


def test_marks_in_items(spark):
    got = spark.createDataFrame([('["w\u0001v (p): t", "a\u0001 b", "w (p\u0001): t", "x (y): z"]',)], "s string").select(P.parse_pairs("s").alias("p")).first().p
    assert [tuple(x) for x in got] == [("w\u0001v", "p", "t"), ("a\u0001", "", ""), ("w", "p\u0001", "t"), ("x", "y", "z")]


def test_white_space_of_any_kind(spark):
    marks = [chr(i) for i in range(0x3100)]
    d = spark.createDataFrame([(f"{c}a{c}{c}b {c}c d{c} e{c}",) for c in marks] + [("",), (" 　\n",), (None,)], "t string")
    same = T.trim_all("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", "")) & T.squeeze("t").eqNullSafe(F.trim(F.regexp_replace("t", r"(?U)\s+", " ")))
    assert d.where(~same).collect() == []
    assert "regexp" not in d.select(T.trim_all("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_few_lines_are_worked_on_at_once():
    import pyarrow as pa

    texts = pa.array([f"ab{k}ab" if k % 9 else None for k in range(200)])
    pairs = pa.array([[{"word": "ab", "pinyin": str(k), "translation": None}] if k % 7 else None for k in range(200)])
    words = pa.array([["ab", f"{k}"] for k in range(200)])
    for parts, whole, given in ((P._segments, P._segmented, pairs), (P._places, P._placed, words)):
        made = list(parts.func(iter([(texts, given)])))
        assert max(map(len, made)) <= P.LINES_AT_ONCE and len(made) > 1
        filled = texts if given is pairs else texts.fill_null("")
        assert pa.chunked_array(made).to_pylist() == whole(filled, given).to_pylist()
