"""Text columns: cleaning, scripts, line breaks, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueforge.functions.timecode import _col

#: Characters that Chinese lines lose.
ZHT_DROPPED = "【】[]{}" + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + "ÁÉÍÓÚÃÕÇÀÈÌÒÙÂÊÎÔÛáéíóúãõçàèìòùâêîôû"
ZHT_MARKER = "\x01c&HFF8000&"
#: Tone-marked vowels and their plain letters, then accents of captions.
TONES = ("āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜĀÁǍÀĒÉĚÈĪÍǏÌŌÓǑÒŪÚǓÙǕǗǙǛ", "aaaaeeeeiiiioooouuuuüüüüAAAAEEEEIIIIOOOOUUUUÜÜÜÜ")
ACCENTS = ("ãáàâäéèêëíìîïóòôöúùûüçñÃÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÇÑ", "aaaaaeeeeiiiioooouuuucnAAAAAEEEEIIIIOOOOUUUUCN")


#: Fixed value: the characters of Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_all(c: Column | str) -> Column:
    """Trim any Unicode white space."""
    return F.btrim(_col(c), F.lit(WHITE))


def one_space(c: Column | str) -> Column:
    """Runs of white space become one space; single spaces, which most runs are, aren't written anew."""
    return F.regexp_replace(_col(c), r"(?U)(?: \s|[\s&&[^ ]])\s*", " ")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(one_space(c))


def clean_zht(c: Column | str) -> Column:
    """Chinese line without brackets, Latin letters and digits."""
    dropped = F.translate(F.replace(_col(c), F.lit(ZHT_MARKER), F.lit("")), ZHT_DROPPED, "")
    return trim_all(dropped)


def clean_for_speech(c: Column | str, drop_cjk: bool = False) -> Column:
    """Line ready to be spoken: no tags, notes, brackets (their contents stay) or ellipses."""
    out = F.regexp_replace(_col(c), r"<[^>]+>", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    out = F.translate(out, "♪♫♬♭♮♯【】[]()（）…", "")
    if drop_cjk:
        out = F.regexp_replace(out, r"[一-鿿]+", "")
    return trim_all(out)


def strip_punct_for_match(c: Column | str) -> Column:
    """Line without the spaces and marks that segmentation skips."""
    return F.translate(_col(c), " 　（）.《》\"", "")


def strip_accents(c: Column | str, captions: bool = False) -> Column:
    """Tone marks off; with ``captions`` the accents of Portuguese captions instead."""
    return F.translate(_col(c), *(ACCENTS if captions else TONES))


def pinyin_slug(c: Column | str) -> Column:
    """Pinyin for a file name."""
    return F.translate(F.replace(strip_accents(c), F.lit(" "), F.lit("_")), ":()", "")


def has_cjk(c: Column | str, script_class: str = r"[一-鿿]") -> Column:
    """Whether the script occurs."""
    return _col(c).rlike(script_class)


def lang_tag(c: Column | str) -> Column:
    """Language of a subtitle file name, empty if it has none."""
    return F.regexp_extract(_col(c), r"(?i)\.([a-z]{2}(?:-[A-Z]{2})?)\.(?:srt|vtt)$", 1)


def split_dialogue(c: Column | str) -> Column:
    """Two speakers' lines if there is a dash: text before it, and text from it on; empty ones drop."""
    text = _col(c)
    at = F.instr(text, "-")
    head, tail = trim_all(F.substring_index(text, "-", 1)), trim_all(F.substring(text, at, F.length(text)))
    both = F.when(at > 0, F.array(head, tail)).otherwise(F.array(trim_all(text)))
    return F.filter(both, lambda x: x != "")


def balance_two_lines(c: Column | str, max_chars: int = 12) -> Column:
    """One line up to ``max_chars``; else words fill the first up to half of all characters and two, the rest follows."""
    words = _col(c)
    size = F.aggregate(words, F.lit(0), lambda a, x: a + F.length(x))
    # Words stay on the first line while the running length fits; the first always does.
    fits = lambda a, x, n: a["open"] & ((a["n"] + F.length(x)) * 2 <= n + 4)
    step = lambda n: lambda a, x: F.struct((a["n"] + F.length(x)).alias("n"), (a["k"] + F.when(fits(a, x, n), 1).otherwise(0)).alias("k"), fits(a, x, n).alias("open"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open"))
    cut = F.greatest(F.element_at(F.transform(F.array(size), lambda n: F.aggregate(words, start, step(n))["k"]), 1), F.lit(1))
    two = F.filter(F.array(F.array_join(F.slice(words, 1, cut), ""), F.array_join(F.slice(words, cut + 1, F.size(words)), "")), lambda x: x != "")
    return F.when(size <= max_chars, F.filter(F.array(F.array_join(words, "")), lambda x: x != "")).otherwise(two)


def pad_frame_name(c: Column | str) -> Column:
    """``12a.png`` to ``0012a.png``; null for other names; longer numbers stay."""
    name = _col(c)
    number, suffix = (F.regexp_extract(name, r"^(\d+)([a-zA-Z]*)\.png$", k) for k in (1, 2))
    wide = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.when(number != "", F.concat(wide, suffix, F.lit(".png")))


def html_to_text(c: Column | str) -> Column:
    """Tags become spaces, white space one space."""
    return squeeze(F.regexp_replace(_col(c), "<[^>]+>", " "))
