"""Word wrap, a sequential rule, as one vectorised helper."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cueforge.functions.timecode import _col


def _wrapped(text: str | None, most: int) -> list[str] | None:
    if text is None:
        return None
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= most:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines


def wrap_words(c: Column | str, width: int, font_size: int = 20) -> Column:
    """Greedy lines of at most max(3, width // int(font_size * 0.6)) characters; words stay whole."""
    most = max(3, width // max(1, int(font_size * 0.6)))

    @F.pandas_udf("array<string>")
    def wrap(text: pd.Series) -> pd.Series:
        return text.map(lambda t: _wrapped(t, most))

    return wrap(_col(c))
