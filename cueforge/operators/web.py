"""Episode lists from web pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueforge.functions.pages import DATE_FORMS, episode_links

_LINK = "struct<url:string,title:string,alt:string,number:string,heading:string,date:string>"


def _named_date(text: Column) -> Column:
    """The date that a title or a picture's text names."""
    return F.nullif(F.regexp_extract(text, rf"(?iu){DATE_FORMS['named date']}", 1), F.lit(""))


def extract_episodes(pages: DataFrame, page: str = "page_id", html: str = "html", link_re: str = r"/v/[^\x22'?]*\?s=0s", id_re: str = r"/v/([^/?]+)", word_re: str = "Cap[íi]tulo|Epis[óo]dio", kind: str = "episode", card_class: str = "episode|card|item|chapter|video|content") -> DataFrame:
    """Rows (page, pos, id, episode_number, chapter_date, title, url, type) of the episode links of each page.

    Only links whose address matches ``link_re`` count. What a link's card says decides: the text of its nearest ancestor
    with a class that ``card_class`` is found in, else that of its parent if no other link is in it, else its own. The number is ``N. word`` in it, else ``Episódio N``,
    else ``word N``, else that of the last heading between the link before and this one (``N. word`` at its start), else
    the place of the link; the date is that of the card, else of the link's title, else of its picture (or the card's first);
    it falls back to ``Capítulo {id}``, which the title then leaves out.

    Pages are read in one pass each, in the tasks that hold them; nothing is shuffled. A null page has no links, an unclosed
    element ends with its parent or the page, rows that repeat a page are read alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([episode_links(text, card_class, word_re) for text in batch.column("_html").to_pylist()], made)
            yield pa.RecordBatch.from_arrays([batch.column(page), found], [page, "_links"])

    made = pa.list_(pa.struct([(n, pa.string()) for n in ("url", "title", "alt", "number", "heading", "date")]))
    read = pages.select(page, F.col(html).alias("_html"))
    linked = read.mapInArrow(run, f"`{page}` {pages.schema[page].dataType.simpleString()}, _links array<{_LINK}>")
    own = F.filter("_links", lambda x: x["url"].rlike(link_re) & (F.regexp_extract(x["url"], id_re, 1) != ""))
    each = linked.select(page, F.posexplode(own).alias("pos", "e")).select(page, "pos", "e.*").withColumn("id", F.regexp_extract("url", id_re, 1))
    number = F.coalesce(F.nullif("number", F.lit("")), F.nullif("heading", F.lit("")), (F.col("pos") + 1).cast("string"))
    dated = F.coalesce(F.nullif("date", F.lit("")), _named_date(F.col("title")), _named_date(F.col("alt")))
    done = each.select(page, "pos", "id", number.alias("episode_number"), dated.alias("_date"), "url", F.lit(kind).alias("type"))
    date = F.coalesce("_date", F.concat(F.lit("Capítulo "), F.col("id")))
    title = F.concat(F.lit("Episódio "), F.col("episode_number"), F.coalesce(F.concat(F.lit(", "), F.col("_date")), F.lit("")))
    return done.select(page, "pos", "id", "episode_number", date.alias("chapter_date"), title.alias("title"), "url", "type")
