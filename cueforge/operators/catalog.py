"""File inventories: choosing, naming and following up work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions.text import has_cjk, lang_tag, pad_frame_name, trim_all
from cueforge.functions.timecode import _col


def subtitle_inventory(files: DataFrame, track: str = "track_id", name: str = "name", size: str = "size") -> DataFrame:
    """Rows (track, ext, lang, files, bytes) of subtitle files."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return files.select(track, ext.alias("ext"), lang_tag(name).alias("lang"), F.col(size).alias("_s")).where(F.col("ext").isin("srt", "vtt")).groupBy(track, "ext", "lang").agg(F.count("*").alias("files"), F.sum("_s").cast("long").alias("bytes"))


def inventory_languages(files: DataFrame, track: str = "track_id", name: str = "name") -> DataFrame:
    """Rows (track, languages): the distinct languages, sorted."""
    return files.select(track, lang_tag(name).alias("lang")).where("lang <> ''").groupBy(track).agg(F.array_sort(F.collect_set("lang")).alias("languages"))


def file_kind(name: Column | str) -> Column:
    """``zht``, ``pt``, ``es`` or ``eng`` by name; null for others and for derived files."""
    n = F.lower(_col(name))
    derived = n.rlike(r"_(secs|real)")
    zht = n.rlike(r"[-_]zht") & ~n.rlike(r"_(traditional|portuguese|secs|real)")
    return F.when(zht, "zht").when(derived, F.lit(None)).when(n.rlike(r"_pt") | n.endswith(".pt-br.srt"), "pt").when(n.rlike("_es"), "es").when(n.rlike("_eng"), "eng")


def choose_track_pair(files: DataFrame, track: str = "track_id", name: str = "name") -> DataFrame:
    """Rows (track, case, zht, other, other_kind): ``both``, ``zht_only``, ``other_only``, ``none`` or ``ambiguous``.

    The other language is Portuguese, else Spanish, else English; several files of a chosen kind are ambiguous.
    """
    k = files.withColumn("_k", file_kind(name))
    counts = k.groupBy(track).agg(*[F.count_if(F.col("_k") == x).alias(f"_n_{x}") for x in ("zht", "pt", "es", "eng")], *[F.min(F.when(F.col("_k") == x, F.col(name))).alias(f"_f_{x}") for x in ("zht", "pt", "es", "eng")])
    other = F.when(F.col("_n_pt") > 0, "pt").when(F.col("_n_es") > 0, "es").when(F.col("_n_eng") > 0, "eng")
    counts = counts.withColumn("other_kind", other)
    n_other = F.coalesce(F.when(F.col("other_kind") == "pt", F.col("_n_pt")).when(F.col("other_kind") == "es", F.col("_n_es")).when(F.col("other_kind") == "eng", F.col("_n_eng")), F.lit(0))
    f_other = F.when(F.col("other_kind") == "pt", F.col("_f_pt")).when(F.col("other_kind") == "es", F.col("_f_es")).when(F.col("other_kind") == "eng", F.col("_f_eng"))
    case = F.when((F.col("_n_zht") > 1) | (n_other > 1), "ambiguous").when((F.col("_n_zht") == 1) & (n_other == 1), "both").when(F.col("_n_zht") == 1, "zht_only").when(n_other == 1, "other_only").otherwise("none")
    return counts.select(track, case.alias("case"), F.col("_f_zht").alias("zht"), f_other.alias("other"), "other_kind")


def choose_subtitle_file(files: DataFrame, track: str = "track_id", name: str = "name") -> DataFrame:
    """Rows (track, name, ext): the subtitle file of each folder, VTT before SRT, the first by name; folders without one have no row."""
    ext = F.regexp_extract(name, r"(?i)\.(vtt|srt)$", 1)
    known = files.select(track, F.col(name).alias("name"), F.lower(ext).alias("ext")).where("ext <> ''")
    return known.groupBy(track).agg(F.min(F.struct((F.col("ext") != "vtt").alias("o"), "name", "ext")).alias("f")).select(track, "f.name", "f.ext")


def rename_plan(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Rows (folder, name, target, status): ``renamed``, ``right``, ``invalid`` or ``exists``.

    A target exists if a file has its name already, or if a file before this one, by name, is renamed to it; so
    carrying out the plan never overwrites a file. A padded name pads to itself, so all files that want a
    target or have it meet in one window.
    """
    planned = files.select(folder, name, pad_frame_name(name).alias("target"))
    w = Window.partitionBy(folder, F.coalesce("target", name))
    first = F.row_number().over(w.orderBy(F.col("target") != F.col(name), name)) == 1
    status = F.when(F.col("target").isNull(), "invalid").when(F.col("target") == F.col(name), "right").when(first, "renamed").otherwise("exists")
    return planned.select(folder, name, "target", status.alias("status"))


def status_totals(planned: DataFrame) -> DataFrame:
    """Rows (status, n)."""
    return planned.groupBy("status").agg(F.count("*").alias("n"))


def _stem(name: str) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def pending_items(items: DataFrame, done: DataFrame | None = None, folder: str = "folder", name: str = "name", suffix: str = "_processed") -> DataFrame:
    """Items without a counterpart ``<stem><suffix>``; processed and temporary files are no items."""
    done = items if done is None else done
    made = done.select(folder, _stem(name).alias("_s")).where(F.col("_s").endswith(suffix)).select(folder, F.expr(f"left(_s, length(_s) - {len(suffix)})").alias("_s")).distinct()
    own = items.where(~F.col(name).contains("_processed") & ~F.col(name).contains("_temp")).withColumn("_s", _stem(name))
    return own.join(made, [folder, "_s"], "left_anti").select(*items.columns)


def merge_manifest(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Rows (folder, chunk_no, name, status) in order for merging: ``processed``, ``promoted`` (only the original is there) or ``missing``.

    Numbers run over the range of the originals; processed files outside of it are listed as well.
    """
    number = F.regexp_extract(name, r"_chunk_(\d{1,9})(_processed)?\.[^.]+$", 1).try_cast("int")
    f = files.select(folder, F.col(name).alias("_name"), number.alias("chunk_no"), F.col(name).rlike(r"_processed\.[^.]+$").alias("_p")).where("chunk_no is not null")
    own = f.groupBy(folder, "chunk_no").agg(F.min(F.when(~F.col("_p"), F.col("_name"))).alias("_orig"), F.min(F.when(F.col("_p"), F.col("_name"))).alias("_proc"))
    span = own.where("_orig is not null").groupBy(folder).agg(F.min("chunk_no").alias("_a"), F.max("chunk_no").alias("_b")).select(folder, F.explode(F.sequence("_a", "_b")).alias("chunk_no"))
    j = span.join(own, [folder, "chunk_no"], "full").where(F.col("_proc").isNotNull() | F.col("_orig").isNotNull() | F.col("chunk_no").isNotNull())
    status = F.when(F.col("_proc").isNotNull(), "processed").when(F.col("_orig").isNotNull(), "promoted").otherwise("missing")
    return j.select(folder, "chunk_no", F.coalesce("_proc", "_orig").alias("name"), status.alias("status"))


def episodes_from(df: DataFrame, n: int, limit: int = 6, number: str = "episode_number") -> DataFrame:
    """The first ``limit`` episodes with a number of at least ``n``, by number."""
    return df.withColumn("_n", F.col(number).cast("string").try_cast("int")).where(F.col("_n") >= n).orderBy("_n").limit(limit).drop("_n")


def cjk_lines(df: DataFrame, text: str = "value", script_class: str = r"[一-鿿]") -> DataFrame:
    """Trimmed lines that hold the script."""
    return df.withColumn(text, trim_all(text)).where(F.col(text) != "").where(has_cjk(text, script_class))


def dedupe_by_id(df: DataFrame, id_col: str = "id", order: str = "pos") -> DataFrame:
    """The first row of each id."""
    w = Window.partitionBy(id_col).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
