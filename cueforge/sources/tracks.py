"""One named file a track: a data source writer that shows its files all at once or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cueforge.functions.timecode import ms_to_secs, ms_to_srt
from cueforge.operators.scan import ranked
from cueforge.sources.writers import base_line, escaped


def file_name(track: str | None, extension: str) -> str:
    """The file of a track: slashes, percent signs, control characters and a leading dot or underscore are percent-encoded."""
    name = "".join(quote(c, safe="") if c in "/%\\" or c < " " else c for c in track or "")
    if name[:1] in (".", "_", ""):
        name = "%" + f"{ord(name[0]):02X}" + name[1:] if name else "%"
    return name + extension


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Tracks(DataSourceArrowWriter):
    """Writes to a folder beside the target; a task's files come into it when the task ends, the folder takes the target's place when all have."""

    def __init__(self, options: dict, overwrite: bool):
        self.extension, self.separator = options.get("extension", ".txt"), options.get("separator", "\n")
        self.head, self.tail = options.get("head", ""), options.get("tail", "")
        self.overwrite, self.path = overwrite, options["path"]
        self.staged = f"{self.path.rstrip('/')}.{uuid.uuid4().hex}"

    def _folder(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path if ":" in path.partition("/")[0] else "file://" + path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Each track's values in order, one after another; only the open file is held."""
        store, base = self._folder(self.staged)
        own = f"{base}/open/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        store.create_dir(own)
        store.create_dir(f"{base}/done")
        names: list[str] = []
        out, track = None, None

        def end() -> None:
            if out is not None:
                out.write(self.tail.encode())
                out.close()

        for batch in iterator:
            for of, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or of != track:
                    end()
                    track = of
                    names.append(file_name(of, self.extension))
                    out = store.open_output_stream(f"{own}/{names[-1]}")
                    out.write(self.head.encode())
                else:
                    out.write(self.separator.encode())
                out.write((value or "").encode())
        end()
        for name in names:
            store.move(f"{own}/{name}", f"{base}/done/{name}")
        return _Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = self._folder(self.staged)
        target = self._folder(self.path)[1].rstrip("/")
        store.create_dir(f"{base}/done")
        if self.overwrite or store.get_file_info(target).type == fs.FileType.NotFound:
            if store.get_file_info(target).type != fs.FileType.NotFound:
                store.move(target, f"{base}/before")
            store.move(f"{base}/done", target)
        else:
            for f in store.get_file_info(fs.FileSelector(f"{base}/done")):
                store.move(f.path, f"{target}/{f.base_name}")
        store.delete_dir(base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = self._folder(self.staged)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


class TrackFiles(DataSource):
    """Format ``track_files``: rows (track, value) dealt and sorted by track; options extension, separator, head, tail."""

    @classmethod
    def name(cls) -> str:
        return "track_files"

    def writer(self, schema, overwrite: bool) -> _Tracks:
        return _Tracks(dict(self.options), overwrite)


def write_track_files(df: DataFrame, path: str, value: Column, extension: str, order: list[str], track: str = "track_id", separator: str = "\n", head: str = "", tail: str = "", mode: str = "overwrite") -> None:
    """A file a track with ``value`` of its rows in ``order``, in a folder that Python can reach from every executor (a mounted one, S3, GCS, HDFS).

    A track streams through one task to its file; nothing of it is gathered. A failed task leaves no file, a failed job none at all; with
    'append', files of equal names are replaced one by one. A null value is an empty one. Elsewhere, use the writers of ``writers``.
    """
    df.sparkSession.dataSource.register(TrackFiles)
    rows = df.select(F.col(track).cast("string").alias("_track"), value.alias("_value"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    dealt = rows.repartition("_track").sortWithinPartitions("_track", *[f"_o{k}" for k in range(len(order))]).select("_track", "_value")
    dealt.write.format("track_files").mode(mode).options(extension=extension, separator=separator, head=head, tail=tail).save(path)


def write_srt_files(df: DataFrame, path: str, track: str = "track_id", order: str = "pos", mode: str = "overwrite") -> None:
    """``{track}.srt``, renumbered from 1."""
    block = F.concat(F.col("_n").cast("string"), F.lit("\n"), ms_to_srt("begin_ms"), F.lit(" --> "), ms_to_srt("end_ms"), F.lit("\n"), F.col("text"), F.lit("\n"))
    write_track_files(ranked(df, track, [order], "_n"), path, block, ".srt", [order], track, mode=mode)


def write_base_files(df: DataFrame, path: str, track: str = "track_id", order: str = "line_no", mode: str = "overwrite") -> None:
    """``{track}.tsv``: the six columns of each base row."""
    write_track_files(df, path, base_line(df), ".tsv", [order], track, mode=mode)


def write_ttml_files(df: DataFrame, path: str, track: str = "track_id", order: str = "pos", mode: str = "overwrite") -> None:
    """``{track}.xml``: TTML with times in seconds."""
    line = F.concat(F.lit('<p begin="'), ms_to_secs("begin_ms"), F.lit('" end="'), ms_to_secs("end_ms"), F.lit('">'), escaped("text"), F.lit("</p>"))
    write_track_files(df, path, line, ".xml", [order], track, head='<tt xmlns="http://www.w3.org/ns/ttml"><body><div>\n', tail="\n</div></body></tt>", mode=mode)
