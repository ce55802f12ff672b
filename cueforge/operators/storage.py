"""Tables between the steps of an operator."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cueforge-")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that it is computed once and its lineage ends.

    It lies in the folder that the session names in ``spark.checkpoint.dir``; a temporary one serves only where none is named, as in tests.
    """
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_folder()
    path = f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
