"""Small helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tideline.session import scratch_path
from tideline.sources.tables import folder

# The words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows of a frame, written once to the shared folder: no later job repeats the work or its lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(table: DataFrame) -> None:
    """Removes the files of a ``saved`` table that no later work reads: what is made of it must have been written."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        fs, where = folder(table.sparkSession, path)
        fs.delete(where, True)


def local_table(spark: SparkSession, schema: str, rows: Iterable[tuple]) -> DataFrame:
    """A small table made on the driver, of known size: Spark broadcasts it under its threshold and shuffles beyond."""
    fields = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    table = pa.Table.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields, strict=True)], fields.names)
    return spark.createDataFrame(table, fields)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
