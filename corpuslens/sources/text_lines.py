"""Numbered rows of text files without shuffling them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from corpuslens.session import stored

_FILE, _BLOCK, _INDEX = "_split_file", "_split_block", "_split_index"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row in its input split.  A task reads a split from its first row to its last, so a count is enough."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(_FILE).to_pylist(), batch.column(_BLOCK).to_pylist(), strict=True))
        starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]]
        sizes = np.diff([*starts, len(keys)])
        index = np.arange(len(keys)) - np.repeat(starts, sizes)
        if keys[0] == last:
            index[:sizes[0]] += n
        last, n = keys[-1], int(index[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index, pa.int64())], names=[*batch.schema.names, _INDEX])


def with_row_numbers(rows: DataFrame, out: str, first: int = 1) -> DataFrame:
    """Add ``out``: the number of each row in its file, from ``first``; ``rows`` is a scan of files.

    Rows are counted in each input split, in place.  The counts of the splits before, a row for each split, are
    added; that table is written first, so its size is known when the two are joined.
    """
    keyed = rows.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK))
    sizes = keyed.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(_FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sizes.select(_FILE, _BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")), "offsets")
    counted = keyed.mapInArrow(_indexed, T.StructType([*keyed.schema.fields, T.StructField(_INDEX, T.LongType())]))
    return counted.join(offsets, [_FILE, _BLOCK]).withColumn(out, F.col("_o") + F.col(_INDEX) + first).drop(
        _FILE, _BLOCK, _INDEX, "_o")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, value): 1-based physical line numbers, blank lines counted."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return with_row_numbers(lines, "line_no").select("file", "line_no", "value")


def file_name(path):
    return F.substring_index(path, "/", -1)
