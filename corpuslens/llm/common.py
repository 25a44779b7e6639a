"""Helpers of the corpus operators: stable row keys, tables in the shared folder, running totals."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuslens.session import scratch_path

#: Names of the columns that :func:`with_row_key` adds.  The prefix keeps them clear of users' columns.
FILE, BLOCK, ROW = "__cl_file", "__cl_block", "__cl_row"
ROW_KEY = [FILE, ROW]
#: Characters that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]"


def written(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cheap to read again, and
    no lost executor makes it run a second time.  Tables with texts are compressed harder; for
    the many narrow ones that would cost each executor native memory and save little."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd" if texts else "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`written` whose last reader has been written itself."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(df: DataFrame) -> DataFrame:
    """Add a key of each row: its file, the start of its split and its index in the file.

    The key belongs to the stored row: reading again after a loss, or with other splits, gives
    the same file and index, and (file, index) is the reading order.  Frames that do not read
    Parquet files are written to the shared folder first.
    """
    try:
        meta = df.metadataColumn("_metadata")
        return df.withColumns({FILE: meta["file_path"], BLOCK: meta["file_block_start"], ROW: meta["row_index"]})
    except AnalysisException:
        if not df.columns:
            raise
        return with_row_key(written(df, "rows", texts=True))


def _mapped(batches: Iterator[pa.RecordBatch], source: str, make: Callable, types: list[pa.DataType],
            names: list[str], step: int) -> Iterator[pa.RecordBatch]:
    use = make()
    for batch in batches:
        at = batch.schema.get_field_index(source)
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            made = use(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(part.columns) if i != at]
                + [pa.array(v, t) for v, t in zip(made, types, strict=True)], names=names)


def with_python(df: DataFrame, source: str, make: Callable, fields: str, step: int = 500) -> DataFrame:
    """Replace the column ``source`` by ``fields``: ``make()`` gives, once a task, a function from a list of
    its values to a list of columns.  All other columns pass through as Arrow data, untouched."""
    new = T.StructType.fromDDL(fields)
    rest = [f for f in df.schema if f.name != source]
    schema = T.StructType([*rest, *new])
    work = functools.partial(_mapped, source=source, make=make, types=[to_arrow_type(f.dataType) for f in new],
                             names=schema.names, step=step)
    return df.mapInArrow(work, schema)


def _running(batches: Iterator[pa.RecordBatch], keys: list[str], mass: str) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.select([*keys, mass]).to_pandas()
        by = [rows[k] for k in keys]
        upto = rows[mass].groupby(by).cumsum()
        labels = list(zip(*by, strict=True))
        before = upto.to_numpy(np.int64) - rows[mass].to_numpy(np.int64) + np.array([held.get(k, 0) for k in labels], np.int64)
        for k, v in zip(labels, (before + rows[mass].to_numpy(np.int64)).tolist(), strict=True):
            held[k] = v
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "__cl_before"])


def with_offsets(df: DataFrame, mass: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: the sum of ``mass`` over the rows of the same ``by`` that are read earlier.

    ``df`` has the columns of :func:`with_row_key`.  First pass: running sums inside each file
    split, where rows come in order; ``df`` with them is written to the shared folder.  Second
    pass: totals of the splits, a row for each split and value of ``by``, are summed up in
    reading order and added.  Rows are neither sorted nor shuffled.  ``by`` holds strings
    without nulls.
    """
    keys = [FILE, BLOCK, *by]
    schema = T.StructType([*df.schema.fields, T.StructField("__cl_before", T.LongType())])
    first = written(df.mapInArrow(functools.partial(_running, keys=keys, mass=mass), schema), "running", texts=True)
    totals = first.groupBy(*keys).agg(F.sum(mass).alias("__cl_total"))
    over = Window.partitionBy(*by).orderBy(FILE, BLOCK) if by else Window.orderBy(FILE, BLOCK)
    base = totals.select(*keys, (F.sum("__cl_total").over(over) - F.col("__cl_total")).alias("__cl_base"))
    return (first.join(shared_small(base), keys)
            .withColumn(out, F.col("__cl_before") + F.col("__cl_base")).drop("__cl_before", "__cl_base"))


#: Rows up to which a table of split totals is broadcast; a wider one is joined by shuffling.
MAX_BROADCAST_ROWS = 500_000


def shared_small(df: DataFrame) -> DataFrame:
    """Write a table that is expected to be small; broadcast it only if its counted rows are few."""
    table = written(df, "small")
    return F.broadcast(table) if table.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else table


def least_hashed(table: DataFrame, most: int) -> DataFrame:
    """Rows that surely hold the ``most`` of least ``h``, a 64-bit hash, and few more: those below a hash that the
    counted rows name.  Taking the first of them in order then brings little more than ``most`` rows to the driver,
    whatever the number of tasks."""
    n = table.count()
    if n <= 2 * most:
        return table
    # Six deviations of the number of rows below the cut, and once more the same for good measure.
    share = (most + 12 * most**0.5 + 100) / n
    below = table.where(F.col("h") < int(-2**63 + min(1.0, share) * (2**64 - 1)))
    return below if below.limit(most).count() == most else table


#: Bytes of row bitmaps up to which they are broadcast: half a billion rows.
MAX_BITMAP_BYTES = 64_000_000


def only_rows(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``keyed`` joined with ``wanted`` by their row keys, most others left out before the shuffle.

    The wanted rows of each file become bitmaps of 32,768 rows, a bit for each row, which are broadcast as long
    as all of them, counted, are small; then only wanted rows are shuffled with their columns.
    """
    bits = written(wanted.groupBy(FILE, F.bitmap_bucket_number(ROW).alias("__cl_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(ROW)).alias("__cl_bits")), "bitmaps")
    if bits.count() * 4096 <= MAX_BITMAP_BYTES:
        place = F.bitmap_bit_position(ROW)
        byte = F.conv(F.hex(F.substring("__cl_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        there = F.call_function("getbit", byte, (place % 8).cast("int")) == 1
        keyed = keyed.withColumn("__cl_bucket", F.bitmap_bucket_number(ROW)).join(F.broadcast(bits), [FILE, "__cl_bucket"]).where(
            there).drop("__cl_bucket", "__cl_bits")
    return keyed.join(wanted, ROW_KEY)


def whole_text(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
