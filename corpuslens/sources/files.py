"""File inventories, hashes, headers and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.sources import byte_files
from corpuslens.sources.text_lines import file_name


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path))


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, name and size of every file; the content column is pruned."""
    return binary_files(spark, path, glob).select("path", file_name(F.col("path")).alias("name"), "length")


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """sha256 and md5 of whole files of any size, each read in chunks by one task.

    Where only Spark can open the path, the files go through ``binaryFile``, which ends at 2 GiB.
    """
    if byte_files.reachable(path):
        return byte_files.load(spark, byte_files.FileDigests, path, glob)
    return binary_files(spark, path, glob).select(
        "path", file_name(F.col("path")).alias("name"), "length",
        F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def input_evidence(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Key, path, hash and size of input files, sorted by key."""
    return file_hashes(spark, path, glob).select(
        F.col("name").alias("key"), "path", "sha256", F.col("length").alias("size_bytes")).orderBy("key")


def wav_headers(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """Form, channels, rate, bits and frames of wave files; only their headers are read."""
    return byte_files.load(spark, byte_files.WaveHeaders, path, glob)


def read_signals(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """Decoded signals, frames x channels; files that give none keep a reason."""
    return byte_files.load(spark, byte_files.WaveSignals, path, glob)


def shard_column(spark: SparkSession, glob: str, column: str, n: int) -> DataFrame:
    """One column of the matching parquet shards, up to ``n`` rows, with provenance."""
    return spark.read.parquet(glob).select(
        column, file_name(F.col("_metadata.file_path")).alias("shard")).limit(n)


def run_folders(inv: DataFrame) -> DataFrame:
    """(encoder, run) pairs of an inventory laid out as ``<encoder>/<run>/performance...``."""
    path = F.col("path")
    enc = F.regexp_extract(path, "([^/]+)/([^/]+)/performance[^/]*$", 1)
    run = F.regexp_extract(path, "([^/]+)/([^/]+)/performance[^/]*$", 2)
    return inv.select(enc.alias("encoder"), run.alias("run")).filter(
        (F.col("encoder") != "") & ~F.col("encoder").startswith("_")).distinct()
