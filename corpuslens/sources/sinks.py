"""Tables, reports and idempotent publication."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuslens.operators.reconcile import table_fingerprint
from corpuslens.operators.rules import duplicate_keys, require_schema, union_all
from corpuslens.schemas import LEDGER, LEDGER_COLUMNS


class PublicationConflict(RuntimeError):
    """An existing artifact differs from the one to be published."""


def _on_file_system(spark: SparkSession, path: str):
    """(file system of the path's scheme, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system its scheme names."""
    system, p = _on_file_system(spark, path)
    return system.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    system, p = _on_file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds."""
    system, p = _on_file_system(spark, path)
    system.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder on its file system."""
    system, p = _on_file_system(spark, source)
    if not system.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True) -> DataFrame:
    """CSV or parquet by suffix.

    Without a schema a pass over a CSV file infers its types.  Quoted line breaks need ``multiline``, which
    reads a file in one task; large files without them can switch it off.
    """
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, schema=schema, header=True, inferSchema=schema is None, escape='"', multiLine=multiline)
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    if path.rstrip("/").endswith(".csv"):
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_manifest(df: DataFrame, path: str, *, replace: bool = True) -> None:
    """All-or-nothing table: readers see ``_SUCCESS`` only after the job commits."""
    (df.write.mode("overwrite" if replace else "errorifexists").option("header", True)
     .option("escape", '"').option("emptyValue", "").csv(path))


def write_small_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Deterministic single-file CSV with LF line ends for small outputs."""
    (df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True)
     .option("lineSep", "\n").option("escape", '"').option("emptyValue", "").csv(path))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON line per row: keys sorted, non-finite numbers as null."""
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str, *, once: bool = False) -> None:
    """JSON-lines report; ``once`` fails when the destination exists."""
    json_rows(df).write.mode("errorifexists" if once else "overwrite").option("lineSep", "\n").text(path)


def fingerprint(df: DataFrame) -> str:
    """Order-insensitive fingerprint of a whole table: one aggregated row reaches the driver."""
    whole = df.withColumn("_all", F.lit("all"))
    rows = table_fingerprint(whole, ["_all"], df.columns).select("fingerprint").collect()
    return rows[0][0] if rows else hashlib.sha256(",".join(df.columns).encode()).hexdigest()


def publish_set(tables: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    """Publish several tables together.

    Equal content is accepted, missing tables are completed, and a difference refuses the whole
    set before anything is published.  Fingerprints, not bytes, are compared.  Each table is computed
    once, into a staging folder beside its destination; what is fingerprinted there is what moves in.
    """
    spark = next(iter(tables.values())).sparkSession
    state, prints = {}, {}
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
        prints[name] = fingerprint(spark.read.schema(df.schema).parquet(f"{staged}/{name}"))
        mark = f"{root}/_fingerprints/{name}"
        if exists(spark, f"{mark}/_SUCCESS"):
            stored = spark.read.text(mark).first()[0]
            state[name] = "kept" if stored == prints[name] else "conflict"
        else:
            state[name] = "written"
    clash = sorted(n for n, s in state.items() if s == "conflict")
    if clash:
        remove(spark, staged)
        raise PublicationConflict("Report-set conflict with existing content: " + ", ".join(clash))
    for name in tables:
        if state[name] == "written":
            # Without its fingerprint a table is left over from a publication that broke off.
            remove(spark, f"{root}/{name}")
            move(spark, f"{staged}/{name}", f"{root}/{name}")
            spark.createDataFrame([(prints[name],)], "value string").coalesce(1).write.mode(
                "overwrite").text(f"{root}/_fingerprints/{name}")
    remove(spark, staged)
    return state


# --- ledger -----------------------------------------------------------------------------------

def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ledger (empty when absent) and its duplicate ids (A10)."""
    if not exists(spark, path):
        df = spark.createDataFrame([], LEDGER)
    else:
        df = require_schema(spark.read.parquet(path), LEDGER_COLUMNS, "extraction ledger")
    return df, duplicate_keys(df, ["utt_id"])


# --- resumable stages -------------------------------------------------------------------------

def config_hash(config: Mapping) -> str:
    """First twelve digits of the sha256 of the sorted configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def run_stages(spark: SparkSession, root: str, config: Mapping,
               stages: Mapping[str, Callable[[Callable[[str], DataFrame]], DataFrame]], *,
               start: str | None = None, only: str | None = None, force: bool = False) -> dict[str, str]:
    """Run named stages in order, each writing ``root/<hash>/<stage>``.

    A stage whose output is complete for this configuration is skipped.  A stage receives a
    function that reads an earlier stage's output.
    """
    names = list(stages)
    for wanted in (start, only):
        if wanted is not None and wanted not in stages:
            raise ValueError(f"unknown stage {wanted!r}; stages: {', '.join(names)}")
    base = f"{root}/{config_hash(config)}"

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{base}/{name}")

    chosen = [only] if only else names[names.index(start):] if start else names
    report = {}
    for name in chosen:
        if not force and exists(spark, f"{base}/{name}/_SUCCESS"):
            report[name] = "skipped"
            continue
        stages[name](read).write.mode("overwrite").parquet(f"{base}/{name}")
        report[name] = "done"
    return report
