"""Incremental ledger upsert from a stream (K2).

Each micro-batch becomes a folder of its own, ``updates/run/batch``, that carries its place in the
order of updates.  A batch that runs again keeps the place it had, so a replay of an older batch
never overrules a later one.  Now and then the newest row of every id is written as a snapshot that
remembers how far it covers each run; reading takes the newest snapshot and the few updates beyond
it, and a batch that a snapshot covers is not written again.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuslens.operators.rules import assert_clean, duplicate_keys
from corpuslens.schemas import LEDGER, LEDGER_COLUMNS
from corpuslens.sources.sinks import children, exists, remove

#: Updates after which a snapshot is written.
COMPACT_EVERY = 50
_APPLIED = T.StructType([*LEDGER.fields, T.StructField("applied", T.LongType()), T.StructField("run", T.StringType()),
                         T.StructField("batch", T.LongType())])
_ORDER = ("applied", "run", "batch")


def _snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of complete snapshots, newest first."""
    found = [int(n) for n in children(spark, f"{root}/snapshots") if n.isdigit()]
    return sorted((n for n in found if exists(spark, f"{root}/snapshots/{n}/covered/_SUCCESS")), reverse=True)


def _covered(spark: SparkSession, root: str, snapshot: int | None) -> dict[str, int]:
    """The last batch of each run that a snapshot holds: a row for each streaming query that ever wrote."""
    if snapshot is None:
        return {}
    return {r.run: r.last for r in spark.read.parquet(f"{root}/snapshots/{snapshot}/covered").collect()}


def _updates(spark: SparkSession, root: str) -> list[tuple[int, str, int]]:
    """(place, run, batch) of every written update; folder names alone tell."""
    out = []
    for run in children(spark, f"{root}/updates"):
        for name in children(spark, f"{root}/updates/{run}"):
            batch, _, place = name.partition("-")
            if exists(spark, f"{root}/updates/{run}/{name}/_SUCCESS"):
                out.append((int(place), run, int(batch)))
    return sorted(out)


def _path(root: str, place: int, run: str, batch: int) -> str:
    return f"{root}/updates/{run}/{batch}-{place}"


def _newest_rows(spark: SparkSession, root: str, snapshot: int | None, updates: list[tuple[int, str, int]]) -> DataFrame:
    """The last row of every utt_id with its place; equal ids meet map-side before the shuffle."""
    covered = _covered(spark, root, snapshot)
    paths = [_path(root, *u) for u in updates if u[2] > covered.get(u[1], -1)]
    if snapshot is not None:
        paths.append(f"{root}/snapshots/{snapshot}/rows")
    if not paths:
        return spark.createDataFrame([], _APPLIED)
    rows = spark.read.schema(_APPLIED).parquet(*paths)
    if len(paths) == 1:
        # An update refuses repeated ids and a snapshot has none, so one folder alone needs no shuffle.
        return rows
    return rows.groupBy("utt_id").agg(F.max_by(F.struct(*_APPLIED.names), F.struct(*_ORDER)).alias("row")).select("row.*")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of every utt_id: the last snapshot and the updates beyond it."""
    return _newest_rows(spark, root, next(iter(_snapshots(spark, root)), None), _updates(spark, root)).select(*LEDGER_COLUMNS)


def apply_batch(updates: DataFrame, batch_id: int, root: str, run: str, compact_every: int = COMPACT_EVERY) -> None:
    """One micro-batch: repeated ids are refused, then its rows are written as a folder of their own.

    ``run`` names the streaming query, so a query that starts anew with a fresh checkpoint adds to
    what others wrote.  A batch that runs again is written again in its old place, or not at all if a
    snapshot covers it.  Runs at the same time may take the same place; then their names decide.
    """
    spark = updates.sparkSession
    updates = updates.select(*LEDGER_COLUMNS)
    assert_clean(duplicate_keys(updates, ["utt_id"], "duplicate_update"))
    snapshot = next(iter(_snapshots(spark, root)), None)
    if batch_id <= _covered(spark, root, snapshot).get(run, -1):
        return
    written = _updates(spark, root)
    last = max([p for p, _, _ in written] + ([] if snapshot is None else [snapshot]), default=-1)
    place = next((p for p, r, b in written if (r, b) == (run, batch_id)), last + 1)
    updates.withColumns({"applied": F.lit(place).cast("long"), "run": F.lit(run), "batch": F.lit(batch_id).cast("long")}).write.mode(
        "overwrite").parquet(_path(root, place, run, batch_id))
    covered = _covered(spark, root, snapshot)
    if sum(b > covered.get(r, -1) for _, r, b in written) + 1 >= compact_every:
        compact(spark, root)


def compact(spark: SparkSession, root: str) -> None:
    """Write the newest rows as a snapshot; remove what the snapshot before the last one needed.

    Updates stay until the next snapshot, and so does the last snapshot, for readers that began before.
    A snapshot is complete once it says what it covers.
    """
    done = _snapshots(spark, root)
    last, written = next(iter(done), None), _updates(spark, root)
    before = _covered(spark, root, last)
    if not written or written[-1][0] == last:
        return
    number = written[-1][0]
    covered = functools.reduce(lambda held, u: held | {u[1]: max(u[2], held.get(u[1], -1))}, written, before)
    _newest_rows(spark, root, last, written).write.mode("overwrite").parquet(f"{root}/snapshots/{number}/rows")
    spark.createDataFrame(list(covered.items()), "run string, last long").coalesce(1).write.mode("overwrite").parquet(
        f"{root}/snapshots/{number}/covered")
    for u in written:
        if u[2] <= before.get(u[1], -1):
            remove(spark, _path(root, *u))
    for old in done[1:]:
        remove(spark, f"{root}/snapshots/{old}")


def upsert_stream(stream: DataFrame, root: str, checkpoint: str):
    """Start the stream; each batch becomes a folder of the ledger's updates."""
    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        apply_batch(batch, batch_id, root, query)
    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
