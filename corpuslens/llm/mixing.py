"""Mixing sources to target weights by Pfair scheduling.

Every source is cut, in reading order, into blocks of ``BLOCK_CHARS`` characters.  A source of
weight w releases its block k at slot floor(k / w) and wants it served by slot ceil((k + 1) / w);
each slot serves the released block with the earliest deadline.  So at every slot each source has
been served its weight times the number of slots, less than one block off.

Release and deadline are computed from the exact weights, in whole numbers, so that nothing adds
up over time.  The schedule has a row for each block that exists and is joined to the documents:
one pass holds a row for each source and emits the blocks; no document is scheduled by itself.
A document belongs to the block in which it starts.  No document is dropped: after a source runs
out its slots stay empty, and the others keep their proportions to each other.

Edge cases: a null source is a source of its own; a null or empty text counts one character, so
that every document has a place; repeated rows take their own places; weights of absent sources
are ignored, sources without a given weight share none of it and come last, in reading order; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuslens.llm import common

BLOCK_CHARS = 65_536
#: Without given weights a source weighs its characters to this power.
TEMPERATURE = 0.5


def in_slots(weights: Mapping[str, float], slots: int) -> dict[str, int]:
    """Whole slots of a period for each source, one at least; the largest remainders are rounded up."""
    total = sum(weights.values())
    share = {s: w / total * slots for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in share.items()}
    spare = slots - sum(out.values())
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s))[:max(0, spare)]:
        out[s] += 1
    return out


def windows(k: int, share: int, period: int) -> tuple[int, int]:
    """Release and deadline of block k of a source that gets ``share`` of ``period`` slots."""
    return k * period // share, -(-(k + 1) * period // share)


def served(shares: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of so many blocks of each source by earliest deadline.  Slots of a source
    that has run out, and all where nothing is released, stay empty."""
    period = sum(shares.values())
    waiting = [(0, s, 0) for s, n in blocks.items() if n > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (windows(k, shares[s], period)[1], s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        yield s, k, release, deadline, slot
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (windows(k + 1, shares[s], period)[0], s, k + 1))
        slot += 1


def schedule(shares: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one period by earliest deadline."""
    return list(served(shares, shares))


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    common_part = math.lcm(1, *{x.denominator for x in parts.values()})
    return {s: int(x * common_part) for s, x in parts.items()}


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block, from one row for each source."""
    weights, blocks = {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            weights[r["__cl_source"]], blocks[r["__cl_source"]] = r["weight"], r["blocks"]
    rows = served(exact(weights), blocks)
    names = ["__cl_source", "__cl_block_no", "__cl_release", "__cl_deadline", "__cl_slot"]
    while part := list(itertools.islice(rows, 50_000)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(zip(*part, strict=True))], names=names)


def deviation(counts: Mapping[str, int], shares: Mapping[str, int], slots: int) -> Fraction:
    """The largest difference between served and due blocks after so many slots."""
    period = sum(shares.values())
    return max(abs(counts.get(s, 0) - Fraction(n * slots, period)) for s, n in shares.items())


def place(docs: DataFrame, targets: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS,
          source: str = "source", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The documents (their columns ``keep``) with the columns of :func:`common.with_row_key` and ``__cl_start`` (characters of
    the source before it), ``__cl_block_no``, ``__cl_release``, ``__cl_deadline`` and ``__cl_slot``."""
    by = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    keyed = common.with_row_key(docs).withColumns({
        "__cl_source": by, "__cl_chars": F.greatest(F.length(common.whole_text(text)), F.lit(1)).cast("long")})
    keyed = keyed.select(*(docs.columns if keep is None else keep), common.FILE, common.BLOCK, common.ROW,
                         "__cl_source", "__cl_chars")
    placed = common.with_offsets(keyed, "__cl_chars", "__cl_start", ["__cl_source"])
    numbered = placed.withColumn("__cl_block_no", F.floor(F.col("__cl_start") / F.lit(block_chars)))
    found = numbered.groupBy("__cl_source").agg(F.sum("__cl_chars").alias("n"), (F.max("__cl_block_no") + 1).alias("blocks"))
    if targets is None:
        weighed = found.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    else:
        named = [("null" if s is None else f"={s}", float(w)) for s, w in targets.items() if w > 0]
        weighed = found.join(docs.sparkSession.createDataFrame(named, "__cl_source string, weight double"), "__cl_source")
    # One row for each source goes in, one for each block comes out, in one pass over time.
    table = common.shared_small(weighed.select("__cl_source", "weight", "blocks").repartition(1).mapInArrow(
        _slots, "__cl_source string, __cl_block_no long, __cl_release long, __cl_deadline long, __cl_slot long"))
    return numbered.join(table, ["__cl_source", "__cl_block_no"], "left")


def mixed(docs: DataFrame, targets: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents themselves in the order of their slots: written and read by file and row, they are the mix."""
    order = [F.asc_nulls_last("__cl_slot"), F.asc(common.FILE), F.asc(common.ROW)]
    return place(docs, targets, block_chars).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
