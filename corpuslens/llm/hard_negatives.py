"""Hard negatives by bounds along a spanning tree of anchors.

Vectors become whole numbers, so inner products are exact.  Anchors lie in blocks, and each block
has a minimum spanning tree over its anchors.  A block of candidates is scored against the root of
a tree; along an edge of length d the score of a candidate c changes by at most d * |c|, so the
bounds of the parent, widened by that, bound the scores at the child.  Only candidates whose bounds
overlap the window that an anchor looks for are scored again, exactly, and these exact scores narrow
the bounds for the anchors below.  Two passes: the nearest rows of the anchor's own label (the
positives; their window begins at the best lower bounds), then, for each positive, the rows of other
labels whose scores lie in a window below the positive's.

Candidates are read in place and never shuffled by anchor.  Anchors reach the tasks by broadcasts of
at most ``GROUP_BYTES``, which are measured before; more anchors mean more passes over the candidates,
each written to the shared folder.  Only the first few of each block leave a task.

Edge cases: rows with a null label, a null vector, or null or non-finite components take no part;
vectors meet only vectors of their own length, empty ones included; an anchor excludes only its own
row, so repeated rows are partners of their own and a repeated anchor row gives its results again; a
null vec_id is a candidate that ranks last among ties, and no anchor; ties go to the smaller vec_id;
an anchor without positives, or a positive without negatives, gives no rows; an empty table gives no
rows; scores beyond the range of a long are kept at its ends; extra columns are not used.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm import common

POSITIVES = NEGATIVES = 5
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 80, 100
SCALE = 256.0
#: Numbers in a block of candidates, anchors in a block at most, bytes of anchors sent out at once.
BLOCK_CELLS, ANCHORS, GROUP_BYTES = 1 << 18, 256, 32_000_000
_LONG = 2**63 - 1


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parents and edge lengths of a minimum spanning tree; parents come before children, the root has -1."""
    n = len(vectors)
    order, parent, edge = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n)
    gap, via, outside = np.full(n, np.inf), np.full(n, -1, np.int32), np.ones(n, bool)
    now = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    for i in range(n):
        order[i], parent[now], outside[now] = now, via[now], False
        edge[now] = gap[now] if via[now] >= 0 else 0.0
        far = np.sqrt(((vectors - vectors[now]) ** 2).sum(axis=1))
        closer = outside & (far < gap)
        gap[closer], via[closer] = far[closer], now
        if i + 1 < n:
            now = int(np.argmin(np.where(outside, gap, np.inf)))
    return order, parent, edge


def exact_scores(rows: np.ndarray, anchor: np.ndarray, wide: bool = False) -> np.ndarray:
    """Inner products of whole numbers as longs; ``wide`` if doubles cannot hold them."""
    if not wide:
        return (rows @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in rows]
    return np.array([min(max(s, -_LONG - 1), _LONG) for s in sums], np.int64)


def walk(anchors: dict, cells: np.ndarray, wanted: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows, exact scores) along the tree; ``wanted(anchor, low, high)`` marks the rows to score again."""
    norms = np.sqrt((cells ** 2).sum(axis=1))
    wide = np.abs(cells).max(initial=0.0) * np.abs(anchors["cells"]).max(initial=0.0) * max(1, cells.shape[1]) >= 2.0**53
    children = np.bincount(anchors["parent"][anchors["parent"] >= 0], minlength=len(anchors["order"]))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in anchors["order"].tolist():
        up = int(anchors["parent"][i])
        if wide:
            # Every score is taken exactly.
            low, high = np.full(len(cells), -np.inf), np.full(len(cells), np.inf)
        elif up < 0:
            low = exact_scores(cells, anchors["cells"][i]).astype(np.float64)
            high = low.copy()
        else:
            # The factor and the constant cover rounding of the bounds.
            room = anchors["edge"][i] * norms
            room += 1.0 + 1e-9 * (room + norms * np.linalg.norm(anchors["cells"][up]))
            low, high = bounds[up][0] - room, bounds[up][1] + room
            children[up] -= 1
            if not children[up]:
                del bounds[up]
        rows = np.flatnonzero(wanted(i, low, high))
        # Most rows: one product with the block as it lies is cheaper than copying them out.
        whole = 2 * len(rows) > len(cells) and not wide
        scores = exact_scores(cells, anchors["cells"][i])[rows] if whole else exact_scores(cells[rows], anchors["cells"][i], wide)
        if children[i] and not wide:
            low[rows] = high[rows] = scores
            bounds[i] = low, high
        yield i, rows, scores


def _first(block: dict, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places in ``rows`` by falling score, then rising vec_id, null last."""
    return np.lexsort((block["ids"][rows], block["null_ids"][rows], -scores))


def positives_of(anchors: dict, block: dict, wanted: int) -> list[tuple]:
    """(anchor, row, score) of the first rows of a block that have the anchor's label."""
    def open_rows(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        same = (block["labels"] == anchors["labels"][i]) & (block["own"] != anchors["own"][i])
        held = low[same]
        floor = np.partition(held, -wanted)[-wanted] if len(held) > wanted else -np.inf
        return same & (high >= floor)

    out = []
    for i, rows, scores in walk(anchors, block["cells"], open_rows):
        out += [(i, int(rows[k]), int(scores[k])) for k in _first(block, rows, scores)[:wanted]]
    return out


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole numbers s with low * score <= 100 * s <= high * score, as both ends."""
    return -(-low * score // 100), high * score // 100


def negatives_of(anchors: dict, block: dict, wanted: int, low: int, high: int) -> list[tuple]:
    """(anchor, number of the positive, row, score) of the first rows of a block in each positive's window."""
    windows = [[window(int(s), low, high) for s in scores] for scores in anchors["p_scores"]]

    def open_rows(i: int, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        ends = [w for w in windows[i] if w[0] <= w[1]]
        if not ends:
            return np.zeros(len(least), bool)
        return ((block["labels"] != anchors["labels"][i]) & (most >= min(w[0] for w in ends) - 1.0)
                & (least <= max(w[1] for w in ends) + 1.0))

    out = []
    for i, rows, scores in walk(anchors, block["cells"], open_rows):
        ends = windows[i]
        if not ends or not len(rows):
            continue
        inside = (scores >= min(w[0] for w in ends)) & (scores <= max(w[1] for w in ends))
        rows, scores = rows[inside], scores[inside]
        order = _first(block, rows, scores)
        rows, falling = rows[order], scores[order]
        rising = falling[::-1]
        for p, (least, most) in enumerate(ends):
            start = len(rising) - int(np.searchsorted(rising, most, "right"))
            stop = len(rising) - int(np.searchsorted(rising, least, "left"))
            out += [(i, p, int(rows[k]), int(falling[k])) for k in range(start, min(stop, start + wanted))]
    return out


ROW_BLOCK = "dim int, least long, most long, ids binary, null_ids binary, own binary, labels binary, cells binary"
ANCHOR_BLOCK = (ROW_BLOCK + ", tree_order binary, parent binary, edge binary, p_ids array<array<long>>, "
                "p_nulls array<array<boolean>>, p_scores array<array<long>>")


def _pack(batches: Iterator[pd.DataFrame], most: int, tree: bool) -> Iterator[pd.DataFrame]:
    """Rows to blocks; the rows of a task that have one length share blocks."""
    held: dict[int, list] = {}

    def block(dim: int) -> pd.DataFrame:
        rows = held.pop(dim)
        pick = lambda name, kind: np.array([getattr(r, name) for r in rows], kind)
        cells, labels = np.array([r.vector for r in rows], np.float64).reshape(len(rows), dim), pick("label", np.int64)
        out = {"dim": dim, "least": labels.min(), "most": labels.max(), "ids": pick("vec_id", np.int64).tobytes(),
               "null_ids": pick("null_id", bool).tobytes(), "own": pick("own", np.int64).tobytes(),
               "labels": labels.tobytes(), "cells": cells.tobytes()}
        if tree:
            order, parent, edge = spanning_tree(cells)
            out |= {"tree_order": order.tobytes(), "parent": parent.tobytes(), "edge": edge.tobytes()}
            out |= {c: [list(getattr(r, c)) for r in rows] for c in ("p_ids", "p_nulls", "p_scores")}
        return pd.DataFrame({c: [v] for c, v in out.items()})

    for batch in batches:
        for row in batch.itertuples(index=False):
            dim = len(row.vector)
            rows = held.setdefault(dim, [])
            rows.append(row)
            if len(rows) >= min(most, max(16, BLOCK_CELLS // max(1, dim))):
                yield block(dim)
    for dim in list(held):
        yield block(dim)


def _opened(row) -> dict:
    """A packed block as arrays."""
    out = {"dim": row["dim"], "least": row["least"], "most": row["most"], "ids": np.frombuffer(row["ids"], np.int64),
           "null_ids": np.frombuffer(row["null_ids"], bool), "own": np.frombuffer(row["own"], np.int64),
           "labels": np.frombuffer(row["labels"], np.int64)}
    return out | {"cells": np.frombuffer(row["cells"]).reshape(len(out["ids"]), row["dim"])}


def _opened_anchors(row) -> dict:
    return _opened(row) | {"order": np.frombuffer(row["tree_order"], np.int32), "parent": np.frombuffer(row["parent"], np.int32),
                           "edge": np.frombuffer(row["edge"])} | {c: row[c] for c in ("p_ids", "p_nulls", "p_scores")}


def _ids(block: dict, rows: list[int]):
    return pd.array([None if block["null_ids"][r] else int(block["ids"][r]) for r in rows], "Int64")


def _meet(batches: Iterator[pd.DataFrame], sent, wanted: int, low: int, high: int, first_pass: bool) -> Iterator[pd.DataFrame]:
    """Each block of candidates with each block of anchors that was sent out."""
    groups = [_opened_anchors(row) for row in sent.value]
    for batch in batches:
        for row in batch.to_dict("records"):
            block = _opened(row)
            for anchors in groups:
                if anchors["dim"] != block["dim"]:
                    continue
                if first_pass:
                    if anchors["least"] > block["most"] or block["least"] > anchors["most"]:
                        continue
                    found = [(a, 0, r, s) for a, r, s in positives_of(anchors, block, wanted)]
                else:
                    if anchors["least"] == anchors["most"] == block["least"] == block["most"]:
                        continue
                    found = negatives_of(anchors, block, wanted, low, high)
                if not found:
                    continue
                a, p, r, s = zip(*found, strict=True)
                out = {"own": anchors["own"][list(a)], "anchor_id": anchors["ids"][list(a)], "no": p,
                       "vec_id": _ids(block, r), "score": s}
                if not first_pass:
                    out["positive_id"] = pd.array([None if anchors["p_nulls"][i][k] else anchors["p_ids"][i][k]
                                                   for i, k in zip(a, p, strict=True)], "Int64")
                    out["positive_score"] = [anchors["p_scores"][i][k] for i, k in zip(a, p, strict=True)]
                yield pd.DataFrame(out)


def _groups(anchors: DataFrame) -> list[DataFrame]:
    """The blocks of anchors in parts of at most ``GROUP_BYTES`` (a single block may be larger)."""
    size = F.length("cells") + F.length("edge") * 12
    total, n = anchors.agg(F.sum(size), F.count("*")).first()
    parts = max(1, -(-(total or 0) // GROUP_BYTES))
    while True:
        part = F.pmod(F.xxhash64("own"), F.lit(parts))
        sizes = anchors.groupBy(part).agg(F.sum(size).alias("bytes")).agg(F.max("bytes")).first()[0]
        if (sizes or 0) <= 2 * GROUP_BYTES or parts > 4 * n:
            return [anchors.where(part == i) for i in range(parts)]
        parts *= 2


def _passes(blocks: DataFrame, anchors: DataFrame, schema: str, name: str, **how) -> DataFrame:
    """All blocks of candidates against all blocks of anchors, one part of the anchors after the other."""
    spark, out = blocks.sparkSession, []
    for part in _groups(anchors):
        # At most twice GROUP_BYTES, as measured.
        sent = spark.sparkContext.broadcast(part.collect())
        out.append(common.written(blocks.mapInPandas(functools.partial(_meet, sent=sent, **how), schema), name))
        sent.destroy()
    return functools.reduce(DataFrame.union, out)


def _best(found: DataFrame, by: list[str], wanted: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, scale: float = SCALE, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, embedding and label.  ``is_anchor`` is a condition on the row; ``label``
    replaces the column of that name.  Components become the floor of ``scale`` times their value.
    """
    keyed = common.with_row_key(vectors)

    def whole(x: Column) -> Column:
        # floor() gives a long; doubles beyond are whole numbers already.
        x = x.cast("double") * scale
        return F.when(F.abs(x) >= 2.0**62, x).otherwise(F.floor(x).cast("double"))

    kept = keyed.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) != float("inf"))))
    kept = kept.select(
        F.coalesce("vec_id", F.lit(-1)).cast("long").alias("vec_id"), F.col("vec_id").isNull().alias("null_id"),
        F.xxhash64(*common.ROW_KEY).alias("own"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.transform("embedding", whole).alias("vector"),
        (F.col("vec_id").isNotNull() & F.coalesce(is_anchor, F.lit(False))).alias("anchor"))
    rows = common.written(kept.where("label is not null"), "vectors")
    n, n_anchors, cells = rows.agg(F.count("*"), F.count_if("anchor"), F.sum(F.size("vector"))).first()
    parts = max(1, -(-(cells or 0) // BLOCK_CELLS), -(-n // BLOCK_CELLS))
    # Rows of a label lie together, a frequent label in many blocks.
    blocks = common.written(rows.drop("anchor").repartitionByRange(parts, "label", "own").mapInPandas(
        functools.partial(_pack, most=BLOCK_CELLS, tree=False), ROW_BLOCK), "blocks")
    anchors = rows.where("anchor").drop("anchor")
    anchor_parts = max(1, -(-n_anchors // ANCHORS))

    def packed(frame: DataFrame) -> DataFrame:
        return common.written(frame.repartitionByRange(anchor_parts, "label", "own").mapInPandas(
            functools.partial(_pack, most=ANCHORS, tree=True), ANCHOR_BLOCK), "anchors")

    bare = anchors.withColumns({"p_ids": F.array().cast("array<long>"), "p_nulls": F.array().cast("array<boolean>"),
                                "p_scores": F.array().cast("array<long>")})
    near = _passes(blocks, packed(bare), "own long, anchor_id long, no int, vec_id long, score long", "positives",
                   wanted=positives, low=low, high=high, first_pass=True)
    best = _best(near, ["own"], positives).groupBy("own").agg(F.sort_array(F.collect_list(
        F.struct("rank", "score", F.col("vec_id").isNull().alias("null"), F.coalesce("vec_id", F.lit(-1)).alias("id")))).alias("p"))
    windows = best.select("own", F.col("p.id").alias("p_ids"), F.col("p.null").alias("p_nulls"), F.col("p.score").alias("p_scores"))
    far = _passes(blocks, packed(anchors.join(windows, "own")),
                  "own long, anchor_id long, no int, vec_id long, score long, positive_id long, positive_score long", "negatives",
                  wanted=negatives, low=low, high=high, first_pass=False)
    return _best(far, ["own", "no"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
