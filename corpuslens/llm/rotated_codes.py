"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is normalised, rotated by one random orthogonal matrix and kept as the signs of its
coordinates, packed into bits, with one correction scalar: the inner product of the vector with
its own code.  For a query the inner product with a code, divided by the scalar, is an unbiased
estimate of the cosine, and the scalar bounds its error.  Vectors lie in blocks; a query block
meets every vector block of its dimension.  Inside such a meeting the best estimates are ranked
exactly first, which gives a floor for the nearest wanted; then exactly those vectors whose upper
bound reaches the floor are reranked by the exact cosine in double precision.  Only the nearest of
each meeting leave the task, and the nearest of these are the answer.

The rotation and the error factor are parameters, nothing is fitted; every vector is encoded.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, as
queries and as candidates; vectors meet only vectors of their own dimension; a query with fewer
candidates than wanted gets all; ties go to the smaller vec_id; repeated rows are candidates of
their own, and a repeated query row is a query of its own, which excludes only itself; a null
vec_id is a candidate that ranks last among ties, and no query; an empty table gives no rows;
extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpuslens.llm import common

NEAREST = 5
#: Vectors in a block, queries in a query block.
BLOCK, QUERY_BLOCK = 4096, 512
#: Standard deviations of the estimate that the error bound allows; 1.9 is usual, more is safer.
ERROR_FACTOR = 2.5
SEED = 20240521


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors and each vector's inner product with its code."""
    dim = units.shape[1]
    turned = units @ rotation(dim).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(dim)


def estimate(queries: np.ndarray, bits: np.ndarray, scalar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of unit queries with coded vectors, and the error bound of each vector."""
    dim = queries.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    turned = (queries @ rotation(dim).T).astype(np.float32)
    near = (turned @ signs.T) / scalar.astype(np.float32)
    bound = ERROR_FACTOR * np.sqrt(np.maximum(0, 1 - scalar ** 2) / scalar ** 2 / max(1, dim - 1))
    return near, bound


def _pack_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (vec_id, own key, vector, null flag) to blocks with codes; a task's rows of a dimension share blocks."""
    held: dict[int, list] = {}

    def block(dim: int, rows: list) -> pd.DataFrame:
        vectors = np.array([r[2] for r in rows], np.float64)
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits, scalar = encode(units)
        ids = np.array([r[0] for r in rows], np.int64)
        null = np.array([r[3] for r in rows], bool)
        return pd.DataFrame({"dim": [dim], "ids": [ids.tobytes()], "null_ids": [null.tobytes()],
                             "own": [np.array([r[1] for r in rows], np.int64).tobytes()],
                             "vectors": [vectors.tobytes()], "bits": [bits.tobytes()], "scalar": [scalar.tobytes()]})

    for batch in batches:
        for row in zip(batch["vec_id"], batch["own"], batch["vector"], batch["null_id"], strict=True):
            rows = held.setdefault(len(row[2]), [])
            rows.append(row)
            if len(rows) == BLOCK:
                yield block(len(row[2]), rows)
                rows.clear()
    for dim, rows in held.items():
        if rows:
            yield block(dim, rows)


BLOCK_SCHEMA = "dim int, ids binary, null_ids binary, own binary, vectors binary, bits binary, scalar binary"


def nearest_in_block(queries: np.ndarray, own: np.ndarray, block: dict, wanted: int) -> list[tuple[int, int, float]]:
    """(query, vector, cosine) of the nearest vectors of one block for each query; vectors are numbered."""
    vectors, norms = block["vectors"], np.linalg.norm(block["vectors"], axis=1)
    query_norms = np.linalg.norm(queries, axis=1)
    near, bound = estimate(queries / query_norms[:, None], block["bits"], block["scalar"])
    out = []
    for q in range(len(queries)):
        others = np.flatnonzero(block["own"] != own[q])
        if not len(others):
            continue
        exact = lambda rows: (vectors[rows] * queries[q]).sum(axis=1) / (norms[rows] * query_norms[q])  # noqa: E731, B023
        first = others if len(others) <= 4 * wanted else others[np.argpartition(-near[q, others], 4 * wanted)[:4 * wanted]]
        floor = np.sort(exact(first))[-min(wanted, len(first))]
        rows = others[near[q, others] + bound[others] >= floor - 1e-6]
        rows = np.union1d(rows, first)
        score = exact(rows)
        order = np.lexsort((block["ids"][rows], block["null_ids"][rows], -score))[:wanted]
        out += [(q, int(rows[i]), float(score[i])) for i in order]
    return out


def _meet(batches: Iterator[pd.DataFrame], wanted: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            dim = row.dim
            block = {"ids": np.frombuffer(row.ids, np.int64), "null_ids": np.frombuffer(row.null_ids, bool),
                     "own": np.frombuffer(row.own, np.int64), "scalar": np.frombuffer(row.scalar),
                     "vectors": np.frombuffer(row.vectors).reshape(-1, dim),
                     "bits": np.frombuffer(row.bits, np.uint8).reshape(-1, (dim + 7) // 8)}
            queries = np.frombuffer(row.q_vectors).reshape(-1, dim)
            own, ids = np.frombuffer(row.q_own, np.int64), np.frombuffer(row.q_ids, np.int64)
            found = nearest_in_block(queries, own, block, wanted)
            yield pd.DataFrame({
                "query": [own[q] for q, _, _ in found], "query_id": [ids[q] for q, _, _ in found],
                "vec_id": pd.array([None if block["null_ids"][v] else block["ids"][v] for _, v, _ in found], "Int64"),
                "score": [s for *_, s in found]})


def search(vectors: DataFrame, is_query, wanted: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query row.

    ``is_query`` is a condition on ``vec_id``.  Each query block is paired with each vector block of
    its dimension, the blocks being the unit of work; queries are part of the vectors.
    """
    keyed = common.with_row_key(vectors)
    good = keyed.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(
        F.coalesce("vec_id", F.lit(-1)).cast("long").alias("vec_id"), F.col("vec_id").isNull().alias("null_id"),
        F.xxhash64(*common.ROW_KEY).alias("own"), F.transform(
            "embedding", lambda x: x.cast("double")).alias("vector"))
    good = good.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
                      & F.exists("vector", lambda x: x != 0))
    # Whole blocks are wanted: rows are dealt to as many tasks as there are blocks.
    rows = common.written(good, "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query & ~F.col("null_id"))).first()
    blocks = common.written(rows.repartition(max(1, -(-n // BLOCK))).mapInPandas(_pack_blocks, BLOCK_SCHEMA), "blocks")
    parts = max(1, -(-n_queries // QUERY_BLOCK))
    query_blocks = rows.where(is_query & ~F.col("null_id")).repartition(parts).mapInPandas(_pack_blocks, BLOCK_SCHEMA).select(
        "dim", F.col("ids").alias("q_ids"), F.col("own").alias("q_own"), F.col("vectors").alias("q_vectors"))
    query_blocks = common.written(query_blocks, "queries")
    tasks = blocks.join(query_blocks, "dim").repartition(
        max(1, min(4096, -(-n // BLOCK) * parts)), F.xxhash64("ids", "q_ids"))
    found = tasks.mapInPandas(lambda batches: _meet(batches, wanted), "query long, query_id long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= wanted).select(
        "query_id", "rank", "vec_id", "score")
