"""Deterministic k-means with a fixed number of rounds, for at most 2048 centroids.

The centroids live on the driver, where their number is bounded; a round sends
them to the tasks, each of which returns a sum and a count per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_CENTROIDS
from .replay import shuffled_prefix

ROWS = 512  # vectors whose distances are held at once


def cells_of(vectors: np.ndarray, centroids: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) per vector, ties to the lowest.

    exact: integers, in int64. Else float32, summed dimension by dimension.
    """
    kind = np.int64 if exact else np.float32
    x, c = vectors.astype(kind), centroids.astype(kind)
    cells, dist = np.empty(len(x), np.int32), np.empty(len(x), kind)
    if exact:  # the distance but for the vector's own square comes out of one product, exact in doubles
        b = c.astype(np.float64)
        side = np.vstack([-2 * b.T, (b * b).sum(axis=1)])
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        if exact:
            a = np.hstack([part.astype(np.float64), np.ones((len(part), 1))])
            total = a @ side
        else:
            total = np.zeros((len(part), len(c)), np.float32)
            for d in range(x.shape[1]):
                delta = part[:, d, None] - c[None, :, d]
                total += delta * delta
        near = total.argmin(axis=1)
        cells[at : at + ROWS] = near
        least = total[np.arange(len(part)), near]
        dist[at : at + ROWS] = least + (part * part).sum(axis=1) if exact else least
    return cells, dist


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def assign(vectors: DataFrame, centroids: np.ndarray, column: str, exact: bool) -> DataFrame:
    """``vectors`` with cell_id and dist to the nearest centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    place, keep = vectors.columns.index(column), vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, dist = cells_of(_matrix(batch.column(place)), shared.value, exact) if batch.num_rows else (np.empty(0, np.int32), np.empty(0, np.int64 if exact else np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(dist)], names=[*keep, "cell_id", "dist"])

    fields = [f"`{name}` {kind}" for name, kind in vectors.dtypes]
    return vectors.mapInArrow(run, ", ".join([*fields, "cell_id int", "dist " + ("long" if exact else "float")]))


def _sums(vectors: DataFrame, centroids: np.ndarray, column: str, exact: bool) -> dict[int, tuple[list, int]]:
    """Per cell the sum and count of its vectors; a task sends a row per cell at most."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    kind = np.int64 if exact else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, count = np.zeros(c.shape, kind), np.zeros(len(c), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                cells, _ = cells_of(x, c, exact)
                np.add.at(total, cells, x.astype(kind))
                count += np.bincount(cells, minlength=len(c))
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cell_id": pa.array(full, pa.int32()), "total": pa.array(list(total[full]), pa.list_(pa.int64() if exact else pa.float64())), "n": count[full]})

    dims = centroids.shape[1]
    rows = vectors.select(column).mapInArrow(run, f"cell_id int, total array<{'long' if exact else 'double'}>, n long")
    sums = [F.sum(F.get("total", F.lit(d))).alias(f"s{d}") for d in range(dims)]
    return {r["cell_id"]: ([r[f"s{d}"] for d in range(dims)], r["n"]) for r in rows.groupBy("cell_id").agg(F.sum("n").alias("n"), *sums).collect()}


def truncated_mean(total: int, n: int) -> int:
    """Integer quotient towards zero."""
    return abs(total) // n * (1 if total >= 0 else -1)


def first_centroids(vectors: DataFrame, k: int, init: str, seed: int, id_col: str, column: str) -> tuple[np.ndarray, object]:
    """k vectors to begin with, and a function that gives a vector for an empty cell.

    init: ``lowest`` ids; ``hash``: lowest hash of the id (any size of input); or a
    replayed shuffle of the ids 0..n-1, ``chacha`` or ``splitmix64``.
    """
    if init in ("lowest", "hash"):
        order = F.col(id_col) if init == "lowest" else F.xxhash64(id_col, F.lit(seed))
        drawn = [r[column] for r in vectors.orderBy(order, id_col).limit(2 * k).select(column).collect()]
        return np.array(drawn[:k]), lambda cell: np.array(drawn[(k + cell) % len(drawn)])
    n, low, high = vectors.agg(F.count("*"), F.min(id_col), F.max(id_col)).first()
    if (low, high) != (0, n - 1):
        raise ValueError("a replayed shuffle needs ids 0..n-1")
    places, draw = shuffled_prefix(n, k, init, seed)
    found = {r[id_col]: r[column] for r in vectors.where(F.col(id_col).isin(places)).select(id_col, column).collect()}
    return np.array([found[p] for p in places]), lambda _: np.array(vectors.where(F.col(id_col) == draw(n)).select(column).first()[0])


def lloyd(vectors: DataFrame, k: int, rounds: int = 15, init: str = "hash", seed: int = 0x52494E48, id_col: str = "ref_id", column: str = "v", exact: bool = False) -> np.ndarray:
    """Centroids after ``rounds`` rounds. exact: integer vectors and means (towards zero), equal on any engine.

    ``vectors`` is read once per round: cache it.
    """
    k = min(k, MAX_CENTROIDS, vectors.count())
    if k <= 0:
        raise ValueError("no vectors")
    centroids, spare = first_centroids(vectors, k, init, seed, id_col, column)
    centroids = centroids.astype(np.int64 if exact else np.float32)
    for _ in range(rounds):
        sums = _sums(vectors, centroids, column, exact)
        for cell in range(k):
            total, n = sums.get(cell, (None, 0))
            if not n:
                centroids[cell] = spare(cell)
            elif exact:
                centroids[cell] = [truncated_mean(t, n) for t in total]
            else:
                centroids[cell] = (np.array(total, np.float64) / n).astype(np.float32)
    return centroids
