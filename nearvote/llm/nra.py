"""Exact top-k by inner product with no-random-access aggregation.

The vectors are cut into segments. In a segment, every dimension is a list
sorted by value; a query reads it from the top where its own component is
positive and from the bottom where it is negative, all lists in step. A vector
is known by the entries read so far: its lower bound takes the list's far end for
a component not yet read, its upper bound the value last read. A vector that no
list has shown yet has the threshold as upper bound, the sum of the values last
read. Vectors whose upper bound is below the k-th largest lower bound can't
qualify. A query stops reading once no more than the wanted vectors are left and
the threshold is below them; the scores of those left are then resolved. Where
the data allow no stop, the lists are read to their end, where both bounds are
the score. ``STEP`` is the factor between the depths at which bounds are compared.

The bounds of a block of queries for the vectors seen are products of matrices
that hold the entries read, and the last value read in place of the others.
Arithmetic is exact: float32 or float64 where no sum can pass 2**24 or 2**53,
else 64-bit or unbounded integers.

Scale: work is queries x vectors, as asked; it is cut into tasks of one segment
and one block of queries, each a single packed row, so no task grows with the
input. Every segment returns k vectors per query; a windowed top-k, which
Spark prunes before the shuffle, merges them.

Defined results: vectors that are null, or hold null or non-finite components,
and rows without vec_id take no part. Every row is a candidate, also one that
repeats a vec_id; rows with the query's own vec_id are not. Rows that repeat a
query's vec_id are queries that share a result. Vectors of another length than a
query's are no candidates of it. Ties go to the smaller vec_id. Quantised
components and scores beyond 64 bits are cut to the largest or smallest long. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, QUERIES = 8192, 1024
#: Factor between the depths at which bounds are compared, and how often it is applied.
STEP, STEPS = 4, 3
LONG = (1 << 63) - 1


def _kind(bound: int) -> type:
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound <= LONG else object


def search(queries: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, list[int], int]]:
    """Per query: (its place, vec_ids, scores, depth read) of the k best of distinct ``vectors``; ids[i]: ascending ids of vectors[i]."""
    n, dims = vectors.shape
    largest = [max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in (queries, vectors)]
    kind = _kind(largest[0] * largest[1] * max(1, dims))
    q, x = queries.astype(kind), vectors.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    weight = np.minimum([len(i) for i in ids], k)
    lists = np.argsort(x, axis=0, kind="stable")  # a column is a list, ascending
    columns = np.arange(dims)
    far_top, far_bottom = (x[lists[0], columns], x[lists[-1], columns]) if n else (x[:0], x[:0])
    high, low = np.zeros((n, dims), bool), np.zeros((n, dims), bool)  # entries read from the top, from the bottom
    alive, live, read = np.ones((len(q), n), bool), np.arange(len(q)), 0
    left: dict[int, tuple[np.ndarray, np.ndarray | None, int]] = {}
    for depth in [*(max(min(n, k), n // STEP**i) for i in range(STEPS, 0, -1)), n]:
        if depth <= read and read or not len(live):
            continue
        for rows, mask in ((lists[n - depth : n - read], high), (lists[read:depth], low)):
            mask[rows, columns] = True
        read = depth
        seen = np.flatnonzero(alive[live].any(axis=0) & (high | low).any(axis=1)) if dims else np.arange(n)
        if depth == n:  # both bounds are the score
            score = q[live] @ x[seen].T
            for row, i in enumerate(live.tolist()):
                own = alive[i, seen]
                left[i] = seen[own], score[row, own], depth
            break
        top, bottom = (x[lists[n - depth], columns], x[lists[depth - 1], columns])
        part, h, w = x[seen], high[seen], low[seen]
        upper = up[live] @ np.where(h, part, top).T
        upper += down[live] @ np.where(w, part, bottom).T
        lower = up[live] @ np.where(h, part, far_top).T
        lower += down[live] @ np.where(w, part, far_bottom).T
        threshold = up[live] @ top + down[live] @ bottom
        if len(seen) < k:
            continue
        lower[~alive[live][:, seen]] = lower.min()
        kth = np.partition(lower, len(seen) - k, axis=1)[:, len(seen) - k]  # of distinct vectors: at most the true one
        hidden = np.ones(n, bool)
        hidden[seen] = False
        keep = np.zeros((len(live), n), bool)
        keep[:, seen] = upper >= kth[:, None]
        keep[:, hidden] = (threshold >= kth)[:, None]
        alive[live] &= keep
        done = (alive[live] @ weight) <= k
        for i in live[done].tolist():
            left[i] = np.flatnonzero(alive[i]), None, depth
        live = live[~done]
    for i, (own, score, depth) in left.items():
        score = x[own] @ q[i] if score is None else score
        if len(own) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            own, score = own[score >= cut], score[score >= cut]
        names = [ids[j][:k] for j in own]
        flat = np.concatenate(names) if names else np.zeros(0, np.int64)
        value = np.repeat(score, [len(a) for a in names])
        order = np.lexsort((flat, -value))[:k] if kind is not object else sorted(range(len(flat)), key=lambda j: (-value[j], flat[j]))[:k]
        yield i, flat[order], [max(-LONG - 1, min(LONG, int(v))) for v in value[order]], depth


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    q = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))  # cut to a long
    return vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("v"))


def _packed(vectors: DataFrame, label: str, size: int, count: int) -> DataFrame:
    """One row per about ``size`` vectors of a length: dim, ids and components as bytes, four each where all fit."""
    groups = max(1, -(-count // size))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy()
        order = np.argsort(ids)
        body = flat.reshape(len(ids), key[1].as_py())[order]
        small = body.size == 0 or max(-int(body.min()) - 1, int(body.max())) < 1 << 31
        body = body.astype("<i4" if small else "<i8").tobytes()
        return pa.Table.from_pydict({f"{label}_part": [key[0].as_py()], "dim": [key[1].as_py()], f"{label}_ids": [ids[order].astype("<i8").tobytes()], f"{label}_v": [body]}, schema=pa.schema([(f"{label}_part", pa.int32()), ("dim", pa.int32()), (f"{label}_ids", pa.binary()), (f"{label}_v", pa.binary())]))

    keyed = vectors.select(part.alias("part"), F.size("v").alias("dim"), "vec_id", "v")
    return keyed.groupBy("part", "dim").applyInArrow(run, f"{label}_part int, dim int, {label}_ids binary, {label}_v binary")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", segment: int = SEGMENT, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each vector whose id is divisible by ``every``."""
    whole = quantised(vectors, id_col, vector_col, scale)
    asked = whole.where(F.col("vec_id") % every == 0)
    n, nq = whole.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    segments, blocks = max(1, -(-n // segment)), max(1, -(-nq // block))
    every_of = lambda t, name, count: t.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    left = every_of(_packed(whole, "c", segment, n), "q_part", blocks)
    right = every_of(_packed(asked, "q", block, nq), "c_part", segments)

    def components(body: bytes, count: int, dim: int) -> np.ndarray:
        return np.frombuffer(body, "<i4" if len(body) == 4 * count * dim else "<i8").reshape(count, dim).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, names = np.frombuffer(row["c_ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                dim = row["dim"]
                x, q = components(row["c_v"], len(ids), dim), components(row["q_v"], len(names), dim)
                distinct, inverse = np.unique(x, axis=0, return_inverse=True) if dim else (x[:1], np.zeros(len(ids), np.int64))
                order = np.argsort(inverse.reshape(-1), kind="stable")
                held = np.split(ids[order], np.cumsum(np.bincount(inverse.reshape(-1)))[:-1])
                own = int(np.unique(ids, return_counts=True)[1].max())  # at most so many rows have the query's vec_id
                out: list[list] = [[], [], []]
                for i, found, score, _ in search(q, distinct, held, k + own):
                    kept = [(f, s) for f, s in zip(found.tolist(), score, strict=True) if f != names[i]][:k]
                    for column, values in zip(out, ([int(names[i])] * len(kept), *map(list, zip(*kept, strict=True))), strict=False):
                        column.extend(values)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    best = left.join(right, ["c_part", "q_part", "dim"]).mapInArrow(run, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
