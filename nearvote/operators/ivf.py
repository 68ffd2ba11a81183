"""Inverted-file index of quantised vectors: four tables, built and searched with joins on cell_id.

centroids: cell_id, c (float centroid) and cq (quantised); cells: cell_id, start,
count, block_start, block_count and the box lo, hi of the cell's vectors;
blocks: cell_id, block, lo, hi per 128 vectors; vectors: cell_id, pos, block,
ref_id, q, label in the order of their distance to the centroid.

Centroids and cells number at most 2048, so they are broadcast whatever the size
of the input; vectors are only ever read by cell. A query's work is the cells it
probes: parts of cells meet groups of queries as packed rows, and each part hands
on five vectors a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.distance import as_columns, box_bound
from ..functions.quantise import quantise
from ..storage import materialise
from . import kmeans, knn
from .knn import nearest_in

FILE_ROWS = 1 << 20
TABLES = ("centroids", "cells", "blocks", "vectors")


@dataclass(frozen=True)
class Index:
    centroids: DataFrame
    cells: DataFrame
    blocks: DataFrame
    vectors: DataFrame
    dims: int = S.DIMS

    def write(self, path: str) -> None:
        for name in TABLES[:3]:  # small; coalesce() would do the work before it in one task too
            getattr(self, name).repartition(1).write.mode("overwrite").parquet(f"{path}/{name}")
        part = F.floor(F.col("pos") / FILE_ROWS)  # a large cell is written by several tasks
        rows = self.vectors.repartition("cell_id", part).sortWithinPartitions("cell_id", "pos")
        rows.write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str, check: bool = True) -> Index:
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        dims = len((tables["centroids"].select("cq").first() or [[]])[0])
        index = cls(**tables, dims=dims)
        if check:
            index.validate()
        return index

    def validate(self) -> None:
        """Raise ValueError unless the tables fit together."""
        problems = []
        if self.dims == 0:
            problems.append("there are no centroids")
        n = self.vectors.count()
        cells, covered, outside = self.cells.agg(F.count("*"), F.sum("count"), F.max(F.col("start") + F.col("count"))).first()
        if cells > S.MAX_CENTROIDS or cells != self.centroids.count():
            problems.append("cells and centroids differ or are too many")
        if (covered or 0) != n or (outside or 0) > n:
            problems.append("cells don't cover the vectors")
        sizes = self.vectors.groupBy("cell_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
        if self.cells.where("count > 0").join(sizes, "cell_id", "full").where("NOT (count <=> n) OR last <> n - 1").limit(1).count():
            problems.append("a cell's count or positions are wrong")
        if self.vectors.where(F.size("q") != self.dims).limit(1).count():
            problems.append(f"a vector hasn't {self.dims} components")
        if self.blocks.count() != (self.cells.agg(F.sum("block_count")).first()[0] or 0):
            problems.append("blocks are missing")
        if problems:
            raise ValueError("; ".join(problems))


def positions(assigned: DataFrame) -> DataFrame:
    """pos and block of each vector in its cell, by distance to the centroid, then ref_id."""
    by = Window.partitionBy("cell_id").orderBy("dist", "ref_id")
    placed = assigned.withColumn("pos", (F.row_number().over(by) - 1).cast("int"))
    return placed.withColumn("block", F.floor(F.col("pos") / S.BLOCK).cast("int"))


def boxes(vectors: DataFrame, by: list[str], dims: int) -> DataFrame:
    """Least and largest component per dimension and group."""
    edges = [f(F.get("q", F.lit(d))).alias(f"{name}{d}") for name, f in (("lo", F.min), ("hi", F.max)) for d in range(dims)]
    grouped = vectors.groupBy(*by).agg(F.count("*").cast("int").alias("count"), *edges)
    return grouped.select(*by, "count", *[F.array(*[f"{name}{d}" for d in range(dims)]).alias(name) for name in ("lo", "hi")])


def cell_table(vectors: DataFrame, k: int, dims: int) -> DataFrame:
    """A row per cell, empty ones too (their box is zero). The running sums are over at most 2048 rows."""
    spark = vectors.sparkSession
    zeros = F.array(*[F.lit(0).cast("smallint")] * dims)
    found = boxes(vectors, ["cell_id"], dims)
    every = spark.range(k).select(F.col("id").cast("int").alias("cell_id"))
    cells = every.join(found, "cell_id", "left").select("cell_id", F.coalesce("count", F.lit(0)).alias("count"), *[F.coalesce(F.col(c).cast("array<smallint>"), zeros).alias(c) for c in ("lo", "hi")])
    blocks = F.ceil(F.col("count") / S.BLOCK).cast("int")
    before = Window.orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    return cells.withColumn("block_count", blocks).select("cell_id", running("count").alias("start"), "count", running("block_count").alias("block_start"), "block_count", "lo", "hi")


def from_assignment(assigned: DataFrame, centroids: np.ndarray, exact: bool) -> Index:
    """assigned: ref_id, q, label, cell_id, dist; the centroids are float, or (exact) quantised already."""
    spark, dims = assigned.sparkSession, centroids.shape[1]
    vectors = positions(assigned).select("cell_id", "pos", "block", "ref_id", "q", "label")
    rows = [(n, [float(x) for x in c]) for n, c in enumerate(centroids.tolist())]
    table = spark.createDataFrame(rows, "cell_id int, c array<float>")
    cq = F.transform("c", (lambda x: x.cast("smallint")) if exact else quantise)
    return Index(table.withColumn("cq", cq), cell_table(vectors, len(rows), dims), boxes(vectors, ["cell_id", "block"], dims).drop("count"), vectors, dims)


def build(refs: DataFrame, k: int = S.MAX_CENTROIDS, rounds: int = 15, init: str = "hash", seed: int = 0x52494E48, exact: bool = False) -> Index:
    """refs: ref_id, label, q (quantised) and, unless exact, v (float). Assignment follows the last update of the centroids."""
    column = "q" if exact else "v"
    refs = refs.cache()
    centroids = kmeans.lloyd(refs, k, rounds, init, seed, column=column, exact=exact)
    return from_assignment(kmeans.assign(refs, centroids, column, exact).cache(), centroids, exact)


# Search


def probes(queries: DataFrame, centroids: DataFrame, count: int, dims: int = S.DIMS) -> DataFrame:
    """query_id, cell_id, probe_rank: the ``count`` nearest quantised centroids per query, ties to the lower cell.

    queries: query_id, q. The first 2048 centroids are used, which bounds what is broadcast.
    """
    few = centroids.where(F.col("cell_id") < S.MAX_CENTROIDS).orderBy("cell_id").select("cell_id", "cq").collect()
    table = np.array([r["cq"] for r in few], np.int64).reshape(len(few), dims)
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r["cell_id"] for r in few], np.int32), table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, places = shared.value
        for batch in batches:
            if batch.num_rows and len(cells):
                near, dist = nearest_in(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims), places, count)
                who = np.repeat(np.arange(batch.num_rows), near.shape[1])
                rank = np.tile(np.arange(1, near.shape[1] + 1, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(cells[near.ravel()]), pa.array(dist.ravel()), pa.array(rank)], names=["query_id", "cell_id", "cell_dist", "probe_rank"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "q").mapInArrow(run, f"query_id {kind}, cell_id int, cell_dist long, probe_rank int")


ORDER = ("dist", "probe_rank", "pos")


def _spread(array: str, name: str, dims: int) -> list[Column]:
    """An array's components as columns. Spread before a join, they keep the distance of its many rows in generated code."""
    return [c.alias(f"{name}{d}") for d, c in enumerate(as_columns(F.col(array), dims))]


def _columns(names: str, dims: int) -> list[list[Column]]:
    return [[F.col(f"{name}{d}") for d in range(dims)] for name in names]


@dataclass(frozen=True)
class Parts:
    """The vectors of an index packed by the leaves of a tree of cuts per cell: ``rows`` holds a row per leaf (a leaf of
    more than some ``4 * SEGMENT`` vectors has several), in order of pos. Per leaf, on the driver and bounded in number
    (``LEAVES`` and one a cell): its cell, how many vectors it has and their box."""

    rows: DataFrame
    leaf: np.ndarray
    cell: np.ndarray
    count: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def pack(index: Index) -> Parts:
    """The cuts are learned from a bounded sample by hash; every vector is dealt, packed and boxed."""
    vectors = index.vectors.where(F.col("cell_id").between(0, S.MAX_CENTROIDS - 1))
    n = vectors.count()
    leaves = max(1, min(knn.LEAVES, -(-n // knn.SEGMENT)))
    step = max(1, n // (leaves * knn.LEARNED))
    drawn = vectors.where(F.pmod(F.xxhash64("ref_id"), F.lit(step)) == 0).select("cell_id", "q").limit(2 * leaves * knn.LEARNED).toArrow()
    cells = drawn.column("cell_id").to_numpy().astype(np.int64)
    forest = knn.Forest(knn._matrix(drawn.column("q")).astype(np.int64) if len(cells) else np.zeros((0, index.dims), np.int64), cells, S.MAX_CENTROIDS, leaves)
    learned = np.bincount(forest.leaf_in(knn._matrix(drawn.column("q")), cells), minlength=len(forest.cell)) if len(cells) else np.zeros(len(forest.cell), np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((forest, np.maximum(1, -(-learned * step // (4 * knn.SEGMENT)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, cut_in = shared.value
        for batch in batches:
            if batch.num_rows:
                leaf = trees.leaf_in(knn._matrix(batch.column(4)), batch.column(0).to_numpy().astype(np.int64))
                part = batch.column(1).to_numpy() % cut_in[leaf]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part.astype(np.int32)), *batch.columns[1:]], names=["leaf", "part", "pos", "ref_id", "label", "q"])

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pos, q = table.column("pos").to_numpy(), knn._matrix(table.column("q"))
        order = np.argsort(pos, kind="stable")
        packed = [x[order].astype(kind).tobytes() for x, kind in ((pos, "<i4"), (table.column("ref_id").to_numpy(), "<i8"), (table.column("label").to_numpy(), "<i4"), (q, "<i4"))]
        return pa.table([[key[0].as_py()], [key[1].as_py()], [len(pos)], [q.min(axis=0).tolist()], [q.max(axis=0).tolist()], *[[x] for x in packed]], schema=pa.schema([
            ("leaf", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64())), *[(f"r_{c}", pa.binary()) for c in ("pos", "id", "label", "q")],
        ]))

    lean = vectors.select("cell_id", F.col("pos").cast("int"), F.col("ref_id").cast("long"), F.col("label").cast("int"), "q")
    dealt = lean.mapInArrow(deal, f"leaf int, part int, pos int, ref_id long, label int, q {dict(vectors.dtypes)['q']}")
    rows = dealt.groupBy("leaf", "part").applyInArrow(gather, "leaf int, part int, n long, lo array<long>, hi array<long>, r_pos binary, r_id binary, r_label binary, r_q binary")
    rows = materialise(rows, "parts")
    edges = [f(F.get(name, F.lit(d))).alias(f"{name}{d}") for name, f in (("lo", F.min), ("hi", F.max)) for d in range(index.dims)]
    boxed = rows.groupBy("leaf").agg(F.sum("n").alias("n"), *edges).orderBy("leaf").collect()
    leaf = np.array([r["leaf"] for r in boxed], np.int64)
    lo, hi = (np.array([[r[f"{name}{d}"] for d in range(index.dims)] for r in boxed], np.float64).reshape(len(boxed), index.dims) for name in ("lo", "hi"))
    return Parts(rows, leaf, forest.cell[leaf], np.array([r["n"] for r in boxed], np.int64), lo, hi)


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least squared distance of each query to each box."""
    bound = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        gap = np.clip(q[:, d, None], lo[:, d], hi[:, d]) - q[:, d, None]
        bound += gap * gap
    return bound


@dataclass(frozen=True)
class Reader:
    """Says which leaves a query reads, in a task: those of the cells in its turn whose box is as near as its limit.

    turn: ``inner`` (the ``nprobe`` nearest cells), ``outer`` (those up to ``repair_probe``) or ``more`` (up to
    ``repair_candidates`` cells not read yet, by the bound of their boxes).
    """

    options: S.SearchOptions
    turn: str
    cells: np.ndarray
    places: np.ndarray  # of the centroids
    leaf: np.ndarray
    at: np.ndarray  # of a leaf's cell in ``cells``, -1: not there
    count: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    HELD = 1 << 18  # bounds held at once

    def ranks(self, q: np.ndarray, widened: np.ndarray) -> np.ndarray:
        """Per query and cell the place of the cell among those that the query reads in this turn, 0: not read."""
        o, rank = self.options, np.zeros((len(q), len(self.cells)), np.int32)
        if not len(self.cells):
            return rank
        near = nearest_in(q, self.places, o.nprobe if self.turn == "inner" else o.repair_probe)[0]
        np.put_along_axis(rank, near, np.arange(1, near.shape[1] + 1, dtype=np.int32)[None].repeat(len(q), 0), axis=1)
        if self.turn == "inner":
            return rank
        if self.turn == "outer":
            return np.where(rank > o.nprobe, rank, 0)
        inside = self._inside()
        full = np.array([c for c, _ in inside], np.int64)
        lo, hi = (np.array([f(edge[leaves], axis=0) for _, leaves in inside]).reshape(len(full), -1) for f, edge in ((np.min, self.lo), (np.max, self.hi)))
        done = (rank[:, full] > 0) & ((rank[:, full] <= o.nprobe) | widened[:, None])
        bound = np.where(done, np.inf, _bounds(q, lo, hi))
        best = np.argsort(bound, axis=1, kind="stable")[:, : o.repair_candidates]
        rank[:] = 0
        place = np.where(np.isfinite(np.take_along_axis(bound, best, axis=1)), np.arange(S.MAX_PROBES + 1, S.MAX_PROBES + 1 + best.shape[1], dtype=np.int32), 0)
        rank[np.arange(len(q))[:, None], full[best]] = place
        return rank

    def _inside(self) -> list[tuple[int, np.ndarray]]:
        """(cell, its leaves) for the cells that have leaves, both by their places."""
        order = np.argsort(self.at, kind="stable")
        cells, start = np.unique(self.at[order], return_index=True)
        return [(c, leaves) for c, leaves in zip(cells.tolist(), np.split(order, start[1:]), strict=False) if c >= 0]

    def _steps(self, q: np.ndarray, widened: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, their ranks of a cell, the cell's leaves, bounds of the leaves), cell by cell, for those that read it."""
        q = q.astype(np.float64)
        step = max(1, 8 * self.HELD // max(1, len(self.cells)))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            rank = np.ascontiguousarray(self.ranks(part, widened[at : at + step]).T)
            for c, leaves in self._inside():
                every = np.flatnonzero(rank[c])
                most = max(1, self.HELD // len(leaves))
                for who in (every[n : n + most] for n in range(0, len(every), most)):
                    yield who + at, rank[c, who], leaves, _bounds(part[who], self.lo[leaves], self.hi[leaves])

    def home(self, q: np.ndarray, widened: np.ndarray) -> np.ndarray:
        """A leaf per query where to begin: the nearest that holds five vectors and is read; -1 if there is none."""
        found, least = np.full(len(q), -1, np.int32), np.full(len(q), np.inf)
        for who, rank, leaves, bound in self._steps(q, widened):
            bound = np.where(self.count[leaves] >= S.K, bound + rank[:, None] / 4096, np.inf)
            best = bound.argmin(axis=1)
            value = np.take_along_axis(bound, best[:, None], axis=1)[:, 0]
            less = value < least[who]
            least[who[less]], found[who[less]] = value[less], self.leaf[leaves[best[less]]]
        return found

    def near(self, q: np.ndarray, limit: np.ndarray, widened: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, queries that read it, their ranks of its cell)."""
        pairs = []
        for asked, rank, leaves, bound in self._steps(q, widened):
            who, place = np.nonzero(bound <= limit[asked, None])
            pairs.append((asked[who], leaves[place], rank[who]))
        if not pairs:
            return
        who, place, rank = (np.concatenate(c) for c in zip(*pairs, strict=True))
        order = np.argsort(place, kind="stable")
        names, start = np.unique(place[order], return_index=True)
        for name, part in zip(names.tolist(), np.split(order, start[1:]), strict=False):
            yield int(self.leaf[name]), who[part], rank[part]


ASKED = "leaf int, first long, q_id binary, q_q binary, q_limit binary, q_rank binary"
FOUND = "query_id long, probe_rank int, pos int, ref_id long, label int, dist long"


def _readers(reader: Reader, ids: np.ndarray, q: np.ndarray, limit: np.ndarray, widened: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = [(leaf, int(ids[who[0]]), *[x.tobytes() for x in (ids[who], q[who], limit[who], rank.astype("<i4"))]) for leaf, who, rank in reader.near(q, limit, widened)]
    if rows:
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[field.split()[0] for field in ASKED.split(", ")])


def _reader(index: Index, parts: Parts, options: S.SearchOptions, turn: str) -> Reader:
    few = index.centroids.where(F.col("cell_id") < S.MAX_CENTROIDS).orderBy("cell_id").select("cell_id", "cq").collect()
    cells, places = np.array([r["cell_id"] for r in few], np.int64), np.array([r["cq"] for r in few], np.int64).reshape(len(few), index.dims)
    where = np.full(S.MAX_CENTROIDS, -1)
    where[cells] = np.arange(len(cells))
    return Reader(options, turn, cells, places, parts.leaf, where[parts.cell], parts.count, parts.lo, parts.hi)


def _candidates(queries: DataFrame, index: Index, parts: Parts, options: S.SearchOptions, turn: str, prune: bool = True, order: tuple[str, ...] = ORDER) -> DataFrame:
    """The five nearest vectors of every packed part that each query reads in this turn.

    queries: query_id, q and, after the first turn, limit (the distance of the fifth vector found, null if there are
    fewer) and widened. In the first turn a query's limit comes from the leaf where it begins. A part is read unless its
    box is farther than the limit: what is left out can't be among the five, ties included. No row is made per query
    and vector; queries meet a part in groups of some ``MEET``.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(_reader(index, parts, options, turn))
    first = "limit" not in queries.columns
    lean = queries.select(F.col("query_id").cast("long"), "q", *([] if first else [F.coalesce(F.col("limit").cast("double"), F.lit(float("inf"))), "widened"]))
    groups = F.lit(max(1, queries.count() // knn.MEET))
    joined = lambda batch, at: (b"".join(x) for x in batch.column(at).to_pylist())

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                limit = batch.column(2).to_numpy() if not first else np.full(batch.num_rows, np.inf)
                widened = batch.column(3).to_numpy(zero_copy_only=False) if not first else np.zeros(batch.num_rows, bool)
                yield from _readers(shared.value, batch.column(0).to_numpy().astype("<i8"), knn._matrix(batch.column(1)).astype("<i4"), limit.astype("<f8"), widened)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, q = batch.column(0).to_numpy(), knn._matrix(batch.column(1)).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.home(q, np.zeros(len(q), bool))), pa.array(ids), pa.array([x.tobytes() for x in q], pa.binary())], names=["leaf", "query_id", "q"])

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (ids, body) in enumerate(zip(batch.column(0).to_pylist(), joined(batch, 1), strict=True)):
                q, known = np.frombuffer(body, "<i4").reshape(len(ids), -1), batch.column(2)[i]
                limit = np.full(len(ids), np.inf)
                if known.is_valid:
                    dist = nearest_in(q, np.frombuffer(known.as_buffer(), "<i4").reshape(-1, q.shape[1]), S.K)[1]
                    limit = dist[:, -1].astype("<f8") if dist.shape[1] == S.K else limit
                yield from _readers(shared.value, np.array(ids, "<i8"), q, limit, np.zeros(len(ids), bool))

    if first and prune:
        home = lean.mapInArrow(begin, "leaf int, query_id long, q binary")
        home = home.repartition(spark.sparkContext.defaultParallelism, "leaf")  # few bytes, much work: tasks aren't to be coalesced
        home = home.groupBy("leaf", F.pmod(F.xxhash64("query_id"), groups).alias("group")).agg(F.collect_list("query_id").alias("ids"), F.collect_list("q").alias("q"))
        known = parts.rows.where("part = 0").select("leaf", "r_q")
        asked = home.join(known, "leaf", "left").select("ids", "q", "r_q").mapInArrow(limits, ASKED)
    else:
        asked = lean.mapInArrow(later, ASKED)
    asked = asked.groupBy("leaf", F.pmod(F.xxhash64("first"), groups).alias("group")).agg(*[F.collect_list(f"q_{c}").alias(f"q_{c}") for c in ("id", "q", "limit", "rank")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pos, ref_id, label, y = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in enumerate(("<i4", "<i8", "<i4", "<i4")))
                ids, x, limit, rank = (np.frombuffer(b"".join(batch.column(c)[i].as_py()), kind) for c, kind in zip(range(4, 8), ("<i8", "<i4", "<f8", "<i4"), strict=True))
                y = y.reshape(len(pos), -1)
                if order != ORDER:
                    by_id = np.argsort(ref_id, kind="stable")
                    pos, ref_id, label, y = pos[by_id], ref_id[by_id], label[by_id], y[by_id]
                place, dist = nearest_in(x.reshape(len(ids), -1), y, S.K)
                who, n = np.nonzero(dist <= limit[:, None])
                at = place[who, n]
                yield pa.RecordBatch.from_pydict({"query_id": ids[who], "probe_rank": rank[who], "pos": pos[at], "ref_id": ref_id[at], "label": label[at], "dist": dist[who, n]})

    return parts.rows.join(asked, "leaf").select("r_pos", "r_id", "r_label", "r_q", "q_id", "q_q", "q_limit", "q_rank").mapInArrow(run, FOUND)


def _nearest(candidates: DataFrame, k: int = S.K, order: tuple[str, ...] = ORDER) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(*order)
    return candidates.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _counted(queries: DataFrame, nearest: DataFrame, name: str = "fraud") -> DataFrame:
    """Every query with its frauds; 0 if no vector was found."""
    votes = nearest.groupBy("query_id").agg(F.sum("label").cast("int").alias(name))
    return queries.join(votes, "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def search_fixed(index: Index, queries: DataFrame, nprobe: int, prune: bool = True, parts: Parts | None = None) -> DataFrame:
    """query_id, rank, ref_id, dist, label of the five nearest vectors in the probed cells.

    prune: parts of the cells are skipped by their boxes; the rows are the same.
    """
    options = S.SearchOptions(nprobe, nprobe)
    found = _candidates(queries, index, parts or pack(index), options, "inner", prune)
    return _nearest(found).select("query_id", "rank", "ref_id", "dist", "label")


def search_exact(index: Index, queries: DataFrame, parts: Parts | None = None) -> DataFrame:
    """The same of all vectors, ties to the smaller ref_id: every part of every cell is read unless its box is too far."""
    options = S.SearchOptions(S.MAX_CENTROIDS, S.MAX_CENTROIDS)
    found = _candidates(queries, index, parts or pack(index), options, "inner", order=("dist", "ref_id"))
    return _nearest(found, order=("dist", "ref_id")).select("query_id", "rank", "ref_id", "dist", "label")


def search(index: Index, queries: DataFrame, options: S.SearchOptions = S.SearchOptions()) -> DataFrame:
    """query_id, fraud: the vote of the five nearest, with wider probing where it is ambiguous."""
    o, parts = options.within(index.centroids.count()), pack(index)
    best = materialise(_nearest(_candidates(queries, index, parts, o, "inner")).drop("rank"), "narrow")
    ambiguous = lambda c: F.col(c).between(o.repair_min, o.repair_max)
    votes = _counted(queries.select("query_id"), best)
    if o.repair_probe == o.nprobe and not o.repair_candidates:
        return votes
    widened = F.lit(False)
    # The ambiguous ones alone read more; what they have found is kept, and limits what they read.
    for turn, name in (("outer", "wide"), ("more", "again")):
        if turn == "outer" and o.repair_probe == o.nprobe or turn == "more" and not o.repair_candidates:
            continue
        fifth = best.groupBy("query_id").agg(F.when(F.count("*") == S.K, F.max("dist")).alias("limit"))
        unsure = votes.where(ambiguous("fraud")).select("query_id", widened.alias("widened"))
        asked = queries.select("query_id", "q").join(unsure, "query_id").join(fifth, "query_id", "left")
        more = _candidates(asked, index, parts, o, turn)
        best = _nearest(best.join(unsure, "query_id", "left_semi").unionByName(more)).drop("rank")
        best = materialise(best, name) if turn == "outer" and o.repair_candidates else best
        again = best.groupBy("query_id").agg(F.sum("label").cast("int").alias("again"))
        votes = votes.withColumnRenamed("fraud", "before").join(again, "query_id", "left").select("query_id", F.coalesce("again", "before").alias("fraud"))
        votes = materialise(votes, "votes") if turn == "outer" and o.repair_candidates else votes
        widened = F.lit(True)  # in the next turn
    return votes


def repair_cells(queries: DataFrame, index: Index, scanned: DataFrame, count: int, offset: int = 0) -> DataFrame:
    """query_id, cell_id, probe_rank of up to ``count`` cells not scanned yet, by (bound of the box, cell)."""
    n = index.dims
    cells = index.cells.where((F.col("cell_id") < S.MAX_CENTROIDS) & (F.col("count") > 0)).select("cell_id", *_spread("lo", "l", n), *_spread("hi", "h", n))
    bound = box_bound(*_columns("alh", n))
    pairs = queries.select("query_id", *_spread("q", "a", n)).crossJoin(F.broadcast(cells)).select("query_id", "cell_id", bound.alias("bound"))
    left = pairs.join(scanned.select("query_id", "cell_id"), ["query_id", "cell_id"], "left_anti")
    by = Window.partitionBy("query_id").orderBy("bound", "cell_id")
    ranked = left.withColumn("r", F.row_number().over(by)).where(F.col("r") <= count)
    return ranked.select("query_id", "cell_id", (F.col("r") + offset).cast("int").alias("probe_rank"))


def rerank(nearest: DataFrame, queries: DataFrame) -> DataFrame:
    """The five nearest in order of their distance in float32; the set, and so the vote, is the same."""
    from ..functions.distance import squared_l2_float
    from ..functions.quantise import dequantise

    value = lambda c: F.transform(c, dequantise)
    joined = nearest.join(queries.select("query_id", F.col("q").alias("asked")), "query_id")
    real = squared_l2_float(value(F.col("asked")), value(F.col("q")))
    by = Window.partitionBy("query_id").orderBy("real", "rank")
    return joined.withColumn("real", real).withColumn("new_rank", F.row_number().over(by)).drop("asked")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours (query_id, ref_id) that were found."""
    hit = truth.join(found.select("query_id", "ref_id").withColumn("hit", F.lit(1)), ["query_id", "ref_id"], "left")
    return hit.agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("wanted"))
