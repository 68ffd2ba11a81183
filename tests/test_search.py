"""Index and search against a plain model, on vectors with many ties."""

from __future__ import annotations

import dataclasses
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.operators import decide, ivf, kmeans, knn, metrics, replay


def _frames(spark, refs, labels, asked):
    known = spark.createDataFrame([(i, int(n), q.tolist()) for i, (q, n) in enumerate(zip(refs, labels, strict=True))], "ref_id long, label int, q array<smallint>")
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id long, q array<smallint>")
    return known, queries


def _model(refs, labels, centroids, asked, options):
    """Step by step, one query at a time."""
    d = lambda a, b: int(((a.astype(np.int64) - b) ** 2).sum())
    cells = [[] for _ in centroids]
    for i, r in enumerate(refs):
        near = [d(r, c) for c in centroids]
        cells[int(np.argmin(near))].append((min(near), i))
    cells = [[i for _, i in sorted(c)] for c in cells]
    box = [(refs[c].min(axis=0), refs[c].max(axis=0)) if c else None for c in cells]
    o, out = options.within(len(centroids)), []
    for q in asked:
        order = sorted(range(len(centroids)), key=lambda c: (d(q, centroids[c]), c))
        def vote(read):
            found = sorted((d(q, refs[i]), n, pos, i) for n, c in enumerate(read) for pos, i in enumerate(cells[c]))[: S.K]
            return sum(labels[i] for *_, i in found)
        read = order[: o.nprobe]
        fraud = vote(read)
        unsure = lambda f: o.repair_min <= f <= o.repair_max
        if unsure(fraud) and o.repair_probe > o.nprobe:
            read = order[: o.repair_probe]
            fraud = vote(read)
        if unsure(fraud) and o.repair_candidates:
            bound = lambda c: int((np.maximum(np.maximum(box[c][0].astype(np.int64) - q, q - box[c][1].astype(np.int64)), 0) ** 2).sum())
            rest = sorted((c for c in range(len(cells)) if cells[c] and c not in read), key=lambda c: (bound(c), c))
            fraud = vote(read + rest[: o.repair_candidates])
        out.append(fraud)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("options", [S.SearchOptions(1, 3, 0, 1, 4), S.SearchOptions(2, 2, 2, 1, 4), S.SearchOptions(1, 2, 3, 2, 3), S.SearchOptions(40, 40, 0, 0, 5)])
def test_search_equals_model(spark, seed, options):
    rng = np.random.default_rng(seed)
    refs, asked = rng.integers(-2, 3, (150, 3)), rng.integers(-2, 3, (25, 3))
    labels = rng.integers(0, 2, 150)
    known, queries = _frames(spark, refs, labels, asked)
    centroids = refs[rng.choice(150, 8, replace=False)]
    index = ivf.from_assignment(kmeans.assign(known, centroids, "q", exact=True), centroids, exact=True)
    got = {r.query_id: r.fraud for r in ivf.search(index, queries, options).collect()}
    assert [got[i] for i in range(len(asked))] == _model(refs, labels, centroids, asked, options)


def test_all_cells_probed_is_exact(spark):
    rng = np.random.default_rng(9)
    refs, asked = rng.integers(-500, 500, (400, 14)), rng.integers(-500, 500, (20, 14))
    known, queries = _frames(spark, refs, rng.integers(0, 2, 400), asked)
    centroids = refs[:16]
    index = ivf.from_assignment(kmeans.assign(known, centroids, "q", exact=True), centroids, exact=True)
    full = {(r.query_id, r.ref_id): r.dist for r in ivf.search_fixed(index, queries, 16).collect()}
    exact = knn.exact_top_k(queries.withColumnRenamed("query_id", "id"), known.withColumnRenamed("ref_id", "id"), 5)
    assert {(r.query_id, r.ref_id): r.dist for r in exact.collect()} == full
    pruned = {(r.query_id, r.ref_id): r.dist for r in ivf.search_fixed(index, queries, 16, prune=True).collect()}
    assert pruned == full
    narrow, wide = (ivf.probes(queries, index.centroids, n) for n in (3, 9))
    assert {tuple(r) for r in narrow.collect()} <= {tuple(r) for r in wide.collect()}


def test_segments_and_blocks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(11)
    known, queries = _frames(spark, rng.integers(-3, 3, (200, 4)), rng.integers(0, 2, 200), rng.integers(-3, 3, (30, 4)))
    args = queries.withColumnRenamed("query_id", "id"), known.withColumnRenamed("ref_id", "id"), 5
    whole = sorted(map(tuple, knn.exact_top_k(*args).collect()))
    monkeypatch.setattr(knn, "SEGMENT", 17)
    monkeypatch.setattr(knn, "BLOCK", 7)
    assert sorted(map(tuple, knn.exact_top_k(*args).collect())) == whole


def test_exact_search_reads_near_leaves_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.integers(-9000, 9000, (30, 6))
    refs = np.repeat(centre, 40, axis=0) + rng.integers(-2, 3, (1200, 6))
    asked = centre[:10] + rng.integers(-2, 3, (10, 6))
    known, queries = _frames(spark, refs, rng.integers(0, 2, 1200), asked)
    monkeypatch.setattr(knn, "SEGMENT", 40)
    got = knn.exact_top_k(queries.withColumnRenamed("query_id", "id"), known.withColumnRenamed("ref_id", "id"), 5).collect()
    dist = ((asked[:, None] - refs[None]) ** 2).sum(axis=2)
    want = {(i, n + 1, int(j), int(dist[i, j])) for i in range(10) for n, j in enumerate(np.lexsort((np.arange(1200), dist[i]))[:5])}
    assert {(r.query_id, r["rank"], r.ref_id, r.dist) for r in got} == want
    cuts = knn.Cuts(refs.astype(np.int64), 30)
    assert len(set(cuts.leaf(refs).tolist())) == 30 and np.bincount(cuts.leaf(refs)).max() < 200


def test_index_search_reads_near_parts_only(spark, monkeypatch):
    """One cell holds all: its parts are met by the queries they are near to, and nothing is lost, ties included."""
    rng = np.random.default_rng(6)
    centre = rng.integers(-9000, 9000, (30, 6))
    refs = np.repeat(centre, 40, axis=0) + rng.integers(-1, 2, (1200, 6))
    asked = centre[:10] + rng.integers(-1, 2, (10, 6))
    labels = rng.integers(0, 2, 1200)
    known, queries = _frames(spark, refs, labels, asked)
    monkeypatch.setattr(knn, "SEGMENT", 40)
    index = ivf.from_assignment(kmeans.assign(known, refs[:2], "q", exact=True), refs[:2], exact=True)
    parts, options = ivf.pack(index), S.SearchOptions(2, 2)
    assert len(parts.leaf) >= 25 and parts.count.sum() == 1200
    reader = ivf._reader(index, parts, options, "inner")
    limit = np.sort(((asked[:, None] - refs[None]) ** 2).sum(axis=2), axis=1)[:, 4].astype(np.float64)
    assert sum(len(who) for _, who, _ in reader.near(asked, limit, np.zeros(10, bool))) < 40
    got, plain = ({tuple(r) for r in ivf.search_fixed(index, queries, 2, prune).collect()} for prune in (True, False))
    assert got == plain and len(got) == 50
    exact = knn.exact_top_k(queries.withColumnRenamed("query_id", "id"), known.withColumnRenamed("ref_id", "id"), 5)
    assert {tuple(r) for r in ivf.search_exact(index, queries, parts).collect()} == {tuple(r) for r in exact.collect()}  # ties to the smaller ref_id
    votes = {r.query_id: r.fraud for r in ivf.search(index, queries, S.SearchOptions(1, 2, 1, 0, 5)).collect()}
    assert [votes[i] for i in range(10)] == _model(refs, labels, refs[:2], asked, S.SearchOptions(1, 2, 1, 0, 5))


def test_bounds_are_taken_of_leaves_in_cells_that_are_read(monkeypatch):
    rng, held = np.random.default_rng(11), []
    places = rng.integers(0, 100, (64, 3))
    refs = rng.integers(0, 100, (256, 4, 3))  # four vectors span a leaf's box
    lo, hi, at = refs.min(axis=1).astype(float), refs.max(axis=1).astype(float), np.arange(256) % 64
    q, limit = rng.integers(0, 100, (40, 3)), rng.integers(0, 2000, 40).astype(float)
    bounds, plain = ivf._bounds, ivf._bounds(q.astype(float), lo, hi)
    monkeypatch.setattr(ivf, "_bounds", lambda *a: held.append(bounds(*a)) or held[-1])
    for turn, options, widened in (("inner", S.SearchOptions(3, 9), 3), ("outer", S.SearchOptions(3, 9), 6)):
        reader, held[:] = ivf.Reader(options, turn, np.arange(64), places, np.arange(256) + 7, at, np.full(256, 9), lo, hi), []
        rank = reader.ranks(q, np.zeros(40, bool))[:, at]
        want = {(n + 7, i, rank[i, n]) for i, n in zip(*np.nonzero((rank > 0) & (plain <= limit[:, None])), strict=True)}
        got = {(leaf, i, r) for leaf, who, ranks in reader.near(q, limit, np.zeros(40, bool)) for i, r in zip(who.tolist(), ranks, strict=True)}
        assert got == want and sum(b.size for b in held) == 40 * widened * 4
        least = np.where(rank > 0, plain + rank / 4096, np.inf)
        home = reader.home(q, np.zeros(40, bool)) - 7
        assert (least[np.arange(40), home] == least.min(axis=1)).all()


def test_index_is_written_by_the_tasks_that_make_it(spark, tmp_path):
    rng = np.random.default_rng(12)
    known, _ = _frames(spark, rng.integers(0, 100, (60, 3)).astype(np.int16), rng.integers(0, 2, 60), [])
    index = ivf.build(known, 4, 1, exact=True)

    def task(batches):
        from pyspark import TaskContext

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()] * batch.num_rows})

    dataclasses.replace(index, blocks=spark.range(0, 8, 1, 4).mapInArrow(task, "task long")).write(f"{tmp_path}/index")
    assert {r.task for r in spark.read.parquet(f"{tmp_path}/index/blocks").collect()} == {0, 1, 2, 3}


def test_exact_assignment_holds_one_matrix_of_distances():
    rng = np.random.default_rng(13)
    x, c = rng.integers(-32767, 32768, (kmeans.ROWS, 14)).astype(np.int16), rng.integers(-32767, 32768, (2048, 14))
    c[1000:1010], x[0] = c[7], c[7]  # ties go to the lowest
    tracemalloc.start()
    cells, dist = kmeans.cells_of(x, c, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = ((x[:64, None].astype(np.int64) - c) ** 2).sum(axis=2)
    assert (cells[:64] == plain.argmin(axis=1)).all() and (dist[:64] == plain.min(axis=1)).all() and cells[0] == 7
    assert peak < 1.5 * kmeans.ROWS * 2048 * 8


def test_build_write_load_validate(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = rng.random((300, S.DIMS)).astype(np.float32)
    refs = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "ref_id long, label int, v array<float>")
    from nearvote.functions.quantise import quantise_array

    refs = refs.withColumn("q", quantise_array(F.col("v")))
    index = ivf.build(refs, k=12, rounds=4)
    index.write(str(tmp_path / "i"))
    again = ivf.Index.load(spark, str(tmp_path / "i"))
    assert again.dims == S.DIMS and again.vectors.count() == 300
    inside = again.vectors.join(again.cells.select("cell_id", "lo", "hi"), "cell_id").where("exists(arrays_zip(q, lo, hi), x -> x.q < x.lo or x.q > x.hi)")
    assert inside.count() == 0
    again.vectors.where("cell_id > 0").write.partitionBy("cell_id").mode("overwrite").parquet(str(tmp_path / "broken"))
    broken = ivf.Index(again.centroids, again.cells, again.blocks, spark.read.parquet(str(tmp_path / "broken")))
    with pytest.raises(ValueError, match="cover"):
        broken.validate()


@pytest.mark.parametrize("init", ["lowest", "hash", "chacha", "splitmix64"])
def test_kmeans_is_deterministic_and_fills_empty_cells(spark, init):
    x = np.repeat(np.arange(4), 5)[:, None] * 100 + np.zeros((20, 2), int)
    refs = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(x)], "ref_id long, q array<smallint>").repartition(3)
    a, b = (kmeans.lloyd(refs, 6, 3, init, column="q", exact=True) for _ in range(2))
    assert (a == b).all() and a.shape == (6, 2)


def test_float_assignment_ties_go_to_the_lower_cell():
    cells, dist = kmeans.cells_of(np.array([[0.5, 0.0]]), np.array([[1.0, 0.0], [0.0, 0.0]]), exact=False)
    assert cells.tolist() == [0] and dist.tolist() == [0.25]


def test_generators():
    words = replay.SplitMix64(1234567)
    assert [words.next64() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]
    a = replay.ChaCha12(7)
    b = replay.ChaCha12(7)
    assert [a.next32() for _ in range(200)] == [b.next32() for _ in range(200)]
    order, _ = replay.shuffled_prefix(100, 100, "chacha", 1)
    assert sorted(order) == list(range(100)) and order != list(range(100))


def test_decisions(spark):
    rows = decide.decided(spark.range(8).select(F.col("id").cast("int").alias("fraud"))).orderBy("fraud").collect()
    assert [(r.approved, r.fraud_score) for r in rows] == [(True, 0.0), (True, 0.2), (True, 0.4), (False, 0.6), (False, 0.8), (False, 1.0), (True, 0.0), (True, 0.0)]


def test_fewer_than_five_vectors(spark):
    known, queries = _frames(spark, np.array([[0, 0], [9, 9]]), [1, 1], np.array([[1, 1]]))
    centroids = np.array([[0, 0]])
    index = ivf.from_assignment(kmeans.assign(known, centroids, "q", exact=True), centroids, exact=True)
    row = decide.decided(ivf.search(index, queries, S.SearchOptions())).first()
    assert (row.fraud, row.fraud_score, row.approved) == (2, 0.4, True)


def test_percentiles_against_sorting(spark):
    rng = np.random.default_rng(2)
    ns = rng.integers(0, 3_000_000, 500)
    rows = spark.createDataFrame([("a", int(x)) for x in ns], "stage string, ns long")
    got = metrics.percentiles(metrics.histogram(rows, ["stage"]), ["stage"]).first()
    b = np.sort(np.minimum(ns // 1000, 2047))
    assert (got.n, got.max_us) == (500, b[-1])
    assert [got.p50, got.p95, got.p99] == [b[-(-500 * p // 100) - 1] for p in (50, 95, 99)]
    assert got.mean_us == pytest.approx(b.mean())
