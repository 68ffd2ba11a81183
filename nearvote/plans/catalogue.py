"""Registered queries and their DuckDB twins (``oracles``)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import distance, features, quantise
from ..operators import decide, ivf, kmeans, knn, metrics, replay
from ..sources import payload, requests, transactions
from ..storage import scratch_path
from ..streaming import scorer
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Cells of the index that the search queries build: the references with the lowest ids are the centroids.
CELLS = 512
SMALL = S.SearchOptions(nprobe=2, repair_probe=6, repair_min=1, repair_max=4)
REPAIR = S.SearchOptions(nprobe=1, repair_probe=2, repair_candidates=4, repair_min=1, repair_max=4)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, label, q0..q13 of every transaction."""
    return features.vectorise(transactions.transactions(spark, sf_dir), "event_id", "label")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, q) and references (ref_id, label, q). The features behind both are computed once: cached."""
    asked, known = transactions.split(features.as_vector(_vectors(spark, sf_dir), "event_id", "label").cache())
    return asked.select(F.col("event_id").alias("query_id"), "q"), known.select(F.col("event_id").alias("ref_id"), "label", "q")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", quantise.quantise_array("embedding").alias("q"))


# Features


@query
def features_float(spark, sf_dir):
    """The 14 features, as text of their float32 bits would differ by engine: scaled to 1e6 and rounded."""
    rows = transactions.transactions(spark, sf_dir)
    return rows.select("event_id", *[F.rint(v.cast("double") * 1e6).cast("bigint").alias(name) for name, v in features.feature_columns().items()])


@query
def features_quantized(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return rows.select("event_id", *[F.col(c).cast("int").alias(c) for c in S.QUANTISED])


@query
def mcc_risk_join(spark, sf_dir):
    """The risk table as a broadcast join."""
    table = spark.createDataFrame(list(S.MCC_RISK.items()), "mcc string, risk double")
    rows = transactions.transactions(spark, sf_dir).select("event_id", "mcc").join(F.broadcast(table), "mcc", "left")
    risk = F.coalesce("risk", F.lit(S.DEFAULT_RISK))
    return rows.groupBy("mcc").agg(F.count("*").alias("n"), F.rint(F.max(risk) * 100).cast("int").alias("risk_pct"))


@query
def unknown_merchant(spark, sf_dir):
    rows = transactions.transactions(spark, sf_dir)
    return rows.select("event_id", features.unknown_merchant(F.col("merchant_id"), F.col("known_merchants")).cast("int").alias("unknown"))


@query
def minutes_since_last(spark, sf_dir):
    rows = transactions.transactions(spark, sf_dir)
    minutes = features.minutes_between(F.col("last_ts"), F.col("requested_at"))
    return rows.select("event_id", minutes.cast("bigint").alias("minutes"), F.weekday("requested_at").alias("weekday"), F.hour("requested_at").alias("hour"))


@query
def parse_payload_json(spark, sf_dir):
    """Transactions written as JSON bodies and read back: the same quantised features."""
    bodies = transactions.payloads(transactions.transactions(spark, sf_dir))
    rows = features.vectorise(payload.parse_bodies(bodies), "event_id", "parse_ok")
    return rows.select("event_id", "parse_ok", *[F.col(c).cast("int").alias(c) for c in S.QUANTISED])


@query
def parse_edge_cases(spark, sf_dir):
    bodies = spark.createDataFrame(payload.edge_bodies(), "name string, body string")
    rows = features.vectorise(payload.parse_bodies(bodies), "name", "parse_ok")
    q = lambda d: F.when(F.col("parse_ok"), F.col(f"q{d}")).cast("int")
    return rows.select("name", "parse_ok", q(0).alias("amount"), q(1).alias("installments"), q(2).alias("ratio"), q(5).alias("minutes"), q(11).alias("unknown"), q(12).alias("risk"))


# Vectors


@query
def embeddings_quantize(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return rows.select("vec_id", F.posexplode("q").alias("dim", "value")).select("vec_id", "dim", F.col("value").cast("int").alias("value"))


@query
def dequantized_error(spark, sf_dir):
    """Largest error of quantising and back, in millionths."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.explode("embedding").alias("x"))
    back = quantise.dequantise(quantise.quantise(F.col("x")))
    error = F.abs(back.cast("double") - F.col("x").cast("double"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.max(F.rint(error * 1e6)).cast("bigint").alias("worst"))


@query
def pairwise_distance(spark, sf_dir):
    """Squared distances of each cluster's first vector to all vectors of the cluster."""
    rows = _embeddings(spark, sf_dir)
    first = rows.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    first = first.join(rows.select(F.col("vec_id").alias("first_id"), F.col("q").alias("p")), "first_id")
    return rows.join(F.broadcast(first), "label").select("vec_id", "first_id", distance.squared_l2_arrays(F.col("q"), F.col("p")).alias("dist"))


@query
def exact_knn_top5(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "id")
    return knn.exact_top_k(rows.where("id % 10 = 0").select("id", "q"), rows, 5, exclude_self=True)


@query
def knn_classify(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "id")
    found = knn.exact_top_k(rows.where("id % 10 = 0").select("id", "q"), rows, 5, exclude_self=True)
    return decide.majority(found)


def _exact_votes(spark, sf_dir):
    asked, known = _sides(spark, sf_dir)
    found = knn.exact_top_k(asked.withColumnRenamed("query_id", "id"), known.withColumnRenamed("ref_id", "id"), S.K)
    votes = found.groupBy("query_id").agg(F.sum("label").cast("int").alias("fraud"), F.sum("dist").alias("sum_dist"))
    return decide.decided(votes)


@query
def fraud_score_exact(spark, sf_dir):
    """Flagship: features, quantisation, exact five nearest, vote, decision."""
    return _exact_votes(spark, sf_dir)


# Index


def _kmeans_start(vectors: DataFrame, k: int, id_col: str) -> np.ndarray:
    return kmeans.first_centroids(vectors, k, "lowest", 0, id_col, "q")[0]


@query
def kmeans_assign(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    return kmeans.assign(rows.select("vec_id", "q"), _kmeans_start(rows, 8, "vec_id"), "q", exact=True).select("vec_id", "cell_id", "dist")


@query
def kmeans_iterations(spark, sf_dir):
    """Two rounds with integer means, from the eight lowest ids."""
    rows = _embeddings(spark, sf_dir).withColumnRenamed("vec_id", "ref_id")
    centroids = kmeans.lloyd(rows, 8, 2, "lowest", column="q", exact=True)
    cells = [(c, d, int(v)) for c, row in enumerate(centroids.tolist()) for d, v in enumerate(row)]
    return spark.createDataFrame(cells, "cell_id int, dim int, value long")


@query
def init_shuffle(spark, sf_dir):
    """First places of the replayed shuffles of 10000 vectors."""
    rows = [(name, n, p) for name in ("chacha", "splitmix64") for n, p in enumerate(replay.shuffled_prefix(10_000, 64, name, 0x52494E48)[0])]
    return spark.createDataFrame(rows, "generator string, n int, place long")


def _index(spark, sf_dir) -> tuple[DataFrame, ivf.Index]:
    """Queries and the index, whose placed vectors are cached too."""
    asked, known = _sides(spark, sf_dir)
    centroids = _kmeans_start(known, CELLS, "ref_id").astype(np.int64)
    return asked, ivf.from_assignment(kmeans.assign(known, centroids, "q", exact=True).cache(), centroids, exact=True)


@query
def ivf_cells(spark, sf_dir):
    return _index(spark, sf_dir)[1].cells.select("cell_id", "count")


@query
def cell_offsets(spark, sf_dir):
    return _index(spark, sf_dir)[1].cells.select("cell_id", "start", "count", "block_start", "block_count")


@query
def cell_positions(spark, sf_dir):
    return _index(spark, sf_dir)[1].vectors.select("cell_id", "pos", "block", "ref_id", "label")


def _edges(boxes: DataFrame, *keys: str) -> DataFrame:
    rows = boxes.select(*keys, F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "edge"))
    return rows.select(*keys, "dim", F.col("edge.lo").cast("int").alias("lo"), F.col("edge.hi").cast("int").alias("hi"))


@query
def cell_bounds(spark, sf_dir):
    return _edges(_index(spark, sf_dir)[1].cells.where("count > 0"), "cell_id")


@query
def block_bounds(spark, sf_dir):
    return _edges(_index(spark, sf_dir)[1].blocks, "cell_id", "block")


@query
def box_lower_bound(spark, sf_dir):
    """Per query its least bound over the cells' boxes, and the cell."""
    asked, index = _index(spark, sf_dir)
    none = spark.createDataFrame([], "query_id long, cell_id int")
    first = ivf.repair_cells(asked, index, none, 1)
    joined = first.join(asked, "query_id").join(F.broadcast(index.cells.select("cell_id", "lo", "hi")), "cell_id")
    return joined.select("query_id", "cell_id", distance.box_bound_arrays(F.col("q"), F.col("lo"), F.col("hi")).alias("bound"))


@query
def probe_cells(spark, sf_dir):
    asked, index = _index(spark, sf_dir)
    return ivf.probes(asked, index.centroids, 4).select("query_id", "probe_rank", "cell_id", "cell_dist")


@query
def ivf_search_fixed(spark, sf_dir):
    asked, index = _index(spark, sf_dir)
    return ivf.search_fixed(index, asked, 4)


@query
def ivf_search_pruned(spark, sf_dir):
    """The same with blocks skipped by their boxes: the same rows."""
    asked, index = _index(spark, sf_dir)
    return ivf.search_fixed(index, asked, 4, prune=True)


@query
def ivf_search_adaptive(spark, sf_dir):
    asked, index = _index(spark, sf_dir)
    return decide.decided(ivf.search(index, asked, SMALL))


@query
def ivf_search_default(spark, sf_dir):
    """The search options as they are by default: 10 cells, 48 where the vote is ambiguous."""
    asked, index = _index(spark, sf_dir)
    return decide.decided(ivf.search(index, asked))


@query
def ivf_search_repair(spark, sf_dir):
    asked, index = _index(spark, sf_dir)
    return decide.decided(ivf.search(index, asked, REPAIR))


@query
def ivf_reranked(spark, sf_dir):
    """The float order of the five nearest leaves the vote as it is."""
    asked, index = _index(spark, sf_dir)
    found = ivf.search_fixed(index, asked, 4).join(index.vectors.select("ref_id", "q"), "ref_id")
    again = ivf.rerank(found, asked)
    return again.groupBy("query_id").agg(F.sum("label").cast("int").alias("fraud"), F.max("new_rank").alias("found"))


@query
def ivf_recall(spark, sf_dir):
    """Neighbours found when 4 of the cells are probed, of the exact ones."""
    asked, index = _index(spark, sf_dir)
    parts = ivf.pack(index)
    return ivf.recall(ivf.search_fixed(index, asked, 4, parts=parts), ivf.search_exact(index, asked, parts))


@query
def ivf_stored(spark, sf_dir):
    """The index written as Parquet, loaded, validated and searched."""
    asked, index = _index(spark, sf_dir)
    path = scratch_path(spark, "index")
    index.write(path)
    return decide.decided(ivf.search(ivf.Index.load(spark, path), asked, SMALL))


# Decisions, metrics, requests


@query
def decision_table(spark, sf_dir):
    counts = spark.range(9).select(F.col("id").cast("int").alias("fraud"))
    return decide.decided(counts).withColumn("body", decide.as_json(F.col("fraud")))


@query
def warmup_vectors(spark, sf_dir):
    rows = transactions.warmup_vectors(spark).select("id", F.posexplode(quantise.quantise_array("v")).alias("dim", "value"))
    return rows.select("id", "dim", F.col("value").cast("int").alias("value"))


@query
def warmup_scores(spark, sf_dir):
    """The generated vectors scored by the index."""
    _, index = _index(spark, sf_dir)
    asked = transactions.warmup_vectors(spark).select(F.col("id").alias("query_id"), quantise.quantise_array("v").alias("q"))
    return decide.decided(ivf.search(index, asked, SMALL))


def _samples(spark, sf_dir):
    """Latencies: an event's value in tens of microseconds, its type as the stage."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_type").alias("stage"), "ts", F.rint(F.col("value") * 10_000).cast("bigint").alias("ns"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))


@query
def latency_histogram(spark, sf_dir):
    return metrics.histogram(_samples(spark, sf_dir), ["stage"])


@query
def latency_percentiles(spark, sf_dir):
    return metrics.percentiles(metrics.histogram(_samples(spark, sf_dir), ["stage"]), ["stage"])


@query
def batch_histogram(spark, sf_dir):
    return metrics.batch_histogram(_samples(spark, sf_dir).withColumn("size", F.col("k") * 2))


@query
def batch_summary(spark, sf_dir):
    return metrics.batch_summary(metrics.batch_histogram(_samples(spark, sf_dir).withColumn("size", F.col("k") * 2)))


@query
def interval_metrics(spark, sf_dir):
    return metrics.intervals(_samples(spark, sf_dir), "5 seconds", by=("stage",))


REQUESTS = [
    (1, "GET /ready HTTP/1.1\r\nHost: a\r\n\r\n"), (2, "GET /x HTTP/1.1\r\n\r\n"), (3, "DELETE /ready HTTP/1.1\r\n\r\n"),
    (4, "POST /score HTTP/1.1\r\nCONTENT-length:  5\r\n\r\nhello, and more"), (5, "PUT /any HTTP/1.1\r\nContent-Length: 2\r\n\r\n{}"),
    (6, "POST /score HTTP/1.1\r\n\r\n{}"), (7, "GET /ready?x HTTP/1.1\r\n\r\n"),
]


@query
def route_requests(spark, sf_dir):
    rows = spark.createDataFrame(REQUESTS, "id int, request string")
    return requests.route_requests(rows).select("id", "route", "status", "body")


@query
def socket_list(spark, sf_dir):
    rows = spark.createDataFrame([(1, " a.sock, ,b.sock,"), (2, ""), (3, ",".join(f"s{i}" for i in range(20)))], "id int, paths string")
    found = requests.socket_list(F.col("paths"))
    return rows.select("id", F.size(found).alias("n"), F.array_join(found, "|").alias("targets"))


@query
def stream_score(spark, sf_dir):
    """Bodies of the queried transactions as a stream, scored against all known ones; equals fraud_score_exact."""
    rows = transactions.transactions(spark, sf_dir)
    # One pass over the transactions gives both sides; they are cached.
    asked, known = transactions.split(transactions.payloads(rows, features.vector(), only=F.expr(transactions.ASKED)).cache())
    refs = known.select(F.col("event_id").alias("ref_id"), "label", "q")
    source, sink = scratch_path(spark, "bodies"), scratch_path(spark, "decisions")
    asked.select("event_id", "body").repartition(4, "event_id").write.parquet(source)
    bodies = spark.readStream.schema("event_id long, body string").option("maxFilesPerTrigger", 2).parquet(source)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{sink}/n={number}")
    score = scorer.score_batches_exact(refs, write)
    bodies.writeStream.foreachBatch(score).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select("query_id", "fraud", "approved", "fraud_score")


@query
def stream_intervals(spark, sf_dir):
    """The interval metrics as a stream with a watermark; equals the batch's, per hour."""
    source, name = scratch_path(spark, "samples"), scratch_path(spark, "intervals")
    _samples(spark, sf_dir).coalesce(1).sortWithinPartitions("ts").write.parquet(source)
    rows = spark.readStream.schema("stage string, ts timestamp_ntz, ns long, k int").parquet(source)
    totals = metrics.intervals(rows.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", late="1 hour")
    write = lambda batch, number: batch.withColumnRenamed("n", "samples").withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{name}/batch={number}")
    totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{name}-state").trigger(availableNow=True).start().awaitTermination()
    return _latest(spark.read.parquet(name))  # intervals that changed, by batch; the watermark lets old ones go


def _latest(found):
    """Each interval as the last batch that changed it left it."""
    order = F.col("batch_no")
    return found.groupBy(F.col("interval_start").cast("timestamp_ntz").alias("interval_start")).agg(*[F.max_by(c, order).alias(n) for c, n in (("samples", "samples"), ("sum_us", "sum_us"), ("max_us", "max_us"))])


ORACLES: dict[str, str] = oracles.build(CELLS, SMALL, REPAIR)
