"""Scoring of streams of JSON bodies: stateless, one decision per body.

``score_stream`` holds a small index in the plan (append mode, no state);
``score_batches`` runs the indexed search on each micro-batch, ``score_batches_exact``
the packed exact search, for any number of references.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import as_vector, vectorise
from ..operators import ivf
from ..operators.decide import decided
from ..operators.knn import Leaves, exact_top_k, leaves_of, nearest_in
from ..schema import K, SearchOptions
from ..sources.payload import parse_bodies

#: References that score_stream sends to every task at most; beyond, use score_batches or score_batches_exact.
BROADCAST_ROWS = 200_000


def vectors_of(bodies: DataFrame, id_col: str) -> DataFrame:
    """query_id, parse_ok and q of JSON bodies."""
    parsed = parse_bodies(bodies)
    return as_vector(vectorise(parsed, id_col, "parse_ok"), F.col(id_col).alias("query_id"), "parse_ok")


def score_stream(bodies: DataFrame, refs: DataFrame, id_col: str = "event_id") -> DataFrame:
    """query_id, parse_ok, fraud, approved, fraud_score of a stream (or a table) of bodies.

    refs: ref_id, q, label; ties go to the smaller ref_id. A body that can't be
    parsed has no frauds and is approved.
    """
    rows = refs.select("ref_id", "q", "label").orderBy("ref_id").limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} references: use score_batches or score_batches_exact")
    q = np.array([r["q"] for r in rows], np.int32).reshape(len(rows), -1)
    label = np.array([r["label"] for r in rows], np.int64)
    shared = bodies.sparkSession.sparkContext.broadcast((q, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, labels = shared.value
        for batch in batches:
            ok = np.array(batch.column(1).to_pylist(), bool)
            fraud = np.zeros(batch.num_rows, np.int32)
            places = np.flatnonzero(ok)
            for at in range(0, len(places) if len(labels) else 0, 256):
                part = places[at : at + 256]
                asked = np.array([batch.column(2)[i].as_py() for i in part.tolist()], np.int32)
                fraud[part] = labels[nearest_in(asked, vectors, K)[0]].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fraud)], names=["query_id", "parse_ok", "fraud"])

    kind = dict(bodies.dtypes)[id_col]
    return decided(vectors_of(bodies, id_col).mapInArrow(run, f"query_id {kind}, parse_ok boolean, fraud int"))


def score_batch(bodies: DataFrame, index: ivf.Index, options: SearchOptions, id_col: str = "event_id") -> DataFrame:
    vectors = vectors_of(bodies, id_col)
    votes = ivf.search(index, vectors.where("parse_ok").select("query_id", "q"), options)
    rows = vectors.select("query_id", "parse_ok").join(votes, "query_id", "left").withColumn("fraud", F.coalesce("fraud", F.lit(0)))
    return decided(rows)


def score_batches(index: ivf.Index, options: SearchOptions, sink: Callable[[DataFrame, int], None], id_col: str = "event_id") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: score each micro-batch and hand the decisions to ``sink``."""
    return lambda batch, number: sink(score_batch(batch, index, options, id_col), number)


def _leaves(refs: DataFrame) -> Leaves:
    return leaves_of(refs.select(F.col("ref_id").alias("id"), "label", "q"))


def score_batch_exact(bodies: DataFrame, refs: DataFrame | Leaves, id_col: str = "event_id") -> DataFrame:
    """As score_stream, for a table; rows are told apart by place, so ids may repeat. refs: ref_id, q, label, or packed already."""
    vectors = vectors_of(bodies, id_col).withColumn("place", F.monotonically_increasing_id()).cache()
    asked = vectors.where("parse_ok").select(F.col("place").alias("id"), "q")
    found = exact_top_k(asked, refs if isinstance(refs, Leaves) else _leaves(refs), K)
    votes = found.groupBy(F.col("query_id").alias("place")).agg(F.sum("label").cast("int").alias("fraud"))
    rows = vectors.select("place", "query_id", "parse_ok").join(votes, "place", "left")
    return decided(rows.select("query_id", "parse_ok", F.coalesce("fraud", F.lit(0)).alias("fraud")))


def score_batches_exact(refs: DataFrame, sink: Callable[[DataFrame, int], None], id_col: str = "event_id") -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: score each micro-batch against all references, packed once, and hand the decisions to ``sink``."""
    known = _leaves(refs)
    return lambda batch, number: sink(score_batch_exact(batch, known, id_col), number)
