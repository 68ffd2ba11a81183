"""stream_score has no limit on the number of references."""

from __future__ import annotations

from nearvote.plans import catalogue
from nearvote.sources import payload
from nearvote.streaming import scorer
from tests.conftest import SF


def test_more_references_than_a_broadcast_holds(spark, monkeypatch):
    monkeypatch.setattr(scorer, "BROADCAST_ROWS", 10)
    got = catalogue.QUERIES["stream_score"](spark, SF)
    want = catalogue.QUERIES["fraud_score_exact"](spark, SF).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_repeated_ids_and_broken_bodies(spark):
    refs = spark.createDataFrame([(i, i % 2, [i] * 14) for i in range(20)], "ref_id long, label int, q array<int>")
    bodies = spark.createDataFrame([(1, "{"), (1, "no"), (None, "")], "event_id long, body string")
    assert [(r.parse_ok, r.fraud) for r in scorer.score_batch_exact(bodies, refs).collect()] == [(False, 0)] * 3


def test_references_are_packed_once_for_all_batches(spark, monkeypatch):
    packed, of = [], scorer.leaves_of
    monkeypatch.setattr(scorer, "leaves_of", lambda refs: packed.append(1) or of(refs))
    refs = spark.createDataFrame([(i, i % 2, [i] * 14) for i in range(20)], "ref_id long, label int, q array<int>")
    bodies, got = spark.createDataFrame([(1, "{"), (2, payload.body_with())], "event_id long, body string"), []
    score = scorer.score_batches_exact(refs, lambda batch, number: got.append(sorted((r.query_id, r.parse_ok) for r in batch.collect())))
    for number in range(2):
        score(bodies, number)
    assert got == [[(1, False), (2, True)]] * 2 and len(packed) == 1
