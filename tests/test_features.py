"""Features, quantisation and the payload parser."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.functions import distance, features, quantise
from nearvote.sources import payload, references, requests


def test_known_vector(spark):
    rows = spark.createDataFrame([(payload.body_with(),)], "body string")
    row = features.vectorise(payload.parse_bodies(rows), "parse_ok").first()
    assert [row[q] for q in S.QUANTISED] == [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60]


def test_quantise_is_float32_and_half_even(spark):
    cents = np.arange(0, 1_000_000, 977)
    rows = spark.createDataFrame([(int(c),) for c in cents], "c long")
    x = (F.col("c") / 100).cast("float")
    got = [r[0] for r in rows.orderBy("c").select(quantise.quantise(quantise.clamp01(quantise.div32(x, 10000.0)))).collect()]
    a = (cents / 100).astype(np.float32) / np.float32(10000)
    assert got == np.rint(a * np.float32(10000)).astype(int).tolist()
    limits = spark.createDataFrame([(9.0,), (-9.0,), (0.00025,), (0.00075,)], "x float").select(quantise.quantise(F.col("x"))).collect()
    assert [r[0] for r in limits] == [32767, -32767, 2, 8]


def test_clamp_and_nulls(spark):
    row = spark.range(1).select(
        quantise.clamp01(F.lit(-1.0).cast("float")).alias("a"), quantise.clamp01(F.lit(2.0).cast("float")).alias("b"),
        features.unknown_merchant(F.lit("m"), F.lit(None).cast("array<string>")).alias("c"), features.mcc_risk(F.lit(None).cast("string")).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (0.0, 1.0, 1.0, 0.5)


def test_distances(spark):
    rng = np.random.default_rng(5)
    a, b = (rng.integers(-10000, 10000, (50, 14)) for _ in range(2))
    rows = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, a array<smallint>, b array<smallint>")
    flat = distance.squared_l2(distance.as_columns(F.col("a"), 14), distance.as_columns(F.col("b"), 14))
    lo, hi = F.transform("b", lambda x: F.least(x, F.lit(0)).cast("smallint")), F.transform("b", lambda x: F.greatest(x, F.lit(0)).cast("smallint"))
    rows = rows.withColumns({"lo": lo, "hi": hi})
    box = distance.box_bound(*[distance.as_columns(F.col(c), 14) for c in ("a", "lo", "hi")])
    got = rows.orderBy("i").select(flat, distance.squared_l2_arrays(F.col("a"), F.col("b")), box, distance.box_bound_arrays(F.col("a"), F.col("lo"), F.col("hi"))).collect()
    want = ((a - b) ** 2).sum(axis=1).tolist()
    gap = np.maximum(np.maximum(np.minimum(b, 0) - a, a - np.maximum(b, 0)), 0)
    assert [r[0] for r in got] == [r[1] for r in got] == want
    assert [r[2] for r in got] == [r[3] for r in got] == (gap**2).sum(axis=1).tolist()


def test_widening_avoids_smallint_overflow(spark):
    row = spark.createDataFrame([([32767], [-32767])], "a array<smallint>, b array<smallint>").select(distance.squared_l2_arrays(F.col("a"), F.col("b"))).first()
    assert row[0] == 65534**2


def test_references_from_gzip(spark, tmp_path):
    import gzip

    path = tmp_path / "refs.json.gz"
    with gzip.open(path, "wt") as out:
        out.write('[{"vector":[0.5,-1],"label":"fraud"},{"vector":[1,2,3],"label":"legit"},{"vector":[0.1],"label":"fraudulent"}]')
    rows = references.read_references(spark, str(path)).collect()
    assert [(r.label, r.q[:3], len(r.q)) for r in rows] == [(1, [5000, -10000, 0], 14), (0, [10000, 20000, 30000], 14), (1, [1000, 0, 0], 14)]
    assert references.count_records(spark, str(path)).first()[0] == 3


def test_requests(spark):
    raw = "POST /s HTTP/1.1\r\nX: 1\r\ncOnTeNt-LeNgTh: \t3\r\n\r\nabcdef"
    row = spark.createDataFrame([(raw,)], "r string").select(requests.content_length(F.col("r")), requests.body_of(F.col("r")), requests.route(F.col("r"))).first()
    assert tuple(row) == (3, "abc", "score")


@pytest.mark.parametrize(("given", "want"), [
    (S.SearchOptions(), S.SearchOptions(10, 48, 0, 1, 4)),
    (S.SearchOptions(-1, -1, -1, -3, 9), S.SearchOptions(64, 64, 256, 0, 5)),
    (S.SearchOptions(0, 0, 3, 1, 4), S.SearchOptions(1, 1, 3, 1, 4)),
    (S.SearchOptions(500, 2, 0, 1, 4), S.SearchOptions(64, 64, 0, 1, 4)),
])
def test_options_are_clamped(given, want):
    assert given.within(64) == want


def test_options_from_settings():
    assert S.SearchOptions.from_settings({"NPROBE": "7", "REPAIR_MIN": "x"}) == S.SearchOptions(nprobe=7)


def test_features_run_in_methods_that_the_jvm_compiles(spark):
    from nearvote.plans import catalogue
    from tests.conftest import SF

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the code is shown before a run only
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        shown = features.as_vector(catalogue._vectors(spark, SF), "event_id", "label")._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000, sizes  # HotSpot interprets longer ones


def test_unknown_merchant_with_nulls(spark):
    rows = spark.createDataFrame([("m", ["a", None, "m"]), ("m", ["a", None]), (None, ["a"]), ("m", []), ("m", ["a"] * 16 + ["m"])], "m string, k array<string>")
    assert [r[0] for r in rows.coalesce(1).select(features.unknown_merchant(F.col("m"), F.col("k"))).collect()] == [0.0, 1.0, 1.0, 1.0, 1.0]
