"""Latency histograms, nearest-rank percentiles and batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_BUCKET, TOP_BATCH = 2047, 127
PERCENTS = (50, 95, 99)


def bucket(nanoseconds: Column) -> Column:
    """Whole microseconds; the top bucket takes all that is longer."""
    return F.least(F.floor(nanoseconds / 1000), F.lit(TOP_BUCKET)).cast("int")


def histogram(samples: DataFrame, by: list[str], nanoseconds: str = "ns") -> DataFrame:
    """by, bucket, n."""
    return samples.groupBy(*by, bucket(F.col(nanoseconds)).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(buckets: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean and max of the buckets, and the nearest-rank p50, p95, p99: the bucket that holds sample ceil(n p / 100).

    The windows run over a histogram, at most 2048 rows per group.
    """
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = buckets.withColumns({"total": F.sum("n").over(whole), "cum": F.sum("n").over(upto)})
    rank = lambda p: F.expr(f"(total * {p} + 99) div 100")
    found = [F.min(F.when(F.col("cum") >= rank(p), F.col("bucket"))).alias(f"p{p}") for p in PERCENTS]
    mean = (F.sum(F.col("n") * F.col("bucket")).cast("double") / F.sum("n")).alias("mean_us")
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), mean, F.max("bucket").alias("max_us"), *found)


def batch_histogram(sizes: DataFrame, size: str = "size") -> DataFrame:
    """size (127 takes all that is larger), batches."""
    return sizes.groupBy(F.least(F.col(size), F.lit(TOP_BATCH)).cast("int").alias("size")).agg(F.count("*").alias("batches"))


def batch_summary(histogram_: DataFrame) -> DataFrame:
    mean = (F.sum(F.col("size") * F.col("batches")).cast("double") / F.sum("batches")).alias("mean_size")
    return histogram_.agg(F.sum("batches").alias("batches"), mean, F.max("size").alias("max_size"))


def intervals(samples: DataFrame, every: str, time: str = "ts", value: str = "ns", by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Count, sum and max of the buckets per tumbling interval; with ``late`` as a watermark, for streams."""
    rows = samples.withWatermark(time, late) if late else samples
    b = bucket(F.col(value))
    grouped = rows.groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"), F.sum(b.cast("bigint")).alias("sum_us"), F.max(b).alias("max_us"))
    return grouped.select(F.col("window.start").alias("interval_start"), *by, "n", "sum_us", "max_us")
