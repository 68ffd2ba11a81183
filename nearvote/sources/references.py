"""Labelled reference vectors from (gzipped) JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.quantise import quantise_array


def is_fraud(label: Column) -> Column:
    return F.coalesce(F.startswith(label, F.lit("fraud")), F.lit(False)).cast("int")


def padded(vector: Column, dims: int = S.DIMS) -> Column:
    """The first ``dims`` components, read as double and cast to float; missing ones are 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(F.get(vector, d), F.lit(0.0)).cast("float"))


def read_references(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """v, q (quantised) and label of records {"vector": [...], "label": "..."}; .gz is read as it is.

    A gzip file or a multi-line array can't be split: use one file per task and
    ``multiline=False`` (a record per line) for large inputs.
    """
    rows = spark.read.schema(S.REFERENCE).option("multiLine", multiline).json(path).where("vector IS NOT NULL AND label IS NOT NULL")
    v = padded(F.col("vector"))
    return rows.select(v.alias("v"), is_fraud(F.col("label")).alias("label")).withColumn("q", quantise_array(F.col("v")))


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """Records by occurrences of the text ``"vector":[``, whatever the structure around it."""
    text = spark.read.text(path)
    return text.select(F.regexp_count("value", F.lit('"vector":\\[')).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
