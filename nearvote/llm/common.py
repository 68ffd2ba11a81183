"""Shared helpers: scratch tables in the cluster's shared folder, skew-safe lookups, word memos."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can see: ``spark.checkpoint.dir``; only where it is unset (tests, a laptop) a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="nearvote-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/nearvote-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all scratch tables and files of this process, once no result that reads them is needed."""
    while _made:
        _delete(spark, _made.pop())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs one task, not the whole history, and values that
    are unique but not reproducible (generated integer names) are computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialise() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


#: A key is hot if it holds at least this share of the rows, so at most 1/HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000
SALTS = 1024


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` to the one row of ``table`` per key, without sending a hot key's rows to one task.

    ``table[count]`` is how many rows have the key. Keys with at least
    ``total * HOT_SHARE`` rows number at most ``1 / HOT_SHARE``, whatever the
    size of the input; they alone are broadcast. Rows of hot keys are salted so
    that the shuffled join spreads them evenly, where they match nothing.
    """
    hot = table.where(F.col(count) >= F.lit(max(2.0, total * HOT_SHARE))).select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values], F.lit(True).alias("_is_hot"))
    cold = table.where(F.col(count) < F.lit(max(2.0, total * HOT_SHARE))).select(*keys, *values, F.when(F.col(count) < 0, 1).otherwise(0).alias("_salt"))  # not a constant, which would leave the join key
    salt = F.when(F.col("_is_hot"), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)  # the same if a task runs again
    out = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt)
    out = out.join(cold, [*keys, "_salt"], "left")
    picked = [F.coalesce(F.col(f"_hot_{v}"), F.col(v)).alias(v) for v in values]
    out = out.select(*rows.columns, *picked)
    return out if how == "left" else out.where(F.col(values[0]).isNotNull())


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as it takes to differ from the taken ones (in any case of letters)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def sha_of(text_col: str):
    """SHA-256 of a text's UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def any_repeated(rows: DataFrame) -> bool:
    """Whether rows repeat doc_id and text (``sha``); few bytes a row are shuffled."""
    return rows.groupBy("doc_id", "sha").count().where("count > 1").limit(1).count() > 0


def keep_rows(docs: DataFrame, kept: DataFrame, repeated: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text ``kept(doc_id, sha)`` lists, one for each.

    The texts are shuffled once and not sorted; once more only if rows of
    ``docs`` repeat id and text, as any_repeated() tells, and one is to stay.
    """
    sha, want_id, want_sha = (free_name(n, docs.columns) for n in ("sha_of_text", "kept_id", "kept_sha"))
    rows = docs.withColumn(sha, sha_of(text_col))
    want = kept.select(F.col("doc_id").alias(want_id), F.col("sha").alias(want_sha)).hint("shuffle_hash")
    out = rows.join(want, F.col(id_col).cast("long").eqNullSafe(F.col(want_id)) & (F.col(sha) == F.col(want_sha)), "left_semi")
    if repeated:
        out = out.dropDuplicates([id_col, sha])
    return out.select(*docs.columns)
