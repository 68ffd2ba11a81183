"""Transactions derived from the events table, as typed columns and as JSON payloads.

Money is kept in integer cents until the last division, so that any engine
computes the same float32 values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S

MCC_CYCLE = (*S.MCC_RISK, "0000")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event; see the module ``nearvote.functions.features`` for the columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    cents = F.lit(20) * F.rint(F.col("value") * 100).cast("bigint")
    base = events.select(
        "event_id", "user_id", F.col("ts").alias("requested_at"), k.alias("k"), cents.alias("amount_c"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )
    merchant = F.concat(F.lit("MERC-"), F.lpad((F.col("k") % 20).cast("string"), 3, "0"))
    base = base.withColumn("merchant_id", merchant)
    user = Window.partitionBy("user_id").orderBy("requested_at")
    before = user.rowsBetween(Window.unboundedPreceding, -1)
    day = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY requested_at RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND CURRENT ROW)")
    base = base.withColumns({
        "avg_c": F.floor(F.sum("amount_c").over(before) / F.nullif(F.count("*").over(before), F.lit(0))),
        "last_ts": F.lag("requested_at").over(user),
        "last_k": F.lag("k").over(user),
        "tx_count_24h": day - 1,
        "known_merchants": F.collect_list("merchant_id").over(user.rowsBetween(-S.KNOWN_MERCHANTS, -1)),
    })
    mcc = F.element_at(F.array(*[F.lit(m) for m in MCC_CYCLE]), (F.col("k") % len(MCC_CYCLE) + 1).cast("int"))
    return base.select(
        "event_id", "requested_at", "label", "merchant_id", "known_merchants", "last_ts", "tx_count_24h", mcc.alias("mcc"),
        (F.col("amount_c") / 100).cast("float").alias("amount"),
        (1 + F.col("k") % 15).alias("installments"),
        (F.coalesce("avg_c", F.lit(0)) / 100).cast("float").alias("avg_amount"),
        (F.abs(F.col("k") - F.col("last_k")) * F.lit(10.25)).cast("float").alias("km_from_current"),
        (F.col("k") * F.lit(11.5)).cast("float").alias("km_from_home"),
        (F.col("k") % 2 == 0).alias("is_online"),
        (F.col("k") % 3 == 0).alias("card_present"),
        ((F.col("k") % 20 + 1) * F.lit(475.5)).cast("float").alias("merchant_avg_amount"),
    )


def payloads(rows: DataFrame, *keep: Column, only: Column | None = None) -> DataFrame:
    """event_id, label, ``keep`` and the transaction as a JSON body (null but where ``only`` holds)."""
    stamp = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    last = F.to_json(F.struct(stamp("last_ts").alias("timestamp"), "km_from_current"))
    parts = {
        "transaction": F.to_json(F.struct("amount", "installments", stamp("requested_at").alias("requested_at"))),
        "customer": F.to_json(F.struct("avg_amount", F.col("tx_count_24h"), "known_merchants")),
        "merchant": F.to_json(F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg_amount").alias("avg_amount"))),
        "terminal": F.to_json(F.struct("is_online", "card_present", "km_from_home")),
        "last_transaction": F.when(F.col("last_ts").isNull(), F.lit("null")).otherwise(last),
    }
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), value) for name, value in parts.items()]), F.lit("}"))
    return rows.select("event_id", "label", *keep, (body if only is None else F.when(only, body)).alias("body"))


ASKED = "event_id % 50 = 0"


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, references) of the scoring queries: every 50th event is asked, all others are known."""
    return rows.where(ASKED), rows.where("event_id % 50 <> 0")


def warmup_vectors(spark: SparkSession, count: int = 2048) -> DataFrame:
    """Generated query vectors (id, v): v[d] = ((131 i + 17 d) mod 1000) / 1000, without a last transaction where 4 divides i."""
    value = lambda d: ((F.col("id") * 131 + d * 17) % 1000).cast("float") / F.lit(1000.0).cast("float")
    dims = [F.when((F.col("id") % 4 == 0) & F.lit(d in (5, 6)), F.lit(-1.0)).otherwise(value(d)).cast("float") for d in range(S.DIMS)]
    return spark.range(count).select("id", F.array(*dims).alias("v"))
