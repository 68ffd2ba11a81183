"""The 14 features of a transaction, as float32 expressions over typed columns.

Input columns: amount, avg_amount, km_from_home, merchant_avg_amount (FLOAT),
installments, tx_count_24h (integer), requested_at, last_ts (TIMESTAMP_NTZ; no
last transaction: null), km_from_current (FLOAT, null without one), is_online,
card_present (BOOLEAN), merchant_id, mcc (STRING), known_merchants (ARRAY).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .quantise import clamp01, div32, f32, quantise


def minutes_between(earlier: Column, later: Column) -> Column:
    """Whole minutes from one time to another, seconds dropped on both sides first."""
    minute = lambda t: F.unix_date(t.cast("date")).cast("bigint") * 1440 + F.hour(t) * 60 + F.minute(t)
    return minute(later) - minute(earlier)


def unknown_merchant(merchant: Column, known: Column) -> Column:
    """1.0 if the merchant isn't among the first known ones (a null list has none).

    A higher-order function, as it keeps the features' projection out of whole-stage code: all 14 in one method are more
    than the JVM compiles, while a projection of its own is split into methods that it does compile.
    """
    found = F.exists(F.slice(known, 1, S.KNOWN_MERCHANTS), lambda m: m == merchant)
    return F.when(F.coalesce(found, F.lit(False)), f32(0.0)).otherwise(f32(1.0))


def mcc_risk(mcc: Column) -> Column:
    risk = F.lit(None)
    for code, value in S.MCC_RISK.items():
        risk = F.when(mcc == code, f32(value)) if code == next(iter(S.MCC_RISK)) else risk.when(mcc == code, f32(value))
    return risk.otherwise(f32(S.DEFAULT_RISK))


def feature_columns() -> dict[str, Column]:
    c = F.col
    at = c("requested_at")
    has_last = c("last_ts").isNotNull() & c("km_from_current").isNotNull()
    ratio = clamp01(div32(div32(c("amount"), F.when(c("avg_amount") > 0, c("avg_amount"))), float(S.MAX_RATIO)))
    minutes = clamp01(div32(minutes_between(c("last_ts"), at).cast("float"), float(S.MAX_MINUTES)))
    flag = lambda b: F.when(b, f32(1.0)).otherwise(f32(0.0))
    values = (
        clamp01(div32(c("amount"), float(S.MAX_AMOUNT))),
        clamp01(div32(c("installments").cast("float"), float(S.MAX_INSTALLMENTS))),
        F.when(c("avg_amount") > 0, ratio).otherwise(f32(0.0)),
        div32(F.hour(at).cast("float"), 23.0),
        div32(F.weekday(at).cast("float"), 6.0),
        F.when(has_last, minutes).otherwise(f32(-1.0)),
        F.when(has_last, clamp01(div32(c("km_from_current"), float(S.MAX_KM)))).otherwise(f32(-1.0)),
        clamp01(div32(c("km_from_home"), float(S.MAX_KM))),
        clamp01(div32(c("tx_count_24h").cast("float"), float(S.MAX_TX_COUNT))),
        flag(c("is_online")),
        flag(c("card_present")),
        unknown_merchant(c("merchant_id"), c("known_merchants")),
        mcc_risk(c("mcc")),
        clamp01(div32(c("merchant_avg_amount"), float(S.MAX_MERCHANT_AMOUNT))),
    )
    return dict(zip(S.FEATURES, values, strict=True))


def vectorise(transactions: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the features as q0..q13."""
    values = feature_columns().values()
    return transactions.select(*keep, *[quantise(v).alias(q) for q, v in zip(S.QUANTISED, values, strict=True)])


def as_vector(df: DataFrame, *keep: str) -> DataFrame:
    """q0..q13 as one array column ``q``."""
    return df.select(*keep, F.array(*S.QUANTISED).alias("q"))


def vector() -> Column:
    """The quantised features of a transaction as one array ``q``."""
    return F.array(*[quantise(v) for v in feature_columns().values()]).alias("q")
