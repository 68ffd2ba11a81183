"""JSON transaction bodies -> typed columns.

A body that lacks a required field fails (``parse_ok`` false) and is then
approved with score 0. The key ``last_transaction`` must be there; null means
no last transaction. Whole numbers are read up to the first other character
(``2.5`` is 2) modulo 2**32; a sign fails. Times need 20 characters, of which
the first 19 count; a code needs 4 characters and keeps 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def _whole(text: Column) -> Column:
    digits = F.regexp_extract(text, "^([0-9]{1,18})", 1)
    return F.when(digits != "", digits.cast("bigint") % (1 << 32))


def _time(text: Column) -> Column:
    return F.when(F.length(text) >= 20, F.substring(text, 1, 19).try_cast("timestamp_ntz"))


def parse_bodies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The frame's other columns, ``parse_ok`` and the columns of a transaction."""
    p = F.from_json(F.col(body), S.PAYLOAD)
    others = [c for c in bodies.columns if c != body]
    variant = F.try_parse_json(F.col(body))
    no_last = F.coalesce(F.is_variant_null(F.try_variant_get(variant, "$.last_transaction", "variant")), F.lit(False))
    rows = bodies.select(*others, p.alias("p"), no_last.alias("no_last"))
    rows = rows.select(
        *others, "no_last",
        F.col("p.transaction.amount").alias("amount"),
        _whole(F.col("p.transaction.installments")).alias("installments"),
        _time(F.col("p.transaction.requested_at")).alias("requested_at"),
        F.col("p.customer.avg_amount").alias("avg_amount"),
        _whole(F.col("p.customer.tx_count_24h")).alias("tx_count_24h"),
        F.slice(F.col("p.customer.known_merchants"), 1, S.KNOWN_MERCHANTS).alias("known_merchants"),
        F.col("p.merchant.id").alias("merchant_id"),
        F.when(F.length("p.merchant.mcc") >= 4, F.substring("p.merchant.mcc", 1, 4)).alias("mcc"),
        F.col("p.merchant.avg_amount").alias("merchant_avg_amount"),
        F.col("p.terminal.is_online").alias("is_online"),
        F.col("p.terminal.card_present").alias("card_present"),
        F.col("p.terminal.km_from_home").alias("km_from_home"),
        _time(F.col("p.last_transaction.timestamp")).alias("last_ts"),
        F.col("p.last_transaction.km_from_current").alias("km_from_current"),
    )
    required = ["amount", "installments", "requested_at", "avg_amount", "tx_count_24h", "known_merchants", "merchant_id", "mcc", "merchant_avg_amount", "is_online", "card_present", "km_from_home"]
    ok = F.col("no_last") | (F.col("last_ts").isNotNull() & F.col("km_from_current").isNotNull())
    for name in required:
        ok = ok & F.col(name).isNotNull()
    return rows.withColumn("parse_ok", ok).drop("no_last")


#: Bodies of the parser's edge cases, as differences from a sound body.
_SOUND = {
    "transaction": '{"amount":41.12,"installments":2,"requested_at":"2026-03-11T18:45:53Z"}',
    "customer": '{"avg_amount":82.24,"tx_count_24h":3,"known_merchants":["MERC-003","MERC-016"]}',
    "merchant": '{"id":"MERC-016","mcc":"5411","avg_amount":60.25}',
    "terminal": '{"is_online":false,"card_present":true,"km_from_home":29.23}',
    "last_transaction": "null",
}


def body_with(drop: str | None = None, order: list[str] | None = None, **sections: str) -> str:
    parts = {**_SOUND, **sections}
    return "{" + ",".join(f'"{name}":{parts[name]}' for name in (order or parts) if name != drop) + "}"


def edge_bodies() -> list[tuple[str, str]]:
    tx = lambda amount="41.12", n="2", at="2026-03-11T18:45:53Z": f'{{"amount":{amount},"installments":{n},"requested_at":"{at}"}}'
    customer = lambda avg='"avg_amount":82.24,', known='["MERC-003","MERC-016"]': f'{{{avg}"tx_count_24h":3,"known_merchants":{known}}}'
    merchant = lambda mcc: f'{{"id":"MERC-016","mcc":"{mcc}","avg_amount":60.25}}'
    last = lambda at: f'{{"timestamp":"{at}","km_from_current":10.5}}'
    many = "[" + ",".join(f'"M-{i}"' for i in range(16)) + ',"MERC-016"]'
    return [
        ("sound", body_with()), ("empty", ""), ("garbage", "no json"),
        *[(f"no_{name}", body_with(drop=name)) for name in _SOUND],
        ("last_is_empty", body_with(last_transaction="{}")), ("exponent", body_with(transaction=tx(amount="1e3"))),
        ("negative_whole", body_with(transaction=tx(n="-1"))), ("broken_whole", body_with(transaction=tx(n="2.5"))),
        ("no_average", body_with(customer=customer(avg=""))), ("zero_average", body_with(customer=customer(avg='"avg_amount":0,'))),
        ("seventeenth_merchant", body_with(customer=customer(known=many))), ("no_merchants", body_with(customer=customer(known="[]"))),
        ("short_code", body_with(merchant=merchant("54"))), ("long_code", body_with(merchant=merchant("54119"))), ("other_code", body_with(merchant=merchant("1234"))),
        ("spaced", body_with(transaction='{"amount" : 41.12, "installments" : 2, "requested_at" : "2026-03-11T18:45:53Z"}')),
        ("last_is_later", body_with(last_transaction=last("2026-03-11T19:00:00Z"))), ("last_is_old", body_with(last_transaction=last("2026-03-01T00:00:00Z"))),
        ("seconds_dropped", body_with(transaction=tx(at="2026-03-11T18:45:00Z"), last_transaction=last("2026-03-11T18:44:59Z"))),
        ("over_midnight", body_with(transaction=tx(at="2026-03-12T00:01:00Z"), last_transaction=last("2026-03-11T23:59:00Z"))),
        ("short_time", body_with(transaction=tx(at="2026-03-11T18:45:53"))), ("bad_month", body_with(transaction=tx(at="2026-13-11T18:45:53Z"))),
        ("reversed", body_with(order=list(_SOUND)[::-1])),
    ]
