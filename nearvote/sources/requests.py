"""Raw HTTP requests as rows: framing, headers and routing as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_length(request: Column) -> Column:
    """The header's value whatever its letters' case; null without one."""
    head = F.split(request, "\r\n\r\n", 2)[0]
    found = F.regexp_extract(head, "(?i)\r\ncontent-length:[ \t]*([0-9]+)", 1)
    return F.when(found != "", found.cast("bigint"))


def body_of(request: Column) -> Column:
    """As many characters after the headers as the length says; without one, an empty body."""
    rest = F.coalesce(F.get(F.split(request, "\r\n\r\n", 2), F.lit(1)), F.lit(""))
    return F.substring(rest, F.lit(1), F.coalesce(content_length(request), F.lit(0)).cast("int"))


def route(request: Column) -> Column:
    """score for any method that begins with P, ready for GET /ready, else not_found."""
    path = F.coalesce(F.get(F.split(request, "[ \r\n]"), F.lit(1)), F.lit(""))
    is_get = F.startswith(request, F.lit("GET "))
    return F.when(F.startswith(request, F.lit("P")), "score").when(is_get & (path == "/ready"), "ready").otherwise("not_found")


def route_requests(requests: DataFrame, request: str = "request") -> DataFrame:
    r = F.col(request)
    status = F.when(F.col("route") == "not_found", 404).otherwise(200)
    return requests.withColumn("route", route(r)).withColumns({"status": status, "body": F.when(F.col("route") == "score", body_of(r))})


def socket_list(paths: Column) -> Column:
    """Targets of a comma-separated list: trimmed, without empty ones, 16 at most."""
    return F.slice(F.filter(F.transform(F.split(paths, ","), lambda p: F.trim(p)), lambda p: p != ""), 1, 16)
