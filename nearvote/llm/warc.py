"""Resolution of not-modified revisit records in web archives.

A revisit record (status 304, no payload) is given the latest earlier full
response (status 200) of the same canonical URL: an as-of join. Their validators
are checked (entity tags compared weakly, else dates of last modification, and
payload digests where both have one) and the stored headers are updated with
those of the revisit that may be (not those that describe the payload).

Scale: one range shuffle of lean rows by (URL, time), so a URL with a third of
all records spreads over many tasks. Each sorted partition is filled forward in
a stream; the last response of a partition, one row of it, is carried to the
next ones that begin with the same URL. Payloads are never shuffled.

Defined results: earlier is strictly earlier; of responses of the same time the
largest record_id counts; a null URL or time matches nothing; repeated revisit
rows are resolved one by one; a revisit without an earlier response is
``no_response``; one whose validators differ ``mismatch`` (no headers merged);
one without any comparable validator ``unchecked``; else ``resolved``. Header
names differ by more than case: the different values of names that differ only in
case are joined by ", ", sorted by name and value. URLs and headers of any length
are used whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Headers of a 304 that don't update the stored ones, as they describe a payload or a connection.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that don't name another page.
TRACKING = "(utm_[a-z]+|gclid|fbclid|ref|phpsessid|jsessionid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Host (lower case, without www. and default port), path without end slash, sorted query without tracking parameters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, "^[^?]*[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING}(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """The map with names in lower case; values of names that then are equal are joined."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    values = lambda n: F.array_distinct(F.transform(F.filter(entries, lambda e: (F.lower(e["key"]) == n) & e["value"].isNotNull()), lambda e: e["value"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.when(F.size(values(n)) > 0, F.array_join(values(n), ", "))))


LEAN = ["url", "ts", "is_response", "record_id", "headers", "digest"]
FILLED = "url string, ts long, record_id long, headers string, digest string, r_id long, r_headers string, r_digest string, part int, pending boolean, tail boolean"


def _as_of(records: DataFrame) -> DataFrame:
    """Revisits with the response found in their partition; a tail row per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, url, held = None, None, None  # first and current URL; (id, headers, digest) of its last response
        for batch in batches:
            out: dict[str, list] = {f.split()[0]: [] for f in FILLED.split(", ")}
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != url:
                    url, held = row[0], None
                    first = url if first is None else first
                if row[2]:
                    held = row[3], row[4], row[5]
                else:
                    values = (row[0], row[1], row[3], row[4], row[5], *(held or (None, None, None)), part, held is None and url == first, False)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=SHAPE)
        if url is not None:
            values = (url, None, None, None, None, *(held or (None, None, None)), part, held is None and url == first, True)
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(SHAPE.names, values, strict=True)}, schema=SHAPE)

    order = [F.col("url"), F.col("ts"), F.col("is_response"), F.col("record_id")]  # at the same time revisits come first
    return records.select(*LEAN).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FILLED)


SHAPE = pa.schema([
    ("url", pa.string()), ("ts", pa.int64()), ("record_id", pa.int64()), ("headers", pa.string()), ("digest", pa.string()),
    ("r_id", pa.int64()), ("r_headers", pa.string()), ("r_digest", pa.string()), ("part", pa.int32()), ("pending", pa.bool_()), ("tail", pa.bool_()),
])


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, kind (response or revisit), status, url, ts, headers (map), digest.

    One row per revisit: record_id, canonical_url, ts, outcome, response_id, digest, headers (merged map).
    """
    spark = records.sparkSession
    keyed = records.select(canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("is_response"), F.col("record_id").cast("long").alias("record_id"), F.to_json(lower_names(F.col("headers"))).alias("headers"), "digest", "status", "kind")
    sound = F.col("url").isNotNull() & F.col("ts").isNotNull()
    used = keyed.where(sound & ((F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("status") == 200))))
    filled = materialise(_as_of(used), "revisits")
    carried, rows = None, []
    for tail in filled.where("tail").orderBy("part").collect():  # one per shuffle partition
        if carried is not None:
            rows.append((tail["part"], carried["url"], carried["r_id"], carried["r_headers"], carried["r_digest"]))
        if tail["r_id"] is not None:
            carried = tail
        elif carried is not None and tail["url"] != carried["url"]:
            carried = None
    ahead = spark.createDataFrame(rows, "part int, url string, c_id long, c_headers string, c_digest string")
    found = filled.where("NOT tail").join(F.broadcast(ahead), ["part", "url"], "left")
    take = lambda name: F.when(F.col("pending"), F.col(f"c_{name}")).otherwise(F.col(f"r_{name}"))
    found = found.select("record_id", "url", "ts", "headers", "digest", take("id").alias("response_id"), take("headers").alias("r_headers"), take("digest").alias("r_digest"))
    odd = keyed.where(~sound & (F.col("kind") == "revisit"))
    found = found.unionByName(odd.select("record_id", "url", "ts", "headers", "digest", F.lit(None).cast("long").alias("response_id"), F.lit(None).cast("string").alias("r_headers"), F.lit(None).cast("string").alias("r_digest")))
    fields = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    found = found.withColumns({"new": fields(F.col("headers")), "old": fields(F.col("r_headers"))})
    tag = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^W/", "")
    date = lambda m: F.element_at(m, "last-modified")
    by_tag, by_date = tag(F.col("new")) == tag(F.col("old")), date(F.col("new")) == date(F.col("old"))
    validators = F.coalesce(by_tag, by_date)
    digests = F.col("digest") == F.col("r_digest")
    outcome = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when((validators == F.lit(False)) | (digests == F.lit(False)), "mismatch")
        .when(validators.isNull() & digests.isNull(), "unchecked")
        .otherwise("resolved")
    )
    permitted = F.map_filter("new", lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    found = found.withColumn("outcome", outcome).withColumn("merged", merged)
    good = F.col("outcome").isin("resolved", "unchecked")
    return found.select("record_id", F.col("url").alias("canonical_url"), "ts", "outcome", "response_id", F.when(good, F.col("r_digest")).alias("digest"), F.when(good, F.col("merged")).alias("headers"))


def header_lines(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def crawl_log(pages: DataFrame) -> DataFrame:
    """Capture records from pages: each page's response, and a later visit of its URL, written another way, that was answered 304.

    Every 5th visit has another entity tag, every 7th a date in place of it (every
    14th another date), every 13th came before the response, every 11th has a digest.
    """
    sha, n = F.sha2(F.coalesce("html", F.lit("")), 256), F.col("page_id").cast("long")
    base = pages.select(n.alias("n"), F.col("url"), sha.alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    n = F.col("n")
    tag = F.concat(F.lit('"'), F.substring("sha", 1, 16), F.lit('"'))
    modified = (n * 60 - n % 7).cast("string")
    stored = [("content-type", F.lit("text/html; charset=utf-8")), ("content-length", F.col("size").cast("string")), ("etag", tag), ("last-modified", modified), ("date", (n * 60).cast("string")), ("cache-control", F.lit("max-age=60"))]
    sent = [
        ("etag", F.when(n % 7 == 0, None).when(n % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))),
        ("last-modified", F.when(n % 14 == 0, F.lit("0")).when(n % 7 == 0, modified)),
        ("content-length", F.lit("0")), ("date", (n * 60 + 90).cast("string")), ("cache-control", F.lit("max-age=120")),
    ]
    as_map = lambda pairs: F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    again = F.when(n % 3 == 0, F.concat("url", F.lit("#seen"))).when(n % 3 == 1, F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.contains(F.col("url"), F.lit("?")), "&utm_campaign=x").otherwise("?utm_campaign=x"))).otherwise(F.concat(F.lit("HTTPS://WWW."), F.regexp_replace("url", "^[a-z]+://", "")))
    digest = F.concat(F.lit("sha256:"), F.col("sha"))
    responses = base.select((2 * n).alias("record_id"), F.lit("response").alias("kind"), F.lit(200).alias("status"), "url", (n * 60).alias("ts"), as_map(stored).alias("headers"), digest.alias("digest"))
    revisits = base.select((2 * n + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("url"), F.when(n % 13 == 0, n * 60 - 1).otherwise(n * 60 + 90).alias("ts"), as_map(sent).alias("headers"), F.when(n % 11 == 0, digest).alias("digest"))
    return responses.unionByName(revisits)
