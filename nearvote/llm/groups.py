"""Links between the members of large groups, found by blocks of rows: no row is made per pair.

The rows of a group (``key``) are dealt to blocks of at most about ``ROWS``; those of one large
component have blocks of their own, which don't meet each other. Each pair of blocks is one row,
in which all pairs are compared by matrix products, and gives a spanning forest of the pairs that
match, so at most a row per member of the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise
from .linedup import _common
from .tokens import give_back

ROWS = 512  # in a block
VOLUME = 1 << 19  # hashes in a block of sets, beside one larger set


def block_pairs(rows: DataFrame, fields: list[str], volume: str | None = None) -> DataFrame:
    """(xs, ys) of ``rows(key, c, large, node, *fields)``; ys is null where a block meets itself."""
    rows = materialise(rows.withColumn("own", F.when(F.col("large"), F.col("c")).otherwise(F.lit(0))), "group-rows")  # read three times
    by = ["key", "large", "own"]
    chunks = F.ceil(F.count("*") / ROWS)
    if volume:
        chunks = F.greatest(chunks, F.ceil(F.sum(volume) / VOLUME))
    sizes = materialise(rows.groupBy(*by).agg(F.count("*").alias("k"), chunks.cast("int").alias("chunks")), "group-sizes")
    # A group of one block without another to meet is left out if it is of one component.
    kinds = rows.groupBy("key").agg((F.min("c") != F.max("c")).alias("mixed")).where("mixed").select("key")
    rows = lookup(rows, sizes, by, ["chunks"], "k", max(1, sizes.agg(F.sum("k")).first()[0] or 0), how="inner").join(kinds, "key", "left_semi")
    blocks = rows.groupBy(*by, F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("block")).agg(F.collect_list(F.struct("node", "c", *fields)).alias("xs"))
    blocks = materialise(blocks, "group-blocks")
    place = lambda t: F.struct(*[F.col(f"{t}.{c}") for c in ("large", "own", "block")])
    meet = (F.col("a.key") == F.col("b.key")) & (place("a") <= place("b")) & ~(F.col("a.large") & F.col("b.large") & (F.col("a.own") == F.col("b.own")))
    pairs = blocks.alias("a").join(blocks.alias("b"), meet)
    return pairs.select(F.col("a.xs").alias("xs"), F.when(place("a") != place("b"), F.col("b.xs")).alias("ys"))


def forest(match: np.ndarray) -> list[tuple[int, int]]:
    """Places of a spanning forest of the graph between rows and columns."""
    rows, columns, out = match.any(axis=1), match.any(axis=0), []
    for start in range(len(rows)):
        waiting = [(start, True)] if rows[start] else []
        rows[start] = False
        while waiting:
            at, is_row = waiting.pop()
            others = columns if is_row else rows
            for other in np.flatnonzero((match[at] if is_row else match[:, at]) & others).tolist():
                others[other] = False
                waiting.append((other, not is_row))
                out.append((at, other) if is_row else (other, at))
    return out


def _linked(pairs: DataFrame, name: str, read: Callable, matches: Callable) -> DataFrame:
    """(a, b) by the field ``name``; ``read`` makes of a block what ``matches`` compares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for column in (batch.column(0), batch.column(1)):
                    if column[i].is_valid:
                        lo, hi = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
                        held = column.values.slice(lo, hi - lo)
                        sides.append((held.field("c").to_numpy(), held.field(name).to_numpy(), read(held)))
                x, y = sides[0], sides[-1]
                found = forest(matches(x[2], y[2]) & (x[0][:, None] != y[0][None]))
                ends = np.array([sorted((x[1][i], y[1][j])) for i, j in found], np.int64).reshape(-1, 2)
                ends = np.unique(ends, axis=0)
                if len(ends):
                    yield pa.RecordBatch.from_pydict({"a": ends[:, 1], "b": ends[:, 0]})
            give_back()

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _list(held: pa.StructArray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, values) of a field of lists."""
    lists = held.field(name)
    ends = lists.offsets.to_numpy()
    return np.diff(ends), lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy()


def alike(rows: DataFrame, similarity: tuple[int, int], short: int, loose: int, most: int) -> DataFrame:
    """Pairs of components that hold, in one group of ``rows(key, c, large, node, size, fps)``, members whose sizes and
    fingerprints allow a link: enough of them to connect what such pairs connect."""
    part, whole = similarity

    def read(held: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        _, values = _list(held, "fps")
        bits = np.unpackbits(values.view(np.uint8).reshape(len(held), -1), axis=1)
        return held.field("size").to_numpy().astype(np.int64), bits.astype(np.float32) * 2 - 1

    def matches(x: tuple, y: tuple) -> np.ndarray:
        less, more = np.minimum(x[0][:, None], y[0][None]), np.maximum(x[0][:, None], y[0][None])
        apart = (x[1].shape[1] - x[1] @ y[1].T) / 2
        return (less * whole >= more * part) & (apart <= np.where(less < short, loose, most))

    return _linked(block_pairs(rows, ["size", "fps"]), "c", read, matches)


def verified(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of nodes of different components in a group of ``rows(key, c, large, node, size, grams)`` whose sets have
    a similarity of at least ``similarity``: enough of them to connect what all such pairs connect."""
    part, whole = similarity

    def read(held: pa.StructArray) -> tuple[np.ndarray, tuple]:
        sizes, values = _list(held, "grams")
        return sizes, (np.repeat(np.arange(len(sizes)), sizes), values)

    def matches(x: tuple, y: tuple) -> np.ndarray:
        both = _common(x[1], len(x[0]), y[1], len(y[0]))
        return both * whole >= (x[0][:, None] + y[0][None] - both) * part

    return _linked(block_pairs(rows, ["grams"], "size"), "node", read, matches)
