"""Sets of word shingles and their exact Jaccard similarity, by which SimHash candidates are verified.

Words and their folding are those of ``simhash``; a text's set holds the XXH64
values (seed 42) of its runs of ``width`` consecutive words, a shorter text's
that of all its words. Texts of one set are one node, named by a hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, sha_of
from .tokens import give_back


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mixed(hashes: np.ndarray, n: np.uint64 | np.ndarray) -> np.ndarray:
    """Hashes mixed with a constant of their family's own."""
    with np.errstate(over="ignore"):
        z = hashes + n * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


def shingle_hashes(words: list[bytes], line: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; ``line`` holds the words joined by a space."""
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(words) - width + 1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(shingle_hashes(words, b" ".join(words), width)) if words else np.zeros(0, np.uint64)


def names(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([signed(xxh64_intdigest(s.tobytes(), 42)) for s in sets], pa.int64())


#: Hashes of texts that are broadcast, 32 bytes each; more are joined by a shuffle of the texts.
BROADCAST_ROWS = 200_000


def sets_of(docs: DataFrame, wanted: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """(node, grams), one row per node, of the texts that ``wanted(sha)`` lists; sets of other texts are not made again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, width) for t in batch.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_pydict({"node": names(sets), "grams": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})
            give_back()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), sha_of(text_col).alias("sha"))
    wanted = materialise(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    rows = rows.join(wanted, "sha", "left_semi").select("text")
    return rows.mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets, of ``sets(node, grams)``, have a similarity of at least ``threshold``, a fraction."""
    part, whole = threshold
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    rows = rows.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return rows.where(both * whole >= (F.size("x") + F.size("y") - both) * part).select("a", "b")
