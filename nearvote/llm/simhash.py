"""SimHash near-duplicates by pigeonring filtering.

Fingerprint: A-Z are lower-cased, words are runs of bytes other than space and
0x09-0x0D, shingles are so many (four) consecutive words joined by a space
(repeats included; a shorter text is one shingle). A fingerprint bit is 1 if it is set
in over half of the shingles' XXH64 values (seed 42). A text without words has
fingerprint zero and is linked like any other; so has a null text.

Search: the 64 bits form a ring of ``m`` segments. If two fingerprints differ in
at most ``tau`` bits, some segment starts a chain in which the differences of
the first l segments sum to at most l * tau / m, for every l up to m (the
pigeonring principle). With m = 5 and tau = 4 the budgets are 0, 1, 2, 3, 4: the
first segment of the chain is equal and the second differs in at most one bit,
which a hash join on 26 bits finds from at most 14 probes; the longer prefixes
of the chain are then tested one after the other before the full distance.

Verified search (``similar``): where links are to follow the Jaccard similarity
of the texts' shingle sets, fingerprints only find candidates. At a similarity of
0.8 two fingerprints differ in some 15 % of their bits, beyond any radius that
can be searched without reading most of the table. So several independent
families of fingerprints are searched, each from ``m`` places on the ring: a
chain begins with ``window`` equal bits, and its longer prefixes must stay
within budgets in proportion to a radius. ``plan_search`` takes window and
families from the number of texts, so that a bucket holds some ``MATES`` texts
that are unlike at any size, and a pair at the threshold meets with probability
``RECALL``. Pairs left by the ring are compared over the bits of all families
(at least ``LEAST_FAMILIES``) and then exactly on whole sets. Members of a bucket
are first compared to two of its members only, so that a large group of near
copies becomes one component by a few comparisons a member; then all pairs of
different components in a bucket are, never those within one large component.
Crowded buckets and those of large components are compared by blocks (``groups``):
components whose members' fingerprints allow a link, in a chain, become a group, and
within each group all pairs of different components are compared exactly.

Defined results: rows are grouped by fingerprint (or set), so repeated rows,
repeated doc_ids and rows without doc_id each get the component of their text; a
component's id is its smallest non-null doc_id (null if it has none). An empty
table gives an empty result; a text of any length is read whole, a part of its
shingles at a time; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import groups
from .common import discard, lookup, materialise
from .shingles import BROADCAST_ROWS, _mixed, names, sets_of, shingle_hashes, shingle_set, signed, verified
from .tokens import give_back

BITS = 64
CHUNK = 1 << 15  # shingles whose bits are counted at once


def _family(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of another family: 0 is XXH64 itself."""
    return _mixed(hashes, np.uint64(n)) if n else hashes


#: Families of fingerprints as (words in a shingle, number of the hash family); the first one names the rows' classes.
Families = tuple[tuple[int, int], ...]
CONTRACT: Families = ((4, 0),)


def fingerprints(text: str | None, families: Families = CONTRACT) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return [0] * len(families)
    line = b" ".join(words)
    hashes = {width: shingle_hashes(words, line, width) for width in {w for w, _ in families}}
    out = []
    for width, n in families:
        ones, own = np.zeros(BITS, dtype=np.int64), hashes[width]
        for at in range(0, len(own), CHUNK):
            part = _family(own[at : at + CHUNK], n).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big"))
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", families: Families = CONTRACT, with_sha: bool = False) -> DataFrame:
    """(doc_id, fp, more) per row: 64 bits as a signed long, and those of the further families; with_sha adds the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [list(map(signed, fingerprints(texts[i].as_py(), families))) for i in range(len(texts))]
            out = {"doc_id": batch.column(0), "fp": pa.array([f[0] for f in fps], pa.int64()), "more": pa.array([f[1:] for f in fps], pa.list_(pa.int64()))}
            if with_sha:
                out["sha"] = pa.array([hashlib.sha256((texts[i].as_py() or "").encode("utf-8")).digest() for i in range(len(texts))], pa.binary())
            yield pa.RecordBatch.from_pydict(out)
            give_back()

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, fp long, more array<long>" + (", sha binary" if with_sha else ""))


def ring(tau: int, m: int) -> tuple[list[int], list[int]]:
    """Widths of the ring's segments, and the budget of a chain of 1..m segments."""
    widths = [BITS // m + (i < BITS % m) for i in range(m)]
    return widths, [(n * tau) // m for n in range(1, m + 1)]


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _chain(x: Column, start: Column, widths: list[int], budgets: list[int], first: int) -> Column:
    """Whether the chain at ``start`` stays in its budgets: prefixes of ``first`` segments and more in turn, the whole ring last."""
    m, near = len(widths), F.lit(True)
    for length in range(first, m):
        bits = [sum(widths[(i + j) % m] for j in range(length)) for i in range(m)]
        shift = F.element_at(F.array(*[F.lit(BITS - n) for n in bits]), start + 1)
        near = near & (F.bit_count(F.call_function("shiftrightunsigned", x, shift)) <= budgets[length - 1])
    return near & (F.bit_count(x) <= budgets[-1])


def links(fps: DataFrame, tau: int = 4, m: int = 5) -> DataFrame:
    """Pairs (a, b) of the nodes in ``fps(node, fp)`` with fingerprints at most ``tau`` bits apart, each at least once.

    Rows made before the filters: m index rows and on average 1 + width/2 probe
    rows per start, so linear in the input. A pair whose second segments differ
    is probed from the side whose bit is 0 only. Needs budgets 0 and 1 for the
    first two segments of a chain.
    """
    widths, budgets = ring(tau, m)
    if budgets[:2] not in ([0, 0], [0, 1]) or budgets[-1] != tau:
        raise ValueError("choose m > tau, with budget 0 for one segment and at most 1 for two")
    offsets = [sum(widths[:i]) for i in range(m)]
    pair = [widths[i] + widths[(i + 1) % m] for i in range(m)]
    starts = F.array(*[
        F.struct(F.lit(i).alias("start"), _rotated(F.col("fp"), offsets[i]).alias("v"), F.shiftleft(F.lit(i).cast("long"), 60).bitwiseOR(F.shiftrightunsigned(_rotated(F.col("fp"), offsets[i]), BITS - pair[i])).alias("k"))
        for i in range(m)
    ])
    index = fps.select("node", F.explode(starts).alias("s")).select("node", "s.*")
    seconds = [widths[(i + 1) % m] for i in range(m)]
    flips = [
        F.when((F.col("start").isin([i for i in range(m) if b < seconds[i]])) & (F.shiftrightunsigned("k", b).bitwiseAND(F.lit(1)) == 0), F.col("k").bitwiseOR(F.lit(1 << b)))
        for b in range(max(seconds))
    ] if budgets[1] else []
    probes = index.select("node", "v", F.col("start"), F.explode(F.array(F.col("k"), *flips)).alias("key"), "k").where(F.col("key").isNotNull())
    a, b = probes.alias("a"), index.select(F.col("k").alias("key"), F.col("v").alias("w"), F.col("node").alias("other")).alias("b")
    x = F.col("v").bitwiseXOR(F.col("w"))
    near = (F.col("a.key") != F.col("k")) | (F.col("v") < F.col("w")) | ((F.col("v") == F.col("w")) & (F.col("node") < F.col("other")))
    near = near & _chain(x, F.col("start"), widths, budgets, 3)
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & near)
    return found.select(F.col("node").alias("a"), F.col("other").alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs(a, b)``; root is the component's smallest node.

    Alternates large-star and small-star steps until nothing changes. Each step
    is a partial aggregate and a skew-safe lookup, written to the shared folder;
    nothing is collected but a row count and a checksum.
    """
    edges = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = materialise(lookup(both, least, ["u"], ["m"], "n", 2 * before[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        total = large.count()
        moved = lookup(large, least, ["u"], ["m"], "n", max(1, total))
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after_edges = materialise(small, "small")
        after = state(after_edges)
        discard(large)
        discard(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _family_links(nodes: DataFrame, tau: int, m: int) -> DataFrame:
    """Links over a further family: nodes of one fingerprint to the least of them, and those between different fingerprints."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("k"))
    least = materialise(least, "family")
    same = lookup(nodes, least.where("k > 1").withColumnRenamed("node", "least"), ["fp"], ["least"], "k", max(1, nodes.count()), how="inner")
    return links(least.select("node", "fp"), tau, m).unionByName(same.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 4, m: int = 5, families: Families = CONTRACT, with_sha: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (and sha), component_id (smallest doc_id reachable over links), root (a fingerprint that names the component).

    With more ``families``, texts are linked that are within ``tau`` bits in any one:
    more of the near copies whose first fingerprints happen to be further apart.
    """
    sig = materialise(signatures(docs, id_col, text_col, families, with_sha), "signatures")
    classes = materialise(sig.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "classes")
    total = sig.count()
    found = links(classes.select(F.col("fp").alias("node"), "fp"), tau, m)
    for n in range(len(families) - 1):
        found = found.unionByName(_family_links(sig.select(F.col("fp").alias("node"), F.get("more", F.lit(n)).alias("fp")).distinct(), tau, m))
    roots = materialise(components(found), "roots")
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "root", "least_id")
    tops = linked.groupBy("root").agg(F.min("least_id").alias("top"), F.count("*").alias("k"))
    grouped = lookup(linked.select("fp", "root"), tops, ["root"], ["top"], "k", max(1, roots.count()))
    named = classes.join(grouped, "fp", "left")
    named = named.select("fp", "n", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("top")).alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return lookup(sig.drop("more"), named, ["fp"], ["root", "component_id"], "n", max(1, total))


#: Words in a shingle and the least similarity, as a fraction so that 0.8 is exact.
WIDTH, SIMILARITY = 5, (4, 5)
MATES, RECALL = 16, 0.98
LEAST_FAMILIES = 16  # that texts are compared by; fewer may be searched
SHORT = 64  # shingles below which an even vote is so frequent that bits differ more than the angle tells
STARTS = 5  # segments of the ring
CROWDED = 4  # times MATES; a bucket with more members is compared by blocks
NEAREST = 4  # of its buckets' least and largest members that a node is compared to first
LARGE = 32  # members from which a component's own pairs are kept out of the buckets' joins


def _differ(similarity: tuple[int, int]) -> float:
    """Share of bits in which the fingerprints of two sets of that Jaccard similarity differ, by their angle."""
    j = similarity[0] / similarity[1]
    return math.acos(2 * j / (1 + j)) / math.pi


@cache
def plan_search(n: int, similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> tuple[int, int, int]:
    """(window, families, tau) for ``n`` texts: bits that are equal at a chain's start, fingerprints per text, radius."""
    window = min(44, max(8, math.ceil(math.log2(max(2, n) / MATES))))
    p, offsets = _differ(similarity), _offsets()
    same = np.random.default_rng(0).random((100_000, BITS)) >= p
    hit = np.zeros(len(same), bool)
    for at in offsets:
        hit |= np.take(same, range(at, at + window), axis=1, mode="wrap").all(axis=1)
    families = max(3, math.ceil(math.log(1 - recall) / math.log(1 - max(float(hit.mean()), 1e-4))))
    rest = BITS - window
    return window, families, math.ceil(rest * p + 2.75 * math.sqrt(rest * p * (1 - p)))


def _offsets() -> list[int]:
    widths, _ = ring(STARTS, STARTS)
    return [sum(widths[:i]) for i in range(STARTS)]


def set_fingerprints(grams: np.ndarray, count: int) -> list[int]:
    """Signed fingerprints of a set under ``count`` families."""
    if not len(grams):
        return []
    numbers, ones = np.arange(1, count + 1, dtype=np.uint64)[:, None], np.zeros((count, BITS), np.int64)
    step = max(1, CHUNK // (4 * count))
    for at in range(0, len(grams), step):
        part = _mixed(grams[None, at : at + step], numbers).astype(">u8").view(np.uint8).reshape(count, -1, 8)
        ones += np.unpackbits(part, axis=2).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(grams), axis=1).view(">i8").ravel().tolist()


def _set_signatures(docs: DataFrame, id_col: str, text_col: str, width: int, count: int) -> DataFrame:
    """(doc_id, sha, node, size, fps) per row; a text without words has no fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                held = [texts[i].as_py() for i in range(at, min(at + 256, len(texts)))]
                sets = [shingle_set(t, width) for t in held]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, len(held)),
                    "sha": pa.array([hashlib.sha256((t or "").encode("utf-8")).digest() for t in held], pa.binary()),
                    "node": names(sets),
                    "size": pa.array([len(s) for s in sets], pa.int32()),
                    "fps": pa.array([set_fingerprints(s, count) for s in sets], pa.list_(pa.int64())),
                })
            give_back()

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, sha binary, node long, size int, fps array<long>")


def _key(fp: Column, slot: Column, at: int, window: int) -> Column:
    """The slot and the first ``window`` bits of the fingerprint turned by ``at``."""
    return F.shiftleft(slot.cast("long"), window).bitwiseOR(F.shiftrightunsigned(_rotated(fp, at), BITS - window))


def _members(nodes: DataFrame, window: int, families: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, node, v, start, more): a row for every family and start; v is the fingerprint turned to the start, key names family, start and window."""
    places = F.flatten(F.transform(F.slice("fps", 1, families), lambda fp, f: F.array(*[
        F.struct(F.lit(i).alias("start"), _rotated(fp, at).alias("v"), (f * STARTS + i).cast("long").alias("slot")) for i, at in enumerate(_offsets())
    ])))
    rows = nodes.select("node", *extra, F.explode(places).alias("p"))
    return rows.select(_key(F.col("p.v"), F.col("p.slot"), 0, window).alias("key"), "node", F.col("p.v").alias("v"), F.col("p.start").alias("start"), *extra)


def _first_start(x: Column, start: Column, window: int) -> Column:
    """Whether no earlier start of the family has a window without differences, so that a pair comes from one start only; x is turned to ``start``."""
    at, first = _offsets(), F.lit(True)
    for i in range(1, STARTS):
        equal = [F.shiftrightunsigned(_rotated(x, (at[j] - at[i]) % BITS), BITS - window) == 0 for j in range(i)]
        first = F.when(start == i, ~reduce(Column.__or__, equal)).otherwise(first)
    return first


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, sha, root) per row of ``docs``; root names the component over links of at least ``similarity``."""
    window, searched, tau = plan_search(docs.count(), similarity, recall)
    widths, budgets = ring(tau, STARTS)
    count = max(searched, LEAST_FAMILIES)
    sig = materialise(_set_signatures(docs, id_col, text_col, width, count), "signatures")
    nodes = materialise(sig.groupBy("node").agg(F.first("size").alias("size"), F.first("fps").alias("fps"), F.min("sha").alias("sha"), F.count("*").alias("n")), "nodes")
    part, whole = similarity
    p, bits = _differ(similarity), BITS * count
    most, loose = math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p))), int(bits * (0.5 + p) / 2)

    def alike(a: str, b: str) -> Column:
        """Whether sizes and the bits of all families of ``size_a, fps_a`` and ``size_b, fps_b`` allow a link."""
        apart = F.aggregate(F.zip_with(f"fps_{a}", f"fps_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        less, more = F.least(f"size_{a}", f"size_{b}"), F.greatest(f"size_{a}", f"size_{b}")
        return (less * whole >= more * part) & (apart <= F.when(less < SHORT, loose).otherwise(most))

    def near(pairs: DataFrame) -> DataFrame:
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("fps").alias(f"fps_{c}"))
        return pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(alike("a", "b")).select("a", "b")

    def links_of(found: DataFrame, name: str) -> DataFrame:
        found = materialise(found, f"{name}-pairs")
        ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
        sets = materialise(sets_of(docs, nodes.join(ends, "node", "left_semi").select("sha"), width, text_col), f"{name}-sets")
        out = materialise(verified(found, sets, similarity), name)
        discard(sets)
        discard(found)
        return out

    within = lambda v, w: _chain(v.bitwiseXOR(w), F.col("start"), widths, budgets, 2)
    rows = _members(nodes, window, searched)
    picks = [c for i, (f, by) in enumerate(((F.min, F.min_by), (F.max, F.max_by))) for c in (f("node").alias(f"least{i}"), by("v", "node").alias(f"w{i}"))]
    buckets = materialise(rows.groupBy("key").agg(F.count("*").alias("k"), *picks).where("k > 1"), "buckets")
    spread = lookup(rows, buckets, ["key"], [f"{c}{i}" for i in range(2) for c in ("least", "w")], "k", max(1, buckets.agg(F.sum("k")).first()[0] or 0), how="inner")
    hits = F.filter(F.array(*[F.when((F.col("node") != F.col(f"least{i}")) & within(F.col("v"), F.col(f"w{i}")), F.col(f"least{i}")) for i in range(2)]), lambda x: x.isNotNull())
    # Of a node's hits the nearest few: what these leave apart, the buckets' joins compare again.
    hits = F.transform(hits, lambda x: F.struct(F.bit_count(F.col("v").bitwiseXOR(F.when(x == F.col("least0"), F.col("w0")).otherwise(F.col("w1")))).alias("apart"), x.alias("b")))
    stars = spread.select(F.col("node").alias("a"), F.explode(hits).alias("hit")).select("a", F.greatest("a", "hit.b").alias("more"), F.least("a", "hit.b").alias("less"), "hit.apart")
    stars = stars.groupBy("a", "more", "less").agg(F.min("apart").alias("apart"))
    stars = stars.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("apart", "more", "less"))), 1, NEAREST).alias("hits")).select(F.explode("hits").alias("hit"))
    stars = links_of(near(stars.select(F.col("hit.more").alias("a"), F.col("hit.less").alias("b"))), "stars")
    crowded = materialise(buckets.where(F.col("k") > CROWDED * MATES).select("key"), "crowded")
    discard(buckets)
    roots = materialise(components(stars), "roots")

    size = roots.groupBy("root").agg(F.count("*").alias("members"))
    placed = nodes.join(roots.join(size, "root"), "node", "left")
    placed = materialise(placed.select("node", "size", "fps", F.coalesce("root", "node").alias("c"), (F.coalesce("members", F.lit(1)) > LARGE).alias("large")), "placed")
    lean = _members(placed.where("not large"), window, searched, ("c",)).join(crowded, "key", "left_anti").select("key", "node", "v", "c")
    start, x = F.pmod(F.shiftrightunsigned("a.key", window), F.lit(STARTS)).cast("int"), F.col("a.v").bitwiseXOR(F.col("b.v"))
    close = (F.col("a.c") < F.col("b.c")) & _chain(x, start, widths, budgets, 2) & _first_start(x, start, window)
    met = lean.alias("a").join(lean.alias("b"), (F.col("a.key") == F.col("b.key")) & close)  # both sides alike, so they are shuffled once
    more = links_of(near(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))), "rest")

    # Crowded buckets and those with members of a large component: no pair becomes a row.
    held = _members(placed.where("large"), window, searched, ("c",)).select("key").unionByName(crowded).distinct()
    held = materialise(held, "dense")
    if many := held.count():
        held = F.broadcast(held) if many <= BROADCAST_ROWS else held
        dense = _members(placed, window, searched, ("c", "large")).select("key", "node", "c", "large").join(held, "key", "left_semi")
        mixed = dense.groupBy("key").agg((F.min("c") != F.max("c")).alias("mixed")).where("mixed").select("key")
        dense = dense.join(mixed, "key", "left_semi").join(placed.select("node", "size", "fps"), "node")
        kinds = materialise(components(groups.alike(dense, similarity, SHORT, loose, most)), "kinds")
        dense = placed.select("node", "c", "large", "size").join(kinds.select(F.col("node").alias("c"), F.col("root").alias("key")), "c")
        dense = materialise(dense, "dense-nodes")
        sets = sets_of(docs, nodes.join(dense.select("node"), "node", "left_semi").select("sha"), width, text_col)
        more = more.unionByName(materialise(groups.verified(dense.join(sets, "node"), similarity), "dense-links"))
    if more.limit(1).count():
        roots = materialise(components(stars.unionByName(more)), "roots")
    count_of = nodes.select("node", "n").join(roots, "node")
    found = lookup(sig.select("doc_id", "sha", "node"), count_of, ["node"], ["root"], "n", max(1, sig.count()))
    return found.select("doc_id", "sha", F.coalesce("root", "node").alias("root"))


def kept(found: DataFrame) -> DataFrame:
    """(doc_id, sha) of the row of each component that stays: the smallest doc_id, then the smallest hash of the text."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha"))
    return found.groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.sha")


def hex_fingerprint(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
