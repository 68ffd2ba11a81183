"""Near-duplicate lines by an exact set-similarity join.

Texts are cut into word sets, and blocks of sets verified, by Arrow batches in Python: as
DataFrame functions, which came first, the cutting alone took more CPU than the whole operator
may, and verifying a large group of near copies some 15 microseconds a pair. Candidates are
found by DataFrame operations.

A line is the set of its words (lower case, between white space). Two lines
match if the Jaccard similarity of their sets is at least ``threshold``; of
matching lines, a later one (by doc_id, line number) is removed.

Lines with equal sets are one class, found by a partial aggregate, and need no
join. Among classes: words are ordered by rarity; two sets that match share one
of the words that come first, in a prefix of n - ceil(threshold n) + 1 words. At
the first word that they share, the words from there on must suffice (positional
filter), and their sizes must be near (length filter); a parity map of 64 bits
bounds the words in which they differ.

1. A left semi join on prefix words under these filters tells which classes can
   have a partner, and at which words; it makes at most a row per class and prefix word.
2. Whole sets are made for those classes only. They are gathered by these words in
   blocks of at most about ``CHUNK``, a frequent word's in several, and each pair
   of blocks is one row, in which a pair of sets is taken at the first word that
   it shares, verified by its exact Jaccard similarity (common words of all pairs are
   one product of 0/1 matrices, ``COLUMNS`` words at a time) and counted on the spot.
   So no row per pair is ever made, and a set moves once per prefix word and block.

Rarity is the count of a word's bucket among ``BUCKETS`` on a scale of logarithms
(all occurrences of all texts are counted), then its hash: any order common to
all lines gives exact results, a finer one only fewer candidates. The table of
levels, a byte per bucket, is the one thing sent to all tasks; its size is
fixed. A word is known by 56 bits of its hash and its bucket's level; that this
names each word of the verified sets once is checked by a second hash of 64 bits, else the
words themselves are compared. A class is known by 128 bits of its set.

Defined results: a line without words matches nothing and stays; a null text has
no lines; rows without doc_id are later than all others; rows that repeat doc_id
and line are the same line, of which none is later than the other. Lines of any
length are used whole; an empty table gives an empty result; columns other than
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import free_name, lookup, materialise
from .shingles import _mixed
from .tokens import give_back

BUCKETS = 1 << 20
STEPS = 4  # levels per doubling of a count; a at most 126 levels
SLOTS = 1 << 20  # of the filter that tells which lines are cut into sets again
CHUNK = 1024  # sets in a block
COLUMNS = 4096  # words that are compared at once
MARGIN = 1e-9


MEMO = 1 << 18  # sets that a task remembers to have sent
ROWS, CHARS = 256, 1 << 20  # texts, and about as many characters, that are cut at once
LONG = 64  # bytes of a word that are hashed word by word

#: The bytes between words, besides the line end; the constants of 64-bit FNV-1a.
BLANKS, LINE_END = b" \t\r\x0b\x0c", 10
FNV_START, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)

#: Of the second hash: an odd factor and its inverse modulo 2^64, a number for each byte.
UP = np.uint64(0x9E3779B97F4A7C15)
DOWN = np.uint64(pow(int(UP), -1, 1 << 64))
BYTES = _mixed(np.arange(1, 257, dtype=np.uint64), np.uint64(7))

BETWEEN = np.isin(np.arange(256), [*BLANKS, LINE_END])


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows of the first columns, in parts; ``column`` holds the text."""
    for batch in batches:
        held, chars = [], 0
        for i in range(batch.num_rows):
            held.append(tuple(batch.column(c)[i].as_py() for c in range(column + 1)))
            chars += len(held[-1][column])
            if len(held) >= ROWS or chars >= CHARS:
                yield held
                held, chars = [], 0
        if held:
            yield held


class _Cut:
    """The words of some texts: where they start and end in ``data``, their lines (numbered over all texts) and hashes."""

    def __init__(self, texts: list[str]) -> None:
        self.lines = np.array([t.count("\n") + 1 for t in texts])
        self.data = "\n".join([t.lower() for t in texts]).encode("utf-8", "surrogatepass")
        bytes_ = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(bytes_) + 2, np.int8)
        inside[1:-1] = ~BETWEEN[bytes_]
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.line = np.searchsorted(np.flatnonzero(bytes_ == LINE_END), self.starts)
        sizes = self.ends - self.starts
        short = np.minimum(sizes, LONG).astype(np.int16)
        order = np.argsort(-short, kind="stable")
        starts, held = self.starts[order], np.full(len(order), FNV_START)
        longer = len(short) - np.cumsum(np.bincount(short, minlength=LONG + 1))  # words of more than j bytes
        for j, k in enumerate(longer[:LONG].tolist()):
            if not k:
                break
            held[:k] = (held[:k] ^ bytes_[starts[:k] + j]) * FNV_PRIME
        hashes = np.empty_like(held)
        hashes[order] = held
        for i in np.flatnonzero(sizes > LONG):
            hashes[i] = xxh64_intdigest(self.data[self.starts[i] : self.ends[i]])
        self.hashes = _mixed(hashes, np.uint64(0))

    def _by_line(self, keys: np.ndarray) -> np.ndarray:
        """Order by line and key; by one number of both where that tells all keys apart, as it is sorted far sooner."""
        if len(self.line) and self.line[-1] < 1 << 15:
            both = self.line.astype(np.int64) << 48 | keys >> 15
            order = np.argsort(both)
            both, sorted_keys = both[order], keys[order]
            if not ((both[1:] == both[:-1]) & (sorted_keys[1:] != sorted_keys[:-1])).any():
                return order
        return np.lexsort((keys, self.line))

    def checks(self) -> np.ndarray:
        """A second hash of each word, a polynomial of its bytes, to tell words of one key apart."""
        bytes_ = np.frombuffer(self.data, np.uint8)
        ups, downs = _powers(1 << (len(bytes_) | 1).bit_length())
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[bytes_] * ups[: len(bytes_)], dtype=np.uint64)))
        return _mixed((sums[self.ends] - sums[self.starts]) * downs[self.starts], np.uint64(3)).view(np.int64)

    def sets(self, levels: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key of each word, and of the distinct keys, by line and rarity: line, key; per line: size, two names)."""
        keys = (levels[(self.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | self.hashes >> np.uint64(8)).view(np.int64)
        order = self._by_line(keys)
        line, key = self.line[order], keys[order]
        new = np.ones(len(key), bool)
        new[1:] = (line[1:] != line[:-1]) | (key[1:] != key[:-1])
        line, key = line[new], key[new]
        n = np.bincount(line, minlength=self.lines.sum())
        return keys, line, key, n, *(_per_line(np.add, _mixed(key.view(np.uint64), np.uint64(i)), n) for i in (1, 2))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, ...]:
    """Powers of UP and DOWN from 0 on."""
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))), dtype=np.uint64) for x in (UP, DOWN))


def _per_line(by: np.ufunc, values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``by`` over each line's values, 0 for a line without."""
    out, some = np.zeros(len(n), np.uint64), n > 0
    if some.any():
        out[some] = by.reduceat(values, (np.cumsum(n) - n)[some])
    return out.view(np.int64)


def bucket_levels(docs: DataFrame, text_col: str) -> bytes:
    """Per bucket the level of its count, of all words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for rows in _texts(batches, 0):
            counts += np.bincount((_Cut([t for (t,) in rows]).hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"b": pa.array(found, pa.int32()), "k": counts[found]})
        give_back()

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "b int, k long").groupBy("b").agg(F.sum("k").alias("k"))
    level = F.least(F.lit(126), 1 + F.floor(F.log2("k") * STEPS)).cast("int")
    found = counts.select("b", level.alias("level")).toArrow()  # a row per bucket at most
    out = np.zeros(BUCKETS, np.uint8)
    out[found.column("b").to_numpy()] = found.column("level").to_numpy()
    return out.tobytes()


def _prefix_sizes(n: np.ndarray, threshold: float) -> np.ndarray:
    """No set of fewer than threshold / (1 - threshold) words has a match other than itself."""
    return np.where(n >= threshold / (1 - threshold) - MARGIN, n - np.ceil(n * threshold - MARGIN).astype(np.int64) + 1, 0)


def _line_sets(docs: DataFrame, id_col: str, text_col: str, levels: bytes, threshold: float) -> DataFrame:
    """A row per line: its place, its set's size and name; and, about once a task and set, prefix (rarest words first) and
    parity map, in which each of 64 bits is the parity of the words that fall on it: two maps differ in no more bits than
    the sets do in words. The prefix is empty elsewhere and for sets that can't match another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(levels, np.uint8), set()
        for rows in _texts(batches, 1):
            cut = _Cut([t for _, t in rows])
            _, line, key, n, k1, k2 = cut.sets(table)
            size = _prefix_sizes(n, threshold)
            if len(seen) >= MEMO:
                seen.clear()
            for i in np.flatnonzero(size).tolist():
                if (name := (k1[i], k2[i])) in seen:
                    size[i] = 0
                seen.add(name)
            prefix = key[np.arange(len(key)) - (np.cumsum(n) - n)[line] < size[line]]
            prefixes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(prefix))
            maps = _per_line(np.bitwise_xor, np.left_shift(np.uint64(1), key.view(np.uint64) & np.uint64(63)), n)
            text = np.repeat(np.arange(len(rows)), cut.lines)
            number = np.arange(len(text)) - np.repeat(np.cumsum(cut.lines) - cut.lines, cut.lines)
            ids = pa.array([i for i, _ in rows], pa.int64()).take(pa.array(text))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "line_no": pa.array(number, pa.int32()), "n": pa.array(n, pa.int32()), "k1": k1, "k2": k2, "prefix": prefixes, "map": maps})
        give_back()

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, line_no int, n int, k1 long, k2 long, prefix array<long>, map long")


def _key_sets(docs: DataFrame, text_col: str, levels: bytes, flags: bytes) -> DataFrame:
    """(k1, k2, s, words) of the sets whose slot is flagged, by their sorted keys; rows without k1 have keys and the second
    hashes of their words, each about once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted, seen, known = np.frombuffer(levels, np.uint8), np.frombuffer(flags, np.uint8), set(), np.zeros((0, 2), np.int64)
        for rows in _texts(batches, 0):
            cut = _Cut([t for (t,) in rows])
            keys, _, key, n, k1, k2 = cut.sets(table)
            if len(seen) >= MEMO:
                seen.clear()
            new = np.zeros(len(n), bool)
            hit = np.flatnonzero((n > 0) & (wanted[k1 % SLOTS] > 0))
            for i, name in zip(hit.tolist(), zip(k1[hit].tolist(), k2[hit].tolist(), strict=True), strict=True):
                if name not in seen:
                    seen.add(name)
                    new[i] = True
            if not new.any():
                continue
            here = new[cut.line]
            words = _distinct(keys[here], cut.checks()[here])
            if len(known) >= MEMO:
                known = known[:0]
            old = len(known)
            both = np.concatenate((known, words))
            order = np.lexsort((np.arange(len(both)), both[:, 1], both[:, 0]))
            first = np.ones(len(both), bool)
            first[1:] = (both[order][1:] != both[order][:-1]).any(axis=1)
            fresh = order[first & (order >= old)]
            fresh, known = both[fresh], both[order[first]]
            ends = np.concatenate(([0], np.cumsum(n[new]), [n[new].sum() + len(fresh)]))
            yield pa.RecordBatch.from_pydict({
                "k1": pa.array([*k1[new].tolist(), None], pa.int64()), "k2": pa.array([*k2[new].tolist(), None], pa.int64()),
                "s": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate((key[np.repeat(new, n)], fresh[:, 0])))),
                "words": pa.array([*[None] * int(new.sum()), fresh[:, 1].tolist()], pa.list_(pa.int64())),
            })
        give_back()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k1 long, k2 long, s array<long>, words array<long>")


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs, as rows."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack((a[new], b[new]), axis=1)


def _whole_sets(docs: DataFrame, text_col: str, levels: bytes, flags: bytes) -> DataFrame:
    """(k1, k2, named) of the sets whose slot is flagged; ``named`` are a set's words by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted, seen = np.frombuffer(levels, np.uint8), np.frombuffer(flags, np.uint8), set()  # a frequent set leaves a task about once
        for rows in _texts(batches, 0):
            cut = _Cut([t for (t,) in rows])
            keys, _, _, n, k1, k2 = cut.sets(table)
            first, found = np.searchsorted(cut.line, np.arange(len(n) + 1)), {}
            if len(seen) >= MEMO:
                seen.clear()
            for i in np.flatnonzero((n > 0) & (wanted[k1 % SLOTS] > 0)).tolist():
                if (name := (k1[i], k2[i])) not in seen:
                    seen.add(name)
                    here = range(first[i], first[i + 1])
                    found[name] = sorted({(keys[j].item(), cut.data[cut.starts[j] : cut.ends[j]].decode("utf-8", "replace")) for j in here})
            yield pa.RecordBatch.from_pydict({
                "k1": pa.array([a for a, _ in found], pa.int64()), "k2": pa.array([b for _, b in found], pa.int64()),
                "named": pa.array([[{"key": k, "word": w} for k, w in s] for s in found.values()], pa.list_(pa.struct([("key", pa.int64()), ("word", pa.string())]))),
            })
        give_back()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k1 long, k2 long, named array<struct<key:long,word:string>>")


class _Block:
    """The sets of one row, sorted by place."""

    def __init__(self, column: pa.ListArray, i: int) -> None:
        lo, hi = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
        sets = column.values.slice(lo, hi - lo)
        self.places, self.cids = sets.field("place"), sets.field("cid").to_numpy()
        lists = sets.field("s")
        ends = lists.offsets.to_numpy()
        self.sizes = np.diff(ends)
        keys = lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy()
        rows, pos = np.repeat(np.arange(len(sets)), self.sizes), sets.field("pos").to_numpy()
        steps = np.ones(len(keys), np.int64)  # keys are sorted; a key that two words share is one place
        steps[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        nth = np.cumsum(steps)
        begins = nth[np.minimum(ends[:-1] - ends[0], len(keys) - 1)] if len(keys) else np.zeros(len(sets), np.int64)
        before = nth - begins[rows] < pos[rows]
        self.words = rows, keys
        self.early = rows[before], keys[before]
        if sets.type.get_field_index("words") >= 0:
            names = sets.field("words")
            self.words = rows, np.array(names.values.slice(ends[0], ends[-1] - ends[0]).to_pylist(), object)


def _common(a: tuple, n_a: int, b: tuple, n_b: int) -> np.ndarray:
    """How many values each of n_a sets has in common with each of n_b; sets are (row, value) entries."""
    if a is b:
        values, counts = np.unique(a[1], return_counts=True)
        shared = values[counts > 1]
    else:
        shared = np.intersect1d(a[1], b[1])
    out = np.zeros((n_a, n_b))

    def dense(entries: tuple, n: int, part: np.ndarray) -> np.ndarray:
        rows, values = entries
        at = np.minimum(np.searchsorted(part, values), len(part) - 1)
        hit = part[at] == values
        found = np.zeros((n, len(part)), np.float32)
        found[rows[hit], at[hit]] = 1
        return found

    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        left = dense(a, n_a, part)
        out += left @ (left if a is b else dense(b, n_b, part)).T
    return out


def _links(groups: DataFrame, threshold: float) -> DataFrame:
    """(cid, n_links, other) of the sets of a row's ``xs`` that match some of its ``ys`` (null: ``xs`` too).

    A pair counts where no earlier word is in both, that is at the first word it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _Block(batch.column(0), i)
                y = _Block(batch.column(1), i) if batch.column(1)[i].is_valid else x
                n, m = len(x.cids), len(y.cids)
                both = _common(x.words, n, x.words if y is x else y.words, m)
                match = both >= threshold * (x.sizes[:, None] + y.sizes[None] - both) - MARGIN
                match &= x.cids[:, None] != y.cids[None]
                if match.any():
                    match &= _common(x.early, n, x.early if y is x else y.early, m) == 0
                counts = match.sum(axis=1)
                some = np.flatnonzero(counts)
                if len(some):
                    yield pa.RecordBatch.from_pydict({"cid": x.cids[some], "n_links": counts[some], "other": y.places.take(pa.array(match[some].argmax(axis=1)))})
            give_back()

    place = groups.schema["xs"].dataType.elementType["place"].dataType.simpleString()
    return groups.mapInArrow(run, f"cid long, n_links long, other {place}")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    return rows


def matching_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per line: doc_id, line_no, n_words, class_doc_id and class_line (the class's first line), class_size,
    n_links (other classes that match), match_doc_id and match_line (the earliest earlier match), kept."""
    texts = docs.where(F.col(text_col).isNotNull())
    levels = bucket_levels(texts, text_col)
    base = materialise(_line_sets(texts, id_col, text_col, levels, threshold), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "k1")
    classes = base.where("n > 0").groupBy("k1", "k2").agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "line-classes")
    prefix = base.where(F.size("prefix") > 0).groupBy("k1", "k2").agg(F.first("prefix").alias("prefix"), F.first("map").alias("map"))
    prefix = classes.select("k1", "k2", "cid", "n").join(prefix, ["k1", "k2"]).select("cid", "n", "map", "prefix")
    prefix = materialise(prefix, "line-prefixes")

    def fits(n_a: Column, pos_a: Column, map_a: Column, n_b: Column, pos_b: Column, map_b: Column) -> Column:
        need = F.ceil((n_a + n_b) * (threshold / (1 + threshold)) - MARGIN)
        sizes = (n_a >= n_b * threshold - MARGIN) & (n_b >= n_a * threshold - MARGIN)
        return sizes & (F.least(n_a - pos_a, n_b - pos_b) >= need) & (F.bit_count(map_a.bitwiseXOR(map_b)) <= n_a + n_b - 2 * need)

    prefix = prefix.select("cid", "n", "map", F.posexplode("prefix").alias("pos", "w"))
    a, b = prefix.alias("a"), prefix.alias("b")
    parts = [F.col(f"{t}.{c}") for t in "ab" for c in ("n", "pos", "map")]
    near = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.cid") != F.col("b.cid")) & fits(*parts), "left_semi")
    near = materialise(near.select("cid", "pos", "w"), "line-near")  # a pair that matches has both its rows at the first word it shares here
    wanted = classes.join(near.select("cid").distinct(), "cid", "left_semi").select("cid", "k1", "k2", "first")
    wanted = materialise(wanted, "line-wanted")

    # Whole sets of those classes, from the texts again; a filter of fixed size keeps most lines out.
    slot = F.pmod(F.col("k1"), F.lit(SLOTS))
    bits = {r["bucket"]: bytes(r["bits"]) for r in wanted.groupBy(F.bitmap_bucket_number(slot + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits")).collect()}
    flags = np.zeros(SLOTS, np.uint8)
    for bucket, packed in bits.items():
        places = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little"))
        flags[((bucket - 1) * 8 * len(packed) + places) % SLOTS] = 1
    place = F.struct(F.col("first.last").alias("last"), F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), F.col("first.k1").alias("k1"))
    found = materialise(_key_sets(texts, text_col, levels, flags.tobytes()), "line-keys")
    words = found.where("k1 is null").select(F.explode(F.arrays_zip("s", "words")).alias("x")).distinct()
    twice = words.groupBy("x.s").count().where("count > 1").limit(1).count()
    if twice:
        found = _whole_sets(texts, text_col, levels, flags.tobytes())
        found = found.select("k1", "k2", F.transform("named", lambda x: x["key"]).alias("s"), F.transform("named", lambda x: x["word"]).alias("words"))
    held = ["s", "words"] if twice else ["s"]
    sets = found.where("k1 is not null").select("k1", "k2", *held).dropDuplicates(["k1", "k2"]).join(wanted.hint("shuffle_hash"), ["k1", "k2"])
    sets = materialise(sets.select("cid", place.alias("place"), *held), "line-sets")

    shared = materialise(near.groupBy("w").agg(F.count("*").alias("k")), "line-words")
    member = lookup(near, shared, ["w"], ["k"], "k", max(1, shared.agg(F.sum("k")).first()[0] or 0), how="inner").join(sets, "cid")

    gathered = F.sort_array(F.collect_list(F.struct("place", "cid", "pos", "s", *(["words"] if twice else [])))).alias("xs")
    whole = member.where(F.col("k") <= CHUNK).groupBy("w").agg(gathered).select("xs")
    linked = _links(whole.withColumn("ys", F.lit(None).cast(whole.schema["xs"].dataType)), threshold)
    if shared.where(F.col("k") > CHUNK).limit(1).count():
        chunks = F.ceil(F.col("k") / CHUNK).cast("int")
        blocks = member.where(F.col("k") > CHUNK).groupBy("w", chunks.alias("chunks"), F.pmod(F.xxhash64("cid"), chunks).cast("int").alias("block")).agg(gathered)
        blocks = materialise(blocks, "line-blocks")
        left = blocks.select("w", "xs", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("block"))
        linked = linked.unionByName(_links(left.join(blocks.select("w", "block", F.col("xs").alias("ys")), ["w", "block"]).select("xs", "ys"), threshold))
    linked = linked.groupBy("cid").agg(F.sum("n_links").alias("n_links"), F.min("other").alias("other"))
    linked = classes.select("cid", "k1", "k2").join(materialise(linked, "line-links"), "cid").drop("cid")
    told = classes.join(linked, ["k1", "k2"], "left").select("k1", "k2", "copies", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), "other")
    rows = lookup(base.select("doc_id", "line_no", "n", "k1", "k2"), told, ["k1", "k2"], ["copies", "first", "n_links", "other"], "copies", max(1, base.count()))
    here = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    place = lambda c: F.struct(F.col(f"{c}.last").alias("last"), F.col(f"{c}.doc_id").alias("doc_id"), F.col(f"{c}.line_no").alias("line_no"))
    earliest = F.least(place("first"), F.when(F.col("other").isNotNull(), place("other")))
    rows = rows.withColumn("match", F.when((F.col("n") > 0) & (earliest < here), earliest))
    own = lambda c, f: F.when(F.col("n") > 0, F.col(f"first.{f}")).otherwise(F.col(c))
    return rows.select(
        "doc_id", "line_no", F.col("n").alias("n_words"), own("doc_id", "doc_id").alias("class_doc_id"), own("line_no", "line_no").alias("class_line"),
        F.when(F.col("n") > 0, F.col("copies")).otherwise(F.lit(1)).alias("class_size"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"),
        F.col("match.doc_id").alias("match_doc_id"), F.col("match.line_no").alias("match_line"), F.col("match").isNull().alias("kept"),
    )


def without_matches(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that ``found`` keeps; ids must be unique and not null."""
    lines = _lines(docs, id_col, text_col).join(found.where("kept").select("doc_id", "line_no"), ["doc_id", "line_no"])
    key, text = free_name("kept_id", docs.columns), free_name("kept_text", docs.columns)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    whole = lines.groupBy(F.col("doc_id").alias(key)).agg(joined.alias(text))
    out = docs.join(whole, F.col(id_col).cast("long") == F.col(key), "left")
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.coalesce(text, F.lit("")))).select(*docs.columns)
