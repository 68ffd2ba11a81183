"""Cost-balanced packing of token sequences.

A document's ids (with an end id) are packed into sequences of at most
``capacity`` tokens. Its estimated cost is linear + quadratic attention cost.
Documents of a group are taken in descending order; each goes to the sequence of
lowest cost that still has room for it. A document longer than a sequence is cut
into full sequences first; one that no sequence has room for is cut to fill the
roomiest one. The sequences of a group have together exactly the group's tokens:
all are of full length but for at most one of each smaller power of two, so
nothing is padded.

Scale: a map over the input's partitions without any shuffle; a group is about
``group_tokens`` tokens of consecutive rows, whatever the input, so memory is
bounded by a group or one document. Sequence ids come from the partition and the
group; a task that runs again makes the same ones.

Defined results: null text is empty and packs as its end id alone; repeated rows
and rows without doc_id are packed one by one; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import give_back, whole_encoder

CAPACITY = 2048
GROUP_TOKENS = 4_000_000
#: Cost of n tokens in one attention span: LINEAR * n + QUADRATIC * n * n (projections and attention scores).
LINEAR, QUADRATIC = 1.0, 1 / 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these many tokens."""
    pieces, sequences = [], 0
    queue: list[tuple[int, int, int]] = []  # descending by length, then by place
    for doc, n in enumerate(lengths.tolist()):
        full = n // capacity
        pieces += [(doc, k * capacity, capacity, sequences + k, 0) for k in range(full)]
        sequences += full
        if n % capacity:
            queue.append((-(n % capacity), doc, full * capacity))
    rest = -sum(q[0] for q in queue)
    sizes = [capacity] * (rest // capacity) + [1 << b for b in range(capacity.bit_length()) if (rest % capacity) >> b & 1][::-1]
    room, spent = np.array(sizes, np.int64), np.zeros(len(sizes))
    heapq.heapify(queue)
    while queue:
        n, doc, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        if fits.any():
            at, take = int(np.where(fits, spent, np.inf).argmin()), n
        else:  # cut it
            at = int(room.argmax())
            take = int(room[at])
            heapq.heappush(queue, (take - n, doc, start + take))
        pieces.append((doc, start, take, sequences + at, sizes[at] - int(room[at])))
        room[at] -= take
        spent[at] += cost(take)
    return pieces


def pack(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds each piece's token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, made = whole_encoder(tokenizer, pattern), TaskContext.get().partitionId() << 32, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []

        def emit() -> pa.RecordBatch:
            nonlocal made
            lengths = np.array([len(x) for x in ids], np.int64)
            pieces = assign(lengths, capacity)
            doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            parts = [ids[d][s : s + n] for d, s, n, _, _ in pieces]
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            columns = [pa.array([names[d] for d in doc.tolist()], pa.int64()), start, length, pa.array(crc, pa.int64()), lengths[doc], base + made + sequence, offset]
            made += int(sequence.max()) + 1
            out = {f.split()[0]: c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for f, c in zip(SCHEMA.split(", "), columns, strict=True)}
            if with_ids:
                out["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
            ids.clear()
            names.clear()
            give_back()
            return pa.RecordBatch.from_pydict(out)

        held = 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(np.append(encode(text.as_py() or ""), np.uint32(end_id)))
                names.append(k)
                held += len(ids[-1])
                if held >= GROUP_TOKENS:
                    yield emit()
                    held = 0
        if ids:
            yield emit()

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return lean.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
