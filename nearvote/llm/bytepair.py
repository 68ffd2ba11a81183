"""Byte-level BPE in linear time, by backtracking from longest matches.

The vocabulary's byte strings, mapped to Latin-1, are a pyahocorasick automaton.
One pass over a word finds, for every place, the tokens that begin there. From
the left, the longest is tried first; it stands if it and the token before it
are compatible, that is if the merges, applied to the two tokens' bytes, end in
just these two. Else the next shorter one is tried, and if none is left, the
token before it is given up and its end is never tried again. So each place is
left at most once, and what remains is what the merges give. The compatibility
of two tokens is found by undoing their merges from both sides of the border
and is memoised.

Defined results: null text is empty and has no ids; repeated rows and rows
without doc_id are encoded like any other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoded, PieceEncoder, flat, groups, texts_of

PAIRS = 2_000_000  # compatibilities that a worker remembers at most


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class BytePair:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.whole: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            halves = self._halves(token, rank)
            if halves is None:
                continue  # no sequence of merges makes it
            self.halves[rank] = halves
            if halves[0] != rank:
                self.whole[halves] = rank
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that the merges of lower rank leave of a token; of a single byte twice itself."""
        if len(token) == 1:
            return rank, rank
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            found = [self.whole.get(pair, rank) for pair in zip(parts, parts[1:], strict=False)]
            least = min(found)
            if least >= rank:
                return None
            i = found.index(least)
            parts[i : i + 2] = [least]
        return parts[0], parts[1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep the border between two adjacent tokens."""
        known = self.memo.get((left, right))
        if known is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            known = self.memo[left, right] = self._border_holds(left, right)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo merges, the latest first, and see if one across the border would have come before.
        limit = len(self.ranks) + max(a, b) + 1
        while True:
            joined = self.whole.get((a, b))
            if joined is not None and joined < limit:
                return False
            (a0, a1), (b0, b1) = self.halves[a], self.halves[b]
            if (a > b and a0 != a) or (b0 == b and b1 == b):
                if a1 == a:
                    return True
                limit, a = a, a1  # on equal rank the left merge comes first: one across must be lower
            else:
                limit, b = b + 1, b0

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of the bytes of one match of the pattern."""
        if (rank := self.ranks.get(word)) is not None:
            return [rank]
        starts: list[list[tuple[int, int]]] = [[] for _ in word]
        for end, (rank, size) in self.automaton.iter(word.decode("latin-1")):
            starts[end + 1 - size].append((rank, size))  # per start in ascending length
        out: list[int] = []
        places, tried, at, dead = [0], [starts[0][:]], 0, set()
        while at < len(word):
            options = tried[-1]
            while options:
                rank, size = options.pop()
                if at + size not in dead and (not out or self.compatible(out[-1], rank)):
                    out.append(rank)
                    at += size
                    places.append(at)
                    tried.append(starts[at][:] if at < len(word) else [])
                    break
            else:
                dead.add(at)
                places.pop()
                tried.pop()
                out.pop()
                at = places[-1]
        return out

    def encode_pieces(self, pieces: list[str]) -> Encoded:
        find, word = self.pattern.findall, self.encode_word
        out = []
        for piece in pieces:
            ids: list[int] = []
            for match in find(piece):
                ids += word(match.encode("utf-8"))
            out.append(ids)
        return flat(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def opened(path: str, pattern: str) -> BytePair:
    """One per worker: the automaton and the table of halves take a second to make."""
    return BytePair(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the decimal ids joined by a space and of the bytes decoded from the ids; with_ids adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = opened(ranks, pattern)
        pieces = PieceEncoder(coder.encode_pieces)
        decimal = {rank: str(rank) for rank in coder.bytes_of}
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in groups(texts):
                got, counts = pieces(texts[a:b])
                each = [x.tolist() for x in np.split(got, np.cumsum(counts)[:-1])]
                out = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest() for ids in each], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(coder.decode(ids)).hexdigest() for ids in each], pa.string()),
                }
                if with_ids:
                    out["ids"] = pa.array(each, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return lean.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def decode(rows: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id and the text of its ids (bytes that aren't UTF-8 are replaced); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = opened(ranks, pattern)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return rows.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")
