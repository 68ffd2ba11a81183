"""Simple-8b coding of unsigned integers in 64-bit words, vectorised over blocks.

The ids are cut into blocks of ``block`` ids. Within a block, words are filled
one after the other: the top four bits (selector) of a word say how many ids it
holds and in how many bits each; the widest count that the next ids fit is
taken. Id k of a word is at bit k * bits. Selector 0 is an escape: the word
after it is one id of more than 60 bits, as it is. A block's last word may have
more places than ids are left. Per block, the offset of its first word is kept,
so blocks decode independently and all at once.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the code. Selector: (ids per word, bits per id); 0 is the escape.
SELECTORS = (
    (1, 64),
    (240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNT = np.array([n for n, _ in SELECTORS], np.int64)
WIDTH = np.array([b for _, b in SELECTORS], np.int64)
BLOCK = 1024
SLICE = 1 << 19  # ids that are coded or decoded at once, in whole blocks
SMALL = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)  # bits of small ids


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, exactly (float64 would round up near powers of two)."""
    if not len(ids) or ids.max() < len(SMALL):
        return SMALL[ids.astype(np.int64)]
    out = np.zeros(ids.shape, np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1) << np.uint64(step)
        out[high] += step
        rest[high] >>= np.uint64(step)
    return out + (rest > 0).astype(np.uint8)


def _choices(bits: np.ndarray) -> np.ndarray:
    """Per place, the selector of the largest count whose ids all fit; bits: (blocks, places), 0 beyond the end."""
    best = np.zeros(bits.shape, np.uint8)  # the escape, unless some selector fits
    np.copyto(best, len(SELECTORS) - 1, where=bits <= 60)
    spans = {1: bits}

    def most(n: int) -> np.ndarray:
        """Per place, the most bits of the n ids from there on."""
        if n not in spans:
            half = (n + 1) // 2
            a = most(half)
            out = a.copy()
            np.maximum(out[:, : -(n - half)], a[:, n - half :], out=out[:, : -(n - half)])
            spans[n] = out
        return spans[n]

    for s in range(len(SELECTORS) - 2, 0, -1):
        n, b = SELECTORS[s]
        np.copyto(best, s, where=most(n) <= b)
    return best


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): offsets[i] is the place of block i's first word; one more at the end."""
    step = max(1, SLICE // block) * block
    words, offsets, base = [], [np.zeros(1, np.int64)], 0
    for at in range(0, len(ids), step):
        w, o = _encode(ids[at : at + step], block)
        words.append(w)
        offsets.append(o[1:] + base)
        base += len(w)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(offsets)


def _encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.ascontiguousarray(ids, np.uint64)
    n = -(-len(ids) // block)
    flat = np.zeros(n * block, np.uint64)
    flat[: len(ids)] = ids
    padded = np.zeros((n, block + int(COUNT[WIDTH > 0].max())), np.uint64)
    padded[:, :block] = flat.reshape(n, block)
    bits = np.zeros((n, block + int(COUNT.max())), np.uint8)
    bits[:, :block] = bit_lengths(flat).reshape(n, block)
    left = np.full(n, block, np.int64)
    if n:
        left[-1] = len(ids) - (n - 1) * block
    best = _choices(bits)
    at, words = np.zeros(n, np.int64), np.zeros(n, np.int64)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.arange(n)
    while len(live):
        s = best[live, at[live]].astype(np.int64)
        steps.append((live, at[live], s, words[live]))
        at[live] += COUNT[s]
        words[live] += 1 + (s == 0)
        live = live[at[live] < left[live]]
    offsets = np.concatenate(([0], np.cumsum(words)))
    out = np.zeros(int(offsets[-1]), np.uint64)
    if not steps:
        return out, offsets
    blk, pos, sel, rank = (np.concatenate(c) for c in zip(*steps, strict=True))
    place, at, cells = offsets[blk] + rank, blk * padded.shape[1] + pos, padded.ravel()
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        word = np.full(len(mine), s, np.uint64) << np.uint64(60)
        if s == 0:
            out[place[mine] + 1] = cells[at[mine]]
        elif width:
            begin = at[mine]
            for k in range(count):
                word |= cells[begin + k] << np.uint64(k * width)
        out[place[mine]] = word
    return out, offsets


def decode(words: np.ndarray, offsets: np.ndarray, total: int, block: int = BLOCK) -> np.ndarray:
    """The ids again; offsets as encode() gave them, total ids in all."""
    out = np.empty(total, np.uint64)
    step = max(1, SLICE // block)
    for at in range(0, len(offsets) - 1, step):
        part = offsets[at : at + step + 1]
        to = out[at * block : (at + step) * block]
        to[:] = _decode(words[part[0] : part[-1]], part - part[0], len(to), block)
    return out


def _decode(words: np.ndarray, offsets: np.ndarray, total: int, block: int) -> np.ndarray:
    words, n = np.ascontiguousarray(words, np.uint64), len(offsets) - 1
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    after = -1
    for i in np.flatnonzero(selector == 0).tolist():  # escapes in order; the word after one is an id
        if i > after:
            after = i + 1
            selector[after], count[after] = -1, 0
    before = np.concatenate(([0], np.cumsum(count)))
    block_of = np.repeat(np.arange(n), np.diff(offsets))
    inside = before[:-1] - before[offsets[:-1]][block_of]
    begin = block_of * block + inside
    limit = np.minimum((block_of + 1) * block, total)
    out = np.zeros(total, np.uint64)
    for s, (size, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if not len(mine) or not width:
            continue
        if s == 0:
            out[begin[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << width) - 1)
        for k in range(size):
            to = begin[mine] + k
            valid = to < limit[mine]
            out[to[valid]] = (words[mine[valid]] >> np.uint64(k * width)) & mask
    return out
