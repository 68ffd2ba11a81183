"""Encoding of whole texts piece by piece, each distinct piece once per worker.

A text is split only where a tokenizer's own pre-tokenizer always splits, so the
ids of the pieces, one after the other, are the ids of the text. Pieces between
which that isn't certain are put together again.
"""

from __future__ import annotations

import ctypes
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces beyond which a worker forgets all before it goes on.
MEMO_LIMIT = 400_000
#: Characters of the texts that are encoded at once (a longer text alone).
GROUP_CHARS = 2_000_000
#: Pieces that a tokenizer gets at once: what it returns is far larger than the ids.
PIECES = 20_000

MARKS = (" ", "\n", ",", ".")
CUT = "\x01"  # put before each place where a text is cut; a text that holds it is not cut


def give_back() -> None:
    """Return freed memory to the system, which a worker otherwise holds from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def open_tokenizer(path: str):
    """For texts, or pieces of them, without special strings."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # so that no piece can become one
    return found


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    """Strings that the library takes as one token wherever they stand in a text."""
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file).get("added_tokens") or ())


@lru_cache(maxsize=4)
def library_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a whole text by the library's own call, which turns special strings into their tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


Encoded = tuple[np.ndarray, np.ndarray]  # ids of strings, one after the other, and how many each has


def flat(lists: list[list[int]]) -> Encoded:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def encoder_of(path: str) -> Callable[[list[str]], Encoded]:
    """Strings' ids by the tokenizers library."""
    tokenizer = open_tokenizer(path)

    def encode(texts: list[str]) -> Encoded:
        found = [flat([e.ids for e in tokenizer.encode_batch_fast(texts[i : i + PIECES], add_special_tokens=False)]) for i in range(0, len(texts), PIECES)]
        return tuple(np.concatenate(parts) for parts in zip(*found, strict=True)) if found else flat([])

    return encode


#: Normalizer and pre-tokenizer of a file for which a word of letters may be prepared beforehand.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_CUT = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
WORD_END = "</w>"
#: Letters whose lower case depends on what is around them, or is no single letter.
ODD_LETTERS = re.compile("[\u03a3\u0130]")
WORDS = 100  # words that are given to the tokenizer as one string


def drops_case_and_space(path: str) -> bool:
    """Whether the file's normalizer makes letters small and white space alike before anything else looks at them."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)["normalizer"] == WORD_NORMALIZER


def made_alike(texts: pa.Array) -> pa.Array:
    """ASCII letters small and line feeds spaces: fewer distinct pieces, the same ids where drops_case_and_space()."""
    return pc.ascii_lower(pc.replace_substring(texts, "\n", " "))  # in this order: lowering a slice of an array garbles it


def word_encoder_of(path: str) -> Callable[[list[str]], Encoded]:
    """encoder_of() for files whose words end in a mark of their own.

    Words of letters alone, which nearly all pieces are, skip the file's costly
    normalizer and pre-tokenizer: they are prepared here the same way and put to
    the same model many at a time. All else goes the usual way.
    """
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    if told["normalizer"] != WORD_NORMALIZER or (told["pre_tokenizer"] or {}).get("pretokenizers") != WORD_CUT or told["model"].get("end_of_word_suffix") != WORD_END:
        return encoder_of(path)
    from tokenizers import normalizers, pre_tokenizers

    tokenizer = open_tokenizer(path)
    usual = tokenizer.normalizer, tokenizer.pre_tokenizer
    bare = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()

    def run(texts: list[str], way: tuple) -> list[list[int]]:
        tokenizer.normalizer, tokenizer.pre_tokenizer = way
        return [e.ids for i in range(0, len(texts), PIECES) for e in tokenizer.encode_batch_fast(texts[i : i + PIECES], add_special_tokens=False)]

    def general(pieces: list[str]) -> Encoded:
        return flat(run(pieces, usual))

    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
    letters = {b: ord(c) for c, b in byte_letters().items() if b >= 0x80}

    def encode(pieces: list[str]) -> Encoded:
        simple = [p.isalpha() or (p[:1] == " " and p[1:].isalpha()) for p in pieces]
        words = [p if p[0] == " " else " " + p for p, s in zip(pieces, simple, strict=True) if s]
        lines = ["".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]
        for n, line in enumerate(lines):
            if ODD_LETTERS.search(line) or not unicodedata.is_normalized("NFC", line):
                return general(pieces)
            line = line.lower()
            lines[n] = line if line.isascii() else line.encode("utf-8").decode("latin-1").translate(letters)
        ids, _ = flat(run(lines, bare))
        last = np.flatnonzero(ends[ids])
        if len(last) != len(words):
            return general(pieces)
        if len(words) == len(pieces):
            return ids, np.diff(last, prepend=-1)
        sizes = np.zeros(len(pieces), np.int64)
        rest = ~np.array(simple)
        sizes[~rest] = np.diff(last, prepend=-1)
        other, sizes[rest] = general([p for p, s in zip(pieces, simple, strict=True) if not s])
        out = np.empty(int(sizes.sum()), np.uint32)
        odd = np.repeat(rest, sizes)
        out[odd], out[~odd] = other, ids
        return out, sizes

    return encode


def byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a tokenizers file that is plain byte-level BPE with the usual pattern, whose merges are in order of their ids; else None."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, cut = told["model"], told["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or told["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        return None
    letters = byte_letters()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(set(made)) or len(made) + 256 > len(model["vocab"]):
        return None
    tokens = {**{c: model["vocab"][c] for c in letters}, **{a + b: i for (a, b), i in zip(merges, made, strict=True)}}
    return {bytes(letters[c] for c in token): i for token, i in tokens.items()}


def byte_letters() -> dict[str, int]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def whole_encoder(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids of whole texts as the tokenizers library gives them for the file.

    Where the file is plain byte-level BPE, its own vocabulary is run by tiktoken,
    which gives the same ids several times faster (a test holds the two together).
    """
    ranks = byte_level_ranks(path)
    if ranks is None:
        return library_encoder(path)
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    special, library = special_strings(path), library_encoder(path)
    return lambda text: library(text) if any(s in text for s in special) else np.array(coder.encode_ordinary(text), np.uint32)


def split(text: str) -> list[str]:
    """Pieces that begin at each space, line feed, comma and full stop."""
    if CUT in text:
        return [text]
    for mark in MARKS:
        text = text.replace(mark, CUT + mark)
    return text.split(CUT)


def _head(piece: str) -> int:
    """0: begins with white space, 1: with a mark, 2: anything (no cut was made before it)."""
    return 0 if piece[:1] in (" ", "\n") else 1 if piece[:1] in (",", ".") else 2


def _tail(piece: str) -> int:
    """0: ends in white space or is empty, 1: in a letter or digit, 2: in anything else."""
    c = piece[-1:]
    if not c or c.isspace():
        return 0
    return 1 if unicodedata.category(c)[0] in "LN" and c != "\u0130" else 2  # that one's lower case ends in a mark


#: [tail of a piece][head of the next]: whether the pre-tokenizers always split between the two.
#: White space begins a new token after anything but white space, a mark only after a letter or digit.
SPLITS = np.array([[False, False, False], [True, True, False], [True, False, False]])


class PieceEncoder:
    """Ids of texts as one flat array and a count per text.

    Each distinct piece goes to the tokenizer once, as long as it is remembered;
    the memo is bounded by its limit and the pieces of one call, so memory doesn't
    grow with the input. Pieces between
    which the pre-tokenizer may not split are put together first.
    """

    def __init__(self, encode: Callable[[list[str]], Encoded], limit: int = MEMO_LIMIT, alike: bool = False, special: tuple[str, ...] = (), library: Callable[[str], np.ndarray] | None = None):
        self.encode, self.limit, self.alike, self.special, self.library = encode, limit, alike, special, library
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.size, self.ends = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros((1024, 2), np.int8)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, pieces: list[str]) -> None:
        ids, sizes = self.encode(pieces)
        n, k = len(self.index), len(pieces)
        while n + k > len(self.start):
            self.start, self.size, self.ends = (np.concatenate((a, np.zeros_like(a))) for a in (self.start, self.size, self.ends))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.size[n : n + k] = sizes
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.ends[n : n + k, 0] = [0 if p[:1] == " " else _head(p) for p in pieces]
        self.ends[n : n + k, 1] = [1 if "a" <= p[-1:] <= "z" else _tail(p) for p in pieces]
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.index.update(zip(pieces, range(n, n + k), strict=True))

    def _places(self, pieces: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        self._learn(list(dict.fromkeys(map(pieces.__getitem__, missing.tolist()))))
        at[missing] = np.fromiter(map(self.index.__getitem__, map(pieces.__getitem__, missing.tolist())), np.int64, len(missing))
        return at

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pieces of all texts, and each text's end among them. Only distinct pieces become strings."""
        if pc.any(pc.match_substring(texts, CUT)).as_py():
            lists = pa.array([split(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        else:
            for mark in MARKS:
                texts = pc.replace_substring(texts, mark, CUT + mark)
            lists = pc.split_pattern(texts, CUT)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist()
        return self._places(distinct)[coded.indices.to_numpy()], lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has; no nulls."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        held = [pc.match_substring(texts, s, ignore_case=True) for s in self.special]  # case may be folded before they are looked for
        odd = np.flatnonzero(reduce(np.logical_or, (h.to_numpy(zero_copy_only=False) for h in held))) if held else []
        if len(odd):
            return self._with_special(texts, odd.tolist())
        if self.alike:
            texts = made_alike(texts)
        if len(self.index) > self.limit:  # only here, as places are held until the end of the call
            self._forget()
        at, ends = self._cut(texts)
        joined = ~SPLITS[self.ends[at[:-1], 1], self.ends[at[1:], 0]]
        joined[ends[:-1] - 1] = False
        if joined.any():
            at, ends = self._joined(texts, joined, at, ends)
        sizes = self.size[at]
        before = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.diff(before[np.concatenate(([0], ends))])
        return self.pool[np.repeat(self.start[at] - before[:-1], sizes) + np.arange(before[-1])], counts

    def _with_special(self, texts: pa.Array, odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold special strings go to the library whole, the others as ever."""
        parts, counts, last = [], [], 0
        for n in [*odd, len(texts)]:
            ids, sizes = self(texts[last:n])
            own = [self.library(texts[n].as_py())] if n < len(texts) else []
            parts += [ids, *own]
            counts += [sizes, np.array([len(x) for x in own], np.int64)]
            last = n + 1
        return np.concatenate(parts).astype(np.uint32), np.concatenate(counts)

    def _joined(self, texts: pa.Array, joined: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places once more, with the pieces put together between which no cut is allowed."""
        begin = np.concatenate(([0], ends))
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(joined), side="right")).tolist()
        pieces, sizes = [], []
        for n in odd:
            parts: list[list[str]] = []
            for p, j in zip(split(texts[n].as_py()), [False, *joined[begin[n] : begin[n + 1] - 1].tolist()], strict=True):
                if j:
                    parts[-1].append(p)
                else:
                    parts.append([p])
            pieces += ["".join(p) for p in parts]
            sizes.append(len(parts))
        own = self._places(pieces)
        new, last, out, lengths = 0, 0, [], np.diff(begin)
        for n, size in zip(odd, sizes, strict=True):
            out += [at[begin[last] : begin[n]], own[new : new + size]]
            lengths[n], new, last = size, new + size, n + 1
        return np.concatenate([*out, at[begin[last] :]]), np.cumsum(lengths)


def groups(texts: pa.Array, chars: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``chars`` bytes each."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + chars, side="right")))
        yield begin, end
        begin = end


def texts_of(column: pa.Array) -> pa.Array:
    """A column's texts, null as empty, with offsets that any size of batch fits."""
    return pc.fill_null(column.cast(pa.large_string()), "")


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    """One per worker: what a task has learned serves the next one."""
    return PieceEncoder(word_encoder_of(path), alike=drops_case_and_space(path), special=special_strings(path), library=library_encoder(path))
