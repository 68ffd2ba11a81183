"""op3, op5, op6: token ids, their files, packing, against the libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearvote.llm import bytepair, packing, simple8b, tokens, tokenstore
from nearvote.llm.common import scratch_path
from nearvote.llm.resources import pattern, vocabulary

ODD = "abAS,,. é\n\t  '1.\x1f\x85\x01sÉΣİβ日ﬁ"


def split(encoded):
    ids, counts = encoded
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def strings(seed, n):
    r = random.Random(seed)
    return ["", " ", "a  b", "'s don't  's", "İ. x", "<|endoftext|> a"] + ["".join(r.choice(ODD) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def coder():
    return bytepair.opened(vocabulary("byte_bpe_50k.tiktoken"), pattern())


@pytest.mark.parametrize("limit", [3, 100_000])
def test_pieces_give_the_ids_of_whole_texts(limit, coder):
    texts = strings(1, 1500)
    word = tokens.word_encoder_of(vocabulary("word_bpe_49k.json"))
    for encode, name, alike in ((word, "word_bpe_49k.json", False), (word, "word_bpe_49k.json", True), (coder.encode_pieces, "byte_bpe_50k.json", False)):
        pieces, direct, got = tokens.PieceEncoder(encode, limit, alike), tokens.encoder_of(vocabulary(name)), []
        column = tokens.texts_of(pa.array(texts, pa.string()))
        for a, b in tokens.groups(column, 200):
            got += split(pieces(column[a:b]))
        assert got == split(direct(texts))


def library(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(vocabulary(name)).encode_batch(texts, add_special_tokens=False)]


SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|> it's", "a<|endoftext", "<|endoftext|>" * 3, " <|endoftext|>\n", "plain text, here"]


def test_special_strings_as_the_library_takes_them():
    texts = strings(4, 200) + SPECIAL + strings(5, 50)
    pieces = tokens.piece_encoder(vocabulary("word_bpe_49k.json"))
    assert split(pieces(tokens.texts_of(pa.array(texts, pa.string())))) == library("word_bpe_49k.json", texts)
    encode = tokens.whole_encoder(vocabulary("byte_bpe_50k.json"), pattern())
    assert [encode(t).tolist() for t in texts] == library("byte_bpe_50k.json", texts)


def test_pieces_hold_the_documents_ids(spark):
    rows = list(enumerate([*strings(6, 120), *SPECIAL, "word " * 9000, None]))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.json"), pattern(), end_id=1, with_ids=True).collect()
    whole = {i: [*x, 1] for (i, _), x in zip(rows, library("byte_bpe_50k.json", [t or "" for _, t in rows]), strict=True)}
    pieces = defaultdict(list)
    for r in got:
        assert r.ids == whole[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
    assert pieces.keys() == whole.keys()
    for i, own in pieces.items():
        assert [a for a, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) == len(whole[i])


def lowest_cost(lengths, capacity):
    """The rule, one sequence at a time: the longest document next, to the cheapest sequence that has room, else cut for the roomiest."""
    full = [(d, k * capacity, capacity) for d, n in enumerate(lengths) for k in range(n // capacity)]
    queue = sorted((-(n % capacity), d, n - n % capacity) for d, n in enumerate(lengths) if n % capacity)
    rest = -sum(q[0] for q in queue)
    sizes = [capacity] * (rest // capacity) + [1 << b for b in range(30, -1, -1) if (rest % capacity) >> b & 1]
    held = [[] for _ in sizes]
    while queue:
        n, d, start = queue.pop(0)
        room = [size - sum(x[2] for x in own) for size, own in zip(sizes, held, strict=True)]
        fits = [i for i in range(len(sizes)) if room[i] >= -n]
        at = min(fits, key=lambda i: (sum(packing.cost(x[2]) for x in held[i]), i)) if fits else max(range(len(sizes)), key=lambda i: (room[i], -i))
        take = min(-n, room[at])
        held[at].append((d, start, take))
        if take < -n:
            queue = sorted([*queue, (n + take, d, start + take)])
    return sorted([*full, *(x for own in held for x in own)])


def test_documents_go_to_the_cheapest_sequence():
    r = random.Random(11)
    for _ in range(40):
        lengths = [r.randint(1, 150) for _ in range(r.randint(1, 30))]
        assert sorted(p[:3] for p in packing.assign(np.array(lengths), 64)) == lowest_cost(lengths, 64)


def test_whole_encoder_equals_the_tokenizers_library():
    encode = tokens.whole_encoder(vocabulary("byte_bpe_50k.json"), pattern())
    texts = strings(2, 1500)
    assert [encode(t).tolist() for t in texts] == library("byte_bpe_50k.json", texts)
    assert tokens.byte_level_ranks(vocabulary("word_bpe_49k.json")) is None
    assert tokens.drops_case_and_space(vocabulary("word_bpe_49k.json")) and not tokens.drops_case_and_space(vocabulary("byte_bpe_50k.json"))


def test_bpe_equals_tiktoken(coder):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéßñ日'!*.0189thein ") for _ in range(r.randint(1, 30))) for _ in range(3000)] + ["a" * 300, "the" * 90, "!" * 200, "\n" * 50]
    assert split(coder.encode_pieces(words)) == [other.encode_ordinary(w) for w in words]
    assert all(coder.decode(other.encode_ordinary(w)) == w.encode() for w in words)


def test_bpe_is_linear(coder):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        coder.encode_word(b"ab" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.01)


def test_op5_rows(spark, odd_docs, no_docs, coder):
    found = bytepair.encode(odd_docs, vocabulary("byte_bpe_50k.tiktoken"), pattern(), with_ids=True)
    rows = found.collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in rows) == sorted((d.doc_id is None, d.doc_id, len(split(coder.encode_pieces([d.text or ""]))[0])) for d in odd_docs.collect())
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in rows)
    want = sorted((hashlib.sha256((d.text or "").encode()).hexdigest() for d in odd_docs.collect()))
    assert sorted(r.decoded_sha256 for r in rows) == want
    back = bytepair.decode(found, vocabulary("byte_bpe_50k.tiktoken"), pattern()).collect()
    assert sorted(r.text for r in back) == sorted(d.text or "" for d in odd_docs.collect())
    assert bytepair.encode(no_docs, vocabulary("byte_bpe_50k.tiktoken"), pattern()).count() == 0


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([1, 3, 64, 1024]))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(ids, block):
    x = np.array(ids, np.uint64)
    words, offsets = simple8b.encode(x, block)
    assert (simple8b.decode(words, offsets, len(x), block) == x).all()
    assert len(offsets) == -(-len(ids) // block) + 1 and offsets[-1] == len(words)


def test_simple8b_packs_by_size():
    assert len(simple8b.encode(np.zeros(240, np.uint64))[0]) == 1
    assert len(simple8b.encode(np.full(60, 1, np.uint64))[0]) == 1
    assert len(simple8b.encode(np.full(1024, 40_000, np.uint64))[0]) == -(-1024 // 3)
    assert simple8b.encode(np.array([2**60], np.uint64))[0].tolist() == [0, 2**60]


def test_token_files(spark, odd_docs, no_docs):
    direct = tokens.encoder_of(vocabulary("word_bpe_49k.json"))
    folder = scratch_path(spark, "tokens")
    manifest = tokenstore.write(odd_docs, folder, vocabulary("word_bpe_49k.json"), 2, shard_ids=5000, block=64)
    rows = sorted(tokenstore.read(spark, folder, manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d.doc_id for d in odd_docs.collect()), key=lambda i: (i is not None, i))
    want = defaultdict(list)
    for d in odd_docs.collect():
        want[d.doc_id].append([*split(direct([d.text or ""]))[0], 2])
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.ids in want[r.doc_id]
        want[r.doc_id].remove(r.ids)
        at += r.n_tokens
    assert manifest.count() > 3
    empty = scratch_path(spark, "tokens")
    assert tokenstore.read(spark, empty, tokenstore.write(no_docs, empty, vocabulary("word_bpe_49k.json"), 2)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_assignment_covers_all_without_padding(seed):
    lengths = np.random.default_rng(seed).integers(1, [9, 700, 5000, 2049][seed], 300)
    pieces = packing.assign(lengths)
    check_pieces(pieces, lengths)


def check_pieces(pieces, lengths):
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in pieces:
        docs[doc].append((start, n))
        sequences[sequence].append((offset, n))
    for spans in (*docs.values(), *sequences.values()):
        end = 0
        for start, n in sorted(spans):
            assert start == end and n > 0
            end += n
    assert {d: sum(n for _, n in s) for d, s in docs.items()} == {d: n for d, n in enumerate(lengths) if n}
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert max(sizes) <= 2048 and all(n & (n - 1) == 0 for n in sizes)


def test_descending_documents_go_to_the_cheapest_sequence():
    pieces = packing.assign(np.array([1500, 1500, 548, 548]))
    assert [(d, s) for d, _, _, s, _ in pieces] == [(0, 0), (1, 1), (2, 0), (3, 1)]


def test_op6_rows(spark, odd_docs, no_docs):
    direct = tokens.encoder_of(vocabulary("byte_bpe_50k.json"))
    got = packing.pack(odd_docs, vocabulary("byte_bpe_50k.json"), pattern(), 1, with_ids=True).collect()
    pieces = [r for r in got]
    assert sum(r.length for r in pieces) == sum(len(split(direct([d.text or ""]))[0]) + 1 for d in odd_docs.collect())
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length for r in pieces)
    sizes = defaultdict(list)
    for r in pieces:
        sizes[r.sequence_id].append((r.offset, r.length))
    for spans in sizes.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= 2048 and end & (end - 1) == 0
    assert packing.pack(no_docs, vocabulary("byte_bpe_50k.json"), pattern(), 1).count() == 0
