"""The pipeline's near_dedup against exact five-word Jaccard similarity."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
import numpy as np
from nearvote.llm import groups, simhash
from tests.conftest import SF
from tests.llm.conftest import words


def shingles_of(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_brute_force(rows):
    sets = {i: shingles_of(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            top[high] = low
    return {i for i in sets if find(i) == i}


def copies(seed, base, changes):
    """Copies of a text with some words exchanged, from far above to below 0.8."""
    r, out = random.Random(seed), []
    for n in changes:
        w = base.split()
        for at in r.sample(range(len(w)), n):
            w[at] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_dedup_equals_exact_jaccard(spark):
    texts = []
    for i in range(30):
        base = words(500 + i, 40 + 12 * i)
        texts += [base, *copies(i, base, [n for n in range(1, 13) if n < len(base.split())])]
    passage = words(9000, 60)
    texts += [f"{passage} {words(9001 + i, 60)}" for i in range(40)]  # share much, but are no near-duplicates
    texts += copies(77, words(9500, 300), [1] * 60) + ["a b c", "A  b\nc", "a b d"]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    want = kept_by_brute_force(rows)
    assert len(got) == len(set(got)) and want <= set(got)  # nothing goes that has no partner
    assert len(rows) - len(got) >= 0.98 * (len(rows) - len(want))


def test_recall_of_the_search_at_the_threshold(spark):
    """Pairs of a similarity just above 0.8, of texts that are otherwise unlike."""
    texts, r = [], random.Random(5)
    while len(texts) < 600:
        base = words(20_000 + len(texts), r.randint(60, 400))
        for copy in copies(len(texts), base, range(1, 40)):
            a, b = shingles_of(base), shingles_of(copy)
            if 0.8 <= len(a & b) / len(a | b) < 0.84:
                texts += [base, copy]
                break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    root = {x.doc_id: x.root for x in simhash.similar(docs).collect()}
    found = sum(root[i] == root[i + 1] for i in range(0, len(texts), 2))
    assert found >= 0.95 * len(texts) / 2 and len(set(root.values())) == len(texts) - found


def test_a_large_group_does_not_hide_its_neighbours(spark):
    """A group beyond LARGE, a second one that only some of its members touch, and single texts."""
    base = words(31_000, 200)
    texts = [base, *copies(1, base, [1] * 60)]
    far = texts[7].split()
    far[50:53] = ["changed"] * 3
    far[120:123] = ["altered"] * 3
    texts += [" ".join(far), *copies(2, " ".join(far), [1] * 40), *[words(32_000 + i, 150) for i in range(30)]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = simhash.similar(docs)
    assert {r.doc_id for r in simhash.kept(found).collect()} == kept_by_brute_force(rows)


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    """Copies so changed that most pairs are somewhat below 0.8: each would be a row to verify."""
    base = words(33_000, 200)
    texts = [base, *copies(3, base, [1 + i % 7 for i in range(240)]), *[words(34_000 + i, 150) for i in range(20)]]
    monkeypatch.setattr(groups, "ROWS", 50)
    met, verify = [], simhash.verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    rows = list(enumerate(texts))
    found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in simhash.kept(found).collect()} == kept_by_brute_force(rows)
    assert sum(met) <= 6 * len(rows)


def test_forest_connects_what_the_pairs_connect():
    r = np.random.default_rng(4)
    for n, m in ((1, 1), (30, 20), (5, 60)):
        match = r.random((n, m)) < 2 / (n + m)
        found = groups.forest(match)

        def parts(pairs):
            top = {}
            for i, j in pairs:
                a, b = top.get((0, i), {(0, i)}), top.get((1, j), {(1, j)})
                top |= dict.fromkeys(a | b, a | b)
            return {frozenset(x) for x in top.values()}

        assert parts(found) == parts(np.argwhere(match).tolist())
        assert all(match[i, j] for i, j in found) and len(found) < n + m


def test_search_plan_keeps_its_promise_at_any_size():
    for n in (1, 200, 50_000, 10**7, 10**10):
        window, families, tau = simhash.plan_search(n)
        assert n / 2**window <= simhash.MATES and families >= 3 and tau < 32
    assert simhash.plan_search(10**10)[1] > simhash.plan_search(10**6)[1]


def test_odd_rows_of_the_verified_search(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = simhash.similar(odd_docs).collect()
    assert len(got) == len(rows)
    assert len({r.root for r in got if r.doc_id in (0, 1, 2, 3)}) == 1  # no words: one set
    assert len({r.root for r in got if r.doc_id in (7, 8)}) == 1
    assert simhash.similar(no_docs).count() == 0
