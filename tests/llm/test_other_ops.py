"""op1, op4, op9 and the pipeline on odd rows and against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearvote.llm import langid, nra, preference, queries, simhash, warc
from tests.conftest import SF
from tests.llm.test_shingles import kept_by_brute_force
from tests.llm.test_text_ops import exact_model

# Revisits


def canon(spark, url):
    return spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0]


@pytest.mark.parametrize(("url", "want"), [
    ("HTTP://WWW.Example.com:80/A/b/#x", "example.com/A/b"), ("https://e.com/?b=2&utm_source=q&a=1", "e.com?a=1&b=2"), ("e.com", "e.com"),
    ("https://e.com:8080/a?ref=x&page=2", "e.com:8080/a?page=2"), ("", ""), (None, None), ("https://www2.e.com//", "e.com"),
])
def test_canonical_url(spark, url, want):
    assert canon(spark, url) == want


SCHEMA = "record_id long, kind string, status int, url string, ts long, headers map<string,string>, digest string, part string, pending boolean"


def revisit_model(rows, spark):
    from functools import cache

    key = cache(lambda u: canon(spark, u))
    out = []
    for i, kind, _, url, ts, headers, digest, *_ in rows:
        if kind != "revisit":
            continue
        mine = key(url)
        earlier = [(r[4], r[0], r) for r in rows if r[1] == "response" and r[2] == 200 and mine is not None and key(r[3]) == mine and ts is not None and r[4] is not None and r[4] < ts]
        if not earlier:
            out.append((i, "no_response", None))
            continue
        r = max(earlier, key=lambda e: e[:2])[2]
        new, old = ({k.lower(): v for k, v in (h or {}).items()} for h in (headers, r[5]))
        tag = lambda m: m["etag"].removeprefix("W/") if m.get("etag") else None
        same = tag(new) == tag(old) if tag(new) and tag(old) else new["last-modified"] == old["last-modified"] if new.get("last-modified") and old.get("last-modified") else None
        sums = digest == r[6] if digest and r[6] else None
        out.append((i, "mismatch" if False in (same, sums) else "unchecked" if same is None and sums is None else "resolved", r[0]))
    return sorted(out, key=str)


def test_header_names_that_differ_in_case(spark):
    rows = [
        (1, "response", 200, "http://a.com/", 1, {"Set-Cookie": "a", "set-cookie": "b", "ETag": "x", "etag": "x"}, None, "p", None),
        (2, "revisit", 304, "http://a.com/", 2, {"Etag": "x", "DATE": "1", "date": "2", "Date": None}, None, "p", None),
        (3, "revisit", 304, "http://a.com/", 3, None, None, "p", None),
    ]
    got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].outcome == "resolved" and got[2].headers == {"set-cookie": "a, b", "etag": "x", "date": "1, 2"}
    assert got[3].outcome == "unchecked" and warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_revisits_equal_brute_force(spark):
    r, rows = random.Random(1), []
    urls = ["http://a.com/x", "https://www.a.com/x/#f", "http://a.com/y", "http://b.com/", None, "http://hot.com/p"]
    for i in range(600):
        url = "http://hot.com/p" if r.random() < 0.4 else r.choice(urls)
        headers = r.choice([{"ETag": r.choice(['"1"', 'W/"1"', '"2"']), "Content-Length": "5"}, {"Last-Modified": r.choice("mn")}, {}, None])
        rows.append((i, r.choice(["response", "revisit", "revisit"]), r.choice([200, 200, 404]), url, r.choice([None, *range(60)]), headers, r.choice([None, "d1", "d2"]), "p", True))
    records = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((x.record_id, x.outcome, x.response_id) for x in warc.resolve(records).collect()), key=str)
    assert got == revisit_model(rows, spark)


def test_headers_are_merged(spark):
    rows = [
        (1, "response", 200, "http://a/", 1, {"ETag": '"q"', "Content-Type": "text/html", "Date": "1", "X": "old"}, "d", "", True),
        (2, "revisit", 304, "http://a", 2, {"etag": 'W/"q"', "content-type": "none", "DATE": "2"}, None, "", True),
    ]
    row = warc.resolve(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.outcome == "resolved" and row.digest == "d" and row.headers == {"etag": 'W/"q"', "content-type": "text/html", "date": "2", "x": "old"}


def test_no_records(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


# Preferences


def test_pairs(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "good"), (2, 0, "user", "u"), (3, 0, None, None), (4, 0, "user", "same"), (4, 0, "user", "same")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "bad"), (1, 4, "user", "more"), (3, 0, None, None), (4, 0, "user", "same"), (None, 0, "user", "x"), (5, None, "user", "x")]
    kind = "pair_id long, turn long, role string, text string"
    rows = {r.pair_id: r for r in preference.preference_pairs(*(spark.createDataFrame(x, kind) for x in (chosen, rejected))).collect()}
    assert set(rows) == {1, 2, 3, 4}
    one = rows[1]
    assert one.n_prompt_turns == 3 and one.prompt == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>user\nr<|im_end|>\n"
    assert [tuple(s) for s in one.chosen] == [("<|im_start|>assistant\n", False), ("good<|im_end|>", True), ("\n", False)]
    assert [s.text for s in one.rejected if s.trained] == ["bad<|im_end|>"] and "more<|im_end|>" in [s.text for s in one.rejected]
    assert rows[2].prompt == "" and rows[2].rejected == [] and len(rows[2].chosen) == 3
    assert rows[3].n_prompt_turns == 1 and rows[3].chosen == [] == rows[3].rejected
    assert rows[4].n_prompt_turns == 1 and rows[4].prompt.count("same") == 1
    none = spark.createDataFrame([], kind)
    assert preference.preference_pairs(none, none).count() == 0


def test_a_long_conversation(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", "t" * 50) for i in range(3000)]
    other = [*turns[:-1], (1, 2999, "assistant", "else")]
    kind = "pair_id long, turn long, role string, text string"
    row = preference.preference_pairs(spark.createDataFrame(turns, kind), spark.createDataFrame(other, kind)).first()
    assert row.n_prompt_turns == 2999 and [s.text for s in row.rejected if s.trained] == ["else<|im_end|>"]


# Top-k


def top_model(rows, k, every):
    v = []
    for i, x in rows:
        if i is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v.append((i, [int(np.floor(64 * float(np.float32(c)))) for c in x]))
    out, limit = [], (1 << 63) - 1
    for i in {i for i, _ in v if i % every == 0}:
        score = lambda q, x: max(-limit - 1, min(limit, sum(a * b for a, b in zip(q, x, strict=True))))
        best = sorted((-score(q, x), j) for own, q in v if own == i for j, x in v if j != i and len(x) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("segment", "block", "spread"), [(8192, 1024, 1.0), (37, 5, 1.0), (64, 16, 0.03)])
def test_top_k_equals_brute_force(spark, segment, block, spread):
    rng = np.random.default_rng(int(segment + 100 * spread))
    rows = [(i, (rng.normal(size=8) * spread).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(500, None), (520, [1.0, None]), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, rows[1][1]), (580, [0.5, 0.5]), (600, [0.25, 0.5]), (0, [9.0] * 8), (620, [])]
    frame = spark.createDataFrame([(*r, "l") for r in rows], "vec_id long, embedding array<float>, part string")
    got = nra.top_k(frame, k=20, every=20, segment=segment, block=block).collect()
    assert sorted(tuple(r) for r in got) == top_model(rows, 20, 20)


def test_top_k_of_nothing(spark):
    assert nra.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0]), (1, [1.0]), (1, [5.0])]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nra.top_k(frame(rows)).orderBy("rank").collect()] == [(0, 1, 1, 20480), (0, 2, 1, 4096)]
    rows = [(i, [float(10**e), 1.0, -float(10**e) * (i % 3)]) for i, e in enumerate((0, 2, 5, 7, 9, 9, 3, 1, 6, 8))] + [(20, [-1e9, 2.0, 1.0]), (40, [1.0, 1e-3, 0.0]), (40, [2.0, 1.0, 1.0]), (3, [1e9, 0.0, 0.0])]
    assert sorted(tuple(r) for r in nra.top_k(frame(rows), k=5).collect()) == top_model(rows, 5, 20)


def test_reading_stops_early():
    """Clustered data: the lists are left long before their end; data without structure are read to the end."""
    rng = np.random.default_rng(0)
    centres = np.eye(40, dtype=int) * 100
    x = np.concatenate([c + rng.integers(-2, 3, size=(10, 40)) for c in centres])
    ids = [np.array([i]) for i in range(len(x))]
    best = np.sort(-(x[::57] @ x.T), axis=1)[:, :10]
    found = {i: (score, depth) for i, _, score, depth in nra.search(x[::57], x, ids, 10)}
    assert [found[i][0] for i in range(len(best))] == (-best).tolist()
    entries = sum(depth * x.shape[1] for _, depth in found.values())
    assert max(d for _, d in found.values()) <= len(x) // 16 and entries <= len(best) * x.size // 16
    y = rng.integers(-9, 10, size=(500, 30))
    assert {depth for *_, depth in nra.search(y[:5], y, [np.array([i]) for i in range(500)], 10)} == {500}


# Pipeline


def test_pipeline_stages(spark, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs, SF).columns == odd_docs.columns
        assert stage(spark, no_docs, SF).count() == 0
    exact = corpus_pipeline.exact_dedup(spark, odd_docs, SF).collect()
    assert len(exact) == len({r.text or "" for r in odd_docs.collect()})


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.doc_id: r.rejected for r in langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not told[r.doc_id]]
    keep = {int(k) for _, k, _, _ in exact_model(rows)}
    rows = [(i, t) for i, t in rows if i in keep]
    left = kept_by_brute_force(rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == left
    whole = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(whole.values())


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)
