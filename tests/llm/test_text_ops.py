"""op2, op7, op8, op10 against brute force, on odd rows and on the test tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from nearvote.llm import blocknames, common, langid, linedup, queries, simhash
from tests.conftest import SF
from tests.helpers import same_rows
from tests.llm.conftest import words

# Exact dedup


def exact_model(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize(("block", "by_content"), [(1024, False), (3, False), (7, True)])
def test_exact_dedup(spark, odd_docs, block, by_content):
    docs = odd_docs.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000) if block < 100 else odd_docs
    got = blocknames.exact_duplicates(docs, block=block, by_content=by_content).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.sha.hex()) for r in got) == exact_model([(r.doc_id, r.text) for r in docs.collect()])
    kept = Counter(r.sha for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.sha for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing(no_docs):
    assert blocknames.exact_duplicates(no_docs).count() == 0


def test_texts_that_share_all_blocks_but_one(spark):
    rows = [(i, "a" * i) for i in range(40)] + [(100 + i, "a" * 16 + "b" + "a" * i) for i in range(20)] + [(200, "a" * 16)]
    got = blocknames.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()
    assert {r.doc_id for r in got if not r.kept} == {16} and {r.keep_id for r in got if r.doc_id == 16} == {200}


# SimHash


def fingerprint_model(text, width=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + width]) for i in range(len(found) - width + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_model(fps, tau):
    top = {f: f for f in fps}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= tau:
            top[find(a)] = find(b)
    return find


def test_near_duplicates(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want_fp = {r.text: fingerprint_model(r.text) for r in rows}
    find = component_model(sorted(set(want_fp.values())), 4)
    least = {}
    for r in rows:
        root = find(want_fp[r.text])
        least[root] = min((x for x in (least.get(root), r.doc_id) if x is not None), default=None)
    got = simhash.near_duplicates(odd_docs).withColumn("hex", simhash.hex_fingerprint("fp")).collect()
    assert sorted((str(r.doc_id), r.hex, str(r.component_id)) for r in got) == sorted((str(r.doc_id), f"{want_fp[r.text]:016x}", str(least[find(want_fp[r.text])])) for r in rows)
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize(("tau", "m"), [(4, 5), (3, 5), (4, 8), (2, 3)])
def test_links_lose_no_pair(spark, tau, m):
    r = random.Random(tau * 10 + m)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 7))))
    signed = [(simhash.signed(f),) * 2 for f in fps]
    got = {frozenset((a % 2**64, b % 2**64)) for a, b in simhash.links(spark.createDataFrame(signed, "node long, fp long"), tau, m).collect()}
    assert got == {frozenset(p) for p in itertools.combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= tau}


def test_components_of_long_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(-5, 7), (300, 300)]
    got = dict(simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {-5} and {got[i] for i in range(100, 160)} == {100} and 300 not in got


def test_more_families_link_more(spark):
    base = words(7, 400).split()
    docs = [(0, " ".join(base))]
    for i in range(1, 40):
        copy = list(base)
        for at in random.Random(i).sample(range(400), 4):
            copy[at] = f"changed{i}"
        docs.append((i, " ".join(copy)))
    frame = spark.createDataFrame(docs + [(100 + i, words(1000 + i, 300)) for i in range(20)], "doc_id long, text string")
    more = ((4, 0), (3, 1), (3, 2), (5, 3))
    one, four = (simhash.near_duplicates(frame, families=f).where("doc_id < 100").select("component_id").distinct().count() for f in (simhash.CONTRACT, more))
    assert four <= one
    assert simhash.near_duplicates(frame, families=more).where("doc_id >= 100 AND component_id <> doc_id").count() == 0


# Lines


def line_model(rows, threshold=0.8):
    lines = [(i, n, frozenset(w for w in re.split("[ \t\r\x0b\f]+", line.lower()) if w)) for i, text in rows if text is not None for n, line in enumerate(text.split("\n"))]
    first, size = {}, Counter(s for *_, s in lines)
    for i, n, s in lines:
        first[s] = min(first.get(s, (i, n)), (i, n))
    sets = [s for s in first if s]
    linked = defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            linked[a].add(b)
            linked[b].add(a)
    out = []
    for i, n, s in lines:
        if not s:
            out.append((i, n, i, n, 1, 0, None, None, True))
            continue
        earliest = min([first[s], *(first[o] for o in linked[s])])
        match = earliest if earliest < (i, n) else (None, None)
        out.append((i, n, *first[s], size[s], len(linked[s]), *match, match == (None, None)))
    return sorted(out, key=str)


def line_rows(frame):
    return sorted(((r.doc_id, r.line_no, r.class_doc_id, r.class_line, r.class_size, r.n_links, r.match_doc_id, r.match_line, r.kept) for r in frame.collect()), key=str)


def test_lines_equal_brute_force(spark):
    r, rows = random.Random(3), []
    base = [words(i, r.randint(1, 30)) for i in range(25)]
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 4)):
            line = r.choice(base).split()
            for _ in range(r.randint(0, 3)):
                line[r.randrange(len(line))] = r.choice(["new", "other", "The", "x"])
            r.shuffle(line)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines) if lines else None))
    rows += [(100, ""), (101, " \n\n the"), (102, "THE"), (103, "x " * 3000)]
    got = linedup.matching_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert line_rows(got) == line_model(rows)


def test_frequent_words_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(linedup, "CHUNK", 7)
    base = words(77, 12).split()
    rows = [(i, "\n".join(" ".join([*base[:k], f"w{i % 23}", *base[k + 1 :]]) for k in (i % 12, (i + 5) % 12))) for i in range(60)]
    assert line_rows(linedup.matching_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == line_model(rows)


def test_lines_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    assert line_rows(linedup.matching_lines(docs)) == line_model([(r.doc_id, r.text) for r in docs.collect()])


def test_words_in_common_by_parts(monkeypatch):
    monkeypatch.setattr(linedup, "COLUMNS", 3)
    r = random.Random(5)
    sets = [[set(r.sample(range(40), r.randint(0, 12))) for _ in range(n)] for n in (9, 6)]
    a, b = ((np.repeat(np.arange(len(s)), [len(x) for x in s]), np.array([v for x in s for v in x])) for s in sets)
    assert linedup._common(a, 9, b, 6).tolist() == [[len(x & y) for y in sets[1]] for x in sets[0]]
    off = ~np.eye(9, dtype=bool)  # a set with itself is never asked for
    assert linedup._common(a, 9, a, 9)[off].tolist() == np.array([[len(x & y) for y in sets[0]] for x in sets[0]])[off].tolist()


def test_words_that_share_a_key_are_told_apart(spark):
    """Words themselves decide where a key names two of them; places and earlier words go by keys."""
    entry = "struct<place:struct<last:boolean,doc_id:long,line_no:int,line_hash:long>,cid:long,pos:int,s:array<long>,words:array<string>>"
    sets = [((False, i, 0, i), i, 1, [1, 5, 5, 6, 7, 8], ["r", w, "x", "k", "l", "m"]) for i, w in enumerate("aab")]
    rows = spark.createDataFrame([(sets, None)], f"xs array<{entry}>, ys array<{entry}>")
    links = {r.cid: (r.n_links, r.other.doc_id) for r in linedup._links(rows, 0.8).collect()}
    assert links == {}  # all share key 1, which comes before
    rows = spark.createDataFrame([([(p, c, 0, k, w) for p, c, _, k, w in sets], None)], rows.schema)
    assert {r.cid: (r.n_links, r.other.doc_id) for r in linedup._links(rows, 0.8).collect()} == {0: (1, 1), 1: (1, 0)}


def test_whole_sets_move_without_their_words(spark, monkeypatch):
    """Keys alone, but for keys that name two words: then the words come along, and the result is the same."""
    rows = [(i, "\n".join(" ".join([*words(i % 5, 9).split(), f"end{j}"]) for j in range(3))) for i in range(20)]
    docs, named, asked = spark.createDataFrame(rows, "doc_id long, text string"), linedup._whole_sets, []
    monkeypatch.setattr(linedup, "_whole_sets", lambda *x: asked.append(1) or named(*x))
    assert line_rows(linedup.matching_lines(docs)) == line_model(rows) and not asked
    cut = linedup._Cut(["ab ba\u00e9 ab", f"{'x' * 70} ba\u00e9 abab\nab"])
    a = cut.checks().tolist()
    assert a[0] == a[2] == a[6] and a[1] == a[4] and len(set(a)) == 4


def test_odd_lines(spark, odd_docs, no_docs):
    got = linedup.matching_lines(odd_docs).collect()
    assert len(got) == sum(len(r.text.split("\n")) for r in odd_docs.collect() if r.text is not None)
    copies = [r for r in got if r.doc_id in (6, 7) and r.n_words > 100]
    assert [r.kept for r in sorted(copies, key=lambda r: r.doc_id)] == [True, False]
    assert linedup.matching_lines(no_docs).count() == 0


def test_later_matches_are_removed(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nkeep me"), (2, "e d c b a\nother line"), (3, None), (4, "")], "doc_id long, text string")
    out = linedup.without_matches(docs, linedup.matching_lines(docs)).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["a b c d e\nkeep me", "other line", None, ""]


# Language


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score").alias("a"), F.max("score").alias("b"), F.count("*").alias("n")).first()
    assert row.n > 100 and row.right >= 0.97 and 0 <= row.a <= row.b <= 1
    assert found.where("rejected").count() <= 0.005 * found.count()


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = langid.train({"de": [words(i, 200, 1) for i in range(20)], "en": [words(i, 200) for i in range(20)]})
    langid.calibrate(model, [(k, words(100 + i, 60, n)) for n, k in enumerate(("en", "de")) for i in range(20)])
    rows = langid.predict(odd_docs, model).collect()
    added = langid.added_names(odd_docs)
    assert added == ["lang_pred", "_score", "_rejected"]
    for r in rows:
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == none and 0 <= r["_score"] <= 1 and (not none or (r["_rejected"] and r["_score"] == 0))
    assert langid.predict(no_docs, model).count() == 0 and langid.fit(no_docs) is None
    assert langid.predict(odd_docs, None).where("lang_pred <> 'und'").count() == 0
    strange = spark.createDataFrame([("Съешь же ещё этих мягких французских булок " * 5,), (words(900, 80, 1),)], "text string")
    assert [r.rejected for r in langid.predict(strange, model).collect()] == [True, False]


def test_probabilities_sum_to_one():
    model = langid.train({"a": ["abba cab bac", "abc"], "b": ["bbb acc"]}, order=3)
    import numpy as np

    letters = "abc"
    total = np.zeros(2)
    for text in ("", *letters, *(x + y for x in letters for y in letters)):  # words up to two letters, and all that are longer
        total += np.exp(model.log_probabilities([text])[0]) if text else 0
    start = {c: np.exp(model.log_probabilities([c])[0]) for c in letters}
    assert (total < 1).all() and all((p > 0).all() for p in start.values())
    codes = [np.exp(model.log_probabilities(["ab" + c])[0] - 0) for c in letters]
    assert all((c > 0).all() for c in codes)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.when(langid.is_held_out("doc_id"), "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.fit(changed).languages


def test_block_names_depend_on_the_data_alone(spark):
    texts = [words(i % 9, 40 + 30 * (i % 4)) for i in range(40)]
    frame = lambda n: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(n)
    one, other = ({r.doc_id: (r.level, r.name) for r in blocknames.identities(frame(n), block=32).collect()} for n in (2, 7))
    assert one == other
    lowest = sorted({name for level, name in one.values() if level == max(one.values())[0]})
    assert all(n < len(texts) for n in lowest)
    assert blocknames.identities(frame(3), block=32, by_content=True).count() == 40


# Shared parts


def test_lookup_with_hot_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("v")).where("k <> 2500")
    got = common.lookup(rows, table, ["k"], ["v"], "n", 3000)
    assert got.count() == 3000 and got.where("k = 0 AND v = 1999").count() == 2000 and got.where("v IS NULL").count() == 1
    assert common.lookup(rows, table, ["k"], ["v"], "n", 3000, how="inner").count() == 2999


def test_cleanup(spark, tmp_path):
    from pathlib import Path

    table = common.materialise(spark.range(5), "x")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and table.count() == 5
    common.discard(table)
    assert not folder.exists()


def test_keep_rows(odd_docs):
    found = blocknames.exact_duplicates(odd_docs)
    assert common.any_repeated(found)
    out = common.keep_rows(odd_docs, found.where("kept"), True)
    assert out.columns == odd_docs.columns and out.count() == found.where("kept").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])
