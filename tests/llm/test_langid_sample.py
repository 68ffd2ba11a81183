"""The sample that op8 learns from."""

from __future__ import annotations

from nearvote.llm import langid
from tests.llm.conftest import words


def test_a_text_that_does_not_fit_removes_no_other(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "train", lambda samples: seen.update(samples))
    monkeypatch.setattr(langid, "calibrate", lambda model, checks: seen.update(checks=checks))
    rows = [(i, words(i, 5), "en") for i in range(80)] + [(1000 + i, "word " * 600, "en") for i in range(40)]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=400, sample_chars=2800)
    free = [t for i, t, _ in rows if i < 80]
    got = seen["en"] + [t for _, t in seen["checks"]]
    short = spark.createDataFrame([(i,) for i in range(80)], "doc_id long").where(~langid.is_held_out("doc_id")).count()
    assert set(got) <= set(free) and len(got) == short and len(seen["checks"]) == short // 5
