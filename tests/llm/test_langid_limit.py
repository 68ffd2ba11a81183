"""The rejection limit of op8."""

from __future__ import annotations

import numpy as np

from nearvote.llm import langid
from tests.llm.conftest import words

STRANGE = "Съешь же ещё этих мягких французских булок "


def test_one_junk_text_does_not_set_the_limit():
    model = langid.train({"de": [words(i, 200, 1) for i in range(20)], "en": [words(i, 200) for i in range(20)]})
    clean = [(k, words(100 + i, 60, n)) for n, k in enumerate(("en", "de")) for i in range(80)]
    for junk in ([], [("en", STRANGE * 5)], [("de", STRANGE * 5)]):
        langid.calibrate(model, clean + junk)
        total, size = langid._Scorer(model)([STRANGE * 4, *(words(900 + i, 80, i % 2) for i in range(20))])
        odd = model.decide(total, np.maximum(size, 1))[2]
        assert odd[0] and not odd[1:].any()
