from __future__ import annotations

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp string, spans int, n_words int, label string, ids string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null keys and texts, empty and blank texts, repeated rows, near copies, a very long text, and columns whose names the
    operators give to their results."""
    random = np.random.default_rng(3)
    word = lambda: "".join(random.choice(list("abcdefghiéü"), random.integers(2, 9)))
    story = " ".join(word() for _ in range(300))
    passage = " ".join(word() for _ in range(120))
    texts = [None, "", " \n\t ", "!!! 123 ???", "one", "One two", "A b c\nA b c\n\nA b c d e", story, story, story + " x", story.upper(), "x" * 700, "é" * 500, passage + " " + story[:300], word() + " " + passage]
    texts += ["und " * 400, "a  b \x1c c\u00a0d\u2003e", " ".join(word() for _ in range(20_000)), "<|endoftext|> it's we'll 12345 ñandú—x " * 3]
    rows = [(k, t, ("de", "en", None)[k % 3], None, len(t) if t else None, 0.5, False, "x", 1, 2, "l", "i") for k, t in enumerate(texts)]
    rows += [rows[7], rows[2], (None, story, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 10), (500, "only here " + word(), "en", *[None] * 9)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
