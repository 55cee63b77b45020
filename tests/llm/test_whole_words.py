"""The scorer of the quality classifier sees every byte of a word, however long."""

import numpy as np

from tests.llm.cases import documents
from tidemark.llm import weaklabel


def test_all_bytes_of_a_long_word_count():
    hasher = weaklabel.Hasher()
    seen = lambda text: [x.tolist() for x in hasher.features(text)]
    clean = b"a" * 64
    assert seen(clean + b"#" * 1000 + b"aaaa") != seen(clean + b"a" * 1004)
    assert seen(clean + b"#" * 500 + b"$" * 500 + b"aaaa") != seen(clean + b"#" * 1000 + b"aaaa")
    assert weaklabel.shape(clean + b"#9X") == b"a#0A"


def test_a_word_of_junk_after_letters_scores_as_junk(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    weights = weaklabel.fitted(docs, None)
    word = b"abcdefgh" * 8
    clean, junk = weaklabel.badness(weights, [word * 100, word + b"#" * 6332 + b"efgh"])
    assert np.isfinite([clean, junk]).all() and junk > clean
