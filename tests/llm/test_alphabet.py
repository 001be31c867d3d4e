"""A word's place in the suffix tree's alphabet hangs on its own count, not on the corpus."""

import numpy as np
import pytest

from riskloom.llm import suffix_tree_lm
from riskloom.llm.suffix_tree_lm import CLASSES


@pytest.mark.parametrize("others", [0, 10**3, 10**7])
def test_frequent_words_stay_apart_in_a_large_corpus(others):
    counts = np.array([40, 16, 15, 3])
    level = np.floor(np.log2(counts)).astype(int)
    totals = np.concatenate([np.bincount(level, minlength=CLASSES), np.bincount(level, counts, minlength=CLASSES)]).astype(np.int64)
    totals[20] += others
    totals[CLASSES + 20] += others << 20
    root = suffix_tree_lm.Root.__new__(suffix_tree_lm.Root)
    root.counts = counts
    root._set(totals)
    assert root.often.tolist() == [True, True, False, False]
    assert root.rare == pytest.approx((18 + 0.1 * 3) / root.whole)
