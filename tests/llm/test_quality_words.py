"""Passages and their word features come from the same words."""

import numpy as np

from forecastlab.llm import quality


def test_words_fall_in_their_passages():
    blank = "\u00a0"
    one = blank.join(["abc"] * 1000)
    got = quality.passages(one)
    assert len(got) == 1 and np.allclose(got[0, -6:], [1, 0, 4, 3, 1 / 64, 0])
    text = " ".join([f"a{blank}b"] * 64 + ["XY"] * 64)
    got = quality.passages(text)
    assert len(got) == 2 and got[0, -2] == got[1, -2] == 1 and got[0, -1] == 0 and got[1, -1] == 1
