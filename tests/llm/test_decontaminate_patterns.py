"""Every substitution pattern that op10's rule allows, for each item length."""

import itertools
import math

import pyarrow as pa
import pytest

from gridloom.llm import op10_decontaminate as op10


@pytest.mark.parametrize("n", [*range(op10.MIN_WORDS, op10.WINDOW + 1), 20])
def test_op10_finds_every_pattern_of_the_rule(n):
    words, window = [f"b{k}" for k in range(n)], min(op10.WINDOW, n)
    allowed = window - math.ceil(op10.MIN_SHARE * window)
    index = op10.SeedIndex([(9, "another item of many words that never stands in any of these texts at all"), (1, " ".join(words))])
    for first in range(n - window + 1):
        texts = []
        for pattern in itertools.combinations(range(first, first + window), allowed):
            texts.append(" ".join("x" if k in pattern or not first <= k < first + window else w for k, w in enumerate(words)))
        over = [" ".join("x" if k in pattern or not first <= k < first + window else w for k, w in enumerate(words)) for pattern in itertools.combinations(range(first, first + window), allowed + 1)]
        for found in index.leaks(pa.array(texts)):
            assert found == {1: (window - allowed) / window}
        assert not any(index.leaks(pa.array(over)))


def test_op10_window_at_the_edges_of_a_document():
    words = [f"b{k}" for k in range(20)]
    index = op10.SeedIndex([(1, " ".join(words))])
    assert [bool(x) for x in index.leaks(pa.array(["a", " ".join(words[:10]), " ".join(words[10:]), "z", " ".join(words[:9]), None]))] == [False, True, True, False, False, False]
