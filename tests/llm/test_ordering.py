"""Numbers in order by a plain sort, held against a sort of places."""

import numpy as np
import pytest

from maxentnet.llm._text import U64, distinct, ordered, ranked

RNG = np.random.default_rng(5)


@pytest.mark.parametrize(
    "x",
    [
        np.zeros(0, U64),
        np.array([5, 5, 1], U64),
        np.zeros(1000, U64),
        RNG.integers(0, 1 << 56, 70_000, dtype=U64),
        RNG.integers(0, 2**64 - 1, 70_000, dtype=U64),
        U64(2**64 - 1) - RNG.integers(0, 5, 1000, dtype=U64),
        # many that differ in their lowest bits only, which do not fit above the places
        RNG.integers(0, 40, 70_000, dtype=U64) << U64(58) | RNG.integers(0, 3000, 70_000, dtype=U64),
        RNG.integers(0, 2000, 70_000, dtype=U64) << U64(32) | RNG.integers(0, 90, 70_000, dtype=U64) * U64(47_000_000),
    ],
)
def test_ranked(x):
    order = ordered(x)
    assert (x[order] == np.sort(x)).all() and (np.sort(order) == np.arange(len(x))).all()
    values, first, index = ranked(x)
    plain, _, of = distinct(x)
    assert (values == plain).all() and (index == of).all() and (x[first] == values).all()
