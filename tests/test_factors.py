"""Mergeable factors against plain solves."""
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daycast.operators import factors as fa


def plain(x, y):
    xm, ym = x.mean(axis=0), y.mean()
    beta, *_ = np.linalg.lstsq(x - xm, y - ym, rcond=None)
    return np.concatenate([[ym - xm @ beta], beta])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_merged_factors_equal_a_plain_solve(parts):
    rng = np.random.default_rng(parts)
    x = rng.normal(size=(200, 5)) * [1, 1e5, 1e-3, 10, 1]
    x[:, 4] = x[:, 0] - x[:, 3]                     # collinear: the minimum-norm fit
    y = x @ [1, 2e-5, 3, 4, 5] + rng.normal(size=200)
    rows = fa.design(x, y)
    stacked = np.vstack([fa.triangle(p) for p in np.array_split(rows, parts)])
    np.testing.assert_allclose(fa.solve(stacked, 200), plain(x, y), rtol=1e-8)


def test_few_rows():
    x, y = np.array([[1.0, 2.0]]), np.array([5.0])
    np.testing.assert_allclose(fa.solve(fa.design(x, y), 1), [5, 0, 0])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 30), st.integers(0, 30), st.integers(1, 7), st.lists(st.booleans(), max_size=60),
       st.integers(0, 10_000))
def test_sliding_window_equals_a_plain_solve(front, base, step, moves, seed):
    rng = np.random.default_rng(seed)
    draw = lambda n: (rng.normal(size=(n, 3)) * [1, 100, 1e-2], rng.normal(size=n))
    (xf, yf), (xb, yb) = draw(front), draw(base)
    window = fa.SlidingFactor(fa.design(xf, yf), fa.triangle(fa.design(xb, yb)) if base else None, base, step)
    held = [*fa.design(xf, yf), *fa.design(xb, yb)]
    dropped = 0
    for push in moves:
        if push:
            row = fa.design(*draw(1))[0]
            window.push(row)
            held.append(row)
        elif held and (dropped < front or not base):
            window.drop()
            held.pop(0)
            dropped += 1
        assert len(window) == len(held)
        if len(held) >= 4:
            all_rows = np.array(held)
            np.testing.assert_allclose(window.solve(), plain(all_rows[:, 1:-1], all_rows[:, -1]), rtol=1e-5, atol=1e-6)


def test_rows_of_the_base_are_not_dropped():
    window = fa.SlidingFactor(np.ones((1, 3)), np.ones((1, 3)), 1)
    window.drop()
    with pytest.raises(IndexError):
        window.drop()
