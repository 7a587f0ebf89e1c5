import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segloom.operators import intervals as iv

PAIRS = st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 400), st.integers(1, 120)), max_size=40)


def brute(rows, slack):
    out = []
    for k, s, e in sorted(rows):
        if out and out[-1][0] == k and s <= out[-1][2] + slack:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([k, s, e])
    return [tuple(x) for x in out]


def arrays(rows):
    rows = sorted(rows)
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


@given(PAIRS, st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_collapse_is_the_union(rows, slack):
    rows = [(k, s, s + n) for k, s, n in rows]
    got = [tuple(map(int, x)) for x in zip(*iv.collapse(*arrays(rows), slack))]
    assert got == brute(rows, slack)


@given(PAIRS, PAIRS, PAIRS, st.integers(0, 30))
@settings(max_examples=150, deadline=None)
def test_merge_is_associative_and_idempotent(a, b, c, slack):
    def lst(rows):
        return iv.collapse(*arrays([(0, s, s + n) for _, s, n in rows]), slack)[1:]

    same = lambda x, y: all(np.array_equal(p, q) for p, q in zip(x, y))
    a, b, c = lst(a), lst(b), lst(c)
    assert same(iv.merge(iv.merge(a, b, slack), c, slack), iv.merge(a, iv.merge(b, c, slack), slack))
    assert same(iv.merge(a, b, slack), iv.merge(b, a, slack))
    assert same(iv.merge(a, a, slack), a)


def test_running_end_without_room_for_offsets():
    codes = np.array([0, 0, 1, 1])
    ends = np.array([2**61, 5, -(2**61), 7])
    assert iv.running_end(codes, ends).tolist() == [2**61, 2**61, -(2**61), 7]


@pytest.mark.parametrize(
    ("low", "high", "holes"),
    [(0, 1000, [(0, 200), (400, 800), (900, 1000)]), (None, None, [(400, 800)]), (0, 950, [(0, 200), (400, 800)]), (150, 901, [(400, 800)])],
)
def test_complement(low, high, holes):
    lst = (np.array([200, 800]), np.array([400, 900]))
    assert iv.complement(lst, low, high, 50) == holes


def test_complement_of_nothing():
    assert iv.complement((np.array([], np.int64), np.array([], np.int64)), 0, 10, 1) == []
