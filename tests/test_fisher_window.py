"""Fisher's test looks at a window of the support, however large the tables are."""

import math
import random
import time
from fractions import Fraction

import pytest

from loomgrid.functions import exact


def whole(a, b, c, d):
    """(p, log weights by x) over the whole support, in whole numbers."""
    m, n, k = a + b, c + d, a + c
    w = {x: math.comb(m, x) * math.comb(n, k - x) for x in range(max(0, k - n), min(k, m) + 1)}
    return float(Fraction(sum(v for v in w.values() if v <= w[a]), sum(w.values()))), w


@pytest.mark.parametrize("least", [0, 30])
def test_p_and_interval_against_the_whole_support(least):
    rng = random.Random(least)
    for _ in range(150):
        t = tuple(rng.randint(least, least + rng.choice([3, 40, 300])) for _ in range(4))
        p, odds, low, high = exact.fisher(*t)
        if min(t[0] + t[1], t[2] + t[3], t[0] + t[2], t[1] + t[3]) <= 0:
            assert math.isnan(p) and math.isnan(exact.fisher_p(*t))
            continue
        want, w = whole(*t)
        assert p == pytest.approx(want, rel=1e-9) and exact.fisher_p(*t) == pytest.approx(want, rel=1e-9)
        logs = {x: math.log(v) for x, v in w.items()}

        def law(odds):
            v = {x: y + x * math.log(odds) for x, y in logs.items()}
            top = max(v.values())
            v = {x: math.exp(y - top) for x, y in v.items()}
            total = sum(v.values())
            return {x: y / total for x, y in v.items()}

        if 0 < odds < math.inf:
            assert sum(x * y for x, y in law(odds).items()) == pytest.approx(t[0], abs=1e-6)
        if low > 0:
            assert sum(y for x, y in law(low).items() if x >= t[0]) == pytest.approx(0.025, abs=1e-7)
        if high < math.inf:
            assert sum(y for x, y in law(high).items() if x <= t[0]) == pytest.approx(0.025, abs=1e-7)


def test_large_tables_take_little_time():
    start = time.process_time()
    for i in range(100):
        p, odds, low, high = exact.fisher(7000 + 10 * i, 8000 - 10 * i, 118_000, 117_000)
        assert low < odds < high and 0 <= p <= 1
    assert time.process_time() - start < 3


def test_tables_of_hundreds_of_millions_of_pairs():
    p, odds, low, high = exact.fisher(60_000, 61_000, 112_000_000, 113_000_000)
    z = (60_000 - 121_000 * 112_060_000 / 225_121_000) / math.sqrt(121_000 * 0.25)
    assert odds == pytest.approx(60_000 * 113 / (61_000 * 112), rel=1e-6) and low < odds < high
    assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=0.05)
