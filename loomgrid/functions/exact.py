"""Exact tests and distribution functions in numpy, for pandas UDFs on aggregated rows."""

from __future__ import annotations

import math

import numpy as np

#: Logarithm of the share of the greatest weight below which weights beyond a window are nothing.
_NOTHING = -40.0


def _window(a: int, b: int, c: int, d: int, wider: int) -> tuple[int, np.ndarray, bool, bool]:
    """(first, log weights, left end, right end): the hypergeometric law of a 2x2 table about its mode and the table itself, and whether the support ends there.

    Weights come from the ratios of neighbours and are 0 at the table, so they are as exact for
    large tables as for small ones. ``wider`` stretches the window.
    """
    m, n, k = a + b, c + d, a + c
    low, high = max(0, k - n), min(k, m)
    mode = min(high, max(low, (m + 1) * (k + 1) // (m + n + 2)))
    sd = math.sqrt(m * n / (m + n) * (k / (m + n)) * ((m + n - k) / max(1, m + n - 1)))
    own = 1 / math.sqrt(1 / (a + 1) + 1 / (b + 1) + 1 / (c + 1) + 1 / (d + 1))
    reach = (int(14 * max(sd, own)) + 30) * wider
    first, last = max(low, min(a, mode) - reach), min(high, max(a, mode) + reach)
    x = np.arange(first, last, dtype=float)
    w = np.r_[0.0, np.cumsum(np.log((m - x) / (x + 1)) + np.log((k - x) / (n - k + x + 1)))]
    return first, w - w[a - first], first == low, last == high


def _p_two_sided(w: np.ndarray) -> float:
    p = np.exp(w - w.max())
    return min(1.0, float(p[w <= 1e-7].sum() / p.sum()))


def _root(f, start: float, low: float = -60.0, high: float = 60.0) -> float:
    """Root of an increasing function, which gives its slope too, by Newton's steps within a bracket that every step narrows."""
    t = min(max(start, low), high)
    for _ in range(200):
        value, slope = f(t)
        low, high = (t, high) if value < 0 else (low, t)
        step = t - value / slope if slope > 0 else math.nan
        after = step if low < step < high else (low + high) / 2
        if abs(after - t) < 1e-12 or high - low < 1e-11:
            return after
        t = after
    return t


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """The two-sided p of fisher() alone."""
    if min(a + b, c + d, a + c, b + d) <= 0:
        return math.nan
    wider = 1
    while True:
        _, w, left, right = _window(a, b, c, d, wider)
        if (left or w[0] < _NOTHING) and (right or w[-1] < _NOTHING):
            return _p_two_sided(w)
        wider *= 2


def fisher(a: int, b: int, c: int, d: int, level: float = 0.95) -> tuple[float, float, float, float]:
    """(p two-sided, conditional odds ratio, its interval) of the table ((a, b), (c, d)); NaN for an empty margin."""
    if min(a + b, c + d, a + c, b + d) <= 0:
        return (math.nan,) * 4
    wider = 1
    while (found := _fisher_within(a, b, c, d, level, wider)) is None:
        wider *= 2
    return found


def _fisher_within(a: int, b: int, c: int, d: int, level: float, wider: int) -> tuple[float, float, float, float] | None:
    """fisher() over a window of the support; None if that leaves out weights that matter."""
    first, w, left, right = _window(a, b, c, d, wider)
    if not ((left or w[0] < _NOTHING) and (right or w[-1] < _NOTHING)):
        return None
    at = a - first
    x = np.arange(len(w)) - float(at)
    log_alpha = math.log((1 - level) / 2)
    least, most = left and at == 0, right and at == len(w) - 1
    cut = False

    def law(t: float) -> np.ndarray:
        nonlocal cut
        v = w + x * t
        v -= v.max()
        cut = not ((left or v[0] < _NOTHING) and (right or v[-1] < _NOTHING))
        v = np.exp(v)
        return v / v.sum()

    def mean(t: float) -> tuple[float, float]:
        p = law(t)
        e = float(p @ x)
        return e, float(p @ (x * x)) - e * e

    def tail(t: float, part: slice, sign: int) -> tuple[float, float]:
        """Log of the probability of ``part`` against that of the interval's end, increasing in t."""
        p = law(t)
        some = float(p[part].sum())
        if some <= 0:
            return -sign * math.inf, 0.0
        return sign * (math.log(some) - log_alpha), sign * (float(p[part] @ x[part]) / some - float(p @ x))

    guess = math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    off = 1.96 * math.sqrt(sum(1 / (v + 0.5) for v in (a, b, c, d)))
    odds, low, high = 0.0, 0.0, math.inf
    if most:
        odds = math.inf
    elif not least:
        odds = math.exp(_root(mean, guess))
        if cut:
            return None
    if not least:
        low = math.exp(_root(lambda t: tail(t, slice(at, None), 1), guess - off))
        if cut:
            return None
    if not most:
        high = math.exp(_root(lambda t: tail(t, slice(0, at + 1), -1), guess + off))
        if cut:
            return None
    return _p_two_sided(w), odds, low, high


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_test(r: float, n: int) -> tuple[float, float, float]:
    """(two-sided p, 95 % interval by Fisher's z) of a correlation."""
    if n < 3 or r is None or abs(r) > 1:
        return (math.nan,) * 3
    if abs(r) == 1:
        return 0.0, r, r
    t2 = r * r * (n - 2) / (1 - r * r)
    p = beta_cdf((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))
    if n < 4:
        return p, math.nan, math.nan
    z, half = math.atanh(r), 1.959963984540054 / math.sqrt(n - 3)
    return p, math.tanh(z - half), math.tanh(z + half)


def chi_square_p(statistic: float, df: int = 1) -> float:
    """Upper tail; closed forms for 1 and 2 degrees of freedom, else a series."""
    if df == 1:
        return math.erfc(math.sqrt(statistic / 2))
    if df == 2:
        return math.exp(-statistic / 2)
    a, x = df / 2, statistic / 2
    term = total = 1 / a
    k = a
    while abs(term) > 1e-16 * abs(total):
        k += 1
        term *= x / k
        total += term
    return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 1.0


def dip(values: np.ndarray) -> float:
    """Hartigan's dip: half the least width of a band about a unimodal distribution function, by greatest convex minorant and least concave majorant."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return 1 / (2 * n) if n else math.nan
    cdf = np.arange(1, n + 1)
    low, high, best = 0, n - 1, 1.0

    def hull(i: int, j: int, sign: int) -> list[int]:
        left = np.arange(i, j + 1)
        while len(left) > 64:  # points on the wrong side of their neighbours' chord can't be corners
            dx, dy = np.diff(x[left]), np.diff(cdf[left])
            stay = np.r_[True, sign * (dy[:-1] * dx[1:] - dy[1:] * dx[:-1]) < 0, True]
            if stay.all():
                break
            left = left[stay]
        out = [i]
        for k in left[1:].tolist():
            while len(out) > 1 and sign * ((cdf[out[-1]] - cdf[out[-2]]) * (x[k] - x[out[-1]]) - (cdf[k] - cdf[out[-1]]) * (x[out[-1]] - x[out[-2]])) >= 0:
                out.pop()
            out.append(k)
        return out

    def at(points: list[int], k: int) -> float:
        right = next(t for t in range(1, len(points)) if points[t] >= k) if k > points[0] else 1
        i, j = points[right - 1], points[right]
        return cdf[i] + (cdf[j] - cdf[i]) * ((x[k] - x[i]) / (x[j] - x[i]) if x[j] > x[i] else 0.0)

    while True:
        convex, concave = hull(low, high, 1), hull(low, high, -1)
        gap, new_low, new_high = 0.0, low, high
        for k in convex:
            if (d := at(concave, k) - cdf[k]) > gap:
                gap, new_low, new_high = d, k, next(c for c in concave if c >= k)
        for k in concave:
            if (d := cdf[k] - at(convex, k)) > gap:
                gap, new_low, new_high = d, max(c for c in convex if c <= k), k
        if gap <= best or new_low >= new_high:
            break
        within = max((np.max(cdf[i : j + 1] - np.interp(x[i : j + 1], x[[i, j]], cdf[[i, j]]) + 1) for i, j in zip(convex, convex[1:]) if j <= new_low), default=1.0)
        within = max(within, max((np.max(np.interp(x[i : j + 1], x[[i, j]], cdf[[i, j]]) - cdf[i : j + 1] + 1) for i, j in zip(concave, concave[1:]) if i >= new_high), default=1.0))
        best = max(best, within)
        low, high = new_low, new_high
    return max(best, gap) / (2 * n)


def _corners(x: np.ndarray, rank: np.ndarray, sign: int) -> np.ndarray:
    """Places of the corners of the convex minorant (sign 1) or concave majorant (-1) of points sorted by rank."""
    left = np.arange(len(x))
    while len(left) > 64:  # points on the wrong side of their neighbours' chord can't be corners
        dx, dy = np.diff(x[left]), np.diff(rank[left])
        stay = np.r_[True, sign * (dy[:-1] * dx[1:] - dy[1:] * dx[:-1]) < 0, True]
        if stay.all():
            break
        left = left[stay]
    out: list[int] = []
    px, pr = x[left].tolist(), rank[left].tolist()
    for k in range(len(left)):
        while len(out) > 1 and sign * ((pr[out[-1]] - pr[out[-2]]) * (px[k] - px[out[-1]]) - (pr[k] - pr[out[-1]]) * (px[out[-1]] - px[out[-2]])) >= 0:
            out.pop()
        out.append(k)
    return left[out]


class Hulls:
    """Corners of both hulls of the points with ranks low to high, from any part of the points: ((x, rank), (x, rank))."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def __call__(self, x: np.ndarray, rank: np.ndarray):
        a, b = np.searchsorted(rank, [self.low, self.high + 1])
        x, rank = x[a:b], rank[a:b]
        return tuple((x[k], rank[k]) for k in (_corners(x, rank, s) for s in (1, -1)))

    @staticmethod
    def merge(parts: list):
        out = []
        for side, sign in ((0, 1), (1, -1)):
            x, rank = (np.concatenate([p[side][c] for p in parts]) for c in (0, 1))
            order = np.argsort(rank)
            x, rank = x[order], rank[order]
            k = _corners(x, rank, sign)
            out.append((x[k], rank[k]))
        return tuple(out)


class Within:
    """Greatest distance between the points and the hulls' edges that lie up to ``low`` (convex) or from ``high`` on (concave)."""

    def __init__(self, convex, concave, low: int, high: int):
        self.edges = [(x[:-1][on], x[1:][on], r[:-1][on], r[1:][on], sign) for (x, r), sign, on in ((convex, 1, convex[1][1:] <= low), (concave, -1, concave[1][:-1] >= high))]

    def __call__(self, x: np.ndarray, rank: np.ndarray) -> float:
        most = 1.0
        for x0, x1, r0, r1, sign in self.edges:
            if not len(r0):
                continue
            a, b = np.searchsorted(rank, [r0[0], r1[-1] + 1])
            p, r = x[a:b], rank[a:b]
            for edge in (np.searchsorted(r1, r), np.searchsorted(r0, r, "right") - 1):  # a corner is on two edges
                e = np.clip(edge, 0, len(r0) - 1)
                wide = x1[e] > x0[e]
                line = np.where(wide, r0[e] + (r1[e] - r0[e]) * ((p - x0[e]) / np.where(wide, x1[e] - x0[e], 1.0)), r1[e])
                if len(r):
                    most = max(most, float(np.max(sign * (r - line) + 1)))
        return most

    @staticmethod
    def merge(parts: list[float]) -> float:
        return max(parts)


def dip_of_parts(n: int, over) -> float:
    """dip() of n values, not all equal, that lie in parts: ``over(job)`` lists what ``job(x, rank)`` gives for each part, sorted by rank (from 0); any division will do."""

    def at(points, x, rank):
        i = np.maximum(1, np.searchsorted(points[1], rank))
        (x0, x1), (r0, r1) = ((c[i - 1], c[i]) for c in points)
        return r0 + (r1 - r0) * np.where(x1 > x0, (x - x0) / np.where(x1 > x0, x1 - x0, 1.0), 0.0)

    low, high, best = 0, n - 1, 1.0
    while True:
        convex, concave = Hulls.merge(over(Hulls(low, high)))
        gap, new_low, new_high = 0.0, low, high
        below, above = at(concave, *convex) - convex[1], concave[1] - at(convex, *concave)
        if (k := int(below.argmax()), below.max())[1] > gap:
            gap, new_low = float(below[k]), int(convex[1][k])
            new_high = int(concave[1][np.searchsorted(concave[1], new_low)])
        if (k := int(above.argmax()), above.max())[1] > gap:
            gap, new_high = float(above[k]), int(concave[1][k])
            new_low = int(convex[1][np.searchsorted(convex[1], new_high, "right") - 1])
        if gap <= best or new_low >= new_high:
            break
        best = max(best, Within.merge(over(Within(convex, concave, new_low, new_high))))
        low, high = new_low, new_high
    return max(best, gap) / (2 * n)


#: Cells whose counts bound the dip of a uniform sample; at least so many values of a cell make that worth it.
CELLS, CELL_VALUES = 1 << 20, 16


def uniform_dip_reaches(own: float, n: int, seed: list[int], size: int = 1 << 20) -> bool:
    """Whether the dip of n uniform numbers is ``own`` at least.

    The same sample with all values of a cell in one place differs from it by the
    cell's share nowhere more, so the dips of both differ by no more than the
    largest share. Where that leaves it open, the sample is made whole.
    """
    if n < CELLS * CELL_VALUES:
        return uniform_dip(n, seed, size) >= own
    counts = np.random.default_rng(seed).multinomial(n, np.full(CELLS, 1 / CELLS))
    at = np.flatnonzero(counts)
    last = np.cumsum(counts[at]) - 1
    x = np.repeat(at.astype(float), 2)
    rank = np.stack([last - counts[at] + 1, last], axis=1).ravel()
    stay = np.r_[True, rank[1:] > rank[:-1]]
    x, rank = x[stay], rank[stay]
    near, most = dip_of_parts(n, lambda job: [job(x, rank)]), counts.max() / n
    if abs(near - own) > most:
        return bool(near > own)
    return _uniform_dip(n, seed, counts) >= own


def uniform_dip(n: int, seed: list[int], size: int = 1 << 20) -> float:
    """The dip of n uniform numbers, made in sorted blocks of about ``size`` that are made again for each pass."""
    if n < 2:
        return dip(np.zeros(n))
    k = max(1, n // size)
    return _uniform_dip(n, seed, np.random.default_rng(seed).multinomial(n, np.full(k, 1 / k)))


def _uniform_dip(n: int, seed: list[int], counts: np.ndarray) -> float:
    """The dip of n uniform numbers of which so many lie in each of as many equal blocks."""
    k = len(counts)
    first = np.concatenate([[0], np.cumsum(counts)])

    def over(job) -> list:
        out = []
        for i in np.flatnonzero(counts).tolist():
            x = (i + np.sort(np.random.default_rng([*seed, i]).random(counts[i]))) / k
            now = job(x, np.arange(first[i], first[i + 1]))
            out = [now if not out else job.merge([out[0], now])]
        return out

    return dip_of_parts(n, over)


def dip_p(values: np.ndarray, draws: int = 200, seed: int = 1) -> tuple[float, float]:
    """(dip, share of uniform samples of that size with a dip as large), with a fixed seed."""
    own, rng = dip(values), np.random.default_rng(seed)
    return own, float(np.mean([dip(rng.random(len(values))) >= own for _ in range(draws)]))
