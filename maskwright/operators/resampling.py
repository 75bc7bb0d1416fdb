"""Portable stratified resampling: multinomial counts by keyed binomial splitting down a fixed tree.

Drawing rows anew with replacement and counting them by cell is a multinomial draw. The cells lie in their order; a stretch
of them is halved until single cells are left, and of the draws that fall to a stretch its first half gets a binomial number, the quantile at
a number that is a function of the stream, the replicate, the class and the place of the cut. The work
does not grow with the rows, and any engine that knows the log gamma function gets the same counts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Beyond this variance the quantile is that of the normal distribution with a correction for skewness.
EXACT_VARIANCE = 10_000.0
#: Standard deviations around the mean outside of which no quantile at a 32-bit number lies.
REACH = 8.0
#: Bytes of counts that are worked on at a time.
BLOCK_BYTES = 16 << 20

#: Multipliers and shifts of the mixing of 32 bits, and the golden ratio's.
GOLDEN, MIX = 2654435769, ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))


def seed(stream: str, *keys) -> int:
    """The first 32 bits of md5 of ``stream|key|key...``."""
    return int(hashlib.md5("|".join([stream, *map(str, keys)]).encode()).hexdigest()[:8], 16)


def uniforms(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each seed (rows) and place (columns) a number between 0 and 1 of 32 bits."""
    x = (seeds.astype(np.uint64)[:, None] + places.astype(np.uint64) * np.uint64(GOLDEN)) & np.uint64(0xFFFFFFFF)
    for shift, factor in MIX:
        x ^= x >> np.uint64(shift)
        if factor is not None:
            x = (x * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    return (x.astype(float) + 0.5) / 4294967296.0


_SMALL = np.array([math.lgamma(k) if k else math.inf for k in range(16)])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of whole numbers from 1 on, by Stirling's series beyond 15."""
    big = np.maximum(x, 16.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5) - 1 / (1680 * big**7)
    return np.where(x < 16, _SMALL[np.minimum(x, 15).astype(int)], series)


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """The standard normal's quantile by a rational start and two Newton steps on its distribution."""
    t = np.sqrt(-2 * np.log(np.minimum(u, 1 - u)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    z = np.where(u < 0.5, -z, z)
    erf = np.vectorize(math.erfc, otypes=[float])
    for _ in range(2):
        z = z - (0.5 * erf(-z / math.sqrt(2)) - u) / (np.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    return z


def binomial_quantile(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The least k whose binomial distribution function exceeds ``u``, for arrays of one length; ``p`` lies between 0 and 1 (exclusive)."""
    n, q = n.astype(float), 1 - p
    mean, variance = n * p, n * p * q
    out = np.zeros(len(n), np.int64)
    large = variance > EXACT_VARIANCE
    if large.any():
        z, s = normal_quantile(u[large]), np.sqrt(variance[large])
        k = np.floor(mean[large] + s * z + (q[large] - p[large]) * (z * z - 1) / 6 + 0.5)
        out[large] = np.clip(k, 0, n[large]).astype(np.int64)
    at = np.flatnonzero(~large & (n > 0))
    low = np.maximum(0.0, np.floor(mean[at] - REACH * np.sqrt(variance[at])) - 1)
    high = np.minimum(n[at], np.ceil(mean[at] + REACH * np.sqrt(variance[at])) + 20)
    n, p, q, u = n[at], p[at], q[at], u[at]
    mass = np.exp(log_gamma(n + 1) - log_gamma(low + 1) - log_gamma(n - low + 1) + low * np.log(p) + (n - low) * np.log(q))
    k, total, odds = low, mass.copy(), p / q
    open_ = np.flatnonzero((total <= u) & (k < high))
    while len(open_):
        mass[open_] *= (n[open_] - k[open_]) / (k[open_] + 1) * odds[open_]
        k[open_] += 1
        total[open_] += mass[open_]
        open_ = open_[(total[open_] <= u[open_]) & (k[open_] < high[open_])]
    out[at] = k.astype(np.int64)
    return out


def split(weights: np.ndarray, draws: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Multinomial counts (one row for each seed) of ``draws`` draws among cells of the given whole weights."""
    m = len(weights)
    out = np.zeros((len(seeds), m), np.int64)
    if not m:
        return out
    before = np.r_[0, np.cumsum(weights)].astype(float)
    low, high, have = np.array([0]), np.array([m]), draws.reshape(-1, 1).astype(np.int64)
    while len(low):
        single = high - low == 1
        out[:, low[single]] = have[:, single]
        low, high, have = low[~single], high[~single], have[:, ~single]
        if not len(low):
            break
        mid = (low + high) // 2
        whole = before[high] - before[low]
        p = np.divide(before[mid] - before[low], whole, out=np.zeros(len(low)), where=whole > 0)
        left = np.where(p >= 1, have, 0)
        live = (p > 0) & (p < 1)
        if live.any():
            u = uniforms(seeds, mid[live])
            left[:, live] = binomial_quantile(have[:, live].ravel(), np.broadcast_to(p[live], u.shape).ravel(), u.ravel()).reshape(u.shape)
        low, high, have = np.r_[low, mid], np.r_[mid, high], np.hstack([left, have - left])
    return out


def blocks(seeds: np.ndarray, cells: int):
    """Stretches of the seeds whose counts take BLOCK_BYTES at most (one seed at least)."""
    step = max(1, BLOCK_BYTES // (8 * max(cells, 1)))
    for a in range(0, len(seeds), step):
        yield slice(a, a + step)
