"""Chinese-restaurant seating of many dishes at once, in numpy.

A dish with c customers in a restaurant of discount d and strength s: the first customer opens a table; another one joins a table of
n customers with weight n - d or opens one with weight (s + d * tables of the restaurant) * p, p being the dish's probability in
the parent restaurant.  Only the number of tables enters the predictive probability and the parent's counts, so a Gibbs step draws
that number for all customers of a dish at once.
"""

from __future__ import annotations

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    """Counts or ids of any size, at the narrowest unsigned width, compressed."""
    top = int(a.max()) if len(a) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(k).max)
    return kind[1:].encode() + zstandard.ZstdCompressor(level=1).compress(a.astype(kind).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[2:]), "<" + raw[:2].decode())
    return got if got.itemsize == 8 and got.dtype.kind == "u" and len(got) and got.max() > np.iinfo(np.int64).max else got.astype(np.int64)


def distinct_pairs(u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in ascending order, and which of them each given pair is."""
    if not len(u):
        return u, w, np.zeros(0, np.int64)
    if max(int(u.max()), int(w.max())) < 1 << 31:
        key, nth = np.unique(u << 32 | w, return_inverse=True)
        return key >> 32, key & 0xFFFFFFFF, nth
    order = np.lexsort((w, u))
    us, ws = u[order], w[order]
    new = np.append(True, (us[1:] != us[:-1]) | (ws[1:] != ws[:-1]))
    nth = np.empty(len(u), np.int64)
    nth[order] = np.cumsum(new) - 1
    return us[new], ws[new], nth


#: Up to so many customers all numbers of tables are weighed at once.
WEIGHED = 96


def _ways(d: float) -> np.ndarray:
    """log of the weight of all seatings of c customers at t tables, by (c, t): generalised Stirling numbers."""
    ways = np.zeros((WEIGHED + 1, WEIGHED + 1))
    ways[0, 0] = 1
    t = np.arange(WEIGHED + 1)
    for c in range(WEIGHED):
        ways[c + 1] = np.maximum(c - d * t, 0) * ways[c]
        ways[c + 1, 1:] += ways[c, :-1]
    with np.errstate(divide="ignore"):
        return np.log(ways)


def _weigh(c: int, others: np.ndarray, p: np.ndarray, strength: float, d: float, ways: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of ``c`` customers each, from their distribution given all other tables: a Gibbs step of the whole dish."""
    k = np.arange(c)
    if c == 2:  # the two weights' ratio is all there is
        new = (strength + d * (others + 1)) * p
        return 1 + (rng.random(len(p)) * (1 - d + new) < new)
    opened = np.log((strength + d * (others[:, None] + k)) * p[:, None])
    weight = ways[c, 1 : c + 1] + np.cumsum(opened, axis=1)
    weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return 1 + (weight <= (rng.random(len(p)) * weight[:, -1])[:, None]).sum(axis=1)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1, by Stirling's series seven places on."""
    z = x + 7.0
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(np.prod([x + k for k in range(7)], axis=0))


def log_ways(c: np.ndarray, t: np.ndarray, d: float, nodes: int = 41) -> np.ndarray:
    """log of the generalised Stirling number of many customers at t tables, in steps that do not grow with either.

    It is c! / (t! d^t) times the coefficient of z^c in (1 - (1 - z)^d)^t: Cauchy's integral over z = exp(-q) through the saddle of
    the integrand, by the trapezoid rule; near the singularity at q = 0 the path bends away from it.
    """
    c, t = c.astype(float), t.astype(float)
    inner = t < c - 1.5
    m = np.where(inner, t, 1.0)
    low, high = np.full(len(c), np.log(1e-9)), np.full(len(c), np.log(60.0))
    for _ in range(40):
        mid = (low + high) / 2
        y = -np.expm1(-np.exp(mid))
        steep = m * d * y ** (d - 1) * (1 - y) / -np.expm1(d * np.log(y)) > c
        low, high = np.where(steep, mid, low), np.where(steep, high, mid)
    q0 = np.maximum(np.exp(mid), 4 / c)
    y, e = -np.expm1(-q0), np.exp(-q0)
    f, f1 = -np.expm1(d * np.log(y)), -d * y ** (d - 1) * e
    f2 = -f1 + d * (1 - d) * y ** (d - 2) * e * e
    bend = np.where(q0 < 0.3, 1 / (4 * q0), 0.0)
    width = 1 / np.sqrt(np.maximum(m * (f2 / f - (f1 / f) ** 2), 0) + 2 * bend * c)
    v = np.linspace(0, 9, nodes)[:, None] * width
    q = q0 + 1j * v - bend * v * v
    part = (np.exp(c * (q - q0) + m * (np.log(1 - (-np.expm1(-q)) ** d) - np.log(f))) * (1 + 2j * bend * v)).real
    part[0] /= 2
    found = _log_gamma(c + 1) - _log_gamma(m + 1) - m * np.log(d) + c * q0 + m * np.log(f) + np.log(np.abs(part.sum(axis=0)) * v[1] / np.pi)
    return np.where(inner, found, np.where(t > c - 0.5, 0.0, np.log(c * (c - 1) / 2 * (1 - d))))


def _walk(c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, steps: int, rng: np.random.Generator) -> np.ndarray:
    """Metropolis steps from ``t`` towards the distribution that ``_weigh`` draws from, for dishes of many customers.

    The first proposal is the limit of that distribution for customers that far outnumber the tables, a negative binomial; then
    follow ``steps`` steps of a random walk as wide as it.
    """
    r = strength / d + others
    mean = np.minimum(r * p / (1 - p), c)
    side = lambda x: log_ways(c, x, d) + x * np.log(d) + _log_gamma(x.astype(float))
    full = lambda s, x: s - _log_gamma(x.astype(float)) + _log_gamma(r + x + 1.0) - np.log(r + x) + x * np.log(p)
    at = side(t)
    for k in range(1 + steps):
        if k == 0:
            new = 1 + rng.negative_binomial(r + 1, 1 - p)
        else:
            step = np.rint(rng.normal(size=len(c)) * 1.5 * np.sqrt(1 + mean)).astype(np.int64)
            new = t + np.where(step == 0, rng.choice([-1, 1], len(c)), step)
        fits = (new >= 1) & (new <= c)
        new = np.where(fits, new, t)
        then = side(new)
        gain = then - at if k == 0 else full(then, new) - full(at, t)
        taken = fits & (np.log1p(-rng.random(len(c))) <= gain)
        t, at = np.where(taken, new, t), np.where(taken, then, at)
    return t


def draw_tables(c: np.ndarray, before: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, steps: int, rng: np.random.Generator, first: bool = False) -> np.ndarray:
    """Tables of each dish, a Gibbs step of all its customers, given ``before``, what it had, and ``others``, the tables of the
    restaurant's other dishes.

    A single customer has one table.  Up to ``WEIGHED`` customers the number of tables is drawn from its distribution; for more,
    Metropolis steps within the Gibbs sweep leave that distribution as it is; at ``first`` they begin at a guess.
    """
    out = np.ones(len(c), np.int64)
    ways = _ways(d)
    order = np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2) :]
    sizes, at = np.unique(c[order], return_index=True)
    ends = [*at[1:].tolist(), len(order)]
    done = 0
    for size, start, end in zip(sizes.tolist(), at.tolist(), ends):
        if size > WEIGHED:
            break
        for k in range(start, end, 1 << 16):
            rows = order[k : min(end, k + (1 << 16))]
            out[rows] = _weigh(size, others[rows], p[rows], strength, d, ways, rng)
        done = end
    for k in range(done, len(order), 1 << 14):
        rows = order[k : k + (1 << 14)]
        t = before[rows]
        if first:
            guess = 1 + (strength / d + others[rows]) * p[rows] / (1 - p[rows])
            t = np.clip(guess, 1, 0.8 * c[rows]).astype(np.int64)
        out[rows] = _walk(c[rows], t, others[rows], p[rows], d, strength, steps, rng)
    return out
