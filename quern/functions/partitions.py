"""Cost-optimal partitions of rising sequences, and the partitioned encoding."""

from __future__ import annotations

import numpy as np

from .codecs import bitmap_decode, bitmap_encode, ceil_log2, elias_fano_decode, elias_fano_encode


def elias_fano_bits(u: int, n: int) -> int:
    low = (u // n).bit_length() - 1 if u > n else 0
    high = n + (u >> low) + 2
    return (((high - n) >> 9) + (n >> 8)) * ceil_log2(high) + high + n * low


def bitmap_bits(u: int, n: int) -> int:
    return (u >> 9) * ceil_log2(n + 1) + (n >> 8) * ceil_log2(u) + u


def best_bits(u: int, n: int) -> int:
    """Nothing for a full range, else a bit to tell and the smaller of the two forms."""
    return 0 if u == n else 1 + min(elias_fano_bits(u, n), bitmap_bits(u, n))


def _ceil_log2s(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(x, 1))).astype(np.int64)


def _best_bits(u: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``best_bits`` of arrays."""
    low = np.frexp((np.maximum(u, n) // n).astype(float))[1].astype(np.int64) - 1
    high = n + (u >> low) + 2
    ef = (((high - n) >> 9) + (n >> 8)) * _ceil_log2s(high) + high + n * low
    bitmap = (u >> 9) * _ceil_log2s(n + 1) + (n >> 8) * _ceil_log2s(u) + u
    return np.where(u == n, 0, 1 + np.minimum(ef, bitmap))


def partition(values: np.ndarray, fixed: int = 64, eps1: float = 0.03, eps2: float = 0.3) -> list[int]:
    """Ends of partitions of cost within about (1 + eps1)(1 + eps2) of the least.

    The cost of a part grows with its end.  So for each start and each budget
    fixed * (1 + eps2)^k, up to fixed / eps1, the farthest end within the budget
    is found by bisection, for all of them at once; the cheapest way from a start to
    the end of the list then takes one of these steps, worked out from the last start back.
    """
    v = np.asarray(values, np.int64)
    n = len(v)
    whole = fixed + best_bits(int(v[-1]) + 1, n)
    if whole <= 2 * fixed:  # two parts cost as much
        return [n]
    budgets = [fixed * (1 + eps2)]
    while budgets[-1] < min(whole, fixed / eps1 if eps1 else whole):
        budgets.append(budgets[-1] * (1 + eps2))
    budget = np.array(budgets)[:, None]
    start = np.arange(n)
    base = np.concatenate([[0], v[:-1] + 1])
    weigh = lambda end: fixed + _best_bits(v[end - 1] - base + 1, end - start)
    near = np.broadcast_to(start + 1, (len(budgets), n)).copy()
    far = np.full_like(near, n)
    while (near < far).any():
        middle = (near + far + 1) // 2
        fits = weigh(middle) <= budget
        near, far = np.where(fits, middle, near), np.where(fits, far, middle - 1)
    steps, costs = near.T.tolist(), weigh(near).T.tolist()
    rest, follow = [0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        rest[i], follow[i] = min((c + rest[j], j) for j, c in zip(steps[i], costs[i], strict=True))
    if whole <= rest[0]:
        return [n]
    ends, at = [], 0
    while at < n:
        at = follow[at]
        ends.append(at)
    return ends


def total_cost(values: np.ndarray, ends: list[int], fixed: int = 64) -> int:
    v, out, i = np.asarray(values, np.int64), 0, 0
    for j in ends:
        base = int(v[i - 1]) + 1 if i else 0
        out += fixed + best_bits(int(v[j - 1]) - base + 1, j - i)
        i = j
    return out


def encode_parts(values: np.ndarray, ends: list[int]) -> list[tuple[int, int, int, str, bytes]]:
    """``(n, base, upper, form, payload)`` of each partition: full range, bitmap, or Elias-Fano."""
    v, out, i = np.asarray(values, np.int64), [], 0
    for j in ends:
        base = int(v[i - 1]) + 1 if i else 0
        part, u = v[i:j] - base, int(v[j - 1]) - base + 1
        if u == j - i:
            out.append((j - i, base, int(v[j - 1]), "ones", b""))
        elif bitmap_bits(u, j - i) < elias_fano_bits(u, j - i):
            out.append((j - i, base, int(v[j - 1]), "bitmap", bitmap_encode(part, u)))
        else:
            out.append((j - i, base, int(v[j - 1]), "ef", elias_fano_encode(part, u)))
        i = j
    return out


def decode_part(n: int, base: int, upper: int, form: str, payload: bytes) -> np.ndarray:
    u = upper - base + 1
    if form == "ones":
        return base + np.arange(n)
    return base + (bitmap_decode if form == "bitmap" else elias_fano_decode)(payload, n, u)
