"""Dictionary codes: integer patterns of 16, 8, 4, 2 or 1 values as single symbols.

A stream is 16-bit little-endian symbols.  Symbols 0 and 1 announce a literal
of 2 or 4 bytes, 2 to 6 stand for runs of 256, 128, 64, 32 and 16 zeros, and the
rest are dictionary entries.  ``greedy`` takes the longest match, ``optimal`` the
cheapest parse by a shortest path.  ``MultiDictionary`` has a dictionary per
context and picks context and symbol width for each block.
"""

from __future__ import annotations

import numpy as np

SIZES = (16, 8, 4, 2, 1)
RUNS = (256, 128, 64, 32, 16)
RESERVED = 7
#: Entries of a dictionary: what 16-bit symbols leave.
MOST = 65_536 - RESERVED


class Dictionary:
    def __init__(self, entries: list[tuple[int, ...]]):
        """``entries`` in the order of their codes; repeats keep the first code."""
        self.entries = [tuple(e) for e in entries][:MOST]
        self.codes: dict[tuple[int, ...], int] = {}
        for i, e in enumerate(self.entries):
            self.codes.setdefault(e, i + RESERVED)

    def _steps(self, v: list[int], i: int, most: int) -> list[tuple[int, int, int]]:
        """What may stand at place ``i``: (values taken, cost in symbols, symbol)."""
        out = []
        if v[i] == 0:
            for k, run in enumerate(RUNS):
                if i + run <= len(v) and not any(v[i : i + run]):
                    out.append((run, 1, 2 + k))
                    break
        for size in SIZES:
            if i + size <= len(v):
                code = self.codes.get(tuple(v[i : i + size]))
                if code is not None and code < most:
                    out.append((size, 1, code))
        out.append((1, 2 if v[i] < 65_536 else 3, 0 if v[i] < 65_536 else 1))
        return out

    def parse(self, values, optimal: bool = True, most: int = 65_536) -> list[tuple[int, int, int]]:
        """Steps ``(values taken, cost, symbol)`` that cover the values."""
        v = np.asarray(values).tolist()
        n = len(v)
        if not optimal:
            out, i = [], 0
            while i < n:
                out.append(max(self._steps(v, i, most), key=lambda s: (s[1] == 1, s[0])))
                i += out[-1][0]
            return out
        cost = [0] * (n + 1)
        best: list[tuple[int, int, int]] = [(0, 0, 0)] * n
        for i in range(n - 1, -1, -1):
            cost[i], best[i] = min(((c + cost[i + k], (k, c, s)) for k, c, s in self._steps(v, i, most)), key=lambda x: (x[0], -x[1][0]))
        out, i = [], 0
        while i < n:
            out.append(best[i])
            i += best[i][0]
        return out

    def encode(self, values, optimal: bool = True) -> bytes:
        v, out, i = np.asarray(values).tolist(), [], 0
        for k, _, symbol in self.parse(v, optimal):
            out.append(symbol)
            if symbol == 0:
                out.append(v[i])
            elif symbol == 1:
                out += [v[i] & 0xFFFF, v[i] >> 16]
            i += k
        return np.array(out, "<u2").tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        s, out, i = np.frombuffer(data, "<u2").tolist(), [], 0
        while len(out) < n:
            x = s[i]
            i += 1
            if x >= RESERVED:
                out += self.entries[x - RESERVED]
            elif x >= 2:
                out += [0] * RUNS[x - 2]
            elif x == 0:
                out.append(s[i])
                i += 1
            else:
                out.append(s[i] | s[i + 1] << 16)
                i += 2
        return np.array(out[:n], np.int64)


CONTEXTS = 6


def context_of(values) -> int:
    """0 up to a largest value of 1, else ceil(log2(ceil(log2(largest + 1)))), 5 at most."""
    most = int(np.max(values)) if len(values) else 0
    if most <= 1:
        return 0
    bits = most.bit_length()
    return min(CONTEXTS - 1, (bits - 1).bit_length())


class MultiDictionary:
    """A dictionary per context; a block's first byte names context and symbol width."""

    def __init__(self, entries: list[list[tuple[int, ...]]]):
        self.parts = [Dictionary(e) for e in entries]

    def _narrow(self, d: Dictionary, v: list[int]) -> bytes:
        out, i = bytearray(), 0
        for k, _, symbol in d.parse(v, True, 256):
            out.append(symbol)
            if symbol < 2:
                out += v[i].to_bytes(2 if symbol == 0 else 4, "little")
            i += k
        return bytes(out)

    def encode(self, values) -> bytes:
        v = np.asarray(values).tolist()
        tries = [(bytes([c << 1]) + d.encode(v)) for c, d in enumerate(self.parts)] + [(bytes([c << 1 | 1]) + self._narrow(d, v)) for c, d in enumerate(self.parts)]
        return min(tries, key=len)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        d = self.parts[data[0] >> 1]
        if not data[0] & 1:
            return d.decode(data[1:], n)
        out, i = [], 1
        while len(out) < n:
            x = data[i]
            i += 1
            if x >= RESERVED:
                out += d.entries[x - RESERVED]
            elif x >= 2:
                out += [0] * RUNS[x - 2]
            else:
                width = 2 if x == 0 else 4
                out.append(int.from_bytes(data[i : i + width], "little"))
                i += width
        return np.array(out[:n], np.int64)


def merge_overlaps(entries: list[tuple[int, ...]]) -> list[int]:
    """One table that holds every entry as a slice: contained ones dropped, then the pair with the longest overlap joined, again and again."""
    alive: list[tuple[int, ...]] = []
    for e in sorted(set(entries), key=lambda e: (-len(e), e)):
        if not any(e == a[i : i + len(e)] for a in alive for i in range(len(a) - len(e) + 1)):
            alive.append(e)

    def overlap(a: tuple[int, ...], b: tuple[int, ...]) -> int:
        return next((k for k in range(min(len(a), len(b)) - 1, 0, -1) if a[-k:] == b[:k]), 0)

    while len(alive) > 1:
        k, i, j = max((overlap(a, b), -i, -j) for i, a in enumerate(alive) for j, b in enumerate(alive) if i != j)
        if not k:
            break
        a, b = alive[-i], alive[-j]
        alive = [e for x, e in enumerate(alive) if x not in (-i, -j)] + [a + b[k:]]
    return [x for e in alive for x in e]
