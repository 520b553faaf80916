"""Integer codecs by name: ``encode(values, total)`` to bytes, ``decode(data, n, total)`` back.

Values are whole numbers below 2**32 (2**28 for the Simple16 family).  ``total``
is the sum of the values if the reader knows it (document gaps) or None
(frequencies).  Byte formats follow the published descriptions of each code.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import le
from typing import NamedTuple

import numpy as np

# ---- bits -------------------------------------------------------------------


class BitWriter:
    def __init__(self) -> None:
        self._word, self._used, self._out = 0, 0, bytearray()

    def put(self, value: int, bits: int) -> None:
        self._word |= value << self._used
        self._used += bits
        if self._used >= 512:
            keep = self._used & 7
            whole = self._used - keep
            self._out += (self._word & ((1 << whole) - 1)).to_bytes(whole // 8, "little")
            self._word >>= whole
            self._used = keep

    def done(self) -> bytes:
        return bytes(self._out) + self._word.to_bytes((self._used + 7) // 8, "little")


class BitReader:
    def __init__(self, data: bytes):
        self._bits, self.at = int.from_bytes(data, "little"), 0
        self._size = 8 * len(data)

    def take(self, bits: int) -> int:
        got = (self._bits >> self.at) & ((1 << bits) - 1)
        self.at += bits
        return got

    def unary(self) -> int:
        """Zeros before the next one."""
        rest = self._bits >> self.at
        n = (rest & -rest).bit_length() - 1
        self.at += n + 1
        return n


def ceil_log2(x: int) -> int:
    return (x - 1).bit_length() if x > 1 else 0


# ---- byte codes -------------------------------------------------------------


def _widths(v: np.ndarray, step: int, most: int) -> np.ndarray:
    """Bytes of ``step`` payload bits that each value needs."""
    out = np.ones(len(v), np.int64)
    for k in range(1, most):
        out += v >= (1 << (step * k))
    return out


def _scatter(v: np.ndarray, width: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """All payload bytes, low first, and each byte's place in its value."""
    place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return (np.repeat(v, width) >> (step * place)) & ((1 << step) - 1), place


def _gather(payload: np.ndarray, width: np.ndarray, step: int) -> np.ndarray:
    if not len(width):
        return np.zeros(0, np.int64)
    first = np.cumsum(width) - width
    place = np.arange(len(payload)) - np.repeat(first, width)
    return np.add.reduceat(payload.astype(np.int64) << (step * place), first)


def vbyte_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """Seven bits a byte, low first; the high bit is set on the last byte."""
    v = np.asarray(values, np.int64)
    width = _widths(v, 7, 9)
    payload, place = _scatter(v, width, 7)
    return (payload | np.where(place == np.repeat(width, width) - 1, 128, 0)).astype(np.uint8).tobytes()


def vbyte_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b & 128)[:n] + 1
    width = np.diff(np.concatenate([[0], ends]))
    return _gather(b[: ends[-1] if n else 0] & 127, width, 7)


def masked_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """Seven bits a byte, low first; the high bit is set where another byte follows."""
    v = np.asarray(values, np.int64)
    width = _widths(v, 7, 9)
    payload, place = _scatter(v, width, 7)
    return (payload | np.where(place < np.repeat(width, width) - 1, 128, 0)).astype(np.uint8).tobytes()


def masked_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)[:n] + 1
    return _gather(b[: ends[-1] if n else 0] & 127, np.diff(np.concatenate([[0], ends])), 7)


def u32_encode(values: np.ndarray, total: int | None = None) -> bytes:
    return np.asarray(values).astype("<u4").tobytes()


def u32_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    return np.frombuffer(data, "<u4", n).astype(np.int64)


def _keys(width: np.ndarray) -> np.ndarray:
    """Two bits per value, four values a byte."""
    w = np.concatenate([width - 1, np.zeros(-len(width) % 4, np.int64)]).reshape(-1, 4)
    return (w << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8)


def _unkeys(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).ravel()[:n].astype(np.int64)


def stream_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """All length keys, then all value bytes."""
    v = np.asarray(values, np.int64)
    width = _widths(v, 8, 4)
    return _keys(width).tobytes() + _scatter(v, width, 8)[0].astype(np.uint8).tobytes()


def stream_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    k = (n + 3) // 4
    width = _unkeys(b[:k], n)
    return _gather(b[k : k + int(width.sum())], width, 8)


def group_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """A length key before every four values."""
    v = np.asarray(values, np.int64)
    return b"".join(stream_encode(v[i : i + 4]) for i in range(0, len(v), 4))


def group_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    out, at = [np.zeros(0, np.int64)], 0
    for i in range(0, n, 4):
        m = min(4, n - i)
        size = 1 + int(_unkeys(np.frombuffer(data[at : at + 1], np.uint8), m).sum())
        out.append(stream_decode(data[at : at + size], m))
        at += size
    return np.concatenate(out)


def g8iu_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """Groups of a descriptor and eight data bytes; a descriptor bit is 0 at the last byte of a value. Below eight values: interpolative."""
    v = np.asarray(values, np.int64)
    if len(v) < 8:
        return interpolative_encode(v, total)
    out, width, i = bytearray(), _widths(v, 8, 4).tolist(), 0
    while i < len(v):
        group, ends = bytearray(), 0xFF
        while i < len(v) and len(group) + width[i] <= 8:
            group += int(v[i]).to_bytes(width[i], "little")
            ends &= ~(1 << (len(group) - 1))
            i += 1
        out += bytes([ends]) + group.ljust(8, b"\0")
    return bytes(out)


def g8iu_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    if n < 8:
        return interpolative_decode(data, n, total)
    out: list[int] = []
    for at in range(0, len(data), 9):
        start = 0
        for k in range(8):
            if not data[at] >> k & 1:
                out.append(int.from_bytes(data[at + 1 + start : at + 2 + k], "little"))
                start = k + 1
    return np.array(out[:n], np.int64)


# ---- word codes -------------------------------------------------------------

# The sixteen ways to cut 28 bits.
SIMPLE16 = (
    (1,) * 28,
    (2,) * 7 + (1,) * 14,
    (1,) * 7 + (2,) * 7 + (1,) * 7,
    (1,) * 14 + (2,) * 7,
    (2,) * 14,
    (4,) + (3,) * 8,
    (3,) + (4,) * 4 + (3,) * 3,
    (4,) * 7,
    (5,) * 4 + (4,) * 2,
    (4,) * 2 + (5,) * 4,
    (6,) * 3 + (5,) * 2,
    (5,) * 2 + (6,) * 3,
    (7,) * 4,
    (10, 9, 9),
    (14,) * 2,
    (28,),
)


def simple16_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """32-bit words: four bits choose how the other 28 are cut; each word takes as many values as fit."""
    v, out, i = np.asarray(values, np.int64).tolist(), [], 0
    bits = [x.bit_length() for x in v]
    if v and max(bits) > 28:
        raise ValueError("Simple16 holds values below 2**28")
    while i < len(v):
        for selector, cuts in enumerate(SIMPLE16):
            m = min(len(cuts), len(v) - i)
            if all(map(le, bits[i : i + m], cuts)):
                word, shift = selector, 4
                for x, c in zip(v[i : i + m], cuts, strict=False):
                    word |= x << shift
                    shift += c
                out.append(word)
                i += m
                break
    return np.array(out, "<u4").tobytes()


def simple16_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    out: list[int] = []
    for word in np.frombuffer(data, "<u4").tolist():
        if len(out) >= n:
            break
        rest = word >> 4
        for c in SIMPLE16[word & 15]:
            out.append(rest & ((1 << c) - 1))
            rest >>= c
    return np.array(out[:n], np.int64)


def _pack(v: np.ndarray, bits: int) -> bytes:
    if not bits or not len(v):
        return b""
    planes = (v[:, None] >> np.arange(bits)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if not bits or not n:
        return np.zeros(n, np.int64)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits).astype(np.int64)
    return (planes << np.arange(bits)).sum(1)


def _pfor_run(part: np.ndarray, b: int) -> bytes:
    """A run with ``b`` bits a value."""
    wide = np.flatnonzero(part >> b)
    extra = simple16_encode(np.concatenate([np.diff(wide, prepend=-1) - 1, (part[wide] >> b) - 1])) if len(wide) else b""
    return bytes([b, len(wide), len(extra) // 4]) + _pack(part & ((1 << b) - 1), b) + extra


def pfor_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """Runs of 128 values in b bits each; what does not fit adds its high bits and place by Simple16.

    Sizes of all b are estimated from the counts of values by their bits; the two most promising are encoded, the smaller stays.
    """
    v, out = np.asarray(values, np.int64), []
    if len(v) and v.max() >= 1 << 28:
        raise ValueError("the exceptions' Simple16 holds values below 2**28")
    for a in range(0, len(v), 128):
        part = v[a : a + 128]
        bits = np.frexp(part.astype(float))[1]
        count = np.bincount(bits)
        top = len(count) - 1
        at = np.arange(top + 1)
        wide = len(part) - np.cumsum(count)
        over = np.maximum(at[None, :] - at[:, None], 0) @ count  # bits above b of all values
        gap = wide * np.ceil(np.log2(len(part) / np.maximum(wide, 1) + 1))
        size = np.where(wide > 127, np.inf, len(part) * at + 1.15 * (over + gap))
        best = np.argsort(size, kind="stable")[:2].tolist()
        out.append(min((_pfor_run(part, b) for b in best if wide[b] <= 127), key=len))
    return b"".join(out)


def pfor_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    out, at = [np.zeros(0, np.int64)], 0
    for a in range(0, n, 128):
        m = min(128, n - a)
        b, wide, words = data[at : at + 3]
        size = (m * b + 7) // 8
        part = _unpack(data[at + 3 : at + 3 + size], m, b)
        if wide:
            extra = simple16_decode(data[at + 3 + size : at + 3 + size + 4 * words], 2 * wide)
            part[np.cumsum(extra[:wide] + 1) - 1] |= (extra[wide:] + 1) << b
        out.append(part)
        at += 3 + size + 4 * words
    return np.concatenate(out)


# Bits of a value, and values in a quantum of 16 bytes (32 for the widths that waste less so).
QMX = ((0, 256), (1, 128), (2, 64), (3, 40), (4, 32), (5, 24), (6, 20), (7, 36), (8, 16), (9, 28), (10, 12), (12, 20), (16, 8), (21, 12), (32, 4))


def qmx_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """Quanta of equal-width values, packed; their selectors follow, with run lengths; a length leads."""
    v = np.asarray(values, np.int64)
    if len(v) < 8:
        return interpolative_encode(v, total)
    bits = np.array([int(x).bit_length() for x in v])
    payload, selectors, i = [], [], 0
    while i < len(v):
        for s, (width, count) in enumerate(QMX):
            part = bits[i : i + count]
            if part.max() <= width and (len(part) == count or s):
                break
        chunk = v[i : i + count]
        payload.append(_pack(chunk, width).ljust((count * width + 127) // 128 * 16 if len(chunk) == count else 0, b"\0"))
        if selectors and selectors[-1][0] == s and selectors[-1][1] < 16:
            selectors[-1][1] += 1
        else:
            selectors.append([s, 1])
        i += count
    body = b"".join(payload)
    return vbyte_encode(np.array([len(body)])) + body + bytes(s << 4 | (n - 1) for s, n in selectors)


def qmx_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    if n < 8:
        return interpolative_decode(data, n, total)
    size = int(vbyte_decode(data, 1)[0])
    head = next(i for i, b in enumerate(data) if b & 128) + 1
    out, at, have = [], head, 0
    for x in data[head + size :]:
        width, count = QMX[x >> 4]
        for _ in range((x & 15) + 1):
            m = min(count, n - have)
            step = (count * width + 127) // 128 * 16 if m == count else (m * width + 7) // 8
            out.append(_unpack(data[at : at + step], m, width))
            at += step
            have += m
    return np.concatenate([np.zeros(0, np.int64), *out])


# ---- bit codes --------------------------------------------------------------


def gamma_bits(n: int) -> int:
    return 2 * ((n + 1).bit_length() - 1) + 1


def put_gamma(w: BitWriter, n: int) -> None:
    k = (n + 1).bit_length() - 1
    w.put(1 << k, k + 1)
    w.put((n + 1) - (1 << k), k)


def take_gamma(r: BitReader) -> int:
    k = r.unary()
    return r.take(k) + (1 << k) - 1


def put_delta(w: BitWriter, n: int) -> None:
    k = (n + 1).bit_length() - 1
    put_gamma(w, k)
    w.put((n + 1) - (1 << k), k)


def take_delta(r: BitReader) -> int:
    k = take_gamma(r)
    return r.take(k) + (1 << k) - 1


def gamma_encode(values: np.ndarray, total: int | None = None) -> bytes:
    w = BitWriter()
    for x in np.asarray(values).tolist():
        put_gamma(w, x)
    return w.done()


def gamma_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    r = BitReader(data)
    return np.array([take_gamma(r) for _ in range(n)], np.int64)


def delta_encode(values: np.ndarray, total: int | None = None) -> bytes:
    w = BitWriter()
    for x in np.asarray(values).tolist():
        put_delta(w, x)
    return w.done()


def delta_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    r = BitReader(data)
    return np.array([take_delta(r) for _ in range(n)], np.int64)


def _put_small(w: BitWriter, value: int, size: int) -> None:
    """A number below ``size``: the low k bits, 2**k <= size, and one more where two numbers share them."""
    k = size.bit_length() - 1
    low = value & ((1 << k) - 1)
    w.put(low, k)
    if low + (1 << k) < size:
        w.put(value >> k, 1)


def _take_small(r: BitReader, size: int) -> int:
    k = size.bit_length() - 1
    low = r.take(k)
    return low | r.take(1) << k if low + (1 << k) < size else low


def interpolative_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """Prefix sums, middle first, each within what its neighbours leave open; the last sum is known or comes first."""
    sums = np.cumsum(np.asarray(values, np.int64)).tolist()
    if not sums:
        return b""
    w = BitWriter()
    todo = [(0, len(sums) - 1, 0, sums[-1])]
    while todo:
        a, b, low, high = todo.pop()
        if a < b and low < high:
            m = (a + b) // 2
            _put_small(w, sums[m] - low, high - low + 1)
            todo += [(m + 1, b, sums[m], high), (a, m, low, sums[m])]
    head = vbyte_encode(np.array([sums[-1]])) if total is None else b""
    return head + w.done()


def interpolative_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    if total is None:
        total = int(vbyte_decode(data, 1)[0])
        data = data[next(i for i, b in enumerate(data) if b & 128) + 1 :]
    r, sums, todo = BitReader(data), [0] * n, [(0, n - 1, 0, total)]
    sums[-1] = total
    while todo:
        a, b, low, high = todo.pop()
        if a < b:
            m = (a + b) // 2
            sums[m] = low + _take_small(r, high - low + 1) if low < high else low
            todo += [(m + 1, b, sums[m], high), (a, m, low, sums[m])]
    return np.diff(np.array(sums, np.int64), prepend=0)


# ---- monotone sequences -----------------------------------------------------


def elias_fano_encode(values: np.ndarray, universe: int) -> bytes:
    """A weakly rising sequence below ``universe``: low bits packed, high parts in unary."""
    v = np.asarray(values, np.int64)
    n = len(v)
    low = (universe // n).bit_length() - 1 if n and universe > n else 0
    high = np.zeros(n + (universe >> low) + 2, np.uint8)
    high[(v >> low) + np.arange(n)] = 1
    return _pack(v & ((1 << low) - 1), low) + np.packbits(high, bitorder="little").tobytes()


def elias_fano_decode(data: bytes, n: int, universe: int) -> np.ndarray:
    low = (universe // n).bit_length() - 1 if n and universe > n else 0
    cut = (n * low + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data[cut:], np.uint8), bitorder="little"))[:n] - np.arange(n)
    return (high << low) | _unpack(data[:cut], n, low)


def strict_encode(values: np.ndarray, universe: int) -> bytes:
    """A strictly rising sequence: the i-th value less i, in a universe smaller by n - 1."""
    v = np.asarray(values, np.int64)
    return elias_fano_encode(v - np.arange(len(v)), universe - len(v) + 1)


def strict_decode(data: bytes, n: int, universe: int) -> np.ndarray:
    return elias_fano_decode(data, n, universe - n + 1) + np.arange(n)


def bitmap_encode(values: np.ndarray, universe: int) -> bytes:
    """A strictly rising sequence as a bit per number of the universe."""
    bits = np.zeros(universe, np.uint8)
    bits[np.asarray(values, np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bitmap_decode(data: bytes, n: int, universe: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))[:n]


def _rising(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Prefix sums of the values plus one, from 0, and the bound that their sum gives."""
    v = np.asarray(values, np.int64)
    return np.cumsum(v + 1) - 1, int(v.sum()) + len(v)


def _with_total(values: np.ndarray, total: int | None) -> bytes:
    return vbyte_encode(np.array([int(np.sum(values))])) if total is None else b""


def _without_total(data: bytes, total: int | None) -> tuple[bytes, int]:
    if total is not None:
        return data, total
    return data[next(i for i, b in enumerate(data) if b & 128) + 1 :], int(vbyte_decode(data, 1)[0])


def ef_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """Elias-Fano of the prefix sums."""
    return _with_total(values, total) + elias_fano_encode(*_rising(values)) if len(values) else b""


def ef_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    data, total = _without_total(data, total)
    return np.diff(elias_fano_decode(data, n, total + n), prepend=-1) - 1


def single_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """The cheapest form of the prefix sums: none where all values are 0, else a byte to tell and Elias-Fano, its strict form or a bitmap."""
    if not len(values):
        return b""
    sums, universe = _rising(values)
    if universe == len(sums):
        return _with_total(values, total)
    forms = [c.encode(sums, universe) for k, c in MONOTONE.items() if k != "bitmap" or universe <= 8 * len(sums) + 64]
    k = min(range(len(forms)), key=lambda i: len(forms[i]))
    return _with_total(values, total) + bytes([k]) + forms[k]


def single_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    data, total = _without_total(data, total)
    if not total:
        return np.zeros(n, np.int64)
    return np.diff(list(MONOTONE.values())[data[0]].decode(data[1:], n, total + n), prepend=-1) - 1


class Codec(NamedTuple):
    encode: Callable[..., bytes]
    decode: Callable[..., np.ndarray]


#: Codes of rising sequences in a known universe.
MONOTONE = {"ef": Codec(elias_fano_encode, elias_fano_decode), "strict_ef": Codec(strict_encode, strict_decode), "bitmap": Codec(bitmap_encode, bitmap_decode)}

#: Codes of gap blocks and frequency blocks, or of whole lists.
CODECS = {
    "vbyte": Codec(vbyte_encode, vbyte_decode),
    "u32": Codec(u32_encode, u32_decode),
    "varintgb": Codec(group_encode, group_decode),
    "streamvbyte": Codec(stream_encode, stream_decode),
    "maskedvbyte": Codec(masked_encode, masked_decode),
    "varintg8iu": Codec(g8iu_encode, g8iu_decode),
    "simple16": Codec(simple16_encode, simple16_decode),
    "optpfor": Codec(pfor_encode, pfor_decode),
    "qmx": Codec(qmx_encode, qmx_decode),
    "interpolative": Codec(interpolative_encode, interpolative_decode),
    "gamma": Codec(gamma_encode, gamma_decode),
    "delta": Codec(delta_encode, delta_decode),
    "ef": Codec(ef_encode, ef_decode),
    "single": Codec(single_encode, single_decode),
}


def mixed_encode(values: np.ndarray, total: int | None = None) -> bytes:
    """A type byte, then the smallest of three codes."""
    best = min(((k, CODECS[c].encode(values, total)) for k, c in enumerate(MIXED)), key=lambda x: (len(x[1]), x[0]))
    return bytes([best[0]]) + best[1]


def mixed_decode(data: bytes, n: int, total: int | None = None) -> np.ndarray:
    return CODECS[MIXED[data[0]]].decode(data[1:], n, total)


MIXED = ("optpfor", "varintg8iu", "interpolative")
CODECS["mixed"] = Codec(mixed_encode, mixed_decode)
