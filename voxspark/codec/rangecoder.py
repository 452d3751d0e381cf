"""A binary adaptive range coder, and the coefficient coder on top of it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

TOP = 1 << 24
MASK = (1 << 32) - 1
HALF = 1 << 11
RATE = 5
SIGNIFICANT, UNARY = 8, 12
#: Bits of blocks that are coded and that are modelled at a time, steps that are kept, and blocks from which on one step is taken for all.
BITS, MODELLED, STEPS, TOGETHER = 1 << 24, 1 << 20, 512, 16
#: Bits that cost no more one by one than a step of all runs.
ALONE = 100


@lru_cache(1)
def _climb() -> np.ndarray:
    """By probability, the probabilities after 0, 1, .. zeros; those after the last column stay."""
    out = [np.arange(4096)]
    while (more := (4096 - out[-1]) >> RATE).any():
        out.append(out[-1] + more)
    return np.stack(out, 1).astype(np.uint16)


class Encoder:
    """Probabilities have 12 bits and move by 1/32; a carry is held back with the bytes that it may still change.

    The first byte out is the empty cache, as in the public scheme; a decoder reads five to begin with.
    """

    def __init__(self) -> None:
        self.low, self.range, self.cache, self.held = 0, MASK, 0, 0
        self.out = bytearray()

    def _shift(self) -> None:
        if self.low < 0xFF000000 or self.low > MASK:
            carry = self.low >> 32
            self.out.append((self.cache + carry) & 255)
            self.out += bytes([(255 + carry) & 255]) * self.held
            self.held = 0
            self.cache = (self.low >> 24) & 255
        else:
            self.held += 1
        self.low = (self.low << 8) & MASK

    def bit(self, p: list[int], i: int, b: int) -> None:
        bound = self.range * p[i] >> 12
        if b:
            self.low += bound
            self.range -= bound
            p[i] -= p[i] >> RATE
        else:
            self.range = bound
            p[i] += (4096 - p[i]) >> RATE
        while self.range < TOP:
            self.range = (self.range << 8) & MASK
            self._shift()

    def plain(self, value: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            self.range >>= 1
            if value >> k & 1:
                self.low += self.range
            while self.range < TOP:
                self.range = (self.range << 8) & MASK
                self._shift()

    def finish(self) -> bytes:
        for _ in range(5):
            self._shift()
        return bytes(self.out)


class Decoder:
    """Reads what an encoder wrote; beyond the end there are zeros."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.range, self.code = data, 0, MASK, 0
        for _ in range(5):
            self.code = (self.code << 8 | self._next()) & MASK

    def _next(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def _fill(self) -> None:
        while self.range < TOP:
            self.range = (self.range << 8) & MASK
            self.code = (self.code << 8 | self._next()) & MASK

    def bit(self, p: list[int], i: int) -> int:
        bound = self.range * p[i] >> 12
        if self.code < bound:
            self.range, b = bound, 0
            p[i] += (4096 - p[i]) >> RATE
        else:
            self.code -= bound
            self.range -= bound
            b = 1
            p[i] -= p[i] >> RATE
        self._fill()
        return b

    def plain(self, n: int) -> int:
        value = 0
        for _ in range(n):
            self.range >>= 1
            b = self.code >= self.range
            if b:
                self.code -= self.range
            value = value << 1 | b
            self._fill()
        return value


def end_bits(n: int) -> int:
    """Bits of an end between 0 and n."""
    return n.bit_length()


def encode_levels(levels: np.ndarray, bands: np.ndarray) -> bytes:
    """Levels in scan order: the end; then for each whether it is 0 by band, its size, its sign.

    A size is unary in twelve contexts, the last of which says that more follows: an exponential Golomb code of plain
    bits, of the rest and one.
    """
    some = np.flatnonzero(levels)
    return encode_blocks(np.array([len(some)]), some, levels[some], len(levels), bands)[0]


def encode_blocks(count: np.ndarray, places: np.ndarray, values: np.ndarray, n: int, bands: np.ndarray) -> list[bytes]:
    """The bytes of ``encode_levels`` for blocks of ``n`` levels that are 0 but for ``count`` of each, at ordered places.

    Probabilities don't depend on the range, so those of all bits come first; ranges are then narrowed bit by bit, many
    blocks side by side, and what is added to them is summed by bytes.
    """
    size = np.abs(values) - 1
    rest = np.frexp(np.maximum(size - UNARY + 2, 1))[1]
    tail = np.where(size < UNARY, size + 2, UNARY + 2 * rest)
    first = np.cumsum(count) - count
    own = np.repeat(np.arange(len(count)), count)
    end = np.zeros(len(count), np.int64)
    end[count > 0] = places[(first + count - 1)[count > 0]] + 1
    length = end_bits(n) + end + np.bincount(own, tail, len(count)).astype(np.int64)
    order = np.argsort(-length, kind="stable")
    out = [b""] * len(count)
    for whole in _parts(order, length, BITS):
        modelled = []
        for blocks in _parts(whole, length, MODELLED):
            k = count[blocks]
            at = np.repeat(first[blocks] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            modelled.append(_modelled(k, places[at], values[at], tail[at], rest[at], end[blocks], length[blocks], n, np.asarray(bands)))
        shares, kind = (np.concatenate(c) for c in zip(*modelled, strict=True))
        for b, data in zip(whole.tolist(), _narrowed(shares, kind, length[whole]), strict=True):
            out[b] = data
    return out


def _parts(blocks: np.ndarray, length: np.ndarray, most: int) -> list[np.ndarray]:
    """``blocks`` in order, in parts of about ``most`` bits."""
    part = np.cumsum(length[blocks]) // most
    return np.split(blocks, np.flatnonzero(part[1:] != part[:-1]) + 1)


def _modelled(count: np.ndarray, places: np.ndarray, values: np.ndarray, tail: np.ndarray, rest: np.ndarray, end: np.ndarray, length: np.ndarray, n: int, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of the range in 1/4096, kind) of all bits, block after block; kind is 1 for modelled 1s, 2 for plain ones, else 0."""
    start, own = np.cumsum(length) - length, np.repeat(np.arange(len(count)), count)
    before = np.cumsum(tail) - tail
    before -= np.repeat(before[np.minimum(np.cumsum(count) - count, len(before) - 1)], count) if len(before) else 0
    total, head, size = int(length.sum()), end_bits(n), np.abs(values) - 1
    shares, kind, whether = np.full(total, HALF, np.uint16), np.zeros(total, np.uint8), np.ones(total, bool)
    at = start[own] + head + places + before

    def plain(place: np.ndarray, bit: np.ndarray) -> None:
        kind[place], whether[place] = 2 * bit.astype(np.uint8), False

    for k in range(head):
        plain(start + k, end >> (head - 1 - k) & 1)
    plain(at + tail, values < 0)
    long = np.flatnonzero(size >= UNARY)
    more, bits = size[long] - UNARY + 2, rest[long]
    for j in range(2 * int(bits.max(initial=0)) - 1):
        on = j < 2 * bits - 1
        k, m = bits[on], more[on]
        plain(at[long[on]] + 1 + UNARY + j, np.where(j < k, j < k - 1, m >> np.maximum(2 * k - 2 - j, 0) & 1))
    u = np.minimum(size + 1, UNARY)
    nth = np.repeat(np.arange(len(u)), u)
    k = np.arange(len(nth)) - np.repeat(np.cumsum(u) - u, u)
    place, bit = at[nth] + 1 + k, k < size[nth]
    whether[place] = False
    p = _adapted(own[nth] * UNARY + k, bit)
    shares[place], kind[place] = np.where(bit, 4096 - p, p), bit
    place, bit = np.flatnonzero(whether), np.zeros(total, bool)
    bit[at] = True
    bit = bit[place]
    key = np.repeat(np.arange(len(count), dtype=np.int32) * SIGNIFICANT, end)
    key += bands.astype(np.int32)[np.arange(len(key)) - np.repeat(np.cumsum(end) - end, end)]
    p = _adapted(key, bit)
    shares[place], kind[place] = np.where(bit, 4096 - p, p), bit
    return shares, kind


def _adapted(key: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The probability that each bit is coded by, in order of the bits of its key: runs of 0 are looked up, 1s are stepped
    through, all keys side by side; or bit by bit where there are few keys or many 1s."""
    if not len(key):
        return np.zeros(0, np.uint16)
    order = np.argsort(key, kind="stable") if (key[1:] < key[:-1]).any() else None
    if order is not None:
        key, bit = key[order], bit[order]
    new = np.append(True, key[1:] != key[:-1])
    run = np.flatnonzero(new | np.append(False, bit[:-1]))
    size = np.diff(np.append(run, len(key)))
    climb, last = _climb(), _climb().shape[1] - 1
    zeros = np.minimum(size - bit[run + size - 1], last)
    first = np.flatnonzero(new[run])
    runs = np.diff(np.append(first, len(run)))
    if runs.max() * ALONE > len(key):
        q, column = HALF, []
        for b, begins in zip(bit.tolist(), new.tolist(), strict=True):
            if begins:
                q = HALF
            column.append(q)
            q += -(q >> RATE) if b else (4096 - q) >> RATE
        out = np.array(column, np.uint16)
    else:
        longest = np.argsort(-runs, kind="stable")
        first, active = first[longest], np.searchsorted(-runs[longest], -np.arange(runs.max()))
        p, begin = np.full(len(first), HALF, np.int64), np.empty(len(run), np.int64)
        for j, a in enumerate(active.tolist()):
            at = first[:a] + j
            begin[at] = p[:a]
            end = climb[p[:a], zeros[at]]
            p[:a] = end - (end >> RATE)
        out = climb[np.repeat(begin, size), np.minimum(np.arange(len(key)) - np.repeat(run, size), last)]
    if order is None:
        return out
    back = np.empty_like(out)
    back[order] = out
    return back


def _narrowed(shares: np.ndarray, kind: np.ndarray, length: np.ndarray) -> list[bytes]:
    """The bytes of blocks, the longest first. A range takes the share of its bit, rounded up for modelled 1s; it grows by a
    byte below 2^24, and 1s add what lies below them. A carry runs into the bytes before it, as in ``Encoder``."""
    start, width, moved = np.cumsum(length) - length, np.full(len(length), MASK, np.int64), np.zeros(len(length), np.int64)
    added: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, int(length[0]), STEPS):
        a = int(np.searchsorted(-length, -begin))
        t = np.arange(begin, min(begin + STEPS, int(length[0])))[:, None]
        inside = t < length[:a]
        at = np.where(inside, start[:a] + t, 0)
        share, what = np.where(inside, shares[at], 4096).astype(np.int64), np.where(inside, kind[at], 0)
        up = (what == 1) * 4095
        now = np.empty((len(t) + 1, a), np.int64)
        now[0] = width[:a]
        if a < TOGETHER:
            for b in range(a):
                r, column = int(width[b]), []
                for s, u in zip(share[:, b].tolist(), up[:, b].tolist(), strict=True):
                    r = (r * s + u) >> 12
                    column.append(r)
                    if r < TOP:
                        r <<= 8
                now[1:, b] = column
        else:
            # Constants as long as the rows, and a shift by arithmetic: calls on rows this short cost more than their work.
            r, by, twelve, top, sign, eight = now[0].copy(), *(np.full(a, c) for c in (0, 12, TOP, 63, 8))
            for s, u, out in zip(share, up, now[1:], strict=True):
                np.multiply(r, s, out)
                np.add(out, u, out)
                np.right_shift(out, twelve, out)
                np.subtract(out, top, by)
                np.right_shift(by, sign, by)
                np.bitwise_and(by, eight, by)
                np.left_shift(out, by, r)
        low = now < TOP
        byte = np.cumsum(low, axis=0)
        step, block = np.nonzero(what)
        was, new = now[step, block], now[step + 1, block]
        was <<= 8 * low[step, block]
        added.append((block, moved[block] + byte[step, block], np.where(what[step, block] == 1, was - new, new)))
        moved[:a] += byte[-1]
        width[:a] = now[-1] << 8 * low[-1]
    block, byte, value = (np.concatenate(c) for c in zip(*added, strict=True))
    size = moved + 5
    edge = np.append(0, np.cumsum(size))
    data = np.zeros(edge[-1], np.int64)
    for k in range(4):
        data += np.bincount(edge[block] + byte + 1 + k, value >> (24 - 8 * k) & 255, edge[-1]).astype(np.int64)
    while (carry := data >> 8).any():
        data &= 255
        data[:-1] += carry[1:]
    text = data.astype(np.uint8).tobytes()
    return [text[i:j] for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def decode_levels(data: bytes, bands: np.ndarray) -> np.ndarray:
    """An end beyond the block is cut to it; data that stop early read as zeros."""
    d, p, u = Decoder(data), [HALF] * SIGNIFICANT, [HALF] * UNARY
    out = np.zeros(len(bands), np.int64)
    end = min(d.plain(end_bits(len(bands))), len(bands))
    for i, b in enumerate(bands[:end].tolist()):
        if d.bit(p, b):
            m = 0
            while m < UNARY and d.bit(u, m):
                m += 1
            if m == UNARY:
                n = 1
                while n < 32 and d.plain(1):
                    n += 1
                m = UNARY - 2 + (1 << (n - 1) | d.plain(n - 1))
            out[i] = -(m + 1) if d.plain(1) else m + 1
    return np.clip(out, -32767, 32767)
