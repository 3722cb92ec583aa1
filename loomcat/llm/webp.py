"""Lossless WebP (VP8L) decoded and written in numpy, as columns.

`decode` reads any lossless WebP file: prefix codes (simple and normal, with several code groups),
back-references, colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. `encode` writes one with the transforms that are asked for. `decode_images` and
`encode_images` apply them to a column.

Prefix-coded streams are read all bits at once: for every bit position numpy looks up how long a
pixel, cache reference or back-reference that began there would be, then the positions where they
really begin are followed one to the next. Only images with several code groups go symbol by symbol.

`store` keeps a byte string as images, three bytes a pixel. Each image, of any size, is coded with codes
of its own and back-references, with or without a colour cache, whichever the entropy of the tokens says, after
the transform (none, subtract green, palette, predictor left or top) that leaves the least entropy; codes of eight bits, or fixed
ones for text, are taken only where they make a smaller file. `restore` reads all of them by `decode`.
`digest` does the same for many texts at once, with the same bytes (module webp_many).

Defined cases: null media give null pixels; a file that is no lossless WebP raises ValueError (or,
with on_error="null", gives nulls); null text is an empty payload, stored like any other; very long
texts take several images; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIDE, OPAQUE = 1 << 14, 0xFF000000
PREDICT, CROSS, GREEN, PALETTE = range(4)
#: Near places for short distance codes: nearest first, then lower, then further right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))
_NEAR_X, _NEAR_Y = (np.array(x) for x in zip(*NEAR, strict=True))
UNIT, ROW = 576, 192
#: The furthest distance that the 40 symbols of its code can say.
FAR = (1 << 20) - 120
#: Bits looked at together, and cache bits that are tried.
STRETCH, CACHE = 1 << 15, 8
#: Bytes of texts that are stored, or read back, at a time.
TOGETHER = 1 << 21
#: Entropies are whole numbers of these parts of a bit, so that their sums don't depend on the order.
SCALE = 256


class Bits:
    """Reads a bit string, least significant bit first."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw + bytes(8), 0

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.raw):
            raise ValueError("the image ends early")
        got = int.from_bytes(self.raw[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got


    def peek(self, n: int) -> int:
        return int.from_bytes(self.raw[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def done(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


# ---- prefix codes


_REVERSED = np.array([int(f"{x:08b}"[::-1], 2) for x in range(256)], np.int64)


def canonical(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols that occur, by length and number, with their codes (first bit lowest) and lengths."""
    size = np.asarray(lengths, np.int64)
    symbols = np.flatnonzero(size)
    symbols = symbols[np.argsort(size[symbols], kind="stable")]
    size = size[symbols]
    # a code is the sum of what the codes before it take of the whole, in units of its own length
    code = (np.cumsum(1 << (15 - size)) - (1 << (15 - size))) >> (15 - size)
    return symbols, (_REVERSED[code & 255] << 8 | _REVERSED[code >> 8]) >> (16 - size), size


@functools.cache
def _turned(bits: int) -> np.ndarray:
    """The numbers of so many bits with their bits in the other order."""
    x = np.arange(1 << bits)
    return (_REVERSED[x & 255] << 8 | _REVERSED[x >> 8]) >> (16 - bits)


class Code:
    """A prefix code as a table over the next `bits` bits."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        size = np.array(lengths, np.int64)
        symbols = np.flatnonzero(size)
        if len(symbols) < 2:
            self.bits, self.packed = 0, symbols[:1] << 4 if len(symbols) else np.zeros(1, np.int64)
            return
        size = size[symbols]
        self.bits = int(size.max())
        share = 1 << (self.bits - size)
        if share.sum() != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        # in order of the codes each symbol takes its share of the table
        by = np.argsort(size, kind="stable")
        #: 16 * symbol + length by the next `bits` bits
        self.packed = np.repeat((symbols << 4 | size)[by], share[by])[_turned(self.bits)]

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        return self.packed & 15

    @functools.cached_property
    def table(self) -> list[int]:
        return self.packed.tolist()

    def read(self, bits: Bits) -> int:
        at = bits.at
        x = self.table[int.from_bytes(bits.raw[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & ((1 << self.bits) - 1)]
        bits.at = at + (x & 15)
        return x >> 4

    def look(self, window: np.ndarray) -> np.ndarray:
        return self.packed.take(window & ((1 << self.bits) - 1))


@functools.lru_cache(maxsize=64)
def _code(lengths: bytes) -> Code:
    return Code(list(lengths))


def read_code(bits: Bits, symbols: int) -> Code:
    return _code(read_lengths(bits, symbols))


def read_lengths(bits: Bits, symbols: int) -> bytes:
    """Code lengths, a byte for each symbol."""
    lengths = bytearray(symbols)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        used = [first, bits.read(8)] if two else [first]
        for s in used:
            if s >= symbols:
                raise ValueError("a symbol is not in its alphabet")
            lengths[s] = 1
        return bytes(lengths)
    of_lengths, given = [0] * 19, 4 + bits.read(4)
    three = bits.read(3 * given)
    for k, s in enumerate(LENGTH_ORDER[:given]):
        of_lengths[s] = three >> 3 * k & 7
    code = _code(bytes(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    s, before, at, table, mask = 0, 8, bits.at, code.table, (1 << code.bits) - 1
    word = have = 0  # the bits that come next, and how many of them
    while s < symbols and left:
        left -= 1
        if have < 14:  # a length takes no more, with those that say how often
            word, have = int.from_bytes(bits.raw[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), 64 - (at & 7)
        n = table[word & mask]
        size, n = n & 15, n >> 4
        if n < 16:
            if n:
                lengths[s] = before = n
            s += 1
        else:
            first, extra = (3, 2) if n == 16 else (3, 3) if n == 17 else (11, 7)
            times = first + (word >> size & (1 << extra) - 1)
            size += extra
            if s + times > symbols:
                raise ValueError("too many code lengths")
            if n == 16:
                lengths[s : s + times] = bytes((before,)) * times
            s += times
        at, word, have = at + size, word >> size, have - size
    if at > 8 * len(bits.raw):
        raise ValueError("the image ends early")
    bits.at = at
    return bytes(lengths)


class _Recent:
    """Sets of codes read lately: one that comes again, bit by bit, is not parsed again."""

    held: list[tuple[int, tuple[int, ...], int, list[bytes]]] = []

    @classmethod
    def read(cls, bits: Bits, sizes: tuple[int, ...]) -> list[bytes]:
        for k, (n, own, value, codes) in enumerate(cls.held):
            if own == sizes and bits.at + n <= 8 * len(bits.raw) and bits.peek(n) == value:
                bits.at += n
                cls.held.insert(0, cls.held.pop(k))
                return codes
        start = bits.at
        codes = [read_lengths(bits, n) for n in sizes]
        n, bits.at = bits.at - start, start
        cls.held = [(n, sizes, bits.peek(n), codes), *cls.held[:7]]
        bits.at = start + n
        return codes


def huffman(counts: list[int], most: int) -> list[int]:
    """Code lengths of at most `most` bits for the symbols that occur."""
    if len(used := [s for s, n in enumerate(counts) if n]) < 2:
        return [int(s in used) for s in range(len(counts))]
    floor, lengths = 1, [0] * len(counts)
    while True:
        # leaves by weight and joined nodes, whose weights only grow, are two queues
        leaves = sorted((max(counts[s], floor), s) for s in used)
        n, never = len(leaves), 1 << 62
        weights = [x for x, _ in leaves] + [never] * n  # what is not joined yet weighs most
        above, leaf, node = [0] * (2 * n - 1), 0, n
        alone = weights[:n] + [never]
        for new in range(n, 2 * n - 1):
            if alone[leaf] <= weights[node]:
                total, above[leaf], leaf = alone[leaf], new, leaf + 1
            else:
                total, above[node], node = weights[node], new, node + 1
            if alone[leaf] <= weights[node]:
                total, above[leaf], leaf = total + alone[leaf], new, leaf + 1
            else:
                total, above[node], node = total + weights[node], new, node + 1
            weights[new] = total
        depth = [0] * len(above)
        for at in range(len(above) - 2, -1, -1):
            depth[at] = depth[above[at]] + 1
        if max(depth) <= most:
            for k, (_, s) in enumerate(leaves):
                lengths[s] = depth[k]
            return lengths
        floor *= 2  # a flatter distribution


def write_code(out: Writer, lengths: list[int], own: bool = False) -> None:
    """own: its lengths are written in a code made for them, which is smaller and takes longer to make."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    runs = np.array(lengths, np.int64)
    begin = np.flatnonzero(np.diff(runs, prepend=-1))
    runs = list(zip(runs[begin].tolist(), np.diff(begin, append=len(runs)).tolist(), strict=True))
    times = [0] * 19
    if own:
        for s, _, _ in (t for r in runs for t in _tokens(*r)):
            times[s] += 1
    weights = tuple(times) if own else _usual()
    text = "".join(reversed([_lengths_head(weights)[0], *(_run(*r, weights) for r in runs)]))  # the first bit is the lowest
    out.put(int(text, 2), len(text))


def _tokens(length: int, run: int) -> list[tuple[int, int, int]]:
    """Symbol, extra value and extra bits of so many equal code lengths."""
    tokens = []
    while length == 0 and run >= 3:
        part = min(run, 138)
        tokens.append((17, part - 3, 3) if part <= 10 else (18, part - 11, 7))
        run -= part
    while run >= 4:
        part = min(run, 7)
        tokens += [(length, 0, 0), (16, part - 4, 2)]
        run -= part
    return tokens + [(length, 0, 0)] * run


@functools.cache
def _usual() -> tuple[int, ...]:
    """Weights of the code that lengths are written in. It is the same for every image, so that it is made, and
    read, once: a length is more seldom the further it is from six, runs of none are frequent."""
    return (2048, *(int(4096 * 0.7 ** abs(n - 6)) for n in range(1, 16)), 1024, 2048, 2048)


@functools.lru_cache(maxsize=64)
def _lengths_head(weights: tuple[int, ...]) -> tuple[str, list[str]]:
    """What stands before the lengths of a code, and the code that they are written in, the last bit first."""
    lengths, codes = huffman(list(weights), 7), [""] * 19
    if sum(map(bool, lengths)) > 1:
        for s, code, n in zip(*(x.tolist() for x in canonical(lengths)), strict=True):
            codes[s] = f"{code:0{n}b}"
    # all lengths follow (one bit), the nineteen code lengths, how many these are, a normal code (one bit)
    return "0" + "".join(f"{lengths[s]:03b}" for s in reversed(LENGTH_ORDER)) + f"{15:04b}" + "0", codes


@functools.lru_cache(maxsize=1 << 14)
def _run(length: int, run: int, weights: tuple[int, ...]) -> str:
    """Bits of so many equal code lengths, the last one first."""
    codes = _lengths_head(weights)[1]
    return "".join((f"{extra:0{n}b}" if n else "") + codes[s] for s, extra, n in reversed(_tokens(length, run)))


def _amount(bits: Bits, symbol: int) -> int:
    """Length or distance of a prefix symbol with its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _symbol(amount: int) -> tuple[int, int, int]:
    """The other way: symbol, extra value, extra bits."""
    v = amount - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v & ((1 << top - 1) - 1), top - 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _amounts(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least amounts of prefix symbols, and how many extra bits they have."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra) + 1, extra


def _tokens_read(bits: Bits, total: int, codes: list[Code], width: int) -> tuple[np.ndarray, ...]:
    """kind (0 pixel, 1 cache, 2 copy), value (colour, slot, length), distance of each token."""
    green, red, blue, alpha, far = codes
    pad = bits.raw + bytes(16)
    left, held = total, []
    while left > 0:
        n = min(STRETCH, 8 * len(bits.raw) - bits.at, 64 + 48 * left)
        if n <= 0:
            raise ValueError("the image ends early")
        first, shift = bits.at >> 3, bits.at & 7
        words = _words(pad)[first : first + (n + shift + 7) // 8]
        window = (words[:, None] >> np.arange(8, dtype=np.int64)).ravel()[shift : shift + n]  # only low bits count
        s = green.look(window)
        size = s & 15
        own = size.copy()
        for code in (red, blue, alpha):
            if code.bits:
                window >>= own
                own = code.sizes.take(window & ((1 << code.bits) - 1))
                size += own
        at = np.flatnonzero(s >= 256 << 4) if len(green.lengths) > 280 or any(green.lengths[256:]) else ()
        if len(at):
            size[at], at = s[at] & 15, at[s[at] < 280 << 4]
            _, extra = _amounts((s[at] >> 4) - 256)
            place = bits.at + at + size[at] + extra
            d = far.look(_words(pad)[place >> 3] >> (place & 7))
            size[at] += extra + (d & 15) + _amounts(d >> 4)[1]
        step = size.astype(np.uint8).tobytes()
        p, starts = 0, []
        if step[0]:
            append = starts.append
            while p < n:
                append(p)
                p += step[p]
        else:  # codes without bits: all that is left is one colour
            starts = [0] * left
        starts = np.array(starts, np.int64)
        kind, value, distance = _token_values(pad, bits.at + starts, codes, width)
        done = np.cumsum(np.where(kind == 2, value, 1))
        stop = int(np.searchsorted(done, left)) + 1
        if stop < len(starts):
            p = int(starts[stop])
        held.append((kind[:stop], value[:stop], distance[:stop]))
        bits.at += p
        left -= int(done[min(stop, len(done)) - 1])
        if left < 0:
            raise ValueError("a back-reference leaves the image")
    if bits.at > 8 * len(bits.raw) - 64:  # Bits adds eight bytes
        raise ValueError("the image ends early")
    return tuple(np.concatenate(x) for x in zip(*held, strict=True)) if held else tuple(np.zeros(0, np.int64) for _ in range(3))


def _token_values(pad: bytes, at: np.ndarray, codes: list[Code], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = _words(pad)
    look = lambda at: words[at >> 3] >> (at & 7)
    green, red, blue, alpha, far = codes
    window = look(at)
    s = green.look(window)
    size, s = s & 15, s >> 4
    kind, distance = np.where(s < 256, 0, np.where(s < 280, 2, 1)), np.zeros(len(at), np.int64)
    colour, own = s << 8, size
    for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
        window >>= own
        x = code.look(window)
        own = x & 15
        colour |= x >> 4 << shift
    value = np.where(kind == 0, colour, s - 280)
    i = np.flatnonzero(kind == 2)
    if len(i):
        least, extra = _amounts(s[i] - 256)
        place = at[i] + size[i]
        value[i] = least + (look(place) & ((1 << extra) - 1))
        place += extra
        d = far.look(look(place))
        least, extra = _amounts(d >> 4)
        code = least + (look(place + (d & 15)) & ((1 << extra) - 1))
        near = np.minimum(code, 120) - 1
        distance[i] = np.where(code > 120, code - 120, np.maximum(1, _NEAR_X[near] + width * _NEAR_Y[near]))
    return kind, value, distance


def _words(pad: bytes) -> np.ndarray:
    """The eight bytes from each byte on, as numbers."""
    return np.ndarray((len(pad) - 7,), "<i8", pad, 0, (1,))


def _slots(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return (pixels.astype(np.uint32) * np.uint32(0x1E35A7BD) >> np.uint32(32 - cache_bits)).astype(np.int64)


def _followed(to: np.ndarray) -> np.ndarray:
    """The end of each chain of places; a place that points at itself ends one."""
    far = to[to]
    open_ = np.flatnonzero(far != to)
    while len(open_):
        before, after = far[open_], far[far[open_]]
        far[open_] = after
        open_ = open_[after != before]
    return far


def _pixels(kind: np.ndarray, value: np.ndarray, distance: np.ndarray, total: int, cache_bits: int) -> np.ndarray:
    """The image that the tokens make: each pixel points at the one that it repeats, until one that
    is given."""
    if not kind.any():
        return value.astype(np.uint32)
    size = np.where(kind == 2, value, 1)
    begin = np.cumsum(size) - size
    if (distance > begin).any():
        raise ValueError("a back-reference leaves the image")
    colour = np.zeros(total + 1, np.uint32)  # the last is an empty cache's
    colour[begin[kind == 0]] = value[kind == 0]
    kinds, place = np.repeat(kind, size), np.arange(total)
    to = place - np.where(kinds == 2, np.repeat(distance, size), 0)
    if (cached := begin[kind == 1]).size:
        slot = _slots(colour[:-1], cache_bits)
        slot[cached] = value[kind == 1]
        before = _before(slot[_followed(to)].astype(np.uint16))[cached]
        to[cached] = np.where(before < 0, total, before)
    return colour[_followed(np.append(to, total))[:-1]]


def alphabets(cache_bits: int) -> tuple[int, ...]:
    """Symbols of the codes for green, red, blue, alpha and distance."""
    return (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """ARGB of an entropy-coded image, a flat array."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, meta, side = 1, None, 0
    if main and bits.read(1):
        side = bits.read(3) + 2
        across = (width + (1 << side) - 1) >> side
        meta = (read_image(bits, across, (height + (1 << side) - 1) >> side) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    codes = [[_code(x) for x in _Recent.read(bits, alphabets(cache_bits))] for _ in range(groups)]
    total = width * height
    if groups == 1:
        return _pixels(*_tokens_read(bits, total, codes[0], width), total, cache_bits)
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    kept = 0  # pixels that are in the cache already
    while len(out) < total:
        at = len(out)
        own = codes[meta[(at // width >> side) * across + (at % width >> side)]] if meta else codes[0]
        s = own[0].read(bits)
        if s < 256:
            r, b = own[1].read(bits), own[2].read(bits)
            out.append(own[3].read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _amount(bits, s - 256)
            d = _distance(_amount(bits, own[4].read(bits)), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at - d, at - d + n):
                out.append(out[k])
        else:
            for p in out[kept:]:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            kept = at
            out.append(cache[s - 280])
        if bits.at > 8 * len(bits.raw):
            raise ValueError("the image ends early")
    return np.array(out, np.uint32)


def _before(keys: np.ndarray) -> np.ndarray:
    """The last place before each with the same key, or -1. Keys of 16 bits are sorted by digits."""
    by = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = keys[by[1:]] == keys[by[:-1]]
    out[by[1:][same]] = by[:-1][same]
    return out


def copies(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """Place, length and distance of repeats of three pixels or more, from left to right."""
    n, out = len(pixels), []
    if n < 4:
        return out
    x = pixels.astype(np.uint64)
    key = c.mix(x[:-2] | x[1:-1] << np.uint64(32)) ^ c.mix(x[2:] + np.uint64(1))
    before = _before(key)
    places = np.flatnonzero((before >= 0) & (np.arange(len(key)) - before <= FAR))
    k = 0
    while k < len(places):
        i = int(places[k])
        j, m = int(before[i]), 0
        for step in (16, 4080):
            size = min(step, n - i - m)
            same = pixels[i + m : i + m + size] == pixels[j + m : j + m + size]
            m += size if same.all() else int(same.argmin())
            if m < 16 or not size:
                break
        if m < 3:  # other pixels of the same key
            k += 1
            continue
        out.append((i, m, i - j))
        k = int(np.searchsorted(places, i + m))
    return out


def tokens(pixels: np.ndarray, found: list[tuple[int, int, int]], cache_bits: int) -> tuple[np.ndarray, ...]:
    """kind, value and distance of tokens that make the image, as _pixels takes them."""
    n = len(pixels)
    begin, size, distance = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    free = np.ones(n, bool)
    for i, m, _ in found:
        free[i : i + m] = False
    at = np.flatnonzero(free)
    kind, value = np.zeros(len(at), np.int64), pixels[at].astype(np.int64)
    if cache_bits:
        slot = _slots(pixels, cache_bits)
        before = _before(slot.astype(np.uint16))[at]
        known = (before >= 0) & (pixels[before] == pixels[at])
        kind[known], value[known] = 1, slot[at[known]]
    order = np.argsort(np.concatenate((at, begin)), kind="stable")
    return tuple(np.concatenate(x)[order] for x in ((kind, np.full(len(begin), 2)), (value, size), (np.zeros(len(at), np.int64), distance)))


def _prefixed(amount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of amounts, values and numbers of their extra bits."""
    v = amount - 1
    top = np.where(v < 4, 2, np.frexp(np.maximum(v, 1).astype(float))[1] - 1)
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> extra & 1)), v & ((1 << extra) - 1), extra


@functools.lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}


def _distance_codes(distance: np.ndarray, width: int) -> np.ndarray:
    near = _near_codes(width)
    return np.array([near.get(d, d + 120) for d in distance.tolist()], np.int64)


_NOTHING = (np.zeros(0, np.int64),) * 3


@functools.cache
def _weights() -> np.ndarray:
    n = np.arange(1 << 16)
    return np.rint(SCALE * n * np.log2(np.maximum(n, 1))).astype(np.int64)


def weight(n: np.ndarray | list[int] | int) -> np.ndarray:
    """n log2 n in parts of a bit."""
    n = np.asarray(n)
    return _weights()[n] if n.max(initial=0) < 1 << 16 else np.rint(SCALE * n * np.log2(np.maximum(n, 1))).astype(np.int64)


class Coded:
    """Tokens with prefix codes of their own, or given ones; like: other tokens with the same copies."""

    def __init__(self, found: tuple[np.ndarray, ...], width: int, cache_bits: int, lengths: list[list[int]] | None = None, like: Coded | None = None):
        kind, value, distance = found
        self.cache_bits, self.pixel = cache_bits, kind == 0
        v = value[self.pixel]
        self.channels = [v >> shift & 255 for shift in (8, 16, 0, 24)]
        self.kind = kind
        self.slots = value[kind == 1]
        copy = kind == 2
        self.sizes, self.far = (like.sizes, like.far) if like else (_prefixed(value[copy]), _prefixed(_distance_codes(distance[copy], width))) if copy.any() else (_NOTHING, _NOTHING)
        n = 280 + (1 << cache_bits if cache_bits else 0)
        greens = np.bincount(np.concatenate((self.channels[0], 280 + self.slots, 256 + self.sizes[0])), minlength=n)
        self.counts = [greens, *(np.bincount(x, minlength=256) for x in self.channels[1:]), np.bincount(self.far[0], minlength=40)]
        self.given = lengths

    @functools.cached_property
    def lengths(self) -> list[list[int]]:
        if self.given is not None:
            return self.given
        lengths = [huffman(x.tolist(), 15) for x in self.counts]
        if sum(map(bool, lengths[0])) == 1 and not any(lengths[0][:256]):
            lengths[0][0] = 1  # a lone symbol above 255 can't be written as a simple code
        return lengths

    @functools.cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_coder(tuple(x)) for x in self.lengths]

    def size(self) -> int:
        """Parts of bits that the tokens need at least, with four bits for the length of each symbol's code."""
        n = np.concatenate(self.counts)
        own = int(weight([x.sum() for x in self.counts]).sum() - weight(n).sum())
        return own + SCALE * (4 * int((n > 0).sum()) + int(self.sizes[2].sum() + self.far[2].sum()))

    def _fields(self) -> tuple[np.ndarray, np.ndarray]:
        value, size = np.zeros(len(self.kind), np.uint64), np.zeros(len(self.kind), np.int64)

        def put(at, v, n):
            value[at] |= np.asarray(v).astype(np.uint64) << size[at].astype(np.uint64)
            size[at] += n

        pixel, cache, copy = (np.flatnonzero(self.kind == k) for k in (0, 1, 2))
        for x, (codes, n) in zip(self.channels, self.tables, strict=False):
            put(pixel, codes[x], n[x])
        greens, fars = self.tables[0], self.tables[4]
        put(cache, greens[0][280 + self.slots], greens[1][280 + self.slots])
        for (s, extra, m), (codes, n), base in ((self.sizes, greens, 256), (self.far, fars, 0)):
            put(copy, codes[base + s], n[base + s])
            put(copy, extra, m)
        return value, size

    def write(self, out: Writer) -> None:
        _put_all(out, *self._fields())


def _put_all(out: Writer, value: np.ndarray, size: np.ndarray) -> None:
    """Puts many values of up to 64 bits: each falls into one 64-bit word and the next."""
    begin = np.cumsum(size) - size
    word, shift = begin >> 6, (begin & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))[: len(word)]
    words = np.zeros((int(size.sum()) >> 6) + 2, np.uint64)
    if len(first):
        words[word[first]] = np.bitwise_or.reduceat(value << shift, first)
        words[word[first] + 1] |= np.bitwise_or.reduceat(value >> np.uint64(1) >> (np.uint64(63) - shift), first)
    out.put(int.from_bytes(words.astype("<u8").tobytes(), "little"), int(size.sum()))


@functools.lru_cache(maxsize=64)
def _coder(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their lengths by symbol; none for a lone symbol."""
    code, size = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    if sum(map(bool, lengths)) > 1:
        symbols, values, sizes = canonical(list(lengths))
        code[symbols], size[symbols] = values, sizes
    return code, size


def write_image(out: Writer, pixels: np.ndarray, width: int, main: bool = False, cache_bits: int | None = 0, lz: bool = False) -> None:
    """cache_bits None: none or CACHE, whichever needs fewer bits by the entropy of its tokens."""
    pixels = np.asarray(pixels, np.uint32)
    found = copies(pixels) if lz else []
    coded = Coded(tokens(pixels, found, cache_bits or 0), width, cache_bits or 0)
    if cache_bits is None:
        coded = min(coded, Coded(tokens(pixels, found, CACHE), width, CACHE, like=coded), key=Coded.size)
    _image_head(out, main, coded.cache_bits, coded.lengths)
    coded.write(out)


def _image_head(out: Writer, main: bool, cache_bits: int, lengths: list[list[int]], own: bool = False) -> None:
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    for x in lengths:
        write_code(out, x, own)


# ---- transforms


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def _halfway(p: int, q: int) -> int:
    return (((p ^ q) & 0xFEFEFEFE) >> 1) + (p & q)


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The 14 predictors, from the pixels to the left, above, above right and above left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _halfway(_halfway(left, right), top)
    if mode == 6:
        return _halfway(left, corner)
    if mode == 7:
        return _halfway(left, top)
    if mode == 8:
        return _halfway(corner, top)
    if mode == 9:
        return _halfway(top, right)
    if mode == 10:
        return _halfway(_halfway(left, corner), _halfway(top, right))
    if mode == 11:
        to_left = sum(abs(t - k) for t, k in zip(_channels(top), _channels(corner), strict=True))
        to_top = sum(abs(n - k) for n, k in zip(_channels(left), _channels(corner), strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return _joined(_clip(n + t - k) for n, t, k in zip(_channels(left), _channels(top), _channels(corner), strict=True))
    if mode == 13:
        return _joined(_clip(m + int((m - k) / 2)) for m, k in zip(_channels(_halfway(left, top)), _channels(corner), strict=True))
    return OPAQUE


def _add(p: int, q: int) -> int:
    return ((p & 0xFF00FF00) + (q & 0xFF00FF00)) & 0xFF00FF00 | ((p & 0x00FF00FF) + (q & 0x00FF00FF)) & 0x00FF00FF


def _sub(p: int, q: int) -> int:
    return _joined((x - y) & 255 for x, y in zip(_channels(p), _channels(q), strict=True))


def predict(values: np.ndarray, modes: np.ndarray, width: int, side: int, inverse: bool) -> np.ndarray:
    """Residuals to pixels (inverse) or pixels to residuals."""
    used = np.unique(modes >> np.uint32(8) & np.uint32(15))
    if len(used) == 1 and used[0] in (1, 2):
        return _one_way(values, int(used[0]), width, inverse)
    values, out, across = values.tolist(), [], (width + (1 << side) - 1) >> side
    modes = (modes >> 8 & 15).tolist()
    known = out if inverse else values
    for i, v in enumerate(values):
        y, x = divmod(i, width)
        if not i:
            p = OPAQUE
        elif not y:
            p = known[i - 1]
        elif not x:
            p = known[i - width]
        else:
            p = predicted(modes[(y >> side) * across + (x >> side)], known[i - 1], known[i - width], known[i - width + 1], known[i - width - 1])
        out.append(_add(v, p) if inverse else _sub(v, p))
    return np.array(out, np.uint32)


def _one_way(values: np.ndarray, mode: int, width: int, inverse: bool) -> np.ndarray:
    """predict where every block has mode 1 (left) or 2 (top); bytes add up modulo 256."""
    x = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, width, 4)
    out = x.copy()
    if inverse:
        out[0, 0, 3] += np.uint8(255)
        edge = out[:, 0] if mode == 1 else out[0]
        np.cumsum(edge, axis=0, dtype=np.uint8, out=edge)
        np.cumsum(out, axis=2 - mode, dtype=np.uint8, out=out)
    else:
        edge = (out[:, 0], x[:, 0]) if mode == 1 else (out[0], x[0])
        edge[0][1:] -= edge[1][:-1]
        if mode == 1:
            out[:, 1:] -= x[:, :-1]
        else:
            out[1:] -= x[:-1]
        out[0, 0, 3] -= np.uint8(255)
    return out.reshape(-1).view("<u4")


def _split(pixels: np.ndarray) -> list[np.ndarray]:
    return [(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (24, 16, 8, 0)]


def _merge(a, r, g, b) -> np.ndarray:
    return ((a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255).astype(np.uint32)


def _byte(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 255) - 128


def cross_colour(pixels: np.ndarray, factors: np.ndarray, width: int, side: int, inverse: bool) -> np.ndarray:
    y, x = np.divmod(np.arange(len(pixels)), width)
    m = factors[(y >> side) * ((width + (1 << side) - 1) >> side) + (x >> side)]
    _, red_blue, green_blue, green_red = map(_byte, _split(m))
    a, r, g, b = _split(pixels)
    sign = 1 if inverse else -1
    new_r = r + sign * (green_red * _byte(g) >> 5) & 255
    b = b + sign * ((green_blue * _byte(g) >> 5) + (red_blue * _byte(new_r if inverse else r) >> 5))
    return _merge(a, new_r, g, b)


def subtract_green(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    out = np.array(pixels, "<u4").reshape(-1, 1).view(np.uint8)
    if inverse:
        out[:, 0:3:2] += out[:, 1:2]
    else:
        out[:, 0:3:2] -= out[:, 1:2]
    return out.view("<u4").ravel()


def _bundle(colours: int) -> int:
    """Pixels that share one are 2 to this power."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(packed: np.ndarray, table: np.ndarray, width: int, height: int) -> np.ndarray:
    k = _bundle(len(table))
    rows = (packed >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    bits, x = 8 >> k, np.arange(width)
    index = rows[:, x >> k] >> (bits * (x & ((1 << k) - 1))).astype(np.uint32) & np.uint32((1 << bits) - 1)
    padded = np.zeros(max(256, len(table)), np.uint32)
    padded[: len(table)] = table
    return padded[index].ravel()


def to_palette(pixels: np.ndarray, table: np.ndarray, width: int, height: int) -> np.ndarray:
    k = _bundle(len(table))
    index = np.searchsorted(table, pixels).reshape(height, width)
    bits, across = 8 >> k, (width + (1 << k) - 1) >> k
    out = np.zeros((height, across), np.uint32)
    for x in range(1 << k):
        part = index[:, x :: 1 << k]
        out[:, : part.shape[1]] |= (part << bits * x).astype(np.uint32)
    return (out << np.uint32(8) | np.uint32(OPAQUE)).ravel()


# ---- files


def _lossless(raw: bytes) -> bytes:
    if raw[:4] != b"RIFF" or raw[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while at + 8 <= len(raw):
        size = int.from_bytes(raw[at + 4 : at + 8], "little")
        if raw[at : at + 4] == b"VP8L":
            return raw[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in this WebP file")


def opened(raw: bytes) -> tuple[Bits, int, int, int, list[tuple], bool]:
    """What stands before the main image: width, width after the transforms, height, the transforms, and whether alpha counts."""
    bits = Bits(_lossless(raw))
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha, version = bits.read(1), bits.read(3)
    if version:
        raise ValueError(f"version {version}")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICT, CROSS):
            side = bits.read(3) + 2
            block = read_image(bits, (inner + (1 << side) - 1) >> side, (height + (1 << side) - 1) >> side)
            undo.append((kind, block, inner, side))
        elif kind == GREEN:
            undo.append((kind, None, inner, 0))
        else:
            n = bits.read(8) + 1
            table = _merge(*(np.cumsum(x) for x in _split(read_image(bits, n, 1))))
            undo.append((kind, table, inner, 0))
            inner = (inner + (1 << _bundle(n)) - 1) >> _bundle(n)
    return bits, width, inner, height, undo, bool(has_alpha)


def undone(pixels: np.ndarray, width: int, height: int, undo: list[tuple], has_alpha: bool) -> np.ndarray:
    for kind, block, across, side in reversed(undo):
        if kind == PREDICT:
            pixels = predict(pixels, block, across, side, True)
        elif kind == CROSS:
            pixels = cross_colour(pixels, block, across, side, True)
        elif kind == GREEN:
            pixels = subtract_green(pixels, True)
        else:
            pixels = from_palette(pixels, block, across, height)
    if not has_alpha:
        pixels |= np.uint32(OPAQUE)
    return pixels.reshape(height, width)


def decode(raw: bytes) -> np.ndarray:
    """Pixels (height, width), ARGB as 32-bit numbers."""
    bits, width, inner, height, undo, has_alpha = opened(raw)
    return undone(read_image(bits, inner, height, main=True), width, height, undo, has_alpha)


def _file(body: bytes) -> bytes:
    padded = body + bytes(len(body) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def _head(out: Writer, width: int, height: int, alpha: bool) -> None:
    if not (1 <= width <= SIDE and 1 <= height <= SIDE):
        raise ValueError("an image's sides are 1 to 16384 pixels")
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        out.put(int(value), n)


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), modes: list[int] | None = None, factors: list[int] | None = None, side: int = 2, cache_bits: int | None = 0, lz: bool = True) -> bytes:
    """A lossless WebP file of ARGB pixels (height, width). modes: a predictor for each block of the
    PREDICT transform (11 everywhere if not given); factors: an element for each of CROSS."""
    height, width = pixels.shape
    flat, out = pixels.astype(np.uint32).ravel(), Writer()
    _head(out, width, height, bool((flat >> np.uint32(24) != 255).any()))
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        blocks = ((width + (1 << side) - 1) >> side) * ((height + (1 << side) - 1) >> side)
        across = (width + (1 << side) - 1) >> side
        if kind == PREDICT:
            block = np.array([OPAQUE | m << 8 for m in (modes or [11] * blocks)], np.uint32)
            flat = predict(flat, block, width, side, False)
        elif kind == CROSS:
            block = np.array(factors or [0] * blocks, np.uint32)
            flat = cross_colour(flat, block, width, side, False)
        elif kind == GREEN:
            flat = subtract_green(flat, False)
            continue
        else:
            table = np.unique(flat)
            if len(table) > 256:
                raise ValueError("over 256 colours")
            out.put(len(table) - 1, 8)
            write_image(out, _merge(*(np.diff(x, prepend=0) for x in _split(table))), len(table))
            flat = to_palette(flat, table, width, height)
            width = (width + (1 << _bundle(len(table))) - 1) >> _bundle(len(table))
            continue
        out.put(side - 2, 3)
        write_image(out, block, across)
    out.put(0, 1)
    write_image(out, flat, width, True, cache_bits, lz)
    return _file(out.done())


# ---- byte strings as images


@functools.cache
def _fixed_codes(text: bool) -> list[list[int]]:
    """Code lengths for green, red, blue, alpha and distance: all of eight bits, or for text by kinds
    of bytes."""
    if not text:
        return [[8] * 256 + [0] * 24, [8] * 256, [8] * 256, [0] * 255 + [1], [0] * 40]
    often = {x: 40 for x in b"etaoinsrhld"} | {x: 16 for x in b"cumfpgwybvk"} | {32: 160}
    weight = [often.get(x, 6 if chr(x).isalnum() and x < 128 else 3 if 32 < x < 48 or x == 10 or x >= 160 else 1) for x in range(256)]
    own = huffman(weight, 15)
    return [own + [0] * 24, own, own, [0] * 255 + [1], [0] * 40]


@functools.cache
def _fixed_head(width: int, height: int, text: bool) -> tuple[int, int]:
    out = Writer()
    _head(out, width, height, False)
    out.put(0, 1)  # no transform
    _image_head(out, True, 0, _fixed_codes(text), own=True)
    return out.value, out.n


def _entropy(pixels: np.ndarray) -> int:
    """Parts of bits of the channels, each by itself."""
    x = np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(-1, 4)
    n = np.bincount((x + np.arange(0, 1024, 256, dtype=np.int64)).ravel(), minlength=1024)
    return 4 * int(weight(len(x))) - int(weight(n).sum())


def smallest(pixels: np.ndarray) -> bytes:
    """With or without a colour cache by the entropy of the tokens, after the transform that leaves the least."""
    height, width = pixels.shape
    flat, blocks = pixels.ravel(), ((width + 511) >> 9) * ((height + 511) >> 9)
    ways: list[tuple[int, dict]] = [(_entropy(flat), {}), (_entropy(subtract_green(flat, False)), {"transforms": (GREEN,)})]
    ways += [(_entropy(_one_way(flat, m, width, False)), {"transforms": (PREDICT,), "modes": [m] * blocks, "side": 9}) for m in (1, 2)]
    if len(table := np.unique(flat)) <= 256:
        ways.append((SCALE * 32 * len(table) + _entropy(to_palette(flat, table, width, height)), {"transforms": (PALETTE,)}))
    how = min(ways, key=lambda w: w[0])[1]
    return encode(pixels, cache_bits=None, **how)


def _fixed(part: np.ndarray, height: int, text: bool) -> bytes:
    codes, sizes = _coder(tuple(_fixed_codes(text)[1]))
    code, size = codes.astype(np.uint64)[part].reshape(-1, 3), sizes.astype(np.uint64)[part].reshape(-1, 3)
    two = size[:, 1] + size[:, 0]
    out = Writer()
    out.value, out.n = _fixed_head(ROW, height, text)
    _put_all(out, code[:, 1] | code[:, 0] << size[:, 1] | code[:, 2] << two, (two + size[:, 2]).astype(np.int64))
    return _file(out.done())


def fixed_sizes(counts: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Bits of images with these byte counts (a row for each) in the fixed codes: for text, and of eight bits."""
    return np.stack([counts @ np.array(_fixed_codes(text)[1]) + np.array([_fixed_head(ROW, h, text)[1] for h in np.asarray(heights).tolist()]) for text in (True, False)])


def store_image(part: np.ndarray) -> bytes:
    """One image of at most SIDE rows, three bytes a pixel."""
    height = len(part) // UNIT
    sizes = fixed_sizes(np.bincount(part, minlength=256)[None], [height])[:, 0].tolist()
    pixels = np.zeros((height * ROW, 4), np.uint8)
    pixels[:, :3], pixels[:, 3] = part.reshape(-1, 3)[:, ::-1], 255
    own = smallest(pixels.view("<u4").reshape(height, ROW))
    return _fixed(part, height, sizes[0] <= sizes[1]) if 8 * len(own) > min(sizes) + 8 * 28 else own


def store(payload: bytes) -> bytes:
    """Images of ROW pixels a row, three bytes a pixel, one after the other: as many as it takes."""
    return b"".join(store_image(np.frombuffer(payload[at : at + UNIT * SIDE], np.uint8)) for at in range(0, len(payload), UNIT * SIDE))


def files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = end
    return out


def payload(images: list[np.ndarray]) -> bytes:
    """The bytes that these images hold, three a pixel."""
    return b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].tobytes() for x in images)


def restore(media: bytes) -> bytes:
    return payload([decode(x) for x in files(media)])


@functools.lru_cache(maxsize=256)
def _edges(n: int) -> np.ndarray:
    return np.linspace(0, n, 66).astype(np.int64)


def features(payload: bytes) -> str:
    """Size, mean of each channel, and a difference hash of 64 neighbouring stretches."""
    x = np.frombuffer(payload, np.uint8)
    edges = _edges(len(x))
    means = np.add.reduceat(x, edges[:-1], dtype=np.int64) / np.diff(edges)
    bits = int.from_bytes(np.packbits(means[1:] > means[:-1]).tobytes(), "big")
    return f"{ROW}x{len(x) // UNIT} mean {' '.join(f'{3 * int(x[k::3].sum()) / len(x):.3f}' for k in range(3))} dhash {bits:016x}"


def encode_images(rows: DataFrame, pixels: str = "pixels", width: str = "width", height: str = "height", media: str = "media") -> DataFrame:
    """rows with `media`: WebP files of ARGB pixels (binary, 32-bit little-endian)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != media)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{media: [None if p is None else encode(np.frombuffer(p, "<u4").reshape(int(h), int(w))) for p, w, h in zip(pdf[pixels], pdf[width], pdf[height], strict=True)]})

    return rows.drop(media).mapInPandas(c.freed(run), f"{schema}, `{media}` binary")


def decode_images(rows: DataFrame, media: str = "media", on_error: str = "raise") -> DataFrame:
    """rows with width, height and pixels (binary, ARGB, 32-bit little-endian) of each WebP file."""
    rows = rows.drop("width", "height", "pixels")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def one(raw: bytes | None) -> tuple:
        try:
            got = decode(raw) if raw is not None else None
        except ValueError:
            if on_error != "null":
                raise
            got = None
        return (None, None, None) if got is None else (got.shape[1], got.shape[0], got.astype("<u4").tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [one(x) for x in pdf[media]]
            yield pdf.assign(width=pd.array([f[0] for f in found], "Int32"), height=pd.array([f[1] for f in found], "Int32"), pixels=[f[2] for f in found])

    return rows.mapInPandas(c.freed(run), f"{schema}, width int, height int, pixels binary")


def digest(documents: DataFrame) -> DataFrame:
    """Stores each text as images in a table of the shared folder and describes what is read back."""
    from . import webp_many as many  # which uses this module

    c.session(documents.sparkSession)
    docs = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
            n, media = [len(x) for x in raw], []
            for a, b in c.chunks(n, TOGETHER):
                media += many.store([x + b"\xff" * (-len(x) % UNIT or (0 if x else UNIT)) for x in raw[a:b]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": n, "media": media})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b in c.chunks(pdf["n_bytes"].tolist(), TOGETHER):
                part = pdf.iloc[a:b]
                for doc_id, n, media, x in zip(part["doc_id"], part["n_bytes"], part["media"], many.restore(part["media"].tolist()), strict=True):
                    out.append((doc_id, n, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(x)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    stored = c.table(docs.mapInPandas(c.freed(write), "doc_id long, n_bytes long, media binary"), "media")
    return stored.mapInPandas(c.freed(read), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
