"""Many small lossless WebP images coded and decoded together.

A text makes an image of some hundred pixels, for which a call of numpy costs more than its work. So the
images of a batch are laid one after the other and each step of webp.store (entropy of the transforms,
copies, tokens, codes, bits) and of webp.restore is done for all of them at once. Nothing is shared between
images: each gets the very bytes that webp.store gives it alone, which a test says. Images of over SMALL
pixels, and those for which a palette may be best, are coded alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from . import common as c
from . import webp as w

#: Images coded together (cache slots are sorted by 16 bits, eight of them the image), pixels together and of one image.
IMAGES, PIXELS, SMALL = 256, 1 << 18, 1 << 15
PLACE = (1 << 20) - 1
AFTER = 128
GREENS = 280 + (1 << w.CACHE)
#: Where the codes of an image lie in its row of lengths: green, red, blue, alpha, distance.
EDGES = np.cumsum([0, GREENS, 256, 256, 256, 40])


def gathered(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most IMAGES neighbours of `most` together."""
    for start, stop in c.chunks(sizes, most):
        for at in range(start, stop, IMAGES):
            yield at, min(at + IMAGES, stop)


# ---- coding


def huffman(counts: np.ndarray) -> np.ndarray:
    """webp.huffman with at most 15 bits for each row: all rows join their two lightest at the same time."""
    lengths = np.zeros(counts.shape, np.int64)
    row, symbol = np.nonzero(counts)
    many = np.bincount(row, minlength=len(counts))
    rank = np.argsort(-many, kind="stable")  # rows with most symbols first, so that those at work stay in front
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    n = many[rank]
    key = np.sort(place[row] << 46 | counts[row, symbol] << 12 | symbol)
    row, weight, symbol = key >> 46, key >> 12 & (1 << 34) - 1, key & 4095
    begin = np.cumsum(n) - n
    leaf_at = np.arange(len(key)) - begin[row]
    wide, never = int(n.max(initial=0)) + 1, 1 << 62
    leaves, nodes = np.full((len(n), wide), never), np.full((len(n), wide), never)
    leaves[row, leaf_at] = weight
    flat, joined = leaves.ravel(), nodes.ravel()
    above_leaf, above_node = np.zeros(flat.shape, np.int64), np.zeros(flat.shape, np.int64)
    leaf = np.arange(len(n)) * wide
    node, first = leaf.copy(), leaf.copy()
    for new in range(wide - 2):
        busy = int(np.searchsorted(-n, -(new + 1), "left"))  # rows with over new + 1 symbols
        at, on, total = leaf[:busy], node[:busy], 0
        for _ in range(2):
            x, y = flat[at], joined[on]
            take = x <= y
            above_leaf[at] = np.where(take, new, above_leaf[at])
            above_node[on] = np.where(take, above_node[on], new)
            total = total + np.minimum(x, y)
            at += take
            on += ~take
        joined[first[:busy] + new] = total
    depth = np.zeros(flat.shape, np.int64)
    for new in range(wide - 4, -1, -1):
        busy = int(np.searchsorted(-n, -(new + 2), "left"))  # rows in which this is not the last node
        at = first[:busy] + new
        depth[at] = depth[first[:busy] + above_node[at]] + 1
    at = first[row] + leaf_at
    deep = np.where(n[row] > 1, depth[first[row] + above_leaf[at]] + 1, 1)
    lengths[rank[row], symbol] = deep
    for r in np.flatnonzero(lengths.max(axis=1, initial=0) > 15):
        lengths[r] = w.huffman(counts[r].tolist(), 15)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by symbol, first bit lowest, and their lengths, for each row; none for a lone symbol."""
    code, size = np.zeros(lengths.shape, np.int64), lengths.copy()
    size[(lengths > 0).sum(axis=1) < 2] = 0
    row, symbol = np.nonzero(size)
    key = np.sort(row << 20 | size[row, symbol] << 12 | symbol)
    row, n, symbol = key >> 20, key >> 12 & 255, key & 4095
    share = 1 << (15 - n)
    before = np.cumsum(share) - share
    start = np.searchsorted(row, np.arange(len(lengths)))
    x = (before - before[np.minimum(start, max(len(before) - 1, 0))][row]) >> (15 - n) if len(row) else row
    code[row, symbol] = (w._REVERSED[x & 255] << 8 | w._REVERSED[x >> 8]) >> (16 - n)
    return code, size


@functools.cache
def _run_bits() -> tuple[np.ndarray, np.ndarray]:
    """Bits of so many equal code lengths, and how many bits, by length and number."""
    value, size = np.zeros((16, 139), np.uint64), np.zeros((16, 139), np.int64)
    for length in range(16):
        for run in range(1, 8 if length else 139):
            text = w._run(length, run, w._usual())
            value[length, run], size[length, run] = int(text, 2), len(text)
    return value, size


def _code_fields(lengths: np.ndarray, greens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """webp.write_code for the five codes of each image, as fields: image, value, bits. greens: how many green symbols."""
    k, codes = len(lengths), len(EDGES) - 1
    code_of = np.repeat(np.arange(codes), np.diff(EDGES))
    used = np.add.reduceat(lengths > 0, EDGES[:-1], axis=1)
    high = (lengths[:, 256:GREENS] > 0).any(axis=1)
    simple = used <= 2
    simple[:, 0] &= ~high
    # the first and the last symbol of each code, which are all symbols of a simple one
    first = np.stack([(lengths[:, a:b] > 0).argmax(axis=1) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)], axis=1)
    last = np.stack([b - a - 1 - (lengths[:, a:b][:, ::-1] > 0).argmax(axis=1) for a, b in zip(EDGES[:-1], EDGES[1:], strict=True)], axis=1)
    two = simple & (used == 2)
    head = w._lengths_head(w._usual())[0]
    value = np.where(simple, 5 | two << 1 | first << 3 | np.where(two, last, 0) << 11, int(head, 2)).astype(np.uint64)
    size = np.where(simple, 11 + 8 * two, len(head))
    row = np.arange(k * codes)
    fields = [(row, value.ravel(), size.ravel())]
    inside = ~simple[:, code_of]
    inside[:, :GREENS] &= np.arange(GREENS) < greens[:, None]
    at = np.flatnonzero(inside)
    if len(at):
        length, own = lengths.ravel()[at], (at // lengths.shape[1]) * codes + code_of[at % lengths.shape[1]]
        begin = np.flatnonzero(np.concatenate(([True], (length[1:] != length[:-1]) | (own[1:] != own[:-1]))))
        run, length, own = np.diff(begin, append=len(at)), length[begin], own[begin]
        most = np.where(length > 0, 7, 138)
        parts = (run + most - 1) // most
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        length, own, most = (np.repeat(x, parts) for x in (length, own, most))
        run = np.minimum(np.repeat(run, parts) - part * most, most)
        bits = _run_bits()
        fields.append((own, bits[0][length, run], bits[1][length, run]))
    row, value, size = (np.concatenate(x) for x in zip(*fields, strict=True))
    by = np.argsort(row.astype(np.uint16), kind="stable")
    return row[by] // codes, value[by], size[by]


def _copies(pixels: np.ndarray, image: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """webp.copies of each image: places, lengths and distances."""
    x = pixels.astype(np.uint64)
    key = c.mix((c.mix(x[:-2] | x[1:-1] << np.uint64(32)) ^ c.mix(x[2:] + np.uint64(1))) + image[:-2].astype(np.uint64))
    place, low = np.flatnonzero(image[:-2] == image[2:]), c.U64(PLACE)
    key = np.sort(key[place] & ~low | place.astype(np.uint64))
    same = np.flatnonzero((key[1:] ^ key[:-1]) <= low)
    # each place with the last one before it that has the same three pixels
    i, j = ((key[same + d] & low).astype(np.int64) for d in (1, 0))
    last = np.full(len(pixels), -1)
    last[i] = j
    i = np.flatnonzero(last >= 0)
    j, stop = last[i], end[image[i]]
    if not (image[i] == image[j]).all() or any((pixels[i + d] != pixels[j + d]).any() for d in range(3)):  # two of one hash
        found = [(p + e - m, n, d) for e, m in zip(end.tolist(), np.diff(end, prepend=0).tolist(), strict=True) for p, n, d in w.copies(pixels[e - m : e])]
        return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else w._NOTHING
    size, open_ = np.full(len(i), 3), np.arange(len(i))
    for step in range(3, 16):
        open_ = open_[i[open_] + step < stop[open_]]
        open_ = open_[pixels[i[open_] + step] == pixels[j[open_] + step]]
        size[open_] += 1
    out, free = [], 0
    for p, q, m, e in zip(*(x.tolist() for x in (i, j, size, stop)), strict=True):
        if p < free:
            continue
        if m == 16 and (more := min(4080, e - p - 16)):
            alike = pixels[p + 16 : p + 16 + more] == pixels[q + 16 : q + 16 + more]
            m += more if alike.all() else int(alike.argmin())
        out.append((p, m, p - q))
        free = p + m
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else w._NOTHING


def _counted(image: np.ndarray, x: np.ndarray, k: int, n: int) -> np.ndarray:
    return np.bincount(image * n + x, minlength=k * n).reshape(k, n)


def _transformed(rows: np.ndarray, opens: np.ndarray) -> list[np.ndarray]:
    """Bytes (row, pixel, channel) after no transform, subtract green, predictors left and top, as in webp.smallest.
    opens: rows that begin an image."""
    green = rows.copy()
    green[:, :, 0:3:2] -= rows[:, :, 1:2]
    left, top = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    follows = np.flatnonzero(~opens)
    left[follows, 0] -= rows[follows - 1, 0]
    top[follows] -= rows[follows - 1]
    opens = np.flatnonzero(opens)
    top[opens, 1:] -= rows[opens, :-1]
    for x in (left, top):
        x[opens, 0, 3] -= np.uint8(255)
    return [rows, green, left, top]


@functools.lru_cache(maxsize=1024)
def _head(height: int, way: int) -> tuple[int, int]:
    """What stands before the cache bit of the main image: sizes and the transform."""
    out = w.Writer()
    w._head(out, w.ROW, height, False)
    if way == 1:
        out.put(1, 1)
        out.put(w.GREEN, 2)
    elif way:
        blocks = ((w.ROW + 511) >> 9) * ((height + 511) >> 9)
        out.put(1, 1)
        out.put(w.PREDICT, 2)
        out.put(7, 3)
        w.write_image(out, np.full(blocks, w.OPAQUE | (way - 1) << 8, np.uint32), (w.ROW + 511) >> 9)
    out.put(0, 1)
    return out.value, out.n


def _pack(words: np.ndarray, begin: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
    """Puts values of up to 64 bits at bit places that only grow."""
    if not len(begin):
        return
    word, shift = begin >> 6, (begin & 63).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
    words[word[first] + 1] |= np.bitwise_or.reduceat(value >> np.uint64(1) >> (np.uint64(63) - shift), first)


def _images(parts: list[np.ndarray]) -> list[bytes]:
    """webp.store_image of each of these byte strings, of whole rows."""
    k = len(parts)
    heights = np.array([len(p) // w.UNIT for p in parts])
    n = heights * w.ROW
    end = np.cumsum(n)
    image, total = np.repeat(np.arange(k), n), int(end[-1])
    raw = np.concatenate(parts)
    rows = np.full((total, 4), 255, np.uint8)
    rows[:, :3] = raw.reshape(-1, 3)[:, ::-1]
    pixels = rows.view("<u4").ravel()
    rows = rows.reshape(-1, w.ROW, 4)
    opens = np.zeros(len(rows), bool)
    opens[(end - n) // w.ROW] = True
    ways = _transformed(rows, opens)
    cost = np.empty((5, k), np.int64)
    of_image = ((image * 768)[:, None] + np.arange(0, 768, 256)).ravel()
    for way, x in enumerate(ways):
        place = of_image + x.reshape(-1, 4)[:, :3].ravel()
        cost[way] = 3 * w.weight(n) - w.weight(np.bincount(place, minlength=768 * k)).reshape(k, 768).sum(axis=1)
    key = np.sort((image << 24).astype(np.uint32) | pixels & np.uint32(0xFFFFFF))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    colours = np.bincount(key[first] >> 24, minlength=k)
    # a palette of over 16 colours gives one channel, of which each colour is a symbol
    spread = w.weight(n) - np.bincount(key[first] >> 24, weights=w.weight(np.diff(first, append=total)), minlength=k).astype(np.int64)
    cost[4] = np.where(colours <= 256, w.SCALE * 32 * colours + spread, 1 << 62)
    how = cost.argmin(axis=0)
    alone = (colours <= 16) | (how == 4)
    how = np.where(alone, 0, how)
    pixels = pixels.copy()
    for way in (1, 2, 3):
        taken = np.flatnonzero(how[image[:: w.ROW]] == way)
        pixels.reshape(-1, w.ROW)[taken] = ways[way][taken].view("<u4")[:, :, 0]

    begin, m, d = _copies(pixels, image, end)
    edge = np.zeros(total + 1, np.int64)
    edge[begin] += 1
    edge[begin + m] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    slot = w._slots(pixels, w.CACHE)
    before = w._before((image << w.CACHE | slot).astype(np.uint16))[at]
    known = (before >= 0) & (pixels[before] == pixels[at]) & (image[before] == image[at])
    size, far = w._prefixed(m), w._prefixed(w._distance_codes(d, w.ROW))
    own, copied = image[at], image[begin]
    channels = [(pixels[at] >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (8, 16, 0)]
    alpha = np.where((how == 2) | (how == 3), 0, 255)
    extra = np.bincount(copied, weights=size[2] + far[2], minlength=k).astype(np.int64)
    fars = _counted(copied, far[0], k, 40)

    def counts(take: np.ndarray, cached: np.ndarray) -> np.ndarray:
        greens = np.concatenate((own[take] * GREENS + channels[0][take], copied * GREENS + 256 + size[0], own[cached] * GREENS + 280 + slot[at[cached]]))
        literal = np.zeros((k, 256), np.int64)
        literal[np.arange(k), alpha] = np.bincount(own[take], minlength=k)
        return np.concatenate([np.bincount(greens, minlength=k * GREENS).reshape(k, GREENS), *(_counted(own[take], x[take], k, 256) for x in channels[1:]), literal, fars], axis=1)

    plain, cached = counts(np.arange(len(at)), np.zeros(0, np.int64)), counts(np.flatnonzero(~known), np.flatnonzero(known))
    needs = [w.weight(np.add.reduceat(x, EDGES[:-1], axis=1)).sum(axis=1) - w.weight(x).sum(axis=1) + w.SCALE * (4 * (x > 0).sum(axis=1) + extra) for x in (plain, cached)]
    cache = needs[1] < needs[0]
    counted = np.where(cache[:, None], cached, plain)
    known &= cache[own]

    lengths = np.zeros_like(counted)
    lengths[:, EDGES[3] : EDGES[4]] = counted[:, EDGES[3] : EDGES[4]] > 0
    code, bits = np.zeros_like(counted), np.zeros_like(counted)
    others = (0, 1, 2, 4)
    table = np.zeros((4, k, GREENS), np.int64)
    for x, e in zip(table, others, strict=True):
        x[:, : EDGES[e + 1] - EDGES[e]] = counted[:, EDGES[e] : EDGES[e + 1]]
    table = huffman(table.reshape(4 * k, GREENS))
    for target, x in ((lengths, table), *zip((code, bits), canonical(table), strict=True)):
        for y, e in zip(x.reshape(4, k, GREENS), others, strict=True):
            target[:, EDGES[e] : EDGES[e + 1]] = y[:, : EDGES[e + 1] - EDGES[e]]

    # fields of the tokens, by the pixel at which they begin
    fields, widths, starts = np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, bool)

    def put(place: np.ndarray, value: np.ndarray, count: np.ndarray) -> None:
        fields[place] |= value.astype(np.uint64) << widths[place].astype(np.uint64)
        widths[place] += count

    starts[at], starts[begin] = True, True
    flat, wide, across = code.ravel(), bits.ravel(), code.shape[1]
    green = np.where(known, 280 + slot[at], channels[0])
    literal = np.flatnonzero(~known)
    for place, where in ((at, own * across + green), *((at[literal], own[literal] * across + EDGES[e] + channels[e][literal]) for e in (1, 2)), (begin, copied * across + 256 + size[0])):
        put(place, flat[where], wide[where])
    put(begin, size[1], size[2])
    where = copied * across + EDGES[4] + far[0]
    put(begin, flat[where], wide[where])
    put(begin, far[1], far[2])
    token = np.flatnonzero(starts)
    token_image, token_value, token_size = image[token], fields[token], widths[token]
    code_image, code_value, code_size = _code_fields(lengths, np.where(cache, GREENS, 280))

    # heads are longer than 64 bits where there is a transform: they go by parts of 32
    heads: list[tuple[int, int, int]] = []
    for i, (height, way, has) in enumerate(zip(heights.tolist(), how.tolist(), cache.tolist(), strict=True)):
        value, count = _head(height, way)
        # cache bit and bits, no groups
        value, count = (value | (1 | w.CACHE << 1) << count, count + 6) if has else (value, count + 2)
        heads += [(i, value >> b & 0xFFFFFFFF, min(32, count - b)) for b in range(0, count, 32)]
    head_image, head_value, head_size = (np.array(x) for x in zip(*heads, strict=True))
    groups = [(head_image, head_value.astype(np.uint64), head_size), (code_image, code_value, code_size), (token_image, token_value, token_size)]
    needed = np.stack([np.bincount(i, weights=s, minlength=k).astype(np.int64) for i, _, s in groups])
    length = (needed.sum(axis=0) + 7) // 8
    room = (needed.sum(axis=0) + 63) // 64 + 1
    base = 64 * (np.cumsum(room) - room)
    words = np.zeros(int(room.sum()) + 1, np.uint64)
    for i, v, s in groups:
        within = np.cumsum(s) - s
        start = np.searchsorted(i, np.arange(k))
        within = within - np.append(within, 0)[start][i]
        _pack(words, base[i] + within, v, s)
        base = base + np.bincount(i, weights=s, minlength=k).astype(np.int64)
    body, start = words.astype("<u8").tobytes(), (8 * (np.cumsum(room) - room)).tolist()

    out = []
    limits = w.fixed_sizes(np.bincount(np.repeat(np.arange(k), [len(p) for p in parts]) * 256 + raw, minlength=256 * k).reshape(k, 256), heights)
    for i, (part, a, size_) in enumerate(zip(parts, start, length.tolist(), strict=True)):
        if alone[i]:
            out.append(w.store_image(part))
        elif 8 * (20 + size_ + (size_ & 1)) > limits[:, i].min() + 8 * 28:
            out.append(w._fixed(part, int(heights[i]), bool(limits[0, i] <= limits[1, i])))
        else:
            out.append(w._file(body[a : a + size_]))
    return out


def store(payloads: list[bytes]) -> list[bytes]:
    """webp.store of each."""
    files: list[bytes] = [b""] * len(payloads)
    small = [i for i, p in enumerate(payloads) if 0 < len(p) <= 3 * SMALL]
    for a, b in gathered([len(payloads[i]) // 3 for i in small], PIXELS):
        for i, media in zip(small[a:b], _images([np.frombuffer(payloads[i], np.uint8) for i in small[a:b]]), strict=True):
            files[i] = media
    return [media if media or not p else w.store(p) for media, p in zip(files, payloads, strict=True)]


# ---- decoding


def _tables(lengths: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """webp.Code of each of these lengths: all tables one after the other, where each begins, and its bits."""
    many = np.array([len(x) for x in lengths])
    flat = np.frombuffer(b"".join(lengths), np.uint8)
    at = np.flatnonzero(flat)
    begin = np.cumsum(many) - many
    row = np.repeat(np.arange(len(many)), many)[at]
    key = np.sort(row << 20 | flat[at].astype(np.int64) << 12 | at - begin[row])
    row, size, symbol = key >> 20, key >> 12 & 255, key & 4095
    used = np.bincount(row, minlength=len(many))
    size[used[row] == 1] = 0  # a lone symbol takes no bits
    bits = np.zeros(len(many), np.int64)
    bits[row] = size  # the last of a row is the longest
    share = 1 << (bits[row] - size)
    if (np.bincount(row, weights=share, minlength=len(many)) != np.where(used, 1 << bits, 0)).any():
        raise ValueError("a prefix code is not complete")
    base = np.cumsum(1 << bits) - (1 << bits)
    table = np.zeros(int((1 << bits).sum()), np.int64)
    filled = np.repeat(used > 0, 1 << bits)
    table[filled] = np.repeat(symbol << 4 | size, share)
    turned = np.concatenate([w._turned(b) for b in bits.tolist()]) + np.repeat(base, 1 << bits)
    return table[turned], base, bits


def _starts(raw: bytes, at: int, total: int, codes: list[tuple[np.ndarray, np.ndarray, int]], copies: bool) -> tuple[np.ndarray, int]:
    """Bits at which tokens begin, as far as the bits go, and where the last one ends: as in webp._tokens_read.
    codes: for each its table, the lengths in it and its bits."""
    n, shift, first = min(8 * len(raw) - at, 64 + 48 * total), at & 7, at >> 3
    if n <= 0:
        raise ValueError("the image ends early")
    many, words = (n + shift + 7) // 8, w._words(raw + bytes(24))
    # a row for each bit of a byte
    window = words[first : first + many] >> np.arange(8)[:, None]
    green, _, bits = codes[0]
    s = green.take(window & ((1 << bits) - 1))
    size = own = s & 15
    for _, sizes, bits in codes[1:4]:
        if bits:
            window >>= own
            own = sizes.take(window & ((1 << bits) - 1))
            size = size + own
    if copies:
        s, size = s.ravel(), size.ravel()
        i = np.flatnonzero(s >= 256 << 4)
        size[i] = s[i] & 15
        i = i[s[i] < 280 << 4]
        extra = w._amounts((s[i] >> 4) - 256)[1]
        place = 8 * (first + i % many) + i // many + size[i] + extra
        far, _, bits = codes[4]
        d = far[words[place >> 3] >> (place & 7) & ((1 << bits) - 1)]
        size[i] += extra + (d & 15) + w._amounts(d >> 4)[1]
    # a token is shorter than AFTER bits; behind the last bit nothing moves on
    step = np.zeros(8 * many + 4 * AFTER, np.int64)
    step[: 8 * many].reshape(many, 8)[:] = size.reshape(8, many).T
    if not step[shift]:  # codes without bits: all is one colour
        return np.full(total, at), at
    place = np.arange(8 * many)
    two = step.copy()
    two[: 8 * many] += step.take(place + step[: 8 * many])
    four = memoryview((two[: 8 * many] + two.take(place + two[: 8 * many])).astype(np.uint16))
    p, end, hops = shift, shift + n, []
    append = hops.append
    while p < end:
        append(p)
        p += four[p]
    starts = np.empty((len(hops), 4), np.int64)
    starts[:, 0] = hops
    starts[:, 2] = starts[:, 0] + two[starts[:, 0]]
    starts[:, 1::2] = starts[:, ::2] + step[starts[:, ::2]]
    starts = starts.ravel()
    starts = starts[: np.searchsorted(starts, end)]
    return starts + (at - shift), int(starts[-1] + step[starts[-1]]) + at - shift


def _decoded(heads: list[tuple]) -> list[np.ndarray]:
    """Main images: of each its bits, width, height, cache bits and code lengths."""
    k = len(heads)
    table, base, bits = _tables([x for h in heads for x in h[4]])
    spans, sizes = list(zip(base.tolist(), bits.tolist(), strict=True)), table & 15
    held, tokens, last = [], [], []
    for i, (b, width, height, _, lengths) in enumerate(heads):
        codes = [(table[a : a + (1 << n)], sizes[a : a + (1 << n)], n) for a, n in spans[5 * i : 5 * i + 5]]
        starts, end = _starts(b.raw, b.at, width * height, codes, any(lengths[0][256:]))
        tokens.append(len(starts))
        held.append(starts)
        last.append(end)
    tokens = np.array(tokens)
    image = np.repeat(np.arange(k), tokens)
    lens = np.array([len(h[0].raw) + 16 for h in heads])
    words = w._words(b"".join(x for h in heads for x in (h[0].raw, bytes(16))) + bytes(8))
    at = np.concatenate(held)
    place = at + 8 * (np.cumsum(lens) - lens)[image]
    base, mask = base.reshape(k, 5), (1 << bits.reshape(k, 5)) - 1
    width, total = np.array([h[1] for h in heads]), np.array([h[1] * h[2] for h in heads])

    def bits_at(place: np.ndarray) -> np.ndarray:
        return words[place >> 3] >> (place & 7)

    def look(code: int, image: np.ndarray, window: np.ndarray) -> np.ndarray:
        return table[base[:, code][image] + (window & mask[:, code][image])]

    window = bits_at(place)
    s = look(0, image, window)
    own, s = s & 15, s >> 4
    size = own
    kind, distance = np.where(s < 256, 0, np.where(s < 280, 2, 1)), np.zeros(len(at), np.int64)
    colour = s << 8
    for code, shift in ((1, 16), (2, 0), (3, 24)):
        window >>= own
        x = look(code, image, window)
        own = x & 15
        colour |= x >> 4 << shift
    value = np.where(kind == 0, colour, s - 280)
    i = np.flatnonzero(kind == 2)
    least, extra = w._amounts(s[i] - 256)
    there = place[i] + size[i]
    value[i] = least + (bits_at(there) & ((1 << extra) - 1))
    there += extra
    d = look(4, image[i], bits_at(there))
    least, extra = w._amounts(d >> 4)
    code = least + (bits_at(there + (d & 15)) & ((1 << extra) - 1))
    near = np.minimum(code, 120) - 1
    distance[i] = np.where(code > 120, code - 120, np.maximum(1, w._NEAR_X[near] + width[image[i]] * w._NEAR_Y[near]))

    # an image's tokens end where it is full; what follows are bits of its padding
    done = np.cumsum(np.where(kind == 2, value, 1))
    token_end = np.cumsum(tokens)
    full = np.concatenate(([0], done))[token_end - tokens] + total
    stop = np.searchsorted(done, full) + 1
    if (stop > token_end).any():
        raise ValueError("the image ends early")
    if (done[stop - 1] != full).any():
        raise ValueError("a back-reference leaves the image")
    ends = np.where(stop < token_end, np.append(at, 0)[stop], last)
    if (ends > 8 * (lens - 24)).any():  # Bits adds eight bytes
        raise ValueError("the image ends early")
    kept = np.arange(len(at)) < stop[image]
    pixels = _pixels(kind[kept], value[kept], distance[kept], image[kept], total, np.array([h[3] for h in heads]))
    return np.split(pixels, np.cumsum(total)[:-1])


def _pixels(kind: np.ndarray, value: np.ndarray, distance: np.ndarray, image: np.ndarray, total: np.ndarray, cache_bits: np.ndarray) -> np.ndarray:
    """webp._pixels of each image, one after the other."""
    size = np.where(kind == 2, value, 1)
    begin, n = np.cumsum(size) - size, int(total.sum())
    if (distance > begin - (np.cumsum(total) - total)[image]).any():
        raise ValueError("a back-reference leaves the image")
    colour = np.zeros(n + 1, np.uint32)  # the last is an empty cache's
    colour[begin[kind == 0]] = value[kind == 0]
    kinds, place = np.repeat(kind, size), np.arange(n)
    to = place - np.where(kinds == 2, np.repeat(distance, size), 0)
    if (cached := begin[kind == 1]).size:
        of = np.repeat(np.arange(len(total)), total)
        most = int(cache_bits.max())
        slot = (colour[:-1] * np.uint32(0x1E35A7BD) >> (32 - np.maximum(cache_bits, 1)).astype(np.uint32)[of]).astype(np.int64)
        slot[cached] = value[kind == 1]
        key = of << most | slot[w._followed(to)]
        before = w._before(key.astype(np.uint16) if len(total) << most <= 1 << 16 else key)[cached]
        to[cached] = np.where(before < 0, n, before)
    return colour[w._followed(np.append(to, n))[:-1]]


def decode(files: list[bytes]) -> list[np.ndarray]:
    """webp.decode of each."""
    out: list[np.ndarray | None] = [None] * len(files)
    heads, rest = [], []
    for i, raw in enumerate(files):
        bits, width, inner, height, undo, has_alpha = w.opened(raw)
        start = bits.at
        cache_bits = bits.read(4) if bits.read(1) else 0
        if bits.read(1) or inner * height > SMALL:
            bits.at = start
            out[i] = w.undone(w.read_image(bits, inner, height, main=True), width, height, undo, has_alpha)
        else:
            heads.append((bits, inner, height, cache_bits, w._Recent.read(bits, w.alphabets(cache_bits))))
            rest.append((i, width, height, undo, has_alpha))
    for a, b in gathered([h[1] * h[2] for h in heads], PIXELS):
        for pixels, (i, *how) in zip(_decoded(heads[a:b]), rest[a:b], strict=True):
            out[i] = w.undone(pixels, *how)
    return out


def restore(media: list[bytes]) -> list[bytes]:
    """webp.restore of each."""
    files = [w.files(x) for x in media]
    images = iter(decode([f for x in files for f in x]))
    return [w.payload([next(images) for _ in x]) for x in files]
