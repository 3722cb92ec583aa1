import base64
import hashlib
import zlib

import numpy as np
import pytest

from loomcat.llm import webp
from loomcat.llm import webp_many as many


def picture(h=13, w=22, colours=None, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    argb = 0xFF000000 | ((x * 9 + rng.integers(0, 3, (h, w))) % 256) << 16 | ((y * 7) % 256) << 8 | ((x * y) % 256)
    argb = argb.astype(np.uint32)
    if colours:
        argb = np.unique(argb)[:colours][rng.integers(0, colours, (h, w))]
    return argb


@pytest.mark.parametrize("mode", range(16))
def test_every_predictor(mode):
    p = picture()
    blocks = ((22 + 3) >> 2) * ((13 + 3) >> 2)
    assert np.array_equal(webp.decode(webp.encode(p, (webp.PREDICT,), modes=[mode] * blocks)), p)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    p = picture(30, 31, colours)
    assert np.array_equal(webp.decode(webp.encode(p, (webp.PALETTE,))), p)


@pytest.mark.parametrize("cache", [0, 1, 6, 11])
@pytest.mark.parametrize("lz", [False, True])
def test_cache_and_back_references(cache, lz):
    p = np.tile(picture(8, 10, 40), (4, 3))
    assert np.array_equal(webp.decode(webp.encode(p, cache_bits=cache, lz=lz)), p)


def test_all_transforms_together_and_alpha():
    p = picture() & np.uint32(0x7FFFFFFF)
    blocks = ((22 + 3) >> 2) * ((13 + 3) >> 2)
    rng = np.random.default_rng(3)
    media = webp.encode(p, (webp.PREDICT, webp.CROSS, webp.GREEN), modes=rng.integers(0, 14, blocks).tolist(), factors=rng.integers(0, 1 << 24, blocks).tolist(), cache_bits=4)
    assert np.array_equal(webp.decode(media), p)


def test_several_code_groups():
    """An entropy image that gives two blocks codes of their own, written by hand."""
    out = webp.Writer()
    webp._head(out, 8, 4, False)
    out.put(0, 1)  # no transform
    out.put(0, 1)  # no cache
    out.put(1, 1)  # groups
    out.put(0, 3)  # of 4 by 4 pixels
    webp.write_image(out, [0xFF000000, 0xFF000100], 2)
    for green in (10, 20):
        for lengths in ([int(s == green) for s in range(280)], [1] + [0] * 255, [0, 1] + [0] * 254, [0] * 255 + [1], [0] * 40):
            webp.write_code(out, lengths)
    got = webp.decode(webp._file(out.done()))
    assert (got[:, :4] == 0xFF000A01).all() and (got[:, 4:] == 0xFF001401).all()


def test_simple_code_and_bad_files():
    p = np.full((3, 3), 0xFF010203, np.uint32)
    assert np.array_equal(webp.decode(webp.encode(p)), p)
    for raw in (b"", b"RIFF....WEBP", webp.encode(p)[:-6], b"GIF89a" + bytes(30)):
        with pytest.raises(ValueError):
            webp.decode(raw)


def english(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(300)]
    return (" ".join(rng.choice(words, n // 3)).encode() + b"x" * n)[:n]


@pytest.mark.parametrize("n", [576, 1152, 576 * 40, 576 * 300])
@pytest.mark.parametrize("kind", ["noise", "text", "lines", "fill", "ramp"])
def test_store_round_trip(n, kind):
    x = {
        "noise": np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes(), "text": english(n), "lines": (english(90) * n)[:n], "fill": b"\xff" * n, "ramp": (np.arange(n) // 3 % 256).astype(np.uint8).tobytes(),
    }[kind]
    media = webp.store(x)
    assert webp.restore(media) == x and len(media) < 1.01 * n + 200
    if kind == "text":
        assert len(media) < (0.8 if n > 9_000 else 0.95) * n


def test_images_have_codes_copies_and_transforms_of_their_own(monkeypatch):
    """Each way is taken by some payload, and each takes less than without it."""
    used = []
    old = webp.encode
    monkeypatch.setattr(webp, "encode", lambda pixels, **how: used.append(how) or old(pixels, **how))
    n = 576 * 96
    rng = np.random.default_rng(2)
    grey = np.repeat(rng.integers(0, 256, n // 3), 3).astype(np.uint8).tobytes()
    few = rng.integers(0, 256, (12, 3))[rng.integers(0, 12, n // 3)].astype(np.uint8).tobytes()
    up = (np.arange(n) // 576 * 5 + np.tile(rng.integers(0, 256, 576), n // 576)).astype(np.uint8).tobytes()
    flat = (np.arange(n) // 3 * np.array([7, 7, 7]).repeat(n // 3) % 256).astype(np.uint8).tobytes()
    for x in (grey, few, up, flat, english(n)):
        media = webp.store(x)
        assert webp.restore(media) == x and len(media) < 0.75 * n
    assert {how.get("transforms", ()) for how in used} >= {(), (webp.GREEN,), (webp.PALETTE,), (webp.PREDICT,)}
    lined = english(300) * 200
    lined = lined[: len(lined) // 576 * 576]
    pixels = np.frombuffer(lined, np.uint8).reshape(-1, 3)
    argb = np.zeros((len(pixels), 4), np.uint8)
    argb[:, :3], argb[:, 3] = pixels[:, ::-1], 255
    argb = argb.view("<u4").reshape(-1, webp.ROW)
    sizes = [len(old(argb, cache_bits=cache, lz=lz)) for cache, lz in ((0, False), (webp.CACHE, False), (0, True))]
    assert sizes[2] < sizes[1] < sizes[0]


def test_small_images_have_copies_too():
    x = english(46) * 100
    x += b"\xff" * (-len(x) % 576)
    media = webp.store(x)
    assert webp.restore(media) == x and len(x) < 5000 and len(media) < 250


def test_several_images(monkeypatch):
    monkeypatch.setattr(webp, "SIDE", 2)
    monkeypatch.setattr(webp, "_head", lambda out, w, h, a: [out.put(v, n) for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 4))])
    webp._fixed_head.cache_clear()
    x = bytes(range(256)) * 9
    assert webp.restore(webp.store(x)) == x
    webp._fixed_head.cache_clear()


def test_a_file_of_another_encoder():
    """The one-pixel transparent image that web pages use to ask whether lossless files are shown."""
    got = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert got.shape == (1, 1) and got[0, 0] >> 24 == 0


def plain_decode(raw):
    """The main image of a file without transforms or groups, symbol by symbol, by definition."""
    bits = webp.Bits(webp._lossless(raw))
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(4)
    assert not bits.read(1)
    cache_bits = bits.read(4) if bits.read(1) else 0
    assert not bits.read(1)
    codes = [webp.read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    out, cache = [], {}

    def put(p):
        out.append(p)
        if cache_bits:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while len(out) < width * height:
        s = codes[0].read(bits)
        if s < 256:
            r, b = codes[1].read(bits), codes[2].read(bits)
            put(codes[3].read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = webp._amount(bits, s - 256)
            d = webp._distance(webp._amount(bits, codes[4].read(bits)), width)
            for _ in range(n):
                put(out[-d])
        else:
            put(cache.get(s - 280, 0))
    return np.array(out, np.uint32).reshape(height, width)


@pytest.mark.parametrize("seed", range(6))
def test_all_bits_at_once_is_symbol_by_symbol(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(webp, "STRETCH", [64, 500, 1 << 15][seed % 3])
    p = rng.integers(0, 4 + 60 * (seed % 2), (11, 37)).astype(np.uint32) * np.uint32(0x10305) | np.uint32(0xFF000000)
    p[4:6] = p[1:3]
    for cache in (0, 3, 9):
        for lz in (False, True):
            raw = webp.encode(p, cache_bits=cache, lz=lz)
            assert np.array_equal(plain_decode(raw), p) and np.array_equal(webp.decode(raw), p)


def test_columns(spark):
    p = picture(5, 6)
    rows = spark.createDataFrame([(1, webp.encode(p), "x"), (2, None, None)], "doc_id long, media binary, width string")
    got = {r.doc_id: r for r in webp.decode_images(rows).collect()}
    assert (got[1].width, got[1].height) == (6, 5) and np.array_equal(np.frombuffer(got[1].pixels, "<u4").reshape(5, 6), p)
    assert got[2].pixels is None
    again = webp.decode_images(webp.encode_images(webp.decode_images(rows))).where("doc_id = 1").first()
    assert again.pixels == got[1].pixels
    bad = spark.createDataFrame([(1, b"none")], "doc_id long, media binary")
    assert webp.decode_images(bad, on_error="null").first().pixels is None


def test_digest(spark):
    rows = [(1, "aé" * 300, "en"), (2, None, None), (3, "", "x"), (4, "aé" * 300, None), (4, "aé" * 300, None)]
    got = webp.digest(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()
    assert len(got) == 5
    for r in got:
        raw = (dict((a, b) for a, b, _ in rows)[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(r.media_sha256, r.feature) for r in got}) == 2
    assert webp.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def kinds():
    rng = np.random.default_rng(5)
    grey = np.repeat(rng.integers(0, 256, 192 * 40), 3).astype(np.uint8).tobytes()
    few = rng.integers(0, 256, (30, 3))[rng.integers(0, 30, 192 * 40)].astype(np.uint8).tobytes()
    up = (np.arange(576 * 96) // 576 * 5 + np.tile(rng.integers(0, 256, 576), 96)).astype(np.uint8).tobytes()
    flat = (np.arange(576 * 40) // 3 * 7 % 256).astype(np.uint8).tobytes()
    tall = (np.arange(576 * 160) // 576 * 3 + np.tile(rng.integers(0, 256, 576), 160)).astype(np.uint8).tobytes()
    texts = [english(576 * (1 + n % 7), n) for n in range(40)]
    skewed = np.minimum(rng.geometric(0.5, 576 * 30), 255).astype(np.uint8).tobytes()
    steep = b"".join(bytes([k]) * (3 * 2 ** min(k, 12)) for k in range(20))
    return [grey, few, up, flat, tall, *texts, b"\xff" * 576, b"\xff" * 57600, english(90) * 320, english(46) * 576, rng.integers(0, 256, 5760).astype(np.uint8).tobytes(), skewed, steep[: len(steep) // 576 * 576], b"", english(576 * 200), texts[0], texts[3]]


def test_images_coded_together_are_those_coded_alone(monkeypatch):
    """Byte for byte, in any company and order, and read back together as alone."""
    payloads = kinds()
    alone = [webp.store(x) for x in payloads]
    seen = []
    old = many._images
    monkeypatch.setattr(many, "_images", lambda parts: seen.append(len(parts)) or old(parts))
    assert many.store(payloads) == alone and max(seen) > 40
    assert many.store(payloads[::-1]) == alone[::-1] and [many.store([x])[0] for x in payloads[:9]] == alone[:9]
    assert many.restore(alone) == payloads == [webp.restore(x) for x in alone]
    monkeypatch.setattr(many, "SMALL", 192 * 4)  # most go alone
    assert many.store(payloads) == alone and many.restore(alone) == payloads
    monkeypatch.setattr(many, "IMAGES", 3)
    assert many.store(payloads) == alone and many.restore(alone) == payloads
    assert many.store([]) == many.restore([]) == []


def test_hash_collisions_of_copies_are_noticed(monkeypatch):
    payloads = kinds()[:20]
    alone = [webp.store(x) for x in payloads]
    monkeypatch.setattr(many.c, "mix", lambda x: x & np.uint64(0xFF) << np.uint64(40))
    monkeypatch.setattr(many.w, "copies", lambda pixels, plain=webp.copies: used.append(1) or plain(pixels))
    used = []
    got = many.store(payloads)
    assert used and many.restore(got) == payloads and len(got) == len(alone)


def test_code_lengths_of_many_rows():
    rng = np.random.default_rng(7)
    counts = [np.minimum(rng.geometric(p, 90), 10**6) * (rng.random(90) < q) for p in (0.001, 0.3, 0.9) for q in (0, 0.02, 0.1, 0.9)]
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    counts = np.array([*counts, [1] * 90, [5] + [0] * 89, fibonacci + [0] * 60])
    assert many.huffman(counts).tolist() == [webp.huffman(x.tolist(), 15) for x in counts]


def test_files_of_all_kinds_decoded_together():
    """Palettes, alpha, all transforms, other caches, several sizes, and a file of another encoder; bad files are errors."""
    blocks = ((22 + 3) >> 2) * ((13 + 3) >> 2)
    rng = np.random.default_rng(3)
    files = [webp.encode(picture(30, 31, n), (webp.PALETTE,)) for n in (1, 2, 3, 9, 17, 200)]
    files += [webp.encode(np.tile(picture(8, 10, 40), (4, 3)), cache_bits=n, lz=lz) for n in (0, 1, 6, 11) for lz in (False, True)]
    files.append(webp.encode(picture() & np.uint32(0x7FFFFFFF), (webp.PREDICT, webp.CROSS, webp.GREEN), modes=rng.integers(0, 14, blocks).tolist(), factors=rng.integers(0, 1 << 24, blocks).tolist(), cache_bits=4))
    files.append(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    files.append(webp.encode(np.full((3, 3), 0xFF010203, np.uint32)))
    for a, b in zip(many.decode(files), map(webp.decode, files), strict=True):
        assert a.shape == b.shape and np.array_equal(a, b)
    whole = webp.encode(picture(), lz=False)
    for cut in (6, 40, 100):
        with pytest.raises(ValueError):
            many.decode([files[0], whole[:-cut], files[1]])


def test_a_batch_takes_few_calls(monkeypatch):
    """Hardly any of 200 texts are coded alone."""
    calls = []
    old = webp.smallest
    monkeypatch.setattr(webp, "smallest", lambda pixels: calls.append(1) or old(pixels))
    payloads = [english(576 * (1 + n % 7), n) for n in range(200)]
    assert many.restore(many.store(payloads)) == payloads and len(calls) < 20


def test_copies_from_too_far_are_not_taken():
    """A text of over 3 MB repeats its beginning at its end, further away than a back-reference can reach."""
    x = np.random.default_rng(1).integers(0, 16, 576 * 5600).astype(np.uint8).tobytes()
    x += x[:5760]
    media = webp.store(x)
    assert len(media) < 0.6 * len(x) and webp.restore(media) == x == many.restore(many.store([x]))[0]
    near = np.concatenate((np.arange(9), np.arange(1000, 1000 + webp.FAR - 9), np.arange(9))).astype(np.uint32)
    assert webp.copies(near) == [(webp.FAR, 9, webp.FAR)] and webp.copies(np.insert(near, 500, 7)) == []
