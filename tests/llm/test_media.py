import base64
import random

import numpy as np
import pytest

from slatecast.llm import media, webp


class Writer:
    """Writes a lossless bitstream symbol by symbol, for tests of what the payload encoder does not use."""

    def __init__(self, width, height):
        self.out = webp.BitWriter()
        for value, n in ((webp.SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            self.out.write(value, n)

    def transform(self, kind, *fields):
        self.out.write(1, 1)
        self.out.write(kind, 2)
        for value, n in fields:
            self.out.write(value, n)

    def pixels(self, items, top=True, cache_bits=0, meta=None, width=None):
        """Items: (a, r, g, b), ("copy", length, distance code) or ("cache", index); with meta, (bits, image, groups of items' positions)."""
        out = self.out
        out.write(1 if cache_bits else 0, 1)
        if cache_bits:
            out.write(cache_bits, 4)
        if top:
            out.write(1 if meta else 0, 1)
        if meta:
            bits, image, _ = meta
            out.write(bits - 2, 3)
            self.pixels([(255, 0, g, 0) for g in image], top=False)
        groups = max(meta[1]) + 1 if meta else 1
        owner = meta[2] if meta else [0] * len(items)
        alphabets = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
        weights = [[np.zeros(n, np.int64) for n in alphabets] for _ in range(groups)]
        parts = []
        for item, g in zip(items, owner, strict=True):
            if item[0] == "copy":
                (ls, le, ln), (ds, de, dn) = amount(item[1]), amount(item[2])
                part = [(0, 256 + ls, le, ln), (4, ds, de, dn)]
            elif item[0] == "cache":
                part = [(0, 280 + item[1], 0, 0)]
            else:
                a, r, gr, b = item
                part = [(0, gr, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
            for channel, symbol, _, _ in part:
                weights[g][channel][symbol] += 1
            parts.append((g, part))
        codes = []
        for group in weights:
            for w in group:
                if not w.any():
                    w[0] = 1
            lengths = [webp.code_lengths(w) for w in group]
            for n in lengths:
                webp.write_lengths(out, n)
            codes.append([webp.canonical(n) if sum(map(bool, n)) > 1 else None for n in lengths])
        for g, part in parts:
            for channel, symbol, extra, n in part:
                if codes[g][channel]:
                    out.write(*codes[g][channel][symbol])
                out.write(extra, n)

    def file(self):
        return webp.container(self.out.bytes())


def amount(value):
    """The symbol, further bits and their number for a length or distance."""
    for symbol in range(40):
        if symbol < 4:
            if value == symbol + 1:
                return symbol, 0, 0
            continue
        n = (symbol - 2) >> 1
        low = ((2 + (symbol & 1)) << n) + 1
        if low <= value < low + (1 << n):
            return symbol, value - low, n
    raise ValueError(value)


def argb(pixels):
    """Rows of (a, r, g, b) from the decoder's array."""
    return [tuple(int(p[k]) for k in (3, 0, 1, 2)) for p in pixels.reshape(-1, 4)]


def random_pixels(n, seed=1, spread=256):
    rng = random.Random(seed)
    return [tuple(rng.randrange(spread) for _ in range(4)) for _ in range(n)]


def test_a_known_file():
    made = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert made.shape == (1, 1, 4) and made.tolist() == [[[0, 0, 0, 0]]]


def test_literals_copies_and_distances():
    width, height = 9, 8
    pixels = random_pixels(20)
    items = [*pixels, ("copy", 7, 120 + 5), ("copy", 10, 2), ("copy", 9, 1), ("copy", 12, 4), ("copy", 14, 3)]
    out = list(pixels)
    for n, distance in ((7, 5), (10, 1), (9, width), (12, width - 1), (14, width + 1)):
        for _ in range(n):
            out.append(out[-distance])
    w = Writer(width, height)
    w.out.write(0, 1)
    w.pixels(items)
    assert argb(webp.decode(w.file())) == out


def test_near_offsets():
    spots = webp.near_offsets()
    assert len(spots) == 120 and spots[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and spots[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]


def test_colour_cache():
    bits = 4
    pixels = random_pixels(12, 2)
    cache = {}
    for a, r, g, b in pixels:
        v = a << 24 | r << 16 | g << 8 | b
        cache[((v * webp.CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - bits)] = (a, r, g, b)
    slots = list(cache)[:4]
    w = Writer(4, 4)
    w.out.write(0, 1)
    w.pixels([*pixels, *(("cache", s) for s in slots)], cache_bits=bits)
    assert argb(webp.decode(w.file())) == pixels + [cache[s] for s in slots]


def test_meta_codes():
    pixels = random_pixels(64, 3, 40)
    owner = [((k // 8) // 4) * 2 + (k % 8) // 4 for k in range(64)]
    w = Writer(8, 8)
    w.out.write(0, 1)
    w.pixels(pixels, meta=(2, [0, 1, 2, 3], owner))
    assert argb(webp.decode(w.file())) == pixels


@pytest.mark.parametrize("colours", [2, 3, 13, 200])
def test_palette(colours):
    rng = random.Random(colours)
    palette = random_pixels(colours, colours)
    index = [rng.randrange(colours) for _ in range(11 * 5)]
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    w = Writer(11, 5)
    w.transform(webp.PALETTE, (colours - 1, 8))
    w.pixels([tuple((c - (palette[k - 1][j] if k else 0)) & 255 for j, c in enumerate(p)) for k, p in enumerate(palette)], top=False)
    w.out.write(0, 1)
    per, bits = 1 << pack, 8 >> pack
    packed = [(255, 0, sum(v << (bits * k) for k, v in enumerate(index[y * 11 + x : min(y * 11 + x + per, y * 11 + 11)])), 0) for y in range(5) for x in range(0, 11, per)]
    w.pixels(packed)
    assert argb(webp.decode(w.file())) == [palette[k] for k in index]


def test_subtract_green_and_cross_colour():
    pixels = random_pixels(36, 5)
    factors = (0, 37, 200, 113)  # red to blue, green to blue, green to red: signed bytes
    w = Writer(6, 6)
    w.transform(webp.CROSS_COLOUR, (1, 3))
    w.pixels([(255, factors[1], factors[2], factors[3])], top=False)
    w.transform(webp.SUBTRACT_GREEN)
    w.out.write(0, 1)
    signed = lambda v: (v & 255 ^ 128) - 128
    stored = []
    for a, r, g, b in pixels:
        red = (r - (signed(factors[3]) * signed(g) >> 5)) & 255
        blue = (b - (signed(factors[2]) * signed(g) >> 5) - (signed(factors[1]) * signed(r) >> 5)) & 255
        stored.append((a, (red - g) & 255, g, (blue - g) & 255))
    w.pixels(stored)
    assert argb(webp.decode(w.file())) == pixels


@pytest.mark.parametrize("mode", range(16))
def test_predictors(mode):
    """Each prediction by its definition, one channel after another."""
    width, height = 5, 6
    pixels = random_pixels(width * height, mode + 9)
    at = lambda x, y: pixels[y * width + x]
    half = lambda a, b: (a + b) // 2
    cut = lambda v: max(0, min(255, v))

    def guess(x, y):
        if x == 0 and y == 0:
            return (255, 0, 0, 0)
        if y == 0:
            return at(x - 1, 0)
        if x == 0:
            return at(0, y - 1)
        L, T, TL = at(x - 1, y), at(x, y - 1), at(x - 1, y - 1)
        TR = at(x + 1, y - 1) if x + 1 < width else at(0, y)
        if mode == 11:
            left = sum(abs(t - c) for t, c in zip(T, TL, strict=True))
            top = sum(abs(v - c) for v, c in zip(L, TL, strict=True))
            return L if left < top else T
        each = {
            1: lambda l, t, c, r: l, 2: lambda l, t, c, r: t, 3: lambda l, t, c, r: r, 4: lambda l, t, c, r: c,
            5: lambda l, t, c, r: half(half(l, r), t), 6: lambda l, t, c, r: half(l, c), 7: lambda l, t, c, r: half(l, t),
            8: lambda l, t, c, r: half(c, t), 9: lambda l, t, c, r: half(t, r), 10: lambda l, t, c, r: half(half(l, c), half(t, r)),
            12: lambda l, t, c, r: cut(l + t - c), 13: lambda l, t, c, r: cut(half(l, t) + int((half(l, t) - c) / 2)),
        }
        if mode not in each:
            return (255, 0, 0, 0)
        return tuple(each[mode](*v) for v in zip(L, T, TL, TR, strict=True))

    w = Writer(width, height)
    w.transform(webp.PREDICTOR, (1, 3))
    w.pixels([(255, 0, mode, 0)], top=False)
    w.out.write(0, 1)
    w.pixels([tuple((v - g) & 255 for v, g in zip(at(x, y), guess(x, y), strict=True)) for y in range(height) for x in range(width)])
    assert argb(webp.decode(w.file())) == pixels


def test_broken_files():
    good = media.store(media.padded(b"some text " * 50))
    for bad in (b"", b"RIFF", good[:40], good[:12], b"x" * 100):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 5000, 64 * 16384 - 1, 64 * 16384 + 1])
def test_round_trip(size):
    raw = random.Random(size).randbytes(size) if size % 2 else (b"the text of a page. " * (size // 20 + 1))[:size]
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw)
    assert media.load(media.store(payload)) == payload


def test_odd_rows(odd, odd_rows, none):
    import hashlib
    import zlib

    made = media.texts_as_media(odd)
    rows = made.collect()
    want = []
    for r in odd_rows:
        payload = media.padded((r[1] or "").encode())
        want.append((r[0], len((r[1] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    same = sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"])) for r in rows)
    assert same
    features = {}
    for r in rows:
        assert features.setdefault(r["payload_sha256"], (r["feature"], bytes(r["media"]))) == (r["feature"], bytes(r["media"]))
    images = media.pixel_arrays(made.limit(3)).select("images").collect()
    assert all(x["images"][0]["width"] == 64 for x in images)
    assert media.texts_as_media(none).count() == 0


def test_texts_come_back_through_back_references(prose):
    """What is repeated is written as back-references, long and far ones too, and the stream is much shorter for it."""
    rng = random.Random(8)
    line = prose(30) + "\n"
    texts = [line * 40, "a" * 9000, prose(200) + line + prose(3000) + line, "".join(rng.choices("abc", k=5000)), "x" * 7, "", "é" * 300, prose(9) * 2]
    for text in texts:
        payload = media.padded(text.encode())
        data = np.frombuffer(payload, np.uint8)
        begin, length, distance = webp.back_references(data)
        at = 0
        for b, n, d in zip(begin, length, distance, strict=True):
            assert at <= b and 8 <= n <= 4096 and 0 < d <= b
            assert all(payload[k] == payload[k - d] for k in range(b, b + n))
            at = b + n
        assert media.load(media.store(payload)) == payload
    assert len(webp.back_references(np.frombuffer(texts[0].encode(), np.uint8))[0]) > 0
    assert len(media.store(media.padded(texts[0].encode()))) < len(texts[0]) / 5


def test_amounts_are_read_back():
    values = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 100, 4095, 4096, 65_537, (1 << 20) - 121])
    symbol, more, extra = webp._amounts(values)
    for v, s, m, e in zip(values, symbol, more, extra, strict=True):
        out = webp.BitWriter()
        out.write(int(m), int(e))
        assert webp.read_amount(webp.BitReader(out.bytes()), int(s)) == v
