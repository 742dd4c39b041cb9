"""Lossless WebP: a decoder of the whole bitstream, and an encoder for byte payloads.

The decoder reads prefix codes (simple and normal), meta codes, back-references with the two-dimensional distance map and
the colour cache, and undoes the predictor, cross-colour, subtract-green and palette transforms. Runs of literals that
share one code and leave the other channels constant are decoded by a table of 16-bit windows, several symbols a look.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREEN_LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
SIGNATURE, MAX_SIDE, CACHE_FACTOR = 0x2F, 1 << 14, 0x1E35A7BD
#: Distance codes that name a neighbour instead of a distance.
NEAR = 120


def near_offsets() -> list[tuple[int, int]]:
    """The 120 neighbours that short distance codes name, as (dx, dy): nearer ones first, then those further up, then right before left."""
    spots = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    spots.sort(key=lambda s: (s[0] ** 2 + s[1] ** 2, abs(s[0]), s[0] < 0))
    return spots[:NEAR]


class BitReader:
    """Bits from the lowest of each byte on."""

    def __init__(self, data: bytes) -> None:
        self.data = np.frombuffer(data + b"\0" * 8, np.uint8)
        self.raw = data + b"\0" * 8
        self.at, self.end = 0, 8 * len(data)

    def peek(self, at: int, n: int) -> int:
        return (int.from_bytes(self.raw[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        start = self.at >> 3
        out = (int.from_bytes(self.raw[start : start + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the bitstream ends early")
        return out


class PrefixCode:
    """A canonical prefix code. ``table[w]`` has the symbol and length for the next 15 bits ``w``."""

    def __init__(self, lengths: tuple[int, ...]) -> None:
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            raise ValueError("an empty prefix code")
        self.single = used[0] if len(used) == 1 else None
        self.bits = 0 if len(used) == 1 else max(lengths)
        if self.single is None:
            if sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
                raise ValueError("an incomplete prefix code")
            symbol, size = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            for s, (code, n) in canonical(lengths).items():
                symbol[code :: 1 << n] = s
                size[code :: 1 << n] = n
            self.symbols, self.sizes = symbol, size
            self.symbol, self.size = symbol.tolist(), size.tolist()

    def read(self, bits: BitReader) -> int:
        if self.single is not None:
            return self.single
        start = bits.at >> 3
        window = (int.from_bytes(bits.raw[start : start + 4], "little") >> (bits.at & 7)) & ((1 << self.bits) - 1)
        bits.at += self.size[window]
        if bits.at > bits.end:
            raise ValueError("the bitstream ends early")
        return self.symbol[window]


def canonical(lengths: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Each symbol's code, its bits in the order in which they are read, and the code's length."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


@lru_cache(maxsize=64)
def prefix_code(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(lengths)


@lru_cache(maxsize=8)
def run_table(lengths: tuple[int, ...]) -> list[tuple[bytes, int]]:
    """For each 16-bit window: the literals that lie wholly in it, as bytes, and their bits; none before other symbols."""
    code = prefix_code(lengths)
    window = np.arange(1 << 16)
    used = np.zeros(1 << 16, np.int64)
    out = [bytearray() for _ in range(1 << 16)]
    live = window
    mask = (1 << code.bits) - 1
    while len(live):
        part = (live >> used[live]) & mask
        symbol, size = code.symbols[part], code.sizes[part]
        ok = (used[live] + size <= 16) & (symbol < GREEN_LITERALS)
        live, symbol, size = live[ok], symbol[ok], size[ok]
        for w, s in zip(live.tolist(), symbol.tolist(), strict=True):
            out[w].append(s)
        used[live] += size
    same: dict[tuple[bytes, int], tuple[bytes, int]] = {}
    return [same.setdefault(x, x) for x in zip(map(bytes, out), used.tolist(), strict=True)]


def read_lengths(bits: BitReader, alphabet: int, seen: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}) -> tuple[int, ...]:
    """The code lengths of an alphabet. The last few ways in which they were written are remembered, bit by bit."""
    begin = bits.at
    known = seen.setdefault(alphabet, [])
    for written, size, lengths in known:
        if size <= bits.end - begin and bits.peek(begin, size) == written:
            bits.at += size
            return lengths
    lengths = _read_lengths(bits, alphabet)
    known.insert(0, (bits.peek(begin, bits.at - begin), bits.at - begin, lengths))
    del known[4:]
    return lengths


def _read_lengths(bits: BitReader, alphabet: int) -> tuple[int, ...]:
    lengths = [0] * alphabet
    if bits.read(1):  # simple: one or two symbols
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return tuple(lengths)
    of_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = prefix_code(tuple(of_lengths))
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, previous = 0, 8
    while at < alphabet and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            previous = n or previous
            at += 1
        else:
            value, times = (previous, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
            if at + times > alphabet:
                raise ValueError("too many code lengths")
            lengths[at : at + times] = [value] * times
            at += times
    return tuple(lengths)


@dataclass
class Codes:
    """The five codes of a group of pixels: green, lengths and cache; red; blue; alpha; distances."""

    lengths: list[tuple[int, ...]]
    codes: list[PrefixCode] = field(init=False)

    def __post_init__(self) -> None:
        self.codes = [prefix_code(n) for n in self.lengths]

    @property
    def plain(self) -> int | None:
        """The constant red, blue and alpha if those channels take no bits, while green does."""
        green, red, blue, alpha, _ = self.codes
        if green.single is not None or None in (red.single, blue.single, alpha.single):
            return None
        return alpha.single << 24 | red.single << 16 | blue.single


def read_amount(bits: BitReader, symbol: int) -> int:
    """A length or distance: small ones as such, greater ones by a power of two and further bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: BitReader, width: int, height: int, top: bool) -> np.ndarray:
    """The entropy-coded pixels, as numbers 0xAARRGGBB."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("a colour cache of a wrong size")
    groups, meta, tile = 1, None, 0
    if top and bits.read(1):
        tile = bits.read(3) + 2
        meta = (read_pixels(bits, -(-width >> tile), -(-height >> tile), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
        meta = meta.tolist()
    alphabets = (GREEN_LITERALS + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    all_codes = [Codes([read_lengths(bits, n) for n in alphabets]) for _ in range(groups)]
    total = width * height
    if top and groups == 1 and not cache_bits and (plain := all_codes[0].plain) is not None:
        return _read_plain(bits, all_codes[0], plain, width, total)
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    cached = at = 0  # pixels before ``cached`` are in the cache
    tiles = -(-width >> tile) if meta else 0
    codes = all_codes[0]
    while at < total:
        if meta:
            codes = all_codes[meta[((at // width) >> tile) * tiles + ((at % width) >> tile)]]
        symbol = codes.codes[0].read(bits)
        if symbol < GREEN_LITERALS:
            red, blue, alpha = (c.read(bits) for c in codes.codes[1:4])
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
            continue
        while cache_bits and cached < at:
            cache[((out[cached] * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
            cached += 1
        if symbol >= GREEN_LITERALS + LENGTH_CODES:
            out[at] = cache[symbol - GREEN_LITERALS - LENGTH_CODES]
            at += 1
            continue
        length = read_amount(bits, symbol - GREEN_LITERALS)
        distance = _distance(read_amount(bits, codes.codes[4].read(bits)), width)
        if distance > at or at + length > total:
            raise ValueError("a back-reference beyond the image")
        for k in range(at, at + length):
            out[k] = out[k - distance]
        at += length
    return np.array(out, np.uint32)


_NEAR = near_offsets()


def _distance(code: int, width: int) -> int:
    if code > NEAR:
        return code - NEAR
    dx, dy = _NEAR[code - 1]
    return max(1, dx + dy * width)


def _read_plain(bits: BitReader, codes: Codes, plain: int, width: int, total: int) -> np.ndarray:
    """Only green takes bits, and nothing follows: literals by whole windows, and back-references on bytes."""
    table = run_table(codes.lengths[0])
    n = len(bits.data) - 3
    words = np.zeros(n, np.uint32)
    for k in range(3):
        words |= bits.data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    words = words.tolist()
    out = bytearray()
    at, end = bits.at, bits.end
    green = codes.codes[0]
    while at < end:  # literals made of the last byte's idle bits are cut off below
        literals, step = table[(words[at >> 3] >> (at & 7)) & 0xFFFF]
        if step:
            out += literals
            at += step
            continue
        if len(out) >= total:
            break
        bits.at = at
        symbol = green.read(bits)
        length = read_amount(bits, symbol - GREEN_LITERALS)
        distance = _distance(read_amount(bits, codes.codes[4].read(bits)), width)
        if distance > len(out):
            raise ValueError("a back-reference beyond the image")
        piece = bytes(out[len(out) - distance :])
        out += (piece * (length // distance + 1))[:length]
        at = bits.at
    if len(out) < total:
        raise ValueError("the bitstream ends early")
    return np.uint32(plain) | (np.frombuffer(bytes(out[:total]), np.uint8).astype(np.uint32) << np.uint32(8))


def channels(pixels: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as the last axis, as wide integers."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def numbers(argb: np.ndarray) -> np.ndarray:
    part = (argb & 255).astype(np.uint32)
    return (part[..., 0] << np.uint32(24)) | (part[..., 1] << np.uint32(16)) | (part[..., 2] << np.uint32(8)) | part[..., 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The prediction of a pixel from its neighbours by one of fourteen modes (others: black)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return ((left + top_right) // 2 + top) // 2
    if mode == 6:
        return (left + top_left) // 2
    if mode == 7:
        return (left + top) // 2
    if mode == 8:
        return (top_left + top) // 2
    if mode == 9:
        return (top + top_right) // 2
    if mode == 10:
        return ((left + top_left) // 2 + (top + top_right) // 2) // 2
    if mode == 11:
        to_left, to_top = abs(top - top_left).sum(), abs(left - top_left).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = (left + top) // 2
        half = mean - top_left
        return np.clip(mean + (half + (half < 0)) // 2, 0, 255)  # halves towards zero
    return np.array([255, 0, 0, 0])


def predictions_undone(argb: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Add each pixel's prediction, row by row and from the left, as each needs those before it."""
    height, width, _ = argb.shape
    out = argb.copy()
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else row[0]
            row[x] = (row[x] + predict(int(modes[y >> tile, x >> tile]), row[x - 1], above[x], above[x - 1], right)) & 255
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255 ^ 128) - 128


def cross_colour_undone(argb: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    """Add to red a share of green, and to blue shares of green and of the new red; shares are in 32nds, by tile."""
    height, width, _ = argb.shape
    f = factors[np.arange(height)[:, None] >> tile, np.arange(width)[None, :] >> tile]
    out = argb.copy()
    green = _signed(argb[..., 2])
    out[..., 1] = (argb[..., 1] + ((_signed(f[..., 3]) * green) >> 5)) & 255
    out[..., 3] = (argb[..., 3] + ((_signed(f[..., 2]) * green) >> 5) + ((_signed(f[..., 1]) * _signed(out[..., 1])) >> 5)) & 255
    return out


def palette_undone(pixels: np.ndarray, palette: np.ndarray, width: int, pack: int) -> np.ndarray:
    """Indexes (several to a pixel for small palettes) to colours; those beyond the palette are clear black."""
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if pack:
        bits = 8 >> pack
        index = np.stack([(index >> np.uint32(bits * k)) & np.uint32((1 << bits) - 1) for k in range(1 << pack)], axis=-1).reshape(len(pixels), -1)[:, :width]
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, as an array (height, width, 4) of red, green, blue, alpha bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            pixels, has_alpha = decode_stream(data[at + 8 : at + 8 + size])
            bgra = pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)
            rgba = bgra[..., [2, 1, 0, 3]]
            if not has_alpha:
                rgba[..., 3] = 255
            return rgba
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode_stream(data: bytes) -> tuple[np.ndarray, bool]:
    bits = BitReader(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless bitstream")
    width, height, has_alpha = bits.read(14) + 1, bits.read(14) + 1, bool(bits.read(1))
    if bits.read(3):
        raise ValueError("an unknown version")
    full, steps, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform that comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            small = read_pixels(bits, -(-width >> tile), -(-height >> tile), False).reshape(-(-height >> tile), -1)
            steps.append((kind, width, tile, small))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = numbers(np.cumsum(channels(read_pixels(bits, n, 1, False)), axis=0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, width, pack, palette))
            width = -(-width >> pack)
        else:
            steps.append((kind, width, 0, None))
    pixels = read_pixels(bits, width, height, True).reshape(height, width)
    for kind, wide, value, extra in reversed(steps):
        if kind == PREDICTOR:
            pixels = numbers(predictions_undone(channels(pixels), (extra >> np.uint32(8)) & np.uint32(15), value))
        elif kind == CROSS_COLOUR:
            pixels = numbers(cross_colour_undone(channels(pixels), channels(extra), value))
        elif kind == PALETTE:
            pixels = palette_undone(pixels, extra, wide, value)
        else:
            argb = channels(pixels)
            argb[..., [1, 3]] += argb[..., [2]]
            pixels = numbers(argb)
    assert pixels.shape == (height, full)
    return pixels, has_alpha


class BitWriter:
    def __init__(self) -> None:
        self.value = self.size = 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def write_lengths(out: BitWriter, lengths: tuple[int, ...]) -> None:
    """Code lengths as such, each by a code in which all that occur take the same number of bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        out.write(1, 1)  # simple
        out.write(0, 1)
        out.write(1, 1)
        out.write(used[0], 8)
        return
    out.write(0, 1)
    out.write(15, 4)
    own = [4 if s < 16 else 0 for s in range(19)]
    for s in CODE_LENGTH_ORDER:
        out.write(own[s], 3)
    out.write(0, 1)
    code = canonical(tuple(own))
    for n in lengths:
        out.write(*code[n])


def code_lengths(weights: np.ndarray, most: int = 15) -> tuple[int, ...]:
    """Lengths of a prefix code for symbols of these weights (0: none), near the best and at most ``most`` bits."""
    import heapq

    weights = np.asarray(weights, np.int64)
    used = np.flatnonzero(weights)
    if len(used) == 1:
        return tuple(int(w > 0) for w in weights)
    least = 1
    while True:
        heap = [(max(int(weights[s]), least), int(s), ()) for s in used]
        heapq.heapify(heap)
        n = len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            n += 1
            heapq.heappush(heap, (a[0] + b[0], n, (a, b)))
        lengths = [0] * len(weights)
        stack = [(heap[0], 0)]
        while stack:
            (_, s, kids), depth = stack.pop()
            if kids:
                stack += [(kid, depth + 1) for kid in kids]
            else:
                lengths[s] = depth
        if max(lengths) <= most:
            return tuple(lengths)
        least *= 2


@lru_cache(maxsize=1)
def text_code() -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """A green code that suits text bytes, the same for all images: letters by a usual order of frequency, then signs, then others."""
    weights = np.full(GREEN_LITERALS + LENGTH_CODES, 2, np.int64)
    weights[128:192] = 40
    weights[192:256] = 10
    weights[32:127] = 20
    for k, letter in enumerate(b"eniatorshdlcumgbpfvzwqyxjk"):
        weights[letter] = 22000 // (k + 3) - 500
        weights[letter - 32] = 400 // (k + 3) + 40
    weights[32], weights[10], weights[0], weights[195], weights[44], weights[46] = 9000, 60, 100, 900, 300, 300
    weights[GREEN_LITERALS:] = 30
    lengths = code_lengths(weights, 14)
    return lengths, *_code_arrays(lengths)


@lru_cache(maxsize=1)
def distance_code() -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """A code for distances as such, of which the first NEAR numbers are none; all take about the same bits."""
    weights = np.zeros(DISTANCE_CODES, np.int64)
    weights[int(_amounts(np.array([NEAR + 1]))[0][0]) :] = 1
    lengths = code_lengths(weights)
    return lengths, *_code_arrays(lengths)


def _code_arrays(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    code = canonical(lengths)
    return np.array([code.get(s, (0, 0))[0] for s in range(len(lengths))], np.uint64), np.array([code.get(s, (0, 0))[1] for s in range(len(lengths))], np.int64)


def _amounts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances as symbols, further bits and their number; see ``read_amount``."""
    w = values.astype(np.int64) - 1
    top = np.floor(np.log2(np.maximum(w, 2) + 0.5)).astype(np.int64)
    extra = np.where(w < 4, 0, top - 1)
    symbol = np.where(w < 4, w, 2 * top + ((w >> np.maximum(top - 1, 0)) & 1))
    return symbol, w & ((1 << extra) - 1), extra


#: Bytes that a back-reference stands for at least and at most.
LEAST_MATCH, MOST_MATCH = 8, 4096


def back_references(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a stretch that stood before begins, its length and its distance, from left to right and without overlaps.

    A place is looked up by its next eight bytes, at the last place that has the same; neighbours at one distance make a stretch.
    """
    n = len(data) - LEAST_MATCH + 1
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    keys = np.lib.stride_tricks.sliding_window_view(data, LEAST_MATCH).copy().view(np.uint64).ravel()
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(same):
        return none, none, none
    distance = np.zeros(n, np.int64)
    distance[order[same + 1]] = order[same + 1] - order[same]
    edge = np.flatnonzero(np.diff(distance, prepend=0, append=0))
    found, at = [], 0
    for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if not distance[begin]:
            continue
        begin, stop = max(begin, at), end + LEAST_MATCH - 1
        while stop - begin >= LEAST_MATCH:
            size = min(stop - begin, MOST_MATCH)
            found.append((begin, size, int(distance[end - 1])))
            begin = at = begin + size
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (none, none, none)


@lru_cache(maxsize=1)
def _text_header() -> tuple[int, int]:
    out = BitWriter()
    out.write(0, 1)  # no colour cache
    out.write(0, 1)  # no meta codes
    write_lengths(out, text_code()[0])
    for constant in (0, 0, 255):
        write_lengths(out, tuple(int(s == constant) for s in range(256)))
    write_lengths(out, distance_code()[0])
    return out.value, out.size


def encode_bytes(payload: bytes, width: int) -> bytes:
    """A WebP file whose green samples are the payload, row by row: literals by the fixed text code, and back-references."""
    data = np.frombuffer(payload, np.uint8)
    height = len(data) // width
    if width * height != len(data) or not 0 < height <= MAX_SIDE or not 0 < width <= MAX_SIDE:
        raise ValueError("the payload must fill whole rows, at most 16384 of them")
    out = BitWriter()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (0, 1)):
        out.write(value, n)
    value, size = _text_header()
    out.write(value, size)
    written, sizes = _written(data)
    ends = np.cumsum(sizes) + out.size
    at = ends - sizes
    # the codes of one 32-bit word do not overlap, so adding them up sets their bits
    shifted = written << (at & 31).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    filled = np.add.reduceat(shifted, first)
    words = np.zeros(int(ends[-1] + 31 >> 5) + 2, np.uint64)
    words[word[first]] = filled
    low, carry = words & np.uint64(0xFFFFFFFF), words >> np.uint64(32)
    low[1:] += carry[:-1]
    stream = bytearray(low.astype("<u4").tobytes()[: (int(ends[-1]) + 7) // 8])
    head = out.bytes()
    last = len(head) - 1
    stream[:last] = head[:last]
    stream[last] |= head[last]
    return container(bytes(stream))


def _written(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of literals and back-references in their order, at most 32 at a time, and their numbers."""
    _, codes, sizes = text_code()
    begin, length, distance = back_references(data)
    if not len(begin):
        return codes[data], sizes[data]
    _, far, far_sizes = distance_code()
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + length, -1)
    plain = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
    symbol, more, extra = _amounts(length)
    one, one_size = codes[GREEN_LITERALS + symbol] | more.astype(np.uint64) << sizes[GREEN_LITERALS + symbol].astype(np.uint64), sizes[GREEN_LITERALS + symbol] + extra
    symbol, more, extra = _amounts(distance + NEAR)
    two, two_size = far[symbol] | more.astype(np.uint64) << far_sizes[symbol].astype(np.uint64), far_sizes[symbol] + extra
    order = np.argsort(np.concatenate([plain, begin, begin]), kind="stable")
    return np.concatenate([codes[data[plain]], one, two])[order], np.concatenate([sizes[data[plain]], one_size, two_size])[order]


def container(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad
