"""Whole batches of texts as byte arrays: words and lines found, hashed and counted without a loop over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from slatecast.llm.common import mix64, segments

#: Bytes handled at once. A longer text is one piece of its own.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and whatever is not ASCII make words here; the rest parts them.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD1342543DE82EF95


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in runs of about PIECE bytes, each with the number of its first."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > PIECE:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, a line feed after each text, and where each text begins (and the last ends)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def _powers(n: int, kept: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse; computed once, and again for longer texts only."""
    if len(kept["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            made = np.full(n + n // 8, base, np.uint64)
            made[0] = 1
            kept[name] = np.multiply.accumulate(made)
    return kept["up"][:n], kept["down"][:n]


class Words:
    """Where the words of a byte array begin and end, and hashes of them or their beginnings, A-Z taken as a-z."""

    def __init__(self, data: np.ndarray) -> None:
        self.begin, self.end = runs(_IN_WORD[data])
        up, self.down = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[_LOWER[data]] * up[: len(data)], out=self.prefix[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[begin]) * self.down[begin])


def distinct_slots(texts: list[bytes], bits: int, beginnings: tuple[int, ...] = (), wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text, ``bits`` bits wide, laid end to end, and each text's number of them.

    Terms are the words, and the first so many bytes of longer words for each of ``beginnings``. With ``wanted``, a flag
    for each slot, other slots are left out.
    """
    slots, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, some in pieces(texts):
        data, starts = joined(some)
        found = Words(data)
        terms, at = [], []
        for size in (0, *beginnings):
            begin, end = found.begin, found.end
            if size:
                long = end - begin > size
                begin = begin[long]
                end = begin + size
            slot = ((found.hashes(begin, end) + np.uint64(size)) >> np.uint64(64 - bits)).astype(np.int64)
            if wanted is not None:
                keep = wanted[slot]
                slot, begin = slot[keep], begin[keep]
            terms.append(slot)
            at.append(begin)
        owner = np.searchsorted(starts, np.concatenate(at), side="right") - 1
        both = np.sort((owner << bits) | np.concatenate(terms))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        slots.append(both & ((1 << bits) - 1))
        counts.append(np.bincount(both >> bits, minlength=len(some)))
    return np.concatenate(slots), np.concatenate(counts)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of rows laid end to end; a group without rows sums to zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    starts, _ = segments(counts)
    return total[starts + counts] - total[starts]
