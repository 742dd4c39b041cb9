"""Online logistic mixing of bit predictors in hashed contexts, many bits at a time.

A mixer foretells a step of bits from what earlier steps taught it, then learns the step: the log odds of each context
are weighed by a set that a gate chooses, added up, and refined by a table of what came true at such odds. A step's bits
are foretold together, so that it is numpy and not a loop over bits; steps begin small.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from slatecast.llm.common import segments
from slatecast.llm.webp import canonical, code_lengths

#: All odds are kept within LIMIT; the refinement has LEVELS of them. FIRST is what an input weighs before it is learned, RATE its step.
LIMIT, LEVELS, FIRST, RATE = 10.0, 41, 0.35, 0.04
#: What a count begins with, and for how many sightings the refinement trusts the odds themselves.
PRIOR, TRUST = 0.3, 20.0


class Mixer:
    """Counts by context and slot, weights by gate and input, and the refinement by gate and level of odds."""

    def __init__(self, contexts: int, extras: int, gates: int, bits: int) -> None:
        self.bits, self.gates = bits, gates
        self.counts = np.zeros((contexts, 1 << bits, 2), np.float32)
        self.odds = np.zeros((contexts, 1 << bits), np.float32)
        self.weights = np.full((gates, contexts + extras), FIRST)
        self.moved = np.full((gates, contexts + extras), 1e-4)
        levels = 1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, LEVELS)))
        self.seen = np.repeat(TRUST * np.stack([1 - levels, levels], axis=1)[None], gates, axis=0)

    def slots(self, contexts: list[np.ndarray], node: np.ndarray) -> np.ndarray:
        """A slot for each context and node, both of them numbers or hashes."""
        out = np.empty((len(contexts), len(node)), np.int64)
        branch = node.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        for k, value in enumerate(contexts):
            mixed = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + branch
            # folds the upper half onto the lower one and takes the upper half of a product; shifts of 64 bits are slow here
            part = mixed.view(np.uint32)
            part[::2] ^= part[1::2]
            out[k] = (mixed * np.uint64(0x9FB21C651E98DF25)).view(np.uint32)[1::2] & np.uint32((1 << self.bits) - 1)
        return out

    def run(self, slots: np.ndarray, extra: np.ndarray, gate: np.ndarray, came: np.ndarray, learn: np.ndarray) -> np.ndarray:
        """The log10 chance that each bit had; bits are learned where ``learn`` says so."""
        if not len(came):
            return np.zeros(0)
        inputs = [*(self.odds[k].take(s) for k, s in enumerate(slots)), *extra.astype(np.float32)]
        weights = np.ascontiguousarray(self.weights.T, np.float32)
        mixed = np.zeros(len(came), np.float32)
        for k, value in enumerate(inputs):
            mixed += weights[k].take(gate) * value
        np.clip(mixed, -LIMIT, LIMIT, out=mixed)
        chance = 1 / (1 + np.exp(-mixed))
        cell = gate * LEVELS + np.rint((mixed + np.float32(LIMIT)) * np.float32((LEVELS - 1) / (2 * LIMIT))).astype(np.int64)
        table = (self.seen[..., 1] / self.seen.sum(axis=2)).astype(np.float32).reshape(-1)
        refined = np.float32(0.5) * (chance + table.take(cell))
        sign = came.astype(np.float32)
        right = np.log(1 - sign + (2 * sign - 1) * refined).astype(np.float64) / np.log(10)
        self.learn(slots, inputs, gate, cell, (sign - chance) * learn, came, learn)
        return right

    def learn(self, slots: np.ndarray, inputs: list[np.ndarray], gate: np.ndarray, cell: np.ndarray, error: np.ndarray, came: np.ndarray, learn: np.ndarray) -> None:
        taught = learn.astype(np.float32)
        n = np.maximum(np.bincount(gate, taught, minlength=self.gates), 1)
        for k, value in enumerate(inputs):
            slope = np.bincount(gate, error * value, minlength=self.gates) / n
            self.moved[:, k] += slope * slope
            self.weights[:, k] += RATE * slope / np.sqrt(self.moved[:, k])
        self.seen += np.bincount(cell * 2 + came, taught, minlength=self.seen.size).reshape(self.seen.shape)
        for k, slot in enumerate(slots):
            np.add.at(self.counts[k].reshape(-1), slot * 2 + came, taught)
            held = self.counts[k].take(slot, axis=0) + np.float32(PRIOR)
            self.odds[k][slot] = np.log(held[:, 1] / held[:, 0])


@lru_cache(maxsize=1)
def spelling() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte and, last, the end of a word: its number of branches, their nodes and their directions.

    A prefix code for usual text: nodes near the root come often. Nodes are numbered by the bits that lead to them.
    """
    weights = np.full(257, 3, np.int64)
    weights[128:192], weights[195], weights[256] = 30, 700, 9000
    weights[32:127] = 15
    for k, letter in enumerate(b"eniatorshdlcumgbpfvzwqyxjk"):
        weights[letter] = 22000 // (k + 3) - 500
    weights[44] = weights[46] = 300
    code = canonical(code_lengths(weights, 16))
    longest = max(n for _, n in code.values())
    size = np.array([code[s][1] for s in range(257)])
    node, branch = np.zeros((257, longest), np.int64), np.zeros((257, longest), np.uint8)
    names: dict[tuple[int, int], int] = {}
    for s in range(257):
        bits, n = code[s]
        for k in range(n):
            node[s, k] = names.setdefault((k, bits & ((1 << k) - 1)), len(names))
            branch[s, k] = (bits >> k) & 1
    return size, node, branch


#: Bytes of context for a byte, which reach over the word's beginning into the word before; none and the text's beginning are symbols as well.
ORDERS, END, SPACE, NOTHING = 4, 256, 32, 300
#: Symbols that are spelled in one step.
SPELL_STEP = 1 << 16


class Speller:
    """Spells words in bits, along the branches of a fixed code for bytes and the end; contexts are the last bytes."""

    def __init__(self, bits: int = 20) -> None:
        self.mixer = Mixer(ORDERS, 0, (ORDERS + 1) * 4, bits)

    def run(self, words: list[bytes], before: list[bytes], learn: np.ndarray) -> np.ndarray:
        """The log10 chance of each word, its end included, after the word before it."""
        lead = [(b[-(ORDERS - 1) :], w) for b, w in zip(before, words, strict=True)]
        symbols, owner, place = _running(lead)
        out = np.zeros(len(words))
        for at in range(0, len(symbols), SPELL_STEP):
            start = max(0, at - ORDERS)
            part = symbols[start : at + SPELL_STEP].astype(np.uint64)
            wanted = np.flatnonzero(place[at : at + SPELL_STEP] >= 0) + (at - start)
            context, contexts = np.zeros(len(wanted), np.uint64), []
            for k in range(1, ORDERS + 1):
                context = context * np.uint64(0x9FB21C651E98DF25) + part[wanted - k] + np.uint64(k)
                contexts.append(context)
            out += np.bincount(owner[start + wanted], self._bits(part[wanted].astype(np.int64), contexts, place[start + wanted], learn[owner[start + wanted]]), minlength=len(words))
        return out

    def _bits(self, symbol: np.ndarray, contexts: list[np.ndarray], place: np.ndarray, learn: np.ndarray) -> np.ndarray:
        size, node, branch = spelling()
        first, at = segments(size[symbol])
        step = np.arange(len(at)) - first[at]
        slots = self.mixer.slots([c[at] for c in contexts], node[symbol[at], step])
        known = sum((self.mixer.odds[k].take(slots[k]) != 0).astype(np.int64) for k in range(ORDERS))
        right = self.mixer.run(slots, np.zeros((0, len(at))), known * 4 + np.minimum(place, 3)[at], branch[symbol[at], step].astype(np.int64), learn[at])
        return np.add.reduceat(right, first) if len(first) else right


def _running(lead: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols laid end to end, for each word ORDERS of what stands before it, its bytes and its end; the word of each symbol; its place, below 0 for what stands before."""
    length = np.fromiter((len(w) for _, w in lead), np.int64, len(lead))
    tail = np.fromiter((len(t) for t, _ in lead), np.int64, len(lead))
    starts, owner = segments(length + ORDERS + 1)
    place = np.arange(len(owner)) - starts[owner] - ORDERS
    symbols = np.full(len(owner), NOTHING, np.int16)
    symbols[place == -1] = SPACE
    symbols[(place < -1) & (place >= -1 - tail[owner])] = np.frombuffer(b"".join(t for t, _ in lead), np.uint8)
    symbols[(place >= 0) & (place < length[owner])] = np.frombuffer(b"".join(w for _, w in lead), np.uint8)
    symbols[place == length[owner]] = END
    return symbols, owner, place
