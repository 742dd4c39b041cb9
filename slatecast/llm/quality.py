"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its potential comes from how it is made (letters, signs, words, repeats) and from how its two
neighbours are made; a transition potential ties neighbours together. Forward-backward gives each line's probability of
being good, and their mean weighted by length is the document's quality. Learning takes a bounded sample of labelled
documents to the driver as line features; lines' labels are hidden, only documents have one. Scoring reads a table of
fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm import labelled, scan
from slatecast.llm.common import by_slices, held_out, map_batches, segments, utf8

#: At most so many labelled documents are learned from, in so many passes over all of them.
SAMPLE, ROUNDS, RATE, DECAY = 6_000, 160, 0.1, 2e-4
#: Chances nearer to 0 or 1 than this count as this far away when learning, and the step at which slopes are taken.
SURE, SLOPE = 1e-2, 1e-5
#: Each measure of a line is cut into so many levels at quantiles of the sample.
LEVELS = 10
THRESHOLD = 0.3

_CLASS_SETS = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b"|", b"!", b"%&#*$", b".,;:", b"@/\\_=<>{}[]()\"'`~^+-", b" \t"]
_CLASSES = np.zeros((256, len(_CLASS_SETS)), bool)
for _k, _set in enumerate(_CLASS_SETS):
    _CLASSES[list(_set), _k] = True
#: Measures of a line: shares of the classes, its length, words, their mean length, their distinct share, those repeated from just before, whether the line is a repeat.
MEASURES = len(_CLASS_SETS) + 6


@dataclass
class Lines:
    """The lines of some texts, laid end to end: measures, lengths, and each text's number of lines."""

    measures: np.ndarray
    length: np.ndarray
    count: np.ndarray


def lines_of(texts: list[bytes]) -> Lines:
    """Lines end at line feeds; an empty text is one empty line."""
    parts = [_lines_of_piece(some) for _, some in scan.pieces(texts)]
    if not parts:
        return Lines(np.zeros((0, MEASURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Lines(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("measures", "length", "count")))


def _lines_of_piece(texts: list[bytes]) -> Lines:
    data, starts = scan.joined(texts)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    length = ends - begins
    owner = np.searchsorted(starts, begins, side="right") - 1
    count = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(begins), MEASURES), np.float32)
    size = np.maximum(length, 1)
    for k in range(len(_CLASS_SETS)):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_CLASSES[data, k], out=total[1:])
        out[:, k] = (total[ends] - total[begins]) / size
    found = scan.Words(data)
    hashes = found.hashes(found.begin, found.end)
    line = np.searchsorted(begins, found.begin, side="right") - 1
    words = np.bincount(line, minlength=len(begins))
    # the first of each word in its line, and the words that the text had before
    order = np.lexsort((np.arange(len(line)), hashes, owner[line]))
    o, h, l = owner[line][order], hashes[order], line[order]
    again = np.concatenate([[False], (o[1:] == o[:-1]) & (h[1:] == h[:-1])]) if len(order) else np.zeros(0, bool)
    same_line = again & np.concatenate([[False], l[1:] == l[:-1]]) if len(order) else again
    repeated_here = np.bincount(l[same_line], minlength=len(begins))
    repeated = np.bincount(l[again], minlength=len(begins))
    k = len(_CLASS_SETS)
    some_words = np.maximum(words, 1)
    out[:, k] = np.log2(1 + length)
    out[:, k + 1] = np.log2(1 + words)
    out[:, k + 2] = np.bincount(line, found.end - found.begin, minlength=len(begins)) / some_words
    out[:, k + 3] = repeated_here / some_words
    out[:, k + 4] = repeated / some_words
    whole = found.hashes(begins, ends)
    order = np.lexsort((whole, owner))
    twin = (owner[order][1:] == owner[order][:-1]) & (whole[order][1:] == whole[order][:-1]) & (length[order][1:] > 0)
    flag = np.zeros(len(begins), bool)
    flag[order[1:][twin]] = True
    flag[order[:-1][twin]] = True
    out[:, k + 5] = flag
    return Lines(out, length, count)


@dataclass
class LineField:
    """The field: cuts between levels, potentials of (place, measure, level) for being good, and of (before, after)."""

    cuts: np.ndarray
    potentials: np.ndarray
    bias: float
    moves: np.ndarray

    def features(self, lines: Lines) -> np.ndarray:
        """For each line the indexes of its own, its predecessor's and its successor's levels; no neighbour has a level of its own."""
        level = np.stack([np.searchsorted(self.cuts[m], lines.measures[:, m], side="right") for m in range(MEASURES)], axis=1) if len(lines.length) else np.zeros((0, MEASURES), np.int64)
        starts, _ = segments(lines.count)
        some = lines.count > 0
        before, after = np.roll(level, 1, axis=0), np.roll(level, -1, axis=0)
        before[starts[some]] = LEVELS
        after[(starts + lines.count - 1)[some]] = LEVELS
        return np.concatenate([(place * MEASURES + np.arange(MEASURES)) * (LEVELS + 1) + x for place, x in enumerate((level, before, after))], axis=1)

    def good(self, features: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of being good, and for the moves into each line those of the four pairs."""
        lift = self.potentials[features].sum(axis=1) + self.bias
        return forward_backward(lift, self.moves, count)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        lines = lines_of(texts)
        chance, _ = self.good(self.features(lines), lines.count)
        weight = np.maximum(lines.length, 1).astype(np.float64)
        return scan.sums(chance * weight, lines.count) / scan.sums(weight, lines.count)


def forward_backward(lift: np.ndarray, moves: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of chains laid end to end, whose lines have potential ``lift`` if good and 0 if bad.

    All chains that are long enough take each step together. Works with log odds: a message is the difference between
    good and bad.
    """
    starts, _ = segments(count)
    order = np.argsort(-count, kind="stable")
    starts, count = starts[order], count[order]
    fore, back = np.zeros(len(lift)), np.zeros(len(lift))
    longest = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(longest), side="left")  # chains with more lines than k

    def through(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.logaddexp(m[0, 1], x + m[1, 1]) - np.logaddexp(m[0, 0], x + m[1, 0])

    for k in range(1, longest):
        at = starts[: active[k]] + k
        fore[at] = through(fore[at - 1] + lift[at - 1], moves)
    for k in range(longest - 2, -1, -1):
        at = starts[: active[k + 1]] + k
        back[at] = through(back[at + 1] + lift[at + 1], moves.T)
    chance = 1 / (1 + np.exp(-np.clip(fore + lift + back, -500, 500)))
    inner = np.ones(len(lift), bool)
    inner[starts[count > 0]] = False
    at = np.flatnonzero(inner)
    left, right = (fore + lift)[at - 1], (lift + back)[at]
    joint = moves.reshape(4)[:, None] + np.stack([np.zeros_like(left), right, left, left + right])
    joint = np.exp(joint - joint.max(axis=0))
    return chance, (joint / joint.sum(axis=0)).sum(axis=1) if len(at) else np.zeros(4)


def slopes(lift: np.ndarray, moves: np.ndarray, count: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How the mean cost of the documents' labels grows with each line's potential, and with that of each pair of labels.

    The chance of a good document is the mean of its lines' marginals by ``weight``. How that mean changes with a line's
    potential is how the line's marginal changes when all lines are lifted by their weights, as the covariance of two
    labels is the same either way; so two further passes forward and backward give all slopes.
    """
    chance, _ = forward_backward(lift, moves, count)
    score = np.clip(scan.sums(chance * weight, count), SURE, 1 - SURE)
    along = np.repeat((1 - labels) / (1 - score) - labels / score, count) * weight
    (up, pairs_up), (down, pairs_down) = (forward_backward(lift + s * along, moves, count) for s in (SLOPE, -SLOPE))
    step = 2 * SLOPE * len(labels)
    return (up - down) / step, (pairs_up - pairs_down) / step


def fit(lines: Lines, labels: np.ndarray) -> LineField:
    """Maximise the likelihood of the documents' labels by Adam; documents count alike.

    Lines bear no labels of their own; those that a document's label speaks of are hidden (see ``slopes``).
    """
    cuts = np.array([np.quantile(lines.measures[:, m], np.arange(1, LEVELS) / LEVELS) if len(lines.length) else np.zeros(LEVELS - 1) for m in range(MEASURES)])
    size = 3 * MEASURES * (LEVELS + 1)
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    field = LineField(cuts, np.zeros(size), float(np.log(rate / (1 - rate))), np.zeros((2, 2)))
    if len(labels) == 0 or labels.min() == labels.max():
        return field
    features = field.features(lines)
    weight = np.maximum(lines.length, 1).astype(np.float64)
    weight /= np.repeat(scan.sums(weight, lines.count), lines.count)
    state = np.zeros((2, size + 5))
    flat = features.ravel()
    for step in range(1, ROUNDS + 1):
        slope, pair_slope = slopes(field.potentials[features].sum(axis=1) + field.bias, field.moves, lines.count, weight, labels)
        g = np.concatenate([np.bincount(flat, np.repeat(slope, features.shape[1]), minlength=size) + DECAY * field.potentials, [slope.sum()], pair_slope + DECAY * field.moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        change = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        field.potentials = field.potentials - change[:size]
        field.bias -= change[size]
        field.moves = field.moves - change[size + 1 :].reshape(2, 2)
    return field


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """A field learned from at most ``sample`` rows of ``labels(doc_id, quality)`` outside the test fold."""
    rows = labelled.training_rows(docs, labels, "quality", sample)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lines = lines_of(batch["text"].to_pylist())
            ends = np.cumsum(lines.count)
            cut = [slice(e - c, e) for e, c in zip(ends, lines.count, strict=True)]
            measures = pa.array([lines.measures[c].tobytes() for c in cut], pa.binary())
            length = pa.array([lines.length[c].tobytes() for c in cut], pa.binary())
            return pa.record_batch([batch["_id"], batch["label"], measures, length], ["id", "label", "measures", "length"])

        return step

    got = map_batches(rows, "id long, label int, measures binary, length binary", make).toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("length", "ascending"), ("measures", "ascending")])
    length = [np.frombuffer(x, np.int64) for x in got["length"].to_pylist()]
    measures = [np.frombuffer(x, np.float32).reshape(-1, MEASURES) for x in got["measures"].to_pylist()]
    lines = Lines(np.concatenate([*measures, np.zeros((0, MEASURES), np.float32)]), np.concatenate([*length, np.zeros(0, np.int64)]), np.fromiter(map(len, length), np.int64, len(length)))
    return fit(lines, (got["label"].to_numpy() > 0).astype(np.float64))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts are one empty line; repeated rows each come out; a null id is in the fold of the empty string;
    other columns are ignored. Without usable labels every score is one half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))  # of fixed size

    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        return by_slices(lambda some: shared.value.scores(some), pa.float64(), texts)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quality(utf8()).alias("score"))
    return scored.select("doc_id", held_out("doc_id", labelled.FOLDS, labelled.TEST_FOLD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
