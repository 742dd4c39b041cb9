"""Toxicity by a factorization machine over hashed terms.

A document's distinct words are hashed to slots; the score is a bias, a weight for each slot, and for each pair of slots
the product of their factor vectors, so that an insult next to a group mention can count for more than the two alone.
Learning takes a bounded sample of labelled documents to the driver as slots; scoring reads a table of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatecast.llm import labelled, scan
from slatecast.llm.common import by_slices, held_out, map_batches, release, segments, utf8

BITS, FACTORS = 20, 4
#: Besides whole words, terms are the first so many bytes of longer words, which inflected forms share.
BEGINNINGS = (4, 5, 6, 7, 8)
#: At most so many labelled documents are learned from. Slots whose presence says less about the label than
#: LEAST_GAIN (a likelihood-ratio statistic), in all documents and beside any slot kept, are left out, as most of them
#: would only fit noise.
SAMPLE, LEAST_GAIN, ROUNDS, RATE, DECAY = 12_000, 12.0, 12, 0.1, 1e-4
#: Terms that tell nothing alone are tried in pairs if at least this share of the sample has them.
OFTEN = 0.05
#: The spread that factors start with.
START = 0.02
THRESHOLD = 0.5


@dataclass(frozen=True)
class FactorizationMachine:
    bias: float
    weights: np.ndarray  # slot
    factors: np.ndarray  # slot, factor

    def margins(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The raw score of each document, whose distinct slots lie end to end."""
        linear = scan.sums(self.weights[slots], counts)
        v = self.factors[slots].astype(np.float64)
        pairs = (scan.sums(v, counts) ** 2 - scan.sums(v * v, counts)).sum(axis=1) / 2
        return self.bias + linear + pairs

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.margins(*scan.distinct_slots(texts, BITS, BEGINNINGS, self.weights != 0)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def gains(slots: np.ndarray, of: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Twice the log likelihood ratio of label and presence being dependent, for each slot; ``of`` is each slot's document."""
    n, positive = len(labels), labels.sum()
    both, present = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for at in range(0, len(slots), 1 << 21):
        some = slots[at : at + (1 << 21)]
        both += np.bincount(some, labels[of[at : at + (1 << 21)]], minlength=1 << BITS)
        present += np.bincount(some, minlength=1 << BITS)

    return likelihood_ratio(both, present, positive, n)


def likelihood_ratio(both: np.ndarray, present: np.ndarray, positive: float, n: int) -> np.ndarray:
    def term(seen: np.ndarray, row: np.ndarray, column: float) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) * n / np.maximum(row * column, 1e-9)), 0)

    total = term(both, present, positive) + term(present - both, present, n - positive)
    return 2 * (total + term(positive - both, n - present, positive) + term(n - positive - present + both, n - present, n - positive))


def wanted_slots(slots: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """A flag for each slot that says enough about the label by itself, or among the documents with a slot that does, or
    as one of a pair that neither of them does.

    The latter two are how words show that count beside another one only. As they have a trial with each slot kept, or
    each other one, the statistic has to exceed LEAST_GAIN by twice the logarithm of the trials' number.
    """
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    kept = gains(slots, owner, labels) >= LEAST_GAIN
    alone = np.flatnonzero(kept)
    number = np.zeros(1 << BITS, np.int32)
    number[slots] = 1
    known = np.flatnonzero(number)
    number[known] = np.arange(len(known))
    at = np.flatnonzero(kept[slots])
    at = at[np.argsort(slots[at], kind="stable")]
    documents, bounds = owner[at], np.searchsorted(slots[at], np.append(alone, 1 << BITS))
    starts, _ = segments(counts)
    for k in range(len(alone)):
        docs = documents[bounds[k] : bounds[k + 1]]
        positive = labels[docs].sum()
        if not 0 < positive < len(docs):
            continue  # nothing is left to tell
        begin, of = segments(counts[docs])
        found = number[slots[np.arange(len(of)) - begin[of] + starts[docs][of]]]
        present = np.bincount(found, minlength=len(known)).astype(np.float64)
        both = np.bincount(found, labels[docs][of], minlength=len(known))
        some = np.flatnonzero(present)
        gain = likelihood_ratio(both[some], present[some], positive, len(docs))
        kept[known[some[gain >= LEAST_GAIN + 2 * np.log(len(alone))]]] = True
    kept[paired_slots(slots, owner, labels, kept)] = True
    return kept


def paired_slots(slots: np.ndarray, owner: np.ndarray, labels: np.ndarray, kept: np.ndarray, often: float = OFTEN) -> np.ndarray:
    """Slots not kept yet that say enough about the label where they stand together, of those that are frequent."""
    n, positive = len(labels), labels.sum()
    present = np.bincount(slots, minlength=1 << BITS)
    some = np.flatnonzero((present >= max(often * n, 8)) & (present < n) & ~kept)
    if len(some) < 2:
        return some[:0]
    number = np.full(1 << BITS, -1, np.int32)
    number[some] = np.arange(len(some))
    # which documents have a term, a bit for each
    has = np.zeros((len(some), -(-n // 64)), np.uint64)
    for at in range(0, len(slots), 1 << 20):
        of, document = number[slots[at : at + (1 << 20)]], owner[at : at + (1 << 20)]
        document, of = document[of >= 0].astype(np.uint64), of[of >= 0]
        np.bitwise_or.at(has, (of, document >> np.uint64(6)), np.uint64(1) << (document & np.uint64(63)))
    toxic = np.zeros(has.shape[1] * 64, np.uint8)
    toxic[:n] = labels > 0
    toxic = np.packbits(toxic, bitorder="little").view(np.uint64)
    found = np.zeros(len(some), bool)
    least = LEAST_GAIN + 2 * np.log(len(some) * (len(some) - 1) / 2)
    for k in range(len(some) - 1):
        shared = has[k + 1 :] & has[k]
        both = np.bitwise_count(shared & toxic).sum(axis=1, dtype=np.int64)
        gain = likelihood_ratio(both.astype(np.float64), np.bitwise_count(shared).sum(axis=1, dtype=np.int64).astype(np.float64), positive, n)
        good = gain >= least
        found[k] |= good.any()
        found[k + 1 :] |= good
    return some[found]


def fit(slots: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 5) -> FactorizationMachine:
    """Learn by AdaGrad on the logistic loss; without both labels present, the bias alone says what was seen."""
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(1 << BITS), np.zeros((1 << BITS, FACTORS))
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if len(labels) == 0 or labels.min() == labels.max():
        return FactorizationMachine(bias, weights.astype(np.float32), factors.astype(np.float32))
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    keep = wanted_slots(slots, counts, labels)[slots]
    owner, slots = owner[keep], slots[keep].astype(np.int64)
    known = np.unique(slots)
    factors[known] = rng.normal(0, START, (len(known), FACTORS))
    bounds = np.searchsorted(owner, np.arange(len(labels) + 1))
    seen_w, seen_v, seen_b = np.full(1 << BITS, 1e-2), np.full((1 << BITS, FACTORS), 1e-2), 1.0
    for _ in range(ROUNDS):
        shuffled = rng.permutation(len(labels))
        for at in range(0, len(labels), 64):
            docs = shuffled[at : at + 64]
            sizes = bounds[docs + 1] - bounds[docs]
            index = np.concatenate([slots[bounds[d] : bounds[d + 1]] for d in docs])
            row = np.repeat(np.arange(len(docs)), sizes)
            v = factors[index]
            total = scan.sums(v, sizes)
            margin = bias + scan.sums(weights[index], sizes) + (total**2 - scan.sums(v * v, sizes)).sum(axis=1) / 2
            error = (sigmoid(margin) - labels[docs]) / len(docs)
            unique, inverse = np.unique(index, return_inverse=True)
            g_w = np.bincount(inverse, error[row]) + DECAY * weights[unique]
            g_each = error[row, None] * (total[row] - v)
            g_v = np.stack([np.bincount(inverse, g_each[:, f]) for f in range(FACTORS)], axis=1) + DECAY * factors[unique]
            seen_w[unique] += g_w**2
            seen_v[unique] += g_v**2
            weights[unique] -= RATE * g_w / np.sqrt(seen_w[unique])
            factors[unique] -= RATE * g_v / np.sqrt(seen_v[unique])
            seen_b += error.sum() ** 2
            bias -= RATE * error.sum() / seen_b**0.5
    return FactorizationMachine(bias, weights.astype(np.float32), factors.astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """A machine learned from at most ``sample`` rows of ``labels(doc_id, toxic)`` outside the test fold."""
    rows = labelled.training_rows(docs, labels, "toxic", sample)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            slots, counts = scan.distinct_slots(batch["text"].to_pylist(), BITS, BEGINNINGS)
            ends = np.cumsum(counts)
            packed = [slots[e - c : e].astype(np.int32).tobytes() for e, c in zip(ends, counts, strict=True)]
            return pa.record_batch([batch["_id"], batch["label"], pa.array(packed, pa.binary())], ["id", "label", "slots"])

        return step

    got = map_batches(rows, "id long, label int, slots binary", make).toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("slots", "ascending")])
    each = [np.frombuffer(x, np.int32) for x in got["slots"].to_pylist()]
    counts = np.fromiter(map(len, each), np.int64, len(each))
    flat = np.concatenate([*each, np.zeros(0, np.int32)])
    truth = (got["label"].to_numpy() > 0).astype(np.float64)
    del got, each
    machine = fit(flat, counts, truth)
    release()
    return machine


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """``docs`` and a column ``toxicity`` with the score from 0 to 1 of each whole text; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size: 2**BITS slots

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        return by_slices(lambda some: shared.value.scores(some), pa.float64(), texts)

    return docs.withColumn("toxicity", toxicity(utf8()))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts get the score of no words; repeated rows each come out; a null id is in the fold of the empty
    string; other columns are ignored. Without usable labels every score is one half.
    """
    machine = learn(docs, labels)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(plain, machine)
    return scored.select("doc_id", held_out("doc_id", labelled.FOLDS, labelled.TEST_FOLD).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less the documents judged toxic; columns stay as they were."""
    rows = docs.select(F.struct("*").alias("row"), "text")  # packed, so that no name of an extra column is in the way
    return score(rows, learn(docs, labels)).where(F.col("toxicity") < threshold).select("row.*")
