"""Toxicity by subword-bag embeddings: word vectors are means of character n-gram vectors, the words of a
passage average into a linear softmax, and vectors and softmax are trained jointly (numpy).

A toxic word in a long text would drown in the average, so a text is scored by its most toxic passage of
``WINDOW`` words, in which a word counts once, and training refines on just those passages.  A misspelling never seen shares most n-grams
with the word it comes from, and so most of its vector.

Defined cases: a null, empty or wordless text has the score of an empty passage (the curve's offset); repeated
rows score alike; without labels of both classes every score is the share of label 1 (0.5 without any); other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common, textscan
from .quality import logistic, prior_shift

#: Labelled rows of either class that train the model at most, and the bytes beyond which a text is none.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 2_500, 100_000
#: Lengths in bytes of the n-grams, the buckets that they hash to, the vectors' length, words of a passage.
GRAMS, BUCKETS, DIMENSIONS, WINDOW = (4, 5, 6, 7), 1 << 17, 8, 12
WORD = textscan.byte_class(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of lower-cased texts as n-gram buckets (flat, and offsets), the number of each
    word in order, the texts' offsets in these, and the words' hashes.  Every byte outside words is one
    boundary mark."""
    mark = pa.scalar("\n", pa.large_string())
    texts = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), mark, pa.scalar("", pa.large_string()))
    data, offsets = textscan.text_bytes(texts)
    data = np.concatenate([np.full(1, 32, np.uint8), np.where(WORD[data], data, 32).astype(np.uint8)])
    starts, ends, at = textscan.word_spans(data, np.concatenate([[0], offsets + 1]), WORD)
    at = at[1:]
    prefix = textscan.prefix_hash(data)
    hashes, first, numbers = np.unique(textscan.word_codes(data, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first] - 1, ends[first] + 1
    grams, owners = [textscan.span_hash(prefix, a, b)], [np.arange(len(first))]
    for n in GRAMS:
        count = np.maximum(b - a - n + 1, 0)
        owner = np.repeat(np.arange(len(first)), count)
        start = a[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        grams.append(textscan.span_hash(prefix, start, start + n))
        owners.append(owner)
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    buckets = (gram[order] & np.uint64(BUCKETS - 1)).astype(np.int32)
    return buckets, np.searchsorted(owner[order], np.arange(len(first) + 1)), numbers, at, hashes


def gathered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`words_of` many texts, a step at a time."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    known: dict[int, int] = {}
    buckets, counts, numbers, ats = [], [], [], [np.zeros(1, int)]
    for a, b in textscan.steps(ends):
        own, bounds, order, at, hashes = words_of(texts.slice(a, b - a))
        new = np.array([h not in known for h in hashes.tolist()], bool)
        known.update(zip(hashes[new].tolist(), range(len(known), len(known) + int(new.sum())), strict=True))
        buckets.append(own[np.repeat(new, np.diff(bounds))])
        counts.append(np.diff(bounds)[new])
        numbers.append(np.array([known[h] for h in hashes.tolist()], np.int64)[order])
        ats.append(at[1:] + ats[-1][-1])
    return np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(numbers), np.concatenate(ats)


def means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The mean of each run of rows; no run is empty."""
    return np.add.reduceat(values, bounds[:-1], axis=0) / np.diff(bounds).reshape(-1, *[1] * (values.ndim - 1)) if len(bounds) > 1 else values[:0]


def best_windows(scores: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the highest mean of ``WINDOW`` consecutive words (of all, if fewer), in which a word that repeats
    adds its score once, and where it starts."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    # a repeat is taken off the windows that hold the word's previous place too
    order = np.argsort(numbers, kind="stable")
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    near = (numbers[order[1:]] == numbers[order[:-1]]) & (order[1:] - order[:-1] < WINDOW) & (text[order[1:]] == text[order[:-1]])
    last, again = order[:-1][near], order[1:][near]
    change = np.bincount(np.maximum(again - WINDOW + 1, at[text[again]]), scores[again], len(total)) - np.bincount(last + 1, scores[again], len(total))
    repeated = np.cumsum(change)
    best, start = np.zeros(len(at) - 1), at[:-1].copy()
    full = np.maximum(np.diff(at) - WINDOW + 1, 0)
    short = np.flatnonzero((full == 0) & (np.diff(at) > 0))
    best[short] = (total[at[short + 1]] - total[at[short]] - repeated[at[short]]) / (at[short + 1] - at[short])
    if len(total) > WINDOW and full.any():
        mean = (total[WINDOW:] - total[:-WINDOW] - repeated[: len(total) - WINDOW]) / WINDOW
        for i in np.flatnonzero(full):
            k = at[i] + int(np.argmax(mean[at[i] : at[i] + full[i]]))
            best[i], start[i] = mean[k], k
    return best, start


@dataclass(frozen=True)
class Model:
    """Each bucket's share of the log odds, and the logistic curve over a text's best window."""

    weights: np.ndarray
    slope: float
    offset: float

    def measures(self, texts: pa.Array) -> np.ndarray:
        data = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(data)])
        out = []
        for a, b in textscan.steps(ends):
            buckets, bounds, numbers, at, _ = words_of(texts.slice(a, b - a))
            out.append(best_windows(means(self.weights[buckets], bounds)[numbers] if len(numbers) else np.empty(0), numbers, at)[0])
        return np.concatenate(out) if out else np.empty(0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.measures(texts) + self.offset, -30, 30)))


class Trainer:
    """Stochastic gradient steps (Adagrad) on vectors and softmax together."""

    def __init__(self, buckets: np.ndarray, bounds: np.ndarray, seed: int = 7) -> None:
        self.random = np.random.default_rng(seed)
        self.buckets, self.bounds = buckets, bounds
        self.vectors = self.random.uniform(-0.1, 0.1, (BUCKETS, DIMENSIONS))
        self.softmax = self.random.normal(0, 0.5, (DIMENSIONS, 2))
        self.bias = np.zeros(2)
        self.seen = [np.full(x.shape, 1e-6) for x in (self.vectors, self.softmax, self.bias)]

    def word_scores(self) -> np.ndarray:
        return means((self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]))[self.buckets], self.bounds)

    def move(self, which: int, value: np.ndarray, gradient: np.ndarray, rate: float, rows: np.ndarray | slice = slice(None)) -> None:
        self.seen[which][rows] += gradient**2
        value[rows] -= rate * gradient / np.sqrt(self.seen[which][rows])

    def epoch(self, passages: list[np.ndarray], labels: np.ndarray, rate: float, size: int = 64) -> None:
        order = self.random.permutation(len(passages))
        for i in range(0, len(order), size):
            chosen = order[i : i + size]
            lengths = np.array([len(passages[k]) for k in chosen])
            flat = np.concatenate([passages[k] for k in chosen])
            words, local = np.unique(flat, return_inverse=True)
            counts = self.bounds[words + 1] - self.bounds[words]
            inner = np.concatenate([[0], np.cumsum(counts)])
            grams = self.buckets[np.repeat(self.bounds[words] - inner[:-1], counts) + np.arange(inner[-1])]
            vectors = means(self.vectors[grams], inner)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            hidden = means(vectors[local], ends)
            logits = hidden @ self.softmax + self.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            back = (p @ self.softmax.T) / lengths[:, None]
            share = np.repeat(np.arange(len(chosen)), lengths)
            each_word = np.stack([np.bincount(local, back[share, d], len(words)) for d in range(DIMENSIONS)], 1) / counts[:, None]
            used, slot = np.unique(grams, return_inverse=True)
            owner = np.repeat(np.arange(len(words)), counts)
            gradient = np.stack([np.bincount(slot, each_word[owner, d], len(used)) for d in range(DIMENSIONS)], 1)
            self.move(1, self.softmax, hidden.T @ p, rate)
            self.move(2, self.bias, p.sum(0), rate)
            self.move(0, self.vectors, gradient, rate, used)


def train(texts: pa.Array, labels: np.ndarray, rounds: int = 3) -> Model:
    """First on the distinct words of whole texts, then on each text's most toxic passage."""
    labels = labels.astype(int)
    share = (labels.sum() + 1) / (len(labels) + 2)
    buckets, bounds, numbers, at = gathered(texts) if len(texts) else (np.empty(0, np.int32), np.zeros(1, int), np.empty(0, int), np.zeros(1, int))
    filled = np.flatnonzero(np.diff(at) > 0)
    if len(set(labels[filled])) < 2:
        return Model(np.zeros(BUCKETS), 0.0, math.log(share / (1 - share)))
    trainer = Trainer(buckets, bounds)
    whole = [np.unique(numbers[at[i] : at[i + 1]]) for i in filled]
    y = labels[filled]
    for _ in range(4):
        trainer.epoch(whole, y, 0.2)
    for _ in range(rounds):
        _, start = best_windows(trainer.word_scores()[numbers], numbers, at)
        passages = [np.unique(numbers[start[i] : min(start[i] + WINDOW, at[i + 1])]) for i in filled]
        for _ in range(4):
            trainer.epoch(passages, y, 0.1)
    weights = trainer.vectors @ (trainer.softmax[:, 1] - trainer.softmax[:, 0])
    best, _ = best_windows(trainer.word_scores()[numbers], numbers, at)
    return Model(weights, *logistic(best[filled], y.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAIN_ROWS) -> Model:
    """A model from a bounded sample of the labelled rows, its curve moved to the classes' shares among all
    of them."""
    rows = common.training_texts(docs, common.cut(common.sample_per_label(labels, label, most)), MAX_TRAIN_BYTES)
    y = rows.column("label").to_numpy()
    model = train(rows.column("text").combine_chunks(), y)
    return Model(model.weights.astype(np.float32), model.slope, model.offset + prior_shift(labels, label, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 0.5 MB, whatever the input

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], ["doc_id", "score"])

    return common.map_batches(docs.select("doc_id", "text"), each, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.keep_where(docs, lambda batch: pa.array(shared.value.scores(batch.column("text")) < threshold))
