"""Quality by compression: how much smaller a text gets with a dictionary of good text than with one of bad.

Two zstandard dictionaries are built from labelled text.  A text is cut into short pieces, each compressed
with either dictionary; the difference of the two total sizes over the text's bytes is its raw measure, and
a logistic curve fitted on labelled rows that built no dictionary turns it into a probability.

Defined cases: a null or empty text has the raw measure 0; repeated rows score alike; without labels of both
classes every score is the share of label 1 (0.5 without any); other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Labelled rows of either class that train the model at most, and the bytes beyond which a text is none.
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 3_000, 200_000
DICTIONARY_BYTES, PIECE_BYTES, LEVEL = 16_384, 300, 1
#: Pieces that one dictionary is built from at most.
MAX_PIECES = 8_000


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]


@dataclass(frozen=True)
class Model:
    """``dictionaries`` of label 0 and 1 (none: a constant model) and the logistic curve."""

    dictionaries: tuple[bytes, ...]
    slope: float
    offset: float

    def compressors(self) -> list:
        import zstandard

        return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in self.dictionaries]

    def measures(self, texts: Sequence[str | None]) -> np.ndarray:
        if not self.dictionaries:
            return np.zeros(len(texts))
        bad, good = (c.compress for c in self.compressors())
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if data := (text or "").encode():
                out[i] = sum(len(bad(p)) - len(good(p)) for p in pieces(data)) / len(data)
        return out

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.measures(texts) + self.offset, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by Newton steps with a little ridge."""
    scale = float(x.std()) or 1.0
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, z.T @ (y - p) - 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def train(texts: Sequence[str], labels: np.ndarray) -> Model:
    """Two rows in three build the dictionaries and the third fits the curve."""
    import zstandard

    share = (labels.sum() + 1) / (len(labels) + 2)
    constant = Model((), 0.0, math.log(share / (1 - share)))
    build = np.arange(len(texts)) % 3 != 2
    dictionaries = []
    for y in (0, 1):
        found = [p for i in np.flatnonzero(build & (labels == y)) for p in pieces(texts[i].encode())]
        found = found[:: max(1, -(-len(found) // MAX_PIECES))]
        if len(found) < 10:
            return constant
        try:
            dictionaries.append(zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, found)) // 8)), found).as_bytes())
        except zstandard.ZstdError:  # too little text to build from
            dictionaries.append(b"".join(found)[-DICTIONARY_BYTES:])
    raw = Model(tuple(dictionaries), 1.0, 0.0)
    rest = np.flatnonzero(~build)
    if len(set(labels[rest])) < 2:
        return constant
    return Model(raw.dictionaries, *logistic(raw.measures([texts[i] for i in rest]), labels[rest].astype(float)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN_ROWS, prior: bool = True) -> Model:
    """A model from a bounded sample of the labelled rows; ``prior`` moves the curve to the classes' shares
    among all of them."""
    rows = common.training_texts(docs, common.cut(common.sample_per_label(labels, label, most)), MAX_TRAIN_BYTES)
    y = rows.column("label").to_numpy()
    model = train(rows.column("text").to_pylist(), y)
    return Model(model.dictionaries, model.slope, model.offset + (prior_shift(labels, label, y) if prior else 0.0))


def prior_shift(labels: DataFrame, label: str, sampled: np.ndarray) -> float:
    """How far the log odds of all labelled rows are from those of the sample."""
    n = {r[0]: r[1] for r in labels.where(labels[label].isin(0, 1)).groupBy(label).count().collect()}
    ones, zeros = int(sampled.sum()), int((sampled == 0).sum())
    return math.log((n.get(1, 0) + 1) * (zeros + 1) / ((n.get(0, 0) + 1) * (ones + 1)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array(model.scores(batch.column("text").to_pylist()))], ["doc_id", "score"])

    return common.map_batches(docs.select("doc_id", "text"), each, "doc_id long, score double")
