"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts.  A text is compressed with each; the difference of the two sizes over
their sum, the smaller size over the raw length (small for repetitive text), the
log length, and the second-order terms of these go through a logistic
calibration, fitted on labelled texts that neither dictionary has seen.

The labelled sample is bounded (`max_docs` documents a class, those of the least
hashes of doc_id, a top-k without a shuffle); scoring is one pass over Arrow batches, nothing is shuffled.

Defined cases: null and empty texts get the calibrated score of no evidence;
labels of null are not learned; if a class has no usable text the score is the
share of label 1; repeated texts get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LEVEL = 3
#: The features of an empty text.
NOTHING = (1.0, *[0.0] * 7)


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the newest texts as raw content where too few to train."""
    texts = [t for t in texts if t]
    try:
        return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


class Sizes:
    """Compressed sizes with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        make = lambda x: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_content_size=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def features(self, text: bytes) -> tuple[float, ...]:
        if not text:
            return NOTHING
        g, b = len(self.good.compress(text)), len(self.bad.compress(text))
        difference, ratio, length = (b - g) / (b + g), min(g, b) / len(text), math.log2(len(text)) / 10 - 1
        d, r = 20 * difference, 10 * (ratio - 0.4)
        return 1.0, d, r, length, 2 * d * length, d * d, r * r, d * r


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(samples: list[tuple[str, int]], size: int = 112_640) -> Model:
    """The first half of each class makes the dictionaries, the second the calibration."""
    good, bad = ([t.encode() for t, y in samples if y == k and t] for k in (1, 0))
    if len(good) < 2 or len(bad) < 2:
        share = (sum(y == 1 for _, y in samples) + 0.5) / (len(samples) + 1)
        return Model(b"", b"", (math.log(share / (1 - share)), *NOTHING[1:]))
    model = Model(dictionary(good[: len(good) // 2], size), dictionary(bad[: len(bad) // 2], size), ())
    sizes = Sizes(model.good, model.bad)
    rest = [(t, 1.0) for t in good[len(good) // 2 :]] + [(t, 0.0) for t in bad[len(bad) // 2 :]]
    x = np.array([sizes.features(t) for t, _ in rest])
    model.weights = tuple(logistic(x, np.array([y for _, y in rest])))
    return model


def sample_of(docs: DataFrame, labels: DataFrame, max_docs: int, label: str) -> list[tuple[str, int]]:
    of: dict = {}
    for value in (0, 1):
        own = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        of |= dict.fromkeys((r[0] for r in own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()), value)
    if not of:
        return []
    rows = docs.where(F.col("doc_id").isin(list(of)) & F.col("text").isNotNull()).select("doc_id", "text").collect()
    return [(r[1], of[r[0]]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1]))]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, label: str = "quality") -> Model:
    return fit(sample_of(docs, labels, max_docs, label))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        w = np.array(model.weights)
        for batch in batches:
            data, offsets = c.buffer_of(c.as_text(batch.column(1)))
            x = np.array([sizes.features(memoryview(data[offsets[i] : offsets[i + 1]])) if offsets[i + 1] > offsets[i] else NOTHING for i in range(len(batch))]).reshape(-1, len(NOTHING))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
