"""Operator 4, a quality classifier on averaged subword embeddings.

A document is the average of learned vectors, one for each hashed word and each
hashed character n-gram (of N_GRAMS lengths, in code points) of its whole text; a
softmax over the average gives the score. The vectors are learned by stochastic
gradient descent in numpy from at most SAMPLE labelled rows, those whose
hashed id is least; their features are counted by tasks, and one task learns from the counts.
Scoring folds vectors and output weights into one number per bucket, so a text
costs one table lookup per feature.

Edge cases: null labels and labels other than 0 and 1 teach nothing; a null or
empty text scores as the bias alone; without labels of both classes every score is
the share of 1 among the labels (0.5 without any); repeated rows are scored each; a text
of any length is scored whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cavitas.llm.shared import slices, utf8

#: The most labelled rows that training looks at.
SAMPLE = 3000
BUCKET_BITS = 18
N_GRAMS = (3, 4)
DIM, EPOCHS, RATE = 8, 6, 0.5
_random = np.random.default_rng(20240101)
_LOW = _random.integers(0, 1 << 32, (max(N_GRAMS), 256), np.uint32)
_PLACE = _random.integers(0, 1 << 32, 64, np.uint32) | np.uint32(1)
_HIGH = _random.integers(0, 1 << 32, max(N_GRAMS), np.uint32) | np.uint32(1)
_MIX = np.uint32(2654435769)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _hashed(x: np.ndarray, place: int) -> np.ndarray:
    """Hashes of characters at a place of a gram."""
    found = _LOW[place][x & 255]
    return found if x.dtype == np.uint8 else found ^ (x >> 8) * _HIGH[place]


def features(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of feature its buckets and, per text, where its buckets start and end.

    x: characters of several texts, each from starts to ends and followed by a blank.
    """
    shift = np.uint32(32 - BUCKET_BITS)
    gram = _hashed(x, 0)
    for n in range(2, max(N_GRAMS) + 1):
        gram = gram[:-1] ^ _hashed(x[n - 1 :], n - 1)
        if n in N_GRAMS:
            yield (gram * _MIX) >> shift, starts, np.maximum(starts, ends - n + 1)
    blank = _BLANK[np.minimum(x, 255)]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(first):
        yield np.zeros(0, np.uint32), np.zeros(len(starts), int), np.zeros(len(starts), int)
        return
    begin = np.zeros(len(x), np.int64)
    begin[first] = np.diff(first, prepend=0)
    place = np.arange(len(x)) - np.cumsum(begin)
    part = np.where(blank, np.uint32(0), _hashed(x, 1) * _PLACE[place & 63])
    yield (np.add.reduceat(part, first, dtype=np.uint32) * _MIX) >> shift, np.searchsorted(first, starts), np.searchsorted(first, ends)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' characters, in bytes if all fit, and where each text starts and ends."""
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    joined = " ".join(texts) + " " * max(N_GRAMS)
    try:
        x = np.frombuffer(joined.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        x = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    return x, ends - [len(t) for t in texts], ends


def _characters(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty, bytes that are no UTF-8 as U+FFFD."""
    return [t.decode("utf-8", "replace") for t in utf8(column)]


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and their counts of each text, as packed 32-bit integers."""
    for batch in slices(batches, "text"):
        found = []
        for text in _characters(batch["text"]):
            each = [b[lo[0] : hi[0]] for b, lo, hi in features(*_joined([text]))]
            found.append(np.unique(np.concatenate(each), return_counts=True))
        packed = [pa.array([x[k].astype("<u4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
        yield pa.record_batch([batch["key"], *packed, batch["quality"].cast(pa.int32())], names=["key", "bucket", "n", "quality"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded model from all rows of the one task that the bounded sample goes to."""
    rows = [r for b in batches for r in zip(b["key"].to_pylist(), b["quality"].to_pylist(), b["bucket"].to_pylist(), b["n"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: r[:2])
    take = lambda k: [np.frombuffer(r[k], "<u4") for r in rows]
    weight, bias = descend(take(2), take(3), np.asarray([r[1] for r in rows], np.int64))
    yield pa.record_batch([pa.array([weight.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], names=["weight", "bias"])


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        for batch in slices(batches, "text", 1 << 19):
            x, starts, ends = _joined(_characters(batch["text"]))
            total, n = np.zeros(len(starts)), np.zeros(len(starts))
            for bucket, lo, hi in features(x, starts, ends):
                value, some = weight[bucket], hi > lo
                if some.any():
                    edges = np.stack([lo[some], hi[some]], axis=1).ravel()
                    total[some] += np.add.reduceat(np.append(value, 0.0), edges)[::2]
                n += hi - lo
            logit = total / np.maximum(n, 1) + bias
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            keys = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), pa.array(score)], names=[*keys, "score"])

    return run


def descend(buckets: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learn vectors and output weights; returns them folded: one number per bucket, and the bias."""
    share = labels.mean() if len(labels) else 0.5
    if not 0 < share < 1:
        level = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BUCKET_BITS), float(np.log(level / (1 - level)))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM))
    out, bias = np.zeros((DIM, 2)), np.log([1 - share, share])
    shares = [n / max(1, n.sum()) for n in counts]
    steps, done = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(labels)):
            rate = RATE * (1 - done / steps)
            done += 1
            mean = shares[k] @ vectors[buckets[k]]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[k]] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # a text's many small shares would hardly move; each feature takes a step scaled to the text
            vectors[buckets[k]] -= rate * (shares[k] * len(shares[k]))[:, None] * back
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The folded model from the bounded sample of labelled rows."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample rows
    found = rows.select(F.xxhash64("doc_id", "text").alias("key"), "text", "quality").mapInArrow(_histograms, "key long, bucket binary, n binary, quality int")
    model = found.repartition(1).mapInArrow(_fit, "weight binary, bias double").first()  # a bounded sample; one number per bucket comes back
    return (np.frombuffer(model["weight"], "<f8"), model["bias"]) if model else descend([], [], np.zeros(0, np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the score of every whole text."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket
    rows = docs.select(*keep, "text")
    kept = "".join(f"`{c}` {t}, " for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(_scores(share), kept + "score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of held-out rows are not learned from."""
    found = score(docs, train(docs, labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
