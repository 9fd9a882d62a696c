"""A byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are covered by overlapping chunks.  Learned filters, each a weight for every byte at
every offset of a short window, slide over all chunks; each filter's largest response in a chunk is kept,
and a document's mean and maximum over its chunks go through a logistic unit to one probability.

The model is fitted by Adam on a bounded sample of labelled documents: those SAMPLE label rows with a document,
outside the held-out quarter, that come first by a hash of doc_id.  Fitting takes each sampled text whole, long
ones a few chunks at a time.  Scoring covers every document and every byte of it.

Defined results: a null or empty text is one chunk of padding and gets its own score; null doc_ids are
scored and count as not held out; repeated rows are scored alike; labels that are null, not 0 or 1, or
without a document are ignored; where the sample lacks one of the two labels, every score is 1 (nothing is
rejected for want of evidence); a sampled doc_id of several texts is fitted on the smallest of them, and one that
is labelled both 0 and 1 once with each label.  Other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_of, with_small_batches

SAMPLE = 2000
CHUNK, STEP, WIDTH, FILTERS = 256, 192, 6, 24
EPOCHS, GROUP, RATE, DECAY = 8, 32, 0.01, 1e-4
THRESHOLD = 0.7
FOLD, HELD_OUT = 4, 2
_ROWS = 64


@dataclass
class Model:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # of the means, then of the maxima
    offset: float


def chunks(text: str) -> np.ndarray:
    """Rows of CHUNK + WIDTH - 1 bytes, one every STEP bytes, that cover the text; zeros after its end."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-max(0, len(raw) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK + WIDTH - 1, np.uint8)
    padded[: min(len(raw), len(padded))] = raw[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::STEP]


def _responses(model: Model, rows: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(model.bias, (len(rows), CHUNK, FILTERS)).copy()
    for k in range(WIDTH):
        out += model.filters[k].take(rows[:, k : k + CHUNK], axis=0)
    return out


def _pooled(model: Model, rows: np.ndarray) -> np.ndarray:
    """Each chunk's largest response of each filter, not under 0."""
    parts = [_responses(model, rows[a : a + _ROWS]).max(axis=1) for a in range(0, len(rows), _ROWS)]
    return np.maximum(np.concatenate(parts), 0)


def _summary(pooled: np.ndarray) -> np.ndarray:
    return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)])


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def score_text(model: Model, text: str) -> float:
    return _sigmoid(_summary(_pooled(model, chunks(text))) @ model.weights + model.offset)


def fit(sample: list[tuple[str, int]], seed: int = 7) -> Model | None:
    """None if the sample lacks one of the labels."""
    labels = np.array([y for _, y in sample], np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    model = Model(
        (0.3 * rng.standard_normal((WIDTH, 256, FILTERS))).astype(np.float32), np.zeros(FILTERS, np.float32),
        (0.1 * rng.standard_normal(2 * FILTERS)).astype(np.float32), float(np.log(labels.mean() / (1 - labels.mean()))),
    )
    rows = [chunks(text) for text, _ in sample]
    state = [np.zeros((2, *np.shape(x)), np.float32) for x in (model.filters, model.bias, model.weights, 0.0)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(sample))
        for at in range(0, len(order), GROUP):
            grads = [np.zeros_like(model.filters), np.zeros_like(model.bias), np.zeros_like(model.weights), np.float32(0)]
            group = order[at : at + GROUP]
            for d in group:
                _add_gradient(model, rows[d], labels[d], grads, len(group))
            step += 1
            _adam(model, grads, state, step)
    return model


def _add_gradient(model: Model, rows: np.ndarray, label: float, grads: list, n: int) -> None:
    best, value = [], []
    for a in range(0, len(rows), _ROWS):
        out = _responses(model, rows[a : a + _ROWS])
        best.append(out.argmax(axis=1))
        value.append(out.max(axis=1))
    place, pooled = np.concatenate(best), np.maximum(np.concatenate(value), 0)
    summary = _summary(pooled)
    slope = (_sigmoid(summary @ model.weights + model.offset) - label) / n
    grads[2] += slope * summary
    grads[3] += slope
    back = np.broadcast_to(slope * model.weights[:FILTERS] / len(rows), pooled.shape).copy()
    back[pooled.argmax(axis=0), np.arange(FILTERS)] += slope * model.weights[FILTERS:]
    chunk, which = np.nonzero((pooled > 0) & (np.abs(back) > 1e-9))
    flow, start = back[chunk, which], place[chunk, which]
    np.add.at(grads[1], which, flow)
    for k in range(WIDTH):
        np.add.at(grads[0][k], (rows[chunk, start + k], which), flow)


def _adam(model: Model, grads: list, state: list, step: int) -> None:
    for name, grad, s in zip(("filters", "bias", "weights", "offset"), grads, state):
        value = getattr(model, name)
        s[0] = 0.9 * s[0] + 0.1 * grad
        s[1] = 0.999 * s[1] + 0.001 * grad**2
        move = RATE * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
        setattr(model, name, value - move - RATE * DECAY * value)


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD


def sample_of(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded training sample: SAMPLE label rows that have a document, and one text of each.

    Label rows that repeat count once.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.filter("doc_id is not null and quality in (0, 1)").filter(fold() != HELD_OUT).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    # A doc_id may be many rows of the documents: one text of each comes to the driver.
    got = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.quality) for r in sorted(got, key=lambda r: (r.doc_id, r.text, r.quality))]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(sample_of(docs, labels))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [1.0 if model is None else score_text(model, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], schema=kinds)

    return with_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))).mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, and predicted (1 from THRESHOLD on)."""
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            good = [model is None or score_text(model, t.as_py() or "") >= THRESHOLD for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return with_small_batches(docs).mapInArrow(kept, docs.schema)
