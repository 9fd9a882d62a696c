"""The classifier's network against plain loops, its gradient against differences, its steps against the published rule."""

import math

import numpy as np
import pytest

from tallyloom.llm import quality_cnn as Q

TEXTS = ["", "a", "short text", "wörd " * 30, "x" * (Q.CHUNK + 1), "The quick brown fox. " * 60, "\x00" * 10 + "end"]


def small_model(seed: int) -> Q.Model:
    rng = np.random.default_rng(seed)
    return Q.Model(rng.normal(0, 0.3, (Q.WIDTH, 256, Q.FILTERS)), rng.normal(0, 0.1, Q.FILTERS), rng.normal(0, 0.3, 2 * Q.FILTERS), 0.2)


def plain_score(model: Q.Model, text: str) -> float:
    raw = list(text.encode())
    n = 1
    while (n - 1) * Q.STEP + Q.CHUNK < len(raw):
        n += 1
    best = []
    for chunk in range(n):
        row = []
        for f in range(Q.FILTERS):
            top = 0.0
            for at in range(chunk * Q.STEP, chunk * Q.STEP + Q.CHUNK):
                total = model.bias[f]
                for k in range(Q.WIDTH):
                    total += model.filters[k][raw[at + k] if at + k < len(raw) else 0][f]
                top = max(top, total)
            row.append(top)
        best.append(row)
    sum_ = model.offset
    for f in range(Q.FILTERS):
        column = [row[f] for row in best]
        sum_ += model.weights[f] * sum(column) / n + model.weights[Q.FILTERS + f] * max(column)
    return 1 / (1 + math.exp(-sum_))


@pytest.mark.parametrize("text", TEXTS)
def test_score_equals_plain_loops(text):
    model = small_model(1)
    assert Q.score_text(model, text) == pytest.approx(plain_score(model, text), abs=1e-9)


def test_every_byte_of_a_text_is_in_a_chunk():
    for n in [0, 1, Q.STEP - 1, Q.STEP, Q.CHUNK - 1, Q.CHUNK, Q.CHUNK + 1, Q.CHUNK + Q.STEP, Q.CHUNK + Q.STEP + 1, 5000]:
        text = "".join(chr(33 + k % 90) for k in range(n))
        rows = Q.chunks(text)
        back = bytes(rows[0][: Q.CHUNK]) + b"".join(bytes(r[Q.CHUNK - Q.STEP : Q.CHUNK]) for r in rows[1:])
        assert back[:n] == text.encode() and not any(back[n:])


@pytest.mark.parametrize("label", [0, 1])
def test_gradient_equals_differences(label):
    model, rows = small_model(2), Q.chunks("The quick brown fox jumps. " * 25)
    grads = [np.zeros_like(model.filters), np.zeros_like(model.bias), np.zeros_like(model.weights), 0.0]
    Q._add_gradient(model, rows, label, grads, 1)

    def loss() -> float:
        p = Q._sigmoid(Q._summary(Q._pooled(model, rows)) @ model.weights + model.offset)
        return -math.log(p if label else 1 - p)

    def slope(array: np.ndarray, at: tuple) -> float:
        kept, ends = array[at], []
        for move in (1e-6, -1e-6):
            array[at] = kept + move
            ends.append(loss())
        array[at] = kept
        return (ends[0] - ends[1]) / 2e-6

    used = [tuple(int(x) for x in at) for at in np.argwhere(np.abs(grads[0]) > 1e-6)[::37]]
    assert len(used) >= 5
    for at in [*used, (0, 1, 0)]:  # byte 1 is not in the text
        assert slope(model.filters, at) == pytest.approx(grads[0][at], abs=1e-6)
    for f in range(Q.FILTERS):
        assert slope(model.bias, (f,)) == pytest.approx(grads[1][f], abs=1e-6)
    for f in range(2 * Q.FILTERS):
        assert slope(model.weights, (f,)) == pytest.approx(grads[2][f], abs=1e-6)
    model.offset += 1e-6
    high = loss()
    model.offset -= 2e-6
    assert (high - loss()) / 2e-6 == pytest.approx(grads[3], abs=1e-6)


def test_steps_follow_the_rule():
    model = small_model(3)
    want, first, second = float(model.bias[0]), 0.0, 0.0
    state = [np.zeros((2, *np.shape(x))) for x in (model.filters, model.bias, model.weights, 0.0)]
    for step in range(1, 6):
        grad = math.sin(step)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        want -= Q.RATE * (first / (1 - 0.9**step)) / (math.sqrt(second / (1 - 0.999**step)) + 1e-8) + Q.RATE * Q.DECAY * want
        grads = [np.zeros_like(model.filters), np.full_like(model.bias, grad), np.zeros_like(model.weights), 0.0]
        Q._adam(model, grads, state, step)
    assert model.bias[0] == pytest.approx(want, abs=1e-12)


def test_a_document_with_both_labels_counts_for_both(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(1, 30) for y in ((0, 1) if i == 7 else (i % 2,))] * 2, "doc_id long, quality int")
    got = Q.sample_of(docs, labels)
    folds = {r.doc_id: r.fold for r in docs.select("doc_id", Q.fold().alias("fold")).collect()}
    want = sorted((f"text {i}", y) for i in range(1, 30) if folds[i] != Q.HELD_OUT for y in ((0, 1) if i == 7 else (i % 2,)))
    assert sorted(got) == want
