"""Training sees whole texts with the features that scoring sees, and climbs the gradient."""

import itertools
import math

import numpy as np

from termweave.llm import line_labels

LONG = "word " * 150 + "end."
TEXTS = [(i, "\n".join([LONG, f"line {i} of a text with some words.", LONG, "", *[f"{i} {j} more" for j in range(90 if i % 2 else 3)]])) for i in range(1, 13)]


def labelled(spark):
    docs = spark.createDataFrame([*TEXTS, (50, None)], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(i, i % 2) for i, _ in TEXTS] + [(50, 1)], "doc_id long, quality int")


def test_features_are_those_of_whole_texts(spark):
    rows = line_labels.training_rows(*labelled(spark))
    whole = [line_labels.text_lines(t)[:2] for _, t in TEXTS]
    assert len([f for f, *_ in rows if len(f)]) >= 6
    for f, c, _ in rows:
        if len(f):
            assert any(np.array_equal(g, f) and np.array_equal(d, c) for g, d in whole)
            assert f[0][7] == f[2][7] == 1.0 and f[2][9] > 1  # long lines end with their sign, and repeat
    links = line_labels.links_of([r for r in rows if len(r[0])])
    assert sum(int(real.sum()) for _, real, *_ in links) == sum(len(f) for f, *_ in rows)
    assert math.isclose(sum((real.sum(1) * total).sum() for _, real, _, total in links), 1.0)


def test_bound_on_lines(spark, monkeypatch):
    every = line_labels.training_rows(*labelled(spark))
    monkeypatch.setattr(line_labels, "TRAIN_LINES", 120)
    some = line_labels.training_rows(*labelled(spark))
    assert 0 < sum(len(f) for f, *_ in some) <= 120 < sum(len(f) for f, *_ in every)
    assert all(any(np.array_equal(f, g) for g, *_ in every) for f, *_ in some)


def random_links(seed):
    rng = np.random.default_rng(seed)
    docs = [(rng.random((n, line_labels.N_FEATURES)), rng.integers(0, 20, n), q) for n, q in ((1, 0), (3, 1), (5, 0), (2, 1), (4, 0))]
    return line_labels.links_of(docs), rng.normal(size=(line_labels.N_FEATURES, 2)), 0.3, docs


def test_gradient_is_the_numeric_one():
    links, w, stick, _ = random_links(1)

    def value(w, stick):
        return line_labels.likelihood(links, w, stick * line_labels.STICK, 0.01)[0]

    _, gw, gt = line_labels.likelihood(links, w, stick * line_labels.STICK, 0.01)
    step = 1e-5
    for at in np.ndindex(w.shape):
        up, down = w.copy(), w.copy()
        up[at] += step
        down[at] -= step
        assert math.isclose((value(up, stick) - value(down, stick)) / (2 * step), gw[at], abs_tol=1e-6)
    assert math.isclose((value(w, stick + step) - value(w, stick - step)) / (2 * step), gt, abs_tol=1e-6)


def test_likelihood_by_all_labelings():
    links, w, stick, docs = random_links(2)
    trans = stick * line_labels.STICK
    total = 0.0
    for f, c, q in docs:
        emit = f @ w
        free, held = [], []
        for labels in itertools.product((0, 1), repeat=len(f)):
            score = sum(emit[i, x] for i, x in enumerate(labels)) + sum(trans[a, b] for a, b in zip(labels, labels[1:]))
            free.append(score)
            if all(x == q or n < line_labels.KNOWN_WORDS for x, n in zip(labels, c)):
                held.append(score)
        share = 0.5 / sum(1 for d in docs if d[2] == q) / len(f)
        total += share * (np.logaddexp.reduce(held) - np.logaddexp.reduce(free))
    assert math.isclose(line_labels.likelihood(links, w, trans, 0.0)[0], total, abs_tol=1e-6)
