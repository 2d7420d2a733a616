from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vaultlens.llm import language_model as lm

STATES = lm.STATES


def plain_forward(model, classes):
    """Forward recursion of one text, token by token, in logarithms."""
    now, log = np.array(model.start), 0.0
    for c in classes:
        now = (now @ model.step) * model.emit[c]
        log += math.log(now.sum())
        now = now / now.sum()
    return log


def plain_expected(model, classes):
    """Expected counts of one text by the textbook, with all alphas and betas."""
    alphas, now = [np.array(model.start)], np.array(model.start)
    for c in classes:
        now = (now @ model.step) * model.emit[c]
        now = now / now.sum()
        alphas.append(now)
    start, step, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emit)
    beta = np.ones(STATES)
    for t in range(len(classes) - 1, -1, -1):
        pair = alphas[t][:, None] * model.step * (model.emit[classes[t]] * beta)[None, :]
        pair /= pair.sum()
        step += pair
        emit[classes[t]] += pair.sum(axis=0)
        if t == 0:
            start += pair.sum(axis=1)
        beta = model.step @ (model.emit[classes[t]] * beta)
        beta /= beta.sum()
    return start, step, emit


@pytest.fixture
def case():
    random_ = np.random.default_rng(4)
    lengths = np.array([1, 5, 128, 129, 700, 2, 256, 1, 40])
    classes = random_.integers(0, lm.CLASSES + 1, lengths.sum())
    return lm.Model.initial(random_.integers(0, 50, lm.CLASSES + 1).astype(float)), classes, lengths


def test_segments_give_the_plain_recursion(case):
    model, classes, lengths = case
    segments = lm.Segments(lengths)
    log, _ = lm.chained(model, *lm.transfers(model, classes, segments), segments)
    ends = np.cumsum(lengths)
    plain = [plain_forward(model, classes[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
    assert np.allclose(log, plain, rtol=1e-10)


def test_expected_counts_are_those_of_the_textbook(case):
    model, classes, lengths = case
    start, step, emit, _ = lm.expected(model, classes, lengths)
    sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(model.emit)]
    ends = np.cumsum(lengths)
    for e, n in zip(ends, lengths, strict=True):
        sums = [x + y for x, y in zip(sums, plain_expected(model, classes[e - n : e]), strict=True)]
    assert np.allclose(start, sums[0]) and np.allclose(step, sums[1]) and np.allclose(emit, sums[2])
    assert math.isclose(emit.sum(), lengths.sum())


def base_rows(rows):
    docs = [(i, (t or "").encode().lower().split() + [b"\0end"]) for i, t in rows]
    out = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    counts = Counter(w for i, d in docs if not out(i) for w in d)
    n, v = sum(counts.values()), len(counts)
    return [
        (i, out(i), len(d), sum(counts[w] > 0 for w in d), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in d), 4))
        for i, d in docs
    ]


def rounded(frame):
    return Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in frame.collect())


@pytest.mark.parametrize("block", [lm.BLOCK_TOKENS, 40])
def test_base_scores(spark, block, monkeypatch):
    pick = random.Random(9)
    rows = [(n, " ".join(f"W{pick.randrange(60)}é" for _ in range(pick.randrange(0, 30)))) for n in range(90)]
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    found = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rounds=1)
    assert rounded(found) == Counter(base_rows(rows))


def test_edge_cases(spark, edge_documents, edge_rows, no_documents):
    found = lm.score(edge_documents, rounds=1)
    assert rounded(found) == Counter(base_rows([(i, t) for i, t, _ in edge_rows]))
    assert lm.score(no_documents, rounds=1).collect() == []


def test_learns_states_that_help_on_texts_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    means = {
        n: lm.score(rows, rounds=n).filter("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
        for n in (0, 4)
    }
    assert means[4][0] > means[0][0] + 0.05
    assert means[4][0] > means[4][1] + 0.05
