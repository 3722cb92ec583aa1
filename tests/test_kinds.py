"""Calibrated kinds: pooling against all partitions, the regression against its optimum, reports by hand."""

import itertools
import random

import numpy as np
import pytest

from loomcat.operators import kinds
from loomcat.operators.kinds import Kinds


def all_partitions(positives, totals):
    """The best non-falling step function by trying every division into blocks."""
    n, best = len(totals), None
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            edges = [0, *cuts, n]
            values = []
            for s, t in itertools.pairwise(edges):
                values += [sum(positives[s:t]) / sum(totals[s:t])] * (t - s)
            if all(a <= b for a, b in itertools.pairwise(values)):
                loss = sum(w * (v - p / w) ** 2 for v, p, w in zip(values, positives, totals, strict=True))
                if best is None or loss < best[0] - 1e-12:
                    best = loss, values
    return best[1]


@pytest.mark.parametrize("seed", range(40))
def test_pooling_is_the_best_rising_function(seed):
    rng = random.Random(seed)
    totals = [rng.randint(1, 5) for _ in range(rng.randint(1, 8))]
    positives = [rng.randint(0, n) for n in totals]
    assert kinds.pooled(np.array(positives), np.array(totals)) == pytest.approx(all_partitions(positives, totals))


def test_pooling_of_empty_bins():
    assert kinds.pooled(np.array([0, 1, 0, 3, 0]), np.array([0, 4, 0, 4, 0])).tolist() == [0.25, 0.25, 0.25, 0.75, 0.75]
    assert kinds.pooled(np.array([0, 0]), np.array([0, 0])).tolist() == [0, 0]
    assert len(kinds.pooled(np.array([]), np.array([]))) == 0


def texts(seed, n):
    rng = random.Random(seed)
    own = {"ad": ["buy", "sale"], "ask": ["who", "how"], "say": ["good", "hard", "课程"]}
    rows = []
    for i in range(n):
        kind = rng.choice(list(own))
        words = [rng.choice(own[kind] if rng.random() < 0.3 else ["a", "b", "c", "d", *sum(own.values(), [])]) for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join(words), kind, 1.0, [0.5]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, text string, kind string, p double, features array<double>")


def optimum(x, y, k, penalty):
    """Multinomial regression with intercepts that aren't penalised, by plain gradient steps."""
    w, b, one = np.zeros((k, x.shape[1])), np.zeros(k), np.eye(k)[y]
    for _ in range(6000):
        z = x @ w.T + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.5 * ((p - one).T @ x / len(y) + penalty * w)
        b -= 0.5 * (p - one).mean(axis=0)
    return w, b


def test_out_of_fold_scores_come_from_the_other_folds(spark):
    rows = texts(1, 150)
    learned = Kinds.learn(frame(spark, rows), penalty=0.05, rounds=300)
    said = {r["key"]: r for r in learned.scored.collect()}
    assert learned.kinds == ("ad", "ask", "say") and set(said) == {r[0] for r in rows}
    vocabulary = sorted({w for r in rows for w in r[1].split()})
    feature = lambda t: [float(w in t.split()) for w in vocabulary]
    for fold in range(3):
        others = [r for r in rows if said[r[0]]["fold"] != fold]
        w, b = optimum(np.array([feature(r[1]) for r in others]), np.array([learned.kinds.index(r[2]) for r in others]), 3, 0.05)
        for r in [r for r in rows if said[r[0]]["fold"] == fold]:
            z = np.array(feature(r[1])) @ w.T + b
            assert np.exp(z - z.max()) / np.exp(z - z.max()).sum() == pytest.approx(said[r[0]]["p"], abs=0.01)


def test_report_is_what_the_rows_say(spark):
    learned = Kinds.learn(frame(spark, texts(2, 240)), sure=0.6)
    rows = learned.scored.collect()
    got = {r["kind"]: r for r in learned.report().collect()}
    name = lambda q: learned.kinds[int(np.argmax(q))] if max(q) >= 0.6 else kinds.UNDECIDED
    for i, kind in enumerate(learned.kinds):
        mine = [r for r in rows if r["kind"] == i]
        assert got[kind]["rows"] == len(mine)
        assert got[kind]["right"] == pytest.approx(np.mean([name(r["q"]) == kind for r in mine]))
        assert got[kind]["undecided"] == pytest.approx(np.mean([name(r["q"]) == kinds.UNDECIDED for r in mine]))
        for column, error in (("p", "raw_error"), ("q", "calibration_error")):
            gaps = 0.0
            for b in range(10):
                here = [r for r in rows if min(int(r[column][i] * 10), 9) == b]
                gaps += abs(sum(r[column][i] for r in here) - sum(r["kind"] == i for r in here))
            assert got[kind][error] == pytest.approx(gaps / len(rows), abs=1e-9)
    assert all(sum(r["q"]) == pytest.approx(1) or max(r["q"]) == 0 for r in rows)


def test_classifier_beats_guessing_and_meets_odd_rows(spark):
    learned = Kinds.learn(frame(spark, texts(3, 300) + [(None, "buy", "ad", 0.0, None), (5000, "buy", None, 0.0, None), (5001, None, "say", 0.0, None), (5002, "", "ad", 0.0, None), (1, "buy", "ad", 0.0, None)]))
    rows = [(-1, "buy sale sale buy"), (-2, None), (-3, ""), (-1, "buy sale"), (None, "who"), (-4, "课程 good " * 50_000)]
    got = learned.classify(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()
    assert len(got) == len(rows) and {r.kind for r in got if r.id == -1} == {"ad"} and {r.kind for r in got if r.id == -4} == {"say"}
    assert all(0 <= r.probability <= 1 for r in got)
    fresh = texts(99, 200)
    said = {r.key: r.kind for r in learned.classify(frame(spark, fresh), "key", "text").collect()}
    assert np.mean([said[r[0]] == r[2] for r in fresh]) > 0.5


def test_few_kinds_and_rare_ones(spark):
    with pytest.raises(ValueError, match="1 kinds"):
        Kinds.learn(frame(spark, [(1, "a", "x", 0.0, None), (2, "b", "x", 0.0, None)]))
    with pytest.raises(ValueError, match="three folds"):
        Kinds.learn(frame(spark, texts(1, 9)), folds=2)
    rare = Kinds.learn(frame(spark, texts(4, 60) + [(900, "odd", "zz", 0.0, None)]))
    assert {len(r["p"]) for r in rare.scored.collect()} == {4} and {r["kind"] for r in rare.report().collect()} == {"ad", "ask", "say", "zz"}


def test_naive_bayes_out_of_fold_reads_texts_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loomcat.operators.mining import Classifier

    labelled = frame(spark, texts(5, 90) + [(900, "odd buy", "zz", 0.0, None), (901, None, "ad", 0.0, None), (None, "buy", "ad", 0.0, None), (902, "buy", None, 0.0, None)])
    rows = labelled.where("key IS NOT NULL AND kind IS NOT NULL").withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(3)))
    want = {}
    for k in range(3):
        held = rows.where(F.col("fold") == k)
        said = {r.key: r.kind for r in Classifier.learn(rows.where(F.col("fold") != k)).classify(held, "key", "text").collect()}
        for r in held.collect():
            want.setdefault(r.kind, []).append(said[r.key] == r.kind)
    asked = []
    monkeypatch.setattr(kinds, "features", lambda x, own=kinds.features: asked.append(x) or own(x))
    got = {r.kind: r.bayes_right for r in kinds.naive_bayes_out_of_fold(labelled).collect()}
    assert got == pytest.approx({k: np.mean(v) for k, v in want.items()}) and asked == ["text"]
    with pytest.raises(ValueError, match="0 kinds"):
        kinds.naive_bayes_out_of_fold(labelled.limit(0))
