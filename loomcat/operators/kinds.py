"""Kinds of texts by logistic regression, with probabilities that hold.

Features are a text's distinct words and character pairs, hashed to a fixed number of dimensions, so
that a model's size doesn't grow with the corpus. Training sums gradients in the tasks. Labelled rows
are dealt to folds by a hash of their key; each fold is scored by a model of the others, and these
out-of-fold scores serve twice: to calibrate (for each kind the share of true rows as a function that
never falls with the score, found by pooling adjacent violators over `BINS` bins), and to say how
good the classifier is. What is said of a fold comes from calibration on the other folds, so no row
judges itself. A text whose best calibrated probability is below `sure` is given no kind.

Rows without a key or kind are not learned from; null and empty texts have no features and get what
the kinds' frequencies say; of kinds with equal probability the first by name counts; repeated rows
count each time they are learned from; a single kind, or none, raises ValueError.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import table
from .mining import features
from .mining import MOST_KINDS as MOST_BAYES_KINDS

#: Dimensions of the hashed features, bins of a probability for calibration and for its error, kinds.
DIMENSIONS, BINS, ERROR_BINS, MOST_KINDS = 1 << 15, 200, 10, 50
#: Models that are trained side by side.
PARALLEL = 4
#: What a text is called that no kind fits well enough.
UNDECIDED = "undecided"


def hashed(rows: DataFrame, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """rows with a vector `features`."""
    return HashingTF(numFeatures=dimensions, binary=True, inputCol="_words", outputCol="features").transform(rows.withColumn("_words", features(text))).drop("_words")


def pooled(positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For bins in order, the non-falling values nearest to positives / totals (squares weighted by
    totals): neighbours that fall are pooled until none do. Empty bins take the value to their left,
    those before the first filled one its value."""
    filled, blocks = np.flatnonzero(totals), []  # blocks: positives, total, bins
    for i in filled:
        blocks.append([float(positives[i]), float(totals[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.zeros(len(totals))
    values = np.concatenate([np.full(k, p / n) for p, n, k in blocks])
    return values[np.maximum(np.searchsorted(filled, np.arange(len(totals)), "right") - 1, 0)]


def _bin(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


@dataclass(frozen=True)
class Kinds:
    """A model of all labelled rows, its calibration (kinds by bins), and rows scored out of fold:
    key, kind (index), fold, p (array of probabilities), q (calibrated on the other folds)."""

    kinds: tuple[str, ...]
    model: LogisticRegressionModel
    calibration: tuple[tuple[float, ...], ...]
    scored: DataFrame
    sure: float

    @staticmethod
    def learn(labelled: DataFrame, folds: int = 3, sure: float = 0.5, penalty: float = 0.01, rounds: int = 30) -> Kinds:
        """labelled: key, text, kind."""
        if folds < 3 or not 0 <= sure <= 1:
            raise ValueError("three folds or more, and sure from 0 to 1")
        known = labelled.where("key IS NOT NULL AND kind IS NOT NULL")
        kinds = tuple(sorted(r[0] for r in known.select("kind").distinct().limit(MOST_KINDS + 1).collect()))
        if not 2 <= len(kinds) <= MOST_KINDS:
            raise ValueError(f"{len(kinds)} kinds: 2 to {MOST_KINDS} are possible")
        index = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1
        rows = hashed(known.select("key", "text", index.cast("double").alias("label"), F.pmod(F.xxhash64("key"), F.lit(folds)).cast("int").alias("fold")), "text").drop("text")
        rows = table(rows, "hashed")
        regression = LogisticRegression(family="multinomial", regParam=penalty, maxIter=rounds, standardization=False)

        def fit(part: DataFrame) -> LogisticRegressionModel:
            # a kind that a part lacks still has its place: labels run to the last kind in every part
            return regression.fit(part)

        # side by side, since the many short steps of one training leave most of a cluster idle
        with ThreadPoolExecutor(PARALLEL) as pool:
            model, *others = pool.map(inheritable_thread_target(rows.sparkSession)(fit), [rows, *(rows.where(F.col("fold") != k) for k in range(folds))])
        out = None
        for k in range(folds):
            held = probabilities(others[k], rows.where(F.col("fold") == k), len(kinds))
            out = held if out is None else out.union(held)
        scored = table(out.select("key", F.col("label").cast("int").alias("kind"), "fold", "p"), "out-of-fold")
        each = scored.select("fold", "kind", F.posexplode("p").alias("of", "p")).groupBy("fold", "of", _bin(F.col("p"), BINS).alias("bin"))
        counts = np.zeros((folds, len(kinds), BINS, 2))
        for r in each.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == F.col("of")).alias("yes")).collect():  # folds x kinds x BINS rows at most
            counts[r["fold"], r["of"], r["bin"]] = r["yes"], r["n"]
        maps = [[tuple(map(float, pooled(*(counts.sum(axis=0) - counts[k])[i].T))) for i in range(len(kinds))] for k in range(folds)]
        q = F.when(F.lit(False), F.array(F.lit(0.0)))
        for k in range(folds):
            q = q.when(F.col("fold") == k, calibrated(F.col("p"), maps[k]))
        whole = tuple(tuple(map(float, pooled(*counts.sum(axis=0)[i].T))) for i in range(len(kinds)))
        return Kinds(kinds, model, whole, table(scored.withColumn("q", q), "calibrated"), sure)

    def classify(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """key, kind (`undecided` if none is sure) and its calibrated probability, for each row."""
        found = probabilities(self.model, hashed(rows.select(key, text), text), len(self.kinds)).withColumn("q", calibrated(F.col("p"), self.calibration))
        return found.select(key, self._named(F.col("q")).alias("kind"), F.array_max("q").alias("probability"))

    def _named(self, q: Column) -> Column:
        best = F.element_at(F.array(*map(F.lit, self.kinds)), F.array_position(q, F.array_max(q)).cast("int"))
        return F.when(F.array_max(q) >= self.sure, best).otherwise(UNDECIDED)

    def report(self) -> DataFrame:
        """Of each kind, out of fold: rows, right (share of its rows that are given it), undecided,
        precision, calibration_error before (raw_error) and after calibration."""
        names = F.array(*map(F.lit, self.kinds))
        judged = self.scored.withColumn("said", self._named(F.col("q"))).withColumn("name", F.element_at(names, F.col("kind") + 1))
        by_kind = judged.groupBy(F.col("name").alias("kind")).agg(F.count("*").alias("rows"), F.avg((F.col("said") == F.col("name")).cast("double")).alias("right"), F.avg((F.col("said") == UNDECIDED).cast("double")).alias("undecided"))
        precision = judged.groupBy(F.col("said").alias("kind")).agg(F.avg((F.col("said") == F.col("name")).cast("double")).alias("precision"))
        errors = calibration_error(self.scored, "p", self.kinds).withColumnRenamed("error", "raw_error").join(calibration_error(self.scored, "q", self.kinds).withColumnRenamed("error", "calibration_error"), "kind")
        return by_kind.join(precision, "kind", "left").join(errors, "kind")


def probabilities(model: LogisticRegressionModel, rows: DataFrame, kinds: int) -> DataFrame:
    """rows with p; kinds after the last that the model has seen get 0."""
    p = vector_to_array("probability")
    return model.transform(rows).withColumn("p", F.concat(p, F.array_repeat(F.lit(0.0), kinds - model.numClasses))).drop("features", "rawPrediction", "probability", "prediction")


def calibrated(p: Column, maps) -> Column:
    """Each kind's probability looked up in its bins, then made to sum to 1 (as it is where all are 0)."""
    values = F.array(*(F.element_at(F.array(*map(F.lit, m)), _bin(p[i], BINS) + 1) for i, m in enumerate(maps)))
    return F.transform(F.array(values), lambda v: F.transform(v, lambda x: x / F.greatest(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), F.lit(1e-12))))[0]


def calibration_error(scored: DataFrame, column: str, kinds: tuple[str, ...]) -> DataFrame:
    """kind and error: over bins of its probability, how far the share of true rows is from the mean
    probability, weighted by rows."""
    each = scored.select("kind", F.posexplode(column).alias("of", "p")).groupBy("of", _bin(F.col("p"), ERROR_BINS).alias("bin"))
    gaps = each.agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg((F.col("kind") == F.col("of")).cast("double"))).alias("gap"))
    return gaps.groupBy(F.element_at(F.array(*map(F.lit, kinds)), F.col("of") + 1).alias("kind")).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("error"))


def naive_bayes_out_of_fold(labelled: DataFrame, folds: int = 3, smooth: float = 1.0) -> DataFrame:
    """kind and bayes_right: the share of a kind's rows that naive Bayes models of the other folds give it
    (as mining.Classifier learns them). Features are found once: a fold's model has the counts of all
    rows but the fold's own, so one table of counts by fold serves all models."""
    known = labelled.where("key IS NOT NULL AND kind IS NOT NULL")
    rows = table(known.select("kind", F.pmod(F.xxhash64("key"), F.lit(folds)).cast("int").alias("fold"), features("text").alias("f"), F.monotonically_increasing_id().alias("id")), "features")
    sizes = rows.groupBy("kind", "fold").agg(F.count("*").alias("n")).limit(folds * MOST_BAYES_KINDS + 1).collect()
    names = sorted({r["kind"] for r in sizes})
    others = [[sum(r["n"] for r in sizes if r["kind"] == x and r["fold"] != k) for x in names] for k in range(folds)]
    if len(names) > MOST_BAYES_KINDS or not all(map(any, others)):
        raise ValueError(f"{len(names)} kinds: 1 to {MOST_BAYES_KINDS} are possible, in each {folds - 1} folds")
    each, count = range(len(names)), lambda i, k: f"n{i}_{k}"
    tally = lambda i, k: F.count_if((F.col("kind") == names[i]) & (F.col("fold") != k)).alias(count(i, k))
    grid = table(rows.select("kind", "fold", F.explode("f").alias("feature")).groupBy("feature").agg(*(tally(i, k) for k in range(folds) for i in each)), "feature-counts")
    seen = lambda k: F.greatest(F.lit(0), *(F.col(count(i, k)) for i in each)) > 0
    sums = grid.agg(*(F.count_if(seen(k)).alias(f"size{k}") for k in range(folds)), *(F.sum(count(i, k)).alias(count(i, k)) for k in range(folds) for i in each)).first()

    def by_fold(value) -> Column:
        out = F.when(F.col("fold") == 0, value(0))
        for k in range(1, folds):
            out = out.when(F.col("fold") == k, value(k))
        return out

    weight = lambda i, k: F.when(seen(k), F.log((F.col(count(i, k)) + smooth) / F.lit((sums[count(i, k)] or 0) + smooth * max(1, sums[f"size{k}"]))))
    prior = lambda i, k: F.lit(float(np.log(others[k][i] / sum(others[k]))) if others[k][i] else float("-inf"))
    met = rows.select("id", "fold", F.explode("f").alias("feature")).join(grid, "feature")
    scored = met.groupBy("id").agg(*(F.sum(by_fold(lambda k, i=i: weight(i, k))).alias(f"w{i}") for i in each))
    judged = rows.select("id", "kind", "fold").join(scored, "id", "left")
    scores = F.array(*(F.coalesce(f"w{i}", F.lit(0.0)) + by_fold(lambda k, i=i: prior(i, k)) for i in each))
    judged = judged.select("kind", scores.alias("s")).select("kind", F.element_at(F.array(*map(F.lit, names)), F.array_position("s", F.array_max("s")).cast("int")).alias("said"))
    return judged.groupBy("kind").agg(F.avg((F.col("said") == F.col("kind")).cast("double")).alias("bayes_right"))
