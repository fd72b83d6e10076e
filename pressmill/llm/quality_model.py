"""Quality learnt from trusted good texts and unlabelled ones.

A linear model over measures of style is fitted by the non-negative unbiased risk: with the class
prior ``p``, the risk of the positives as positives, plus what the unlabelled texts as negatives
cost beyond the share ``p`` of positives among them, which is never let below nought.  The prior
is estimated from scores that tell trusted from unlabelled texts: it is the least ratio, over
thresholds, of the unlabelled texts above to the trusted texts above.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import slices, texts_of

#: Kinds of characters: each ASCII mark and white space alone, then lower, upper, digit,
#: other lower, other upper, other letter, other.
MARKS = "\t\n\r !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KINDS = len(MARKS) + 7
#: Coarser kinds whose transitions are counted.
COARSE = 12
FEATURES = KINDS + COARSE * COARSE + 5
#: Rows drawn to fit the model, about: trusted ones, and unlabelled ones.
MOST_TRUSTED = MOST_UNLABELLED = 12_000


def kind_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point, and coarse kind of each kind."""
    n = len(MARKS)
    kinds = np.full(0x110000, n + 6, np.uint8)
    for c in range(0x80, 0x3000):
        ch = chr(c)
        if ch.isalpha():
            kinds[c] = n + 3 if ch.islower() else n + 4 if ch.isupper() else n + 5
    kinds[0x3000:0xD800] = n + 5
    for k, ch in enumerate(MARKS):
        kinds[ord(ch)] = k
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = n, n + 1, n + 2
    groups = ["\n\r", " \t", ".,;:", "!?", "#$%&*^~", "|", "<>=+{}[]\\_/", "\"'`()-@"]
    coarse = [next(g for g, chars in enumerate(groups) if ch in chars) for ch in MARKS]
    return kinds, np.array([*coarse, 8, 9, 10, 8, 9, 8, 11], np.uint8)


def features(texts: list[str], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row for each text: shares of kinds and of transitions (as square roots), and of repeats."""
    kinds, coarse = tables
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts):
        if not text:
            continue
        kind = kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        row[:KINDS] = np.bincount(kind, minlength=KINDS) / len(kind)
        group = coarse[kind].astype(np.int64)
        if len(group) > 1:
            row[KINDS : KINDS + COARSE**2] = np.bincount(group[:-1] * COARSE + group[1:], minlength=COARSE**2) / (len(group) - 1)
        words, lines = text.split(), text.split("\n")
        row[-5] = sum(map(eq, words[1:], words)) / max(len(words), 1)
        row[-4] = len(set(words)) / max(len(words), 1)
        row[-3] = len(set(lines)) / len(lines)
        row[-2] = min(len(text) / max(len(words), 1), 50) / 50
        row[-1] = np.log1p(len(text)) / 20
    out[:, :-4] = np.sqrt(out[:, :-4])  # and of words equal to the one before
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Weights after ``steps`` of the Adam method from nought."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(trusted: np.ndarray, unlabelled: np.ndarray, steps: int = 150) -> float:
    """Share of good texts among the unlabelled ones, from halves that the scorer hasn't seen."""
    p, u = trusted[::2], unlabelled[::2]

    def gradient(w):
        return -((1 - sigmoid(p @ w)) @ p) / len(p) + (sigmoid(u @ w) @ u) / len(u) + 1e-3 * w

    w = descend(gradient, p.shape[1], steps)
    a, b = np.sort(trusted[1::2] @ w)[::-1], np.sort(unlabelled[1::2] @ w)[::-1]
    if not len(a) or not len(b):
        return 0.5
    above_a = np.arange(1, len(a) + 1) / len(a)
    above_b = np.searchsorted(-b, -a, side="right") / len(b)
    slack = np.sqrt(np.log(20) / (2 * len(a))) + np.sqrt(np.log(20) / (2 * len(b)))
    enough = above_a >= 0.1
    best = np.argmin(((above_b + slack) / above_a)[enough])
    return float(np.clip((above_b / above_a)[enough][best], 0.05, 0.95))


def fitted(trusted: np.ndarray, unlabelled: np.ndarray, steps: int = 400, penalty: float = 1e-3) -> Model:
    """The model; without trusted or unlabelled rows, one that scores 0.5 everywhere."""
    if not len(trusted) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), 0.5)
    mean, scale = unlabelled.mean(axis=0), np.maximum(unlabelled.std(axis=0), 1e-3)
    p, u = (np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))].astype(np.float64) for x in (trusted, unlabelled))
    prior = estimated_prior(p, u)

    def gradient(w):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        good = -prior * ((1 - sp) @ p) / len(p)  # positives as positives
        excess = (su @ u) / len(u) - prior * (sp @ p) / len(p)  # unlabelled as negatives, less the good ones
        risk = np.logaddexp(0, np.clip(u @ w, -40, 40)).mean() - prior * np.logaddexp(0, np.clip(p @ w, -40, 40)).mean()
        step = good + excess if risk >= 0 else -excess
        return step + penalty * np.r_[w[:-1], 0]

    return Model(mean, scale, descend(gradient, p.shape[1], steps), prior)


def drawn(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of their id."""
    count = rows.count()
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < F.lit(int(most / count * (1 << 30))))


def learnt(docs: DataFrame, labels: DataFrame, most_trusted: int = MOST_TRUSTED, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit on documents with quality 1 as trusted ones and on any documents as unlabelled ones.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``quality``.  Rows drawn
    are bounded by the two parameters; only their features reach the driver.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    good = labels.where("quality = 1").select("doc_id").distinct()
    chosen = drawn(ids.join(good, "doc_id", "left_semi"), most_trusted, 1).withColumn("trusted", F.lit(True))
    chosen = chosen.unionByName(drawn(ids, most_unlabelled, 2).withColumn("trusted", F.lit(False)))
    rows = docs.select("doc_id", "text").join(chosen.distinct(), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = kind_tables()
        for batch in slices(batches, "text"):
            x = features(texts_of(batch, "text"), tables)
            yield pa.RecordBatch.from_arrays([batch.column("trusted"), pa.array([r.tobytes() for r in x], pa.binary())], ["trusted", "x"])

    drawn_rows = rows.select("trusted", "text").mapInArrow(run, "trusted boolean, x binary").toPandas()
    matrix = lambda part: np.array([np.frombuffer(x, np.float32) for x in sorted(part)], np.float32).reshape(-1, FEATURES)
    return fitted(matrix(drawn_rows.x[drawn_rows.trusted]), matrix(drawn_rows.x[~drawn_rows.trusted.astype(bool)]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    A null text is scored as an empty one.  Equal texts have equal scores.  Columns of these two
    names are replaced, all others stay as they are.
    """
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = kind_tables()
        for batch in slices(batches, "text"):
            score = model.score(features(texts_of(batch, "text"), tables)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "score double", "predicted int"])
    return kept.mapInArrow(run, schema)
