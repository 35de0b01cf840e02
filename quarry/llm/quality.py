"""Quality scores by Bradley-Terry ranking.

Pairs of a better and a worse labelled document are compared: the chance that the first wins is the logistic function
of the weighted difference of their features. The weights minimise the logistic loss over the pairs. A document's
score is its weighted features, set against a quantile of the labelled documents' scores and squashed to 0..1.

Features are rates over the whole text: marks, lengths and repeats, hashed runs of three letters and hashed words, and
whether there is any word at all; labels, language, source and id are no inputs. The model is fitted on a bounded sample
of labelled rows (SAMPLE), those with the smallest hashes of their ids. Some of the good ones also lose to what is left of
them when their letters are shuffled or drawn at random, and to an empty text, so that gibberish and emptiness count as
bad though no label marks them; a document's score is the lesser of both rankings.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import fresh, table

#: Labelled rows in the fit at most, and pairs drawn from them.
SAMPLE = 20_000
PAIRS = 40_000
#: Pairs that are compared at once, and one of so many good rows that is spoiled.
CHUNK, SPOILED = 8_000, 4

#: Characters by the feature that counts them (fixed values).
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!", "#$%&*^~", "|", "0123456789", ".", ",;:", "=<>{}[]()/\\_\"'`@+")
_CLASS_OF = np.zeros((256, len(CLASSES)), "float64")
for _k, _chars in enumerate(CLASSES):
    for _c in _chars:
        _CLASS_OF[ord(_c), _k] = 1
#: Places of hashed runs of letters and of hashed words.
RUNS, WORDS = 128, 128
N_FEATURES = len(CLASSES) + 9 + RUNS + WORDS
_LOWER = np.arange(256, dtype="int64")
_LOWER[ord("A") : ord("Z") + 1] += 32
#: All but letters, of any script, stand for one border (fixed values).
_LOWER[[c for c in range(128) if not chr(c).isalpha()]] = 32
#: Factors of a word's bytes by their place in it, from the 32nd on again.
_FACTORS = np.array([pow(31, k + 1, 1_000_003) for k in range(32)])


def hashed(raw: np.ndarray) -> np.ndarray:
    """Roots of the shares of hashed runs of three bytes, letters in lower case and borders, and of hashed words."""
    low = _LOWER[raw]
    runs = np.bincount((low[:-2] * 961 + low[1:-1] * 31 + low[2:]) * 40_503 % 65_521 % RUNS, minlength=RUNS) if len(low) > 2 else np.zeros(RUNS)
    inside = low != 32
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1]))
    if not len(starts):
        return np.zeros(RUNS + WORDS)
    place = np.arange(len(low)) - starts[np.clip(np.searchsorted(starts, np.arange(len(low)), "right") - 1, 0, None)]
    sums = np.add.reduceat(np.where(inside, low * _FACTORS[place % 32], 0), starts)
    words = np.bincount(sums * 40_503 % 65_521 % WORDS, minlength=WORDS)
    return np.sqrt(np.concatenate([runs / max(1, runs.sum()), words / words.sum()]))


def features(text: str) -> np.ndarray:
    """Rates over the whole text; zeros but for the last where it has no words."""
    raw = np.frombuffer(text.encode(), "uint8")
    words = text.split()
    n = len(words)
    if not n:
        return np.append(np.zeros(N_FEATURES - 1), 1.0)
    counts = np.bincount(raw, minlength=256)
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words))
    marks = np.sqrt(counts @ _CLASS_OF / n)
    rest = (
        np.log1p(n),
        np.log1p(distinct),
        distinct / n,
        sum(map(len, words)) / n,
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.sqrt(counts[10] / n),
        counts[128:].sum() / len(raw),
        # Words that repeat the one before.
        sum(a == b for a, b in zip(words, words[1:])) / n,
    )
    return np.concatenate([np.minimum(marks, 3), rest, hashed(raw), [0.0]])


def spoiled(text: str) -> str:
    """The text with its letters shuffled, or each drawn at random, as its checksum has it; all else stays."""
    seed = zlib.crc32(text.encode())
    rng, letters = np.random.default_rng(seed), np.array(list(text), object)
    at = np.flatnonzero([c.isalpha() for c in text])
    letters[at] = rng.permutation(letters[at]) if seed % 2 else rng.choice(list("abcdefghijklmnopqrstuvwxyz"), len(at))
    return "".join(letters)


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 25, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of the Bradley-Terry model over the pairs (better[i], worse[i]) of rows of x, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        gradient, hessian = -ridge * w, ridge * np.eye(len(w))
        for k in range(0, len(better), CHUNK):
            d = (x[better[k : k + CHUNK]].astype("float64") - x[worse[k : k + CHUNK]]) / scale
            lose = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient += d.T @ lose / len(better)
            hessian += (d * (lose * (1 - lose))[:, None]).T @ d / len(better)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Ranking:
    """Weights of the features ``of`` that make good rows win against bad ones, and the score quantile of a score of 0.5.

    That quantile is the one with the best mean of both accuracies, of equal ones the middle; with ``most`` it loses no
    larger share of the good rows.
    """

    def __init__(self, x: np.ndarray, good: np.ndarray, bad: np.ndarray, of: np.ndarray, most: float = 1.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = x.std(0, dtype="float64")[of] + 1e-9
        self.weights = np.zeros(x.shape[1])
        self.weights[of] = fit_pairs(x[:, of], rng.choice(good, PAIRS), rng.choice(bad, PAIRS), scale=scale) / scale
        raw = x @ self.weights
        quantiles = np.quantile(raw[np.concatenate([good, bad])], np.linspace(0, 1, 1001))
        right = np.array([((raw[good] >= q).mean() + (raw[bad] < q).mean()) / 2 for q in quantiles])
        best = np.flatnonzero(right >= right.max() - 1e-12)
        self.middle = min(float(quantiles[best].mean()), float(np.quantile(raw[good], most)))
        self.slope = float(4 / (raw.std() + 1e-9))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x @ self.weights - self.middle) * self.slope, -30, 30)))


#: The share of good rows that may fall to the ranking against spoiled ones.
LOST = 0.001


class Model:
    """Two rankings of good rows: against those that labels call bad, by rates, and against spoiled ones, by all features.

    A text is as good as the worse of both has it; without any ranking all scores are 0.5.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, made: np.ndarray | None = None):
        """made marks the rows that no label stands behind."""
        made = np.zeros(len(y), bool) if made is None else made
        good, rates = np.flatnonzero(y == 1), np.arange(N_FEATURES) < N_FEATURES - 1 - RUNS - WORDS
        kinds = ((np.flatnonzero((y == 0) & ~made), rates, 1.0), (np.flatnonzero((y == 0) & made), np.ones(N_FEATURES, bool), LOST))
        self.rankings = [Ranking(x, good, bad, of, most) for bad, of, most in kinds if len(good) and len(bad)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.min([r.score(x) for r in self.rankings], 0) if self.rankings else np.full(len(x), 0.5)


def feature_rows(texts: pd.Series) -> np.ndarray:
    return np.array([features(t if isinstance(t, str) else "") for t in texts]).reshape(-1, N_FEATURES)


@F.pandas_udf(T.BinaryType())
def _features(texts: pd.Series) -> pd.Series:
    """For the fit, which takes single precision."""
    return pd.Series([x.astype("<f4").tobytes() for x in feature_rows(texts)])


@F.pandas_udf(T.BinaryType())
def _spoiled(texts: pd.Series) -> pd.Series:
    return pd.Series([x.astype("<f4").tobytes() for x in feature_rows(texts.map(lambda t: spoiled(t) if isinstance(t, str) else t))])


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model of the labelled documents in training, at most SAMPLE of them, whatever other columns docs has.

    Rows without a label or without an id are no examples; repeated rows count as often as they occur, ties in the order
    of the sample go by text. Very long texts are read whole, one at a time. Without a good row all scores are 0.5; with
    good rows only, these win against spoiled ones.
    """
    own_id, own_y = fresh(docs, "__id", "__y")
    # As many labels as the sample has, so the broadcast is bounded.
    sample = labels.filter(F.col("quality").isNotNull() & in_training(F.col("doc_id"))).select(F.col("doc_id").alias(own_id), F.col("quality").alias(own_y))
    sample = sample.orderBy(F.xxhash64(own_id), own_id, own_y).limit(SAMPLE)
    t = F.col(f"`{text}`")
    got = docs.join(F.broadcast(sample), F.col(f"`{doc_id}`") == F.col(own_id)).select(F.col(own_id).alias("id"), F.col(own_y).alias("y"), F.xxhash64(t).alias("h"), t.alias("t"))
    rows = got.select("id", "y", "h", _features("t").alias("x")).orderBy("id", "h", "y").limit(SAMPLE).toPandas()
    if rows.empty:
        return Model(np.zeros((0, N_FEATURES)), np.zeros(0))
    some = got.filter((F.col("y") == 1) & (F.pmod("h", F.lit(SPOILED)) == 0) & (F.trim("t") != ""))
    worse = some.select("id", "h", _spoiled("t").alias("x")).orderBy("id", "h").limit(SAMPLE // SPOILED).toPandas()
    return Model(*examples(list(rows["x"]), rows["y"].to_numpy(), list(worse["x"])))


def examples(x: list[bytes], y: np.ndarray, worse: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, labels and which are made, with spoiled rows, and one empty text for eight of these, where any row is good."""
    more = [*worse, *[features("").astype("<f4").tobytes()] * (1 + len(worse) // 8)] if (y == 1).any() else []
    return np.frombuffer(b"".join([*x, *more]), "<f4").reshape(-1, N_FEATURES), np.concatenate([y, np.zeros(len(more))]), np.arange(len(x) + len(more)) >= len(x)


def scorer(model: Model) -> Callable[[Column], Column]:
    """A function that gives the score column of a text column; null and empty texts have the score of no features."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_rows(texts)))

    return score


def op6_quality(spark, sf_dir):
    """Every document's score; null and empty texts are scored as texts without words, repeated rows alike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(fit(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with a score of at least 0.5; columns as given.

    Null and empty texts count as bad where any row is good; repeated rows share their score, and an empty table gives
    no rows. Without good labels all scores are 0.5, and everything stays.
    """
    (name,) = fresh(docs, "__score")
    score = scorer(fit(docs, labels))
    return docs.withColumn(name, score(F.col(f"`{text}`"))).filter(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
