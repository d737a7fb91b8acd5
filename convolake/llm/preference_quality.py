"""Quality scores from preference pairs (operator 3).

Bradley-Terry: a text with label 1 is preferred to one with label 0, and the
probability of a preference is the logistic function of the difference of two
scores, which are linear in the texts' features.  The weights minimise the
logistic loss on feature differences of pairs, with a small ridge.  The score
quantile at the share of 0 labels becomes the threshold; a text's final score
is the logistic function of its distance from it, so 0.5 is the threshold.

Features describe the whole text only: character classes, word shapes,
repetition, lines.  Labels, ids, language and source never enter.

The fit uses every labelled row outside the held-out fold and every pair of a
row with label 1 and one with label 0.  Pairs are never built: the loss of a
row depends on its score and on how the scores of the other label are spread.
Each Newton step counts the scores in bins (``BINS`` at most), with the first
powers of the distances from the bins' centres, which gives the slope at every
score to about 1e-9; then one pass sums it over the rows.  Only the curvature
takes all scores of a wider bin as equal, which changes the steps and not where
they end.  Tasks hold sums of bounded size, the driver the sums of all.

Defined results: null text counts as empty and gets the score of its features
like any text; labels other than 0 and 1, null ids and ids with both labels
are left out of the fit; a fit without rows of both labels keeps everything
(score 1); repeated rows each get their result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convolake.llm.common import crc_bucket, discard, staged, text_bytes
from convolake.session import small_batches

RIDGE = 1e-4
#: scores are counted in this many bins at most, no narrower than ``WIDTH``; the curvature has ``CURVE_BINS`` at most, no narrower than 8 of these
BINS, WIDTH, CURVE_BINS = 1 << 16, 1 / 64, 1024
FOLDS, HELD_FOLD = 3, 1

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
N_FEATURES = 16 + len(_PUNCTUATION)


def features(text: bytes) -> np.ndarray:
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    lower, upper, digits, high = int(count[97:123].sum()), int(count[65:91].sum()), int(count[48:58].sum()), int(count[128:].sum())
    distinct = len(set(words))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    capitals = sum(map(bytes.isupper, words))
    bare = sum(map(bytes.isalpha, words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    head = [
        math.log1p(len(words)), math.log1p(chars / n), upper / max(1, upper + lower), digits / chars, high / chars,
        int(count[32]) / chars, distinct / n, math.log(max(1, distinct)) / math.log(n + 1), repeats / n, capitals / n, bare / n,
        math.log1p(int(lengths.max())), float(lengths.std()) / 10, len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))), math.log1p(int(count[:9].sum() + count[14:32].sum() + count[127])),
    ]
    return np.array([*head, *(math.log1p(20 * int(count[c]) / n) for c in _PUNCTUATION)])


class PairwiseModel:
    """Linear scores: centre and spread of the features, weights, threshold."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, threshold: float):
        self.mean, self.spread, self.weights, self.threshold = mean, spread, weights, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _matrix(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), dtype="<f4").astype(np.float64).reshape(-1, N_FEATURES)


def _summed(rows: DataFrame, of) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows: ``of(features, labels)`` gives places and numbers
    for some rows; returns the places that occur, in order, and their sums."""

    def run(batches):
        at, sums = np.empty(0, dtype=np.int64), np.empty(0)
        for batch in batches:
            i, v = of(_matrix(batch.column("x")), batch.column("label").to_numpy())
            at, back = np.unique(np.concatenate([at, i]), return_inverse=True)
            sums = np.bincount(back, weights=np.concatenate([sums, v]), minlength=len(at))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums, pa.float64())], ["i", "v"])

    got = rows.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    i, v = (got.column(c).to_numpy() for c in ("i", "v"))
    order = np.argsort(i)
    return i[order], v[order]


def _dense(rows: DataFrame, of) -> np.ndarray:
    """Sums over all rows of the vectors ``of(features, labels)``."""

    def each(x, label):
        v = of(x, label)
        return np.arange(len(v)), v

    return _summed(rows, each)[1]


def _slopes(x: np.ndarray) -> list[np.ndarray]:
    """The logistic function and its first three derivatives."""
    p = 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    q = p * (1 - p)
    return [p, q, q * (1 - 2 * p), q * (1 - 6 * q)]


def _against(powers: np.ndarray, step: float, sign: int) -> np.ndarray:
    """Value and three derivatives, at the bins' centres, of the sum of
    logistic(sign * (s - t)) over the scores t with these ``powers`` (per bin:
    number, sums of the distances from the centre, of their squares, cubes)."""
    k = powers.shape[1]
    slopes = _slopes(sign * np.arange(1 - k, k) * step)
    size = 1 << (3 * k).bit_length()
    kernels = np.fft.rfft(np.array(slopes), size)
    spread = np.fft.rfft(powers / np.array([1, 1, 2, 6])[:, None], size)
    # the derivative number m by s, at a distance d of t from its centre: sum of sign^(m + l) (-d)^l / l! slope number m + l
    sums = [sum((-1) ** n * sign ** (m + n) * kernels[m + n] * spread[n] for n in range(4 - m)) for m in range(4)]
    return np.fft.irfft(np.array(sums), size)[:, k - 1:2 * k - 1]


def _newton_step(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The Newton step of the mean loss over all pairs, with its ridge."""
    scaled = lambda x: np.clip((x - mean) / spread, -8, 8)
    step = max(WIDTH, 16 * float(np.abs(w).sum()) / BINS)

    def count(x, label):
        s = scaled(x) @ w
        bins = np.rint(s / step).astype(np.int64)
        off = s - bins * step
        return np.concatenate([(bins * 2 + label) * 4 + n for n in range(4)]), np.concatenate([off ** n for n in range(4)])

    at, sums = _summed(rows, count)
    bins = at >> 3
    first = int(bins[0])
    wider = max(8, -(-(int(bins[-1]) - first + 1) // CURVE_BINS))
    k = (int(bins[-1]) - first) // wider * wider + wider
    powers = np.zeros((2, 4, k))  # by label
    powers[at >> 2 & 1, at & 3, bins - first] = sums
    pairs = float(powers[0, 0].sum() * powers[1, 0].sum())
    slope = _against(powers[1], step, 1), _against(powers[0], step, -1)  # each label's chance to be on the wrong side, over all of the other
    many = powers[:, 0].reshape(2, -1, wider).sum(axis=2)
    centres = np.arange(many.shape[1]) * wider * step
    weight = _slopes(centres[:, None] - centres[None, :])[1]  # of a pair, by their wider bins
    curved = np.array([weight @ many[1], weight @ many[0]])

    def gather(x, label):
        z = scaled(x)
        s = z @ w
        bins = np.rint(s / step).astype(np.int64)
        off, bins = s - bins * step, np.clip(bins - first, 0, k - 1)
        chance = sum(np.where(label == 1, slope[1][n][bins], slope[0][n][bins]) * off ** n / (1, 1, 2, 6)[n] for n in range(4))
        down = ((2 * label - 1) * chance) @ z
        wide = bins // wider
        bent = (z * curved[label, wide][:, None]).T @ z
        group = wide * 2 + label
        order = np.argsort(group, kind="stable")
        group, starts = np.unique(group[order], return_index=True)
        totals = np.add.reduceat(z[order], starts, axis=0) if len(order) else z
        head = N_FEATURES + N_FEATURES ** 2
        places = head + group[:, None] * N_FEATURES + np.arange(N_FEATURES)
        return np.concatenate([np.arange(head), places.ravel()]), np.concatenate([down, bent.ravel(), totals.ravel()])

    at, sums = _summed(rows, gather)
    head = N_FEATURES + N_FEATURES ** 2
    totals = np.zeros((many.shape[1], 2, N_FEATURES))
    totals.reshape(-1)[at[head:] - head] = sums[head:]
    cross = totals[:, 1].T @ weight @ totals[:, 0]
    curve = (sums[N_FEATURES:head].reshape(N_FEATURES, N_FEATURES) - cross - cross.T) / pairs + RIDGE * np.eye(N_FEATURES)
    return np.linalg.solve(curve, sums[:N_FEATURES] / pairs - RIDGE * w)


def _threshold(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray, below: int) -> float:
    """The middle of the widest gap between scores, 3 % of ``below`` about that rank."""

    def run(batches):
        for batch in batches:
            s = np.clip((_matrix(batch.column("x")) - mean) / spread, -8, 8) @ w
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64())], ["s"])

    step = max(WIDTH, 16 * float(np.abs(w).sum()) / BINS)
    scores = rows.mapInArrow(run, "s double").withColumn("bin", F.rint(F.col("s") / step).cast("bigint"))
    scores = staged(scores.groupBy("bin", "s").agg(F.count("*").alias("n")), "preference-scores")  # equal scores are one row
    bins = scores.groupBy("bin").agg(F.sum("n").alias("n"), F.max("s").alias("last")).toArrow().sort_by("bin")
    bin_, n, last = (bins.column(c).to_numpy() for c in ("bin", "n", "last"))
    before = np.cumsum(n) - n
    low = max(1, int(0.97 * below))
    high = max(low, min(int(n.sum()) - 1, math.ceil(1.03 * below) + 1))
    # the bins with the scores from rank ``low - 1`` to ``high``
    some = slice(int(np.searchsorted(before, low - 1, "right")) - 1, int(np.searchsorted(before, high, "right")))
    earlier = [None, *last.tolist()]
    known = [(int(b), int(m), x) for b, m, x in zip(bin_[some], before[some], earlier[some])]
    known = scores.sparkSession.createDataFrame(known, "bin bigint, before bigint, earlier double")
    order = Window.partitionBy("bin").orderBy("s")
    placed = scores.join(F.broadcast(known), "bin").select(
        "s", "n", F.coalesce(F.lag("s").over(order), F.col("earlier")).alias("old"),
        (F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("k"))
    gap = F.when(F.col("k").between(low, high), F.struct((F.col("s") - F.col("old")).alias("gap"), (-F.col("k")).alias("k"), ((F.col("s") + F.col("old")) / 2).alias("at")))
    inside = F.when((F.col("k") < low) & (F.col("k") + F.col("n") > low), F.col("s"))  # if all these ranks have one score
    best, same = placed.agg(F.max(gap), F.max(inside)).first()
    discard(scores)
    return float(same if best is None else best["at"])


def _featured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = [features(t).astype("<f4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["id", "x"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_bytes(text_col).alias("t")).mapInArrow(run, "id bigint, x binary")


def fit_pairs(rows: DataFrame) -> PairwiseModel | None:
    """``rows``: label, x (features as 32-bit floats), read several times."""
    sums = _dense(rows, lambda x, label: np.concatenate([[len(label), label.sum()], x.sum(axis=0)]))
    if not len(sums) or not 0 < sums[1] < sums[0]:
        return None
    n, mean = sums[0], sums[2:] / sums[0]
    spread = np.maximum(np.sqrt(_dense(rows, lambda x, _: ((x - mean) ** 2).sum(axis=0)) / n), 1e-6)
    w = np.zeros(N_FEATURES)
    for _ in range(25):  # Newton steps; the ridge makes the optimum finite
        step = _newton_step(rows, mean, spread, w)
        w += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return PairwiseModel(mean, spread, w, _threshold(rows, mean, spread, w, int(sums[0] - sums[1])))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> PairwiseModel | None:
    """Learns from labelled rows outside the held-out fold only."""
    outside = lambda df: df.where(F.col(id_col).isNotNull() & (crc_bucket(id_col, FOLDS) != HELD_FOLD))
    clean = outside(labels).where(F.col(label_col).isin(0, 1)) \
        .groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("hi")).where("label = hi")
    with small_batches(docs.sparkSession):  # features are joined, not texts
        rows = staged(_featured(outside(docs), id_col, text_col).join(clean.select("id", "label"), "id").select("label", "x"), "preference-features")
    model = fit_pairs(rows)
    discard(rows)
    return model


def score_documents(docs: DataFrame, model: PairwiseModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model is None or not texts:
                score = np.ones(len(texts))
            else:
                score = model.score(np.array([features(t) for t in texts], dtype=np.float32).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), (crc_bucket("id", FOLDS) == HELD_FOLD).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = fit(docs, labels, id_col, text_col, **options)

    @F.pandas_udf("boolean")
    def accepted(texts):
        if model is None or not len(texts):
            return texts.map(lambda _: True).astype(bool)
        x = np.array([features(bytes(t)) for t in texts], dtype=np.float32).astype(np.float64)
        return texts.__class__(model.score(x) >= 0.5, index=texts.index)

    return docs.where(accepted(text_bytes(text_col)))
