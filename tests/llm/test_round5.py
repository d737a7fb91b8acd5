"""Operators do their whole work."""

import numpy as np
from pyspark.sql import functions as F

from convolake.llm import line_set_dedup
from convolake.llm import preference_quality as PQ


def _all_pairs(good, bad):
    """Newton steps over all pairs, and the threshold, in plain numpy."""
    every = np.concatenate([good, bad])
    mean, spread = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-6)
    g, b = (np.clip((x - mean) / spread, -8, 8) for x in (good, bad))
    d = (g[:, None, :] - b[None, :, :]).reshape(-1, g.shape[1])
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + PQ.RIDGE * np.eye(len(w))
        w += np.linalg.solve(curve, d.T @ p / len(d) - PQ.RIDGE * w)
    s = np.sort(np.concatenate([g @ w, b @ w]))
    low, high = int(0.97 * len(b)), int(np.ceil(1.03 * len(b))) + 1
    k = max(range(low, high + 1), key=lambda i: s[i] - s[i - 1])
    return mean, spread, w, (s[k - 1] + s[k]) / 2


def test_fit_takes_every_pair(spark):
    """Before, 60,000 of the 97,200 pairs were drawn."""
    rng = np.random.default_rng(3)
    good, bad = (rng.normal(m, 1, (n, PQ.N_FEATURES)).astype(np.float32) for m, n in ((0.15, 270), (0, 360)))
    rows = [(1, x.tobytes()) for x in good] + [(0, x.tobytes()) for x in bad]
    model = PQ.fit_pairs(spark.createDataFrame(rows, "label int, x binary").repartition(3))
    mean, spread, w, threshold = _all_pairs(good.astype(np.float64), bad.astype(np.float64))
    assert np.allclose(model.mean, mean) and np.allclose(model.spread, spread)
    assert np.abs(model.weights - w).max() < 1e-5 * np.abs(w).max()
    assert abs(model.threshold - threshold) < 1e-4


def test_fit_takes_every_labelled_row(spark):
    """Before, 20,000 labelled rows were taken."""
    docs = spark.range(33_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("some words "), F.col("id"))).otherwise(F.concat(F.lit("!! ?? "), F.col("id"))).alias("text"))
    labels = docs.select("doc_id", (F.pmod("doc_id", F.lit(2)) == 0).cast("int").alias("quality"))
    outside = docs.where(PQ.crc_bucket("doc_id", PQ.FOLDS) != PQ.HELD_FOLD)
    texts = [r.text.encode() for r in outside.select("text").collect()]
    assert len(texts) > 21_000
    model = PQ.fit(docs, labels)
    every = np.array([PQ.features(t) for t in texts], dtype=np.float32).astype(np.float64)
    assert np.abs(model.mean - every.mean(axis=0)).max() < 1e-9
    got = PQ.score_documents(docs, model).join(labels, "doc_id")
    assert got.where(F.col("predicted") != F.col("quality")).count() == 0


def test_fit_of_equal_scores(spark):
    x = np.ones(PQ.N_FEATURES, dtype=np.float32).tobytes()
    model = PQ.fit_pairs(spark.createDataFrame([(k % 2, x) for k in range(10)], "label int, x binary"))
    assert model.threshold == 0 and model.score(np.ones((1, PQ.N_FEATURES))).tolist() == [0.5]
    assert PQ.fit_pairs(spark.createDataFrame([(1, x)], "label int, x binary")) is None


def test_unrelated_long_lines_are_told_apart_where_their_postings_meet(spark, monkeypatch):
    """Before, all pairs of long lines with a rare token in common were written."""
    rng = np.random.default_rng(5)
    lines = [[f"p{min(a, b)}-{max(a, b)}" for b in range(30) if b != a] + [f"w{x}" for x in rng.choice(600, 120, replace=False)] for a in range(30)]
    lines.append([*lines[7][:140], *(f"new{x}" for x in range(10))])
    rows = [(k, " ".join(x)) for k, x in enumerate(lines)]
    met, staged = [], line_set_dedup.staged

    def counted(df, name, *rest):
        out = staged(df, name, *rest)
        if name in ("line-pairs", "close-pairs"):
            met.append(out.count())
        return out

    monkeypatch.setattr(line_set_dedup, "staged", counted)
    got = line_set_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.doc_id for r in got if r.n_removed] == [30]
    assert max(met) <= 2
