"""Components, fits and centers that grow, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patquarry.operators import online
from patquarry.streaming import growing, incremental


def vectors(n, d, seed=1, groups=5):
    r = np.random.default_rng(seed)
    return r.normal(size=(groups, d))[r.integers(0, groups, n)] * 4 + r.normal(size=(n, d)) * np.linspace(2, 0.1, d) + 50


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "patent_id long, vector array<double>")


def angle(a, b):
    """The cosine of the largest angle between two subspaces."""
    return np.linalg.svd(a @ b.T)[1].min()


def test_components_equal_a_full_decomposition(spark):
    x = vectors(700, 24)
    rows = frame(spark, x).repartition(5).unionByName(spark.createDataFrame([(-1, None)], "patent_id long, vector array<double>"))
    state = online.moments(rows, "vector")
    got = online.components(state, 6)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert state.count() == 1 and np.allclose(got.mean, x.mean(0)) and np.allclose(np.abs((got.rows * v[:6]).sum(1)), 1)
    assert np.allclose(got.explained, s[:6] ** 2 / (s**2).sum())
    out = {r.patent_id: r.reduced for r in got.project(rows, "vector").collect()}
    assert out[-1] is None and np.allclose([out[i] for i in range(len(x))], (x - x.mean(0)) @ got.rows.T)
    assert len(online.components(online.moments(frame(spark, x[:7]), "vector")).rows) == 7  # no more than there are vectors
    assert len(online.components(state).rows) == 24
    with pytest.raises(ValueError, match="no vectors"):
        online.components(online.moments(rows.where("vector is null"), "vector"))


def test_components_grow_by_batches(spark):
    """Moments of parts, one after another, give the components of all rows, whatever the batches."""
    x = vectors(600, 16, 3)
    state = None
    for a, b in ((0, 5), (5, 400), (400, 401), (401, 600)):
        state = spark.createDataFrame(online.moments(frame(spark, x[a:b], a), "vector", state).collect(), online._STATE)
    got = online.components(state, 5)
    v = np.linalg.svd(x - x.mean(0), full_matrices=False)[2]
    assert angle(got.rows, v[:5]) > 1 - 1e-9 and state.first().n == 600


def test_all_starts_are_fitted_in_the_same_passes(spark):
    x = vectors(500, 6, 7, groups=8)
    rows = frame(spark, x).repartition(4)
    many, passes = online.kmeans(rows, "vector", [3, 8], starts=6, seed=5)
    one, _ = online.kmeans(rows, "vector", [3, 8], starts=1, seed=5)
    alone, passes_alone = online.kmeans(rows, "vector", [8], starts=6, seed=5)
    assert [f.k for f in many] == [3, 8] and all(a.inertia <= b.inertia * (1 + 1e-12) for a, b in zip(many, one, strict=True))
    assert np.allclose(alone[0].centers, many[1].centers, atol=1e-4) and passes_alone <= passes <= 31
    for fit in many:  # a fit is a fixed point: every center is the mean of its rows
        far = ((x[:, None] - fit.centers) ** 2).sum(2)
        at = far.argmin(1)
        assert fit.inertia == pytest.approx(far.min(1).sum()) and fit.sizes.tolist() == np.bincount(at, minlength=fit.k).tolist()
        assert np.allclose([x[at == i].mean(0) for i in range(fit.k)], fit.centers, atol=1e-3)
    got = online.assigned(rows, "vector", many).collect()
    for r in got:
        far = [np.sqrt(((x[r.patent_id] - f.centers) ** 2).sum(1)) for f in many]
        assert r.topics == [int(d.argmin()) for d in far] and np.allclose(r.distances, [d.min() for d in far])


def test_odd_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, None)], "patent_id long, vector array<double>")
    fit = online.kmeans(same, "vector", [3], starts=2)[0][0]
    assert fit.inertia == 0 and sorted(fit.sizes.tolist()) == [0, 0, 5]
    with pytest.raises(ValueError, match="no vectors"):
        online.kmeans(same.where("vector is null"), "vector", [2])


def plain_partial(centers, n, x):
    """The update of centers that count their rows, one batch."""
    centers, n = centers.copy(), n.copy()
    at = ((x[:, None] - centers) ** 2).sum(2).argmin(1) if len(x) else np.empty(0, int)
    for t in set(at.tolist()):
        own = x[at == t]
        centers[t] = (centers[t] * n[t] + own.sum(0)) / (n[t] + len(own))
        n[t] += len(own)
    return centers, n


def test_a_stream_moves_centers_as_numpy_does(spark, tmp_path):
    """Batches are learned once: again run ones change nothing, earlier versions stay, and rows that are there already do not count."""
    x = vectors(300, 5, 11, groups=4)
    model, arrived = str(tmp_path / "model"), str(tmp_path / "rows")
    fit = online.kmeans(frame(spark, x[:100]), "vector", [4], starts=3)[0][0]
    growing.found(spark, model, fit, frame(spark, x[:100]))
    centers, n = fit.centers, fit.sizes.astype(float)
    shown = lambda v: {r.topic: (r.center, r.n) for r in growing.centers(spark, model, v).collect()}
    for k, (a, b) in enumerate(((100, 180), (150, 260), (260, 260), (260, 300)), 1):  # the second brings rows of the first again, the third none
        frame(spark, x[a:b], a).unionByName(frame(spark, x[a : min(a + 2, b)], a)).coalesce(1).write.mode("append").parquet(arrived)
        growing.grow(incremental.stream_table(spark, arrived, frame(spark, x[:1])), model, str(tmp_path / "checkpoint")).awaitTermination()
        centers, n = plain_partial(centers, n, x[max(a, 180) if k == 2 else a : b])
        got = shown(k)
        assert all(np.allclose(got[t][0], centers[t]) and got[t][1] == n[t] for t in range(4))
    before, rows = [shown(v) for v in range(5)], sorted(map(tuple, growing.assignments(spark, model).collect()))
    assert sorted(r[0] for r in rows) == list(range(300)) and {r[3] for r in rows} == {0, 1, 2, 4}
    growing.learn(frame(spark, x[150:260], 150), 2, model)  # as after a failure between its two tables
    assert [shown(v) for v in range(5)] == before and sorted(map(tuple, growing.assignments(spark, model).collect())) == rows
    far = {i: np.sqrt(((x[i] - np.array([before[0][t][0] for t in range(4)])) ** 2).sum(1)) for i in range(100, 180)}
    assert all(r[1] == far[r[0]].argmin() and r[2] == pytest.approx(far[r[0]].min()) for r in rows if r[3] == 1)
    assert growing.assignments(spark, model, 1).agg(F.count(F.lit(1))).first()[0] == 180
