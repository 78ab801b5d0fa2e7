"""Models against dense numpy on whole tables: the registered queries, and the forms for axes larger than a task."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import kernels, network, regression
from orrery.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)


def works(seed, n, width=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[: n // 10] = x[n // 10 : 2 * (n // 10)]  # some lie on each other
    return x, np.clip(5 + x[:, 0] + np.tanh(2 * x[:, 1]) + rng.normal(size=n) * 0.2, 1, 10)


def frame(spark, axes):
    rows = [(axis, i, len(y), len(y) if len(y) <= 60 else 10, i if len(y) <= 60 else i % 10, float(t), [float(v) for v in r]) for axis, (x, y) in axes.items() for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "axis string, i long, n long, folds long, fold long, value double, embedding array<double>").repartition(3)


def summed(found):
    added = found.groupBy("axis", "model").agg(F.array(*[F.sum(F.element_at("sums", k)) for k in range(1, 8)]).alias("sums"))
    return {(r.axis, r.model): np.array(r.sums) for r in added.collect()}


def kernel_by_definition(x, y, width, penalty):
    """A Gram matrix a fold, solved."""
    out = np.empty(len(y))
    folds = len(y) if len(y) <= 60 else 10
    for f in range(folds):
        test = np.arange(len(y)) % folds == f
        a, t = x[~test], y[~test]
        far = ((a[:, None] - a[None, :]) ** 2).sum(2)
        gamma = width / np.median(far[far > 0])
        alpha = np.linalg.solve(np.exp(-gamma * far) + penalty * np.eye(len(t)), t - t.mean())
        out[test] = np.exp(-gamma * ((x[test][:, None] - a[None, :]) ** 2).sum(2)) @ alpha + t.mean()
    return out


def test_kernel_by_gradients_equals_its_definition(spark):
    axes = {"a": works(1, 600), "b": works(2, 170)}
    grid = {"widths": (0.5, 2.0), "penalties": (0.3, 1.0)}
    got = summed(kernels.kernel_sums(frame(spark, axes), dense=100, block=256, **grid))
    for axis, (x, y) in axes.items():
        for w in grid["widths"]:
            for p in grid["penalties"]:
                want = kernels.error_sums(kernel_by_definition(x, y, w, p), y)
                assert np.allclose(got[axis, kernels.name(w, p)], want, rtol=1e-6, atol=1e-6)
    assert len(got) == 8


def test_dense_kernel_has_the_whole_grid(spark):
    axes = {"a": works(3, 150), "few": works(4, 12), "two": works(5, 2), "one": works(6, 1)}
    got = summed(kernels.kernel_sums(frame(spark, axes)))
    assert {a for a, _ in got} == {"a", "few", "two"} and sum(a == "a" for a, _ in got) == 16
    for axis in ("a", "few"):
        x, y = axes[axis]
        for w, p in ((0.25, 0.03), (1.0, 0.1), (2.0, 1.0)):
            assert np.allclose(got[axis, kernels.name(w, p)], kernels.error_sums(kernel_by_definition(x, y, w, p), y), rtol=1e-6)


def test_medians_are_exact(spark):
    x, y = works(7, 137)
    axes = {"a": (x, y), "same": (np.ones((130, 2)), np.ones(130))}
    blocks = kernels._blocks(frame(spark, axes), 50)
    got = kernels._medians(blocks, {"a": 10, "same": 10})
    for f in range(10):
        rest = x[np.arange(137) % 10 != f]
        far = kernels.distances(rest, rest)
        np.fill_diagonal(far, 0)
        assert np.isclose(got["a"][f], np.median(far[far > 0]), rtol=1e-12)
    assert (got["same"] == 1).all()


def test_network_by_steps_equals_one_task(spark):
    axes = {"a": works(8, 140, 3), "few": works(9, 9, 3)}
    rows = frame(spark, axes)
    for steps in (26, 50):
        whole, parts = summed(network.network_sums(rows, steps=steps)), summed(network.network_sums(rows, whole=10, steps=steps))
        assert whole.keys() == parts.keys() == {("a", "network"), ("few", "network")}
        assert all(np.allclose(whole[k], parts[k], rtol=1e-6, atol=1e-6) for k in whole)


def test_network_by_definition():
    """One fold, step by step, with the derivative of the error taken by differences."""
    x, y = works(10, 40, 2)
    test = np.arange(40) % 10 == 3
    rest = np.flatnonzero(~test)
    fit = [i for k, i in enumerate(rest) if k % 7]
    assert (network._watches(rest, 3, 10) == (np.arange(len(rest)) % 7 == 0)).all()
    w = network.starts(2, 4)[3]
    z, t = x[fit] - x[rest].mean(0), y[fit] - y[fit].mean()
    loss = lambda w: 0.5 * ((network.layers(z, w)[3][:, 0] - t) ** 2).mean()
    grads = network.gradients(z, t, w, len(fit))
    for k in range(6):
        for at in list(np.ndindex(w[k].shape))[:5]:
            up, down = ([p.copy() for p in w] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert np.isclose(grads[k][at], (loss(up) - loss(down)) / 2e-6, atol=1e-6)
    assert np.abs(network.held_out(x, y, test, 3, 200) - y[test]).mean() < np.abs(y[rest].mean() - y[test]).mean() + 0.5


# ---------------------------------------------------------------- registered queries on the whole table
@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet' where label is not null and embedding is not null order by vec_id").fetchall()
    return np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows], dtype=float)


def ridge(x, y, penalty):
    a = x - x.mean(0)
    coef = np.linalg.solve(a.T @ a + penalty * np.eye(x.shape[1]), a.T @ (y - y.mean()))
    return y.mean() - x.mean(0) @ coef, coef


def crossed(x, y, z=None):
    """Held-out guesses by penalty; z: other vectors of the rows that are guessed."""
    z, folds = x if z is None else z, len(y) if len(y) <= 60 else 10
    out = {p: np.empty(len(y)) for p in GRID}
    for f in range(folds):
        test = np.arange(len(y)) % folds == f
        for p in GRID:
            intercept, coef = ridge(x[~test], y[~test], p)
            out[p][test] = z[test] @ coef + intercept
    return out


def error(g, y):
    return np.abs(np.clip(g, 1, 10) - y).mean()


def test_ridge_query(spark, labelled):
    x, label = labelled
    got = {r.axis: r for r in QUERIES["v6_ridge_weights"](spark, SF).collect()}
    assert set(got) == {"label", "half"}
    for axis, y in (("label", label + 1), ("half", (label + 1) / 2 + 1)):
        guesses = crossed(x, y)
        best = min(GRID, key=lambda p: error(guesses[p], y))
        g, (intercept, coef) = guesses[best], ridge(x, y, best)
        slope = 1.0
        if len(y) >= 30 and np.corrcoef(g, y)[0, 1] > 0.2:
            slope = float(np.clip(y.std() / g.std(), 1.0, 2.5))
        shift = y.mean() - slope * g.mean() if slope != 1.0 else 0.0
        r = got[axis]
        assert r.penalty == best and r.trained_on == len(y) and np.allclose(r.coef, coef * slope, atol=1e-8) and np.isclose(r.intercept, intercept * slope + shift, atol=1e-8)
        assert np.isclose(r.mae_cv, error(g * slope + shift, y), atol=1e-3) and np.isclose(r.mae_fit, error((x @ coef + intercept) * slope + shift, y), atol=1e-3) and np.isclose(r.slope, slope, atol=6e-3)


def test_ablation_query(spark, labelled):
    x, label = labelled
    y, cut = label + 1, x * (np.arange(x.shape[1]) < 32)
    full, part, shifted = crossed(x, y), crossed(cut, y), crossed(x, y, cut)
    best, other = min(GRID, key=lambda p: error(full[p], y)), min(GRID, key=lambda p: error(part[p], y))
    r = QUERIES["v12_ablation"](spark, SF).first()
    assert r.works == len(y) and np.allclose([r.with_it, r.without_it, r.shifted], [error(full[best], y), error(part[other], y), error(shifted[best], y)], atol=1e-8)


def test_encoders_query(spark, labelled):
    x, label = labelled
    want = {}
    for name, z in (("whole", x), ("half", x[:, :32])):
        errors = []
        for y in (label + 1, (label + 1) / 2 + 1):
            guesses = crossed(z, y)
            g = guesses[min(GRID, key=lambda p: error(guesses[p], y))]
            slope = float(np.clip(y.std() / g.std(), 1.0, 2.5)) if np.corrcoef(g, y)[0, 1] > 0.2 else 1.0
            errors.append(error(g * slope + (y.mean() - slope * g.mean()) if slope != 1.0 else g, y))
        want[name] = np.mean(errors)
    got = {r.encoder: r for r in QUERIES["v15_encoders"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[e].mae, want[e], atol=1e-3) and got[e].axes == 2 for e in want)


def test_comparison_query_covers_the_table(spark, labelled):
    x, label = labelled
    got = {(r.axis, r.model): r for r in QUERIES["v11_model_comparison"](spark, SF).collect()}
    assert {m for _, m in got} == {"ridge", "kernel", "network", "neighbours"} and {r.works for r in got.values()} == {len(label)}
    y = label + 1
    assert np.isclose(got["label", "kernel"].mae, error(regression.kernel_predictions(x, y), y), atol=1e-6)
    assert np.isclose(got["label", "network"].mae, error(regression.network_predictions(x, y), y), atol=1e-6)
