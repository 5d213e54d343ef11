import numpy as np
import pytest
from conftest import DATA, rows

from snapmill.operators import gradient
from snapmill.plans import metrics

R = np.random.default_rng(5)
X = R.normal(size=(200, 6))
BETA = np.array([3.0, -2.0, 0.0, 0.0, 1.0, 0.0])
Y = X @ BETA + R.normal(scale=0.3, size=200)


def test_ridge():
    assert np.allclose(gradient.ridge(X, Y, 7.0), np.linalg.solve(X.T @ X + 7 * np.eye(6), X.T @ Y))
    assert np.allclose(gradient.ridge(np.zeros((9, 2)), np.ones(9), 0.0), 0)


def test_elastic_net_meets_its_conditions():
    """At the solution the gradient of the penalised loss is zero, or within the penalty for zero coefficients."""
    penalty, mix, n = 0.4, 0.5, len(Y)
    b = gradient.elastic_net(X, Y, penalty, mix, 5000, 1e-12)
    slope = X.T @ (Y - X @ b) / n - penalty * (1 - mix) * b
    assert np.allclose(slope[b != 0], penalty * mix * np.sign(b[b != 0]), atol=1e-9)
    assert (np.abs(slope[b == 0]) <= penalty * mix + 1e-9).all() and (b == 0).any()


def test_huber_resists_outliers():
    y = Y.copy()
    y[:10] += 500
    plain, robust = gradient.ridge(X, y, 1e-6), gradient.huber(X, y, 1e-6, 100, 1e-9)
    assert np.abs(robust - BETA).max() < 0.5 * np.abs(plain - BETA).max()


def test_quantile():
    x = np.ones((500, 1))
    y = np.arange(500.0)
    assert gradient.quantile(x, y, 0.95, 0.0, 200, 1e-9)[0] == pytest.approx(475, abs=3)


def test_inflation():
    x = np.column_stack((X, X[:, 0] + X[:, 1] + R.normal(scale=0.01, size=200)))
    got = gradient.inflation(x)
    for j in range(x.shape[1]):
        rest = np.delete(x - x.mean(0), j, 1)
        y = (x - x.mean(0))[:, j]
        r2 = 1 - ((y - rest @ np.linalg.lstsq(rest, y, rcond=None)[0]) ** 2).sum() / (y**2).sum()
        assert got[j] == pytest.approx(1 / (1 - r2), rel=1e-2)
    assert (gradient.inflation(x[:, :1]) == 1).all() and (gradient.inflation(x[:3]) == 1).all()


def test_settings_are_checked():
    with pytest.raises(ValueError):
        gradient.Settings(ridge=-1)


def test_agreement(spark):
    coefficients = [(1, 1, m, n, 1.0, 2.0, 3.0, k + 1) for n, models in {"all": gradient.MODELS, "tail": ("quantile95",), "steady": ("ridge", "huber"), "sparse": ("elastic_net",), "odd": ("ridge",)}.items() for k, m in enumerate(models)]
    df = spark.createDataFrame(coefficients, "db_id bigint, instance_num bigint, model string, name string, coefficient double, active double, peak double, rank int")
    got = {r.name: (r.label, r.priority, r.impact) for r in gradient.agreement(df).collect()}
    assert got == {"all": ("CONFIRMED_BOTTLENECK", 0, 8.0), "tail": ("TAIL_RISK", 4, 2.0), "steady": ("STABLE_CONTRIBUTOR", 3, 4.0), "sparse": ("SPARSE_DOMINANT", 6, 2.0), "odd": ("OUTLIER_DRIVEN", 5, 2.0)}


def test_fit_over_tables(spark):
    """What the tables' models are for one instance equals numpy on its own matrix."""
    moved = metrics.moved(spark, f"{DATA}/sf0.001").cache()
    one = moved.select("db_id", "instance_num").distinct().orderBy("db_id", "instance_num").first()
    frame = moved.where((moved.db_id == one[0]) & (moved.instance_num == one[1])).toPandas()
    x = frame.pivot(index="snap_id", columns="name", values="z").fillna(0)
    y = frame.groupby("snap_id").target.first().loc[x.index].to_numpy()
    fitted = gradient.fit(moved).where(f"db_id = {one[0]} and instance_num = {one[1]}").toPandas().set_index("name")
    assert np.allclose(fitted.ridge[x.columns], gradient.ridge(x.to_numpy(), y, 50.0))
    assert gradient.fit(moved.limit(0)).count() == 0
    assert rows(gradient.groups(moved.limit(0), gradient.fit(moved.limit(0)))) == []
    moved.unpersist()
