"""Which names move a target: four penalised regressions of differences, collinearity, and their agreement.

Spark makes the differences, the Gram sums and the rankings; the small dense solves run in numpy, one call per key and section.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmill.functions.stats import abs_linear
from snapmill.operators.series import KEYS, delta, densify, of, standardized

MODELS = ("ridge", "elastic_net", "huber", "quantile95")
# What the agreement of the models is called, first match first: label, models in whose top lists a name is, models in whose
# lists it is not, priority.
AGREEMENT = (
    ("CONFIRMED_BOTTLENECK", ("ridge", "elastic_net", "huber", "quantile95"), (), 0),
    ("CONFIRMED_BOTTLENECK_EN_COLLINEAR", ("ridge", "huber", "quantile95"), (), 1),
    ("STRONG_CONTRIBUTOR", ("ridge", "elastic_net", "huber"), (), 2),
    ("STABLE_CONTRIBUTOR", ("ridge", "huber"), (), 3),
    ("TAIL_RISK", ("quantile95",), ("ridge",), 4),
    ("TAIL_OUTLIER", ("quantile95", "ridge"), (), 4),
    ("OUTLIER_DRIVEN", ("ridge",), (), 5),
    ("SPARSE_DOMINANT", ("elastic_net",), (), 6),
    ("ROBUST_ONLY", ("huber",), (), 7),
)


@dataclass(frozen=True)
class Settings:
    """Penalties, iteration bounds and tolerance of the models."""

    ridge: float = 50.0
    net: float = 30.0
    mix: float = 0.333
    tau: float = 0.95
    net_rounds: int = 5000
    huber_rounds: int = 100
    quantile_rounds: int = 200
    tolerance: float = 1e-6

    def __post_init__(self) -> None:
        if self.ridge < 0 or self.net < 0 or not 0 <= self.mix <= 1:
            raise ValueError("penalties are not negative and the mix is within 0 and 1")


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a symmetric system; of a singular one the least-norm solution."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    return solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ y)


def elastic_net(x: np.ndarray, y: np.ndarray, penalty: float, mix: float, rounds: int, tolerance: float) -> np.ndarray:
    """Cyclic coordinate descent in column order, on the Gram matrix, so that a step costs columns rather than rows."""
    n = max(len(y), 1)
    gram, right = x.T @ x / n, x.T @ y / n
    norm = np.where(np.diag(gram) > 0, np.diag(gram), 1e-12)
    beta, fitted = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        most = 0.0
        for j in range(len(beta)):
            pull = right[j] - fitted[j] + gram[j, j] * beta[j]
            new = np.sign(pull) * max(abs(pull) - penalty * mix, 0.0) / (norm[j] + penalty * (1 - mix))
            if new != beta[j]:
                fitted += gram[:, j] * (new - beta[j])
                most = max(most, abs(new - beta[j]))
                beta[j] = new
        if most < tolerance:
            break
    return beta


def reweighted(x: np.ndarray, y: np.ndarray, weights, penalty: float, rounds: int, tolerance: float) -> np.ndarray:
    """Iteratively reweighted least squares from 0; ``weights`` gives those of residuals."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = weights(y - x @ beta)
        new = solve((x * w[:, None]).T @ x + penalty * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
        moved = np.abs(new - beta).max(initial=0.0)
        beta = new
        if moved < tolerance:
            break
    return beta


def huber(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int, tolerance: float) -> np.ndarray:
    """Bend at 1.345 MADs of the target."""
    bend = max(1.345 * np.median(np.abs(y - np.median(y))), 1e-6)
    return reweighted(x, y, lambda r: np.minimum(1.0, bend / np.maximum(np.abs(r), 1e-15)), penalty, rounds, tolerance)


def quantile(x: np.ndarray, y: np.ndarray, tau: float, penalty: float, rounds: int, tolerance: float) -> np.ndarray:
    weights = lambda r: np.where(r >= 0, tau, 1 - tau) / np.maximum(np.abs(r), 1e-6)
    return reweighted(x, y, weights, max(0.01 * penalty, 1e-6), rounds, tolerance)


def inflation(x: np.ndarray) -> np.ndarray:
    """Variance inflation of each column: 1 / (1 - R2) of its regression on the others, 1e6 at most.

    The inverse of the correlation matrix has them on its diagonal, which replaces one solve per column.
    """
    n, p = x.shape
    if p <= 1 or n < p + 1:
        return np.ones(p)
    centred = x - x.mean(0)
    spread = np.sqrt((centred**2).sum(0))
    scaled = centred / np.where(spread > 0, spread, 1.0)
    gram = scaled.T @ scaled + 1e-8 * np.eye(p)
    diagonal = np.diag(np.linalg.inv(gram)).copy()
    diagonal[spread == 0] = 1.0
    return np.clip(diagonal, 1.0, 1e6)


def differences(fact: DataFrame, target: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, snap_id, name, delta, z, target``: differences of the dense series, standardised, with the centred ones of the target."""
    dense = densify(fact, 0.0, keys, snaps=target)
    moved = standardized(delta(dense, keys), keys)
    goal = delta(target, keys).select(*keys, "snap_id", F.col("delta").alias("goal"))
    centred = goal.withColumn("target", F.col("goal") - F.avg("goal").over(of(keys))).drop("goal")
    return moved.join(centred, [*keys, "snap_id"])


def gram(moved: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sums over snapshots of z_a z_b for pairs of names of a key, each pair once (a before b or a itself)."""
    at = [*keys, "snap_id"]
    a = moved.select(*at, F.col("name").alias("a"), F.col("z").alias("za"))
    b = moved.select(*at, F.col("name").alias("b"), F.col("z").alias("zb"))
    return a.join(b, at).where("a <= b").groupBy(*keys, "a", "b").agg(F.sum(F.col("za") * F.col("zb")).alias("product"))


def toward_target(moved: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sums over snapshots of z and the target."""
    return moved.groupBy(*keys, "name").agg(F.sum(F.col("z") * F.col("target")).alias("product"))


def fit(moved: DataFrame, settings: Settings = Settings(), keys: Sequence[str] = KEYS) -> DataFrame:
    """Coefficients of the four models and the variance inflation: ``keys, name, ridge, elastic_net, huber, quantile95, vif``.

    A key with fewer than three differences is left out; so is one whose numbers aren't finite; ``skipped`` tells them. A task holds one key's matrix of snapshots and names.
    """
    kinds = {f.name: f.dataType.simpleString() for f in moved.schema}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, "name", *MODELS, "vif"]
        wide = frame.pivot_table(index="snap_id", columns="name", values="z").fillna(0.0).sort_index(axis=1)
        y = frame.groupby("snap_id")["target"].first().loc[wide.index].to_numpy()
        x = wide.to_numpy()
        if len(y) < 3 or not np.isfinite(x).all() or not np.isfinite(y).all():
            return pd.DataFrame(columns=columns)
        s = settings
        out = pd.DataFrame({k: frame[k].iloc[0] for k in keys} | {"name": wide.columns})
        out["ridge"] = ridge(x, y, s.ridge)
        out["elastic_net"] = elastic_net(x, y, s.net, s.mix, s.net_rounds, s.tolerance)
        out["huber"] = huber(x, y, s.ridge, s.huber_rounds, s.tolerance)
        out["quantile95"] = quantile(x, y, s.tau, s.ridge, s.quantile_rounds, s.tolerance)
        out["vif"] = inflation(x)
        return out[columns]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "name string", *(f"{m} double" for m in MODELS), "vif double"])
    return moved.select(*keys, "snap_id", "name", "z", "target").groupBy(*keys).applyInPandas(run, schema)


def skipped(moved: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The keys that ``fit`` leaves out, and why: ``keys, note``."""
    finite = reduce(lambda a, b: a & b, (~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("z", "target")))
    counts = moved.groupBy(*keys).agg(F.count_distinct("snap_id").alias("n"), F.min(F.coalesce(finite, F.lit(False))).alias("finite"))
    note = F.when(F.col("n") < 3, "fewer than 3 differences").when(~F.col("finite"), "numbers that aren't finite")
    return counts.select(*keys, note.alias("note")).where("note is not null")


def scales(moved: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """MAD, 90th and 99th percentile of the plain differences of each name."""
    medians = moved.groupBy(*keys, "name").agg(F.median("delta").alias("m"))
    off = moved.join(medians, [*keys, "name"])
    return off.groupBy(*keys, "name").agg(F.median(F.abs(F.col("delta") - F.col("m"))).alias("mad"), abs_linear("delta", 0.9).alias("p90"), abs_linear("delta", 0.99).alias("p99"))


def impacts(coefficients: DataFrame, scaled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per model and name (``keys, model, name, coefficient``) the usual, active and peak impact, the share among positive ones, and the rank."""
    rows = coefficients.join(scaled, [*keys, "name"])
    size = F.abs("coefficient")
    rows = rows.withColumns({"impact": size * F.col("mad"), "active": size * F.col("p90"), "peak": size * F.col("p99")})
    signed = F.when(F.col("coefficient") >= 0, F.col("active")).otherwise(-F.col("active"))
    total = F.sum(F.when(F.col("coefficient") > 0, F.col("active"))).over(of(keys, "model"))
    share = F.when(F.col("coefficient") > 0, F.col("active") / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn("signed", signed).withColumn("rank", F.row_number().over(of(keys, "model").orderBy(F.col("signed").desc(), "name"))).drop("mad", "p90", "p99")


def long_coefficients(fitted: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, model, name, coefficient``; the elastic net without the names that it dropped."""
    long = fitted.unpivot([*keys, "name"], list(MODELS), "model", "coefficient")
    return long.where((F.col("model") != "elastic_net") | (F.col("coefficient") != 0))


def agreement(ranked: DataFrame, top: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names in the top lists of the models with a positive coefficient, and what the lists they are in make of them."""
    listed = ranked.where(F.col("rank") <= top)
    inside = lambda m: F.max((F.col("model") == m) & (F.col("coefficient") > 0))
    flags = listed.groupBy(*keys, "name").agg(*(inside(m).alias(f"in_{m}") for m in MODELS), F.sum("active").alias("impact"), F.sum("peak").alias("peak")).where(reduce(lambda a, b: a | b, (F.col(f"in_{m}") for m in MODELS)))
    label, order = F.when(F.lit(False), ""), F.when(F.lit(False), 0)
    for name, present, absent, priority in AGREEMENT:
        rule = reduce(lambda a, b: a & b, [F.col(f"in_{m}") for m in present] + [~F.col(f"in_{m}") for m in absent])
        label, order = label.when(rule, name), order.when(rule, priority)
    return flags.withColumn("label", label).withColumn("priority", order)


def collinear(fitted: DataFrame, least: float = 100.0, severe: float = 1000.0, top: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Names with a high variance inflation."""
    rank = F.row_number().over(of(keys).orderBy(F.col("vif").desc(), "name"))
    return fitted.where(F.col("vif") > least).select(*keys, "name", "vif", F.when(F.col("vif") > severe, "SEVERE").otherwise("HIGH").alias("label"), rank.alias("rank")).where(F.col("rank") <= top)


def groups(moved: DataFrame, fitted: DataFrame, inflated: float = 10.0, alike: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Groups of inflated names that correlate with the first of their group, with the impact of their summed differences."""
    rows = moved.join(fitted.where(F.col("vif") > inflated).select(*keys, "name"), [*keys, "name"], "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in moved.schema}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index="snap_id", columns="name", values="delta").fillna(0.0).sort_index(axis=1)
        y = frame.groupby("snap_id")["target"].first().loc[wide.index].to_numpy()
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.nan_to_num(np.atleast_2d(np.corrcoef(wide.to_numpy().T)))
        found: list[list[int]] = []
        for j in range(len(wide.columns)):
            own = next((g for g in found if abs(r[j, g[0]]) > alike), None)
            if own is None:
                found.append([j])
            else:
                own.append(j)
        out = []
        for g in found:
            if len(g) < 2:
                continue
            c = wide.iloc[:, g].sum(axis=1).to_numpy()
            spread = ((c - c.mean()) ** 2).sum()
            coefficient = ((c - c.mean()) * (y - y.mean())).sum() / spread if spread > 0 else 0.0
            out.append((*(frame[k].iloc[0] for k in keys), list(wide.columns[g]), coefficient, abs(coefficient) * np.median(np.abs(c - np.median(c)))))
        return pd.DataFrame(out, columns=[*keys, "names", "coefficient", "impact"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "names array<string>, coefficient double, impact double"])
    return rows.select(*keys, "snap_id", "name", "delta", "target").groupBy(*keys).applyInPandas(run, schema)
