"""Small numpy learners and the bounded samples they are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


#: A hash is kept as so many bits; shares of it pick samples.
_HASH = 1 << 30
#: How far an approximate count may fall short, and the share of a sample that is drawn too many.
_SLACK = 1.3


def hashed(rows: DataFrame, cols: list[str], salt: str) -> DataFrame:
    """``rows`` with ``_h`` and ``_g``, two hashes of an id and a text, say, by which rows under one id, or none, are picked each by itself.

    Taken before a join, they let it carry the rows of a sample alone.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return rows.withColumns({"_h": F.pmod(F.xxhash64(*parts, F.lit(salt)), F.lit(_HASH)), "_g": F.xxhash64(F.lit(salt), *parts)})


def share_of(bound: int, n: int) -> int:
    """The hash below which about 1.3 ``bound`` of ``n`` different rows lie; all rows if there are hardly more."""
    return _HASH if n <= bound else min(_HASH, int(_HASH * _SLACK * bound / n))


def bounded_sample(rows: DataFrame, bound: int, take: list[Column | str], source: DataFrame | None = None) -> DataFrame:
    """``take`` of at most ``bound`` of the different rows of ``hashed`` rows, each once, by their hashes.

    The same rows give the same sample, however they are dealt and repeated: one id on
    many rows, or no id at all, is neither taken nor left as a whole, and ties of one hash
    are settled by the other. Rows are thinned to about the bound before ``take`` is
    worked out, and only that is ordered. With ``source``, the hashed table that ``rows``
    were joined from, hashes alone go through that join, and the picked ones, ``bound`` at
    most, are broadcast to fetch their rows.
    """
    n = rows.agg(F.approx_count_distinct("_g", 0.02)).first()[0]
    some = rows.where(F.col("_h") < share_of(bound, n))
    if source is not None:
        picked = some.select("_h", "_g").distinct().orderBy("_h", "_g").limit(bound)
        some = source.join(F.broadcast(picked), ["_h", "_g"], "left_semi")
    some = some.dropDuplicates(["_h", "_g"]).select("_h", "_g", *take)
    return some.orderBy("_h", "_g").limit(bound).drop("_h", "_g")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept, which is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step * min(1.0, 10.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 150) -> np.ndarray:
    """Squared-hinge support vector machine for y in {-1, 1} by accelerated gradient; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype) * c * 100
    lipschitz = 1.0 + 2.0 * weight.max() * np.linalg.norm(x.T @ (x * (weight / weight.max())[:, None]), 2) if x.shape[1] <= 64 else None
    if lipschitz is None:  # power steps
        v = np.ones(x.shape[1], x.dtype)
        for _ in range(20):
            v = x.T @ (weight * (x @ v))
            size = np.linalg.norm(v)
            v /= max(size, 1e-12)
        lipschitz = 1.0 + 2.2 * size
    w = z = np.zeros(x.shape[1], x.dtype)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - (z - 2 * x.T @ (weight * y * slack)) / lipschitz
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = (new + (t - 1) / t2 * (new - w)).astype(x.dtype)
        w, t = new.astype(x.dtype), t2
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid from margins to probabilities of y = 1."""
    w = logistic(margin.reshape(-1, 1), (y > 0).astype(float), 0.1)
    return float(w[0]), float(w[1])


def non_negative_pu(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 1e-4, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Linear weights (the last is the bias) by non-negative positive-unlabelled learning.

    Kiryo et al. (2017): the risk is prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior *
    E_p[l(-f)]) with the logistic loss l. Where the second part falls below zero the
    step goes against it. Steps are Adam's.
    """
    pos, unl = (np.hstack([a, np.ones((len(a), 1), a.dtype)]) for a in (pos, unl))
    w = np.zeros(pos.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        fp, fu = pos @ w, unl @ w
        up = -(pos.T @ (1 - sigmoid(fp))) / len(pos)  # of E_p[l(f)]
        down_p, down_u = (pos.T @ sigmoid(fp)) / len(pos), (unl.T @ sigmoid(fu)) / len(unl)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        grad = prior * up + (down_u - prior * down_p) if negative >= 0 else -(down_u - prior * down_p)
        grad[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w
