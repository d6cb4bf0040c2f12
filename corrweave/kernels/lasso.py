"""Lasso by coordinate descent over a path, with cross-validated choice of the penalty.

The path has 100 values in equal steps of the logarithm, from the smallest penalty without coefficients down to 1e-4 of
it (1e-2 where there are more features than rows); ten folds are dealt by a seeded order. Columns are scaled to
variance 1.
"""

from __future__ import annotations

import numpy as np


def path(x: np.ndarray, y: np.ndarray, lambdas: np.ndarray, tol: float = 1e-7, rounds: int = 1000) -> np.ndarray:
    """Coefficients for each penalty of centred y on standardised x, warm-started; by covariance updates."""
    return descend(x.T @ x / len(x), x.T @ y / len(x), lambdas, tol, rounds)


def descend(gram: np.ndarray, xy: np.ndarray, lambdas: np.ndarray, tol: float = 1e-7, rounds: int = 1000) -> np.ndarray:
    """``path`` from the mean cross products of x, and of x with y."""
    p = len(xy)
    beta, out = np.zeros(p), np.zeros((len(lambdas), p))
    for k, lam in enumerate(lambdas):
        for _ in range(rounds):
            most = 0.0
            for j in range(p):
                if gram[j, j] <= 0:
                    continue
                rho = xy[j] - gram[j] @ beta + gram[j, j] * beta[j]
                new = np.sign(rho) * max(abs(rho) - lam, 0.0) / gram[j, j]
                most = max(most, abs(new - beta[j]))
                beta[j] = new
            if most < tol:
                break
        out[k] = beta
    return out


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-12, sd, np.inf)
    return (x - mean) / sd, mean, sd


def lambda_path(x: np.ndarray, y: np.ndarray, size: int = 100) -> np.ndarray:
    z, _, _ = _standard(x)
    return _spaced(z.T @ (y - y.mean()) / len(y), len(y), size)


def _spaced(xy: np.ndarray, n: float, size: int = 100) -> np.ndarray:
    top = np.abs(xy).max()
    return top * np.logspace(0, -4 if n > len(xy) else -2, size) if top > 0 else np.zeros(size)


def dealt(n: int, folds: int = 10, seed: int = 0) -> np.ndarray:
    """The fold of each of n rows."""
    return np.random.default_rng(seed).permutation(np.arange(n) % min(folds, n))


def cv_lasso(x: np.ndarray, y: np.ndarray, choose: str = "min", folds: int = 10, seed: int = 0, size: int = 100) -> tuple[np.ndarray, float, float]:
    """Coefficients, intercept and penalty at the smallest cross-validated error (``min``), or the largest penalty within one standard error (``1se``)."""
    if choose not in ("min", "1se"):
        raise ValueError(f"unknown choice {choose!r}")
    x, y = np.asarray(x, float), np.asarray(y, float)
    lambdas = lambda_path(x, y, size)
    fold = dealt(len(y), folds, seed)
    errors = []
    for f in range(fold.max() + 1):
        train = fold != f
        z, mean, sd = _standard(x[train])
        beta = path(z, y[train] - y[train].mean(), lambdas) / sd
        fit = (x[~train] - mean) @ beta.T + y[train].mean()
        errors.append(((y[~train][:, None] - fit) ** 2).mean(0))
    pick = _pick(np.array(errors), choose)
    z, centre, sd = _standard(x)
    beta = path(z, y - y.mean(), lambdas[: pick + 1])[-1] / sd
    return beta, float(y.mean() - centre @ beta), float(lambdas[pick])


def _pick(errors: np.ndarray, choose: str) -> int:
    """Place of the chosen penalty, from the errors of each fold at each penalty."""
    mean, se = errors.mean(0), errors.std(0, ddof=1) / np.sqrt(len(errors))
    best = int(mean.argmin())
    return best if choose == "min" else int(np.flatnonzero(mean <= mean[best] + se[best])[0])


def lasso_at(x: np.ndarray, y: np.ndarray, decile: int) -> np.ndarray:
    """Coefficients at a decile of the path (index from 1 of the quantiles 0, 1/9, ..., 1); 0 or less is no penalty."""
    lambdas = lambda_path(x, y)
    lam = 0.0 if decile <= 0 else float(np.quantile(lambdas, (decile - 1) / 9))
    z, _, sd = _standard(np.asarray(x, float))
    return path(z, y - y.mean(), np.array([*lambdas[lambdas > lam], lam]))[-1] / sd


def _of_sums(s: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """Means of x, mean of y, deviations of x (infinite for a constant one), and mean cross products of standardised x, and of those with centred y, from the sums of products of (1, x, y)."""
    n, mean = s[0, 0], s[0, 1:] / s[0, 0]
    cov = s[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0.0))
    sd = np.where(sd > 1e-12, sd, np.inf)
    return mean[:-1], float(mean[-1]), sd, cov[:-1, :-1] / np.outer(sd, sd), cov[:-1, -1] / sd


def cv_lasso_sums(folds: np.ndarray, choose: str = "min", size: int = 100) -> np.ndarray:
    """Coefficients as ``cv_lasso``, from the sums of products of (1, x, y) over the rows of each fold: the rows themselves are not needed."""
    total = folds.sum(0)
    _, _, sd, gram, xy = _of_sums(total)
    lambdas = _spaced(xy, total[0, 0], size)
    errors = []
    for own in folds:
        mean, level, scale, g, v = _of_sums(total - own)
        beta = descend(g, v, lambdas) / scale
        c = np.hstack([(beta @ mean - level)[:, None], -beta, np.ones((len(beta), 1))])  # the error of a row is c times (1, x, y)
        errors.append(((c @ own) * c).sum(1) / own[0, 0])
    return descend(gram, xy, lambdas[: _pick(np.array(errors), choose) + 1])[-1] / sd


def lasso_at_sums(folds: np.ndarray, decile: int) -> np.ndarray:
    """Coefficients as ``lasso_at``, from sums of products of (1, x, y)."""
    total = folds.sum(0)
    _, _, sd, gram, xy = _of_sums(total)
    lambdas = _spaced(xy, total[0, 0])
    lam = 0.0 if decile <= 0 else float(np.quantile(lambdas, (decile - 1) / 9))
    return descend(gram, xy, np.array([*lambdas[lambdas > lam], lam]))[-1] / sd
