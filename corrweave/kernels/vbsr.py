"""Variational Bayes spike regression (Logsdon, Hoffman and Mezey 2010), all restarts at once.

A restart is an order of the features. The restarts' states are rows of arrays, so one coordinate step updates one
feature of every restart, and numpy does the work for all of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from corrweave.functions.dist import chi2_isf1, chi2_sf1, normal_quantile, pearson_p

DUPLICATE = 10.0


@dataclass(frozen=True)
class VbsrFit:
    """Coefficients, z statistics, their p-values and posteriors of the features, the intercept, the penalty, and the weights of the restarts."""

    beta: np.ndarray
    z: np.ndarray
    p: np.ndarray
    post: np.ndarray
    intercept: float
    l0: float
    weights: np.ndarray
    state: tuple[np.ndarray, np.ndarray] | None = None  # coefficients and error variances of the restarts


def penalty(n: int, m: int, post: float = 0.95) -> float:
    """The penalty at which a feature at the Bonferroni limit (m counts the intercept) has posterior ``post``."""
    return -(chi2_isf1(0.05 / m) - math.log(n) + 2 * math.log((1 - post) / post))


def vbsr(x: np.ndarray, y: np.ndarray, l0: float | None = None, post: float = 0.95, orderings: int = 15, seed: int = 0, eps: float = 1e-6, max_rounds: int = 10_000, correct: bool = True, best_only: bool = False, start: VbsrFit | None = None) -> VbsrFit:
    """Fit y on the columns of x. Constant columns get no coefficient; a y without variance is a ValueError.

    ``correct`` divides z by the root of the restarts' weighted residual correlations; ``best_only`` takes the restart
    with the best bound instead of averaging; ``start`` goes on from the restarts of another fit of the same data.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, p = x.shape
    if not np.isfinite(x).all() or not np.isfinite(y).all() or y.std() <= 0:
        raise ValueError("x and y must be finite, and y must vary")
    scale = x.std(0)
    alive = scale > 1e-12
    z = np.zeros_like(x)
    z[:, alive] = (x[:, alive] - x[:, alive].mean(0)) / scale[alive]
    l0 = penalty(n, p + 1, post) if l0 is None else l0
    prior = 1 / (1 + math.exp(-0.5 * l0))
    design = np.hstack([np.ones((n, 1)), z])
    ss = (design**2).sum(0)
    rng = np.random.default_rng(seed)
    features = np.concatenate([[0], np.flatnonzero(alive) + 1])
    order = np.array([rng.permutation(features) for _ in range(orderings)])
    rows = np.arange(orderings)
    eb, eb2, pr, mu, var = (np.zeros((orderings, p + 1)) for _ in range(5))
    pr[:, 0] = 1
    sigma = np.full(orderings, y.var(ddof=1))
    resid = np.tile(y, (orderings, 1))
    if start is not None and start.state is not None:
        eb, sigma = (v.copy() for v in start.state)
        resid = y - eb @ design.T
    bound = np.full(orderings, -np.inf)
    going = np.ones(orderings, bool)
    for _ in range(max_rounds):
        live = rows[going]
        for t in range(order.shape[1]):
            k = order[live, t]
            columns = design[:, k].T
            m = (columns * resid[live]).sum(1) / ss[k] + eb[live, k]
            v = sigma[live] / ss[k]
            q = np.where(k == 0, 1.0, 1 / (1 + np.exp(-0.5 * np.clip(m * m / v + l0 + np.log(v), -1400, 1400))))
            new = q * m
            resid[live] += columns * (eb[live, k] - new)[:, None]
            mu[live, k], var[live, k], pr[live, k], eb[live, k] = m, v, q, new
            eb2[live, k] = np.where(k == 0, new * new, q * (m * m + v))
        sigma[live] = ((resid[live] ** 2).sum(1) - ((eb[live] ** 2 - eb2[live]) * ss).sum(1)) / n
        if not np.isfinite(sigma).all() or (sigma <= 0).any():
            raise ValueError("the error variance left the positive numbers")
        on = features[1:]
        q, v = pr[np.ix_(live, on)], np.maximum(var[np.ix_(live, on)], 1e-300)
        entropy = -(q * np.log(np.maximum(q, 1e-300)) + (1 - q) * np.log(np.maximum(1 - q, 1e-300))) + 0.5 * q * np.log(2 * np.pi * v)
        now = -0.5 * n * (np.log(2 * np.pi * sigma[live]) + 1) + (q * math.log(prior) + (1 - q) * math.log1p(-prior) + entropy).sum(1)
        change = np.abs(now - bound[live])
        bound[live] = now
        going[live] = change > eps
        if not going.any():
            break
    weights = np.exp(bound - bound.max())
    if best_only:
        weights = (np.arange(orderings) == bound.argmax()).astype(float)
    for i in range(orderings):
        weights[i + 1 :][np.abs(bound[i + 1 :] - bound[i]) < DUPLICATE * eps] *= weights[i] <= 0
    weights /= weights.sum()
    used = np.flatnonzero(weights > 0)
    chi = np.divide(mu, np.sqrt(var), out=np.zeros_like(mu), where=var > 0)
    average = weights @ chi
    if correct and len(used) > 1:
        for k in features:
            partial = resid[used] + eb[used, k][:, None] * design[:, k]
            c = np.atleast_2d(np.corrcoef(partial))
            average[k] /= math.sqrt(max(weights[used] @ c @ weights[used], 1e-12))
    back = np.where(alive, scale, 1.0)
    beta = np.where(alive, (weights @ eb)[1:] / back, 0.0)
    stat = np.where(alive, average[1:], 0.0)
    centre = np.where(alive, x.mean(0), 0.0)
    return VbsrFit(beta, stat, np.array([chi2_sf1(s * s) for s in stat]), (weights @ pr)[1:], float((weights @ eb)[0] - centre @ beta), l0, weights, (eb, sigma))


def screen(x: np.ndarray, y: np.ndarray, below: float) -> np.ndarray:
    """Columns whose own regression has a p-value below the level: the features that a screened fit gets."""
    sd = x.std(0)
    r = np.divide((x - x.mean(0)).T @ (y - y.mean()) / len(y), sd * y.std(), out=np.zeros(x.shape[1]), where=sd > 1e-12)
    return np.flatnonzero((sd > 1e-12) & (pearson_p(np.clip(r, -1, 1), len(y)) < below))


def refit(x: np.ndarray, y: np.ndarray, fit: VbsrFit, level: float = 0.05) -> tuple[np.ndarray, np.ndarray, float]:
    """Ordinary least squares on the features below the Bonferroni limit: their columns, coefficients, intercept."""
    on = np.flatnonzero(fit.p < level / x.shape[1])
    beta = np.linalg.lstsq(np.hstack([np.ones((len(y), 1)), x[:, on]]), y, rcond=None)[0]
    return on, beta[1:], float(beta[0])


def vbsr_logistic(x: np.ndarray, y: np.ndarray, l0: float | None = None, post: float = 0.95, seed: int = 0, eps: float = 1e-6, max_rounds: int = 1000) -> VbsrFit:
    """Fit of a 0/1 response by weighted coordinate steps on the working residuals; one order of the features.

    Fitted probabilities of 0 or 1 (separable data) are a ValueError.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, p = x.shape
    scale = x.std(0)
    alive = scale > 1e-12
    z = np.zeros_like(x)
    z[:, alive] = (x[:, alive] - x[:, alive].mean(0)) / scale[alive]
    design = np.hstack([np.ones((n, 1)), z])
    l0 = penalty(n, p + 1, post) if l0 is None else l0
    order = np.random.default_rng(seed).permutation(np.concatenate([[0], np.flatnonzero(alive) + 1]))
    eb, pr, stat = np.zeros(p + 1), np.zeros(p + 1), np.zeros(p + 1)
    eta = np.zeros(n)
    for _ in range(max_rounds):
        m = 1 / (1 + np.exp(-eta))
        w = m * (1 - m)
        if (w < 1e-10).any():
            raise ValueError("fitted probabilities reached 0 or 1")
        resid = (y - m) / w
        before = eb.copy()
        for k in order:
            c = design[:, k]
            precision = (w * c * c).sum()
            mu = (w * c * resid).sum() / precision + eb[k]
            q = 1.0 if k == 0 else 1 / (1 + np.exp(-0.5 * np.clip(mu * mu * precision + l0 - np.log(precision), -1400, 1400)))
            new = q * mu
            resid -= c * (new - eb[k])
            eta += c * (new - eb[k])
            eb[k], pr[k], stat[k] = new, q, mu * math.sqrt(precision)
        if np.abs(eb - before).max() < eps:
            break
    beta = np.where(alive, eb[1:] / np.where(alive, scale, 1.0), 0.0)
    return VbsrFit(beta, stat[1:], np.array([chi2_sf1(s * s) for s in stat[1:]]), pr[1:], float(eb[0] - np.where(alive, x.mean(0), 0) @ beta), l0, np.ones(1))


def kl_to_null(z: np.ndarray, alpha: float, screened: float = 1.0, draws: int = 1000, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """For each column of z statistics the log divergence of their bulk from the normal null cut at ``alpha`` (and beyond ``screened``, where features were screened), and mean and deviation of the same under the null.

    The divergence is between normals: mean squared over two, and (v - 1 - ln v) / 2 of the variance over the cut normal's.
    """
    density = lambda t: math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    low = -normal_quantile(screened / 2) if screened < 1 else 0.0
    high = -normal_quantile(alpha / 2)
    inside = 2 * (0.5 * math.erf(high / math.sqrt(2)) - 0.5 * math.erf(low / math.sqrt(2)))
    reference = 1 + 2 * (low * density(low) - high * density(high)) / inside

    def divergence(column: np.ndarray) -> float:
        bulk = column[(np.abs(column) < high) & (np.abs(column) >= low)]
        if len(bulk) < 3:
            return float("nan")
        v = bulk.var(ddof=1) / reference
        return math.log(max(bulk.mean() ** 2 / 2 + 0.5 * (v - 1 - math.log(v)), 1e-300))

    rng = np.random.default_rng(seed)
    null = []
    for _ in range(draws):
        sample = rng.standard_normal(len(z) if low == 0 else int(len(z) / screened * 1.5))
        null.append(divergence(sample[np.abs(sample) >= low][: len(z)]))
    return np.array([divergence(c) for c in z.T]), float(np.nanmean(null)), float(np.nanstd(null, ddof=1))


#: Rules that choose a fit of a path: the divergence's smallest value or the null's mean, plus so many standard errors of the null.
PATH_RULES = {"min": ("min", 0), "mean": ("mean", 0), "min_1se": ("min", 1), "mean_1se": ("mean", 1), "min_2se": ("min", 2), "mean_2se": ("mean", 2)}


def penalty_path(x: np.ndarray, y: np.ndarray, size: int = 20) -> np.ndarray:
    """Penalties in equal steps from the one that lets the best feature in down to that of the weakest, or of the feature at the root of the rows where there are not enough rows for all; the strongest comes first."""
    sd = x.std(0)
    r = np.divide((x - x.mean(0)).T @ (y - y.mean()) / len(y), sd * y.std(), out=np.zeros(x.shape[1]), where=sd > 1e-12)
    r2 = np.minimum(r * r, 1 - 1e-12)
    #: The score at which a single feature's posterior is one half: its chi square and the logarithm of its variance.
    chi = np.sort(len(y) * r2 / (1 - r2) + np.log(np.maximum(y.var() * (1 - r2) / len(y), 1e-300)))[::-1]
    last = len(chi) - 1 if math.sqrt(len(y)) > x.shape[1] else min(len(chi) - 1, max(0, round(math.sqrt(len(y))) - 1))
    return np.linspace(-chi[0], -chi[last], size)


def choose_on_path(kl: np.ndarray, mean: float, se: float, rule: str) -> int:
    """Place of the fit that a rule chooses, of divergences along a path from the strongest penalty to the weakest.

    Read from the weakest penalty on, it is the last rise over the rule's value: of the two fits at it, the nearer. Where
    there is none, the weakest fit if its divergence reaches the value, else the strongest.
    """
    if rule not in PATH_RULES:
        raise ValueError(f"unknown rule {rule!r}; one of {', '.join(PATH_RULES)}")
    base, errors = PATH_RULES[rule]
    target = (np.nanmin(kl) if base == "min" else mean) + errors * se
    back = kl[::-1]
    rises = np.flatnonzero((back[:-1] <= target) & (target <= back[1:]))
    if len(rises):
        k = int(rises[-1])
        k += int(abs(back[k + 1] - target) < abs(back[k] - target))
    else:
        k = 0 if target <= back[0] else len(back) - 1
    return len(kl) - 1 - k


def vbsr_path(x: np.ndarray, y: np.ndarray, l0s: np.ndarray | None = None, alpha: float = 0.01, rule: str = "mean", **fit) -> tuple[VbsrFit, list[VbsrFit], dict[str, int]]:
    """Fits along penalties, each going on from the one before, the fit that ``rule`` chooses by the divergence of its statistics, and the place that each rule chooses."""
    if rule not in PATH_RULES:
        raise ValueError(f"unknown rule {rule!r}; one of {', '.join(PATH_RULES)}")
    fits: list[VbsrFit] = []
    for v in penalty_path(x, y) if l0s is None else l0s:
        fits.append(vbsr(x, y, l0=float(v), start=fits[-1] if fits else None, **fit))
    kl, mean, se = kl_to_null(np.stack([f.z for f in fits], 1), alpha)
    chosen = {name: choose_on_path(kl, mean, se, name) for name in PATH_RULES}
    return fits[chosen[rule]], fits, chosen
