"""Discovery of modules within one bootstrap: seeds, assignment, regulatory programs, reassignment, evaluation."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from corrweave.functions.dist import pearson_p
from corrweave.kernels.lasso import cv_lasso, cv_lasso_sums, lasso_at, lasso_at_sums
from corrweave.kernels.vbsr import vbsr


def _z(x: np.ndarray) -> np.ndarray:
    sd = x.std(1, ddof=1, keepdims=True)
    return np.divide(x - x.mean(1, keepdims=True), sd, out=np.zeros_like(x), where=sd > 0)


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of the rows of a with the rows of b; 0 where one is constant."""
    return _z(a) @ _z(b).T / max(a.shape[1] - 1, 1)


def _signif(x: np.ndarray, digits: int = 7) -> np.ndarray:
    places = digits - 1 - np.floor(np.log10(np.where(x == 0, 1.0, np.abs(x))))
    return np.rint(x * 10.0**places) / 10.0**places


def nearest(genes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid with the largest correlation at 7 significant digits; the first on ties."""
    return _signif(correlate(genes, centroids)).argmax(1)


def eigengene(x: np.ndarray) -> np.ndarray:
    """First right singular vector, with the sign of the mean profile."""
    v = np.linalg.svd(x, full_matrices=False)[2][0]
    return v if v @ x.mean(0) >= 0 else -v


#: Profiles of a module by name.
PROFILES = {"MEAN": lambda x: x.mean(0), "EIGENGENE": eigengene}


def seed_modules(targets: np.ndarray, k: int, seed: int, profile: str = "MEAN", rounds: int = 5) -> np.ndarray:
    """Module of each target: seeds far apart in squared correlation, then rounds of assignment to profiles by module."""
    rng = np.random.default_rng(seed)
    n = len(targets)
    k = min(k, n)
    chosen = [int(rng.integers(n))]
    r2 = correlate(targets, targets[chosen]) ** 2
    while len(chosen) < k:
        far = r2.max(1)
        if len(chosen) == 1:
            pick = int(far.argmin())
        else:
            w = 2 - far
            w[chosen] = 0
            pick = int(rng.choice(n, p=w / w.sum()))
        chosen.append(pick)
        r2 = np.hstack([r2, correlate(targets, targets[[pick]]) ** 2])
    centroids = targets[chosen]
    module = nearest(targets, centroids)
    for _ in range(rounds - 1):
        centroids = np.array([PROFILES[profile](targets[module == c]) if (module == c).sum() > 1 else centroids[c] for c in range(k)])
        module = nearest(targets, centroids)
    return module


def _by_lm(x: np.ndarray, y: np.ndarray, cut: float, seed: int) -> np.ndarray:
    r = correlate(x.T, y[None])[:, 0]
    sx = x.std(0)
    slope = np.divide(r * y.std(), sx, out=np.zeros_like(sx), where=sx > 0)
    return np.where(pearson_p(r, len(y)) < cut, slope, 0.0)


def _by_vbsr(x: np.ndarray, y: np.ndarray, cut: float, seed: int) -> np.ndarray:
    try:
        fit = vbsr(x, y, seed=seed)
    except ValueError:
        return np.zeros(x.shape[1])
    return np.where(fit.p <= cut, fit.beta, 0.0)


#: Regressions by name: (design, response, cut for p-values, seed) to coefficients. Beside these, LASSOparam and a number is the lasso at that place of its path.
REGRESSIONS = {
    "VBSR": _by_vbsr,
    "LM": _by_lm,
    "LASSOmin": lambda x, y, cut, seed: cv_lasso(x, y, "min", seed=seed)[0],
    "LASSO1se": lambda x, y, cut, seed: cv_lasso(x, y, "1se", seed=seed)[0],
    "LASSOparam5": lambda x, y, cut, seed: lasso_at(x, y, 5),
}


def regression(mode: str):
    """The regression of a name. ``LASSOparam<k>``: the penalty at the k-th of ten quantiles of the path (1 the smallest); 0 or less is no penalty."""
    if mode in REGRESSIONS:
        return REGRESSIONS[mode]
    found = re.fullmatch(r"LASSOparam(-?\d+)", mode)
    if not found or int(found[1]) > 10:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(REGRESSIONS)}, or LASSOparam with a number up to 10")
    place = int(found[1])
    return lambda x, y, cut, seed: lasso_at(x, y, place)


def _by_lm_sums(folds: np.ndarray, cut: float) -> np.ndarray:
    s = folds.sum(0)
    n, mean = s[0, 0], s[0, 1:] / s[0, 0]
    cov = s[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    on = (sd[:-1] > 1e-12) & (sd[-1] > 1e-12)
    r = np.divide(cov[:-1, -1], sd[:-1] * sd[-1], out=np.zeros(len(sd) - 1), where=on)
    slope = np.divide(r * sd[-1], sd[:-1], out=np.zeros_like(r), where=on)
    return np.where(pearson_p(r, int(n)) < cut, slope, 0.0)


def sums_regression(mode: str):
    """The regression of a name from sums of products of (1, x, y) over the rows of each fold, as (sums, cut for p-values) to coefficients; None for one that needs the rows."""
    regression(mode)
    if mode == "LM":
        return _by_lm_sums
    if mode in ("LASSOmin", "LASSO1se"):
        return lambda folds, cut: cv_lasso_sums(folds, mode[5:])
    return None if mode == "VBSR" else lambda folds, cut: lasso_at_sums(folds, int(mode[10:]))


def folded(mode: str) -> bool:
    """Whether a regression deals its rows over folds."""
    return mode in ("LASSOmin", "LASSO1se")


def programs(targets: np.ndarray, module: np.ndarray, regulators: np.ndarray, mode: str, profile: str, fdr: float, seed: int, by_members=None) -> dict[int, np.ndarray]:
    """Coefficients of the regulators for each module's profile; tests are cut at ``fdr`` over regulators x target genes. ``by_members`` (which targets are the module's, cut) takes the place of the regression of rows."""
    fit = regression(mode)
    cut = fdr / max(len(regulators) * len(targets), 1)
    out = {}
    for c in np.unique(module).tolist():
        y = PROFILES[profile](targets[module == c])
        found = (lambda c=c, y=y: fit(regulators.T, y, cut, seed)) if by_members is None else (lambda c=c: by_members(module == c, cut))
        out[c] = found() if y.std() > 1e-12 else np.zeros(len(regulators))
    return out


def program_fit(targets: np.ndarray, module: np.ndarray, regulators: np.ndarray, beta: dict[int, np.ndarray], profile: str, mode: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Intercept, prediction and error of each module's program over the samples. Lasso programs have the intercept that centres the error; the others have none."""
    out = {}
    for c, b in beta.items():
        y, fitted = PROFILES[profile](targets[module == c]), b @ regulators
        intercept = float(y.mean() - fitted.mean()) if mode.startswith("LASSO") else 0.0
        out[c] = (intercept, fitted + intercept, y - fitted - intercept)
    return out


def reassign(targets: np.ndarray, module: np.ndarray, beta: dict[int, np.ndarray], regulators: np.ndarray) -> np.ndarray:
    """Targets move to the module whose program predicts them best; modules of one gene are dissolved into the others."""
    names = [c for c, b in sorted(beta.items()) if np.any(b)]
    if not names:
        return module
    predicted = np.array([beta[c] @ regulators for c in names])
    r = _signif(correlate(targets, predicted))
    out = np.array(names)[r.argmax(1)]
    sizes = {c: int((out == c).sum()) for c in names}
    good = [k for k, c in enumerate(names) if sizes[c] >= 2]
    if good and len(good) < len(names):
        small = np.array([sizes[c] < 2 for c in out.tolist()])
        out[small] = np.array(names)[np.array(good)[r[small][:, good].argmax(1)]]
    return out


def evaluate(x: np.ndarray, outcome: np.ndarray, predicted: np.ndarray, n_reg: int, eigen: bool, rows: int | None = None) -> dict[str, float]:
    """The seven statistics of a module's genes x, their profile, and its prediction; ``rows`` samples, where x stands for more than it has."""
    k, n = x.shape
    n = n if rows is None else rows
    res, tot = ((outcome - predicted) ** 2).sum(), ((outcome - outcome.mean()) ** 2).sum()
    r2 = 1 - res / tot if tot > 0 else 0.0
    every = np.abs(correlate(x, x))
    d = np.linalg.svd(x, compute_uv=False) if eigen else np.zeros(1)
    return {
        "n_reg": float(n_reg),
        "n_genes": float(k),
        "mean_corr": float(np.abs(correlate(x, outcome[None])).mean()),
        "rsquare": float(r2),
        "rsquare_adjusted": float(1 - (1 - r2) * (n - 1) / (n - n_reg)) if n > n_reg else 0.0,
        "homogeneity": float((every.sum() - k) / (k - 1) ** 2) if k > 1 else 0.0,
        "condition": float(d[0] ** 2 / (d**2).sum()) if eigen and (d**2).sum() > 0 else 0.0,
    }


def discover(expr: np.ndarray, is_regulator: np.ndarray, samples: list[str], modules: int, mode: str, iterations: int, bootstrap: int, train_share: float = 0.8, profile: str = "MEAN", fdr: float = 0.05, seed: int = 1, only_train: bool = False) -> list[dict]:
    """Modules of one bootstrap: members, program with its intercept, and statistics on the training and, unless ``only_train``, the held-out samples.

    Samples are split by the smallest hashes and scaled within each part; a module without regulators is left out.
    """
    order = sorted(range(len(samples)), key=lambda k: (hashlib.md5(f"{seed}:{bootstrap}:{samples[k]}".encode()).hexdigest(), samples[k]))
    train = np.array(sorted(order[: round(train_share * len(samples))]))
    held = np.array(sorted(set(range(len(samples))).difference(train.tolist())), int)
    parts = {"train": _z(expr[:, train]), "held_out": _z(expr[:, held]) if len(held) > 1 and not only_train else None}
    return _grow(parts, is_regulator, modules, mode, iterations, bootstrap, profile, fdr, seed)


def stand_in(sums: np.ndarray) -> np.ndarray:
    """A matrix of genes x (genes + 1) whose rows have mean 0 and the correlations that ``sums``, of products of (1, genes) over many samples, have: what depends on correlations alone comes out as over all samples."""
    p = len(sums) - 1
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    var, square = np.diag(cov), np.diag(sums)[1:] / n
    on = var > 1e-12 * np.maximum(square, 1e-300)
    sd = np.where(on, np.sqrt(np.maximum(var, 0.0)), np.inf)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    k = np.arange(1, p + 1)
    helmert = np.tril(np.ones((p, p + 1)))  # rows of unit length, orthogonal to each other and to ones
    helmert[np.arange(p), k] = -k
    helmert /= np.sqrt(k * (k + 1))[:, None]
    return np.where(on[:, None], _z((vectors * np.sqrt(np.maximum(values, 0.0))) @ vectors.T @ helmert), 0.0)


def discover_sums(train: np.ndarray, held_out: np.ndarray | None, is_regulator: np.ndarray, modules: int, mode: str, iterations: int, bootstrap: int, fdr: float = 0.05, seed: int = 1) -> list[dict]:
    """As ``discover`` with the mean profile, from sums of products of (1, genes) over the training samples of each fold, and over the held-out samples: what it holds does not grow with the samples."""
    fit, total = sums_regression(mode), train.sum(0)
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    z = stand_in(total)
    sd = np.sqrt(np.maximum(np.diag(total)[1:] / n - mean**2, 0.0) * n / max(n - 1, 1))
    scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=z.any(1))
    change = np.vstack([np.eye(1, len(total)), np.hstack([(-mean * scale)[:, None], np.diag(scale)])])
    folds = change @ train @ change.T  # of scaled genes
    regs, targets = 1 + np.flatnonzero(is_regulator), 1 + np.flatnonzero(~is_regulator)

    def by_members(own: np.ndarray, cut: float) -> np.ndarray:
        pick = np.zeros((len(regs) + 2, len(total)))
        pick[0, 0] = 1
        pick[np.arange(1, len(regs) + 1), regs] = 1
        pick[-1, targets[own]] = 1 / own.sum()
        return fit(pick @ folds @ pick.T, cut)

    parts = {"train": z, "held_out": None if held_out is None or held_out[0, 0] < 2 else stand_in(held_out)}
    rows = {"train": int(n), "held_out": 0 if held_out is None else int(held_out[0, 0])}
    return _grow(parts, is_regulator, modules, mode, iterations, bootstrap, "MEAN", fdr, seed, by_members, rows)


def _grow(parts: dict, is_regulator: np.ndarray, modules: int, mode: str, iterations: int, bootstrap: int, profile: str, fdr: float, seed: int, by_members=None, rows: dict | None = None) -> list[dict]:
    t, r = parts["train"][~is_regulator], parts["train"][is_regulator]
    if len(r) < 2:
        raise ValueError("at least two regulators are needed")
    if not len(t):
        return []
    module = seed_modules(t, modules, seed * 1000 + bootstrap, profile)
    beta = programs(t, module, r, mode, profile, fdr, seed, by_members)
    for _ in range(iterations - 1):
        module = reassign(t, module, beta, r)
        beta = programs(t, module, r, mode, profile, fdr, seed, by_members)
    out = []
    fitted = program_fit(t, module, r, beta, profile, mode)
    for c, b in sorted(beta.items()):
        if not np.any(b):
            continue
        found = {"module": int(c), "targets": np.flatnonzero(module == c), "beta": b, "intercept": fitted[c][0]}
        for split, part in parts.items():
            if part is not None:
                x = part[~is_regulator][module == c]
                found[split] = evaluate(x, PROFILES[profile](x), b @ part[is_regulator], int(np.count_nonzero(b)), profile == "EIGENGENE", rows and rows[split])
        out.append(found)
    return out
