"""The rewiring statistic of many labellings of one module."""

from __future__ import annotations

import hashlib
import warnings

import numpy as np


def hashed_labels(samples: list[str], ones: int, draw: int, seed: int = 1) -> np.ndarray:
    """Label 1 for the ``ones`` samples with the smallest MD5 of seed, draw and name."""
    order = sorted(range(len(samples)), key=lambda k: (hashlib.md5(f"{seed}:{draw}:{samples[k]}".encode()).hexdigest(), samples[k]))
    out = np.zeros(len(samples), np.int8)
    out[order[:ones]] = 1
    return out


def _correlations(x: np.ndarray) -> np.ndarray | None:
    """Correlations of the columns, each pair over the rows that have both; None where a column is constant."""
    known = ~np.isnan(x)
    if known.all():
        z = x - x.mean(0)
        s = np.sqrt((z * z).sum(0))
        if len(z) < 2 or (s <= 1e-12).any():
            return None
        z /= s
        return z.T @ z
    m = known.astype(float)
    z = np.where(known, x - np.nanmean(x, 0), 0.0)
    n, a, q = m.T @ m, z.T @ m, (z * z).T @ m  # rows, sums and squares of the first gene of a pair over the pair's rows
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = z.T @ z - a * a.T / n
        var = q - a * a / n
        return np.where((var > 1e-12) & (var.T > 1e-12), cov / np.sqrt(var * var.T), np.nan)


def statistic(x: np.ndarray, label: np.ndarray) -> float:
    """Sum over both triangles of squared differences of the correlations within the labels; NaN where a gene is constant in one. Missing values count pair by pair, and a pair that is undefined within a label adds nothing."""
    parts = [_correlations(x[label == k]) for k in (0, 1)]
    if any(p is None for p in parts):
        return float("nan")
    d = parts[0] - parts[1]
    np.fill_diagonal(d, 0)
    return float(np.nansum(d * d)) if np.isfinite(d).any() else float("nan")


def varying(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Genes that vary within both labels."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # a gene without values in a label does not vary
        return np.all([np.nan_to_num(np.nanstd(x[label == k], 0)) > 1e-12 for k in (0, 1)], axis=0)


def statistics_of_sums(sums: np.ndarray, genes: int) -> np.ndarray:
    """The observed statistic and those of the draws, NaN where ``statistic`` is. ``sums`` has a row for all samples, one for those of label 1, and one for those that each draw labels 1, of 1, the genes, and the products of each gene with itself and later ones."""
    k = genes
    upper = np.triu_indices(k)
    cross = np.zeros((len(sums), k, k))
    cross[:, upper[0], upper[1]] = sums[:, 1 + k :]
    cross[:, upper[1], upper[0]] = sums[:, 1 + k :]
    n, first = sums[:, 0], sums[:, 1 : 1 + k]
    parts = []
    for m, a, q in ((n[1:], first[1:], cross[1:]), (n[0] - n[1:], first[0] - first[1:], cross[0] - cross[1:])):
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = q - a[:, :, None] * a[:, None, :] / m[:, None, None]
            square = np.einsum("dii->di", cov)
            flat = ~(square > np.maximum(1e-24, 1e-13 * np.einsum("dii->di", q))) | (m < 2)[:, None]
            parts.append((cov / np.sqrt(square[:, :, None] * square[:, None, :]), flat))
    keep = ~(parts[0][1][0] | parts[1][1][0])  # genes that vary within both labels
    if keep.sum() < 2:
        return np.full(1, np.nan)
    d = (parts[0][0] - parts[1][0])[:, keep][:, :, keep]
    d[:, np.arange(keep.sum()), np.arange(keep.sum())] = 0
    out = np.where(np.isnan(d), 0, d * d).sum((1, 2))
    return np.where((parts[0][1][:, keep] | parts[1][1][:, keep]).any(1), np.nan, out)


def label_products(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The rows of ``statistics_of_sums`` over some samples: x is samples x genes, labels are (1 + draws) x samples."""
    i, j = np.triu_indices(x.shape[1])
    wide = np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])
    return np.vstack([wide.sum(0), labels @ wide])
