"""Hierarchical clustering, leaf order, and multiscale bootstrap of clusters."""

from __future__ import annotations

import numpy as np

from corrweave.functions.dist import normal_quantile, normal_sf


def correlation_distance(x: np.ndarray) -> np.ndarray:
    """1 - correlation between columns; columns without variance are at distance 1 from all others."""
    sd = x.std(0)
    z = np.divide(x - x.mean(0), sd, out=np.zeros_like(x, float), where=sd > 0)
    d = 1 - z.T @ z / len(x)
    np.fill_diagonal(d, 0)
    return d


def euclidean_distance(x: np.ndarray) -> np.ndarray:
    """Distances between rows, from their inner products: memory of rows squared."""
    q = (x * x).sum(1)
    return np.sqrt(np.maximum(q[:, None] + q[None] - 2 * (x @ x.T), 0.0))


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float]]:
    """Merges (a, b, height) by ``average`` or ``complete`` linkage; leaves are 0..n-1, the k-th merge makes node n + k. Ties go to the smallest pair. Each row's nearest neighbour is kept, so that a merge takes time in proportion to the rows."""
    if method not in ("average", "complete"):
        raise ValueError(f"unknown linkage {method!r}")
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    node, size = list(range(n)), np.ones(n)
    near, best = (d.argmin(1), d.min(1)) if n else (np.zeros(0, int), np.zeros(0))
    out = []
    for k in range(n - 1):
        i = int(best.argmin())
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        out.append((min(node[i], node[j]), max(node[i], node[j]), float(d[i, j])))
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j]) if method == "average" else np.maximum(d[i], d[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        node[i] = n + k
        stale = np.flatnonzero((near == i) | (near == j))
        for r in {*stale.tolist(), i} - {j}:
            near[r] = d[r].argmin()
            best[r] = d[r, near[r]]
        closer = row < best
        near[closer], best[closer] = i, row[closer]
        best[j] = np.inf
    return out


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float]]:
    return linkage(d, "average")


def clusters_of(merges: list[tuple[int, int, float]], n: int) -> list[frozenset[int]]:
    """The leaves below each merge."""
    below = {k: frozenset([k]) for k in range(n)}
    for k, (a, b, _) in enumerate(merges):
        below[n + k] = below[a] | below[b]
    return [below[n + k] for k in range(len(merges))]


def leaf_order(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    """Leaves from left to right."""
    below = {k: [k] for k in range(n)}
    for k, (a, b, _) in enumerate(merges):
        below[n + k] = below.pop(a) + below.pop(b)
    return [v for k in sorted(below) for v in below[k]]


#: Sizes of the samples that are drawn, beside the number of rows.
SCALES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.4)


def bootstrap_hits(x: np.ndarray, found: list[frozenset[int]], scale: float, rounds: range, seed: int = 0) -> np.ndarray:
    """How often each cluster appears again when rows are drawn anew, over some rounds of one scale. A round's draw depends on seed, scale and round alone, so rounds can be dealt over tasks."""
    hits = np.zeros(len(found))
    for k in rounds:
        rng = np.random.default_rng([seed, round(scale * 1000), k])
        rows = rng.integers(0, len(x), max(2, round(scale * len(x))))
        again = set(clusters_of(average_linkage(correlation_distance(x[rows])), x.shape[1]))
        hits += [f in again for f in found]
    return hits


def approximately_unbiased(hits: np.ndarray, rounds: int, scales: tuple[float, ...] = SCALES) -> tuple[float, float]:
    """AU and plain bootstrap probability (Shimodaira 2002) of one cluster from its hits at each scale: v and c by weighted least squares of the normal quantiles on the root of the scale and its inverse, and AU is the upper tail of v - c."""
    bp = hits / rounds
    plain = float(bp[int(np.argmin(np.abs(np.array(scales) - 1)))])
    inner = (bp > 0) & (bp < 1)
    if inner.sum() < 2:
        return (1.0 if bp.mean() > 0.5 else 0.0), plain
    root = np.sqrt(np.array(scales))
    z = -np.array([normal_quantile(b) for b in bp[inner]])
    w = rounds * np.exp(-(z**2)) / (2 * np.pi) / (bp[inner] * (1 - bp[inner]))
    a = np.stack([root[inner], 1 / root[inner]], 1)
    v, c = np.linalg.lstsq(a * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0]
    return normal_sf(v - c), plain


def multiscale_bootstrap(x: np.ndarray, rounds: int = 1000, scales: tuple[float, ...] = SCALES, seed: int = 0) -> list[tuple[frozenset[int], float, float]]:
    """Each cluster of the columns with its AU and plain bootstrap probability; rows are drawn again at several scales."""
    found = clusters_of(average_linkage(correlation_distance(x)), x.shape[1])
    hits = np.array([bootstrap_hits(x, found, s, range(rounds), seed) for s in scales])
    return [(f, *approximately_unbiased(hits[:, k], rounds, scales)) for k, f in enumerate(found)]


def significant_clusters(tested: list[tuple[frozenset[int], float, float]], least: float = 0.95, whole: int | None = None) -> list[frozenset[int]]:
    """The largest clusters whose AU reaches ``least``; the root, which is all, does not count."""
    out: list[frozenset[int]] = []
    for f, au, _ in sorted(tested, key=lambda t: -len(t[0])):
        if au >= least and len(f) != whole and not any(f <= g for g in out):
            out.append(f)
    return out
