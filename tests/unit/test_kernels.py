"""Numpy kernels against closed forms, published figures and planted data."""

import math
import random

import numpy as np
import pytest

from corrweave.functions import dist
from corrweave.kernels import hclust, perm
from corrweave.kernels.cliques import maximal_cliques
from corrweave.kernels.lasso import cv_lasso, lambda_path, path
from corrweave.kernels.modules import discover, reassign, regression, seed_modules
from corrweave.kernels.vbsr import PATH_RULES, choose_on_path, kl_to_null, penalty, penalty_path, refit, screen, vbsr, vbsr_logistic, vbsr_path


def test_published_p_values():
    assert dist.pearson_p(0.686604406789968, 35) == pytest.approx(5.25949529916028e-06, rel=1e-10)
    assert dist.spearman_p(0.747368421052632, 20, False) == pytest.approx(0.000231130847673579, rel=1e-9)
    assert dist.spearman_p(0.64430282390652, 35, True) == pytest.approx(2.95636445594942e-05, rel=1e-10)
    assert dist.wilcoxon_p(215, 20, 15) == pytest.approx(0.0302, abs=5e-5)
    assert dist.wilcoxon_p(88, 20, 15) == pytest.approx(0.0392, abs=5e-5)
    assert dist.chi2_isf1(0.05) == pytest.approx(3.841458820694124)
    assert dist.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert dist.t_two_sided(2.0, 1) == pytest.approx(1 - 2 * math.atan(2) / math.pi)


def test_tie_branches():
    assert dist.wilcoxon_p(206, 20, 15) == pytest.approx(0.0638, abs=5e-5)
    assert dist.wilcoxon_p(206, 20, 15, [2]) == pytest.approx(0.0643, abs=6e-4)
    assert math.isnan(dist.wilcoxon_p(1, 0, 5)) and math.isnan(dist.pearson_p(0.5, 2))
    assert dist.spearman_p(1.0, 5, False) == pytest.approx(2 / 120)


def test_vbsr_finds_the_planted_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 30))
    y = 2 * x[:, 3] - 1.5 * x[:, 11] + x[:, 20] + rng.normal(0, 0.3, 120)
    fit = vbsr(x, y)
    assert set(np.flatnonzero(fit.p < 0.05 / 30)) == {3, 11, 20} and (fit.post[[3, 11, 20]] > 0.99).all()
    assert fit.beta[3] == pytest.approx(2, abs=0.1) and fit.weights.sum() == pytest.approx(1)
    again = vbsr(x, y, seed=9)
    assert np.allclose(fit.beta, again.beta, atol=1e-3)


def test_vbsr_edge_cases():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(64, 8))
    x[:, 2] = 5
    fit = vbsr(x, x[:, 0] * 3 + 7, orderings=3)
    assert fit.beta[2] == 0 and fit.beta[0] == pytest.approx(3, abs=1e-3) and fit.intercept == pytest.approx(7, abs=1e-2)
    with pytest.raises(ValueError):
        vbsr(x, np.ones(64))
    assert penalty(100, 10) == pytest.approx(-(dist.chi2_isf1(0.005) - math.log(100) + 2 * math.log(0.05 / 0.95)))


def test_vbsr_noise_is_calm():
    rng = np.random.default_rng(3)
    assert (vbsr(rng.normal(size=(80, 20)), rng.normal(size=80)).post < 0.95).all()


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 12))
    x = (x - x.mean(0)) / x.std(0)
    y = x[:, 0] * 2 - x[:, 5] + rng.normal(0, 0.5, 100)
    y = y - y.mean()
    for lam in (0.05, 0.3):
        beta = path(x, y, np.array([lam]), tol=1e-10)[0]
        grad = x.T @ (y - x @ beta) / len(y)
        on = beta != 0
        assert np.allclose(grad[on], lam * np.sign(beta[on]), atol=1e-6) and (np.abs(grad[~on]) <= lam + 1e-6).all()
    q, _ = np.linalg.qr(rng.normal(size=(64, 8)))
    q = (q - q.mean(0)) / (q - q.mean(0)).std(0)
    assert lambda_path(x, y)[0] == pytest.approx(np.abs(x.T @ y).max() / len(y))
    best, _, low = cv_lasso(x, y, "min")
    sparse, _, high = cv_lasso(x, y, "1se")
    assert high >= low and {0, 5} <= set(np.flatnonzero(sparse)) <= set(np.flatnonzero(best))


def _graph(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def test_cliques():
    k4 = [(a, b) for a in "abcd" for b in "abcd" if a < b]
    assert sorted(maximal_cliques(_graph([*k4, ("d", "e")]))) == [["a", "b", "c", "d"], ["d", "e"]]
    assert sorted(maximal_cliques(_graph([("a", "b"), ("b", "c"), ("a", "c"), ("b", "d"), ("c", "d")]))) == [["a", "b", "c"], ["b", "c", "d"]]
    assert list(maximal_cliques({})) == []
    rnd = random.Random(1)
    g = _graph([(f"n{a:02d}", f"n{b:02d}") for a in range(15) for b in range(a) if rnd.random() < 0.5])
    found = list(maximal_cliques(g))
    assert len({tuple(c) for c in found}) == len(found)
    for c in found:
        assert all(b in g[a] for a in c for b in c if a != b)
        assert not any(all(v in g[u] for u in c) for v in g if v not in c)


def test_average_linkage_and_bootstrap():
    d = np.array([[0, 1, 6, 8], [1, 0, 5, 9], [6, 5, 0, 2], [8, 9, 2, 0]], float)
    merges = hclust.average_linkage(d)
    assert [(a, b) for a, b, _ in merges] == [(0, 1), (2, 3), (4, 5)] and merges[-1][2] == pytest.approx(7)
    assert sorted(hclust.leaf_order(merges, 4)) == [0, 1, 2, 3]
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 1)), rng.normal(size=(60, 1))
    x = np.hstack([a + rng.normal(0, 0.2, (60, 3)), b + rng.normal(0, 0.2, (60, 3))])
    chosen = hclust.significant_clusters(hclust.multiscale_bootstrap(x, 30), 0.95, 6)
    assert set(chosen) == {frozenset({0, 1, 2}), frozenset({3, 4, 5})}


def test_permutation_statistic():
    rng = np.random.default_rng(5)
    half = rng.normal(size=(20, 5))
    label = np.repeat([0, 1], 20)
    assert perm.statistic(np.vstack([half, half]), label) == pytest.approx(0, abs=1e-12)
    base = rng.normal(size=(40, 1))
    x = np.where(label[:, None] == 1, base + rng.normal(0, 0.1, (40, 6)), rng.normal(size=(40, 6)))
    names = [f"s{k}" for k in range(40)]
    null = [perm.statistic(x, perm.hashed_labels(names, 20, d)) for d in range(99)]
    assert sum(v >= perm.statistic(x, label) for v in null) == 0
    assert perm.hashed_labels(names, 20, 3).sum() == 20
    x[:, 0] = 1
    assert math.isnan(perm.statistic(x, label)) and not perm.varying(x, label)[0]


def _planted(seed=1):
    rng = np.random.default_rng(seed)
    regs = rng.normal(size=(6, 60))
    targets = np.vstack([regs[2 * m] * 1.5 + regs[2 * m + 1] + rng.normal(0, 0.3, (20, 60)) for m in range(3)])
    return np.vstack([regs, targets]), np.array([True] * 6 + [False] * 60)


@pytest.mark.parametrize("mode", ["VBSR", "LASSO1se", "LM"])
def test_planted_modules_are_recovered(mode):
    x, is_reg = _planted()
    found = discover(x, is_reg, [f"s{k:02d}" for k in range(60)], 3, mode, 5, 0)
    truth = [set(range(20 * m, 20 * m + 20)) for m in range(3)]
    assert sorted(map(sorted, (m["targets"].tolist() for m in found))) == sorted(map(sorted, truth))
    for m in found:
        own = int(m["targets"][0]) // 20
        assert ({2 * own} if mode == "LM" else {2 * own, 2 * own + 1}) <= set(np.flatnonzero(m["beta"]))
        assert m["held_out"]["mean_corr"] > 0.8 and m["train"]["rsquare"] > 0.6


def test_small_modules_dissolve():
    x, is_reg = _planted()
    module = np.repeat([0, 1, 2], 20)
    module[0] = 3
    beta = {c: np.eye(6)[2 * min(c, 2)] for c in range(4)}
    out = reassign(x[~is_reg], module, beta, x[is_reg])
    assert min(np.bincount(out)[np.unique(out)]) >= 2
    assert len(np.unique(seed_modules(x[~is_reg], 3, 1))) == 3
    with pytest.raises(ValueError):
        regression("NONE")


def test_vbsr_options():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 40))
    y = 2 * x[:, 4] - x[:, 9] + rng.normal(0, 0.5, 150)
    assert {4, 9} <= set(screen(x, y, 0.01)) and len(screen(x, y, 0.01)) < 10
    on, beta, intercept = refit(x, y, vbsr(x, y, best_only=True))
    assert on.tolist() == [4, 9] and beta == pytest.approx([2, -1], abs=0.15) and abs(intercept) < 0.2
    best, fits, chosen = vbsr_path(x, y, np.array([-60.0, -20.0, -8.0]), orderings=3)
    assert len(fits) == 3 and set(chosen) == set(PATH_RULES) and best is fits[chosen["mean"]]
    cold = vbsr(x, y, l0=-20.0, orderings=3)
    assert fits[1].beta == pytest.approx(cold.beta, abs=1e-3)
    l0s = penalty_path(x, y, 10)
    assert len(l0s) == 10 and (np.diff(l0s) > 0).all()
    with pytest.raises(ValueError):
        vbsr_path(x, y, np.array([-20.0]), rule="max")


def test_choices_on_a_path():
    kl = np.array([5.0, 4.0, 2.0, 1.0, 3.0])
    assert choose_on_path(kl, 2.1, 1.0, "mean") == 2 and choose_on_path(kl, 2.1, 1.0, "mean_1se") == 1 and choose_on_path(kl, 2.1, 1.0, "mean_2se") == 1
    assert choose_on_path(kl, 0.0, 1.0, "min") == 3 and choose_on_path(kl, 9.0, 0.1, "mean") == 0 and choose_on_path(kl, 2.9, 0.0, "mean") in (1, 2)
    assert choose_on_path(np.array([3.0, 2.0]), 1.0, 0.0, "mean") == 1


def test_vbsr_on_an_orthonormal_design():
    """With orthogonal columns and a strong penalty, only the features of the response are in, at their least squares coefficients."""
    rng = np.random.default_rng(21)
    q, _ = np.linalg.qr(np.hstack([np.ones((64, 1)), rng.normal(size=(64, 8))]))
    x = q[:, 1:] * 8
    y = 3 * x[:, 1] - 2 * x[:, 6] + 0.05 * rng.normal(size=64)
    fit = vbsr(x, y)
    ols = x.T @ (y - y.mean()) / (x * x).sum(0)
    assert fit.beta[[1, 6]] == pytest.approx(ols[[1, 6]], rel=1e-6) and np.abs(np.delete(fit.beta, [1, 6])).max() < 0.02
    z = ols[[1, 6]] * np.sqrt((x * x).sum(0)[[1, 6]]) / np.sqrt(((y - y.mean() - x[:, [1, 6]] @ ols[[1, 6]]) ** 2).mean())
    assert fit.z[[1, 6]] == pytest.approx(z, rel=0.05)


def test_lasso_on_an_orthonormal_design():
    """Coefficients are least squares ones drawn towards zero by the penalty."""
    rng = np.random.default_rng(22)
    q, _ = np.linalg.qr(np.hstack([np.ones((64, 1)), rng.normal(size=(64, 8))]))
    x = q[:, 1:] * 8
    y = 3 * x[:, 1] - 2 * x[:, 6] + rng.normal(size=64)
    ols = x.T @ (y - y.mean()) / 64
    for place in (1, 5, 9):
        lam = float(np.quantile(lambda_path(x, y), (place - 1) / 9))
        assert regression(f"LASSOparam{place}")(x, y, 0.05, 0) == pytest.approx(np.sign(ols) * np.maximum(np.abs(ols) - lam, 0), abs=1e-6)
    assert regression("LASSOparam0")(x, y, 0.05, 0) == pytest.approx(ols, abs=1e-5)


def test_linkage_against_plain_search():
    rng = np.random.default_rng(23)
    for method, join in (("average", np.mean), ("complete", np.max)):
        d = hclust.euclidean_distance(rng.normal(size=(25, 4)))
        got = hclust.clusters_of(hclust.linkage(d, method), 25)
        groups = [frozenset([k]) for k in range(25)]
        for merged in got:
            a, b = min(((a, b) for a in groups for b in groups if a != b), key=lambda p: join([d[i, j] for i in p[0] for j in p[1]]))
            assert merged == a | b
            groups = [g for g in groups if g not in (a, b)] + [merged]
    with pytest.raises(ValueError):
        hclust.linkage(d, "single")
    hits = sum(hclust.bootstrap_hits(rng.normal(size=(30, 5)), [frozenset({0, 1})], 1.0, range(k, k + 5)) for k in (0, 5))
    assert 0 <= hits[0] <= 10


def test_tails_of_arrays():
    t, df = np.array([0.0, 1.5, -3.0, np.nan, np.inf, 40.0]), np.array([3.0, 10.5, 200.0, 5.0, 5.0, 7.0])
    got = dist.t_two_sided(t, df)
    assert got[0] == 1 and math.isnan(got[3]) and got[4] == 0
    for k in (1, 2, 5):
        grid = np.linspace(math.atan(abs(t[k]) / math.sqrt(df[k])), math.pi / 2, 200_001)
        area = np.trapezoid(np.cos(grid) ** (df[k] - 1), grid)
        assert got[k] == pytest.approx(2 * area * math.exp(math.lgamma(df[k] / 2 + 0.5) - math.lgamma(df[k] / 2) - math.lgamma(0.5)), rel=1e-6)
    z = np.array([-3.0, 0.0, 0.7, 2.5, 9.0])
    assert dist.erfc(z) == pytest.approx([math.erfc(v) for v in z], rel=1e-11)
    assert dist.spearman_tail([0.2, 0.3], [8, 20], [False, True])[1] == pytest.approx(dist.pearson_p(0.3, 20))


def test_vbsr_logistic():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 15))
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.5 * x[:, 2] - 1.2 * x[:, 7])))).astype(float)
    fit = vbsr_logistic(x, y)
    assert set(np.flatnonzero(fit.post > 0.95)) == {2, 7} and fit.beta[2] == pytest.approx(1.5, abs=0.5)
    with pytest.raises(ValueError):
        vbsr_logistic(x[:, :1] * 100, (x[:, 0] > 0).astype(float), l0=0.0)


def test_divergence_of_null_statistics_is_the_nulls():
    rng = np.random.default_rng(9)
    z = np.stack([rng.standard_normal(2000), rng.standard_normal(2000) * 2 + 1], 1)
    kl, mean, se = kl_to_null(z, 0.05, draws=200)
    assert abs(kl[0] - mean) < 4 * se and kl[1] > mean + 4 * se
    kl, mean, se = kl_to_null(z[np.abs(z[:, 0]) > 0.7][:, :1], 0.05, screened=0.5, draws=100)
    assert math.isfinite(kl[0]) and se > 0
