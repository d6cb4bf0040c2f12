"""Every query with SQL against DuckDB; of every other one, what must hold of its result."""

import glob
import math
import os

import duckdb
import pytest

from corrweave import catalogue


def _norm(rows):
    def text(v):
        if v is None:
            return "null"
        if isinstance(v, (bool, int)) or hasattr(v, "as_tuple"):
            v = float(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


GENES = {f"g{k:02d}" for k in range(64)}
REGULATORS = {f"g{k:02d}" for k in range(8)}


def _is_graph(rows):
    assert rows and all(r["regulator"] in REGULATORS and r["target"] in GENES - REGULATORS and r["weight"] for r in rows)
    assert len({(r["regulator"], r["target"]) for r in rows}) == len(rows)


def _lasso_graph(rows, spark, sf):
    """A target's coefficients meet the lasso's conditions at some penalty: gradients of its edges are equal, all others smaller."""
    import numpy as np

    _is_graph(rows)
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], float)
    z = (x[:, :8] - x[:, :8].mean(0)) / x[:, :8].std(0)
    for t in {r["target"] for r in rows}:
        beta = np.zeros(8)
        for r in rows:
            if r["target"] == t:
                beta[int(r["regulator"][1:])] = r["weight"] * x[:, int(r["regulator"][1:])].std()
        y = x[:, int(t[1:])] - x[:, int(t[1:])].mean()
        grad = z.T @ (y - z @ beta) / len(y)
        on = beta != 0
        lam = np.abs(grad[on]).mean()
        assert np.allclose(grad[on], lam * np.sign(beta[on]), atol=2e-5) and (np.abs(grad[~on]) <= lam + 2e-5).all()


def _discovery(rows, spark, sf):
    """A target is in one module of a bootstrap at most, and modules have regulators with coefficients (a bootstrap whose modules have none is left out)."""
    assert len({r["bootstrap"] for r in rows}) > 3 and {r["bootstrap"] for r in rows} <= set(range(10))
    targets = [(r["bootstrap"], r["gene"]) for r in rows if r["role"] == "target"]
    assert len(targets) == len(set(targets)) and {g for _, g in targets} <= GENES - REGULATORS
    modules = {(r["bootstrap"], r["module"]) for r in rows}
    assert {(r["bootstrap"], r["module"]) for r in rows if r["role"] == "regulator" and r["beta"] and r["gene"] in REGULATORS} == modules
    assert max(m for _, m in modules) < 7


def _module_graphs(rows, spark, sf):
    """Edges lie within modules, between regulators and targets."""
    members = {(r["bootstrap"], r["module"], r["gene"]): r["role"] for r in catalogue.QUERIES["module_discovery"](spark, sf).collect()}
    assert rows and all(members[r["bootstrap"], r["module"], r["regulator"]] == "regulator" and members[r["bootstrap"], r["module"], r["target"]] == "target" for r in rows)


def _vbsr(rows, spark, sf):
    """Edges are the planted ones alone: none in data without structure but by chance, and then a strong correlation."""
    import numpy as np

    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], float)
    r = np.corrcoef(x.T)
    assert all(abs(r[int(e["regulator"][1:]), int(e["target"][1:])]) > 0.15 and np.sign(r[int(e["regulator"][1:]), int(e["target"][1:])]) == np.sign(e["weight"]) for e in rows)


def _hclust(rows, spark, sf):
    from corrweave.sources.adapters import module_members

    modules = [r["module"] for r in rows]
    assert sorted(modules) == sorted(r["module"] for r in module_members(spark, sf).select("module").distinct().collect())
    sizes = {c: sum(r["cluster"] == c for r in rows) for c in {r["cluster"] for r in rows} - {-1}}
    assert all(n >= 2 for n in sizes.values()) and sorted(sizes) == list(range(len(sizes)))


def _gene_order(rows, spark, sf):
    """Each role's genes once, and neighbours in the order are nearer than genes are on the whole."""
    import numpy as np

    x = np.zeros((64, 64))
    for r in catalogue.QUERIES["corr_difference"](spark, sf).collect():
        i, j = int(r["gene_a"][1:]), int(r["gene_b"][1:])
        x[i, j] = x[j, i] = r["diff"]
    for reg, genes in ((True, REGULATORS), (False, GENES - REGULATORS)):
        order = [r["gene"] for r in sorted(rows, key=lambda r: r["pos"]) if r["is_regulator"] == reg]
        assert sorted(order) == sorted(genes)
        at = [int(g[1:]) for g in order]
        d = np.linalg.norm(x[np.ix_(at, at)][:, None] - x[np.ix_(at, at)][None], axis=2)
        assert np.diag(d, 1).mean() < d[np.triu_indices(len(at), 1)].mean()


def _regulons(rows, spark, sf):
    """Drivers' targets by multiplicity, each pair once; targets are in as many graphs as there are tens of dimensions at most."""
    assert rows and len({(r["driver"], r["target"]) for r in rows}) == len(rows)
    assert all(r["driver"] in REGULATORS and 0 < r["p"] <= 1 and r["multiplicity"] == 1 for r in rows)


def _joint(rows, spark, sf):
    modules = {r["module"] for r in rows}
    assert len(modules) == len(rows) and {m.split(".")[0] for m in modules} <= {"w8", "w4"} and all(r["cluster"] >= -1 for r in rows)


#: What must hold of the queries that SQL cannot express.
HOLDS = {
    "lasso_graph": _lasso_graph,
    "vbsr_graph": _vbsr,
    "module_discovery": _discovery,
    "module_graphs": _module_graphs,
    "module_hclust": _hclust,
    "gene_order": _gene_order,
    "regulon_level": _regulons,
    "rewired_clusters": _joint,
}


def test_every_query_is_held_against_something():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL) | set(HOLDS)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_small, duck):
    df = catalogue.QUERIES[name](spark, sf_small)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert _norm(rows) == _norm([tuple(r[names.index(c)] for c in columns) for r in want.fetchall()])
    else:
        HOLDS[name]([dict(zip(columns, r, strict=True)) for r in rows], spark, sf_small)


def test_entry(spark, sf_small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
