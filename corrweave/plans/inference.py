"""Plans that run a numpy kernel once for each bootstrap, module, target or component.

A group is what a kernel needs whole: one bootstrap's matrix, one module's values, one component's edges. Shared
matrices are checked for size before they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corrweave.kernels import cliques as clique_kernel
from corrweave.kernels import hclust
from corrweave.kernels.lasso import dealt as lasso_folds
from corrweave.kernels.modules import discover, discover_sums, folded, regression, sums_regression
from corrweave.kernels.perm import hashed_labels, label_products, statistic, statistics_of_sums, varying
from corrweave.plans import moments
from corrweave.plans.components import connected_components
from corrweave.plans.shared import materialize

#: Numbers of a regulator matrix that may be broadcast (8 bytes each).
MAX_BROADCAST = 8_000_000


@dataclass(frozen=True)
class DiscoveryParams:
    """Modules, bootstraps, iterations of each, regression, profile of a module, share of training samples, level of the tests, seed, and whether held-out samples are left alone."""

    modules: int = 100
    bootstraps: int = 10
    iterations: int = 100
    mode: str = "VBSR"
    profile: str = "MEAN"
    train_share: float = 0.8
    fdr: float = 0.05
    seed: int = 1
    only_train: bool = False


def _matrix(pdf: pd.DataFrame, gaps: bool = False) -> tuple[np.ndarray, list[str], list[str]]:
    """Samples x genes, both in order. A regression needs every value; where ``gaps`` may be, they are NaN."""
    wide = pdf.pivot(index="sample", columns="gene", values="value").sort_index().sort_index(axis=1)
    if not gaps and wide.isna().to_numpy().any():
        raise ValueError(f"{int(wide.isna().to_numpy().sum())} of {wide.size} values of genes x samples are missing: fill them in, or leave out those genes or samples")
    return wide.to_numpy(float), list(wide.index), list(wide.columns)


def _labelled(values: DataFrame, samples: DataFrame) -> DataFrame:
    return values.select("module", "gene", "sample", "value").join(samples.where("phenotype is not null").select("sample", "phenotype"), "sample")


def _null_of(pdf: pd.DataFrame, draws: int, seed: int) -> tuple[float, np.ndarray]:
    label = pdf.drop_duplicates("sample").set_index("sample")["phenotype"]
    x, names, _ = _matrix(pdf, gaps=True)
    y = label.loc[names].to_numpy().astype(np.int8)
    x = x[:, varying(x, y)] if 0 < y.sum() < len(y) else x[:, :0]
    if x.shape[1] < 2:
        return float("nan"), np.zeros(0)
    ones = int(y.sum())
    return statistic(x, y), np.array([statistic(x, hashed_labels(names, ones, d, seed)) for d in range(draws)])


#: Digests that a task of ``_draw_sums`` finds, and samples that it multiplies at once.
TASK_DIGESTS, BLOCK_SAMPLES = 4_000_000, 2_000


def _draw_sums(labelled: DataFrame, draws: int, seed: int) -> tuple[DataFrame, list[tuple[str, int]]] | None:
    """m, sums (to be added: rows of ``statistics_of_sums``), and the module and its number of genes for each m; None where kernels get the samples.

    Labels of a draw are the same for all modules that have all samples, and a statistic needs no more than sums of
    products by label. So samples are dealt over tasks, each with the values of all modules, and nothing held grows with
    their number. For values without gaps, and where the sums are fewer numbers than those.
    """
    found = labelled.groupBy("module", "gene").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.avg("value").alias("middle"))
    sized = sorted(found.limit(MAX_BROADCAST // 100).collect(), key=lambda r: (str(r["module"]), r["gene"]))  # numbers of genes and modules, checked below
    sizes: dict = {}
    for r in sized:
        sizes[r["module"]] = sizes.get(r["module"], 0) + 1
    sums = (draws + 2) * sum((k + 1) * (k + 2) // 2 for k in sizes.values())
    if not sized or len(sized) == MAX_BROADCAST // 100 or len({r["n"] for r in sized} | {r["known"] for r in sized}) > 1 or sums >= min(sized[0]["n"] * len(sized), MAX_BROADCAST):
        return None
    at = labelled.sparkSession.createDataFrame([(r["module"], r["gene"], k) for k, r in enumerate(sized)], StructType([*labelled.select("module", "gene").schema, StructField("at", IntegerType())]))
    rows = moments.rows_of(labelled.join(F.broadcast(at), ["module", "gene"]).select("sample", "phenotype", "at", "value"), "phenotype")  # one row a gene of a module
    n = moments.complete(rows, len(sized))
    labels = rows.agg(F.count_if(F.col("phenotype") == 1).alias("ones"), F.count_if(~F.col("phenotype").isin(0, 1)).alias("others")).first()
    if n is None or labels["others"]:
        return None
    dealt = rows.select("sample", "phenotype", "v").repartition(max(1, -(-n * draws // TASK_DIGESTS)))
    last = moments.last_of_smallest(dealt, list(range(draws)), n, labels["ones"], seed)
    ends = np.cumsum([0, *sizes.values()]).tolist()
    shared = labelled.sparkSession.sparkContext.broadcast((last, np.array([r["middle"] for r in sized])))  # one row a draw, a number a gene

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, middle = shared.value
        total = None
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_SAMPLES):
                batch = whole.slice(start, BLOCK_SAMPLES)
                names = [s.encode() for s in batch.column(0).to_pylist()]
                y = np.vstack([np.asarray(batch.column(1)), *(moments.chosen(seed, d, names, cuts[d]) for d in range(draws))]).astype(float)
                x = np.asarray(batch.column(2).flatten(), float).reshape(len(names), -1) - middle
                own = [label_products(x[:, a:b], y) for a, b in zip(ends, ends[1:], strict=False)]
                total = own if total is None else [np.add(t, o, out=t) for t, o in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["m", "sums"])

    return dealt.mapInArrow(run, "m int, sums binary"), list(sizes.items())


def _per_module(values: DataFrame, samples: DataFrame, draws: int, seed: int, table: Callable, schema: str) -> DataFrame:
    """``table`` of each module, its statistic and those of the draws."""
    labelled = _labelled(values, samples)
    by_sums = _draw_sums(labelled, draws, seed)
    if by_sums is None:
        return labelled.groupBy("module").applyInPandas(lambda key, pdf: table(key[0], *_null_of(pdf, draws, seed)), schema)
    sums, modules = by_sums

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, genes = modules[int(key[0])]
        total = sum(np.frombuffer(s).reshape(draws + 2, -1) for s in pdf["sums"])
        found = statistics_of_sums(total, genes)
        return table(name, float(found[0]), found[1:])

    return sums.groupBy("m").applyInPandas(run, schema)


def permutation_p(values: DataFrame, samples: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """module, stat, p as ``operators.tests.permutation_p``, by sums over samples or one kernel for each module: right for modules of hundreds of genes. Missing values count pair by pair, as in the join."""

    def table(module, seen: float, null: np.ndarray) -> pd.DataFrame:
        null = null[np.isfinite(null)]
        p = (1 + (null >= seen * (1 - 1e-9)).sum()) / (1 + len(null)) if np.isfinite(seen) else np.nan
        return pd.DataFrame({"module": [module], "stat": [seen], "p": [p]})

    return _per_module(values, samples, draws, seed, table, "module string, stat double, p double")


def permutation_null(values: DataFrame, samples: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """module, draw, stat of each permutation; draw -1 is the observed labelling."""

    def table(module, seen: float, null: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"module": module, "draw": np.arange(-1, len(null)).astype(np.int32), "stat": [seen, *null]})

    return _per_module(values, samples, draws, seed, table, "module string, draw int, stat double")


#: Statistics of a module over one part of the samples.
STATISTICS = ("n_reg", "n_genes", "mean_corr", "rsquare", "rsquare_adjusted", "homogeneity", "condition")


def _fewer_sums(sized: list, draws: int, mode: str) -> bool:
    """Whether sums of products, of all folds of some draws, are fewer numbers than the values (rows: gene, n), and few enough for one kernel or task to hold."""
    sums = draws * (12 if folded(mode) else 2) * (len(sized) + 1) ** 2
    return sums < min(sum(r["n"] for r in sized), MAX_BROADCAST) and len({r["gene"] for r in sized}) == len(sized)


def _sample_rows(measured: DataFrame, sized: list) -> tuple[DataFrame, int]:
    """Samples as rows of the values of the genes in ``sized``, in that order, and how many they are."""
    at = measured.sparkSession.createDataFrame([(r["gene"], k) for k, r in enumerate(sized)], "gene string, at int")
    rows = moments.rows_of(measured.join(F.broadcast(at), "gene").select("sample", "at", "value"))  # one row a gene
    n = moments.complete(rows, len(sized))
    if n is None:
        raise ValueError("values of genes x samples are missing, or there more than once: fill them in, or leave out those genes or samples")
    return rows, n


def discover_modules(expr: DataFrame, genes: DataFrame, params: DiscoveryParams = DiscoveryParams()) -> DataFrame:
    """bootstrap, module, role, gene, beta (of regulators), intercept, and the seven statistics of training and held-out samples, one row for each member.

    Each bootstrap's loop of assignment and fitting is short of data and long of rounds, so it runs in one kernel, and
    bootstraps run beside each other. Where samples are many beside the genes, kernels get sums of products over them
    (``moments``; not for VBSR or the eigengene, which need the rows). Else the matrix is broadcast once if its size
    allows; a larger one is dealt to the bootstraps by a shuffle. Values must be complete.
    """
    regression(params.mode)
    spark = expr.sparkSession
    draws = spark.range(params.bootstraps).select(F.col("id").cast("int").alias("bootstrap"))
    measured = expr.join(genes, "gene").select("gene", "sample", "value", "is_regulator")
    stats = [f"{s}_{k}" for s in ("train", "held_out") for k in STATISTICS]
    columns = ["bootstrap", "module", "role", "gene", "beta", "intercept", *stats]
    schema = "bootstrap int, module int, role string, gene string, beta double, intercept double, " + ", ".join(f"{c} double" for c in stats)

    def one(bootstrap: int, x: np.ndarray, samples: list[str], gene: np.ndarray, reg: np.ndarray) -> pd.DataFrame:
        return members(bootstrap, discover(x.T, reg, samples, params.modules, params.mode, params.iterations, bootstrap, params.train_share, params.profile, params.fdr, params.seed, params.only_train), gene, reg)

    def members(bootstrap: int, found: list[dict], gene: np.ndarray, reg: np.ndarray) -> pd.DataFrame:
        rows = []
        for m in found:
            own = {"bootstrap": bootstrap, "module": m["module"], "intercept": m["intercept"], **{f"{s}_{k}": m[s][k] for s in ("train", "held_out") if s in m for k in STATISTICS}}
            rows += [{**own, "role": "target", "gene": g, "beta": np.nan} for g in gene[~reg][m["targets"]]]
            rows += [{**own, "role": "regulator", "gene": g, "beta": b} for g, b in zip(gene[reg], m["beta"], strict=True) if b]
        return pd.DataFrame(rows, columns=columns)

    def whole(pdf: pd.DataFrame) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        role = pdf.drop_duplicates("gene").set_index("gene")["is_regulator"]
        x, samples, gene = _matrix(pdf)
        return x, samples, np.array(gene), role.loc[gene].to_numpy(bool)

    sized = measured.groupBy("gene", "is_regulator").agg(F.count("*").alias("n"), F.avg("value").alias("middle")).collect()  # one row a gene
    numbers = sum(r["n"] for r in sized)
    if params.profile == "MEAN" and sums_regression(params.mode) and _fewer_sums(sized, params.bootstraps, params.mode):
        sized = sorted(sized, key=lambda r: r["gene"])
        names, reg = np.array([r["gene"] for r in sized]), np.array([r["is_regulator"] for r in sized], bool)
        rows, n = _sample_rows(measured, sized)
        size = round(params.train_share * n)
        fold = lasso_folds(size, seed=params.seed).astype(np.int8) if folded(params.mode) else None
        sums = moments.fold_sums(rows, n, np.array([r["middle"] for r in sized]), list(range(params.bootstraps)), size, params.seed, fold)

        def of_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total = moments.added(pdf["sums"].tolist(), len(names))
            if reg.sum() < 2:
                raise ValueError("at least two regulators are needed")
            found = [] if reg.all() else discover_sums(total[:-1], None if params.only_train else total[-1], reg, params.modules, params.mode, params.iterations, int(key[0]), params.fdr, params.seed)
            return members(int(key[0]), found, names, reg)

        return sums.repartition(params.bootstraps, "d").groupBy("d").applyInPandas(of_sums, schema)
    if numbers <= MAX_BROADCAST:
        shared = spark.sparkContext.broadcast(whole(measured.toPandas()))  # its size is checked above

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for bootstrap in batch["bootstrap"]:
                    yield one(int(bootstrap), *shared.value)

        return draws.repartition(params.bootstraps, "bootstrap").mapInPandas(run, schema)
    copies = measured.crossJoin(F.broadcast(draws))  # bootstraps rows
    return copies.groupBy("bootstrap").applyInPandas(lambda key, pdf: one(int(key[0]), *whole(pdf)), schema)


def _regulator_matrix(expr: DataFrame, genes: DataFrame):
    """Broadcast samples x regulators; its size is checked as it comes."""
    chosen = expr.join(genes.where("is_regulator"), "gene").select("gene", "sample", "value")
    found = chosen.limit(MAX_BROADCAST + 1).toPandas()
    if len(found) > MAX_BROADCAST:
        raise ValueError(f"more than {MAX_BROADCAST} values of regulators: they cannot be broadcast")
    return expr.sparkSession.sparkContext.broadcast(_matrix(found))


def target_graph(expr: DataFrame, genes: DataFrame, mode: str, fdr: float = 0.05, seed: int = 1) -> DataFrame:
    """regulator, target, weight: each target fitted on all regulators. A constant target, or a fit that fails, has no edges. Lasso edges carry their coefficients."""
    fit = regression(mode)
    shared = _regulator_matrix(expr, genes)
    targets = expr.join(genes.where("not is_regulator"), "gene").select(F.col("gene").alias("target"), "sample", "value")
    tests = genes.where("is_regulator").count() * genes.where("not is_regulator").count()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, samples, names = shared.value
        y = pdf.set_index("sample")["value"].reindex(samples).to_numpy(float)
        keep = np.isfinite(y) & np.isfinite(x).all(1)
        y, x = y[keep], x[keep]
        beta = fit(x, y, fdr / max(tests, 1), seed) if len(y) > 2 and y.std() > 1e-12 else np.zeros(len(names))
        on = np.flatnonzero(beta)
        return pd.DataFrame({"regulator": np.array(names, object)[on], "target": key[0], "weight": beta[on]})

    return targets.groupBy("target").applyInPandas(run, "regulator string, target string, weight double")


def module_graphs(expr: DataFrame, modules: DataFrame, mode: str, fdr: float = 0.05, seed: int = 1) -> DataFrame:
    """bootstrap, module, regulator, target, weight: in each module, each target fitted on the module's regulators; a module of one regulator gives all its targets that regulator's coefficient. Where samples are many beside the genes, modules get sums of products over them (``moments``; not for VBSR)."""
    fit, schema = regression(mode), "bootstrap int, module int, regulator string, target string, weight double"
    members = modules.select("bootstrap", "module", "role", "gene", "beta")
    by_sums = sums_regression(mode)
    used = expr.join(members.select("gene").distinct(), "gene", "left_semi")
    sized = used.groupBy("gene").agg(F.count("value").alias("n"), F.avg("value").alias("middle")).orderBy("gene").collect() if by_sums else []  # one row a gene
    if len({r["n"] for r in sized}) == 1 and _fewer_sums(sized, 1, mode):
        rows, n = _sample_rows(used, sized)
        fold = lasso_folds(n, seed=seed).astype(np.int8) if folded(mode) else None
        found = moments.fold_sums(rows, n, np.array([r["middle"] for r in sized]), [None], n, seed, fold).collect()  # one row a range of samples
        shared = expr.sparkSession.sparkContext.broadcast(moments.added([r["sums"] for r in found], len(sized))[:-1])  # its size is checked above
        at = {r["gene"]: k + 1 for k, r in enumerate(sized)}

        def of_sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf[pdf["gene"].isin(list(at))]
            regs = pdf[pdf["role"] == "regulator"].sort_values("gene")
            names, targets = regs["gene"].tolist(), sorted(set(pdf["gene"][pdf["role"] == "target"]))
            out = []
            for g in targets if names else []:
                if len(names) == 1:
                    beta = np.array([regs["beta"].iloc[0]])
                else:
                    pick = [0, *(at[r] for r in names), at[g]]
                    own = shared.value[:, pick][:, :, pick]
                    total = own.sum(0)
                    varies = total[-1, -1] / n - (total[0, -1] / n) ** 2 > 1e-24
                    beta = by_sums(own, fdr / max(len(names) * len(targets), 1)) if varies else np.zeros(len(names))
                    beta = np.where(beta != 0, 1.0, 0.0) if mode == "LM" else beta
                out += [(key[0], key[1], names[k], g, float(beta[k])) for k in np.flatnonzero(beta)]
            return pd.DataFrame(out, columns=["bootstrap", "module", "regulator", "target", "weight"])

        return members.groupBy("bootstrap", "module").applyInPandas(of_sums, schema)
    data = members.join(expr, "gene")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        regs = pdf[pdf["role"] == "regulator"]
        x, samples, names = _matrix(regs[["gene", "sample", "value"]])
        targets = {g: d.set_index("sample")["value"].reindex(samples).to_numpy(float) for g, d in pdf[pdf["role"] == "target"].groupby("gene")}
        out = []
        for g, y in targets.items():
            if len(names) == 1:
                beta = np.array([regs["beta"].iloc[0]])
            else:
                beta = fit(x, y, fdr / max(len(names) * len(targets), 1), seed) if y.std() > 1e-12 else np.zeros(len(names))
                beta = np.where(beta != 0, 1.0, 0.0) if mode == "LM" else beta
            out += [(key[0], key[1], names[k], g, float(beta[k])) for k in np.flatnonzero(beta)]
        return pd.DataFrame(out, columns=["bootstrap", "module", "regulator", "target", "weight"])

    return data.groupBy("bootstrap", "module").applyInPandas(run, schema)


def cliques(edges: DataFrame) -> DataFrame:
    """component, clique (a number within it, by size and names), size, genes: maximal cliques.

    Every vertex is a group of its own: it finds the cliques in which it comes first in order of degree, from its
    neighbours and the triangles that it is part of. So a dense component is dealt over tasks, and what a group searches
    is bounded by its later neighbours, of which a vertex has few in that order.
    """
    ends = edges.select(F.col("gene_a").alias("a"), F.col("gene_b").alias("b")).where("a != b")
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    ranked = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    later = materialize(ranked.where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))).select("a", "b"), "oriented")
    #: x before y before z, each triangle once.
    xy, xz, yz = later.toDF("x", "y"), later.toDF("x", "z"), later.toDF("y", "z")
    triangles = xy.join(xz, "x").join(yz, ["y", "z"])
    around = later.select(F.col("a").alias("v"), F.col("b").alias("p"), F.lit(None).cast("string").alias("q"), F.lit(True).alias("after"))
    before = later.select(F.col("b").alias("v"), F.col("a").alias("p"), F.lit(None).cast("string").alias("q"), F.lit(False).alias("after"))
    near = triangles.select(F.col("x").alias("v"), F.col("y").alias("p"), F.col("z").alias("q"), F.lit(None).cast("boolean").alias("after"))
    across = triangles.select(F.col("y").alias("v"), F.col("x").alias("p"), F.col("z").alias("q"), F.lit(None).cast("boolean").alias("after"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["q"].isna()
        near: dict[str, set[str]] = {v: set() for v in pdf["p"][own]}
        for p, q in zip(pdf["p"][~own], pdf["q"][~own], strict=True):
            near[p].add(q)
            near[q].add(p)
        open_ = set(pdf["p"][own & (pdf["after"] == True)])  # noqa: E712  the column has nulls
        found = list(clique_kernel.maximal_cliques(near, [key[0]], open_, set(near) - open_))
        return pd.DataFrame({"v": [key[0]] * len(found), "members": ["\x01".join(c) for c in found]}, dtype=object)

    found = around.unionByName(before).unionByName(near).unionByName(across).groupBy("v").applyInPandas(run, "v string, members string").withColumn("members", F.split("members", "\x01"))
    parts = connected_components(later, "a", "b")
    placed = found.join(parts, F.col("v") == F.col("node")).withColumn("size", F.size("members"))
    number = F.row_number().over(W.partitionBy("component").orderBy(F.desc("size"), "members")) - 1
    return placed.select("component", number.alias("clique"), "size", F.array_join("members", ", ").alias("genes"))


#: Scores that rank cliques, by name: of a clique's size, median correlation and average variance.
SELECTIONS: dict[str, Callable] = {"size": lambda s, m, v: s, "median": lambda s, m, v: m, "variance": lambda s, m, v: v, "sum": lambda s, m, v: m + v}


def select_representatives(expr: DataFrame, corr: DataFrame, threshold: float, selection: str = "size", keep: int | None = None, mandatory: list[str] | None = None) -> DataFrame:
    """rank, representative, genes: cliques by a score, each gene in the first clique that has it, genes without a neighbour last; a clique's representative is its gene of largest variance.

    With ``keep``, the first cliques by that variance stay; those with a mandatory gene always do.
    """
    from corrweave.operators.graph import first_seen, high_corr_graph, singletons
    from corrweave.operators.prep import variance_by

    if selection not in SELECTIONS:
        raise ValueError(f"unknown selection {selection!r}")
    found = cliques(high_corr_graph(corr, threshold)).select(F.concat_ws(":", "component", "clique").alias("id"), "size", F.posexplode(F.split("genes", ", ")).alias("pos", "gene"))
    var = variance_by(expr, "gene")
    a, b = found.select("id", F.col("gene").alias("gene_a")), found.select("id", F.col("gene").alias("gene_b"))
    median = a.join(b, "id").join(corr, ["gene_a", "gene_b"]).groupBy("id").agg(F.median("r").alias("m"))
    score = found.join(var, "gene").groupBy("id", "size").agg(F.avg("variance").alias("v")).join(median, "id", "left")
    ranked = score.withColumn("clique_rank", F.row_number().over(W.partitionBy().orderBy(F.desc(SELECTIONS[selection](F.col("size").cast("double"), F.coalesce("m", F.lit(0.0)), F.col("v"))), "id")))  # cliques of one matrix
    own = first_seen(found.join(ranked.select("id", "clique_rank"), "id").select("clique_rank", "pos", "gene"))
    alone = singletons(corr, expr, threshold).withColumn("clique_rank", F.lit(1 << 30) + F.row_number().over(W.partitionBy().orderBy("gene"))).withColumn("pos", F.lit(0))
    grouped = own.select("clique_rank", "gene").unionByName(alone.select("clique_rank", "gene")).join(var, "gene").groupBy("clique_rank").agg(F.max_by("gene", F.struct("variance", "gene")).alias("representative"), F.max("variance").alias("v"), F.array_sort(F.collect_list("gene")).alias("members"))
    must = F.arrays_overlap("members", F.array(*map(F.lit, mandatory))) if mandatory else F.lit(False)
    out = grouped.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(must.desc(), F.desc("v"), "representative")))
    if keep is not None:
        out = out.where((F.col("rank") <= keep) | must)
    return out.select("rank", "representative", F.array_join("members", ", ").alias("genes"))


#: Tasks that the rounds of one scale are dealt over.
BLOCKS = 8


def cluster_modules(similarity: DataFrame, rounds: int = 1000, least: float = 0.95, seed: int = 0) -> DataFrame:
    """module, cluster: average linkage of modules by the correlation of their similarities, clusters that hold up in a multiscale bootstrap; -1 for modules in none. Pairs without a row share no gene, and have a similarity of 0.

    The square matrix of modules is broadcast if its size allows, and the rounds are dealt over tasks.
    """
    spark = similarity.sparkSession
    pdf = similarity.select("m1", "m2", "score").limit(MAX_BROADCAST + 1).toPandas()
    names = sorted(set(pdf["m1"]) | set(pdf["m2"]))
    if len(pdf) > MAX_BROADCAST or len(names) ** 2 > MAX_BROADCAST:
        raise ValueError(f"a square of {len(names)} modules or more is over {MAX_BROADCAST} numbers")
    at = {m: k for k, m in enumerate(names)}
    x = np.zeros((len(names), len(names)))
    i, j = pdf["m1"].map(at).to_numpy(int), pdf["m2"].map(at).to_numpy(int)
    x[i, j] = x[j, i] = pdf["score"].to_numpy(float)
    cluster = np.full(len(names), -1)
    if len(names) > 2:
        found = hclust.clusters_of(hclust.average_linkage(hclust.correlation_distance(x)), len(names))
        shared = spark.sparkContext.broadcast((x, found))  # its size is checked above
        dealt = np.array_split(np.arange(rounds), BLOCKS)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for task in batch["id"]:
                    scale, part = divmod(int(task), BLOCKS)
                    hits = hclust.bootstrap_hits(*shared.value, hclust.SCALES[scale], dealt[part].tolist(), seed)
                    yield pd.DataFrame({"scale": scale, "k": np.arange(len(hits)), "hits": hits})

        tasks = spark.range(0, len(hclust.SCALES) * BLOCKS, 1, len(hclust.SCALES) * BLOCKS)
        hits = np.zeros((len(hclust.SCALES), len(found)))
        for r in tasks.mapInPandas(run, "scale int, k int, hits double").groupBy("scale", "k").agg(F.sum("hits").alias("n")).collect():  # scales x modules rows
            hits[r["scale"], r["k"]] = r["n"]
        tested = [(f, *hclust.approximately_unbiased(hits[:, k], rounds)) for k, f in enumerate(found)]
        for k, members in enumerate(sorted(hclust.significant_clusters(tested, least, len(names)), key=min)):
            cluster[list(members)] = k
    return spark.createDataFrame([(m, int(c)) for m, c in zip(names, cluster, strict=True)], "module string, cluster int")


def gene_order(difference: DataFrame, genes: DataFrame) -> DataFrame:
    """is_regulator, pos, gene: regulators and targets, each in the order of the leaves of the complete-linkage tree over rows of their matrix of correlation differences (gene_a, gene_b, diff), by Euclidean distance. A role's square matrix is one group."""
    roles = genes.select("gene", "is_regulator")
    a, b = roles.toDF("gene_a", "is_regulator"), roles.toDF("gene_b", "_role")
    same = difference.select("gene_a", "gene_b", "diff").join(a, "gene_a").join(b, "gene_b").where(F.col("is_regulator") == F.col("_role")).select("is_regulator", "gene_a", "gene_b", "diff")
    alone = roles.select("is_regulator", F.col("gene").alias("gene_a"), F.col("gene").alias("gene_b"), F.lit(0.0).alias("diff"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["gene_a"]) | set(pdf["gene_b"]))
        at = {m: k for k, m in enumerate(names)}
        x = np.zeros((len(names), len(names)))
        i, j = pdf["gene_a"].map(at).to_numpy(), pdf["gene_b"].map(at).to_numpy()
        x[i, j] = x[j, i] = pdf["diff"].fillna(0).to_numpy(float)
        order = hclust.leaf_order(hclust.linkage(hclust.euclidean_distance(x), "complete"), len(names))
        return pd.DataFrame({"is_regulator": bool(key[0]), "pos": np.arange(len(names), dtype=np.int32), "gene": [names[k] for k in order]})

    return same.unionByName(alone).groupBy("is_regulator").applyInPandas(run, "is_regulator boolean, pos int, gene string")
