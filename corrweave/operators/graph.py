"""Bipartite and gene graphs as edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrweave.functions.dist import pearson_p_udf
from corrweave.operators.assoc import pairs, spearman_pairs


def correlations(expr: DataFrame, method: str = "pearson") -> DataFrame:
    """gene_a < gene_b, r: absolute correlations."""
    methods = {"pearson": pairs, "spearman": spearman_pairs}
    if method not in methods:
        raise ValueError(f"unknown method {method!r}")
    return methods[method](expr).select("gene_a", "gene_b", F.abs("r").alias("r"))


def neighbours(corr: DataFrame, genes: DataFrame, threshold: float) -> DataFrame:
    """gene, neighbours: genes with r above the threshold, itself included, by name."""
    strong = corr.where(F.col("r") > threshold)
    sides = strong.select(F.col("gene_a").alias("gene"), F.col("gene_b").alias("other")).unionByName(strong.select(F.col("gene_b").alias("gene"), F.col("gene_a").alias("other")))
    own = genes.select("gene", F.col("gene").alias("other"))
    return sides.unionByName(own).groupBy("gene").agg(F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("neighbours"), F.countDistinct("other").alias("n"))


def high_corr_graph(corr: DataFrame, threshold: float) -> DataFrame:
    """gene_a, gene_b, weight of the pairs above the threshold."""
    return corr.where(F.col("r") > threshold).select("gene_a", "gene_b", F.col("r").alias("weight"))


def singletons(corr: DataFrame, genes: DataFrame, threshold: float) -> DataFrame:
    """Genes in no pair above the threshold."""
    strong = corr.where(F.col("r") > threshold)
    inside = strong.select(F.col("gene_a").alias("gene")).unionByName(strong.select(F.col("gene_b").alias("gene")))
    return genes.select("gene").distinct().join(inside.distinct(), "gene", "left_anti")


def ols(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """regulator, target, n, slope, intercept, r of each target on each regulator alone."""
    x = expr.join(genes.where("is_regulator"), "gene").select(F.col("gene").alias("regulator"), "sample", F.col("value").alias("x"))
    y = expr.join(genes.where("not is_regulator"), "gene").select(F.col("gene").alias("target"), "sample", F.col("value").alias("y"))
    return x.join(y, "sample").groupBy("regulator", "target").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("x", "y").alias("r"))


def ols_edges(fits: DataFrame, fdr: float = 0.05) -> DataFrame:
    """Edges whose slope's p is below fdr / (regulators x targets); the slope's p is that of the correlation."""
    tested = fits.withColumn("p", pearson_p_udf("r", "n"))
    size = fits.agg((F.countDistinct("regulator") * F.countDistinct("target")).alias("m"))
    return tested.crossJoin(F.broadcast(size)).where(F.col("p") < fdr / F.col("m")).select("regulator", "target", F.col("slope").alias("weight"), "p")  # one row


def vertex_degree(edges: DataFrame, times: str | None = None) -> DataFrame:
    """vertex, is_regulator, degree; ``times`` is the column that says for how many edges a row stands."""
    n = F.count("*") if times is None else F.sum(times)
    r = edges.groupBy(F.col("regulator").alias("vertex")).agg(n.alias("degree")).withColumn("is_regulator", F.lit(True))
    t = edges.groupBy(F.col("target").alias("vertex")).agg(n.alias("degree")).withColumn("is_regulator", F.lit(False))
    return r.unionByName(t).select("vertex", "is_regulator", "degree")


def graphs_to_modules(edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """graph, module (a new number, by graph), regulators, targets: vertices without the dropped genes; graphs left without regulators go."""
    regs = edges.select("graph", F.col("regulator").alias("gene"), F.lit(True).alias("reg"))
    targets = edges.select("graph", F.col("target").alias("gene"), F.lit(False).alias("reg"))
    kept = regs.unionByName(targets).distinct().join(dropped.select("gene"), "gene", "left_anti")
    names = lambda of: F.array_join(F.array_sort(F.collect_set(F.when(of, F.col("gene")))), ", ")
    grouped = kept.groupBy("graph").agg(names(F.col("reg")).alias("regulators"), names(~F.col("reg")).alias("targets"), F.count_if("reg").alias("n"))
    numbered = grouped.where("n > 0").withColumn("module", F.row_number().over(W.partitionBy().orderBy("graph")))  # one row for each graph
    return numbered.select("graph", "module", "regulators", "targets")


def chosen_graphs(edges: DataFrame, prefer: str = "VBSR") -> DataFrame:
    """Edges (link_mode, graph_mode, graph, ...) of one graph mode for each link mode: the preferred one where it is among several, else the first by name."""
    modes = edges.groupBy("link_mode").agg(F.collect_set("graph_mode").alias("_modes"))
    pick = F.when(F.array_contains("_modes", prefer), F.lit(prefer)).otherwise(F.array_min("_modes"))
    return edges.join(modes.select("link_mode", pick.alias("graph_mode")), ["link_mode", "graph_mode"], "left_semi")


def ordered_weights(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Weights of given edges, 0 where the graph lacks one."""
    return wanted.join(edges.select("regulator", "target", "weight"), ["regulator", "target"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def first_seen(members: DataFrame) -> DataFrame:
    """Each gene in the first clique that has it: rows (clique_rank, pos, gene)."""
    rank = F.row_number().over(W.partitionBy("gene").orderBy("clique_rank", "pos"))
    return members.withColumn("_r", rank).where("_r = 1").drop("_r")


def assign_to_centroids(corr: DataFrame) -> DataFrame:
    """gene, cluster with the largest correlation at 7 significant digits; the first cluster on ties. Rows (gene, cluster, r)."""
    from corrweave.functions.scalar import signif

    return corr.groupBy("gene").agg(F.min_by("cluster", F.struct(-signif(F.col("r"), 7), F.col("cluster"))).alias("cluster"))


def dissolve_small(assigned: DataFrame, least: int = 2) -> DataFrame:
    """gene, cluster, dissolved: whether the gene's cluster has fewer than ``least`` genes."""
    return assigned.withColumn("dissolved", F.count("*").over(W.partitionBy("cluster")) < least)


def predictions(expr: DataFrame, programs: DataFrame) -> DataFrame:
    """module, sample, predicted: the sum of regulators' values by a module's coefficients; programs are (module, regulator, beta), and an intercept where they have that column."""
    by = programs.where("beta != 0")
    found = by.join(expr.select(F.col("gene").alias("regulator"), "sample", "value"), "regulator").groupBy("module", "sample").agg(F.sum(F.col("beta") * F.col("value")).alias("predicted"))
    if "intercept" in programs.columns:
        level = programs.groupBy("module").agg(F.max("intercept").alias("_level"))
        found = found.join(level, "module").withColumn("predicted", F.col("predicted") + F.coalesce("_level", F.lit(0.0))).drop("_level")
    return found


def residuals(expr: DataFrame, members: DataFrame, programs: DataFrame) -> DataFrame:
    """module, sample, outcome (mean of the module's genes), predicted, error."""
    outcome = expr.join(members, "gene").groupBy("module", "sample").agg(F.avg("value").alias("outcome"))
    joined = outcome.join(predictions(expr, programs), ["module", "sample"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0.0)))
    return joined.withColumn("error", F.col("outcome") - F.col("predicted"))


def module_eval(expr: DataFrame, members: DataFrame, programs: DataFrame) -> DataFrame:
    """The seven statistics of each module: n_reg, n_genes, mean_corr (absolute, of genes with the mean profile), rsquare and rsquare_adjusted (of the regulators' prediction of the profile), homogeneity, condition (0: the profile is a mean). Members are (module, gene), programs (module, regulator, beta)."""
    values = expr.join(members, "gene").select("module", "gene", "sample", "value")
    fitted = residuals(expr, members, programs)
    corr = values.join(fitted.select("module", "sample", "outcome"), ["module", "sample"]).groupBy("module", "gene").agg(F.abs(F.corr("value", "outcome")).alias("r")).groupBy("module").agg(F.count("*").alias("n_genes"), F.avg("r").alias("mean_corr"))
    fit = fitted.groupBy("module").agg(F.count("*").alias("_n"), (1 - F.sum(F.col("error") ** 2) / (F.var_pop("outcome") * F.count("*"))).alias("rsquare"))
    regs = programs.where("beta != 0").groupBy("module").agg(F.count("*").alias("n_reg"))
    a = values.select("module", "sample", F.col("gene").alias("ga"), F.col("value").alias("x"))
    b = values.select("module", "sample", F.col("gene").alias("gb"), F.col("value").alias("y"))
    within = a.join(b, ["module", "sample"]).where("ga < gb").groupBy("module", "ga", "gb").agg(F.abs(F.corr("x", "y")).alias("r")).groupBy("module").agg((2 * F.sum("r")).alias("off"))
    out = corr.join(fit, "module").join(regs, "module", "left").join(within, "module", "left").withColumn("n_reg", F.coalesce("n_reg", F.lit(0)))
    adjusted = 1 - (1 - F.col("rsquare")) * (F.col("_n") - 1) / F.nullif(F.col("_n") - F.col("n_reg"), F.lit(0))
    return out.select("module", "n_reg", "n_genes", "mean_corr", "rsquare", adjusted.alias("rsquare_adjusted"), (F.coalesce("off", F.lit(0.0)) / F.nullif((F.col("n_genes") - 1) ** 2, F.lit(0.0))).alias("homogeneity"), F.lit(0.0).alias("condition"))
