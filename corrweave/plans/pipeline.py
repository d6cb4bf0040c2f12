"""The three top entry points: inference, rewiring, and evidence."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.functions.scalar import signif
from corrweave.operators import evidence, prep, tests, validate
from corrweave.plans import inference
from corrweave.plans.shared import materialize
from corrweave.sources.adapters import ExprSet


def preprocess(data: ExprSet, gene_variance: float = 0.25, sample_variance: float = 1.0) -> ExprSet:
    """Low-variance genes, then low-variance samples, go; roles and labels follow."""
    expr = prep.filter_samples(prep.filter_genes(data.expr, gene_variance), sample_variance)
    genes = data.genes.join(expr.select("gene").distinct(), "gene", "left_semi")
    samples = data.samples.join(expr.select("sample").distinct(), "sample", "left_semi")
    return ExprSet(expr, genes, samples)


def run_inference(data: ExprSet, link_modes: list[str], graph_modes: list[str], params: inference.DiscoveryParams = inference.DiscoveryParams(), only_modules: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Modules (link_mode, bootstrap, module, role, gene, beta, statistics) and their graphs (link_mode, graph_mode, bootstrap, module, regulator, target, weight)."""
    validate.check_expr(data)
    validate.check_modes(link_modes, graph_modes)
    modules, graphs = None, None
    for link in link_modes:
        found = materialize(inference.discover_modules(data.expr, data.genes, replace(params, mode=link)), "modules")
        tagged = found.withColumn("link_mode", F.lit(link))
        modules = tagged if modules is None else modules.unionByName(tagged)
        for mode in [] if only_modules else graph_modes:
            edges = inference.module_graphs(data.expr, found, mode, params.fdr, params.seed).withColumn("link_mode", F.lit(link)).withColumn("graph_mode", F.lit(mode))
            graphs = edges if graphs is None else graphs.unionByName(edges)
    return modules, graphs


def run_network(data: ExprSet, graph_modes: list[str], fdr: float = 0.05) -> DataFrame:
    """graph_mode, regulator, target, weight: one network over all genes for each mode."""
    validate.check_expr(data)
    validate.check_modes([], graph_modes)
    out = None
    for mode in graph_modes:
        edges = inference.target_graph(data.expr, data.genes, mode, fdr).withColumn("graph_mode", F.lit(mode))
        out = edges if out is None else out.unionByName(edges)
    return out


@dataclass(frozen=True)
class Prepared:
    """Data of labelled samples and genes that vary, modules (module, gene, role) without the others, the genes dropped, the counts of both labels, and the lines of the log."""

    data: ExprSet
    modules: DataFrame
    dropped: DataFrame
    label0: int
    label1: int
    log: list[str]


def prepare_rewiring(data: ExprSet, members: DataFrame, gene_variance: float = 0.25) -> Prepared:
    """Samples with a label, genes that vary among those, and modules of these genes that keep a regulator. Unequal labels (the smaller below 0.8 of the larger) are a warning."""
    labelled = data.samples.where(F.col("phenotype").isNotNull())
    before = data.expr.join(labelled.select("sample"), "sample", "left_semi")
    expr = materialize(prep.filter_genes(before, gene_variance), "expr")
    names = expr.select("gene").distinct()
    genes = data.genes.join(names, "gene", "left_semi")
    kept = members.join(names, "gene", "left_semi")
    if "role" in members.columns and members.where("role = 'regulator'").limit(1).count():
        kept = kept.join(kept.where("role = 'regulator'").select("module").distinct(), "module", "left_semi")
    dropped = prep.dropped_genes(before, expr)
    counts = prep.class_balance(labelled).first()
    if counts["imbalanced"]:
        warnings.warn(f"unequal numbers of samples of the two labels: {counts['n0']} and {counts['n1']} (the smaller is below 80 % of the larger)", stacklevel=2)
    n = genes.agg(F.count_if("is_regulator").alias("r"), F.count_if(~F.col("is_regulator")).alias("t")).first()
    samples = counts["n0"] + counts["n1"]
    log = [f"regulators and targets: {n['r']}, {n['t']}", f"genes dropped for their variance: {dropped.count()}", f"samples: {samples}", f"samples of each label: {counts['n0']}, {counts['n1']}"]
    return Prepared(ExprSet(expr, genes, labelled), kept, dropped, counts["n0"], counts["n1"], log)


@dataclass(frozen=True)
class ClusterProducts:
    """Tables of one cluster: multiplicity of its genes, its raw and refined nodes and edges, edges by condition, and the drivers' shares of edges in one condition only."""

    cluster: int
    multiplicity: DataFrame
    raw: tuple[DataFrame, DataFrame]
    refined: tuple[DataFrame, DataFrame]
    conditions: DataFrame
    drivers: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        nodes, edges = raw_summary(*self.raw)
        refined_nodes, refined_edges = raw_summary(*self.refined)
        return {"multiplicity": self.multiplicity, "raw_nodes": nodes, "raw_edges": edges, "refined_nodes": refined_nodes, "refined_edges": refined_edges, "conditions": self.conditions, "drivers": self.drivers}


@dataclass(frozen=True)
class Rewiring:
    """What it started from, tested modules with their statistics, overlaps of the significant ones, their clusters, and the members of each cluster."""

    prepared: Prepared
    tested: DataFrame
    overlaps: DataFrame
    clusters: DataFrame
    members: DataFrame

    def log(self) -> list[str]:
        """The lines of the preparation, and one for each cluster with its modules."""
        rows = self.clusters.where("cluster >= 0").groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("module")), "|").alias("modules")).orderBy("cluster").collect()  # one for each cluster
        return [*self.prepared.log, *(f"cluster {r['cluster']}: {r['modules']}" for r in rows)]


def module_statistics(prepared: Prepared, tested: DataFrame) -> DataFrame:
    """module, both p-values (3 significant digits), numbers and names of targets and regulators, samples, genes, samples of each label, significant; by p."""
    m = prepared.modules.select("module", "gene", "role").distinct()
    of = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("gene"))))
    named = m.groupBy("module").agg(of("target").alias("_t"), of("regulator").alias("_r"), F.countDistinct("gene").alias("num_genes"))
    p = signif(F.col("p_cheap"), 3)
    out = tested.join(named, "module").select("module", p.alias("orig_p"), F.coalesce(signif(F.col("p"), 3), p).alias("revised_p"), F.size("_t").alias("num_targets"), F.size("_r").alias("num_regulators"), F.array_join("_r", ", ").alias("regulator_names"), F.array_join("_t", ", ").alias("target_names"), F.lit(prepared.label0 + prepared.label1).alias("num_samples"), "num_genes", F.lit(prepared.label0).alias("num_label0"), F.lit(prepared.label1).alias("num_label1"), "significant")
    return out.orderBy("revised_p", "module")


def run_rewiring(data: ExprSet, members: DataFrame, plan: tests.PermutationPlan = tests.PermutationPlan(), rounds: int = 1000, compat: bool = False, gene_variance: float = 0.25) -> Rewiring:
    """Which modules' correlations depend on the label, and which of those belong together. Members are (module, gene, role)."""
    prepared = prepare_rewiring(data, members, gene_variance)
    kept, expr = prepared.modules, prepared.data.expr
    values = kept.select("module", "gene").distinct().join(expr, "gene")
    tested = materialize(tests.two_stage(values, prepared.data.samples, plan, inference.permutation_p), "tested")
    chosen = kept.join(tested.where("significant").select("module"), "module", "left_semi")
    universe = max(1, expr.select("gene").distinct().count())
    overlaps = materialize(evidence.module_overlaps(chosen, universe), "overlaps")
    clusters = materialize(inference.cluster_modules(evidence.similarity(overlaps), rounds), "clusters")
    grouped = materialize(evidence.cluster_members(chosen, clusters.where("cluster >= 0"), compat), "cluster_members")
    return Rewiring(prepared, tested, overlaps, clusters, grouped)


def cluster_products(run: Rewiring, mode: str = "VBSR", last_cluster: bool = False, cliques: DataFrame | None = None) -> list[ClusterProducts]:
    """Tables of every cluster of a run but the last (``last_cluster`` adds it): clusters are few. ``cliques`` (genes) name the drivers' correlated genes."""
    ids = sorted(r["cluster"] for r in run.members.select("cluster").distinct().collect())
    out = []
    for k in ids if last_cluster else ids[:-1]:
        members = run.members.where(F.col("cluster") == k)
        genes = members.select("gene").distinct().join(run.prepared.data.genes, "gene")
        nodes, edges = summarize_module(run.prepared.data, genes, mode)
        edges = materialize(edges, "edges")
        refined = refine_module(genes, edges)
        by = refined.agg(F.count_if("is_regulator").alias("r"), F.count_if(~F.col("is_regulator")).alias("t")).first()
        again = summarize_module(run.prepared.data, refined, mode) if by["r"] and by["t"] else (nodes.limit(0), edges.limit(0))
        own = materialize(again[1], "edges")
        drawn = lambda tag, own=own: own.where(f"{tag}_weight != 0").select(F.col("reg").alias("regulator"), "target")
        conditions = evidence.condition_xor(drawn("c0"), drawn("c1"))
        drivers = evidence.xor_summary(conditions)
        drivers = evidence.with_cliques(drivers, "driver", cliques) if cliques is not None else drivers
        multiplicity = members.groupBy("role", "multiplicity").agg(F.count("*").alias("n_genes"), F.array_join(F.array_sort(F.collect_list("gene")), ", ").alias("genes")).orderBy(F.desc("multiplicity"), "role")
        out.append(ClusterProducts(k, multiplicity, (nodes, edges), (again[0], own), conditions, drivers))
    return out


def joint_clusters(runs: dict[str, Rewiring], rounds: int = 1000) -> DataFrame:
    """module (run and module), cluster of all runs' significant modules together, over as many genes as the largest run has; -1 for modules in none."""
    members, universe = None, 1
    for name, run in sorted(runs.items()):
        chosen = run.prepared.modules.join(run.tested.where("significant").select("module"), "module", "left_semi")
        tagged = chosen.select(F.concat_ws(".", F.lit(name), F.col("module").cast("string")).alias("module"), "gene")
        members = tagged if members is None else members.unionByName(tagged)
        universe = max(universe, run.prepared.data.expr.select("gene").distinct().count())
    found = inference.cluster_modules(evidence.similarity(evidence.module_overlaps(members, universe)), rounds)
    return evidence.module_clusters(members, found)


def run_regulons(data: ExprSet, edges: DataFrame, tested: DataFrame | None = None, plan: tests.PermutationPlan = tests.PermutationPlan(), threshold: float = 0.05, test=inference.permutation_p) -> DataFrame:
    """driver, target, p, multiplicity: targets of rewired regulons.

    A regulon is a regulator with its targets in one graph, of the significant modules of ``tested`` (module,
    significant) or, without one, of all graphs. Each is tested like a module; p-values are adjusted over all (BH) and
    combined for each target of a driver (Fisher). Edges are (graph, target, regulator, weight).
    """
    if tested is not None:
        edges = edges.join(tested.where("significant").select(F.col("module").alias("graph")), "graph", "left_semi")
    found = materialize(evidence.regulons(edges).withColumn("module", F.concat_ws("\u0001", F.col("graph").cast("string"), "driver")), "regulons")
    genes = found.select("module", F.explode(F.array_append("targets", F.col("driver"))).alias("gene")).distinct()
    values = genes.join(data.expr, "gene")
    tests_of = tests.two_stage(values, data.samples, plan, test).select("module", F.coalesce("p", "p_cheap").alias("p"))
    scored = materialize(found.join(tests_of, "module").where("p is not null and not isnan(p)").select("graph", "driver", "targets", "p"), "scored")
    return evidence.filter_regulons(evidence.merge_regulons(scored), threshold)


def run_evidence(members: DataFrame, tested: DataFrame, threshold: float = 0.05, block: int = 5, cliques: DataFrame | None = None) -> DataFrame:
    """Regulators tied to rewired modules. Members are (module, bootstrap, gene, role), tested (module, significant). With ``cliques`` (genes), each is labelled with those it is correlated with."""
    flags = members.select("module", "bootstrap").distinct().join(tested.select("module", F.col("significant").alias("rewired")), "module", "left").withColumn("rewired", F.coalesce("rewired", F.lit(False)))
    scores = evidence.gene_level_scores(members, flags, block)
    if cliques is not None:
        scores = evidence.clique_labels(scores, cliques)
    return evidence.refine(scores, threshold)


def summarize_module(data: ExprSet, genes: DataFrame, mode: str = "VBSR") -> tuple[DataFrame, DataFrame]:
    """Node and edge summaries of one module, edges with the weights of the graphs over all samples and within each label. ``genes`` are (gene, is_regulator)."""
    labelled = prep.with_phenotype(data).join(genes.select("gene"), "gene", "left_semi")
    nodes = tests.with_node_p(tests.node_summary(labelled, genes))
    edges = tests.with_edge_p(tests.edge_summary(labelled, genes))
    for tag, part in (("all", labelled), ("c0", labelled.where("phenotype = 0")), ("c1", labelled.where("phenotype = 1"))):
        graph = inference.target_graph(part.select("gene", "sample", "value"), genes, mode)
        edges = edges.join(graph.select(F.col("regulator").alias("reg"), "target", F.col("weight").alias(f"{tag}_weight")), ["reg", "target"], "left").withColumn(f"{tag}_weight", F.coalesce(f"{tag}_weight", F.lit(0.0)))
    return nodes, edges


def refine_module(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """The module's genes that its full graph has."""
    drawn = edges.where("all_weight != 0")
    return genes.join(drawn.select(F.col("reg").alias("gene")).unionByName(drawn.select(F.col("target").alias("gene"))).distinct(), "gene", "left_semi")


def raw_summary(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by p, edges by weight."""
    return nodes.orderBy("t_p", "gene"), edges.orderBy("all_weight", "reg", "target")


def module_counts(data: ExprSet, genes: DataFrame) -> DataFrame:
    """Regulators, targets, samples, and samples of each label of a module."""
    roles = genes.agg(F.count_if("is_regulator").alias("regulators"), F.count_if(~F.col("is_regulator")).alias("targets"), F.count("*").alias("genes"))
    labels = data.samples.agg(F.count("*").alias("samples"), F.count_if(F.col("phenotype") == 0).alias("label0"), F.count_if(F.col("phenotype") == 1).alias("label1"))
    return roles.crossJoin(F.broadcast(labels))  # one row each
