"""Reports: tables of a module, of a run, and of the evidence, as frames first and as TSV and HTML last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.operators import evidence, layout, prep, tests
from corrweave.plans import inference, pipeline
from corrweave.sources import files
from corrweave.sources.adapters import ExprSet


def first_last(names: list[str], most: int = 3) -> str:
    """A list in short: all of a short one, else its first and last names."""
    return ", ".join(names) if len(names) <= most else f"{names[0]}, ..., {names[-1]}"


def cell(counts: dict[object, int]) -> str:
    """A small frequency table in one cell: value:count, by value."""
    return " ".join(f"{k}:{v}" for k, v in sorted(counts.items()))


def contingency(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``row`` by the given values of ``column``, zero where there is none."""
    wide = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return wide.select(row, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{column}_{v}".replace("-", "minus_")) for v in values))


def clique_points(cliques: DataFrame, corr: DataFrame, variance: DataFrame) -> DataFrame:
    """component, clique, size class (2, 3, 4 or more), average variance and median correlation: the points of the clique plot."""
    member = cliques.select("component", "clique", "size", F.explode(F.split("genes", ", ")).alias("gene"))
    v = member.join(variance, "gene").groupBy("component", "clique", "size").agg(F.avg("variance").alias("avg_variance"))
    a, b = (member.select("component", "clique", F.col("gene").alias(f"gene_{s}")) for s in "ab")
    m = a.join(b, ["component", "clique"]).join(corr, ["gene_a", "gene_b"]).groupBy("component", "clique").agg(F.median("r").alias("median_r"))
    return v.join(m, ["component", "clique"]).select("component", "clique", F.least("size", F.lit(4)).alias("size_class"), "avg_variance", "median_r")


def distributions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, gene, value: what the violins show, expression t of all genes and, for each regulator, its targets' t and correlation shifts."""
    t = nodes.select(F.lit("t").alias("kind"), "gene", F.col("t_stat").alias("value"))
    own = edges.join(nodes.select(F.col("gene").alias("target"), "t_stat"), "target").select(F.lit("target_t").alias("kind"), F.col("reg").alias("gene"), F.col("t_stat").alias("value"))
    shift = edges.select(F.lit("shift").alias("kind"), F.col("reg").alias("gene"), (F.col("c0_pearson") - F.col("c1_pearson")).alias("value"))
    return t.unionByName(own).unionByName(shift)


@dataclass(frozen=True)
class ModuleReport:
    """Frames of one module, by name."""

    tables: dict[str, DataFrame]

    def write(self, folder: str) -> None:
        for name, df in self.tables.items():
            files.write_tsv(df.select(*(F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes)), f"{folder}/{name}")

    def html(self, title: str) -> str:
        return files.html_page(title, [files.to_html(df, name) for name, df in self.tables.items()])


def module_report(data: ExprSet, genes: DataFrame, mode: str = "VBSR", draws: int = 1000) -> ModuleReport:
    """Everything about one module on a (possibly new) dataset: nodes, edges, the refined module, ranks of regulators, order of genes, layout, the null of its statistic, counts."""
    nodes, edges = pipeline.summarize_module(data, genes, mode)
    values = data.expr.join(genes.select("gene"), "gene", "left_semi").withColumn("module", F.lit("module"))
    ordered, by_weight = pipeline.raw_summary(nodes, edges)
    labelled = prep.with_phenotype(data).join(genes.select("gene"), "gene", "left_semi")
    from corrweave.operators.assoc import label_correlations

    correlations = label_correlations(labelled)
    return ModuleReport(
        {
            "nodes": ordered,
            "edges": by_weight,
            "refined": pipeline.refine_module(genes, edges),
            "expression": layout.top_or_regulator(nodes, "t_p"),
            "regulators": evidence.regulator_ranking(nodes, edges),
            "correlations": correlations,
            "order": inference.gene_order(correlations, genes),
            "layout": layout.layout_phenotype(nodes),
            "distributions": distributions(nodes, edges),
            "null": inference.permutation_null(values, data.samples, draws),
            "counts": pipeline.module_counts(data, genes),
        }
    )


def evidence_report(edges: DataFrame, peaks: DataFrame, regulators: int, targets: int, bootstraps: int, rows: int = 1000) -> dict[str, DataFrame]:
    """Support of edges beside their evidence: the first edges, genes of both roles with their neighbours, cumulative and overview tables. Edges are (graph, target, regulator, weight), peaks (regulator, target, peaks); the numbers are those that the graphs could have."""
    joined = evidence.evidence_join(evidence.edge_support(edges), peaks)
    return {
        "edges": evidence.top_edges(joined, rows),
        "regulators": evidence.gene_table(joined, "regulator", bootstraps, rows=rows),
        "targets": evidence.gene_table(joined, "target", bootstraps, rows=rows),
        "cumulative": evidence.cumulative_support(joined),
        "support_by_evidence": contingency(joined, "support", "evidence", [-1, 0, 1]),
        "runs": evidence.run_overview(edges, regulators, targets, bootstraps),
        "overview": evidence.evidence_overview(peaks),
    }


def rewired_ids(values: DataFrame, samples: DataFrame, plan: tests.PermutationPlan = tests.PermutationPlan(), numbers: DataFrame | None = None) -> DataFrame:
    """Ids of the significant modules alone, without summaries: what the cache of rewired modules holds."""
    return tests.two_stage(values, samples, plan, inference.permutation_p, numbers).where("significant").select("module")
