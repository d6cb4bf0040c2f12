"""Statistical tests and summaries of genes, edges and modules."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrweave.functions.dist import pearson_p_udf, spearman_p_udf, t_p_udf, wilcoxon_p_udf
from corrweave.functions.scalar import average_rank
from corrweave.plans.shared import materialize


def node_summary(labelled: DataFrame, genes: DataFrame) -> DataFrame:
    """For each gene: role, means (all, label 0, label 1), their difference (label 0 less label 1), Welch's t with its degrees, the rank-sum statistic, and how often its commonest value occurs."""
    ranked = average_rank(labelled, "value", ["gene"])
    is0, is1 = F.col("phenotype") == 0, F.col("phenotype") == 1
    stats = ranked.groupBy("gene").agg(
        F.avg("value").alias("avg_all"),
        F.avg(F.when(is0, F.col("value"))).alias("avg0"),
        F.avg(F.when(is1, F.col("value"))).alias("avg1"),
        F.var_samp(F.when(is0, F.col("value"))).alias("v0"),
        F.var_samp(F.when(is1, F.col("value"))).alias("v1"),
        F.count_if(is0).alias("n0"),
        F.count_if(is1).alias("n1"),
        F.sum(F.when(is0, F.col("rank"))).alias("r0"),
    )
    counts = labelled.groupBy("gene", "value").agg(F.count("*").alias("c"), F.count_if(is0).alias("c0"), F.count_if(is1).alias("c1"))
    repeats = counts.groupBy("gene").agg(F.max("c").alias("repeats_all"), F.max("c0").alias("repeats0"), F.max("c1").alias("repeats1"), F.sum(F.col("c") ** 3 - F.col("c")).alias("tie_sum"))
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = F.try_divide(F.col("avg0") - F.col("avg1"), F.sqrt(e0 + e1))
    df = F.try_divide((e0 + e1) ** 2, e0**2 / (F.col("n0") - 1) + e1**2 / (F.col("n1") - 1))
    out = stats.join(repeats, "gene").join(genes, "gene")
    return out.select("gene", "is_regulator", "avg_all", "avg0", "avg1", (F.col("avg0") - F.col("avg1")).alias("avg_diff"), t.alias("t_stat"), df.alias("t_df"), (F.col("r0") - F.col("n0") * (F.col("n0") + 1) / 2).alias("wilcox_stat"), "n0", "n1", "repeats_all", "repeats0", "repeats1", "tie_sum")


def with_node_p(summary: DataFrame) -> DataFrame:
    """p-values of the t and rank-sum statistics of ``node_summary``."""
    return summary.withColumn("t_p", t_p_udf("t_stat", "t_df")).withColumn("wilcox_p", wilcoxon_p_udf("wilcox_stat", "n0", "n1", "tie_sum"))


def edge_summary(labelled: DataFrame, genes: DataFrame) -> DataFrame:
    """reg, target, and n, Pearson and Spearman correlations, and whether either gene has ties, over all samples and within each label.

    Regulators meet targets on their samples once, and every statistic is an aggregate of that join.
    """
    ranked = average_rank(average_rank(labelled, "value", ["gene"], "rank_all"), "value", ["gene", "phenotype"], "rank_own")
    is0, is1 = F.col("phenotype") == 0, F.col("phenotype") == 1
    counts = labelled.groupBy("gene", "value").agg(F.count("*").alias("all"), F.count_if(is0).alias("c0"), F.count_if(is1).alias("c1"))
    tied = counts.groupBy("gene").agg(*((F.max(c) > 1).alias(c) for c in ("all", "c0", "c1")))
    roles = genes.select("gene", "is_regulator").join(tied, "gene")
    regs = ranked.join(genes.where("is_regulator").select("gene"), "gene", "left_semi").select("sample", "phenotype", F.col("gene").alias("reg"), F.col("value").alias("xv"), F.col("rank_all").alias("xa"), F.col("rank_own").alias("xo"))
    targets = ranked.join(genes.where("not is_regulator").select("gene"), "gene", "left_semi").select("sample", F.col("gene").alias("target"), F.col("value").alias("yv"), F.col("rank_all").alias("ya"), F.col("rank_own").alias("yo"))
    stats = [F.count("*").alias("all_n"), F.corr("xv", "yv").alias("all_pearson"), F.corr("xa", "ya").alias("all_spearman")]
    for tag, of in (("c0", is0), ("c1", is1)):
        only = lambda c, of=of: F.when(of, F.col(c))
        stats += [F.count_if(of).alias(f"{tag}_n"), F.corr(only("xv"), only("yv")).alias(f"{tag}_pearson"), F.corr(only("xo"), only("yo")).alias(f"{tag}_spearman")]
    both = regs.join(targets, "sample").groupBy("reg", "target").agg(*stats)
    ties = [roles.select(F.col("gene").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("all", "c0", "c1"))) for side in ("reg", "target")]
    named = both.join(ties[0], "reg").join(ties[1], "target")
    return named.select("reg", "target", *(c for tag in ("all", "c0", "c1") for c in (f"{tag}_n", f"{tag}_pearson", f"{tag}_spearman", (F.col(f"reg_{tag}") | F.col(f"target_{tag}")).alias(f"{tag}_ties"))))


def with_edge_p(summary: DataFrame) -> DataFrame:
    """p-values of all correlations of ``edge_summary``; a rank correlation's way depends on its own ties."""
    for tag in ("all", "c0", "c1"):
        summary = summary.withColumn(f"{tag}_pearson_p", pearson_p_udf(f"{tag}_pearson", f"{tag}_n")).withColumn(f"{tag}_spearman_p", spearman_p_udf(f"{tag}_spearman", f"{tag}_n", f"{tag}_ties"))
    return summary


#: ln k! for k below 10, where the series is not exact enough.
_SMALL = [math.lgamma(k + 1) for k in range(10)]


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series; looked up for n below 10."""
    x = n.cast("double")
    z = 1 / (x * x)
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x
    return F.when(n < 10, F.element_at(F.array(*map(F.lit, _SMALL)), F.greatest(F.least(n, F.lit(9)), F.lit(0)).cast("int") + 1)).otherwise(series)


def fisher_p(df: DataFrame, a: str, b: str, c: str, d: str, tail: str, name: str) -> DataFrame:
    """One-sided p of a 2 x 2 table by the hypergeometric tail; a table with an empty margin has p = 1. No table is too large: factorials are expressions.

    Terms are added from the table's own outwards, away from the mode, each by its ratio to the one before: those of the
    tail, or of the other tail where the table lies on the near side of the mode. Ratios fall from 1 or less, the k-th by
    exp(-k r) at least, r the sum of inverses of the counts that shrink; so beyond sqrt(120 / r) + 2 terms each one is
    below e^-60 of the first, and none of them can change a double. Terms grow with the root of the table.
    """
    if tail not in ("greater", "less"):
        raise ValueError(f"unknown tail {tail!r}")
    A, B, C, D = (F.col(x).cast("long") for x in (a, b, c, d))
    sums = {"_cell": A, "_row": A + B, "_column": A + C, "_total": A + B + C + D}
    out = df.select("*", *(v.alias(k) for k, v in sums.items()))
    x0, row, col, n = (F.col(k) for k in sums)
    lf = log_factorial
    out = out.withColumn("_low", F.greatest(F.lit(0), row + col - n)).withColumn("_high", F.least(row, col)).withColumn("_fixed", lf(row) + lf(n - row) + lf(col) + lf(n - col) - lf(n))
    low, high = F.col("_low"), F.col("_high")

    def reach(one: Column, other: Column) -> Column:
        """Terms that count, where two counts shrink with each."""
        return (F.sqrt(120.0 / (1.0 / F.greatest(one, F.lit(1)) + 1.0 / F.greatest(other, F.lit(1)))) + 2).cast("long")

    def outwards(start: Column, up: bool) -> Column:
        """Sum of the terms from ``start`` to the end of its side; 0 beyond the end."""
        first = F.exp(F.col("_fixed") - lf(start) - lf(row - start) - lf(col - start) - lf(n - row - col + start))
        if up:
            inside, more = start <= high, start < high
            steps = F.when(more, F.sequence(start, F.least(high - 1, start + reach(row - start, col - start)), F.lit(1).cast("long")))
            ratio = lambda x: (row - x).cast("double") * (col - x) / ((x + 1).cast("double") * (n - row - col + x + 1))
        else:
            inside, more = start >= low, start > low
            steps = F.when(more, F.sequence(start, F.greatest(low + 1, start - reach(start, n - row - col + start)), F.lit(-1).cast("long")))
            ratio = lambda x: x.cast("double") * (n - row - col + x) / ((row - x + 1).cast("double") * (col - x + 1))
        relative = F.aggregate(
            F.coalesce(steps, F.array().cast("array<bigint>")),
            F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
            lambda acc, x: F.struct((acc["t"] * ratio(x)).alias("t"), (acc["s"] + acc["t"] * ratio(x)).alias("s")),
            lambda acc: acc["s"],
        )
        return F.when(inside, first * relative).otherwise(0.0)

    mode = F.floor((row + 1).cast("double") * (col + 1) / (n + 2))
    up = tail == "greater"
    near = x0 <= mode if up else x0 >= mode
    p = F.when(near, 1.0 - outwards(x0 - 1 if up else x0 + 1, not up)).otherwise(outwards(x0, up))
    return out.withColumn(name, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).drop(*sums, "_low", "_high", "_fixed")


def module_correlations(values: DataFrame, by: list[str]) -> DataFrame:
    """by, module, gene_a < gene_b, r within each group of ``by``; values are (module, gene, sample, value) with ``by``."""
    a = values.select("module", "sample", *by, F.col("gene").alias("gene_a"), F.col("value").alias("x"))
    b = values.select("module", "sample", *by, F.col("gene").alias("gene_b"), F.col("value").alias("y"))
    joined = a.join(b, ["module", "sample", *by]).where(F.col("gene_a") < F.col("gene_b"))
    return joined.groupBy("module", *by, "gene_a", "gene_b").agg(F.corr("x", "y").alias("r"))


def rewiring_statistic(values: DataFrame, draw: list[str] | None = None) -> DataFrame:
    """module, stat: the sum over both triangles of squared differences of the correlations within the two labels; genes constant in a label must be gone before."""
    draw = draw or []
    r = module_correlations(values, [*draw, "phenotype"])
    wide = r.groupBy("module", *draw, "gene_a", "gene_b").agg(F.max(F.when(F.col("phenotype") == 0, F.col("r"))).alias("r0"), F.max(F.when(F.col("phenotype") == 1, F.col("r"))).alias("r1"))
    return wide.groupBy("module", *draw).agg((2 * F.sum((F.col("r0") - F.col("r1")) ** 2)).alias("stat"))


def permuted_labels(samples: DataFrame, draws: int, seed: int = 1, first: int = 0) -> DataFrame:
    """draw, sample, phenotype: as many samples with label 1 as observed, chosen by the smallest hashes."""
    spark = samples.sparkSession
    labelled = samples.where(F.col("phenotype").isNotNull())
    ones = labelled.where(F.col("phenotype") == 1).count()
    grid = labelled.select("sample").crossJoin(F.broadcast(spark.range(first, first + draws).select(F.col("id").cast("int").alias("draw"))))  # draws rows
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("sample")))
    rank = F.row_number().over(W.partitionBy("draw").orderBy(hashed, "sample"))
    return grid.withColumn("_r", rank).select("draw", "sample", F.when(F.col("_r") <= ones, 1).otherwise(0).alias("phenotype"))


@dataclass(frozen=True)
class PermutationPlan:
    """Permutations of the cheap and of the thorough stage, the p below which a module is tested again, the threshold, whether a p of exactly 1 counts as significant (as some published results do), and a number: modules whose own number it divides are tested again whatever their p (none by default)."""

    cheap: int = 100
    thorough: int = 1000
    retest_below: float = 0.08
    threshold: float = 0.05
    compat: bool = False
    every: int | None = None


def permutation_p(values: DataFrame, samples: DataFrame, draws: int, seed: int = 1) -> DataFrame:
    """module, stat, p: the share of statistics, the observed one included, that reach the observed one within 1e-9 of it. Null statistics are skipped."""
    observed = rewiring_statistic(values.join(samples.where("phenotype is not null"), "sample"))
    drawn = rewiring_statistic(values.join(permuted_labels(samples, draws, seed), "sample"), ["draw"])
    return _p_of(observed, drawn)


def _p_of(observed: DataFrame, drawn: DataFrame) -> DataFrame:
    hits = drawn.select("module", F.col("stat").alias("drawn")).join(observed, "module").where(F.col("drawn").isNotNull())
    counted = hits.groupBy("module").agg(F.count_if(F.col("drawn") >= F.col("stat") * (1 - 1e-9)).alias("k"), F.count("*").alias("n"))
    return observed.join(counted, "module", "left").select("module", "stat", ((F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 1)).alias("p"))


def two_stage(values: DataFrame, samples: DataFrame, plan: PermutationPlan = PermutationPlan(), test=permutation_p, numbers: DataFrame | None = None) -> DataFrame:
    """module, p_cheap, p, significant: modules whose cheap p is small are tested again with more permutations. ``numbers`` (module, number) is for ``plan.every``."""
    first = materialize(test(values, samples, plan.cheap).select("module", F.col("p").alias("p_cheap")), "first")
    again: Column = F.col("p_cheap") < plan.retest_below
    if plan.compat:
        again = again | (F.col("p_cheap") == 1)
    chosen = first.where(again).select("module")
    if plan.every and numbers is not None:
        chosen = chosen.unionByName(numbers.where(F.col("number") % plan.every == 0).select("module")).distinct()
    second = test(values.join(chosen, "module", "left_semi"), samples, plan.thorough).select("module", "p")
    significant = F.col("p") <= plan.threshold
    if plan.compat:
        significant = significant | (F.col("p") == 1)
    return first.join(second, "module", "left").select("module", "p_cheap", "p", F.coalesce(significant, F.lit(False)).alias("significant"))
