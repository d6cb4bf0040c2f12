"""The data behind plots: places of vertices, clamped matrices, first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrweave.functions.dist import pearson_p_udf, t_p_udf
from corrweave.functions.scalar import signif
from corrweave.operators.prep import clamp


def _offset(row, n):
    """Evenly from -1 to 1."""
    return F.when(n > 1, -1 + 2.0 * (row - 1) / (n - 1)).otherwise(0.0)


def layout(genes: DataFrame) -> DataFrame:
    """gene, x, y: targets on the axis, regulators in turn above and below it, both evenly spread by name. A module's genes are few."""
    w = W.partitionBy("is_regulator")
    row, n = F.row_number().over(w.orderBy("gene")), F.count("*").over(w)
    placed = genes.withColumn("_row", row).withColumn("_n", n)
    y = F.when(F.col("is_regulator"), F.when(F.col("_row") % 2 == 1, 1.0).otherwise(-1.0)).otherwise(0.0)
    return placed.select("gene", "is_regulator", _offset(F.col("_row"), F.col("_n")).alias("x"), y.alias("y"))


def layout_phenotype(summary: DataFrame) -> DataFrame:
    """gene, x, y: targets in order of t at t over the largest absolute t (3 digits), regulators at 2 above and below."""
    w = W.partitionBy("is_regulator")
    row, n = F.row_number().over(w.orderBy("t_stat", "gene")), F.count("*").over(w)
    most = F.max(F.abs("t_stat")).over(w)
    placed = summary.withColumn("_row", row).withColumn("_n", n).withColumn("_most", most)
    y = F.when(F.col("is_regulator"), F.when(F.col("_row") % 2 == 1, 2.0).otherwise(-2.0)).otherwise(signif(F.try_divide("t_stat", "_most"), 3))
    return placed.select("gene", "is_regulator", _offset(F.col("_row"), F.col("_n")).alias("x"), y.alias("y"))


def heatmap(expr: DataFrame, low: float, high: float) -> DataFrame:
    """gene, sample, value within the colour limits."""
    return expr.select("gene", "sample", clamp(F.col("value"), low, high).alias("value"))


def edge_colours(edges: DataFrame) -> DataFrame:
    """Edges with a shade between 0 and 1: (w + max) / (2 max)."""
    most = edges.agg(F.max(F.abs("weight")).alias("most"))
    return edges.crossJoin(F.broadcast(most)).withColumn("shade", F.try_divide(F.col("weight") + F.col("most"), 2 * F.col("most"))).drop("most")  # one row


def top_or_regulator(summary: DataFrame, p: str, rows: int = 25) -> DataFrame:
    """The first genes by p, and all regulators."""
    first = summary.orderBy(p, "gene").limit(rows).select("gene")
    return summary.join(first.unionByName(summary.where("is_regulator").select("gene")).distinct(), "gene", "left_semi").select(*summary.columns)


def gene_pair(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """phenotype (null: all samples), n, r and its p, slope, intercept and means of two genes; and for all samples the p of both genes' t-tests between the labels."""
    x = labelled.where(F.col("gene") == a).select("sample", "phenotype", F.col("value").alias("x"))
    y = labelled.where(F.col("gene") == b).select("sample", F.col("value").alias("y"))
    both = x.join(y, "sample")
    stats = [F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")]
    for c in "xy":
        for k in (0, 1):
            only = F.when(F.col("phenotype") == k, F.col(c))
            stats += [F.avg(only).alias(f"_m{c}{k}"), (F.var_samp(only) / F.count(only)).alias(f"_e{c}{k}"), F.count(only).alias(f"_n{c}{k}")]
    found = both.groupBy("phenotype").agg(*stats).unionByName(both.agg(F.lit(None).cast(dict(labelled.dtypes)["phenotype"]).alias("phenotype"), *stats))
    for c in "xy":
        m0, m1, e0, e1, n0, n1 = (F.col(f"_{k}{c}{j}") for k in "men" for j in (0, 1))
        t = F.when(F.col("phenotype").isNull(), F.try_divide(m0 - m1, F.sqrt(e0 + e1)))
        found = found.withColumn(f"_t{c}", t).withColumn(f"_d{c}", F.try_divide((e0 + e1) ** 2, e0**2 / (n0 - 1) + e1**2 / (n1 - 1))).withColumn(f"t_p_{c}", t_p_udf(f"_t{c}", f"_d{c}"))
    return found.withColumn("r_p", pearson_p_udf("r", "n")).select("phenotype", "n", "r", "r_p", "slope", "intercept", "mean_x", "mean_y", "t_p_x", "t_p_y")


def log_bins(names: DataFrame, bins: int) -> DataFrame:
    """name, bin: names in order, in bins of equal width of their ordinals. One row for each module of a cluster."""
    row, n = F.row_number().over(W.partitionBy().orderBy("name")), F.count("*").over(W.partitionBy())
    return names.withColumn("_row", row).withColumn("_n", n).select("name", F.least(F.floor((F.col("_row") - 1) * bins / F.greatest(F.col("_n") - 1, F.lit(1))), F.lit(bins - 1)).cast("int").alias("bin"))
