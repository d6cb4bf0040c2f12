"""Filters, roles, labels, splits and scaling of long measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrweave.sources.adapters import ExprSet


def unpivot(wide: DataFrame, gene_col: str) -> DataFrame:
    """A matrix with one column for each sample, as (gene, sample, value)."""
    samples = [c for c in wide.columns if c != gene_col]
    return wide.withColumnRenamed(gene_col, "gene").unpivot("gene", samples, "sample", "value").withColumn("value", F.col("value").cast("double"))


def variance_by(expr: DataFrame, key: str) -> DataFrame:
    """Sample variance (n - 1) of each gene or sample."""
    return expr.groupBy(key).agg(F.var_samp("value").alias("variance"))


def filter_genes(expr: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Genes whose variance across samples reaches the threshold; 0 keeps all."""
    return _filter(expr, "gene", threshold)


def filter_samples(expr: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Samples whose variance across the genes that remain reaches the threshold; 0 keeps all."""
    return _filter(expr, "sample", threshold)


def _filter(expr: DataFrame, key: str, threshold: float) -> DataFrame:
    if threshold == 0:
        return expr
    return expr.join(variance_by(expr, key).where(F.col("variance") >= threshold), key, "left_semi")


def assign_roles(genes: DataFrame, regulators: DataFrame) -> DataFrame:
    """gene, is_regulator: whether the list has it."""
    known = regulators.select("gene").distinct().withColumn("_listed", F.lit(True))
    return genes.select("gene").distinct().join(known, "gene", "left").select("gene", F.col("_listed").isNotNull().alias("is_regulator"))


def encode_phenotype(samples: DataFrame, label_col: str = "label") -> DataFrame:
    """sample, phenotype: the rank of the label among the sorted labels, from 0; null stays null."""
    labels = samples.where(F.col(label_col).isNotNull()).select(label_col).distinct()
    codes = labels.withColumn("phenotype", (F.dense_rank().over(W.orderBy(label_col)) - 1).cast("int"))  # one row for each label
    return samples.join(codes, label_col, "left").select("sample", "phenotype")


def with_phenotype(data: ExprSet) -> DataFrame:
    """gene, sample, value, phenotype of samples that have a label."""
    labelled = data.samples.where(F.col("phenotype").isNotNull())
    return data.expr.join(labelled, "sample").select("gene", "sample", "value", "phenotype")


def class_balance(samples: DataFrame, least: float = 0.8) -> DataFrame:
    """Counts of both labels, the smaller over the larger, and whether that is below ``least``."""
    n0, n1 = F.count_if(F.col("phenotype") == 0), F.count_if(F.col("phenotype") == 1)
    counts = samples.agg(n0.alias("n0"), n1.alias("n1"))
    ratio = F.round(F.try_divide(F.least("n0", "n1"), F.greatest("n0", "n1")), 6)
    return counts.select("n0", "n1", ratio.alias("ratio"), (ratio < least).alias("imbalanced"))


def constant_genes(labelled: DataFrame) -> DataFrame:
    """gene, least_sd, keep: whether the standard deviation is above zero in every label."""
    by = labelled.groupBy("gene", "phenotype").agg(F.stddev_samp("value").alias("sd"))
    least = by.groupBy("gene").agg(F.min(F.coalesce("sd", F.lit(0.0))).alias("least_sd"))
    return least.withColumn("keep", F.col("least_sd") > 0)


def dropped_genes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Genes of ``before`` that ``after`` lacks."""
    return before.select("gene").distinct().join(after.select("gene").distinct(), "gene", "left_anti")


def draw_key(seed: int, draw: Column, name: Column) -> Column:
    """The text whose MD5 orders a draw: the same in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), name))


def bootstrap_split(samples: DataFrame, bootstraps: int, train_share: float = 0.8, seed: int = 1) -> DataFrame:
    """bootstrap, sample, split: the round(share x n) samples with the smallest hashes are train, the others validation."""
    spark = samples.sparkSession
    n = samples.select("sample").distinct().count()
    size = F.bround(F.lit(n) * F.lit(train_share), 0)
    draws = samples.select("sample").distinct().crossJoin(F.broadcast(spark.range(bootstraps).select(F.col("id").cast("int").alias("bootstrap"))))  # bootstraps rows
    rank = F.row_number().over(W.partitionBy("bootstrap").orderBy(draw_key(seed, F.col("bootstrap"), F.col("sample")), "sample"))
    return draws.withColumn("rank", rank).select("bootstrap", "sample", F.when(F.col("rank") <= size, "train").otherwise("validation").alias("split"))


def zscore(expr: DataFrame, by: list[str]) -> DataFrame:
    """value centred and scaled (n - 1) for each gene within ``by``; null where the deviation is zero."""
    stats = expr.groupBy("gene", *by).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return expr.join(stats, ["gene", *by]).withColumn("z", F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def clamp(column: Column, low: float, high: float) -> Column:
    """Values limited to a range."""
    return F.least(F.greatest(column, F.lit(low)), F.lit(high))


def prune(edges: DataFrame) -> DataFrame:
    """Edges with a weight: genes without one drop out of both sides."""
    return edges.where(F.col("weight") != 0)


def remap_ids(genes: DataFrame, id_map: DataFrame, from_col: str = "uniq_isos", to_col: str = "iso_gnames") -> DataFrame:
    """Names by the id map, where it has one."""
    names = id_map.select(F.col(from_col).alias("gene"), F.col(to_col).alias("_name"))
    return genes.join(names, "gene", "left").withColumn("gene", F.coalesce("_name", "gene")).drop("_name")


def pipe_field(column: Column, field: int = 6) -> Column:
    """A field of a composite id split at ``|``."""
    return F.get(F.split(column, r"\|"), F.lit(field - 1))
