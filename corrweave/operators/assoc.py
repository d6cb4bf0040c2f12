"""Associations between genes: Pearson, Spearman, by label, and the correlation matrix of many genes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrweave.functions.scalar import average_rank


def pairs(expr: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """gene_a < gene_b, n, r for genes measured on the same samples, within ``by``. A self-join on the sample: right for tens of genes; use ``gram_correlation`` for more."""
    by = by or []
    a = expr.select("sample", *by, F.col("gene").alias("gene_a"), F.col(value).alias("x"))
    b = expr.select("sample", *by, F.col("gene").alias("gene_b"), F.col(value).alias("y"))
    joined = a.join(b, ["sample", *by]).where(F.col("gene_a") < F.col("gene_b"))
    return joined.groupBy(*by, "gene_a", "gene_b").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def spearman_pairs(expr: DataFrame, by: list[str] | None = None) -> DataFrame:
    """As ``pairs`` over average ranks."""
    return pairs(average_rank(expr, "value", ["gene", *(by or [])]), by, "rank")


def label_difference(labelled: DataFrame) -> DataFrame:
    """gene_a, gene_b, r0, r1, diff: correlations within each label, and the difference."""
    by = pairs(labelled, ["phenotype"])
    wide = by.groupBy("gene_a", "gene_b").agg(F.max(F.when(F.col("phenotype") == 0, F.col("r"))).alias("r0"), F.max(F.when(F.col("phenotype") == 1, F.col("r"))).alias("r1"))
    return wide.withColumn("diff", F.col("r0") - F.col("r1"))


def label_correlations(labelled: DataFrame) -> DataFrame:
    """gene_a, gene_b, r (all samples), r0, r1, diff: the four correlation matrices that reports order genes by; undefined ones within a label are 0."""
    every = pairs(labelled).select("gene_a", "gene_b", "r")
    own = label_difference(labelled).select("gene_a", "gene_b", F.coalesce("r0", F.lit(0.0)).alias("r0"), F.coalesce("r1", F.lit(0.0)).alias("r1"))
    return every.join(own, ["gene_a", "gene_b"]).withColumn("diff", F.col("r0") - F.col("r1"))


def gram_correlation(vectors: DataFrame, genes: list[str], column: str = "v") -> DataFrame:
    """gene_a < gene_b, n, r from rows that hold all genes of one sample as an array.

    Tasks add up cross products, p x p numbers each, and the sums are added by row: nothing but those is shuffled,
    however many samples there are.
    """
    p = len(genes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten(), float).reshape(-1, p)
            x = np.hstack([np.ones((len(flat), 1)), flat])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.select(column).mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "s"))
    sums = parts.groupBy("i", "j").agg(F.sum("s").alias("s"))
    first = sums.where("i = 0").select(F.col("j").alias("k"), F.col("s").alias("m"))
    own = sums.where("i = j and i > 0").select(F.col("i").alias("k"), F.col("s").alias("q"))
    stats = first.join(own, "k")
    n = sums.where("i = 0 and j = 0").select(F.col("s").alias("n"))
    names = vectors.sparkSession.createDataFrame([(k + 1, g) for k, g in enumerate(genes)], "k int, gene string")
    both = sums.where("0 < i and i < j")
    for side, at in (("a", "i"), ("b", "j")):
        mine = stats.join(names, "k").select(F.col("k").alias(at), F.col("gene").alias(f"gene_{side}"), F.col("m").alias(f"m{side}"), F.col("q").alias(f"q{side}"))
        both = both.join(mine, at)
    cov = F.col("n") * F.col("s") - F.col("ma") * F.col("mb")
    scale = F.sqrt((F.col("n") * F.col("qa") - F.col("ma") ** 2) * (F.col("n") * F.col("qb") - F.col("mb") ** 2))
    return both.crossJoin(F.broadcast(n)).select("gene_a", "gene_b", F.col("n").cast("long").alias("n"), F.try_divide(cov, scale).alias("r"))  # one row
