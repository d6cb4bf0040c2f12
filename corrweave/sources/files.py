"""Readers and writers of matrices, tables, results and reports."""

from __future__ import annotations

import html
import logging
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.operators.prep import unpivot
from corrweave.sources.adapters import ExprSet

#: Rows that a report page may show; larger tables are written as TSV.
MAX_REPORT_ROWS = 10_000


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", gene_col: str | None = None) -> DataFrame:
    """A text matrix with a header and gene names in the first column (or ``gene_col``), as (gene, sample, value). Values that are not numbers are an error."""
    header = spark.read.option("sep", sep).option("header", True).csv(path)
    name = gene_col or header.columns[0]
    long = header.withColumnRenamed(name, "gene").unpivot("gene", [c for c in header.columns if c != name], "sample", "_text")
    return long.select("gene", "sample", F.col("_text").cast("double").alias("value"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = "\t") -> DataFrame:
    """A text table with a header; without a schema all columns are text."""
    reader = spark.read.option("sep", sep).option("header", True)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_evidence(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A regulator x target matrix of peak counts (-1 unknown) as (regulator, target, peaks)."""
    long = read_matrix(spark, path, sep)
    return long.select(F.col("gene").alias("regulator"), F.col("sample").alias("target"), F.col("value").cast("int").alias("peaks"))


def read_annotated(assays: DataFrame, row_data: DataFrame, col_data: DataFrame, assay: int = 1, regulator_col: str = "regulator", phenotype_col: str | None = "phenotype") -> ExprSet:
    """One assay of an annotated container: assays (assay, gene, sample, value), row_data (gene, a regulator flag), col_data (sample, a label)."""
    expr = assays.where(F.col("assay") == assay).select("gene", "sample", "value")
    genes = row_data.select("gene", (F.col(regulator_col).cast("int") == 1).alias("is_regulator"))
    label = F.col(phenotype_col).cast("int") if phenotype_col else F.lit(None).cast("int")
    return ExprSet(expr.join(genes, "gene", "left_semi"), genes, col_data.select("sample", label.alias("phenotype")))


def vectors(expr: DataFrame) -> DataFrame:
    """sample, v: values of all genes in order of their names, for ``gram_correlation``."""
    return expr.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("gene", "value"))).alias("_v")).select("sample", F.transform("_v", lambda s: s["value"]).alias("v"))


def transcription_factors(atlas: DataFrame, class_col: str = "protein_class") -> DataFrame:
    """gene and whether its class list names transcription factors."""
    return atlas.withColumn("regulator", F.array_contains(F.split(class_col, ", "), "Transcription factors").cast("int"))


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a result as Parquet and read it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cache_path(path: str, threshold: float) -> str:
    """The cache's name: the path without a three-letter ending, and the threshold."""
    return re.sub(r"\..{3}$", "", path) + f"_fs_{threshold:g}"


def cached(spark: SparkSession, path: str, threshold: float, compute: Callable[[], DataFrame]) -> DataFrame:
    """A result from its cache, or computed and cached."""
    where = cache_path(path, threshold)
    folder = spark._jvm.org.apache.hadoop.fs.Path(where)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")):
        return load(spark, where)
    return save(compute(), where)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, with a header, without quotes."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "NA").csv(path)


def to_html(df: DataFrame, title: str = "", rows: int = MAX_REPORT_ROWS) -> str:
    """A table as HTML; a report's tables are small, and a larger one is refused."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows; write them as TSV")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in found)
    return f"<h2>{html.escape(title)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def html_page(title: str, parts: list[str]) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{"".join(parts)}</body></html>'


def index_page(title: str, links: dict[str, str]) -> str:
    """A page of links, name to address."""
    items = "".join(f'<li><a href="{html.escape(a, quote=True)}">{html.escape(n)}</a></li>' for n, a in links.items())
    return html_page(title, [f"<ul>{items}</ul>"])


def log_to(path: str) -> logging.Logger:
    """A logger that appends to a file."""
    logger = logging.getLogger(f"corrweave.{path}")
    if not logger.handlers:
        logger.addHandler(logging.FileHandler(path))
        logger.setLevel(logging.INFO)
    return logger
