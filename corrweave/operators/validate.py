"""Checks of arguments, in the order in which they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.kernels.modules import regression
from corrweave.sources.adapters import ExprSet


def check_columns(df: DataFrame, **types: type) -> None:
    """The columns exist and have the types."""
    for name, kind in types.items():
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing")
        if not isinstance(df.schema[name].dataType, kind):
            raise ValueError(f"column {name!r} must be {kind.__name__}, not {df.schema[name].dataType.simpleString()}")


def check_expr(data: ExprSet) -> None:
    """Numeric values with names, genes that are there, and at least two regulators and one target."""
    check_columns(data.expr, gene=T.StringType, sample=T.StringType, value=T.NumericType)
    check_columns(data.genes, gene=T.StringType, is_regulator=T.BooleanType)
    if data.expr.where("gene is null or sample is null").limit(1).count():
        raise ValueError("every value must have a gene and a sample")
    missing = data.genes.join(data.expr.select("gene").distinct(), "gene", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"gene {missing[0]['gene']!r} is not in the matrix")
    n = data.genes.agg(F.count_if("is_regulator").alias("r"), F.count_if(~F.col("is_regulator")).alias("t")).first()
    if n["r"] < 2:
        raise ValueError("at least two regulators are needed")
    if n["t"] < 1:
        raise ValueError("at least one target is needed")


def check_modes(link_modes: list[str], graph_modes: list[str]) -> None:
    for mode in [*link_modes, *graph_modes]:
        regression(mode)


#: Messages of argument checks, in the order in which the checks are made.
NETWORK_MESSAGES = {
    "empty": "lognorm_est_counts field empty",
    "class": "matrix class is required for input dataset",
    "number": "non-numeric values inside lognorm_est_counts variable",
    "names": "null field detected in row names or column names, check lognorm_est_counts matrix",
    "targets": "target_filtered_idx field empty",
    "regulators": "regulator_filtered_idx field empty",
    "total": "the total number of genes is not equal to the sum of target_filtered_idx and regulatory_filtered_idx lengths",
}
CLIQUE_MESSAGES = {"empty": "dataset field empty", "class": "matrix or dataframe class is required", "number": "non-numeric values inside dataset variable"}
REPORT_MESSAGES = {"path": "Path to the graph object must be specified", "missing": "graph object in the specified folder must exist", "cliques": "non-logical variable pass to this cliquesbool argument"}


def check_network(expr: object, targets: list | None, regulators: list | None) -> None:
    """Arguments of a network over one matrix, in order: measurements (gene, sample, value), and names of targets and regulators that make up all genes."""
    say = NETWORK_MESSAGES
    if expr is None:
        raise ValueError(say["empty"])
    if not isinstance(expr, DataFrame):
        raise ValueError(say["class"])
    if "value" not in expr.columns or not isinstance(expr.schema["value"].dataType, T.NumericType):
        raise ValueError(say["number"])
    if not {"gene", "sample"} <= set(expr.columns) or expr.where("gene is null or sample is null").limit(1).count():
        raise ValueError(say["names"])
    if targets is None:
        raise ValueError(say["targets"])
    if regulators is None:
        raise ValueError(say["regulators"])
    if len(set(targets)) + len(set(regulators)) != expr.select("gene").distinct().count():
        raise ValueError(say["total"])


def check_cliques(expr: object) -> None:
    """The measurements of a clique search."""
    if expr is None:
        raise ValueError(CLIQUE_MESSAGES["empty"])
    if not isinstance(expr, DataFrame):
        raise ValueError(CLIQUE_MESSAGES["class"])
    if "value" not in expr.columns or not isinstance(expr.schema["value"].dataType, T.NumericType):
        raise ValueError(CLIQUE_MESSAGES["number"])


def check_report(path: str | None, exists: bool, cliques: object) -> None:
    """The arguments of a condition report: a stored module's path, whether it is there, and whether cliques are wanted."""
    if path is None:
        raise ValueError(REPORT_MESSAGES["path"])
    if not exists:
        raise ValueError(REPORT_MESSAGES["missing"])
    if not isinstance(cliques, bool):
        raise ValueError(REPORT_MESSAGES["cliques"])


def check_threshold(name: str, value: float, low: float = 0.0, high: float = 1.0) -> None:
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be a number from {low:g} to {high:g}")
