"""Scalar and window expressions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrweave.plans.shared import materialize


def signif(x: Column, digits: int = 3) -> Column:
    """Rounded to significant digits; zero and null stay as they are."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), places)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def capped_log10(p: Column, cap: float = 300.0) -> Column:
    """-log10 of a p-value, at most ``cap``; zero gives the cap."""
    return F.when(p <= 0, F.lit(cap)).otherwise(F.least(-F.log10(p), F.lit(cap)))


#: Distinct values of a frame that one window orders; more are ordered in ranges.
RANGE_ROWS = 1_000_000


def cumulated(counts: DataFrame, value: str, by: list[str], extremes: dict[str, tuple[str, Column]] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``counts`` (by, value, c: one row for each value) with hi, the sum of c up to the value, and n, over all values.

    ``extremes`` adds, by name, the largest of an expression over smaller values and this one (``up``), or the smallest
    over this and larger ones (``down``); the expression may use hi, n and c. Without ``by``, more than ``range_rows``
    values are dealt over ranges between quantiles: each range is one window, and a table of one row a range carries
    sums and extremes from one to the next, so that no task orders everything.
    """
    bounds: list[float] = []
    if not by:
        counts = materialize(counts, "counts")
        ranges = -(-counts.count() // range_rows)
        bounds = sorted(set(counts.approxQuantile(value, [k / ranges for k in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    part = sum((F.when(F.col(value) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    ranged = counts.withColumn("_range", part)
    totals = ranged.groupBy(*by, "_range").agg(F.sum("c").alias("_c"))
    over = W.partitionBy(*by) if by else W.partitionBy()  # one row for each range
    before = over.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(over).alias("n"))
    up = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(0, W.unboundedFollowing)
    out = ranged.withColumn("_hi", F.sum("c").over(up)).join(offsets, [*by, "_range"]).withColumn("hi", F.col("_hi") + F.col("_before")).drop("_hi", "_before")
    for name, (way, form) in (extremes or {}).items():
        out = out.withColumn(name, F.max(form).over(up) if way == "up" else F.min(form).over(down))
    if bounds:
        out = materialize(out, "ranked")
        for name, (way, _) in (extremes or {}).items():
            best = out.groupBy("_range").agg((F.max(name) if way == "up" else F.min(name)).alias("_best"))
            others = W.partitionBy().orderBy("_range").rowsBetween(*((W.unboundedPreceding, -1) if way == "up" else (1, W.unboundedFollowing)))
            carried = best.select("_range", (F.max("_best") if way == "up" else F.min("_best")).over(others).alias("_best"))
            pick = F.greatest if way == "up" else F.least  # both pass over nulls
            out = out.join(F.broadcast(carried), "_range").withColumn(name, pick(name, "_best")).drop("_best")  # one row for each range
    return out.drop("_range")


def average_rank(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties at their mean, within ``by``; without ``by``, over all rows in ranges. Null values have no rank.

    Ranks over all rows are joined back by value, so the rows are written first: a sum that is added up again, in another
    order, can differ in its last digit, and would find no rank.
    """
    if by:
        order = W.partitionBy(*by).orderBy(value)
        peers = W.partitionBy(*by, value)
        rank = F.rank().over(order) + (F.count("*").over(peers) - 1) / F.lit(2.0)
        missing = F.count(F.when(F.col(value).isNull(), 1)).over(W.partitionBy(*by))  # they are ordered first
        return df.withColumn(name, F.when(F.col(value).isNotNull(), rank - missing))
    df = materialize(df, "valued")
    ranked = cumulated(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c")), value, [])
    return df.join(ranked.select(value, (F.col("hi") - (F.col("c") - 1) / F.lit(2.0)).alias(name)), value, "left").select(*df.columns, name)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 50, by its expansion beyond."""
    near = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(50)).cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
    far = F.ln(n) + F.lit(0.5772156649015329) + 1 / (2.0 * n) - 1 / (12.0 * n * n) + 1 / (120.0 * n * n * n * n)
    return F.when(n <= 50, near).otherwise(far)


def adjust_many(df: DataFrame, p: str, methods: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Multiple-testing corrections (name to method: bonferroni, holm, hochberg, BH or BY) within ``by``; nulls do not count.

    A correction depends on a p-value and on how many are smaller and as large, so it is found once for each different
    value, and joined back to the rows, which are written first (as in ``average_rank``).
    """
    by = by or []
    P, hi, n, c = F.col(p), F.col("hi"), F.col("n"), F.col("c")
    forms = {
        "bonferroni": ("up", P * n),
        "holm": ("up", P * (n - hi + c)),
        "hochberg": ("down", P * (n - hi + 1)),
        "BH": ("down", P * n / hi),
        "BY": ("down", P * n / hi * harmonic(n)),
    }
    for method in methods.values():
        if method not in forms:
            raise ValueError(f"unknown adjustment {method!r}")
    df = materialize(df, "valued")
    counts = df.where(P.isNotNull()).groupBy(*by, p).agg(F.count("*").alias("c"))
    found = cumulated(counts, p, by, {name: forms[method] for name, method in methods.items()})
    joined = df.join(found.select(*by, p, *methods), [*by, p], "left")
    return joined.select(*df.columns, *(F.when(P.isNotNull(), F.least(F.col(name), F.lit(1.0))).alias(name) for name in methods))


def adjust_p(df: DataFrame, p: str, method: str = "BH", name: str = "adjusted", by: list[str] | None = None) -> DataFrame:
    """One correction, as ``adjust_many``."""
    return adjust_many(df, p, {name: method}, by)


def fisher_combined(ps: Column) -> Column:
    """Fisher's combined p of an array of p-values: the chi-square tail has an even number of degrees, so its sum is finite."""
    half = -F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.ln(p))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(ps) - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, k: F.struct((a["t"] * half / k).alias("t"), (a["s"] + F.when(k < F.size(ps), a["t"] * half / k).otherwise(0.0)).alias("s")),
        lambda a: a["s"],
    )
    return F.when(F.exists(ps, lambda p: p <= 0), 0.0).when(F.size(ps) == 0, None).otherwise(F.exp(-half) * terms)


def fisher_tail(half: Column, n: Column) -> Column:
    """Fisher's combined p from minus the sum of the logarithms of n p-values; null for none."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)).cast("int")),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, k: F.struct((a["t"] * half / k).alias("t"), (a["s"] + F.when(k < n, a["t"] * half / k).otherwise(0.0)).alias("s")),
        lambda a: a["s"],
    )
    return F.when(n == 0, None).otherwise(F.exp(-half) * terms)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """((c + .5) / (d + .5)) / ((a + .5) / (b + .5))"""
    return ((c + 0.5) / (d + 0.5)) / ((a + 0.5) / (b + 0.5))
