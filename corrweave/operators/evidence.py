"""Evidence over many modules: overlaps, enrichment of regulators, regulons, multiplicity, edges and their support.

Members are (module, bootstrap, gene, role); edges are (graph, target, regulator, weight).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corrweave.functions.dist import t_p_udf
from corrweave.functions.scalar import adjust_p, average_rank, capped_log10, fisher_combined, fisher_tail, odds_ratio, signif
from corrweave.operators.tests import fisher_p
from corrweave.plans.shared import materialize


#: Modules whose pairs a task counts in one matrix.
MAX_MODULES = 2_000


def module_overlaps(members: DataFrame, universe: int, disjoint: bool = False) -> DataFrame:
    """m1 <= m2, the cells of their 2 x 2 table over ``universe`` genes, and the one-sided p of their overlap.

    Up to ``MAX_MODULES`` modules are bits of their genes, and pairs are counted by products of those. More meet through
    the genes that they share. ``disjoint`` adds the pairs that share none, whose p is 1: for a table that shows every pair.
    """
    sets = members.select("module", "gene").distinct()
    names = sorted(r["module"] for r in sets.where("module is not null").select("module").distinct().limit(MAX_MODULES + 1).collect())
    if names and len(names) <= MAX_MODULES:
        place = sets.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], StructType([sets.schema["module"], StructField("graph", IntegerType())]))
        return overlaps_of_bits(materialize(gene_bits(sets.join(F.broadcast(place), "module"), len(names)), "bits"), names, universe, disjoint)  # its size is checked above
    count = sets.groupBy("module").agg(F.count("*").alias("size"))
    both = sets.select(F.col("module").alias("m1"), "gene").join(sets.select(F.col("module").alias("m2"), "gene"), "gene").where("m1 <= m2").groupBy("m1", "m2").agg(F.count("*").alias("a"))
    s1, s2 = count.select(F.col("module").alias("m1"), F.col("size").alias("s1")), count.select(F.col("module").alias("m2"), F.col("size").alias("s2"))
    if disjoint:
        sized = s1.join(s2, F.col("m1") <= F.col("m2")).join(both, ["m1", "m2"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
    else:
        sized = both.join(s1, "m1").join(s2, "m2")
    return _tested(sized, universe)


def _tested(sized: DataFrame, universe: int) -> DataFrame:
    cells = sized.select("m1", "m2", "a", (F.col("s1") - F.col("a")).alias("b"), (F.col("s2") - F.col("a")).alias("c"), (F.lit(universe) - F.col("s1") - F.col("s2") + F.col("a")).alias("d"))
    return fisher_p(cells, "a", "b", "c", "d", "greater", "p")


def _bits(graphs: int) -> list[Column]:
    """Columns w0, w1, ...: the numbers in column ``graph`` as bits, 64 a column, for an aggregate."""
    bit = F.expr("shiftleft(1L, graph % 64)")
    return [F.bit_or(F.when(F.expr("graph div 64") == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(-(-graphs // 64))]


def gene_bits(members: DataFrame, graphs: int) -> DataFrame:
    """gene, w0, w1, ...: the modules (graph, a number below ``graphs``) of each gene."""
    return members.groupBy("gene").agg(*_bits(graphs))


def overlaps_of_bits(bits: DataFrame, names: list, universe: int, disjoint: bool = False) -> DataFrame:
    """``module_overlaps`` from ``gene_bits``, whose numbers are places in ``names``, which is sorted. A task adds up one square of modules, whatever its genes."""
    m = len(names)
    words = [f"w{w}" for w in range(-(-m // 64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for batch in batches:
            packed = np.stack([np.asarray(c, np.int64) for c in batch.columns], 1).astype("<i8")
            for start in range(0, len(packed), 4096):
                on = np.unpackbits(packed[start : start + 4096].copy().view(np.uint8), axis=1, bitorder="little")[:, :m].astype(np.float32)
                total += on.T @ on
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m), pa.int32()), pa.array(list(total.astype(np.int64)), pa.list_(pa.int64()))], ["i", "row"])

    parts = bits.where("gene is not null").select(*words).mapInArrow(run, "i int, row array<bigint>").select("i", F.posexplode("row").alias("j", "a")).where("i <= j")
    shared = materialize(parts.groupBy("i", "j").agg(F.sum("a").alias("a")), "shared")
    size = shared.where("i = j")
    s1, s2 = size.select("i", F.col("a").alias("s1")), size.select("j", F.col("a").alias("s2"))
    kind = bits.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], ["m", "k"]) if not isinstance(names[0], str) else bits.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], "m string, k int")
    named = shared.join(F.broadcast(s1.where("s1 > 0")), "i").join(F.broadcast(s2.where("s2 > 0")), "j")  # one row a module, as below
    for at, name in (("i", "m1"), ("j", "m2")):
        named = named.join(F.broadcast(kind.select(F.col("k").alias(at), F.col("m").alias(name))), at)
    return _tested(named if disjoint else named.where("a > 0"), universe)


def similarity(overlaps: DataFrame) -> DataFrame:
    """m1, m2, score: -log10 p to three significant digits, at most 300."""
    return overlaps.select("m1", "m2", F.least(signif(capped_log10(F.col("p")), 3), F.lit(300.0)).alias("score"))


def _tables(members: DataFrame, flags: DataFrame, group: Column) -> DataFrame:
    """regulator, grp, and the cells absent / present x plain / rewired of all regulators in all groups, zero counts included."""
    grouped = flags.select("module", group.alias("grp"), "rewired")
    totals = grouped.groupBy("grp").agg(F.count_if("rewired").alias("rewired_all"), F.count_if(~F.col("rewired")).alias("plain_all"))
    regs = members.where("role = 'regulator'").select("module", F.col("gene").alias("regulator")).distinct()
    has = regs.join(grouped, "module").groupBy("regulator", "grp").agg(F.count_if("rewired").alias("d"), F.count_if(~F.col("rewired")).alias("c"))
    grid = regs.select("regulator").distinct().crossJoin(F.broadcast(totals))  # one row for each group of bootstraps
    full = grid.join(has, ["regulator", "grp"], "left").select("regulator", "grp", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("d", F.lit(0)).alias("d"), "plain_all", "rewired_all")
    return full.select("regulator", "grp", (F.col("plain_all") - F.col("c")).alias("a"), (F.col("rewired_all") - F.col("d")).alias("b"), "c", "d")


def regulator_enrichment(members: DataFrame, flags: DataFrame, group: Column) -> DataFrame:
    """regulator, grp, the cells, one-sided p and odds ratio: is a regulator's presence tied to rewired modules?"""
    cells = _tables(members, flags, group)
    # rows: absent, present; columns: plain, rewired. Enrichment makes a small and b large, or d large: the lower tail of b.
    tested = fisher_p(cells.withColumnsRenamed({"a": "_a", "b": "_b", "c": "_c", "d": "_d"}), "_b", "_a", "_d", "_c", "less", "p")
    return tested.select("regulator", "grp", F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_c").alias("c"), F.col("_d").alias("d"), "p", odds_ratio(F.col("_b"), F.col("_a"), F.col("_d"), F.col("_c")).alias("odds_ratio"))


def gene_level_scores(members: DataFrame, flags: DataFrame, block: int = 5) -> DataFrame:
    """regulator, and p and odds ratio by single bootstraps (combined), over all, and by blocks of bootstraps (combined)."""
    out = None
    for tag, group in (("one", F.col("bootstrap")), ("all", F.lit(0)), ("block", F.floor(F.col("bootstrap") / block))):
        each = regulator_enrichment(members, flags, group)
        mine = each.groupBy("regulator").agg(fisher_combined(F.array_sort(F.collect_list("p"))).alias(f"p_{tag}"), F.avg("odds_ratio").alias(f"or_{tag}"))
        out = mine if out is None else out.join(mine, "regulator")
    return out


def refine(scores: DataFrame, threshold: float) -> DataFrame:
    """Regulators with a p below the threshold in any grouping, in order of the p over all bootstraps."""
    return scores.where(F.least("p_one", "p_all", "p_block") < threshold).orderBy("p_all", "regulator")


def clique_members(cliques: DataFrame) -> DataFrame:
    """gene, others: for each gene of disjoint cliques (genes, joined by commas) the other genes of its clique, in their order."""
    split = cliques.select(F.split("genes", ", ").alias("all"))
    return split.select(F.explode("all").alias("gene"), "all").select("gene", F.filter("all", lambda g: g != F.col("gene")).alias("others"))


def with_cliques(table: DataFrame, gene_col: str, cliques: DataFrame, name: str = "cliques") -> DataFrame:
    """A table of drivers with the other members of each one's clique, joined by commas; none is an empty text."""
    others = clique_members(cliques).select(F.col("gene").alias(gene_col), F.array_join("others", ", ").alias(name))
    return table.join(others, gene_col, "left").withColumn(name, F.coalesce(name, F.lit("")))


def clique_labels(scores: DataFrame, cliques: DataFrame) -> DataFrame:
    """Scores of regulators, each named with the members of its clique: regulator||member||..."""
    others = clique_members(cliques).select(F.col("gene").alias("regulator"), "others")
    joined = scores.join(others, "regulator", "left")
    label = F.concat_ws("||", F.col("regulator"), F.coalesce("others", F.array().cast("array<string>")))
    return joined.withColumn("label", label).drop("others")


def regulons(edges: DataFrame) -> DataFrame:
    """graph, driver, targets: each regulator with its targets, and how many."""
    return edges.groupBy("graph", F.col("regulator").alias("driver")).agg(F.array_sort(F.collect_set("target")).alias("targets"), F.countDistinct("target").alias("degree"))


def set_regulons(sets: DataFrame, tasks: int | None = None) -> DataFrame:
    """graph, driver, targets, degree as ``regulons``, from sets (graph, regulators, targets) of numbers: a regulator's sets are rows until they meet."""
    each = sets.select("graph", F.explode("regulators").alias("driver"), "targets")
    dealt = each.repartition(tasks, "graph", "driver") if tasks else each.repartition("graph", "driver")
    found = dealt.where(F.size("targets") > 0).groupBy("graph", "driver").agg(F.array_distinct(F.flatten(F.collect_list("targets"))).alias("targets"))
    return found.withColumn("degree", F.size("targets").cast("long"))


def merge_regulons(tested: DataFrame) -> DataFrame:
    """driver, target, p, multiplicity from regulons (graph, driver, targets, p): BH over all, then Fisher's combination for each target."""
    adjusted = adjust_p(tested, "p", "BH", "q")
    flat = adjusted.select("driver", "targets", "q").repartition("driver").select("driver", F.explode("targets").alias("target"), "q")  # a driver's regulons meet before they are unfolded
    sums = flat.groupBy("driver", "target").agg(F.sum(-F.ln("q")).alias("_h"), F.count("q").alias("_n"), F.count_if(F.col("q") <= 0).alias("_zero"), F.count("*").alias("multiplicity"))
    return sums.select("driver", "target", F.when(F.col("_zero") > 0, 0.0).otherwise(fisher_tail(F.col("_h"), F.col("_n"))).alias("p"), "multiplicity")


def filter_regulons(merged: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Targets at the threshold or below, the most frequent first; none is a result too."""
    return merged.where(F.col("p") <= threshold).orderBy(F.desc("multiplicity"), "driver", "target")


def multiplicity_table(members: DataFrame) -> DataFrame:
    """role, multiplicity, n_genes, genes: how many genes are in so many modules, and their names."""
    per = members.groupBy("role", "gene").agg(F.countDistinct("module").alias("multiplicity"))
    return per.groupBy("role", "multiplicity").agg(F.count("*").alias("n_genes"), F.array_join(F.array_sort(F.collect_list("gene")), ", ").alias("genes"))


def condition_xor(first: DataFrame, second: DataFrame) -> DataFrame:
    """driver, target, nr, r, xor: presence of each edge in the graphs of the two conditions."""
    a = first.select("regulator", "target").distinct().withColumn("_a", F.lit(1))
    b = second.select("regulator", "target").distinct().withColumn("_b", F.lit(1))
    out = a.join(b, ["regulator", "target"], "full_outer")
    nr, r = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    return out.select(F.col("regulator").alias("driver"), "target", nr.alias("nr"), r.alias("r"), F.abs(nr - r).alias("xor"))


def xor_summary(xor: DataFrame) -> DataFrame:
    """driver, normalised_xor: the share of a driver's edges in one condition only, to three decimals."""
    return xor.groupBy("driver").agg(F.round(F.avg("xor"), 3).alias("normalised_xor"))


def edge_support(edges: DataFrame) -> DataFrame:
    """regulator, target, support (graphs that have the edge), graphs (their ids)."""
    each = edges.select("regulator", "target", "graph").distinct()
    return each.groupBy("regulator", "target").agg(F.count("*").alias("support"), F.array_join(F.array_sort(F.collect_list("graph")), "|").alias("graphs"))


def set_support(sets: DataFrame, graphs: int, tasks: int | None = None) -> DataFrame:
    """regulator, target, support, and the graphs that have the edge as bits of 64 a column (w0, w1, ...), from sets (graph, regulators, targets) whose regulators all have edges to its targets; graph is a number below ``graphs``.

    A regulator's sets meet as they are, and edges are unfolded there, into sums of fixed size: no edge of a graph is a
    row of a shuffle.
    """
    each = sets.select("graph", F.explode("regulators").alias("regulator"), "targets")
    dealt = each.repartition(tasks, "regulator") if tasks else each.repartition("regulator")
    flat = dealt.select("graph", "regulator", F.explode("targets").alias("target"))
    found = flat.groupBy("regulator", "target").agg(*_bits(graphs))
    words = found.columns[2:]
    return found.select("regulator", "target", sum((F.bit_count(w) for w in words), F.lit(0)).cast("long").alias("support"), *words)


def graph_names(names: list[str]) -> Column:
    """The names of the graphs of ``set_support``, in order of their numbers, joined by |."""
    has = lambda word: lambda _, k: F.col(word).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0
    parts = [F.filter(F.array(*map(F.lit, names[w : w + 64])), has(f"w{w // 64}")) for w in range(0, len(names), 64)]
    return F.array_join(F.concat(*parts), "|")


def evidence_join(support: DataFrame, evidence: DataFrame) -> DataFrame:
    """Support with peaks (-1 unknown), their class (-1 unknown, 0 none, 1 some) and the edge's key."""
    joined = support.join(evidence, ["regulator", "target"], "left").withColumn("peaks", F.coalesce("peaks", F.lit(-1)))
    return joined.withColumn("evidence", F.least("peaks", F.lit(1)).cast("int")).withColumn("key", F.concat_ws("||", "target", "regulator"))


def top_edges(joined: DataFrame, rows: int = 1000) -> DataFrame:
    """The report's first rows: by support, then peaks."""
    return joined.orderBy(F.desc("support"), F.desc("peaks"), "key").limit(rows)


def gene_support(joined: DataFrame, bootstraps: int, top: int = 3) -> DataFrame:
    """role, gene, total support, neighbours, neighbours that every bootstrap supports, and the first neighbours by support, then peaks."""
    side = lambda role, gene, other: joined.select(F.lit(role).alias("role"), F.col(gene).alias("gene"), F.col(other).alias("other"), "support", "peaks")
    sides = side("regulator", "regulator", "target").unionByName(side("target", "target", "regulator"))
    rank = F.row_number().over(W.partitionBy("role", "gene").orderBy(F.desc("support"), F.desc("peaks"), "other"))
    first = sides.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("role", "gene").agg(F.array_sort(F.collect_list(F.struct("rank", "other"))).alias("first"))
    sums = sides.groupBy("role", "gene").agg(F.sum("support").alias("total"), F.count("*").alias("neighbours"), F.count_if(F.col("support") == bootstraps).alias("at_best"))
    return sums.join(first, ["role", "gene"]).select("role", "gene", "total", "neighbours", "at_best", F.array_join(F.transform("first", lambda s: s["other"]), ", ").alias("first"))


def gene_table(joined: DataFrame, role: str, bootstraps: int, least: int = 4, rows: int = 1000) -> DataFrame:
    """The report's genes of one role: of targets the first by their support from ``least`` up, then by the neighbours that every bootstrap supports, then by total support."""
    genes = gene_support(joined, bootstraps).where(F.col("role") == role)
    if role == "target" and bootstraps > 1:
        strong = F.sum(F.when(F.col("support").between(least, bootstraps), F.col("support")).otherwise(0))
        kept = joined.groupBy(F.col("target").alias("gene")).agg(strong.alias("_strong")).orderBy(F.desc("_strong"), "gene").limit(rows)
        genes = genes.join(kept.select("gene"), "gene", "left_semi")
    return genes.orderBy(F.desc("at_best"), F.desc("total"), "gene").limit(rows)


def cumulative_support(joined: DataFrame) -> DataFrame:
    """support, edges and cumulated edges from the largest support down, and the percentages of unknown, no and some evidence among the cumulated ones (3 significant digits). One row for each support, which are as many as graphs at most."""
    of = lambda k: F.count_if(F.col("evidence") == k)
    n = joined.groupBy("support").agg(F.count("*").alias("edges"), of(-1).alias("_u"), of(0).alias("_n"), of(1).alias("_s"))
    down = W.partitionBy().orderBy(F.desc("support")).rowsBetween(W.unboundedPreceding, 0)  # rows as said above
    total = lambda c: F.sum(c).over(down)
    share = lambda c: signif(100.0 * total(c) / total("edges"), 3)
    return n.select("support", "edges", total("edges").alias("cum_edges"), share("_u").alias("percent_unknown"), share("_n").alias("percent_none"), share("_s").alias("percent_some"))


def run_overview_of(counts: DataFrame, regulators: int, targets: int, bootstraps: int) -> DataFrame:
    """``run_overview`` from the numbers of edges, graphs and unique edges (one row)."""
    percent = lambda c, of: signif(100.0 * F.col(c) / F.lit(float(max(of, 1))), 3)
    return counts.select("graphs", signif(F.col("edges") / F.greatest("graphs", F.lit(1)), 3).alias("mean_edges"), "edges", percent("edges", regulators * targets * bootstraps).alias("percent_possible"), "unique_edges", percent("unique_edges", regulators * targets).alias("percent_unique"))


def support_counts(support: DataFrame) -> DataFrame:
    """edges, graphs and unique_edges of ``set_support``."""
    words = [c for c in support.columns if re.fullmatch(r"w\d+", c)]
    found = support.agg(F.coalesce(F.sum("support"), F.lit(0)).alias("edges"), F.count("*").alias("unique_edges"), *(F.coalesce(F.bit_or(w), F.lit(0)).cast("long").alias(w) for w in words))
    return found.select("edges", "unique_edges", sum((F.bit_count(w) for w in words), F.lit(0)).cast("long").alias("graphs"))


def run_overview(edges: DataFrame, regulators: int, targets: int, bootstraps: int) -> DataFrame:
    """graphs, average edges of one, all edges and their percentage of regulators x targets x bootstraps, unique edges and theirs of regulators x targets (percentages and the average to 3 significant digits)."""
    each = edges.select("graph", "regulator", "target").distinct()
    counts = each.agg(F.count("*").alias("edges"), F.countDistinct("graph").alias("graphs")).crossJoin(F.broadcast(each.select("regulator", "target").distinct().agg(F.count("*").alias("unique_edges"))))  # one row each
    return run_overview_of(counts, regulators, targets, bootstraps)


def evidence_overview(evidence: DataFrame) -> DataFrame:
    """peaks class (-1, 0, 1 for any), pairs, and the percentage of all pairs."""
    cls = F.signum("peaks").cast("int").alias("class")
    n = evidence.groupBy(cls).agg(F.count("*").alias("pairs"))
    return n.withColumn("percent", 100.0 * F.col("pairs") / F.sum("pairs").over(W.partitionBy()))  # one row for each class


def cluster_members(members: DataFrame, clusters: DataFrame, compat: bool = False) -> DataFrame:
    """cluster, gene, role, multiplicity: genes of each cluster's modules; ``compat`` adds those of all clusters before it."""
    own = clusters if not compat else clusters.select(F.col("module"), F.col("cluster").alias("_from")).join(clusters.select("cluster").distinct(), F.col("cluster") >= F.col("_from")).select("module", "cluster")
    return members.join(own, "module").groupBy("cluster", "gene", "role").agg(F.countDistinct("module").alias("multiplicity"))


def module_clusters(modules: DataFrame, clusters: DataFrame) -> DataFrame:
    """module, cluster; -1 for modules in none."""
    return modules.select("module").distinct().join(clusters, "module", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def _list_test(edges: DataFrame, first: Column, second: Column, name: str) -> DataFrame:
    """reg, p of Welch's t between the correlations of a regulator with its targets within label 1 (where ``first`` holds) and label 0 (where ``second`` does), to one significant digit; 1 for fewer than two targets, or lists that do not vary."""
    r, nr = F.coalesce("c1_pearson", F.lit(0.0)), F.coalesce("c0_pearson", F.lit(0.0))
    a, b = F.when(first, r), F.when(second, nr)
    stats = edges.groupBy("reg").agg(*(f.alias(k) for k, f in (("n1", F.count(a)), ("n2", F.count(b)), ("m1", F.avg(a)), ("m2", F.avg(b)), ("v1", F.var_samp(a)), ("v2", F.var_samp(b)))))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(e1 + e2))
    df = F.try_divide((e1 + e2) ** 2, e1**2 / (F.col("n1") - 1) + e2**2 / (F.col("n2") - 1))
    tested = stats.withColumn("_t", t).withColumn("_df", df).withColumn("_p", t_p_udf("_t", "_df"))
    plain = (F.col("n1") < 2) | (F.col("n2") < 2) | (F.col("v1") == 0) | (F.col("v2") == 0)
    return tested.select("reg", F.when(plain, F.lit(1.0)).otherwise(signif(F.col("_p"), 1)).alias(name))


def regulator_ranking(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """reg, and three measures with their ranks (ties at their mean).

    ``expr_p``: p of the regulator's own expression. ``targets`` and ``target_t``: how many targets it has in the graph
    over all samples, and the mean t of those (3 significant digits). ``corr_p``: whether its correlations with those
    differ between the labels; ``corr_p_own`` takes the targets of each label's own graph. Nodes have gene,
    is_regulator, t_stat and t_p; edges reg, target, c0_pearson, c1_pearson, and all_weight, c0_weight and c1_weight.
    """
    regs = nodes.where("is_regulator").select(F.col("gene").alias("reg"), F.col("t_p").alias("expr_p"))
    drawn = edges.where("all_weight != 0").join(nodes.select(F.col("gene").alias("target"), "t_stat"), "target")
    mean = drawn.groupBy("reg").agg(F.count("*").alias("targets"), signif(F.avg("t_stat"), 3).alias("target_t"))
    on = lambda tag: F.col(f"{tag}_weight") != 0
    out = regs.join(mean, "reg", "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    out = out.join(_list_test(edges, on("all"), on("all"), "corr_p"), "reg", "left").join(_list_test(edges, on("c1"), on("c0"), "corr_p_own"), "reg", "left")
    out = out.withColumn("corr_p", F.coalesce("corr_p", F.lit(1.0))).withColumn("corr_p_own", F.coalesce("corr_p_own", F.lit(1.0)))
    for value, name in (("expr_p", "rank_expr"), ("target_t", "rank_t"), ("corr_p", "rank_corr"), ("corr_p_own", "rank_corr_own")):
        out = average_rank(out, value, [], name)
    return out
