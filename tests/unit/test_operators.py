"""Operators and plans on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrweave.functions.scalar import adjust_many, adjust_p, average_rank, capped_log10, cumulated, fisher_combined, signif
from corrweave.kernels.modules import REGRESSIONS
from corrweave.operators import assoc, evidence, graph, layout, prep, tests, validate
from corrweave.plans import inference, pipeline, report
from corrweave.sources import files
from corrweave.sources.adapters import ExprSet


def _expr(spark, x, genes=None, samples=None):
    genes = genes or [f"g{k}" for k in range(x.shape[0])]
    samples = samples or [f"s{k:02d}" for k in range(x.shape[1])]
    return spark.createDataFrame([(g, s, float(x[i, j])) for i, g in enumerate(genes) for j, s in enumerate(samples)], "gene string, sample string, value double")


@pytest.fixture(scope="module")
def planted(spark):
    """Ten genes that hang together for label 1 only, ten that always do, four regulators of the latter."""
    rng = np.random.default_rng(3)
    label = np.repeat([0, 1], 20)
    common, always = rng.normal(size=40), rng.normal(size=40)
    rewired = np.where(label == 1, common, 0) + rng.normal(0, 1, (10, 40)) * np.where(label == 1, 0.1, 1)
    steady = always + rng.normal(0, 0.2, (10, 40))
    regs = np.vstack([always + rng.normal(0, 0.1, 40), rng.normal(size=(3, 40))])
    genes = [*(f"a{k}" for k in range(10)), *(f"b{k}" for k in range(10)), *(f"r{k}" for k in range(4))]
    expr = _expr(spark, np.vstack([rewired, steady, regs]), genes)
    samples = spark.createDataFrame([(f"s{k:02d}", int(v)) for k, v in enumerate(label)], "sample string, phenotype int")
    roles = spark.createDataFrame([(g, g[0] == "r") for g in genes], "gene string, is_regulator boolean")
    return ExprSet(expr, roles, samples)


def test_signif_and_caps(spark):
    row = spark.createDataFrame([(123456.0, -0.00123456, 0.0, 1e-320)], "a double, b double, c double, p double").select(signif(F.col("a"), 3), signif(F.col("b"), 3), signif(F.col("c"), 3), capped_log10(F.col("p")), capped_log10(F.lit(0.0))).first()
    assert row[0] == 123000 and row[1] == pytest.approx(-0.00123) and row[2] == 0 and row[3] == 300 and row[4] == 300


def test_fisher_combination(spark):
    df = spark.createDataFrame([([0.05],), ([0.1, 0.2, 0.3],), ([0.0, 0.5],), ([],)], "p array<double>")
    got = [r[0] for r in df.select(fisher_combined(F.col("p"))).collect()]
    x = -np.log([0.1, 0.2, 0.3]).sum()
    assert got[0] == pytest.approx(0.05) and got[1] == pytest.approx(np.exp(-x) * (1 + x + x * x / 2)) and got[2] == 0 and got[3] is None


def test_adjustments(spark):
    p = [0.01, 0.04, 0.03, 0.2, None]
    df = spark.createDataFrame([(str(k), v) for k, v in enumerate(p)], "k string, p double")
    by = {m: {r["k"]: r["adjusted"] for r in adjust_p(df, "p", m).collect()} for m in ("BH", "holm", "bonferroni", "hochberg", "BY")}
    assert by["BH"]["0"] == pytest.approx(0.04) and by["BH"]["1"] == by["BH"]["2"] == pytest.approx(0.04 * 4 / 3) and by["BH"]["4"] is None
    assert by["holm"]["2"] == pytest.approx(0.09) and by["holm"]["1"] == pytest.approx(0.09) and by["bonferroni"]["3"] == pytest.approx(0.8)
    assert by["BY"]["0"] == pytest.approx(0.04 * (1 + 1 / 2 + 1 / 3 + 1 / 4))
    with pytest.raises(ValueError):
        adjust_p(df, "p", "none")


def test_fisher_tails(spark):
    df = spark.createDataFrame([(3, 1, 1, 3), (0, 0, 2, 2), (5, 0, 0, 5)], "a int, b int, c int, d int")
    up = [r["p"] for r in tests.fisher_p(df, "a", "b", "c", "d", "greater", "p").collect()]
    down = [r["p"] for r in tests.fisher_p(df, "a", "b", "c", "d", "less", "p").collect()]
    assert up == pytest.approx([17 / 70, 1, 1 / 252]) and down == pytest.approx([69 / 70, 1, 1])


def test_permutation_test_tells_rewired_from_steady(planted):
    values = planted.expr.where("gene < 'r'").withColumn("module", F.substring("gene", 1, 1))
    rows = {r["module"]: r for r in inference.permutation_p(values, planted.samples, 99).collect()}
    assert rows["a"]["p"] == pytest.approx(0.01) and rows["b"]["p"] > 0.05
    sql = {r["module"]: r["p"] for r in tests.permutation_p(values, planted.samples, 19).collect()}
    assert sql == {m: pytest.approx(r["p"]) for m, r in ((r["module"], r) for r in inference.permutation_p(values, planted.samples, 19).collect())}
    two = {r["module"]: r for r in tests.two_stage(values, planted.samples, tests.PermutationPlan(50, 200), inference.permutation_p).collect()}
    assert two["a"]["significant"] and not two["b"]["significant"] and two["b"]["p"] is None


@pytest.mark.parametrize("mode", sorted(REGRESSIONS))
def test_target_graphs(planted, mode):
    genes = planted.genes.where("gene like 'b%' or gene like 'r%'")
    edges = inference.target_graph(planted.expr.join(genes.select("gene"), "gene", "left_semi"), genes, mode).collect()
    assert {(r["regulator"], r["target"]) for r in edges} >= {("r0", f"b{k}") for k in range(10)}


def test_rewiring_end_to_end(spark, planted):
    members = planted.genes.where("not is_regulator").select(F.substring("gene", 1, 1).alias("module"), "gene", F.lit("target").alias("role"))
    out = pipeline.run_rewiring(planted, members, tests.PermutationPlan(50, 100), rounds=5)
    assert {r["module"] for r in out.tested.where("significant").collect()} == {"a"}
    assert out.clusters.count() == 1 and out.overlaps.first()["p"] < 1


def test_inference_end_to_end(planted):
    modules, graphs = pipeline.run_inference(planted, ["LM"], ["LM"], inference.DiscoveryParams(modules=2, bootstraps=2, iterations=3))
    assert {r["bootstrap"] for r in modules.collect()} == {0, 1}
    assert graphs.where("regulator = 'r0'").count() > 0
    assert pipeline.run_network(planted, ["LM"]).where("regulator = 'r0' and target = 'b1'").count() == 1


def test_evidence_end_to_end(spark):
    rows = [(f"m{k}", k % 10, "tf" if k % 2 else "other", "regulator") for k in range(40)] + [(f"m{k}", k % 10, "x", "target") for k in range(40)]
    members = spark.createDataFrame(rows, "module string, bootstrap int, gene string, role string")
    tested = spark.createDataFrame([(f"m{k}", k % 2 == 1) for k in range(40)], "module string, significant boolean")
    got = pipeline.run_evidence(members, tested, 0.05).collect()
    assert [r["regulator"] for r in got] == ["tf"] and got[0]["or_all"] > 10


def test_summaries_of_a_module(planted):
    genes = planted.genes.where("gene in ('b0', 'b1', 'r0', 'r1')")
    nodes, edges = pipeline.summarize_module(planted, genes, "LM")
    assert nodes.count() == 4 and edges.count() == 4
    assert edges.where("reg = 'r0' and all_pearson_p < 1e-6 and all_weight != 0").count() == 2
    ties = edges.where("reg = 'r0' and target = 'b0'").first()
    assert not ties["all_ties"] and ties["all_n"] == 40 and ties["c1_n"] == 20
    assert {r["gene"] for r in pipeline.refine_module(genes, edges).collect()} == {"b0", "b1", "r0"}
    assert pipeline.module_counts(planted, genes).first().asDict() == {"regulators": 2, "targets": 2, "genes": 4, "samples": 40, "label0": 20, "label1": 20}


def test_zero_variance_and_missing_labels(spark):
    expr = _expr(spark, np.array([[1, 1, 1, 2.0], [1, 2, 3, 4]]))
    samples = spark.createDataFrame([("s00", 0), ("s01", 0), ("s02", 1), ("s03", 1), ("s04", None)], "sample string, phenotype int")
    data = ExprSet(expr, expr.select("gene").distinct(), samples)
    assert {r["gene"]: r["keep"] for r in prep.constant_genes(prep.with_phenotype(data)).collect()} == {"g0": False, "g1": True}
    assert prep.encode_phenotype(spark.createDataFrame([("a", "R"), ("b", "NR"), ("c", None)], "sample string, label string")).where("phenotype = 0").first()["sample"] == "b"


def test_cliques_plan(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.9), ("x", "y", 0.9)], "gene_a string, gene_b string, weight double")
    assert {r["genes"] for r in inference.cliques(edges).collect()} == {"a, b, c", "x, y"}


def test_representatives_cover_all_genes(planted):
    expr = planted.expr
    corr = graph.correlations(expr)
    for selection in inference.SELECTIONS:
        rows = inference.select_representatives(expr, corr, 0.8, selection).collect()
        assert sorted(g for r in rows for g in r["genes"].split(", ")) == sorted(r["gene"] for r in planted.genes.collect())
    few = inference.select_representatives(expr, corr, 0.8, "size", keep=1, mandatory=["r3"]).collect()
    assert any("r3" in r["genes"] for r in few)
    with pytest.raises(ValueError):
        graph.correlations(expr, "kendall")


def test_queries_without_sql_cover_all_genes(spark, sf_small):
    from corrweave import catalogue

    edges = catalogue.QUERIES["edge_summary_pvalues"](spark, sf_small).select("reg", "target").collect()
    assert sorted(map(tuple, edges)) == [(f"g{r:02d}", f"g{t:02d}") for r in range(8) for t in range(8, 64)]
    assert catalogue.QUERIES["gene_order"](spark, sf_small).count() == 64


def test_xor_and_support(spark):
    a = spark.createDataFrame([("g1", "t1", "r1", 1.0), ("g1", "t2", "r1", 1.0)], "graph string, target string, regulator string, weight double")
    b = spark.createDataFrame([("g2", "t1", "r1", 1.0), ("g2", "t3", "r1", 1.0)], "graph string, target string, regulator string, weight double")
    assert evidence.xor_summary(evidence.condition_xor(a, b)).first()["normalised_xor"] == 0.667
    assert {r["target"]: r["support"] for r in evidence.edge_support(a.unionByName(b)).collect()} == {"t1": 2, "t2": 1, "t3": 1}


def test_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("gene\ts1\ts2\ng1\t1.5\t2\ng2\t-1\t0\n")
    long = files.read_matrix(spark, f"file://{tmp_path}/m.tsv")
    assert {(r["gene"], r["sample"], r["value"]) for r in long.collect()} == {("g1", "s1", 1.5), ("g1", "s2", 2.0), ("g2", "s1", -1.0), ("g2", "s2", 0.0)}
    assert files.read_evidence(spark, f"file://{tmp_path}/m.tsv").where("peaks = -1").count() == 1
    calls = []
    make = lambda: calls.append(1) or long
    for _ in range(2):
        assert files.cached(spark, f"file://{tmp_path}/c.tsv", 0.05, make).count() == 4
    assert len(calls) == 1 and files.cache_path("a/b.tsv", 0.05) == "a/b_fs_0.05"
    files.write_tsv(long, f"file://{tmp_path}/out")
    assert files.read_table(spark, f"file://{tmp_path}/out").count() == 4
    page = files.html_page("a < b", [files.to_html(long.orderBy("gene", "sample"), "t")])
    assert "<td>1.5</td>" in page and "a &lt; b" in page
    with pytest.raises(ValueError):
        files.to_html(long, rows=2)
    assert 'href="x.html"' in files.index_page("i", {"x": "x.html"})
    atlas = spark.createDataFrame([("g", "Enzymes, Transcription factors"), ("h", "Enzymes")], "gene string, protein_class string")
    assert {r["gene"]: r["regulator"] for r in files.transcription_factors(atlas).collect()} == {"g": 1, "h": 0}
    assert files.vectors(long).where("sample = 's1'").first()["v"] == [1.5, -1.0]


def test_validation(spark, planted):
    validate.check_expr(planted)
    with pytest.raises(ValueError, match="at least two regulators"):
        validate.check_expr(ExprSet(planted.expr, planted.genes.where("not is_regulator"), planted.samples))
    with pytest.raises(ValueError, match="not in the matrix"):
        validate.check_expr(ExprSet(planted.expr.where("gene <> 'a0'"), planted.genes, planted.samples))
    with pytest.raises(ValueError, match="'value' must be"):
        validate.check_expr(ExprSet(planted.expr.withColumn("value", F.col("value").cast("string")), planted.genes, planted.samples))
    with pytest.raises(ValueError, match="is missing"):
        validate.check_columns(planted.expr, other=object)
    with pytest.raises(ValueError, match="unknown mode"):
        validate.check_modes(["VBSR"], ["FOREST"])
    for bad in (-0.1, 2, "x", True):
        with pytest.raises(ValueError):
            validate.check_threshold("threshold", bad)


def test_reports(spark, planted, tmp_path):
    genes = planted.genes.where("gene in ('b0', 'b1', 'r0', 'r1')")
    found = report.module_report(planted, genes, "LM", draws=20)
    found.write(f"file://{tmp_path}/module")
    assert files.read_table(spark, f"file://{tmp_path}/module/edges").count() == 4
    assert found.tables["null"].count() == 21 and "<h2>regulators</h2>" in found.html("m")
    edges = spark.createDataFrame([("g1", "t1", "r1", 1.0), ("g2", "t1", "r1", 1.0), ("g2", "t2", "r1", 0.5)], "graph string, target string, regulator string, weight double")
    peaks = spark.createDataFrame([("r1", "t1", 4)], "regulator string, target string, peaks int")
    tables = report.evidence_report(edges, peaks, 1, 2, 2)
    assert tables["edges"].first()["key"] == "t1||r1"
    assert sorted(map(tuple, tables["support_by_evidence"].collect())) == [(1, 1, 0, 0), (2, 0, 0, 1)]
    assert report.first_last(["a", "b", "c", "d"]) == "a, ..., d" and report.cell({1: 3, 0: 2}) == "0:2 1:3"
    values = planted.expr.where("gene < 'r'").withColumn("module", F.substring("gene", 1, 1))
    assert [r["module"] for r in report.rewired_ids(values, planted.samples, tests.PermutationPlan(50, 100)).collect()] == ["a"]


def test_ranks_and_adjustments_in_ranges(spark):
    """Ordering in ranges between quantiles gives what one window gives."""
    rng = np.random.default_rng(6)
    p = rng.integers(1, 60, 300) / 60
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)], "k int, p double")
    counts = df.groupBy("p").agg(F.count("*").alias("c"))
    forms = {"low": ("down", F.col("p") * F.col("n") / F.col("hi")), "high": ("up", F.col("p") * (F.col("n") - F.col("hi") + F.col("c")))}
    plain = {r["p"]: tuple(r) for r in cumulated(counts, "p", [], forms).select("p", "hi", "n", "low", "high").collect()}
    ranged = {r["p"]: tuple(r) for r in cumulated(counts, "p", [], forms, range_rows=7).select("p", "hi", "n", "low", "high").collect()}
    assert len(plain) > 40 and {k: pytest.approx(v) for k, v in plain.items()} == ranged
    order = np.sort(p)
    ranks = {r["k"]: r["rank"] for r in average_rank(df, "p", []).collect()}
    for k, v in enumerate(p):
        assert ranks[k] == (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2
    by = {r["k"]: r for r in adjust_many(df.withColumn("g", F.col("k") % 2), "p", {"bh": "BH", "by": "BY"}, ["g"]).collect()}
    own = np.sort(p[::2])
    for k in range(0, 300, 2):
        want = min(own[j] * 150 / (j + 1) for j in range(150) if own[j] >= p[k])
        assert by[k]["bh"] == pytest.approx(min(want, 1)) and by[k]["by"] == pytest.approx(min(want * sum(1 / j for j in range(1, 151)), 1))
    assert average_rank(spark.createDataFrame([(1, None), (2, 5.0)], "k int, p double"), "p", []).orderBy("k").collect()[0]["rank"] is None


def test_published_condition_table(spark):
    """A published table of drivers' edges by condition, and its summary."""
    targets = {
        "ASCL1": (["CHGA", "EYA3", "ILF3", "SEZ6", "SYT4"], []),
        "ELK3": (["PPME1", "ZMYM3"], ["OTUD3"]),
        "INSM1": (["CACNA1B", "MARCH11", "MGAT5B", "MYT1", "RPL30", "SYT13", "TSPYL4"], ["MARCH11", "SYT13"]),
        "ZBTB12": (["BCL7A", "BTBD9", "COPG2", "IFT81", "MAP3K9", "TRAF3IP1"], []),
    }
    graphs = [spark.createDataFrame([(r, t) for r, both in targets.items() for t in both[k]], "regulator string, target string") for k in (0, 1)]
    xor = evidence.condition_xor(*graphs)
    assert xor.count() == 21 and xor.where("xor = 0").count() == 2
    assert {r["driver"]: r["normalised_xor"] for r in evidence.xor_summary(xor).collect()} == {"ASCL1": 1, "ELK3": 1, "INSM1": 0.714, "ZBTB12": 1}
    cliques = spark.createDataFrame([("ASCL1, INSM1, X",), ("Y",)], "genes string")
    named = {r["driver"]: r["cliques"] for r in evidence.with_cliques(evidence.xor_summary(xor), "driver", cliques).collect()}
    assert named == {"ASCL1": "INSM1, X", "ELK3": "", "INSM1": "ASCL1, X", "ZBTB12": ""}
    labels = evidence.clique_labels(spark.createDataFrame([("INSM1", 0.1), ("ELK3", 0.2)], "regulator string, p double"), cliques)
    assert {r["label"] for r in labels.collect()} == {"INSM1||ASCL1||X", "ELK3"}


def test_difference_is_label_0_less_label_1(spark):
    """Published rows say 1.73 - 1.28 with a positive difference and t."""
    values = [("g", f"s{k}", v, int(k >= 20)) for k, v in enumerate([1.73 + 0.3 * (-1) ** k for k in range(20)] + [1.28 + 0.3 * (-1) ** k for k in range(15)])]
    row = tests.node_summary(spark.createDataFrame(values, "gene string, sample string, value double, phenotype int"), spark.createDataFrame([("g", False)], "gene string, is_regulator boolean")).first()
    assert row["avg_diff"] == pytest.approx(row["avg0"] - row["avg1"]) and row["avg_diff"] > 0 and row["t_stat"] > 0


def test_rank_correlation_of_tied_values_goes_by_t(spark):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=20), rng.normal(size=20)
    rows = [(g, f"s{k:02d}", float(v), int(k % 2)) for g, values in (("r", x), ("t", y), ("u", np.round(y))) for k, v in enumerate(values)]
    genes = spark.createDataFrame([("r", True), ("t", False), ("u", False)], "gene string, is_regulator boolean")
    got = {r["target"]: r for r in tests.with_edge_p(tests.edge_summary(spark.createDataFrame(rows, "gene string, sample string, value double, phenotype int"), genes)).collect()}
    from corrweave.functions import dist

    assert not got["t"]["all_ties"] and got["u"]["all_ties"]
    assert got["t"]["all_spearman_p"] == pytest.approx(dist.spearman_p(got["t"]["all_spearman"], 20, False))
    assert got["u"]["all_spearman_p"] == pytest.approx(dist.pearson_p(got["u"]["all_spearman"], 20))


def test_support_tables(spark):
    """Classes of evidence are three; a gene's first neighbours go by support, then peaks; percentages are of the cumulated row."""
    support = spark.createDataFrame([("r1", "t1", 3, "a"), ("r1", "t2", 3, "a"), ("r1", "t3", 1, "a"), ("r2", "t1", 1, "a")], "regulator string, target string, support long, graphs string")
    peaks = spark.createDataFrame([("r1", "t1", 0), ("r1", "t2", 7), ("r1", "t3", 2)], "regulator string, target string, peaks int")
    joined = evidence.evidence_join(support, peaks)
    assert {(r["key"], r["evidence"]) for r in joined.collect()} == {("t1||r1", 0), ("t2||r1", 1), ("t3||r1", 1), ("t1||r2", -1)}
    assert [tuple(r) for r in evidence.cumulative_support(joined).orderBy(F.desc("support")).collect()] == [(3, 2, 2, 0.0, 50.0, 50.0), (1, 2, 4, 25.0, 25.0, 50.0)]
    genes = {(r["role"], r["gene"]): r for r in evidence.gene_support(joined, 3).collect()}
    assert genes["regulator", "r1"]["first"] == "t2, t1, t3" and genes["regulator", "r1"]["at_best"] == 2 and genes["target", "t1"]["total"] == 4
    assert [r["gene"] for r in evidence.gene_table(joined, "target", 3, least=2, rows=2).collect()] == ["t1", "t2"]
    edges = spark.createDataFrame([(g, t, "r1", 1.0) for g, t in (("a", "t1"), ("a", "t2"), ("b", "t1"))], "graph string, target string, regulator string, weight double")
    assert tuple(evidence.run_overview(edges, 2, 5, 4).first()) == (2, 1.5, 3, 7.5, 2, 20.0)


def test_overlaps_of_disjoint_modules(spark):
    members = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "z"), ("c", "w")], "module string, gene string")
    assert evidence.module_overlaps(members, 10).count() == 4
    every = {(r["m1"], r["m2"]): r for r in evidence.module_overlaps(members, 10, disjoint=True).collect()}
    assert len(every) == 6 and every["a", "c"]["p"] == 1 and every["a", "b"]["p"] == pytest.approx(1 - 28 / 45)
    big = spark.createDataFrame([(400_000, 600_000, 600_000, 2_000_000)], "a long, b long, c long, d long")
    assert 0 <= tests.fisher_p(big.limit(0), "a", "b", "c", "d", "greater", "p").count() == 0


def test_ranking_of_regulators(spark):
    nodes = spark.createDataFrame([("r1", True, 1.0, 0.5), ("r2", True, 2.0, 0.01), ("t1", False, -2.0, 0.1), ("t2", False, 3.0, 0.1), ("t3", False, -4.0, 0.1)], "gene string, is_regulator boolean, t_stat double, t_p double")
    edges = [("r1", "t1", 0.9, 0.1, 1.0, 1.0, 0.0), ("r1", "t3", 0.8, 0.2, 1.0, 1.0, 1.0), ("r1", "t2", 0.7, 0.1, 1.0, 0.0, 1.0), ("r2", "t2", 0.1, 0.1, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(edges, "reg string, target string, c0_pearson double, c1_pearson double, all_weight double, c0_weight double, c1_weight double")
    got = {r["reg"]: r for r in evidence.regulator_ranking(nodes, df).collect()}
    assert got["r1"]["target_t"] == -1.0 and got["r1"]["rank_t"] == 1 and got["r2"]["rank_t"] == 2 and got["r2"]["rank_expr"] == 1
    assert got["r2"]["corr_p"] == 1 and got["r1"]["corr_p"] < 0.01 and got["r1"]["rank_corr"] == 1


def test_module_statistics_and_residuals(spark):
    rng = np.random.default_rng(13)
    regs = rng.normal(size=(2, 30))
    targets = np.vstack([regs[0] * 2 + rng.normal(0, 0.1, 30) for _ in range(3)])
    expr = _expr(spark, np.vstack([regs, targets]), ["r0", "r1", "t0", "t1", "t2"])
    members = spark.createDataFrame([("m", f"t{k}") for k in range(3)], "module string, gene string")
    programs = spark.createDataFrame([("m", "r0", 2.0, 0.5), ("m", "r1", 0.0, 0.5)], "module string, regulator string, beta double, intercept double")
    from corrweave.kernels.modules import evaluate

    row = graph.module_eval(expr, members, programs.drop("intercept")).first()
    want = evaluate(targets, targets.mean(0), 2 * regs[0], 1, False)
    for name, value in want.items():
        assert row[name] == pytest.approx(value), name
    errors = graph.residuals(expr, members, programs).collect()
    assert len(errors) == 30 and np.mean([r["error"] for r in errors]) == pytest.approx((targets.mean(0) - 2 * regs[0]).mean() - 0.5)


def test_missing_values(spark, planted):
    """The permutation test counts them pair by pair, in the kernel as in the join; regressions refuse them."""
    holes = planted.expr.where("gene < 'r'").where("not (gene = 'a3' and sample in ('s01', 's25')) and not (gene = 'b1' and sample = 's07')")
    values = holes.withColumn("module", F.substring("gene", 1, 1))
    kernel = {r["module"]: (r["stat"], r["p"]) for r in inference.permutation_p(values, planted.samples, 19).collect()}
    joined = {r["module"]: (r["stat"], r["p"]) for r in tests.permutation_p(values, planted.samples, 19).collect()}
    assert kernel == {m: pytest.approx(v) for m, v in joined.items()}
    with pytest.raises(ValueError, match="are missing"):
        inference.discover_modules(holes.unionByName(planted.expr.where("gene >= 'r'")), planted.genes, inference.DiscoveryParams(modules=2, bootstraps=1, iterations=2, mode="LM"))


def test_modules_broadcast_or_dealt_alike(planted, monkeypatch):
    params = inference.DiscoveryParams(modules=2, bootstraps=2, iterations=3, mode="LASSOparam3")
    one = sorted(map(str, inference.discover_modules(planted.expr, planted.genes, params).collect()))
    monkeypatch.setattr(inference, "MAX_BROADCAST", 10)
    assert one and sorted(map(str, inference.discover_modules(planted.expr, planted.genes, params).collect())) == one
    with pytest.raises(ValueError):
        inference.discover_modules(planted.expr, planted.genes, inference.DiscoveryParams(mode="LASSOparam11"))


def test_cliques_of_a_dense_component(spark):
    import random

    rnd = random.Random(3)
    pairs = [(f"n{a:02d}", f"n{b:02d}") for a in range(18) for b in range(a + 1, 18) if rnd.random() < 0.6]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    from corrweave.kernels.cliques import maximal_cliques

    got = inference.cliques(spark.createDataFrame([(b, a, 0.9) for a, b in pairs], "gene_a string, gene_b string, weight double")).collect()
    assert sorted(r["genes"] for r in got) == sorted(", ".join(c) for c in maximal_cliques(near))
    assert sorted(r["clique"] for r in got) == list(range(len(got))) and {r["component"] for r in got} == {"n00"}


def test_order_of_genes(spark):
    """Leaves of complete linkage, against a plain search for the closest pair."""
    rng = np.random.default_rng(15)
    x = rng.normal(size=(9, 9))
    x = x + x.T
    np.fill_diagonal(x, 0)
    rows = [(f"g{i}", f"g{j}", float(x[i, j])) for i in range(9) for j in range(i + 1, 9)]
    genes = spark.createDataFrame([(f"g{i}", i >= 7) for i in range(9)] + [("alone", True)], "gene string, is_regulator boolean")
    got = inference.gene_order(spark.createDataFrame(rows, "gene_a string, gene_b string, diff double"), genes).orderBy("is_regulator", "pos").collect()
    sub = x[:7, :7]
    groups = [[k] for k in range(7)]
    far = lambda a, b: max(np.linalg.norm(sub[i] - sub[j]) for i in a for j in b)
    age = {(k,): k - 7 for k in range(7)}
    for step in range(6):
        a, b = min(((a, b) for a in range(len(groups)) for b in range(a)), key=lambda p: far(groups[p[0]], groups[p[1]]))
        first, second = sorted((groups[a], groups[b]), key=lambda g: age[tuple(g)])
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [first + second]
        age[tuple(first + second)] = step
    assert [r["gene"] for r in got if not r["is_regulator"]] == [f"g{k}" for k in groups[0]]
    assert {r["gene"] for r in got if r["is_regulator"]} == {"g7", "g8", "alone"}


def test_rewiring_with_products(spark, planted):
    genes = planted.genes.where("gene like 'a%' or gene like 'r%'")
    halves = [genes.where("gene like 'r%' or gene < 'a5'"), genes.where("gene like 'r%' or gene >= 'a5'"), genes]
    rows = None
    for k, g in enumerate(halves):
        m = g.select(F.lit(f"m{k}").alias("module"), "gene", F.when(F.col("is_regulator"), "regulator").otherwise("target").alias("role"))
        rows = m if rows is None else rows.unionByName(m)
    run = pipeline.run_rewiring(planted, rows, tests.PermutationPlan(20, 50, retest_below=1.1, threshold=1.0), rounds=5, gene_variance=0.0)
    table = pipeline.module_statistics(run.prepared, run.tested)
    assert table.count() == 3 and table.first()["num_samples"] == 40 and table.first()["num_label0"] == 20
    assert run.log()[2:4] == ["samples: 40", "samples of each label: 20, 20"]
    one = run.tested.select("module", F.lit(0).alias("cluster"))
    whole = pipeline.Rewiring(run.prepared, run.tested, run.overlaps, one, evidence.cluster_members(run.prepared.modules, one))
    assert pipeline.cluster_products(whole, "LM") == [] and whole.log()[-1] == "cluster 0: m0|m1|m2"
    found = pipeline.cluster_products(whole, "LM", last_cluster=True)
    tables = found[0].tables()
    assert tables["raw_edges"].count() == 40 and set(tables) == {"multiplicity", "raw_nodes", "raw_edges", "refined_nodes", "refined_edges", "conditions", "drivers"}
    joint = pipeline.joint_clusters({"x": run, "y": run}, rounds=5)
    assert {r["module"] for r in joint.collect()} == {f"{n}.m{k}" for n in "xy" for k in range(3)}
    assert joint.select("module").distinct().count() == joint.count()


def test_preparation_warns_and_drops(spark, planted):
    few = ExprSet(planted.expr.unionByName(planted.expr.where("gene = 'a0'").withColumn("gene", F.lit("flat")).withColumn("value", F.lit(1.0))), planted.genes.unionByName(spark.createDataFrame([("flat", False)], planted.genes.schema)), planted.samples.where("sample < 's25'"))
    members = few.genes.select(F.lit("m").alias("module"), "gene", F.when(F.col("is_regulator"), "regulator").otherwise("target").alias("role"))
    members = members.unionByName(members.where("role = 'target'").withColumn("module", F.lit("bare")))
    with pytest.warns(UserWarning, match="20 and 5"):
        got = pipeline.prepare_rewiring(few, members, 1e-9)
    assert [r["gene"] for r in got.dropped.collect()] == ["flat"] and got.modules.where("gene = 'flat' or module = 'bare'").count() == 0
    assert got.log[1] == "genes dropped for their variance: 1"


def test_regulons_end_to_end(spark, planted):
    """The driver of genes that are rewired is found, that of steady ones is not; each 3rd module is tested again in any case."""
    edges = [("m", f"a{k}", "r1", 1.0) for k in range(6)] + [("n", f"a{k}", "r1", 1.0) for k in range(3, 9)] + [("m", f"b{k}", "r0", 1.0) for k in range(6)]
    df = spark.createDataFrame(edges, "graph string, target string, regulator string, weight double")
    got = pipeline.run_regulons(planted, df, plan=tests.PermutationPlan(50, 200))
    assert {r["driver"] for r in got.collect()} == {"r1"} and got.first()["multiplicity"] == 2
    tested = spark.createDataFrame([("m", False), ("n", True)], "module string, significant boolean")
    assert pipeline.run_regulons(planted, df, tested, tests.PermutationPlan(50, 200)).where("multiplicity > 1").count() == 0
    values = planted.expr.where("gene < 'r'").withColumn("module", F.substring("gene", 1, 1))
    numbers = spark.createDataFrame([("a", 1), ("b", 3)], "module string, number int")
    two = {r["module"]: r["p"] for r in tests.two_stage(values, planted.samples, tests.PermutationPlan(20, 30, every=3), inference.permutation_p, numbers).collect()}
    assert two["b"] is not None


def test_chosen_graphs(spark):
    df = spark.createDataFrame([("LM", "LM", "g"), ("LM", "VBSR", "g"), ("VBSR", "LASSOmin", "g"), ("VBSR", "LM", "g")], "link_mode string, graph_mode string, graph string")
    assert {(r["link_mode"], r["graph_mode"]) for r in graph.chosen_graphs(df).collect()} == {("LM", "VBSR"), ("VBSR", "LASSOmin")}


def test_containers_and_ids(spark):
    assays = spark.createDataFrame([(1, "a", "s", 1.0), (2, "a", "s", 5.0), (2, "b", "s", 6.0)], "assay int, gene string, sample string, value double")
    rows = spark.createDataFrame([("a", 1), ("b", 0)], "gene string, regulator int")
    data = files.read_annotated(assays, rows, spark.createDataFrame([("s", 1)], "sample string, phenotype int"), assay=2)
    assert {(r["gene"], r["value"]) for r in data.expr.collect()} == {("a", 5.0), ("b", 6.0)} and data.genes.where("is_regulator").first()["gene"] == "a"
    names = spark.createDataFrame([("i1", "G1")], "uniq_isos string, iso_gnames string")
    assert {r["gene"] for r in prep.remap_ids(spark.createDataFrame([("i1",), ("i2",)], "gene string"), names).collect()} == {"G1", "i2"}
    assert prep.prune(spark.createDataFrame([("g", 0.0), ("h", -1.0)], "gene string, weight double")).first()["gene"] == "h"
    top = layout.top_or_regulator(spark.createDataFrame([("a", False, 0.3), ("b", True, 0.9), ("c", False, 0.1)], "gene string, is_regulator boolean, p double"), "p", 1)
    assert {r["gene"] for r in top.collect()} == {"b", "c"}


def test_messages_come_in_order(spark, planted):
    for args, say in (
        ((None, None, None), "lognorm_est_counts field empty"),
        (("text", [], []), "matrix class is required for input dataset"),
        ((planted.expr.withColumn("value", F.lit("1")), [], []), "non-numeric values inside lognorm_est_counts variable"),
        ((planted.expr.withColumn("gene", F.lit(None).cast("string")), [], []), "null field detected in row names or column names, check lognorm_est_counts matrix"),
        ((planted.expr, None, []), "target_filtered_idx field empty"),
        ((planted.expr, ["a0"], None), "regulator_filtered_idx field empty"),
        ((planted.expr, ["a0"], ["r0"]), "the total number of genes is not equal to the sum of target_filtered_idx and regulatory_filtered_idx lengths"),
    ):
        with pytest.raises(ValueError) as found:
            validate.check_network(*args)
        assert str(found.value) == say
    validate.check_network(planted.expr, [f"{c}{k}" for c in "ab" for k in range(10)], [f"r{k}" for k in range(4)])
    for args, say in (((None,), "dataset field empty"), (("x",), "matrix or dataframe class is required"), ((planted.genes,), "non-numeric values inside dataset variable")):
        with pytest.raises(ValueError, match=say):
            validate.check_cliques(*args)
    for args, say in (((None, False, True), "Path to the graph object must be specified"), (("p", False, True), "graph object in the specified folder must exist"), (("p", True, "x"), "non-logical variable pass to this cliquesbool argument")):
        with pytest.raises(ValueError, match=say):
            validate.check_report(*args)


def test_four_correlation_matrices(planted):
    found = assoc.label_correlations(prep.with_phenotype(planted)).where("gene_a = 'a0' and gene_b = 'a1'").first()
    assert found["r1"] > 0.9 and found["diff"] == pytest.approx(found["r0"] - found["r1"]) and abs(found["r"]) < 1


def test_ranks_and_adjustments_of_values_that_change(spark):
    """Values that differ each time they are computed, as sums added in another order do, keep their ranks and corrections."""
    import random

    anew = F.udf(lambda k: k + random.random() / 2, "double").asNondeterministic()
    df = spark.range(40).select("id", (anew("id") / 100).alias("p"))
    assert [r["rank"] for r in average_rank(df, "p", []).orderBy("id").collect()] == list(range(1, 41))
    assert all(r["q"] is not None for r in adjust_p(df, "p", "BH", "q").collect())


@pytest.mark.parametrize("mode", ["LM", "LASSOmin", "LASSOparam3"])
def test_modules_of_sums_are_those_of_rows(spark, mode, monkeypatch):
    """Discovery and graphs from sums of products over samples, which kernels get where samples are many, are those of the matrix; no kernel gets the samples."""
    rng = np.random.default_rng(21)
    n = 1100
    regs = rng.normal(size=(3, n)) + 5
    targets = np.vstack([*(regs[k % 2] + rng.normal(0, 1.5, n) for k in range(6)), regs[0] * regs[2], np.full(n, 2.0)])
    genes = [*(f"r{k}" for k in range(3)), *(f"t{k}" for k in range(8))]
    expr = _expr(spark, np.vstack([regs, targets]), genes, [f"s{k}" for k in range(n)])
    roles = spark.createDataFrame([(g, g[0] == "r") for g in genes], "gene string, is_regulator boolean")
    params = inference.DiscoveryParams(modules=3, bootstraps=2, iterations=3, mode=mode)

    def both():
        found = inference.discover_modules(expr, roles, params).orderBy("bootstrap", "module", "role", "gene").toPandas()
        edges = inference.module_graphs(expr, spark.createDataFrame(found[["bootstrap", "module", "role", "gene", "beta"]]), mode).orderBy("bootstrap", "module", "regulator", "target").toPandas()
        return found, edges

    with monkeypatch.context() as m:
        m.setattr(inference, "_fewer_sums", lambda *a: False)
        plain = both()
    monkeypatch.setattr(inference.moments, "RANGE_NUMBERS", 3000)
    monkeypatch.setattr(inference, "_matrix", None)  # whoever pivots the samples fails
    for got, want in zip(both(), plain, strict=True):
        assert len(want) > 3 and list(got.columns) == list(want.columns) and len(got) == len(want)
        for c in want.columns:
            if want[c].dtype.kind == "f":
                assert np.allclose(got[c], want[c], rtol=1e-7, atol=1e-7, equal_nan=True), c
            else:
                assert (got[c] == want[c]).all(), c


def test_last_of_the_smallest_digests(spark):
    """The cut of each draw is found from a window of digests, and from a wider one where that misses it."""
    import hashlib

    names = [f"s{k}" for k in range(500)]
    df = spark.createDataFrame([(s,) for s in names], "sample string")
    for size in (0, 1, 170, 500):
        for spread in (6.0, 1e-3):
            got = inference.moments.last_of_smallest(df, [0, 3], 500, size, 7, spread)
            for d in (0, 3):
                order = sorted(names, key=lambda s: (hashlib.md5(f"7:{d}:{s}".encode()).hexdigest(), s))
                inside = inference.moments.chosen(7, d, [s.encode() for s in names], got[d])
                assert {s for s, on in zip(names, inside, strict=True) if on} == set(order[:size])


def test_permutations_by_sums_are_those_of_rows(spark, monkeypatch):
    """Statistics from sums over samples, which are dealt over tasks, are those of a kernel with all samples of a module; no kernel gets those."""
    rng = np.random.default_rng(22)
    n = 900
    label = np.arange(n) % 3 == 0
    common = rng.normal(size=n)
    a = np.where(label, common, 0) + rng.normal(size=(3, n)) + 4
    b = np.vstack([rng.normal(size=(2, n)), np.where(label, 1.0, rng.normal(size=n))])  # its last gene is constant within a label
    genes = ["a0", "a1", "a2", "b0", "b1", "b2", "c0"]
    names = [f"s{k}" for k in range(n)]
    values = _expr(spark, np.vstack([a, b, common]), genes, names).withColumn("module", F.substring("gene", 1, 1))
    samples = spark.createDataFrame([*((s, int(v)) for s, v in zip(names, label, strict=True)), ("other", None)], "sample string, phenotype int")
    tables = lambda: [f(values, samples, 20).orderBy("module", *x).toPandas() for f, x in ((inference.permutation_p, ()), (inference.permutation_null, ("draw",)))]
    with monkeypatch.context() as m:
        m.setattr(inference, "_draw_sums", lambda *a: None)
        plain = tables()
    monkeypatch.setattr(inference, "TASK_DIGESTS", 5000)
    monkeypatch.setattr(inference, "BLOCK_SAMPLES", 70)
    monkeypatch.setattr(inference, "_matrix", None)
    for got, want in zip(tables(), plain, strict=True):
        assert len(got) == len(want) > 2 and (got["module"] == want["module"]).all()
        assert all(np.allclose(got[c], want[c], equal_nan=True) for c in want.columns[1:])
    assert plain[0]["p"][0] == pytest.approx(1 / 21) and np.isnan(plain[0]["p"][2])


def test_sets_of_genes_are_their_edges(spark, sf_small):
    """Support, its graphs, regulons and counts from sets are those of the edges that the sets stand for, and no edge of a graph is a row of a shuffle."""
    from corrweave import catalogue

    rng = np.random.default_rng(23)
    rows = [(int(g), rng.choice(9, 2, False).tolist(), (10 + rng.choice(9, 3, False)).tolist()) for g in rng.integers(0, 150, 300)] + [(149, [1], []), (3, [], [10])]
    sets = spark.createDataFrame(rows, "graph int, regulators array<int>, targets array<int>")
    names = [f"m{k:03d}" for k in range(150)]
    edges = spark.createDataFrame(sorted({(names[g], t, r) for g, rs, ts in rows for r in rs for t in ts}), "graph string, target int, regulator int").withColumn("weight", F.lit(1.0))
    support = evidence.set_support(sets, 150, 3)
    got = support.select("regulator", "target", "support", evidence.graph_names(names).alias("graphs"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evidence.edge_support(edges).collect()))
    own = {(names[r["graph"]], r["driver"], tuple(sorted(r["targets"])), r["degree"]) for r in evidence.set_regulons(sets, 3).collect()}
    assert own == {(r["graph"], r["driver"], tuple(r["targets"]), r["degree"]) for r in evidence.regulons(edges).collect()}
    assert tuple(evidence.run_overview_of(evidence.support_counts(support), 9, 9, 10).first()) == tuple(evidence.run_overview(edges, 9, 9, 10).first())
    assert sorted(map(tuple, graph.vertex_degree(support, "support").collect())) == sorted(map(tuple, graph.vertex_degree(edges).collect()))
    for name in ("edge_support", "vertex_degree", "run_overview"):
        plan = catalogue.QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString().split("Generate explode(targets")
        below = plan[-1]
        assert len(plan) > 1 and "Exchange" in below and "HashAggregate" in plan[-2].rsplit("Exchange", 1)[-1], name


def test_regulons_merge_by_sums(spark):
    """Fisher's combination by sums is that of the sorted list; a p of 0 gives 0."""
    rows = [("a", "d1", ["x", "y"], 0.2), ("b", "d1", ["x"], 0.05), ("c", "d1", ["x"], 0.9), ("a", "d2", ["z"], 0.0)]
    got = {(r["driver"], r["target"]): (r["p"], r["multiplicity"]) for r in evidence.merge_regulons(spark.createDataFrame(rows, "graph string, driver string, targets array<string>, p double")).collect()}
    qs = [0.0, 0.1, 0.2 * 4 / 3, 0.9]
    want = spark.createDataFrame([(qs[1:],)], "q array<double>").select(fisher_combined(F.col("q"))).first()[0]
    assert got["d1", "x"] == (pytest.approx(want), 3) and got["d2", "z"] == (0.0, 1) and got["d1", "y"] == (pytest.approx(qs[2]), 1)


def test_overlaps_of_bits_are_those_of_joins(spark, monkeypatch):
    """Pairs of modules counted by products of bits are those that meet through shared genes."""
    rng = np.random.default_rng(24)
    rows = sorted({(f"m{a:02d}", f"g{b}") for a, b in zip(rng.integers(0, 70, 400), rng.integers(0, 60, 400), strict=True)})
    members = spark.createDataFrame(rows, "module string, gene string")
    for disjoint in (False, True):
        got = evidence.module_overlaps(members, 60, disjoint)
        assert "gene" not in got._jdf.queryExecution().optimizedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(evidence, "MAX_MODULES", 5)
            want = evidence.module_overlaps(members, 60, disjoint)
        columns = ["m1", "m2", "a", "b", "c", "d", "p"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert evidence.module_overlaps(spark.createDataFrame([(1, "x"), (2, "x")], "module int, gene string"), 3).count() == 3


def test_fisher_tails_of_large_tables(spark):
    """A tail takes as many terms as count, not as many as the table has."""
    import math

    def tail(a, b, c, d):
        row, col, n = a + b, a + c, a + b + c + d
        ln = lambda x: math.lgamma(x + 1)
        return sum(math.exp(ln(row) + ln(n - row) + ln(col) + ln(n - col) - ln(n) - ln(x) - ln(row - x) - ln(col - x) - ln(n - row - col + x)) for x in range(a, min(row, col) + 1))

    cells = [(4100, 900, 900, 300), (3760, 1240, 1240, 400), (3700, 1300, 1300, 300), (30, 9000, 8, 9000)]
    df = spark.createDataFrame([*cells, (1_000_000_000,) * 4], "a long, b long, c long, d long")
    up = [r["p"] for r in tests.fisher_p(df, "a", "b", "c", "d", "greater", "p").collect()]
    down = [r["p"] for r in tests.fisher_p(df, "a", "b", "c", "d", "less", "p").collect()]
    assert up[:4] == pytest.approx([tail(*c) for c in cells], rel=1e-7, abs=1e-12)
    assert down[:4] == pytest.approx([tail(b, a, d, c) for a, b, c, d in cells], rel=1e-7, abs=1e-12)
    assert up[4] == pytest.approx(0.5, abs=1e-3) and down[4] == pytest.approx(0.5, abs=1e-3)
