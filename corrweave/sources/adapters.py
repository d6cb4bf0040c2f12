"""Measurements and module sets from the driver's tables, in the library's canonical long form.

expr(gene, sample, value); samples(sample, phenotype); genes(gene, is_regulator); module members
(module, bootstrap, gene, role); edges (graph, target, regulator, weight).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrweave.plans.shared import plan_bytes


@dataclass(frozen=True)
class ExprSet:
    """Long measurements, gene roles and sample labels: the container that operators exchange."""

    expr: DataFrame
    genes: DataFrame
    samples: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(prefix: str, column, width: int):
    return F.concat(F.lit(prefix), F.lpad(column.cast("string"), width, "0"))


def embedding_set(spark: SparkSession, sf_dir: str) -> ExprSet:
    """Genes are the dimensions of ``embeddings`` (regulators the first eight), samples its vectors; labels 0-4 are phenotype 0, 5-8 are 1, others none."""
    raw = table(spark, sf_dir, "embeddings").select(_name("s", F.col("vec_id"), 6).alias("sample"), "embedding", "label")
    expr = raw.select("sample", F.posexplode("embedding").alias("pos", "value")).select(_name("g", F.col("pos"), 2).alias("gene"), "sample", F.col("value").cast("double").alias("value"))
    samples = raw.select("sample", F.when(F.col("label") <= 4, 0).when(F.col("label") <= 8, 1).alias("phenotype"))
    genes = expr.select("gene").distinct().withColumn("is_regulator", F.col("gene") < "g08")
    return ExprSet(expr, genes, samples)


def supplier_set(spark: SparkSession, sf_dir: str) -> ExprSet:
    """Genes are suppliers (regulators those with a key below 10), samples customers' nations; values ln(1 + sales), 0 without any; labels the region's parity."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    sales = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("l_suppkey", "c_nationkey").agg(F.sum("l_extendedprice").alias("v"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    grid = suppliers.crossJoin(F.broadcast(nation.select(F.col("n_nationkey").alias("c_nationkey"))))  # 25 nations
    filled = grid.join(sales, ["l_suppkey", "c_nationkey"], "left")
    expr = filled.select(_name("sup", F.col("l_suppkey"), 5).alias("gene"), _name("n", F.col("c_nationkey"), 2).alias("sample"), F.log1p(F.coalesce("v", F.lit(0.0))).alias("value"))
    genes = suppliers.select(_name("sup", F.col("l_suppkey"), 5).alias("gene"), (F.col("l_suppkey") < 10).alias("is_regulator"))
    samples = nation.select(_name("n", F.col("n_nationkey"), 2).alias("sample"), F.pmod("n_regionkey", F.lit(2)).alias("phenotype"))
    return ExprSet(expr, genes, samples)


def brand_set(spark: SparkSession, sf_dir: str) -> ExprSet:
    """Genes are brands (regulators those whose number ends in 5 or less), samples suppliers; values summed quantities; labels the nation's parity."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    expr = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("gene"), _name("sup", F.col("l_suppkey"), 5).alias("sample")).agg(F.sum("l_quantity").alias("value"))
    genes = part.select(F.col("p_brand").alias("gene")).distinct().withColumn("is_regulator", F.substring("gene", -1, 1) <= "3")
    samples = table(spark, sf_dir, "supplier").select(_name("sup", F.col("s_suppkey"), 5).alias("sample"), F.pmod("s_nationkey", F.lit(2)).alias("phenotype"))
    return ExprSet(expr, genes, samples)


def module_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module (a brand in a bootstrap), bootstrap (part size modulo 10), part, gene (a supplier of the part), role (regulator if the key is a multiple of 10)."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.pmod("p_size", F.lit(10)).alias("bootstrap"))
    module = F.concat_ws(":", F.col("p_brand"), F.col("bootstrap").cast("string"))
    role = F.when(F.pmod("l_suppkey", F.lit(10)) == 0, "regulator").otherwise("target")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(module.alias("module"), F.col("bootstrap").cast("int").alias("bootstrap"), F.col("l_partkey").alias("part"), _name("sup", F.col("l_suppkey"), 5).alias("gene"), role.alias("role"))


def module_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module, bootstrap, gene, role of all suppliers of a module's parts."""
    return module_parts(spark, sf_dir).select("module", "bootstrap", "gene", "role").distinct()


@dataclass(frozen=True)
class CodedSets:
    """Sets of genes of graphs as numbers: rows (graph, regulators, targets), graph a place in ``graphs``, which is sorted, and genes numbers that ``gene_of`` names; ``tasks`` is how many to deal them over. Each set's regulators have edges to its targets."""

    rows: DataFrame
    graphs: list[str]
    tasks: int


#: Bytes of ``lineitem`` for each partition of the sets, and names of modules that are coded by number.
SET_BYTES, MAX_GRAPHS = 4_000_000, 2_000


def gene_code(key):
    """A supplier's name as a number: its first five characters."""
    text = key.cast("string")
    return F.when(F.length(text) <= 5, key.cast("int")).otherwise(F.substring(text, 1, 5).cast("int"))


def gene_of(code):
    """The name of a number of ``gene_code``."""
    return _name("sup", code, 5)


def coded_parts(spark: SparkSession, sf_dir: str) -> CodedSets | None:
    """The parts' suppliers by module, as ``module_parts`` has them; None for more modules than ``MAX_GRAPHS``.

    A part is one row: its suppliers are collected where its lines meet, and named when all is added up.
    """
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    module = F.concat_ws(":", F.col("p_brand"), F.pmod("p_size", F.lit(10)).cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", module.alias("module"))
    names = sorted(r["module"] for r in part.select("module").distinct().limit(MAX_GRAPHS + 1).collect())
    if not names or len(names) > MAX_GRAPHS:
        return None
    place = F.broadcast(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "module string, graph int"))  # its size is checked above
    tasks = max(8, -(-plan_bytes(table(spark, sf_dir, "lineitem")) // SET_BYTES))
    sets = line.where("l_partkey is not null and l_suppkey is not null").repartition(tasks, "l_partkey").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("keys"))
    coded = sets.join(part.join(place, "module").select("p_partkey", "graph"), F.col("l_partkey") == F.col("p_partkey"))
    pick = lambda regulator: F.transform(F.filter("keys", lambda k: (F.pmod(k, F.lit(10)) == 0) == F.lit(regulator)), gene_code)
    return CodedSets(coded.select("graph", pick(True).alias("regulators"), pick(False).alias("targets")), names, tasks)


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph (a module), target, regulator, weight: an edge where both supply a part of the module, a sixteenth for each such part."""
    sets = coded_parts(spark, sf_dir)
    if sets is None:
        parts = module_parts(spark, sf_dir)
        r = parts.where("role = 'regulator'").select(F.col("module").alias("graph"), "part", F.col("gene").alias("regulator"))
        t = parts.where("role = 'target'").select("part", F.col("gene").alias("target"))
        return r.join(t, "part").groupBy("graph", "target", "regulator").agg((F.count("*") / 16.0).alias("weight"))
    dealt = sets.rows.select("graph", F.explode("regulators").alias("regulator"), "targets").repartition(sets.tasks, "graph", "regulator")
    counted = dealt.select("graph", "regulator", F.explode("targets").alias("target")).groupBy("graph", "regulator", "target").agg((F.count("*") / 16.0).alias("weight"))
    names = F.array(*map(F.lit, sets.graphs))
    return counted.select(F.get(names, F.col("graph")).alias("graph"), gene_of(F.col("target")).alias("target"), gene_of(F.col("regulator")).alias("regulator"), "weight")


def rewired_modules(members: DataFrame) -> DataFrame:
    """module, bootstrap, rewired: a deterministic stand-in for the permutation test's verdicts."""
    return members.select("module", "bootstrap").distinct().withColumn("rewired", F.substring(F.md5("module"), 1, 1) < "6")


#: The same views in DuckDB SQL; each is one or more common table expressions.
E_SQL = """raw AS (SELECT concat('s', lpad(vec_id::varchar, 6, '0')) AS sample, embedding, label FROM embeddings),
expr AS (SELECT concat('g', lpad(i::varchar, 2, '0')) AS gene, sample, embedding[i + 1]::double AS value FROM raw, range(64) t(i)),
samples AS (SELECT sample, CASE WHEN label <= 4 THEN 0 WHEN label <= 8 THEN 1 END AS phenotype FROM raw),
genes AS (SELECT DISTINCT gene, gene < 'g08' AS is_regulator FROM expr)"""
L_SQL = """sales AS (SELECT l_suppkey, c_nationkey, sum(l_extendedprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
expr AS (SELECT concat('sup', lpad(s_suppkey::varchar, 5, '0')) AS gene, concat('n', lpad(n_nationkey::varchar, 2, '0')) AS sample, ln(1 + coalesce(v, 0.0)) AS value FROM supplier CROSS JOIN nation LEFT JOIN sales ON l_suppkey = s_suppkey AND c_nationkey = n_nationkey),
genes AS (SELECT concat('sup', lpad(s_suppkey::varchar, 5, '0')) AS gene, s_suppkey < 10 AS is_regulator FROM supplier),
samples AS (SELECT concat('n', lpad(n_nationkey::varchar, 2, '0')) AS sample, n_regionkey % 2 AS phenotype FROM nation)"""
B_SQL = """expr AS (SELECT p_brand AS gene, concat('sup', lpad(l_suppkey::varchar, 5, '0')) AS sample, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
genes AS (SELECT DISTINCT p_brand AS gene, right(p_brand, 1) <= '3' AS is_regulator FROM part),
samples AS (SELECT concat('sup', lpad(s_suppkey::varchar, 5, '0')) AS sample, s_nationkey % 2 AS phenotype FROM supplier)"""
M_SQL = """parts AS (SELECT DISTINCT concat(p_brand, ':', (p_size % 10)::varchar) AS module, (p_size % 10)::int AS bootstrap, l_partkey AS part, concat('sup', lpad(l_suppkey::varchar, 5, '0')) AS gene, CASE WHEN l_suppkey % 10 = 0 THEN 'regulator' ELSE 'target' END AS role FROM lineitem JOIN part ON l_partkey = p_partkey),
members AS (SELECT DISTINCT module, bootstrap, gene, role FROM parts),
flags AS (SELECT DISTINCT module, bootstrap, substr(md5(module), 1, 1) < '6' AS rewired FROM members)"""
G_SQL = M_SQL + """,
edges AS (SELECT r.module AS graph, t.gene AS target, r.gene AS regulator, count(*)::double / 16 AS weight FROM parts r JOIN parts t ON r.part = t.part AND r.role = 'regulator' AND t.role = 'target' GROUP BY 1, 2, 3)"""
