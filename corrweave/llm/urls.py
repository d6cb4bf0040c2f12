"""URL filters by a path-template tree.

For each host, paths are generalised level by level: under a template, a segment that enough pages share stays literal,
and the others become one wildcard. Sibling branches that continue alike, and whose labels do not contradict each other,
are merged at every level and pool their labels, so that branches without labels are judged by those that they are like.
A template is rejected if the smoothed share of blocked labels in its branch is high. Nothing runs in Python on the
executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrweave.plans.shared import drop, materialize


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Copies of a small side for joins on a host, so that one host's rows are dealt over so many tasks.
SALTS = 16


@dataclass(frozen=True)
class UrlParams:
    """Least pages of a literal segment, of a branch's pages that a continuation needs to mark it, most total variation of a branch from those it is merged with, most standard errors between their label rates, and the least labels of a branch that can contradict; weight of the prior, share of blocked labels for a rejection, the least labels for one, and the least share of a branch's pages that must be labelled for its verdict to reach the others."""

    least_rows: int = 5
    marking: float = 0.2
    most_variation: float = 0.3
    most_errors: float = 2.0
    least_labels: int = 5
    prior_weight: float = 4.0
    reject_at: float = 0.8
    least_cover: float = 0.25


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rules(rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits columns ``host`` and ``path``; null without one. Rules are configuration: they are the branches of one expression."""
    out = F.when(F.lit(False), F.lit(None).cast("struct<rule:string,verdict:string>"))
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        out = out.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return out


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")


def templates(pages: DataFrame, params: UrlParams) -> DataFrame:
    """``pages`` (page_id, host, path, label) with ``template``, an array of literal segments and ``*``, one for each segment of the path.

    A segment under a template is literal if ``least_rows`` pages have it there: a number, not a share, so that a host
    may have any number of sections. Each level is one aggregation, with partial sums, and one join with the literals,
    which is salted against hot hosts. Levels go on while any template has so many pages with deeper segments; from
    there on every segment is a wildcard.
    """
    segments = F.filter(F.split("path", "/", -1), lambda s: s != "")
    now = pages.select("*", segments.alias("segments")).withColumn("template", F.array().cast("array<string>")).withColumn("salt", _salt())
    level, written = 0, []
    while True:
        segment = F.get("segments", F.lit(level))
        counts = materialize(now.where(F.size("segments") > level).groupBy("host", "template", segment.alias("segment")).agg(F.count("*").alias("rows")), "counts")
        most = counts.groupBy("host", "template").agg(F.sum("rows").alias("total")).agg(F.max("total")).first()[0] or 0
        if most < params.least_rows:
            drop(pages.sparkSession, counts)
            break
        literal = counts.where(F.col("rows") >= params.least_rows).select("host", "template", "segment", F.lit(True).alias("literal"))
        step = now.withColumn("segment", segment).join(_salted(literal), ["host", "template", "segment", "salt"], "left")
        grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.when(F.col("literal"), F.col("segment")).otherwise(F.lit("*")))))
        now = materialize(step.withColumn("template", grown).drop("segment", "literal"), "templates")
        drop(pages.sparkSession, counts, *written)
        written, level = [now], level + 1
    rest = F.array_repeat(F.lit("*"), F.greatest(F.size("segments") - level, F.lit(0)))
    return now.withColumn("template", F.concat("template", rest)).drop("segments", "salt")


def _merge_level(leaf: DataFrame, level: int, params: UrlParams) -> DataFrame:
    """``leaf`` with siblings of one level merged: the segment of ``branch`` at ``level`` becomes ``~`` and a mark in branches that are alike.

    Siblings under one branch whose frequent continuations are the same form a candidate group; a member whose
    continuations, or whose labels, differ too much from the group as a whole keeps its name. So every sibling is
    compared once, with a sum over its group, and no pairs are made.
    """
    deep = leaf.where(F.size("branch") > level)
    cut = deep.select("host", F.slice("branch", 1, level).alias("parent"), F.get("branch", F.lit(level)).alias("child"), F.array_join(F.slice("branch", level + 2, 1 << 30), "/").alias("tail"), "rows", "labels", "bad")
    tails = materialize(cut.groupBy("host", "parent", "child", "tail").agg(*(F.sum(c).alias(c) for c in ("rows", "labels", "bad"))), "tails")
    node = tails.groupBy("host", "parent", "child").agg(F.sum("rows").alias("n_rows"), F.sum("labels").alias("n_labels"), F.sum("bad").alias("n_bad"))
    shares = tails.select("host", "parent", "child", "tail", "rows").join(node, ["host", "parent", "child"])
    frequent = F.when(F.col("rows") >= params.marking * F.col("n_rows"), F.col("tail"))
    marked = shares.groupBy("host", "parent", "child", "n_rows", "n_labels", "n_bad").agg(F.xxhash64(F.array_sort(F.collect_set(frequent))).alias("mark"))
    marked = materialize(marked, "marked")
    group = marked.groupBy("host", "parent", "mark").agg(F.count("*").alias("members"), F.sum("n_rows").alias("g_rows"), F.sum("n_labels").alias("g_labels"), F.sum("n_bad").alias("g_bad")).where("members > 1")
    members = materialize(marked.join(group, ["host", "parent", "mark"]), "members")
    own = tails.select("host", "parent", "child", "tail", "rows").join(members, ["host", "parent", "child"])
    pooled = own.groupBy("host", "parent", "mark", "tail").agg(F.sum("rows").alias("t_rows"))
    p, q = F.col("rows") / F.col("n_rows"), F.col("t_rows") / F.col("g_rows")
    #: Total variation: half the sum of |p - q|; tails that the branch lacks add what is left of q.
    variation = own.join(pooled, ["host", "parent", "mark", "tail"]).groupBy("host", "parent", "child").agg(((F.sum(F.abs(p - q)) + 1 - F.sum(q)) / 2).alias("variation"))
    rate, whole = F.try_divide("n_bad", "n_labels"), F.try_divide("g_bad", "g_labels")
    error = F.sqrt(F.greatest(whole * (1 - whole), F.lit(0.01)) / F.nullif(F.col("n_labels"), F.lit(0)))
    agrees = (F.col("n_labels") < params.least_labels) | (F.abs(rate - whole) <= params.most_errors * error)
    alike = members.join(variation, ["host", "parent", "child"]).where((F.col("variation") <= params.most_variation) & agrees)
    names = materialize(alike.select("host", "parent", "child", F.concat(F.lit("~"), F.lower(F.hex("mark"))).alias("name")), "names")
    keyed = leaf.withColumn("parent", F.slice("branch", 1, level)).withColumn("child", F.get("branch", F.lit(level)))
    named = keyed.join(names, ["host", "parent", "child"], "left")
    renamed = F.when(F.col("name").isNull(), F.col("branch")).otherwise(F.concat("parent", F.array("name"), F.slice("branch", level + 2, 1 << 30)))
    out = materialize(named.select("host", "template", renamed.alias("branch"), "rows", "labels", "bad"), "leaves")
    drop(leaf.sparkSession, tails, marked, members, names)
    return out


def template_verdicts(paged: DataFrame, params: UrlParams) -> DataFrame:
    """host, template, branch (its segments, those of merged branches marked), purity, blocked for each template."""
    spark = paged.sparkSession
    leaf = paged.groupBy("host", "template").agg(F.count("*").alias("rows"), F.count("label").alias("labels"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    leaf = materialize(leaf.withColumn("branch", F.col("template")), "leaves")
    named = F.array_max(F.transform("template", lambda s, i: F.when(s != "*", i + 1).otherwise(0)))
    deepest = leaf.agg(F.max(named)).first()[0] or 0
    for level in range(deepest):
        before, leaf = leaf, _merge_level(leaf, level, params)
        drop(spark, before)
    sums = leaf.groupBy("host", "branch").agg(F.sum("rows").alias("g_rows"), F.sum("labels").alias("n"), F.sum("bad").alias("k"))
    prior = leaf.agg(((F.sum("bad") + 1) / (F.sum("labels") + 2)).alias("prior"))
    purity = (F.col("k") + params.prior_weight * F.col("prior")) / (F.col("n") + params.prior_weight)
    known = (F.col("n") >= params.least_labels) & (F.col("n") >= params.least_cover * F.col("g_rows"))
    scored = sums.crossJoin(F.broadcast(prior)).select("host", "branch", purity.alias("purity"), (known & (purity >= params.reject_at)).alias("blocked"))  # one row
    return leaf.select("host", "template", "branch").join(scored, ["host", "branch"]).select("host", "template", F.array_join("branch", "/").alias("branch"), "purity", "blocked")


def judge_urls(pages: DataFrame, rules: list[Rule], params: UrlParams = UrlParams(), id_col: str = "page_id", url_col: str = "url", label_col: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, branch and purity for each row of ``pages``.

    The longest rule that fits decides; else the page's template does, by the labels of the branch that it was merged
    into. Labels are ``label_col`` (1 blocked, 0 allowed, null unlabelled) or, without one, the verdicts of the rules. A
    url that is null or has no ``://`` has an empty host and path, like any other host. Repeated rows each get a row;
    other columns are not read; an empty table gives an empty result.
    """
    url = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), (F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")).alias("given"))
    host, path = split_url(F.col("url"))
    ruled = url.select("page_id", host.alias("host"), path.alias("path"), "given").withColumn("match", match_rules(rules))
    label = F.col("given") if label_col else F.when(F.col("match.verdict") == "block", 1).when(F.col("match.verdict") == "allow", 0)
    paged = templates(ruled.select("page_id", "host", "path", "match", label.alias("label")), params)
    verdicts = _salted(template_verdicts(paged, params))
    out = paged.withColumn("salt", _salt()).join(verdicts, ["host", "template", "salt"], "left")
    verdict = F.coalesce(F.col("match.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), F.array_join("template", "/").alias("template"), "branch", "purity")
