"""MinHash near-duplicates with tensored banding.

Two collections of ``side`` short bands (``rows`` minhashes each) are computed. A table's key is a pair of one band from
each collection, so ``side`` squared tables cost 2 x side x rows minhashes where independent tables would cost
2 x side x side x rows. Documents that share a key are candidates; links are confirmed on full shingle sets.

Within a key no list of all pairs is made. Rows with one set are one class first, whatever their ids, and all that
follows is about classes. Every class of a key is compared with the key's hub, the class that its neighbours resemble
most (the largest sum of the sizes of its keys), and what the hubs link is one component. Classes whose keys still hold
several components are verified by an exact join: sets are sorted by rarity, similar sets must share one of their rarest
shingles, at places that leave room for the overlap that a link takes, and only pairs of different components that pass
are compared in full. Components around one hub are joined by their differences from it instead: in a large group of
near copies any two share most shingles and miss a link by little, but what each changed is its own, so few pairs pass.
No link between classes that share a key is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.llm.text import SPACED, blocks, mix64, window_hashes, words_of
from corrweave.plans.components import connected_components
from corrweave.plans.shared import broadcast_if_small, drop, materialize


@dataclass(frozen=True)
class NearDupParams:
    """Words of a shingle, the least Jaccard similarity in hundredths, bands of each collection, minhashes of a band."""

    words: int = 3
    percent: int = 85
    side: int = 8
    rows: int = 2


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: windows of ``width`` words, or the whole shorter sequence; none without words."""
    w = words_of(texts, SPACED)
    windows = window_hashes(w.hash, width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(w.hash[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _functions(params: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    n = 2 * params.side * params.rows
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _bands(params: NearDupParams) -> tuple[list[str], list[str]]:
    """Columns of the two collections. Each band is a column of its own, so that classes are counted without sorting."""
    return [f"a{k}" for k in range(params.side)], [f"b{k}" for k in range(params.side)]


def signatures(docs: DataFrame, params: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n (size of the set), d1 and d2 (its digest), and the bands of the two collections for each row."""
    left, right = _bands(params)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("text_hash", "n", "d1", "d2", *left, *right))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions(params)
        for rows, texts in blocks(batches):
            sets = shingle_sets(texts, params.words)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(n)
            digests = np.zeros((2, len(sets)), np.uint64)
            bands = np.zeros((2 * params.side, len(sets)), np.uint64)
            if len(full):
                every = np.concatenate([sets[k] for k in full])
                begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                digests[0, full] = np.add.reduceat(mix64(every + np.uint64(1)), begin)
                digests[1, full] = np.add.reduceat(mix64(every ^ np.uint64(0xA5A5A5A55A5A5A5A)), begin)
                for k in range(len(a)):
                    at = k // params.rows
                    bands[at, full] = mix64(bands[at, full] + np.minimum.reduceat(every * a[k] + b[k], begin) + np.uint64(k))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), *(pa.array(x.view(np.int64)) for x in (*digests, *bands))], schema.names)

    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, params: NearDupParams, id_col: str, text_col: str) -> DataFrame:
    """c, shingles (the sorted set) of each class of ``wanted`` (c, rep, rep_hash): one row a class, though rows repeat.

    A class is found by one row's id and text hash, so that texts which share an id do not meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        task = TaskContext.get().partitionId()
        for rows, texts in blocks(batches):
            number = rows.column(0).to_pylist()
            fresh = [k for k, c in enumerate(number) if not (c in seen or seen.add(c))]
            sets = shingle_sets([texts[k] for k in fresh], params.words)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([number[k] for k in fresh], pa.int64()), pa.array(np.full(len(fresh), task, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["c", "task", "shingles"])

    named = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    rows = named.join(wanted, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_hash") == F.col("rep_hash"))).select("c", "text")
    found = materialize(rows.mapInArrow(run, "c long, task int, shingles array<long>"), "sets")
    first = found.groupBy("c").agg(F.min("task").alias("task"), F.count("*").alias("copies"))
    if first.where("copies > 1").isEmpty():
        return found.select("c", "shingles")
    once = materialize(found.join(first.select("c", "task"), ["c", "task"], "left_semi").select("c", "shingles"), "sets")
    drop(docs.sparkSession, found)
    return once


def _close_sizes(a: str, b: str, percent: int) -> Column:
    """Sizes that a link allows: 100 x the smaller >= percent x the larger."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, shared, united: the sizes of the intersection and the union of the full sets of each pair. The join on u comes last: it is the side that may be a hub of very many pairs, and holds one set for each."""
    mine = sets.select(F.col("c").alias("v"), F.col("shingles").alias("sv"))
    hubs = sets.select(F.col("c").alias("u"), F.col("shingles").alias("su"))
    both = pairs.join(mine.hint("merge"), "v").join(hubs.hint("merge"), "u")
    shared = F.size(F.array_intersect("su", "sv"))
    return both.select("u", "v", shared.alias("shared"), (F.size("su") + F.size("sv") - shared).alias("united"))


def _families(classes: DataFrame, kin: DataFrame) -> DataFrame:
    """``classes`` (c, n, component, crowd) with ``family``, and ``hub`` (c, n, component) of families that hold several components.

    A component joins that of the most crowded hub that shares half of the shingles with one of its classes (``kin``: pairs
    u, v of a hub and a class) and is more crowded than its own classes. So a component is in one family as a whole.
    Families decide how pairs are sought, never which are found.
    """
    ends = kin
    for end in "uv":
        ends = ends.join(classes.select(F.col("c").alias(end), F.col("component").alias(f"c{end}"), F.struct("crowd", (-F.col("c")).alias("c")).alias(f"r{end}")), end)
    best = ends.where("cu != cv").groupBy(F.col("cv").alias("component")).agg(F.max("ru").alias("ru"), F.max_by("cu", "ru").alias("cu"))
    own = classes.groupBy("component").agg(F.max(F.struct("crowd", (-F.col("c")).alias("c"))).alias("own"))
    steps = best.join(own, "component").where("ru > own").select(F.col("cu").alias("u"), F.col("component").alias("v"))
    found = connected_components(steps)
    grouped = found.select(F.col("node").alias("component"), F.col("component").alias("family"))
    joined = materialize(classes.join(grouped, "component", "left").withColumn("family", F.coalesce("family", "component")), "joined")
    hubs = joined.groupBy("family").agg(F.max_by(F.struct("c", "n", "component"), F.struct("crowd", -F.col("c"))).alias("hub"), (F.min("component") < F.max("component")).alias("several")).where("several").select("family", "hub")
    families = materialize(joined.join(hubs, "family", "left").select("c", "n", "component", "family", "hub"), "families")
    drop(classes.sparkSession, found, joined)
    return families


def _across_components(families: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of classes in different components that a link's overlap does not rule out, and links (u, v) with the hubs of families. ``sets`` has one row a class.

    An exact prefix filter, in two scopes. Classes of different families are compared by their sets, those of one family
    by how their sets differ from its hub's: near copies share most of their shingles, but few of their edits. In both,
    with lists sorted by how few classes have an item (first those of one family or component alone), the first common
    item of a pair of lists of lengths d and e stands at places x and y, so that they share at most min(d - x, e - y).
    With q = 100 - percent and r = 100 + percent, sets of sizes a and b are linked if r times the size of their symmetric
    difference is at most q (a + b), and that difference is the same for the lists: d + e - 2 x shared. Two classes of one
    family whose lists share nothing are linked only if both are linked with the hub; such links are returned, and two
    classes that both have one are not compared. A list's length and an item's place bound the lengths of lists that can
    match, so that lists meet only those in their ranges of lengths.

    An item's rows are joined with those outside its largest component or family. What a join reads is written first, so
    that both its sides are plain exchanges and a frequent item can be split.
    """
    q, r = 100 - percent, 100 + percent
    others = sets.select(F.col("c").alias("hc"), F.col("shingles").alias("sh"))
    apart = F.concat(F.array_except("shingles", "sh"), F.array_except("sh", "shingles"))
    edited = families.where("hub.c != c").join(sets, "c").withColumn("hc", F.col("hub.c")).join(others.hint("merge"), "hc")
    diffs = materialize(edited.select("c", "n", "component", "family", "hub", apart.alias("items")).withColumn("d", F.size("items").cast("long")), "diffs")
    near = r * F.col("d") <= q * (F.col("n") + F.col("h"))
    to_hubs = diffs.withColumn("h", F.col("hub.n")).where(near & (F.col("component") != F.col("hub.component"))).select(F.col("hub.c").alias("u"), F.col("c").alias("v"))

    same = ["scope", "c", "n", "d", "part", "h"]
    zero = F.lit(0).cast("long")
    by_set = families.join(sets, "c").select((zero - 1).alias("scope"), "c", "n", F.col("n").alias("d"), F.col("family").alias("part"), zero.alias("h"), F.explode("shingles").alias("token"))
    by_diff = diffs.select(F.col("family").alias("scope"), "c", "n", "d", F.col("component").alias("part"), F.col("hub.n").alias("h"), F.explode("items").alias("token"))
    token = by_set.unionByName(by_diff)
    common = token.groupBy("scope", "token").agg(F.count("*").alias("df"), F.min("part").alias("low"), F.max("part").alias("high"))
    common = materialize(common.where("low < high").select("scope", "token", "df"), "counts")
    counted = token.join(common.hint("merge"), ["scope", "token"], "left").select(*same, F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token").alias("t"))
    sorted_ = counted.groupBy(*same).agg(F.array_sort(F.collect_list("t")).alias("tokens"))
    #: Lengths of lists that one of a class can match: ``least`` to ``most`` - 2 x the place.
    slack = F.floor(F.col("n") * q / percent)
    far = F.when(near, F.floor(q * (F.ceil(F.col("n") * percent / 100) + F.col("h")) / r) + 1).otherwise(0)
    ranged = sorted_.withColumns({"whole": F.col("scope") < 0, "near": (F.col("scope") >= 0) & near, "least": F.greatest(F.col("d") - slack, far), "most": F.col("d") + slack, "step": F.greatest(F.lit(1), F.floor(F.col("h") * q / percent / 4))})
    places = F.when(F.col("whole"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).otherwise(F.greatest(F.lit(0), F.floor((F.col("most") - F.col("least")) / 2) + 1))
    prefix = ranged.select("scope", "c", "n", "d", "part", "near", "whole", "least", "most", "step", F.posexplode(F.slice("tokens", F.lit(1), places.cast("int"))).alias("pos", "t"))
    #: Ranges are met in steps: a row for each step of lengths that it can match.
    at = F.when(F.col("whole"), zero).otherwise(F.floor(F.col("d") / F.col("step")))
    to = F.when(F.col("whole"), F.array(zero)).otherwise(F.sequence(F.floor(F.col("least") / F.col("step")), F.floor((F.col("most") - 2 * F.col("pos")) / F.col("step"))))
    rows = materialize(prefix.where("t.df > 1").select("scope", F.col("t.token").alias("token"), "c", "n", "d", "part", "near", "pos", at.alias("at"), F.explode(to).alias("to")), "prefix")
    met = ["scope", "token", "low", "high"]
    rows = rows.withColumns({"low": F.least("at", "to"), "high": F.greatest("at", "to")})
    parts = rows.groupBy(*met, "part").agg(F.count("*").alias("members"))
    largest = parts.groupBy(*met).agg(F.max_by("part", F.struct("members", -F.col("part"))).alias("main"), F.count("*").alias("parts")).where("parts > 1").select(*met, "main")
    largest = materialize(largest, "largest")
    split = materialize(rows.join(largest.hint("merge"), met), "split")
    minor = split.where("part != main").select("scope", "token", F.col("at").alias("to"), F.col("to").alias("at"), F.col("c").alias("v"), F.col("n").alias("b"), F.col("d").alias("e"), F.col("part").alias("pv"), F.col("pos").alias("y"), F.col("near").alias("nv"))
    every = split.select("scope", "token", "at", "to", F.col("c").alias("u"), F.col("n").alias("a"), "d", F.col("part").alias("pu"), F.col("pos").alias("x"), F.col("near").alias("nu"), "main")
    room = 2 * r * F.least(F.col("d") - F.col("x"), F.col("e") - F.col("y")) >= r * (F.col("d") + F.col("e")) - q * (F.col("a") + F.col("b"))
    once = (F.col("pu") == F.col("main")) | (F.col("u") < F.col("v"))
    keys = [every[k] == minor[k] for k in ("scope", "token", "at", "to")]
    passing = every.join(minor.hint("merge"), [*keys, F.col("pu") != F.col("pv"), ~(F.col("nu") & F.col("nv")), _close_sizes("a", "b", percent), room, once])
    pairs = materialize(passing.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    links = materialize(to_hubs, "links")
    drop(families.sparkSession, diffs, common, rows, largest, split)
    return pairs, links


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash.

    Words are lower-cased (A-Z) and split at ASCII white space. ``component_id`` is the smallest id reachable by links,
    ``kept`` whether it is the row's own. Null, empty and blank texts have no shingles, are linked with nothing and are
    kept. Rows repeated under one id each get a row with the same answer. Two texts that share an id are two documents:
    the id links neither to the other's class, and ``text_hash`` (xxhash64 of the text) tells them apart. A row without
    an id takes the smallest id of its component; where no row of that has one, its component is null and it is kept.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    left, right = _bands(params)
    #: Narrow rows, dealt anew so that they are written in few files of a fair size, not one for each piece of input.
    base = materialize(signatures(docs, params, id_col, text_col).hint("rebalance"), "signatures")
    one = base.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("rep_hash"), *(F.first(b).alias(b) for b in (*left, *right)))
    #: Numbered where they are written, so that a class keeps its number.
    classes = materialize(one.withColumn("c", F.monotonically_increasing_id()), "classes")
    tables = classes.select("c", "n", F.posexplode(F.array(*left)).alias("i", "a"), F.array(*right).alias("right")).select("c", "n", "i", "a", F.posexplode("right").alias("j", "b"))
    keys = tables.select(F.xxhash64("i", "j", "a", "b").alias("key"), "c", "n")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(keys.join(sizes.hint("merge"), "key").select("key", "c", "n", "size"), "keys")

    #: The hub of a key: the class whose keys hold most classes in all.
    crowd = shared.groupBy("c").agg(F.sum("size").alias("crowd"))
    ranked = shared.join(crowd, "c")
    hubs = ranked.groupBy("key").agg(F.max_by(F.struct(F.col("c").alias("u"), F.col("n").alias("nu")), F.struct("crowd", -F.col("c"))).alias("hub")).select("key", "hub.u", "hub.nu")
    stars = shared.join(hubs.hint("merge"), "key").where((F.col("u") != F.col("c")) & _close_sizes("n", "nu", params.percent)).select("u", F.col("c").alias("v")).distinct()
    wanted = materialize(classes.select("c", "rep", "rep_hash").join(shared.select("c").distinct(), "c", "left_semi"), "wanted")
    sets = _sets(docs, broadcast_if_small(wanted), params, id_col, text_col)
    linked = F.expr(f"100 * shared >= {params.percent} * united")
    kin = materialize(_overlaps(stars, sets).where(f"100 * shared >= {min(50, params.percent)} * united").select("u", "v", linked.alias("linked")), "kin")
    links = kin.where("linked").select("u", "v")
    found = connected_components(links)

    placed = shared.join(found, shared["c"] == found["node"], "left").select("key", "c", "n", "size", F.coalesce("component", "c").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    open_ = materialize(placed.join(mixed.hint("merge"), "key", "left_semi").groupBy("c", "n", "component").agg(F.sum("size").alias("crowd")), "open")
    families = _families(open_, kin.where("not linked").select("u", "v"))
    rest, to_hubs = _across_components(families, sets, params.percent)
    more = materialize(_overlaps(rest, sets).where(linked).select("u", "v").unionByName(to_hubs), "links")
    labels = found if more.isEmpty() else connected_components(links.unionByName(more))

    #: Classes in no component have keys of their own, so that none is hot; what a join reads is written first, so that adaptive execution can split it.
    named = classes.join(labels, F.col("c") == F.col("node"), "left").select("d1", "d2", "n", "rep", F.col("component"), F.coalesce("component", -1 - F.col("c")).alias("group"))
    least = materialize(named.where("component is not null").groupBy("group").agg(F.min("rep").alias("least")), "least")
    reached = F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least"))
    ids = materialize(named.join(least.hint("merge"), "group", "left").select("d1", "d2", "n", reached.alias("component_id")), "ids")
    drop(spark, shared, wanted, sets, kin, rest, to_hubs, more, open_, families, least, classes, found, labels)
    narrow = base.select("doc_id", "n", "d1", "d2", "text_hash")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash"]
    out = narrow.where("n > 0").join(ids.hint("merge"), ["d1", "d2", "n"]).select(*columns).unionByName(narrow.where("n = 0").withColumn("component_id", F.col("doc_id")).select(*columns))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "text_hash")
