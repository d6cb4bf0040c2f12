"""Sums of products over samples, for kernels that need no more of a matrix: what a task or a kernel holds is bounded by the genes, however many samples there are.

Samples are rows of all their values. Subsets of samples that are ordered by MD5 of seed, draw and name are found by
their last member, so that any task can tell which samples are in.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corrweave.plans.shared import drop, materialize

#: Numbers of a range of samples that one task orders.
RANGE_NUMBERS = 4_000_000


def rows_of(cells: DataFrame, *keep: str) -> DataFrame:
    """sample, v: the values of each sample by their number ``at``, written to the shared folder; ``keep`` are columns that depend on the sample alone."""
    row = F.array_sort(F.collect_list(F.struct("at", "value")))
    wide = cells.groupBy("sample", *keep).agg(row.alias("_v"))
    return materialize(wide.select("sample", *keep, F.transform("_v", lambda s: s["value"]).alias("v"), F.transform("_v", lambda s: s["at"]).alias("_at")), "rows")


def complete(rows: DataFrame, width: int) -> int | None:
    """How many samples there are, or None if one lacks a value, or has one twice."""
    whole = (F.size("_at") == width) & (F.size(F.array_distinct("_at")) == width) & (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    found = rows.agg(F.count("*").alias("n"), F.count_if(whole).alias("ok"), F.countDistinct("sample").alias("names")).first()
    return found["n"] if found["n"] == found["ok"] == found["names"] else None


def digests(seed: int, draw: int, names: list[bytes]) -> list[bytes]:
    """MD5 of seed, draw and name, as bytes, which are ordered as their hexadecimal digits are."""
    prefix = f"{seed}:{draw}:".encode()
    md5 = hashlib.md5
    return [md5(prefix + s).digest() for s in names]


def _heads(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), ">u8")[::2]


def chosen(seed: int, draw: int, names: list[bytes], last: tuple[bytes, bytes] | None) -> np.ndarray:
    """Which of the names are not behind the last one that is in; None is nobody."""
    if last is None:
        return np.zeros(len(names), bool)
    found = digests(seed, draw, names)
    head = _heads(found)
    cut = np.frombuffer(last[0], ">u8")[0]
    out = head < cut
    for k in np.flatnonzero(head == cut).tolist():
        out[k] = (found[k], names[k]) <= last
    return out


def last_of_smallest(samples: DataFrame, draws: list[int], n: int, size: int, seed: int, spread: float = 6.0) -> dict[int, tuple[bytes, bytes] | None]:
    """draw to (digest, name) of the ``size``-th of n samples by MD5 of seed, draw and name.

    Digests are spread evenly, so the one looked for lies near ``size`` / n of their range: tasks count those below a
    window around that place and send those inside alone, some ``spread`` deviations to either side. A draw whose
    window missed it is searched again in a wider one, which at last is everything.
    """
    if size <= 0 or n <= 0 or not draws:
        return dict.fromkeys(draws)
    share = min(size, n) / n
    wide = spread * math.sqrt(max(share * (1 - share), 1 / n) / n)
    top = (1 << 64) - 1
    low, high = (np.uint64(min(max(int(b * top), 0), top)) for b in (max(share - wide, 0.0), min(share + wide, 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [s.encode() for s in batch.column(0).to_pylist()]
            out: list[tuple] = []
            for d in draws if names else []:
                found = digests(seed, d, names)
                head = _heads(found)
                inside = np.flatnonzero((head >= low) & (head <= high)).tolist()
                out.append((d, int((head < low).sum()), None, None))
                out += [(d, 0, found[k], names[k]) for k in inside]
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["draw", "below", "digest", "name"])

    near = materialize(samples.select("sample").mapInArrow(run, "draw int, below long, digest binary, name binary"), "near")
    below = near.groupBy("draw").agg(F.sum("below").alias("_below"))
    place = F.row_number().over(W.partitionBy("draw").orderBy("digest", "name"))
    at = near.where("digest is not null").withColumn("_place", place).join(F.broadcast(below), "draw").where(F.col("_place") + F.col("_below") == min(size, n))  # one row a draw
    out = {r["draw"]: (bytes(r["digest"]), bytes(r["name"])) for r in at.select("draw", "digest", "name").collect()}  # one row a draw
    drop(near.sparkSession, near)
    missed = [d for d in draws if d not in out]
    if missed and wide < 1:
        out |= last_of_smallest(samples, missed, n, size, seed, spread * 8)
    return out


def _products(v: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(v), 1)), v])
    return x.T @ x


def _values(batch: pa.RecordBatch, k: int, width: int, centre: np.ndarray) -> np.ndarray:
    return np.asarray(batch.column(k).flatten(), float).reshape(-1, width) - centre


def fold_sums(rows: DataFrame, n: int, centre: np.ndarray, draws: list[int | None], size: int, seed: int, fold: np.ndarray | None) -> DataFrame:
    """draw, sums: of each draw the sums of products of (1, values less ``centre``) over its ``size`` smallest samples, for each fold, and over the others, last; one row or more for each draw, to be added. Draw None is all samples.

    ``fold`` deals the samples that are in, in order of their names. So samples are ordered in ranges, and a table of one
    row a range says how many are in before it.
    """
    spark, width = rows.sparkSession, len(centre)
    ranges = max(1, -(-n * width // RANGE_NUMBERS))
    ordered = materialize(rows.select("sample", "v").repartitionByRange(ranges, "sample").withColumn("_range", F.spark_partition_id()), "ranges")
    last = last_of_smallest(ordered, [d for d in draws if d is not None], n, size, seed)
    folds = 1 if fold is None else int(fold.max()) + 1
    shared = spark.sparkContext.broadcast((last, fold, centre))  # a row a draw, a byte a sample, a number a gene

    def inside(draw: int | None, names: list[bytes]) -> np.ndarray:
        return np.ones(len(names), bool) if draw is None else chosen(seed, draw, names, shared.value[0][draw])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [s.encode() for s in batch.column(1).to_pylist()]
            at = np.asarray(batch.column(0), np.int32)
            for d in range(len(draws)):
                own = np.bincount(at[inside(draws[d], names)], minlength=1)
                on = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), d, np.int32)), pa.array(on.astype(np.int32)), pa.array(own[on].astype(np.int64))], ["d", "_range", "n"])

    before: dict[tuple[int, int], int] = {}
    if fold is not None:
        counted = ordered.select("_range", "sample").mapInArrow(count, "d int, _range int, n long").groupBy("d", "_range").agg(F.sum("n").alias("n")).collect()  # draws x ranges
        sums = [0] * len(draws)
        for r in sorted(counted, key=lambda r: (r["d"], r["_range"])):
            before[r["d"], r["_range"]] = sums[r["d"]]
            sums[r["d"]] += r["n"]

    def add(table: pa.Table) -> pa.Table:
        _, deal, middle = shared.value
        at = table.column("_range")[0].as_py()
        names = [s.encode() for s in table.column("sample").to_pylist()]
        order = np.array(sorted(range(len(names)), key=names.__getitem__), int)
        names = [names[k] for k in order.tolist()]
        v = np.asarray(table.column("v").combine_chunks().flatten(), float).reshape(-1, width)[order] - middle
        out = []
        for d, draw in enumerate(draws):
            own = inside(draw, names)
            parts = np.zeros((folds + 1, width + 1, width + 1))
            kept, place = v[own], before.get((d, at), 0)
            dealt = np.zeros(len(kept), int) if deal is None else deal[place : place + len(kept)]
            for f in range(folds):
                parts[f] = _products(kept[dealt == f])
            parts[folds] = _products(v[~own])
            out.append(parts.tobytes())
        return pa.table({"d": pa.array(range(len(draws)), pa.int32()), "sums": pa.array(out, pa.binary())})

    return ordered.groupBy("_range").applyInArrow(add, "d int, sums binary")


def added(sums: list[bytes], width: int) -> np.ndarray:
    """The sums of one draw over all ranges: for each fold, and last for the samples that are not in."""
    total = None
    for s in sums:
        own = np.frombuffer(s).reshape(-1, width + 1, width + 1)
        total = own.copy() if total is None else np.add(total, own, out=total)
    return total
