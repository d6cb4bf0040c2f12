"""Benchmark decontamination by winnowing.

Of each window of ``t - k + 1`` consecutive k-gram hashes the smallest is kept, on both sides by one rule, so that any
shared span of t words shares a kept fingerprint. Documents' fingerprints are joined with the benchmark's, and hits are
extended: each window of t words around one is looked up among the benchmark's windows by its hash. Words are 64-bit
hashes throughout; in memory, a window that is found is also compared word hash by word hash. Items shorter than the window are spans of their own length, winnowed at that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.llm.text import ALNUM, blocks, window_hashes, words_of
from corrweave.plans.shared import materialize

#: Words of a benchmark window.
WINDOW = 10
#: A benchmark of up to so many bytes of text is indexed in memory and broadcast; a larger one is joined by shuffles.
BROADCAST_BYTES = 32 << 20


def gram_size(t: int) -> int:
    """Words of the k-grams for spans of t words."""
    return (t + 1) // 2


def fingerprints(hashed: np.ndarray, first: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (first words) and hashes of the kept k-grams of a block of texts, whose words ``first`` limits."""
    k = gram_size(t)
    w = t - k + 1
    gram = window_hashes(hashed, k)
    if len(hashed) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(gram, w).argmin(1) + np.arange(len(gram) - w + 1)
    inside = np.zeros(len(hashed) + 1, np.int64)  # windows that lie in one text
    size = np.diff(first)
    long = size >= t
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, first[1:][long] - t + 1, -1)
    at = np.unique(least[np.cumsum(inside)[: len(least)] > 0])
    return at, gram[at]


@dataclass(frozen=True)
class _Length:
    """Items' spans of one length: kept fingerprints (sorted), window hashes (sorted), where each is found in the item words, and the items that have it (begin, items)."""

    t: int
    prints: np.ndarray
    windows: np.ndarray
    at: np.ndarray
    begin: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class BenchmarkIndex:
    """All windows of a benchmark."""

    names: list[str]
    words: np.ndarray
    lengths: list[_Length]

    @staticmethod
    def of_items(rows: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> BenchmarkIndex:
        names = sorted({name for name, _ in rows if name is not None})
        number = {name: k for k, name in enumerate(names)}
        w = words_of([text for _, text in rows], ALNUM)
        lengths = []
        for t in sorted({min(int(n), window) for n in w.counts if n}):
            mine = [k for k, n in enumerate(w.counts.tolist()) if n and min(n, window) == t]
            hashes = window_hashes(w.hash, t)
            start = np.concatenate([np.arange(w.first[k], w.first[k + 1] - t + 1) for k in mine])
            owner = np.concatenate([np.full(w.counts[k] - t + 1, number.get(rows[k][0], -1)) for k in mine])
            prints = [fingerprints(w.hash[w.first[k] : w.first[k + 1]], np.array([0, w.counts[k]]), t)[1] for k in mine]
            windows, at, where = np.unique(hashes[start], return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([where, owner], 1)[owner >= 0], axis=0)
            lengths.append(_Length(t, np.unique(np.concatenate(prints)), windows, start[at], np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1]))
        return BenchmarkIndex(names, w.hash, lengths)

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Words of each text, its hit spans (first word, end) and the items whose windows it has."""
        w = words_of(texts, ALNUM)
        n = len(w.hash)
        cover = np.zeros(n + 1, np.int64)
        found: list[np.ndarray] = []
        for one in self.lengths:
            at, print_ = fingerprints(w.hash, w.first, one.t)
            if not len(at):
                continue
            spot = np.minimum(np.searchsorted(one.prints, print_), len(one.prints) - 1)
            at = at[one.prints[spot] == print_]
            if not len(at):
                continue
            text = np.searchsorted(w.first, at, "right") - 1
            back = np.arange(one.t - gram_size(one.t) + 1)
            start = (at[:, None] - back).ravel()
            owner = np.repeat(text, len(back))
            fits = (start >= w.first[owner]) & (start + one.t <= w.first[owner + 1])
            start, keep = np.unique(start[fits], return_index=True)
            owner = owner[fits][keep]
            if not len(start):
                continue
            words = w.hash[start[:, None] + np.arange(one.t)]
            hashed = window_hashes(words.ravel(), one.t)[:: one.t]
            spot = np.minimum(np.searchsorted(one.windows, hashed), len(one.windows) - 1)
            same = one.windows[spot] == hashed
            same[same] = (self.words[one.at[spot[same]][:, None] + np.arange(one.t)] == words[same]).all(1)
            np.add.at(cover, start[same], 1)
            np.add.at(cover, start[same] + one.t, -1)
            hits = np.unique(np.stack([owner[same], spot[same]], 1), axis=0)
            sizes = one.begin[hits[:, 1] + 1] - one.begin[hits[:, 1]]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.repeat(one.begin[hits[:, 1]] - upto[:-1], sizes) + np.arange(upto[-1])
            found.append(np.unique(np.stack([np.repeat(hits[:, 0], sizes), one.items[flat]], 1), axis=0))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[list[str]] = [[] for _ in texts]
        if found:
            hit = np.cumsum(cover)[:n] > 0
            edge = np.diff(hit.view(np.int8), prepend=np.int8(0), append=np.int8(0))
            limits = np.unique(np.concatenate([np.flatnonzero(edge), w.first[(w.first > 0) & (w.first < n)]]))
            for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
                if hit[a]:
                    k = int(np.searchsorted(w.first, a, "right")) - 1
                    spans[k].append((a - int(w.first[k]), b - int(w.first[k])))
            for k, item in np.unique(np.concatenate(found), axis=0).tolist():
                items[k].append(self.names[item])
        return w.counts, spans, items


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def benchmark_rows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))


def fits_in_memory(benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the benchmark's text, with its ids, stays under the bound for a broadcast."""
    size = benchmark_rows(benchmark).agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    return size <= limit


def load_index(benchmark: DataFrame) -> BenchmarkIndex:
    """Index of a benchmark whose size ``fits_in_memory`` has checked."""
    return BenchmarkIndex.of_items([(r[0], bytes(r[1]) if r[1] is not None else None) for r in benchmark_rows(benchmark).collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Where documents repeat benchmark items.

    Returns ``id_col``, n_words, ``spans`` (hit words as (start, end) pairs, ends exclusive, in order, disjoint) and
    ``items`` (ids as text, sorted as text, each once). Words are lower-cased (A-Z) runs of letters, digits and
    characters beyond ASCII; a window is ten words of an item, or a shorter item whole. Null and empty texts have no
    words; items without words have no windows; an item without an id hits words but is not listed; repeated rows each
    get a row; other columns are not read; empty tables on either side give no hits. A benchmark above ``limit`` bytes
    goes through shuffles instead of a broadcast, with the same results.
    """
    if not fits_in_memory(benchmark, limit):
        return _find_by_shuffle(docs, benchmark, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(load_index(benchmark))  # its size is checked above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, text_col):
            n, spans, items = shared.value.search(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))], [id_col, "n_words", "spans", "items"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, that repeat no benchmark window.

    Null and empty texts repeat none and stay; repeated rows are judged alike; rows without an id are judged like any
    other; an empty benchmark drops nothing; columns of any name pass, for the join's are its own.
    """
    if not fits_in_memory(benchmark):
        leaking = _find_by_shuffle(docs, benchmark, id_col, text_col).where(F.size("spans") > 0).select(F.col(id_col).alias("_leaking")).distinct()
        return docs.join(leaking, docs[id_col].eqNullSafe(leaking["_leaking"]), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(load_index(benchmark))  # its size is checked above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, text_col):
            _, spans, _ = shared.value.search(texts)
            yield rows.filter(pa.array([not s for s in spans], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _windows(kind: str, lengths: list[int], key: str):
    """A mapInArrow function: of rows (key, text) the fingerprints or all windows as (key, t, at, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            w = words_of(texts, ALNUM)
            for t in lengths:
                if kind == "prints":
                    at, h = fingerprints(w.hash, w.first, t)
                else:
                    h = window_hashes(w.hash, t)
                    at = np.arange(len(h))
                    owner = np.searchsorted(w.first, at, "right") - 1
                    fits = at + t <= w.first[owner + 1]
                    at, h = at[fits], h[fits]
                owner = np.searchsorted(w.first, at, "right") - 1
                if key == "item":  # an item is spans of one length
                    mine = np.minimum(w.counts[owner], WINDOW) == t
                    owner, at, h = owner[mine], at[mine], h[mine]
                if kind == "prints":
                    once = np.unique(np.stack([owner.astype(np.uint64), h], 1), axis=0)
                    owner, h = once[:, 0].astype(np.int64), once[:, 1]
                    at = np.zeros(len(owner), np.int64)
                if len(owner):
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), pa.array(np.full(len(owner), t, np.int32)), pa.array(at - w.first[owner]), pa.array(h.view(np.int64))], [key, "t", "at", "h"])

    return run


def _find_by_shuffle(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same result for benchmarks of any size: fingerprints are joined, and the windows of documents with a common fingerprint are."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words_of(texts, ALNUM).counts)], ["row", "n_words"])

    items = benchmark_rows(benchmark)
    spec = "{} string, t int, at long, h long"
    lengths = list(range(1, WINDOW + 1))
    prints = items.mapInArrow(_windows("prints", lengths, "item"), spec.format("item")).select("t", "h").distinct()
    lengths = sorted(r[0] for r in prints.select("t").distinct().collect())
    windows = items.mapInArrow(_windows("all", lengths, "item"), spec.format("item")).select("t", "h", "item").distinct()
    #: A row is named by its id and its text, for ids that repeat.
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text")).withColumn("row", F.concat_ws(":", F.col("_id").cast("string"), F.xxhash64("text"), F.sha1("text")))
    texts = named.select("row", "text")
    mine = texts.mapInArrow(_windows("prints", lengths, "row"), spec.format("row"))
    candidates = materialize(mine.join(prints, ["t", "h"], "left_semi").select("row").distinct(), "candidates")
    held = texts.dropDuplicates(["row"]).join(candidates, "row", "left_semi")
    hits = held.mapInArrow(_windows("all", lengths, "row"), spec.format("row")).join(windows, ["t", "h"])
    marks = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("t")).alias("end")))).alias("marks"), F.array_sort(F.collect_set("item")).alias("items"))
    last = lambda acc: F.element_at(acc, -1)
    merged = F.aggregate(
        "marks",
        F.array().cast(_SPANS),
        lambda acc, m: F.when((F.size(acc) > 0) & (m["at"] <= F.coalesce(last(acc)["end"], F.lit(-1))), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], m["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(m["at"].alias("start"), m["end"].alias("end"))))),
    )
    joined = named.select(F.col("_id").alias(id_col), "row").join(texts.mapInArrow(sizes, "row string, n_words long").distinct(), "row").join(marks.select("row", merged.alias("spans"), "items"), "row", "left")
    return joined.select(id_col, "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
