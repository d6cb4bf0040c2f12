"""Language-model scoring by deleted interpolation.

    P(w | h) = l2[b] c(h, w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1),     b = the bucket of c(h), by powers of two

The weights of each bucket are learned by expectation-maximisation on held-out counts: each training token in turn is
deleted from the counts that predict it, so that c(h, w) - 1 of c(h) - 1 and c(w) - 1 of N - 1 are left. The counts of
equal estimates are added up first, so EM runs on a histogram of bounded size.

Counts cover every training text, and bigrams of all words are counted. The most frequent words (a bounded table) have
short numbers, and the most frequent bigrams among them are scored where they are read, from a second bounded table, so
that no group is hot. All other bigrams move in compressed blocks, one for each task and group, and are counted and scored
in their groups. A word outside the table goes to the group of its hash, by itself as a word and as a context, where all
its tokens meet and its own count is found; the other word's count is the table's. Only bigrams of two such words take
joins, with the counts of all words. So no result depends on the tables' sizes. A group sends its sums back by blocks of
texts, packed, so that rows grow with blocks and groups and not with texts and groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrweave.llm.text import SPACED, blocks, mix64, words_of
from corrweave.plans.shared import materialize, plan_bytes

#: The end token's hash.
END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Estimates are binned by quarters of a power of two for EM; the last bin is zero.
_BINS = 200
_BUCKETS = 48


@dataclass(frozen=True)
class LmParams:
    """Words of the table of frequent words (at most 2**21), bigrams of the table of frequent bigrams, bytes of input for a group that bigrams are dealt into (by Spark's estimate; there are as many as shuffle partitions at least), and rounds of EM."""

    words: int = 1 << 20
    hot_bigrams: int = 1 << 20
    group_bytes: int = 6 << 20
    rounds: int = 60


def _bin(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.minimum(np.round(-4 * np.log2(np.maximum(x, 1e-300))), _BINS - 2), _BINS - 1).astype(np.int64)


def _unbin(k: np.ndarray) -> np.ndarray:
    return np.where(k == _BINS - 1, 0.0, 2.0 ** (-k / 4))


def _bucket(c: np.ndarray) -> np.ndarray:
    """0 for contexts never seen in training, else 1 + floor(log2 c)."""
    return np.where(c > 0, 1 + np.floor(np.log2(np.maximum(c, 1))), 0).astype(np.int64)


def expectation_maximisation(cells: dict[tuple[int, int, int], float], uniform: float, rounds: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket from a histogram of (bucket, bigram bin, unigram bin)."""
    weights = np.tile([0.0, 0.9, 0.1], (_BUCKETS, 1))
    keys = np.array(sorted(cells), np.int64).reshape(-1, 3)
    mass = np.array([cells[tuple(k)] for k in keys.tolist()])
    for b in np.unique(keys[:, 0]):
        mine = keys[:, 0] == b
        f = np.stack([_unbin(keys[mine, 1]), _unbin(keys[mine, 2]), np.full(mine.sum(), uniform)], 1)
        m = mass[mine]
        w = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.8, 0.2])
        for _ in range(rounds):
            part = f * w
            w = (part / part.sum(1, keepdims=True) * m[:, None]).sum(0) / m.sum()
        #: No weight of exactly zero for the uniform part, so that every text has a probability.
        weights[b] = (w + [0, 0, 1e-9]) / (1 + 1e-9)
    return weights


@dataclass(frozen=True)
class _Tables:
    """Frequent words by hash with their counts, N and V."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """Number of each word, -1 outside the table."""
        once, where = np.unique(hashed, return_inverse=True)
        if not len(self.hashes):
            return np.full(len(hashed), -1)
        spot = np.minimum(np.searchsorted(self.hashes, once), len(self.hashes) - 1)
        return np.where(self.hashes[spot] == once, spot, -1)[where]


def _tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each text, the places where texts begin, and each token's text."""
    w = words_of(texts, SPACED)
    first = w.first + np.arange(len(w.first))
    hashed = np.insert(w.hash, w.first[1:], END)
    return hashed, first, np.repeat(np.arange(len(texts)), np.diff(first))


def _contexts(numbers: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Number of the word before each token; a text begins after an end."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[first[:-1]] = end
    return before


#: A text's place in its block, the low bits of its row.
_PLACE = (1 << 20) - 1
#: In place of a number: the other word of the bigram is outside the table, too.
_RARE = (1 << 32) - 1
#: Kinds of blocks: bigrams in the table, by number; of a word outside it, by that word's hash; of a context outside it, by that context's hash; of two words outside it, by the hash of both.
_NEAR, _WORD, _CONTEXT, _BOTH = range(4)
#: Small numbers beside each key of a block that counts, and of one that scores.
_COUNTED = {_NEAR: 1, _WORD: 2, _CONTEXT: 2, _BOTH: 3}
_SCORED = {_NEAR: 1, _WORD: 2, _CONTEXT: 2}


def _pack(keys: np.ndarray, *extra: np.ndarray) -> bytes:
    """Sorted keys as differences, and small numbers for each, byte planes compressed."""
    import zstandard

    delta = np.diff(keys, prepend=np.uint64(0))
    planes = [delta.view(np.uint8).reshape(-1, 8), *(np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4) for x in extra)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.T.tobytes() for x in planes))


def _unpack(data: bytes, extra: int) -> list[np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8 + 4 * extra, -1)
    numbers = lambda at, size, kind: np.ascontiguousarray(planes[at : at + size].T).view(kind).ravel()
    return [np.cumsum(numbers(0, 8, np.uint64), dtype=np.uint64), *(numbers(8 + 4 * k, 4, "<u4").astype(np.int64) for k in range(extra))]


def _pack_sums(owner: np.ndarray, known: np.ndarray, base: np.ndarray, logs: np.ndarray) -> bytes:
    """What a group adds to the sums of a block's texts, byte planes compressed."""
    import zstandard

    planes = [owner.astype("<u4").view(np.uint8).reshape(-1, 4), known.astype("<u4").view(np.uint8).reshape(-1, 4), *(x.astype("<f8").view(np.uint8).reshape(-1, 8) for x in (base, logs))]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.T.tobytes() for x in planes))


def _unpack_sums(data: bytes) -> list[np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(24, -1)
    return [np.ascontiguousarray(planes[a:b].T).view(kind).ravel() for a, b, kind in ((0, 4, "<u4"), (4, 8, "<u4"), (8, 16, "<f8"), (16, 24, "<f8"))]


def _group_of(pairs: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(pairs) % np.uint64(groups)).astype(np.int64)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    once, where = np.unique(keys, return_inverse=True)
    return once, np.bincount(where, weights=values, minlength=len(once)).astype(np.int64)


def _pair_sums(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal pairs of hashes added up, in order of the first."""
    order = np.lexsort((w, h))
    h, w, c = h[order], w[order], c[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    return h[at], w[at], np.add.reduceat(c, at) if len(at) else c


def _of_whole(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of sorted keys the sum of the values of all that equal it."""
    once, where = np.unique(keys, return_inverse=True)
    return np.bincount(where, weights=values, minlength=len(once)).astype(np.int64)[where]


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


class _Held:
    """Counts of keys that a task adds up, merged now and then."""

    def __init__(self, limit: int = 1 << 21):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.limit:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _sums(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


def _word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """h, c of every word of the training texts, and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for _, texts in blocks(batches, text_col):
            held.add(_tokens(texts)[0])
            if held.size > held.limit // 2:
                keys, n = held.merged()
                held = _Held()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "c"])
        keys, n = held.merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "c"])

    return train.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, params: LmParams) -> _Tables:
    """The table of words above the count at which it is full."""
    by_count = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()}  # as many rows as there are different counts
    room, least = params.words, 1
    for c in sorted(by_count, reverse=True):
        if by_count[c] > room:
            least = c + 1
            break
        room -= by_count[c]
    top = counts.where(F.col("c") >= least).toArrow()  # params.words rows at most, 16 bytes each
    hashes = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return _Tables(hashes[order], top["c"].to_numpy()[order], sum(c * n for c, n in by_count.items()), sum(by_count.values()))


def _bucket_of(c: Column) -> Column:
    """The same as ``_bucket``, as a column: the binary digits of the count."""
    return F.when(c > 0, F.length(F.bin(c))).otherwise(0)


def _bin_of(x: Column) -> Column:
    return F.when(x > 0, F.least(F.rint(-4 * F.log2(x)).cast("long"), F.lit(_BINS - 2))).otherwise(_BINS - 1)


def _with_counts(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """``ch`` and ``cw``, counts of the words h and w, which are outside the table of frequent words."""
    for side, count in (("h", "ch"), ("w", "cw")):
        pairs = pairs.join(counts.select(F.col("h").alias(side), F.col("c").alias(count)).hint("merge"), side, "left").withColumn(count, F.coalesce(count, F.lit(0)))
    return pairs


def score(docs: DataFrame, learn: Column, params: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows where ``learn`` holds. ``base_score`` is the add-one unigram log10 probability,
    ``score`` the interpolated one. Null and empty texts are an end alone. Without training rows all counts are zero,
    and all probability is uniform. Repeated rows each get a row; other columns are not read; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(docs) // params.group_bytes))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))
    counts = materialize(_word_counts(picked.where("train"), "text"), "words")
    tables = _frequent(counts, params)
    shared = spark.sparkContext.broadcast(tables)  # 16 bytes for each of params.words at most
    n, v = tables.total, tables.distinct
    uniform = 1.0 / (v + 1)
    end = int(tables.numbers(np.array([END]))[0])

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of counted bigrams for each group."""
        table = shared.value
        near, rare = _Held(), {_WORD: [], _CONTEXT: [], _BOTH: []}

        def out() -> Iterator[pa.RecordBatch]:
            pairs, c = near.merged()
            for kind, keys, at, extra in [(_NEAR, pairs, _group_of(pairs, groups), (c,)), *far()]:
                for g in np.unique(at).tolist():
                    mine = at == g
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([kind], pa.int32()), pa.array([_pack(keys[mine], *(x[mine] for x in extra))], pa.binary())], ["g", "kind", "data"])

        def far() -> Iterator[tuple]:
            for kind, parts in rare.items():
                if parts:
                    a, b, c = _pair_sums(*_joined(parts))
                    if kind == _BOTH:
                        yield kind, a, _group_of(mix64(a) ^ b, groups), (b & np.uint64(_RARE), b >> np.uint64(32), c)
                    else:
                        yield kind, a, _group_of(a, groups), (b, c)

        for _, texts in blocks(batches, "text"):
            hashed, first, _ = _tokens(texts)
            number = table.numbers(hashed)
            before = _contexts(number, first, end)
            word, context = number < 0, before < 0
            both = ~word & ~context
            near.add((before[both].astype(np.uint64) << np.uint64(21)) | number[both].astype(np.uint64))
            if not both.all():
                old = _contexts(hashed, first, END)
                named = lambda x: np.where(x < 0, _RARE, x).astype(np.uint64)
                for kind, where, a, b in ((_WORD, word, hashed, named(before)), (_CONTEXT, context, old, named(number)), (_BOTH, word & context, old, hashed)):
                    if where.any():
                        rare[kind].append(_pair_sums(a[where], b[where], np.ones(where.sum(), np.int64)))
            if near.size + 2 * sum(len(p[0]) for parts in rare.values() for p in parts) > near.limit // 2:
                yield from out()
                near, rare = _Held(), {_WORD: [], _CONTEXT: [], _BOTH: []}
        yield from out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each group, the cells of the histogram (kind 0), the most frequent bigrams (kind 1), and all bigrams of two words outside the table (kind 2, h in ``at``)."""
        table = shared.value
        held: dict[int, dict[int, list]] = {}
        names = ["kind", "at", "w", "c"]

        def cells(ch: np.ndarray, cw: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cell = (_bucket(ch) * _BINS + _bin((c - 1) / np.maximum(ch - 1, 1))) * _BINS + _bin((cw - 1) / max(table.total - 1, 1))
            return _sums(cell, c)

        def rows(kind: int, at: np.ndarray, c: np.ndarray, w: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.nulls(len(at), pa.int64()) if w is None else pa.array(w), pa.array(c)], names)

        def close(g: int) -> Iterator[pa.RecordBatch]:
            for kind, parts in held[g].items():
                if kind == _NEAR:
                    pairs, c = _sums(*_joined(parts))
                    yield rows(0, *cells(table.counts[(pairs >> np.uint64(21)).astype(np.int64)], table.counts[(pairs & np.uint64((1 << 21) - 1)).astype(np.int64)], c))
                    top = np.argsort(-c, kind="stable")[: max(1, params.hot_bigrams // groups)]
                    yield rows(1, pairs[top].view(np.int64), c[top])
                elif kind == _BOTH:
                    h, low, high, c = _joined(parts)
                    h, w, c = _pair_sums(h, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), c)
                    yield rows(2, h.view(np.int64), c, w.view(np.int64))
                else:
                    key, other, c = _pair_sums(*_joined(parts))
                    own = _of_whole(key, c)
                    known = other != _RARE
                    counted = table.counts[other[known]] if known.any() else np.zeros(0, np.int64)
                    ch, cw = (counted, own[known]) if kind == _WORD else (own[known], counted)
                    yield rows(0, *cells(ch, cw, c[known]))

        for batch in batches:
            for g, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and g not in held:
                    for k in list(held):
                        yield from close(k)
                    held.clear()
                held.setdefault(g, {}).setdefault(kind, []).append(tuple(_unpack(data, _COUNTED[kind])))
        for k in held:
            yield from close(k)

    dealt = picked.where("train").select("text").mapInArrow(pair_counts, "g int, kind int, data binary").repartition(groups, "g").sortWithinPartitions("g")
    found = materialize(dealt.mapInArrow(total, "kind int, at long, w long, c long"), "bigrams")
    far_pairs = found.where("kind = 2").select(F.col("at").alias("h"), "w", "c")
    counted = _with_counts(far_pairs, counts)
    ratio = lambda c, whole: _bin_of((c - 1) / whole)
    far_cell = (_bucket_of(F.col("ch")) * _BINS + ratio(F.col("c"), F.greatest(F.col("ch") - 1, F.lit(1)))) * _BINS + ratio(F.col("cw"), F.lit(max(n - 1, 1)))
    cells: dict[tuple[int, int, int], float] = {}
    every_cell = found.where("kind = 0").select(F.col("at").alias("cell"), "c").unionByName(counted.select(far_cell.cast("long").alias("cell"), "c"))
    for at, c in every_cell.groupBy("cell").agg(F.sum("c")).collect():  # buckets x bins x bins rows at most
        cells[at // _BINS**2, at // _BINS % _BINS, at % _BINS] = c
    weights = expectation_maximisation(cells, uniform, params.rounds)
    top = found.where("kind = 1").select("at", "c").toArrow()  # params.hot_bigrams rows at most, 16 bytes each
    order = np.argsort(top["at"].to_numpy())
    hot = spark.sparkContext.broadcast((top["at"].to_numpy()[order].astype(np.uint64), top["c"].to_numpy()[order]))

    def log_p(ch: np.ndarray, cw: np.ndarray, chw: np.ndarray) -> np.ndarray:
        w = weights[_bucket(ch)]
        return np.log10(w[:, 0] * chw / np.maximum(ch, 1) + w[:, 1] * cw / max(n, 1) + w[:, 2] * uniform)

    kind_of_id = docs.schema[id_col].dataType.simpleString()
    columns = {"row": "long", "id": kind_of_id, "h": "long", "w": "long", "k": "long", "n_tokens": "long", "n_known": "long", "base": "double", "score": "double", "data": "binary"}
    sent_columns = {"g": "int", "kind": "int", "t": "long"} | columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what is known of its score here; blocks of bigrams for each group (``t`` of a block's texts, the first ones, are training texts); rows for bigrams of two words outside the table.

        ``row`` names a text by task, block and place."""
        table = shared.value
        hot_pairs, hot_counts = hot.value
        task, number_of_block = TaskContext.get().partitionId(), 0

        def batch(size: int, id_type: pa.DataType, **given: pa.Array) -> pa.RecordBatch:
            kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(size, id_type if c == "id" else kinds[t]) for c, t in sent_columns.items()], list(sent_columns))

        for rows, texts in blocks(batches, "text", 2 << 20):
            train = np.array([bool(x) for x in rows.column(2).to_pylist()])
            order = np.argsort(~train, kind="stable")
            texts = [texts[k] for k in order.tolist()]
            n_train, size = int(train.sum()), len(texts)
            base_row = (task << 40) + (number_of_block << 20)
            number_of_block += 1
            hashed, first, owner = _tokens(texts)
            number = table.numbers(hashed)
            before = _contexts(number, first, end)
            word, context = number < 0, before < 0
            both = ~word & ~context
            cw = np.where(word, 0, table.counts[number] if len(table.counts) else 0)
            ch = np.where(context, 0, table.counts[before] if len(table.counts) else 0)
            pairs = np.where(both, (before << 21) | number, 0).astype(np.uint64)
            spot = np.minimum(np.searchsorted(hot_pairs, pairs), max(len(hot_pairs) - 1, 0))
            is_hot = both & (hot_pairs[spot] == pairs) if len(hot_pairs) else np.zeros(len(pairs), bool)
            value = np.zeros(len(pairs))
            if is_hot.any():
                value[is_hot] = log_p(ch[is_hot], cw[is_hot], hot_counts[spot[is_hot]])
            total_of = lambda x: np.bincount(owner, weights=x, minlength=size)
            base = total_of(np.where(word, 0, np.log10((cw + 1) / (n + v + 1))))
            row = base_row + np.arange(size)
            id_type = rows.column(0).type
            yield batch(size, id_type, g=pa.array((np.arange(size) % groups).astype(np.int32)), row=pa.array(row), id=rows.column(0).take(pa.array(order)), n_tokens=pa.array(np.diff(first)), n_known=pa.array(total_of(~word).astype(np.int64)), base=pa.array(base), score=pa.array(total_of(value)))
            old = _contexts(hashed, first, END)
            named = lambda x: np.where(x < 0, _RARE, x)
            for kind, where, key, other in ((_NEAR, both & ~is_hot, pairs, None), (_WORD, word, hashed, named(before)), (_CONTEXT, context, old, named(number))):
                if not where.any():
                    continue
                key, o = key[where], owner[where]
                extra = [o] if other is None else [other[where], o]
                at = _group_of(key, groups)
                sort = np.lexsort((*extra[::-1], key, at))
                key, at, extra = key[sort], at[sort], [x[sort] for x in extra]
                limits = np.searchsorted(at, np.arange(groups + 1)).tolist()
                full = [g for g in range(groups) if limits[g + 1] > limits[g]]
                packed = [_pack(key[limits[g] : limits[g + 1]], *(x[limits[g] : limits[g + 1]] for x in extra)) for g in full]
                m = len(full)
                yield batch(m, id_type, g=pa.array(full, pa.int32()), kind=pa.array(np.full(m, kind, np.int32)), data=pa.array(packed, pa.binary()), t=pa.array(np.full(m, n_train)), row=pa.array(np.full(m, base_row)))
            far = word & context
            if far.any():
                h, w, o = old[far], hashed[far], owner[far]
                sort = np.lexsort((o, w, h))
                h, w, o = h[sort], w[sort], o[sort]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (o[1:] != o[:-1])
                once = np.flatnonzero(new)
                of = row[o[once]]
                yield batch(len(once), id_type, g=pa.array((of % groups).astype(np.int32)), row=pa.array(of), h=pa.array(h[once].view(np.int64)), w=pa.array(w[once].view(np.int64)), k=pa.array(np.diff(np.append(once, len(h)))))

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Count a group's bigrams over training texts and score them for all texts, in one row for each block of texts (``row`` is its first text's); other rows pass."""
        table = shared.value
        group, held = None, {}
        place = {c: list(sent_columns).index(c) for c in sent_columns}

        def scored(kind: int, parts: list[tuple]) -> tuple[np.ndarray, ...]:
            """Rows, and what each token adds to n_known, base and score."""
            t = np.repeat([x[1] for x in parts], [len(x[2][0]) for x in parts])
            start = np.repeat([x[0] for x in parts], [len(x[2][0]) for x in parts])
            key, *other, o = _joined([tuple(x[2]) for x in parts])
            learned = o < t
            once, where = np.unique(key, return_inverse=True)
            count = lambda places, size: np.bincount(places, weights=learned, minlength=size)[places]
            nothing = np.zeros(len(key))
            if kind == _NEAR:
                h, w = (once >> np.uint64(21)).astype(np.int64), (once & np.uint64((1 << 21) - 1)).astype(np.int64)
                logs = log_p(table.counts[h], table.counts[w], np.bincount(where, weights=learned, minlength=len(once)))[where]
                return start + o, nothing, nothing, logs
            other = other[0]
            own = count(where, len(once))
            pair, which = np.unique((where.astype(np.uint64) << np.uint64(32)) | other.astype(np.uint64), return_inverse=True)
            both = count(which, len(pair))
            known = other != _RARE
            counted = np.zeros(len(key))
            counted[known] = table.counts[other[known]] if known.any() else 0
            ch, cw = (counted, own) if kind == _WORD else (own, counted)
            logs = np.zeros(len(key))
            logs[known] = log_p(ch[known], cw[known], both[known])
            if kind == _CONTEXT:
                return start + o, nothing, nothing, logs
            return start + o, (cw > 0).astype(float), np.log10((cw + 1) / (n + v + 1)), logs

        def close(types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
            row, known, base, logs = _joined([scored(k, parts) for k, parts in held.items()])
            once, where = np.unique(row, return_inverse=True)
            sums = [np.bincount(where, weights=x) for x in (known, base, logs)]
            begin = np.flatnonzero(np.diff(once >> 20, prepend=-1)).tolist()
            packed = [_pack_sums(once[a:b] & _PLACE, *(x[a:b] for x in sums)) for a, b in zip(begin, [*begin[1:], len(once)], strict=True)]
            given = {"row": pa.array(once[begin] & ~_PLACE), "data": pa.array(packed, pa.binary())}
            yield pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(len(begin), types[c]) for c in columns], list(columns))

        types = {}
        for batch in batches:
            types = {c: batch.column(place[c]).type for c in columns}
            data = batch.column(place["data"])
            plain = batch.filter(data.is_null())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([plain.column(place[c]) for c in columns], list(columns))
            blob = batch.filter(data.is_valid())
            for g, kind, raw, t, row in zip(*(blob.column(place[c]).to_pylist() for c in ("g", "kind", "data", "t", "row")), strict=True):
                if g != group and held:
                    yield from close(types)
                    held = {}
                group = g
                held.setdefault(kind, []).append((row, t, _unpack(raw, _SCORED[kind])))
        if held:
            yield from close(types)

    spec = lambda of: ", ".join(f"{c} {t}" for c, t in of.items())
    sent = picked.select("id", "text", "train").mapInArrow(send, spec(sent_columns)).repartition(groups, "g").sortWithinPartitions("g")
    partial = materialize(sent.mapInArrow(receive, spec(columns)), "partial")
    table = spark.createDataFrame([(int(b), *map(float, w)) for b, w in enumerate(weights)], "bucket int, l2 double, l1 double, l0 double")
    seen = partial.where("h is not null").select("row", "h", "w", "k").join(far_pairs.select("h", "w", F.col("c").alias("chw")).hint("merge"), ["h", "w"], "left")
    far = _with_counts(seen, counts).withColumn("bucket", _bucket_of(F.col("ch"))).join(F.broadcast(table), "bucket")  # as many rows as buckets
    ch, cw, chw = F.col("ch"), F.col("cw"), F.coalesce(F.col("chw"), F.lit(0))
    logs = F.log10(F.col("l2") * chw / F.greatest(ch, F.lit(1)) + F.col("l1") * cw / F.lit(float(max(n, 1))) + F.col("l0") * F.lit(uniform))
    kept = ("id", "n_tokens", "n_known", "base")
    resolved = far.select("row", *(F.lit(None).cast(columns[c]).alias(c) for c in kept), (F.col("k") * logs).alias("score"), F.lit(None).cast("binary").alias("data"))
    every = partial.where("h is null").select("row", *kept, "score", "data").unionByName(resolved)
    final = {"id": kind_of_id, "n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each text of a block: its own row, bigrams of two words outside the table, and what each group packed."""
        block, plain, packed = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(plain)
            place = rows["row"].to_numpy() & _PLACE
            texts = np.flatnonzero(np.array(rows["n_tokens"].is_valid()))
            size = int(place.max()) + 1
            sums = [np.bincount(place, weights=rows[c].fill_null(0).to_numpy().astype(float), minlength=size) for c in ("n_known", "base", "score")]
            for owner, *values in map(_unpack_sums, packed):
                for held, x in zip(sums, values, strict=True):
                    held[owner] += x
            known, base, logs = (x[place[texts]] for x in sums)
            own = rows.take(pa.array(texts)).combine_chunks()
            columns_out = [own["id"].combine_chunks(), own["n_tokens"].combine_chunks(), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(logs)]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns_out], list(final))

        for batch in batches:
            blocks_of = batch.column(0).to_numpy() >> 20
            begin = np.flatnonzero(np.diff(blocks_of, prepend=-1)).tolist()
            for a, b in zip(begin, [*begin[1:], batch.num_rows], strict=True):
                if block is not None and blocks_of[a] != block:
                    yield from close()
                    plain, packed = [], []
                block = blocks_of[a]
                part = batch.slice(a, b - a)
                data = part.column(part.schema.get_field_index("data"))
                packed += data.drop_null().to_pylist()
                plain.append(part.filter(data.is_null()))
        if block is not None:
            yield from close()

    block = F.shiftright("row", 20)
    out = every.repartition(block).sortWithinPartitions(block).mapInArrow(gather, spec(final))
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
