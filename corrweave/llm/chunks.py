"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text, and a chunk ends where its top bits are zero: limits depend on the bytes
around them alone, so that an insertion moves the limits near it and no others. Chunks are deduplicated by digest over
all documents; runs of repeated chunks are the repeated passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.llm.text import blocks, join_texts
from corrweave.plans.shared import materialize

#: Bytes that the hash looks back over: one shift drops each byte after 32 steps.
REACH = 32
#: Chunks at the start of a shared passage that may differ: limits there still depend on what stands before it.
LEAD = 2
_GEAR = np.random.default_rng(97).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


@dataclass(frozen=True)
class ChunkParams:
    """Top bits of the hash that must be zero at a limit, least and most bytes of a chunk, the least words of a run of repeated chunks for a repeated passage, and the least words that the passage could have: a run's own, and those of the chunks that its ends lie in."""

    bits: int = 4
    least: int = 16
    most: int = 128
    min_words: int = 12
    passage_words: int = 51


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, in five doublings instead of one step a byte."""
    h = _GEAR[data]
    reach = 1
    while reach < REACH:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def cut_points(text: bytes, params: ChunkParams, hashes: np.ndarray | None = None) -> list[int]:
    """Ends of the chunks of one text. A limit never parts a character; the last chunk ends with the text.

    Where no hash ends a chunk in time, the smallest one within reach does (the first of equal ones): such limits, too,
    come from the content, so that long periodic stretches are cut alike wherever they begin.
    """
    n = len(text)
    if n == 0:
        return []
    data = np.frombuffer(text, np.uint8)
    h = gear_hashes(data) if hashes is None else hashes
    begins = np.append((data[1:] & 0xC0) != 0x80, True)
    spots = (np.flatnonzero((h >> np.uint32(32 - params.bits) == 0) & begins) + 1).tolist()
    ends, at = [], 0
    for spot in [*spots, n]:
        while spot - at > params.most:
            fits = np.flatnonzero(begins[at + params.least - 1 : at + params.most]) + at + params.least
            at = int(fits[h[fits - 1].argmin()])
            ends.append(at)
        if spot - at >= params.least or spot == n:
            if spot > at:
                ends.append(spot)
            at = spot
    return ends


def chunk_table(docs: DataFrame, params: ChunkParams = ChunkParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, d1 and d2 (128 bits of the digest), at and end (bytes), words (that begin in the chunk), and before and after (those of the ``LEAD`` chunks before it and of the one after it) of every chunk of every whole text."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("d1", "d2")), *(T.StructField(c, T.IntegerType()) for c in ("at", "end", "words", "before", "after"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, text_col):
            data, offset = join_texts(texts)
            h = gear_hashes(data)
            white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
            begin_word = np.zeros(len(data) + 1, np.int64)
            np.cumsum(~white & np.concatenate([[True], white[:-1]]), out=begin_word[1:])
            owner: list[int] = []
            at: list[int] = []
            end: list[int] = []
            digests: list[bytes] = []
            for k, text in enumerate(texts):
                if not text:
                    continue
                #: The first bytes' hashes look back over the text before in the block; they are taken anew.
                o = int(offset[k])
                own = h[o : o + len(text)].copy()
                own[: REACH - 1] = gear_hashes(np.frombuffer(text[: REACH - 1], np.uint8))
                ends = cut_points(text, params, own)
                begins = [0, *ends[:-1]]
                owner += [k] * len(ends)
                at += begins
                end += ends
                digests += [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begins, ends, strict=True)]
            if not owner:
                continue
            start = offset[owner]
            words = begin_word[start + np.array(end)] - begin_word[start + np.array(at)]
            first = np.array(at) == 0
            upto = np.concatenate([[0], np.cumsum(words)])
            place = np.arange(len(words))
            start_of = np.maximum.accumulate(np.where(first, place, 0))
            before = upto[place] - upto[np.maximum(place - LEAD, start_of)]
            after = np.where(np.append(first[1:], True), 0, np.append(words[1:], 0))
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(at, pa.int32()), pa.array(end, pa.int32()), *(pa.array(x.astype(np.int32)) for x in (words, before, after))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, params: ChunkParams = ChunkParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that a document shares with another: doc_id, at and end (bytes of the UTF-8 text, end exclusive), words, first_doc (the smallest id that has the passage's first chunk), drop (every chunk of it occurs in a document with a smaller id) and earlier (at and end of each span of neighbouring chunks that do, in order, so that what a passage takes from smaller ids is known where it also has chunks that are first seen here).

    A chunk is repeated if two ids have it; neighbouring repeated chunks are one run. Runs of ``min_words`` are passages
    if, with the chunks that their ends lie in, they could have ``passage_words``: those of fewer words for certain are
    left out. A passage is found whole but for the part chunks at its ends. Texts without a
    repeated passage have no row. Null and empty texts have no chunks; repeats within one id alone do not count, so rows
    repeated under one id are one document; rows without an id are not compared; other columns are not read; an empty
    table gives an empty result. Digests are counted with partial sums and joined back with the few that are repeated,
    and a document's runs are found among its own chunks.
    """
    chunks = chunk_table(docs, params, id_col, text_col).where("doc_id is not null")
    #: Smallest and largest id tell whether two documents have a chunk, without a list of them.
    seen = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").select("d1", "d2", "first_doc")
    #: Written, so that both sides of the join are plain exchanges and adaptive execution can split a hot digest.
    seen = materialize(seen, "digests")
    #: Few chunks have fewer than 1024 words: one number carries all three sums.
    packed = chunks.select("doc_id", "d1", "d2", "at", "end", (F.col("words") + 1024 * F.col("before") + (1 << 20) * F.col("after")).alias("words"))
    hits = packed.join(seen.hint("merge"), ["d1", "d2"]).select("doc_id", "at", "end", "words", "first_doc").distinct()
    hits = hits.select("doc_id", "at", "end", "first_doc", *(F.shiftright("words", k).bitwiseAND(1023).alias(c) for k, c in ((0, "words"), (10, "before"), (20, "after"))))
    place = W.partitionBy("doc_id").orderBy("at", "end", "first_doc")
    marked = hits.withColumn("new", F.coalesce(F.col("at") > F.max("end").over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    earlier = F.col("first_doc") < F.col("doc_id")
    parted = marked.withColumn("turn", F.coalesce(earlier != F.lag(earlier).over(place), F.lit(False)).cast("int"))
    rows = place.rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = parted.withColumn("run", F.sum("new").over(rows)).withColumn("part", F.sum("turn").over(rows))
    parts = runs.groupBy("doc_id", "run", "part").agg(
        F.min("at").alias("at"),
        F.max("end").alias("end"),
        F.sum("words").cast("long").alias("words"),
        F.min_by("first_doc", F.struct("at", "end")).alias("first_doc"),
        F.min_by("before", F.struct("at", "end")).alias("before"),
        F.max_by("after", F.struct("end", "at")).alias("after"),
        F.min(earlier).alias("drop"),
    )
    out = parts.groupBy("doc_id", "run").agg(
        F.min("at").alias("at"),
        F.max("end").alias("end"),
        F.sum("words").alias("words"),
        F.min_by("first_doc", F.struct("at", "end")).alias("first_doc"),
        (F.min_by("before", F.struct("at", "end")) + F.max_by("after", F.struct("end", "at"))).alias("edges"),
        F.min("drop").alias("drop"),
        F.array_sort(F.collect_list(F.when(F.col("drop"), F.struct("at", "end")))).alias("earlier"),
    )
    long = (F.col("words") >= params.min_words) & (F.col("words") + F.col("edges") >= params.passage_words)
    return out.where(long).select("doc_id", "at", "end", "words", "first_doc", "drop", "earlier")
