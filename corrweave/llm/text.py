"""Vectorised words over UTF-8 bytes.

Both word patterns of this subpackage are decided byte by byte: white space is ASCII, and every byte of a
non-ASCII character is 0x80 or above, so word limits found on bytes are the limits on characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: True for bytes of words of ``[^\x20\x09-\x0D]+``.
SPACED = ~_WHITE
#: True for bytes of words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(20240607)
_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size + 1, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    """Words of a block of texts: byte limits in ``data``, 64-bit hashes, and for each text the first word's number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of length texts + 1
    hash: np.ndarray
    offset: np.ndarray  # where each text begins in data; of length texts + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, a newline after each, and their offsets."""
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 if t else 1 for t in texts], out=offset[1:])
    return np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8), offset


def words_of(texts: list[bytes | None], table: np.ndarray, lower: bool = True) -> Words:
    """Words whose bytes are true in ``table``; null is an empty text."""
    data, offset = join_texts(texts)
    if lower:
        data = _LOWER[data]
    inside = table[data]
    inside[offset[1:] - 1] = False
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * power[: len(data)], out=total[1:])
    hashed = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, np.searchsorted(start, offset), hashed, offset)


def window_hashes(hashed: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every ``width`` consecutive hashes; limits between texts are the caller's affair."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix64(out + hashed[k : k + n] * np.uint64(2 * k + 3) + np.uint64(k + 1))
    return out


#: Rows and bytes of the batches that Spark hands to Python: texts are long, and every task holds a batch on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def limit_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches, as programs that run these operators on long texts should; the operators themselves leave the session as it is. Results do not depend on it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Who keeps something in this Python worker between tasks, and what frees it.
_kept: list[tuple[str, Callable[[], None]]] = []


def keep(name: str, free: Callable[[], None]) -> None:
    """Say that an operator keeps a cache from one task to the next; another operator's task in this worker frees it first."""
    _free_others(name)
    _kept[:] = [(name, free)]


def _free_others(name: str) -> None:
    if _kept and _kept[0][0] != name:
        _kept.pop()[1]()
        give_back()


def give_back() -> None:
    """Hand freed memory back to the machine: workers live on, and the next one's memory comes beside theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES, keeper: str = "") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Pieces of the batches with at most ``size`` bytes of text each (or one row), and their texts as bytes. ``keeper`` names the operator, if it keeps a cache."""
    _free_others(keeper)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary() if not pa.types.is_large_string(batch.schema.field(text).type) else pa.large_binary())
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        begin, held = 0, 0
        for k, n in enumerate(lengths):
            if k > begin and held + n > size:
                yield batch.slice(begin, k - begin), column.slice(begin, k - begin).to_pylist()
                begin, held = k, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin), column.slice(begin).to_pylist()
    if not keeper:  # a keeper's next task needs the memory again
        give_back()
