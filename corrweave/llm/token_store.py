"""Token ids on disk: one zstandard frame for each document under a shared dictionary.

A store is a folder with ``dictionary.zst``, shard files and ``manifest.json`` (shards in order, with their totals).
A shard file is, little-endian:

    8 bytes   b"CWTOKS01"
    32 bytes  SHA-256 of the dictionary (of nothing, if the store has none)
    frames    one for each document: its ids as unsigned integers of ``width`` bytes
    index     n x (doc_id int64, known uint8), then (n + 1) x frame offset uint64, then n x ids uint64
    footer    n uint64, width uint64, where the index begins uint64, b"CWTOKEND"

so that one document is read with three short reads: footer, index, frame. Shards hold ascending doc_ids (null first),
and no shard's ids come after the next one's; rows with one id may be dealt over several shards. A shard is written as
its documents are encoded, and its file is moved into place when whole: a task that runs again after a lost executor
writes the same bytes under the same name.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.llm.bpe import ChunkCache, plain_pretokens
from corrweave.llm.text import blocks, keep
from corrweave.plans.shared import plan_bytes

MAGIC, END = b"CWTOKS01", b"CWTOKEND"
#: Chunks kept with their ids in one Python worker (beyond that, the more frequent half stays).
CACHE_CHUNKS = 1_400_000


@dataclass(frozen=True)
class StoreParams:
    """Bytes of an id, the id that ends a document, documents that the dictionary is trained on (those whose ids have the smallest hashes), bytes of each (in pieces from all over a longer one) and of the dictionary, zstandard's level, and bytes of input for a shard (by Spark's estimate). The dictionary decides about the files' size alone: every whole document is stored."""

    width: int = 4
    end_id: int = 1
    sample_docs: int = 500
    sample_bytes: int = 1 << 16
    dictionary_bytes: int = 1 << 16
    level: int = 3
    shard_bytes: int = 8 << 20


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(uri: str, data: bytes) -> None:
    """The file appears whole or not at all."""
    filesystem, path = _filesystem(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with filesystem.open_output_stream(part, compression=None) as out:
        out.write(data)
    filesystem.move(part, path)


def _read(uri: str, at: int = 0, size: int | None = None) -> bytes:
    """``size`` bytes from ``at`` (from the end, if negative)."""
    filesystem, path = _filesystem(uri)
    with filesystem.open_input_file(path) as file:
        if at:
            file.seek(at if at >= 0 else file.size() + at)
        return file.read(size) if size is not None else file.read()


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> ChunkCache:
    """Ids by the tokenizers library, for distinct white-space separated chunks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    suffix = json.loads(library.to_str())["model"].get("end_of_word_suffix")
    closes = np.array([bool(suffix) and (library.id_to_token(i) or "").endswith(suffix) for i in range(library.get_vocab_size())])
    marked = bool(closes.any())

    def by_place(chunks: list[bytes]) -> list[list[int]]:
        """One call for all chunks, joined by blanks; the tokens' places tell the chunks."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        upto = np.cumsum([len(t) + 1 for t in texts])
        found = library.encode(" ".join(texts), add_special_tokens=False)
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.offsets))
        limits = np.searchsorted(at, upto, "left").tolist()
        ids = found.ids
        return [ids[a:b] for a, b in zip([0, *limits[:-1]], limits, strict=True)]

    #: Plain pre-tokens are in the byte alphabet already: the model alone gives their ids.
    bare = Tokenizer(library.model)
    bare.pre_tokenizer = WhitespaceSplit()

    def by_mark(pieces: list[str]) -> list[list[int]]:
        """One call for plain pre-tokens, joined by blanks; word-end marks tell them apart."""
        ids = bare.encode(" ".join(pieces), add_special_tokens=False).ids
        limits = (np.flatnonzero(closes[ids]) + 1).tolist()
        if len(limits) != len(pieces):
            raise ValueError("word ends do not match the pre-tokens")
        return [ids[a:b] for a, b in zip([0, *limits[:-1]], limits, strict=True)]

    def in_parts(encode: Callable, of: list) -> list[list[int]]:
        return [ids for k in range(0, len(of), 2000) for ids in encode(of[k : k + 2000])]

    def encode_many(chunks: list[bytes]) -> list[list[int]]:
        """Chunks share their pre-tokens' ids where these are plain to see; the others go to the library as they are."""
        split = [plain_pretokens(c) for c in chunks] if marked else [None] * len(chunks)
        pieces = list({p for s in split if s for p in s})
        ids = dict(zip(pieces, in_parts(by_mark, pieces), strict=True))
        rest = iter(in_parts(by_place, [c for c, s in zip(chunks, split, strict=True) if s is None]))
        return [next(rest) if s is None else ids[s[0]] if len(s) == 1 else [i for p in s for i in ids[p]] for s in split]

    return ChunkCache(encode_many, CACHE_CHUNKS)


def _with_end(offsets: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each document."""
    return offsets + np.arange(len(offsets)), np.insert(ids, offsets[1:], end_id)


def _pieces(data: bytes, size: int, piece: int = 1 << 12) -> bytes:
    """All of a short value; else pieces of it, evenly spaced from its start to its end."""
    if len(data) <= size:
        return data
    starts = np.linspace(0, len(data) - piece, size // piece).astype(np.int64) // 8 * 8
    return b"".join(data[a : a + piece] for a in starts.tolist())


def _train(docs: DataFrame, tokenizer: str, params: StoreParams, text_col: str, id_col: str) -> bytes:
    """A dictionary from a bounded sample, trained in one task; empty where the sample is too small for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        keep("token_store", library_encoder.cache_clear)
        samples = []
        for _, texts in blocks(batches, text_col, keeper="token_store"):
            offsets, ids = _with_end(*library_encoder(tokenizer)(texts), params.end_id)
            data = ids.astype(f"<u{params.width}").tobytes()
            samples += [_pieces(data[a * params.width : b * params.width], params.sample_bytes) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        try:
            trained = zstandard.train_dictionary(params.dictionary_bytes, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            trained = b""
        yield pa.RecordBatch.from_arrays([pa.array([trained], pa.binary())], ["dictionary"])

    sample = docs.select(id_col, text_col).orderBy(F.xxhash64(id_col), id_col, F.xxhash64(text_col)).limit(params.sample_docs)
    return max((bytes(r[0]) for r in sample.select(text_col).mapInArrow(run, "dictionary binary").collect()), key=len, default=b"")


def write_store(docs: DataFrame, store: str, tokenizer: str, params: StoreParams = StoreParams(), id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every whole text, append ``params.end_id``, and write the store in ascending order of ``id_col``.

    Null and empty texts are documents of the end id alone; null ids come first; rows with one id follow each other and
    each is a document of its own; an empty table gives a store without documents. Other columns are not read. Shards
    grow in number with the input, and a task holds one block of text and 25 bytes for each document of its shard.
    Returns the manifest (a row of totals for each shard goes to the driver).
    """
    spark = docs.sparkSession
    width, end_id = params.width, params.end_id
    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    dictionary = _train(picked, tokenizer, params, text_col, id_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    _write(f"{store}/dictionary.zst", dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # of params.dictionary_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        keep("token_store", library_encoder.cache_clear)
        raw = shared.value
        press = zstandard.ZstdCompressor(level=params.level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}.cwt"
        shard = ShardWriter(f"{store}/{name}", bytes.fromhex(digest), width)
        try:
            for rows, texts in blocks(batches, text_col, keeper="token_store"):
                offsets, ids = _with_end(*library_encoder(tokenizer)(texts), end_id)
                data = memoryview(ids.astype(f"<u{width}").tobytes())
                frames = [press.compress(data[a * width : b * width]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                shard.add(rows.column(0), np.diff(offsets), frames)
            total = shard.close()
        except BaseException:
            shard.abandon()
            raise
        if shard.docs:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([shard.docs], pa.int64()), pa.array([total], pa.int64())], ["number", "name", "docs", "ids"])

    #: Rows with one id are told apart by their texts' hashes and their places, so that no id is more than a range can part.
    keyed = picked.withColumn("_hash", F.xxhash64(text_col)).withColumn("_place", F.monotonically_increasing_id())
    order = [F.col(id_col).asc_nulls_first(), F.col("_hash"), F.col("_place")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(docs) // params.shard_bytes))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(id_col, text_col)
    shards, total = [], 0
    for r in sorted(ordered.mapInArrow(run, "number int, name string, docs long, ids long").collect(), key=lambda r: r["number"]):
        shards.append({"name": r["name"], "docs": r["docs"], "ids": r["ids"], "start": total})
        total += r["ids"]
    manifest = {"dictionary_sha256": digest, "width": width, "end_id": end_id, "tokenizer": os.path.basename(tokenizer), "ids": total, "shards": shards}
    _write(f"{store}/manifest.json", json.dumps(manifest).encode())
    return manifest


class ShardWriter:
    """Writes one shard file as its documents come; the file appears whole, or not at all."""

    def __init__(self, uri: str, digest: bytes, width: int):
        self.uri, self.head, self.width = uri, MAGIC + digest, width
        self.out = None
        self.docs = 0
        self.keys: list[bytes] = []
        self.frames: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: pa.Array, counts: np.ndarray, frames: list[bytes]) -> None:
        if self.out is None:
            self.filesystem, path = _filesystem(self.uri)
            self.filesystem.create_dir(os.path.dirname(path), recursive=True)
            self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.part"
            self.out = self.filesystem.open_output_stream(self.part, compression=None)
            self.out.write(self.head)
        self.out.write(b"".join(frames))
        known = np.array(keys.is_valid())
        head = np.zeros(len(keys), np.dtype([("key", "<i8"), ("known", "u1")]))
        head["key"], head["known"] = np.array(keys.fill_null(0)), known
        self.docs += len(keys)
        self.keys.append(head.tobytes())
        self.frames.append(np.fromiter(map(len, frames), np.uint64, len(frames)))
        self.counts.append(counts.astype("<u8"))

    def close(self) -> int:
        """Index, footer, and the move into place. Returns the number of ids."""
        if self.out is None:
            return 0
        at = np.concatenate([[np.uint64(len(self.head))], np.uint64(len(self.head)) + np.cumsum(np.concatenate(self.frames), dtype=np.uint64)])
        counts = np.concatenate(self.counts)
        for part in (*self.keys, at.astype("<u8").tobytes(), counts.tobytes(), struct.pack("<QQQ", self.docs, self.width, int(at[-1])), END):
            self.out.write(part)
        self.out.close()
        self.filesystem.move(self.part, self.path)
        return int(counts.sum())

    def abandon(self) -> None:
        """Delete what a failed task has written."""
        if self.out is not None:
            self.out.close()
            self.filesystem.delete_file(self.part)


class Shard:
    """Reads documents of one shard file."""

    def __init__(self, uri: str, dictionary: bytes):
        import zstandard

        if _read(uri, 0, 40) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a shard of this store's dictionary")
        n, self.width, at = struct.unpack("<QQQ", _read(uri, -32, 24))
        self.uri = uri
        index = _read(uri, at, n * 9 + (n + 1) * 8 + n * 8)
        head = np.frombuffer(index, np.dtype([("key", "<i8"), ("known", "u1")]), n)
        self.keys = [int(k) if known else None for k, known in head.tolist()]
        self.at = np.frombuffer(index, "<u8", n + 1, n * 9)
        self.counts = np.frombuffer(index, "<u8", n, n * 9 + (n + 1) * 8)
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.press.decompress(frame), f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document alone, by its offset."""
        a, b = int(self.at[k]), int(self.at[k + 1])
        return self.ids(_read(self.uri, a, b - a))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers in one binary value)."""
    manifest = json.loads(_read(f"{store}/manifest.json"))
    dictionary = _read(f"{store}/dictionary.zst")
    shared = spark.sparkContext.broadcast(dictionary)  # of the dictionary_bytes it was written with
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uri = f"{store}/{row['name']}"
                shard = Shard(uri, shared.value)
                begin = row["start"] + np.concatenate([[0], np.cumsum(shard.counts.astype(np.int64))])
                a = 0
                while a < len(shard.keys):  # frames of 1 MB or one longer frame at once
                    b = max(a + 1, int(np.searchsorted(shard.at, shard.at[a] + np.uint64(1 << 20), "right")) - 1)
                    held = _read(uri, int(shard.at[a]), int(shard.at[b] - shard.at[a]))
                    cut = (shard.at[a : b + 1] - shard.at[a]).tolist()
                    ids = [shard.ids(held[x:y]).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.keys[a:b], pa.int64()), pa.array(begin[a:b], pa.int64()), pa.array(shard.counts[a:b].astype(np.int64)), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                    a = b

    rows = [(s["name"], s["start"]) for s in manifest["shards"]]
    names = spark.createDataFrame(rows, "name string, start long")
    return names.repartition(max(1, min(len(rows), 10_000))).mapInArrow(run, schema)
