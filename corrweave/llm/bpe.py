"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a block go into a trie, in sorted order, so that it grows depth first. Each node keeps the last
token of its prefix's encoding and the node that the prefix without that token ends at. A token ``t`` is the last
token of a prefix exactly if the last token before it and ``t`` are a pair that BPE leaves alone, so a node's state
follows from its ancestors' states, and what words share at their start is encoded once.

Text is cut at ASCII white space first: no normalisation or pre-token crosses it. Unicode normalisation, the
pre-token pattern and added tokens are the library's; merging is done here.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corrweave.llm.text import blocks, keep

#: Chunks kept with their encodings in one Python worker (beyond that, the more frequent half stays), and trie nodes (beyond that, the trie starts anew).
CACHE_CHUNKS = 700_000
TRIE_NODES = 1_000_000
#: Token pairs whose standing is remembered.
KNOWN_PAIRS = 400_000
#: Chunks kept from one task to the next.
KEPT_CHUNKS = 500_000
#: Added to the last character of a word: it stands for the character with the word-end mark.
_LAST = 0x1000
#: Printable ASCII and Latin letters whose lower case is one Latin letter: normalisation leaves them as they are.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
#: Bytes that are a pre-token of their own after letters.
_MARKS = frozenset(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
#: Bytes that stand for themselves in the byte-level alphabet; the others, in order, are the characters from 256 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = dict(zip(sorted(set(range(256)).difference(_SELF)), range(256, 512), strict=False))


def plain_pretokens(chunk: bytes) -> list[str] | None:
    """Byte-level pre-tokens, lower-cased, of a chunk of plain characters; None where the library has to look."""
    if chunk.isalpha():
        return [chunk.decode().lower()]
    if chunk[-1] in _MARKS and chunk[:-1].isalpha():
        return [chunk[:-1].decode().lower(), chr(chunk[-1])]
    if b"<|" in chunk:
        return None
    text = chunk.decode("utf-8", "replace")
    if not _PLAIN.fullmatch(text):
        return None
    found = _PRETOKEN.findall(text.lower())
    return found if text.isascii() else [p.encode().decode("latin-1").translate(_BYTE_LEVEL) for p in found]


class _Numbers(dict):
    """Numbers keys in the order in which they are first looked up; ``fresh`` gathers the new ones."""

    def __init__(self, *given):
        super().__init__(*given)
        self.fresh: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number


class ChunkCache:
    """Token ids of texts from the encodings of their white-space separated chunks, each computed once.

    ``encode_many`` maps distinct chunks to lists of ids.
    """

    def __init__(self, encode_many: Callable[[list[bytes]], list[list[int]]], limit: int = CACHE_CHUNKS):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.chunks = 0
        #: Arrays with room to grow: where each chunk's ids begin in the arena (the last one's end beside it), the ids, and uses.
        self.begin, self.arena, self.uses = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), np.zeros(1 << 16, np.int64)

    def _room(self, chunks: int, ids: int) -> None:
        for name, size in (("begin", chunks + 1), ("arena", ids), ("uses", chunks)):
            old = getattr(self, name)
            if len(old) < size:
                new = np.zeros(max(size, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _learn(self, encoded: list[list[int]]) -> None:
        """Ids of new chunks, in the order of their numbers."""
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        total, held, first = int(sizes.sum()), int(self.begin[self.chunks]), self.chunks
        self.chunks += len(sizes)
        self._room(self.chunks, held + total)
        self.begin[first + 1 : self.chunks + 1] = held + np.cumsum(sizes)
        self.arena[held : held + total] = np.fromiter(itertools.chain.from_iterable(encoded), np.int32, total)
        self.uses[first : self.chunks] = 0

    def shrink(self, size: int) -> None:
        """Keep the ``size`` most frequent chunks; counts are halved, so that old uses fade."""
        if size >= self.chunks:
            return
        uses = self.uses[: self.chunks]
        keep = np.sort(np.argsort(-uses, kind="stable")[:size])  # in the order of self.number
        place = np.full(len(uses), -1)
        place[keep] = np.arange(len(keep))
        sizes = np.diff(self.begin[: self.chunks + 1])[keep]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        self.arena = self.arena[np.repeat(self.begin[keep] - upto[:-1], sizes) + np.arange(upto[-1])]
        self.begin, self.uses, self.chunks = upto, uses[keep] // 2, len(keep)
        self.number = _Numbers((w, k) for w, k in zip(self.number, place.tolist(), strict=True) if k >= 0)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and the ids. The cycle collector, which would walk the caches again and again, rests meanwhile."""
        gc.disable()
        try:
            return self._ids(texts)
        except BaseException:
            self.clear()  # a later task must not find numbers without ids
            raise
        finally:
            gc.enable()

    def _ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        split = [t.split() if t else [] for t in texts]
        words = [w for s in split for w in s]
        if len(self.number) > self.limit:
            self.shrink(self.limit // 2)
        index = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if fresh := self.number.fresh:
            self.number.fresh = []
            self._learn(self.encode_many(fresh))
        np.add.at(self.uses, index, 1)
        begin = self.begin[index]
        sizes = self.begin[index + 1] - begin
        upto = np.zeros(len(index) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        ids = self.arena[np.repeat(begin - upto[:-1], sizes) + np.arange(upto[-1])]
        per_text = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(s) for s in split], out=per_text[1:])
        return upto[per_text], ids


class TrieBpe:
    """Encodes pre-tokens of a word-end BPE vocabulary; see the module's text."""

    def __init__(self, path: str, nodes: int = TRIE_NODES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model, self.limit, self.decoder = spec["model"], nodes, spec.get("decoder")
        suffix = model["end_of_word_suffix"]
        self.tokens: dict[str, int] = {self._symbols(t, suffix): i for t, i in model["vocab"].items()}
        self.names = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merge: dict[tuple[int, int], int] = {}
        #: For each token, the rank of the merge that makes it and its two parts; single symbols have none.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, ab = (model["vocab"][x] for x in (left, right, left + right))
            self.merge.setdefault((a, b), rank)
            self.parts.setdefault(ab, (rank, a, b))
        #: Lengths of the tokens that end in two given characters, and 1, longest first.
        self.lengths: dict[str, list[int]] = {}
        for t in self.tokens:
            self.lengths.setdefault(t[-2:], [1]).append(len(t))
        self.lengths = {k: sorted(set(v), reverse=True) for k, v in self.lengths.items() if len(k) == 2}
        self.stays: dict[int, bool] = {}  # for pairs of tokens, whether BPE leaves them apart
        self.clear()

    @staticmethod
    def _symbols(token: str, suffix: str) -> str:
        if len(token) > len(suffix) and token.endswith(suffix):
            token = token[: -len(suffix)]
            return token[:-1] + chr(ord(token[-1]) + _LAST)
        return token

    def clear(self) -> None:
        """An empty trie: the root alone."""
        self.child: dict[int, int] = {}
        self.last, self.back = [-1], [0]

    def _apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves this pair of tokens as it is.

        The tokens' trees are undone from the top. Two parts that meet at the border stand side by side until the
        earlier of the merges that take them up; a merge of the two that ranks before both would have come first
        (of equal merges the left one comes first).
        """
        key = left << 20 | right
        never = len(self.merge) + 1
        a, b, up_a, up_b = left, right, never, never
        result = True
        while True:
            rank = self.merge.get((a, b), never)
            if rank < up_a and rank <= up_b and rank < never:
                result = False
                break
            part_a, part_b = self.parts.get(a), self.parts.get(b)
            if part_a is None and part_b is None:
                break
            if part_b is None or (part_a is not None and part_a[0] > part_b[0]):
                up_a, a = part_a[0], part_a[2]
            else:
                up_b, b = part_b[0], part_b[1]
        if len(self.stays) > KNOWN_PAIRS:
            self.stays.clear()
        self.stays[key] = result
        return result

    def _last_token(self, word: str, end: int, path: list[int]) -> tuple[int, int]:
        """The last token of the encoding of ``word[:end]`` and its length, from the states of shorter prefixes."""
        tokens, last, stays = self.tokens, self.last, self.stays
        for size in self.lengths.get(word[end - 2 : end], (1,)) if end > 1 else (1,):
            if size > end:
                continue
            token = tokens.get(word[end - size : end])
            if token is None:
                continue
            if size == end:
                return token, size
            left = last[path[end - size]]
            known = stays.get(left << 20 | token)
            if known or (known is None and self._apart(left, token)):
                return token, size
        raise ValueError(f"no token ends at {end} of {word!r}")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of pre-tokens of byte-level characters, in sorted order: what a word shares with the one before it is neither walked nor encoded again, and new nodes of the trie get their states on the way."""
        child, last, back = self.child, self.last, self.back
        before, path, out = "", [0], {}
        for word in words:
            marked = word[:-1] + chr(ord(word[-1]) + _LAST)
            same = 0
            for a, b in zip(before, marked, strict=False):
                if a != b:
                    break
                same += 1
            del path[same + 1 :]
            node, end = path[same], same
            for c in marked[same:]:
                end += 1
                edge = node << 13 | ord(c)
                node = child.get(edge)
                if node is None:
                    token, size = self._last_token(marked, end, path)
                    child[edge] = node = len(last)
                    last.append(token)
                    back.append(path[end - size])
                path.append(node)
            before, ids = marked, []
            while node:
                ids.append(last[node])
                node = back[node]
            out[word] = ids[::-1]
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        return self.encode_words([word])[word]

    def _pretokens(self, chunk: bytes) -> Iterator[str | int]:
        """Byte-level pre-tokens of a chunk, and ids of added tokens."""
        if (plain := plain_pretokens(chunk)) is not None:
            yield from plain
            return
        text = chunk.decode("utf-8", "replace")
        for piece in self.added.split(text) if self.added else [text]:
            if piece in self.special:
                yield self.special[piece]
            elif piece:
                normal = self.library.normalizer.normalize_str(piece)
                yield from (p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk. The distinct pre-tokens go into the trie in sorted order, that is depth first."""
        split = [[*self._pretokens(c)] for c in chunks]
        if len(self.last) > self.limit:
            self.clear()
        ids = self.encode_words(sorted({w for s in split for w in s if type(w) is str}))
        return [[i for w in s for i in (ids[w] if type(w) is str else (w,))] for s in split]


@functools.lru_cache(maxsize=2)
def trie_encoder(path: str) -> tuple[TrieBpe, ChunkCache, list[str]]:
    """One encoder for each vocabulary and Python worker; the names of ids last."""
    bpe = TrieBpe(path)
    return bpe, ChunkCache(bpe.encode_chunks), [bpe.names.get(i, "") for i in range(max(bpe.names) + 1)]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text and the text that the ids decode to.

    Returns ``id_col``, ``ids`` (array of int) and ``decoded`` (by the vocabulary file's decoder; names of the ids, joined
    by blanks, where it names none). Null and empty texts have no ids and decode to an empty text. Repeated rows each get a row;
    other columns are not read, so clashing names do not matter; an empty table gives an empty result. Memory in a
    worker is bounded by the cache, the trie and one block of text or one longer text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep("bpe", trie_encoder.cache_clear)
        bpe, cache, names = trie_encoder(tokenizer)
        for rows, texts in blocks(batches, text_col, 1 << 19, "bpe"):
            offsets, ids = cache(texts)
            places = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            if bpe.decoder:
                decoded = bpe.library.decode_batch([ids[a:b].tolist() for a, b in places], skip_special_tokens=False)
            else:
                spelled = list(map(names.__getitem__, ids.tolist()))
                decoded = [" ".join(spelled[a:b]) for a, b in places]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], [id_col, "ids", "decoded"])
        cache.shrink(KEPT_CHUNKS)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
