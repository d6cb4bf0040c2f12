"""Language identification by language-bitmask n-gram filters.

Every slot of a bit-sliced Bloom filter holds one bit for each language; the AND of an n-gram's slots is the set of all
languages that contain it (and, at a known rate, some that do not). A text's score for a language is its share of
n-grams with that language's bit, corrected for the rate of false bits; the largest decides.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.llm.text import blocks, mix64

UNKNOWN = "und"
#: Bytes of text handled at once: a byte becomes a score of numbers.
BLOCK = 1 << 18
#: Distinct n-grams of a language that a task holds before it sends their counts on.
HELD_GRAMS = 1 << 20


@dataclass(frozen=True)
class LanguageParams:
    """Filter slots (a power of two) and probes, an n-gram's least share of its language's n-grams, and its least share of the largest share that any language gives it."""

    slots: int = 1 << 19
    probes: int = 2
    least_share: float = 2e-5
    least_of_best: float = 0.5


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case (itself, where that is not one character)."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            letter[c] = True
            if len(low := chr(c).lower()) == 1:
                lower[c] = ord(low)
    return letter, lower


def trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Exact codes of the letter trigrams of a block, lower-cased, runs of other characters being one blank, and how many begin in each text.

    A text with a letter has one at least, because its ends count as blanks.
    """
    letter, lower = _letters()
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, decoded), np.int64, len(decoded)) + 2
    points = np.frombuffer("".join(f" {t} " for t in decoded).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum(sizes)
    is_letter = letter[points]
    code = np.where(is_letter, lower[points], 0).astype(np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:-1] |= is_letter[1:]
    at = np.flatnonzero(keep)  # letters and the blanks beside them
    code = code[at]
    if len(code) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    gram = code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:]
    middle = at[1:-1]
    good = (code[1:-1] > 0) & (at[2:] - at[:-2] == 2)
    middle = middle[good]
    return gram[good], np.diff(np.searchsorted(middle, ends), prepend=0)


def _probe(gram: np.ndarray, params: LanguageParams) -> list[np.ndarray]:
    h = mix64(gram)
    return [((h >> np.uint64(21 * k)) & np.uint64(params.slots - 1)).astype(np.int64) for k in range(params.probes)]


@dataclass(frozen=True)
class LanguageModel:
    """The filter: ``slices`` x ``slots`` words of 64 languages each, and the rate of false bits of each language."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    params: LanguageParams

    @staticmethod
    def of_grams(languages: list[str], grams: dict[str, np.ndarray], params: LanguageParams) -> LanguageModel:
        table = np.zeros((max(1, -(-len(languages) // 64)), params.slots), np.uint64)
        rate = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            bit = np.uint64(1) << np.uint64(k % 64)
            for slot in _probe(grams.get(lang, np.zeros(0, np.uint64)), params):
                table[k // 64, slot] |= bit
            rate[k] = np.count_nonzero(table[k // 64] & bit) / params.slots
        return LanguageModel(languages, table, rate**params.probes, params)

    def shares(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of each language among each text's n-grams, and the number of those."""
        gram, counts = trigrams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        slots = _probe(gram, self.params)
        ends = np.cumsum(counts)
        for part in range(len(self.table)):
            mask = self.table[part, slots[0]]
            for slot in slots[1:]:
                mask &= self.table[part, slot]
            for k in range(64 * part, min(len(self.languages), 64 * part + 64)):
                upto = np.concatenate([[0], np.cumsum((mask & (np.uint64(1) << np.uint64(k % 64))) != 0, dtype=np.int64)])
                out[:, k] = upto[ends] - upto[ends - counts]
        share = out / np.maximum(counts, 1)[:, None]
        return np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1), counts

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language (``und`` for a text without letters) and score, the corrected share of that language."""
        share, counts = self.shares(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = share.argmax(1)
        score = np.where(counts > 0, share[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist(), strict=True)], score


def train(docs: DataFrame, learn: Column | None = None, params: LanguageParams = LanguageParams(), lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Fit to every whole text with a language (where ``learn`` holds).

    Tasks send counts of distinct n-grams; a language keeps those above its least share, so that at most
    1 / least_share n-grams of each language reach the driver. Languages are in alphabetical order, which settles ties.
    Null texts and rows without a language teach nothing; an empty table gives a model without languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(lang: str) -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held[lang]])
            gram, where = np.unique(keys, return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in held[lang]])).astype(np.int64)
            held[lang] = [(gram, n)]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for rows, texts in blocks(batches, text_col, BLOCK):
            langs = rows.column(0).to_pylist()
            for lang in sorted({x for x in langs if x is not None}):
                gram, _ = trigrams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                if len(gram):
                    held.setdefault(lang, []).append(np.unique(gram, return_counts=True))
                    if len(held[lang]) >= 32:
                        counted = emit(lang)
                        if counted.num_rows > HELD_GRAMS:
                            yield counted
                            del held[lang]
        for lang in held:
            yield emit(lang)

    picked = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    picked = picked.where(learn) if learn is not None else picked
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    counts = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias(text_col)).mapInArrow(run, schema).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    best = F.max("share").over(W.partitionBy("gram"))
    chosen = share.where(F.col("share") >= params.least_share).withColumn("best", best).where(F.col("share") >= params.least_of_best * F.col("best"))
    found: dict[str, list[int]] = {}
    for lang, gram in chosen.select("lang", "gram").toLocalIterator():
        found.setdefault(lang, []).append(gram)
    return LanguageModel.of_grams(sorted(found), {k: np.array(v, np.int64).astype(np.uint64) for k, v in found.items()}, params)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score (0 to 1) for every whole text.

    Null, empty and letterless texts are ``und`` with score 0; repeated rows each get a row; other columns are not read;
    an empty table gives an empty result. The model is of constant size for each 64 languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x 8 bytes for each 64 languages, and no more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, text_col, BLOCK):
            lang, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose language is known with ``least_score`` at least.

    Null, empty and letterless texts have no language and go; repeated rows are judged alike; a null id, an empty table
    and columns of any other name pass as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as in identify

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, text_col, BLOCK):
            lang, score = shared.value.predict(texts)
            yield rows.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
