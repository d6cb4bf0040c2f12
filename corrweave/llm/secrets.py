"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Two first-order chains over the 67 characters of tokens give each token a log-likelihood ratio. Both are fitted to
labelled samples over the whole corpus: what the fixed patterns find is labelled random (with strings from a seeded
generator, so that every alphabet is covered), all other words are labelled ordinary. Only transition counts leave a
task, so training holds a constant amount whatever the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrweave.llm.text import blocks, join_texts

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_STATES = len(_ALPHABET) + 1  # 0 is any other byte: the outside of a token
_STATE = np.zeros(256, np.int64)
_STATE[[*_ALPHABET]] = np.arange(1, _STATES)
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True
_RANDOM_ALPHABETS = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _ALPHABET[:62], _ALPHABET[:64])


@dataclass(frozen=True)
class SecretParams:
    """Shortest token the chains judge, the log-likelihood ratio from which it is a secret (prior odds of one in a million), the weight of a label's overall frequencies beside a state's own, and generated strings for each alphabet."""

    min_length: int = 16
    min_ratio: float = 13.8
    smoothing: float = 20.0
    generated: int = 2000


def base_spans(text: str, raw: bytes, hex_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in code points, in order of start and kind."""
    out = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hex_run:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def _spans_of(texts: list[bytes | None], data: np.ndarray, offset: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Base spans of each text of a block, in code points."""
    start, _ = _runs(_HEX_BYTE[data], 24)
    has_hex = np.zeros(len(texts), bool)
    has_hex[np.searchsorted(offset, start, "right") - 1] = True
    out = []
    for raw, hexed in zip(texts, has_hex.tolist(), strict=True):
        if not raw:
            out.append([])
        else:
            out.append(base_spans(raw.decode("utf-8", "replace"), raw, hexed))
    return out


#: Letters of scripts that are written without blanks: a token beside them is no part of a longer word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u30ff\u3100-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def _joins_word(data: np.ndarray, at: int, step: int) -> bool:
    """Whether the character beyond ASCII that ends (step -1) or begins (step 1) at a byte is a letter or mark of a script written with blanks."""
    if step < 0:
        first = at
        while first > max(at - 3, 0) and data[first] & 0xC0 == 0x80:
            first -= 1
        char = data[first : at + 1].tobytes().decode("utf-8", "replace")[-1]
    else:
        char = data[at : at + 4].tobytes().decode("utf-8", "replace")[0]
    return unicodedata.category(char)[0] in "LM" and not _UNSPACED.match(char)


def _pairs(token: bytes) -> np.ndarray:
    """State pairs along a token, entry and exit included."""
    s = np.concatenate([[0], _STATE[np.frombuffer(token, np.uint8)], [0]])
    return s[:-1] * _STATES + s[1:]


def _generated(params: SecretParams) -> np.ndarray:
    rng = np.random.default_rng(7)
    counts = np.zeros(_STATES**2)
    for alphabet in _RANDOM_ALPHABETS:
        letters = np.frombuffer(alphabet, np.uint8)
        for size in rng.integers(16, 64, params.generated):
            counts += np.bincount(_pairs(letters[rng.integers(0, len(letters), size)].tobytes()), minlength=_STATES**2)
    return counts


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratio of each transition, random over ordinary."""

    ratio: np.ndarray
    params: SecretParams

    @staticmethod
    def of_counts(random: np.ndarray, ordinary: np.ndarray, params: SecretParams) -> SecretModel:
        def logs(counts: np.ndarray) -> np.ndarray:
            """A state that is rarely left takes its label's frequencies of the next states."""
            c = counts.reshape(_STATES, _STATES)
            overall = (c.sum(0) + 0.5) / (c.sum() + 0.5 * _STATES)
            return np.log((c + params.smoothing * overall) / (c.sum(1, keepdims=True) + params.smoothing))

        return SecretModel((logs(random + _generated(params)) - logs(ordinary)).ravel(), params)

    def score(self, token: bytes) -> float:
        return float(self.ratio[_pairs(token)].sum())


def train(docs: DataFrame, params: SecretParams = SecretParams(), text_col: str = "text") -> SecretModel:
    """Transition counts of both labels over every whole text; at most 2 x 68 x 68 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros(2 * _STATES**2, np.int64)
        for _, texts in blocks(batches, text_col):
            data, offset = join_texts(texts)
            state = _STATE[data]
            everything = np.bincount(state[:-1] * _STATES + state[1:], minlength=_STATES**2)
            secret = np.zeros(_STATES**2, np.int64)
            for raw, spans in zip(texts, _spans_of(texts, data, offset), strict=True):
                text = raw.decode("utf-8", "replace") if spans else ""
                for a, kind, b in spans:
                    token = _ASSIGN.match(text[a:b])[2] if kind == 0 else text[a:b]
                    secret += np.bincount(_pairs(token.encode()), minlength=_STATES**2)
            both[: _STATES**2] += secret
            both[_STATES**2 :] += np.maximum(everything - secret, 0)
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(both[at])], ["at", "n"])

    both = np.zeros(2 * _STATES**2)
    for at, n in docs.select(text_col).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        both[at] = n
    both[0] = both[_STATES**2] = 0
    return SecretModel.of_counts(both[: _STATES**2], both[_STATES**2 :], params)


def spans_of_block(texts: list[bytes | None], model: SecretModel) -> list[list[tuple[int, int, int]]]:
    """Base spans and the chains' spans of each text, (start, kind, end) in code points, in order."""
    data, offset = join_texts(texts)
    out = _spans_of(texts, data, offset)
    state = _STATE[data]
    start, end = _runs(state > 0, model.params.min_length)
    if len(start):
        #: A run that touches a letter beyond ASCII is part of a longer word; other characters beyond ASCII bound it.
        whole = np.ones(len(start), bool)
        for places, step in ((np.maximum(start - 1, 0), -1), (np.minimum(end, len(data) - 1), 1)):
            for k in np.flatnonzero(data[places] >= 0x80).tolist():
                whole[k] &= not _joins_word(data, int(places[k]), step)
        start, end = start[whole], end[whole]
        upto = np.zeros(len(data) + 1)
        np.cumsum(model.ratio[state[:-1] * _STATES + state[1:]], out=upto[1:-1])
        first = np.where(start > 0, upto[np.maximum(start - 1, 0)], 0)
        value = upto[np.minimum(end, len(data) - 1)] - first
        for a, b in zip(start[value >= model.params.min_ratio].tolist(), end[value >= model.params.min_ratio].tolist(), strict=True):
            k = int(np.searchsorted(offset, a, "right")) - 1
            at = int(offset[k])
            x = len(texts[k][: a - at].decode("utf-8", "replace"))
            y = x + b - a
            if not any(p < y and x < q for p, _, q in out[k]):
                out[k].append((x, 3, y))
    return [sorted(s) for s in out]


def find_secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text.

    Returns ``id_col`` and ``spans``, an array of (kind, start, end) in order of start, then kind as in KINDS; ends are
    exclusive, places are code points. Spans of the chains never overlap those of the patterns. Null and empty texts
    have none; repeated rows each get a row; other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    shape = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, text_col):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans_of_block(texts, model)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, inner)], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("spans", shape)]))


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, each secret replaced by ``[kind]``; ``length_col``, where there is one, follows the text.

    Null and empty texts stay as they are, and so do the lengths of texts without a secret; repeated rows each stay; a
    null id, an empty table and columns of any other name pass as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, text_col):
            found = spans_of_block(texts, model)
            if any(found):
                values = rows.column(rows.schema.get_field_index(text_col)).to_pylist()
                for k, spans in enumerate(found):
                    if spans:
                        text, out, at = values[k], [], 0
                        for a, kind, b in spans:
                            if b > at:
                                out += [text[at : max(a, at)], f"[{KINDS[kind]}]"] if a >= at else []
                                at = b
                        values[k] = "".join([*out, text[at:]])
                columns = rows.columns
                place = rows.schema.get_field_index(text_col)
                columns[place] = pa.array(values, rows.schema.field(place).type)
                if length_col in rows.schema.names:
                    place = rows.schema.get_field_index(length_col)
                    old = rows.column(place).to_pylist()
                    columns[place] = pa.array([len(v) if s else n for v, s, n in zip(values, found, old, strict=True)], rows.schema.field(place).type)
                rows = pa.RecordBatch.from_arrays(columns, schema=rows.schema)
            yield rows

    return docs.mapInArrow(run, docs.schema)
