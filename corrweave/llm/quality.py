"""Quality rules with adaptive thresholds.

Counts over whole texts are native expressions. Each (language, source) gets a KLL sketch of every rate; sketches of
small groups are merged upwards (language, then all), and fences around the quartiles replace fixed cutoffs. The
documents are then joined with their group's fences and filtered. Nothing runs in Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrweave.plans.shared import materialize

#: White space between words.
_WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "!?#*$%&|<>=+~^@_\\/{}[]"
#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    """Fixed base rules (least words, most hundredths of repeated words); rows that a group needs to have fences of its own; quartile ranges and slack beyond a quartile; size of the sketches."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_group: int = 200
    ranges: float = 6.0
    sketch_k: int = 200


#: Rates and the slack of their fences, which keeps a group of equal values from rejecting small deviations.
RATES = {"mean_word": 2.0, "symbol_rate": 0.02, "mark_rate": 0.04, "dup_line_rate": 0.5, "repeat_rate": 0.35, "upper_rate": 0.15}


def _count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, lang, source, the counts, and the rates of each row. A null text counts as empty.

    Repeats: hashes of the windows of three words are sorted with their places; a place beside an equal hash is a window
    found twice or more, and the words that such windows cover are counted from the sorted places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(k) for c, k in zip(group_cols, ("lang", "source"), strict=True)), text.alias("text"))
    split = start.select(
        "doc_id",
        "lang",
        "source",
        F.char_length(F.translate("text", _WHITE, "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count_of(F.col("text"), _MARKS).alias("n_marks"),
        _count_of(F.col("text"), _UPPER).alias("n_upper"),
        F.filter(F.split("text", "\n", -1), lambda x: F.char_length(F.translate(x, _WHITE, "")) > 0).alias("lines"),
        F.array_remove(F.split(F.translate("text", _WHITE, " " * len(_WHITE)), " ", -1), "").alias("words"),
    )
    #: slice() keeps the last two words from beginning a window; it is empty for texts of fewer than three words.
    heads = F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    hashed = split.select(
        *(c for c in split.columns if c not in ("words", "lines")),
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(heads, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"),
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = hashed.select(*(c for c in hashed.columns if c != "windows"), F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    twice = F.filter("sorted", lambda x, i: (x["h"] == F.get("sorted", i - 1)["h"]) | (x["h"] == F.get("sorted", i + 1)["h"]))
    spots = placed.select(*(c for c in placed.columns if c != "sorted"), F.array_sort(F.transform(twice, lambda x: x["i"])).alias("spots"))
    covered = F.aggregate(F.transform("spots", lambda x, i: F.coalesce(F.least(F.lit(3), x - F.get("spots", i - 1)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = spots.select(*(c for c in spots.columns if c != "spots"), F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return counted.select(
        "*",
        rate("word_chars", "n_words").alias("mean_word"),
        rate("n_symbols", "word_chars").alias("symbol_rate"),
        rate("n_marks", "word_chars").alias("mark_rate"),
        rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_upper", "word_chars").alias("upper_rate"),
    )


def base_failed(params: QualityParams) -> Column:
    return (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))


def fences(measured: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """lang, source, and low and high of each rate, one row for each group of rows that pass the base rules.

    A group of fewer than ``min_group`` rows takes its language's fences, a language of fewer those of all rows.
    """
    good = measured.where(~base_failed(params))
    own = good.groupBy("lang", "source").agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(r, F.lit(params.sketch_k)).alias(r) for r in RATES))
    own = materialize(own, "sketches")
    merged = [F.sum("rows").alias("rows"), *(F.kll_merge_agg_double(r).alias(r) for r in RATES)]
    lang = own.groupBy("lang").agg(*merged)
    whole = lang.agg(*merged)
    named = lambda df, p: df.select(*(F.col(c).alias(c if c in ("lang", "source") else f"{p}_{c}") for c in df.columns))
    levels = named(own, "o").join(named(lang, "l").withColumnRenamed("lang", "ll"), F.col("lang").eqNullSafe(F.col("ll"))).crossJoin(F.broadcast(named(whole, "w")))  # one row
    pick = lambda r: F.when(F.col("o_rows") >= params.min_group, F.col(f"o_{r}")).when(F.col("l_rows") >= params.min_group, F.col(f"l_{r}")).otherwise(F.col(f"w_{r}"))
    quartiles = levels.select("lang", "source", *(F.kll_sketch_get_quantile_double(pick(r), F.lit(q)).alias(f"{r}_{n}") for r in RATES for n, q in (("q1", 0.25), ("q3", 0.75))))
    out = []
    for r, slack in RATES.items():
        width = params.ranges * (F.col(f"{r}_q3") - F.col(f"{r}_q1")) + slack
        out += [(F.col(f"{r}_q1") - width).alias(f"{r}_low"), (F.col(f"{r}_q3") + width).alias(f"{r}_high")]
    return quartiles.select("lang", "source", *out)


def judge(docs: DataFrame, params: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the rates.

    A text is kept if it passes the base rules and each rate lies within its group's fences. Null, empty and blank texts
    have no words and fail the base rules. Null languages and sources are groups of their own. Repeated rows each get a
    row; other columns are not read; an empty table gives an empty result. Groups are small beside the documents; the
    join with them is left to adaptive execution, which broadcasts them only if their measured size allows, and splits
    a hot group otherwise.
    """
    measured = materialize(measures(docs, id_col, text_col), "measures")
    limits = fences(measured, params).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for r in RATES:
        within = within & F.coalesce(F.col(r).between(F.col(f"{r}_low"), F.col(f"{r}_high")), F.lit(True))
    failed = base_failed(params)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & within).alias("kept"), *RATES)
