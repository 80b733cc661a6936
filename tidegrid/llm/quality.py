"""Quality rules whose thresholds follow the data.

Per (language, source) a KLL sketch of each measure is kept; sketches merge, so the
sketches of a language and of the whole table are merges of the group sketches, not new
scans. A row takes the thresholds of its group, or of its language or the whole table where
the group (or language) has fewer than ``min_rows`` rows. An upper fence is

    median + spread * (median - tenth percentile) + slack

and the lower fence of the word length mirrors it with the ninetieth percentile. The inner
half of the data sets the fence, so junk of up to 40 percent of a group cannot move it; the
slack keeps rows that are within a harmless distance of the median whatever the spread.

Defined results: null text has no words and fails the base rules; null language or source is
a group of its own, apart from empty text; undefined ratios are 0; ties at a fence are kept.
An empty table gives an empty result. Extra columns of the table are not read unless carried along.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import field, map_texts, written

# Words and symbols of the rules.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

# measure -> (slack, two-sided)
MEASURES = {"symbol_share": (0.05, False), "duplicate_share": (0.3, False), "capital_share": (0.2, False),
            "word_length": (3.0, True)}
RANKS = (0.1, 0.5, 0.9)
MAX_BROADCAST_GROUPS = 100_000


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more.

    Windows get exact ids by doubling: a pair of ids of half windows is a window's name."""
    if len(words) <= window:
        return 0
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    step = 1
    while step < window:
        pairs = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    often = np.bincount(ids)[ids] > 1
    if not often.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:-window] += often
    cover[window:] -= often
    return int((np.cumsum(cover[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(CAPITAL.findall(text)))


def measured(df: DataFrame, keep, text: str = "text") -> DataFrame:
    """``keep`` plus the counts of every whole text."""
    def start():
        return lambda texts: [list(x) for x in zip(*map(counts, texts))]
    return map_texts(df, keep, text, [field(c, "long") for c in COUNTS], start)


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def _measures() -> dict[str, Column]:
    return {"symbol_share": _share("n_symbols", "word_chars"), "duplicate_share": _share("n_dup_lines", "n_lines"),
            "capital_share": _share("n_capitals", "word_chars"), "word_length": _share("word_chars", "n_words")}


def _key(*names: str) -> list[Column]:
    """Join keys in which null is a value of its own."""
    return [F.when(F.col(n).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(n).cast("string"))).alias(f"_{n}")
            for n in names]


def _fences(df: DataFrame, spread: float) -> DataFrame:
    """Sketch columns -> one low and one high column per measure."""
    for m, (slack, two_sided) in MEASURES.items():
        at = F.kll_sketch_get_quantile_double(F.col(m), F.array(*map(F.lit, RANKS)))
        low, mid, high = (at[i] for i in range(3))
        df = df.withColumn(f"{m}_high", mid + spread * (mid - low) + slack).withColumn(
            f"{m}_low", mid - spread * (high - mid) - slack if two_sided else F.lit(float("-inf")))
    return df.drop(*MEASURES)


def thresholds(rows: DataFrame, spread: float = 6.0, min_rows: int = 200, size: int = 400) -> DataFrame:
    """Fences of each (language, source) of ``rows`` (keys ``_lang``, ``_source`` and the measures).

    One partial aggregation makes the sketches; wider levels merge them."""
    groups = rows.groupBy("_lang", "_source").agg(F.count("*").alias("n"), *(
        F.kll_sketch_agg_double(m, F.lit(size)).alias(m) for m in MEASURES))
    groups = written(groups, "quality-sketches")

    def merged(*keys):
        return groups.groupBy(*keys).agg(F.sum("n").alias("n"), *(
            F.kll_merge_agg_double(m, F.lit(size)).alias(m) for m in MEASURES))

    bounds = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]

    def level(df, name):
        return _fences(df, spread).withColumn(name, F.struct("n", *bounds)).drop("n", *bounds)

    out = (level(groups, "own").join(level(merged("_lang"), "wide"), "_lang")
           .join(level(merged(F.lit(0).alias("_all")), "whole").drop("_all"), F.lit(True)))
    used = F.when(F.col("own.n") >= min_rows, F.col("own")).when(
        F.col("wide.n") >= min_rows, F.col("wide")).otherwise(F.col("whole"))
    return out.withColumn("used", used).select("_lang", "_source", *(F.col(f"used.{b}").alias(b) for b in bounds))


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
          spread: float = 6.0, min_rows: int = 200, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, the counts, the measures, base_failed and kept of every document, and the columns ``carry``."""
    rows = measured(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                              *[k for n, c in (("lang", lang), ("source", source)) for k in _key_as(c, n)], *carry),
                    ["doc_id", "_lang", "_source", *carry])
    rows = written(rows.withColumns(_measures()), "quality-counts")
    fences = written(thresholds(rows, spread, min_rows), "quality-fences")
    if fences.count() <= MAX_BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    joined = rows.join(fences, ["_lang", "_source"], "left")
    fine = F.lit(True)
    for m in MEASURES:
        fine = fine & F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & F.coalesce(fine, F.lit(True))).select(
        "doc_id", *COUNTS[:5], "base_failed", "kept", *MEASURES, *carry)


def _key_as(column: str, name: str) -> list[Column]:
    return [c.alias(f"_{name}") for c in _key(column)]
