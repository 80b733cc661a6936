"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. A letter trigram is bound by
multiplying the three vectors, the first two rotated by two and one places, so that
order counts. A document is the bundle (sum) of its trigrams, a language the bundle of
its training documents; the prediction is the prototype with the largest cosine.

Defined results: null text, text without a letter, or no prototype -> ``und`` and score 0;
equal cosines -> the language that sorts first; a negative cosine scores 0. Training rows
without language or text are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import TEXT, field, map_texts, slices

DIMENSIONS = 1024
UNDETERMINED = "und"
SPACE = 32


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Trigrams:
    """Trigram vectors, made on demand. Both tables are dropped when they outgrow their bound."""

    def __init__(self, dimensions: int = DIMENSIONS, bound: int = 30_000):
        self.dimensions, self.bound = dimensions, bound
        self.alphabet: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((1024, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.alphabet:
            if len(self.alphabet) >= self.bound:
                self.alphabet.clear()
            bits = np.random.default_rng([2024, code]).integers(0, 2, self.dimensions, np.int8)
            self.alphabet[code] = bits * np.int8(2) - np.int8(1)
        return self.alphabet[code]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """One row per trigram key (three code points of 21 bits)."""
        if len(self.rows) + len(keys) > self.bound:
            self.rows.clear()
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            row = self.rows.get(key)
            if row is None:
                row = self.rows[key] = len(self.rows)
                if row >= len(self.matrix):
                    self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
                a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
                self.matrix[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            out[i] = row
        return self.matrix[out]


def trigram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram keys, documents x keys counts). Words are lower-cased, all else is one space."""
    lowered = [f"\n{(t or '').lower()}\n" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    codes = np.where(letters()[codes], codes, SPACE)
    kept = codes != SPACE
    kept[1:] |= (codes[:-1] != SPACE) | (doc[1:] != doc[:-1])
    kept[0] = True
    codes, doc = codes[kept], doc[kept]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.zeros((len(texts), 0), np.float32)
    inside = doc[2:] == doc[:-2]
    present = np.unique(codes)
    n = len(present)
    small = np.zeros(int(present[-1]) + 1, np.int64)
    small[present] = np.arange(n)
    c = small[codes]
    short = ((c[:-2] * n + c[1:-1]) * n + c[2:])[inside]
    if n <= 200:
        seen = np.flatnonzero(np.bincount(short, minlength=n ** 3))
        place = np.zeros(n ** 3, np.int32)
        place[seen] = np.arange(len(seen))
        at = place[short]
    else:
        seen, at = np.unique(short, return_inverse=True)
    p = present.astype(np.int64)
    keys = p[seen // (n * n)] << 42 | p[seen // n % n] << 21 | p[seen % n]
    counts = np.bincount(doc[:-2][inside] * np.int64(len(seen)) + at, minlength=len(texts) * len(seen))
    return keys, counts.reshape(len(texts), len(seen)).astype(np.float32)


def bundles(texts: list[str | None], trigrams: Trigrams, block: int = 4096) -> np.ndarray:
    """One bundle per document; a zero row if it has no letter."""
    keys, counts = trigram_counts(texts)
    out = np.zeros((len(texts), trigrams.dimensions), np.float32)
    for i in range(0, len(keys), block):
        out += counts[:, i:i + block] @ trigrams.vectors(keys[i:i + block])
    return out


def prototypes(df: DataFrame, text: str = "text", lang: str = "lang",
               dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """Unit prototype of each language, bundled over all rows of ``df``.

    Tasks send one sum per language, added up in two steps. Only the prototypes reach the
    driver, one vector for each language of the table.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias(TEXT))

    def run(batches):
        trigrams, sums, count = Trigrams(dimensions), {}, {}
        for part in slices(batches, TEXT, 256):
            names = np.array(part.column("lang").to_pylist(), object)
            keys, counts = trigram_counts(part.column(TEXT).to_pylist())
            found = sorted(set(names))
            total = np.stack([counts[names == n].sum(axis=0) for n in found])
            for i in range(0, len(keys), 4096):
                add = total[:, i:i + 4096].astype(np.float64) @ trigrams.vectors(keys[i:i + 4096])
                for n, v in zip(found, add):
                    sums[n] = sums[n] + v if n in sums else v
            for n in found:
                count[n] = count.get(n, 0) + int((names == n).sum())
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([count[n] for n in sums], pa.int64()),
                 pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
                names=["lang", "n", "total"])

    parts = rows.mapInArrow(run, "lang string, n long, total array<double>").withColumn(
        "salt", F.spark_partition_id() % 64).withColumn("total", array_to_vector("total"))

    def add(g):
        return g.agg(F.sum("n").alias("n"), Summarizer.sum(F.col("total")).alias("total"))

    whole = add(add(parts.groupBy("lang", "salt")).groupBy("lang"))
    out = {}
    for row in whole.select("lang", vector_to_array("total").alias("total")).toLocalIterator():
        v = np.array(row["total"])
        norm = np.linalg.norm(v)
        if norm:
            out[row["lang"]] = (v / norm).tolist()
    return out


def predict(df: DataFrame, profiles: dict[str, list[float]], keep, text: str = "text",
            dimensions: int = DIMENSIONS) -> DataFrame:
    """``keep`` plus ``lang_pred`` and ``score`` of every whole text; nothing but the text is looked at."""
    names = sorted(profiles)
    matrix = np.array([profiles[n] for n in names], np.float32).reshape(len(names), dimensions).T

    def start():
        trigrams = Trigrams(dimensions)

        def work(texts):
            vectors = bundles(texts, trigrams)
            norm = np.linalg.norm(vectors, axis=1)
            if not names:
                return [[UNDETERMINED] * len(texts), [0.0] * len(texts)]
            cosine = (vectors @ matrix) / np.where(norm > 0, norm, 1)[:, None]
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
            has = [t is not None and n > 0 for t, n in zip(texts, norm)]
            return [[names[b] if h else UNDETERMINED for b, h in zip(best, has)],
                    [s if h else 0.0 for s, h in zip(score.tolist(), has)]]
        return work

    return map_texts(df, keep, text, [field("lang_pred", "string"), field("score", "double")], start, rows=128)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows outside fold 2 and predict all rows: doc_id, held_out, lang_pred, score."""
    profiles = prototypes(df.where(fold(doc_id) != 2), text, lang)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (fold(doc_id) == 2).alias("held_out"))
    return predict(rows, profiles, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
