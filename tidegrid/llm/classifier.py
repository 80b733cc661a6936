"""Quality scores: random Fourier features, ridge, isotonic calibration.

Each whole text becomes a row of STATISTICS, clipped and scaled by the training rows' means and
deviations. ``features`` random cosines of them approximate a Gaussian kernel. Tasks sum the normal equations
of their labelled rows, one set for each of FOLDS parts of the training rows; Spark adds the sums up, row
by row of the matrix. A ridge fit over all parts scores the documents. Fits that leave out one part score that
part, and an isotonic regression of the labels on those scores turns scores into probabilities.
Inside its steps a small share of the plain score keeps documents apart.

Everything that reaches the driver is of fixed size: sums of ``features`` squared numbers for each
fold, and ``BINS`` bins of scores. All labelled training rows are used, without a bound.

Defined results: null text counts as empty; empty texts have statistics and a score like others.
Several labels of one id are averaged, null labels are none; repeated documents are rows of their own. Without a
training row all scores are 0.5. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.common import field, map_texts, written
from tidegrid.llm.quality import repeated_words

FEATURES, WIDTH, RIDGE, FOLDS, BINS = 512, 8.0, 1e-4, 4, 2000
TRAIN_ROWS = 8192  # Labelled rows a task sums up.
CLIP = 5.0  # Deviations; a statistic further out counts as this far.
LEARNED_SHARE = 0.98  # Of the score, by isotonic regression; the rest is the plain score.
THRESHOLD = 0.3
# Character classes; the table covers Latin-1, others count as letters beyond it.
KINDS = ("lower", "upper", "digit", "space", "newline", "end", "comma", "quote", "symbol", "control", "accented", "other")
STATISTICS = ("log_chars", "log_words", "word_length", "word_spread", *(f"share_{k}" for k in KINDS), "shouted_words", "glued_words",
              "capital_words", "distinct_words", "top_word", "repeated_windows", "duplicate_lines", "log_line", "line_spread",
              "ended_lines", "log_sentence", "long_words", "single_words", "entropy")


def _kinds() -> np.ndarray:
    out = np.full(257, KINDS.index("other"))
    for i in range(256):
        c = chr(i)
        out[i] = KINDS.index("lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if c.isdigit() else "newline" if c == "\n"
                             else "space" if c.isspace() else "end" if c in ".!?" else "comma" if c in ",;:" else "quote" if c in "'\"()-"
                             else "accented" if c.isalpha() else "control" if i < 32 else "symbol")
    return out


KIND = _kinds()


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one whole text."""
    text = text or ""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 256)
    counts = np.bincount(codes, minlength=257)
    kinds = np.bincount(KIND, weights=counts, minlength=len(KINDS)) / max(len(text), 1)
    share = counts[counts > 0] / max(len(text), 1)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    wide = np.fromiter(map(len, lines), float, len(lines)) if lines else np.zeros(1)
    times = Counter(words)
    ends = counts[ord(".")] + counts[ord("!")] + counts[ord("?")]
    own = [w for w in times if len(w) > 1]
    return [np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), *kinds.tolist(),
            sum(times[w] for w in own if w.isupper()) / n,
            sum(times[w] for w in own if w[-1] not in ".,!?" and not w.isalnum()) / n,
            sum(times[w] for w in times if w[0].isupper()) / n,
            len(times) / n ** 0.8, max(times.values(), default=0) / n, repeated_words(words) / n, 1 - len(set(lines)) / m,
            np.log1p(wide.mean()), np.log1p(wide.std()), sum(x.rstrip()[-1] in ".!?" for x in lines) / m,
            np.log1p(len(words) / (1 + ends)), (lengths > 20).sum() / n, (lengths == 1).sum() / n, float(-(share * np.log(share)).sum())]


@dataclass(frozen=True)
class Features:
    """Scaled statistics and their random Fourier features, with a constant as the last one."""
    mean: np.ndarray
    spread: np.ndarray
    count: int = FEATURES
    width: float = WIDTH
    seed: int = 13

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(self.seed)
        turn = random.normal(size=(len(self.mean), self.count)) / self.width
        shift = random.uniform(0, 2 * np.pi, self.count)
        scaled = np.clip((rows - self.mean) / self.spread, -CLIP, CLIP)
        return np.hstack([np.sqrt(2 / self.count) * np.cos(scaled @ turn + shift), np.ones((len(rows), 1))])


def solve(gram: np.ndarray, right: np.ndarray, rows: float, ridge: float = RIDGE) -> np.ndarray:
    """Ridge weights; the constant bears no penalty."""
    penalty = np.full(len(gram), ridge * max(rows, 1.0))
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), right)


@dataclass(frozen=True)
class Model:
    """Weights of the features, and the steps that turn plain scores into probabilities."""
    features: Features
    weights: np.ndarray
    edges: np.ndarray
    steps: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        plain = self.features(rows) @ self.weights
        learned = np.interp(plain, self.edges, self.steps)
        return np.clip(LEARNED_SHARE * learned + (1 - LEARNED_SHARE) * np.clip(plain, 0, 1), 0, 1)


def measured(df: DataFrame, keep, text: str = "text") -> DataFrame:
    """``keep`` plus ``statistics`` (array of float) of every whole text."""
    def start():
        return lambda texts: [pa.array([np.array(statistics(t), np.float32) for t in texts], pa.list_(pa.float32()))]
    return map_texts(df, keep, text, [T.StructField("statistics", T.ArrayType(T.FloatType()))], start)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def normal_equations(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the rows (statistics, label, fold) of each fold: features' products, and products with the label
    in the last column; number of rows. Tasks send one set of sums, Spark adds them up row by row."""
    width = features.count + 1

    def run(batches):
        sums, counts = np.zeros((FOLDS, width, width + 1)), np.zeros(FOLDS)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                z, fold = features(_matrix(part.column("statistics"))), part.column("fold").to_numpy()
                both = np.hstack([z, part.column("label").to_numpy()[:, None]])
                for f in range(FOLDS):
                    sums[f] += z[fold == f].T @ both[fold == f]
                counts += np.bincount(fold, minlength=FOLDS)
        if counts.any():
            for f in range(FOLDS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(width, f, np.int32)), pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, counts[f])),
                     pa.FixedSizeListArray.from_arrays(pa.array(sums[f].ravel()), width + 1).cast(pa.list_(pa.float64()))],
                    names=["fold", "at", "n", "sums"])

    parts = rows.select("statistics", "label", "fold").mapInArrow(run, "fold int, at int, n double, sums array<double>")
    added = parts.groupBy("fold", "at").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    out, counts = np.zeros((FOLDS, width, width + 1)), np.zeros(FOLDS)
    for row in added.select("fold", "at", "n", vector_to_array("sums").alias("sums")).toLocalIterator():
        out[row["fold"], row["at"]], counts[row["fold"]] = row["sums"], row["n"]
    return out, counts


def fit(rows: DataFrame) -> Model | None:
    """Model of the labelled rows (statistics, label, fold); None without rows."""
    rows = written(rows.withColumn("vector", array_to_vector(F.col("statistics").cast("array<double>"))), "labelled")
    count = rows.count()
    if not count:
        return None
    summary = rows.agg(Summarizer.mean(F.col("vector")).alias("mean"), Summarizer.std(F.col("vector")).alias("spread")).first()
    spread = np.nan_to_num(summary["spread"].toArray())
    features = Features(summary["mean"].toArray(), np.where(spread > 1e-9, spread, 1.0))
    rows = rows.drop("vector").repartition(math.ceil(count / TRAIN_ROWS))
    sums, counts = normal_equations(rows, features)

    def weights(chosen):
        total = sums[chosen].sum(axis=0)
        return solve(total[:, :-1], total[:, -1], counts[chosen].sum())

    everything = np.ones(FOLDS, bool)
    without = [weights(everything & (np.arange(FOLDS) != f)) for f in range(FOLDS)]

    def unseen(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                z, fold = features(_matrix(part.column("statistics"))), part.column("fold").to_numpy()
                plain = np.einsum("ij,ij->i", z, np.array(without)[fold])
                yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(plain, -0.5, 1.5) * BINS) / BINS), part.column("label")],
                                                 names=["plain", "label"])

    bins = rows.select("statistics", "label", "fold").mapInArrow(unseen, "plain double, label double").groupBy("plain").agg(
        F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    steps = IsotonicRegression(featuresCol="plain", labelCol="label", weightCol="weight").fit(bins.coalesce(1))
    return Model(features, weights(everything), steps.boundaries.toArray(), steps.predictions.toArray())


def score(rows: DataFrame, model: Model | None, keep) -> DataFrame:
    """``keep`` and ``score`` of rows with ``statistics``."""
    schema = rows.select(*keep).schema.add(field("score", "double"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                found = np.full(part.num_rows, 0.5) if model is None else model(_matrix(part.column("statistics")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found)], names=schema.names)

    return rows.select(*keep, "statistics").mapInArrow(run, schema)


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the labels of rows that are not held out."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held_out"))
    rows = written(measured(docs, ["doc_id", "held_out"]), "statistics")
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.avg(F.col(label).cast("double")).alias("label"))
    train = rows.where(~F.col("held_out")).join(known, "doc_id").select(
        "statistics", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    return score(rows, fit(train), ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
