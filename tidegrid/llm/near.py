"""Near-duplicate texts: MinHash bands, odd sketches, exact confirmation, components.

A document's set holds its distinct five-word shingles (64-bit hashes of words lower-cased
in A-Z). Documents with equal sets are one class, found by a digest; the rest works on one
representative of a class, so copies are never expanded into pairs.

1. 128 MinHash samples give 32 bands of 4. Two sets of similarity 0.75 share a band with
   probability 0.999995.
2. One-permutation MinHash samples (the least hash in each of 4096 bins) are folded into a
   4096-bit parity bitmap, the odd sketch. The XOR of two bitmaps tells how many samples
   differ, hence how many agree. A pair is discarded where the agreement lies more than five
   standard deviations below what its set sizes and a similarity of 0.75 lead to expect, or
   where the sizes alone rule that similarity out.
3. Each band bucket is first tied to its smallest member. Pairs that pass the sketch are
   confirmed on the full sets, streamed by leader, and components are labelled.
4. Buckets that still hold two labels compare their members across labels in the same way,
   first with a few more leaders, then with each other, so no link
   inside a bucket is skipped; pairs of equal label need no test, and a pair is made only in the
   first bucket that both share.

Defined results: null text or text without words has an empty set and links with nothing;
fewer than five words make one shingle; repeated ids act as one document; a document without
an id (null) links with nothing, has no component and is not kept; an empty table
gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import TEXT, field, lists, map_texts, slices, written
from tidegrid.llm.graph import components
from tidegrid.session import fresh_path, release

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SHINGLE, PERCENT = 5, 75
SAMPLES, BANDS = 128, 32
BIN_BITS, BITS = 12, 4096
DEVIATIONS = 5.0
LEADERS, LEADER_PASSES = 8, 1
SALT_ROWS = 64  # Pairs of one leader that go to one task.
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
_random = np.random.default_rng(7)
FACTORS = _random.integers(1, 2 ** 63, SAMPLES, np.uint64) * U(2) + U(1)
OFFSETS = _random.integers(0, 2 ** 63, SAMPLES, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.empty(0, U)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    codes = np.array([known[w] for w in words], U)
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, U)
    for i in range(size):
        out = _mix(out * STEP + codes[i:i + len(out)])
    return np.unique(out)


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set, by slices whose products stay in a core's cache."""
    best = np.full(SAMPLES, np.iinfo(U).max, U)
    for i in range(0, len(found), 512):
        part = found[i:i + 512]
        best = np.minimum(best, (part[:, None] * FACTORS + OFFSETS).min(axis=0))
    return best


def odd_sketch(found: np.ndarray) -> tuple[np.ndarray, int]:
    """Parity bitmap of the least hash of each bin, and the number of bins with one."""
    hashed = np.sort(_mix(found * FACTORS[0]))
    bins = hashed >> U(64 - BIN_BITS)
    least = hashed[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(hashed) else hashed
    at = (_mix(least) % U(BITS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=BITS) & 1).view(np.int64), len(least)


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=U)
    for column in sample.reshape(BANDS, -1).T:
        key = _mix(key * STEP + column)
    return key.view(np.int64)


def signatures(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, sketch, filled of every whole text."""
    def start():
        def work(texts):
            sets = [shingles(t) for t in texts]
            made = [samples(s) for s in sets]
            odd = [odd_sketch(s) for s in sets]
            full = [len(s) > 0 for s in sets]
            return [[len(s) for s in sets], [hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets],
                    lists(np.concatenate([band_keys(m) for m, f in zip(made, full) if f] or [np.empty(0, np.int64)]),
                          [BANDS * f for f in full]),
                    lists(np.concatenate([o for (o, _), f in zip(odd, full) if f] or [np.empty(0, np.int64)]),
                          [BITS // 64 * f for f in full]), [n for _, n in odd]]
        return work
    return map_texts(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text",
                     [field("n_shingles", "long"), field("set_key", "string"), field("bands", "array<bigint>"),
                      field("sketch", "array<bigint>"), field("filled", "int")], start)


def close(a: str, b: str) -> Column:
    """Whether two marks (structs of n_shingles, filled, sketch) allow the similarity."""
    bits = F.zip_with(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    odd = F.least(F.aggregate(bits, F.lit(0), lambda n, x: n + x), F.lit(BITS // 2 - 1))
    differ = -BITS / 2 * F.log(1 - 2 * odd / F.lit(float(BITS)))
    filled = F.col(f"{a}.filled") + F.col(f"{b}.filled")
    sizes = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    bins, share = float(1 << BIN_BITS), PERCENT / 100
    union = (sizes[0] + sizes[1]) / (1 + share)
    used = bins * (1 - F.exp(-union / bins))  # bins that the union fills, by expectation
    expected = share * used
    apart = F.greatest(filled - 2 * expected, F.lit(0.0))
    # Variances: of the samples drawn from the union, and of the parity count.
    drawn = used * share * (1 - share) * F.greatest(1 - used / union, F.lit(0.0))
    keep = F.exp(-4 * apart / BITS)
    parity = F.greatest(BITS / 4 * (1 - keep) - apart * keep, F.lit(0.0)) / keep / 4
    margin = DEVIATIONS * F.sqrt(drawn + parity) + 3
    return (100 * F.least(*sizes) >= PERCENT * F.greatest(*sizes)) & ((filled - differ) / 2 >= expected - margin)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity.

    Rows are dealt by (a, salt of b), with as many salts as a leader's pairs ask for, and stream through a task:
    the set of ``a`` is made once, each ``b`` is compared as it passes, so a group of any size is never held."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # A merge join at every size: broadcast ids would make the plan depend on how many there are.
    texts = written(docs.join(ids.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidate-texts")
    large = pairs.groupBy("a").count().where(F.col("count") > SALT_ROWS).select("a", F.ceil(F.col("count") / SALT_ROWS).alias("salts"))
    salted = written(pairs.join(large, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "salts"), F.lit(0)).alias("salt")), "salted")
    first = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select(
        "a", "salt", F.lit(0).alias("part"), F.col("a").alias("b"), "text")
    second = salted.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", F.lit(1).alias("part"), "b", "text")
    rows = first.unionByName(second).withColumnRenamed("text", TEXT).repartition("a", "salt").sortWithinPartitions("a", "salt", "part")

    def run(batches):
        leader, own = None, np.empty(0, U)
        for part in slices(batches, TEXT):
            kept_a, kept_b = [], []
            for a, kind, b, text in zip(*(part.column(c).to_pylist() for c in ("a", "part", "b", TEXT))):
                found = shingles(text)
                if kind == 0:
                    leader, own = a, found
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                if leader == a and 100 * both >= PERCENT * (len(own) + len(found) - both):
                    kept_a.append(a)
                    kept_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _unsettled(members: DataFrame, labels: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, rep, label, mark, bands) of the buckets whose members have several labels."""
    named = written(members.select("key", "rep").join(labels.toDF("rep", "label"), "rep", "left").select(
        "key", "rep", F.coalesce("label", "rep").alias("label")), "named")
    mixed = written(named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                    .where("low < high").select("key"), "mixed")
    return written(named.join(mixed, "key").join(marks, "rep"), "open")


def _with_leaders(rest: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of bucket members with up to LEADERS members a bucket. The choice goes by a hash
    of the id and the turn, so buckets with the same members choose alike."""
    chosen = rest.groupBy("key", F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(LEADERS)).alias("slot")).agg(
        F.min_by(F.struct("rep", "label", "mark"), F.xxhash64("rep", F.lit(-turn))).alias("x"))
    chosen = written(chosen.select("key", F.col("x.rep").alias("a"), F.col("x.label").alias("a_label"), F.col("x.mark").alias("a_mark")), "leaders")
    return rest.join(chosen, "key").where("rep <> a and label <> a_label").where(close("mark", "a_mark")).select(
        F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b"))


def _with_all(rest: DataFrame) -> DataFrame:
    """All pairs (a, b) of a bucket across labels, each in the first bucket that both share."""
    x, y = (rest.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "label", "mark", "bands"))) for s in "ab")
    shared = F.filter(F.zip_with("bands_a", "bands_b", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())
    pairs = x.join(y, "key").where("rep_a < rep_b and label_a <> label_b").where(shared[0] == F.col("key")).where(close("mark_a", "mark_b"))
    return pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def clusters(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "signatures")
    signatures(docs, "doc_id", "text").write.parquet(path)
    made = spark.read.parquet(path)
    classes = written(made.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by(F.struct("n_shingles", "filled", "sketch"), "doc_id").alias("mark")), "classes")
    marks = written(made.select("doc_id", "n_shingles", "set_key"), "set-keys")
    release(spark, path)  # both tables made from it are written
    sketches = classes.select("rep", "mark")
    rows = classes.select(F.explode("bands").alias("key"), "rep")
    leaders = written(rows.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "buckets")
    members = written(rows.join(leaders, "key"), "members")
    tested = members.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    tested = written(tested.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b").where(close("x", "y")).select("a", "b"), "pairs")
    links = written(confirmed(tested, docs), "links")
    labels = written(components(links), "labels")

    # Buckets that still hold several labels: more leaders, which join large groups of near copies, then all pairs across labels.
    for turn in range(1, LEADER_PASSES + 2):
        every = turn > LEADER_PASSES
        rest = _unsettled(members, labels, classes.select("rep", "mark", "bands"))
        found = _with_all(rest) if every else _with_leaders(rest, turn).distinct()
        found = written(found.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(found)
        more = written(confirmed(found, docs), "links")
        if more.limit(1).count():
            links = links.union(more)
            labels = written(components(links), "labels")

    whole = classes.select("set_key", "rep").join(labels.toDF("rep", "label"), "rep", "left").select(
        "set_key", F.coalesce("label", "rep").alias("component"))
    return marks.join(written(whole, "class-labels"), "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
