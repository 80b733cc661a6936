"""Operators on Spark: edge cases, brute force, SQL twins, the pipeline."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle_check import compare, connect
from tidegrid.llm import chat, chunks, cover, languages, near, packing, pages, quality, secrets, sharding
from tidegrid.llm.queries import BYTES, ORACLES, PIECES, QUERIES, SHARDS

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _text_of_row string, label string, shard int, a long"
EDGES = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "  \n\t", "en", "s", 4), (4, "word " * 30000, "en", "s", 150000),
         (5, "one two", None, "s", 7), (6, "one two", "de", None, 7), (6, "one two", "de", None, 7), (7, "日本 語", "ja", "s", 4)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in EDGES], DOCUMENTS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


OPERATORS = {
    "languages": languages.identify, "chunks": lambda d: chunks.digests(d, PIECES), "quality": quality.judge,
    "sharding": lambda d: sharding.place(d, SHARDS), "secrets": secrets.digests, "redact": secrets.redact,
    "near": near.clusters, "packing": lambda d: packing.pieces(d, BYTES),
    "pages": lambda d: pages.extract(d, ["doc_id"], "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges_and_empty(edges, nothing, name):
    rows = OPERATORS[name](edges).collect()
    assert len(rows) >= len(EDGES) and {r["doc_id"] for r in rows} == {r[0] for r in EDGES}
    assert OPERATORS[name](nothing).count() == 0


def test_edge_values(edges):
    near_rows = {r["doc_id"]: r for r in near.clusters(edges).collect()}
    assert [near_rows[i]["component_id"] for i in range(1, 8)] == [1, 2, 3, 4, 5, 5, 7]
    assert near_rows[1]["n_shingles"] == 0 and near_rows[4]["n_shingles"] == 1
    assert {r["doc_id"]: r["lang_pred"] for r in languages.identify(edges).collect()}[1] == "und"
    assert {r["doc_id"]: r["n_tokens"] for r in chunks.digests(edges, PIECES).collect()}[1] == 1
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pieces(edges, BYTES).collect()}[2] == 1


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_sql_twins(spark, small, name):
    assert compare(spark, connect(small), name, QUERIES[name], ORACLES[name], small) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_queries_return_every_row(spark, small, name):
    rows = QUERIES[name](spark, small).toPandas()
    key, table = ("page_id", "pages") if "page_id" in rows else ("doc_id", "documents")
    ids = [r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(key).collect()]
    assert sorted(set(rows[key])) == sorted(ids)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op1_language_id"](spark, folder).toPandas().merge(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_quality_keeps_the_clean(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op3_quality_rules"](spark, folder).toPandas().merge(
        spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    fine = found[(found.quality == 1) & ~found.base_failed]
    assert fine.kept.mean() > 0.99
    assert not (found.kept & found.base_failed).any()


def test_fences_against_exact_quantiles(spark, small):
    rows = quality.judge(spark.read.parquet(f"{small}/documents.parquet"), min_rows=10 ** 9).toPandas()
    fine = pd.Series(True, index=rows.index)
    for m, (slack, two_sided) in quality.MEASURES.items():
        low, mid, high = (np.quantile(rows[m], q, method="inverted_cdf") for q in quality.RANKS)
        fine &= rows[m] <= mid + 6 * (mid - low) + slack
        if two_sided:
            fine &= rows[m] >= mid - 6 * (high - mid) - slack
    assert ((fine & ~rows.base_failed) == rows.kept).mean() > 0.99


def _similar(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def test_near_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 8)):
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and _similar(sets[i], sets[j]):
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    got = near.clusters(docs).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == label
    assert got.n_shingles.tolist() == [len(s) for s in sets]


def test_vectors_of_all_kinds(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    points = np.concatenate([base + s * rng.normal(size=base.shape) for s in (0, 0.05, 0.2, 0.3)]).astype(np.float32)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    rows += [(500, rows[0][1]), (501, None), (502, [0.0] * 8), (503, [float("nan")] + [1.0] * 7), (504, [None] + [1.0] * 7),
             (505, [float("inf")] + [1.0] * 7), (506, []), (507, [2 * x for x in rows[0][1]]), (508, [1.0, 2.0]), (509, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "2 AS n")
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if i < 501 or i >= 507}
    links = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    label = {i: i for i, _ in rows}
    for _ in range(100):
        label |= {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
    for settings in ({}, {"block": 16}, {"max_nodes": 4, "block": 8}):
        got = {r["vec_id"]: r for r in cover.clusters(df, **settings).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == {i: len(links.get(i, ())) for i, _ in rows}
        assert {i: r["component_id"] for i, r in got.items()} == label
    assert cover.clusters(df.limit(0)).count() == 0


def test_copies_of_vectors_without_neighbours_follow_the_input(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(6000, 32)).astype(np.float32)
    points[1::100] = points[::100] + 0.1 * rng.normal(size=(60, 32))
    df = spark.createDataFrame(pd.DataFrame({"rep": range(len(points)), "n": 1, "v": [x.astype(float).tolist() for x in points]})).withColumn(
        "point", F.col("rep").cast("string")).repartition(4).cache()
    few, many = (cover._dealt(df.where(F.col("rep") < n), 0.9, 256, 64).count() / n for n in (1200, 6000))
    assert many <= 1.3 * few <= 13
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    got = cover.clusters(df.select(F.col("rep").alias("vec_id"), F.col("v").alias("embedding")), block=64).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links == (unit @ unit.T >= 0.9).sum(axis=1) - 1).all() and got.n_links.sum() == 120


def test_loose_groups_share_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 32))
    points = centres[rng.integers(0, 100, 3000)] / np.linalg.norm(centres, axis=1).mean() + 0.07 * rng.normal(size=(3000, 32))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"rep": range(3000), "n": 1, "v": points.tolist()})).withColumn("point", F.col("rep").cast("string")).cache()
    # No group can be kept apart from another, so a vector meets all blocks, but not all groups.
    assert cover._dealt(df, 0.9, 256, 64).count() <= 3000 * 12
    links = unit @ unit.T >= 0.9
    got = cover.clusters(df.select(F.col("rep").alias("vec_id"), F.col("v").alias("embedding")), block=64).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links == links.sum(axis=1) - 1).all() and got.n_links.sum() > 1000
    label = np.arange(3000)
    for _ in range(100):
        label = np.minimum(label, np.where(links, label, 3000).min(axis=1))
    assert (got.component_id == label).all()


def test_more_than_a_thousand_lengths_and_languages(spark):
    vectors = spark.range(2060).selectExpr(
        "id AS vec_id", "array_repeat(if(id < 1030, 1.0D, 2.0D), CAST(id % 1030 + 1 AS INT)) AS embedding")
    got = cover.clusters(vectors).toPandas().set_index("vec_id")
    assert (got.n_links == 1).all() and (got.component_id == got.index % 1030).all()
    docs = spark.range(1010).selectExpr("concat('l', id) AS lang", "concat('text ', conv(id * 7919, 10, 36)) AS text").coalesce(1)
    assert len(languages.prototypes(docs, dimensions=64)) == 1010


def test_conversations_of_all_kinds(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 2, "assistant", "b"), (None, None, None, None), (2, None, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df, BYTES)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 2), None: (1, 0), 2: (1, 10)}
    assert chat.read_back(chat.format_turns(df.limit(0), BYTES)).count() == 0


def test_shards_are_files(spark, edges, tmp_path):
    sharding.write_shards(edges.drop("shard"), str(tmp_path / "out"), ["x", "y"], salt=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(EDGES)


def test_shards_keep_columns_of_any_name_and_type(spark, tmp_path):
    df = spark.sql("SELECT id AS doc_id, 'keep' AS _salt, id + 1 AS `a.b`, map('k', id) AS m, array(map('k', id)) AS n FROM range(40)")
    back = sharding.write_shards(df, str(tmp_path / "out"), ["x", "y"], salt=3)
    assert back.columns == [*df.columns, "slot", "shard"]
    rows = {r["doc_id"]: r for r in back.collect()}
    assert all(r["_salt"] == "keep" and r["a.b"] == i + 1 and r["m"] == {"k": i} and r["n"] == [{"k": i}] for i, r in rows.items()) and len(rows) == 40


def test_a_row_that_comes_again_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_ROWS", 50)
    df = spark.range(0, 2000, 1, 40).selectExpr("7 AS doc_id", "'same' AS text")
    back = sharding.write_shards(df, str(tmp_path / "out"), ["x", "y"])
    assert back.count() == 2000 and back.select("shard").distinct().count() == 1 and len(back.inputFiles()) > 10


def test_sharding_query_writes_whole_rows(spark, small):
    files = QUERIES["op4_sharding"](spark, small).inputFiles()
    assert files and all("/shard=" in f for f in files)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = [c for c in docs.columns if c not in ("slot", "shard")]
    assert spark.read.parquet(*files).select(columns).exceptAll(docs.select(columns)).count() == 0


def test_pipeline_against_its_parts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, at = at, stage(spark, at, small)
        assert at.columns == docs.columns
        gone = before.count() - at.count()
        assert gone >= 0 and (name != "secret_scan" or gone == 0)
    texts = at.toPandas()
    scanner = secrets.build()
    assert not any(secrets.spans(scanner, t) for t in texts.text)
    out = corpus_pipeline.run(spark, small).toPandas()
    assert sorted(set(out.doc_id)) == sorted(texts.doc_id)
    assert out.groupby("doc_id").length.sum().equals(out.groupby("doc_id").doc_tokens.first())


def test_pipeline_verdicts_are_of_rows(spark):
    """Null ids, repeated rows and one id on two texts: the surviving rows by brute force."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "sa") for b in ("ton", "rel", "mas", "vid", "pon", "gar", "nel")]
    good = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(8)]
    near_copy = " ".join([*good[2].split()[:-1], "last"])
    bad = "only three words"
    rows = [(1, good[0]), (2, good[1]), (None, good[3]), (None, good[3]), (None, bad), (5, good[4]), (5, good[4]), (6, good[5]), (6, bad),
            (9, good[2]), (8, near_copy), (None, good[2]), (10, good[6]), (10, good[7]), (11, None), (None, None), (None, good[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def left(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    fine = [r for r in rows if len((r[1] or "").split()) >= 20]
    assert left(corpus_pipeline.quality_rules(spark, docs, "")) == sorted(fine, key=str)

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = []
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        own = shingles(row[1])
        if not any(_similar(own, shingles(t)) if own else (row[0] is not None and i == row[0] and not shingles(t)) for i, t in kept):
            kept.append(row)
    assert left(corpus_pipeline.near_duplicates(spark, docs, "")) == sorted(kept, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_sketch_passes_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for size in (1, 3, 7, 20, 100, 400, 2000, 20000):
        for k in range(40):
            base = rng.integers(0, 2 ** 63, 2 * size, np.uint64)
            both = int(np.ceil(2 * size * 0.75 / 1.75))
            a, b = np.unique(base[:size]), np.unique(np.concatenate([base[:both], base[size:2 * size - both]]))
            marks = [(len(x), near.odd_sketch(x)) for x in (a, b)]
            rows.append((size, *[(n, f, o.tolist()) for n, (o, f) in marks]))
    mark = "struct<n_shingles: bigint, filled: int, sketch: array<bigint>>"
    df = spark.createDataFrame(rows, f"size int, a {mark}, b {mark}")
    assert df.where(~near.close("a", "b")).count() == 0
