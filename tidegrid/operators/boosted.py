"""Gradient boosted trees over rolling origins, one model of all series for each origin.

All origins are fitted in one computation and written as one table of models: a row per origin with
its error per round, the rounds in use and its trees as arrays. Forecasts, residuals, importances and
validation curves only read that table.

A model's rows are those of every series in the window, and the mean and spread of each series in the
window are inputs, so that one model serves series of different size. Where the rows of a window fit a
task (``task_rows``, counted first), a task fits the origins of a chunk one after another; rows are
copied once per chunk. Larger windows are grown level by level: rows are binned once, each level is one
aggregation of histograms keyed by (origin, node, input) over all origins whose early stop is open, and only
the chosen splits reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import trees
from tidegrid.functions.trees import Boosting, best_round
from tidegrid.operators.blocks import epoch
from tidegrid.operators.linear import shared_residual_forecast
from tidegrid.plans.backtest import Backtest, origin_bounds, origin_chunks, training_rows
from tidegrid.session import fresh_path, ship

__all__ = ["Boosting", "best_round"]

SERIES_FEATURES = ("series_mean", "series_sd")
MISSING = -1e12  # Fixed value: stands for a missing input.
TASK_ROWS = 1_000_000
REWRITE = 8  # Rounds after which stored predictions are brought up to date.
MODELS = "_o long, kept int, errors array<double>, feature array<int>, edge array<double>, leaf array<double>, gain array<double>"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a lost executor costs a rescan."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_features(df: DataFrame) -> DataFrame:
    """The feature frame as a stored table, for several passes over its columns."""
    return stored(df, "features")


def _inputs(df: DataFrame, features) -> DataFrame:
    """Inputs as one array; a vector column gives one input for each of its places. Missing ones become a
    value below all others, which a split can set apart."""
    kinds, parts = dict(zip(df.columns, (f.dataType for f in df.schema.fields))), []
    for c in features:
        if isinstance(kinds[c], VectorUDT):
            parts.append(vector_to_array(c))
        else:
            parts.append(F.array(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING))))
    return df.withColumn("_x", F.concat(*parts))


def _rows(table: DataFrame, features, keys) -> DataFrame:
    """keys, ts, value, the inputs, an id of the series and one of the row."""
    return _inputs(table.select(*keys, "ts", "value", *features), features).select(
        *keys, "ts", F.col("value").cast("double").alias("value"), "_x",
        F.xxhash64(*keys).alias("_unit"), F.xxhash64(*keys, "ts").alias("_id"))


def origins(table: DataFrame, spec: Backtest, keys=("series_id",)) -> list[int]:
    """All origins, in epoch seconds."""
    low, high = origin_bounds(table, spec, keys).agg(F.min("_first"), F.max("_last")).first()
    return [] if low is None else list(range(int(low), int(high) + 1, spec.every_seconds))


def _per_chunk(table: DataFrame, found: list[int]) -> int:
    """Origins of a chunk: a few chunks for each core, as neighbours share their rows."""
    return max(1, math.ceil(len(found) / (3 * table.sparkSession.sparkContext.defaultParallelism)))


def _scaled(x: np.ndarray, unit: np.ndarray, y: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Inputs plus mean and spread of each row's series over the ``head`` rows. A series without any has missing ones."""
    _, place = np.unique(unit, return_inverse=True)
    n = np.bincount(place[head], minlength=place.max() + 1).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.bincount(place[head], y[head], len(n)) / n
        apart = np.bincount(place[head], (y[head] - mean[place[head]]) ** 2, len(n))
        sd = np.where(n > 1, np.sqrt(apart / (n - 1)), 0.0)
    mean, sd = (np.where(n > 0, v, MISSING) for v in (mean, sd))
    return np.column_stack([x, mean[place], sd[place]])


class _Window:
    """The rows of a chunk as arrays, and the parts of one origin."""

    def __init__(self, rows: pa.Table, spec: Backtest, per_chunk: int):
        rows = rows.combine_chunks().sort_by([("_s", "ascending"), ("_id", "ascending")])
        self.spec, self.rows = spec, rows
        self.s, self.y, self.unit, self.id, self.first, self.last = (
            rows[c].to_numpy() for c in ("_s", "value", "_unit", "_id", "_first", "_last"))
        self.x = pc.list_flatten(rows["_x"].combine_chunks()).to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        chunk = rows["_chunk"][0].as_py() if rows.num_rows else 0
        width = spec.every_seconds
        self.origins = [o for o in range(chunk * per_chunk * width, (chunk + 1) * per_chunk * width, width)
                        if ((self.first <= o) & (o <= self.last)).any()]

    def part(self, o: int, ahead: bool) -> np.ndarray:
        """Rows of the training window, or of window and horizon, of the series that have this origin."""
        sec = self.spec.step_seconds
        start, end = o - (self.spec.score_from + self.spec.train - 1) * sec, o - self.spec.score_from * sec
        if ahead:
            end += self.spec.horizon * sec
        a, b = np.searchsorted(self.s, start), np.searchsorted(self.s, end, side="right")
        at = np.arange(a, b)
        return at[(self.first[at] <= o) & (o <= self.last[at])]

    def head_ends(self, o: int) -> int:
        return o - (self.spec.score_from + self.spec.valid) * self.spec.step_seconds


def _chunked(table: DataFrame, features, spec: Backtest, per_chunk: int, keys) -> DataFrame:
    return origin_chunks(_rows(table, features, keys), spec, per_chunk, keys).withColumn("_s", epoch())


def fit_origins(table: DataFrame, features, spec: Backtest, boosting: Boosting = Boosting(), keys=("series_id",),
                all_rounds: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """The models of all origins, written. ``all_rounds`` goes on after the early stop is settled."""
    ship(table.sparkSession)
    found = origins(table, spec, keys)
    if not found:
        raise ValueError("no origin has a full training window")
    spec = replace(spec, expanding=False)
    per_chunk = _per_chunk(table, found)
    largest = origin_chunks(table.select(*keys, "ts"), spec, per_chunk, keys).groupBy("_chunk").count().agg(F.max("count")).first()[0]
    while largest > task_rows and per_chunk > 1:
        per_chunk = max(1, per_chunk // 2)
        largest = origin_chunks(table.select(*keys, "ts"), spec, per_chunk, keys).groupBy("_chunk").count().agg(F.max("count")).first()[0]
    if largest > task_rows:
        return _fit_by_levels(table, features, spec, boosting, keys, all_rounds, task_rows)

    def run(rows: pa.Table) -> pa.Table:
        w, out = _Window(rows, spec, per_chunk), []
        for o in w.origins:
            at = w.part(o, False)
            at = at[~np.isnan(w.y[at])]
            valid = w.s[at] > w.head_ends(o)
            x = _scaled(w.x[at], w.unit[at], w.y[at], ~valid)
            out.append((o, *trees.fit(x, w.y[at], valid, w.id[at], boosting, o, all_rounds)))
        columns = list(zip(*out)) or [[]] * 7
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, _arrow_fields())], names=_names())

    rows = _chunked(table, features, spec, per_chunk, keys).select("_s", "value", "_unit", "_id", "_first", "_last", "_x", "_chunk")
    chunks = rows.repartition(2 * table.sparkSession.sparkContext.defaultParallelism, "_chunk")
    return stored(chunks.groupBy("_chunk").applyInArrow(run, MODELS), "models")


def _names() -> list[str]:
    return [c.split()[0] for c in MODELS.split(", ")]


def _arrow_fields() -> list[pa.DataType]:
    doubles = pa.list_(pa.float64())
    return [pa.int64(), pa.int32(), doubles, pa.list_(pa.int32()), doubles, doubles, doubles]


# Windows larger than a task: one aggregation a level for all origins.

def _level_rows(table: DataFrame, features, spec: Backtest, b: Boosting, keys, task_rows: int) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(_o, _id, valid, y, codes, fitted), binned once and written, and the edges of each origin's inputs."""
    rows = training_rows(_rows(table, features, keys), spec, keys).where("value IS NOT NULL").withColumn("_o", epoch("origin"))
    head = rows.where("NOT is_valid")
    scale = head.groupBy("_unit", "_o").agg(F.avg("value").alias("m"), F.coalesce(F.stddev("value"), F.lit(0.0)).alias("d"))
    rows = stored(rows.join(scale, ["_unit", "_o"], "left").select("_o", "_id", F.col("is_valid").alias("valid"), F.col("value").alias("y"), F.concat(
        "_x", F.array(F.coalesce("m", F.lit(MISSING)), F.coalesce("d", F.lit(MISSING)))).alias("x")), "window-rows")
    count = rows.select(F.size("x")).first()[0]
    shares = F.array(*(F.lit(i / b.bins) for i in range(1, b.bins)))
    quantiles = rows.where("NOT valid").groupBy("_o").agg(F.count("*").alias("n"), *(
        F.struct(F.percentile_approx(F.col("x")[i], shares, F.lit(100_000)).alias("q"), F.max(F.col("x")[i]).alias("top")).alias(f"e{i}") for i in range(count)))
    edges, most = {}, 0
    for row in quantiles.toLocalIterator():
        edges[row["_o"]] = [np.unique([v for v in row[f"e{i}"]["q"] if v < row[f"e{i}"]["top"]]) for i in range(count)]
        most = max(most, row["n"])
    sent = table.sparkSession.sparkContext.broadcast(edges)

    def run(batches):
        for batch in batches:
            o, x = batch.column("_o").to_numpy(), pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.empty(x.shape, np.uint8)
            for one in np.unique(o):
                if one in sent.value:
                    codes[o == one] = trees.binned(x[o == one], sent.value[one])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_o", "_id", "valid", "y")), pa.array(list(map(bytes, codes)), pa.binary()),
                                              pa.array(np.full(len(o), b.start))], names=["_o", "_id", "valid", "y", "codes", "fitted"])

    salted = rows.withColumn("salt", F.pmod("_id", F.lit(math.ceil(most / task_rows))))
    return stored(salted.repartition("_o", "salt").drop("salt").mapInArrow(
        run, "_o long, _id long, valid boolean, y double, codes binary, fitted double"), "binned"), edges


def _fit_by_levels(table: DataFrame, features, spec: Backtest, b: Boosting, keys, all_rounds: bool, task_rows: int) -> DataFrame:
    """The same models, every level of every round as one aggregation over all open origins."""
    spark = table.sparkSession
    rows, edges = _level_rows(table, features, spec, b, keys, task_rows)
    inputs = max(map(len, edges.values()))
    made: dict[int, list] = {o: [] for o in edges}
    errors: dict[int, list[float]] = {o: [] for o in edges}
    since, open_ = 0, sorted(edges)

    def passes(batches, finished, growing, round_):
        """For each origin of a batch: its rows, their codes, predictions after the finished trees, and nodes in the growing one."""
        for batch in batches:
            origin = batch.column("_o").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(origin), inputs)
            for o in np.unique(origin).tolist():
                if o not in finished:
                    continue
                at = np.flatnonzero(origin == o)
                fitted = batch.column("fitted").to_numpy()[at]
                for feature, cut, leaf, _ in finished[o]:
                    fitted = fitted + trees.walk(codes[at], feature, cut, leaf, b.depth)
                node = np.zeros(len(at), np.int64)
                if growing is not None:
                    node = trees.walk(codes[at], *growing[o][:2], np.arange(b.nodes), b.depth)
                yield batch, o, at, codes[at], fitted, node

    def sums(finished, growing, round_, level):
        sent = spark.sparkContext.broadcast((finished, growing))

        def run(batches):
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch, o, at, codes, fitted, node in passes(batches, *sent.value, round_):
                ids = batch.column("_id").to_numpy()[at]
                use = ~batch.column("valid").to_numpy(zero_copy_only=False)[at] & trees.drawn_rows(ids, b, o, round_) & (node >= 2 ** level - 1)
                gradient, flat = (fitted - batch.column("y").to_numpy()[at])[use], codes[use].astype(np.int64) + np.arange(inputs) * b.bins
                known, slot = np.unique(node[use], return_inverse=True)
                hist = trees.histogram(flat, slot, gradient, len(known), inputs, b.bins)
                for i, k in enumerate(known.tolist()):
                    total[o, k] = total.get((o, k), 0) + hist[:, i]
            for (o, k), h in total.items():
                flat = h.transpose(1, 0, 2).reshape(inputs, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(inputs, o)), pa.array(np.full(inputs, k)), pa.array(np.arange(inputs)),
                                                  pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))],
                                                 names=["o", "node", "input", "sums"])

        def best(batches):
            for batch in batches:
                o, node, which = (batch.column(c).to_numpy() for c in ("o", "node", "input"))
                hist = pc.list_flatten(batch.column("sums")).to_numpy(zero_copy_only=False).reshape(len(o), 1, 2, b.bins).transpose(2, 0, 1, 3)
                gain, _, cut, left_g, left_n = trees.splits(hist, b, np.ones(1, bool))
                drawn = {k: trees.drawn_columns(inputs, b, k, round_, level) for k in set(o.tolist())}
                gain = np.where([drawn[k][i] for k, i in zip(o.tolist(), which.tolist())], gain, 0.0)
                whole = hist.sum(axis=3)[:, :, 0]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("o", "node", "input")), *map(pa.array, (gain, cut, left_g, left_n, *whole))],
                                                 names=["o", "node", "input", "gain", "cut", "left_g", "left_n", "g", "n"])

        added = rows.mapInArrow(run, "o long, node long, input long, sums array<double>").groupBy("o", "node", "input").agg(
            vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        found = added.mapInArrow(best, "o long, node long, input long, gain double, cut long, left_g double, left_n double, g double, n double")
        sides = F.sort_array(F.collect_list(F.struct("input", *(c for c in found.columns if c != "input"))))  # one entry for each input
        ties = found.groupBy("o", "node").agg(sides.alias("s"), F.max("gain").alias("top"))
        return ties.select(F.filter("s", lambda x: x["gain"] >= F.col("top") * (1 - trees.SAME))[0].alias("s")).select("s.*").collect()

    def measured(finished):
        sent = spark.sparkContext.broadcast(finished)

        def run(batches):
            for batch, o, at, _, fitted, _ in passes(batches, sent.value, None, 0):
                apart = (fitted - batch.column("y").to_numpy()[at])[batch.column("valid").to_numpy(zero_copy_only=False)[at]]
                yield pa.RecordBatch.from_arrays([pa.array([o]), pa.array([float(apart @ apart)]), pa.array([float(len(apart))])], names=["o", "e", "n"])

        return rows.where("valid").mapInArrow(run, "o long, e double, n double").groupBy("o").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).collect()

    for round_ in range(b.rounds):
        finished = {o: made[o][since:] for o in open_}
        growing = {o: trees.empty_tree(b) for o in open_}
        totals = {o: (np.zeros(b.nodes), np.zeros(b.nodes)) for o in open_}
        for level in range(b.depth):
            chosen = sums(finished, growing, round_, level)
            for s in chosen:
                feature, cut, _, gain = growing[s["o"]]
                g, n = totals[s["o"]]
                k = s["node"]
                g[k], n[k] = s["g"], s["n"]
                if s["gain"] > 0:
                    feature[k], cut[k], gain[k] = s["input"], s["cut"], s["gain"]
                    g[2 * k + 1], n[2 * k + 1] = s["left_g"], s["left_n"]
                    g[2 * k + 2], n[2 * k + 2] = s["g"] - s["left_g"], s["n"] - s["left_n"]
            if not any(s["gain"] > 0 for s in chosen):
                break
        for o in open_:
            g, n = totals[o]
            ends = growing[o][0] < 0
            growing[o][2][ends] = (-b.rate * g / (n + max(b.l2, 1e-12)))[ends]
            made[o].append(growing[o])
        if spec.valid:
            for row in measured({o: made[o][since:] for o in open_}):
                if row["n"]:
                    errors[row["o"]].append(math.sqrt(row["e"] / row["n"]))
            if b.use_best_round and not all_rounds:
                open_ = [o for o in open_ if not errors[o] or not trees.settled(errors[o], b.patience)]
        if not open_:
            break
        if len(made[open_[0]]) - since == REWRITE and round_ + 1 < b.rounds:
            rows, since = _brought_up(rows, {o: made[o][since:] for o in open_}, passes), len(made[open_[0]])

    def model(o):
        kept = best_round(errors[o], b.patience) if errors[o] and b.use_best_round else len(made[o])
        feature, cut, leaf, gain = (np.concatenate(x) for x in zip(*made[o]))
        return o, kept, errors[o], feature, np.concatenate([trees.edges_of(t[0], t[1], edges[o]) for t in made[o]]), leaf, gain

    columns = zip(*map(model, sorted(made)))
    models = pa.table([pa.array(list(c), k) for c, k in zip(columns, _arrow_fields())], names=_names())
    return stored(spark.createDataFrame(models, MODELS), "models")


def _brought_up(rows: DataFrame, finished, passes) -> DataFrame:
    """Rows of the open origins with predictions after their finished trees, written."""
    sent = rows.sparkSession.sparkContext.broadcast(finished)
    names = rows.columns

    def run(batches):
        for batch, _, at, _, fitted, _ in passes(batches, sent.value, None, 0):
            part = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names if c != "fitted"), pa.array(fitted)], names=[*(c for c in names if c != "fitted"), "fitted"])

    ordered = rows.select(*(c for c in names if c != "fitted"), "fitted")
    return stored(ordered.mapInArrow(run, ordered.schema), "binned")


# Readers of the models.

def predicted_rows(table: DataFrame, features, spec: Backtest, models: DataFrame, boosting: Boosting, keys=("series_id",),
                   window: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, _o, ts, value, prediction) of each origin's horizon, with ``window`` of its training rows too.

    Rows meet the models of their chunk of origins; large chunks are cut by series."""
    found = origins(table, spec, keys)
    spec, per_chunk = replace(spec, expanding=False), _per_chunk(table, found)
    rows = _chunked(table, features, spec, per_chunk, keys)
    largest = rows.groupBy("_chunk").count().agg(F.max("count")).first()[0] or 1
    salts = math.ceil(largest / task_rows)
    rows = rows.withColumn("_salt", F.pmod("_unit", F.lit(salts))).select(*keys, "ts", "_s", "value", "_unit", "_id", "_first", "_last", "_x", "_chunk", "_salt")
    own = models.withColumn("_chunk", F.floor(F.col("_o") / (per_chunk * spec.every_seconds))).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    schema = rows.select(*keys).schema.add("_o", "long")
    schema = T.StructType([*schema.fields, T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()), T.StructField("prediction", T.DoubleType())])

    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        w = _Window(rows, spec, per_chunk)
        known = {m["_o"]: m for m in models.to_pylist()} if rows.num_rows else {}
        parts = []
        for o in w.origins:
            if o not in known:
                continue
            at = w.part(o, True)
            x = _scaled(w.x[at], w.unit[at], w.y[at], (w.s[at] <= w.head_ends(o)) & ~np.isnan(w.y[at]))
            if not window:
                ahead = w.s[at] > o - spec.score_from * spec.step_seconds
                at, x = at[ahead], x[ahead]
            m = known[o]
            p = trees.predict(x, m["kept"], *(np.array(m[c]) for c in ("feature", "edge", "leaf")), boosting)
            part = w.rows.take(pa.array(at)).select([*keys, "ts", "value"])
            parts.append(part.add_column(len(keys), "_o", pa.array(np.full(len(at), o))).append_column("prediction", pa.array(p)))
        return pa.concat_tables(parts) if parts else w.rows.select([*keys, "ts", "value"]).slice(0, 0).add_column(
            len(keys), "_o", pa.array([], pa.int64())).append_column("prediction", pa.array([], pa.float64()))

    n = 2 * table.sparkSession.sparkContext.defaultParallelism
    both = rows.repartition(n, "_chunk", "_salt").groupBy("_chunk", "_salt").cogroup(
        own.repartition(n, "_chunk", "_salt").groupBy("_chunk", "_salt"))
    return both.applyInArrow(run, schema)


def forecasts(table: DataFrame, features, spec: Backtest, models: DataFrame, boosting: Boosting = Boosting(), residual_order=None,
              residual_seasonal=(1, 0, 0), period: int = 24, keys=("series_id",)) -> DataFrame:
    """(keys, origin, step, ts, actual, base, residual, predicted) of all origins.

    ``residual_order`` adds the seasonal ARMA forecast of the residuals over each origin's own training window."""
    spec = replace(spec, expanding=False)
    rows = predicted_rows(table, features, spec, models, boosting, keys, residual_order is not None)
    step = ((epoch() - F.col("_o")) / spec.step_seconds + spec.score_from).cast("int")
    if residual_order is not None:
        rows = stored(rows, "window-predictions")
    ahead = rows.withColumn("step", step).where("step >= 1").select(
        *keys, F.timestamp_seconds("_o").alias("origin"), "step", "ts", F.col("value").alias("actual"), F.col("prediction").alias("base"), "_o")
    if residual_order is None:
        return ahead.drop("_o").withColumns({"residual": F.lit(0.0), "predicted": F.col("base")})
    # The rows of an origin are a series of their own, just as long as its one window and horizon.
    left = rows.select(*keys, "_o", "ts", (F.col("value") - F.col("prediction")).alias("residual"))
    own = replace(spec, first=None, last=None)
    layer = shared_residual_forecast(left.withColumnRenamed("_o", "_of"), own, residual_order, residual_seasonal, period, (*keys, "_of")).select(
        *keys, F.col("_of").alias("_o"), "step", "residual")
    return ahead.join(layer, [*keys, "_o", "step"]).drop("_o").withColumn("predicted", F.col("base") + F.col("residual"))


def boosted_backtest(table: DataFrame, features, spec: Backtest, boosting: Boosting = Boosting(), residual_order=None,
                     residual_seasonal=(1, 0, 0), period: int = 24, keys=("series_id",)) -> tuple[DataFrame, DataFrame]:
    """Forecasts of all origins, and their models. ``table`` should be a stored frame (``store_features``)."""
    models = fit_origins(table, features, spec, boosting, keys)
    return forecasts(table, features, spec, models, boosting, residual_order, residual_seasonal, period, keys), models


def importance(models: DataFrame, features, boosting: Boosting = Boosting()) -> DataFrame:
    """(feature, importance): share of the gain of an origin's kept trees, averaged over the models; one row per
    input. ``features`` are plain columns, not vectors."""
    names = [*features, *SERIES_FEATURES]
    used = F.slice(F.arrays_zip("feature", "gain"), 1, F.col("kept") * boosting.nodes)
    gains = models.select("_o", F.explode(used).alias("x")).where("x.feature >= 0").groupBy("_o", "x.feature").agg(F.sum("x.gain").alias("gain"))
    whole = gains.groupBy("_o").agg(F.sum("gain").alias("whole"))
    shares = gains.join(whole, "_o").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    inputs = models.sparkSession.createDataFrame(list(enumerate(names)), "feature int, name string")
    count = models.agg(F.count("*").alias("models"))
    return inputs.join(shares, "feature", "left").join(count, F.lit(True)).select(
        F.col("name").alias("feature"), (F.coalesce("share", F.lit(0.0)) / F.col("models")).alias("importance")).orderBy(F.desc("importance"))


def validation_curve(models: DataFrame) -> DataFrame:
    """(origin, round, valid_error, kept): error of each round on the validation tail."""
    return models.select(F.timestamp_seconds("_o").alias("origin"), F.posexplode("errors").alias("at", "valid_error"), F.col("kept").alias("rounds")).select(
        "origin", (F.col("at") + 1).alias("round"), "valid_error", (F.col("at") + 1 == F.col("rounds")).cast("int").alias("kept"))


def ranked(table: DataFrame) -> DataFrame:
    """Position of each input by importance. The window sees one row per input."""
    order = Window.orderBy(F.desc("importance"), "feature")
    return table.withColumn("position", F.row_number().over(order))
