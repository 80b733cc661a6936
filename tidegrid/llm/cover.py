"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one, so cosine >= c is a distance of at most sqrt(2 - 2c).
Equal vectors are one point with a count.

Upper levels: nested nets with halving radii over a bounded sample (``SAMPLE`` points; it
only shapes the tree). The finest net of at most ``max_nodes`` points gives the nodes; every
vector joins its nearest, and each node's covering radius is measured over all its vectors.
Pairs of nodes farther apart than the threshold and both radii are pruned. Nodes that are left
together are packed into, and large ones cut into, blocks of ``block`` vectors or an eighth of
all (at most 16 MB), and a task gets one pair of blocks. Lower levels: a task builds the tree of each block and traverses both at once: node
pairs are pruned, or taken whole where even the farthest members link. Leaves are compared by
upper bounds of their cosines first, all pairs that these leave open exactly in double precision.
Only counts and one root per vector leave a task, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts link with
nothing (0 links, a component of their own); vectors of different lengths never link; equal
rows link with each other; a null id has no component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import written
from tidegrid.llm.graph import components

SAMPLE = 2048
SLACK = 1e-9
# A comparison of rows by columns stays in a core's cache; more candidate numbers than MANY are compared as a whole.
ROWS, COLUMNS, MANY = 256, 2048, 1 << 21
# A pair of balls taken on by itself costs about as much as so many pairs of vectors.
STEP = 1 << 15
# Cuts of a large node, and the bytes a cut may have before there are more of them.
CUTS, CUT_BYTES = 8, 16 << 20


def net(points: np.ndarray, radius: float, first: list[int]) -> list[int]:
    """Indices of a net that keeps ``first``: every point lies within ``radius`` of one."""
    chosen, far = [], np.full(len(points), np.inf)
    todo = list(first)
    while True:
        if todo:
            k = todo.pop(0)
        else:
            k = int(far.argmax())
            if far[k] <= radius:
                return chosen
        chosen.append(k)
        far = np.minimum(far, np.linalg.norm(points - points[k], axis=1))


class Node:
    """A ball: its members (indices), centre, covering radius and child balls."""

    def __init__(self, points: np.ndarray, at: np.ndarray, centre: np.ndarray, radius: float, leaf: int):
        self.at, self.centre = at, centre
        self.radius = float(np.linalg.norm(points[at] - centre, axis=1).max()) + SLACK
        self.children: list[Node] = []
        while len(at) > leaf and radius > 0.05 and not self.children:
            radius /= 2
            if radius >= self.radius:
                continue
            chosen = self._net(points[at], radius, len(at) // 8)
            if chosen is None:
                break
            centres = points[at[chosen]]
            nearest = np.concatenate([(points[at[i:i + ROWS]] @ centres.T).argmax(axis=1) for i in range(0, len(at), ROWS)])
            members = np.split(at[np.argsort(nearest, kind="stable")], np.cumsum(np.bincount(nearest, minlength=len(centres)))[:-1])
            self.children = [Node(points, m, c, radius, leaf) for m, c in zip(members, centres) if len(m)]

    @staticmethod
    def _net(points, radius, most):
        """A greedy net, or None if it needs more than ``most`` points (no finer structure)."""
        near, chosen, left = 1 - radius * radius / 2, [], np.arange(len(points))
        while len(left):
            head, rest = left[:ROWS], left[ROWS:]
            close = points[head] @ points[head].T >= near
            free, picked = np.ones(len(head), bool), []
            for i in range(len(head)):
                if free[i]:
                    picked.append(head[i])
                    free &= ~close[i]
            chosen += picked
            left = rest[(points[rest] @ points[picked].T).max(axis=1) < near] if len(rest) else rest
            # Points of a net of that size cover eight others on average; those that hardly cover one show there is none.
            if len(chosen) > most or len(left) and len(points) - len(left) < 2 * len(chosen):
                return None
        return chosen


def _leading(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides in single precision with fewer columns, and how much less than the cosine their products may be.

    The columns are the strongest common directions and the length of the rest, so a product
    is at least the cosine but for rounding: what stays below the threshold cannot link."""
    width = a.shape[1]
    if width >= 32 and len(a) * len(b) >= 64 * width * width:
        basis = np.linalg.eigh(a.T @ a + b.T @ b)[1][:, ::-1][:, :3 * width // 8]
        a, b = ((lead, np.sqrt(np.maximum((x * x).sum(axis=1) - (lead * lead).sum(axis=1), 0)))
                for x, lead in ((a, a @ basis), (b, b @ basis)))
        a, b = np.column_stack(a), np.column_stack(b)
    return a.astype(np.float32), b.astype(np.float32), (a.shape[1] + 8) * 2.0 ** -23


def traverse(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, cosine: float, same: bool, leaf: int = 256):
    """(links of a, links of b, root of each row): links weigh the partner's count, roots name local components."""
    limit = math.sqrt(2 - 2 * cosine)
    links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    parent = np.arange(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    lead_a, lead_b, less = _leading(a, b)

    def tie(u, v):
        # Every row points to the root of its tree; larger roots are hung below smaller ones until no link joins two trees.
        while True:
            u, v = parent[u], parent[v]
            apart = u != v
            if not apart.any():
                return
            u, v = u[apart], v[apart]
            np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]

    def whole(x, y):
        """All members link, but none with itself."""
        if x is y:
            links_a[x.at] += nb[x.at].sum() - nb[x.at]
            return tie(np.repeat(x.at[0], len(x.at)), x.at)
        links_a[x.at] += nb[y.at].sum()
        (links_a if same else links_b)[y.at] += na[x.at].sum()
        tie(np.repeat(x.at[0], len(y.at)), y.at + shift)
        tie(np.repeat(y.at[0] + shift, len(x.at)), x.at)

    def compare(x, y):
        for s in range(0, len(y.at), COLUMNS):
            q = y.at[s:s + COLUMNS]
            columns = np.ascontiguousarray(lead_b[q].T)
            for r in range(0, len(x.at), ROWS):
                p = x.at[r:r + ROWS]
                i, j = np.divmod(np.flatnonzero(lead_a[p] @ columns >= cosine - less), len(q))
                if not len(i):
                    continue
                if len(i) * a.shape[1] > MANY:
                    c = a[p] @ b[q].T
                    i, j = np.nonzero(c >= cosine - SLACK)
                    c = c[i, j]
                else:
                    c = np.einsum("ij,ij->i", a[p[i]], b[q[j]])
                i, j = p[i], q[j]
                linked = c >= cosine
                for k in np.flatnonzero(np.abs(c - cosine) < SLACK):
                    linked[k] = math.fsum(a[i[k]] * b[j[k]]) >= cosine
                if same:
                    linked &= i != j
                i, j = i[linked], j[linked]
                np.add.at(links_a, i, nb[j])
                if x is not y:
                    np.add.at(links_a if same else links_b, j, na[i])
                tie(i, j + shift)

    def open_pairs(x, y):
        """Pairs of parts that may link, or None where taking the balls apart saves too little."""
        xs, ys = x.children or [x], y.children or [y]
        centres, radii = np.array([d.centre for d in ys]).T, np.array([d.radius for d in ys])
        sizes, work, pairs = np.array([len(d.at) for d in ys]), 0, []
        for r in range(0, len(xs), ROWS):
            some = xs[r:r + ROWS]
            apart = np.sqrt(np.maximum(2 - 2 * np.array([c.centre for c in some]) @ centres, 0))
            near = apart - np.array([c.radius for c in some])[:, None] - radii <= limit + 1e-6
            i, j = np.nonzero(near)
            if x is y:
                # Each pair of children once, so two different nodes never share a member.
                once = i + r <= j
                i, j = i[once], j[once]
            pairs.append((i + r, j))
            work += int((np.array([len(c.at) for c in some])[i] * sizes[j] + STEP).sum())
            if 2 * work > len(x.at) * len(y.at):
                return None
        return [(xs[i], ys[j]) for some in pairs for i, j in zip(*some)]

    tree = Node(a, np.arange(len(a)), a[0], 2.0, leaf)
    other = tree if same else Node(b, np.arange(len(b)), b[0], 2.0, leaf)
    todo = [(tree, other)]
    while todo:
        x, y = todo.pop()
        apart = float(np.linalg.norm(x.centre - y.centre))
        if apart - x.radius - y.radius > limit + SLACK:
            continue
        if apart + x.radius + y.radius <= limit - SLACK:
            whole(x, y)
            continue
        parts = open_pairs(x, y) if x.children or y.children else None
        if parts is None:
            compare(x, y)
        else:
            todo += parts
    return links_a, links_b, parent


def _unit(column) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    points = flat.reshape(len(column), -1)
    scale = np.abs(points).max(axis=1, keepdims=True)
    points = points / scale
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def clusters(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9,
             max_nodes: int = 256, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = written(rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn(
        "point", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))).withColumn(
        "v", F.when(F.col("fine"), F.col("v"))), "vectors")
    points = written(rows.where("fine").groupBy("point").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min_by("v", "vec_id").alias("v")), "points")
    # The only length and those of more than a block of vectors have upper levels; all others are one job, a group each.
    points = points.withColumn("size", F.size("v"))
    sizes = written(points.groupBy("size").agg(F.count("*").alias("n")), "sizes")
    one = sizes.count() == 1
    large = [r["size"] for r in sizes.where((F.col("n") > block) | F.lit(one)).select("size").collect()]
    parts = [written(_block_links(points.where(F.col("size") == size), cosine, max_nodes, block), "size-links") if len(large) > 1
             else _block_links(points.where(F.col("size") == size), cosine, max_nodes, block) for size in large]
    if not one and sizes.where(F.col("n") <= block).limit(1).count():
        parts.append(_whole_links(points.where(~F.col("size").isin(large)) if large else points, cosine))
    found = reduce(DataFrame.unionByName, parts) if parts else None
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    found = written(found, "block-links")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).toDF("rep", "label")
    whole = points.select("point", "rep", "n").join(counted, "rep", "left").join(labels, "rep", "left").select(
        "point", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("label", "rep").alias("label"))
    return rows.select("vec_id", "point").join(written(whole, "point-links"), "point", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _whole_links(points: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root) of each vector that links, where the vectors of a length are one block."""
    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        unit = _unit(table.column("v").combine_chunks())
        links, _, roots = traverse(unit, unit, n, n, cosine, True)
        keep = links > 0
        return pa.table({"rep": rep[keep], "links": links[keep], "root": rep[roots[keep]]})

    return points.select("size", "rep", "n", "v").groupBy("size").applyInArrow(meet, "rep long, links long, root long")


def _dealt(points: DataFrame, cosine: float, max_nodes: int, block: int) -> DataFrame:
    """Each vector once for each block that its own block meets, with the pair of blocks (p, q)."""
    limit = math.sqrt(2 - 2 * cosine)
    sample = points.orderBy(F.xxhash64("point")).limit(SAMPLE).select("v").collect()
    shape = np.array([r[0] for r in sample], float)
    shape /= np.abs(shape).max(axis=1, keepdims=True)
    shape /= np.linalg.norm(shape, axis=1, keepdims=True)
    chosen, radius = [0], 2.0
    while radius > limit / 4:
        finer = net(shape, radius / 2, chosen)
        if len(finer) > max_nodes:
            break
        chosen, radius = finer, radius / 2
    centres = shape[chosen]

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                unit = _unit(batch.column("v"))
                near = unit @ centres.T
                node = near.argmax(axis=1)
                away = np.linalg.norm(unit - centres[node], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node.astype(np.int32)), pa.array(away)],
                                                 names=[*batch.schema.names, "node", "away"])

    placed = written(points.select("rep", "n", "v").mapInArrow(assign, "rep long, n long, v array<double>, node int, away double"), "placed")
    stats = {r["node"]: (r["away"], r["n"]) for r in placed.groupBy("node").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect()}
    # A cut holds an eighth of all vectors, so copies follow the input, until that is more than a task should hold.
    cut = max(block, min(-(-sum(n for _, n in stats.values()) // CUTS), CUT_BYTES // (8 * shape.shape[1])))
    nodes = list(stats)
    reach, sizes = np.array([stats[k][0] for k in nodes]), np.array([stats[k][1] for k in nodes])
    apart = np.array([np.linalg.norm(centres[nodes] - centres[k], axis=1) for k in nodes]).reshape(len(nodes), -1)
    close = apart - reach[:, None] - reach <= limit + SLACK
    # Small nodes share a group with the nearest of those that they meet anyway; only a large node by itself is cut.
    group, held = np.full(len(nodes), -1), []
    for i in np.argsort(-sizes, kind="stable"):
        if group[i] < 0:
            group[i], total = len(held), sizes[i]
            for j in np.argsort(apart[i], kind="stable"):
                if group[j] < 0 and close[i, j] and total + sizes[j] <= cut:
                    group[j], total = len(held), total + sizes[j]
            held.append(-(-int(total) // cut))
    meets = np.zeros((len(held), len(held)), bool)
    np.logical_or.at(meets, (group[:, None], group), close)
    near = [(k, int(g), int(h), held[g], held[h]) for k, g in zip(nodes, group) for h in np.flatnonzero(meets[g])]
    partners = placed.sparkSession.createDataFrame(near, "node int, group int, other int, own int, others int")
    # A block meets each block of the near groups; the pair is named by its smaller block first.
    dealt = placed.join(F.broadcast(partners), "node").withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("own")).cast("int"))
    dealt = dealt.withColumn("across", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    mine, yours = F.struct("group", "cut"), F.struct(F.col("other").alias("group"), F.col("across").alias("cut"))
    return dealt.select(F.least(mine, yours).alias("p"), F.greatest(mine, yours).alias("q"), (mine <= yours).alias("left"), "rep", "n", "v")


def _block_links(points: DataFrame, cosine: float, max_nodes: int, block: int) -> DataFrame:
    """(rep, links, root) of each vector that links within a pair of blocks."""
    def meet(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        rep = table.column("rep").to_numpy()
        n = table.column("n").to_numpy().astype(np.int64)
        unit = _unit(table.column("v").combine_chunks())
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        same = p == q
        order = np.argsort(rep, kind="stable")
        rep, n, unit, left = rep[order], n[order], unit[order], left[order]
        x, y = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        if not len(x) or not len(y):
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        la, lb, roots = traverse(unit[x], unit[y], n[x], n[y], cosine, same)
        every = x if same else np.concatenate([x, y])
        links = la if same else np.concatenate([la, lb])
        keep = links > 0
        return pa.table({"rep": rep[every][keep], "links": links[keep], "root": rep[every][roots[keep]]})

    return _dealt(points, cosine, max_nodes, block).groupBy("p", "q").applyInArrow(meet, "rep long, links long, root long")
