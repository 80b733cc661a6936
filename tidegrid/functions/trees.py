"""Histogram regression trees in numpy: the arithmetic inside a task of the boosted models.

Inputs are replaced by bin numbers; a node's histogram holds the gradient sums and row counts of each
(input, bin). A tree is a heap of ``2 ** (depth + 1) - 1`` nodes: input (-1: leaf), last bin that goes
left, leaf value and gain. The loss is half the squared error, so the gradient is
prediction - value and a row's weight is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAME = 1e-9  # Relative difference of gains that counts as a tie.


@dataclass(frozen=True)
class Boosting:
    """The published settings of the boosted model.

    ``gamma`` and ``l2`` are a loss sum and a penalty on leaves, ``start`` the prediction before the first
    tree. Columns are drawn for each tree (``tree_share``), and of those for each level (``column_share``)."""
    rounds: int = 120
    rate: float = 0.1
    depth: int = 5
    row_share: float = 0.9
    tree_share: float = 0.9
    column_share: float = 0.9
    min_rows: int = 2
    gamma: float = 0.6
    l2: float = 0.1
    start: float = 0.5
    patience: int = 10
    use_best_round: bool = True
    seed: int = 42
    bins: int = 64

    @property
    def nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1


def best_round(errors, patience: int) -> int:
    """Rounds to keep: the best one before ``patience`` rounds without improvement."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def settled(errors, patience: int) -> bool:
    """Whether ``patience`` rounds passed without improvement: later rounds cannot change ``best_round``."""
    return len(errors) >= best_round(errors, patience) + patience


def inner_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Distinct quantiles of a sample, without its largest value: x > edge goes to a higher bin."""
    ordered = np.sort(values)
    at = np.ceil(np.arange(1, bins) / bins * len(ordered)).astype(int) - 1
    found = np.unique(ordered[at])
    return found[found < ordered[-1]]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def drawn_rows(row_ids: np.ndarray, b: Boosting, origin: int, round_: int) -> np.ndarray:
    """The rows of a round: a hash of row, origin and round, whatever task a row is in."""
    if b.row_share >= 1:
        return np.ones(len(row_ids), bool)
    salt = np.random.SeedSequence([b.seed, origin % 2 ** 63, round_]).generate_state(1, np.uint64)[0]
    u = _mixed(_mixed(row_ids.view(np.uint64) ^ salt)) >> np.uint64(11)
    return u < np.uint64(int(b.row_share * 2 ** 53))


def drawn_columns(count: int, b: Boosting, origin: int, round_: int, level: int) -> np.ndarray:
    """The columns of a level, drawn from those of its tree."""
    own = np.random.default_rng([b.seed, origin % 2 ** 63, round_]).permutation(count)[:max(1, int(b.tree_share * count))]
    chosen = np.random.default_rng([b.seed, origin % 2 ** 63, round_, level]).permutation(own)[:max(1, int(b.column_share * len(own)))]
    out = np.zeros(count, bool)
    out[chosen] = True
    return out


def histogram(flat: np.ndarray, slot: np.ndarray, gradient: np.ndarray, slots: int, inputs: int, bins: int) -> np.ndarray:
    """(2, slots, inputs, bins): gradient sums and counts. ``flat`` holds input * bins + bin of each cell."""
    cells = (flat + (slot * (inputs * bins))[:, None]).ravel()
    size = slots * inputs * bins
    return np.stack([np.bincount(cells, np.repeat(gradient, inputs), size), np.bincount(cells, minlength=size)]).reshape(2, slots, inputs, bins)


def splits(hist: np.ndarray, b: Boosting, columns: np.ndarray):
    """(gain, input, bin, left gradient, left count) of the best split of each slot; no split has gain 0.
    Of gains that differ by rounding only, the first input and lowest bin win."""
    left = np.cumsum(hist, axis=-1)[..., :-1]
    g, n = left
    whole_g, whole_n = hist.sum(axis=-1)[..., None]
    rest_g, rest_n = whole_g - g, whole_n - n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (g * g / (n + b.l2) + rest_g * rest_g / (rest_n + b.l2) - whole_g * whole_g / (whole_n + b.l2))
    gain[~((n >= b.min_rows) & (rest_n >= b.min_rows)) | ~columns[None, :, None]] = -np.inf
    slots, inputs, cuts = gain.shape
    flat = gain.reshape(slots, -1)
    top = flat.max(axis=1)
    best = (flat >= (top - SAME * np.abs(top))[:, None]).argmax(axis=1)
    at = np.arange(slots), best // cuts, best % cuts
    value = gain[at]
    return np.where(value > b.gamma, value, 0.0), at[1], at[2], g[at], n[at]


def empty_tree(b: Boosting) -> tuple[np.ndarray, ...]:
    return np.full(b.nodes, -1, np.int32), np.zeros(b.nodes, np.int32), np.zeros(b.nodes), np.zeros(b.nodes)


def grow(codes: np.ndarray, flat: np.ndarray, gradient: np.ndarray, drawn: np.ndarray, b: Boosting, origin: int, round_: int):
    """A tree on the drawn rows, and the leaf of every row. Of two siblings only the smaller is counted;
    the other is their parent's histogram less that one."""
    inputs = codes.shape[1]
    feature, cut, leaf, gain = empty_tree(b)
    at = np.zeros(len(codes), np.int32)
    sums, counts = np.zeros(b.nodes), np.zeros(b.nodes)
    sums[0], counts[0] = gradient[drawn].sum(), drawn.sum()
    here = np.array([0])
    hist = histogram(flat[drawn], np.zeros(int(drawn.sum()), np.int64), gradient[drawn], 1, inputs, b.bins)
    for level in range(b.depth):
        value, which, bin_, left_g, left_n = splits(hist, b, drawn_columns(inputs, b, origin, round_, level))
        good = value > 0
        parents = here[good]
        if not len(parents):
            break
        feature[parents], cut[parents], gain[parents] = which[good], bin_[good], value[good]
        sums[2 * parents + 1], counts[2 * parents + 1] = left_g[good], left_n[good]
        sums[2 * parents + 2], counts[2 * parents + 2] = sums[parents] - left_g[good], counts[parents] - left_n[good]
        rows = np.flatnonzero(feature[at] >= 0)
        node = at[rows]
        at[rows] = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
        if level + 1 == b.depth:
            break
        small = np.where(counts[2 * parents + 1] <= counts[2 * parents + 2], 2 * parents + 1, 2 * parents + 2)
        slot = np.full(b.nodes, -1)
        slot[small] = np.arange(len(small))
        rows = np.flatnonzero((slot[at] >= 0) & drawn)
        own = histogram(flat[rows], slot[at[rows]], gradient[rows], len(small), inputs, b.bins)
        other = hist[:, good] - own
        first = (small % 2 == 1)[None, :, None, None]
        hist = np.stack([np.where(first, own, other), np.where(first, other, own)], axis=2).reshape(2, -1, inputs, b.bins)
        here = np.stack([2 * parents + 1, 2 * parents + 2], axis=1).ravel()
    ends = np.flatnonzero(feature < 0)
    leaf[ends] = -b.rate * sums[ends] / (counts[ends] + max(b.l2, 1e-12))
    return (feature, cut, leaf, gain), at


def walk(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int) -> np.ndarray:
    """The leaf value of each row of bins (or of values, with edges in place of bins)."""
    at, rows = np.zeros(len(codes), np.int32), np.arange(len(codes))
    for _ in range(depth):
        inner = feature[at] >= 0
        at = np.where(inner, 2 * at + 1 + (codes[rows, np.maximum(feature[at], 0)] > cut[at]), at)
    return leaf[at]


def edges_of(tree_feature: np.ndarray, cut: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The value of each node's last bin that goes left."""
    return np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(tree_feature.tolist(), cut.tolist())])


def fit(x: np.ndarray, y: np.ndarray, valid: np.ndarray, row_ids: np.ndarray, b: Boosting, origin: int, all_rounds: bool = False):
    """(kept rounds, errors, feature, edge, leaf, gain) of one model; the last four hold all rounds made, tree by tree.

    ``valid`` rows measure the error of each round; fitting ends where the early stop is settled."""
    edges = [inner_edges(x[~valid, i], b.bins) for i in range(x.shape[1])]
    codes = binned(x, edges)
    train, test = codes[~valid], codes[valid]
    flat = train.astype(np.int64) + np.arange(x.shape[1]) * b.bins
    target, ids = y[~valid], row_ids[~valid]
    fitted, held = np.full(len(train), b.start), np.full(len(test), b.start)
    errors, made = [], []
    for round_ in range(b.rounds):
        tree, at = grow(train, flat, fitted - target, drawn_rows(ids, b, origin, round_), b, origin, round_)
        fitted += tree[2][at]
        made.append((tree[0], edges_of(tree[0], tree[1], edges), tree[2], tree[3]))
        if len(test):
            held += walk(test, *tree[:3], b.depth)
            errors.append(float(np.sqrt(np.mean((held - y[valid]) ** 2))))
            if b.use_best_round and not all_rounds and settled(errors, b.patience):
                break
    kept = best_round(errors, b.patience) if errors and b.use_best_round else len(made)
    return kept, errors, *(np.concatenate(parts) for parts in zip(*made))


def predict(x: np.ndarray, kept: int, feature, edge, leaf, b: Boosting) -> np.ndarray:
    """Predictions from the first ``kept`` trees."""
    out = np.full(len(x), b.start)
    for i in range(0, kept * b.nodes, b.nodes):
        out += walk(x, feature[i:i + b.nodes], edge[i:i + b.nodes], leaf[i:i + b.nodes], b.depth)
    return out
