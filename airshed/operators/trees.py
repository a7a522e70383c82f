"""Histogram trees: boosting and forests with a learned direction for NULLs.

Features are cut into at most 255 quantile bins; NULL has a bin of its own.  Trees grow level
by level: the sums of each (node, feature, bin) decide every split of a level, trying NULLs on
either side.  ``grow`` doesn't care where the sums come from:

* a city's rows are bounded by the calendar, so all cities are fitted in one job, each in one
  task, from sums over its arrays (``fit_groups``);
* for models of all rows (``boost_distributed``), tasks sum over their rows for all such models
  at once, the sums meet in one task for each model (nodes x features x bins numbers), and only the
  best splits reach the driver.  Rows stay where they are; their running predictions are kept from
  round to round and written every few rounds.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airshed.session import checkpoint_dir

NULL = 255
BOOST = {"rounds": 200, "depth": 5, "leaves": 31, "least": 20, "rate": 0.1, "bins": 255}
FOREST = {"trees": 100, "depth": 15, "least": 1, "bins": 64, "seed": 42}
#: Rounds of distributed boosting between two writes of the running predictions.
WRITTEN = 25
#: Rows of a task of distributed boosting.
TASK_ROWS = 20_000
#: Values (rows x features x trees) of the trees of a forest that grow together.
HELD_CELLS = 2_000_000


@dataclass
class Tree:
    """Nodes in order of their making; feature -1 marks a leaf.  A row goes left if its bin is at most ``at``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    null_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    levels: int = 0

    def split(self, node: int, feature: int, at: int, null_left: bool, gain: float) -> tuple[int, int]:
        child = len(self.feature)
        self.feature[node], self.at[node], self.null_left[node], self.left[node], self.gain[node] = feature, at, null_left, child, gain
        for _ in range(2):
            for column, start in ((self.feature, -1), (self.at, 0), (self.null_left, False), (self.left, 0), (self.value, 0.0), (self.gain, 0.0)):
                column.append(start)
        return child, child + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, at, null_left, left = (np.asarray(c) for c in (self.feature, self.at, self.null_left, self.left))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.levels):
            f = feature[node]
            b = bins[rows, np.maximum(f, 0)]
            go_left = np.where(b == NULL, null_left[node], b <= at[node])
            node = np.where(f >= 0, left[node] + ~go_left, node)
        return node

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaf_of(bins)]


def best_splits(total: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gain, feature, bin and side of NULLs of each node's best split, from its sums by (node, feature, bin); the last bin holds the NULLs.

    The gain is the fall of the squared error; of equal ones, the first feature, lowest bin and NULLs right win."""
    bins = total.shape[-1] - 1
    s, n = total[..., :bins].cumsum(-1), count[..., :bins].cumsum(-1)
    null_s, null_n = total[..., bins:], count[..., bins:]
    all_s, all_n = s[..., -1:] + null_s, n[..., -1:] + null_n
    base = all_s[:, 0, 0] ** 2 / np.maximum(all_n[:, 0, 0], 1)
    gains = []
    sides = (False, True) if null_n.any() else (False,)
    for null_left in sides:
        ls, ln = (s + null_s, n + null_n) if null_left else (s, n)
        rn = all_n - ln
        fits = (ln >= least) & (rn >= least)
        with np.errstate(divide="ignore", invalid="ignore"):
            gains.append(np.where(fits, ls**2 / ln + (all_s - ls) ** 2 / rn, -np.inf))
    both = np.stack(gains, -1).reshape(len(total), -1)  # (feature, bin, side)
    # sums added in another order differ in their last digits, and the first of what is equal but for them is taken
    top = both.max(1, keepdims=True)
    pick = (both >= top - 1e-11 * np.abs(top)).argmax(1)
    gain = both[np.arange(len(both)), pick] - base
    return gain, pick // (len(sides) * bins), pick // len(sides) % bins, pick % len(sides) == 1


def grow(sums: Callable[[Tree, list[int]], tuple[np.ndarray, np.ndarray]], depth: int, leaves: int | None, least: int) -> Tree:
    """A tree; ``sums(tree, nodes)`` gives the total and count by (node, feature, bin) of the rows in those nodes.  Values are means."""
    grower = Grower(depth, leaves, least)
    while grower.open:
        grower.take(*sums(grower.tree, grower.open))
    return grower.tree


class Grower:
    """A tree in growth; ``open`` lists the nodes whose sums are due."""

    def __init__(self, depth: int, leaves: int | None, least: int):
        self.tree, self.open, self.depth, self.leaves, self.least, self.n_leaves = Tree(), [0], depth, leaves, least, 1

    def take(self, total: np.ndarray, count: np.ndarray) -> None:
        all_s, all_n = total[:, 0].sum(-1), count[:, 0].sum(-1)
        for k, node in enumerate(self.open):
            self.tree.value[node] = float(all_s[k] / all_n[k]) if all_n[k] else 0.0
        if self.tree.levels == self.depth:
            self.open = []
            return
        self.choose(all_s, *best_splits(total, count, self.least))

    def choose(self, all_s, gain, feature, at, side) -> None:
        """Split the open nodes where that is best; the children are open then."""
        order = [k for k in np.argsort(-gain, kind="stable").tolist() if gain[k] > 1e-12 * max(1.0, abs(float(all_s[k])))]
        if self.leaves is not None:  # the least useful splits of the level go
            order = order[: self.leaves - self.n_leaves]
        made = []
        for k in sorted(order):
            made += self.tree.split(self.open[k], int(feature[k]), int(at[k]), bool(side[k]), float(gain[k]))
        self.n_leaves += len(order)
        self.open = made
        self.tree.levels += bool(made)


# ---------------------------------------------------------------- bins


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points of one feature: between its distinct values if they are few, else at quantiles."""
    known = np.unique(values[~np.isnan(values)])
    if len(known) <= bins:
        return (known[1:] + known[:-1]) / 2
    return np.unique(np.quantile(values[~np.isnan(values)], np.arange(1, bins) / bins))


def binned(x: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, p in enumerate(points):
        out[:, j] = np.where(np.isnan(x[:, j]), NULL, np.searchsorted(p, x[:, j], side="left"))
    return out


def array_sums(bins: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, width: int = NULL) -> Callable:
    """Sums over rows held in arrays, for ``width`` bins and the NULLs."""
    n, n_f = bins.shape
    w = np.ones(n) if weight is None else weight
    column = np.minimum(bins, width) + np.arange(n_f) * (width + 1)

    def sums(tree: Tree, nodes: list[int]):
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        at = place[tree.leaf_of(bins)]
        here = np.flatnonzero((at >= 0) & (w > 0))
        cell = (at[here, None] * (n_f * (width + 1)) + column[here]).ravel()
        size, shape = len(nodes) * n_f * (width + 1), (len(nodes), n_f, width + 1)
        return np.bincount(cell, np.repeat(w[here] * y[here], n_f), size).reshape(shape), np.bincount(cell, np.repeat(w[here], n_f), size).reshape(shape)

    return sums


def occupied(cell: np.ndarray, w: np.ndarray, wy: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that occur, in order, with their sums of ``w`` and ``wy``."""
    if size <= 16 * len(cell):
        there = np.flatnonzero(np.bincount(cell, minlength=size))
        return there, np.bincount(cell, w, size)[there], np.bincount(cell, wy, size)[there]
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return cell[first], np.add.reduceat(w[order], first), np.add.reduceat(wy[order], first)


def sparse_splits(slot: np.ndarray, bins: np.ndarray, w: np.ndarray, wy: np.ndarray, all_n: np.ndarray, all_s: np.ndarray, least: int):
    """``best_splits`` of the slots from their rows: only bins that occur in a slot are tried, as others split no differently."""
    n_f, slots = bins.shape[1], len(all_n)
    cell = ((slot[:, None] * n_f + np.arange(n_f)) * 256 + bins).ravel()
    is_null = bins.ravel() == NULL
    groups = slots * n_f
    null_n = np.bincount(cell[is_null] >> 8, np.repeat(w, n_f)[is_null], groups)
    null_s = np.bincount(cell[is_null] >> 8, np.repeat(wy, n_f)[is_null], groups)
    # NULLs alone on the left: an empty lowest bin where there are NULLs
    lone = np.flatnonzero(null_n) << 8
    known = ~is_null
    cell = np.r_[cell[known], lone]
    zero = np.zeros(len(lone))
    cell, n, s = occupied(cell, np.r_[np.repeat(w, n_f)[known], zero], np.r_[np.repeat(wy, n_f)[known], zero], groups << 8)
    group = cell >> 8
    of = group // n_f
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    length = np.diff(np.r_[first, len(group)])
    n, s = n.cumsum(), s.cumsum()
    n, s = n - np.repeat(np.r_[0.0, n][first], length), s - np.repeat(np.r_[0.0, s][first], length)
    gains = np.empty((len(cell), 2))
    for side in (0, 1):
        ln, ls = (n + null_n[group], s + null_s[group]) if side else (n, s)
        rn, rs = all_n[of] - ln, all_s[of] - ls
        with np.errstate(divide="ignore", invalid="ignore"):
            gains[:, side] = np.where((ln >= least) & (rn >= least), ls**2 / ln + rs**2 / rn, -np.inf)
    flat = gains.ravel()
    start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])  # every slot has rows, so all slots occur, in order
    top = np.maximum.reduceat(flat, start * 2)
    fits = np.flatnonzero(flat >= np.repeat(top - 1e-11 * np.abs(top), np.diff(np.r_[start, len(of)]) * 2))
    pick = fits[np.searchsorted(fits, start * 2)]
    gain = flat[pick] - all_s**2 / np.maximum(all_n, 1)
    return gain, group[pick // 2] % n_f, cell[pick // 2] & 255, pick % 2 == 1


def grow_rows(
    bins: np.ndarray, y: np.ndarray, weights: list[np.ndarray | None], depth: int, leaves: int | None, least: int, some: Callable[[np.ndarray], np.ndarray] | None = None, root: int = 1
) -> list[Tree]:
    """The trees that ``grow`` makes of ``array_sums`` for each of the weights, grown together: rows keep their
    node from level to level, and the work of a level is that of the rows that are still in it.

    ``some`` gives the features (slots x features tried) of nodes by their paths: ``root``, and 2 p and 2 p + 1 below p."""
    trees, n_leaves = [Tree() for _ in weights], [1] * len(weights)
    rows = [np.arange(len(y)) if w is None else np.flatnonzero(w > 0) for w in weights]
    slot = np.repeat(np.arange(len(weights)), [len(r) for r in rows])
    w = np.concatenate([np.ones(len(r)) if x is None else x[r] for x, r in zip(weights, rows, strict=True)])
    row = np.concatenate(rows)
    nodes = [(k, 0) for k in range(len(weights))]  # tree and node of each slot
    path = np.full(len(weights), root, np.int64)
    for level in range(depth + 1):
        if not len(row):
            break
        wy = w * y[row]
        all_n, all_s = np.bincount(slot, w, len(nodes)), np.bincount(slot, wy, len(nodes))
        for (t, node), value in zip(nodes, (all_s / np.maximum(all_n, 1e-300)).tolist(), strict=True):
            trees[t].value[node] = value
        if level == depth:
            break
        tried = None if some is None else some(path)
        b = bins[row].astype(np.int64) if tried is None else bins[row[:, None], tried[slot]].astype(np.int64)
        gain, feature, at, side = sparse_splits(slot, b, w, wy, all_n, all_s, least)
        good = gain > 1e-12 * np.maximum(1.0, np.abs(all_s))
        if leaves is not None:  # the least useful splits of a tree's level go
            for k in np.argsort(-gain, kind="stable").tolist():
                if good[k]:
                    t = nodes[k][0]
                    good[k] = n_leaves[t] < leaves
                    n_leaves[t] += bool(good[k])
        place, made = np.cumsum(good) - 1, []
        real = feature if tried is None else tried[np.arange(len(nodes)), feature]
        for k in np.flatnonzero(good).tolist():
            t, node = nodes[k]
            made += [(t, child) for child in trees[t].split(node, int(real[k]), int(at[k]), bool(side[k]), float(gain[k]))]
        path = (path[good][:, None] * 2 + np.arange(2)).ravel()
        for t in {t for t, _ in made}:
            trees[t].levels += 1
        here = good[slot]
        row, w, slot, b = row[here], w[here], slot[here], b[here]
        own = b[np.arange(len(row)), feature[slot]]
        left = np.where(own == NULL, side[slot], own <= at[slot])
        slot, nodes = place[slot] * 2 + ~left, made
    return trees


def width_of(points: list[np.ndarray]) -> int:
    return max([len(p) for p in points], default=0) + 1


# ---------------------------------------------------------------- models


@dataclass
class Model:
    points: list[np.ndarray]
    start: float
    rate: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.points)
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self.rate * tree.predict(b)
        return out

    def importance(self, n_f: int) -> np.ndarray:
        """Share of all gains by feature."""
        out = np.zeros(n_f)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    out[f] += g
        return out / out.sum() if out.sum() else out


def to_json(model: Model) -> str:
    trees = [[t.feature, t.at, [int(b) for b in t.null_left], t.left, t.value, t.gain, t.levels] for t in model.trees]
    return json.dumps({"points": [p.tolist() for p in model.points], "start": model.start, "rate": model.rate, "trees": trees})


def from_json(text: str) -> Model:
    m = json.loads(text)
    trees = [Tree(f, at, [bool(b) for b in side], left, value, gain, levels) for f, at, side, left, value, gain, levels in m["trees"]]
    return Model([np.array(p, float) for p in m["points"]], m["start"], m["rate"], trees)


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, leaves: int, least: int, rate: float, bins: int) -> Model:
    points = [cuts(c, bins) for c in x.T]
    b = binned(x, points)
    model = Model(points, float(y.mean()), rate, [])
    f = np.full(len(y), model.start)
    for _ in range(rounds):
        tree = grow_rows(b, y - f, [None], depth, leaves, least)[0]
        f += rate * tree.predict(b)
        model.trees.append(tree)
    return model


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, least: int, bins: int, seed: int) -> Model:
    """Trees on bootstrap samples, averaged; every split looks at all features."""
    points = [cuts(c, bins) for c in x.T]
    b = binned(x, points)
    rng = np.random.default_rng(seed)
    weights = [np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float) for _ in range(trees)]
    held = max(1, HELD_CELLS // max(1, b.size))
    made = [t for k in range(0, trees, held) for t in grow_rows(b, y, weights[k : k + held], depth, None, least)]
    return Model(points, 0.0, 1.0 / trees, made)


FITS = {"RandomForest": (forest, FOREST), "GradientBoosting": (boost, BOOST)}


def fit_groups(df: DataFrame, group: str, keys: list[str], x: list[str], y: list[str], algorithms, settings: dict | None = None) -> DataFrame:
    """group, keys, algorithm, target, prediction of the rows whose split isn't train, by models of each group's train rows.

    All groups are fitted by one job; a group's rows (bounded: a city's days) meet in one task."""
    kept = [group, *keys, "split"]
    goals = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("goal")) for c in y])).alias("_t")
    rows = df.select(*kept, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)], goals).select("*", F.col("_t.target").alias("_target"), F.col("_t.goal").alias("_goal")).drop("_t")
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + ["algorithm string", "target string", "prediction double"])
    settings = settings or {}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        train, goal = (frame["split"] == "train").to_numpy(), frame["_goal"].to_numpy(float)
        v = frame[[f"_x{i}" for i in range(len(x))]].to_numpy(float)
        use, out = train & ~np.isnan(goal), []
        for name in algorithms if use.any() else ():
            make, default = FITS[name]
            model = make(v[use], goal[use], **{**default, **settings.get(name, {})})
            out.append(frame.loc[~train, kept].assign(algorithm=name, target=frame["_target"].iloc[0], prediction=model.predict(v[~train])))
        return pd.concat(out) if out else frame.loc[[], kept].assign(algorithm="", target="", prediction=0.0)

    return rows.groupBy(group, "_target").applyInPandas(run, schema)


# ---------------------------------------------------------------- boosting over distributed rows


def column_cuts(df: DataFrame, x: list[str], bins: int) -> list[np.ndarray]:
    """Cut points of every feature from mergeable quantile sketches (one row, at most ``bins`` numbers a feature)."""
    probs = [i / bins for i in range(1, bins)]
    one = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"_c{i}") for i, c in enumerate(x)]).first()
    return [np.unique(np.array(one[i] or [], float)) for i in range(len(x))]


def boost_distributed(df: DataFrame, fits: dict[str, tuple[list[str], str]], rounds: int, depth: int, leaves: int, least: int, rate: float, bins: int) -> dict[str, Model]:
    """Models of all rows by name: ``fits`` gives each one's features and target (rows without the target are not its).

    All models grow in step, so a level of all of them costs one job."""
    spark = df.sparkSession
    names = list(fits)
    x = sorted({c for cols, _ in fits.values() for c in cols})
    points = dict(zip(x, column_cuts(df, x, bins), strict=True))
    at = [[x.index(c) for c in fits[name][0]] for name in names]
    mean = df.agg(*[F.avg(F.col(fits[name][1]).cast("double")) for name in names]).first()
    start = [float(m or 0.0) for m in mean]
    cut = [points[c] for c in x]

    def prepare(batches):
        for b in batches:
            v = np.column_stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(x))]) if b.num_rows else np.zeros((0, len(x)))
            q = binned(v, cut)
            goal = [b.column(f"_y{t}").to_numpy(zero_copy_only=False).astype(float) - start[t] for t in range(len(names))]
            rest = np.column_stack(goal).reshape(b.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in q], pa.binary()), pa.array([r.tobytes() for r in rest], pa.binary())], names=["q", "rest"])

    def arrays(b):
        q = np.frombuffer(b"".join(b.column("q").to_pylist()), np.uint8).reshape(b.num_rows, len(x))
        return q, np.frombuffer(b"".join(b.column("rest").to_pylist()), float).reshape(b.num_rows, len(names)).copy()

    checkpoint_dir(spark)
    source = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)], *[F.col(fits[n][1]).cast("double").alias(f"_y{t}") for t, n in enumerate(names)])
    rows = source.mapInArrow(prepare, "q binary, rest binary").checkpoint()
    # a level is a job, so rows lie in as few tasks as their number asks for
    rows = rows.coalesce(max(1, -(-rows.count() // TASK_ROWS)))
    models = [Model([points[c] for c in fits[n][0]], start[t], rate, []) for t, n in enumerate(names)]
    kept = None
    for k in range(rounds):
        growing = [Grower(depth, leaves, least) for _ in names]
        while any(g.open for g in growing):
            step = [(g.tree, g.open) for g in growing]

            def level(batches, step=step):
                cells: dict[int, list] = {}
                for b in batches:
                    if not b.num_rows:
                        continue
                    q, rest = arrays(b)
                    for t, (tree, nodes) in enumerate(step):
                        there = ~np.isnan(rest[:, t])
                        if nodes and there.any():
                            got = array_sums(q[there][:, at[t]], rest[there, t])(tree, nodes)
                            cells[t] = [a + c for a, c in zip(cells[t], got, strict=True)] if t in cells else list(got)
                for t, (total, count) in cells.items():
                    cell = np.flatnonzero(count)
                    packed = [pa.array([v.tobytes()], pa.binary()) for v in (cell, total.ravel()[cell], count.ravel()[cell])]
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *packed], names=["t", "cell", "total", "n"])

            def best(frame: pd.DataFrame) -> pd.DataFrame:
                """A model's best splits: of at most nodes x features x bins sums, however many rows there are."""
                t = int(frame["t"].iloc[0])
                shape = (len(step[t][1]), len(at[t]), NULL + 1)
                total, count = np.zeros(shape), np.zeros(shape)
                for cell, s, n in zip(frame["cell"], frame["total"], frame["n"], strict=True):
                    where = np.frombuffer(cell, np.int64)
                    total.ravel()[where] += np.frombuffer(s, float)
                    count.ravel()[where] += np.frombuffer(n, float)
                gain, feature, cut, side = best_splits(total, count, least)
                nodes = np.arange(shape[0])
                left = (np.arange(NULL + 1) <= cut[:, None]) & (np.arange(NULL + 1) < NULL)
                left[:, NULL] = side
                out = {"t": t, "node": nodes, "s": total[:, 0].sum(-1), "n": count[:, 0].sum(-1), "gain": gain, "feature": feature, "at": cut, "side": side,
                       "left_s": (total[nodes, feature] * left).sum(-1), "left_n": (count[nodes, feature] * left).sum(-1)}
                return pd.DataFrame(out)

            sums = rows.mapInArrow(level, "t int, cell binary, total binary, n binary").repartition(len(names), "t")
            found = sums.groupBy("t").applyInPandas(best, "t int, node int, s double, n double, gain double, feature int, at int, side boolean, left_s double, left_n double").toPandas()
            for t, g in enumerate(growing):
                own = found[found["t"] == t].sort_values("node")
                if not g.open or own.empty:  # a model without rows
                    g.open = []
                    continue
                s, n, left_s, left_n = (own[c].to_numpy() for c in ("s", "n", "left_s", "left_n"))
                parents = list(g.open)
                for node, value in zip(parents, s / n, strict=True):
                    g.tree.value[node] = float(value)
                g.choose(s, *(own[c].to_numpy() for c in ("gain", "feature", "at", "side")))
                if g.tree.levels == depth:  # the leaves' values follow from their parents' splits
                    for i, node in enumerate(parents):
                        if g.tree.feature[node] >= 0:
                            child = g.tree.left[node]
                            g.tree.value[child] = float(left_s[i] / left_n[i])
                            g.tree.value[child + 1] = float((s[i] - left_s[i]) / (n[i] - left_n[i]))
                    g.open = []
        for t, g in enumerate(growing):
            models[t].trees.append(g.tree)
        if k + 1 == rounds:
            break
        made = [g.tree for g in growing]

        def write(batches, made=made):
            for b in batches:
                if b.num_rows:
                    q, rest = arrays(b)
                    for t, tree in enumerate(made):
                        rest[:, t] -= rate * tree.predict(q[:, at[t]])
                    yield pa.RecordBatch.from_arrays([b.column("q"), pa.array([r.tobytes() for r in rest], pa.binary())], names=["q", "rest"])

        rows = rows.mapInArrow(write, "q binary, rest binary")
        if (k + 1) % WRITTEN == 0:
            rows = rows.checkpoint()
        else:
            rows = rows.persist()
            rows.count()
        if kept is not None:
            kept.unpersist()
        kept = rows if (k + 1) % WRITTEN else None
    if kept is not None:
        kept.unpersist()
    return dict(zip(names, models, strict=True))


def predict_with(df: DataFrame, model: Model, x: list[str]) -> DataFrame:
    """``df`` with the model's prediction; all other columns unchanged."""
    fields = df.schema
    rows = df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in x]))

    def run(batches):
        for b in batches:
            v = np.array([[np.nan if e is None else e for e in r] for r in b.column("_x").to_pylist()], float).reshape(b.num_rows, len(x))
            keep = [b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(model.predict(v))], names=[*[f.name for f in fields], "prediction"])

    return rows.mapInArrow(run, df.withColumn("prediction", F.lit(0.0)).schema)
