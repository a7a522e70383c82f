"""A random forest of all rows, grown and applied where the rows are.

Every tree has a bootstrap of its own: a row's weight in it is a Poisson(1) number drawn from the
hash of the row's key, and the features that a node tries are drawn from its tree and its path, so
neither depends on the rows' layout.  A node of more than ``HELD_ROWS`` rows is split from sums that
tasks make over their own rows and that meet by node; a smaller one's rows meet in one task, which
grows all that is below it.  The parts of trees stay a table: rows to be predicted are sent to the
part that they reach, so the driver holds only the splits of the large nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airshed.llm.common import mix
from airshed.operators import trees as T
from airshed.session import checkpoint_dir

#: As Spark's: 32 bins, a third of the features for each node.
FOREST = {"trees": 100, "depth": 15, "least": 1, "bins": 32, "seed": 42}
#: Rows of a node that are held by one task.
HELD_ROWS = 20_000
#: Rows of a task.
TASK_ROWS = 5_000
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1, 20)]))


def bootstrap(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """The rows' Poisson(1) weights in a tree."""
    with np.errstate(over="ignore"):
        h = mix(key.astype(np.uint64) ^ mix(np.full(1, seed << 32 | tree + 1, np.uint64)))
    return np.searchsorted(POISSON, (h >> np.uint64(11)).astype(float) * 2.0**-53, side="right").astype(float)


def third(path: np.ndarray, tree: int, n_f: int, seed: int) -> np.ndarray:
    """The features that nodes try, in order: a third of them, at least one."""
    with np.errstate(over="ignore"):
        own = mix(path.astype(np.uint64) ^ mix(np.full(1, ~seed & 0xFFFFFFFF, np.uint64) << np.uint64(32) | np.uint64(tree + 1)))
        h = mix(own[:, None] ^ mix(np.arange(1, n_f + 1, dtype=np.uint64)))
    return np.sort(np.argsort(h, axis=1)[:, : -(-n_f // 3)], axis=1)


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * (len(names) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _by_node(node: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(node, places) of each node that occurs."""
    order = np.argsort(node, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0, True])
    return [(int(node[order[a]]), order[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)] if len(node) else []


def predictions(df: DataFrame, keys: list[str], kept: list[str], x: list[str], y: list[str], trees: int, depth: int, least: int, bins: int, seed: int) -> DataFrame:
    """kept, split, target, prediction of the rows of ``df`` whose split isn't train, by a forest of the train rows for each target.

    ``keys`` names a row for its bootstrap; rows of the same key are told apart by their values, and copies by their number.
    Features aren't NULL."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    train = F.col("split") == "train"
    points = T.column_cuts(df.where(train), x, bins)
    n_f, n_y = len(x), len(y)
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy("split", *y, *x))
    source = df.select(*kept, "split", F.xxhash64(*keys, copy).alias("_key"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x)], *[F.col(c).cast("double").alias(f"_y{k}") for k, c in enumerate(y)])
    names = [*kept, "split", "_key"]

    def prepare(batches):
        for b in batches:
            if b.num_rows:
                v = np.column_stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n_f)])
                goal = np.column_stack([b.column(f"_y{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(n_y)])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array([r.tobytes() for r in T.binned(v, points)], pa.binary()), pa.array([r.tobytes() for r in goal], pa.binary())], names=[*names, "_q", "_goal"])

    fields = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    rows = source.mapInArrow(prepare, f"{fields}, _q binary, _goal binary").withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    count = rows.groupBy(train.alias("train")).count().collect()
    n_train, n_all = sum(r["count"] for r in count if r["train"]), sum(r["count"] for r in count)
    if not n_train:
        raise RuntimeError("a forest needs train rows")
    rows = rows.coalesce(max(1, -(-n_all // TASK_ROWS)))
    known, asked = rows.where(train).select("_key", "_q", "_goal"), rows.where(~train).select("_row", "_q")

    def arrays(b):
        return np.frombuffer(b"".join(b.column("_q").to_pylist()), np.uint8).reshape(b.num_rows, n_f)

    # Tree k * trees + i is the i-th for target k.  ``at`` gives the path of each node that isn't split here: large ones are split next.
    tops = [T.Tree() for _ in range(n_y * trees)]
    at = [{0: 1} for _ in tops]
    large = {(t, 0) for t in range(len(tops))} if n_train > HELD_ROWS else set()
    settled: list[tuple[int, int]] = []

    def drawn(b):
        """tree, its rows that are drawn, their weights and nodes."""
        q, key = arrays(b), b.column("_key").to_numpy()
        goal = np.frombuffer(b"".join(b.column("_goal").to_pylist()), float).reshape(b.num_rows, n_y)
        for i in range(trees):
            w = bootstrap(key, i, seed)
            here = np.flatnonzero(w)
            for t in range(i, n_y * trees, trees):
                yield t, q[here], key[here], goal[here, t // trees], w[here], tops[t].leaf_of(q[here])

    while large:
        tried = {(t, node): third(np.array([at[t][node]]), t % trees, n_f, seed)[0] for t, node in large}
        wanted = n_f // 3 + bool(n_f % 3)

        def sums(batches, tried=tried):
            for b in batches:
                for t, q, _, goal, w, node in drawn(b) if b.num_rows else ():
                    found = []
                    for k, own in _by_node(node):
                        if (t, k) in tried:
                            cell = (np.arange(wanted) * 256 + q[own][:, tried[t, k]]).ravel()
                            each = [np.bincount(cell, np.repeat(v, wanted), wanted * 256) for v in (w[own] * goal[own], w[own], np.ones(len(own)))]
                            there = np.flatnonzero(each[2])
                            found.append((t, k, there.tobytes(), *[v[there].tobytes() for v in each]))
                    if found:
                        yield _batch(["t", "node", "cell", "s", "w", "n"], found)

        def best(frame: pd.DataFrame) -> pd.DataFrame:
            """A node's best split, from its features x bins sums."""
            s, w, n = (np.zeros(wanted * 256) for _ in range(3))
            for cell, *parts in zip(frame["cell"], frame["s"], frame["w"], frame["n"], strict=True):
                where = np.frombuffer(cell, np.int64)
                for to, part in zip((s, w, n), parts, strict=True):
                    to[where] += np.frombuffer(part, float)
            s, w, n = (v.reshape(1, wanted, 256) for v in (s, w, n))
            gain, feature, cut, _ = T.best_splits(s, w, least)
            left = [float(v[0, feature[0], : cut[0] + 1].sum()) for v in (s, w, n)]
            whole = [float(v[0, feature[0]].sum()) for v in (s, w, n)]
            return pd.DataFrame([(int(frame["t"].iloc[0]), int(frame["node"].iloc[0]), float(gain[0]), int(feature[0]), int(cut[0]), *whole, *left)], columns=["t", "node", "gain", "feature", "cut", "s", "w", "n", "ls", "lw", "ln"])

        tasks = max(4 * spark.sparkContext.defaultParallelism, -(-len(large) // 25))
        found = known.mapInArrow(sums, "t int, node int, cell binary, s binary, w binary, n binary").repartition(tasks, "t", "node").groupBy("t", "node").applyInPandas(
            best, "t int, node int, gain double, feature int, cut int, s double, w double, n double, ls double, lw double, ln double").orderBy("t", "node").collect()
        seen, large = large, set()
        for r in found:  # the large nodes' splits: at most trees x rows / HELD_ROWS of a level
            t, node, tree = r["t"], r["node"], tops[r["t"]]
            path = at[t].pop(node)
            tree.value[node] = r["s"] / r["w"]
            if not r["gain"] > 1e-12 * max(1.0, abs(r["s"])):
                settled.append((t, node))
                continue
            children = tree.split(node, int(tried[t, node][r["feature"]]), r["cut"], False, r["gain"])
            for side, (child, s, w, n) in enumerate(((children[0], r["ls"], r["lw"], r["ln"]), (children[1], r["s"] - r["ls"], r["w"] - r["lw"], r["n"] - r["ln"]))):
                tree.value[child] = s / w
                below = path * 2 + side
                tree.levels = max(tree.levels, below.bit_length() - 1)
                if below.bit_length() - 1 == depth:
                    settled.append((t, child))
                    continue
                at[t][child] = below
                if n > HELD_ROWS:
                    large.add((t, child))
        for t, node in seen - {(r["t"], r["node"]) for r in found}:  # a bootstrap without rows
            at[t].pop(node)

    def pieces(batches):
        for b in batches:
            for t, q, key, goal, w, node in drawn(b) if b.num_rows else ():
                found = [(t, k, q[own].tobytes(), key[own].tobytes(), goal[own].tobytes(), w[own].tobytes()) for k, own in _by_node(node) if k in at[t]]
                if found:
                    yield _batch(["t", "node", "q", "key", "goal", "w"], found)

    def below(frame: pd.DataFrame) -> pd.DataFrame:
        """What a node that is not large has below it: of at most HELD_ROWS rows."""
        t, node = int(frame["t"].iloc[0]), int(frame["node"].iloc[0])
        key = np.frombuffer(b"".join(frame["key"]), np.int64)
        order = np.argsort(key, kind="stable")
        q = np.frombuffer(b"".join(frame["q"]), np.uint8).reshape(-1, n_f)[order]
        goal, w = (np.frombuffer(b"".join(frame[c]), float)[order] for c in ("goal", "w"))
        path = at[t][node]
        tree = T.grow_rows(q, goal, [w], depth + 1 - path.bit_length(), None, least, lambda p: third(p, t % trees, n_f, seed), path)[0]
        made = [np.array(v, kind).tobytes() for v, kind in ((tree.feature, np.int32), (tree.at, np.int32), (tree.left, np.int32), (tree.value, float))]
        return pd.DataFrame([(t, node, *made, tree.levels)], columns=["t", "node", "feature", "cut", "left", "value", "levels"])

    parts_schema = "t int, node int, feature binary, cut binary, left binary, value binary, levels int"
    n_parts = sum(map(len, at))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-n_parts // 25))
    parts = known.mapInArrow(pieces, "t int, node int, q binary, key binary, goal binary, w binary").repartition(tasks, "t", "node").groupBy("t", "node").applyInPandas(below, parts_schema)
    if settled:  # leaves of large nodes
        lone = [(t, k, *[np.array([v], kind).tobytes() for v, kind in ((-1, np.int32), (0, np.int32), (0, np.int32), (tops[t].value[k], float))], 0) for t, k in settled]
        parts = parts.unionByName(spark.createDataFrame(lone, parts_schema))

    def questions(batches):
        for b in batches:
            if b.num_rows:
                q, row = arrays(b), b.column("_row").to_numpy()
                for t, tree in enumerate(tops):
                    yield _batch(["t", "node", "q", "row"], [(t, k, q[own].tobytes(), row[own].tobytes()) for k, own in _by_node(tree.leaf_of(q))])

    def answers(batches):
        for b in batches:
            for r in b.to_pylist():
                tree = T.Tree(*[np.frombuffer(r[c], np.int32) for c in ("feature", "cut")], np.zeros(len(r["feature"]) // 4, bool), np.frombuffer(r["left"], np.int32), np.frombuffer(r["value"], float), levels=r["levels"])
                row = np.frombuffer(r["row"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), r["t"] // trees, np.int32)), pa.array(tree.predict(np.frombuffer(r["q"], np.uint8).reshape(-1, n_f)))], names=["_row", "_k", "p"])

    met = asked.mapInArrow(questions, "t int, node int, q binary, row binary").repartition(tasks, "t", "node").join(parts.hint("shuffle_hash"), ["t", "node"])
    mean = met.mapInArrow(answers, "_row long, _k int, p double").groupBy("_row", "_k").agg((F.sum("p") / F.count("p")).alias("prediction"))
    target = F.element_at(F.array(*[F.lit(c) for c in y]), F.col("_k") + 1).alias("target")
    return rows.where(~train).select("_row", *kept, "split").join(mean, "_row").select(*kept, "split", target, "prediction")
