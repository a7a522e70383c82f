"""Linear models from cross-products.

``grams`` makes one pass: every task adds up the cross-products of its rows for each group, and
the tasks' sums are added by group.  A group's sums are then enough for any linear model of it:
ridge for all targets with one factorisation, lasso and elastic net by coordinate descent,
models of a part of the features (an ablation ladder), and, added up over periods, the model of
every origin of a rolling validation.  Rows never move; only k^2 numbers of each group do.

Targets may be missing in different rows: sums are kept for each pattern of present targets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHA, L1_RATIO = 1.0, 0.5
#: Coordinate descent ends when no coefficient moves by more than this share of the largest.
TOLERANCE, ROUNDS = 1e-10, 100_000
#: Bytes of sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20

LINEAR = {"Ridge": None, "Lasso": 1.0, "ElasticNet": L1_RATIO}


def grams(df: DataFrame, groups: list[str], x: list[str], y: list[str]) -> DataFrame:
    """groups, pattern (bit t: target t is present), centre, gram of each group: the upper triangle of the
    cross-products of (1, x - centre, y - centre).  Rows with a missing feature or group are left out."""
    cols = [*x, *y]
    rows = df.select(*groups, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    rows = rows.where(" AND ".join([f"`{g}` IS NOT NULL" for g in groups] + [f"_v{i} IS NOT NULL" for i in range(len(x))] or ["true"]))
    # a level common to all rows is taken out first, so that squares cost no digits
    middle = rows.agg(*[F.avg(f"_v{i}").alias(f"_v{i}") for i in range(len(cols))]).first()
    centre = np.array([middle[i] or 0.0 for i in range(len(cols))])
    size, n_x = len(cols) + 1, len(x)
    upper = np.triu_indices(size)
    kinds = [rows.schema[g].dataType.simpleString() for g in groups]
    schema = ", ".join([f"`{g}` {k}" for g, k in zip(groups, kinds, strict=True)] + ["pattern int", "gram array<double>"])

    def handed(held):
        if held:
            keys = pd.DataFrame(list(held), columns=[*groups, "pattern"])
            columns = [pa.array(keys[c].tolist(), pa_types[i]) for i, c in enumerate([*groups, "pattern"])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m[upper].tolist() for m in held.values()], pa.list_(pa.float64()))], names=[*groups, "pattern", "gram"])

    pa_types = [_arrow(k) for k in kinds] + [pa.int32()]

    def run(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.column_stack([batch.column(f"_v{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(cols))]) - centre
            there = ~np.isnan(v[:, n_x:])
            z = np.column_stack([np.ones(len(v)), np.nan_to_num(v)])
            pattern = there @ (1 << np.arange(len(y)))
            keys = pd.DataFrame({g: batch.column(g).to_pylist() for g in groups} | {"pattern": pattern})
            for key, at in keys.groupby([*groups, "pattern"], sort=False).indices.items():
                part = z[at]
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0.0) + part.T @ part
            if len(held) * size * size * 8 > HELD_BYTES:
                yield from handed(held)
                held = {}
        yield from handed(held)

    parts = rows.mapInArrow(run, schema).select(*groups, "pattern", F.posexplode("gram").alias("_at", "_s"))
    sums = parts.groupBy(*groups, "pattern", "_at").agg(F.sum("_s").alias("_s"))
    whole = sums.groupBy(*groups, "pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda e: e["_s"]).alias("gram"))
    return whole.withColumn("centre", F.array(*[F.lit(float(c)) for c in centre]))


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]


class Sums:
    """The sums of one group, ready to be solved; they add up over groups."""

    def __init__(self, frame: pd.DataFrame, n_x: int, n_y: int):
        size = 1 + n_x + n_y
        upper = np.triu_indices(size)
        self.n_x, self.n_y, self.centre, self.of = n_x, n_y, np.zeros(n_x + n_y), {}
        for pattern, centre, gram in zip(frame["pattern"], frame["centre"], frame["gram"], strict=True):
            m = np.zeros((size, size))
            m[upper] = gram
            self.centre = np.asarray(centre, float)
            self.of[int(pattern)] = self.of.get(int(pattern), 0.0) + m + np.triu(m, 1).T

    def add(self, other: Sums) -> None:
        self.centre = other.centre
        for pattern, m in other.of.items():
            self.of[pattern] = self.of.get(pattern, 0.0) + m

    def target(self, t: int):
        """n, means of x and y, centred cross-products of x, of x and y, and of y over the rows that have target t."""
        m = sum((g for pattern, g in self.of.items() if pattern >> t & 1), np.zeros((1 + self.n_x + self.n_y,) * 2))
        n, s = m[0, 0], m[0]
        if not n:
            return 0, None, None, None, None, None
        c = m - np.outer(s, s) / n
        x, y = slice(1, 1 + self.n_x), 1 + self.n_x + t
        return int(n), s[x] / n + self.centre[: self.n_x], s[y] / n + self.centre[self.n_x + t], c[x, x], c[x, y], c[y, y]

    def patterns(self, t: int) -> frozenset:
        return frozenset(p for p in self.of if p >> t & 1)


def coordinate_descent(xx: np.ndarray, xy: np.ndarray, n: int, alpha: float = ALPHA, l1_ratio: float = 1.0) -> np.ndarray:
    """argmin |y - Xw|^2 / 2n + alpha * l1_ratio * |w|_1 + alpha * (1 - l1_ratio) / 2 * |w|^2, from the cross-products alone."""
    q, g = xx / n, xy / n
    w, at = np.zeros(len(g)), np.zeros(len(g))  # at = q @ w
    curve, l1 = np.diag(q) + alpha * (1 - l1_ratio), alpha * l1_ratio
    for _ in range(ROUNDS):
        most = 0.0
        for j in range(len(w)):
            if curve[j] <= 0:
                continue
            r = g[j] - at[j] + q[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / curve[j]
            if new != w[j]:
                at += q[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most <= TOLERANCE * max(1e-300, np.abs(w).max()):
            break
    return w


def solve(sums: Sums, algorithms=LINEAR, alpha: float = ALPHA, columns: list[int] | None = None) -> list[tuple]:
    """(algorithm, target number, n, intercept, coefficients) of every algorithm and target; with ``columns``, of those features alone."""
    out = []
    use = np.arange(sums.n_x) if columns is None else np.asarray(columns)
    alike: dict = {}
    for t in range(sums.n_y):
        alike.setdefault(sums.patterns(t), []).append(t)
    for targets in alike.values():
        at = {t: sums.target(t) for t in targets}
        if not at[targets[0]][0]:
            continue
        n, _, _, xx, _, _ = at[targets[0]]
        xx = xx[np.ix_(use, use)]
        xy = np.column_stack([at[t][4][use] for t in targets])
        for name in algorithms:
            l1 = LINEAR[name]
            # targets that the same rows have are solved with one factorisation
            w = np.linalg.solve(xx + alpha * np.eye(len(use)), xy) if l1 is None else np.column_stack([coordinate_descent(xx, c, n, alpha, l1) for c in xy.T])
            for k, t in enumerate(targets):
                coefficients = np.zeros(sums.n_x)
                coefficients[use] = w[:, k]
                out.append((name, t, n, float(at[t][2] - at[t][1][use] @ w[:, k]), coefficients.tolist()))
    return out


def fit(df: DataFrame, group: str, x: list[str], y: list[str], algorithms=tuple(LINEAR), alpha: float = ALPHA) -> DataFrame:
    """group, algorithm, target, n, intercept, coefficients: all linear models of all groups from one aggregate."""
    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, algorithm string, target string, n long, intercept double, coefficients array<double>"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        made = solve(Sums(frame, len(x), len(y)), algorithms, alpha)
        return pd.DataFrame([(frame[group].iloc[0], a, y[t], n, b, w) for a, t, n, b, w in made], columns=[group, "algorithm", "target", "n", "intercept", "coefficients"])

    return grams(df, [group], x, y).groupBy(group).applyInPandas(run, schema)


def rungs(df: DataFrame, x: list[str], y: str, ladder: list[tuple[str, list[str]]], alpha: float = ALPHA) -> DataFrame:
    """rung, label, n, intercept, coefficients (over all of x): a ridge for each set of features of the ladder, all from one Gram matrix."""
    one = df.withColumn("_all", F.lit(0))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sums = Sums(frame, len(x), 1)
        made = [(k, label, *solve(sums, ["Ridge"], alpha, [x.index(c) for c in cols])[0][2:]) for k, (label, cols) in enumerate(ladder)]
        return pd.DataFrame(made, columns=["rung", "label", "n", "intercept", "coefficients"])

    return grams(one, ["_all"], x, [y]).groupBy("_all").applyInPandas(run, "rung int, label string, n long, intercept double, coefficients array<double>")


def rolling(df: DataFrame, period: str, x: list[str], y: str, alpha: float = ALPHA) -> DataFrame:
    """period, n_train, intercept, coefficients: for every period after the first, the ridge of all rows before it.

    One pass gives each period's sums; running sums of them, one row for each period of the calendar, give all origins."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total, out = None, []
        for p, part in frame.sort_values(period).groupby(period, sort=True):
            if total is not None:
                out += [(int(p), n, b, w) for _, _, n, b, w in solve(total, ["Ridge"], alpha)]
            sums = Sums(part, len(x), 1)
            if total is None:
                total = sums
            else:
                total.add(sums)
        return pd.DataFrame(out, columns=["period", "n_train", "intercept", "coefficients"])

    sums = grams(df, [period], x, [y]).withColumn("_all", F.lit(0))
    return sums.groupBy("_all").applyInPandas(run, "period int, n_train long, intercept double, coefficients array<double>")


def predict(df: DataFrame, x: list[str]) -> DataFrame:
    """``df`` (with intercept and coefficients) and prediction in their place."""
    dot = F.aggregate(F.zip_with(F.array(*[F.col(c).cast("double") for c in x]), F.col("coefficients"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("prediction", F.col("intercept") + dot).drop("intercept", "coefficients")


def impute_by(df: DataFrame, cols: list[str], group: str | None, fitted_on: DataFrame) -> DataFrame:
    """NULLs of ``cols`` as the medians of ``fitted_on`` (0 where it has none), of each group or of all rows.

    A group's median is taken in one buffer, so groups must be bounded (a city's days are, by the calendar);
    the medians of all rows come from range buckets."""
    if group is None:
        from airshed.operators.features import impute

        filled = impute(df, cols, "median", stats_from=fitted_on)
        return filled.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in filled.columns])
    medians = fitted_on.groupBy(group).agg(F.array(*[F.coalesce(F.percentile(c, 0.5), F.lit(0.0)) for c in cols]).alias("_medians"))
    place = {c: i for i, c in enumerate(cols)}
    return df.join(medians, group).select(*[F.coalesce(F.col(c), F.col("_medians")[place[c]]).alias(c) if c in place else F.col(c) for c in df.columns])
