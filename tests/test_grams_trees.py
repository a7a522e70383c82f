"""Models from cross-products and histogram trees against plain versions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from airshed.operators import gram as G
from airshed.operators import trees as T

X = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c, n in (("a", 150), ("b", 90), ("c", 260)):
        for k in range(n):
            x = [*rng.normal(size=2), 1000 + rng.normal(), float(rng.integers(0, 3))]
            y = 2 * x[0] - x[1] * (c == "a") + 0.5 * (x[2] - 1000) + rng.normal() * 0.1
            z = x[1] + rng.normal() if k % 4 else None
            rows.append((c, k, *[float(v) for v in x], float(y), None if z is None else float(z)))
    return spark.createDataFrame(rows, "city string, k int, x0 double, x1 double, x2 double, x3 double, y double, z double").repartition(5).cache()


def _arrays(pdf, target):
    pdf = pdf[pdf[target].notna()]
    x, y = pdf[X].to_numpy(), pdf[target].to_numpy()
    return x, y, x - x.mean(0), y - y.mean()


def test_all_linear_models_of_all_groups(spark, table):
    got = {(r["city"], r["algorithm"], r["target"]): r for r in G.fit(table, "city", X, ["y", "z"], alpha=0.3).collect()}
    pdf = table.toPandas()
    assert len(got) == 3 * 3 * 2
    for (city, algorithm, target), r in got.items():
        x, y, xc, yc = _arrays(pdf[pdf.city == city], target)
        w, n = np.array(r["coefficients"]), len(y)
        assert r["n"] == n and abs(r["intercept"] - (y.mean() - x.mean(0) @ w)) < 1e-6
        if algorithm == "Ridge":
            assert np.allclose(w, np.linalg.solve(xc.T @ xc + 0.3 * np.eye(4), xc.T @ yc), atol=1e-7)
            continue
        l1 = G.LINEAR[algorithm]
        # Karush-Kuhn-Tucker: the gradient is the l1 weight's sign where w isn't 0, and within it where it is
        grad = xc.T @ (yc - xc @ w) / n - 0.3 * (1 - l1) * w
        assert np.allclose(grad[w != 0], 0.3 * l1 * np.sign(w[w != 0]), atol=1e-6)
        assert (np.abs(grad[w == 0]) <= 0.3 * l1 + 1e-6).all()
    assert any((np.array(r["coefficients"]) == 0).any() for (_, a, _), r in got.items() if a == "Lasso")


def test_lasso_equals_spark(spark, table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    one = table.where("city = 'a'")
    model = LinearRegression(featuresCol="f", labelCol="y", regParam=0.2, elasticNetParam=1.0, standardization=False, maxIter=500, tol=1e-12).fit(VectorAssembler(inputCols=X, outputCol="f").transform(one))
    got = next(r for r in G.fit(one, "city", X, ["y"], ("Lasso",), alpha=0.2).collect())
    assert np.allclose(got["coefficients"], model.coefficients.toArray(), atol=1e-5)


def test_ladder_and_rolling_origins(spark, table):
    pdf = table.toPandas()
    ladder = [("one", ["x0"]), ("two", ["x0", "x2"]), ("all", X)]
    for r in G.rungs(table, X, "y", ladder, alpha=1.0).collect():
        cols = ladder[r["rung"]][1]
        x, y = pdf[cols].to_numpy(), pdf["y"].to_numpy()
        xc = x - x.mean(0)
        w = np.linalg.solve(xc.T @ xc + np.eye(len(cols)), xc.T @ (y - y.mean()))
        assert np.allclose([r["coefficients"][X.index(c)] for c in cols], w, atol=1e-7) and np.count_nonzero(r["coefficients"]) == len(cols)
    folds = table.withColumn("period", F.floor(F.col("k") / 40).cast("int"))
    got = {r["period"]: r for r in G.rolling(folds, "period", X, "y").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for p, r in got.items():
        x, y, xc, yc = _arrays(pdf[pdf.k < 40 * p], "y")
        assert r["n_train"] == len(y)
        assert np.allclose(r["coefficients"], np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc), atol=1e-7)


def test_no_rows(spark, table):
    assert G.fit(table.limit(0), "city", X, ["y"]).collect() == []
    assert G.rolling(table.limit(0), "k", X, "y").collect() == []


# ---------------------------------------------------------------- trees


def _rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.normal(size=n)])
    x[rng.random(n) < 0.2, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 3.0, np.sin(np.nan_to_num(x[:, 0]))) + 0.7 * (x[:, 1] == 2) + 0.05 * rng.normal(size=n)
    return x, y


def plain_boost(bins, y, rounds, depth, leaves, least, rate):
    """Row lists and loops; every split is tried by itself."""
    f, start = np.full(len(y), y.mean()), y.mean()
    for _ in range(rounds):
        r, level, done, n_leaves = y - f, [np.arange(len(y))], [], 1
        for _ in range(depth):
            tried = []
            for k, rows in enumerate(level):
                best = None
                for j in range(bins.shape[1]):
                    b = bins[rows, j]
                    for at in range(255):
                        for null_left in (False, True):
                            left = np.where(b == T.NULL, null_left, b <= at)
                            a, c = rows[left], rows[~left]
                            if len(a) < least or len(c) < least:
                                continue
                            gain = r[a].sum() ** 2 / len(a) + r[c].sum() ** 2 / len(c) - r[rows].sum() ** 2 / len(rows)
                            if best is None or gain > best[0] * (1 + 1e-9) + 1e-13:
                                best = (gain, a, c)
                if best is not None and best[0] > 1e-9:
                    tried.append((best[0], k, best[1], best[2]))
            tried = sorted(tried, key=lambda t: -t[0])[: leaves - n_leaves]
            n_leaves += len(tried)
            split = {t[1] for t in tried}
            done += [rows for k, rows in enumerate(level) if k not in split]
            level = [part for t in sorted(tried, key=lambda t: t[1]) for part in (t[2], t[3])]
        for rows in done + level:
            if len(rows):
                f[rows] += rate * r[rows].mean()
    return start, f


def test_booster_equals_plain_loops():
    x, y = _rows(160)
    model = T.boost(x, y, rounds=4, depth=3, leaves=6, least=5, rate=0.3, bins=16)
    _, f = plain_boost(T.binned(x, model.points), y, 4, 3, 6, 5, 0.3)
    assert np.allclose(model.predict(x), f, atol=1e-8)
    assert abs(model.importance(3).sum() - 1) < 1e-12 and model.importance(3)[2] < 0.2


def test_nulls_find_their_side_and_error_falls():
    x, y = _rows()
    model = T.boost(x, y, **{**T.BOOST, "rounds": 60})
    assert np.mean((model.predict(x) - y) ** 2) < 0.02 * y.var()
    other, goal = _rows(seed=2)
    assert np.mean((model.predict(other) - goal) ** 2) < 0.1 * goal.var()
    assert max(sum(f < 0 for f in t.feature) for t in model.trees) <= 31
    wood = T.forest(x, y, **{**T.FOREST, "trees": 20})
    assert np.mean((wood.predict(other) - goal) ** 2) < 0.15 * goal.var()


def test_distributed_booster_equals_the_one_in_arrays(spark, monkeypatch):
    monkeypatch.setattr(T, "WRITTEN", 2)
    x, y = _rows(300)
    x[:, 0] = np.round(x[:, 0], 1)  # few distinct values, so that sketches and arrays give the same cuts
    x[:, 2] = np.round(x[:, 2], 1)
    rows = [(*[None if np.isnan(v) else float(v) for v in a], float(b), float(b) if k % 3 else None) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, z double").repartition(4)
    setting = {"rounds": 5, "depth": 3, "leaves": 6, "least": 5, "rate": 0.3, "bins": 100}
    fits = {"all": (["a", "b", "c"], "y"), "some": (["c", "a"], "z")}
    models = T.boost_distributed(df, fits, **setting)
    for name, (cols, _) in fits.items():
        at = ["abc".index(c) for c in cols]
        use = np.array([name == "all" or k % 3 > 0 for k in range(len(y))])
        points = models[name].points
        b = T.binned(x[:, at], points)
        f = np.full(use.sum(), y[use].mean())
        for tree in models[name].trees:
            own = T.grow(T.array_sums(b[use], y[use] - f), 3, 6, 5)
            assert own.feature == tree.feature and own.at == tree.at and np.allclose(own.value, tree.value)
            f += 0.3 * own.predict(b[use])
    out = T.predict_with(df, models["all"], ["a", "b", "c"]).select("a", "b", "c", "prediction").toPandas()
    assert np.allclose(out["prediction"], models["all"].predict(out[["a", "b", "c"]].to_numpy(float)))


def test_groups_are_fitted_in_one_job(spark, table):
    split = table.withColumn("split", F.when(F.col("k") < 60, "train").otherwise("test"))
    small = {"RandomForest": {"trees": 5}, "GradientBoosting": {"rounds": 8}}
    got = T.fit_groups(split, "city", ["k"], X, ["y"], ["RandomForest", "GradientBoosting"], small).toPandas()
    pdf = split.toPandas().sort_values("k")
    for city in "abc":
        own = pdf[pdf.city == city]
        train, test = own[own.split == "train"], own[own.split == "test"]
        model = T.boost(train[X].to_numpy(), train["y"].to_numpy(), **{**T.BOOST, "rounds": 8})
        want = dict(zip(test["k"], model.predict(test[X].to_numpy()), strict=True))
        here = got[(got.city == city) & (got.algorithm == "GradientBoosting")]
        assert len(here) == len(want) and np.allclose(here["prediction"], here["k"].map(want))
    assert set(got.algorithm) == {"RandomForest", "GradientBoosting"}


@pytest.mark.parametrize("depth,leaves,least", [(15, None, 1), (5, 9, 5), (4, None, 20)])
def test_trees_grown_together_are_those_of_dense_sums(depth, leaves, least):
    rng = np.random.default_rng(7)
    x, y = _rows(250)
    x[:, 1] += 3.0  # a feature whose lowest bin stays empty in places
    b = T.binned(x, [T.cuts(c, 64) for c in x.T])
    weights = [None, *[np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float) for _ in range(6)]]
    for weight, tree in zip(weights, T.grow_rows(b, y, weights, depth, leaves, least), strict=True):
        own = T.grow(T.array_sums(b, y, weight), depth, leaves, least)
        assert (own.feature, own.at, own.null_left, own.left, own.levels) == (tree.feature, tree.at, tree.null_left, tree.left, tree.levels)
        assert np.allclose(own.value, tree.value) and np.allclose(own.gain, tree.gain)


def test_forest_of_all_rows_is_that_of_arrays_in_any_layout(spark, monkeypatch):
    from airshed.operators import forest as FO

    x, y = _rows(400)
    x = np.round(np.where(np.isnan(x), 0.0, x), 1)
    rows = [(k, "train" if k < 300 or k in (310, 311) else "val", *map(float, a), float(b), float(-b * a[0])) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [rows[0], rows[0], (None, *rows[1][1:])]  # a row that comes three times, a null key
    df = spark.createDataFrame(rows, "k int, split string, a double, b double, c double, y double, z double")
    setting = {"trees": 4, "depth": 6, "least": 2, "bins": 200, "seed": 3}
    run = lambda d: {(r["k"], r["target"]): r["prediction"] for r in FO.predictions(d, ["k"], ["k"], ["a", "b", "c"], ["y", "z"], **setting).collect()}
    got = run(df.coalesce(1))
    key = np.array([r[0] for r in df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("split", "y", "z", "a", "b", "c"))).where("split = 'train'").select(F.xxhash64("k", "n"), "k", "a", "b", "c", "y", "z").orderBy("k").collect()])
    own = df.where("split = 'train'").orderBy("k").toPandas()
    points = T.column_cuts(df.where("split = 'train'"), ["a", "b", "c"], 200)
    train, test = (T.binned(v, points) for v in (own[["a", "b", "c"]].to_numpy(), x))
    for target in "yz":
        want = np.zeros(len(x))
        for i in range(4):
            tree = T.grow_rows(train, own[target].to_numpy(), [FO.bootstrap(key, i, 3)], 6, None, 2, lambda p, i=i: FO.third(p, i, 3, 3))[0]
            want += tree.predict(test) / 4
        assert all(abs(got[k, target] - want[k]) < 1e-9 for k, s, *_ in rows if s == "val")
    assert len(got) == 2 * sum(r[1] == "val" for r in rows)
    # other layouts give the same forest, and so do large nodes that are split from sums of all tasks
    for held in (FO.HELD_ROWS, 40):
        monkeypatch.setattr(FO, "HELD_ROWS", held)
        again = run(df.repartition(6))
        assert again.keys() == got.keys() and all(abs(again[k] - got[k]) < 1e-9 for k in got)
