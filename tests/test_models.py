"""Ratings, logistic models, boosting and bootstrap: identities and small properties."""

import numpy as np
import pytest

from pyspark.sql import functions as F
from tallyframe.operators import boost, gates, linalg, logistic, metrics


def frame(spark, x, y, split=None):
    rows = [(int(i), f"g{i % 20}", 2022 + i % 4, (split[i] if split else "train"), int(y[i]), *map(float, x[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "row long, game_id string, season int, split string, y int, " + ", ".join(f"x{k} double" for k in range(x.shape[1])))


def test_ridge_from_gram_equals_direct_solution(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((200, 6)) < 0.4) * rng.integers(1, 3, (200, 6))
    y = rng.normal(size=200)
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row_id long, column_id int, value double")
    ys = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row_id long, y double")
    n = linalg.Normal.collect(linalg.gram(entries), linalg.moment(entries, ys), 6)
    assert np.allclose(n.a, x.T @ x) and np.allclose(n.b, x.T @ y)
    mask = np.array([True] * 5 + [False])
    direct = np.linalg.solve(x.T @ x + np.diag(np.where(mask, 3.0, 0.0)), x.T @ y)
    beta = linalg.solve_ridge(n, mask, 3.0)
    assert np.allclose(beta, direct)
    rss = float(((y - x @ beta) ** 2).sum())
    p = linalg.posterior(n, mask, 3.0, rss, len(y))
    assert np.allclose(p.mean, beta) and np.isclose(p.sigma2, rss / 200)
    low, high = p.interval(x[:5].astype(float), noise=p.sigma2)
    assert (low < x[:5] @ beta).all() and (high > x[:5] @ beta).all()


def test_simulation_calibration_is_near_nominal(spark):
    x = np.random.default_rng(2).normal(size=(120, 5))
    c = linalg.simulation_calibration(spark, x.T @ x, 2.0, 1.0, trials=200).agg(F.avg("coverage")).first()[0]
    assert 0.86 < c < 0.94


def test_logistic_equals_newton_and_guards_leakage(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(int)
    split = ["train" if i % 3 else "validation" for i in range(600)]
    df = frame(spark, x, y, split)
    m = logistic.fit(df, ["x0", "x1"], 0.0)
    z = (x - x.mean(0)) / x.std(0)
    want = logistic.newton(np.column_stack([np.ones(600), z]), y.astype(float))
    assert np.allclose([m.intercept, *m.beta], want, atol=1e-4)
    p = df.select(m.predict().alias("p"), "y", "row")
    a, b = logistic.calibration(p)
    assert abs(a) < 1e-4 and abs(b - 1) < 1e-4
    best, curve = logistic.select_and_fit(df, ["x0", "x1"], (1e-4, 10.0))
    assert best.lam == min(curve, key=curve.get) == 1e-4
    with pytest.raises(ValueError):
        logistic.guard(df, ["train", "test"])
    with pytest.raises(ValueError):
        logistic.fit(df.withColumn("points", F.lit(1.0)), ["points"], 1.0)


def test_boosting_needs_depth_two_for_xor(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 2))
    df = frame(spark, x, (x[:, 0] > 0) ^ (x[:, 1] > 0))
    loss = {}
    for depth in (1, 2):
        _, losses = boost.fit(df, ["x0", "x1"], boost.Config(rate=0.5, depth=depth, rounds=4, bins=8, least_rows=20), validation=df)
        loss[depth] = losses[-1]
    assert loss[2] < 0.55 < loss[1]
    for bad in ({"rate": 0}, {"depth": 0}, {"bins": 1}, {"least_rows": 0}):
        with pytest.raises(ValueError):
            boost.Config(**bad)


def test_split_ties_go_to_the_first_feature_and_lowest_threshold():
    hist = {b: (-10.0 if b < 2 else 10.0, 5.0, 300) for b in range(4)}
    c = boost.Config(least_rows=200)
    assert boost.best_split({"a": hist, "b": hist}, ["a", "b"], {"a": [0, 1, 2], "b": [0, 1, 2]}, c) == ("a", 1)
    assert boost.best_split({"a": {0: (1.0, 1.0, 150), 1: (-1.0, 1.0, 150)}}, ["a"], {"a": [0]}, c) is None


def test_bootstrap_on_sums_equals_bootstrap_on_rows():
    rng = np.random.default_rng(5)
    n = rng.integers(1, 30, 40)
    loss = [rng.random(k) for k in n]
    sums = np.array([x.sum() for x in loss])
    d = metrics.draws(40, 50, 9)
    g = np.random.default_rng(9)
    for k in range(50):
        take = g.integers(0, 40, size=40)
        assert np.isclose(np.concatenate([loss[t] for t in take]).mean(), (d[k] @ sums) / (d[k] @ n))
    ci = metrics.interval(np.array([1.0, 2.0, np.nan, 3.0]))
    assert ci["point"] == 2.0 and ci["low"] < 2 < ci["high"]
    assert metrics.gap_closed(np.array([0.25]), np.array([0.22]), np.array([0.19])) == pytest.approx(0.5)


def test_reliability_edges(spark):
    df = spark.createDataFrame([(0.3, 1), (0.7, 0), (0.95, 1), (1.0, 1), (0.0, 0)], "p double, y int")
    got = {r["bin"]: r["n"] for r in metrics.reliability(df).collect()}
    assert len(got) == 10 and got[2] == 1 and got[6] == 1 and got[9] == 2 and got[0] == 1 and got[5] == 0


def test_gate_outcomes():
    out = gates.passed({"a": True, "b": False}, {"a"})
    assert out == {"gates": {"a": True, "b": False}, "structural_pass": True, "pass": False, "failed": ["b"]}
    assert all(gates.posterior_gates(0.9, 0.9, 1.0, 1.0).values())


def test_gate_sets_fail_where_they_should():
    ok = {"p_min": 0.01, "p_max": 0.99, "late_error": 0.01, "intercept": 0.0, "slope": 1.0, "splits": {"train", "validation"}}
    tiers, better = {"C": ok, "D": ok}, {"brier_high": -0.1, "log_loss_high": 0.1}
    assert all(gates.ablation_gates(tiers, better, [-0.1, -0.2], 0).values())
    bad = gates.ablation_gates({"C": ok, "D": ok | {"p_max": 1.0, "late_error": 0.2}}, {"brier_high": 0.1, "log_loss_high": 0.0}, [], 3)
    assert not any(bad.values()) and set(bad) > gates.STRUCTURAL["ablation"]
    good = gates.challenger_gates(ok, ok, better, {"train"}, 0, 0)
    assert all(good.values()) and set(good) > gates.STRUCTURAL["challenger"]
    assert not any(gates.challenger_gates(ok | {"p_min": 0.0, "slope": 2.0}, ok, {"brier_high": 0.0, "log_loss_high": 0.0}, {"train", "test"}, 1, 2).values())
    assert all(gates.market_gates(ok, ok).values()) and not gates.market_gates(ok | {"intercept": 0.5}, ok)["model_calibrated"]
    ladder = gates.ladder_gates({"P3": ok}, "P3", "form_beats_prior_strength", -0.1)
    assert all(ladder.values()) and not gates.ladder_gates({"P3": ok | {"splits": {"train", "test"}}}, "P3", "x", 0.1)["test_untouched"]
    assert all(gates.prediction_market_gates(ok, ok, 1.0, 86_400.0, 0).values())
    assert not gates.prediction_market_gates(ok, ok, 0.0, 5.0, 1)["prices_before_tip"]


def test_ridge_query_against_numpy(spark):
    """All seasons, all penalties, inner folds and a held-out one, by dense matrices."""
    from tallyframe.plans import studies

    sf = "/root/testdata/sf0.001"
    r = studies.Ridge(spark, sf)
    cols = r.columns.toPandas()
    at = {(s, k, p, side): c for s, k, p, side, c in zip(cols["season"].fillna(-1), cols["kind"], cols["player_id"].fillna(-1), cols["side"], cols["column_id"])}
    rows = studies.design_rows(spark, sf).collect()
    fold = {x["game_id"]: x["fold"] for x in r.margins.select("game_id", "fold").collect()}
    x, games = np.zeros((len(rows), len(cols))), {}
    for i, row in enumerate(rows):
        for side, five in (("O", row["offense_five"]), ("D", row["defense_five"])):
            for p in five:
                x[i, at.get((row["season"], 0, p, side), at[row["season"], 1, -1, side])] += 1
        x[i, at[-1, 2, -1, "H"]] = float(row["home"])
        games.setdefault(row["game_id"], []).append(i)
    y, part = np.array([row["points"] for row in rows], dtype=float), np.array([fold[row["game_id"]] for row in rows])
    sign = np.array([1.0 if row["home"] else -1.0 for row in rows])
    free = np.ones(len(cols))
    free[at[-1, 2, -1, "H"]] = 0
    lam, curve = r.select()
    assert list(curve) == list(linalg.LAMBDAS) and lam == min(curve, key=curve.get)
    for some in (linalg.LAMBDAS[0], linalg.LAMBDAS[9]):
        errors = []
        for f in range(4):
            use = (part != f) & (part != 4)
            beta = np.linalg.solve(x[use].T @ x[use] + some * np.diag(free), x[use].T @ y[use])
            margin = [(sum(sign[i] * (y[i] - x[i] @ beta) for i in at_)) ** 2 for g, at_ in games.items() if fold[g] == f]
            errors.append(np.sqrt(np.mean(margin)))
        assert np.isclose(curve[float(some)], np.mean(errors))


def test_ridge_by_blocks_equals_the_whole_solution(spark):
    rng = np.random.default_rng(5)
    block = np.array([0, 0, 0, 1, 1, 1, 1, -1])
    x = rng.normal(size=(60, 8))
    x[:30, block == 1] = 0
    x[30:, block == 0] = 0
    y, mask = rng.normal(size=60), block >= 0
    n = linalg.Normal(x.T @ x, x.T @ y)
    e = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(8)], "row_id long, column_id int, value double")
    ys = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row_id long, y double")
    blocks = linalg.Blocks.collect(linalg.gram(e), linalg.moment(e, ys), block, float(y @ y), 60)
    beta = blocks.solve(3.0)
    assert np.allclose(beta, linalg.solve_ridge(n, mask, 3.0))
    assert np.isclose(blocks.rss(beta), ((y - x @ beta) ** 2).sum())
    whole = np.linalg.inv(n.a + np.diag(np.where(mask, 3.0, 0.0)))
    for a, inv in zip(blocks.at, blocks.inverses(3.0)):
        assert np.allclose(inv, whole[np.ix_(a, a)])


def test_newton_path_equals_single_fits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.0])))).astype(int)
    df = frame(spark, x, y)
    for m, lam in zip(logistic.fit_path(df, ["x0", "x1", "x2"], (1e-4, 0.1, 10.0)), (1e-4, 0.1, 10.0)):
        want = logistic.fit(df, ["x0", "x1", "x2"], lam)
        assert np.allclose([m.intercept, *m.beta], [want.intercept, *want.beta], atol=1e-4)


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = [(f"g{k}", 10 + k % 7, float(k % 11), float(k % 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "game_id string, n long, brier double, log_loss double")
    a, b = (metrics.bootstrap_sums(df.repartition(k), ["n", "brier"], n=400) for k in (1, 7))
    assert np.allclose(a, b) and abs(a[:, 0].mean() - 300) < 5
    means = a[:, 2] / a[:, 1]
    rng = np.random.default_rng(1)
    v = np.array([(r[1], r[2]) for r in rows], dtype=float)
    want = [np.divide(*v[rng.integers(0, 300, 300)].sum(axis=0)[::-1]) for _ in range(400)]
    assert abs(means.std() / np.std(want) - 1) < 0.25


def test_orthogonality_query_fits_the_whole_table(spark):
    from tallyframe.plans import statistics

    sf = "/root/testdata/sf0.1"
    r = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").toPandas()["p_partkey"].to_numpy()
    p, q = (r % 89 + 5) / 99.0, (r * 7 % 83 + 8) / 99.0
    want = logistic.orthogonality(p, q, ((r * 31 % 97) / 97.0 < p).astype(float))
    assert np.allclose(list(statistics.log09(spark, sf).first()), want, atol=1e-8)
