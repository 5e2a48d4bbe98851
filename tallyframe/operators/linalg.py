"""Sparse designs, ridge and Gaussian posteriors from distributed gram matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAMBDAS = np.logspace(1, 6, 16)
NORMAL = {0.50: 0.6744897501960817, 0.80: 1.2815515655446004, 0.90: 1.6448536269514722, 0.95: 1.959963984540054}


# --- design --------------------------------------------------------------------------------------


def floor_counts(poss: DataFrame) -> DataFrame:
    """AGG21: possessions on the floor, both sides together."""
    return poss.select("season", F.explode(F.concat("offense_five", "defense_five")).alias("player_id")).groupBy("season", "player_id").agg(F.count("*").alias("n"))


def columns(counts: DataFrame, *, least: int = 200) -> DataFrame:
    """MLR01: column layout: a season's kept players, offence and defence, then its two replacement
    columns; the home column is last and unpenalised.

    Player columns number a few thousand at most, so the ordering window's one partition is small.
    """
    sides = F.explode(F.array(F.lit("O"), F.lit("D"))).alias("side")
    kept = counts.where(F.col("n") >= least).select("season", F.lit(0).alias("kind"), "player_id", sides)
    rest = counts.select("season").distinct().select("season", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("player_id"), sides)
    order = Window.orderBy("season", "kind", "player_id", F.col("side").desc())
    c = kept.unionByName(rest).withColumn("column_id", F.row_number().over(order) - 1)
    home = c.agg(F.max("column_id").alias("m")).select(F.lit(None).cast("int").alias("season"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("player_id"), F.lit("H").alias("side"), (F.coalesce("m", F.lit(-1)) + 1).alias("column_id"))
    return c.unionByName(home).withColumn("penalised", F.col("side") != "H")


def design(poss: DataFrame, cols: DataFrame, *, parts: int | None = None) -> DataFrame:
    """MLR02: rows (row_id, column_id, value). Pooled players of one side add up. ``poss``: row_id,
    season, offense_five, defense_five, home (boolean).

    The layout, thousands of rows at most, is broadcast: by player or season its keys are few, and entries
    shuffled by them would meet in few tasks. Possessions are partitioned by row (``parts``) before they
    are exploded, so entries aren't shuffled at all.
    """
    rows = poss.repartition(parts, "row_id") if parts else poss.repartition("row_id")
    last = cols.where("kind = 2").agg(F.max("column_id").alias("home_column"))
    side = lambda s, five: F.struct(F.lit(s).alias("side"), F.col(five).alias("five"))
    both = F.array(side("O", "offense_five"), side("D", "defense_five"), F.struct(F.lit("H").alias("side"), F.when(F.col("home"), F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("five")))
    e = rows.crossJoin(F.broadcast(last)).select("row_id", "season", "home_column", F.explode(both).alias("x")).select("row_id", "season", "home_column", F.col("x.side").alias("side"), F.explode("x.five").alias("player_id"))
    own = cols.where("kind = 0").select("season", "player_id", "side", F.col("column_id").alias("own"))
    pooled = cols.where("kind = 1").select("season", "side", F.col("column_id").alias("pooled"))
    at = F.when(F.col("side") == "H", F.col("home_column")).otherwise(F.when(F.col("pooled").isNotNull(), F.coalesce("own", "pooled")))
    j = e.join(F.broadcast(own), ["season", "player_id", "side"], "left").join(F.broadcast(pooled), ["season", "side"], "left")
    return j.select("row_id", at.alias("column_id")).where("column_id is not null").groupBy("row_id", "column_id").agg(F.sum(F.lit(1.0)).alias("value"))


def folds(games: DataFrame, *, k: int = 5, seed: int = 0) -> DataFrame:
    """MLR03: folds by whole games, even within each season, by a seeded hash order."""
    w = Window.partitionBy("season").orderBy(F.xxhash64(F.lit(seed), "game_id"), "game_id")
    return games.select("game_id", "season").distinct().withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


# --- gram ----------------------------------------------------------------------------------------


def gram(entries: DataFrame, *keys: str, weight: Column | None = None) -> DataFrame:
    """MLR06: sums of products (keys, i, j, value) with i <= j of a sparse matrix (row_id, column_id, value).

    Each row's entries are gathered once, equal rows become one whose weights add up (lineups recur), and
    entries are paired inside the row, so the shuffle is linear in entries; the pairs are combined on the
    map side. ``keys`` (a fold) are constant within a row.
    """
    e = F.struct("column_id", "value")
    rows = entries.groupBy(*keys, "row_id").agg(F.array_sort(F.collect_list(e)).alias("xs"), F.first(weight if weight is not None else F.lit(1.0)).alias("w"))
    rows = rows.groupBy(*keys, "xs").agg(F.sum("w").alias("w"))
    pair = rows.select(*keys, "w", "xs", F.posexplode("xs").alias("k", "a")).select(*keys, "w", "a", F.explode(F.slice("xs", F.col("k") + 1, F.size("xs"))).alias("b"))
    return pair.groupBy(*keys, F.col("a.column_id").alias("i"), F.col("b.column_id").alias("j")).agg(F.sum(F.col("a.value") * F.col("b.value") * F.col("w")).alias("value"))


def moment(entries: DataFrame, y: DataFrame, *keys: str) -> DataFrame:
    """MLR06: X'y as (keys, i, value); ``y``: row_id, y."""
    return entries.join(y, "row_id").groupBy(*keys, F.col("column_id").alias("i")).agg(F.sum(F.col("value") * F.col("y")).alias("value"))


@dataclass
class Normal:
    """A gram matrix and moment on the driver; p is thousands of columns, whatever the rows."""

    a: np.ndarray
    b: np.ndarray

    @classmethod
    def collect(cls, g: DataFrame, m: DataFrame, p: int) -> Normal:
        """From :func:`gram` and :func:`moment`."""
        a, b = np.zeros((p, p)), np.zeros(p)
        i, j, v = g.select("i", "j", "value").toPandas().to_numpy(dtype=float).reshape(-1, 3).T
        i, j = i.astype(int), j.astype(int)
        a[i, j] = a[j, i] = v
        k, w = m.select("i", "value").toPandas().to_numpy(dtype=float).reshape(-1, 2).T
        b[k.astype(int)] = w
        return cls(a, b)

    def __add__(self, other: Normal) -> Normal:
        return Normal(self.a + other.a, self.b + other.b)


def penalty(mask: np.ndarray, lam: float) -> np.ndarray:
    """MLR04-05: lambda where penalised, 0 for home and intercept."""
    return np.where(mask, lam, 0.0)


def solve_ridge(n: Normal, mask: np.ndarray, lam: float) -> np.ndarray:
    """MLR06: by Cholesky; falls back to least squares if the matrix isn't positive definite."""
    a = n.a + np.diag(penalty(mask, lam))
    try:
        c = np.linalg.cholesky(a)
        return np.linalg.solve(c.T, np.linalg.solve(c, n.b))
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, n.b, rcond=None)[0]


@dataclass
class Blocks:
    """Normal equations of columns that meet within their block only (a season), and of one shared column
    that meets all (home): by block the gram, its border and the moment. A gram over a block's columns
    is as large as that season's players, whatever the number of seasons."""

    at: list[np.ndarray]
    gram: list[np.ndarray]
    border: list[np.ndarray]
    moment: list[np.ndarray]
    corner: float = 0.0
    corner_moment: float = 0.0
    yy: float = 0.0
    rows: int = 0

    @classmethod
    def collect(cls, g: DataFrame, m: DataFrame, block: np.ndarray, yy: float, rows: int) -> Blocks:
        """From :func:`gram` and :func:`moment`; ``block`` numbers each column's block, -1 is the shared one."""
        at = [np.flatnonzero(block == k) for k in np.unique(block[block >= 0])]
        where, local = np.zeros(len(block), dtype=int), np.zeros(len(block), dtype=int)
        for k, a in enumerate(at):
            where[a], local[a] = k, np.arange(len(a))
        out = cls(at, [np.zeros((len(a), len(a))) for a in at], [np.zeros(len(a)) for a in at], [np.zeros(len(a)) for a in at], yy=float(yy), rows=int(rows))
        i, j, v = g.select("i", "j", "value").toPandas().to_numpy(dtype=float).reshape(-1, 3).T
        i, j = i.astype(int), j.astype(int)
        for k in range(len(at)):
            mine = (block[i] >= 0) & (block[j] >= 0) & (where[i] == k) & (where[j] == k)
            x, y = local[i[mine]], local[j[mine]]
            out.gram[k][x, y] = out.gram[k][y, x] = v[mine]
            for a, b in ((i, j), (j, i)):
                edge = (block[a] >= 0) & (block[b] < 0) & (where[a] == k)
                out.border[k][local[a[edge]]] = v[edge]
        out.corner = float(v[(block[i] < 0) & (block[j] < 0)].sum())
        c, w = m.select("i", "value").toPandas().to_numpy(dtype=float).reshape(-1, 2).T
        c = c.astype(int)
        for k in range(len(at)):
            mine = (block[c] >= 0) & (where[c] == k)
            out.moment[k][local[c[mine]]] = w[mine]
        out.corner_moment = float(w[block[c] < 0].sum())
        return out

    def __add__(self, o: Blocks) -> Blocks:
        add = lambda x, y: [a + b for a, b in zip(x, y)]
        return Blocks(self.at, add(self.gram, o.gram), add(self.border, o.border), add(self.moment, o.moment), self.corner + o.corner, self.corner_moment + o.corner_moment, self.yy + o.yy, self.rows + o.rows)

    def solve(self, lam: float) -> np.ndarray:
        """MLR04-06: the ridge solution; the shared column is free."""
        s, r, parts = self.corner, self.corner_moment, []
        for g, e, m in zip(self.gram, self.border, self.moment):
            x = np.linalg.solve(g + lam * np.eye(len(g)), np.column_stack([e, m]))
            s, r = s - e @ x[:, 0], r - e @ x[:, 1]
            parts.append(x)
        out = np.zeros(sum(map(len, self.at)) + 1)
        home = r / s if s > 0 else 0.0
        for a, x in zip(self.at, parts):
            out[a] = x[:, 1] - x[:, 0] * home
        out[self._shared()] = home
        return out

    def _shared(self) -> int:
        n = sum(map(len, self.at)) + 1
        return int(np.setdiff1d(np.arange(n), np.concatenate(self.at) if self.at else []).item())

    def rss(self, beta: np.ndarray) -> float:
        """The squared error of ``beta`` on these rows."""
        h = beta[self._shared()]
        out = self.yy - 2 * h * self.corner_moment + h * h * self.corner
        for a, g, e, m in zip(self.at, self.gram, self.border, self.moment):
            b = beta[a]
            out += b @ g @ b + 2 * h * (e @ b) - 2 * b @ m
        return float(max(out, 0.0))

    def rmse(self, beta: np.ndarray) -> float:
        """Root of the mean squared error."""
        return float(np.sqrt(self.rss(beta) / max(1, self.rows)))

    def inverses(self, lam: float) -> list[np.ndarray]:
        """BAY03: the diagonal blocks of the penalised gram's inverse."""
        inv = [np.linalg.inv(g + lam * np.eye(len(g))) for g in self.gram]
        u = [x @ e for x, e in zip(inv, self.border)]
        s = self.corner - sum(float(e @ x) for e, x in zip(self.border, u))
        return [x + np.outer(v, v) / s if s > 0 else x for x, v in zip(inv, u)]


def select_lambda(by_fold: dict[int, Normal | Blocks], score, mask: np.ndarray, lambdas: np.ndarray = LAMBDAS, solve=solve_ridge) -> tuple[float, dict[float, float]]:
    """MLR07: the lambda of least mean ``score(beta, fold)``; each fold's gram is computed once and a
    training gram is the sum of the others."""
    curve = {}
    for lam in lambdas:
        out = []
        for f in by_fold:
            rest = [n for k, n in by_fold.items() if k != f]
            out.append(score(solve(sum(rest[1:], rest[0]), mask, lam), f))
        curve[float(lam)] = float(np.mean(out))
    return min(curve, key=curve.get), curve


def is_interior(best: float, lambdas: np.ndarray = LAMBDAS) -> bool:
    """MLR08: not at either end of the grid."""
    return bool(lambdas.min() < best < lambdas.max())


def predict(entries: DataFrame, beta: DataFrame) -> DataFrame:
    """MLR12: (row_id, prediction) of a sparse matrix; ``beta``: column_id, beta."""
    return entries.join(beta, "column_id").groupBy("row_id").agg(F.sum(F.col("value") * F.col("beta")).alias("prediction"))


def indicator_means(entries: DataFrame, y: DataFrame) -> DataFrame:
    """AGG22, MLR09: each column's rows and mean of y over the rows that have it."""
    return entries.select("row_id", "column_id").distinct().join(y, "row_id").groupBy("column_id").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"))


def team_means(poss: DataFrame, teams: DataFrame) -> DataFrame:
    """AGG23, MLR10: points per possession by team, the global mean for teams without any."""
    g = poss.groupBy("offense_team_id").agg(F.avg("points").alias("m"))
    return teams.join(g, teams["team_id"] == g["offense_team_id"], "left").crossJoin(poss.agg(F.avg("points").alias("overall"))).select("team_id", F.coalesce("m", "overall").alias("mean_points"))


def ratings_per_100(cols: DataFrame, beta: DataFrame, counts: DataFrame) -> DataFrame:
    """MLR11: offence, defence and net by player and season."""
    c = cols.where("kind = 0").join(beta, "column_id")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("beta"))) * 100.0
    g = c.groupBy("player_id", "season").agg(side("O").alias("off_rating"), side("D").alias("def_rating"))
    return g.withColumn("net_rating", F.col("off_rating") - F.col("def_rating")).join(counts.withColumnRenamed("n", "n_possessions"), ["player_id", "season"])


def game_margin(poss: DataFrame, value: str = "points") -> DataFrame:
    """AGG19: home minus away by game."""
    return poss.groupBy("game_id").agg(F.sum(F.when(F.col("home"), F.col(value)).otherwise(-F.col(value))).alias("margin"))


def margin_rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """AGG20: over the games of both."""
    j = a.select("game_id", F.col("margin").alias("m1")).join(b.select("game_id", F.col("margin").alias("m2")), "game_id")
    return j.agg(F.count("*").alias("games"), F.round(F.sqrt(F.avg(F.pow(F.col("m1") - F.col("m2"), 2))), 8).alias("rmse"))


# --- posterior -----------------------------------------------------------------------------------


@dataclass
class Posterior:
    """BAY01-03: mean and covariance of the coefficients for noise variance sigma2."""

    mean: np.ndarray
    inverse: np.ndarray
    sigma2: float
    lam: float

    @property
    def tau2(self) -> float:
        """BAY02: prior variance."""
        return self.sigma2 / self.lam

    def interval(self, x: np.ndarray, level: float = 0.9, noise: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """BAY05: predictive interval of weight rows, with separate noise variance."""
        m = x @ self.mean
        sd = np.sqrt(np.maximum(self.sigma2 * np.einsum("ij,jk,ik->i", x, self.inverse, x) + noise, 0.0))
        return m - NORMAL[level] * sd, m + NORMAL[level] * sd

    def net(self, off: int, dfn: int) -> tuple[float, float]:
        """BAY09: net rating per 100 and its SD, covariance included."""
        v = self.sigma2 * (self.inverse[off, off] + self.inverse[dfn, dfn] - 2 * self.inverse[off, dfn])
        return 100.0 * float(self.mean[off] - self.mean[dfn]), 100.0 * float(np.sqrt(max(v, 0.0)))


def posterior(n: Normal, mask: np.ndarray, lam: float, rss: float, rows: int) -> Posterior:
    """BAY01-03: sigma2 is the residual sum of squares over n (not n - p)."""
    a = n.a + np.diag(penalty(mask, lam))
    c = np.linalg.cholesky(a)
    inv = np.linalg.solve(c.T, np.linalg.solve(c, np.eye(len(a))))
    return Posterior(inv @ n.b, inv, rss / rows, lam)


def residual_variance(y: DataFrame, prediction: DataFrame) -> DataFrame:
    """BAY02."""
    return y.join(prediction, "row_id").agg(F.sum(F.pow(F.col("y") - F.col("prediction"), 2)).alias("rss"), F.count("*").alias("rows"))


def game_weights(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """BAY04: signed sums (game_id, column_id, value); ``rows``: row_id, game_id, home."""
    sign = F.when(F.col("home"), F.col("value")).otherwise(-F.col("value"))
    return entries.join(rows, "row_id").groupBy("game_id", "column_id").agg(F.sum(sign).alias("value"))


def margin_noise(observed: np.ndarray, predicted: np.ndarray, model_var: np.ndarray) -> float:
    """BAY06: method of moments, floored at 0."""
    return float(max(np.mean((observed - predicted) ** 2 - model_var), 0.0))


def covered(y: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """BAY07."""
    return float(np.mean((y >= low) & (y <= high)))


def coverage_frame(df: DataFrame) -> DataFrame:
    """BAY07: share of y inside [low, high] at each level, as columns (level, coverage)."""
    return df.groupBy("level").agg(F.round(F.avg(F.when((F.col("y") >= F.col("low")) & (F.col("y") <= F.col("high")), 1.0).otherwise(0.0)), 10).alias("coverage"))


def simulation_calibration(spark, gram: np.ndarray, lam: float, sigma2: float, *, trials: int = 40, seed: int = 7, level: float = 0.9) -> DataFrame:
    """BAY08: trials in parallel: draw coefficients from the prior, data from them, and count how many
    intervals hold the truth.

    Data meet the posterior only as X'y, which is X'X beta plus noise of covariance sigma2 X'X; so a trial
    needs the ``gram`` of all rows and none of the rows.
    """
    p = len(gram)
    inv = np.linalg.inv(gram + lam * np.eye(p))
    values, vectors = np.linalg.eigh(gram)
    root = vectors * np.sqrt(np.maximum(values, 0.0))
    z = NORMAL[level]

    def run(batches):
        for b in batches:
            out = []
            for t in b["id"]:
                rng = np.random.default_rng([seed, int(t)])
                beta = rng.normal(0, np.sqrt(sigma2 / lam), p)
                xy = gram @ beta + np.sqrt(sigma2) * (root @ rng.normal(size=p))
                m, sd = inv @ xy, np.sqrt(sigma2 * np.diag(inv))
                out.append((int(t), float(np.mean(np.abs(m - beta) <= z * sd))))
            yield pd.DataFrame(out, columns=["trial", "coverage"])

    return spark.range(trials).mapInPandas(run, "trial long, coverage double")


def stability(ratings: DataFrame) -> DataFrame:
    """JON18, BAY12, AGG34: correlation of a player's net rating with the season after."""
    a = ratings.select("player_id", F.col("season").alias("s"), F.col("net_rating").alias("x"))
    b = ratings.select("player_id", (F.col("season") - 1).alias("s"), F.col("net_rating").alias("y"))
    return a.join(b, ["player_id", "s"]).agg(F.count("*").alias("pairs"), F.round(F.corr("x", "y"), 8).alias("r"))


def tercile_widths(ratings: DataFrame) -> DataFrame:
    """AGG38: mean interval width by tercile of possessions (a few thousand players)."""
    t = ratings.withColumn("tercile", F.ntile(3).over(Window.orderBy("n_possessions", "player_id", "season")))
    return t.groupBy("tercile").agg(F.count("*").alias("players"), F.round(F.avg(F.col("net_ci_high") - F.col("net_ci_low")), 8).alias("mean_width"))


def quarantine_bias(games: DataFrame, quarantine: DataFrame) -> DataFrame:
    """BAY13, AGG13, JON11: games set aside by team, and their rate."""
    q = quarantine.select("game_id").distinct().withColumn("bad", F.lit(True))
    t = games.select("game_id", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).join(q, "game_id", "left")
    g = t.groupBy("team_id").agg(F.count("*").alias("games"), F.count_if(F.coalesce("bad", F.lit(False))).alias("quarantined"))
    return g.withColumn("q_rate", F.col("quarantined") / F.col("games"))


def decayed_gram(entries: DataFrame, row_days: DataFrame, half_life: float = 60.0) -> DataFrame:
    """BAY10: a gram whose rows weigh 0.5 ** (days / half_life); ``row_days``: row_id, days."""
    w = row_days.select("row_id", F.coalesce(F.pow(F.lit(0.5), F.col("days") / half_life), F.lit(1.0)).alias("w"))
    return gram(entries.join(w, "row_id"), weight=F.col("w"))


def weighted_posterior_mean(n: Normal, mask: np.ndarray, lam: float) -> np.ndarray:
    """BAY10: the mean for a weighted gram and moment."""
    return solve_ridge(n, mask, lam)


def predictive_coverage(p: Posterior, weights: np.ndarray, margins: np.ndarray, noise: float, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> dict[float, float]:
    """BAY07, BAY11: coverage curve of held-out game margins."""
    return {lv: covered(margins, *p.interval(weights, lv, noise)) for lv in levels}


def held_out_rmse(p: Posterior, weights: np.ndarray, margins: np.ndarray) -> float:
    """BAY11: of the posterior mean's margins."""
    return float(np.sqrt(np.mean((weights @ p.mean - margins) ** 2)))
