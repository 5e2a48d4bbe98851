"""Queries of the metrics, linear-algebra, model and bootstrap operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import exprs as X
from tallyframe.operators import boost, linalg, logistic, metrics, pregame
from tallyframe.plans import standins as S
from tallyframe.plans.relational import mart
from tallyframe.plans.studies import design_rows
from tallyframe.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, text: str | None, *uses: str):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        if text is not None:
            ORACLES[name] = S.sql(text, *uses)
        return f

    return add


# --- probability metrics -------------------------------------------------------------------------


def scored(spark, d) -> DataFrame:
    """Stand-in forecasts with their losses."""
    m = mart(spark, d)
    p = X.sigmoid(F.col("home_score_differential") / 4.0 + F.col("lineup_net_rapm_differential") / 40.0)
    s = m.select("game_id", "season", "period", "possession_number", F.col("home_score_differential").alias("margin"), F.col("regulation_seconds_remaining").alias("remaining"), F.col("home_win").cast("int").alias("y"), p.alias("p"))
    return metrics.scored(s)


def _round(df: DataFrame, n: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("AGG29_cluster_log_loss", "SELECT round(avg(m), 7) AS cluster_log_loss FROM (SELECT avg(log_loss) AS m FROM scored GROUP BY game_id)", "scored")
def agg29(spark, d):
    return _round(metrics.cluster_log_loss(scored(spark, d)), 7, "cluster_log_loss")


_BIN = "CAST(CASE WHEN p >= 0.9 THEN 9 WHEN p >= 0.8 THEN 8 WHEN p >= 0.7000000000000001 THEN 7 WHEN p >= 0.6000000000000001 THEN 6 WHEN p >= 0.5 THEN 5 WHEN p >= 0.4 THEN 4 WHEN p >= 0.30000000000000004 THEN 3 WHEN p >= 0.2 THEN 2 WHEN p >= 0.1 THEN 1 ELSE 0 END AS INTEGER)"


@query("AGG30_reliability", f"SELECT CAST(b.i AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, rate FROM range(10) b(i) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n, round(avg(p), 7) AS mean_p, round(avg(y), 7) AS rate FROM scored GROUP BY 1) ON bin = i", "scored")
def agg30(spark, d):
    return _round(metrics.reliability(scored(spark, d)), 7, "mean_p", "rate")


_LABELS = "SELECT 'period' AS dimension, CASE WHEN period <= 4 THEN 'Q' || period ELSE 'OT' END AS bucket, * FROM scored UNION ALL SELECT 'time', CASE WHEN remaining <= 60 THEN '0-60' WHEN remaining <= 300 THEN '60-300' WHEN remaining <= 720 THEN '300-720' WHEN remaining <= 1440 THEN '720-1440' ELSE '1440-2880' END, * FROM scored UNION ALL SELECT 'margin', CASE WHEN abs(margin) <= 3 THEN '0-3' WHEN abs(margin) <= 8 THEN '4-8' WHEN abs(margin) <= 15 THEN '9-15' ELSE '16+' END, * FROM scored"
_TABLE = f"SELECT dimension, bucket, count(*) AS n, round(avg(p), 7) AS mean_p, round(avg(y), 7) AS rate, round(avg(p) - avg(y), 7) AS error, round(avg(brier), 7) AS brier, round(avg(log_loss), 7) AS log_loss FROM ({_LABELS}) GROUP BY 1, 2"


def _table(spark, d):
    t = metrics.breakdown(scored(spark, d), {"period": X.period_label(F.col("period")), "time": X.time_bucket(F.col("remaining")), "margin": X.margin_band(F.col("margin"))})
    return _round(t, 7, "mean_p", "rate", "error", "brier", "log_loss")


@query("AGG31_breakdown", _TABLE, "scored")
def agg31(spark, d):
    return _table(spark, d)


_OFF = "SELECT game_id, season, period, possession_number, margin, remaining, y, p, (p - y) * (p - y) AS brier, -CASE WHEN y = 1 THEN ln(p) ELSE ln(1.0 - p) END AS log_loss FROM (SELECT * REPLACE (p * {a} + {b} AS p) FROM scored)"


def _moved(spark, d, a: float, b: float) -> DataFrame:
    s = scored(spark, d).drop("brier", "log_loss")
    return metrics.scored(s.withColumn("p", F.col("p") * a + b))


def _broken(df: DataFrame) -> DataFrame:
    t = metrics.breakdown(df, {"period": X.period_label(F.col("period")), "time": X.time_bucket(F.col("remaining")), "margin": X.margin_band(F.col("margin"))})
    return _round(t, 7, "mean_p", "rate", "error", "brier", "log_loss")


def _off_table(a: float, b: float) -> str:
    return _TABLE.replace("FROM scored", f"FROM ({_OFF.format(a=f'CAST({a} AS DOUBLE)', b=f'CAST({b} AS DOUBLE)')})")


@query("AGG32_material", f"SELECT * FROM ({_off_table(0.5, 0.05)}) WHERE n >= 250 AND abs(error) > 0.1", "scored")
def agg32(spark, d):
    return metrics.material(_broken(_moved(spark, d, 0.5, 0.05)))


@query("AGG33_murphy", f"SELECT round(sum(n * (mp - my) ** 2) / max(t), 7) AS reliability, round(sum(n * (my - base) ** 2) / max(t), 7) AS resolution, round(max(base * (1 - base)), 7) AS uncertainty FROM (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY 1), (SELECT avg(y) AS base, count(*) AS t FROM scored)", "scored")
def agg33(spark, d):
    return _round(metrics.murphy(scored(spark, d)), 7, "reliability", "resolution", "uncertainty")


@query("JON22_subgroup_lift", f"SELECT c.dimension, c.bucket, c.n, c.brier AS brier_c, d.brier AS brier_d, round(d.brier - c.brier, 6) AS gain FROM ({_off_table(0.8, 0.1)}) c JOIN ({_TABLE}) d USING (dimension, bucket)", "scored")
def jon22(spark, d):
    return metrics.subgroup_lift(_broken(_moved(spark, d, 0.8, 0.1)), _table(spark, d)).withColumn("gain", F.round("gain", 6))


@query("BST01_game_sums", "SELECT game_id, count(*) AS n, round(sum(brier), 7) AS brier, round(sum(log_loss), 7) AS log_loss FROM scored GROUP BY 1", "scored")
def bst01(spark, d):
    return _round(metrics.game_sums(scored(spark, d)), 7, "brier", "log_loss")


@query("BST02_BST03_BST05_paired_bootstrap", None)
def bst02(spark, d):
    s = scored(spark, d)
    base = metrics.scored(s.drop("brier", "log_loss").withColumn("p", F.lit(0.5)))
    r = metrics.paired_bootstrap(metrics.game_sums(s), metrics.game_sums(base))
    return spark.createDataFrame([(k, v["point"], v["low"], v["high"]) for k, v in r.items()], "statistic string, point double, low double, high double")


@query("MKT01_MKT02_MKT05_compare", "SELECT count(*) AS games, round(avg((p - y) ** 2), 7) AS model_brier, round(avg((q - y) ** 2), 7) AS market_brier, round(corr(p, q), 4) AS correlation FROM (SELECT y, p, CAST(CAST(substr(game_id, 6) AS BIGINT) * 37 % 89 + 5 AS DOUBLE) / 99 AS q FROM scored)", "scored")
def mkt01(spark, d):
    c = pregame.compare(scored(spark, d).select("y", F.col("p").alias("p_model"), ((F.substring("game_id", 6, 20).cast("long") * 37 % 89 + 5).cast("double") / 99.0).alias("market_home_prob")))
    return c.select("games", F.round("model_brier", 7).alias("model_brier"), F.round("market_brier", 7).alias("market_brier"), F.round("correlation", 4).alias("correlation"))


@query("AGG35_standardise", "SELECT round(avg(margin), 8) AS m0, round(stddev_pop(margin), 8) AS s0 FROM scored", "scored")
def agg35(spark, d):
    st = logistic.Standard.of(scored(spark, d), ["margin"])
    return spark.createDataFrame([(round(st.means[0], 8), round(st.stds[0], 8))], "m0 double, s0 double")


# --- design and gram -----------------------------------------------------------------------------


_ROWS = "SELECT concat_ws('|', game_id, period, possession_number) AS row_id, game_id, season, offense_five, defense_five, offense_team_id = home_team_id AS home, points FROM state"
_COUNTS = "SELECT season, pid AS player_id, count(*) AS n FROM (SELECT season, unnest(list_concat(offense_five, defense_five)) AS pid FROM poss) GROUP BY 1, 2"
_COLS = f"WITH ct AS ({_COUNTS}), l AS (SELECT season, 0 AS kind, player_id, side FROM ct, (VALUES ('O'), ('D')) s(side) WHERE n >= 20 UNION ALL SELECT DISTINCT season, 1, CAST(NULL AS BIGINT), side FROM ct, (VALUES ('O'), ('D')) s(side)), o AS (SELECT *, CAST(row_number() OVER (ORDER BY season, kind, player_id NULLS FIRST, side DESC) - 1 AS INTEGER) AS column_id FROM l) SELECT season, kind, player_id, side, column_id, TRUE AS penalised FROM o UNION ALL SELECT NULL, 2, NULL, 'H', max(column_id) + 1, FALSE FROM o"
_ENTRIES = f"WITH r AS ({_ROWS}), cl AS ({_COLS}), e AS (SELECT row_id, season, 'O' AS side, unnest(offense_five) AS player_id FROM r UNION ALL SELECT row_id, season, 'D', unnest(defense_five) FROM r) SELECT row_id, column_id, CAST(sum(v) AS DOUBLE) AS value FROM (SELECT row_id, coalesce(a.column_id, b.column_id) AS column_id, 1.0 AS v FROM e LEFT JOIN (SELECT * FROM cl WHERE kind = 0) a ON a.season = e.season AND a.player_id = e.player_id AND a.side = e.side JOIN (SELECT * FROM cl WHERE kind = 1) b ON b.season = e.season AND b.side = e.side UNION ALL SELECT row_id, column_id, 1.0 FROM r, cl WHERE home AND kind = 2) GROUP BY 1, 2"


@query("AGG21_floor_counts", _COUNTS, "poss")
def agg21(spark, d):
    return linalg.floor_counts(S.poss(spark, d))


def _cols(spark, d):
    return linalg.columns(linalg.floor_counts(S.poss(spark, d)), least=20)


@query("MLR01_columns", _COLS, "poss")
def mlr01(spark, d):
    return _cols(spark, d)


@query("ARR05_MLR02_SRC12_design", _ENTRIES, "state")
def mlr02(spark, d):
    # both are read several times: the columns three times, the rows for the layout and the entries
    rows = sinks.written(design_rows(spark, d), "design-rows")
    return linalg.design(rows, sinks.written(linalg.columns(linalg.floor_counts(rows), least=20), "design-columns"), parts=S.parts(spark, d, "lineitem"))


@query("MLR06_gram", f"WITH x AS ({_ENTRIES}) SELECT a.column_id AS i, b.column_id AS j, sum(a.value * b.value) AS value FROM x a JOIN x b ON a.row_id = b.row_id AND a.column_id <= b.column_id GROUP BY 1, 2", "state")
def mlr06(spark, d):
    return linalg.gram(mlr02(spark, d))


@query("MLR06_moment", f"WITH x AS ({_ENTRIES}), r AS ({_ROWS}) SELECT column_id AS i, sum(value * points) AS value FROM x JOIN r USING (row_id) GROUP BY 1", "state")
def mlr06b(spark, d):
    return linalg.moment(mlr02(spark, d), design_rows(spark, d).select("row_id", F.col("points").alias("y")))


@query("MLR06_embedding_gram", "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS value FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2")
def mlr06c(spark, d):
    e = S._t(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("column_id", "v")).select("row_id", F.col("column_id").cast("long").alias("column_id"), F.col("v").cast("double").alias("value"))
    return linalg.gram(e).withColumn("value", F.round("value", 6))


@query("MLR09_AGG22_indicator_means", f"WITH x AS ({_ENTRIES}), r AS ({_ROWS}) SELECT column_id, count(*) AS n, round(avg(points), 9) AS mean_y FROM x JOIN r USING (row_id) GROUP BY 1", "state")
def mlr09(spark, d):
    return linalg.indicator_means(mlr02(spark, d), design_rows(spark, d).select("row_id", F.col("points").alias("y"))).withColumn("mean_y", F.round("mean_y", 9))


@query("MLR10_AGG23_team_means", "SELECT t AS team_id, round(coalesce(m, o), 9) AS mean_points FROM (SELECT DISTINCT home_team_id AS t FROM games0 UNION SELECT 999) LEFT JOIN (SELECT offense_team_id, avg(points) AS m FROM poss GROUP BY 1) ON t = offense_team_id, (SELECT avg(points) AS o FROM poss)", "poss")
def mlr10(spark, d):
    t = S.games0(spark, d).select(F.col("home_team_id").alias("team_id")).distinct().union(spark.range(999, 1000))
    return linalg.team_means(S.poss(spark, d), t).withColumn("mean_points", F.round("mean_points", 9))


@query("MLR12_predict", f"WITH x AS ({_ENTRIES}) SELECT row_id, round(sum(value * (column_id % 7 - 3) / 10.0), 9) AS prediction FROM x GROUP BY 1", "state")
def mlr12(spark, d):
    beta = _cols(spark, d).select("column_id", ((F.col("column_id") % 7 - 3) / 10.0).alias("beta"))
    return linalg.predict(mlr02(spark, d), beta).withColumn("prediction", F.round("prediction", 9))


@query("MLR11_ratings_per_100", f"WITH c AS ({_COLS}), b AS (SELECT *, (column_id % 7 - 3) / 10.0 AS beta FROM c WHERE kind = 0), ct AS ({_COUNTS}) SELECT player_id, season, round(o, 9) AS off_rating, round(d, 9) AS def_rating, round(o - d, 9) AS net_rating, n AS n_possessions FROM (SELECT player_id, season, max(CASE WHEN side = 'O' THEN beta END) * 100.0 AS o, max(CASE WHEN side = 'D' THEN beta END) * 100.0 AS d FROM b GROUP BY 1, 2) JOIN ct USING (player_id, season)", "poss")
def mlr11(spark, d):
    cols = _cols(spark, d)
    beta = cols.select("column_id", ((F.col("column_id") % 7 - 3) / 10.0).alias("beta"))
    return _round(linalg.ratings_per_100(cols, beta, linalg.floor_counts(S.poss(spark, d))), 9, "off_rating", "def_rating", "net_rating")


@query("AGG19_game_margin", f"SELECT game_id, CAST(sum(CASE WHEN home THEN points ELSE -points END) AS BIGINT) AS margin FROM ({_ROWS}) GROUP BY 1", "state")
def agg19(spark, d):
    return linalg.game_margin(design_rows(spark, d))


@query("AGG20_margin_rmse", f"WITH m AS (SELECT game_id, sum(CASE WHEN home THEN points ELSE -points END) AS margin FROM ({_ROWS}) GROUP BY 1) SELECT count(*) AS games, round(sqrt(avg((margin - 1.5) ** 2)), 8) AS rmse FROM m", "state")
def agg20(spark, d):
    m = linalg.game_margin(design_rows(spark, d))
    return linalg.margin_rmse(m, m.select("game_id", F.lit(1.5).alias("margin")))


@query("BAY04_game_weights", f"WITH x AS ({_ENTRIES}), r AS ({_ROWS}) SELECT game_id, column_id, CAST(sum(CASE WHEN home THEN value ELSE -value END) AS DOUBLE) AS value FROM x JOIN r USING (row_id) GROUP BY 1, 2", "state")
def bay04(spark, d):
    return linalg.game_weights(mlr02(spark, d), design_rows(spark, d).select("row_id", "game_id", "home"))


@query("BAY02_residual_variance", f"WITH x AS ({_ENTRIES}), r AS ({_ROWS}), p AS (SELECT row_id, sum(value * (column_id % 7 - 3) / 10.0) AS p FROM x GROUP BY 1) SELECT round(sum((points - p) ** 2), 5) AS rss, count(*) AS rows FROM r JOIN p USING (row_id)", "state")
def bay02(spark, d):
    beta = _cols(spark, d).select("column_id", ((F.col("column_id") % 7 - 3) / 10.0).alias("beta"))
    y = design_rows(spark, d).select("row_id", F.col("points").alias("y"))
    return linalg.residual_variance(y, linalg.predict(mlr02(spark, d), beta)).withColumn("rss", F.round("rss", 5))


@query("BAY07_coverage", "SELECT level, round(avg(CASE WHEN v BETWEEN -level AND level THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM (SELECT (p_partkey % 201 - 100) / 100.0 AS v FROM part), (VALUES (0.5), (0.8), (0.9), (0.95)) l(level) GROUP BY 1")
def bay07(spark, d):
    v = S._t(spark, d, "part").select(((F.col("p_partkey") % 201 - 100) / 100.0).alias("y"))
    lv = spark.createDataFrame([(0.5,), (0.8,), (0.9,), (0.95,)], "level double")
    return linalg.coverage_frame(v.crossJoin(lv).select("level", "y", (-F.col("level")).alias("low"), F.col("level").alias("high"))).withColumn("coverage", F.round("coverage", 9))


ORACLES["BAY07_coverage"] = "SELECT CAST(level AS DOUBLE) AS level, round(avg(CASE WHEN v BETWEEN -CAST(level AS DOUBLE) AND CAST(level AS DOUBLE) THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM (SELECT CAST(p_partkey % 201 - 100 AS DOUBLE) / 100 AS v FROM part), (VALUES (0.5), (0.8), (0.9), (0.95)) l(level) GROUP BY 1"


@query("AGG38_tercile_widths", "SELECT tercile, count(*) AS players, round(avg(w), 8) AS mean_width FROM (SELECT CAST(ntile(3) OVER (ORDER BY n_possessions, player_id, season) AS INTEGER) AS tercile, 2 + abs(net_rating) AS w FROM ratings) GROUP BY 1", "ratings")
def agg38(spark, d):
    r = S.ratings(spark, d).withColumn("net_ci_high", 2 + F.abs("net_rating")).withColumn("net_ci_low", F.lit(0.0))
    return linalg.tercile_widths(r)


@query("MLR03_folds", None)
def mlr03(spark, d):
    return linalg.folds(S.games0(spark, d), k=5, seed=20)


@query("BAY08_simulation_calibration", None)
def bay08(spark, d):
    g = mlr06c(spark, d).toPandas()  # columns x columns
    a = np.zeros((int(g["j"].max()) + 1,) * 2) if len(g) else np.zeros((0, 0))
    a[g["i"], g["j"]] = a[g["j"], g["i"]] = g["value"]
    return linalg.simulation_calibration(spark, a, 5.0, 1.0)


# --- models --------------------------------------------------------------------------------------


def _model_frame(spark, d) -> DataFrame:
    e = S._t(spark, d, "embeddings")
    split = F.expr("case when vec_id % 5 < 3 then 'train' when vec_id % 5 = 3 then 'validation' else 'test' end")
    return e.select(F.col("vec_id").alias("row"), (F.col("vec_id") % 97).alias("game_id"), split.alias("split"), (F.col("label") < 5).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(4)])


FEATURES = [f"x{i}" for i in range(4)]


@query("LOG02_LOG03_LOG04_select_and_fit", None)
def log03(spark, d):
    df = _model_frame(spark, d)
    m, _ = logistic.select_and_fit(df, FEATURES)
    return df.where("split = 'test'").select("row", F.round(m.predict(), 6).alias("p"))


@query("LOG01_feature_columns", "SELECT game_id, period, possession_number, CAST(home_score_differential AS DOUBLE) AS margin, round(home_score_differential / sqrt(regulation_seconds_remaining + 1.0), 8) AS margin_over_sqrt_time, greatest(0.0, 180.0 - regulation_seconds_remaining) AS hinge_180, CAST(season = 2023 AS DOUBLE) AS season_2023, CAST(starts_with(game_id, '004') AS DOUBLE) AS playoff FROM mart", "mart")
def log01(spark, d):
    f = logistic.feature_columns([2022, 2023])
    m = mart(spark, d)
    return m.select("game_id", "period", "possession_number", f["margin"].alias("margin"), F.round(f["margin_over_sqrt_time"], 8).alias("margin_over_sqrt_time"), f["hinge_180"].alias("hinge_180"), f["season_2023"].alias("season_2023"), f["playoff"].alias("playoff"))


@query("LOG06_calibration", None)
def log06(spark, d):
    a, b = logistic.calibration(scored(spark, d).select("y", "p"))
    return spark.createDataFrame([(a, b)], "intercept double, slope double")


@query("LOG09_orthogonality", None)
def log09(spark, d):
    # 89 x 83 x 2 groups at most, whatever the rows
    r = F.col("p_partkey").cast("long")
    p, q = (r % 89 + 5) / 99.0, (r * 7 % 83 + 8) / 99.0
    t = S._t(spark, d, "part").select(p.alias("p"), q.alias("q"), ((r * 31 % 97) / 97.0 < p).cast("double").alias("y"))
    g = t.groupBy("p", "q", "y").count().toPandas().to_numpy(dtype=float)
    b = logistic.orthogonality(*g.T)
    return spark.createDataFrame([tuple(float(x) for x in b)], "intercept double, market double, model double")


@query("AGG41_GBM01_bin_edges", "SELECT 'x0' AS feature, quantile_cont(x, q) AS edge FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), (VALUES (0.25), (0.5), (0.75)) t(q) GROUP BY q")
def agg41(spark, d):
    e = boost.bin_edges(_model_frame(spark, d), ["x0"], 4)
    return spark.createDataFrame([("x0", x) for x in e["x0"]], "feature string, edge double").withColumn("edge", F.round("edge", 9))


ORACLES["AGG41_GBM01_bin_edges"] = "SELECT 'x0' AS feature, round(unnest([quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75)]), 9) AS edge FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)"


@query("AGG42_histograms", "SELECT CAST(vec_id % 2 AS INTEGER) AS node, 'f' AS feature, CAST(vec_id % 7 AS INTEGER) AS bin, round(sum(label / 10.0), 8) AS g, round(sum(0.25), 8) AS h, count(*) AS n FROM embeddings GROUP BY 1, 3")
def agg42(spark, d):
    b = S._t(spark, d, "embeddings").select((F.col("vec_id") % 2).cast("int").alias("node"), (F.col("label") / 10.0).alias("g"), F.lit(0.25).alias("h"), (F.col("vec_id") % 7).cast("int").alias("bin_f"))
    return _round(boost.histograms(b, ["f"]), 8, "g", "h")


ORACLES["AGG42_histograms"] = ORACLES["AGG42_histograms"].replace("round(sum(label / 10.0), 8)", "round(sum(CAST(label AS DOUBLE) / 10), 8)").replace("round(sum(0.25), 8)", "round(sum(CAST(0.25 AS DOUBLE)), 8)")


@query("GBM02_GBM03_GBM04_GBM05_GBM06_GBM07_GBM08_boosting", None)
def gbm06(spark, d):
    df = _model_frame(spark, d)
    m, losses = boost.fit(df.where("split = 'train'"), FEATURES, boost.Config(rate=0.3, depth=2, bins=64, least_rows=20), validation=df.where("split = 'validation'"), patience=5)
    return df.where("split = 'test'").select("row", m.truncated(int(np.argmin(losses)) + 1).predict().alias("p"))


@query("MLR04_MLR05_penalties", f"SELECT column_id, CASE WHEN penalised THEN 100.0 ELSE 0.0 END AS penalty FROM ({_COLS})", "poss")
def mlr04(spark, d):
    cols = _cols(spark, d)
    laid = cols.orderBy("column_id").select("column_id", "penalised").collect()  # thousands of columns at most
    return spark.createDataFrame([(r[0], float(x)) for r, x in zip(laid, linalg.penalty(np.array([r[1] for r in laid]), 100.0))], "column_id int, penalty double")


ORACLES["MLR04_MLR05_penalties"] = S.sql(f"SELECT column_id, CAST(CASE WHEN penalised THEN 100 ELSE 0 END AS DOUBLE) AS penalty FROM ({_COLS})", "poss")


@query("BAY10_decayed_gram", "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT a.i, b.i AS j, round(sum(a.v * b.v * pow(CAST(0.5 AS DOUBLE), CAST(a.vec_id % 120 AS DOUBLE) / 60)), 6) AS value FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2")
def bay10(spark, d):
    t = S._t(spark, d, "embeddings")
    e = t.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("column_id", "v")).select("row_id", F.col("column_id").cast("long").alias("column_id"), F.col("v").cast("double").alias("value"))
    return linalg.decayed_gram(e, t.select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 120).alias("days"))).withColumn("value", F.round("value", 6))
