"""Quality gates: queries that must return no row, and the frames that run many at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["game_id", "period", "possession_number"]


def not_null(df: DataFrame, column: str) -> DataFrame:
    """GAT01."""
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """GAT01, GAT06, AGG10: keys that occur more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n <> 1")


def accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    """GAT01."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values))


def related(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """GAT01, JON10: rows without a counterpart."""
    return df.where(F.col(column).isNotNull()).join(other.select(F.col(other_column).alias("__k")).distinct(), F.col(column) == F.col("__k"), "left_anti")


def row_count(df: DataFrame, expected: int) -> DataFrame:
    """GAT02, AGG09: the count, if it isn't the expected one."""
    return df.agg(F.count("*").alias("n")).where(F.col("n") != expected)


def lineup_of_five(stint_rows: DataFrame, poss: DataFrame) -> DataFrame:
    """GAT03, SET05: lineups of another size at three grains."""
    a = stint_rows.select("game_id", "period", F.lit("stint").alias("grain"), F.size("five").alias("lineup_size"))
    # both fives of a possession in one scan
    b = poss.select("game_id", "period", F.explode(F.array(F.struct(F.lit("possession_offense").alias("grain"), F.size("offense_five").alias("lineup_size")), F.struct(F.lit("possession_defense").alias("grain"), F.size("defense_five").alias("lineup_size")))).alias("x")).select("game_id", "period", "x.*")
    return a.unionByName(b).where("lineup_size <> 5")


def minutes_tolerance(minutes: DataFrame, tolerance: float, most: float) -> DataFrame:
    """GAT04: one row if too large a share is off."""
    over = F.sum((F.abs("residual_seconds") > tolerance).cast("int"))
    g = minutes.agg(F.count("*").alias("player_games"), over.alias("over_tolerance_count"))
    return g.withColumn("over_tolerance_fraction", F.col("over_tolerance_count") / F.nullif("player_games", F.lit(0))).where(F.col("over_tolerance_fraction") > most)


def bad_state(cold: str = "cold_start") -> Column:
    """GAT07: the first rule a state breaks, or null."""
    c = F.col
    return (
        F.when((F.size("home_five") != 5) | (F.size("away_five") != 5), "lineup_not_five")
        .when(c("home_has_possession") != (c("possession_team_id") == c("home_team_id")), "possession_flag_mismatch")
        .when(c("game_clock_seconds") < 0, "negative_game_clock")
        .when((c("period") <= 4) & (c("game_clock_seconds") > 720), "invalid_game_clock")
        .when((c("period") > 4) & (c("game_clock_seconds") > 300), "invalid_ot_clock")
        .when(c("elapsed_game_seconds") < 0, "negative_elapsed_time")
        .when(c("regulation_seconds_remaining") != F.greatest(F.lit(0.0), 2880.0 - c("elapsed_game_seconds")), "regulation_clock_mismatch")
        .when(c("rapm_coverage_status").isNull(), "missing_coverage_status")
        .when((c("rapm_coverage_status") != cold) & (c("rapm_source_season") != c("season") - 1), "rapm_source_not_prior_season")
    )


def not_monotone(states: DataFrame) -> DataFrame:
    """GAT08, WIN02-03: scores or time going back."""
    w = Window.partitionBy("game_id").orderBy("period", "possession_number")
    cols = ("home_score", "away_score", "elapsed_game_seconds")
    s = states.select(*KEY, *cols, *[F.lag(k).over(w).alias(f"was_{k}") for k in cols])
    return s.where(reduce(lambda a, b: a | b, [F.col(k) < F.col(f"was_{k}") for k in cols])).select(*KEY)


def split_leakage(states: DataFrame) -> DataFrame:
    """GAT09, AGG11: games in more than one split."""
    return states.groupBy("game_id").agg(F.countDistinct("split").alias("n"), F.min("period").alias("period"), F.min("possession_number").alias("possession_number")).where("n <> 1").select(*KEY)


def coverage(poss: DataFrame, states: DataFrame) -> DataFrame:
    """GAT10, JON08: keys on one side only."""
    a, b = poss.select(*KEY, F.lit(1).alias("a")), states.select(*KEY, F.lit(1).alias("b"))
    return a.join(b, KEY, "full_outer").where("a is null or b is null").select(*KEY)


def final_mismatch(states: DataFrame, poss: DataFrame, games: DataFrame) -> DataFrame:
    """GAT11, JON09, AGG12: final score or winner that the possessions don't give."""
    s = states.select(*KEY, "home_win").join(poss.select(*KEY, "offense_team_id", "points"), KEY).join(games.select("game_id", "home_team_id", "away_team_id", "home_final_score", "away_final_score"), "game_id")
    points = lambda t: F.sum(F.when(F.col("offense_team_id") == F.col(t), F.col("points")).otherwise(0))
    g = s.groupBy("game_id").agg(points("home_team_id").alias("h"), points("away_team_id").alias("a"), F.max("home_final_score").alias("fh"), F.max("away_final_score").alias("fa"), F.max(F.col("home_win").cast("int")).alias("won"))
    return g.where((F.col("h") != F.col("fh")) | (F.col("a") != F.col("fa")) | (F.col("won") != (F.col("fh") > F.col("fa")).cast("int"))).select("game_id", F.lit(0).alias("period"), F.lit(0).alias("possession_number"))


def state_gates(states: DataFrame, poss: DataFrame, games: DataFrame) -> DataFrame:
    """SET05: every violation of GAT06-11 with its reason."""
    tag = lambda d, why: d.select(*KEY, F.lit(why).alias("reason"))
    parts = [
        tag(unique(states, *KEY), "duplicate_key"),
        states.withColumn("reason", bad_state()).where("reason is not null").select(*KEY, "reason"),
        tag(not_monotone(states), "state_not_monotonic"),
        tag(split_leakage(states), "game_spans_splits"),
        tag(coverage(poss, states), "possession_coverage_mismatch"),
        tag(final_mismatch(states, poss, games), "final_score_or_winner_mismatch"),
    ]
    return reduce(DataFrame.unionByName, parts)


def failures(gates: dict[str, DataFrame]) -> DataFrame:
    """GAT12: failures by gate, zeros included, from one job: a union and one aggregation."""
    parts = [d.select(F.lit(name).alias("gate"), F.lit(1).alias("bad")) for name, d in gates.items()]
    spark = next(iter(gates.values())).sparkSession
    names = spark.createDataFrame([(n, 0) for n in gates], "gate string, bad int")
    return reduce(DataFrame.unionByName, parts, names).groupBy("gate").agg(F.sum("bad").alias("failures"))


def ten_gates(states: DataFrame, poss: DataFrame, games: DataFrame) -> DataFrame:
    """GAT12: (gate, failures) of the ten checks of the state mart.

    States and possessions meet once, with their game; row rules, both window rules and the game
    rules are then counted over that one partitioning, as sums by game and by gate.
    """
    c = F.col
    p = poss.select(*KEY, c("offense_team_id").alias("p_offense"), c("points").alias("p_points"), F.lit(1).alias("in_poss"))
    s = states.groupBy(*KEY).agg(F.count("*").alias("copies"), *[F.first(k).alias(k) for k in states.columns if k not in KEY])
    j = s.withColumn("in_states", F.lit(1)).join(p, KEY, "full_outer")
    g = games.select("game_id", c("home_team_id").alias("g_home"), c("away_team_id").alias("g_away"), c("home_final_score").alias("g_fh"), c("away_final_score").alias("g_fa"))
    j = j.join(g, "game_id", "left")
    w = Window.partitionBy("game_id").orderBy("period", "possession_number")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    points = lambda t: F.when(c("in_states").isNotNull() & (c("p_offense") == c(t)), c("p_points")).otherwise(0)
    j = j.withColumns({f"was_{k}": F.lag(k).over(w) for k in ("home_score", "away_score", "elapsed_game_seconds")} | {"exp_home": F.coalesce(F.sum(points("g_home")).over(before), F.lit(0)), "exp_away": F.coalesce(F.sum(points("g_away")).over(before), F.lit(0))})
    is_state, both = c("in_states").isNotNull(), c("in_states").isNotNull() & c("in_poss").isNotNull()
    rows = {
        "unique_key": c("copies") > 1,
        "lineups_of_five": is_state & ((F.size("home_five") != 5) | (F.size("away_five") != 5)),
        "possession_coverage": c("in_states").isNull() | c("in_poss").isNull(),
        "possession_flag": is_state & (c("home_has_possession") != (c("possession_team_id") == c("home_team_id"))),
        "score_and_time_monotonic": is_state & ((c("home_score") < c("was_home_score")) | (c("away_score") < c("was_away_score")) | (c("elapsed_game_seconds") < c("was_elapsed_game_seconds"))),
        "clock_consistent": is_state & ((c("game_clock_seconds") < 0) | (c("game_clock_seconds") > F.when(c("period") <= 4, 720).otherwise(300)) | (c("regulation_seconds_remaining") != F.greatest(F.lit(0.0), 2880.0 - c("elapsed_game_seconds")))),
        "score_before_possession": both & ((c("home_score") != c("exp_home")) | (c("away_score") != c("exp_away"))),
        "rating_strictly_prior": is_state & (c("rapm_coverage_status").isNull() | ((c("rapm_coverage_status") != "cold_start") & (c("rapm_source_season").isNull() | (c("rapm_source_season") != c("season") - 1)))),
    }
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    by_game = j.groupBy("game_id").agg(
        *[count(cond).alias(k) for k, cond in rows.items()],
        (F.sum(points("g_home")) != F.max("g_fh")).alias("fh"), (F.sum(points("g_away")) != F.max("g_fa")).alias("fa"),
        (F.max(c("home_win").cast("int")) != F.max((c("g_fh") > c("g_fa")).cast("int"))).alias("won"),
        F.countDistinct("split").alias("splits"), F.count_if(both).alias("matched"), F.count_if(is_state).alias("states"),
    )
    names = [*rows, "final_score_and_winner", "one_split_a_game"]
    by_game = by_game.withColumns({"final_score_and_winner": F.when((c("matched") > 0) & (c("fh") | c("fa") | c("won")), 1).otherwise(0), "one_split_a_game": F.when((c("states") > 0) & (c("splits") != 1), 1).otherwise(0)})
    total = by_game.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return total.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), c(n).alias("failures")) for n in names])).alias("x")).select("x.*")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET07, GAT13: keys of one side only, with the side."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right_only")))


def rating_not_prior(states: DataFrame) -> DataFrame:
    """GAT22."""
    return states.where(F.col("rapm_source_season").isNotNull() & (F.col("rapm_source_season") >= F.col("season")))


# --- booleans over small summaries (driver) ----------------------------------------------------


def passed(gates: dict[str, bool], structural: set[str]) -> dict:
    """GAT14-21: what a verdict needs: all gates, those that are structural, and both outcomes."""
    return {"gates": gates, "structural_pass": all(gates[k] for k in structural), "pass": all(gates.values()), "failed": sorted(k for k, ok in gates.items() if not ok)}


def model_gates(m: dict) -> dict[str, bool]:
    """GAT14: better than both baselines, calibrated, and no leakage."""
    return {
        "brier_beats_base_rate": m["brier"] < m["base_rate_brier"],
        "brier_beats_score_time": m["brier"] <= m["score_time_brier"],
        "log_loss_beats_base_rate": m["log_loss"] < m["base_rate_log_loss"],
        "log_loss_beats_score_time": m["log_loss"] <= m["score_time_log_loss"],
        "calibration_slope": 0.8 <= m["calibration_slope"] <= 1.2,
        "no_material_miscalibration": m["material_buckets"] == 0,
    }


def posterior_gates(coverage_90: float, sbc: float, rmse: float, ridge_rmse: float) -> dict[str, bool]:
    """GAT21."""
    return {"coverage_90": 0.85 <= coverage_90 <= 0.95, "sbc": 0.88 <= sbc <= 0.92, "rmse": rmse <= ridge_rmse + 1e-6}


CALIBRATION = {"intercept": 0.1, "slope_low": 0.9, "slope_high": 1.1}


def calibrated(intercept: float, slope: float, bounds: dict[str, float] = CALIBRATION) -> bool:
    """Intercept near 0 and slope near 1."""
    return abs(intercept) < bounds["intercept"] and bounds["slope_low"] <= slope <= bounds["slope_high"]


def inside(*forecasts: dict) -> bool:
    """Every forecast strictly between 0 and 1 (each has ``p_min`` and ``p_max``)."""
    return all(0.0 < f["p_min"] and f["p_max"] < 1.0 for f in forecasts)


#: The gates whose failure is a defect; the others report a finding.
STRUCTURAL = {
    "ablation": {"predictions_inside", "late_calibration_kept", "ratings_prior"},
    "challenger": {"predictions_inside", "holdout_untouched", "ratings_prior"},
    "market": {"predictions_inside"},
    "ladder": {"predictions_inside", "test_untouched"},
    "injury": {"predictions_inside", "test_untouched"},
    "prediction_market": {"predictions_inside", "prices_before_tip", "test_only"},
}


def ablation_gates(tiers: dict[str, dict], d_minus_c: dict[str, float], rolling: list[float], prior_violations: int, tolerance: float = 0.01) -> dict[str, bool]:
    """GAT15. ``tiers``: p_min, p_max, late_error of each; ``d_minus_c``: upper bounds brier_high, log_loss_high."""
    return {
        "predictions_inside": inside(*tiers.values()),
        "late_calibration_kept": abs(tiers["D"]["late_error"]) <= abs(tiers["C"]["late_error"]) + tolerance,
        "ratings_prior": prior_violations == 0,
        "lineups_beat_teams": min(d_minus_c["brier_high"], d_minus_c["log_loss_high"]) < 0.0,
        "rolling_reproduces": bool(rolling) and all(x < 0.0 for x in rolling),
    }


def challenger_gates(trees: dict, linear: dict, difference: dict[str, float], splits: set[str], prior_violations: int, material_buckets: int) -> dict[str, bool]:
    """GAT16. ``trees`` has intercept and slope too."""
    return {
        "predictions_inside": inside(trees, linear),
        "holdout_untouched": splits <= {"train", "validation"},
        "ratings_prior": prior_violations == 0,
        "trees_beat_linear": min(difference["brier_high"], difference["log_loss_high"]) < 0.0,
        "trees_calibrated": calibrated(trees["intercept"], trees["slope"]),
        "no_material_miscalibration": material_buckets == 0,
    }


def market_gates(model: dict, market: dict) -> dict[str, bool]:
    """GAT17: beating the market is not asked for."""
    return {"model_calibrated": calibrated(model["intercept"], model["slope"]), "predictions_inside": inside(model, market)}


def ladder_gates(tiers: dict[str, dict], top: str, finding: str, high: float) -> dict[str, bool]:
    """GAT18 (top P3, finding form_beats_prior_strength), GAT19 (top P4, finding availability_beats_form)."""
    return {
        "predictions_inside": inside(*tiers.values()),
        "test_untouched": all(set(t["splits"]) == {"train", "validation"} for t in tiers.values()),
        finding: high < 0.0,
        "top_calibrated": calibrated(tiers[top]["intercept"], tiers[top]["slope"]),
    }


def prediction_market_gates(model: dict, market: dict, gap_min: float, gap_max: float, other_splits: int, most: float = 86_400.0) -> dict[str, bool]:
    """GAT20: as GAT17, prices from before the start only and not older than a day, test season only."""
    return market_gates(model, market) | {"prices_before_tip": 0.0 < gap_min and gap_max <= most, "test_only": other_splits == 0}
