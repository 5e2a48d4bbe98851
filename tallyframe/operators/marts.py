"""Staging and mart operators: typed tables from nested documents, the state mart, validations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import exprs as X

POSSESSION_ORDER = ("period", "possession_number")


# --- staging -----------------------------------------------------------------------------------


def dim_games(box: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """PRJ01-03, JON01: one row a game from the traditional box document."""
    b = F.col("boxScoreTraditional")
    g = box.select(
        b["gameId"].alias("game_id"),
        X.season_of(b["gameId"]).alias("season"),
        X.season_type_of(b["gameId"]).alias("season_type"),
        b["homeTeamId"].alias("home_team_id"),
        b["awayTeamId"].alias("away_team_id"),
        b["homeTeam"]["statistics"]["points"].cast("int").alias("home_final_score"),
        b["awayTeam"]["statistics"]["points"].cast("int").alias("away_final_score"),
    )
    if dates is None:
        return g.withColumn("game_date", F.lit(None).cast("date"))
    return g.join(dates.select("game_id", X.first_ten_date(F.col("game_date")).alias("game_date")), "game_id", "left")


def stg_actions(pbp: DataFrame) -> DataFrame:
    """ARR01: actions in array order, typed."""
    a = pbp.select(F.col("game.gameId").alias("game_id"), F.posexplode("game.actions").alias("ord", "a"))
    c = lambda k: F.col(f"a.{k}")
    return a.select(
        "game_id", "ord", c("actionNumber").alias("action_number"), c("period").alias("period"), c("clock").alias("clock_raw"),
        X.clock_remaining(c("clock")).alias("seconds_remaining"),
        F.nullif(c("teamId"), F.lit(0)).alias("team_id"), F.nullif(c("personId"), F.lit(0)).alias("person_id"),
        X.blank_to_null(c("playerName")).alias("player_name"), c("actionType").alias("action_type"), X.blank_to_null(c("subType")).alias("sub_type"),
        c("description").alias("description"), X.blank_to_null(c("shotResult")).alias("shot_result"),
        c("isFieldGoal").cast("boolean").alias("is_field_goal"), c("shotValue").alias("shot_value"), c("pointsTotal").alias("points_total"),
        X.safe_int(c("scoreHome")).alias("score_home"), X.safe_int(c("scoreAway")).alias("score_away"),
    )


def _sides(doc: DataFrame, root: str, build) -> DataFrame:
    """SET01-03: both teams of a document by one scan: an exploded pair of structs."""
    r = F.col(root)
    pair = F.array(F.struct(r["homeTeam"].alias("team"), r["homeTeamId"].alias("team_id"), F.lit(True).alias("is_home")), F.struct(r["awayTeam"].alias("team"), r["awayTeamId"].alias("team_id"), F.lit(False).alias("is_home")))
    return build(doc.select(r["gameId"].alias("game_id"), F.explode(pair).alias("side")))


def stg_box_player(box: DataFrame) -> DataFrame:
    """ARR02, SET01: one row a player of either team."""

    def build(d: DataFrame) -> DataFrame:
        p = d.select("game_id", F.col("side.team_id").alias("team_id"), F.col("side.is_home").alias("is_home"), F.explode("side.team.players").alias("p"))
        s = lambda k: F.col(f"p.statistics.{k}")
        return p.select(
            "game_id", "team_id", F.col("p.personId").alias("person_id"), F.col("p.nameI").alias("player_name"), s("minutes").alias("minutes_raw"),
            X.box_seconds(s("minutes")).alias("minutes_seconds"), s("points").alias("points"), s("fieldGoalsAttempted").alias("fga"),
            s("freeThrowsAttempted").alias("fta"), s("reboundsOffensive").alias("oreb"), s("turnovers").alias("tov"), "is_home",
            X.zero_if_null(X.box_seconds(s("minutes"))).alias("box_seconds"),
        )

    return _sides(box, "boxScoreTraditional", build)


def stg_box_team_advanced(box: DataFrame) -> DataFrame:
    """SET02: one row a team."""
    s = lambda k: F.col(f"side.team.statistics.{k}").cast("double")
    return _sides(box, "boxScoreAdvanced", lambda d: d.select("game_id", F.col("side.team_id").alias("team_id"), s("possessions").alias("possessions"), s("pace").alias("pace"), s("offensiveRating").alias("offensive_rating"), F.col("side.is_home").alias("is_home")))


# --- the state mart ----------------------------------------------------------------------------


def with_games(poss: DataFrame, games: DataFrame) -> DataFrame:
    """JON02, PRJ24: possessions with their game and the fives by side."""
    g = games.select("game_id", "game_date", "home_team_id", "away_team_id", "home_final_score", "away_final_score")
    side = lambda t: X.side_five(F.col("offense_team_id"), F.col(t), F.col("offense_five"), F.col("defense_five"))
    return poss.join(g, "game_id").withColumns({"home_five": side("home_team_id"), "away_five": side("away_team_id")})


def with_score_before(p: DataFrame) -> DataFrame:
    """WIN01: both teams' points over the game's earlier possessions."""
    w = Window.partitionBy("game_id").orderBy(*POSSESSION_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    points = lambda t: F.coalesce(F.sum(F.when(F.col("offense_team_id") == F.col(t), F.col("points")).otherwise(0)).over(w), F.lit(0)).cast("int")
    return p.withColumns({"home_score": points("home_team_id"), "away_score": points("away_team_id")})


def lineup_strength(states: DataFrame, ratings: DataFrame) -> DataFrame:
    """ARR03, JON03, AGG04: for each possession, sums of both fives' ratings of the season before.

    Both fives are exploded with their side in one pass, without the state's other columns, and reduced in one
    hash aggregation where they are. Ratings, one a player and season, are some thousands of rows and
    broadcast, so that the exploded rows are neither shuffled nor sorted.
    """
    keys = ["game_id", *POSSESSION_ORDER]
    both = F.array(F.struct(F.lit("home").alias("side"), F.col("home_five").alias("five")), F.struct(F.lit("away").alias("side"), F.col("away_five").alias("five")))
    e = states.select(*keys, (F.col("season") - 1).alias("rating_season"), F.explode(both).alias("x")).select(*keys, "rating_season", F.col("x.side").alias("side"), F.explode("x.five").alias("player_id"))
    r = ratings.select(F.col("player_id").cast("long").alias("r_player"), F.col("season").cast("int").alias("r_season"), *[F.col(f"{k}_rating").cast("double").alias(k) for k in ("off", "def", "net")])
    j = e.join(F.broadcast(r), (F.col("r_player") == F.col("player_id")) & (F.col("r_season") == F.col("rating_season")), "left")
    out = []
    for s in ("home", "away"):
        mine = F.col("side") == s
        out.append(F.count(F.when(mine, F.col("r_player"))).alias(f"{s}_rated_players"))
        out += [F.round(F.sum(F.when(mine, F.coalesce(k, F.lit(0.0)))), 10).alias(f"{s}_lineup_{k}_rapm") for k in ("off", "def", "net")]
        out.append(F.count_if(mine).alias(f"{s}_members"))
    return j.groupBy(*keys).agg(*out).where("home_members > 0 and away_members > 0").drop("home_members", "away_members")


def game_states(poss: DataFrame, games: DataFrame, ratings: DataFrame, *, cold_season: int = 2021) -> DataFrame:
    """The flagship: the state of a game before each possession, from earlier points and ratings of
    the season before only.

    Lineups are reduced by themselves and joined by possession: with possessions partitioned by game, both sides
    stay in that partitioning, and the exploded rows carry nothing of the state.
    """
    p = with_games(poss, games)
    strength = lineup_strength(p, ratings)
    elapsed = X.cumulative_elapsed(F.col("start_seconds"), F.col("period"))
    s = with_score_before(p).withColumns({"game_clock_seconds": X.game_clock(F.col("start_seconds"), F.col("period")), "elapsed_game_seconds": elapsed, "split": X.split_of(F.col("season"))})
    j = s.join(strength, ["game_id", *POSSESSION_ORDER])
    cold = F.col("season") == cold_season
    return j.select(
        "game_id", "season", "game_date", "period", "possession_number", "game_clock_seconds", "elapsed_game_seconds",
        X.regulation_remaining(F.col("elapsed_game_seconds")).alias("regulation_seconds_remaining"),
        "home_team_id", "away_team_id", F.col("offense_team_id").alias("possession_team_id"),
        (F.col("offense_team_id") == F.col("home_team_id")).alias("home_has_possession"),
        "home_score", "away_score", (F.col("home_score") - F.col("away_score")).alias("home_score_differential"),
        F.col("home_score_before").alias("feed_home_score_before"), F.col("away_score_before").alias("feed_away_score_before"),
        "home_five", "away_five", (F.col("home_final_score") > F.col("away_final_score")).alias("home_win"),
        F.when(cold, None).otherwise(F.col("season") - 1).alias("rapm_source_season"),
        *[f"{s}_lineup_{k}_rapm" for s in ("home", "away") for k in ("off", "def", "net")],
        F.round(F.col("home_lineup_net_rapm") - F.col("away_lineup_net_rapm"), 10).alias("lineup_net_rapm_differential"),
        X.coverage_status(cold, F.col("home_rated_players"), F.col("away_rated_players")).alias("rapm_coverage_status"),
        "home_rated_players", "away_rated_players", (10 - F.col("home_rated_players") - F.col("away_rated_players")).alias("replacement_player_appearances"),
        "split",
    )


# --- validations -------------------------------------------------------------------------------


def val_minutes(box_player: DataFrame, stint_rows: DataFrame, quarantined: DataFrame) -> DataFrame:
    """JON05, AGG01, FLT02-03."""
    r = stint_rows.select("game_id", "team_id", F.explode("five").alias("person_id"), "seconds").groupBy("game_id", "team_id", "person_id").agg(F.sum("seconds").alias("seconds"))
    b = box_player.where("box_seconds > 0").join(quarantined.select("game_id").distinct(), "game_id", "left_anti")
    got = F.coalesce("seconds", F.lit(0.0))
    return b.join(r, ["game_id", "team_id", "person_id"], "left").select("game_id", "team_id", "person_id", "player_name", got.alias("reconstructed_seconds"), "box_seconds", (got - F.col("box_seconds")).alias("residual_seconds"))


def val_possessions(games: DataFrame, box_player: DataFrame, poss: DataFrame, quarantined: DataFrame) -> DataFrame:
    """JON06, AGG02-03, SET03."""
    g = games.join(quarantined.select("game_id").distinct(), "game_id", "left_anti")
    team = g.select("game_id", F.explode(F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("home_final_score").alias("final_score")), F.struct(F.col("away_team_id").alias("team_id"), F.col("away_final_score").alias("final_score")))).alias("t")).select("game_id", "t.*")
    box = box_player.groupBy("game_id", "team_id").agg(*[F.sum(k).alias(k) for k in ("fga", "fta", "oreb", "tov")])
    counted = poss.groupBy("game_id", F.col("offense_team_id").alias("team_id")).agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    j = team.join(box, ["game_id", "team_id"], "left").join(counted, ["game_id", "team_id"], "left")
    points = F.coalesce("points", F.lit(0))
    return j.select("game_id", "team_id", F.coalesce("n", F.lit(0)).alias("counted_possessions"), X.box_possessions(F.col("fga"), F.col("oreb"), F.col("tov"), F.col("fta")).alias("estimated_possessions"), points.alias("possession_points"), "final_score", (points == F.col("final_score")).alias("points_reconciliation_ok"))


def val_quarantine(built: DataFrame, stint_rows: DataFrame, poss_check: DataFrame, minutes: DataFrame, tolerance: float) -> DataFrame:
    """SET04, SET06: all reasons to set a game aside."""
    why = lambda d, reason: d.select("game_id").distinct().withColumn("reason", F.lit(reason))
    return built.select("game_id", "reason").unionByName(why(stint_rows.where(F.size("five") != 5), "lineup_not_five")).unionByName(why(poss_check.where(~F.col("points_reconciliation_ok")), "possession_points_mismatch")).unionByName(why(minutes.where(F.abs("residual_seconds") > tolerance), "minutes_residual_exceeds_tolerance"))


def val_summary(poss: DataFrame, games: DataFrame, quarantine: DataFrame, minutes: DataFrame, poss_check: DataFrame) -> DataFrame:
    """JON07, AGG05-08: one row of totals."""
    r = F.abs("residual_seconds")
    n = games.agg(F.count("*").alias("total_games"))
    return poss.agg(F.count("*").alias("total_possessions")).crossJoin(n).crossJoin(quarantine.agg(F.countDistinct("game_id").alias("quarantined_games"))).crossJoin(minutes.agg(F.percentile(r, F.lit(0.5)).alias("minutes_residual_p50_seconds"), F.percentile(r, F.lit(0.95)).alias("minutes_residual_p95_seconds"), F.max(r).alias("minutes_residual_max_seconds"))).crossJoin(poss_check.agg(F.avg(F.when(F.col("points_reconciliation_ok"), 1.0).otherwise(0.0)).alias("points_reconciliation_pass_rate"))).select("total_possessions", "total_games", "quarantined_games", (F.col("quarantined_games") / F.nullif("total_games", F.lit(0))).alias("quarantine_rate"), "minutes_residual_p50_seconds", "minutes_residual_p95_seconds", "minutes_residual_max_seconds", "points_reconciliation_pass_rate")
