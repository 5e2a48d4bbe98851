"""Strictly-prior aggregates and as-of lookups, without quadratic joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _prior(keys: list[str], day: str):
    """Rows of the same keys on earlier days only: equal days are outside the frame."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(F.col(day))).rangeBetween(Window.unboundedPreceding, -1)


def team_ledger(games: DataFrame) -> DataFrame:
    """SET09, AGG17: one row a team and game, by one scan of the games.

    ``games``: game_id, season, game_date, home_team_id, away_team_id, home_final_points,
    away_final_points, possessions.
    """
    row = lambda us, them, home: F.struct(F.col(f"{us}_team_id").alias("team_id"), F.col(f"{us}_final_points").alias("points_for"), F.col(f"{them}_final_points").alias("points_against"), F.lit(home).alias("is_home"))
    e = games.select("game_id", "season", "game_date", "possessions", F.explode(F.array(row("home", "away", True), row("away", "home", False))).alias("t"))
    return e.select("game_id", "season", "game_date", "possessions", "t.*").withColumn("won", (F.col("points_for") > F.col("points_against")).cast("int"))


def form_to_date(ledger: DataFrame) -> DataFrame:
    """WIN05, JON13, AGG18: each team's season so far, strictly before the day."""
    w = _prior(["season", "team_id"], "game_date")
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return ledger.select("*", F.count(F.lit(1)).over(w).alias("prior_games"), total("won").alias("prior_wins"), total("points_for").alias("prior_for"), total("points_against").alias("prior_against"), total("possessions").alias("prior_possessions"))


def rest_days(ledger: DataFrame, *, cap: int = 7) -> DataFrame:
    """WIN06, PRE03: days since the game before (at most ``cap``), back-to-back, season's opener."""
    before = F.max("game_date").over(_prior(["season", "team_id"], "game_date"))
    d = F.datediff(F.col("game_date"), before)
    return ledger.select("*", F.least(F.coalesce(d, F.lit(cap)), F.lit(cap)).alias("rest"), F.coalesce(d <= 1, F.lit(False)).alias("back_to_back"), before.isNull().alias("opener"))


def shrunk_form(form: DataFrame, prior_net: str, *, k: float = 10.0) -> DataFrame:
    """PRE02: the season's net rating blended with the prior by n / (n + k)."""
    net = F.when(F.col("prior_possessions") > 0, 100.0 * (F.col("prior_for") - F.col("prior_against")) / F.col("prior_possessions")).otherwise(0.0)
    w = F.col("prior_games") / (F.col("prior_games") + k)
    rate = F.when(F.col("prior_games") > 0, F.col("prior_wins") / F.when(F.col("prior_games") > 0, F.col("prior_games"))).otherwise(0.5)
    return form.select("*", F.round(w * net + (1 - w) * F.col(prior_net), 10).alias("blended_net"), F.round(w * rate + (1 - w) * 0.5, 10).alias("blended_win_rate"))


def last_tick(ticks: DataFrame, cutoffs: DataFrame, key: str = "market_id", *, stale: int = 86_400) -> DataFrame:
    """JON21, FLT10-11: the last price at or before the cutoff; ties in time go to the first tick.

    ``ticks``: key, t, price, n (position); ``cutoffs``: key, tip. Keeps markets without such a tick,
    with null price, and says whether the tick is stale.
    """
    j = ticks.join(cutoffs, key).where(F.col("t") <= F.col("tip"))
    best = j.groupBy(key).agg(F.max_by("price", F.struct("t", -F.col("n"))).alias("price"), F.max("t").alias("t"), F.count("*").alias("ticks"))
    return cutoffs.join(best, key, "left").withColumn("gap", F.col("tip") - F.col("t")).withColumn("fresh", F.coalesce(F.col("gap") <= stale, F.lit(False)))


def opening_state(states: DataFrame) -> DataFrame:
    """WIN07: each game's first state; nulls of its columns are filled from the next state that has one."""
    order = F.struct("period", "possession_number")
    cols = [c for c in states.columns if c not in ("game_id", "period", "possession_number")]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
    return states.groupBy("game_id").agg(*first)


def trajectory_states(states: DataFrame, percents: tuple[int, ...] = (1, 20, 40, 60, 80, 100)) -> DataFrame:
    """WIN04, RPT06: the states at the given shares of each game."""
    p = Window.partitionBy("game_id")
    s = states.withColumn("k", F.row_number().over(p.orderBy("period", "possession_number"))).withColumn("n", F.count(F.lit(1)).over(p))
    at = F.array(*[F.greatest(F.lit(1), F.ceil(F.lit(x) * F.col("n") / 100.0)).cast("int") for x in percents])
    return s.where(F.array_contains(at, F.col("k")))


def last_record(log: DataFrame, key: str, order: str) -> DataFrame:
    """SRC20: the last record of each key wins."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return log.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
