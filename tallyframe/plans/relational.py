"""Queries of the relational operators on the stand-in tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import exprs as X
from tallyframe.operators import asof, eventlog, gates, marts, pregame, reporting
from tallyframe.plans import standins as S
from tallyframe.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ("game_id", "period", "possession_number")


def query(name: str, text: str | None, *uses: str):
    """Register a query and its SQL (with the stand-ins it uses)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if text is not None:
            ORACLES[name] = S.sql(text, *uses)
        return f

    return add


def mart(spark: SparkSession, d: str) -> DataFrame:
    """The state mart on the stand-ins."""
    return marts.game_states(S.poss(spark, d, by_game=True), S.games(spark, d), S.ratings(spark, d))


def _flat(df: DataFrame) -> DataFrame:
    """Fives as text, so that results compare by value."""
    return df.withColumns({c: X.lineup_id(F.col(c)) for c in ("home_five", "away_five") if c in df.columns})


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- the flagship and its parts ----------------------------------------------------------------

MART_SQL = "SELECT * REPLACE (array_to_string(home_five, '-') AS home_five, array_to_string(away_five, '-') AS away_five) FROM mart"


@query("FLAGSHIP_game_states", MART_SQL, "mart")
def flagship(spark, d):
    return _flat(mart(spark, d))


@query("WIN01_score_before", "SELECT game_id, period, possession_number, home_score, away_score FROM state", "state")
def win01(spark, d):
    return marts.with_score_before(marts.with_games(S.poss(spark, d, by_game=True), S.games(spark, d))).select(*KEY, "home_score", "away_score")


@query("ARR03_JON03_AGG04_lineup_strength", "SELECT h.game_id, h.period, h.possession_number, h.rated AS home_rated_players, h.o AS home_lineup_off_rapm, h.d AS home_lineup_def_rapm, h.n AS home_lineup_net_rapm, a.rated AS away_rated_players, a.o AS away_lineup_off_rapm, a.d AS away_lineup_def_rapm, a.n AS away_lineup_net_rapm FROM strength h JOIN strength a USING (game_id, period, possession_number) WHERE h.side = 'home' AND a.side = 'away'", "strength")
def strength(spark, d):
    return marts.lineup_strength(marts.with_games(S.poss(spark, d, by_game=True), S.games(spark, d)), S.ratings(spark, d))


@query("JON02_PRJ24_possessions_with_games", "SELECT game_id, period, possession_number, game_date, array_to_string(home_five, '-') AS home_five, array_to_string(away_five, '-') AS away_five FROM state", "state")
def jon02(spark, d):
    return _flat(marts.with_games(S.poss(spark, d, by_game=True), S.games(spark, d)).select(*KEY, "game_date", "home_five", "away_five"))


@query("JON01_games_left_dates", "SELECT g.game_id, g.season, d.game_date FROM games0 g LEFT JOIN (SELECT game_id, game_date FROM games0 WHERE o_orderkey % 3 <> 0) d USING (game_id)", "games0")
def jon01(spark, d):
    g = S.games0(spark, d)
    return g.select("game_id", "season").join(g.where("o_orderkey % 3 <> 0").select("game_id", "game_date"), "game_id", "left")


@query("JON05_AGG01_val_minutes", "SELECT * FROM val_minutes", "val_minutes")
def val_minutes(spark, d):
    return marts.val_minutes(S.box(spark, d), S.stints(spark, d), S.quarantine(spark, d))


@query("JON06_AGG02_AGG03_val_possessions", "SELECT game_id, team_id, counted_possessions, round(CAST(estimated_possessions AS DOUBLE), 6) AS estimated_possessions, CAST(possession_points AS BIGINT) AS possession_points, final_score, points_reconciliation_ok FROM val_possessions", "val_possessions")
def val_possessions(spark, d):
    v = marts.val_possessions(S.games(spark, d, by_game=True), S.box(spark, d), S.poss(spark, d, by_game=True), S.quarantine(spark, d))
    return v.withColumn("estimated_possessions", F.round(F.col("estimated_possessions").cast("double"), 6))


def _val_quarantine(spark, d):
    m, p = val_minutes(spark, d), marts.val_possessions(S.games(spark, d, by_game=True), S.box(spark, d), S.poss(spark, d, by_game=True), S.quarantine(spark, d))
    return marts.val_quarantine(S.quarantine(spark, d), S.stints(spark, d), p, m, 60), m, p


@query("SET04_SET06_val_quarantine", "SELECT * FROM val_quarantine", "val_quarantine")
def set04(spark, d):
    return _val_quarantine(spark, d)[0]


@query(
    "JON07_AGG05_AGG06_AGG07_AGG08_val_summary",
    "SELECT t.n AS total_possessions, g.n AS total_games, q.n AS quarantined_games, q.n / g.n AS quarantine_rate, m.a AS minutes_residual_p50_seconds, m.b AS minutes_residual_p95_seconds, m.c AS minutes_residual_max_seconds, r.x AS points_reconciliation_pass_rate FROM (SELECT count(*) AS n FROM poss) t, (SELECT count(*) AS n FROM games) g, (SELECT count(DISTINCT game_id) AS n FROM val_quarantine) q, (SELECT quantile_cont(abs(residual_seconds), 0.5) AS a, quantile_cont(abs(residual_seconds), 0.95) AS b, max(abs(residual_seconds)) AS c FROM val_minutes) m, (SELECT avg(CASE WHEN points_reconciliation_ok THEN 1.0 ELSE 0.0 END) AS x FROM val_possessions) r",
    "val_quarantine", "games",
)
def val_summary(spark, d):
    # of the minutes and the possession checks, which are read twice, only what is read is written; fives aren't
    g, bad = S.games(spark, d, by_game=True), S.quarantine(spark, d)
    poss = S.poss(spark, d, by_game=True)
    stint = S.stints_of(poss)
    box = S.box_of(stint)
    m = sinks.written(marts.val_minutes(box, stint, bad).select("game_id", "residual_seconds"), "minutes")
    p = sinks.written(marts.val_possessions(g, box, poss, bad).select("game_id", "points_reconciliation_ok"), "possessions")
    plain = S.poss(spark, d)
    return marts.val_summary(plain, S.games0(spark, d), marts.val_quarantine(bad, S.stints_of(plain), p, m, 60), m, p)


# --- gates -------------------------------------------------------------------------------------

_BAD = "CASE WHEN len(home_five) <> 5 OR len(away_five) <> 5 THEN 'lineup_not_five' WHEN home_has_possession <> (possession_team_id = home_team_id) THEN 'possession_flag_mismatch' WHEN game_clock_seconds < 0 THEN 'negative_game_clock' WHEN period <= 4 AND game_clock_seconds > 720 THEN 'invalid_game_clock' WHEN period > 4 AND game_clock_seconds > 300 THEN 'invalid_ot_clock' WHEN elapsed_game_seconds < 0 THEN 'negative_elapsed_time' END"
_MONO = "SELECT game_id, period, possession_number FROM (SELECT *, lag(home_score) OVER w AS a, lag(away_score) OVER w AS b, lag(elapsed_game_seconds) OVER w AS c FROM mart WINDOW w AS (PARTITION BY game_id ORDER BY period, possession_number)) WHERE home_score < a OR away_score < b OR elapsed_game_seconds < c"
_FINAL = "SELECT game_id, 0 AS period, 0 AS possession_number FROM (SELECT m.game_id, sum(CASE WHEN p.offense_team_id = g.home_team_id THEN p.points ELSE 0 END) AS h, sum(CASE WHEN p.offense_team_id = g.away_team_id THEN p.points ELSE 0 END) AS a, max(g.home_final_score) AS fh, max(g.away_final_score) AS fa, max(CAST(m.home_win AS INTEGER)) AS won FROM mart m JOIN poss p USING (game_id, period, possession_number) JOIN games g USING (game_id) GROUP BY 1) WHERE h <> fh OR a <> fa OR won <> CAST(fh > fa AS INTEGER)"
_COVER = "SELECT game_id, period, possession_number FROM (SELECT *, 1 AS a FROM (SELECT game_id, period, possession_number FROM poss)) FULL JOIN (SELECT game_id, period, possession_number, 1 AS b FROM mart WHERE possession_number < 3 OR period < 3) USING (game_id, period, possession_number) WHERE a IS NULL OR b IS NULL"


@query("GAT01_not_null", "SELECT game_id, period FROM mart WHERE rapm_source_season IS NULL", "mart")
def gat01a(spark, d):
    return gates.not_null(mart(spark, d), "rapm_source_season").select("game_id", "period")


@query("GAT01_unique", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) <> 1")
def gat01b(spark, d):
    return gates.unique(S._t(spark, d, "orders"), "o_custkey", "o_orderdate")


@query("GAT01_accepted_values", "SELECT game_id, split FROM mart WHERE split NOT IN ('train', 'validation', 'test')", "mart")
def gat01c(spark, d):
    return gates.accepted(mart(spark, d), "split", ["train", "validation", "test"]).select("game_id", "split")


@query("GAT01_JON10_relationships", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def gat01d(spark, d):
    return gates.related(S._t(spark, d, "customer"), "c_custkey", S._t(spark, d, "orders").where("o_orderkey % 7 = 0"), "o_custkey").select("c_custkey")


@query("GAT02_AGG09_row_count", "SELECT count(*) AS n FROM orders HAVING count(*) <> 1312")
def gat02(spark, d):
    return gates.row_count(S._t(spark, d, "orders"), 1312)


@query("GAT03_SET05_lineup_is_five", "SELECT game_id, period, 'stint' AS grain, len(five) AS lineup_size FROM stints WHERE len(five) <> 5 UNION ALL SELECT game_id, period, 'possession_offense', len(offense_five) FROM poss WHERE len(offense_five) <> 5 UNION ALL SELECT game_id, period, 'possession_defense', len(defense_five) FROM poss WHERE len(defense_five) <> 5", "stints")
def gat03(spark, d):
    return gates.lineup_of_five(S.stints(spark, d), S.poss(spark, d)).withColumn("lineup_size", F.col("lineup_size").cast("long"))


@query("GAT04_minutes_tolerance", "SELECT count(*) AS player_games, CAST(sum(CASE WHEN abs(residual_seconds) > 60 THEN 1 ELSE 0 END) AS BIGINT) AS over_tolerance_count, sum(CASE WHEN abs(residual_seconds) > 60 THEN 1 ELSE 0 END) / count(*) AS over_tolerance_fraction FROM val_minutes HAVING sum(CASE WHEN abs(residual_seconds) > 60 THEN 1 ELSE 0 END) / count(*) > 0.01", "val_minutes")
def gat04(spark, d):
    return gates.minutes_tolerance(val_minutes(spark, d), 60, 0.01)


@query("GAT05_points_match_final", "SELECT game_id, team_id, CAST(possession_points AS BIGINT) AS possession_points, final_score FROM val_possessions WHERE NOT points_reconciliation_ok", "val_possessions")
def gat05(spark, d):
    v = marts.val_possessions(S.games(spark, d, by_game=True), S.box(spark, d), S.poss(spark, d, by_game=True), S.quarantine(spark, d))
    return v.where(~F.col("points_reconciliation_ok")).select("game_id", "team_id", "possession_points", "final_score")


@query("GAT06_AGG10_duplicate_key", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) <> 1")
def gat06(spark, d):
    return gates.unique(S._t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("GAT07_row_validity", f"SELECT game_id, period, possession_number, {_BAD} AS reason FROM mart WHERE {_BAD} IS NOT NULL", "mart")
def gat07(spark, d):
    return mart(spark, d).withColumn("reason", gates.bad_state()).where("reason is not null").select(*KEY, "reason")


@query("GAT10_JON08_coverage", _COVER, "mart")
def gat10(spark, d):
    return gates.coverage(S.poss(spark, d), mart(spark, d).where("possession_number < 3 or period < 3"))


@query("GAT11_JON09_AGG12_final_mismatch", _FINAL, "mart")
def gat11(spark, d):
    return gates.final_mismatch(mart(spark, d), S.poss(spark, d), S.games(spark, d))


_TEN = f"""WITH j AS (SELECT m.*, p.offense_team_id AS po, p.points AS pp, g.home_team_id AS gh, g.away_team_id AS ga, g.home_final_score AS fh, g.away_final_score AS fa,
  coalesce(sum(CASE WHEN p.offense_team_id = g.home_team_id THEN p.points ELSE 0 END) OVER w, 0) AS eh, coalesce(sum(CASE WHEN p.offense_team_id = g.away_team_id THEN p.points ELSE 0 END) OVER w, 0) AS ea
  FROM planted m JOIN poss p USING (game_id, period, possession_number) JOIN games g USING (game_id) WINDOW w AS (PARTITION BY game_id ORDER BY period, possession_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'unique_key' AS gate, count(*) AS failures FROM (SELECT game_id FROM planted GROUP BY game_id, period, possession_number HAVING count(*) <> 1)
UNION ALL SELECT 'lineups_of_five', count(*) FROM planted WHERE len(home_five) <> 5 OR len(away_five) <> 5
UNION ALL SELECT 'possession_coverage', count(*) FROM poss p FULL JOIN planted s USING (game_id, period, possession_number) WHERE p.season IS NULL OR s.season IS NULL
UNION ALL SELECT 'possession_flag', count(*) FROM planted WHERE home_has_possession <> (possession_team_id = home_team_id)
UNION ALL SELECT 'score_and_time_monotonic', count(*) FROM (SELECT *, lag(home_score) OVER w AS a, lag(away_score) OVER w AS b, lag(elapsed_game_seconds) OVER w AS c FROM planted WINDOW w AS (PARTITION BY game_id ORDER BY period, possession_number)) WHERE home_score < a OR away_score < b OR elapsed_game_seconds < c
UNION ALL SELECT 'clock_consistent', count(*) FROM planted WHERE game_clock_seconds < 0 OR (period <= 4 AND game_clock_seconds > 720) OR (period > 4 AND game_clock_seconds > 300) OR regulation_seconds_remaining <> greatest(0.0, 2880.0 - elapsed_game_seconds)
UNION ALL SELECT 'score_before_possession', count(*) FROM j WHERE home_score <> eh OR away_score <> ea
UNION ALL SELECT 'rating_strictly_prior', count(*) FROM planted WHERE rapm_coverage_status IS NULL OR (rapm_coverage_status <> 'cold_start' AND (rapm_source_season IS NULL OR rapm_source_season <> season - 1))
UNION ALL SELECT 'final_score_and_winner', count(*) FROM (SELECT game_id, sum(CASE WHEN po = gh THEN pp ELSE 0 END) AS h, sum(CASE WHEN po = ga THEN pp ELSE 0 END) AS a, max(fh) AS fh, max(fa) AS fa, max(CAST(home_win AS INTEGER)) AS won FROM j GROUP BY 1) WHERE h <> fh OR a <> fa OR won <> CAST(fh > fa AS INTEGER)
UNION ALL SELECT 'one_split_a_game', count(*) FROM (SELECT game_id FROM planted GROUP BY 1 HAVING count(DISTINCT split) <> 1)"""
#: The mart with violations of each gate that the stand-ins don't have by themselves.
_PLANT = {
    "home_has_possession": "home_has_possession <> (period = 1 AND possession_number = 2 AND season = 2019)",
    "home_score": "home_score - CASE WHEN period = 2 AND possession_number = 2 AND season = 2020 THEN 90 ELSE 0 END",
    "game_clock_seconds": "game_clock_seconds + CASE WHEN period = 2 AND possession_number = 1 AND season = 2018 THEN 1000.0 ELSE 0.0 END",
    "rapm_source_season": "CASE WHEN period = 1 AND possession_number = 3 THEN season ELSE rapm_source_season END",
    "split": "CASE WHEN period = 2 AND season = 2022 THEN 'test' ELSE split END",
}


def planted(spark, d) -> DataFrame:
    """The mart, written once, with planted violations; a hundredth of its rows missing."""
    m = sinks.written(mart(spark, d), "mart").repartition(S.parts(spark, d, "lineitem"), "game_id")
    return m.select(*[F.expr(_PLANT[c]).alias(c) if c in _PLANT else F.col(c) for c in m.columns]).where("not (possession_number = 3 and period = 2 and season = 2023)")


_PLANTED = f"planted AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in _PLANT.items())}) FROM mart WHERE NOT (possession_number = 3 AND period = 2 AND season = 2023))"


@query("GAT12_failures_by_gate", _TEN.replace("WITH j AS", f"WITH {_PLANTED}, j AS"), "mart")
def gat12(spark, d):
    return gates.ten_gates(planted(spark, d), S.poss(spark, d, by_game=True), S.games(spark, d))


@query("GAT08_WIN02_WIN03_monotone", f"WITH {_PLANTED} {_MONO.replace('FROM mart', 'FROM planted')}", "mart")
def gat08(spark, d):
    return gates.not_monotone(planted(spark, d))


@query("GAT09_AGG11_split_leakage", f"WITH {_PLANTED} SELECT game_id, min(period) AS period, min(possession_number) AS possession_number FROM planted GROUP BY game_id HAVING count(DISTINCT split) <> 1", "mart")
def gat09(spark, d):
    return gates.split_leakage(planted(spark, d))


@query("GAT13_SET07_two_way_difference", "SELECT k, 'left_only' AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) UNION ALL SELECT k, 'right_only' FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 1 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def gat13(spark, d):
    o = S._t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return gates.set_difference(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "k")


@query("GAT22_rating_strictly_prior", "SELECT game_id FROM mart WHERE rapm_source_season >= season", "mart")
def gat22(spark, d):
    return gates.rating_not_prior(mart(spark, d)).select("game_id")


# --- as of -------------------------------------------------------------------------------------


def ledger(spark, d):
    """Team-game ledger of the stand-in games."""
    g = S.games(spark, d).join(S.poss(spark, d).groupBy("game_id").agg(F.count("*").alias("possessions")), "game_id")
    return asof.team_ledger(g.withColumnRenamed("home_final_score", "home_final_points").withColumnRenamed("away_final_score", "away_final_points"))


@query("SET03_SET09_team_ledger", "SELECT * FROM ledger", "ledger")
def set09(spark, d):
    return ledger(spark, d)


@query("WIN05_JON13_AGG18_form_to_date", "SELECT a.game_id, a.team_id, count(b.game_id) AS prior_games, CAST(coalesce(sum(b.won), 0) AS BIGINT) AS prior_wins, CAST(coalesce(sum(b.points_for), 0) AS BIGINT) AS prior_for, CAST(coalesce(sum(b.points_against), 0) AS BIGINT) AS prior_against, CAST(coalesce(sum(b.possessions), 0) AS BIGINT) AS prior_possessions FROM ledger a LEFT JOIN ledger b ON a.season = b.season AND a.team_id = b.team_id AND b.game_date < a.game_date GROUP BY 1, 2", "ledger")
def win05(spark, d):
    return asof.form_to_date(ledger(spark, d)).select("game_id", "team_id", "prior_games", "prior_wins", "prior_for", "prior_against", "prior_possessions")


@query("WIN06_PRE03_rest_days", "SELECT game_id, team_id, CAST(least(coalesce(game_date - was, 7), 7) AS INTEGER) AS rest, coalesce(game_date - was <= 1, FALSE) AS back_to_back, was IS NULL AS opener FROM (SELECT a.game_id, a.team_id, a.game_date, max(b.game_date) AS was FROM ledger a LEFT JOIN ledger b ON a.season = b.season AND a.team_id = b.team_id AND b.game_date < a.game_date GROUP BY ALL)", "ledger")
def win06(spark, d):
    return asof.rest_days(ledger(spark, d)).select("game_id", "team_id", "rest", "back_to_back", "opener")


_SHRUNK = "SELECT game_id, team_id, round(n / (n + 10.0) * CASE WHEN ps > 0 THEN 100.0 * (pf - pa) / ps ELSE 0.0 END + (1 - n / (n + 10.0)) * (team_id % 7), 6) AS blended_net, round(n / (n + 10.0) * CASE WHEN n > 0 THEN w / n ELSE 0.5 END + (1 - n / (n + 10.0)) * 0.5, 6) AS blended_win_rate FROM (SELECT a.game_id, a.team_id, count(b.game_id) AS n, coalesce(sum(b.won), 0) AS w, coalesce(sum(b.points_for), 0) AS pf, coalesce(sum(b.points_against), 0) AS pa, coalesce(sum(b.possessions), 0) AS ps FROM ledger a LEFT JOIN ledger b ON a.season = b.season AND a.team_id = b.team_id AND b.game_date < a.game_date GROUP BY 1, 2)"


@query("PRE02_shrunk_form", _SHRUNK, "ledger")
def pre02(spark, d):
    f = asof.shrunk_form(asof.form_to_date(ledger(spark, d)).withColumn("prior_net", (F.col("team_id") % 7).cast("double")), "prior_net")
    return f.select("game_id", "team_id", F.round("blended_net", 6).alias("blended_net"), F.round("blended_win_rate", 6).alias("blended_win_rate"))


@query("PRE04_net_mode", "SELECT 'per_100' AS mode")
def pre04(spark, d):
    return pregame.net_mode(S.poss(spark, d).groupBy("game_id").agg(F.count("*").alias("possessions")))


@query("PRE05_ladder_frame", f"SELECT game_id, round(max(CASE WHEN is_home THEN blended_net END) - max(CASE WHEN NOT is_home THEN blended_net END), 6) AS blended_net_difference FROM ledger JOIN ({_SHRUNK}) USING (game_id, team_id) GROUP BY 1", "ledger")
def pre05(spark, d):
    f = asof.rest_days(asof.form_to_date(ledger(spark, d)))
    f = asof.shrunk_form(f.withColumn("prior_net", (F.col("team_id") % 7).cast("double")), "prior_net").withColumn("blended_net", F.round("blended_net", 6))
    return pregame.ladder_frame(f).select("game_id", F.round("blended_net_difference", 6).alias("blended_net_difference"))


@query("JON21_FLT10_FLT11_last_tick", "SELECT user_id AS market_id, tip, p AS price, t, n AS ticks, tip - t AS gap, coalesce(tip - t <= 3600, FALSE) AS fresh FROM (SELECT user_id, CAST(max(epoch(ts)) - 86400 * 3 AS BIGINT) // 1 AS tip FROM events GROUP BY 1) c LEFT JOIN (SELECT user_id, arg_max(value, (t, -event_id)) AS p, max(t) AS t, count(*) AS n FROM (SELECT e.user_id, value, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, tip FROM events e JOIN (SELECT user_id, CAST(floor(max(epoch(ts))) AS BIGINT) - 86400 * 3 AS tip FROM events GROUP BY 1) USING (user_id)) WHERE t <= tip GROUP BY 1) USING (user_id)")
def jon21(spark, d):
    e = S._t(spark, d, "events").select(F.col("user_id").alias("market_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("t"), F.col("value").alias("price"), F.col("event_id").alias("n"))
    c = e.groupBy("market_id").agg((F.max("t") - 86400 * 3).alias("tip"))
    return asof.last_tick(e, c, "market_id", stale=3600)


ORACLES["JON21_FLT10_FLT11_last_tick"] = "WITH e AS (SELECT user_id AS market_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value, event_id FROM events), c AS (SELECT market_id, max(t) - 259200 AS tip FROM e GROUP BY 1), b AS (SELECT market_id, t, value, row_number() OVER (PARTITION BY market_id ORDER BY t DESC, event_id) AS k, count(*) OVER (PARTITION BY market_id) AS ticks FROM e JOIN c USING (market_id) WHERE t <= tip) SELECT market_id, tip, value AS price, t, ticks, tip - t AS gap, coalesce(tip - t <= 3600, FALSE) AS fresh FROM c LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (market_id)"


@query("JON20_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_value FROM events")
def jon20(spark, d):
    e = S._t(spark, d, "events").withColumn("game_id", F.col("user_id"))
    return e.select("event_id", eventlog.last_known_before(F.when(F.col("event_type") == "purchase", F.col("value")), "ts", "event_id").alias("last_value"))


@query("WIN04_RPT06_trajectory_states", "SELECT game_id, period, possession_number FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY period, possession_number) AS k, count(*) OVER (PARTITION BY game_id) AS n FROM poss) WHERE k IN (greatest(1, CAST(ceil(1 * n / 100.0) AS INTEGER)), greatest(1, CAST(ceil(20 * n / 100.0) AS INTEGER)), CAST(ceil(40 * n / 100.0) AS INTEGER), CAST(ceil(60 * n / 100.0) AS INTEGER), CAST(ceil(80 * n / 100.0) AS INTEGER), n)", "poss")
def win04(spark, d):
    return asof.trajectory_states(S.poss(spark, d)).select(*KEY)


@query("WIN07_opening_state", "SELECT game_id, arg_min(points, (period, possession_number)) AS points, arg_min(offense_team_id, (period, possession_number)) AS offense_team_id FROM poss GROUP BY 1", "poss")
def win07(spark, d):
    return asof.opening_state(S.poss(spark, d).select(*KEY, "points", "offense_team_id"))


@query("WIN08_PRJ49_decay_weight", "SELECT game_id, round(pow(0.5, (max(game_date) OVER (PARTITION BY season) - game_date) / 60.0), 9) AS weight FROM games0", "games0")
def win08(spark, d):
    days = F.datediff(F.max("game_date").over(Window.partitionBy("season")), F.col("game_date"))
    return S.games0(spark, d).select("game_id", F.round(X.decay_weight(days), 9).alias("weight"))


@query("WIN09_expected_score_check", "SELECT game_id, period, possession_number FROM state WHERE home_score <> home_score_before", "state")
def win09(spark, d):
    return marts.with_score_before(marts.with_games(S.poss(spark, d, by_game=True), S.games(spark, d))).where("home_score <> home_score_before").select(*KEY)


# --- event log ---------------------------------------------------------------------------------

_LOG = """act0 AS (SELECT *, try_cast(nullif(score_home, '') AS INTEGER) AS sh, try_cast(nullif(score_away, '') AS INTEGER) AS sa FROM raw_actions),
act1 AS (SELECT *, coalesce(last_value(sh IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS home_score_before, coalesce(last_value(sa IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS away_score_before,
  coalesce(last_value(CASE WHEN action_type = 'Foul' THEN sub_type END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS foul FROM act0),
log AS (SELECT game_id, ord, period, CASE action_type WHEN 'period' THEN 'period_end' WHEN 'Made Shot' THEN 'made_shot' WHEN 'Missed Shot' THEN 'missed_shot' WHEN 'Rebound' THEN 'rebound' WHEN 'Turnover' THEN 'turnover' WHEN 'Free Throw' THEN 'free_throw' ELSE 'delay' END AS event,
  CASE WHEN action_type <> 'period' THEN nullif(team_id, 0) END AS team_id,
  CASE WHEN period <= 4 THEN 720.0 ELSE 300.0 END - (CAST(substr(clock, 3, 2) AS DOUBLE) * 60 + CAST(substr(clock, 6, 5) AS DOUBLE)) AS seconds,
  CAST(CASE WHEN action_type = 'Made Shot' THEN CASE WHEN shot_value = 0 THEN 2 ELSE shot_value END WHEN action_type = 'Free Throw' THEN CASE WHEN starts_with(description, 'MISS') THEN 0 ELSE 1 END ELSE 0 END AS INTEGER) AS points,
  CASE WHEN action_type = 'Free Throw' THEN CASE WHEN sub_type LIKE '%2 of 2%' THEN 2 ELSE 1 END END AS ft_index,
  CASE WHEN action_type = 'Free Throw' THEN CASE WHEN sub_type LIKE '%of 2%' THEN 2 ELSE 1 END END AS ft_total,
  CASE WHEN action_type = 'Free Throw' THEN CASE WHEN sub_type LIKE '%Technical%' THEN 'technical' WHEN sub_type LIKE '%Flagrant%' THEN 'flagrant' WHEN sub_type NOT LIKE '%of 2%' AND (lower(foul) LIKE '%away from play%' OR lower(foul) LIKE '%take%') THEN 'flagrant' ELSE 'regular' END END AS ft_kind,
  CASE WHEN action_type = 'Free Throw' THEN NOT starts_with(description, 'MISS') END AS made, home_score_before, away_score_before
  FROM act1 WHERE action_type <> 'period' OR sub_type = 'end')"""


def _with_log(tail: str) -> str:
    return S.sql("", "raw_actions").rstrip() + ",\n" + _LOG + tail


@query("EVT01_WIN10_WIN11_action_log", None)
def evt01(spark, d):
    return eventlog.action_log(S.raw_actions(spark, d))


ORACLES["EVT01_WIN10_WIN11_action_log"] = _with_log("\nSELECT * FROM log")

_AND1 = """,
and1 AS (SELECT *, coalesce(event = 'made_shot' AND nx.e = 'free_throw' AND nx.t IS NOT DISTINCT FROM team_id AND nx.k = 'regular', FALSE) AS and_one FROM (SELECT *, first_value(CASE WHEN event <> 'delay' THEN {'e': event, 't': team_id, 'k': coalesce(ft_kind, 'regular')} END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM log))"""


@query("EVT07_WIN12_and_one", None)
def evt07(spark, d):
    return eventlog.with_and_one(evt01(spark, d)).where("and_one").select("game_id", "ord")


ORACLES["EVT07_WIN12_and_one"] = _with_log(_AND1 + "\nSELECT game_id, ord FROM and1 WHERE and_one")

_POSS = """,
e0 AS (SELECT *, event IN ('made_shot', 'missed_shot', 'turnover', 'rebound') OR (event = 'free_throw' AND ft_kind <> 'technical') AS owning, (event = 'made_shot' AND NOT and_one) OR event IN ('turnover', 'period_end') OR (event = 'free_throw' AND ft_kind = 'regular' AND made AND ft_index = ft_total) AS closes FROM and1),
e1 AS (SELECT * FROM e0 WHERE owning OR event = 'period_end'),
e2 AS (SELECT *, lag(team_id) OVER w AS pt, lag(closes) OVER w AS pc FROM e1 WINDOW w AS (PARTITION BY game_id, period ORDER BY ord)),
e3 AS (SELECT *, CAST(sum(CASE WHEN owning AND (pc IS NULL OR pc OR pt IS DISTINCT FROM team_id) THEN 1 ELSE 0 END) OVER (PARTITION BY game_id, period ORDER BY ord) AS INTEGER) AS number FROM e2)
SELECT game_id, period, number AS possession_number, arg_min(coalesce(team_id, -1), ord) AS offense_team_id, arg_min(seconds, ord) AS start_seconds, arg_min(home_score_before, ord) AS home_score_before, arg_min(away_score_before, ord) AS away_score_before FROM e3 WHERE owning GROUP BY 1, 2, 3"""


@query("EVT06_possession_boundaries", None)
def evt06(spark, d):
    p = eventlog.possessions(evt01(spark, d)).where("home_score_before is not null")
    return p.select(*KEY, F.coalesce("offense_team_id", F.lit(-1)).alias("offense_team_id"), "start_seconds", "home_score_before", "away_score_before")


ORACLES["EVT06_possession_boundaries"] = _with_log(_AND1 + _POSS)


@query("EVT08_AGG24_points_by_team", None)
def evt08(spark, d):
    p = eventlog.possessions(evt01(spark, d))
    return p.groupBy("game_id", F.coalesce("offense_team_id", F.lit(-1)).alias("team_id")).agg(F.sum("points").alias("points"))


ORACLES["EVT08_AGG24_points_by_team"] = _with_log("\n, pt AS (SELECT game_id, coalesce(team_id, -1) AS team_id, CAST(sum(CASE WHEN event = 'made_shot' OR made THEN points ELSE 0 END) AS BIGINT) AS points, count_if(event IN ('made_shot', 'missed_shot', 'turnover', 'rebound') OR (event = 'free_throw' AND (ft_kind <> 'technical' OR (made AND points > 0)))) AS n FROM log WHERE event <> 'period_end' GROUP BY 1, 2) SELECT game_id, team_id, points FROM pt WHERE n > 0")


@query("EVT06_possessions_fold", None)
def evt06_fold(spark, d):
    return eventlog.fold_games(evt01(spark, d))


def _moves(spark, d):
    """Acts and substitutions from events: period = twelve events, team by parity, few players."""
    r = S.raw_actions(spark, d).where("team_id > 0 and action_type <> 'period'")
    kind = "case when ord % 7 = 3 then 'in' when ord % 7 = 5 then 'out' else 'act' end"
    return r.select("game_id", "period", "team_id", F.expr("cast(ord % 9 + 10 * team_id as bigint)").alias("player_id"), F.col("ord"), F.expr(kind).alias("kind"), F.expr("cast(ord % 12 * 60.0 as double)").alias("seconds"))


@query("EVT03_period_starters", "SELECT game_id, period, team_id, player_id FROM (SELECT game_id, period, team_id, ord % 9 + 10 * team_id AS player_id, CASE WHEN ord % 7 = 3 THEN 'in' WHEN ord % 7 = 5 THEN 'out' ELSE 'act' END AS kind, row_number() OVER (PARTITION BY game_id, period, team_id, ord % 9 ORDER BY ord) AS k FROM raw_actions WHERE team_id > 0 AND action_type <> 'period') WHERE k = 1 AND kind <> 'in'", "raw_actions")
def evt03(spark, d):
    return eventlog.period_starters(_moves(spark, d))


@query("EVT12_first_seen_teams", "SELECT game_id, team_id, min(ord) AS first_ord, CAST(row_number() OVER (PARTITION BY game_id ORDER BY min(ord), team_id) AS INTEGER) AS position FROM raw_actions WHERE team_id > 0 GROUP BY 1, 2", "raw_actions")
def evt12(spark, d):
    return eventlog.first_seen_teams(S.raw_actions(spark, d))


@query("EVT13_opponent", "SELECT game_id, offense_team_id, CASE WHEN offense_team_id = home_team_id THEN away_team_id ELSE home_team_id END AS opponent FROM state", "state")
def evt13(spark, d):
    return marts.with_games(S.poss(spark, d, by_game=True), S.games(spark, d)).select("game_id", "offense_team_id", eventlog.opponent(F.col("offense_team_id"), F.col("home_team_id"), F.col("away_team_id")).alias("opponent"))


@query("EVT09_SET08_reconcile", "SELECT coalesce(a.game_id, b.game_id) AS game_id, coalesce(a.team_id, b.team_id) AS team_id, coalesce(a.v, 0) AS left_value, coalesce(b.v, 0) AS right_value, coalesce(a.v, 0) - coalesce(b.v, 0) AS delta FROM (SELECT game_id, offense_team_id AS team_id, CAST(sum(points) AS BIGINT) AS v FROM poss GROUP BY 1, 2) a FULL JOIN (SELECT game_id, defense_team_id AS team_id, CAST(sum(points) AS BIGINT) AS v FROM poss WHERE period = 1 GROUP BY 1, 2) b ON a.game_id = b.game_id AND a.team_id = b.team_id WHERE abs(coalesce(a.v, 0) - coalesce(b.v, 0)) > 2", "poss")
def evt09(spark, d):
    p = S.poss(spark, d)
    a = p.groupBy("game_id", F.col("offense_team_id").alias("team_id")).agg(F.sum("points").alias("v"))
    b = p.where("period = 1").groupBy("game_id", F.col("defense_team_id").alias("team_id")).agg(F.sum("points").alias("v"))
    return eventlog.reconcile(a, b, ["game_id", "team_id"], "v", 2)


@query("EVT10_quarantine_mismatches", "SELECT DISTINCT coalesce(a.game_id, b.game_id) AS game_id, 'points_mismatch' AS reason FROM (SELECT game_id, offense_team_id AS team_id, sum(points) AS v FROM poss GROUP BY 1, 2) a FULL JOIN (SELECT game_id, home_team_id AS team_id, home_final_score AS v FROM games UNION ALL SELECT game_id, away_team_id, away_final_score FROM games) b ON a.game_id = b.game_id AND a.team_id = b.team_id WHERE coalesce(a.v, 0) <> coalesce(b.v, 0)", "games")
def evt10(spark, d):
    g = S.games(spark, d)
    f = g.select("game_id", F.col("home_team_id").alias("team_id"), F.col("home_final_score").alias("final_score")).union(g.select("game_id", "away_team_id", "away_final_score"))
    return eventlog.quarantine_mismatches(S.poss(spark, d), f)


@query("EVT11_AGG37_corpus_gate", None)
def evt11(spark, d):
    return eventlog.corpus_gate(val_minutes(spark, d).withColumn("delta", F.col("residual_seconds")), S.stints(spark, d))


ORACLES["EVT11_AGG37_corpus_gate"] = S.sql("SELECT r.*, f.five AS all_five, f.five AND within >= 0.99 AS passes FROM (SELECT count(*) AS n, quantile_cont(d, 0.5) AS median, (list(d ORDER BY d))[CAST(round(0.95 * (count(*) - 1)) AS BIGINT) + 1] AS p95, max(d) AS largest, avg(CASE WHEN d <= 60 THEN 1.0 ELSE 0.0 END) AS within FROM (SELECT abs(residual_seconds) AS d FROM val_minutes)) r, (SELECT min(CAST(len(five) = 5 AS INTEGER)) = 1 AS five FROM stints) f", "val_minutes")


# --- sets, sorts, filters, joins -----------------------------------------------------------------


@query("SET01_SET02_union_all", "SELECT game_id, home_team_id AS team_id, TRUE AS is_home FROM games0 UNION ALL SELECT game_id, away_team_id, FALSE FROM games0", "games0")
def set01(spark, d):
    g = S.games0(spark, d)
    row = lambda c, h: F.struct(F.col(c).alias("team_id"), F.lit(h).alias("is_home"))
    return g.select("game_id", F.explode(F.array(row("home_team_id", True), row("away_team_id", False))).alias("x")).select("game_id", "x.*")


@query("SRT01_ordered_output", "SELECT game_id, period, possession_number, points FROM poss ORDER BY ALL", "poss")
def srt01(spark, d):
    return S.poss(spark, d).select(*KEY, "points").orderBy(*KEY)


@query("SRT02_SRT04_top_k", "SELECT player_id, season, net_rating FROM ratings ORDER BY net_rating DESC, player_id, season LIMIT 25", "ratings")
def srt02(spark, d):
    return reporting.top(S.ratings(spark, d).select("player_id", "season", "net_rating"), "net_rating", 25, "player_id", "season")


@query("SRT03_top_and_bottom", "(SELECT player_id, season, net_rating, 'top' AS \"end\" FROM ratings ORDER BY net_rating DESC, player_id, season LIMIT 10) UNION ALL (SELECT player_id, season, net_rating, 'bottom' FROM ratings ORDER BY net_rating, player_id, season LIMIT 10)", "ratings")
def srt03(spark, d):
    return reporting.top_and_bottom(S.ratings(spark, d).select("player_id", "season", "net_rating"), "net_rating", 10, "player_id", "season")


@query("SRT06_distinct_order_limit", "SELECT DISTINCT season FROM games0 ORDER BY season LIMIT 2", "games0")
def srt06(spark, d):
    return S.games0(spark, d).select("season").distinct().orderBy("season").limit(2)


@query("SRT07_lowest_rows", "SELECT player_id, season, n_possessions FROM ratings ORDER BY n_possessions, player_id, season LIMIT 3", "ratings")
def srt07(spark, d):
    return reporting.top(S.ratings(spark, d).select("player_id", "season", "n_possessions"), "n_possessions", 3, "player_id", "season", ascending=True)


@query("SRT05_representative", "WITH a AS (SELECT min(l_orderkey) AS g FROM lineitem WHERE l_quantity > 40), b AS (SELECT min(l_orderkey) AS g FROM lineitem WHERE l_quantity > 20 AND l_orderkey NOT IN (SELECT g FROM a)) SELECT 'large' AS category, CAST(g AS VARCHAR) AS game_id FROM a UNION ALL SELECT 'medium', CAST(g AS VARCHAR) FROM b")
def srt05(spark, d):
    li = S._t(spark, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), "l_quantity")
    return reporting.representative(li, {"large": F.col("l_quantity") > 40, "medium": F.col("l_quantity") > 20})


@query("FLT01_like_scope", "SELECT game_id FROM games0 WHERE game_id LIKE '00221%' OR game_id LIKE '00424%'", "games0")
def flt01(spark, d):
    return S.games0(spark, d).where(X.any_like(F.col("game_id"), ["00221%", "00424%"])).select("game_id")


@query("FLT02_positive_only", "SELECT game_id, person_id FROM box WHERE box_seconds > 0", "box")
def flt02(spark, d):
    return S.box(spark, d).where("box_seconds > 0").select("game_id", "person_id")


@query("FLT03_not_in", "SELECT game_id FROM games0 WHERE game_id NOT IN (SELECT game_id FROM quarantine)", "quarantine")
def flt03(spark, d):
    return S.games0(spark, d).select("game_id").join(S.quarantine(spark, d).select("game_id"), "game_id", "left_anti")


@query("FLT05_scope_dedupe_order", "SELECT DISTINCT game_id, season FROM mart WHERE split = 'test' ORDER BY 1", "mart")
def flt05(spark, d):
    return mart(spark, d).where("split = 'test'").select("game_id", "season").dropDuplicates(["game_id"]).orderBy("game_id")


@query("FLT06_resolved_only", "SELECT game_id, ord FROM raw_actions WHERE nullif(team_id, 0) IS NOT NULL", "raw_actions")
def flt06(spark, d):
    return S.raw_actions(spark, d).where(F.nullif("team_id", F.lit(0)).isNotNull()).select("game_id", "ord")


@query("FLT07_fold_mapping", "SELECT game_id, CASE season WHEN 2022 THEN 'fit' WHEN 2023 THEN 'fit' WHEN 2024 THEN 'score' END AS fold FROM games0 WHERE season IN (2022, 2023, 2024)", "games0")
def flt07(spark, d):
    m = F.create_map(*[F.lit(x) for kv in {2022: "fit", 2023: "fit", 2024: "score"}.items() for x in kv])
    return S.games0(spark, d).select("game_id", m[F.col("season")].alias("fold")).where("fold is not null")


@query("FLT08_action_types", "SELECT game_id, ord FROM raw_actions WHERE action_type NOT IN ('Timeout', 'period')", "raw_actions")
def flt08(spark, d):
    return S.raw_actions(spark, d).where(~F.col("action_type").isin("Timeout", "period")).select("game_id", "ord")


@query("FLT09_finite_only", "SELECT k, x FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN CAST('nan' AS DOUBLE) WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS x FROM part) WHERE x IS NOT NULL AND NOT isnan(x)")
def flt09(spark, d):
    x = F.when(F.col("p_partkey") % 11 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 13 == 0, None).otherwise(F.col("p_retailprice"))
    return S._t(spark, d, "part").select(F.col("p_partkey").alias("k"), x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))


@query("JON04_three_key_join", "SELECT h.game_id, h.period, h.possession_number, h.rated + a.rated AS rated FROM strength h JOIN strength a USING (game_id, period, possession_number) WHERE h.side = 'home' AND a.side = 'away'", "strength")
def jon04(spark, d):
    s = strength(spark, d)
    a, b = s.select(*KEY, F.col("home_rated_players").alias("x")), s.select(*KEY, F.col("away_rated_players").alias("y"))
    return a.join(b, list(KEY)).select(*KEY, (F.col("x") + F.col("y")).alias("rated"))


@query("JON11_AGG13_BAY13_SRT04_quarantine_bias", "SELECT team_id, count(*) AS games, count(*) FILTER (WHERE game_id IN (SELECT game_id FROM quarantine)) AS quarantined, count(*) FILTER (WHERE game_id IN (SELECT game_id FROM quarantine)) / count(*) AS q_rate FROM (SELECT game_id, home_team_id AS team_id FROM games0 UNION ALL SELECT game_id, away_team_id FROM games0) GROUP BY 1 ORDER BY q_rate DESC, team_id LIMIT 5", "quarantine")
def jon11(spark, d):
    from tallyframe.operators.linalg import quarantine_bias

    return reporting.top(quarantine_bias(S.games0(spark, d), S.quarantine(spark, d)), "q_rate", 5, "team_id")


@query("JON14_JON15_covered_games", "SELECT g.game_id, round((1 / o.h) / (1 / o.h + 1 / o.a), 10) AS market_home_prob FROM games0 g JOIN (SELECT DISTINCT game_date, home_team_id, away_team_id, CAST(1.2 AS DOUBLE) + home_team_id / CAST(10 AS DOUBLE) AS h, CAST(1.3 AS DOUBLE) + away_team_id / CAST(9 AS DOUBLE) AS a FROM games0 WHERE o_orderkey % 2 = 0) o USING (game_date, home_team_id, away_team_id)", "games0")
def jon14(spark, d):
    g = S.games0(spark, d)
    o = g.where("o_orderkey % 2 = 0").select("game_date", "home_team_id", "away_team_id", F.expr("1.2D + home_team_id / 10.0D").alias("money_home_decimal_odds"), F.expr("1.3D + away_team_id / 9.0D").alias("money_away_decimal_odds")).distinct()
    return pregame.covered_games(g, o).select("game_id", "market_home_prob")


@query("JON16_lookup_or_fail", "SELECT game_id, season * 2 AS looked_up FROM games0", "games0")
def jon16(spark, d):
    g = S.games0(spark, d)
    m = g.select("season", (F.col("season") * 2).alias("looked_up")).distinct()
    missing = F.when(F.col("looked_up").isNull(), F.raise_error(F.lit("no prediction for a game"))).otherwise(F.col("looked_up"))
    return g.select("game_id", "season").join(m, "season", "left").select("game_id", missing.cast("int").alias("looked_up"))


@query("PRJ34_label_to_id", "SELECT n_nationkey, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def prj34(spark, d):
    n, r = S._t(spark, d, "nation"), S._t(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name", "r_regionkey")


@query("PRJ21_team_from_description", None)
def prj21(spark, d):
    a = S._t(spark, d, "part").select(F.lit("g").alias("game_id"), F.col("p_partkey").alias("ord"), F.lit(None).cast("long").alias("team_id"), F.col("p_name").alias("description"))
    t = spark.createDataFrame([("g", 1, 1, "Red"), ("g", 1, 1, "blue"), ("g", 2, 2, "small"), ("g", 2, 2, "re")], "game_id string, team_id long, position int, token string")
    return eventlog.resolve_team(a, t).select("ord", "resolved_team_id")


ORACLES["PRJ21_team_from_description"] = "SELECT p_partkey AS ord, CAST(CASE WHEN starts_with(lower(trim(p_name)), 'red') OR starts_with(lower(trim(p_name)), 'blue') THEN 1 WHEN starts_with(lower(trim(p_name)), 'small') OR starts_with(lower(trim(p_name)), 're') THEN 2 END AS BIGINT) AS resolved_team_id FROM part"


# --- sources on the driver's tables ------------------------------------------------------------


@query("SRC06_SRC07_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def src06(spark, d):
    return S._t(spark, d, "orders").where("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("SRC08_column_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def src08(spark, d):
    return S._t(spark, d, "lineitem").select("l_orderkey", "l_quantity")


@query("SRC10_id_filter", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def src10(spark, d):
    c = S._t(spark, d, "customer").where("c_nationkey = 3")
    return S._t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SRC17_distinct_games", "SELECT DISTINCT user_id, event_type FROM events")
def src17(spark, d):
    return S._t(spark, d, "events").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


@query("SRC18_game_dates", "SELECT user_id AS game_id, min(CAST(ts AS DATE)) AS game_date FROM events GROUP BY 1")
def src18(spark, d):
    from tallyframe.sources.readers import game_dates

    return game_dates(S._t(spark, d, "events").select(F.col("user_id").alias("game_id"), F.to_date("ts").alias("game_date")))


@query("SRC20_last_record_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def src20(spark, d):
    return asof.last_record(S._t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SRC21_distinct_with_count", "SELECT DISTINCT home_team_id FROM games0", "games0")
def src21(spark, d):
    return S.games0(spark, d).select("home_team_id").distinct()


# --- hashes, reports -----------------------------------------------------------------------------


@query("HSH03_row_digest", "SELECT o_orderkey, sha256('=' || o_orderkey || '|=' || o_orderstatus || '|=' || o_orderpriority) AS digest FROM orders")
def hsh03(spark, d):
    o = S._t(spark, d, "orders")
    return o.select("o_orderkey", reporting.row_digest(o, ["o_orderkey", "o_orderstatus", "o_orderpriority"]).alias("digest"))


@query("HSH03_table_digest", "WITH r AS (SELECT sha256('=' || o_orderkey || '|=' || o_orderstatus) AS d FROM orders), p AS (SELECT substr(d, 1, 4) AS p, sha256(string_agg(d, '' ORDER BY d)) AS s, count(*) AS n FROM r GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS row_count, sha256(string_agg(s, '' ORDER BY p)) AS digest FROM p")
def hsh03b(spark, d):
    return reporting.table_digest(S._t(spark, d, "orders"), ["o_orderkey", "o_orderstatus"])


@query("AGG40_corpus_fingerprint", "SELECT substr(sha256(string_agg(game_id, '' ORDER BY game_id) || count(*)), 1, 16) AS fingerprint, count(*) AS ids FROM (SELECT DISTINCT game_id FROM games0)", "games0")
def agg40(spark, d):
    return reporting.corpus_fingerprint(S.games0(spark, d))


@query("AGG14_season_status", "SELECT season, rapm_coverage_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY season), 10) AS rate FROM mart GROUP BY 1, 2", "mart")
def agg14(spark, d):
    return reporting.season_status(mart(spark, d))


@query("AGG15_null_counts", "SELECT 'rapm_source_season' AS column_name, count(*) FILTER (WHERE rapm_source_season IS NULL) AS nulls FROM mart UNION ALL SELECT 'home_score', count(*) FILTER (WHERE home_score IS NULL) FROM mart", "mart")
def agg15(spark, d):
    return reporting.null_counts(mart(spark, d), ["rapm_source_season", "home_score"])


@query("AGG39_RPT04_game_shape", "SELECT game_id, arg_max(p, (period, possession_number)) AS last_p, max(p) AS max_p, min(p) AS min_p, count(*) AS states FROM (SELECT *, points / 4.0 AS p FROM poss) GROUP BY 1", "poss")
def agg39(spark, d):
    return reporting.game_shape(S.poss(spark, d).withColumn("p", F.col("points") / 4.0))


@query("PRJ51_normalised_time", "SELECT game_id, period, possession_number, round(CASE WHEN hi > lo THEN (t - lo) / (hi - lo) ELSE 0.0 END, 9) AS x FROM (SELECT *, elapsed_game_seconds AS t, min(elapsed_game_seconds) OVER (PARTITION BY game_id) AS lo, max(elapsed_game_seconds) OVER (PARTITION BY game_id) AS hi FROM state)", "state")
def prj51(spark, d):
    p = S.poss(spark, d).withColumn("elapsed_game_seconds", X.cumulative_elapsed(F.col("start_seconds"), F.col("period")))
    return reporting.normalised_time(p).select(*KEY, F.round("x", 9).alias("x"))


@query("AGG16_game_results", "SELECT game_id, arg_min(season, (period, possession_number)) AS season, max(home_score) AS home_final_points, max(away_score) AS away_final_points, max(possession_number) AS possessions FROM mart GROUP BY 1", "mart")
def agg16(spark, d):
    return pregame.game_results(mart(spark, d)).select("game_id", "season", "home_final_points", "away_final_points", "possessions")


@query("AGG17_JON12_PRE01_pregame_table", "WITH s AS (SELECT season, team_id, round(avg(net), 8) AS strength FROM (SELECT season, home_team_id AS team_id, home_lineup_net_rapm AS net FROM mart UNION ALL SELECT season, away_team_id, away_lineup_net_rapm FROM mart) GROUP BY 1, 2), o AS (SELECT game_id, season, home_team_id, away_team_id, home_win FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY period, possession_number) AS k FROM mart) WHERE k = 1) SELECT game_id, round(h.strength, 6) AS home_strength, round(a.strength, 6) AS away_strength, home_win FROM o LEFT JOIN s h ON h.season = o.season AND h.team_id = o.home_team_id LEFT JOIN s a ON a.season = o.season AND a.team_id = o.away_team_id", "mart")
def pre01(spark, d):
    t = pregame.pregame_table(mart(spark, d))
    return t.select("game_id", F.round("home_strength", 6).alias("home_strength"), F.round("away_strength", 6).alias("away_strength"), "home_win")


def _players(spark, d):
    return S.box(spark, d).join(S.games0(spark, d).select("game_id", "season"), "game_id").select("game_id", "team_id", "season", F.col("person_id").alias("player_id"), F.expr("person_id % 9 <> 4").alias("available"))


@query("AGG27_unavailable", "SELECT game_id, team_id, coalesce(string_agg(CASE WHEN person_id % 9 = 4 THEN CAST(person_id AS VARCHAR) END, '-' ORDER BY person_id), '') AS out_ids, count(*) AS listed, CAST(count(*) FILTER (WHERE person_id % 9 = 4) AS INTEGER) AS out_count FROM box GROUP BY 1, 2", "box")
def agg27(spark, d):
    return pregame.unavailable(_players(spark, d)).withColumn("out_ids", X.lineup_id(F.col("out_ids")))


@query("AGG28_rosters", "SELECT DISTINCT season, team_id, person_id AS player_id FROM box JOIN games0 USING (game_id)", "box")
def agg28(spark, d):
    return pregame.rosters(_players(spark, d))


@query("AGG26_JON17_PRE07_availability_strength", "SELECT game_id, team_id, round(CASE WHEN sum(w) > 0 THEN sum(w * r) / sum(w) ELSE 0 END, 10) AS full_strength, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS missing FROM (SELECT b.game_id, b.team_id, b.person_id % 9 <> 4 AS ok, coalesce(net_rating, 0.0) AS r, coalesce(CAST(n_possessions AS DOUBLE), 0.0) AS w FROM box b JOIN games0 g USING (game_id) LEFT JOIN ratings r ON r.player_id = b.person_id AND r.season + 1 = g.season) GROUP BY 1, 2", "box", "ratings")
def pre07(spark, d):
    a = pregame.availability_strength(_players(spark, d), S.ratings(spark, d))
    return a.select("game_id", "team_id", "full_strength", "missing")


@query("AGG36_MKT03_MKT04_coverage", "SELECT status, count(*) AS games, count(*) FILTER (WHERE status <> 'x' AND mt < 5) AS thin FROM (SELECT CASE WHEN o_orderkey % 10 = 1 THEN 'event_not_found' WHEN o_orderkey % 10 = 2 THEN 'orientation_mismatch' WHEN o_orderkey % 10 = 3 THEN 'no_pretip_ticks' WHEN greatest(o_orderkey % 7, o_orderkey % 11) * 10000 > 86400 THEN 'stale_last_tick' ELSE 'covered' END AS status, least(o_orderkey % 13, o_orderkey % 17) AS mt FROM orders) GROUP BY 1")
def agg36(spark, d):
    m = S._t(spark, d, "orders").select(F.col("o_orderkey").alias("game_id"), F.expr("o_orderkey % 10 <> 1").alias("found"), F.expr("o_orderkey % 10 <> 2").alias("oriented"), F.expr("case when o_orderkey % 10 <> 3 then 0.6D end").alias("home_price"), F.lit(0.5).alias("away_price"), F.expr("o_orderkey % 7 * 10000").alias("home_gap"), F.expr("o_orderkey % 11 * 10000").alias("away_gap"), F.expr("o_orderkey % 13").alias("home_ticks"), F.expr("o_orderkey % 17").alias("away_ticks"))
    return pregame.coverage_counts(pregame.snapshot(m))


@query("JON18_BAY12_AGG34_stability", "SELECT count(*) AS pairs, round(corr(a.net_rating, b.net_rating), 8) AS r FROM ratings a JOIN ratings b ON a.player_id = b.player_id AND b.season = a.season + 1", "ratings")
def jon18(spark, d):
    from tallyframe.operators.linalg import stability

    return stability(S.ratings(spark, d))


@query("AGG25_final_score_from_log", "SELECT game_id, coalesce(max(try_cast(nullif(score_home, '') AS INTEGER)), 0) AS home, coalesce(max(try_cast(nullif(score_away, '') AS INTEGER)), 0) AS away FROM raw_actions GROUP BY 1", "raw_actions")
def agg25(spark, d):
    return eventlog.final_score_from_log(S.raw_actions(spark, d))


@query("EVT04_EVT05_AGG01_stints", "SELECT game_id, team_id, b AS start_seconds, e AS end_seconds, CASE WHEN b < t THEN '1-2-3-4-5' ELSE '1-2-3-4-6' END AS lineup_id FROM (SELECT game_id, team_id, t, unnest([{'b': 0.0, 'e': th}, {'b': th, 'e': ta}, {'b': ta, 'e': 720.0}], recursive := true) FROM (SELECT game_id, 1 AS team_id, CAST(60.0 * (1 + o_orderkey % 5) AS DOUBLE) AS th, CAST(60.0 * (6 + o_orderkey % 5) AS DOUBLE) AS ta, CAST(60.0 * (1 + o_orderkey % 5) AS DOUBLE) AS t FROM games0 UNION ALL SELECT game_id, 2, CAST(60.0 * (1 + o_orderkey % 5) AS DOUBLE), CAST(60.0 * (6 + o_orderkey % 5) AS DOUBLE), CAST(60.0 * (6 + o_orderkey % 5) AS DOUBLE) FROM games0))", "games0")
def evt04(spark, d):
    """Five players a team; one substitution each, at different times."""
    g = S.games0(spark, d).select("game_id", "o_orderkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("team_id"))
    move = lambda p, o, k, t: F.struct(F.lit(p).alias("player_id"), F.lit(o).alias("ord"), F.lit(k).alias("kind"), t.cast("double").alias("seconds"))
    at = 60.0 * ((F.col("team_id") - 1) * 5 + 1 + F.col("o_orderkey") % 5)
    m = g.select("game_id", F.lit(1).alias("period"), "team_id", F.explode(F.array(*[move(p, p, "act", F.lit(0.0)) for p in range(1, 6)], move(5, 10, "out", at), move(6, 11, "in", at))).alias("x")).select("game_id", "period", "team_id", "x.*")
    s, _ = eventlog.stints(m, eventlog.period_starters(m))
    return s.select("game_id", "team_id", "start_seconds", "end_seconds", "lineup_id")


@query("EVT02_JON19_lineup_actions", None)
def evt02(spark, d):
    r = S.raw_actions(spark, d).withColumns({"person_id": (F.col("ord") % 9 + 1).cast("long"), "team_id": F.nullif("team_id", F.lit(0))})
    sub = F.col("ord") % 7 == 3
    r = r.withColumns({"action_type": F.when(sub, "Substitution").otherwise(F.col("action_type")), "description": F.when(sub, F.concat(F.lit("SUB: P"), (F.col("ord") % 5 + 1).cast("string"), F.lit(" FOR Q"))).otherwise(F.col("description"))})
    roster = r.select("game_id", "team_id").where("team_id is not null").distinct().select("game_id", "team_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("player_id")).withColumns({"short_name": F.concat(F.lit("P"), F.col("player_id").cast("string")), "family_name": F.concat(F.lit("F"), F.col("player_id").cast("string"))})
    return eventlog.lineup_actions(r, roster)


@query("EVT14_box_truth", "SELECT t.game_id, t.team_id, t.final_score, c.possessions, b.player_seconds FROM (SELECT game_id, home_team_id AS team_id, home_final_score AS final_score FROM games UNION ALL SELECT game_id, away_team_id, away_final_score FROM games) t LEFT JOIN (SELECT game_id, offense_team_id AS team_id, CAST(count(*) AS DOUBLE) AS possessions FROM poss GROUP BY 1, 2) c USING (game_id, team_id) LEFT JOIN (SELECT game_id, team_id, CAST(sum(box_seconds) AS BIGINT) AS player_seconds FROM box GROUP BY 1, 2) b USING (game_id, team_id)", "games", "box")
def evt14(spark, d):
    adv = S.poss(spark, d, by_game=True).groupBy("game_id", F.col("offense_team_id").alias("team_id")).agg(F.count("*").cast("double").alias("possessions"))
    return eventlog.box_truth(S.box(spark, d), adv, S.games(spark, d, by_game=True))


def _fixture_documents(spark, d):
    """Box documents made from games, written as JSON in the session's shared folder and read back."""
    from tallyframe.sources import readers

    path = sinks.scratch(spark, "box-json")
    team = lambda s: F.struct(F.col(f"{s}_team_id").alias("teamId"), F.struct(F.col(f"{s}_final_score").alias("points")).alias("statistics"), F.array(F.struct(F.col(f"{s}_team_id").alias("personId"), F.lit("A. B").alias("nameI"), F.struct(F.lit("12:30").alias("minutes"), F.lit(3).alias("fieldGoalsAttempted")).alias("statistics"))).alias("players"))
    doc = F.struct(F.col("game_id").alias("gameId"), F.col("home_team_id").alias("homeTeamId"), F.col("away_team_id").alias("awayTeamId"), team("home").alias("homeTeam"), team("away").alias("awayTeam"))
    S.games(spark, d).select(doc.alias("boxScoreTraditional")).write.json(path)
    return spark.read.schema(readers.BOX).json(path)


@query("SRC01_SRC02_SRC05_PRJ01_dim_games_from_json", "SELECT game_id, season, CASE substr(game_id, 1, 3) WHEN '002' THEN 'Regular Season' WHEN '004' THEN 'Playoffs' ELSE 'Unknown' END AS season_type, home_team_id, away_team_id, home_final_score, away_final_score, game_date FROM games", "games")
def src01(spark, d):
    return marts.dim_games(_fixture_documents(spark, d), S.games(spark, d).select("game_id", F.col("game_date").cast("string").alias("game_date")))


@query("SRC03_SRC04_ARR02_SET01_box_from_json", "SELECT game_id, team_id, team_id AS person_id, 750 AS box_seconds, is_home FROM (SELECT game_id, home_team_id AS team_id, TRUE AS is_home FROM games UNION ALL SELECT game_id, away_team_id, FALSE FROM games)", "games")
def src03(spark, d):
    return marts.stg_box_player(_fixture_documents(spark, d)).select("game_id", "team_id", "person_id", "box_seconds", "is_home")
