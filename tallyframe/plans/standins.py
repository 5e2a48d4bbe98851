"""The engine's tables made from the driver's: the same definitions as DataFrames and as SQL.

An order stands for a game, its line items for possessions, parts for players, events for actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files for a partition: some 150,000 line items, some 100,000 events.
PART_BYTES = {"lineitem": 2 << 20, "events": 2 << 20}


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Partitions for what is made of a table: their number follows the input, so that a task's memory doesn't."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    # tables that are both partitioned by game are joined where they are on game and more; stays with the session, as plans are made when they run
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES[name]))


def games0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games without final scores."""
    o = _t(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.expr("concat('00', case when o_orderkey % 10 = 0 then '4' else '2' end, lpad(cast(year(o_orderdate) - 1976 as string), 2, '0'), lpad(cast(o_orderkey as string), 7, '0'))").alias("game_id"),
        F.expr("cast(year(o_orderdate) + 24 as int)").alias("season"),
        F.expr("cast(o_custkey % 30 + 1 as bigint)").alias("home_team_id"),
        F.expr("cast((o_custkey % 30 + 1 + o_orderkey % 29) % 30 + 1 as bigint)").alias("away_team_id"),
        F.expr("cast(o_orderdate as date)").alias("game_date"),
    )


def _poss0(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition(parts(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("rn", F.row_number().over(w) - 1)
    return li.withColumns({"home": F.expr("(l_suppkey + l_linenumber) % 2 = 0"), "points": F.expr("cast(cast(l_quantity as int) % 4 as int)")})


def poss(spark: SparkSession, sf_dir: str, *, by_game: bool = False) -> DataFrame:
    """Possessions in the shape of the reconstruction's output; ``by_game``: with each game in one partition,
    for steps by game (the fives are made behind that shuffle)."""
    j = _poss0(spark, sf_dir).join(games0(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    if by_game:
        j = j.repartition(parts(spark, sf_dir, "lineitem"), "game_id")
    return j.select(
        "game_id", "season",
        F.expr("cast(rn div 3 + 1 as int)").alias("period"),
        F.expr("cast(rn % 3 + 1 as int)").alias("possession_number"),
        F.expr("case when home then home_team_id else away_team_id end").alias("offense_team_id"),
        F.expr("case when home then away_team_id else home_team_id end").alias("defense_team_id"),
        "points",
        F.expr("cast((rn % 3) * 80.0 + l_quantity as double)").alias("start_seconds"),
        F.expr("cast((rn % 3) * 80.0 + l_quantity + 24.0 as double)").alias("end_seconds"),
        F.expr("array_sort(transform(sequence(0, case when l_partkey % 50 = 0 then 3 else 4 end), k -> (l_partkey * 7 + k * 13) % 300 + 1))").alias("offense_five"),
        F.expr("array_sort(transform(sequence(0, 4), k -> (l_suppkey * 11 + l_partkey + k * 17) % 300 + 301))").alias("defense_five"),
        F.expr("cast(rn * 2 + l_partkey % 2 as int)").alias("home_score_before"),
        F.expr("cast(rn + l_suppkey % 2 as int)").alias("away_score_before"),
    )


def games(spark: SparkSession, sf_dir: str, *, by_game: bool = False) -> DataFrame:
    """Games with final scores; one in 97 has a point too many. ``by_game``: partitioned as possessions are."""
    side = lambda home: F.sum(F.when(F.col("home") == home, F.col("points")).otherwise(0))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("(l_suppkey + l_linenumber) % 2 = 0").alias("home"), F.expr("cast(l_quantity as int) % 4").alias("points"))
    p = li.repartition(parts(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(side(True).alias("hp"), side(False).alias("ap"))
    j = games0(spark, sf_dir).join(p, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if by_game:
        j = j.repartition(parts(spark, sf_dir, "lineitem"), "game_id")
    return j.select("game_id", "season", "home_team_id", "away_team_id", "game_date", F.expr("cast(coalesce(hp, 0) + case when o_orderkey % 97 = 0 then 1 else 0 end as int)").alias("home_final_score"), F.expr("cast(coalesce(ap, 0) as int)").alias("away_final_score"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-season ratings."""
    return _t(spark, sf_dir, "part").where("p_partkey < 4200").select(F.expr("cast(p_partkey % 600 + 1 as bigint)").alias("player_id"), F.expr("cast(2019 + p_partkey div 600 as int)").alias("season"), F.expr("cast(p_partkey * 37 % 1000 / 64.0D - 5.0D as double)").alias("off_rating"), F.expr("cast(p_size % 20 / 4.0D - 2.5D as double)").alias("def_rating"), F.expr("cast(p_partkey * 37 % 1000 / 64.0D - 5.0D as double) - cast(p_size % 20 / 4.0D - 2.5D as double)").alias("net_rating"), F.expr("cast(p_partkey % 211 * 10 as bigint)").alias("n_possessions"))


def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stint rows a possession, by game."""
    return stints_of(poss(spark, sf_dir, by_game=True))


def stints_of(p: DataFrame) -> DataFrame:
    """The stints of given possessions."""
    row = lambda t, five: F.struct(F.col(t).alias("team_id"), F.col(five).alias("five"))
    return p.select("game_id", "season", "period", F.explode(F.array(row("offense_team_id", "offense_five"), row("defense_team_id", "defense_five"))).alias("x"), F.expr("end_seconds - start_seconds + points").alias("seconds")).select("game_id", "season", "period", "x.team_id", "x.five", "seconds")


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player box rows: what the stints give, with some noise."""
    return box_of(stints(spark, sf_dir))


def box_of(rows: DataFrame) -> DataFrame:
    """The box of given stints."""
    s = rows.select("game_id", "team_id", F.explode("five").alias("person_id"), "seconds")
    g = s.groupBy("game_id", "team_id", "person_id").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))
    return g.select("game_id", "team_id", "person_id", F.expr("concat('P', cast(person_id as string))").alias("player_name"), F.expr("cast(case when person_id % 23 = 0 then 0 else seconds + person_id % 7 * 12 end as int)").alias("box_seconds"), F.expr("cast(n * 3 as int)").alias("fga"), F.expr("cast(person_id % 5 as int)").alias("fta"), F.expr("cast(person_id % 3 as int)").alias("oreb"), F.expr("cast(person_id % 4 as int)").alias("tov"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One game in 41."""
    return games0(spark, sf_dir).where("o_orderkey % 41 = 0").select("game_id", F.lit("built_bad").alias("reason"))


def raw_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw actions from events: user = game, twelve actions a period."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = parts(spark, sf_dir, "events")
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts").repartition(n, "user_id").select("event_id", "user_id", "value", (F.row_number().over(w) - 1).alias("rn"), F.expr("concat('G', lpad(cast(user_id as string), 6, '0'))").alias("game_id")).repartition(n, "game_id")
    h = "(event_id * 7919 + 13) % 101"
    kind = f"case when rn % 12 = 11 then 'period' when {h} < 22 then 'Made Shot' when {h} < 40 then 'Missed Shot' when {h} < 60 then 'Rebound' when {h} < 68 then 'Turnover' when {h} < 84 then 'Free Throw' when {h} < 94 then 'Foul' else 'Timeout' end"
    sub = f"case when rn % 12 = 11 then 'end' when {h} between 68 and 69 then 'Free Throw Technical' when {h} between 70 and 71 then 'Free Throw Flagrant 1 of 2' when {h} between 72 and 77 then 'Free Throw 1 of 2' when {h} between 78 and 80 then 'Free Throw 2 of 2' when {h} between 81 and 83 then 'Free Throw 1 of 1' when {h} between 84 and 85 then 'Personal Take' when {h} between 86 and 87 then 'Away From Play' else '' end"
    return e.select(
        "game_id", F.col("rn").cast("int").alias("ord"),
        F.expr("cast(rn div 12 + 1 as int)").alias("period"),
        F.expr("concat('PT', lpad(cast(11 - rn % 12 as string), 2, '0'), 'M', lpad(cast(59 - event_id % 60 as string), 2, '0'), '.00S')").alias("clock"),
        F.expr("cast(case when event_id % 29 = 0 then 0 else event_id % 2 + 1 end as bigint)").alias("team_id"),
        F.expr(kind).alias("action_type"), F.expr(sub).alias("sub_type"),
        F.expr("case when event_id % 5 = 0 then 'MISS throw' else 'throw' end").alias("description"),
        F.expr("cast(case when event_id % 3 = 0 then 3 when event_id % 3 = 1 then 2 else 0 end as int)").alias("shot_value"),
        F.expr("case when event_id % 4 = 0 then cast(rn * 2 as string) else '' end").alias("score_home"),
        F.expr("case when event_id % 4 = 1 then cast(rn as string) else '' end").alias("score_away"),
    )


#: Common table expressions, each with those it needs.
SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "games0": (
        "SELECT o_orderkey, '00' || CASE WHEN o_orderkey % 10 = 0 THEN '4' ELSE '2' END || lpad(CAST(year(o_orderdate) - 1976 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS game_id, CAST(year(o_orderdate) + 24 AS INTEGER) AS season, CAST(o_custkey % 30 + 1 AS BIGINT) AS home_team_id, CAST((o_custkey % 30 + 1 + o_orderkey % 29) % 30 + 1 AS BIGINT) AS away_team_id, CAST(o_orderdate AS DATE) AS game_date FROM orders",
        (),
    ),
    "li": ("SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS rn FROM lineitem", ()),
    "poss": (
        "SELECT game_id, season, CAST(rn // 3 + 1 AS INTEGER) AS period, CAST(rn % 3 + 1 AS INTEGER) AS possession_number, CASE WHEN (l_suppkey + l_linenumber) % 2 = 0 THEN home_team_id ELSE away_team_id END AS offense_team_id, CASE WHEN (l_suppkey + l_linenumber) % 2 = 0 THEN away_team_id ELSE home_team_id END AS defense_team_id, CAST(CAST(l_quantity AS INTEGER) % 4 AS INTEGER) AS points, CAST((rn % 3) * 80.0 + l_quantity AS DOUBLE) AS start_seconds, CAST((rn % 3) * 80.0 + l_quantity + 24.0 AS DOUBLE) AS end_seconds, list_sort([(l_partkey * 7 + k * 13) % 300 + 1 for k in range(0, CASE WHEN l_partkey % 50 = 0 THEN 4 ELSE 5 END)]) AS offense_five, list_sort([(l_suppkey * 11 + l_partkey + k * 17) % 300 + 301 for k in range(0, 5)]) AS defense_five, CAST(rn * 2 + l_partkey % 2 AS INTEGER) AS home_score_before, CAST(rn + l_suppkey % 2 AS INTEGER) AS away_score_before FROM li JOIN games0 ON l_orderkey = o_orderkey",
        ("games0", "li"),
    ),
    "pts": ("SELECT game_id, offense_team_id AS t, sum(points) AS pts FROM poss GROUP BY ALL", ("poss",)),
    "games": (
        "SELECT g.game_id, season, home_team_id, away_team_id, game_date, CAST(coalesce(h.pts, 0) + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS INTEGER) AS home_final_score, CAST(coalesce(a.pts, 0) AS INTEGER) AS away_final_score FROM games0 g LEFT JOIN pts h ON h.game_id = g.game_id AND h.t = g.home_team_id LEFT JOIN pts a ON a.game_id = g.game_id AND a.t = g.away_team_id",
        ("pts",),
    ),
    "ratings": ("SELECT CAST(p_partkey % 600 + 1 AS BIGINT) AS player_id, CAST(2019 + p_partkey // 600 AS INTEGER) AS season, CAST(p_partkey * 37 % 1000 / 64.0 - 5.0 AS DOUBLE) AS off_rating, CAST(p_size % 20 / 4.0 - 2.5 AS DOUBLE) AS def_rating, CAST(p_partkey * 37 % 1000 / 64.0 - 5.0 AS DOUBLE) - CAST(p_size % 20 / 4.0 - 2.5 AS DOUBLE) AS net_rating, CAST(p_partkey % 211 * 10 AS BIGINT) AS n_possessions FROM part WHERE p_partkey < 4200", ()),
    "stints": ("SELECT game_id, season, period, offense_team_id AS team_id, offense_five AS five, end_seconds - start_seconds + points AS seconds FROM poss UNION ALL SELECT game_id, season, period, defense_team_id, defense_five, end_seconds - start_seconds + points FROM poss", ("poss",)),
    "box": (
        "SELECT game_id, team_id, person_id, 'P' || person_id AS player_name, CAST(CASE WHEN person_id % 23 = 0 THEN 0 ELSE seconds + person_id % 7 * 12 END AS INTEGER) AS box_seconds, CAST(n * 3 AS INTEGER) AS fga, CAST(person_id % 5 AS INTEGER) AS fta, CAST(person_id % 3 AS INTEGER) AS oreb, CAST(person_id % 4 AS INTEGER) AS tov FROM (SELECT game_id, team_id, person_id, sum(seconds) AS seconds, count(*) AS n FROM (SELECT game_id, team_id, unnest(five) AS person_id, seconds FROM stints) GROUP BY ALL)",
        ("stints",),
    ),
    "quarantine": ("SELECT game_id, 'built_bad' AS reason FROM games0 WHERE o_orderkey % 41 = 0", ("games0",)),
    "ev": ("SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, (event_id * 7919 + 13) % 101 AS h FROM events", ()),
    "raw_actions": (
        "SELECT 'G' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS game_id, CAST(rn AS INTEGER) AS ord, CAST(rn // 12 + 1 AS INTEGER) AS period, 'PT' || lpad(CAST(11 - rn % 12 AS VARCHAR), 2, '0') || 'M' || lpad(CAST(59 - event_id % 60 AS VARCHAR), 2, '0') || '.00S' AS clock, CAST(CASE WHEN event_id % 29 = 0 THEN 0 ELSE event_id % 2 + 1 END AS BIGINT) AS team_id, CASE WHEN rn % 12 = 11 THEN 'period' WHEN h < 22 THEN 'Made Shot' WHEN h < 40 THEN 'Missed Shot' WHEN h < 60 THEN 'Rebound' WHEN h < 68 THEN 'Turnover' WHEN h < 84 THEN 'Free Throw' WHEN h < 94 THEN 'Foul' ELSE 'Timeout' END AS action_type, CASE WHEN rn % 12 = 11 THEN 'end' WHEN h BETWEEN 68 AND 69 THEN 'Free Throw Technical' WHEN h BETWEEN 70 AND 71 THEN 'Free Throw Flagrant 1 of 2' WHEN h BETWEEN 72 AND 77 THEN 'Free Throw 1 of 2' WHEN h BETWEEN 78 AND 80 THEN 'Free Throw 2 of 2' WHEN h BETWEEN 81 AND 83 THEN 'Free Throw 1 of 1' WHEN h BETWEEN 84 AND 85 THEN 'Personal Take' WHEN h BETWEEN 86 AND 87 THEN 'Away From Play' ELSE '' END AS sub_type, CASE WHEN event_id % 5 = 0 THEN 'MISS throw' ELSE 'throw' END AS description, CAST(CASE WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 3 = 1 THEN 2 ELSE 0 END AS INTEGER) AS shot_value, CASE WHEN event_id % 4 = 0 THEN CAST(rn * 2 AS VARCHAR) ELSE '' END AS score_home, CASE WHEN event_id % 4 = 1 THEN CAST(rn AS VARCHAR) ELSE '' END AS score_away FROM ev",
        ("ev",),
    ),
    "state": (
        "SELECT *, CAST(coalesce(sum(CASE WHEN offense_team_id = home_team_id THEN points ELSE 0 END) OVER w, 0) AS INTEGER) AS home_score, CAST(coalesce(sum(CASE WHEN offense_team_id = away_team_id THEN points ELSE 0 END) OVER w, 0) AS INTEGER) AS away_score, CASE WHEN offense_team_id = home_team_id THEN offense_five ELSE defense_five END AS home_five, CASE WHEN offense_team_id = away_team_id THEN offense_five ELSE defense_five END AS away_five, CASE WHEN period <= 4 THEN 720.0 ELSE 300.0 END - start_seconds AS game_clock_seconds, CASE WHEN period <= 4 THEN (period - 1) * 720.0 ELSE 2880.0 + (period - 5) * 300.0 END + start_seconds AS elapsed_game_seconds, CASE WHEN season IN (2022, 2023) THEN 'train' WHEN season = 2024 THEN 'validation' WHEN season = 2025 THEN 'test' ELSE 'audit_only' END AS split FROM (SELECT p.*, game_date, home_team_id, away_team_id, home_final_score, away_final_score FROM poss p JOIN games USING (game_id)) WINDOW w AS (PARTITION BY game_id ORDER BY period, possession_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        ("poss", "games"),
    ),
    "strength": (
        "SELECT game_id, period, possession_number, side, count(r.player_id) AS rated, round(sum(coalesce(off_rating, 0.0)), 10) AS o, round(sum(coalesce(def_rating, 0.0)), 10) AS d, round(sum(coalesce(net_rating, 0.0)), 10) AS n FROM (SELECT game_id, period, possession_number, season, 'home' AS side, unnest(home_five) AS pid FROM state UNION ALL SELECT game_id, period, possession_number, season, 'away', unnest(away_five) FROM state) e LEFT JOIN ratings r ON r.player_id = pid AND r.season = e.season - 1 GROUP BY 1, 2, 3, 4",
        ("state", "ratings"),
    ),
    "mart": (
        "SELECT s.game_id, s.season, s.game_date, s.period, s.possession_number, game_clock_seconds, elapsed_game_seconds, greatest(0.0, 2880.0 - elapsed_game_seconds) AS regulation_seconds_remaining, home_team_id, away_team_id, offense_team_id AS possession_team_id, offense_team_id = home_team_id AS home_has_possession, home_score, away_score, home_score - away_score AS home_score_differential, home_score_before AS feed_home_score_before, away_score_before AS feed_away_score_before, home_five, away_five, home_final_score > away_final_score AS home_win, CASE WHEN season <> 2021 THEN season - 1 END AS rapm_source_season, h.o AS home_lineup_off_rapm, h.d AS home_lineup_def_rapm, h.n AS home_lineup_net_rapm, a.o AS away_lineup_off_rapm, a.d AS away_lineup_def_rapm, a.n AS away_lineup_net_rapm, round(h.n - a.n, 10) AS lineup_net_rapm_differential, CASE WHEN season = 2021 THEN 'cold_start' WHEN h.rated = 5 AND a.rated = 5 THEN 'full' WHEN h.rated = 0 AND a.rated = 0 THEN 'replacement_only' ELSE 'partial' END AS rapm_coverage_status, h.rated AS home_rated_players, a.rated AS away_rated_players, 10 - h.rated - a.rated AS replacement_player_appearances, split FROM state s JOIN strength h ON (h.game_id, h.period, h.possession_number, h.side) = (s.game_id, s.period, s.possession_number, 'home') JOIN strength a ON (a.game_id, a.period, a.possession_number, a.side) = (s.game_id, s.period, s.possession_number, 'away')",
        ("state", "strength"),
    ),
    "val_minutes": (
        "SELECT b.game_id, b.team_id, b.person_id, player_name, coalesce(seconds, 0.0) AS reconstructed_seconds, box_seconds, coalesce(seconds, 0.0) - box_seconds AS residual_seconds FROM box b LEFT JOIN (SELECT game_id, team_id, person_id, sum(seconds) AS seconds FROM (SELECT game_id, team_id, unnest(five) AS person_id, seconds FROM stints) GROUP BY ALL) r USING (game_id, team_id, person_id) WHERE box_seconds > 0 AND b.game_id NOT IN (SELECT game_id FROM quarantine)",
        ("box", "quarantine"),
    ),
    "val_possessions": (
        "SELECT t.game_id, t.team_id, coalesce(c, 0) AS counted_possessions, fga - oreb + tov + 0.44 * fta AS estimated_possessions, coalesce(pp, 0) AS possession_points, final_score, coalesce(pp, 0) = final_score AS points_reconciliation_ok FROM (SELECT game_id, home_team_id AS team_id, home_final_score AS final_score FROM games WHERE game_id NOT IN (SELECT game_id FROM quarantine) UNION ALL SELECT game_id, away_team_id, away_final_score FROM games WHERE game_id NOT IN (SELECT game_id FROM quarantine)) t LEFT JOIN (SELECT game_id, team_id, sum(fga) AS fga, sum(fta) AS fta, sum(oreb) AS oreb, sum(tov) AS tov FROM box GROUP BY ALL) b USING (game_id, team_id) LEFT JOIN (SELECT game_id, offense_team_id AS team_id, count(*) AS c, sum(points) AS pp FROM poss GROUP BY ALL) k USING (game_id, team_id)",
        ("games", "box", "quarantine"),
    ),
    "val_quarantine": (
        "SELECT game_id, reason FROM quarantine UNION ALL SELECT DISTINCT game_id, 'lineup_not_five' FROM stints WHERE len(five) <> 5 UNION ALL SELECT DISTINCT game_id, 'possession_points_mismatch' FROM val_possessions WHERE NOT points_reconciliation_ok UNION ALL SELECT DISTINCT game_id, 'minutes_residual_exceeds_tolerance' FROM val_minutes WHERE abs(residual_seconds) > 60",
        ("val_possessions", "val_minutes"),
    ),
    "ledger": (
        "SELECT game_id, season, game_date, possessions, team_id, points_for, points_against, is_home, CAST(points_for > points_against AS INTEGER) AS won FROM (SELECT game_id, season, game_date, n AS possessions, home_team_id AS team_id, home_final_score AS points_for, away_final_score AS points_against, TRUE AS is_home FROM games JOIN pn USING (game_id) UNION ALL SELECT game_id, season, game_date, n, away_team_id, away_final_score, home_final_score, FALSE FROM games JOIN pn USING (game_id))",
        ("games", "pn"),
    ),
    "pn": ("SELECT game_id, CAST(count(*) AS BIGINT) AS n FROM poss GROUP BY 1", ("poss",)),
    "scored": (
        "SELECT *, (p - y) * (p - y) AS brier, -CASE WHEN y = 1 THEN ln(p) ELSE ln(1.0 - p) END AS log_loss FROM (SELECT game_id, season, period, possession_number, home_score_differential AS margin, regulation_seconds_remaining AS remaining, CAST(home_win AS INTEGER) AS y, least(greatest(1.0 / (1.0 + exp(-(home_score_differential / 4.0 + lineup_net_rapm_differential / 40.0))), 1e-12), 1.0 - 1e-12) AS p FROM mart)",
        ("mart",),
    ),
}


def sql(query: str, *names: str) -> str:
    """``query`` with the expressions it names, and theirs, put before it."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in SQL[n][1]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return query
    # materialised: each expression is computed once, however often it is used
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n][0]})" for n in order)
    return head + (",\n" + query[5:] if query.startswith("WITH ") else "\n" + query)
