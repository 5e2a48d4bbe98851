"""Queries of the column builders, over columns derived from the part table, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import exprs as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: name -> (Spark SQL, DuckDB SQL) of the base columns; k is the part key
BASE = {
    "k": "p_partkey",
    "game_id": "concat('00', case when p_partkey % 5 = 0 then '4' when p_partkey % 7 = 0 then '1' else '2' end, lpad(cast(p_partkey % 7 + 19 as varchar(9)), 2, '0'), lpad(cast(p_partkey as varchar(9)), 7, '0'))",
    "season": "cast(2019 + p_partkey % 7 as int)",
    "period": "cast(p_partkey % 6 + 1 as int)",
    "elapsed": "cast(p_partkey % 400 as double)",
    "remaining": "cast(p_partkey * 7 % 2881 as double)",
    "margin": "cast(p_partkey % 61 - 30 as int)",
    "clock": "case when p_partkey % 17 = 0 then '' when p_partkey % 19 = 0 then 'junk' when p_partkey % 23 = 0 then concat('PT', lpad(cast(p_partkey % 60 as varchar(9)), 2, '0'), '.50S') else concat('PT', lpad(cast(p_partkey % 12 as varchar(9)), 2, '0'), 'M', lpad(cast(p_partkey * 7 % 60 as varchar(9)), 2, '0'), '.', lpad(cast(p_partkey % 100 as varchar(9)), 2, '0'), 'S') end",
    "minutes": "case when p_partkey % 13 = 0 then '' when p_partkey % 11 = 0 then null else concat(cast(p_partkey % 48 as varchar(9)), ':', lpad(cast(p_partkey % 60 as varchar(9)), 2, '0')) end",
    "minutes_f": "case when p_partkey % 13 = 0 then 'DNP' else concat(cast(p_partkey % 48 as varchar(9)), ':', lpad(cast(p_partkey % 60 as varchar(9)), 2, '0'), '.25') end",
    "score": "case when p_partkey % 4 = 0 then '' when p_partkey % 29 = 0 then 'x' else cast(p_partkey % 130 as varchar(9)) end",
    "action_type": "case p_partkey % 9 when 0 then 'Made Shot' when 1 then 'Missed Shot' when 2 then 'Rebound' when 3 then 'Turnover' when 4 then 'Free Throw' when 5 then 'Foul' when 6 then 'Jump Ball' when 7 then null else '' end",
    "sub_type": "case p_partkey % 7 when 0 then 'Free Throw Technical' when 1 then 'Free Throw Flagrant 2 of 3' when 2 then 'Free Throw 1 of 2' when 3 then 'Free Throw Clear Path 1 of 2' when 4 then 'Personal Take' when 5 then 'Away From Play' else null end",
    "description": "case p_partkey % 4 when 0 then ' MISS Smith Free Throw' when 1 then 'SUB: Ann Lee FOR Bo Ray' when 2 then 'Smith Free Throw' else 'SUB: X' end",
    "name": "case p_partkey % 5 when 0 then 'García Jr.' when 1 then 'Dončić' when 2 then 'O''Neal III' when 3 then 'Müller' else 'Smith' end",
    "odds_h": "1.05 + p_partkey % 40 / 10.0",
    "odds_a": "1.07 + p_partkey % 30 / 8.0",
    "price_h": "p_partkey % 21 / 20.0",
    "price_a": "p_partkey % 17 / 16.0",
    "y": "cast(p_partkey % 2 as int)",
    "p": "p_partkey % 101 / 100.0",
    "z": "p_partkey % 121 - 60.0",
    "day": "date_add(date '2024-01-01', cast(p_partkey % 300 as int))",
    "stamp": "concat('2024-0', cast(p_partkey % 9 + 1 as varchar(9)), '-15T19:30:00Z')",
    "comment": "case p_partkey % 6 when 0 then '' when 1 then 'DND - Injury/Illness' when 2 then 'DNP - Coach''s Decision' when 3 then 'NWT - Not With Team' when 4 then null else 'Something Else' end",
    "a": "cast(p_partkey % 5 as int)",
    "b": "cast(p_partkey % 3 as int)",
}


def _duck(sql: str) -> str:
    return sql.replace("varchar(9)", "varchar").replace("date_add(date '2024-01-01', cast(p_partkey % 300 as int))", "date '2024-01-01' + cast(p_partkey % 300 as integer)")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns; doubles are doubles, as in DuckDB."""
    double = {"odds_h", "odds_a", "price_h", "price_a", "p", "z"}
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(*[F.expr(f"cast({_spark_double(e)} as double)" if n in double else e.replace("varchar(9)", "string")).alias(n) for n, e in BASE.items()])


def _spark_double(e: str) -> str:
    """Decimal literals as doubles, so that arithmetic is the same in both engines."""
    import re

    return re.sub(r"(\d+\.\d+)", r"\1D", e)


BASE_SQL = "base AS (SELECT " + ", ".join(f"CAST({_duck(e)} AS DOUBLE) AS {n}" if n in {"odds_h", "odds_a", "price_h", "price_a", "p", "z"} else f"{_duck(e)} AS {n}" for n, e in BASE.items()) + " FROM part)"


def project(name: str, **columns: tuple[Callable, str]) -> None:
    """Register a query: k and each named column, as a Column builder and as SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return base(spark, sf_dir).select("k", *[f().alias(n) for n, (f, _) in columns.items()])

    QUERIES[name] = run
    ORACLES[name] = f"WITH {BASE_SQL} SELECT k, " + ", ".join(f"{s} AS {n}" for n, (_, s) in columns.items()) + " FROM base"


c = F.col
_LEN = "CASE WHEN period <= 4 THEN 720.0 ELSE 300.0 END"
_CLOCK = "CASE WHEN regexp_matches(clock, '^PT[0-9]+M[0-9.]+S$') THEN CAST(regexp_extract(clock, '^PT([0-9]+)M', 1) AS DOUBLE) * 60 + CAST(regexp_extract(clock, 'M([0-9.]+)S$', 1) AS DOUBLE) END"
_START = "CAST(least(period - 1, 4) * 720.0 + greatest(period - 5, 0) * 300.0 AS DOUBLE)"

project("PRJ01_nested_field", v=(lambda: F.struct(F.struct(c("season").alias("inner")).alias("outer"))["outer"]["inner"], "season"))
project("PRJ02_season_decode", v=(lambda: X.season_of(c("game_id")), "CAST(2000 + CAST(substr(game_id, 4, 2) AS INTEGER) AS INTEGER)"))
project("PRJ03_season_type", v=(lambda: X.season_type_of(c("game_id")), "CASE substr(game_id, 1, 3) WHEN '002' THEN 'Regular Season' WHEN '004' THEN 'Playoffs' ELSE 'Unknown' END"))
project("PRJ04_clock_remaining", v=(lambda: X.clock_remaining(c("clock")), _CLOCK))
project("PRJ05_clock_lenient", v=(lambda: X.clock_remaining_lenient(c("clock")), f"CASE WHEN regexp_matches(clock, '^PT[0-9.]+S$') THEN CAST(regexp_extract(clock, '^PT([0-9.]+)S$', 1) AS DOUBLE) ELSE {_CLOCK} END"))
project("PRJ06_clock_elapsed", v=(lambda: X.clock_elapsed(c("clock"), c("period")), f"coalesce({_LEN} - {_CLOCK}, 0.0)"))
project("PRJ07_period_length", v=(lambda: X.period_length(c("period")), f"CAST({_LEN} AS DOUBLE)"))
project("PRJ08_period_start", v=(lambda: X.period_start(c("period")), _START))
project("PRJ09_elapsed", ok=(lambda: X.elapsed_valid(c("elapsed"), c("period")), f"elapsed >= 0 AND elapsed <= {_LEN}"), total=(lambda: X.cumulative_elapsed(c("elapsed"), c("period")), f"{_START} + elapsed"))
project("PRJ10_box_seconds", v=(lambda: X.box_seconds(c("minutes")), "CAST(CASE WHEN minutes <> '' THEN CAST(split_part(minutes, ':', 1) AS INTEGER) * 60 + CAST(split_part(minutes, ':', 2) AS INTEGER) END AS INTEGER)"))
_FRAC = "CASE WHEN regexp_matches(minutes_f, '^[0-9]+:') THEN CAST(split_part(minutes_f, ':', 1) AS DOUBLE) * 60 + CAST(split_part(minutes_f, ':', 2) AS DOUBLE) END"
project("PRJ11_box_seconds_fractional", v=(lambda: X.box_seconds_fractional(c("minutes_f")), _FRAC))
project("PRJ12_minutes_played", v=(lambda: F.round(X.minutes_played(c("minutes_f")), 9), f"round(coalesce(({_FRAC}) / 60.0, 0.0), 9)"))
project("PRJ13_blank_to_null", v=(lambda: X.blank_to_null(c("score")), "nullif(score, '')"))
project("PRJ14_safe_cast", v=(lambda: X.safe_int(c("score")), "try_cast(nullif(score, '') AS INTEGER)"))
project("PRJ15_zero_if_null", v=(lambda: X.zero_if_null(X.box_seconds(c("minutes"))), "CAST(coalesce(CASE WHEN minutes <> '' THEN CAST(split_part(minutes, ':', 1) AS INTEGER) * 60 + CAST(split_part(minutes, ':', 2) AS INTEGER) END, 0) AS INTEGER)"))
project("PRJ16_optional_int", v=(lambda: X.optional_int(c("score")), "nullif(try_cast(nullif(score, '') AS INTEGER), 0)"))
project("PRJ17_event_map", v=(lambda: X.event_of(c("action_type")), "CASE action_type WHEN 'Made Shot' THEN 'made_shot' WHEN 'Missed Shot' THEN 'missed_shot' WHEN 'Rebound' THEN 'rebound' WHEN 'Turnover' THEN 'turnover' WHEN 'Free Throw' THEN 'free_throw' ELSE 'delay' END"))
_TECH = "coalesce(sub_type, '') LIKE '%Technical%'"
project("PRJ18_free_throw", ft_index=(lambda: X.free_throw(c("sub_type"))[0], f"CAST(CASE WHEN {_TECH} THEN 1 ELSE coalesce(try_cast(regexp_extract(sub_type, '([0-9]+) of ([0-9]+)', 1) AS INTEGER), 1) END AS INTEGER)"), ft_total=(lambda: X.free_throw(c("sub_type"))[1], f"CAST(CASE WHEN {_TECH} THEN 1 ELSE coalesce(try_cast(regexp_extract(sub_type, '([0-9]+) of ([0-9]+)', 2) AS INTEGER), 1) END AS INTEGER)"), kind=(lambda: X.free_throw(c("sub_type"))[2], f"CASE WHEN {_TECH} THEN 'technical' WHEN sub_type LIKE '%Flagrant%' OR sub_type LIKE '%Clear Path%' THEN 'flagrant' ELSE 'regular' END"))
project("PRJ19_foul_keeps_ball", v=(lambda: X.foul_keeps_ball(c("sub_type")), "coalesce(lower(sub_type) LIKE '%away from play%' OR lower(sub_type) LIKE '%take%', FALSE)"))
project("PRJ20_missed_free_throw", v=(lambda: X.missed_free_throw(c("description")), "starts_with(ltrim(description), 'MISS')"))
project("PRJ22_name_folding", folded=(lambda: X.fold_accents(c("name")), "lower(strip_accents(name))"), bare=(lambda: X.strip_suffix(c("name")), "regexp_replace(name, '[ ,]+(jr|sr|ii|iii|iv)\\.?$', '', 'i')"), written=(lambda: X.umlaut_variant(c("name")), "replace(replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"))
project("PRJ23_substitution", came=(lambda: X.substitution_names(c("description"))[0], "nullif(regexp_extract(description, '^SUB: (.+) FOR (.+)$', 1), '')"), went=(lambda: X.substitution_names(c("description"))[1], "nullif(regexp_extract(description, '^SUB: (.+) FOR (.+)$', 2), '')"))
project("PRJ24_side_five", v=(lambda: F.array_join(X.side_five(c("a"), c("b"), F.array(F.lit("o")), F.array(F.lit("d"))), ""), "CASE WHEN a = b THEN 'o' ELSE 'd' END"))
project("PRJ25_game_clock", v=(lambda: X.game_clock(c("elapsed"), c("period")), f"{_LEN} - elapsed"), total=(lambda: X.cumulative_elapsed(c("elapsed"), c("period")), f"{_START} + elapsed"))
project("PRJ26_split", v=(lambda: X.split_of(c("season")), "CASE WHEN season IN (2022, 2023) THEN 'train' WHEN season = 2024 THEN 'validation' WHEN season = 2025 THEN 'test' ELSE 'audit_only' END"))
project("PRJ27_regulation_remaining", v=(lambda: X.regulation_remaining(c("remaining") + 400.0), "greatest(0.0, 2880.0 - (remaining + 400.0))"))
project("PRJ28_boolean_equality", v=(lambda: c("a") == c("b"), "a = b"))
project("PRJ29_round_10", v=(lambda: F.round(c("odds_h") / 3.0, 10), "round(odds_h / 3.0, 10)"))
project("PRJ30_coverage_status", v=(lambda: X.coverage_status(c("season") == 2021, c("a") + 1, c("b") + 3), "CASE WHEN season = 2021 THEN 'cold_start' WHEN a + 1 = 5 AND b + 3 = 5 THEN 'full' WHEN a + 1 = 0 AND b + 3 = 0 THEN 'replacement_only' ELSE 'partial' END"))
project("PRJ31_box_possessions", v=(lambda: F.round(X.box_possessions(c("a") * 10, c("b"), c("a"), c("b") * 4).cast("double"), 6), "round(CAST(a * 10 - b + a + 0.44 * (b * 4) AS DOUBLE), 6)"))
project("PRJ32_vig_free_odds", v=(lambda: F.round(X.vig_free_from_odds(c("odds_h"), c("odds_a")), 9), "round((1 / odds_h) / (1 / odds_h + 1 / odds_a), 9)"))
project("PRJ33_vig_free_prices", v=(lambda: F.round(X.vig_free_from_prices(c("price_h"), c("price_a")), 9), "CASE WHEN price_h + price_a > 0 THEN round(price_h / (price_h + price_a), 9) END"))
project("PRJ35_playoff_flag", v=(lambda: X.playoff_flag(c("game_id")), "CAST(starts_with(game_id, '004') AS DOUBLE)"))
project("PRJ36_margin_over_sqrt_time", v=(lambda: F.round(X.margin_over_sqrt_time(c("margin"), c("remaining")), 9), "round(margin / sqrt(remaining + 1.0), 9)"))
project("PRJ37_hinge", **{f"h{int(n)}": (lambda n=n: X.hinge(c("remaining"), n), f"greatest(0.0, {n} - remaining)") for n in X.KNOTS})
project("PRJ38_season_dummies", **{f"season_{s}": (lambda s=s: X.season_dummies(c("season"), [2022, 2023, 2024])[f"season_{s}"], f"CAST(season = {s} AS DOUBLE)") for s in (2023, 2024)})
project("PRJ39_constant_columns", one=(lambda: F.lit(1.0), "CAST(1.0 AS DOUBLE)"), margin=(lambda: c("margin").cast("double"), "CAST(margin AS DOUBLE)"), has=(lambda: (c("a") == 1).cast("double"), "CAST(a = 1 AS DOUBLE)"))
project("PRJ40_availability", v=(lambda: X.available(c("b").cast("double"), c("comment")), "CASE WHEN b > 0 THEN TRUE WHEN trim(coalesce(comment, '')) = '' THEN TRUE WHEN lower(comment) LIKE '%coach%' THEN TRUE WHEN regexp_matches(lower(comment), 'inactive|injury|illness|personal|suspen|not with team|rest|return to competition|g league') THEN FALSE ELSE TRUE END"))
project("PRJ41_candidate_slugs", v=(lambda: F.array_join(X.candidate_slugs(c("day"), F.lit("AAA"), F.when(c("a") == 0, "AAA").otherwise("BBB")), ","), "CASE WHEN a = 0 THEN concat_ws(',', 'game-aaa-aaa-' || strftime(day, '%Y-%m-%d'), 'game-aaa-aaa-' || strftime(day - 1, '%Y-%m-%d'), 'game-aaa-aaa-' || strftime(day + 1, '%Y-%m-%d')) ELSE concat_ws(',', 'game-bbb-aaa-' || strftime(day, '%Y-%m-%d'), 'game-aaa-bbb-' || strftime(day, '%Y-%m-%d'), 'game-bbb-aaa-' || strftime(day - 1, '%Y-%m-%d'), 'game-aaa-bbb-' || strftime(day - 1, '%Y-%m-%d'), 'game-bbb-aaa-' || strftime(day + 1, '%Y-%m-%d'), 'game-aaa-bbb-' || strftime(day + 1, '%Y-%m-%d')) END"))
project("PRJ44_sigmoid", v=(lambda: F.round(X.sigmoid(c("z")), 12), "round(least(greatest(1.0 / (1.0 + exp(-z)), 1e-12), 1.0 - 1e-12), 12)"))
project("PRJ45_logit", v=(lambda: F.round(X.logit(c("p")), 6), "round(ln(least(greatest(p, 1e-12), 1.0 - 1e-12) / (1.0 - least(greatest(p, 1e-12), 1.0 - 1e-12))), 6)"))
project("PRJ46_row_losses", log_loss=(lambda: F.round(X.log_loss(c("y"), c("p")), 6), "round(-CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-12), 1.0 - 1e-12)) ELSE ln(1.0 - least(greatest(p, 1e-12), 1.0 - 1e-12)) END, 6)"), brier=(lambda: F.round(X.brier(c("y"), c("p")), 9), "round((p - y) * (p - y), 9)"))
project("PRJ47_labels", period=(lambda: X.period_label(c("period")), "CASE WHEN period <= 4 THEN 'Q' || period ELSE 'OT' END"), bucket=(lambda: X.time_bucket(c("remaining")), "CASE WHEN remaining <= 60 THEN '0-60' WHEN remaining <= 300 THEN '60-300' WHEN remaining <= 720 THEN '300-720' WHEN remaining <= 1440 THEN '720-1440' ELSE '1440-2880' END"), band=(lambda: X.margin_band(c("margin")), "CASE WHEN abs(margin) <= 3 THEN '0-3' WHEN abs(margin) <= 8 THEN '4-8' WHEN abs(margin) <= 15 THEN '9-15' ELSE '16+' END"))
project("PRJ48_lineup_id", v=(lambda: X.lineup_id(F.array(c("season"), c("period"), c("a"))), "array_to_string(list_sort([season, period, a]), '-')"))
project("PRJ49_decay_weight", v=(lambda: F.round(X.decay_weight(F.when(c("a") > 0, c("elapsed"))), 9), "CASE WHEN a > 0 THEN round(pow(0.5, elapsed / 60.0), 9) ELSE 1.0 END"))
project("PRJ50_first_ten_date", v=(lambda: X.first_ten_date(c("stamp")), "CAST(substr(stamp, 1, 10) AS DATE)"))
project("ARR04_ARR08_sizes", n=(lambda: F.size(F.array_distinct(F.array(c("a"), c("b"), c("period")))).cast("long"), "len(list_distinct([a, b, period]))"))
project("ARR05_elements", v=(lambda: F.array(c("a"), c("b"), c("period"))[1], "[a, b, period][2]"))
project("ARR06_sorted_set", v=(lambda: F.array_join(F.transform(F.array_sort(F.array_distinct(F.array(c("a"), c("b"), c("period")))), lambda x: x.cast("string")), "-"), "array_to_string(list_sort(list_distinct([a, b, period])), '-')"))
project("ARR07_swap", v=(lambda: F.array_join(F.transform(F.array_sort(F.array_union(F.array_remove(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), c("a")), F.array(c("period") + 10))), lambda x: x.cast("string")), "-"), "array_to_string(list_sort(list_append(list_filter([1, 2, 3, 4], lambda x: x <> a), period + 10)), '-')"))


def arr01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR01-03: explode with position; null and empty arrays give no rows."""
    b = base(spark, sf_dir).select("k", F.when(c("a") == 0, None).when(c("a") == 1, F.array().cast("array<int>")).otherwise(F.array(c("a"), c("b"), c("period"))).alias("xs"))
    return b.select("k", F.posexplode("xs").alias("pos", "x")).withColumn("pos", c("pos").cast("long"))


QUERIES["ARR01_ARR02_ARR03_explode"] = arr01
ORACLES["ARR01_ARR02_ARR03_explode"] = f"WITH {BASE_SQL} SELECT k, generate_subscripts(xs, 1) - 1 AS pos, unnest(xs) AS x FROM (SELECT k, [a, b, period] AS xs FROM base WHERE a > 1)"


def prj42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ42-43: the event's own market, its lists parsed, and the home token's position."""
    from tallyframe.operators.pregame import home_token, moneyline

    b = base(spark, sf_dir).select(F.concat(F.lit("s"), c("k").cast("string")).alias("slug"), "a")
    m = lambda s, o: F.struct(s.alias("slug"), o.alias("outcomes"), F.lit('["t1", "t2"]').alias("clobTokenIds"), F.lit("2024-01-05T00:30:00Z").alias("gameStartTime"))
    e = b.select("slug", F.array(m(F.lit("other"), F.lit("[]")), m(F.when(c("a") == 0, F.lit("none")).otherwise(c("slug")), F.when(c("a") == 1, F.lit('["Reds", "Blues"]')).otherwise(F.lit('["Blues", "Reds"]')))).alias("markets"))
    t = b.select("slug", F.when(c("a") == 2, "greens").otherwise("reds").alias("home_label"), F.lit("blues").alias("away_label"))
    return home_token(moneyline(e), t).select("slug", F.array_join("tokens", ",").alias("tokens"), c("home_index").cast("long").alias("home_index"))


QUERIES["PRJ42_PRJ43_moneyline"] = prj42
ORACLES["PRJ42_PRJ43_moneyline"] = f"WITH {BASE_SQL} SELECT 's' || k AS slug, 't1,t2' AS tokens, CAST(CASE WHEN a = 2 THEN NULL WHEN a = 1 THEN 0 ELSE 1 END AS BIGINT) AS home_index FROM base WHERE a <> 0"
