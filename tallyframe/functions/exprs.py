"""Column builders: parsing, clocks, prices, model features. All stay inside code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGULATION, OVERTIME, FULL_GAME = 720.0, 300.0, 2880.0

# --- game and season codes -------------------------------------------------------------------


def season_of(game_id: Column) -> Column:
    """PRJ02: 2000 + the two digits at position 4."""
    return (F.substring(game_id, 4, 2).try_cast("int") + 2000).cast("int")


def season_type_of(game_id: Column) -> Column:
    """PRJ03: by the first three characters."""
    kind = F.substring(game_id, 1, 3)
    return F.when(kind == "002", "Regular Season").when(kind == "004", "Playoffs").otherwise("Unknown")


def playoff_flag(game_id: Column) -> Column:
    """PRJ35."""
    return game_id.startswith("004").cast("double")


def split_of(season: Column) -> Column:
    """PRJ26: which part of the data a season belongs to."""
    return F.when(season.isin(2022, 2023), "train").when(season == 2024, "validation").when(season == 2025, "test").otherwise("audit_only")


def any_like(c: Column, patterns: Sequence[str]) -> Column:
    """FLT01: c matches one of the patterns."""
    return reduce(or_, [c.like(p) for p in patterns]) if patterns else F.lit(False)


# --- clocks ----------------------------------------------------------------------------------


def period_length(period: Column) -> Column:
    """PRJ07."""
    return F.when(period <= 4, REGULATION).otherwise(OVERTIME)


def period_start(period: Column) -> Column:
    """PRJ08: seconds played before a period begins."""
    p = period.cast("int")
    return (F.least(p - 1, F.lit(4)) * REGULATION + F.greatest(p - 5, F.lit(0)) * OVERTIME).cast("double")


def clock_remaining(clock: Column) -> Column:
    """PRJ04: PT##M##.##S to remaining seconds; blank or malformed is null."""
    part = lambda k: F.regexp_extract(clock, r"^PT(\d+)M(\d+(?:\.\d+)?)S$", k).try_cast("double")
    return part(1) * 60.0 + part(2)


def clock_remaining_lenient(clock: Column) -> Column:
    """PRJ05: minutes may be absent; null marks what a caller has to quarantine."""
    shape = r"^PT(?:(\d+)M)?(\d+(?:\.\d+)?)S$"
    ok = clock.rlike(shape)
    minutes = F.coalesce(F.nullif(F.regexp_extract(clock, shape, 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(ok, minutes * 60.0 + F.regexp_extract(clock, shape, 2).try_cast("double"))


def clock_elapsed(clock: Column, period: Column) -> Column:
    """PRJ06: seconds into the period; a malformed clock counts as its start."""
    return F.coalesce(period_length(period) - clock_remaining(F.trim(clock)), F.lit(0.0))


def elapsed_valid(elapsed: Column, period: Column) -> Column:
    """PRJ09: whether elapsed seconds lie inside their period."""
    return (elapsed >= 0) & (elapsed <= period_length(period))


def cumulative_elapsed(elapsed: Column, period: Column) -> Column:
    """PRJ09: seconds since the game began."""
    return period_start(period) + elapsed


def game_clock(start: Column, period: Column) -> Column:
    """PRJ25: what the period's clock shows."""
    return period_length(period) - start


def regulation_remaining(elapsed_game: Column) -> Column:
    """PRJ27."""
    return F.greatest(F.lit(0.0), F.lit(FULL_GAME) - elapsed_game)


def box_seconds(minutes: Column) -> Column:
    """PRJ10: MM:SS to seconds; blank is null."""
    m = F.nullif(minutes, F.lit(""))
    return (F.split_part(m, F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(m, F.lit(":"), F.lit(2)).try_cast("int")).cast("int")


def box_seconds_fractional(minutes: Column) -> Column:
    """PRJ11: seconds may have a fraction; anything else (a player who didn't play) is null."""
    shape = r"^(\d+):(\d+(?:\.\d+)?)$"
    return F.regexp_extract(minutes, shape, 1).try_cast("double") * 60.0 + F.regexp_extract(minutes, shape, 2).try_cast("double")


def minutes_played(minutes: Column) -> Column:
    """PRJ12: minutes as a number; malformed is 0."""
    return F.coalesce(box_seconds_fractional(minutes) / 60.0, F.lit(0.0))


# --- blanks and safe casts -------------------------------------------------------------------


def blank_to_null(c: Column) -> Column:
    """PRJ13."""
    return F.nullif(c, F.lit(""))


def safe_int(c: Column) -> Column:
    """PRJ14: blank or malformed is null."""
    return blank_to_null(c).try_cast("int")


def zero_if_null(c: Column) -> Column:
    """PRJ15."""
    return F.coalesce(c, F.lit(0))


def optional_int(c: Column) -> Column:
    """PRJ16: zero, blank and null are null."""
    return F.nullif(safe_int(c), F.lit(0))


def first_ten_date(c: Column) -> Column:
    """PRJ50: the date in the first ten characters."""
    return F.substring(c, 1, 10).try_cast("date")


# --- events ----------------------------------------------------------------------------------

EVENTS = {"Made Shot": "made_shot", "Missed Shot": "missed_shot", "Rebound": "rebound", "Turnover": "turnover", "Free Throw": "free_throw"}
#: Events that neither open nor close anything; unlisted kinds of action become "delay".
NEUTRAL = ("foul", "substitution", "timeout", "jump_ball", "ejection", "violation", "delay")


def event_of(action_type: Column) -> Column:
    """PRJ17."""
    out = F.when(action_type.isNull(), "delay")
    for raw, event in EVENTS.items():
        out = out.when(action_type == raw, event)
    return out.otherwise("delay")


def free_throw(sub_type: Column) -> tuple[Column, Column, Column]:
    """PRJ18: (index, total, kind)."""
    s = F.coalesce(sub_type, F.lit(""))
    technical = s.contains("Technical")
    number = lambda k: F.when(technical, 1).otherwise(F.coalesce(F.regexp_extract(s, r"(\d+)\s+of\s+(\d+)", k).try_cast("int"), F.lit(1)))
    kind = F.when(technical, "technical").when(s.contains("Flagrant") | s.contains("Clear Path"), "flagrant").otherwise("regular")
    return number(1), number(2), kind


def foul_keeps_ball(sub_type: Column) -> Column:
    """PRJ19."""
    s = F.lower(F.coalesce(sub_type, F.lit("")))
    return s.contains("away from play") | s.contains("take")


def missed_free_throw(description: Column) -> Column:
    """PRJ20."""
    return F.ltrim(F.coalesce(description, F.lit(""))).startswith("MISS")


def substitution_names(description: Column) -> tuple[Column, Column]:
    """PRJ23: (coming in, going out) of ``SUB: in FOR out``; null without a match."""
    shape = r"^SUB: (.+) FOR (.+)$"
    return tuple(F.nullif(F.regexp_extract(F.trim(description), shape, k), F.lit("")) for k in (1, 2))


def lineup_id(five: Column) -> Column:
    """PRJ48: sorted members joined by dashes."""
    return F.array_join(F.transform(F.array_sort(five), lambda x: x.cast("string")), "-")


def side_five(offense_team: Column, team: Column, offense_five: Column, defense_five: Column) -> Column:
    """PRJ24: the five of ``team``."""
    return F.when(offense_team == team, offense_five).otherwise(defense_five)


@F.pandas_udf(T.StringType())
def fold_accents(names: pd.Series) -> pd.Series:
    """PRJ22: lower case without accents (NFKD has no built-in form)."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().strip())


def strip_suffix(name: Column) -> Column:
    """PRJ22: without a trailing jr, sr, ii, iii or iv."""
    return F.regexp_replace(name, r"(?i)[ ,]+(jr|sr|ii|iii|iv)\.?$", "")


def umlaut_variant(name: Column) -> Column:
    """PRJ22: umlauts written out."""
    out = F.lower(name)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


MARKERS = ("inactive", "injury", "illness", "personal", "suspen", "not with team", "rest", "return to competition", "g league")


def available(minutes: Column, comment: Column) -> Column:
    """PRJ40: who played or could have: minutes win, then a blank or a coach's decision."""
    c = F.lower(F.trim(F.coalesce(comment, F.lit(""))))
    out = F.when(minutes > 0, True).when(c == "", True).when(c.contains("coach"), True)
    for m in MARKERS:
        out = out.when(c.contains(m), False)
    return out.otherwise(True)


# --- prices and probabilities ------------------------------------------------------------------


def vig_free_from_odds(home: Column, away: Column) -> Column:
    """PRJ32: home probability from decimal odds."""
    return (1.0 / home) / ((1.0 / home) + (1.0 / away))


def vig_free_from_prices(home: Column, away: Column) -> Column:
    """PRJ33: home probability from prices; null where their sum isn't positive."""
    return F.when(home + away > 0, home / (home + away))


def sigmoid(z: Column, margin: float = 1e-12) -> Column:
    """PRJ44: kept inside (0, 1)."""
    return F.least(F.greatest(1.0 / (1.0 + F.exp(-z)), F.lit(margin)), F.lit(1.0 - margin))


def logit(p: Column, margin: float = 1e-12) -> Column:
    """PRJ45."""
    q = F.least(F.greatest(p, F.lit(margin)), F.lit(1.0 - margin))
    return F.ln(q / (1.0 - q))


def log_loss(y: Column, p: Column, margin: float = 1e-12) -> Column:
    """PRJ46: one row's negative log likelihood."""
    q = F.least(F.greatest(p, F.lit(margin)), F.lit(1.0 - margin))
    return -F.when(y.cast("int") == 1, F.ln(q)).otherwise(F.ln(1.0 - q))


def brier(y: Column, p: Column) -> Column:
    """PRJ46: one row's squared error."""
    return (p - y.cast("double")) * (p - y.cast("double"))


# --- model features ----------------------------------------------------------------------------

KNOTS = (720.0, 180.0, 30.0)


def margin_over_sqrt_time(margin: Column, remaining: Column) -> Column:
    """PRJ36."""
    return margin / F.sqrt(remaining + 1.0)


def hinge(remaining: Column, knot: float) -> Column:
    """PRJ37."""
    return F.greatest(F.lit(0.0), F.lit(knot) - remaining)


def season_dummies(season: Column, levels: Sequence[int]) -> dict[str, Column]:
    """PRJ38: one column a level but the lowest."""
    return {f"season_{s}": (season == s).cast("double") for s in sorted(levels)[1:]}


def period_label(period: Column) -> Column:
    """PRJ47."""
    return F.when(period <= 4, F.concat(F.lit("Q"), period.cast("int").cast("string"))).otherwise("OT")


def time_bucket(remaining: Column) -> Column:
    """PRJ47: right-closed buckets of remaining seconds."""
    return F.when(remaining <= 60, "0-60").when(remaining <= 300, "60-300").when(remaining <= 720, "300-720").when(remaining <= 1440, "720-1440").otherwise("1440-2880")


def margin_band(margin: Column) -> Column:
    """PRJ47: right-closed bands of the absolute margin."""
    m = F.abs(margin)
    return F.when(m <= 3, "0-3").when(m <= 8, "4-8").when(m <= 15, "9-15").otherwise("16+")


def decay_weight(days: Column, half_life: float = 60.0) -> Column:
    """PRJ49: a null age weighs 1."""
    return F.coalesce(F.pow(F.lit(0.5), days / half_life), F.lit(1.0))


def coverage_status(cold: Column, home_rated: Column, away_rated: Column, full: int = 5) -> Column:
    """PRJ30."""
    return F.when(cold, "cold_start").when((home_rated == full) & (away_rated == full), "full").when((home_rated == 0) & (away_rated == 0), "replacement_only").otherwise("partial")


def box_possessions(fga: Column, oreb: Column, tov: Column, fta: Column) -> Column:
    """PRJ31."""
    return fga - oreb + tov + 0.44 * fta


def slug(day: Column, first: Column, second: Column) -> Column:
    """PRJ41: an event's name from its date and the two codes."""
    return F.concat_ws("-", F.lit("game"), F.lower(first), F.lower(second), F.date_format(day, "yyyy-MM-dd"))


def candidate_slugs(day: Column, home: Column, away: Column) -> Column:
    """PRJ41: three dates by two orders, without repeats."""
    return F.array_distinct(F.array(*[slug(F.date_add(day, k), a, b) for k in (0, -1, 1) for a, b in ((away, home), (home, away))]))
