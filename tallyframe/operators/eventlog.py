"""Ordered event logs: normalising, possessions, starters, stints. All relational: windows over one
partitioning by game, so a chain of these operators shuffles once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import exprs as X
from tallyframe.sources import sinks


def _before(*order: str):
    return Window.partitionBy("game_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def last_known_before(value: Column, *order: str) -> Column:
    """JON20, WIN10, WIN11: the last non-null value of earlier rows of the game."""
    return F.last(value, ignorenulls=True).over(_before(*order))


def action_log(raw: DataFrame) -> DataFrame:
    """EVT01: raw actions (game_id, ord, period, clock, team_id, action_type, sub_type, description,
    shot_value, score_home, score_away) to normalised events.

    Scores are those before the action; period starts are dropped, ends kept; a one-shot free throw
    after a foul that keeps the ball counts as flagrant.
    """
    index, total, kind = X.free_throw(F.col("sub_type"))
    foul = F.when(F.col("action_type") == "Foul", F.coalesce("sub_type", F.lit("")))
    w = Window.partitionBy("game_id").orderBy("ord")
    seen = raw.select(
        "*",
        F.coalesce(last_known_before(X.safe_int(F.col("score_home")), "ord"), F.lit(0)).alias("home_score_before"),
        F.coalesce(last_known_before(X.safe_int(F.col("score_away")), "ord"), F.lit(0)).alias("away_score_before"),
        F.last(foul, ignorenulls=True).over(w).alias("last_foul"),
    )
    keep = (F.col("action_type") != "period") | (F.col("sub_type") == "end")
    event = F.when(F.col("action_type") == "period", "period_end").otherwise(X.event_of(F.col("action_type")))
    throw = F.col("event") == "free_throw"
    retained = (kind == "regular") & (total == 1) & X.foul_keeps_ball(F.col("last_foul"))
    made = ~X.missed_free_throw(F.col("description"))
    return seen.where(keep).withColumn("event", event).select(
        "game_id", "ord", "period", "event",
        F.when(F.col("event") == "period_end", None).otherwise(X.optional_int(F.col("team_id").cast("string"))).cast("long").alias("team_id"),
        X.clock_elapsed(F.col("clock"), F.col("period")).alias("seconds"),
        F.when(F.col("event") == "made_shot", F.coalesce(F.nullif("shot_value", F.lit(0)), F.lit(2))).when(throw, made.cast("int")).otherwise(0).cast("int").alias("points"),
        F.when(throw, index).alias("ft_index"), F.when(throw, total).alias("ft_total"),
        F.when(throw, F.when(retained, "flagrant").otherwise(kind)).alias("ft_kind"),
        F.when(throw, made).alias("made"),
        "home_score_before", "away_score_before",
    )


def with_and_one(log: DataFrame) -> DataFrame:
    """EVT07, WIN12: flags a made shot whose next event, neutral ones aside, is a regular free throw
    by the same team."""
    # backwards, so that a row's frame grows by one: forwards Spark would read on to the game's end from every row
    after = Window.partitionBy("game_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    real = F.when(~F.col("event").isin(*X.NEUTRAL), F.struct("event", "team_id", F.coalesce("ft_kind", F.lit("regular")).alias("kind")))
    nxt = F.last(real, ignorenulls=True).over(after)
    return log.withColumn("nxt", nxt).withColumn("and_one", F.coalesce((F.col("event") == "made_shot") & (F.col("nxt.event") == "free_throw") & F.col("nxt.team_id").eqNullSafe(F.col("team_id")) & (F.col("nxt.kind") == "regular"), F.lit(False))).drop("nxt")


def possessions(log: DataFrame) -> DataFrame:
    """EVT06, EVT08: possessions of each game from its normalised log.

    Every owning event (shots, turnovers, rebounds, free throws but technicals) leaves its team as
    owner, and whether it closes is local to it. So a possession opens where the owning event before
    it in the period closed, was another team's, or isn't there; the running count of openings is its
    number. Points of technicals go to the shooter's possession that is open, else to their next one,
    else to their last; where they have none, a row is minted so that points still add up.
    Ordering: ``ord`` within a game is total.
    """
    game = Window.partitionBy("game_id").orderBy("ord")
    period = Window.partitionBy("game_id", "period").orderBy("ord")
    back = Window.partitionBy("game_id", "period").orderBy(F.desc("ord"))
    technical = (F.col("event") == "free_throw") & (F.col("ft_kind") == "technical")
    owning = F.col("event").isin("made_shot", "missed_shot", "turnover", "rebound") | ((F.col("event") == "free_throw") & ~technical)
    closes = ((F.col("event") == "made_shot") & ~F.col("and_one")) | (F.col("event").isin("turnover", "period_end")) | ((F.col("event") == "free_throw") & (F.col("ft_kind") == "regular") & F.coalesce("made", F.lit(False)) & (F.col("ft_index") == F.col("ft_total")))
    e = with_and_one(log).select("*", F.coalesce(owning, F.lit(False)).alias("owning"), F.coalesce(technical, F.lit(False)).alias("technical"), F.coalesce(closes, F.lit(False)).alias("closes"))
    last_of_period = F.last("seconds").over(period.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mark = F.when(F.col("owning") | (F.col("event") == "period_end"), F.struct("team_id", "closes", "seconds", "owning"))
    e = e.select("*", F.last(mark, ignorenulls=True).over(period.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"), F.last(mark, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("following"), last_of_period.alias("period_last"))
    opens = F.col("owning") & (F.col("prev").isNull() | F.col("prev.closes") | ~F.col("prev.team_id").eqNullSafe(F.col("team_id")))
    e = e.withColumn("opens", opens).withColumn("number", F.sum(F.col("opens").cast("int")).over(period.rowsBetween(Window.unboundedPreceding, 0)))
    ends = F.when(F.col("closes"), F.col("seconds")).when(F.col("following").isNotNull(), F.col("following.seconds")).otherwise(F.col("period_last"))
    own = e.where("owning").groupBy("game_id", "period", F.col("number").alias("possession_number")).agg(
        F.min_by("team_id", "ord").alias("offense_team_id"),
        F.sum(F.when((F.col("event") == "made_shot") | F.coalesce("made", F.lit(False)), F.col("points")).otherwise(0)).alias("own_points"),
        F.min_by("seconds", "ord").alias("start_seconds"),
        F.max_by(ends, "ord").alias("end_seconds"),
        F.min_by("home_score_before", "ord").alias("home_score_before"),
        F.min_by("away_score_before", "ord").alias("away_score_before"),
        F.min("ord").alias("first_ord"),
    )
    # technicals: the owner's open possession, the shooter's next, or their last
    owner = F.when(F.col("owning") | (F.col("event") == "period_end"), F.struct("team_id", "closes", "owning", "number"))
    t = e.select("*", F.last(owner, ignorenulls=True).over(period.rowsBetween(Window.unboundedPreceding, -1)).alias("held"))
    t = t.where(F.col("technical") & F.coalesce("made", F.lit(False)) & (F.col("points") > 0)).select("game_id", "ord", "period", "team_id", "points", "seconds", F.when(F.col("held.owning") & ~F.col("held.closes") & F.col("held.team_id").eqNullSafe(F.col("team_id")), F.col("held.number")).alias("number"))
    here = t.where("number is not null").groupBy("game_id", "period", F.col("number").alias("possession_number")).agg(F.sum("points").alias("extra"))
    parked = t.where("number is null").select("game_id", "ord", "team_id", "points", F.lit(True).alias("parked"))
    both = parked.select("game_id", "team_id", "ord", "points", F.lit(None).cast("struct<period:int,number:bigint>").alias("at")).unionByName(own.select("game_id", F.col("offense_team_id").alias("team_id"), F.col("first_ord").alias("ord"), F.lit(None).cast("int").alias("points"), F.struct(F.col("period").cast("int").alias("period"), F.col("possession_number").cast("bigint").alias("number")).alias("at")))
    team = Window.partitionBy("game_id", "team_id").orderBy("ord")
    landed = both.select("game_id", "team_id", "ord", "points", F.coalesce(F.last("at", ignorenulls=True).over(Window.partitionBy("game_id", "team_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)), F.last("at", ignorenulls=True).over(team.rowsBetween(Window.unboundedPreceding, -1))).alias("to")).where("points is not null")
    later = landed.where("to is not null").groupBy("game_id", F.col("to.period").alias("period"), F.col("to.number").alias("possession_number")).agg(F.sum("points").alias("extra"))
    extra = here.select("game_id", F.col("period").cast("int").alias("period"), F.col("possession_number").cast("bigint").alias("possession_number"), "extra").unionByName(later).groupBy("game_id", "period", "possession_number").agg(F.sum("extra").alias("extra"))
    rows = own.join(extra, ["game_id", "period", "possession_number"], "left").select("game_id", "period", "possession_number", "offense_team_id", (F.col("own_points") + F.coalesce("extra", F.lit(0))).cast("int").alias("points"), "start_seconds", "end_seconds", "home_score_before", "away_score_before")
    tail = e.groupBy("game_id").agg(F.max_by("period", "ord").alias("last_period"), F.max_by("seconds", "ord").alias("last_seconds"))
    top = own.groupBy("game_id").agg(F.max_by("period", F.struct("first_ord")).alias("period")).join(own.groupBy("game_id", "period").agg(F.max("possession_number").alias("n")), ["game_id", "period"])
    mint = landed.where("to is null").groupBy("game_id", "team_id").agg(F.sum("points").alias("points"), F.min("ord").alias("o"))
    mint = mint.join(tail, "game_id").join(top, "game_id", "left").withColumn("k", F.row_number().over(Window.partitionBy("game_id").orderBy("o")))
    minted = mint.select("game_id", F.coalesce("period", F.lit(1)).alias("period"), (F.coalesce("n", F.lit(0)) + F.col("k")).alias("possession_number"), F.col("team_id").alias("offense_team_id"), F.col("points").cast("int").alias("points"), F.col("last_seconds").alias("start_seconds"), F.col("last_seconds").alias("end_seconds"), F.lit(None).cast("int").alias("home_score_before"), F.lit(None).cast("int").alias("away_score_before"))
    return rows.unionByName(minted).withColumn("possession_number", F.col("possession_number").cast("int"))


def fold_possessions(actions: list[dict]) -> list[dict]:
    """EVT06 as a plain fold over one game's events; what the tests hold the window form against."""
    rows: list[dict] = []
    now: dict | None = None
    number, period, last = 0, None, 0.0
    parked: dict = {}
    for i, a in enumerate(actions):
        def shut(at: float) -> None:
            nonlocal now
            if now is not None:
                rows.append(now | {"end_seconds": at})
                now = None

        def begin(a: dict) -> None:
            nonlocal now, number
            number += 1
            now = {"period": period, "possession_number": number, "offense_team_id": a["team_id"], "points": parked.pop(a["team_id"], 0), "start_seconds": a["seconds"]}

        def own(a: dict) -> None:
            if now is None or now["offense_team_id"] != a["team_id"]:
                shut(a["seconds"])
                begin(a)

        kind = a.get("ft_kind") or "regular"
        if a["period"] != period:
            shut(last)
            period, number = a["period"], 0
        match a["event"]:
            case "made_shot":
                own(a)
                now["points"] += a["points"]
                real = next((b for b in actions[i + 1 :] if b["event"] not in X.NEUTRAL), None)
                if not (real and real["event"] == "free_throw" and real["team_id"] == a["team_id"] and (real.get("ft_kind") or "regular") == "regular"):
                    shut(a["seconds"])
            case "missed_shot":
                own(a)
            case "turnover":
                own(a)
                shut(a["seconds"])
            case "free_throw" if kind == "technical":
                if a["made"]:
                    if now is not None and now["offense_team_id"] == a["team_id"]:
                        now["points"] += a["points"]
                    else:
                        parked[a["team_id"]] = parked.get(a["team_id"], 0) + a["points"]
            case "free_throw":
                own(a)
                if a["made"]:
                    now["points"] += a["points"]
                    if kind == "regular" and a["ft_index"] == a["ft_total"]:
                        shut(a["seconds"])
            case "rebound":
                if now is None or now["offense_team_id"] != a["team_id"]:
                    shut(a["seconds"])
                    begin(a)
            case "period_end":
                shut(a["seconds"])
        last = a["seconds"]
    if now is not None:
        rows.append(now | {"end_seconds": last})
    for team, points in parked.items():
        mine = [r for r in rows if r["offense_team_id"] == team]
        if mine:
            mine[-1]["points"] += points
        elif points:
            p = rows[-1]["period"] if rows else 1
            rows.append({"period": p, "possession_number": max((r["possession_number"] for r in rows if r["period"] == p), default=0) + 1, "offense_team_id": team, "points": points, "start_seconds": last, "end_seconds": last})
    return rows


def period_starters(moves: DataFrame) -> DataFrame:
    """EVT03: rows (game_id, period, team_id, player_id) of those who act, or are taken out, before
    they come in. ``moves`` has (game_id, period, team_id, player_id, ord, kind: in | out | act)."""
    rank = F.when(F.col("kind") == "in", 1).otherwise(0)
    first = moves.where("player_id is not null and team_id is not null").groupBy("game_id", "period", "team_id", "player_id").agg(F.min_by("kind", F.struct("ord", rank.alias("r"))).alias("kind"))
    return first.where("kind <> 'in'").drop("kind")


def stints(moves: DataFrame, starters: DataFrame, *, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """EVT04, EVT05: (stints, quarantined games) by interval membership.

    ``moves`` has substitutions (kind in | out) with ``seconds`` into the period. A player is on the
    floor from the start (starters) or a sub-in to the next sub-out or the period's end. A period's
    boundaries are its substitution times; each interval of positive length gives one row a team with
    the players on the floor, sorted. Games in which a team doesn't start with ``size``, or a player's
    substitutions don't alternate, are quarantined and give no stints.
    """
    subs = moves.where("kind in ('in', 'out')").select("game_id", "period", "team_id", "player_id", "ord", F.when(F.col("kind") == "out", 0).otherwise(1).alias("into"), "seconds")
    begin = starters.select("game_id", "period", "team_id", "player_id", F.lit(-1).cast("long").alias("ord"), F.lit(1).alias("into"), F.lit(0.0).alias("seconds"))
    steps = subs.withColumn("ord", F.col("ord").cast("long")).unionByName(begin)
    w = Window.partitionBy("game_id", "period", "team_id", "player_id").orderBy("ord", "into")
    steps = steps.select("*", F.lag("into").over(w).alias("was"), F.lead("seconds").over(w).alias("until"))
    wrong = steps.where((F.col("was").isNull() & (F.col("into") == 0)) | (F.col("was") == F.col("into"))).select("game_id", F.lit("player_off_floor").alias("reason")).distinct()
    short = starters.groupBy("game_id", "period", "team_id").agg(F.count("*").alias("n")).where(F.col("n") != size).select("game_id", F.lit("starters_not_five").alias("reason")).distinct()
    uneven = subs.groupBy("game_id", "period", "team_id", "seconds").agg(F.sum(F.col("into") * 2 - 1).alias("d")).where("d <> 0").select("game_id", F.lit("lineup_not_five").alias("reason")).distinct()
    quarantine = wrong.unionByName(short).unionByName(uneven)
    length = X.period_length(F.col("period"))
    on = steps.where("into = 1").select("game_id", "period", "team_id", "player_id", F.col("seconds").alias("since"), F.coalesce("until", length).alias("until"))
    cuts = subs.select("game_id", "period", "seconds").where((F.col("seconds") > 0) & (F.col("seconds") < length)).unionByName(starters.select("game_id", "period", F.lit(0.0).alias("seconds"))).distinct()
    at = Window.partitionBy("game_id", "period").orderBy("seconds")
    spans = cuts.withColumn("end_seconds", F.coalesce(F.lead("seconds").over(at), length)).withColumnRenamed("seconds", "start_seconds")
    inside = (F.col("since") <= F.col("start_seconds")) & (F.col("until") >= F.col("end_seconds"))
    out = spans.join(on, ["game_id", "period"]).where(inside).groupBy("game_id", "period", "team_id", "start_seconds", "end_seconds").agg(F.array_sort(F.collect_set("player_id")).alias("five"))
    out = out.join(quarantine, "game_id", "left_anti").withColumn("lineup_id", X.lineup_id(F.col("five"))).withColumn("seconds", F.col("end_seconds") - F.col("start_seconds"))
    return out, quarantine


def player_seconds(stint_rows: DataFrame) -> DataFrame:
    """AGG01: seconds on the floor by game, team and player."""
    return stint_rows.select("game_id", "team_id", F.explode("five").alias("player_id"), "seconds").groupBy("game_id", "team_id", "player_id").agg(F.sum("seconds").alias("seconds"))


def reconcile(mine: DataFrame, theirs: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """EVT09, SET08: keys of either side whose values differ by more than ``tolerance``; absent is 0."""
    a, b = mine.select(*keys, F.col(value).alias("left_value")), theirs.select(*keys, F.col(value).alias("right_value"))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("left_value", F.lit(0)).alias("left_value"), F.coalesce("right_value", F.lit(0)).alias("right_value"))
    return both.withColumn("delta", F.col("left_value") - F.col("right_value")).where(F.abs("delta") > tolerance)


def first_seen_teams(raw: DataFrame) -> DataFrame:
    """EVT12: teams of a game in the order they first appear."""
    seen = raw.where("team_id is not null and team_id <> 0").groupBy("game_id", "team_id").agg(F.min("ord").alias("first_ord"))
    return seen.withColumn("position", F.row_number().over(Window.partitionBy("game_id").orderBy("first_ord", "team_id")))


def opponent(team: Column, first_team: Column, second_team: Column) -> Column:
    """EVT13: the first of the two that isn't ``team``; a null team gets the first."""
    return F.when(team.eqNullSafe(first_team), second_team).otherwise(first_team)


def resolve_team(actions: DataFrame, tokens: DataFrame) -> DataFrame:
    """PRJ21: ``actions`` with ``resolved_team_id``: their team, else that of the first token (by
    team order, then token) that the description begins with. ``tokens``: (game_id, team_id, position, token)."""
    missing = actions.where("team_id is null")
    t = tokens.select("game_id", F.col("team_id").alias("t"), "position", F.lower("token").alias("token"))
    hit = missing.join(t, "game_id").where(F.lower(F.trim("description")).startswith(F.col("token"))).groupBy("game_id", "ord").agg(F.min_by("t", F.struct("position", "token")).alias("found"))
    return actions.join(hit, ["game_id", "ord"], "left").withColumn("resolved_team_id", F.coalesce("team_id", "found")).drop("found")


def resolve_names(wanted: DataFrame, roster: DataFrame) -> DataFrame:
    """JON19: (game_id, team_id, name) to one player by tiers: the exact short name, the exact family
    name, the family name without accents and suffix. A tier with none or several falls through; rows
    that no tier decides have a null player and a reason.
    ``roster``: (game_id, team_id, player_id, short_name, family_name)."""
    w = wanted.dropDuplicates(["game_id", "team_id", "name"]).withColumn("bare", X.strip_suffix(X.fold_accents(F.col("name"))))
    r = roster.withColumn("bare_family", X.strip_suffix(X.fold_accents(F.col("family_name"))))
    c = w.join(r, ["game_id", "team_id"]).select("game_id", "team_id", "name", "player_id", (F.col("name") == F.col("short_name")).alias("a"), (F.col("name") == F.col("family_name")).alias("b"), (F.element_at(F.split("bare", " "), -1) == F.element_at(F.split("bare_family", " "), -1)).alias("c"))
    n = lambda k: F.count_if(F.col(k))
    one = lambda k: F.max(F.when(F.col(k), F.col("player_id")))
    g = c.groupBy("game_id", "team_id", "name").agg(F.when(n("a") == 1, one("a")).when(n("b") == 1, one("b")).when(n("c") == 1, one("c")).alias("player_id"), F.when(n("c") == 0, "unknown").otherwise("ambiguous").alias("why"))
    return wanted.join(g, ["game_id", "team_id", "name"], "left").select(*[wanted[x] for x in wanted.columns], "player_id", F.when(F.col("player_id").isNull(), F.coalesce("why", F.lit("unknown"))).alias("reason"))


def quarantine_mismatches(poss: DataFrame, finals: DataFrame) -> DataFrame:
    """EVT10, AGG24: games whose points by team differ from the final score, with the reason."""
    got = poss.where("offense_team_id is not null").groupBy("game_id", F.col("offense_team_id").alias("team_id")).agg(F.sum("points").alias("points"))
    off = reconcile(got, finals.select("game_id", "team_id", F.col("final_score").alias("points")), ["game_id", "team_id"], "points", 0)
    return off.select("game_id", F.lit("points_mismatch").alias("reason")).distinct()


def fold_games(log: DataFrame) -> DataFrame:
    """EVT06 as a grouped fold, game by game; a game that the fold can't read is one quarantine row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        game = rows["game_id"].iloc[0]
        cols = ["game_id", "period", "possession_number", "offense_team_id", "points", "start_seconds", "end_seconds", "reason"]
        try:
            actions = rows.sort_values("ord").astype(object).where(rows.notna(), None).to_dict("records")
            out = pd.DataFrame([r | {"game_id": game, "reason": None} for r in fold_possessions(actions)], columns=cols)
        except Exception as e:  # noqa: BLE001 - a bad game must not fail the job
            out = pd.DataFrame([{"game_id": game, "reason": type(e).__name__}], columns=cols)
        out["offense_team_id"] = out["offense_team_id"].astype("Int64")
        for c in ("period", "possession_number", "points"):
            out[c] = out[c].astype("Int32")
        return out

    return log.groupBy("game_id").applyInPandas(run, "game_id string, period int, possession_number int, offense_team_id long, points int, start_seconds double, end_seconds double, reason string")


def corpus_gate(residuals: DataFrame, lineups: DataFrame, *, tolerance: float = 60.0, share: float = 0.99) -> DataFrame:
    """EVT11, AGG37: one row: lineups all of five, share of residuals within tolerance, median,
    nearest-rank 95th percentile, largest, and whether the gate passes."""
    # a row for each distinct residual first: residuals are computed once, and ranked by their numbers
    r = residuals.select(F.abs("delta").alias("d")).groupBy("d").agg(F.count("*").alias("k"))
    r = sinks.written(r, "residuals")
    total = r.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n")).first()[0]
    rank = round(0.95 * (total - 1)) / (total - 1) if total > 1 else 0.0  # falls on a row: no interpolation
    within = F.sum(F.when(F.col("d") <= tolerance, F.col("k")).otherwise(0)) / F.sum("k")
    n = r.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.percentile("d", F.lit(0.5), F.col("k")).alias("median"), F.percentile("d", F.lit(rank), F.col("k")).alias("p95"), F.max("d").alias("largest"), within.alias("within"))
    five = lineups.agg(F.min((F.size("five") == 5).cast("int")).alias("five"))
    return n.crossJoin(five).select("n", "median", "p95", "largest", "within", (F.col("five") == 1).alias("all_five"), ((F.col("five") == 1) & (F.col("within") >= share)).alias("passes"))




#: Kinds of action that say nothing about who is on the floor.
ADMINISTRATIVE = ("Timeout", "Instant Replay", "period", "Game", "Stoppage")


def lineup_actions(raw: DataFrame, roster: DataFrame) -> DataFrame:
    """EVT02, FLT08: raw actions as moves (game_id, period, team_id, player_id, ord, kind, seconds).

    A substitution is two moves: the acting person goes out, the one named in the description, found
    by :func:`resolve_names`, comes in. Administrative rows are dropped; the person of a technical or an
    ejection isn't one on the floor for it and becomes null. Order is the position in the log.
    Names that resolve to nobody give a move with a null player and a reason, for quarantine.
    """
    came, _ = X.substitution_names(F.col("description"))
    sub = F.col("action_type") == "Substitution"
    base = raw.where(~F.coalesce(F.col("action_type"), F.lit("")).isin(*ADMINISTRATIVE)).withColumns({"seconds": X.clock_elapsed(F.col("clock"), F.col("period")), "name": F.when(sub, came)})
    benched = F.coalesce(F.col("action_type"), F.lit("")).isin("Ejection") | F.coalesce(F.col("sub_type"), F.lit("")).contains("Technical")
    person = F.when(benched, None).otherwise(F.nullif("person_id", F.lit(0))).cast("long")
    acts = base.where(~F.coalesce(sub, F.lit(False))).select("game_id", "period", "team_id", person.alias("player_id"), "ord", F.lit("act").alias("kind"), "seconds", F.lit(None).cast("string").alias("reason"))
    out = base.where(sub).select("game_id", "period", "team_id", person.alias("player_id"), "ord", F.lit("out").alias("kind"), "seconds", F.lit(None).cast("string").alias("reason"))
    named = resolve_names(base.where(sub).select("game_id", "team_id", "name", "period", "ord", "seconds"), roster)
    into = named.select("game_id", "period", "team_id", F.col("player_id").cast("long").alias("player_id"), "ord", F.lit("in").alias("kind"), "seconds", "reason")
    return acts.unionByName(out).unionByName(into)


def box_truth(box_player: DataFrame, advanced: DataFrame, games: DataFrame) -> DataFrame:
    """EVT14: final score, estimated possessions and player seconds by game and team."""
    row = lambda s: F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_final_score").alias("final_score"))
    team = games.select("game_id", F.explode(F.array(row("home"), row("away"))).alias("t")).select("game_id", "t.*")
    seconds = box_player.groupBy("game_id", "team_id").agg(F.sum("box_seconds").alias("player_seconds"))
    return team.join(advanced.select("game_id", "team_id", "possessions"), ["game_id", "team_id"], "left").join(seconds, ["game_id", "team_id"], "left")


def final_score_from_log(raw: DataFrame) -> DataFrame:
    """AGG25: the largest running scores of each game."""
    return raw.groupBy("game_id").agg(F.coalesce(F.max(X.safe_int(F.col("score_home"))), F.lit(0)).alias("home"), F.coalesce(F.max(X.safe_int(F.col("score_away"))), F.lit(0)).alias("away"))
