"""Event-log operators: window forms against plain folds on random logs, and hand-made cases."""

import random

from tallyframe.functions import exprs as X
from tallyframe.operators import eventlog as E
from pyspark.sql import functions as F

LOG = "game_id string, ord int, period int, event string, team_id long, seconds double, points int, ft_index int, ft_total int, ft_kind string, made boolean, home_score_before int, away_score_before int"
EVENTS = ["made_shot", "missed_shot", "turnover", "rebound", "free_throw", "delay", "foul"]


def random_log(rng, game):
    rows, ord_ = [], 0
    for period in range(1, rng.randrange(2, 6)):
        at = 0.0
        for _ in range(rng.randrange(0, 12)):
            at += rng.randrange(0, 40)
            e = rng.choice(EVENTS)
            kind = rng.choice(["regular", "regular", "technical", "flagrant"]) if e == "free_throw" else None
            total = rng.choice([1, 2]) if kind == "regular" else 1
            made = rng.random() < 0.6 if e == "free_throw" else None
            points = 2 if e == "made_shot" else int(bool(made))
            team = None if e == "rebound" and rng.random() < 0.1 else rng.choice([1, 2])
            rows.append((game, ord_, period, e, team, at, points, rng.randrange(1, total + 1) if kind else None, total if kind else None, kind, made, ord_, ord_))
            ord_ += 1
        if rng.random() < 0.6:
            rows.append((game, ord_, period, "period_end", None, at + 1, 0, None, None, None, None, ord_, ord_))
            ord_ += 1
    return rows


def as_dicts(rows):
    names = [c.split()[0] for c in LOG.split(", ")]
    return [dict(zip(names, r)) for r in rows]


def key(r):
    return (r["period"], r["possession_number"], r["offense_team_id"], r["points"], r["start_seconds"], r["end_seconds"])


def test_possessions_equal_the_fold(spark):
    rng = random.Random(11)
    logs = {f"g{k}": random_log(rng, f"g{k}") for k in range(400)}
    df = spark.createDataFrame([r for rows in logs.values() for r in rows], LOG)
    got = {}
    for r in E.possessions(df).collect():
        got.setdefault(r["game_id"], []).append(key(r))
    for g, rows in logs.items():
        want = [key(r) for r in E.fold_possessions(as_dicts(rows))]
        mine = got.get(g, [])
        if any(sum(1 for w in want if w[:2] == m[:2]) > 1 for m in want):
            continue
        assert sorted(mine, key=str) == sorted(want, key=str), g
    folded = {}
    for r in E.fold_games(df).collect():
        assert r["reason"] is None
        folded.setdefault(r["game_id"], []).append(key(r))
    assert {g: len(x) for g, x in folded.items()} == {g: len(E.fold_possessions(as_dicts(x))) for g, x in logs.items() if E.fold_possessions(as_dicts(x))}


def test_and_one_is_one_possession(spark):
    rows = [("g", 0, 1, "made_shot", 1, 10.0, 2, None, None, None, None, 0, 0), ("g", 1, 1, "foul", 2, 10.0, 0, None, None, None, None, 2, 0), ("g", 2, 1, "free_throw", 1, 10.0, 1, 1, 1, "regular", True, 2, 0), ("g", 3, 1, "turnover", 2, 30.0, 0, None, None, None, None, 3, 0)]
    got = E.possessions(spark.createDataFrame(rows, LOG)).orderBy("possession_number").collect()
    assert [(r["offense_team_id"], r["points"]) for r in got] == [(1, 3), (2, 0)]


def test_technical_points_wait_for_the_next_possession(spark):
    t = lambda o, team, p=1: ("g", o, p, "free_throw", team, float(o), 1, 1, 1, "technical", True, 0, 0)
    rows = [t(0, 2), ("g", 1, 1, "made_shot", 1, 5.0, 2, None, None, None, None, 0, 0), ("g", 2, 2, "turnover", 2, 8.0, 0, None, None, None, None, 0, 0), t(3, 3, 2)]
    got = {r["offense_team_id"]: r["points"] for r in E.possessions(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {1: 2, 2: 1, 3: 1}


def test_starters(spark):
    rng = random.Random(12)
    rows = [(f"g{g}", 1, rng.choice([1, 2]), rng.randrange(6), o, rng.choice(["in", "out", "act"])) for g in range(60) for o in range(20)]
    first = {}
    for g, p, t, who, o, kind in rows:
        first.setdefault((g, p, t, who), kind)
    want = {k for k, kind in first.items() if kind != "in"}
    df = spark.createDataFrame(rows, "game_id string, period int, team_id int, player_id int, ord int, kind string")
    assert {tuple(r) for r in E.period_starters(df).collect()} == want


def test_stints_and_quarantine(spark):
    moves = []
    for g in ("ok", "bad"):
        for t, base in ((1, 0), (2, 10)):
            moves += [(g, 1, t, base + k, k, "act", 0.0) for k in range(1, 6)]
        moves += [(g, 1, 1, 5, 20, "out", 300.0), (g, 1, 1, 6 if g == "ok" else 2, 21, "in", 300.0), (g, 1, 2, 11, 30, "out", 720.0), (g, 1, 2, 17, 31, "in", 720.0)]
    df = spark.createDataFrame(moves, "game_id string, period int, team_id int, player_id int, ord int, kind string, seconds double")
    s, q = E.stints(df, E.period_starters(df))
    assert {(r["team_id"], r["start_seconds"], r["end_seconds"], r["lineup_id"]) for r in s.collect()} == {(1, 0.0, 300.0, "1-2-3-4-5"), (1, 300.0, 720.0, "1-2-3-4-6"), (2, 0.0, 300.0, "11-12-13-14-15"), (2, 300.0, 720.0, "11-12-13-14-15")}
    assert {r["game_id"] for r in q.collect()} == {"bad"}
    seconds = {r["player_id"]: r["seconds"] for r in E.player_seconds(s).collect()}
    assert seconds[5] == 300.0 and seconds[6] == 420.0 and seconds[11] == 720.0


def test_name_resolution(spark):
    roster = spark.createDataFrame([("g", 1, 10, "J. Smith", "Smith"), ("g", 1, 11, "K. Smith", "Smith"), ("g", 1, 12, "L. Dončić", "Dončić"), ("g", 1, 13, "T. Hardaway Jr.", "Hardaway Jr.")], "game_id string, team_id int, player_id int, short_name string, family_name string")
    wanted = spark.createDataFrame([("g", 1, n) for n in ("J. Smith", "Smith", "Doncic", "Hardaway", "Nobody")], "game_id string, team_id int, name string")
    got = {r["name"]: (r["player_id"], r["reason"]) for r in E.resolve_names(wanted, roster).collect()}
    assert got == {"J. Smith": (10, None), "Smith": (None, "ambiguous"), "Doncic": (12, None), "Hardaway": (13, None), "Nobody": (None, "unknown")}


def test_clock_forms(spark):
    df = spark.createDataFrame([("PT11M41.00S", 1), ("PT34.00S", 1), ("", 1), (None, 5), ("junk", 5)], "c string, p int")
    r = df.select(X.clock_remaining(F.col("c")), X.clock_remaining_lenient(F.col("c")), X.clock_elapsed(F.col("c"), F.col("p"))).collect()
    assert [tuple(x) for x in r] == [(701.0, 701.0, 19.0), (None, 34.0, 0.0), (None, None, 0.0), (None, None, 0.0), (None, None, 0.0)]
