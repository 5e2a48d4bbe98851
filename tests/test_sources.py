"""Readers, staging, sinks, hashes, as-of lookups and streams on small fixtures."""

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F
from tallyframe.operators import asof, marts, pregame, reporting
from tallyframe.sources import readers, sinks
from tallyframe.streaming import folds


def team(tid, code, points, players):
    return {"teamId": tid, "teamName": code, "teamCity": code, "teamTricode": code, "statistics": {"points": points}, "players": players}


def player(pid, minutes, comment=""):
    return {"personId": pid, "nameI": f"P. {pid}", "firstName": "P", "familyName": str(pid), "comment": comment, "statistics": {"minutes": minutes, "points": 1, "fieldGoalsAttempted": 4, "freeThrowsAttempted": 2, "reboundsOffensive": 1, "turnovers": 1}}


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    at = tmp_path_factory.mktemp("raw")
    for d in ("pbp", "box"):
        (at / d).mkdir()
    for k, gid in enumerate(("0022300001", "0042100002")):
        box = {"boxScoreTraditional": {"gameId": gid, "homeTeamId": 1, "awayTeamId": 2, "homeTeam": team(1, "AAA", 100 + k, [player(10, "34:30"), player(11, "", "DNP - Coach's Decision")]), "awayTeam": team(2, "BBB", 90, [player(20, "12:00")])}}
        (at / "box" / f"{gid}.json").write_text(json.dumps(box, indent=1))
        acts = [{"actionNumber": 7, "period": 1, "clock": "PT11M41.00S", "teamId": 1, "personId": 10, "playerName": "", "actionType": "Made Shot", "subType": "", "description": "x", "shotResult": "Made", "isFieldGoal": 1, "shotValue": 2, "scoreHome": "2", "scoreAway": ""}, {"actionNumber": 3, "period": 1, "clock": "", "teamId": 0, "actionType": "period", "subType": "end"}]
        (at / "pbp" / f"{gid}.json").write_text(json.dumps({"game": {"gameId": gid, "actions": acts}}, indent=1))
    (at / "dates.json").write_text(json.dumps([{"game_id": "0022300001", "game_date": "2024-01-05T00:00:00"}]))
    (at / "odds.csv").write_text("game_date,home_team,away_team,money_home_decimal_odds,money_away_decimal_odds,money_home_won\n2024-01-05,Reds,Blues,1.5,2.6,1\n")
    return at


def test_staging_from_nested_json(spark, raw):
    box = readers.json_documents(spark, str(raw / "box"), readers.BOX)
    g = {r["game_id"]: r for r in marts.dim_games(box, readers.json_array(spark, str(raw / "dates.json"))).collect()}
    assert g["0022300001"]["season"] == 2023 and g["0022300001"]["season_type"] == "Regular Season" and g["0022300001"]["game_date"] == dt.date(2024, 1, 5)
    assert g["0042100002"]["season_type"] == "Playoffs" and g["0042100002"]["home_final_score"] == 101 and g["0042100002"]["game_date"] is None
    p = {(r["game_id"], r["person_id"]): r for r in marts.stg_box_player(box).collect()}
    assert len(p) == 6 and p["0022300001", 10]["box_seconds"] == 2070 and p["0022300001", 11]["minutes_seconds"] is None and p["0022300001", 11]["box_seconds"] == 0 and not p["0022300001", 20]["is_home"]
    a = marts.stg_actions(readers.json_documents(spark, str(raw / "pbp"), readers.PBP)).where("game_id = '0022300001'").orderBy("ord").collect()
    assert [r["action_number"] for r in a] == [7, 3] and a[0]["seconds_remaining"] == 701.0 and a[0]["player_name"] is None and a[0]["score_away"] is None and a[1]["team_id"] is None and a[1]["seconds_remaining"] is None
    codes = {r["code"]: r["team_id"] for r in readers.tricodes(box, 2).collect()}
    assert codes == {"AAA": 1, "BBB": 2}
    with pytest.raises(ValueError):
        readers.tricodes(box)


def test_file_scans(spark, raw):
    assert {r[0] for r in readers.file_ids(spark, str(raw / "box"), 2023).collect()} == {"0022300001"}
    ids = spark.createDataFrame([("0042100002",)], "game_id string")
    assert [r["game_id"] for r in readers.documents_of(spark, str(raw / "box"), readers.BOX, ids).select("game_id").collect()] == ["0042100002"]
    odds = readers.odds_csv(spark, str(raw / "odds.csv")).collect()
    assert odds[0]["game_date"] == dt.date(2024, 1, 5) and odds[0]["money_home_decimal_odds"] == 1.5
    assert readers.table_or_none(spark, "no_such_table") is None
    with pytest.raises(FileNotFoundError, match="run the fit"):
        readers.json_artifact(str(raw / "none.json"), "the fit")


def test_polite_call_retries_only_what_passes():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return 5

    assert readers.polite_call(flaky, sleep=waits.append, jitter=lambda: 1.0) == 5
    assert waits == [0.75, 1.5, 0.75, 3.0, 0.75]
    with pytest.raises(KeyError):
        readers.polite_call(lambda: {}["x"], sleep=waits.append)
    with pytest.raises(TimeoutError):
        readers.polite_call(lambda: (_ for _ in ()).throw(TimeoutError()), attempts=2, sleep=waits.append)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    sinks.ordered_file(df, str(tmp_path / "t.parquet"), "k")
    assert [r["k"] for r in spark.read.parquet(str(tmp_path / "t.parquet")).collect()] == [1, 2]
    doc = sinks.snapshot(df, str(tmp_path / "s.parquet"), "k", {"source": "x"})
    assert doc["rows"] == 2 and json.loads((tmp_path / "s.parquet.json").read_text())["source"] == "x"
    log = spark.createDataFrame([("g", 1, "old"), ("g", 2, "new")], "game_id string, n int, status string")
    sinks.append_json_lines(log, str(tmp_path / "log"))
    sinks.append_json_lines(log.where("n = 1").withColumn("n", F.lit(3)), str(tmp_path / "log"))
    assert readers.progress_log(spark, str(tmp_path / "log"), "game_id string, n int, status string").first()["status"] == "old"
    for svg in (sinks.reliability_svg([(0.1, 0.2, 5), (0.9, 0.8, 0)]), sinks.trajectory_svg({"g": [(0, 0.5), (1, 1)]}), sinks.bars_svg([("a", 0.2), ("b", -0.1)])):
        assert svg.startswith("<svg") and svg.endswith("</svg>")


def test_design_artifacts_are_validated(spark, tmp_path):
    e = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 1.0)], "row_id string, column_id int, value double")
    rows, cols = e.select("row_id"), e.select("column_id")
    sinks.design_artifacts(e, rows, cols, str(tmp_path / "ok"))
    assert readers.design_artifacts(spark, str(tmp_path / "ok"))[0].count() == 2
    for name, r, c in (("rows", rows.limit(1), cols), ("columns", rows, cols.limit(1)), ("twice", rows.union(rows), cols)):
        sinks.design_artifacts(e, r, c, str(tmp_path / name))
        with pytest.raises(ValueError):
            readers.design_artifacts(spark, str(tmp_path / name))


def test_hashes_and_report_chain(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, v string")
    one = reporting.table_digest(df, ["k", "v"]).first()
    assert one == reporting.table_digest(df.repartition(3), ["k", "v"]).first() and one["row_count"] == 3
    assert one["digest"] != reporting.table_digest(df.fillna("", ["v"]), ["k", "v"]).first()["digest"]
    docs = {"data": {"hash": "x"}, "model": {"data_hash": "x", "hash": "m"}, "audit": {"model_hash": "m"}}
    links = [("model", "data_hash", "data", "hash"), ("audit", "model_hash", "model", "hash")]
    assert len(reporting.consolidate(docs, links)["report_hash"]) == 64
    with pytest.raises(ValueError, match="audit"):
        reporting.consolidate(docs | {"audit": {"model_hash": "?"}}, links)
    assert "improves on" in reporting.verdict("P3", {"point": -0.1, "low": -0.2, "high": -0.05}, {"pass": True, "failed": []})


def test_form_excludes_the_same_day(spark):
    d = dt.date
    games = spark.createDataFrame([("a", 2024, d(2024, 1, 1), 1, 2, 100, 90, 80), ("b", 2024, d(2024, 1, 3), 1, 3, 80, 90, 80), ("c", 2024, d(2024, 1, 3), 2, 1, 70, 75, 80), ("d", 2024, d(2024, 1, 4), 1, 2, 1, 2, 80)], "game_id string, season int, game_date date, home_team_id int, away_team_id int, home_final_points int, away_final_points int, possessions int")
    rows = {(r["game_id"], r["team_id"]): r for r in asof.rest_days(asof.form_to_date(asof.team_ledger(games))).collect()}
    assert rows["a", 1]["prior_games"] == 0 and rows["a", 1]["opener"] and rows["a", 1]["rest"] == 7
    assert rows["b", 1]["prior_games"] == rows["c", 1]["prior_games"] == 1 and rows["b", 1]["rest"] == 2
    assert rows["d", 1]["prior_games"] == 3 and rows["d", 1]["back_to_back"] and rows["d", 1]["prior_wins"] == 2


def test_last_tick_never_after_the_tip(spark):
    t = spark.createDataFrame([("m", 10, 0.4, 0), ("m", 20, 0.5, 1), ("m", 20, 0.6, 2), ("m", 30, 0.9, 3), ("late", 99, 0.1, 0)], "market_id string, t long, price double, n int")
    c = spark.createDataFrame([("m", 20), ("late", 50), ("none", 5)], "market_id string, tip long")
    got = {r["market_id"]: (r["price"], r["gap"], r["fresh"]) for r in asof.last_tick(t, c).collect()}
    assert got == {"m": (0.5, 0, True), "late": (None, None, False), "none": (None, None, False)}


def test_opening_state_fills_nulls_from_later_rows(spark):
    s = spark.createDataFrame([("g", 1, 1, None, 5), ("g", 1, 2, 7, 6)], "game_id string, period int, possession_number int, a int, b int")
    assert tuple(asof.opening_state(s).first()) == ("g", 7, 5)


def test_unknown_team_labels_are_listed(spark):
    odds = spark.createDataFrame([("Reds", "Greens")], "home_team string, away_team string")
    ok, bad = pregame.known_teams(odds, spark.createDataFrame([("Reds", 1)], "label string, team_id int"))
    assert ok.count() == 0 and [r[0] for r in bad.collect()] == ["Greens"]


def test_stream_of_windowed_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", 1.0) for m in range(0, 59, 7)] + [(dt.datetime(2024, 1, 1, 9, 0), "a", 1.0)]
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = folds.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["event_type"], r["n"]) for r in spark.table("windowed").collect()} == {("a", 4), ("b", 5)}


def test_running_scores_go_on_over_batches(spark, tmp_path):
    schema, seen = "game_id string, ts timestamp, team_id long, points long", {}
    rows = [("g", dt.datetime(2024, 1, 1, 0, k), 7 + k % 2, k % 4) for k in range(12)]
    for k in range(2):
        spark.createDataFrame(rows[6 * k : 6 * k + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def keep(batch, _):
        for r in batch.collect():
            seen[r["game_id"], r["team_id"]] = max(seen.get((r["game_id"], r["team_id"]), (0, 0)), (r["events"], r["points"]))

    q = folds.running_scores(stream).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert seen == {("g", t): (6, sum(p for _, _, u, p in rows if u == t)) for t in (7, 8)}
