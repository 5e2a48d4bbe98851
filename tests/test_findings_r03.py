"""What the findings of round 3 asked for, of the queries on the stand-in tables."""

import hashlib

from pyspark.sql import functions as F
from tallyframe.operators import eventlog, linalg, marts, reporting
from tallyframe.plans import standins as S

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_input(spark, monkeypatch):
    """A task's share of possessions doesn't grow with the table."""
    assert S.parts(spark, SF, "lineitem") == 4
    monkeypatch.setitem(S.PART_BYTES, "lineitem", 1 << 13)
    n = S.parts(spark, SF, "lineitem")
    assert n > 10 and S.poss(spark, SF, by_game=True).rdd.getNumPartitions() == n


def test_lineups_are_not_shuffled_by_player(spark):
    """Exploded lineups were shuffled and sorted with all columns of the state."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(marts.game_states(S.poss(spark, SF, by_game=True), S.games(spark, SF), S.ratings(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(player_id" not in p and "SortAggregate" not in p and "hashpartitioning(period" not in p


def test_minutes_are_joined_where_games_are(spark):
    """a row for each player and possession was shuffled."""
    p = plan(marts.val_minutes(S.box(spark, SF), S.stints(spark, SF), S.quarantine(spark, SF)))
    assert not any("Exchange" in x and ("person_id" in x or "team_id" in x) for x in p.split("\n"))


def test_residuals_are_computed_once(spark):
    """the gate made the residuals for their number and again for each figure."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    r = spark.createDataFrame([(float(k),) for k in (5, 1, 1, 70, 9)], "x double").select(counted("x").alias("delta"))
    got = eventlog.corpus_gate(r, spark.createDataFrame([([1, 2, 3, 4, 5],)], "five array<int>")).first()
    assert (got["n"], got["median"], got["p95"], got["largest"], got["within"], got["passes"]) == (5, 5.0, 70.0, 70.0, 0.8, False)
    assert seen.value == 5


def test_fingerprint_holds_no_list_of_ids(spark):
    """all ids were one row's list."""
    ids = [f"g{k % 700:05d}" for k in range(2000)]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "game_id string").repartition(5)
    want = hashlib.sha256(("".join(sorted(set(ids))) + "700").encode()).hexdigest()[:16]
    out = reporting.corpus_fingerprint(df)
    assert tuple(out.first()) == (want, 700) and "collect_set" not in plan(out)
    assert tuple(reporting.corpus_fingerprint(df.limit(0)).first()) == (hashlib.sha256(b"0").hexdigest()[:16], 0)


def test_entries_are_not_shuffled_by_player(spark):
    """entries met by (season, side), a few tasks whatever the table."""
    rows = [(f"r{k}", 2020 + k % 2, [1, 2, 2], [3 + k % 3, 9], k % 2 == 0) for k in range(12)]
    poss = spark.createDataFrame(rows, "row_id string, season int, offense_five array<long>, defense_five array<long>, home boolean")
    cols = linalg.columns(linalg.floor_counts(poss), least=3)
    d = linalg.design(poss, cols, parts=3)
    assert not any("Exchange hash" in x and ("side" in x or "column_id" in x) for x in plan(d).split("\n"))
    at = {(c["season"], c["kind"], c["player_id"], c["side"]): c["column_id"] for c in cols.collect()}
    want = {}
    for r, season, off, dfn, home in rows:
        for side, five in (("O", off), ("D", dfn)):
            for p in five:
                k = (r, at.get((season, 0, p, side), at[season, 1, None, side]))
                want[k] = want.get(k, 0.0) + 1.0
        if home:
            want[r, at[None, 2, None, "H"]] = 1.0
    assert {(x["row_id"], x["column_id"]): x["value"] for x in d.collect()} == want
