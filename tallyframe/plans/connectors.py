"""Queries of readers and sinks: what is written to the shared folder is read back and compared."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import logistic, reporting
from tallyframe.plans import standins as S
from tallyframe.plans.relational import mart
from tallyframe.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, text: str, *uses: str):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[name] = f
        ORACLES[name] = S.sql(text, *uses)
        return f

    return add


_GAMES = "SELECT game_id, season, home_team_id, away_team_id, game_date FROM games0"


def _games(spark, d) -> DataFrame:
    return S.games0(spark, d).select("game_id", "season", "home_team_id", "away_team_id", "game_date")


@query("SNK01_SNK02_SRC13_replaced_table", "SELECT count(*) AS rows, sum(season) AS seasons, TRUE AS absent FROM games0", "games0")
def snk01(spark, d):
    name = f"sink_{sinks.scratch(spark, 't').rsplit('-', 1)[1]}"
    absent = readers.table_or_none(spark, name) is None
    sinks.table(_games(spark, d).limit(3), name)
    sinks.table(_games(spark, d), name)  # the second writing replaces the first
    r = readers.table_or_none(spark, name).agg(F.count("*"), F.sum("season")).first()
    spark.sql(f"drop table {name}")
    return spark.createDataFrame([(r[0], r[1], absent)], "rows long, seasons long, absent boolean")


@query("SNK03_SNK09_ordered_snapshot", _GAMES, "games0")
def snk03(spark, d):
    path = sinks.scratch(spark, "snapshot") + ".parquet"
    sinks.snapshot(_games(spark, d), path, "game_id", {"source": "orders"})
    return spark.read.parquet(path)


@query("SNK04_SRC08_partitioned_parquet", "SELECT game_id, season FROM games0 WHERE season >= 2022", "games0")
def snk04(spark, d):
    path = sinks.scratch(spark, "by-season")
    sinks.parquet(_games(spark, d), path, partition_by=("season",))
    return spark.read.parquet(path).where("season >= 2022").select("game_id", "season")


@query("SNK05_SRC14_design_artifacts", "SELECT c_custkey AS row_id, CAST(c_nationkey AS BIGINT) AS column_id, CAST(1 AS DOUBLE) AS value FROM customer")
def snk05(spark, d):
    c = S._t(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("long").alias("column_id"), F.lit(1.0).alias("value"))
    path = sinks.scratch(spark, "design")
    sinks.design_artifacts(c, c.select("row_id"), c.select("column_id").distinct(), path)
    return readers.design_artifacts(spark, path)[0]


@query("SNK06_SNK07_SRC15_json_document", "SELECT CAST(season AS VARCHAR) AS season, count(*) AS games FROM games0 GROUP BY 1", "games0")
def snk06(spark, d):
    path = sinks.scratch(spark, "metrics") + ".json"
    counts = {str(r["season"]): r["count"] for r in S.games0(spark, d).groupBy("season").count().collect()}
    sinks.json_atomic(path, {"games": {}}, spark)
    sinks.json_atomic(path, {"games": counts}, spark)  # replaces the first
    return spark.createDataFrame(sorted(readers.json_artifact(path, "this query", spark)["games"].items()), "season string, games long")


@query("SNK08_SRC20_appended_log", "SELECT game_id, CASE WHEN o_orderkey % 3 = 0 THEN 'retried' ELSE 'done' END AS status FROM games0", "games0")
def snk08(spark, d):
    g, path = S.games0(spark, d), sinks.scratch(spark, "progress")
    sinks.append_json_lines(g.select("game_id", F.lit(1).alias("n"), F.lit("done").alias("status")), path)
    sinks.append_json_lines(g.where("o_orderkey % 3 = 0").select("game_id", F.lit(2).alias("n"), F.lit("retried").alias("status")), path)
    return readers.progress_log(spark, path, "game_id string, n int, status string").select("game_id", "status")


@query("SNK10_RPT05_bars_figure", "SELECT c_mktsegment AS name, printf('%.4f', CAST(count(*) AS DOUBLE)) AS label FROM customer GROUP BY 1")
def snk10(spark, d):
    counts = {r[0]: float(r[1]) for r in S._t(spark, d, "customer").groupBy("c_mktsegment").count().collect()}
    texts = re.findall(r"<text[^>]*>([^<]*)</text>", sinks.bars_svg(reporting.bars(counts)))
    return spark.createDataFrame(list(zip(texts[::2], texts[1::2])), "name string, label string")


@query("SRC09_odds_from_csv", "SELECT game_date, home_team_id AS home, away_team_id AS away FROM games0", "games0")
def src09(spark, d):
    path = sinks.scratch(spark, "odds")
    values = {"game_date": F.col("game_date").cast("string")}
    cols = [c.strip().split()[0] for c in readers.ODDS.split(",")]
    g = _games(spark, d).select(*[values.get(c, F.concat(F.lit("T"), F.col("home_team_id" if "home" in c else "away_team_id")) if c.endswith("_team") else F.lit("1.9")).alias(c) for c in cols])
    g.write.option("header", True).csv(path)
    team = lambda c: F.substring(c, 2, 9).cast("long")
    return readers.odds_csv(spark, path).select("game_date", team("home_team").alias("home"), team("away_team").alias("away"))


@query("SRC11_ids_from_file_names", "SELECT DISTINCT '002' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '00001' AS game_id FROM nation WHERE n_nationkey = 22")
def src11(spark, d):
    path = sinks.scratch(spark, "box")
    for r in S._t(spark, d, "nation").select("n_nationkey").collect():
        sinks.json_atomic(f"{path}/002{r[0]:02d}00001.json", {"id": r[0]}, spark)
    return readers.file_ids(spark, path, 2022)


@query("FLT04_split_guard", "SELECT split, count(*) AS rows FROM mart WHERE split IN ('train', 'validation') GROUP BY 1", "mart")
def flt04(spark, d):
    return logistic.guard(mart(spark, d), ["train", "validation"]).groupBy("split").agg(F.count("*").alias("rows"))


@query("GAT23_RPT01_hash_chain", "SELECT 'model.data=data.hash' AS link, TRUE AS holds UNION ALL SELECT 'audit.model=model.hash', TRUE UNION ALL SELECT 'audit.data=model.data', FALSE")
def gat23(spark, d):
    digest = reporting.table_digest(_games(spark, d), ["game_id", "season"]).first()["digest"]
    model = {"data": digest, "hash": reporting.json_hash({"data": digest})}
    docs = {"data": {"hash": digest}, "model": model, "audit": {"model": model["hash"], "data": "another"}}
    links = [("model", "data", "data", "hash"), ("audit", "model", "model", "hash"), ("audit", "data", "model", "data")]
    return spark.createDataFrame(list(reporting.verify_chain(docs, links).items()), "link string, holds boolean")


@query("HSH01_HSH04_schema_hash", "SELECT sha256('{\"features\":[\"margin\",\"margin_over_sqrt_time\"],\"tier\":\"A\"}') AS hash")
def hsh01(spark, d):
    return spark.createDataFrame([(reporting.json_hash({"tier": "A", "features": list(logistic.TIERS["A"])}),)], "hash string")
