"""Scans: explicit schemas, so that nothing is read twice to infer them."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyframe.operators.asof import last_record

_ACTION = "actionNumber int, period int, clock string, teamId long, personId long, playerName string, actionType string, subType string, description string, shotResult string, isFieldGoal int, shotValue int, pointsTotal int, scoreHome string, scoreAway string"
_STATS = "minutes string, points int, fieldGoalsAttempted int, freeThrowsAttempted int, reboundsOffensive int, turnovers int"


def _nested(fields: str) -> str:
    """'a int, b string' as the inside of struct<...>."""
    return ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", "))


PBP = f"game struct<gameId:string,actions:array<struct<{_nested(_ACTION)}>>>"
_TEAM = f"struct<teamId:long,teamName:string,teamCity:string,teamTricode:string,statistics:struct<points:int>,players:array<struct<personId:long,nameI:string,firstName:string,familyName:string,comment:string,statistics:struct<{_nested(_STATS)}>>>>"
BOX = f"boxScoreTraditional struct<gameId:string,homeTeamId:long,awayTeamId:long,homeTeam:{_TEAM},awayTeam:{_TEAM}>"
_ADVANCED = "struct<teamId:long,statistics:struct<possessions:double,pace:double,offensiveRating:double>>"
BOX_ADVANCED = f"boxScoreAdvanced struct<gameId:string,homeTeamId:long,awayTeamId:long,homeTeam:{_ADVANCED},awayTeam:{_ADVANCED}>"
DATES = "game_id string, game_date string"
ODDS = "game_date string, home_team string, away_team string, money_home_decimal_odds double, money_away_decimal_odds double, money_home_won int"
EVENTS = "slug string, markets array<struct<slug:string,outcomes:string,clobTokenIds:string,gameStartTime:string,volumeNum:double>>"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC01-04: one document a file; absent fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_array(spark: SparkSession, path: str, schema: str = DATES) -> DataFrame:
    """SRC05: a file that is one array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """SRC06-08: columns that aren't selected aren't read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def odds_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC09."""
    return spark.read.schema(ODDS).option("header", True).option("enforceSchema", False).csv(path).withColumn("game_date", F.substring("game_date", 1, 10).try_cast("date"))


def documents_of(spark: SparkSession, path: str, schema: str, ids: DataFrame) -> DataFrame:
    """SRC10: documents whose file name is one of ``ids.game_id``."""
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d.withColumn("game_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)\.", 1)).join(ids.select("game_id").distinct(), "game_id", "left_semi")


def file_ids(spark: SparkSession, path: str, season: int | None = None) -> DataFrame:
    """SRC11: ids from file names, of one season if asked; contents aren't read."""
    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("game_id")).where("game_id <> ''")
    return f if season is None else f.where(F.substring("game_id", 4, 2) == f"{season % 100:02d}")


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    """SRC13: an optional table."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def design_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC14: (entries, rows) of a written design; every entry must be of a written row and column, and
    rows and columns must be written once each."""
    entries, rows, cols = (spark.read.parquet(f"{path}/{name}") for name in ("entries", "rows", "columns"))
    for key, known in (("row_id", rows), ("column_id", cols)):
        stray = entries.select(key).join(known.select(key), key, "left_anti").first()
        if stray is not None:
            raise ValueError(f"entries refer to {key} {stray[0]}, which isn't written")
        twice = known.groupBy(key).count().where("count > 1").first()
        if twice is not None:
            raise ValueError(f"{key} {twice[0]} is written {twice['count']} times")
    return entries, rows


def json_artifact(path: str, made_by: str, spark: SparkSession | None = None) -> dict:
    """SRC15: a metrics document; the error says what makes it. With a session, read by its file systems."""
    if spark is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(f"{path} is missing; run {made_by} first")
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"{path} is missing; run {made_by} first")
    return json.loads(p.read_text())


def distinct_games(rows: DataFrame) -> DataFrame:
    """SRC17: games from team rows."""
    return rows.dropDuplicates(["game_id"])


def game_dates(rows: DataFrame) -> DataFrame:
    """SRC18: one date a game (the earliest, should rows differ)."""
    return rows.groupBy("game_id").agg(F.min("game_date").alias("game_date"))


def progress_log(spark: SparkSession, path: str, schema: str, key: str = "game_id", order: str = "n") -> DataFrame:
    """SRC20: JSON lines; the last record of a key wins."""
    return last_record(spark.read.schema(schema).json(path), key, order)


def tricodes(box: DataFrame, expected: int = 30) -> DataFrame:
    """SRC21: team code to id; another number of teams is an error."""
    r = F.col("boxScoreTraditional")
    t = box.select(F.explode(F.array(r["homeTeam"], r["awayTeam"])).alias("t")).select(F.col("t.teamTricode").alias("code"), F.col("t.teamId").alias("team_id")).distinct()
    n = t.count()
    if n != expected:
        raise ValueError(f"{n} teams, expected {expected}")
    return t


def polite_call(call: Callable[[], object], *, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), attempts: int = 8, gap: float = 0.75, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random):
    """SRC16, SRC19: paced, with full-jitter exponential backoff; other errors are raised at once."""
    for k in range(attempts):
        sleep(gap)
        try:
            return call()
        except transient:
            if k + 1 == attempts:
                raise
            sleep(jitter() * min(cap, gap * 2 ** (k + 1)))


class HttpJsonSource(DataSource):
    """SRC16, SRC19: an HTTP JSON endpoint as a Spark source: one request a partition.

    Options: ``urls`` (comma-separated), ``gap`` and ``attempts``. Rows are (url, body).
    """

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _HttpReader(dict(self.options))


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u.strip()) for u in self.options["urls"].split(",") if u.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        from urllib.request import urlopen

        def call() -> str:
            with urlopen(partition.value, timeout=30) as r:
                return r.read().decode()

        yield partition.value, polite_call(call, transient=(OSError,), gap=float(self.options.get("gap", "0.75")), attempts=int(self.options.get("attempts", "8")))
