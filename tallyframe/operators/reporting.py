"""Hashes, reports, trajectories and top lists."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def json_hash(obj: object) -> str:
    """HSH01, HSH04: SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(obj, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def file_hash(path: str) -> str:
    """HSH02: by blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """HSH03: a row's SHA-256; null and the empty string differ."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """HSH03: rows, and a digest of the whole table that no partitioning or row order changes: row
    digests are reduced to one of each of 65,536 prefixes in parallel, those are joined in order."""
    d = df.select(row_digest(df, columns).alias("d"))
    part = d.groupBy(F.substring("d", 1, 4).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("s"), F.count("*").alias("n"))
    return part.agg(F.sum("n").alias("row_count"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda x: x["s"]), ""), 256).alias("digest"))


def corpus_fingerprint(df: DataFrame, key: str = "game_id") -> DataFrame:
    """AGG40: the first 16 of a hash over sorted distinct ids and their number.

    A SHA-256 is one sequence, so the ids are made distinct, sorted and joined to blocks by all tasks, and
    one task hashes the blocks in order; no row holds more than a block.
    """
    ids = df.select(F.col(key).cast("string").alias("id")).where("id is not null").distinct()
    ids = ids.repartitionByRange("id").sortWithinPartitions("id")
    blocks = ids.mapInArrow(_joined, "part int, k int, n long, ids binary")
    # a row that is always there, as an empty table has a fingerprint too
    blocks = blocks.unionByName(df.sparkSession.createDataFrame([(-1, 0, 0, b"")], "part int, k int, n long, ids binary"))
    return blocks.repartition(1).sortWithinPartitions("part", "k").mapInArrow(_hashed, "fingerprint string, ids long")


#: Bytes of a block of ids.
BLOCK = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's ids joined to blocks, numbered."""
    from pyspark import TaskContext

    part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(held)], pa.int64()), pa.array(["".join(held).encode()], pa.binary())], ["part", "k", "n", "ids"])

    for b in batches:
        for i in b.column("id").to_pylist():
            held.append(i)
            size += len(i)
            if size >= BLOCK:
                yield block()
                k, held, size = k + 1, [], 0
    if held:
        yield block()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks' hash, in order, and their number of ids."""
    h, n = hashlib.sha256(), 0
    for b in batches:
        for k, ids in zip(b.column("n").to_pylist(), b.column("ids")):
            h.update(ids.as_py())
            n += k
    h.update(str(n).encode())
    yield pa.record_batch([pa.array([h.hexdigest()[:16]]), pa.array([n], pa.int64())], ["fingerprint", "ids"])


def verify_chain(documents: dict[str, dict], links: list[tuple[str, str, str, str]]) -> dict[str, bool]:
    """GAT23, RPT01: whether each (document, field) equals the (other document, field) it builds on."""
    out = {}
    for a, fa, b, fb in links:
        va, vb = documents.get(a, {}).get(fa), documents.get(b, {}).get(fb)
        out[f"{a}.{fa}={b}.{fb}"] = va is not None and va == vb
    return out


def consolidate(documents: dict[str, dict], links: list[tuple[str, str, str, str]]) -> dict:
    """RPT01-02: one report with the chain's outcome and its own hash; a broken chain is an error."""
    chain = verify_chain(documents, links)
    if not all(chain.values()):
        raise ValueError(f"broken links: {[k for k, ok in chain.items() if not ok]}")
    body = {"documents": documents, "chain": chain}
    return body | {"report_hash": json_hash(body)}


def verdict(name: str, difference: dict[str, float], outcome: dict) -> str:
    """RPT03: what an interval and the gates say."""
    side = "improves on" if difference["high"] < 0 else "is worse than" if difference["low"] > 0 else "can't be told from"
    return f"{name} {side} the baseline: {difference['point']:+.5f} [{difference['low']:+.5f}, {difference['high']:+.5f}]; gates {'pass' if outcome['pass'] else 'fail: ' + ', '.join(outcome['failed'])}"


def bars(scores: dict[str, float]) -> list[tuple[str, float]]:
    """RPT05: by score, then name."""
    return sorted(scores.items(), key=lambda x: (x[1], x[0]))


def top(df: DataFrame, column: str, n: int, *ties: str, ascending: bool = False) -> DataFrame:
    """SRT02-04, SRT07: n rows of a total order; Spark keeps n a partition, not a global sort."""
    first = F.col(column).asc() if ascending else F.col(column).desc()
    return df.orderBy(first, *ties).limit(n)


def top_and_bottom(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    """SRT03."""
    return top(df, column, n, *ties).withColumn("end", F.lit("top")).unionByName(top(df, column, n, *ties, ascending=True).withColumn("end", F.lit("bottom")))


def game_shape(states: DataFrame, p: str = "p") -> DataFrame:
    """AGG39, RPT04: a game's last, largest and smallest probability, and its number of states."""
    return states.groupBy("game_id").agg(F.max_by(p, F.struct("period", "possession_number")).alias("last_p"), F.max(p).alias("max_p"), F.min(p).alias("min_p"), F.count("*").alias("states"))


def representative(shapes: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """SRT05: the lowest game id of each category, none used twice; categories in order."""
    spark, used, out = shapes.sparkSession, [], []
    for name, cond in categories.items():
        g = shapes.where(cond & ~F.col("game_id").isin(used) if used else cond).agg(F.min("game_id")).first()[0]
        if g is not None:
            used.append(g)
            out.append((name, g))
    return spark.createDataFrame(out, "category string, game_id string")


def normalised_time(states: DataFrame, t: str = "elapsed_game_seconds") -> DataFrame:
    """PRJ51: elapsed time of each game scaled to [0, 1]; a game of one moment gets 0."""
    w = Window.partitionBy("game_id")
    span = F.max(t).over(w) - F.min(t).over(w)
    return states.withColumn("x", F.when(span > 0, (F.col(t) - F.min(t).over(w)) / span).otherwise(0.0))


def season_status(states: DataFrame) -> DataFrame:
    """AGG14: rows by season and coverage status with rates within the season."""
    g = states.groupBy("season", "rapm_coverage_status").agg(F.count("*").alias("n"))
    return g.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("season")), 10))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG15: nulls of every column in one pass, one row a column."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("x")).select("x.*")
