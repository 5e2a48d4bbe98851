"""Line dedup with levelled sorted runs of line hashes (operator 9).

Documents come in batches. A *run* is a table of the lines that one batch saw first: the 128-bit
hash of the normalised line and the position that keeps it, hash-bucketed and sorted by hash in
the shared folder. A new batch finds the first position of each of its lines (partial aggregation
on the map side, so a line of a million copies costs one row per task), merge-anti-joins the runs
level by level, and writes what is left as its own run. A level that holds ``fanout`` runs is
merged into one run of the next level, so a batch joins O(log batches) runs. Runs and batch use
one bucketing: the runs are never shuffled again.

A line is kept where it occurs first in (document id, line number) order; nothing else of that
text is touched. Lines are compared in lower case with runs of white space as one blank. Lines of
fewer than ``min_chars`` characters are always kept, as short sentences recur by chance.

Defined cases: a null text, an empty one and one with no line of ``min_chars`` stay as they are. A
document all of whose longer lines are repeats is dropped, short lines included. Null ids come
after all others. Of rows equal in id (null too) and text one stays, any of them if their other columns
differ; rows with one id and different texts are different documents, ordered by a hash of the text. Other
columns are carried along whatever their names, but a whole-number column ``n_chars`` follows the text's
length. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import give_back, new_path, remove_paths

_BLANK = re.compile("[ \t\n\x0b\f\r]+")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[ \t\n\x0B\f\r]+", " "))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns nul, id, th: the order of documents, and their key."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).isNull().alias("nul"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


class LineRuns:
    """The runs of one corpus, in the shared folder."""

    def __init__(self, spark: SparkSession, *, fanout: int = 2, min_chars: int = 20):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.levels: list[list[tuple[str, str]]] = []  # (table, path), oldest first
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        df.repartition(self.buckets, "h1").write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def first_lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The first position of each line of a batch: h1, h2, nul, id, th, line."""
        lines = _keyed(docs, id_col, text_col).where("text is not null").select("nul", "id", "th", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
        norm = lines.withColumn("n", _normal(F.col("raw"))).where(F.length("n") >= self.min_chars).withColumn("n", F.lower("n"))
        hashed = norm.select(F.xxhash64("n").alias("h1"), F.xxhash64(F.lit(7), F.reverse("n")).alias("h2"), F.struct("nul", "id", "th", "line").alias("at"))
        return hashed.groupBy("h1", "h2").agg(F.min("at").alias("at")).select("h1", "h2", "at.*")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; returns its own run, the positions of its lines that no earlier batch has (once
        that was merged, all positions so far)."""
        new = self.first_lines(docs, id_col, text_col)
        for level in self.levels:
            for name, _ in level:
                new = new.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        run = self._write(new)
        self.levels = self.levels or [[]]
        self.levels[0].append(run)
        self._compact()
        return self.spark.table(run[0]) if run in self.levels[0] else self.positions()

    def _compact(self) -> None:
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                old = self.levels[k]
                merged = self.spark.table(old[0][0])
                for name, _ in old[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                run = self._write(merged)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(run)
                for name, _ in old:
                    self.spark.sql(f"drop table {name}")
                remove_paths(self.spark, [p for _, p in old])
            k += 1

    def save(self, path: str) -> None:
        """Write the list of runs, so that a later job can go on with :meth:`open`."""
        rows = [(k, p, self.fanout, self.min_chars, self.buckets) for k, level in enumerate(self.levels) for _, p in level]
        self.spark.createDataFrame(rows, "level int, path string, fanout int, min_chars int, buckets int").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        """The runs that :meth:`save` listed; their files are used as they are."""
        rows = spark.read.schema("level int, path string, fanout int, min_chars int, buckets int").json(path).orderBy("level").collect()
        if not rows:
            return cls(spark)
        runs = cls(spark, fanout=rows[0]["fanout"], min_chars=rows[0]["min_chars"])
        runs.buckets = rows[0]["buckets"]
        runs.levels = [[] for _ in range(rows[-1]["level"] + 1)]
        for r in rows:
            name = f"line_run_{uuid.uuid4().hex}"
            kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(r["path"]).schema)
            spark.sql(f"create table {name} ({kind}) using parquet clustered by (h1) sorted by (h1, h2) into {runs.buckets} buckets location '{r['path']}'")
            runs.levels[r["level"]].append((name, r["path"]))
        return runs

    def close(self) -> None:
        """Take the runs out of the catalogue; their files stay, and what reads them goes on."""
        for level in self.levels:
            for name, _ in level:
                self.spark.sql(f"drop table if exists {name}")

    def positions(self) -> DataFrame:
        """The kept positions of all batches so far: nul, id, th, line."""
        parts = [self.spark.table(name).select("nul", "id", "th", "line") for level in self.levels for name, _ in level]
        return reduce(DataFrame.unionByName, parts)


def keep_lines(docs: DataFrame, positions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """``docs`` with only the lines at ``positions`` and the short ones; see the module's text."""
    kept = positions.groupBy("nul", "id", "th").agg(F.collect_list("line").alias("lines"))
    row = docs.select(F.col(id_col).isNull().alias("nul"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = row.dropDuplicates(["nul", "id", "th"]).join(kept.withColumn("id", F.coalesce("id", F.lit(0))), ["nul", "id", "th"], "left")

    @F.pandas_udf("struct<text string, gone boolean>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        give_back()
        for texts, lines in batches:
            out = []
            for text, at in zip(texts, lines):
                if not text:
                    out.append((text, False))
                    continue
                keep, parts, mine, gone = set(() if at is None else at.tolist()), text.split("\n"), [], False
                for i, part in enumerate(parts):
                    if i in keep or len(_BLANK.sub(" ", part).strip(" ")) < min_chars:
                        mine.append(part)
                    else:
                        gone = True
                out.append((text if not gone else "\n".join(mine), gone and not keep))
            yield pd.DataFrame(out, columns=["text", "gone"])
        texts = lines = out = None
        give_back()

    done = joined.select("row", cut(F.col("row").getField(text_col).cast("string"), F.col("lines")).alias("cut")).where(~F.col("cut.gone"))
    take = []
    for c in docs.columns:
        if c == text_col:
            take.append(F.col("cut.text").alias(c))
        elif c == "n_chars" and isinstance(docs.schema[c].dataType, T.IntegralType):
            take.append(F.coalesce(F.length("cut.text"), F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            take.append(F.col("row").getField(c).alias(c))
    return done.select(*take)


def line_dedup(docs: DataFrame, *, batches: int = 4, fanout: int = 2, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole table as ``batches`` batches of document ids, in order; null ids come last.

    The number of batches changes the cost, never the result.
    """
    runs = LineRuns(docs.sparkSession, fanout=fanout, min_chars=min_chars)
    i = F.col(id_col).cast("long")
    cuts = docs.agg(F.percentile_approx(i, [k / batches for k in range(1, batches)]).alias("q")).first()["q"] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    for k in range(len(cuts) + 1):
        part = docs
        if k:
            part = part.where((i > cuts[k - 1]) | i.isNull() if k == len(cuts) else i > cuts[k - 1])
        if k < len(cuts):
            part = part.where(i <= cuts[k])
        runs.add(part, id_col, text_col)
    kept = keep_lines(docs, runs.positions(), id_col=id_col, text_col=text_col, min_chars=min_chars)
    runs.close()
    return kept


ORACLE = r"""
WITH d AS (SELECT doc_id, lang, source, text, n_chars, string_split(text, chr(10)) AS parts FROM documents),
raw AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
l AS (SELECT *, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS norm FROM raw),
k AS (SELECT *, length(norm) >= 20 AS longer,
        row_number() OVER (PARTITION BY lower(norm) ORDER BY doc_id, pos) = 1 AS is_first FROM l),
a AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT longer OR is_first) AS kept,
        count(*) FILTER (longer AND is_first) AS firsts, count(*) FILTER (longer AND NOT is_first) AS gone
      FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.kept, d.text) AS text, d.lang, d.source,
       coalesce(CAST(length(coalesce(a.kept, d.text)) AS BIGINT), d.n_chars) AS n_chars
FROM d LEFT JOIN a USING (doc_id) WHERE coalesce(a.gone, 0) = 0 OR a.firsts > 0
"""
