"""Sinks: tables, ordered single files, artifacts, canonical JSON, figures."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; a local session
    without that setting gets a temporary folder, a cluster without it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tallyframe-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, in the shared folder, and read from there: its lineage is cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what :func:`scratch` named, whatever its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame, name: str) -> None:
    """SNK01-02: replace a table."""
    df.write.mode("overwrite").saveAsTable(name)


def parquet(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """SNK04."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def _publish(spark: SparkSession, made: str, path: str) -> None:
    """Rename ``made`` to ``path``, whatever the file system, replacing what is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    fs = b.getFileSystem(conf)
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"{made} can't be renamed to {path}")


def ordered_file(df: DataFrame, path: str, *keys: str) -> None:
    """SNK03, SNK09: one sorted zstd file, visible only when whole. For exports, not for scale."""
    spark, work = df.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    df.repartition(1).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(work)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work}/part-*.parquet")
    part = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)[0].getPath().toString()
    _publish(spark, part, path)
    remove(spark, work)


def design_artifacts(entries: DataFrame, rows: DataFrame, columns: DataFrame, path: str) -> None:
    """SNK05: a sparse design as long Parquet with its row and column tables."""
    for name, df in (("entries", entries), ("rows", rows), ("columns", columns)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def canonical(obj: object) -> str:
    """SNK07: sorted keys, two spaces, one end of line."""
    return json.dumps(obj, sort_keys=True, indent=2, ensure_ascii=False, default=str) + "\n"


def json_atomic(path: str, obj: object, spark: SparkSession | None = None) -> None:
    """SNK06: written beside, synced, renamed; with a session, on the file system that it knows for ``path``."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    if spark is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tmp)
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(canonical(obj).encode()))
        out.close()
        _publish(spark, tmp, path)
        return
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(canonical(obj))
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """SNK08: a log that only grows; each batch is its own file, so writers don't clash."""
    df.write.mode("append").json(path)


def snapshot(df: DataFrame, path: str, key: str, provenance: dict) -> dict:
    """SNK09: the sorted table and its provenance document beside it."""
    ordered_file(df, path, key)
    doc = provenance | {"rows": df.count(), "columns": df.columns}
    json_atomic(f"{path}.json", doc, df.sparkSession)
    return doc


# --- figures (SNK10): small results, drawn on the driver ----------------------------------------


def _svg(width: int, height: int, body: list[str], title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img"><title>{title}</title>' + "".join(body) + "</svg>"


def reliability_svg(rows: list[tuple[float, float, int]], size: int = 320) -> str:
    """Mean forecast against rate, one dot a bin, its area by n."""
    top = max((n for *_, n in rows), default=1) or 1
    pos = lambda v: 20 + v * (size - 40)
    body = [f'<line x1="{pos(0):.1f}" y1="{size - pos(0):.1f}" x2="{pos(1):.1f}" y2="{size - pos(1):.1f}" stroke="#999"/>']
    body += [f'<circle cx="{pos(p):.1f}" cy="{size - pos(r):.1f}" r="{2 + 8 * (n / top) ** 0.5:.1f}" fill="#246"/>' for p, r, n in rows if n]
    return _svg(size, size, body, "Reliability")


def trajectory_svg(lines: dict[str, list[tuple[float, float]]], width: int = 640, height: int = 240) -> str:
    """Probabilities over normalised time, one line a game."""
    body = []
    for k, (name, pts) in enumerate(lines.items()):
        path = " ".join(f"{20 + x * (width - 40):.1f},{20 + (1 - p) * (height - 40):.1f}" for x, p in pts)
        body.append(f'<polyline points="{path}" fill="none" stroke="hsl({k * 67 % 360} 60% 40%)"><title>{name}</title></polyline>')
    return _svg(width, height, body, "Trajectories")


def bars_svg(bars: list[tuple[str, float]], width: int = 480) -> str:
    """Labelled horizontal bars."""
    top = max((abs(v) for _, v in bars), default=1.0) or 1.0
    body = []
    for k, (name, v) in enumerate(bars):
        y = 16 + 26 * k
        body.append(f'<rect x="150" y="{y}" width="{abs(v) / top * (width - 220):.1f}" height="16" fill="#246"/><text x="4" y="{y + 13}" font-size="12">{name}</text><text x="{width - 62}" y="{y + 13}" font-size="12">{v:.4f}</text>')
    return _svg(width, 26 * len(bars) + 24, body, "Bars")


def sort_for_export(df: DataFrame, *keys: str) -> DataFrame:
    """SRT01: a total order, at the edge only."""
    return df.orderBy(*[F.col(k) for k in keys])
