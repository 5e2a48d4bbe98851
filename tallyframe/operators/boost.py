"""Histogram Newton boosting: each level of a tree is one aggregation over binned rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import exprs as X
from tallyframe.sources import sinks

#: Rounds between two writings of the margins.
WRITE_EVERY = 8


@dataclass(frozen=True)
class Config:
    """GBM08: validated on construction."""

    rate: float = 0.05
    depth: int = 2
    rounds: int = 300
    bins: int = 64
    l2: float = 1.0
    least_rows: int = 200
    least_gain: float = 1e-6

    def __post_init__(self):
        if not (0 < self.rate <= 1 and self.depth >= 1 and self.rounds >= 1 and 2 <= self.bins <= 256 and self.l2 >= 0 and self.least_rows >= 1 and self.least_gain >= 0):
            raise ValueError(f"bad configuration: {self}")


@dataclass
class Node:
    """A split (feature, threshold, children) or a leaf value."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        """GBM05: nested conditions; values below the threshold go left."""
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(F.col(self.feature) < self.threshold, self.left.column()).otherwise(self.right.column())


@dataclass
class Model:
    """GBM07: a start value and trees."""

    start: float
    rate: float
    trees: list[Node] = field(default_factory=list)

    def margin(self) -> Column:
        """The sum of the trees."""
        z = F.lit(self.start)
        for t in self.trees:
            z = z + t.column() * self.rate
        return z

    def predict(self) -> Column:
        """Probability."""
        return X.sigmoid(self.margin())

    def truncated(self, n: int) -> Model:
        """The first n trees."""
        return Model(self.start, self.rate, self.trees[:n])


def bin_edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """GBM01, AGG41: distinct inner quantiles of every feature, exact, in one aggregation."""
    qs = [k / bins for k in range(1, bins)]
    r = df.agg(*[F.percentile(f, F.array(*[F.lit(q) for q in qs])).alias(f) for f in features]).first()
    return {f: sorted(set(r[f] or [])) for f in features}


def bin_of(c: Column, edges: list[float]) -> Column:
    """GBM01: how many edges are at or below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= c))


def histograms(binned: DataFrame, features: list[str]) -> DataFrame:
    """AGG42: gradient, Hessian and count sums by node, feature and bin: one shuffle for all features."""
    x = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in features]))
    return binned.select("node", "g", "h", x.alias("x")).groupBy("node", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def leaf_value(g: float, h: float, l2: float) -> float:
    """GBM02."""
    return -g / (h + l2)


def split_gain(gl: float, hl: float, gr: float, hr: float, l2: float) -> float:
    """GBM02."""
    return 0.5 * (gl * gl / (hl + l2) + gr * gr / (hr + l2) - (gl + gr) ** 2 / (hl + hr + l2))


def best_split(rows: dict[str, dict[int, tuple[float, float, int]]], features: list[str], edges: dict[str, list[float]], c: Config) -> tuple[str, int] | None:
    """GBM03: the largest gain; ties go to the first feature and the lowest threshold."""
    best, found = c.least_gain, None
    for f in features:
        hist = rows.get(f, {})
        tg, th, tn = (sum(v[k] for v in hist.values()) for k in range(3))
        g = h = 0.0
        n = 0
        for b in range(len(edges[f])):
            dg, dh, dn = hist.get(b, (0.0, 0.0, 0))
            g, h, n = g + dg, h + dh, n + dn
            if n >= c.least_rows and tn - n >= c.least_rows and (gain := split_gain(g, h, tg - g, th - h, c.l2)) > best:
                best, found = gain, (f, b)
    return found


def fit(df: DataFrame, features: list[str], config: Config, *, y: str = "y", validation: DataFrame | None = None, patience: int | None = None) -> tuple[Model, list[float]]:
    """GBM04, GBM06: (model, validation loss by round). Bins are computed once and kept; each level
    is one aggregation of (node, feature, bin). Rows carry their margin as a column; every ``WRITE_EVERY``
    rounds they are written to the shared folder, so that no plan holds more trees than that. The
    validation rows carry theirs in the same table."""
    edges = bin_edges(df, features, config.bins)
    mean = float(df.agg(F.avg(F.col(y).cast("double"))).first()[0])
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    model = Model(float(np.log(mean / (1 - mean))), config.rate)
    spark, bins = df.sparkSession, [f"bin_{f}" for f in features]
    take = lambda d, held: d.select(F.col(y).cast("double").alias("y"), *features, F.lit(held).alias("__tf_held"))
    rows = take(df, False) if validation is None else take(df, False).unionByName(take(validation, True))
    rows = rows.select("*", *[bin_of(F.col(f), edges[f]).alias(f"bin_{f}") for f in features], F.lit(model.start).alias("__tf_margin"))
    paths_written: list[str] = []

    def keep(d: DataFrame) -> DataFrame:
        paths_written.append(sinks.scratch(spark, "margins"))
        d.write.parquet(paths_written[-1])
        return spark.read.parquet(paths_written[-1])

    rows = keep(rows)
    losses: list[float] = []
    for turn in range(config.rounds):
        p = X.sigmoid(F.col("__tf_margin"))
        base = rows.where("not __tf_held").select(*bins, p.alias("p"), "y").select(*bins, (F.col("p") - F.col("y")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
        root = Node()
        open_: dict[int, Node] = {0: root}
        paths: dict[int, Column] = {0: F.lit(True)}
        for level in range(config.depth + 1):
            node = F.lit(None).cast("int")
            for k, cond in paths.items():
                node = F.when(cond, F.lit(k)).otherwise(node)
            hist: dict[int, dict] = {}
            for r in histograms(base.withColumn("node", node).where("node is not null"), features).collect():  # nodes x features x bins
                hist.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"], r["n"])
            nxt: dict[int, Node] = {}
            nxt_paths: dict[int, Column] = {}
            for k, nd in open_.items():
                first = hist.get(k, {}).get(features[0], {})
                nd.value = leaf_value(sum(v[0] for v in first.values()), sum(v[1] for v in first.values()), config.l2)
                found = best_split(hist.get(k, {}), features, edges, config) if level < config.depth else None
                if found:
                    f, b = found
                    nd.feature, nd.threshold, nd.left, nd.right = f, edges[f][b], Node(), Node()
                    nxt[2 * k + 1], nxt[2 * k + 2] = nd.left, nd.right
                    nxt_paths[2 * k + 1], nxt_paths[2 * k + 2] = paths[k] & (F.col(f"bin_{f}") <= b), paths[k] & (F.col(f"bin_{f}") > b)
            open_, paths = nxt, nxt_paths
            if not open_:
                break
        model.trees.append(root)
        rows = rows.withColumn("__tf_margin", F.col("__tf_margin") + root.column() * config.rate)
        if (turn + 1) % WRITE_EVERY == 0 and turn + 1 < config.rounds:
            rows = keep(rows)
        if validation is not None:
            losses.append(float(rows.where("__tf_held").agg(F.avg(X.log_loss(F.col("y"), X.sigmoid(F.col("__tf_margin"))))).first()[0]))
            if patience and len(losses) - 1 - int(np.argmin(losses)) >= patience:
                break
    for at in paths_written:
        sinks.remove(spark, at)
    return model, losses


def select_config(train: DataFrame, validation: DataFrame, features: list[str], grid: list[Config], *, patience: int = 20) -> tuple[Config, int, dict]:
    """GBM09: the configuration and number of rounds of least validation loss."""
    seen = {}
    for c in grid:
        _, losses = fit(train, features, c, validation=validation, patience=patience)
        seen[c] = (min(losses), int(np.argmin(losses)) + 1)
    best = min(seen, key=lambda c: seen[c][0])
    return best, seen[best][1], {(c.rate, c.depth): v for c, v in seen.items()}
