"""Best-fit packing after Martello-Toth dominance reduction (operator 4).

Documents are laid into sequences of ``capacity`` tokens. What a packing looks like depends only
on how many pieces of each size there are, so Spark reduces the corpus to that histogram (at most
``capacity`` sizes, whatever the corpus), the driver plans on it, and each piece then finds its
place from its size and its rank among the pieces of that size. The plan is global: no bin is
confined to a partition.

1. *Dominance reduction.* From the largest size down, a set is fixed for good when it dominates
   every other that holds the same largest item: the item alone when nothing fits beside it; with
   the largest item that fits when both fill the bin, when no two others fit, or when at most two
   fit and that one is no smaller than any such two; with the largest two when at most two fit and
   each is no smaller than its counterpart in any other pair. This repeats until nothing more is
   fixed. Equal sizes are fixed in bulk.
2. *Best fit.* The rest go, largest first, to the fullest bin that takes them.

Sizes are words unless ``size`` is another expression. A document longer than ``capacity`` is cut
into full pieces and a rest; every piece is packed.

Defined cases: a null or empty text (size null or 0) has one row with length 0 and no bin (null).
Rows with one id are separate documents. A negative size counts as 0. Ties of equal size are
ordered by id, then piece. An empty table gives no rows. Ids of any size and type are kept as they are.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import small_batches, written

#: Parts that a size is split in for ranking, so that one frequent size isn't one task: so many at least,
#: and one for each so many pieces.
SPREAD, PIECES = 32, 4_000_000


@dataclass
class Plan:
    """Groups of equal bins: (first bin, bins, ((size, copies), ...)), in order of planning."""

    capacity: int
    groups: list[tuple[int, int, tuple[tuple[int, int], ...]]] = field(default_factory=list)
    bins: int = 0
    fixed_bins: int = 0

    def add(self, count: int, pattern: tuple[tuple[int, int], ...]) -> None:
        """Append ``count`` bins of one pattern."""
        if count:
            self.groups.append((self.bins, count, pattern))
            self.bins += count


def reduce_dominated(count: dict[int, int], capacity: int, plan: Plan) -> dict[int, int]:
    """Fix dominating sets in ``plan``; returns the sizes that are left."""
    left = {s: n for s, n in count.items() if n > 0}
    sizes = sorted(left)

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            del left[s]
            sizes.pop(bisect.bisect_left(sizes, s))

    def spare(s: int, used: tuple[int, ...]) -> int:
        return left.get(s, 0) - used.count(s)

    def largest(most: int, used: tuple[int, ...]) -> int | None:
        i = bisect.bisect_right(sizes, most)
        while i > 0:
            i -= 1
            if spare(sizes[i], used) > 0:
                return sizes[i]
        return None

    def smallest(n: int, used: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(n - len(out), spare(s, used))
            if len(out) >= n:
                break
        return out

    def most_pair(room: int, used: tuple[int, ...]) -> int:
        """The largest sum of two items that fit in ``room``."""
        best, lo, hi = 0, 0, bisect.bisect_right(sizes, room) - 1
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            if a + b > room or spare(b, used) <= 0:
                hi -= 1
            elif spare(a, used) <= 0 or (lo == hi and spare(a, used) < 2):
                lo += 1
            else:
                best = max(best, a + b)
                lo += 1
        return best

    changed = True
    while changed and left:
        changed = False
        for s in sorted(left, reverse=True):
            while left.get(s, 0):
                room, used = capacity - s, (s,)
                k = largest(room, used)
                if k is None:
                    n = left[s]
                    plan.add(n, ((s, 1),))
                    take(s, n)
                    changed = True
                    continue
                few = smallest(3, used)
                two = len(few) < 2 or few[0] + few[1] > room
                three = len(few) < 3 or sum(few) > room
                if k == room or two or (three and k >= most_pair(room, used)):
                    n = left[s] // 2 if k == s else min(left[s], left[k])  # true for as long as both last
                    plan.add(n, ((s, 2),) if k == s else ((s, 1), (k, 1)))
                    take(s, 2 * n if k == s else n)
                    if k != s:
                        take(k, n)
                    changed = True
                    continue
                if three:
                    b = largest(room - k, (s, k))
                    half = largest(room // 2, (s, k))
                    if b is not None and (half is None or b >= half):
                        pattern = defaultdict(int)
                        for x in (s, k, b):
                            pattern[x] += 1
                        n = min(left[x] // m for x, m in pattern.items())
                        plan.add(n, tuple(sorted(pattern.items(), reverse=True)))
                        for x, m in pattern.items():
                            take(x, n * m)
                        changed = True
                        continue
                break
    plan.fixed_bins = plan.bins
    return left


def best_fit(left: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best fit of the rest, largest first, as groups of equal bins."""
    opened: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, n: int, pattern: tuple[tuple[int, int], ...]) -> None:
        if n:
            if not opened[room]:
                bisect.insort(rooms, room)
            opened[room].append((n, pattern))

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                per = capacity // s
                full, rest = divmod(n, per)
                put(capacity - per * s, full, ((s, per),))
                put(capacity - rest * s, int(rest > 0), ((s, rest),))
                break
            room = rooms[i]
            bins, pattern = opened[room].pop()
            if not opened[room]:
                rooms.pop(i)
            per = room // s
            full = min(bins, n // per)
            put(room - per * s, full, (*pattern, (s, per)))
            n, bins = n - full * per, bins - full
            if bins and n and n < per:
                put(room - n * s, 1, (*pattern, (s, n)))
                n, bins = 0, bins - 1
            put(room, bins, pattern)
    for room in rooms:
        for n, pattern in opened[room]:
            plan.add(n, pattern)


def plan_bins(count: dict[int, int], capacity: int) -> Plan:
    """Reduction, then best fit."""
    plan = Plan(capacity)
    best_fit(reduce_dominated(count, capacity, plan), capacity, plan)
    return plan


def _slots(plan: Plan) -> dict[str, np.ndarray]:
    """For each size, the ranks that each group takes: sorted by (size, first rank)."""
    at: dict[int, int] = defaultdict(int)
    rows = []
    for first, n, pattern in plan.groups:
        offset = 0
        for s, copies in pattern:
            rows.append((s, at[s], first, copies, offset))
            at[s] += n * copies
            offset += s * copies
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {"key": a[:, 0] * (1 << 44) + a[:, 1], "rank": a[:, 1], "bin": a[:, 2], "copies": a[:, 3], "offset": a[:, 4]}


def word_count(text: Column) -> Column:
    """Words of a text: stretches without white space."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def _cut(n: Column, capacity: int) -> Column:
    """Numbers of the pieces of a document of ``n`` tokens; an empty one has piece 0."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(n / capacity) - 1).cast("long"))


def pack(docs: DataFrame, *, capacity: int = 2048, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, bin_id, bin_offset), one for each piece."""
    n = (size if size is not None else word_count(F.col(text_col).cast("string"))).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias("n"))
    cut = sized.select("doc_id", "n", F.explode(_cut(F.col("n"), capacity)).alias("piece"))
    pieces = cut.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("length"))
    pieces = written(pieces, "pieces")
    parts = max(SPREAD, -(-pieces.count() // PIECES))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    # at most capacity * parts rows: 16 bytes for each of 4 million pieces and size
    counts = pieces.where("length > 0").groupBy("length", "part").count().orderBy("length", "part").toPandas()
    plan = plan_bins(counts.groupby("length")["count"].sum().astype(int).to_dict(), capacity)
    slots = _slots(plan)
    before = counts.groupby("length")["count"].cumsum() - counts["count"]
    base = np.zeros((capacity + 1, parts), dtype=np.int64)
    base[counts["length"].to_numpy(dtype=int), counts["part"].to_numpy(dtype=int)] = before.to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((slots, base))
    spread = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = pieces.where("length > 0").withColumn("rank", F.row_number().over(spread))

    @F.pandas_udf("bin_id long, bin_offset long")
    def place(length: pd.Series, part: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slots, base = shared.value
        s = length.to_numpy(dtype=np.int64)
        at = base[s, part.to_numpy(dtype=np.int64)] + rank.to_numpy(dtype=np.int64) - 1
        i = np.searchsorted(slots["key"], s * (1 << 44) + at, side="right") - 1
        nth = at - slots["rank"][i]
        return pd.DataFrame({"bin_id": slots["bin"][i] + nth // slots["copies"][i], "bin_offset": slots["offset"][i] + (nth % slots["copies"][i]) * s})

    placed = ranked.select("doc_id", "piece", "start", "length", place("length", "part", "rank").alias("at")).select("doc_id", "piece", "start", "length", "at.bin_id", "at.bin_offset")
    empty = pieces.where("length = 0").select("doc_id", "piece", "start", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"))
    return placed.unionByName(empty)


def pack_sequences(docs: DataFrame, *, capacity: int = 2048, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The sequences themselves, from token ids: rows (bin_id, doc_ids, starts, offsets, lengths, tokens).

    ``tokens`` are the bin's ids, ``capacity`` at most; the k-th piece in it is of document ``doc_ids[k]``,
    from that document's token ``starts[k]`` on, and is at ``offsets[k]``, ``lengths[k]`` long. Documents
    without tokens are in no sequence.
    """
    ids = F.col(f"`{ids_col}`")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), ids.alias("ids")).where(F.size("ids") > 0)
    cut = rows.select("row", "doc_id", "ids", F.explode(_cut(F.size("ids"), capacity)).alias("piece"))
    with small_batches(docs.sparkSession, 256):  # the ids may be made by Python as they are written
        cut = written(cut.select("row", "doc_id", "piece", F.slice("ids", (F.col("piece") * capacity).cast("int") + 1, capacity).alias("tokens")), "token-pieces")
    whole = cut.groupBy("row").agg(F.sum(F.size("tokens")).alias("n"))
    places = pack(whole, capacity=capacity, size=F.col("n"), id_col="row").withColumnRenamed("doc_id", "row")
    piece = F.struct("bin_offset", "doc_id", "start", "length", "tokens")
    bins = cut.join(places, ["row", "piece"]).groupBy("bin_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return bins.select("bin_id", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.bin_offset").alias("offsets"), F.col("p.length").alias("lengths"), F.flatten("p.tokens").alias("tokens"))
