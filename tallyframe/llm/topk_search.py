"""Exact top-k search with an impact-ordered index, read score-at-a-time (operator 2).

Every row of ``queries`` is a query; the ``k`` documents of highest BM25 score are returned for
each, exactly. Scores are sums of integer impacts (micro-units, so that they don't depend on the
order of summation); ties go to the smaller document id.

Index: documents stay in the partitions they are read in, and each partition is a shard (the
usual document-partitioned index). In a shard, the postings of a term are sorted by falling
quantised impact (``levels`` levels of the term's global maximum) and cut into segments of equal
quantised impact. For a query, segments of all its terms are processed in order of falling quantised
impact, adding to accumulators. Processing stops only on proof: when no document outside the current
k best can reach the k-th best even with all that remains. With ``remaining`` the sum over terms of
the next segments' upper bounds, a document's final score lies between its accumulator's lower
bound and upper bound + remaining; members that may still be among the k best are rescored
exactly from their term frequencies. The shards' k best are then merged.

Collection statistics (document count, average length, document frequencies) are exact counts over
all documents; only the vocabulary of the query batch is indexed, since no other posting is ever
read. The vocabulary is broadcast; its size is that of the query table, checked against
``max_vocabulary``: queries with more distinct terms than that are run in several batches, each with its
own scan of the documents and the same result.

Defined cases: a query or document that is null, empty or without a letter or digit matches nothing.
A term that no document has adds nothing. Repeated terms of a query count as often as they
occur. Queries with equal ids are one query each row only if their texts differ: equal rows are one.
Documents with a null id are not returned and not counted. Rows that repeat a document's id are
documents of their own and may both be returned. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import written

#: Letters and digits of any script; of Latin-1, those that the SQL has.
TOKEN = re.compile(r"[^\W_ª²³µ¹º¼-¾]+")
K1, B, MICRO = 1.2, 0.75, 1_000_000


def tokens(text: str | None) -> list[str]:
    """Lower-case words of letters and digits."""
    return TOKEN.findall(text.lower()) if text else []


def impacts(tf: np.ndarray, length: np.ndarray, df: int, n: int, average: float) -> np.ndarray:
    """BM25 contributions in micro-units."""
    idf = np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    w = idf * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * length / average))
    return np.floor(w * MICRO + 0.5).astype(np.int64)


class Shard:
    """The impact-ordered postings of one partition's documents."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, df: dict[int, int], n: int, average: float, levels: int):
        self.ids = ids
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        cuts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.array([], dtype=int)
        ends = np.append(cuts[1:], len(term))
        #: term -> documents, exact impacts, segment starts, upper bound of each segment
        self.postings: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.step: dict[int, int] = {}
        for s, e in zip(cuts.tolist(), ends.tolist()):
            t = int(term[s])
            w = impacts(tf[s:e].astype(float), length[doc[s:e]].astype(float), df[t], n, average)
            self.exact[t] = (doc[s:e], w)  # by document
            step = self.step[t] = max(1, -(-int(w.max()) // levels))
            q = -(-w // step)
            o = np.argsort(-q, kind="stable")
            q = q[o]
            starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            self.postings[t] = (doc[s:e][o], w[o], np.append(starts, len(q)), q[starts] * step)
        self.work = np.zeros(len(ids), dtype=np.int64)

    def search(self, query: Counter, k: int) -> list[tuple[int, int, int]]:
        """(position, id, score) of the k best."""
        terms = [(t, c) for t, c in query.items() if t in self.postings]
        if not terms:
            return []
        segments = sorted(((int(b) * c, t, c, i) for t, c in terms for i, b in enumerate(self.postings[t][3])), key=lambda x: (-x[0], x[1], x[3]))
        bound = {t: int(self.postings[t][3][0]) * c for t, c in terms}
        remaining, acc = sum(bound.values()), self.work
        acc[:] = 0
        # accumulators add upper bounds of segments; slack is the most a bound can exceed the truth
        slack = sum(self.step[t] * c for t, c in terms)
        proof_at, done, touched = max(1, len(segments) // 8), 0, None
        for done, (_, t, c, i) in enumerate(segments, 1):
            docs, _, starts, ub = self.postings[t]
            acc[docs[starts[i] : starts[i + 1]]] += int(ub[i]) * c
            nxt = int(ub[i + 1]) * c if i + 1 < len(ub) else 0
            remaining += nxt - bound[t]
            bound[t] = nxt
            if done % proof_at == 0 and remaining:
                # final score >= acc - slack, final score <= acc + remaining
                if len(acc) <= k:
                    continue
                kth = int(np.partition(acc, len(acc) - k)[-k])
                if kth - slack > remaining:  # no document that is untouched can be a member
                    touched = np.flatnonzero(acc + remaining >= kth - slack)
                    if len(touched) <= 4 * k + 64:
                        break
        if touched is None or not (0 < len(touched) <= 4 * k + 64):
            if int((acc > 0).sum()) > k:
                kth = int(np.partition(acc, len(acc) - k)[-k])
                touched = np.flatnonzero((acc > 0) & (acc + remaining >= kth - slack))
            else:
                touched = np.flatnonzero(acc > 0)
        score = np.zeros(len(touched), dtype=np.int64)
        for t, c in terms:
            docs, w = self.exact[t]
            at = np.searchsorted(docs, touched)
            at[at == len(docs)] = 0
            hit = docs[at] == touched
            score[hit] += w[at[hit]] * c
        o = np.lexsort((touched, self.ids[touched], -score))[:k]
        return [(int(touched[x]), int(self.ids[touched[x]]), int(score[x])) for x in o if score[x] > 0]


def _forward(vocabulary):
    """Documents as (id, length, term numbers, frequencies) over the query vocabulary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.value
        for b in batches:
            out = []
            for i, text in zip(b["id"].tolist(), b["text"]):
                ws = tokens(text)
                if ws:
                    c = Counter(x for w in ws if (x := number.get(w)) is not None)
                    out.append((i, len(ws), list(c), list(c.values())))
            yield pd.DataFrame(out, columns=["id", "length", "terms", "tfs"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = 10, levels: int = 64, max_vocabulary: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Rows (query_id, rank, doc_id, score), score in BM25 units, rank from 1."""
    asked = [(r[0], tokens(r[1])) for r in queries.select(F.col(query_id).cast("long"), F.col(query_text).cast("string")).distinct().orderBy(query_id, query_text).collect()]
    asked = [(i, ws) for i, ws in asked if ws and i is not None]
    batches: list[list[tuple[int, list[str]]]] = [[]]
    held: set[str] = set()
    for i, ws in asked:
        if batches[-1] and len(held | set(ws)) > max_vocabulary:
            batches.append([])
            held = set()
        batches[-1].append((i, ws))
        held |= set(ws)
    found = [_batch(docs, batch, k, levels, id_col, text_col) for batch in batches]
    return reduce(DataFrame.unionByName, found)


def _batch(docs: DataFrame, asked: list[tuple[int, list[str]]], k: int, levels: int, id_col: str, text_col: str) -> DataFrame:
    """The k best documents for each of the queries, whose terms are broadcast."""
    spark = docs.sparkSession
    number = {w: n for n, w in enumerate(sorted({w for _, ws in asked for w in ws}))}
    vocabulary = spark.sparkContext.broadcast(number)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    forward = written(source.mapInPandas(_forward(vocabulary), "id long, length int, terms array<int>, tfs array<int>"), "forward-index")
    stats = forward.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    n, average = int(stats["n"]), (stats["total"] or 0) / max(1, stats["n"])
    df = {int(r[0]): int(r[1]) for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    shared = spark.sparkContext.broadcast((df, n, average, [(i, Counter(number[w] for w in ws)) for i, ws in asked]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, average, asked = shared.value
        parts = list(batches)
        rows = pd.concat(parts) if parts else None
        if rows is None or not len(rows):
            return
        rows = rows.sort_values("id", kind="stable")
        sizes = rows["terms"].map(len).to_numpy()
        doc = np.repeat(np.arange(len(rows)), sizes)
        term = np.concatenate(rows["terms"].to_list()).astype(np.int64) if sizes.sum() else np.array([], dtype=np.int64)
        tf = np.concatenate(rows["tfs"].to_list()).astype(np.int64) if sizes.sum() else np.array([], dtype=np.int64)
        shard = Shard(rows["id"].to_numpy(), rows["length"].to_numpy(), doc, term, tf, df, n, average, levels)
        out = [(i, q, d, s) for q, (i, c) in enumerate(asked) for _, d, s in shard.search(c, k)]
        yield pd.DataFrame(out, columns=["query_id", "row", "doc_id", "micro"])

    local = forward.mapInPandas(search, "query_id long, row int, doc_id long, micro long")
    w = Window.partitionBy("query_id", "row").orderBy(F.desc("micro"), "doc_id")
    best = local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", (F.col("micro") / float(MICRO)).alias("score"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}]+')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM len),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9\x{df}-\x{f6}\x{f8}-\x{ff}]+')) AS term FROM benchmark) GROUP BY item_id, term),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
p AS (SELECT tf.doc_id, tf.term, CAST(floor(ln(1.0 + (CAST(n AS DOUBLE) - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1.0 - 0.75 + 0.75 * dl / avgdl)) * 1000000 + 0.5) AS BIGINT) AS w
      FROM tf JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN s),
r AS (SELECT item_id, doc_id, sum(w * c) AS m FROM p JOIN q USING (term) GROUP BY item_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY m DESC, doc_id) AS rank FROM r)
SELECT item_id AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(m AS DOUBLE) / 1000000.0 AS score FROM k WHERE rank <= 10
"""
