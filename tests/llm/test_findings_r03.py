"""What the findings of round 3 asked for, of the text operators."""

import numpy as np

from tallyframe.llm import embedding_dedup


def test_blocks_are_compared_in_stripes_and_all_links_found(spark):
    """whatever the stripes, all links; copies, scaled copies and repeated ids count as before."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 12))
    near = m[rng.integers(0, 40, 260)] + rng.normal(scale=0.05, size=(260, 12))
    x = np.concatenate((m, near, m[:5], 2.0 * m[:5])).astype(np.float32)
    ids = list(range(len(x) - 1)) + [7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    got = {stripe: sorted(map(tuple, embedding_dedup.embedding_near_dedup(df, threshold=0.9, stripe_bytes=stripe).collect())) for stripe in (1, 1 << 20)}
    assert got[1] == got[1 << 20]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos, ids = u @ u.T, np.array(ids)
    links = {}
    for i in range(len(x)):
        if i != len(x) - 1:  # the repeated id has the links of both of its vectors
            links[int(ids[i])] = {int(ids[j]) for j in range(len(x)) if cos[i, j] >= 0.9 and ids[j] != ids[i]}
    for i, _, partner, _, n in got[1]:
        assert partner in links[i] or i == 7
        if i != 7 and 7 not in links[i]:
            assert n == len(links[i])
    assert {r[0] for r in got[1]} >= {i for i, s in links.items() if s}


def test_the_comparison_of_blocks_shuffles_nothing(spark, monkeypatch):
    """disk used to grow with the number of block pairs."""
    plans = []
    write = type(spark.range(1).write).parquet

    def parquet(self, path, *a, **k):
        if "near-pairs" in path:
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *a, **k)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", parquet)
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_near_dedup(df).count() == 60
    assert plans and all("Exchange hashpartitioning" not in p and "Exchange rangepartitioning" not in p for p in plans)


def _near_copies(rng, members, words=120, changed=12):
    base = rng.integers(0, 5000, words)
    out = []
    for _ in range(members):
        t = base.copy()
        at = rng.integers(0, words, rng.integers(0, changed))
        t[at] = rng.integers(5000, 90_000, len(at))
        out.append(" ".join(f"w{k}" for k in t))
    return out


def test_large_groups_of_near_copies(spark, monkeypatch):
    """all links of large groups by products of matrices, with candidates in proportion to the group."""
    from tallyframe.llm import ngram_join

    rng = np.random.default_rng(17)
    texts = _near_copies(rng, 240) + _near_copies(rng, 90, changed=60) + [" ".join(f"x{k}" for k in rng.integers(0, 30_000, 40)) for _ in range(60)]
    texts += texts[:6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    made = {}
    keep = ngram_join.written

    def written(d, name):
        out = keep(d, name)
        if "candidates" in name or name == "stars-of-tokens":
            made[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    got = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(df).collect()}
    assert sum(made.values()) < 10 * len(texts)  # all pairs of the first group alone are 28,680
    grams = ngram_join.GramHasher(3)
    sets = [set(grams(t).tolist()) for t in texts]
    links, best = {}, {}
    for i, x in enumerate(sets):
        js = [(len(x & y) / len(x | y), -k) for k, y in enumerate(sets) if k != i]
        if n := sum(j >= 0.6 for j, _ in js):
            links[i], best[i] = n, max(js)
    assert {i: r["links"] for i, r in got.items()} == links
    assert all(abs(r["jaccard"] - best[i][0]) < 1e-12 for i, r in got.items())
    some = {r["doc_id"]: r["group_id"] for r in ngram_join.ngram_jaccard_join(df, links=False).collect()}
    assert some == {i: r["group_id"] for i, r in got.items()}
