"""Toxicity, line dedup, n-gram join, packing, and the pipeline, against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import bpe, line_dedup, ngram_join, packing, toxicity
from tallyframe.llm.queries import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, line long, root string, lines string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "x", 7, "r", "l") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- toxicity ------------------------------------------------------------------------------------

BAD = ["moronic", "scumbag", "pathetic", "worthless", "disgusting"]


def toxic_rows(rng, n=600):
    rows = []
    for i in range(n):
        ws = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['er', 'ing', 'ed', 'ly', 'ion'])}" for _ in range(120)]
        t = int(i % 5 == 0)
        if t:
            for k in rng.sample(range(120), 6):
                ws[k] = rng.choice(BAD)
        rows.append((i, " ".join(ws), t))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows(random.Random(1))
    model = toxicity.fit(rows[:400])
    d = docs(spark, [(i, t) for i, t, _ in rows[400:]])
    got = {r["doc_id"]: r["toxicity"]["toxic"] for r in toxicity.toxicity_score(d, model).collect()}
    want = {i: bool(t) for i, _, t in rows[400:]}
    assert sum(got[i] for i in want if want[i]) >= 0.9 * sum(want.values())
    assert sum(got[i] for i in want if not want[i]) <= 2


def test_toxicity_passage_in_a_long_document(spark):
    rows = toxic_rows(random.Random(11))
    model = toxicity.fit(rows[:400])
    plain = [t for _, t, label in rows if not label]
    long = " ".join(plain[k % len(plain)] for k in range(170))
    passage = next(t for _, t, label in rows[400:] if label)
    got = {r["doc_id"]: r["toxicity"]["toxic"] for r in toxicity.toxicity_score(docs(spark, [(1, long), (2, f"{long} {passage} {long}")]), model).collect()}
    assert got == {1: False, 2: True}


def test_toxicity_edges(spark):
    rows = toxic_rows(random.Random(2))
    model = toxicity.fit(rows)
    long = " ".join(["plainer"] * 200_000)
    d = docs(spark, [(1, None), (2, ""), (3, "123 !!"), (4, " ".join(BAD)), (4, " ".join(BAD)), (None, " ".join(BAD)), (5, long)])
    kept = toxicity.without_toxic(d, model)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5]
    none = toxicity.fit([])
    assert toxicity.without_toxic(d, none).count() == 7
    assert toxicity.without_toxic(d.limit(0), model).count() == 0
    labels = spark.createDataFrame([(4, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    assert toxicity.train(d, labels).gain == 0
    named = toxicity.toxicity_score(d.withColumn("toxicity", F.lit("mine")), model)
    assert named.columns == [*d.columns, "toxicity"] and {r["toxicity"]["toxic"] for r in named.collect()} == {True, False}


def test_toxicity_ids_of_any_type(spark):
    rows = toxic_rows(random.Random(13))
    d = spark.createDataFrame([(f"id-{i}", t) for i, t, _ in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(f"id-{i}", y) for i, _, y in rows], "doc_id string, toxic int")
    model = toxicity.train(d, labels)
    assert model.gain and toxicity.without_toxic(d, model).count() < len(rows)


def test_toxicity_score_against_recompression(spark):
    """Every window compressed anew, without the memory of words, and the rule written out."""
    import zstandard as zstd

    rows = toxic_rows(random.Random(14), 300)
    model = toxicity.fit(rows)

    def size(content, window):
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        p = zstd.ZstdCompressionParameters.from_level(model.level, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(zstd.ZstdCompressor(compression_params=p, dict_data=d).compress(window))

    some = rows[:12]
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.toxicity_score(docs(spark, [(i, t) for i, t, _ in some]), model).collect()}
    for i, t, _ in some:
        windows = [f" {w} ".encode() + toxicity.CARRIER for w in t.lower().split()]
        hits = [size(model.ordinary, w) - size(model.toxic, w) >= model.gain for w in windows]
        runs = max(sum(hits[k : k + toxicity.RUN]) for k in range(len(hits)))
        assert (got[i]["windows"], got[i]["toxic_windows"]) == (len(windows), sum(hits))
        assert got[i]["toxic"] == (any(hits) and (sum(hits) / len(hits) > model.share or runs > model.local))


# --- line dedup ----------------------------------------------------------------------------------


def brute_lines(rows, min_chars=20):
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if not t:
            out.append((i, t))
            continue
        keep, gone, firsts = [], 0, 0
        for line in t.split("\n"):
            norm = " ".join(line.split())
            if len(norm) < min_chars:
                keep.append(line)
            elif norm.lower() in seen:
                gone += 1
            else:
                seen.add(norm.lower())
                keep.append(line)
                firsts += 1
        if not gone or firsts:
            out.append((i, "\n".join(keep)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [words(rng, 8) for _ in range(60)] + ["Of.", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, rows[5][1]), (None, pool[0] + "\n" + "a line that nobody else has at all"), (303, pool[0].upper() + "\n" + words(rng, 9))]
    for batches in (1, 5):
        got = line_dedup.line_dedup(docs(spark, rows), batches=batches)
        assert got.columns == docs(spark, rows).columns
        found = [(r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()]
        assert sorted([x[:2] for x in found], key=str) == brute_lines(rows)
        assert all(n == (len(t) if t is not None else None) for _, t, n in found)


def test_line_dedup_repeated_rows_and_empty_table(spark):
    a = "one line that is long enough to count\nanother line that is long enough"
    got = line_dedup.line_dedup(docs(spark, [(1, a), (1, a), (1, "a different text under the same id")]))
    assert sorted(r["text"] for r in got.collect()) == sorted([a, "a different text under the same id"])
    nulls = line_dedup.line_dedup(docs(spark, [(None, a), (None, a), (2, None), (2, None), (3, ""), (4, "")]))
    assert sorted([(r["doc_id"], r["text"]) for r in nulls.collect()], key=str) == sorted([(None, a), (2, None), (3, ""), (4, "")], key=str)
    assert line_dedup.line_dedup(docs(spark, [(1, a)]).limit(0)).count() == 0
    long = "\n".join(f"line number {k} of a very long text" for k in range(30_000))
    assert line_dedup.line_dedup(docs(spark, [(1, long), (2, long)])).count() == 1


def test_line_dedup_leaves_other_columns_and_the_catalogue_alone(spark):
    d = docs(spark, [(1, "one line that is long enough to count"), (2, "one line that is long enough to count\nand another one that stays here")])
    text = d.withColumn("n_chars", F.lit("many"))
    got = line_dedup.line_dedup(text)
    assert got.schema == text.schema and {r["n_chars"] for r in got.collect()} == {"many"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_saved_runs_take_another_batch(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, fanout=3)
    runs.add(docs(spark, [(1, "this is a line of batch number one\nthis line is in every batch")]))
    runs.add(docs(spark, [(2, "this is a line of batch number two\nthis line is in every batch")]))
    runs.save(f"{tmp_path}/runs")
    runs.close()
    later = line_dedup.LineRuns.open(spark, f"{tmp_path}/runs")
    assert [len(x) for x in later.levels] == [2]
    new = later.add(docs(spark, [(3, "this line is in every batch\nthis is a line of batch number three")]))
    assert later.positions().count() == 4 and [len(x) for x in later.levels] == [0, 1]
    later.close()


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(4):
        runs.add(docs(spark, [(k, f"this is the line of batch number {k}\nthis line is in every batch")]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert runs.positions().count() == 5


# --- n-gram join ---------------------------------------------------------------------------------


def grams(t):
    ws = ngram_join.TOKEN.findall(t.lower()) if t else []
    return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


def near_rows(rng):
    rows = []
    for g in range(25):
        ws = words(rng, rng.choice([2, 6, 30, 80, 300]), 5000).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            v = [w if rng.random() > 0.03 else f"e{rng.randrange(10**6)}" for w in ws]
            rows.append((len(rows) + 1, " ".join(v)))
    rows.append((900, rows[0][1]))
    shared = words(rng, 40, 5000)
    return rows + [(1000 + k, shared + " " + words(rng, 120, 5000)) for k in range(60)]


def brute_pairs(rows, t=0.6):
    s = [(i, grams(x)) for i, x in rows if i is not None and grams(x)]
    return {(min(a, b), max(a, b)): len(x & y) / len(x | y) for k, (a, x) in enumerate(s) for b, y in s[k + 1 :] if a != b and len(x & y) / len(x | y) >= t}


def test_ngram_join_against_brute_force(spark):
    rows = near_rows(random.Random(4))
    want = brute_pairs(rows)
    pairs = {(r[0], r[1]): r[2] for r in ngram_join.ngram_jaccard_join(docs(spark, rows), all_pairs=True).collect()}
    assert all(abs(want[k] - v) < 1e-12 for k, v in pairs.items())
    from tallyframe.llm.components import Forest

    f = Forest()
    for a, b in want:
        f.union(a, b)
    groups = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()}
    together = sum(a in groups and b in groups and groups[a]["group_id"] == groups[b]["group_id"] for a, b in want)
    assert together >= 0.99 * len(want)
    assert all(g["group_id"] == f.find(i) for i, g in groups.items())
    assert all(abs(want[min(i, g["partner_id"]), max(i, g["partner_id"])] - g["jaccard"]) < 1e-12 for i, g in groups.items())


def test_ngram_join_large_copy_groups_with_rarer_passages(spark):
    """Copies of one body that also hold a passage of few documents stay in the body's group."""
    rng = random.Random(12)
    rows, group = [], {}
    for body in range(4):
        common = words(rng, 300, 100_000)
        first = len(rows)
        passages = [words(rng, 140, 100_000) for _ in range(2)]
        for k in range(50):
            passage = " " + passages[k % 2] if k >= 38 else ""
            group[len(rows)] = first
            rows.append((len(rows), f"{common}{passage} {words(rng, 2, 100_000)}"))
    got = {r["doc_id"]: r["group_id"] for r in ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()}
    assert got == group


def test_ngram_join_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = near_rows(random.Random(10))[:120]
    want = sorted(map(tuple, ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()))
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, ngram_join.ngram_jaccard_join(docs(spark, rows)).collect())) == want


def test_signature_trees_never_drop_a_pair():
    import numpy as np

    rng = random.Random(5)
    texts = [t for _, t in near_rows(rng)]
    h = ngram_join.GramHasher(3)
    sets = [h(t) for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a]) and len(sets[b]) and len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.6}
    seen = set()
    ngram_join.self_join(np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets], ngram_join.Need(0.6), lambda a, b: seen.add((min(a, b), max(a, b))), lambda a, b: False)
    assert want <= seen and len(seen) < len(sets) * (len(sets) - 1) / 4


def test_sketch_bound_misses_one_pair_in_thousands():
    """Pairs right at the threshold, against the bound that the query uses."""
    import numpy as np

    rng, need, seen = np.random.default_rng(6), ngram_join.Need(0.6, 128), 0
    assert need.least[0] == 0 and int(need.least[128]) in (55, 56, 57)
    for _ in range(3000):
        n = int(rng.integers(40, 1500))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        over = int(np.ceil(1.2 * n / 1.6))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:over], pool[n : 2 * n - over])))
        seen += ngram_join._quick(n, n, *(ngram_join.bitmap(x[:128], ngram_join.SKETCH_BITS) for x in (a, b)), need)
    assert seen >= 2997


def test_ngram_join_keeps_every_link(spark):
    """Each document's links against brute force, with pairs that have none of the smallest hashes in common."""
    rng, h = random.Random(21), ngram_join.GramHasher(3)
    rows = near_rows(rng)[:140]
    rows += [(2000 + k, rows[k % 4][1]) for k in range(9)]
    for k in range(6):
        ws = words(rng, 320, 10**6).split()
        other = list(ws)
        # the words in the middle of the 20 grams of the smallest hashes are replaced
        for i in sorted(range(318), key=lambda i: int(h(" ".join(ws[i : i + 3]))[0]))[:20]:
            other[i + 1] = f"r{k}x{i}"
        rows += [(3000 + 2 * k, " ".join(ws)), (3001 + 2 * k, " ".join(other))]
    want = brute_pairs(rows)
    assert all((3000 + 2 * k, 3001 + 2 * k) in want for k in range(6))
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()}
    assert {i: r["links"] for i, r in got.items()} == links
    assert all(got[a]["group_id"] == got[b]["group_id"] for a, b in want)


def test_ngram_join_of_ids_with_two_texts(spark):
    rng = random.Random(15)
    a, b = words(rng, 60, 5000), words(rng, 60, 5000)
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (9007199254740993, words(rng, 50, 5000)), (None, a)]
    got = {r["doc_id"]: (r["group_id"], r["partner_id"]) for r in ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (1, 2)}


def test_ngram_join_edges(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "... !!"), (4, "one"), (5, "One!"), (6, long), (7, long + " more"), (None, "one"), (8, "two words"), (8, "two words")]
    got = {r["doc_id"]: (r["group_id"], r["partner_id"]) for r in ngram_join.ngram_jaccard_join(docs(spark, rows)).collect()}
    assert got == {4: (4, 5), 5: (4, 4), 6: (6, 7), 7: (6, 6)}
    kept = ngram_join.one_of_each_group(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == [1, 2, 3, 4, 6, 8, None]
    assert ngram_join.ngram_jaccard_join(docs(spark, rows).limit(0)).count() == 0


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """No batch of texts or blobs of the join holds the usual 10,000 rows, and the setting is put back."""
    from tallyframe.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []

    def written(df, what):
        seen.append((what, int(spark.conf.get(name))))
        return common.written(df, what)

    monkeypatch.setattr(ngram_join, "written", written)
    ngram_join.ngram_jaccard_join(docs(spark, [(k, f"words of text number {k // 2}") for k in range(8)])).count()
    assert {what for what, rows in seen if rows <= 512} == {"tokens", "candidates", "matches"}
    assert spark.conf.get(name) == before


# --- packing -------------------------------------------------------------------------------------


def fits(groups, capacity):
    return all(sum(s * c for s, c in pattern) <= capacity for _, _, pattern in groups)


def optimum(sizes, capacity):
    """Fewest bins, by trying every placement."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= sizes[k]:
                go(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        go(k + 1, rooms + [capacity - sizes[k]])

    go(0, [])
    return best


def test_reduction_never_costs_a_bin():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        count = {s: sizes.count(s) for s in sizes}
        plan = packing.Plan(capacity)
        left = packing.reduce_dominated(count, capacity, plan)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert fits(plan.groups, capacity)
        assert plan.bins + (optimum(rest, capacity) if rest else 0) == optimum(sizes, capacity), (sizes, capacity)


def test_best_fit_is_best_fit():
    rng = random.Random(7)
    for _ in range(100):
        sizes = sorted((rng.randrange(1, 51) for _ in range(60)), reverse=True)
        rooms = []
        for s in sizes:
            open_ = [i for i, r in enumerate(rooms) if r >= s]
            if open_:
                rooms[min(open_, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(50 - s)
        plan = packing.Plan(50)
        packing.best_fit({s: sizes.count(s) for s in sizes}, 50, plan)
        assert plan.bins == len(rooms) and fits(plan.groups, 50)


def check_packed(rows, want, capacity):
    spans = {}
    by_doc = {}
    for r in rows:
        if r["length"]:
            spans.setdefault(r["bin_id"], []).append((r["bin_offset"], r["length"]))
            by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(spans) == list(range(len(spans)))
    assert {i: sum(n for _, n in p) for i, p in by_doc.items()} == want


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.choice([1, 3, 20, 64, 100, 333, 40]))) for i in range(300)]
    got = packing.pack(docs(spark, rows), capacity=64).collect()
    check_packed(got, {i: len(t.split()) for i, t in rows}, 64)
    count = {}
    for r in got:
        count[r["length"]] = count.get(r["length"], 0) + 1
    assert max(r["bin_id"] for r in got) + 1 == packing.plan_bins(count, 64).bins


def test_pack_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b c"), (4, "a b c"), (None, "a"), (5, "w " * 100_000)]
    got = packing.pack(docs(spark, rows), capacity=1000).collect()
    assert sorted(r["doc_id"] for r in got if r["bin_id"] is None) == [1, 2, 3]
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == 100_000
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 6
    assert packing.pack(docs(spark, rows).limit(0), capacity=10).count() == 0


def test_pack_sequences(spark):
    rng = random.Random(16)
    rows = [(i if i % 9 else None, [rng.randrange(1000) for _ in range(rng.choice([0, 1, 7, 64, 65, 200]))]) for i in range(120)] + [(5, [1, 2, 3]), (5, [1, 2, 3]), (9007199254740993, [4] * 10), (7, None)]
    d = spark.createDataFrame([(i, x, "t", 1) for i, x in rows], "doc_id long, ids array<int>, tokens string, row int")
    got = packing.pack_sequences(d, capacity=64).collect()
    pieces = []
    for r in got:
        assert len(r["tokens"]) <= 64 and sum(r["lengths"]) == len(r["tokens"])
        at = 0
        for i, start, offset, length in zip(r["doc_ids"], r["starts"], r["offsets"], r["lengths"]):
            assert offset == at
            pieces.append((str(i), start, tuple(r["tokens"][at : at + length])))
            at += length
    want = [(str(i), k, tuple(x[k : k + 64])) for i, x in rows for k in range(0, len(x or []), 64)]
    assert sorted(pieces) == sorted(want) and sorted(r["bin_id"] for r in got) == list(range(len(got)))
    assert packing.pack_sequences(d.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    base = toxic_rows(rng, 500)
    rows = [(i, t) for i, t, _ in base] + [(600 + k, base[3 * k + 1][1].replace("a", "a", 1) + " tail") for k in range(10)] + [(700, None), (701, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, _, t in base[:400]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = toxicity.fit([(i, t, y) for i, t, y in base[:400]])
    gain = toxicity.WindowGain(*model.compressors())
    clean = []
    for i, t in rows:
        hits = [gain(w) >= model.gain for w in toxicity.words(t)]
        runs = max((sum(hits[k : k + toxicity.RUN]) for k in range(len(hits))), default=0)
        if not (any(hits) and (sum(hits) / len(hits) > model.share or runs > model.local)):
            clean.append((i, t))
    lines = brute_lines(clean)
    from tallyframe.llm.components import Forest

    f = Forest()
    for a, b in brute_pairs(lines):
        f.union(a, b)
    kept = {i: t for i, t in lines if f.find(i) == i}
    check_sequences(got, kept)


def check_sequences(got, kept):
    """Every document's ids are in the sequences once, in order."""
    ranks = bpe.read_ranks(vocabulary_path())
    coder = bpe.ByteBPE(bpe.sentencepiece_model(ranks), sorted(ranks, key=ranks.__getitem__))
    back = {}
    for r in got:
        assert len(r["tokens"]) <= 2048 and sum(r["lengths"]) == len(r["tokens"])
        for i, start, offset, length in zip(r["doc_ids"], r["starts"], r["offsets"], r["lengths"]):
            back.setdefault(i, []).append((start, r["tokens"][offset : offset + length]))
    text = {i: coder.decode([x for _, part in sorted(p) for x in part]) for i, p in back.items()}
    assert text == {i: t for i, t in kept.items() if t}


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows, clashing columns, very long texts; and an empty table."""
    long = "\n".join(f"line number {k} of one very long text" for k in range(20_000))
    rows = [(None, "a text without an id that is kept"), (1, None), (2, ""), (3, long), (4, "the same row twice in the table"), (4, "the same row twice in the table"), (5, "another text that stands for itself")]
    for name, some in (("rows", rows), ("none", [])):
        docs(spark, some).withColumn("toxicity", F.lit(1)).withColumn("tokens", F.lit("t")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    check_sequences(corpus_pipeline.run(spark, f"{tmp_path}/rows").collect(), {i: t for i, t in rows})
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
