"""Embedding dedup, search, WARC, BPE, URL filter and chat spans, against brute force."""

import gzip
import hashlib
import io
import math
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken

from tallyframe.llm import bpe, chat_format, embedding_dedup, topk_search, url_filter, warc
from tallyframe.llm.components import Forest, components
from tallyframe.llm.queries import vocabulary_path


# --- components ----------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(1, 300)] + [(1000, rng.randrange(1001, 1100)) for _ in range(80)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (7000, 7000)]
    f = Forest()
    for a, b in edges:
        if a != b:
            f.union(a, b)
    want = {x: f.find(x) for e in edges for x in e if e[0] != e[1]}
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long").repartition(7)
    assert {r["node"]: r["root"] for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


# --- embeddings ----------------------------------------------------------------------------------


def test_embedding_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((400, 32))
    rows = [base]
    for k in range(60):
        rows.append(base[k] + 0.12 * rng.standard_normal((1 + k % 4, 32)) * np.linalg.norm(base[k]) / math.sqrt(32))
    rows.append(np.repeat(base[7:8], 40, axis=0) * 3.0)
    rows.append(base[9] + 0.05 * rng.standard_normal((150, 32)))
    x = np.concatenate(rows)
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(n @ n.T >= 0.95, 1))
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, key int, pass int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_near_dedup(df).collect()}
    found = sum(i in got and j in got and got[i]["group_id"] == got[j]["group_id"] for i, j in zip(a.tolist(), b.tolist()))
    assert found >= 0.95 * len(a)
    for i, r in got.items():
        assert n[i] @ n[r["partner_id"]] >= 0.95 - 1e-5 and abs(n[i] @ n[r["partner_id"]] - r["cosine"]) < 1e-4


def test_embedding_links_are_all_found(spark, monkeypatch):
    """Groups, links and nearest partners against brute force, over several blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(31)
    base = rng.standard_normal((500, 24))
    x = np.concatenate((base, base[:80] + 0.32 * rng.standard_normal((80, 24)), base[5] + 0.2 * rng.standard_normal((200, 24)), np.repeat(base[7:9], 6, axis=0)))
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = n @ n.T
    np.fill_diagonal(cos, -1)
    near = cos >= 0.95
    f = Forest()
    for a, b in zip(*np.nonzero(near)):
        f.union(int(a), int(b))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_near_dedup(df).collect()}
    assert {i: (r["group_id"], r["links"]) for i, r in got.items()} == {i: (f.find(i), int(k)) for i, k in enumerate(near.sum(axis=1)) if k}
    assert all(abs(r["cosine"] - cos[i].max()) < 1e-5 and abs(cos[i, r["partner_id"]] - cos[i].max()) < 1e-5 for i, r in got.items())


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (8, [1.0, 1.0, 0.0]), (None, [1.0, 1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["group_id"]) for r in embedding_dedup.embedding_near_dedup(df).collect()}
    assert got == {(6, 6), (7, 6)}
    assert embedding_dedup.embedding_near_dedup(df.limit(0)).count() == 0


def test_embeddings_of_ids_with_several_vectors(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, v), (2, v), (2, w), (3, [0.01, 1.0, 0.0]), (9007199254740993, [0.0, 0.0, 1.0]), (9007199254740995, [0.0, 0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["group_id"]) for r in embedding_dedup.embedding_near_dedup(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9007199254740993, 9007199254740993), (9007199254740995, 9007199254740993)}


# --- search --------------------------------------------------------------------------------------


def brute_search(docs, queries, k):
    toks = {i: Counter(topk_search.tokens(t)) for i, t in docs if t}
    toks = {i: c for i, c in toks.items() if c}
    n, avg = len(toks), sum(sum(c.values()) for c in toks.values()) / max(1, len(toks))
    df = Counter(w for c in toks.values() for w in c)
    out = {}
    for q, text in queries:
        scores = Counter()
        for w, m in Counter(topk_search.tokens(text)).items():
            for i, c in toks.items():
                if w in c:
                    scores[i] += m * int(topk_search.impacts(np.array([float(c[w])]), np.array([float(sum(c.values()))]), df[w], n, avg)[0])
        out[q] = sorted(((-s, i) for i, s in scores.items()))[:k]
    return out


def test_search_is_exact(spark):
    rng = random.Random(3)
    vocabulary = [f"t{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 90])))) for i in range(500)]
    docs += [(500 + i, docs[i][1]) for i in range(20)] + [(900, None), (901, ""), (902, "!!")]
    queries = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 30])))) for i in range(40)] + [(98, ""), (99, None), (97, "nowhere")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, terms int").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    want = brute_search(docs, [(i, t) for i, t in queries if t], 10)
    got = {}
    for r in topk_search.top_k(d, q, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"] * 1e6), r["doc_id"]))
    assert got == {i: x for i, x in want.items() if x}
    batched = sorted(map(tuple, topk_search.top_k(d, q, k=10, max_vocabulary=40).collect()))
    assert batched == sorted(map(tuple, topk_search.top_k(d, q, k=10).collect()))
    long = spark.createDataFrame([(1, "t1 " * 300_000), (2, "t1 t2")], "doc_id long, text string")
    assert {r["doc_id"] for r in topk_search.top_k(long, spark.createDataFrame([(1, "t1")], "item_id long, text string")).collect()} == {1, 2}
    assert topk_search.top_k(d.limit(0), q).count() == 0
    assert topk_search.top_k(d, q.limit(0)).count() == 0


def test_search_stops_early_only_on_proof():
    rng = np.random.default_rng(4)
    n = 3000
    doc = np.concatenate([rng.choice(n, n // 2, replace=False) for _ in range(6)])
    term = np.repeat(np.arange(6), n // 2)
    tf = rng.zipf(1.7, len(doc)).clip(1, 500)
    length = np.maximum(np.bincount(doc, tf, n).astype(int) + rng.integers(1, 200, n), 1)
    order = np.lexsort((doc, term))
    shard = topk_search.Shard(np.arange(n), length, doc[order], term[order], tf[order], dict.fromkeys(range(6), n // 2), n, float(length.mean()), 64)
    full = np.zeros(n, dtype=np.int64)
    for t in range(6):
        d, w = shard.exact[t]
        full[d] += w
    want = sorted(((-s, i) for i, s in enumerate(full.tolist())))[:10]
    assert [(-s, i) for _, i, s in shard.search(Counter(range(6)), 10)] == want


# --- warc ----------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"http://x/{i}", bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 99, 100, 101, 5000])))) for i in range(40)]
    rows += [(100, None, b"WARC/1.1\r\n\r\n" * 50), (None, "http://y", b"a"), (101, "http://z", None), (3, "http://x/3", rows[3][2])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html binary, chunk int").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"), id_col="page_id", uri_col="url", payload_col="html", chunk_bytes=64)
    got = warc.read_warc(spark, str(tmp_path / "w"), chunk_bytes=100).collect()
    back, digest = {}, {}
    for r in sorted(got, key=lambda r: (r["file"], r["record_no"], r["chunk_no"])):
        k = (r["file"], r["record_no"])
        assert r["chunk_offset"] == len(back.get(k, (0, 0, b""))[2]) and r["error"] is None and len(r["chunk"]) <= 100
        back[k] = (r["source_id"], r["target_uri"], back.get(k, (0, 0, b""))[2] + bytes(r["chunk"]), r["is_null"])
        assert r["digest_so_far"] == hashlib.sha256(back[k][2]).hexdigest()
        if r["is_last"]:
            digest[k] = r["digest_ok"]
    assert all(digest.values()) and len(digest) == len(rows)
    assert Counter((i, u, b, n) for i, u, b, n in back.values()) == Counter((i, u, b or b"", b is None) for i, u, b in rows)
    warc.write_warc(df.limit(0), str(tmp_path / "none"), id_col="page_id", uri_col="url", payload_col="html")
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_warc_chunk_table_round_trip(spark, tmp_path):
    big = bytes(range(256)) * 3000
    rows = [(2**53 + 1, "http://x/1", big), (2**53 + 3, "http://x/2", b""), (None, None, b"ab"), (7, "http://x/3", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").coalesce(1)
    warc.write_warc(df, f"{tmp_path}/a", id_col="page_id", uri_col="url", payload_col="html")
    with pytest.raises(ValueError):
        warc.write_warc(df, f"{tmp_path}/a", id_col="page_id", uri_col="url", payload_col="html")
    chunks = warc.read_warc(spark, f"{tmp_path}/a", chunk_bytes=1000)
    warc.write_chunks(chunks.union(chunks.where("chunk_no = 1")).repartition(5), f"{tmp_path}/b")
    back = {}
    for r in warc.read_warc(spark, f"{tmp_path}/b", chunk_bytes=4096).orderBy("file", "record_no", "chunk_no").collect():
        assert r["error"] is None and r["digest_ok"] is (True if r["is_last"] else None)
        k = r["source_id"], r["target_uri"], r["is_null"]
        back[k] = back.get(k, b"") + bytes(r["chunk"])
    assert back == {(i, u, x is None): x or b"" for i, u, x in rows}
    with pytest.raises(Exception, match="lacks chunks"):
        warc.write_chunks(chunks.where("chunk_no <> 3"), f"{tmp_path}/c")
    warc.write_chunks(chunks.limit(0), f"{tmp_path}/d")
    assert warc.read_warc(spark, f"{tmp_path}/d").count() == 0
    line = b"WARC/1.0\r\nX: " + b"x" * (3 << 20) + b"\r\nContent-Length: 0\r\n\r\n"
    assert "header line" in list(warc.records(io.BytesIO(line), "l", 10, ("response",)))[-1][14]


def test_warc_in_bounded_memory_and_broken_files():
    size = 40 << 20
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % size

    class Zeros(io.RawIOBase):
        def __init__(self):
            self.left, self.head = size + 4, head

        def read(self, n=-1):
            if self.head:
                out, self.head = self.head, b""
                return out
            n = min(n, self.left)
            self.left -= n
            return b"\0" * n if self.left >= 4 else (b"\0" * n)

    import tracemalloc

    tracemalloc.start()
    n = sum(r[9] for r in warc.records(Zeros(), "z", 65536, ("response",)) if r[14] is None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == size and peak < 4 << 20
    cut = list(warc.records(io.BytesIO(head + b"abc"), "c", 10, ("response",)))
    assert "truncated" in cut[-1][14]
    assert "version" in list(warc.records(io.BytesIO(b"hello\n"), "h", 10, ("response",)))[0][14]
    assert list(warc.records(io.BytesIO(gzip.compress(head)[:-9]), "g", 10, ("response",)))[-1][14] is not None


# --- bpe -----------------------------------------------------------------------------------------

TEXTS = ["wörd, " * 300_000, "", " ", "Hello  world\n\n\tx", "日本語 🤗🤗 ́", "<|endoftext|> a", "x" * 3000, "it's we'll 123 4567 !!?", "\x00\x01 é É ß", " hi   there", " private", "naïve\r\nline"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(vocabulary_path())


def test_bpe_equals_reference_encoder(ranks):
    enc = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.ByteBPE(bpe.sentencepiece_model(ranks), sorted(ranks, key=ranks.__getitem__))
    rng = random.Random(6)
    texts = TEXTS[1:] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x1F300, 0x1F5FF), 32])) for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        ids = coder.encode(t).tolist()
        assert ids == enc.encode_ordinary(t), t
        assert coder.decode(ids) == t
    assert coder.decode([10**6]) is None


def test_bpe_columns(spark, ranks):
    path = vocabulary_path()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(90, None, 1), (1, TEXTS[1], 1), (None, "a", 1)], "doc_id long, text string, ids int")
    v = bpe.Vocabulary(spark, path)
    both = bpe.decode(bpe.encode(df, v), v).collect()
    assert len(both) == len(TEXTS) + 3 and all(r["decoded"] == r["text"] for r in both)
    rt = bpe.round_trip(df, path).collect()
    assert all(r["intact"] for r in rt) and sum(r["ids"] is None for r in rt) == 1
    assert all(r["n_tokens"] == len(r["ids"]) for r in rt if r["ids"] is not None)
    assert bpe.round_trip(df.limit(0), path).count() == 0


# --- urls ----------------------------------------------------------------------------------------


def test_url_filter(spark):
    rng = random.Random(7)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "xa.com", "d.org", "b.org"]
    urls = [(i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts).upper() if i % 7 == 0 else rng.choice(hosts)}{rng.choice(['', ':80', '.'])}{rng.choice(['', '/', '/x', '/x/y?z', '?q', '/xy#f'])}") for i in range(400)]
    urls += [(900, None), (901, ""), (902, "no url"), (903, "http://"), (5, urls[5][1])]
    rules = [(1, "com", "block"), (2, "a.com", "allow"), (3, "*.b.a.com", "block"), (4, "b.a.com/x", "allow"), (5, "b.a.com/x/y", "block"), (6, "d.org/", "block"), (8, "a.com", "block"), (9, None, "block"), (10, "", "block")]

    def key(u):
        if not u or "://" not in u or not u.split("://")[1]:
            return None
        auth, rest = u.split("://")[1], ""
        for k, ch in enumerate(auth):
            if ch in "/?#":
                auth, rest = auth[:k], auth[k:].split("#")[0]
                break
        host = auth.split("@")[-1].lower().split(":")[0].rstrip(".")
        return ".".join(reversed(host.split("."))) + "." + (rest if rest.startswith("/") else "/" + rest)

    prefix = {1: "com.", 2: "com.a.", 3: "com.a.b.", 4: "com.a.b./x", 5: "com.a.b./x/y", 6: "org.d./", 8: "com.a."}
    act = {i: a for i, _, a in rules}
    want = Counter()
    for i, u in urls:
        k = key(u)
        hit = sorted(((-len(p), r) for r, p in prefix.items() if k is not None and k.startswith(p)))
        want[i, hit[0][1] if hit else None, act[hit[0][1]] if hit else "allow", len(hit)] += 1
    u = spark.createDataFrame([(*x, "k", 1) for x in urls], "page_id long, url string, key string, part int")
    r = spark.createDataFrame(rules, "rule_id long, pattern string, action string")
    for parts in (1, 6):
        got = Counter((x["page_id"], x["rule_id"], x["action"], x["covering"]) for x in url_filter.url_filter(u, r, partitions=parts).collect())
        assert got == want
    assert {x["action"] for x in url_filter.url_filter(u, r.limit(0)).collect()} == {"allow"}
    assert url_filter.url_filter(u.limit(0), r).count() == 0


def test_url_filter_ids(spark):
    big = [2**53 + 1, 2**53 + 3]
    u = spark.createDataFrame([(big[0], "http://a.com/"), (big[1], "http://b.com/"), (None, "http://a.com/x")], "page_id long, url string")
    r = spark.createDataFrame([(None, "a.com", "drop"), (big[0], "a.com", "block"), (big[1], "a.com", "allow")], "rule_id long, pattern string, action string")
    got = {(x["page_id"], x["rule_id"], x["action"], x["covering"]) for x in url_filter.url_filter(u, r).collect()}
    assert got == {(big[0], big[0], "block", 2), (big[1], None, "allow", 0), (None, big[0], "block", 2)}


# --- chat ----------------------------------------------------------------------------------------

TALK = [{"role": "system", "content": "be kind"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "<think>hm</think>hello"}, {"role": "user", "content": ""}, {"role": "assistant", "content": "<think>x</think>yes"}]


def test_locate_each_kind_of_template():
    spans, whole = chat_format.locate(TALK, chat_format.chatml)
    assert [whole[s:e] for s, e, _, _ in spans] == [chat_format.chatml([m]) for m in TALK] and all(k == "append" and ok for *_, k, ok in spans)
    spans, whole = chat_format.locate(TALK, chat_format.closed)
    assert {k for *_, k, _ in spans[1:]} == {"moved_tail"}
    assert [whole[s:e] for s, e, _, _ in spans][2] == "[assistant] <think>hm</think>hello\n"
    spans, _ = chat_format.locate(TALK, chat_format.last_thought_only)
    assert [k for *_, k, _ in spans] == ["append", "append", "append", "append", "rewrite"]
    assert [ok for *_, ok in spans] == [True, True, False, False, True]
    spans, _ = chat_format.locate(TALK, lambda ms: chat_format.chatml(ms) if len(ms) != 2 else 1 / 0)
    assert [k for *_, k, _ in spans] == ["append", "error", "append", "append", "append"]


def test_chat_spans(spark):
    rows = [(1, 2, "user", "b", "x"), (1, 1, "user", "a", "x"), (1, 1, "user", "a", "x"), (2, 1, None, None, "x"), (None, 1, "user", "p", "x"), (None, 2, "user", "q", "x"), (3, None, "user", "y" * 100_000, "x"), (3, 5, "assistant", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, status string")
    got = sorted([(r["conv_id"] or -1, r["turn"], r["span_start"], r["rendered"]) for r in chat_format.chat_spans(df).collect()], key=str)
    one = len(chat_format.chatml([{"role": "user", "content": "a"}]))
    assert [(t, s) for c, t, s, _ in got if c == 1] == [(1, 0), (1, one), (2, 2 * one)]
    assert [s for c, _, s, _ in got if c == -1] == [0, 0]
    assert [t for c, t, s, _ in sorted(got, key=lambda x: x[2]) if c == 3] == [5, None]
    assert [x for c, *_, x in got if c == 2] == ["<|im_start|>\n<|im_end|>\n"]
    assert chat_format.chat_spans(df.limit(0)).count() == 0


def test_chat_ids_and_long_conversations(spark):
    big = 2**53
    rows = [(big, 1, "user", "a"), (big + 1, 1, "user", "b"), (None, 1, "user", "c")] + [(5, k, "user", f"turn {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.chat_spans(df).collect()}
    assert [got[k]["span_start"] for k in ((big, 1), (big + 1, 1), (None, 1))] == [0, 0, 0] and len(got) == 303
    assert all(got[5, k]["rendered"] == chat_format.chatml([{"role": "user", "content": f"turn {k}"}]) for k in range(300))


def test_embedding_plan_keeps_recall_in_a_dense_cluster():
    """100,000 vectors of mutual cosine 0.8 with pairs at 0.955 among them; a table of 10**9 vectors."""
    import numpy as np
    from tallyframe.llm import embedding_dedup

    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, dim = 100_000, 64
    m = unit(np.sqrt(0.8) * unit(rng.normal(size=(1, dim))) + np.sqrt(0.2) * unit(rng.normal(size=(n, dim)))).astype(np.float32)
    away = rng.normal(size=(1000, dim))
    away -= (away * m[:1000]).sum(axis=1, keepdims=True) * m[:1000]
    m[1000:2000] = 0.955 * m[:1000] + np.sqrt(1 - 0.955**2) * unit(away)
    passes, window = embedding_dedup.plan(m[rng.choice(n, embedding_dedup.SAMPLE, replace=False)], n, 0.95)
    met = np.zeros(1000, dtype=bool)
    for k in range(passes):
        key = np.packbits((m @ embedding_dedup._planes(k, dim, 64, 11)) > 0, axis=1).view(">u8")[:, 0]
        place = np.empty(n, dtype=int)
        place[np.argsort(key, kind="stable")] = np.arange(n)
        met |= abs(place[:1000] - place[1000:2000]) <= window
    assert met.mean() >= 0.9, (passes, window, met.mean())
    spread = unit(rng.normal(size=(embedding_dedup.SAMPLE, dim)))
    for n in (10**6, 10**7, 10**8, 10**9):
        passes, window = embedding_dedup.plan(spread, n, 0.95)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** np.log2(n / window)) ** passes >= 0.9


def test_topk_tokens_of_any_script():
    import re
    from tallyframe.llm import topk_search

    assert topk_search.tokens("Привет, мир! cœur Łódź 東京 word_2 École") == ["привет", "мир", "cœur", "łódź", "東京", "word", "2", "école"]
    latin = "".join(map(chr, range(256))).lower()
    assert topk_search.tokens(latin) == re.findall(r"[a-z0-9\u00df-\u00f6\u00f8-\u00ff]+", latin)
