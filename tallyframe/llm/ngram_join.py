"""N-gram Jaccard join by signature trees (operator 6).

A document is the set of its word n-grams (lower case, letters and digits only). Two documents
match when the Jaccard coefficient of their sets is at least ``threshold``.

A *signature tree* holds documents as (set size, token bitmap). A leaf is a run of neighbours in
size order; each node holds the OR of its bitmaps, its range of sizes, and the most tokens that
any member hides behind an already set bit. Two trees are traversed together from the roots: a pair
of nodes whose shared bits plus hidden tokens, the maximum possible overlap, cannot reach what the
threshold asks of their smallest sizes, or whose size ranges are too far apart, is dropped with
everything below it. The test never drops a true pair.

One tree over the corpus would still compare all leaves with each other, so the first level of the
tree is a partition of the documents by tokens. It loses no pair: a document of n tokens stands below
its first n - ceil(t n) + 1 tokens in one order of all tokens, and two sets that match have one of
them in common, whichever the order is. Tokens are ordered by the number of sets that hold them (255
stands for more), then by hash, so that a document stands below its rarest tokens. A token of one set
joins nothing and is only counted. There is no cap on the members of a token, on candidates or on partners.

Stages:
1. one pass over the texts, in chunks of documents: set size, exact fingerprint of the set, and the
   tokens by ranges of their hashes (32 bits below the range; two tokens that share them are one token
   here, which adds candidates and never takes one away);
2. equal sets are one representative from here on;
3. a range counts the sets of its tokens, a chunk picks each document's first tokens, and a range again
   makes the pairs below each. Of a pair it knows the sizes and the places of the token in both orders,
   which bound the overlap; summed over the ranges, the tokens that both stand below bound it once more
   (what isn't shared among the first tokens can be shared only behind the first ones of one side);
   Candidates serve to connect: pairs inside what a few pairs of each token already connect aren't made, so a
   large group of near copies gives a number of candidates in proportion to it;
4. connected candidates are brought together with their texts, and verified exactly on their token
   sets, small components by dual traversal, large ones by products of matrices, whose matches are summed by
   member where they are found.

All bounds are exact: no pair that meets the threshold is left out, but for equal 64-bit hashes.

The result has each document that has a match: its group (the smallest id among those connected
by matches), its best partner with the coefficient, and the number of its links: the documents that it
matches, copies counted one by one though never expanded into pairs (an id with several texts has the links
of each). ``all_pairs`` gives every pair of matching representatives instead (and copies with their
representative); ``links=False`` verifies only what the groups need, and gives some verified partner.

Defined cases: a null or empty text, or one without letters or digits, has an empty set and matches
nothing. A text of fewer than n words is one gram. Rows with a null id match nothing. Rows with the
same id are one document for grouping, each of their texts is compared. Ties go to the smaller id. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import delete, give_back, small_batches, written
from tallyframe.llm.components import Forest, components

TOKEN = re.compile(r"[^\W_]+")
LEAF, FANOUT = 32, 4
#: Node pairs that a traversal takes down at a time.
BLOCK = 1 << 16
#: Documents of a chunk at most (a power of two), and tokens from which it is full.
CHUNK_DOCS, CHUNK_TOKENS = 512, 300_000
CHUNK_COLUMNS = ["range", "chunk", "docs", "lens", "keys"]
#: The share of a set's tokens that it stands below besides those that the join needs.
EXTRA = 0.05
#: A token of more documents than this first gives pairs with its smallest ones only, and how many these are.
HEAVY, PIVOTS = 32, 4
#: Documents whose groups are known to the tasks that make pairs, at most (those of the largest groups).
KNOWN = 1_000_000
#: Characters of text for each range of tokens, and ranges at most.
RANGE_CHARS, MOST_RANGES = 24_000_000, 2_048
#: Sets of a component that are verified by products of matrices, at least, and sets of a block.
PRODUCT, SETS = 64, 256
#: Pairs that a task holds before it sums them.
PAIRS = 1 << 20
#: Candidate ids (16 bytes each) that are broadcast at most; beyond, the join is a sort-merge join.
BROADCAST_ROWS = 1_000_000
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


class GramHasher:
    """Sorted distinct 64-bit hashes of a text's n-grams; word hashes are remembered."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def _word(self, w: str) -> int:
        h = self.known.get(w)
        if h is None:
            if len(self.known) > 100_000:
                self.known.clear()
            h = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        ws = TOKEN.findall(text.lower()) if text else []
        if not ws:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        try:
            h = np.array([known[w] for w in ws], dtype=np.uint64)
        except KeyError:
            h = np.array([self._word(w) for w in ws], dtype=np.uint64)
        m = max(1, len(h) - self.n + 1)
        g = np.zeros(m, dtype=np.uint64)
        for k in range(min(self.n, len(h))):
            g = (g ^ h[k : k + m]) * _M[0]
            g ^= g >> np.uint64(29)
        g *= _M[2]
        g ^= g >> np.uint64(32)
        g.sort()
        return g[np.concatenate(([True], g[1:] != g[:-1]))]


def bitmap_bits(n: int) -> int:
    """Bits of the bitmap of n tokens: a power of two, 2n at least."""
    return max(64, 1 << (2 * n - 1).bit_length())


#: Bits of a sketch's bitmap.
SKETCH_BITS = 2048


def bitmap(grams: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The token bitmap as 64-bit words."""
    bits = bits or bitmap_bits(len(grams))
    at = (grams >> np.uint64(20)) & np.uint64(bits - 1)
    out = np.zeros(bits // 64, dtype=np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps cut down to ``words``: bit i and bit i + bits/2 become one."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


class SignatureTree:
    """Documents of one bitmap length, in order of size; see the module's text."""

    def __init__(self, at: np.ndarray, size: np.ndarray, bits: np.ndarray, most: int | None = None):
        order = np.lexsort((bits[:, 0], size))
        self.at, self.size, self.bits, self.most = at[order], size[order].astype(np.int64), bits[order], most
        held = self.size if most is None else np.minimum(self.size, most)
        self.hidden = held - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        n = len(self.at)
        starts = np.arange(0, n, LEAF)
        level = (np.bitwise_or.reduceat(self.bits, starts), np.minimum.reduceat(self.size, starts), np.maximum.reduceat(self.size, starts), np.maximum.reduceat(self.hidden, starts))
        self.levels = [level]
        while len(level[1]) > 1:
            s = np.arange(0, len(level[1]), FANOUT)
            level = (np.bitwise_or.reduceat(level[0], s), np.minimum.reduceat(level[1], s), np.maximum.reduceat(level[2], s), np.maximum.reduceat(level[3], s))
            self.levels.append(level)

    def folded(self, words: int) -> SignatureTree:
        """The same documents with shorter bitmaps."""
        return self if self.bits.shape[1] == words else SignatureTree(self.at, self.size, _fold(self.bits, words), self.most)


def _least(k: int, t: float, miss: float) -> int:
    """The largest m that a binomial of k draws at t falls below with a probability of ``miss`` at most."""
    below, m = 0.0, 0
    while m < k and (below := below + comb(k, m) * t**m * (1 - t) ** (k - m)) <= miss:
        m += 1
    return m


class Need:
    """The overlap that a pair of sizes must have; for ranges, the least that any pair inside must.

    ``sketch`` None: exact, t / (1 + t) of the sizes' sum. Otherwise bitmaps hold that many tokens at
    most; see the module's text.
    """

    def __init__(self, t: float, sketch: int | None = None, miss: float = 1e-4):
        self.t, self.sketch = t, sketch
        self.least = np.array([_least(k, t, miss) for k in range((sketch or 0) + 1)])

    def __call__(self, low_a, high_a, low_b, high_b) -> np.ndarray:
        exact = self.t / (1 + self.t) * (low_a + low_b)
        if self.sketch is None:
            return exact
        part = self.least[np.minimum(self.sketch, np.minimum(low_a, low_b)).astype(np.int64)]
        return np.where(np.maximum(high_a, high_b) <= self.sketch, exact, part)


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, need: Need) -> np.ndarray:
    """Whether node pairs (i of x, j of y) may hold a matching pair."""
    t = need.t
    ok = (x[1][i] * t <= y[2][j] + 1e-9) & (y[1][j] * t <= x[2][i] + 1e-9)
    k = np.flatnonzero(ok)
    if len(k):
        a, b = i[k], j[k]
        least = need(x[1][a], x[2][a], y[1][b], y[2][b])
        most = np.empty(len(k), dtype=np.int64)
        for c in range(0, len(k), 4096):
            most[c : c + 4096] = np.bitwise_count(x[0][a[c : c + 4096]] & y[0][b[c : c + 4096]]).sum(axis=1)
        ok[k] = most + np.minimum(x[3][a], y[3][b]) >= least - 1e-9
    return ok


def traverse(x: SignatureTree, y: SignatureTree, need: Need, visit: Callable[[int, int], None], connected: Callable[[np.ndarray, np.ndarray], bool]) -> None:
    """Dual traversal; ``visit`` gets each pair of documents that may match, ``connected`` can skip
    two leaves. x is y for a self-join."""
    same = x is y
    # depth first by blocks, so that the node pairs held are some levels times FANOUT**2 times BLOCK at most
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        up_x, up_y, i, j = stack.pop()
        if len(i) > BLOCK:
            stack += [(up_x, up_y, i[c : c + BLOCK], j[c : c + BLOCK]) for c in range(0, len(i), BLOCK)][::-1]
            continue
        keep = _possible(x.levels[up_x], y.levels[up_y], i, j, need)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not up_x and not up_y:
            _leaves(x, y, i, j, need, visit, connected)
            continue
        # the deeper side goes down alone until both are level
        if up_x >= up_y:
            up_x -= 1
            i, j = np.repeat(i * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(i)), np.repeat(j, FANOUT)
            ok = i < len(x.levels[up_x][1])
            i, j = i[ok], j[ok]
        if up_y > up_x:
            up_y -= 1
            i, j = np.repeat(i, FANOUT), np.repeat(j * FANOUT, FANOUT) + np.tile(np.arange(FANOUT), len(j))
            ok = j < len(y.levels[up_y][1])
            i, j = i[ok], j[ok]
        if same:
            ok = i <= j
            i, j = i[ok], j[ok]
        stack.append((up_x, up_y, i, j))


def _leaves(x: SignatureTree, y: SignatureTree, i: np.ndarray, j: np.ndarray, need: Need, visit: Callable[[int, int], None], connected: Callable[[np.ndarray, np.ndarray], bool]) -> None:
    """The documents of each pair of leaves with each other."""
    for a, b in zip(i.tolist(), j.tolist()):
        pa, pb = slice(a * LEAF, a * LEAF + LEAF), slice(b * LEAF, b * LEAF + LEAF)
        if connected(x.at[pa], y.at[pb]):
            continue
        sx, sy = x.size[pa], y.size[pb]
        both = np.bitwise_count(x.bits[pa][:, None, :] & y.bits[pb][None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(x.hidden[pa][:, None], y.hidden[pb][None, :])
        small, large = np.minimum(sx[:, None], sy[None, :]), np.maximum(sx[:, None], sy[None, :])
        ok = (both >= need(small, small, large, large) - 1e-9) & (small >= need.t * large - 1e-9)
        if x is y and a == b:
            ok = np.triu(ok, 1)
        for p, q in zip(*np.nonzero(ok)):
            visit(int(x.at[a * LEAF + p]), int(y.at[b * LEAF + q]))


def self_join(size: np.ndarray, bits: list[np.ndarray], need: Need, visit: Callable[[int, int], None], connected: Callable[[np.ndarray, np.ndarray], bool]) -> None:
    """Dual traversal of all documents with each other: a tree for each bitmap length, each tree
    with itself and with the next ones that sizes allow."""
    words = np.array([len(b) for b in bits])
    trees = []
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        trees.append((int(w), SignatureTree(at, size[at], np.stack([bits[k] for k in at]), need.sketch)))
    for k, (w, tree) in enumerate(trees):
        traverse(tree, tree, need, visit, connected)
        for _, other in trees[k + 1 :]:
            if other.size.min() * need.t <= tree.size.max():
                traverse(tree, other.folded(w), need, visit, connected)


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each key's rows, of a partition sorted by key, whatever the batches."""
    rest: list[dict[str, np.ndarray]] = []
    whole = lambda: rest[0] if len(rest) == 1 else {c: np.concatenate([r[c] for r in rest]) for c in rest[0]}
    for b in batches:
        if not len(b):
            continue
        cols = {c: b[c].to_numpy() for c in b.columns}
        k = cols[key]
        edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for s, e in zip(edges, edges[1:]):
            if rest and rest[0][key][0] != k[s]:
                yield whole()
                rest = []
            rest.append({c: v[s:e] for c, v in cols.items()})
    if rest:
        yield whole()


def _quick(sx: int, sy: int, bx: np.ndarray, by: np.ndarray, need: Need) -> bool:
    """The leaf test for two sketches."""
    small, large = min(sx, sy), max(sx, sy)
    if small < need.t * large - 1e-9:
        return False
    hidden = min(min(s, need.sketch) - int(np.bitwise_count(b).sum()) for s, b in ((sx, bx), (sy, by)))
    return int(np.bitwise_count(bx & by).sum()) + hidden >= float(need(small, small, large, large)) - 1e-9


def _reach(n: np.ndarray, t: float) -> np.ndarray:
    """How many of its first tokens a set of n stands below: n - ceil(t n) + 1 lose no pair, the
    ``EXTRA`` ones make the bound by their number sharper."""
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + 1 + (EXTRA * n).astype(np.int64))


def _spread(n: int, ranges: int):
    """Chunks of documents: a row with range -1 for their ids, fingerprints and sizes, and one for the tokens of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        first, made, grams = TaskContext.get().partitionId() << 32, 0, GramHasher(n)
        held: list[tuple[int, np.ndarray]] = []

        def chunk() -> pa.RecordBatch:
            docs, g = len(held), np.concatenate([x for _, x in held])
            size = np.array([len(x) for _, x in held])
            prints = np.array([_fingerprint(x) for _, x in held], dtype=np.int64)
            r = (((g >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            lens = np.bincount(r * docs + np.repeat(np.arange(docs), size), minlength=ranges * docs).reshape(ranges, docs)
            # by range, then document, then hash
            keys = np.split(g[np.argsort(r, kind="stable")].astype(np.uint32), np.cumsum(lens.sum(axis=1))[:-1])
            meta = np.concatenate(([i for i, _ in held], prints[:, 0], prints[:, 1], size)).astype(np.int64)
            rows = [(-1, b"", meta.tobytes()), *((k, _packed(x), y.tobytes()) for k, (x, y) in enumerate(zip(lens, keys)) if len(y))]
            k, lens, keys = zip(*rows)
            full = lambda x, kind: pa.array(np.full(len(k), x), kind)
            return pa.record_batch([pa.array(k, pa.int32()), full(first + made, pa.int64()), full(docs, pa.int32()), pa.array(lens, pa.binary()), pa.array(keys, pa.binary())], CHUNK_COLUMNS)

        tokens = 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text")):  # one text as an object at a time
                if len(g := grams(text.as_py())):
                    held.append((i, g))
                    tokens += len(g)
                if tokens >= CHUNK_TOKENS or len(held) == CHUNK_DOCS:
                    yield chunk()
                    made, tokens, held = made + 1, 0, []
        if held:
            yield chunk()
        held, grams = [], None
        give_back()

    return run


def _packed(lens: np.ndarray) -> bytes:
    """Numbers of tokens, in a byte each if they fit, in four otherwise."""
    return lens.astype(np.uint8 if lens.max(initial=0) < 256 else np.uint32).tobytes()


def _lens(raw: bytes, docs: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8 if len(raw) == docs else np.uint32).astype(np.int64)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document of the chunks."""
    for b in batches:
        for c, docs, raw in zip(b["chunk"].tolist(), b["docs"].tolist(), b["keys"]):
            ids, h1, h2, size = np.frombuffer(raw, dtype=np.int64).reshape(4, docs)
            yield pd.DataFrame({"node": (c * CHUNK_DOCS) + np.arange(docs), "id": ids, "h1": h1, "h2": h2, "n": size})


def _living(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks' tokens without those of documents that are none of ``alive``."""
    for b in batches:
        rows = []
        for docs, alive, lens, keys in zip(b["docs"].tolist(), b["alive"], b["lens"], b["keys"]):
            stays = np.zeros(docs, dtype=bool)
            stays[np.asarray(alive)] = True
            if not stays.all():
                lens = _lens(lens, docs)
                keys, lens = np.frombuffer(keys, dtype=np.uint32)[np.repeat(stays, lens)].tobytes(), _packed(lens * stays)
            rows.append((lens, keys))
        yield b[["range", "chunk", "docs"]].assign(lens=[x for x, _ in rows], keys=[x for _, x in rows])
    give_back()


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tokens that several sets have, with their number (255 at most)."""
    for g in _grouped(batches, "range"):
        parts = [np.frombuffer(x, dtype=np.uint32) for x in g["keys"]]
        _, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        df = np.minimum(count, 255).astype(np.uint8)[at]
        rows, start = [], 0
        for c, docs, lens, keys in zip(g["chunk"].tolist(), g["docs"].tolist(), g["lens"], parts):
            d = df[start : start + len(keys)]
            start += len(keys)
            several = d > 1
            if several.any():
                doc = np.repeat(np.arange(docs), _lens(lens, docs))[several]
                rows.append((g["range"][0], c, docs, _packed(np.bincount(doc, minlength=docs)), keys[several].tobytes(), d[several].tobytes()))
        yield pd.DataFrame(rows, columns=[*CHUNK_COLUMNS, "df"])
    give_back()


def _first_tokens(t: float):
    """Each document's first tokens that another set has, by ranges again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _grouped(batches, "chunk"):
            if len(g["range"]) == 1:
                continue
            docs, c = int(g["docs"][0]), int(g["chunk"][0])
            size = np.frombuffer(g["keys"][0], dtype=np.int64).reshape(4, docs)[3]
            doc = np.concatenate([np.repeat(np.arange(docs), _lens(x, docs)) for x in g["lens"][1:]])
            keys = [np.frombuffer(x, dtype=np.uint32) for x in g["keys"][1:]]
            token = np.repeat(g["range"][1:].astype(np.int64), [len(k) for k in keys]) << 32 | np.concatenate(keys).astype(np.int64)
            df = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in g["df"][1:]])
            order = np.lexsort((token, df, doc))
            doc, token = doc[order], token[order]
            several = np.bincount(doc, minlength=docs)
            # the tokens of one set come first in the order
            pos = (size - several)[doc] + np.arange(len(doc)) - (np.cumsum(several) - several)[doc]
            keep = pos < _reach(size, t)[doc]
            doc, token, pos = doc[keep], token[keep], pos[keep]
            order = np.argsort(token >> 32, kind="stable")
            doc, token, pos = doc[order], token[order], pos[order]
            part = token >> 32
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            yield pd.DataFrame(
                [(int(part[s]), token[s:e].astype(np.uint32).tobytes(), (c * CHUNK_DOCS + doc[s:e]).tobytes(), size[doc[s:e]].astype(np.int32).tobytes(), pos[s:e].astype(np.int32).tobytes()) for s, e in zip(edges, edges[1:])],
                columns=["range", "keys", "nodes", "sizes", "places"],
            )
        give_back()

    return run


def _paired(t: float, known=None):
    """The pairs below each token of a range: how many tokens they are both below, and how many they need.

    Without ``known``, of a token with more than ``HEAVY`` documents only the pairs of each with the ``PIVOTS``
    smallest, of other tokens none. ``known`` (a broadcast: sorted nodes, their groups' roots) are the groups that
    those pairs connect: pairs of one group would connect nothing more and are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _grouped(batches, "range"):
            key, node, size, pos = (np.concatenate([np.frombuffer(x, dtype=d) for x in g[c]]) for c, d in (("keys", np.uint32), ("nodes", np.int64), ("sizes", np.int32), ("places", np.int32)))
            if known is None:
                order = np.lexsort((node, key))
                group = node[order]
            else:
                group = node.copy()
                if len(known.value[0]):
                    near = np.minimum(np.searchsorted(known.value[0], node), len(known.value[0]) - 1)
                    group = np.where(known.value[0][near] == node, known.value[1][near], node)
                order = np.lexsort((node, group, key))
                group = group[order]
            key, pos, size = key[order], pos[order].astype(np.int64), size[order].astype(np.int64)
            first, end = np.searchsorted(key, key, "left"), np.searchsorted(key, key, "right")
            if known is None:
                # each of a token's first rows with all that follow it
                rows = np.flatnonzero((end - first > HEAVY) & (np.arange(len(key)) - first < PIVOTS))
                start = rows + 1
            else:
                # each row with those behind its group's
                rows = np.arange(len(key))
                last = np.flatnonzero(np.concatenate(((key[1:] != key[:-1]) | (group[1:] != group[:-1]), [True])))
                start = last[np.searchsorted(last, rows)] + 1
            if not len(rows):
                continue
            names, node = np.unique(node[order], return_inverse=True)
            of = np.zeros(len(names), dtype=np.int64)
            of[node] = size
            pairs, shared, fresh, more = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), [], 0
            for i, j in _crossed(rows, start, end[rows]):
                if len(i):
                    x, y = size[i], size[j]
                    most = np.minimum(pos[i], pos[j]) + np.minimum(x - pos[i], y - pos[j])
                    ok = (node[i] != node[j]) & (np.minimum(x, y) >= t * np.maximum(x, y) - 1e-9) & (most >= t / (1 + t) * (x + y) - 1e-9)
                    a, b = node[i[ok]], node[j[ok]]
                    fresh.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
                    more += len(a)
                    if more > PAIRS:
                        pairs, shared = _summed(pairs, shared, fresh)
                        fresh, more = [], 0
            pairs, shared = _summed(pairs, shared, fresh)
            for s in range(0, len(pairs), PAIRS // 4):
                u, v = pairs[s : s + PAIRS // 4] // len(names), pairs[s : s + PAIRS // 4] % len(names)
                behind = np.maximum(of[u] - _reach(of[u], t), of[v] - _reach(of[v], t))
                need = np.ceil(t / (1 + t) * (of[u] + of[v]) - 1e-9).astype(np.int64) - behind
                yield pd.DataFrame({"u": names[u], "v": names[v], "shared": shared[s : s + PAIRS // 4], "need": need})
        give_back()

    return run


def _crossed(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with all from its start to before its end, ``BLOCK`` pairs at a time."""
    count = end - start
    total = np.concatenate(([0], np.cumsum(count)))
    for s in range(0, int(total[-1]), BLOCK):
        at = np.arange(s, min(s + BLOCK, int(total[-1])))
        r = np.searchsorted(total, at, "right") - 1
        yield rows[r], start[r] + at - total[r]


def _summed(pairs: np.ndarray, shared: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of both, with how often they occurred."""
    new, count = np.unique(np.concatenate([*fresh, np.empty(0, dtype=np.int64)]), return_counts=True)
    both, at = np.unique(np.concatenate((pairs, new)), return_inverse=True)
    return both, np.bincount(at, weights=np.concatenate((shared, count)), minlength=len(both)).astype(np.int64)


def _matched(sets: list[np.ndarray], t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of sets that match, with their coefficients: the overlaps of two blocks of sets, in order of size,
    are one product of matrices over the tokens that both blocks hold; exact, as counts below 2^24 are in single precision."""
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    blocks = []
    for s in range(0, len(order), SETS):
        at = order[s : s + SETS]
        tokens, cols = np.unique(np.concatenate([sets[k] for k in at]), return_inverse=True)
        blocks.append((at, sizes[at], tokens, np.repeat(np.arange(len(at)), sizes[at]), cols))
    for k, (a, size_a, tokens_a, row_a, col_a) in enumerate(blocks):
        for b, size_b, tokens_b, row_b, col_b in blocks[k:]:
            if size_b[0] * t > size_a[-1] + 1e-9:
                break
            _, here, there = np.intersect1d(tokens_a, tokens_b, assume_unique=True, return_indices=True)
            over = np.zeros((len(a), len(b)))
            for c in range(0, len(here), 8192):
                part = []
                for at, row, col, n, m in ((here, row_a, col_a, len(tokens_a), len(a)), (there, row_b, col_b, len(tokens_b), len(b))):
                    place = np.full(n, -1)
                    place[at[c : c + 8192]] = np.arange(len(at[c : c + 8192]))
                    to = place[col]
                    dense = np.zeros((m, len(at[c : c + 8192])), dtype=np.float32)
                    dense[row[to >= 0], to[to >= 0]] = 1
                    part.append(dense)
                over += part[0] @ part[1].T
            j = over / (size_a[:, None] + size_b[None, :] - over)
            ok = j >= t
            if a is b:
                ok = np.triu(ok, 1)
            p, q = np.nonzero(ok)
            if len(p):
                yield a[p], b[q], j[p, q]


class _Members:
    """Of a component's matches what the links need: a forest of them, each set's number of matching documents and
    its best partner. Pairs come in arrays and aren't kept."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies, n = ids, copies, len(ids)
        self.label, self.edges = np.arange(n), []
        self.links, self.best, self.partner = np.zeros(n, dtype=np.int64), np.full(n, -1.0), np.full(n, -1)

    def add(self, a: np.ndarray, b: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, a, self.copies[b])
        np.add.at(self.links, b, self.copies[a])
        me, other, w = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((j, j))
        ok = self.ids[me] != self.ids[other]
        me, other, w = me[ok], other[ok], w[ok]
        order = np.lexsort((self.ids[other], -w, me))
        me, other, w = me[order], other[order], w[order]
        first = np.flatnonzero(np.concatenate(([True], me[1:] != me[:-1]))) if len(me) else np.empty(0, dtype=np.int64)
        me, other, w = me[first], other[first], w[first]
        better = (w > self.best[me]) | ((w == self.best[me]) & (self.ids[other] < self.ids[self.partner[me]]))
        self.best[me[better]], self.partner[me[better]] = w[better], other[better]
        while len(apart := np.flatnonzero(self.label[a] != self.label[b])):
            a, b = a[apart], b[apart]
            x, y = sorted((self.label[a[0]], self.label[b[0]]))
            self.edges.append((a[0], b[0]))
            self.label[self.label == y] = x

    def rows(self, nodes: np.ndarray) -> pd.DataFrame:
        """Forest edges (kind 0) and members (kind 1)."""
        some = np.flatnonzero(self.links)
        partner = pd.array(self.ids[self.partner[some]], dtype="Int64")
        partner[self.partner[some] < 0] = pd.NA
        members = pd.DataFrame({"kind": 1, "u": self.ids[some], "v": partner, "jaccard": self.best[some], "h1": nodes[some], "links": self.links[some]})
        e = np.array(self.edges, dtype=np.int64).reshape(-1, 2)
        u, v = self.ids[e[:, 0]], self.ids[e[:, 1]]
        forest = pd.DataFrame({"kind": 0, "u": np.minimum(u, v), "v": pd.array(np.maximum(u, v), dtype="Int64"), "jaccard": 0.0, "h1": 0, "links": 0})
        return pd.concat((forest, members))


PAIR_ROWS = "u long, v long, jaccard double"
MEMBER_ROWS = "kind int, u long, v long, jaccard double, h1 long, links long"


def _verified(t: float, n: int, what: str):
    """Matches of each candidate component, by exact coefficients: all ``pairs``, some that connect the ``groups``, or
    the ``links`` of its members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = GramHasher(n)
        for g in _grouped(batches, "root"):
            made = [(i, node, grams(x), c) for i, node, x, c in zip(g["id"].tolist(), g["node"].tolist(), g["text"], g["copies"].tolist())]
            # of an id with several texts, the one that is the node; of equal sets, one
            made = {node: (i, x, c) for i, node, x, c in made if len(x) and _fingerprint(x)[0] == node}
            nodes, (ids, sets, copies) = np.array(list(made), dtype=np.int64), zip(*made.values())
            p, q, w = [], [], []
            ready: list[pd.DataFrame] = []
            f, ids, copies = Forest(), np.array(ids, dtype=np.int64), np.array(copies, dtype=np.int64)
            members = _Members(ids, copies)

            def keep() -> None:
                a, b = np.array(p, dtype=np.int64), np.array(q, dtype=np.int64)
                if what == "links":
                    members.add(a, b, np.array(w, dtype=float))
                else:
                    ready.append(pd.DataFrame({"u": np.minimum(ids[a], ids[b]), "v": np.maximum(ids[a], ids[b]), "jaccard": w}))
                p.clear(), q.clear(), w.clear()

            def visit(a: int, b: int) -> None:
                if what == "groups" and f.find(a) == f.find(b):
                    return
                x, y = sets[a], sets[b]
                both = np.concatenate((x, y))
                both.sort()
                over = int((both[1:] == both[:-1]).sum())
                j = over / (len(x) + len(y) - over)
                if j >= t:
                    if what == "groups":
                        f.union(a, b)
                    p.append(a)
                    q.append(b)
                    w.append(j)
                    if len(w) == PAIRS // 4:
                        keep()

            def connected(a: np.ndarray, b: np.ndarray) -> bool:
                first = f.find(int(a[0]))
                return what == "groups" and all(f.find(int(x)) == first for x in a) and all(f.find(int(x)) == first for x in b)

            if len(ids) == 2:
                visit(0, 1)
            elif what != "groups" and len(ids) >= PRODUCT:
                for a, b, j in _matched(list(sets), t):
                    if what == "links":
                        members.add(a, b, j)
                    else:
                        yield pd.DataFrame({"u": np.minimum(ids[a], ids[b]), "v": np.maximum(ids[a], ids[b]), "jaccard": j})
            elif len(ids) > 2:
                self_join(np.array([len(x) for x in sets]), [bitmap(x) for x in sets], Need(t), visit, connected)
            if w:
                keep()
            yield from ready
            if what == "links":
                yield members.rows(nodes)
        give_back()

    return run


def _fingerprint(g: np.ndarray) -> tuple[int, int]:
    """Two sums of hashes, of 64 bits each; the first names the set."""
    return int(g.sum().view(np.int64)), int(((g * _M[1]) ^ (g >> np.uint64(31))).sum().view(np.int64))


def ngram_jaccard_join(docs: DataFrame, *, threshold: float = 0.6, n: int = 3, all_pairs: bool = False, links: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, group_id, partner_id, jaccard, links), or (left_id, right_id, jaccard) for all pairs."""
    spark = docs.sparkSession
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    # a range's tokens are held by one task: their number follows the texts, whatever the setting
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS)))
    blob = "range int, chunk long, docs int, lens binary, keys binary"
    with small_batches(spark):
        spread = written(texts.mapInArrow(_spread(n, ranges), blob), "tokens")
    meta = spread.where("range = -1")
    made = written(meta.select("chunk", "docs", "keys").mapInPandas(_members, "node long, id long, h1 long, h2 long, n int").groupBy("h1", "h2", "n", "id").agg(F.min("node").alias("node")), "documents")
    # (h1, h2, n) is a fingerprint of the set; a set goes under the smallest id that has it
    sets = written(made.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "node")).alias("m"), F.count("*").alias("copies")).select("h1", "h2", "n", F.col("m.id").alias("id"), F.col("m.node").alias("node"), "copies"), "sets")
    tied = made.join(sets.where("copies > 1").select("h1", "h2", "n", F.col("id").alias("rep")), ["h1", "h2", "n"])
    same = written(tied.where("id <> rep").select("rep", "id").distinct(), "ties")
    alive = written(sets.groupBy(F.shiftright("node", CHUNK_DOCS.bit_length() - 1).alias("chunk")).agg(F.collect_list((F.col("node") % CHUNK_DOCS).cast("int")).alias("alive")), "representatives")
    living = spread.where("range >= 0").join(few(alive), "chunk").mapInPandas(_living, blob)
    counted = living.repartition("range").sortWithinPartitions("range", "chunk").mapInPandas(_counted, blob + ", df binary")
    packed = "range int, keys binary, nodes binary, sizes binary, places binary"
    with small_batches(spark):
        first = written(counted.unionByName(meta.withColumn("df", F.lit(b""))).repartition("chunk").sortWithinPartitions("chunk", "range").mapInPandas(_first_tokens(threshold), packed), "first-tokens")
    by_range = first.repartition("range").sortWithinPartitions("range")

    def candidates(known, name: str) -> DataFrame:
        pairs = by_range.mapInPandas(_paired(threshold, known), "u long, v long, shared long, need long")
        with small_batches(spark):
            return written(pairs.groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("u", "v"), name)

    # what large groups of near copies connect is known from few of their pairs, the others aren't made
    stars = candidates(None, "stars-of-tokens")
    grouped = components(stars)
    most = grouped.join(grouped.groupBy("root").count(), "root").orderBy(F.desc("count"), "root").limit(KNOWN).select("node", "root").toPandas()
    most = most.sort_values("node")
    known = spark.sparkContext.broadcast((most["node"].to_numpy(dtype=np.int64), most["root"].to_numpy(dtype=np.int64)))
    edges = candidates(known, "candidates").union(stars)
    known.destroy()
    delete(first)
    delete(spread)
    comps = written(components(edges).join(sets.select("node", "id", "h1", "copies"), "node").select("root", F.col("h1").alias("node"), "id", "copies"), "components")
    # where the candidates' ids are few enough to be broadcast, only candidates' texts are shuffled
    together = texts.join(few(comps), "id").select("root", "node", "id", "text", "copies").repartition("root").sortWithinPartitions("root", "id", "text")
    what = "pairs" if all_pairs else "links" if links else "groups"
    with small_batches(spark):
        found = written(together.mapInPandas(_verified(threshold, n, what), MEMBER_ROWS if what == "links" else PAIR_ROWS), "matches")
    copies = same.select(F.col("rep").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("jaccard"))
    if all_pairs:
        return found.where("u <> v").union(copies).select(F.col("u").alias("left_id"), F.col("v").alias("right_id"), "jaccard")
    joined = (found.where("kind = 0") if links else found).where("u <> v").select("u", "v")
    groups = components(joined.union(copies.select("u", "v")))
    # a member's row has its best partner; pairs and copies stand for both ends
    both = copies if links else found.where("u <> v").union(copies)
    ends = both.select("u", "v", "jaccard").union(both.select("v", "u", "jaccard"))
    if links:
        ends = ends.union(found.where("kind = 1 and v is not null").select("u", "v", "jaccard"))
    best = ends.select(F.col("u").alias("node"), F.struct("jaccard", (-F.col("v")).alias("other")).alias("p")).groupBy("node").agg(F.max("p").alias("p"))
    out = groups.join(best, "node").select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (-F.col("p.other")).alias("partner_id"), F.col("p.jaccard").alias("jaccard"))
    if not links:
        return out
    # a set's links are the copies of the sets that it matches, and those of its own but one
    others = found.where("kind = 1").select("h1", "links").union(sets.where("copies > 1").select("h1", F.col("copies") - 1)).groupBy("h1").agg(F.sum("links").alias("links"))
    counts = made.select("id", "h1").join(others, "h1").groupBy(F.col("id").alias("doc_id")).agg(F.sum("links").alias("links"))
    return out.join(counts, "doc_id")


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without all but the smallest id of each group; their columns are kept.

    Of rows that repeat an id the one with the first text stays. Rows with a null id all stay.
    """
    groups = ngram_jaccard_join(docs, id_col=id_col, text_col=text_col, links=False, **how)
    gone = written(groups.where("doc_id <> group_id").select(F.col("doc_id").alias("__tf_gone")), "removed")
    i = F.col(f"`{id_col}`").cast("long")
    kept = docs.join(gone, i == F.col("__tf_gone"), "left_anti")
    twice = written(docs.select(i.alias("__tf_twice")).where("__tf_twice is not null").groupBy("__tf_twice").count().where("count > 1").select("__tf_twice"), "repeated")
    if twice.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = kept.join(twice, i == F.col("__tf_twice"), "left_semi").select(i.alias("__tf_id"), F.col(f"`{text_col}`").alias("__tf_text"), row.alias("__tf_row"))
    first = again.withColumn("__tf_k", F.row_number().over(Window.partitionBy("__tf_id").orderBy("__tf_text"))).where("__tf_k = 1").select("__tf_row.*")
    return kept.join(twice, i == F.col("__tf_twice"), "left_anti").unionByName(first)
