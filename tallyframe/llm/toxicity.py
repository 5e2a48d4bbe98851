"""Toxicity by compression distance (operator 10).

Two zstandard dictionaries are trained from labelled text, one on toxic and one on ordinary
passages. A window of text is compressed with each; a window that is shorter by at least ``gain``
bytes under the toxic dictionary counts as toxic, and a document is rejected when more than
``share`` of its windows are, or more than ``local`` of some ``RUN`` successive ones, so that length
can't hide a passage. The thresholds are calibrated on labelled documents that trained neither
dictionary.

A label is of a whole document, most of whose text is ordinary even if it is toxic. So training goes in
``rounds``: at first the toxic dictionary is trained on all text of toxic documents, then on those of
their windows that it compressed better than the ordinary one did in any round, without those that went
wrong in ordinary text; the ordinary dictionary is trained on all ordinary text, and again with the
ordinary windows that went wrong in the rounds before. Of all rounds the pair of dictionaries that serves the calibration documents best is kept. Both
dictionaries are zstandard's (its COVER trainer) and no word is chosen by hand or by a count.

Windows are single words between blanks, followed by a fixed carrier that ends both dictionaries:
zstandard starts no match in the last bytes of its input and stores very small inputs as they are,
so a bare word would compress equally under either dictionary. Windows of several words were tried:
the chance differences of their ordinary words outweigh what one toxic word saves (README). Distinct
words are compressed once per worker and remembered. The dictionaries are read as content: their entropy
tables, of texts of different length, would shift all windows.

Defined cases: a null or empty text, or one without a letter, has 0 windows, share 0.0 and is not
toxic. Whole texts are scored, however long. Repeated rows are scored alike. A null label or a
label of an absent document is not used; ids may be of any type. With no labelled toxic or no ordinary
document (an empty table, too) no document is toxic. With too little text for the trainer the text
itself is the dictionary. Other columns are ignored, but one named ``out`` is replaced in what
:func:`toxicity_score` returns.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import give_back

WORD = re.compile(r"[^\W\d_]+")
CARRIER = b"#0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ#"
#: Distinct words a worker remembers before it starts afresh.
REMEMBERED = 250_000
#: Successive windows among which a passage's toxic ones are counted.
RUN = 100
#: Words of a training passage.
PASSAGE = 50


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries and thresholds; ``gain`` 0 marks a model that rejects nothing."""

    toxic: bytes
    ordinary: bytes
    level: int
    gain: int
    share: float
    local: float = float("inf")

    def compressors(self):
        """Functions bytes -> bytes for the toxic and the ordinary dictionary."""
        return _compressor(self.toxic, self.level), _compressor(self.ordinary, self.level)


def _compressor(content: bytes, level: int):
    d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    p = zstd.ZstdCompressionParameters.from_level(level, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False)
    d.precompute_compress(compression_params=p)
    return zstd.ZstdCompressor(compression_params=p, dict_data=d).compress


def words(text: str | None) -> list[str]:
    """The windows of a text: its words in lower case."""
    return WORD.findall(text.lower()) if text else []


class WindowGain:
    """Bytes that the toxic dictionary saves on a word, against the ordinary one."""

    def __init__(self, toxic, ordinary):
        self.toxic, self.ordinary, self.known = toxic, ordinary, {}

    def __call__(self, word: str) -> int:
        v = self.known.get(word)
        if v is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            b = f" {word} ".encode() + CARRIER
            v = self.known[word] = len(self.ordinary(b)) - len(self.toxic(b))
        return v


def densest(at: list[int], run: int = RUN) -> int:
    """The most of the rising positions ``at`` that ``run`` successive ones hold."""
    most = first = 0
    for last, x in enumerate(at):
        while x - at[first] >= run:
            first += 1
        most = max(most, last - first + 1)
    return most


def _passages(texts: list[list[str]], keep: set[str] | None = None) -> list[bytes]:
    """Texts, or their windows that are kept, in passages for the trainer."""
    out = []
    for ws in texts:
        ws = ws if keep is None else [w for w in ws if w in keep]
        out += [f" {' '.join(ws[i : i + PASSAGE])} ".encode() for i in range(0, len(ws), PASSAGE)]
    return out


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Trained by zstandard; where there is too little text to train on, the text itself."""
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=6).as_bytes() + CARRIER
    except (zstd.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:] + CARRIER


def _calibrated(kind: np.ndarray, size: np.ndarray, doc: np.ndarray, gains: np.ndarray) -> tuple[float, int, float, float]:
    """(F, gain, share, local) of the best thresholds: ``kind`` and ``size`` by document, ``doc`` and
    ``gains`` by window, in order. F counts a toxic document missed like two ordinary ones rejected."""
    first = np.concatenate(([0], np.cumsum(size)))
    best = (-1.0, 0, 1.0, float("-inf"))
    for g in range(2, 9):
        at = np.flatnonzero(gains >= g)
        hits = np.bincount(doc[at], minlength=len(kind))
        edge = np.concatenate(([0], np.cumsum(hits)))
        part, most = hits / size, np.zeros(len(kind), dtype=int)
        for d in np.flatnonzero(hits):
            most[d] = densest((at[edge[d] : edge[d + 1]] - first[d]).tolist())
        for share in (0.0, 0.001, 0.002, 0.003, 0.004, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05):
            # of equal F, the local threshold that lets the fewest passages through
            for local in [*range(1, 21), float("inf")]:
                said = (part > share) | (most > local)
                tp = int((said & kind).sum())
                f = 3 * tp / max(1, int(said.sum()) + 2 * int(kind.sum()))
                best = max(best, (round(f, 6), g, share, -local))
    return best[0], best[1], best[2], -best[3]


def fit(rows: list[tuple], *, level: int = 12, toxic_bytes: int = 8192, ordinary_bytes: int = 112_640, rounds: int = 6) -> ToxicityModel:
    """A model from (doc_id, text, toxic) rows: three in five train, the others calibrate."""
    nothing = ToxicityModel(b"", b"", level, 0, 1.0)
    rows = [(xxhash.xxh64_intdigest(str(i)) % 10, t, [sys.intern(w) for w in words(x)]) for i, x, t in sorted(rows, key=lambda r: (str(r[0]), r[1] or ""))]  # a word is held once
    rows = [r for r in rows if r[2]]
    texts: dict[int, list[list[str]]] = {0: [], 1: []}
    for part, t, ws in rows:
        if part < 6:
            texts[t].append(ws)
    if not texts[0] or not texts[1]:
        return nothing
    held = [r[1:] for r in rows if r[0] >= 6] or [r[1:] for r in rows]
    number: dict[str, int] = {}
    windows = np.fromiter((number.setdefault(w, len(number)) for _, ws in held for w in ws), np.int64)
    kind, size = np.array([t for t, _ in held], dtype=bool), np.array([len(ws) for _, ws in held])
    doc = np.repeat(np.arange(len(held)), size)
    seen = [sorted({w for ws in texts[k] for w in ws}) for k in (0, 1)]
    plain = _passages(texts[0])
    wrong: list[bytes] = []
    claimed: set[str] = set()
    amiss: set[str] = set()
    toxic, best = _dictionary(_passages(texts[1]), toxic_bytes, 12), (-1.0, nothing)
    for _ in range(rounds):
        model = ToxicityModel(toxic, _dictionary(plain + wrong, ordinary_bytes, 16), level, 0, 1.0)
        gain = WindowGain(*model.compressors())
        f, g, share, local = _calibrated(kind, size, doc, np.fromiter(map(gain, number), np.int16, len(number))[windows])
        if f > 0 and f >= best[0]:
            best = f, ToxicityModel(model.toxic, model.ordinary, level, g, share, local)
        claimed |= {w for w in seen[1] if gain(w) >= 2}
        bad = {w for w in seen[0] if gain(w) >= 1}
        amiss |= bad
        if not claimed - amiss:
            break
        toxic = _dictionary(_passages(texts[1], claimed - amiss), toxic_bytes, 12)
        wrong += 2 * _passages(texts[0], bad)
    return best[1]


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on at most ``max_labelled`` labelled documents, those whose id hashes lowest.

    The bound keeps the driver's share constant; every document of the corpus is then scored.
    """
    chosen = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("t")).where("i is not null and t in (0, 1)").groupBy("i").agg(F.max("t").alias("t"))
    chosen = chosen.orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("x")).where("x is not null").join(F.broadcast(chosen), "i").select("i", "x", "t").collect()
    return fit([tuple(r) for r in rows])


def toxicity_score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``: windows, toxic_windows, share, toxic. No shuffle."""
    kind = T.StructType([T.StructField("windows", T.LongType()), T.StructField("toxic_windows", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("toxic", T.BooleanType())])

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        gain = WindowGain(*model.compressors()) if model.gain else None
        for texts in batches:
            found = []
            for text in texts:
                ws = words(text)
                at = [k for k, w in enumerate(ws) if gain(w) >= model.gain] if gain else []
                share = len(at) / len(ws) if ws else 0.0
                found.append((len(ws), len(at), share, len(at) > 0 and (share > model.share or densest(at) > model.local)))
            yield pd.DataFrame(found, columns=kind.names)
        gain = texts = found = None
        give_back()

    udf = F.pandas_udf(score, kind)
    return docs.withColumn(out, udf(F.col(text_col).cast("string")))


def without_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, with their columns."""
    tag = "__tf_toxicity"
    return toxicity_score(docs, model, text_col=text_col, out=tag).where(~F.col(f"{tag}.toxic")).select(*[F.col(f"`{c}`") for c in docs.columns])
