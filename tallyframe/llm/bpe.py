"""Byte-level BPE with a sentencepiece model made from the vocabulary (operator 5).

The model file is serialised here, field by field: every vocabulary entry is a piece, its bytes
mapped to printable characters, scored by its negative rank; the normaliser is the identity, no
space is added, removed or escaped. Sentencepiece merges the neighbouring pair whose joined piece
scores highest, leftmost first, which is the byte-level BPE rule of the lowest rank. Nothing is trained.

Encoding: the text is split into pre-tokens by the vocabulary's pattern. Those that a worker has not
met lately are joined by a character that no piece has, so that no merge crosses a pre-token, and
encoded in one call; the separators come out as the unknown id and part the results again.
Decoding joins the bytes of the ids.

Ids are the ranks of the vocabulary file. The model is read on the driver from the path given and
broadcast (its size is that of the vocabulary, some 1 MB).

Defined cases: a null text has null ids and decodes to null; an empty one has no ids. Special tokens'
strings are ordinary text. Ids outside the vocabulary decode to nothing for the whole row (null).
Bytes that aren't UTF-8 after decoding are replaced (only ids that didn't come from a text).
Repeated rows are encoded alike. Other columns are kept, and ``out`` replaces one of its name.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import give_back

#: The pre-token pattern of the 50k vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = "\ue000"
#: Distinct pre-tokens a worker remembers before it starts afresh.
REMEMBERED = 200_000
#: Texts that a worker holds as Python objects at a time.
ROWS = 256


def byte_characters() -> list[str]:
    """A printable character for each byte, as byte-level vocabularies write them."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; ids are ranks, and one more is the unknown piece."""
    char = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = bytearray()
    for rank, token in enumerate(by_rank):
        piece = "".join(char[b] for b in token).encode()
        out += _bytes(1, _bytes(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _int(3, 1))
    out += _bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int(3, 2))
    unknown, n = len(by_rank), len(by_rank) + 1
    # trainer: model_type BPE, vocab_size, no bos, eos, pad
    out += _bytes(2, _int(3, 2) + _int(4, n) + _int(40, unknown) + _int(41, -1) + _int(42, -1) + _int(43, -1))
    # normaliser: identity, no dummy prefix, nothing removed, spaces as they are
    out += _bytes(3, _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0))
    return bytes(out)


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str = PATTERN):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens, self.unknown = tokens, len(tokens)
        self.split = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_characters())) | {0xFF: SEPARATOR}
        self.known: dict[str, bytes] = {}  # int32 ids

    def _merge(self, pieces: list[str]) -> None:
        """Encode pre-tokens not met before, all in one call, and remember their ids."""
        # byte 0xFF, which UTF-8 never has, stands for the separator until the bytes are mapped
        raw = b"\xff".join([p.encode("utf-8", "surrogatepass") for p in pieces])
        ids = self.sp.encode(raw.decode("latin-1").translate(self.table))
        at, unknown, known = 0, self.unknown, self.known
        for p in pieces[:-1]:
            end = ids.index(unknown, at)
            known[p] = np.array(ids[at:end], dtype=np.int32).tobytes()
            at = end + 1
        known[pieces[-1]] = np.array(ids[at:], dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if not text:
            return np.empty(0, dtype=np.int32)
        pieces, known = self.split(text), self.known
        if new := {p for p in pieces if p not in known}:
            if len(known) > REMEMBERED:
                known.clear()
                new = set(pieces)
            self._merge(list(new))
        return np.frombuffer(b"".join([known[p] for p in pieces]), dtype=np.int32)

    def decode(self, ids) -> str | None:
        """The text of ids; None if one is outside the vocabulary."""
        n = self.unknown
        if any(not 0 <= i < n for i in ids):
            return None
        t = self.tokens
        return b"".join([t[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _coder(model: bytes, tokens: tuple[bytes, ...], pattern: str) -> ByteBPE:
    return ByteBPE(model, list(tokens), pattern)


class Vocabulary:
    """A vocabulary on the driver, broadcast to the workers."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = PATTERN):
        ranks = read_ranks(path)
        tokens = tuple(sorted(ranks, key=ranks.__getitem__))
        self.shared = spark.sparkContext.broadcast((sentencepiece_model(ranks), tokens, pattern))


def _mapped(df: DataFrame, vocabulary: Vocabulary, source: str, out: str, kind: str, arrow: pa.DataType, each) -> DataFrame:
    """``df`` with a column ``out`` made of ``source`` by ``each(coder, value)``; a worker holds the values of
    ``ROWS`` rows as objects at a time, and hands these on before the next."""
    shared = vocabulary.shared
    rest = df.drop(out)
    kept = [F.col(f"`{c}`") for c in rest.columns]
    src = df.select(F.col(f"`{source}`").alias("__tf_source"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        coder = _coder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                made = pa.array([None if x is None else each(coder, x) for x in b.column(0).to_pylist()], arrow)
                yield pa.record_batch([made, *b.columns[1:]], names)
        give_back()

    names = ["__tf_made", *rest.columns]
    schema = T.StructType([T.StructField("__tf_made", T.DataType.fromDDL(kind)), *rest.schema.fields])
    done = src.mapInArrow(run, schema)
    order = [c for c in df.columns if c != out] + [out] if out not in df.columns else df.columns
    return done.select(*[F.col("__tf_made").alias(out) if c == out else F.col(f"`{c}`") for c in order])


def encode(df: DataFrame, vocabulary: Vocabulary, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the column ``out``: the ids of each text."""
    return _mapped(df.withColumn(text_col, F.col(f"`{text_col}`").cast("string")), vocabulary, text_col, out, "array<int>", pa.list_(pa.int32()), lambda coder, t: coder.encode(t))


def decode(df: DataFrame, vocabulary: Vocabulary, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the column ``out``: the text of each row's ids."""
    return _mapped(df, vocabulary, ids_col, out, "string", pa.string(), lambda coder, ids: coder.decode(ids))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids, intact): every text encoded, and whether decoding gives it back.

    Both are done by one worker, so that a task needs one copy of the vocabulary.
    """
    shared = Vocabulary(docs.sparkSession, path).shared
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # neither texts nor ids of a whole batch at once
                b = batch.slice(at, ROWS)
                texts = b.column("text").to_pylist()
                ids = [None if t is None else coder.encode(t) for t in texts]
                intact = [t is None or coder.decode(i.tolist()) == t for t, i in zip(texts, ids)]
                n = [None if i is None else len(i) for i in ids]
                yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(intact)], ["doc_id", "n_tokens", "ids", "intact"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens int, ids array<int>, intact boolean")
