"""WARC files as a chunked record table (operator 3).

Reading: a task opens its file through pyarrow's file systems, reads record headers line by line,
and hands each payload on in pieces of ``chunk_bytes``: rows (record id, chunk number, offset, bytes,
digest so far). A payload is never held whole, so a record may be larger than memory. The digest is
incremental: each row carries the SHA-256 of the payload up to and including its chunk, and the last
row says whether the SHA-1 that the record declares is right.

Writing: :func:`write_warc` takes a record table (a payload a row), :func:`write_chunks` the chunk table
itself, so that a record larger than memory can be written as well: chunks come sorted by record, the last
chunk first, as it has the length and the digest that the header states; no more than two chunks of a
record are held. Records become WARC/1.1, one gzip member a record, one file a task, in a folder that
must not hold WARC files already.

The unit of reading is a file, not a byte range, since gzip members can't be found from the middle;
write files of some 100 MB. Partitions of a written set are its files.

Defined cases: a null payload is written with length 0 and reads as one empty chunk with
``is_null`` true; an empty one as one empty chunk. A null id or URI is written without that header and
reads as null. Records with equal ids stay separate records (``file`` and ``record_no`` tell them
apart). Ids of any size are kept as they are. Record types other than those asked for, and unknown headers, are passed over. A truncated or
malformed record (a header line above 1 MiB too) ends its file with one row whose ``error`` says where.
Of a chunk table, a record that lacks chunks or has errors is an error of the write; repeated rows of a
chunk are written once. An empty table writes no
records and reads as no rows. Payloads may hold anything, header-like lines included.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import new_path

CHUNK = 65_536
SCHEMA = "file string, record_no long, record_id string, record_type string, target_uri string, source_id long, chunk_no long, chunk_offset long, chunk binary, chunk_length long, digest_so_far string, is_last boolean, digest_ok boolean, is_null boolean, error string"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Stream:
    """Lines and pieces of a plain or gzip (one or many members) file, in bounded memory."""

    def __init__(self, raw, block: int = 1 << 18):
        self.raw, self.block, self.buffer, self.over, self.rest = raw, block, bytearray(), False, b""
        self.rest = raw.read(block)
        self.unzip = zlib.decompressobj(31) if self.rest[:2] == b"\x1f\x8b" else None

    def _fill(self) -> bool:
        while not self.over:
            data = self.rest or self.raw.read(self.block)
            self.rest = b""
            if not data:
                self.over = True
                return False
            if self.unzip is None:
                self.buffer += data
                return True
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
            out = self.unzip.decompress(data, self.block)
            self.rest = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if out:
                self.buffer += out
                return True
        return False

    def line(self, most: int = 1 << 20) -> bytes | None:
        """The next line with its end; None at the end of the file."""
        while (i := self.buffer.find(b"\n")) < 0:
            if len(self.buffer) > most:
                raise ValueError(f"header line above {most} bytes")
            if not self._fill():
                if not self.buffer:
                    return None
                i = len(self.buffer) - 1
                break
        out = bytes(self.buffer[: i + 1])
        del self.buffer[: i + 1]
        return out

    def piece(self, n: int) -> bytes:
        """The next n bytes, fewer only at the end of the file."""
        while len(self.buffer) < n and self._fill():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(raw, name: str, chunk_bytes: int, types: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of SCHEMA of one open file."""
    s, no = _Stream(raw), -1
    bad = lambda why: (name, no, None, None, None, None, 0, 0, b"", 0, None, True, False, False, why)
    try:
        while (line := s.line()) is not None:
            if not line.strip():
                continue
            no += 1
            if not line.startswith(b"WARC/"):
                yield bad(f"record {no}: no WARC version line")
                return
            head: dict[str, str] = {}
            while (line := s.line()) is not None and line.strip():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                head[key.strip().lower()] = value.strip()
            if line is None or not head.get("content-length", "").isdigit():
                yield bad(f"record {no}: header without content length")
                return
            left, at, k = int(head["content-length"]), 0, 0
            wanted = head.get("warc-type") in types
            sha256, sha1 = hashlib.sha256(), hashlib.sha1()
            declared = head.get("warc-block-digest")
            source = head.get("tallyframe-source-id")
            while True:
                part = s.piece(min(chunk_bytes, left))
                if len(part) < min(chunk_bytes, left):
                    yield bad(f"record {no}: truncated after {at + len(part)} bytes")
                    return
                left -= len(part)
                sha256.update(part)
                sha1.update(part)
                last = left == 0
                if wanted:
                    ok = declared in ("sha1:" + base64.b32encode(sha1.digest()).decode(), "sha256:" + sha256.hexdigest()) if last and declared else None
                    yield (name, no, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), int(source) if source else None, k, at, part, len(part), sha256.hexdigest(), last, ok, head.get("tallyframe-null") == "1", None)
                at, k = at + len(part), k + 1
                if last:
                    break
    except (zlib.error, OSError, ValueError) as e:
        yield bad(f"record {no}: {type(e).__name__}: {e}"[:200])


def read_warc(spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK, types: tuple[str, ...] = ("response", "resource"), files_per_task: int = 1) -> DataFrame:
    """The chunk table of all WARC files below ``path``; columns as in SCHEMA."""
    from pyarrow import fs

    system, at = _filesystem(path)
    found = [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.is_file and f.path.endswith((".warc", ".warc.gz")) and f.size]
    scheme = path.split("://")[0] + "://" if "://" in path else "file://" if path.startswith("file:") else ""
    rows = [((scheme + p) if scheme else p,) for p in sorted(found)]
    files = spark.createDataFrame(rows, "path string").repartition(max(1, -(-len(rows) // files_per_task)), "path") if rows else spark.createDataFrame([], "path string")

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("path").to_pylist():
                system, at = _filesystem(name)
                with system.open_input_stream(at, compression=None) as raw:
                    out, held = [], 0
                    for r in records(raw, name.rsplit("/", 1)[-1], chunk_bytes, types):
                        out.append(r)
                        held += r[9]
                        if held >= 8 << 20 or len(out) >= 10_000:
                            yield batch(out)
                            out, held = [], 0
                    if out:
                        yield batch(out)

    return files.mapInArrow(run, SCHEMA)


def _head(kind: str, key, record: str, digest: str, length: int, uri: str | None, null: bool) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Block-Digest: {digest}", f"Content-Length: {length}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + " ".join(uri.split()))
    if key is not None:
        head.append(f"Tallyframe-Source-ID: {key}")
    if null:
        head.append("Tallyframe-Null: 1")
    return "\r\n".join(head).encode() + b"\r\n\r\n"


def _write(rows: DataFrame, path: str, put) -> None:
    """One file a task, written under a temporary name and renamed, so that a task that is run again
    leaves one file; ``put(batches, out)`` writes the records and returns their number."""
    from pyarrow import fs

    system, at = _filesystem(path)
    if any(f.path.endswith((".warc", ".warc.gz")) for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True))):
        raise ValueError(f"{path} holds WARC files already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = TaskContext.get()
        system, at = _filesystem(path)
        system.create_dir(at, recursive=True)
        name = f"{at}/part-{t.partitionId():06d}.warc.gz"
        temporary = f"{name}.{t.taskAttemptId()}.tmp"
        with system.open_output_stream(temporary, compression=None) as out:
            n = put(batches, out)
        system.move(temporary, name)
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    rows.mapInArrow(run, "file string, records long").write.mode("overwrite").format("noop").save()


def write_warc(df: DataFrame, path: str, *, id_col: str, uri_col: str, payload_col: str, chunk_bytes: int = CHUNK) -> None:
    """Write each row as a resource record; files are gzip, one for each task."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).cast("binary").alias("payload"))

    def put(batches: Iterator[pa.RecordBatch], out) -> int:
        n = 0
        for b in batches:
            for i, uri, payload in zip(*b.columns):  # a row at a time becomes a Python object
                i, uri = i.as_py(), uri.as_py()
                data = memoryview(payload.as_buffer() if payload.is_valid else b"")
                sha1 = hashlib.sha1()
                for k in range(0, len(data), chunk_bytes):
                    sha1.update(data[k : k + chunk_bytes])
                record = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{'' if i is None else i} {uri} {sha1.hexdigest()}')}>"
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(z.compress(_head("resource", i, record, f"sha1:{base64.b32encode(sha1.digest()).decode()}", len(data), uri, not payload.is_valid)))
                for k in range(0, len(data), chunk_bytes):
                    out.write(z.compress(data[k : k + chunk_bytes]))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                n += 1
        return n

    _write(rows, path, put)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write a chunk table as :func:`read_warc` gives it; the record's digest is its SHA-256."""
    keys = ["file", "record_no"]
    rows = chunks.dropDuplicates([*keys, "chunk_no"]).repartition(*keys).sortWithinPartitions(*keys, F.desc("is_last"), "chunk_no")
    rows = rows.select(*keys, "record_id", "record_type", "target_uri", "source_id", "chunk_no", "chunk_offset", "chunk", "digest_so_far", "is_last", "is_null", "error")

    def put(batches: Iterator[pa.RecordBatch], out) -> int:
        n, now, last, z, at, sha = 0, None, None, None, 0, None

        def end() -> None:
            if now is None:
                return
            if at != last["chunk_offset"]:
                raise ValueError(f"record {now} lacks chunks")
            sha.update(last["chunk"])
            if sha.hexdigest() != last["digest_so_far"]:
                raise ValueError(f"record {now}: the chunks don't have the digest of the last row")
            out.write(z.compress(last["chunk"]) + z.compress(b"\r\n\r\n") + z.flush())

        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                key = r["file"], r["record_no"]
                if key != now:
                    end()
                    if r["error"] is not None or not r["is_last"]:
                        raise ValueError(f"record {key} has no last chunk: {r['error']}")
                    now, last, at, sha, n = key, r, 0, hashlib.sha256(), n + 1
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    record = r["record_id"] or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {r['digest_so_far']}')}>"
                    out.write(z.compress(_head(r["record_type"] or "resource", r["source_id"], record, f"sha256:{r['digest_so_far']}", r["chunk_offset"] + len(r["chunk"]), r["target_uri"], bool(r["is_null"]))))
                else:
                    if at != r["chunk_offset"]:
                        raise ValueError(f"record {key} lacks chunks")
                    at += len(r["chunk"])
                    sha.update(r["chunk"])
                    out.write(z.compress(r["chunk"]))
        end()
        return n

    _write(rows, path, put)


def pages_through_warc(pages: DataFrame, *, chunk_bytes: int = CHUNK) -> DataFrame:
    """Pages written as WARC files in the shared folder, read back as chunks.

    Rows (page_id, url, chunk_no, chunk_offset, chunk_length, chunk_hex, digest_so_far, is_last, digest_ok).
    """
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col="page_id", uri_col="url", payload_col="html", chunk_bytes=chunk_bytes)
    got = read_warc(pages.sparkSession, path, chunk_bytes=chunk_bytes)
    return got.select(F.col("source_id").alias("page_id"), F.col("target_uri").alias("url"), "chunk_no", "chunk_offset", "chunk_length", F.hex("chunk").alias("chunk_hex"), "digest_so_far", "is_last", "digest_ok")


ORACLE = f"""
WITH p AS (SELECT page_id, url, hex(encode(html)) AS h FROM pages),
c AS (SELECT *, length(h) // 2 AS n, unnest(range(0, greatest(1, (length(h) // 2 + {CHUNK} - 1) // {CHUNK}))) AS k FROM p)
SELECT page_id, url, CAST(k AS BIGINT) AS chunk_no, CAST(k * {CHUNK} AS BIGINT) AS chunk_offset,
       CAST(least({CHUNK}, n - k * {CHUNK}) AS BIGINT) AS chunk_length,
       substring(h, CAST(k * {2 * CHUNK} + 1 AS BIGINT), {2 * CHUNK}) AS chunk_hex,
       sha256(unhex(substring(h, 1, CAST((k + 1) * {2 * CHUNK} AS BIGINT)))) AS digest_so_far,
       (k + 1) * {CHUNK} >= n AS is_last, CASE WHEN (k + 1) * {CHUNK} >= n THEN TRUE END AS digest_ok
FROM c
"""
