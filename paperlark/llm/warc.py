"""Web archives (WARC 1.1) written from pages and read back as a table of chunks.

Of equal payloads one record holds the bytes, the response; the others are revisits that name it and repeat its digest and length.
An archive is a chain of gzip members, one a record, rolled over at a bounded size. A payload never stands in a Python worker as a
whole: the writer gets it, and the reader gives it, as rows of a record's identifier, a chunk's number and the chunk; the reader's
rows carry the number of bytes and the SHA-1 of all chunks so far, so the row marked last has the record's.

Data moved: keys, ids and addresses of all rows; each distinct payload once, by its SHA-256, after equal ones have met in each
task. Payloads that very many rows share are found by count; their keys, at most HUBS, are broadcast, so that no task gets all of
their revisits. Archives get a new name in each attempt, and a manifest table, committed by Spark, lists the ones that count:
lost executors leave at most files that nobody reads.

Null html is the empty payload. A null address is written as the record's identifier. Rows without a page id come after all others:
one is a response only if no row with an id has its payload, and revisits of it refer to null. Of repeated rows of one id and
payload one is the response (the one of the smallest address), the others revisit it. An empty table gives archives without
records and no rows; further columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlark.llm.common import bounded, shared_dir

#: Bytes of a payload's chunk, and of an archive at which the next record starts another.
CHUNK, ROLL = 1 << 16, 64 << 20
#: A bound of the payloads that are taken as very frequent.
HUBS = 20_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STARTS = "page_id bigint, url string, size bigint, sha1 string, copy bigint, first bigint, revisit boolean, chunk_no bigint, chunk binary"
_MANIFEST = "archive string, records bigint, bytes bigint"
_CHUNKS = pa.schema([
    ("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()),
    ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("error", pa.string()),
])
_CHUNK_COLUMNS = ", ".join(f"{f.name} {({pa.string(): 'string', pa.int64(): 'bigint', pa.bool_(): 'boolean', pa.binary(): 'binary'})[f.type]}" for f in _CHUNKS)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, _, rest = path.partition(":")
    if rest and scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return (pyarrow.fs.FileSystem.from_uri(path)) if rest else (pyarrow.fs.LocalFileSystem(), path)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class _Archive:
    """An archive in the making: gzip members written as they come."""

    def __init__(self, folder: str):
        self.name, self.records, self.bytes, self.member = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        fs, path = _place(f"{folder}/{self.name}")
        self.out = fs.open_output_stream(path, compression=None)

    def put(self, data: bytes) -> None:
        packed = self.member.compress(data)
        self.out.write(packed)
        self.bytes += len(packed)

    def start(self, head: bytes) -> None:
        self.end()
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.records += 1
        self.put(head)

    def end(self) -> None:
        if self.member:
            packed = self.member.compress(b"\r\n\r\n") + self.member.flush()
            self.out.write(packed)
            self.bytes += len(packed)
            self.member = None

    def close(self) -> tuple:
        self.end()
        self.out.close()
        return self.name, self.records, self.bytes


def _identifier(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}" + (f":{copy}" if copy else "")


def _head(row: dict, date: str) -> bytes:
    """A record's header and the HTTP header before its payload."""
    digest = _base32(bytes.fromhex(row["sha1"]))
    own = _identifier(row["page_id"], digest, row["copy"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {own if row['url'] is None else urllib.parse.quote(row['url'], safe=''.join(map(chr, range(33, 127))))}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if row["revisit"]:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_identifier(row['first'], digest)}>", "WARC-Truncated: length"]
    length = len(http) + (0 if row["revisit"] else row["size"])
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode() + http


def _writer(folder: str, date: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if archive and archive.bytes >= roll:
                        done.append(archive.close())
                        archive = None
                    archive = archive or _Archive(folder)
                    archive.start(_head(row, date))
                if row["chunk"]:
                    archive.put(row["chunk"])
        if archive:
            done.append(archive.close())
        if done:
            names, records, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return write


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, its size and key, and where the row stands among those of its payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    place = F.struct(F.col("page_id").isNull(), "page_id", F.coalesce("url", F.lit("")))
    return rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("key"), place.alias("place"))


def _responses(keyed: DataFrame) -> DataFrame:
    """The first row of each payload, cut into chunks in the order that the writer needs."""
    best = keyed.groupBy("key").agg(F.min_by(F.struct("page_id", "url", "size", "payload"), "place").alias("r")).select("r.*")
    chunks = best.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((size - 1) div {CHUNK} as int)")))).alias("chunk_no"))
    return chunks.select(
        "page_id", "url", "size", F.sha1("payload").alias("sha1"), F.lit(0).cast("long").alias("copy"), F.lit(None).cast("long").alias("first"), F.lit(False).alias("revisit"),
        F.col("chunk_no").cast("long").alias("chunk_no"), F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)).alias("chunk"),
    )


def _revisits(copies: DataFrame) -> DataFrame:
    """copies(key, place, page_id, url, size, sha1, n) -> a row for each page that is not the first of its payload."""
    n = copies.agg(F.sum("n")).first()[0] or 0
    firsts = copies.groupBy("key").agg(F.min("place").alias("f"), F.sum("n").alias("all")).where("all > 1")
    most = max(64, n // HUBS)
    hubs = F.broadcast(firsts.where(F.col("all") > most).select("key", F.col("f").alias("hub_f")))
    # part is 0 for them all, in a form that the optimizer does not know: else it joins by the key alone
    others = firsts.where(F.col("all") <= most).select("key", "f", F.when(F.col("all") > most, 1).otherwise(0).alias("part"))
    dealt = copies.join(hubs, "key", "left").withColumn("part", F.when(F.col("hub_f").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("place"), F.lit(HUBS)).cast("int")))
    told = dealt.join(others, ["key", "part"], "left").withColumn("f", F.coalesce("f", "hub_f")).where("f is not null")
    more = F.col("n") - F.when(F.col("place") == F.col("f"), 1).otherwise(0)
    return told.where(more > 0).select(
        "page_id", "url", "size", "sha1", F.explode(F.sequence(F.lit(1).cast("long"), more)).alias("copy"), F.col("f.page_id").alias("first"), F.lit(True).alias("revisit"),
        F.lit(0).cast("long").alias("chunk_no"), F.lit(None).cast("binary").alias("chunk"),
    )


def write_archives(pages: DataFrame, folder: str | None = None, *, date: str = "1970-01-01T00:00:00Z", roll: int = ROLL) -> str:
    """Write a record for each row of pages(page_id, url, html) into new archives of a new folder; its path is returned."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    keyed = _keyed(pages)
    keys = keyed.select("key", "place", "page_id", "url", "size", F.sha1("payload").alias("sha1"))
    keys.groupBy(*keys.columns).agg(F.count("*").alias("n")).write.parquet(f"{folder}/copies")
    rows = _responses(keyed).unionByName(_revisits(spark.read.parquet(f"{folder}/copies")))
    fs, path = _place(f"{folder}/archives")
    fs.create_dir(path, recursive=True)
    bounded(rows).mapInArrow(_writer(f"{folder}/archives", date, roll), _MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


class _Stream:
    """Bytes of an archive, unpacked as they are asked for."""

    def __init__(self, raw, block: int = 1 << 18):
        self.raw, self.block, self.have, self.at = raw, block, b"", 0
        start = raw.read(block)
        self.packed, self.left = start[:2] == b"\x1f\x8b", start
        self.member = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bytes:
        while True:
            data, self.left = self.left or self.raw.read(self.block), b""
            if not data:
                return b""
            if not self.packed:
                return data
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(data, self.block)
            self.left = self.member.unconsumed_tail or self.member.unused_data
            if out:
                return out

    def _fill(self) -> bool:
        data = self._more()
        self.have, self.at = self.have[self.at :] + data, 0
        return bool(data)

    def line(self, longest: int = 1 << 20) -> bytes | None:
        """The next line without its end; None where nothing is left."""
        seen = 0
        while (end := self.have.find(b"\n", self.at + seen)) < 0:
            seen = len(self.have) - self.at
            if seen > longest:
                raise ValueError("a header line has no end")
            if not self._fill():
                if not seen:
                    return None
                end = len(self.have)
                break
        line, self.at = self.have[self.at : end].rstrip(b"\r"), min(end + 1, len(self.have))
        return line

    def some(self, most: int) -> bytes:
        """At most so many bytes, as many as there are; none at the end."""
        while len(self.have) - self.at < most and self._fill():
            pass
        out = self.have[self.at : self.at + most]
        self.at += len(out)
        return out


def _fields(stream: _Stream) -> dict[str, str]:
    found, last = {}, ""
    while line := stream.line():
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        found.setdefault(last, value.strip())
    return found


class _Counted:
    """What is left of a record's block, read like a stream."""

    def __init__(self, stream: _Stream, length: int):
        self.stream, self.left, self.short = stream, length, False

    def some(self, most: int) -> bytes:
        out = self.stream.some(min(most, self.left))
        self.short |= len(out) < min(most, self.left)
        self.left = 0 if self.short else self.left - len(out)
        return out

    def http(self, longest: int = 1 << 20) -> tuple[dict[str, str], bytes]:
        """The fields of the HTTP header, and what was read beyond it."""
        data = b""
        while (end := data.find(b"\r\n\r\n")) < 0 and len(data) < longest and (more := self.some(4096)):
            data += more
        if end < 0:
            return {}, data
        return _fields(_Stream(io.BytesIO(data[: end + 4].partition(b"\r\n")[2]))), data[end + 4 :]


def _records(name: str, stream: _Stream, chunk: int) -> Iterator[tuple]:
    """Rows of the chunk table, record by record."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            yield name, None, None, None, None, None, None, 0, None, 0, None, True, "no record starts here"
            return
        fields = _fields(stream)
        length = fields.get("content-length", "")
        block = _Counted(stream, int(length) if length.isdigit() else 0)
        http, rest = block.http() if fields.get("content-type", "").startswith("application/http") else ({}, b"")
        size = http.get("content-length", "")
        told = [name, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-type"), fields.get("warc-target-uri"), fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(size) if size.isdigit() else None]
        digest, so_far, number, error = hashlib.sha1(), 0, 0, None if length.isdigit() else "no length"
        while True:
            while len(rest) < chunk and (more := block.some(chunk - len(rest))):
                rest += more
            now, rest = rest[:chunk], rest[chunk:]
            digest.update(now)
            so_far += len(now)
            last = not rest and not block.left
            total = _base32(digest.digest())
            if last:
                error = error or ("truncated" if block.short else "digest differs" if told[2] != "revisit" and told[5] and told[5] != total else None)
            yield *told, number, now, so_far, total, last, error
            if last:
                break
            number += 1


def _reader(chunk: int, with_bytes: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)]
            if not with_bytes:
                columns[8] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHUNKS)], schema=_CHUNKS)

        for paths in batches:
            for path in paths.column(0).to_pylist():
                fs, place = _place(path)
                with fs.open_input_stream(place, compression=None) as raw:
                    rows, held = [], 0
                    for row in _records(os.path.basename(place), _Stream(raw), chunk):
                        rows.append(row)
                        held += len(row[8] or b"")
                        if held >= 4 << 20 or len(rows) >= 1000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return read


def read_chunks(archives: DataFrame, *, chunk: int = CHUNK, with_bytes: bool = True) -> DataFrame:
    """archives(path), gzip or plain -> the chunk table: a row for each chunk of each record, at least one a record.

    record_id, record_type, target_uri, refers_to, declared_digest and declared_bytes (of the HTTP header) are the record's;
    bytes_so_far and digest_so_far are of the chunks up to this one; last marks the record's last chunk, whose error says what
    is wrong with the record (null: nothing). Without with_bytes the chunks are read and digested, but not returned.
    """
    return bounded(archives.select("path")).mapInArrow(_reader(chunk, with_bytes), _CHUNK_COLUMNS)


def archives_of(spark: SparkSession, folder: str) -> DataFrame:
    """The archives that write_archives has committed, as path and length; Spark deals them out by their length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").schema("path string, modificationTime timestamp, length bigint, content binary").load(f"{folder}/archives").select("path", "length")
    counted = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("archive")
    return files.withColumn("archive", F.substring_index("path", "/", -1)).join(counted, "archive", "left_semi").select("path", "length")


def page_records(chunks: DataFrame) -> DataFrame:
    """The chunk table of archives of pages -> per record page_id, size and digest of its full payload, type, and the page of the response that it refers to."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        F.expr("try_cast(split(record_id, ':')[2] as bigint)").alias("page_id"), F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type",
        F.when(revisit, F.expr("try_cast(split(refers_to, ':')[2] as bigint)")).alias("refers_to"), "error",
    )
