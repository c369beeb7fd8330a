"""WARC archives by way of a chunked record table.

A payload never has to be in one piece: the writer takes (record, chunk number, bytes) rows, the
reader gives such rows, and digests are carried from chunk to chunk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions

CHUNK = 256 << 10
#: An archive ends with the record that takes it beyond this many bytes, as compressed.
ARCHIVE = 1 << 30
#: A batch of chunk rows given back to Spark holds about this many bytes at most.
BATCH = 4 << 20
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:corpusloom:warc")
CHUNKS = "archive string, record_id string, page_id long, record_type string, target_uri string, refers_to long, header_digest string, chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id, digest: str) -> str:
    """The id of the response of a page with a payload; one that is no other record's."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def header(kind: str, page_id, uri: str | None, length: int, digest: str, refers_to: int | None, alone: bool = True) -> bytes:
    """The head of one record, and for a response that of the HTTP message which its block is.

    ``alone`` tells that no other row has the page_id and payload of a response, or of the response that a revisit refers
    to. Only such a response has an id that follows from them, which revisits name; all other records have
    an id of chance, so ids are unique whatever the rows are."""
    http = b"" if kind == "revisit" else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest) if alone and kind == 'response' and page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {(uri or '').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Identified-Payload-Bytes: {length}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
        if alone:
            lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {0 if kind == 'revisit' else len(http) + length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class Writer:
    """Streams chunks into a gzip-per-record archive that gets its final name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.files, self.at = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(self.at, recursive=True)
        self.name, self.out, self.zip, self.records, self.size = name, None, None, 0, 0

    def begin(self, head: bytes) -> None:
        self.finish()
        if self.out is None:
            self.out = self.files.open_output_stream(f"{self.at}/{self.name}.part", compression=None)
        self.zip = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.add(head)
        self.records += 1

    def add(self, data: bytes) -> None:
        self._write(self.zip.compress(data))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def finish(self) -> None:
        if self.zip is not None:
            self.add(b"\r\n\r\n")
            self._write(self.zip.flush())
            self.zip = None

    def close(self) -> str | None:
        self.finish()
        if self.out is None:
            return None
        self.out.close()
        self.files.move(f"{self.at}/{self.name}.part", f"{self.at}/{self.name}")
        return self.name


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes the partitions of a chunk table as archives of about ARCHIVE bytes at most and gives (archive, records).

    The rows of a record must follow each other in chunk order. A repeated or speculative task
    writes a file of another name; only the names that the returned manifest holds are archives.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(writer: Writer) -> Iterator[pa.RecordBatch]:
            records, name = writer.records, writer.close()
            if name:
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([records], pa.int64())})

        out = Writer(folder, f"part-{uuid.uuid4().hex}.warc.gz")
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "target_uri", "record_type", "refers_to", "n_bytes", "digest", "alone", "chunk", "data")]
            for i in range(batch.num_rows):
                page, uri, kind, refers, n, digest, alone, k, data = (c[i].as_py() for c in columns)
                if k == 0:
                    if out.size > ARCHIVE:
                        yield from told(out)
                        out = Writer(folder, f"part-{uuid.uuid4().hex}.warc.gz")
                    out.begin(header(kind, page, uri, n, digest, refers, alone))
                if data and kind != "revisit":
                    out.add(data)
        yield from told(out)

    return chunks.mapInArrow(run, "archive string, records long")


def _members(stream) -> Iterator[bytes | None]:
    """The archive's bytes; None ends each gzip member."""
    unzip = zlib.decompressobj(31)
    while piece := stream.read(CHUNK):
        while piece:
            data = unzip.decompress(piece, CHUNK)
            if data:
                yield data
            piece = unzip.unconsumed_tail
            if unzip.eof:
                piece = unzip.unused_data
                yield None
                unzip = zlib.decompressobj(31)
    if tail := unzip.flush():
        yield tail


def read_records(stream) -> Iterator[dict]:
    """Chunk rows of an archive, at most two chunks in memory. Each carries the digest of the payload so far."""
    held, fields, left, k, sha, seen, total, http = b"", None, 0, 0, None, 0, 0, False
    for data in _members(stream):
        if data is None:
            held = b""
            continue
        held += data
        while held:
            if fields is None:
                held = held.lstrip(b"\r\n")
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                pairs = [x.split(b": ", 1) if b": " in x else [x.rstrip(b":"), b""] for x in held[:end].split(b"\r\n")[1:]]
                fields = {a.decode(): b.decode() for a, b in pairs}
                held = held[end + 4 :]
                total = left = int(fields["Content-Length"])
                k, sha, seen = 0, hashlib.sha1(), 0
                http = bool(left) and fields["Content-Type"].startswith("application/http")
                if left:
                    continue
            if http:  # the payload begins behind the head of the message
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                left, held, http = left - end - 4, held[end + 4 :], False
                if left:
                    continue
            part = held[: min(left, CHUNK)]
            held = held[len(part) :]
            left -= len(part)
            seen += len(part)
            sha.update(part)
            yield {"fields": fields, "chunk": k, "data": part, "bytes_so_far": seen, "digest_so_far": base32_sha1(sha.digest()), "last": not left}
            k += 1
            if not left:
                fields = None
    if fields is not None:
        raise ValueError(f"archive ends {left} of {total} bytes early")


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The chunk table of the archives that the manifest names. Without ``payload`` the bytes are
    read and digested but not given back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pafs.FileSystem.from_uri(folder)
        names = CHUNKS.split(", ")
        names = [x.split()[0] for x in names]
        types = {"page_id": pa.int64(), "refers_to": pa.int64(), "chunk": pa.int32(), "data": pa.binary(), "bytes_so_far": pa.int64(), "last": pa.bool_()}
        schema = pa.schema([(x, types.get(x, pa.string())) for x in names])
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                with files.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for r in read_records(stream):
                        f = r["fields"]
                        number = lambda key, f=f: int(f[key]) if f.get(key) else None
                        rows.append({"archive": name, "record_id": f["WARC-Record-ID"], "page_id": number("WARC-Page-ID"), "record_type": f["WARC-Type"], "target_uri": f.get("WARC-Target-URI"), "refers_to": number("WARC-Refers-To-Page-ID"), "header_digest": f["WARC-Payload-Digest"].removeprefix("sha1:"), **{c: r[c] for c in ("chunk", "bytes_so_far", "digest_so_far", "last")}, "data": r["data"] if payload else None})
                        if f["WARC-Type"] == "revisit":
                            rows[-1] |= {"bytes_so_far": int(f["WARC-Identified-Payload-Bytes"]), "digest_so_far": rows[-1]["header_digest"]}
                        size += len(r["data"]) if payload else 200
                        if size >= BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.mapInArrow(run, CHUNKS)


def page_records(pages: DataFrame, scratch: Scratch, least: int = 0, id_col: str = "page_id", text_col: str = "html", url_col: str = "url") -> DataFrame:
    """The chunk table of the pages: what is to be written.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response and all
    others revisit it. Only ids and digests are grouped, pre-aggregated for each partition; the
    payloads move once, to meet the verdicts. The groups are written first, so that Spark can
    split the partition of a payload that a third of all pages share.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    raw = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), body.alias("body"), F.sha1(body).alias("hex"))
    told = raw.select("page_id", "hex", F.octet_length("body").alias("size")).groupBy("page_id", "hex", "size").agg(F.count("*").alias("n"))
    told = scratch.table(told, "told")
    first = told.filter((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("hex").agg(F.min(F.struct("page_id", "n")).alias("first"), F.sum("n").alias("copies")).filter("copies > 1").drop("copies")
    marked = told.join(scratch.table(first, "copies"), "hex", "left")
    later = F.coalesce((F.col("size") >= least) & (F.col("page_id") > F.col("first.page_id")), F.lit(False))
    marked = marked.select("page_id", "hex", F.when(later, F.col("first.page_id")).alias("refers_to"), F.when(later, F.col("first.n") == 1).otherwise(F.col("n") == 1).alias("alone"))
    verdict = raw.join(marked.filter("refers_to is not null or not alone"), ["page_id", "hex"], "left").withColumn("n_bytes", F.octet_length("body").cast("long")).withColumn("alone", F.coalesce("alone", F.lit(True)))
    pieces = F.when(F.col("refers_to").isNotNull() | (F.col("n_bytes") == 0), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / CHUNK).cast("int")))
    chunked = verdict.select("page_id", "target_uri", "refers_to", "hex", "n_bytes", "alone", "body", F.explode(pieces).alias("chunk"))
    return chunked.select(
        "page_id",
        "target_uri",
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
        "refers_to",
        "n_bytes",
        _base32("hex").alias("digest"),
        "alone",
        "chunk",
        F.when(F.col("refers_to").isNull(), F.substring("body", F.col("chunk") * CHUNK + 1, F.lit(CHUNK))).alias("data"),
    )


def _base32(column: str):
    """RFC 4648 base32 of a 40-digit hexadecimal string: eight groups of five digits, four letters each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    letters = []
    for group in range(8):
        value = F.conv(F.substring(column, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(alphabet, F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def roundtrip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to.
    Null html counts as empty. A null page_id has no order, so it is always a response; rows that
    repeat the smallest page_id of a payload are all responses. An empty table gives an empty
    result; other columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark)
    folder = folder or scratch.folder("warc")
    # the manifest is written once: it says which files count
    manifest = scratch.table(write_archives(page_records(pages, scratch, least), folder), "manifest")
    files = manifest.repartition(partitions(spark), "archive")
    return read_archives(files, folder, payload=False).filter("last").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")
