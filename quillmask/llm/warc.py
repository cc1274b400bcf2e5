"""WARC archives compressed record by record with a shared Zstandard
dictionary.

*Writing.*  A dictionary is trained on a bounded sample of the archived
records.  An archive file begins with a skippable frame that holds the
dictionary; every record is a frame of its own after it, so it can be read
alone from its offset.  Of records with equal payloads of at least
``min_bytes``, the one with the largest id is a ``response``; the others are
``revisit`` records that refer to it and carry no payload.

*Finding equal payloads.*  Digests are grouped, not payloads: (digest, length)
with the largest id and the count are aggregated map-side, so a payload that a
third of all records share is a row per task.  The repeated digests are joined
back to the digests, salted; the pages get that list of revisits by their id.

*Files.*  Tasks write through ``pyarrow.fs`` to the shared folder, to a name
that contains the task attempt, and return (path, records, bytes); that
manifest is a written table, and only files in it are part of the archive, so
a lost or repeated attempt leaves at most a file nobody refers to.  A task
starts a new file after ``file_bytes``, so nothing grows with the input.

Reading streams the files of the manifest through a decompressor and parses
the records.

Defined results: a null payload is empty; a null url is left out of the
record; a null id is the smallest; rows equal in id and payload are records of
their own and of one type.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared, stored

MIN_BYTES = 1000
FILE_BYTES = 64 << 20
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8 << 10, 110 << 10
LEVEL = 3
SALTS = 16
BROADCAST_ROWS = 500_000
#: Fixed values of the formats: a skippable frame's magic number that holds a
#: dictionary, the profile of a revisit, the format's version line.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"


def filesystem(uri: str):
    """(file system, path) of a folder all executors share."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def sha1_base32(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def urn(record_id: str | None) -> str:
    """A record id that follows from the page's."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(record_id))}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, same) -> bytes:
    """One record.  ``same``: whether it revisits ``refers_to``."""
    body = b"" if same else payload
    fields = [("WARC-Type", "revisit" if same else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)))
    fields += [("WARC-Payload-Digest", sha1_base32(digest)), ("X-Page-ID", "" if page_id is None else page_id),
               ("X-Payload-Length", str(len(payload)))]
    if same:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to)), ("X-Refers-To-Page-ID", "" if refers_to is None else refers_to)]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    head = "".join([VERSION, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"])
    return head.encode() + body + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; the samples themselves (raw content) where they
    are too few to train on."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or VERSION.encode()


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def payload(pages: DataFrame, html: str) -> Column:
    kind = dict(pages.dtypes)[html]
    body = F.col(html) if kind == "binary" else F.col(html).cast("string").cast("binary")
    return F.coalesce(body, F.lit(b"").cast("binary"))


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """page_id, url, html (binary), digest, bytes, and ``refers_to`` with
    ``same`` for revisits."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload(pages, html).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    slim = stored(rows.filter(F.col("bytes") >= min_bytes).select("page_id", F.unhex("digest").alias("digest"), "bytes"), "digests")
    shared = slim.groupBy("digest", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    back = slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(shared, ["digest", "bytes", "salt"])
    back = back.filter("not (page_id <=> refers_to)").groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"))
    back = stored(back.select(F.col("page_id").alias("own"), F.lower(F.hex("digest")).alias("of"), "refers_to", F.lit(True).alias("same")), "revisits")
    back = F.broadcast(back) if back.count() <= BROADCAST_ROWS else back
    return rows.join(back, rows.page_id.eqNullSafe(back.own) & (rows.digest == back.of), "left").drop("own", "of")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``pages`` as archives into ``folder``; the manifest: path,
    records, bytes."""
    spark = prepared(pages.sparkSession)
    rows = with_revisits(pages, page_id, url, html, min_bytes)
    return write_records(rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")}),
                         folder, sample(spark, pages, page_id, url, html), file_bytes, level)


def sample(spark, pages: DataFrame, page_id: str, url: str, html: str) -> list[bytes]:
    """What the dictionary is trained on: of each of ``SAMPLE_RECORDS`` hash
    buckets the record of least hash, at most ``SAMPLE_BYTES`` of each.  The
    minima are aggregated map-side."""
    rows = pages.select(F.col(page_id).cast("string").alias("p"), F.col(url).cast("string").alias("u"),
                        F.substring(payload(pages, html), 1, SAMPLE_BYTES).alias("h"), F.xxhash64(F.col(page_id), F.col(html)).alias("x"))
    least = rows.groupBy(F.pmod("x", F.lit(SAMPLE_RECORDS)).alias("b")).agg(F.min("x").alias("x")).select("x")
    picked = rows.join(F.broadcast(least), "x").groupBy("x").agg(F.min(F.struct("p", "u", "h")).alias("r")).select("x", "r.*").collect()
    return [record(r.p, r.u, bytes(r.h), hashlib.sha1(r.h).hexdigest(), None, False) for r in sorted(picked, key=lambda r: r.x)]


def write_records(rows: DataFrame, folder: str, samples: list[bytes], file_bytes: int, level: int) -> DataFrame:
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(train_dictionary(samples))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(held.value), write_checksum=True)
        task, nth, out, made, n, size = TaskContext.get(), 0, None, [], 0, 0

        def close():
            out.close()
            made.append((f"{folder}/{name}", n, size))
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{nth:04d}.warc.zst"
                    out, n, nth = files.open_output_stream(f"{path}/{name}", compression=None), 0, nth + 1
                    size = out.write(skippable(held.value))
                get = {k: c[i].as_py() for k, c in column.items()}
                size += out.write(packer.compress(record(get["page_id"], get["url"], get["html"], get["digest"], get["refers_to"], bool(get["same"]))))
                n += 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "records": [m[1] for m in made], "bytes": [m[2] for m in made]},
                                         schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    chosen = rows.select("page_id", "url", "html", "digest", "refers_to", "same")
    return stored(chosen.mapInArrow(write, "path string, records long, bytes long"), "manifest")


def parsed(raw: bytes) -> dict:
    """Fields of a record and its ``body``."""
    head, body = raw.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0]!r}")
    out: dict = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(out["Content-Length"])
    if body[size:] != b"\r\n\r\n":
        raise ValueError("a record has another length than it says")
    return out | {"body": body[:size]}


def frames(stream, dictionary=None) -> Iterator[bytes]:
    """The records of an archive, one frame after another."""
    import zstandard
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    rest = b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    raise ValueError("an archive ends inside a record")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(parts)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the manifest's files: page_id (string), url,
    record_type, payload_bytes and payload_digest of the full payload,
    refers_to (string), payload (binary; null for a revisit)."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                files, path = filesystem(uri)
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for raw in frames(stream):
                        r = parsed(raw)
                        same = r["WARC-Type"] == "revisit"
                        digest = base64.b32decode(r["WARC-Payload-Digest"][5:]).hex()
                        if not same and (hashlib.sha1(r["body"]).hexdigest() != digest or len(r["body"]) != int(r["X-Payload-Length"])):
                            raise ValueError("a payload differs from its digest")
                        rows.append((r["X-Page-ID"] or None, r.get("WARC-Target-URI"), r["WARC-Type"], int(r["X-Payload-Length"]), digest,
                                     (r["X-Refers-To-Page-ID"] or None) if same else None, None if same else r["body"]))
                        size += len(r["body"])
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(max(n, manifest.sparkSession.sparkContext.defaultParallelism)).mapInPandas(
        read, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")
