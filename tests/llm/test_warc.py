import hashlib
import os
import random
import struct
import uuid

import pytest

from quillmask.llm import warc as W
from quillmask.session import scratch_path

PAGES = "page_id long, url string, html string"


def expected(rows, min_bytes=W.MIN_BYTES):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, b in body:
        if i is not None:
            last[b] = max(last.get(b, i), i)
    out = []
    for i, b in body:
        same = len(b) >= min_bytes and last.get(b, i) != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if same else "response", last[b] if same else None))
    return sorted(out, key=str)


def read(manifest):
    rows = W.read_archives(manifest).collect()
    num = lambda x: None if x is None else int(x)
    return rows, sorted(((num(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in rows), key=str)


@pytest.mark.parametrize("file_bytes", [W.FILE_BYTES, 3000])
def test_round_trip(frame, spark, file_bytes):
    rng = random.Random(1)
    bodies = ["<p>" + "é日x "[rng.randrange(4)] * rng.choice([10, 999, 1500, 40000]) for _ in range(12)] + [None, "", "\r\n\r\nWARC/1.1\r\n"]
    rows = [(i, rng.choice(["http://a/b?c d", "http://x/é\r\nEvil: 1", None]), rng.choice(bodies)) for i in range(150)]
    rows += [(None, None, "z" * 2000), (None, None, "z" * 2000), (900, None, "z" * 2000), (901, "u", "q" * 3000), (901, "u", "q" * 3000)]
    docs = frame([(*r, "x", 1) for r in rows], PAGES + ", digest string, bytes int")
    manifest = W.write_archives(docs, scratch_path(spark, "warc"), file_bytes=file_bytes)
    raw, got = read(manifest)
    assert got == expected(rows)
    payloads = {(r.page_id, r.payload_digest): bytes(r.payload) for r in raw if r.record_type == "response"}
    assert all(hashlib.sha1(b).hexdigest() == d for (_, d), b in payloads.items())
    assert manifest.count() > (1 if file_bytes < 10_000 else 0)
    for r in manifest.collect():        # each archive: a dictionary frame, then frames
        path = W.filesystem(r.path)[1]
        assert os.path.getsize(path) == r.bytes
        with open(path, "rb") as f:
            assert struct.unpack("<I", f.read(4))[0] == W.DICTIONARY_MAGIC


def test_only_committed_files_count(frame, spark):
    folder = scratch_path(spark, "warc")
    manifest = W.write_archives(frame([(1, "u", "x" * 50)], PAGES), folder)
    with open(os.path.join(W.filesystem(folder)[1], f"part-{uuid.uuid4()}.warc.zst"), "wb") as f:
        f.write(b"half a file")
    assert len(read(manifest)[1]) == 1


def test_dictionary_helps(spark):
    import zstandard
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(200).collect()
    raw = [W.record(str(r.page_id), r.url, r.html.encode(), hashlib.sha1(r.html.encode()).hexdigest(), None, False) for r in pages]
    d = zstandard.ZstdCompressionDict(W.train_dictionary(raw[:100]))
    own = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in raw[100:])
    shared = sum(len(zstandard.ZstdCompressor(level=3, dict_data=d).compress(r)) for r in raw[100:])
    assert shared < 0.9 * own


def test_empty_table(frame, spark):
    manifest = W.write_archives(frame([], PAGES), scratch_path(spark, "warc"))
    assert manifest.count() == 0 and W.read_archives(manifest).count() == 0
