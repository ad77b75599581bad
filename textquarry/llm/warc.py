"""WARC: a deterministic sharded writer and a reader.

Records are cut into ranges of page_id and sorted by it; a task writes its range to gzip members, one per record, and
rolls to the next file when the compressed size passes `roll`. Headers, lengths and digests are made anew from the
payload. Files get their names by rename when they are whole; the manifest, one row per file with its records, bytes
and SHA-256, is written last and is what a reader goes by: files that no manifest names do not count. The bytes follow
from the rows alone (fixed date, ids from the page_id and the payload, gzip without time), so reruns write equal files.

Of records with equal payloads the one with the smallest page_id is the response and the others are revisits of it.
A null html is the empty payload; a null url is empty; rows with a null page_id come first, and do not revisit.
Rows that repeat a page_id are ordered by digest and url; those with the payload of the response's row and its id are
responses too. An empty table gives a manifest without files. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, shards
from .common import mapped, new_path

DATE = "2000-01-01T00:00:00Z"
MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def _id(page_id: int | None, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _clean(s: str) -> str:
    """A header value: one line."""
    return re.sub(r"[\r\n]+", " ", s or "").strip()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP head alone, and the length and digest of the full payload."""
    digest = b32(hashlib.sha1(payload).digest())
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: gzip, whose header has no time
    return c.compress(data) + c.flush()


def write(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, roll: int = 16 << 20, revisit_from: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) below folder; the manifest as a DataFrame. revisit_from: smallest payload that may be a revisit."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    keyed = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n"))
    # one small row per payload that several pages share, joined to the pages' ids, never to their html
    first = keyed.filter(F.col("n") >= revisit_from).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("of")).filter("of > 1").drop("of")
    again = keyed.filter(F.col("n") >= revisit_from).join(first, "sha").filter(F.col("page_id") > F.col("first")).select("page_id", "sha", "first").distinct()
    # the html moves once: the notes on revisits travel beside it and are sorted in front of it
    both = rows.select("page_id", F.lit(1).alias("kind"), F.sha1(F.col("html").cast("binary")).alias("sha"), "url", "html", F.lit(None).cast("long").alias("first")).unionByName(
        again.select("page_id", F.lit(0).alias("kind"), "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
    )
    sized = rows.select("page_id", F.octet_length("html").alias("n"))
    n, cells = shards.plan(sized, "page_id", F.col("n") + 500, shard_bytes)
    dealt = shards.deal(both, "page_id", cells, n).sortWithinPartitions("shard", "page_id", "sha", "kind", "url")

    def put(batches):
        out, shard, k, records, sha, note, page = None, None, 0, 0, None, {}, object()

        def close():
            out.commit()
            return pa.RecordBatch.from_pylist([{"file": out.final.rsplit("/", 1)[1], "shard": shard, "records": records, "bytes": out.size, "sha256": sha.hexdigest()}], schema=manifest)

        try:
            for batch in batches:
                for at, page_id, kind, key, url, text, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "kind", "sha", "url", "html", "first")), strict=True):
                    if page_id != page:
                        note, page = {}, page_id
                    if kind == 0:
                        note[key] = first
                        continue
                    if out and (at != shard or out.size >= roll):
                        whole, out = close(), None
                        yield whole
                    if out is None:
                        k, shard, records, sha = (k + 1 if at == shard else 0), at, 0, hashlib.sha256()
                        out = files.Committed(folder, f"part-{at:05d}-{k:05d}.warc.gz")
                    member = _gzip(record(page_id, url, text.encode(), note.get(key)))
                    sha.update(member)
                    out.write(member)
                    records += 1
            if out:
                whole, out = close(), None
                yield whole
        finally:
            if out:  # the task has failed
                out.abort()

    manifest = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    mapped(dealt, put, MANIFEST, "warc").write.parquet(f"{folder}/manifest")
    return read_manifest(pages.sparkSession, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream, size: int = 1 << 16):
    """The contents of the gzip members of a stream, one at a time."""
    d, parts = zlib.decompressobj(31), []
    data = stream.read(size)
    while data:
        parts.append(d.decompress(data))
        if d.eof:
            yield b"".join(parts)
            data, d, parts = d.unused_data, zlib.decompressobj(31), []
        else:
            data = b""
        data = data or stream.read(size)
    if any(parts):
        raise ValueError("a gzip member is cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block, whose length and digest must be right."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict((k.lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]))
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != "sha1:" + b32(hashlib.sha1(block).digest()):
        raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
    return fields, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the files that the manifest names, from the files' bytes; a file that differs from it is an error."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())])

    def get(batches):
        for batch in batches:
            for name, wanted in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, path = files.at(folder)
                rows, seen = [], 0
                with store.open_input_stream(f"{path}/{name}", buffer_size=1 << 20) as f:
                    for member in members(f):
                        h, block = parse(member)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                        ok = kind == "revisit" or (len(payload) == length and b32(hashlib.sha1(payload).digest()) == digest)
                        ids = [int(x) if x else None for x in (h["x-page-id"], h.get("x-refers-to-page-id"))]
                        rows.append({"page_id": ids[0], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": ids[1], "digest_ok": ok})
                        seen += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if seen != wanted:
                    raise ValueError(f"{name} has {seen} records, not {wanted}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = read_manifest(spark, folder)
    return mapped(listed.repartition(max(1, listed.count()), "file"), get, RECORD, "warc")


def new_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
