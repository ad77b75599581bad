"""Token ids in fixed-width bit-packed files.

A file is a 32-byte header, blocks, a block index and a document index, and ends with the place of the indexes:

    header   8s magic, <I bits, <I ids per block, <Q ids in the file, <Q id of the whole file's first id
    block    `ids per block` ids of `bits` bits each, the first in the lowest bits; the last block may be short
    index    <Q offset of each block
    docs     <q doc_id, <Q first id within the file, <Q ids: a row for each document
    footer   <Q offset of the index, <Q blocks, <Q documents, 8s magic

`bits` is the least that holds every id of the vocabulary. A block starts on a byte, so id i is in block i // per_block
at a known bit: any document is read by one seek, and a block is unpacked by numpy without a loop over ids.

Documents are written in ascending doc_id: ranges of ids become shards, a shard becomes files that roll at `roll`
bytes. A null or empty text is the end id alone. Null doc_ids come first; rows that repeat a doc_id are all written,
ordered by text, and read back each with a start of its own. An empty table writes a manifest without files. Extra
columns are ignored. Files are named by rename when whole, the manifest comes last.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files, shards
from .common import Kept, mapped, written
from .pieces import Encoder, Splitter, Values, gathered, in_groups

MAGIC, PER_BLOCK = b"TQTOKEN1", 8192
HEADER, FOOTER = struct.Struct("<8sIIQQ"), struct.Struct("<QQQ8s")
MANIFEST = "file string, shard int, part int, documents long, ids long, bytes long"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in `bits` bits, lowest first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(rows.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """n ids after the first `skip` of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}")[skip : skip + n].astype("<u4")
    first = skip * bits
    raw = np.unpackbits(np.frombuffer(data, dtype=np.uint8)[first // 8 : -(-(first + n * bits) // 8)], bitorder="little")
    rows = raw[first % 8 : first % 8 + n * bits].reshape(n, bits)
    whole = np.zeros((n, 32), dtype=np.uint8)
    whole[:, :bits] = rows
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    def __init__(self, folder: str, name: str, bits: int, per_block: int = PER_BLOCK):
        self.file, self.name, self.bits, self.per_block = files.Committed(folder, name), name, bits, per_block
        self.docs, self.blocks, self.rest, self.waiting, self.n = [], [], [], 0, 0
        self.file.write(HEADER.pack(MAGIC, bits, per_block, 0, 0))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.n += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * self.per_block:
            self._put(self.waiting // self.per_block * self.per_block)

    def _put(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.empty(0, "<u4")
        for i in range(0, n, self.per_block):
            self.blocks.append(self.file.size)
            self.file.write(pack(ids[i : min(n, i + self.per_block)], self.bits))
        self.rest, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> dict:
        self._put(self.waiting)
        at = self.file.size
        self.file.write(np.asarray(self.blocks, dtype="<u8").tobytes())
        none = np.iinfo(np.int64).min  # a null doc_id
        table = np.array([(none if d is None else d, s, n) for d, s, n in self.docs], dtype=[("doc", "<i8"), ("start", "<u8"), ("n", "<u8")])
        self.file.write(table.tobytes())
        self.file.write(FOOTER.pack(at, len(self.blocks), len(self.docs), MAGIC))
        self.file.commit()
        return {"file": self.name, "documents": len(self.docs), "ids": self.n, "bytes": self.file.size}


class Reader:
    """Random access to one file: `docs` lists (doc_id, start, n), `ids(start, n)` reads only the blocks it needs."""

    def __init__(self, folder: str, name: str):
        store, path = files.at(folder)
        self.f = store.open_input_file(f"{path}/{name}")
        size = self.f.size()
        at, n_blocks, n_docs, magic = FOOTER.unpack(self.f.read_at(FOOTER.size, size - FOOTER.size))
        head = HEADER.unpack(self.f.read_at(HEADER.size, 0))
        if magic != MAGIC or head[0] != MAGIC:
            raise ValueError(f"{name} is not a token file, or is cut off")
        self.bits, self.per_block, self.end = head[1], head[2], at
        tail = self.f.read_at(size - FOOTER.size - at, at)
        self.blocks = np.frombuffer(tail[: 8 * n_blocks], dtype="<u8")
        self.docs = np.frombuffer(tail[8 * n_blocks :], dtype=[("doc", "<i8"), ("start", "<u8"), ("n", "<u8")])
        assert len(self.docs) == n_docs

    def ids(self, start: int, n: int) -> np.ndarray:
        if not n:
            return np.empty(0, "<u4")
        first, last = start // self.per_block, (start + n - 1) // self.per_block
        begin, stop = int(self.blocks[first]), int(self.blocks[last + 1]) if last + 1 < len(self.blocks) else self.end
        data = self.f.read_at(stop - begin, begin)
        each = -(-self.per_block * self.bits // 8)
        out, skip = [], start - first * self.per_block
        for k in range(last - first + 1):
            take = min(n, self.per_block - skip)
            out.append(unpack(data[k * each : (k + 1) * each], self.bits, take, skip))
            n, skip = n - take, 0
        return out[0] if len(out) == 1 else np.concatenate(out)


def encoder(tokenizer: str) -> tuple[Splitter, Values]:
    """Words and their values, ids as little-endian bytes."""
    split = Splitter(tokenizer)
    merged = Encoder(split)
    return split, Values(lambda ws: [array("I", ids).tobytes() for ids in merged(ws)], 150_000)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, shard_chars: int = 48 << 20, roll: int = 64 << 20) -> DataFrame:
    """Writes docs (doc_id, text) below folder in ascending doc_id; the manifest. tokenizer: a path that every executor has."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, cells = shards.plan(rows.select("doc_id", F.octet_length("text").alias("n")), "doc_id", F.col("n") + 64, shard_chars)
    dealt = shards.deal(rows, "doc_id", cells, n).sortWithinPartitions("shard", "doc_id", "text")
    end = np.array([] if end_id is None else [end_id], dtype="<u4")
    schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def put(batches):
        split, values = Kept.get(tokenizer, lambda: encoder(tokenizer))
        bits = bits_for(max(split.tokenizer.get_vocab_size(), (end_id or 0) + 1))
        out, shard, part = None, None, 0
        row = lambda: pa.RecordBatch.from_pylist([out.close() | {"shard": shard, "part": part}], schema=schema)
        try:
            for batch in batches:
                at, doc_ids, texts = (batch.column(c).to_pylist() for c in ("shard", "doc_id", "text"))
                i = 0
                for some in in_groups(texts):
                    group = split.group(some)
                    ids, upto = gathered(values.of(group.words), group)
                    for a, b in zip([0, *upto.tolist()], upto.tolist(), strict=False):
                        if out and (at[i] != shard or out.file.size >= roll):
                            whole, out = row(), None
                            yield whole
                            part = part + 1 if at[i] == shard else 0
                        if out is None:
                            shard = at[i]
                            out = Writer(folder, f"ids-{shard:05d}-{part:05d}.bin", bits)
                        out.add(doc_ids[i], np.concatenate([ids[a:b], end]))
                        i += 1
            if out:
                whole, out = row(), None
                yield whole
        finally:
            if out:  # the task has failed
                out.file.abort()

    mapped(dealt, put, MANIFEST, "token-files").write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per file: ordering them in one task is bounded by the number of files, not of documents
    first = manifest.withColumn("first", F.coalesce(F.sum("ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = written(first.select("file", "first", "documents"), "token-files")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def get(batches):
        none = np.iinfo(np.int64).min
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                r = Reader(folder, name)
                # read in stretches of whole documents, so that blocks are unpacked once
                docs, i = r.docs, 0
                while i < len(docs):
                    j, base = i + 1, int(docs["start"][i])
                    while j < len(docs) and int(docs["start"][j] + docs["n"][j]) - base <= 1 << 20 and j - i < 8192:
                        j += 1
                    ids = r.ids(base, int(docs["start"][j - 1] + docs["n"][j - 1]) - base)
                    crc = [zlib.crc32(ids[int(s) - base : int(s) - base + int(n)].tobytes()) for s, n in zip(docs["start"][i:j], docs["n"][i:j], strict=True)]
                    ids_of = [None if d == none else int(d) for d in docs["doc"][i:j]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids_of, pa.int64()), pa.array(docs["start"][i:j].astype("i8") + before), pa.array(docs["n"][i:j].astype("i8")), pa.array(crc, pa.int64())], schema=schema
                    )
                    i = j

    return mapped(first.repartition(max(1, first.count()), "file"), get, "doc_id long, start long, n_tokens long, ids_crc32 long", "token-files")
