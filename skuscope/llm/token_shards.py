"""Token ids as bit-packed shard files (operator 7).

A shard holds the ids of a range of documents, each id in the fewest bits that the
vocabulary needs, in blocks of ``BLOCK_IDS``. Every block starts at a byte, so block k is
read by its offset alone and unpacked by vectorised shifts; any id or document is reached
without reading what precedes it. Layout, little-endian:

    magic "IDPK1\\0", bits u16 | blocks | doc_ids i64, document starts u64 (n + 1) |
    block offsets u64 (k + 1) | n_docs u64, n_ids u64, n_blocks u64, footer offset u64

Documents are dealt to shards by ranges of doc_id and sorted, so shards in number order
hold the documents in ascending order; a shard's base is the sum of the shards before it.
A shard is written under a name of its attempt and moved into place, so a retried or lost
task leaves no partial file. Names carry no host path: any store pyarrow reaches will do.

Cases: null text counts as empty (one end id); rows sharing a doc_id lie side by side in
text order; null ids come first and read back as null; an empty table gives no shard and
an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path
from .library_tokens import encoder, texts_of

MAGIC, BLOCK_IDS = b"IDPK1\0", 1 << 16
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = ((ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{bits // 8}", count=count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Appends documents to one shard; memory holds one block and the document index."""

    def __init__(self, uri: str, name: str, bits: int):
        self.fs, root = _store(uri)
        self.fs.create_dir(root, recursive=True)
        self.final, self.name = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.bits = self.fs.open_output_stream(self.name), bits
        self.out.write(MAGIC + struct.pack("<H", bits))
        self.at, self.total = len(MAGIC) + 2, 0
        self.docs, self.starts, self.offsets = [], [0], [self.at]
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc is None else doc)
        self.total += len(ids)
        self.starts.append(self.total)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            flat = np.concatenate(self.held)
            whole = len(flat) - len(flat) % BLOCK_IDS
            for lo in range(0, whole, BLOCK_IDS):
                self._block(flat[lo : lo + BLOCK_IDS])
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.out.write(raw)
        self.at += len(raw)
        self.offsets.append(self.at)

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        for values, kind in ((self.docs, "<i8"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.write(struct.pack("<4Q", len(self.docs), self.total, len(self.offsets) - 1, self.at))
        self.out.close()
        self.fs.move(self.name, self.final)
        return len(self.docs), self.total


class ShardReader:
    """Random access to one shard."""

    def __init__(self, uri: str, name: str):
        filesystem, root = _store(uri)
        self.file = filesystem.open_input_file(f"{root}/{name}")
        head = self.file.read_at(len(MAGIC) + 2, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"not a token shard: {name}")
        self.bits = struct.unpack("<H", head[len(MAGIC) :])[0]
        size = self.file.size()
        n, self.total, blocks, at = struct.unpack("<4Q", self.file.read_at(32, size - 32))
        raw = self.file.read_at(size - 32 - at, at)
        self.docs = np.frombuffer(raw, "<i8", n)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, 8 * (2 * n + 1)).astype(np.int64)
        self.cache: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, k: int) -> np.ndarray:
        if self.cache[0] != k:
            raw = self.file.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            self.cache = (k, unpack_bits(raw, self.bits, min(BLOCK_IDS, int(self.total) - k * BLOCK_IDS)))
        return self.cache[1]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1 of the shard."""
        parts = []
        for k in range(lo // BLOCK_IDS, -(-hi // BLOCK_IDS) if hi > lo else 0):
            base = k * BLOCK_IDS
            parts.append(self.block(k)[max(lo - base, 0) : hi - base])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_shards(docs: DataFrame, uri: str, path: str, end_id: int) -> list[tuple]:
    """Writes all documents; returns (shard, n_docs, n_ids, base) of each shard (one a partition)."""

    def run(batches):
        from pyspark import TaskContext

        tok, writer = encoder(path), None
        name = f"shard-{TaskContext.get().partitionId():06d}.idpk"
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                for doc, ids in zip(part.column(0).to_pylist(), tok.encode(texts_of(part.column(1)))):
                    writer = writer or ShardWriter(uri, name, bits_for(max(tok.size, end_id + 1)))
                    writer.add(doc, np.concatenate([ids, end]))
        if writer:
            n, total = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [name], "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    found = sorted(tuple(r) for r in rows.mapInArrow(run, "shard string, n_docs long, n_ids long").collect())  # a row a shard
    out, base = [], 0
    for shard, n, ids in found:
        out.append((shard, n, ids, base))
        base += ids
    return out


def read_shards(spark, uri: str, shards: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches):
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(uri, shard)
                for lo in range(0, len(reader.docs), 2048):
                    hi = min(lo + 2048, len(reader.docs))
                    at = reader.starts[lo : hi + 1]
                    crc = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(lo, hi)]
                    ids = reader.docs[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame([(s, b) for s, _, _, b in shards], "shard string, base long")
    return listed.repartition(max(1, len(shards))).mapInArrow(run, kind)


def op7_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    uri = scratch_path(spark, "token-shards")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(spark, uri, write_shards(docs, uri, P.path("byte_bpe_50k.json"), end_id=2))
