"""Packing by minimum bin slack (operator 8).

Documents are cut into full windows and one remainder each. Remainders wait in a pool of
bounded size; a window is opened with the longest one and filled by the multiset of
remaining lengths whose sum comes closest to its capacity: subset sums are the bits of an
integer, lengths enter with their counts split in powers of two, and the snapshots before
each entry give the counts back. A gap that no multiset fills is closed by cutting one
more remainder; the last window of a partition is cut into powers of two, which need no
padding.

Each input partition packs by itself, in one pass and without a shuffle, so hot sources
and long documents cost nothing special.

Cases: null text counts as empty (only the end id); a doc_id may repeat (each row is a
document of its own); null doc_id is kept as null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library_tokens import encoder, texts_of

POOL = 4096


def best_subset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset of lengths (at most ``counts`` of each) with the largest sum <= capacity."""
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            k *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


class Packer:
    """Yields pieces (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = 2048, pool: int = POOL):
        self.window, self.pool = window, pool
        self.items: dict[int, list[tuple]] = {}
        self.held = 0
        self.sequence = 0

    def add(self, doc, ids: np.ndarray):
        n = len(ids)
        full = n - n % self.window
        for s in range(0, full, self.window):
            yield doc, s, ids[s : s + self.window], n, self.sequence, 0
            self.sequence += 1
        if n > full:
            self.items.setdefault(n - full, []).append((doc, full, ids[full:].copy(), n))
            self.held += 1
        while self.held > self.pool:
            yield from self.fill()

    def pop(self, length: int) -> tuple:
        group = self.items[length]
        item = group.pop()
        if not group:
            del self.items[length]
        self.held -= 1
        return item

    def fill(self):
        first = self.pop(max(self.items))
        chosen, room = [first], self.window - len(first[2])
        if room:
            for length, k in best_subset({n: len(x) for n, x in self.items.items() if n <= room}, room).items():
                for _ in range(k):
                    chosen.append(self.pop(length))
                    room -= length
        if room and self.items:  # no multiset fits exactly: cut one more
            doc, start, ids, n = self.pop(max(self.items))
            chosen.append((doc, start, ids[:room], n))
            self.items.setdefault(len(ids) - room, []).append((doc, start + room, ids[room:], n))
            self.held += 1
            room = 0
        if room:
            yield from self.halve(chosen)
            return
        offset = 0
        for doc, start, ids, n in chosen:
            yield doc, start, ids, n, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def halve(self, chosen: list[tuple]):
        """Sequences of powers of two from what is less than one window."""
        total = sum(len(c[2]) for c in chosen)
        left, offset = 0, 0
        for doc, start, ids, n in chosen:
            at = 0
            while at < len(ids):
                if not left:
                    left, offset = 1 << (total.bit_length() - 1), 0
                    total -= left
                    self.sequence += 1
                take = min(left, len(ids) - at)
                yield doc, start + at, ids[at : at + take], n, self.sequence - 1, offset
                at, offset, left = at + take, offset + take, left - take

    def finish(self):
        while self.held:
            yield from self.fill()


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; sequence_id is the partition's number and a running one."""

    def run(batches):
        from pyspark import TaskContext

        tok, packer = encoder(path), Packer(window)
        base = TaskContext.get().partitionId() << 36
        end = np.array([end_id], dtype="<u4")

        def rows(pieces):
            cols = [[] for _ in range(7 + with_ids)]
            for doc, start, ids, n, seq, offset in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, base + seq, offset)
                for c, v in zip(cols, row):
                    c.append(v)
                if with_ids:
                    cols[7].append(ids.astype(np.int32))
                if len(cols[0]) >= 4096:
                    yield cols
                    cols = [[] for _ in cols]
            if cols[0]:
                yield cols

        def pieces():
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    for doc, ids in zip(part.column(0).to_pylist(), tok.encode(texts_of(part.column(1)))):
                        yield from packer.add(doc, np.concatenate([ids, end]))
            yield from packer.finish()

        for cols in rows(pieces()):
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, NAMES[: len(arrays)])

    kind = ", ".join(f"{n} long" for n in NAMES[:7]) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage and query: windows of 2048 tokens."""
    import public_tokenizers as P

    return pack_documents(docs, P.path("word_bpe_49k.json"))
