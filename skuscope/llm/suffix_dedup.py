"""Removal of repeated byte strings by merged Burrows-Wheeler transforms (operator 11).

A byte goes if it lies in a string of ``length`` bytes that also starts earlier (in a smaller
document, or earlier in the same one). Three steps find these strings:

1. *Pieces.* Every window of ``length`` bytes has an anchor, its k-gram of smallest hash; equal
   windows have equal anchors. Runs of windows with one anchor are cut out as pieces, if a sketch
   of the repeated anchors holds theirs, and meet by anchor in one shuffle. A task remembers the
   pieces it has cut (``SEEN`` at most) and sends the text of a copy only if it starts before the one it knows. Anchors whose
   pieces may exceed ``LIMIT`` bytes go another way: their equal pieces are collapsed before they
   are shuffled, and what is left is cut anew by longer grams, level by level; at the last level a
   gram is a whole window, so that the pieces of an anchor are all equal.
2. *Merge.* A task indexes about ``PACK`` bytes of pieces at a time: the pieces of each document
   range (a shard) are sorted into a transform of their own, then the transforms are merged by
   refining their interleave: from the order of the suffixes by h symbols, one stable pass over
   the preceding symbols gives the order by h + 1, so no suffix is compared or sorted again.
   The pass at which two neighbours part is their common prefix; neighbours that are together
   after ``length`` bytes are a repeated interval. Symbols are several bytes wide, so that a
   pass refines by several bytes.
3. *Spans.* In each interval all windows but the first are covered (of equal pieces, one stands for
   all in the index, and the later ones are covered whole); a document's covered runs are put
   together and cut out of its bytes.

Cases: a null text is empty; texts shorter than ``length`` stay whole; documents are ordered by
doc_id, nulls first, those that repeat a doc_id by a hash of their text; rows that repeat both are
one document and get the same result each; very long texts are read in chunks; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, discard, in_bitmap, key_bitmap, materialize, mix, text_buffers

LENGTH = 100
#: Windows looked at in one go; bytes of an anchor's pieces, of a merge and of one shard of it.
CHUNK, LIMIT, PACK, SHARD = 1 << 17, 1 << 18, 1 << 20, 1 << 18
#: Pieces that a task remembers.
SEEN = 1 << 17
_BASE = 0x9E3779B97F4A7C17
PIECE = "m long, piece binary, doc_id long, th long, start long, windows long"


def grams(length: int) -> list[int]:
    """Bytes of the anchors, level by level."""
    return [max(1, length * i // 4) for i in (1, 2, 3, 4)]


# --------------------------------------------------------------------------- anchors
def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, put together from those of 1, 2, 4, ... bytes."""
    part, size, out, have = _BYTE[buf], 1, None, 0
    while True:
        if k & size:
            out = part if out is None else part[: len(buf) - have - size + 1] * np.uint64(pow(_BASE, have, 1 << 64)) + out[size : len(buf) - have + 1]
            have += size
        if size * 2 > k:
            break
        part = part[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    return mix(out[: len(buf) - k + 1])


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """(anchor, start, windows) arrays of consecutive texts, chunk by chunk; starts count from offsets[0]."""
    base = int(offsets[0])
    buf, cut = data[base : int(offsets[-1])], (offsets - base).astype(np.int64)
    if len(buf) < length:
        return
    inside = np.ones(len(buf) - length + 1, dtype=bool)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        inside[max(lo, hi - length + 1) : hi] = False
    width, low = length - k + 1, np.uint64(CHUNK * 2 - 1)
    for at in range(0, len(inside), CHUNK):
        part = buf[at : at + CHUNK + length - 1]
        ok = inside[at : at + CHUNK]
        if not ok.any():
            continue
        gram = gram_hashes(part, k)
        least = gram & ~low | np.arange(len(gram), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(ok)], least[width - size : width - size + len(ok)])
        place = (least[: len(ok)] & low).astype(np.int64)
        turn = np.empty(len(ok), dtype=bool)
        turn[0] = True
        turn[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
        turn &= ok
        first = np.flatnonzero(turn)
        stop = np.empty(len(ok), dtype=bool)
        stop[-1] = True
        stop[:-1] = turn[1:] | ~ok[1:]
        last = np.flatnonzero(stop & ok)
        yield gram[place[first]].view(np.int64), first + at, last - first + 1


def anchors(documents: DataFrame, length: int, k: int) -> DataFrame:
    """(m, n): anchors of all windows of (text), counted a batch at a time."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for m, _, _ in pieces_of(data, offsets, length, k):
                m, n = np.unique(m, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(n)], ["m", "n"])

    return documents.select("text").mapInArrow(run, "m long, n long")


def cut_pieces(rows: DataFrame, length: int, k: int, bits=None) -> DataFrame:
    """Pieces of (seed, text, doc_id, th, start), ``start`` being the text's own in its document.

    A piece is null if the task has seen an equal one that starts earlier; its anchor is then a hash of its place.
    """

    def run(batches):
        seen: dict[bytes, tuple] = {}
        for batch in batches:
            data, offsets = binary_buffers(batch.column(1))
            base, cut = int(offsets[0]), (offsets - offsets[0]).astype(np.int64)
            seed, begin, th = (batch.column(c).to_numpy() for c in (0, 4, 3))
            ids = batch.column(2).to_pylist()
            doc = [(i is not None, i or 0, t) for i, t in zip(ids, th.tolist())]
            for m, first, windows in pieces_of(data, offsets, length, k):
                if bits is not None:
                    kept = in_bitmap(bits.value, m)
                    m, first, windows = m[kept], first[kept], windows[kept]
                if not len(m):
                    continue
                owner = np.searchsorted(cut, first, side="right") - 1
                raw = data[base + int(first[0]) : base + int(first[-1] + windows[-1]) + length - 1].tobytes()
                ends = first + windows + length - 1 - first[0]
                start, m, piece = begin[owner] + first - cut[owner], m ^ seed[owner], []
                for a, b, o, s in zip((first - first[0]).tolist(), ends.tolist(), owner.tolist(), start.tolist()):
                    text, place = raw[a:b], (*doc[o], s)
                    if seen.setdefault(text, place) < place:
                        piece.append(None)
                        continue
                    seen[text] = place
                    piece.append(text)
                if len(seen) > SEEN:
                    seen = {}
                piece = pa.array(piece, pa.binary())
                settled = piece.is_null().to_numpy(zero_copy_only=False)
                m = np.where(settled, mix((start + th[owner]).view(np.uint64)).view(np.int64), m)
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(m), piece, batch.column(2).take(own), batch.column(3).take(own), pa.array(start), pa.array(windows)], ["m", "piece", "doc_id", "th", "start", "windows"])

    return rows.mapInArrow(run, PIECE)


def binary_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8), offsets


# --------------------------------------------------------------------------- transforms
class Pieces:
    """Strings laid out one after another, each with an end row of its own; ``ends`` are the rows less than a symbol from theirs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        size = np.diff(offsets)
        self.begin = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.zeros(int(self.begin[-1]), dtype=np.uint8)
        rows = np.ones(len(text), dtype=bool)
        rows[self.begin[1:] - 1] = False
        text[rows] = data[int(offsets[0]) : int(offsets[-1])]
        self.owner = np.repeat(np.arange(len(size)), size + 1)
        at = np.arange(len(text))
        self.past, self.left = at - self.begin[self.owner], self.begin[self.owner + 1] - 1 - at
        for wide in (w for w in (5, 4, 3, 2, 1) if length % w == 0):
            whole = np.flatnonzero(self.left >= wide)
            key = np.zeros(len(whole), dtype=np.uint64)
            for j in range(wide):
                key = key << np.uint64(8) | text[whole + j]
            kinds, rank = np.unique(key, return_inverse=True)
            if len(kinds) < 65535:  # 65535 marks rows before which no symbol lies
                break
        self.wide, self.symbol = wide, np.zeros(len(text), dtype=np.uint16)
        self.symbol[whole] = rank
        self.is_end, self.is_head = self.left < wide, self.past < wide

    def order(self, lo: int, hi: int) -> np.ndarray:
        """Rows of the strings lo..hi in the order of their suffixes (ends first, by place), by prefix doubling."""
        a, b = int(self.begin[lo]), int(self.begin[hi])
        end = self.is_end[a:b]
        n, ends = b - a, np.flatnonzero(end)
        rest = np.flatnonzero(~end)
        rest = rest[np.argsort(self.symbol[a:b][rest], kind="stable")]
        order = np.concatenate([ends, rest])
        rank = np.empty(n, dtype=np.int64)
        rank[ends] = np.arange(len(ends))
        value = self.symbol[a:b][rest]
        slots, fresh, step = np.arange(len(ends), n), np.concatenate([[True], value[1:] != value[:-1]])[: len(rest)], self.wide
        while len(slots):
            group = np.cumsum(fresh) - 1
            head = slots[np.flatnonzero(fresh)]
            rank[order[slots]] = head[group]
            several = np.bincount(group)[group] > 1
            slots = slots[several]
            rows = order[slots]
            major, minor = rank[rows], rank[rows + step]
            turn = np.argsort(major * n + minor, kind="stable")
            order[slots], major, minor = rows[turn], major[turn], minor[turn]
            fresh = np.ones(len(slots), dtype=bool)
            fresh[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
            step *= 2
        return order + a

    def merge(self, orders: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, common): all rows by their first ``length`` bytes, and the bytes each shares with the row before it
        (in whole symbols, at most ``length``), from the shards' orders.

        A shard's transform is the symbol before each of its rows. The interleave says from which shard
        the next row comes; a pass visits it in order, takes each shard's symbols one by one, and lets the
        rows fall behind their symbols. Blocks of rows with equal prefixes keep their bounds from pass to pass.
        """
        rows = np.concatenate(orders)
        head = self.is_head[rows]
        before = np.where(head, np.uint16(65535), self.symbol[np.where(head, 0, rows - self.wide)])
        n, heads = len(rows), int(head.sum())
        shard = np.repeat(np.arange(len(orders), dtype=np.uint8), [len(o) for o in orders])
        ends = shard[self.is_end[rows]]
        common = np.full(n, length, dtype=np.int32)
        common[:1] = 0
        block, bounds = np.zeros(n, dtype=np.int32), 1
        symbol, fresh = np.empty(n, dtype=np.uint16), np.ones(n, dtype=bool)
        for depth in range(length // self.wide):
            symbol[np.argsort(shard, kind="stable")] = before
            turn = np.argsort(symbol, kind="stable")[: n - heads]
            behind, near = symbol[turn], block[turn]
            last, shard = shard, np.concatenate([ends, shard[turn]])
            fresh[len(ends) + 1 :] = (behind[1:] != behind[:-1]) | (near[1:] != near[:-1])
            common[fresh & (common == length)] = depth * self.wide
            block = np.cumsum(fresh, dtype=np.int32)
            was, bounds = bounds, int(block[-1]) if n else 0
            if was == bounds and (last == shard).all():
                break  # nothing parts any more
        out = np.empty(n, dtype=np.int64)
        out[np.argsort(shard, kind="stable")] = rows
        return out, common


def covered(data: np.ndarray, offsets: np.ndarray, place: np.ndarray, length: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, windows) of the runs of windows that some string holds at an earlier place.

    ``place`` orders the strings' first bytes; strings come in that order, shard by shard.
    """
    held = Pieces(data, offsets, length)
    size = held.begin[-1]
    edges = np.searchsorted(held.begin, np.arange(0, size + shard, max(shard, int(size) // 250 + 1))).clip(0, len(place))  # at most 256 shards
    edges = np.unique(np.concatenate([[0], edges, [len(place)]]))
    rows, common = held.merge([held.order(lo, hi) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist())], length)
    at = place[held.owner] + held.past
    low = np.minimum.reduceat(at[rows], np.flatnonzero(common < length)) if len(rows) else at
    block = np.cumsum(common < length) - 1
    out = np.zeros(len(rows) + 1, dtype=bool)
    out[rows] = (at[rows] > low[block]) & (held.left[rows] >= length)
    change = np.flatnonzero(out[1:] != out[:-1]) + 1
    change = np.concatenate([[0], change]) if out[0] else change
    first, stop = change[::2], change[1::2]
    return held.owner[first], held.past[first], stop - first


def index(pieces: DataFrame, length: int, pack: int, shard: int) -> DataFrame:
    """(doc_id, th, start, windows): covered runs of the pieces, which meet by anchor."""

    def settle(t: pa.Table):
        """Covered runs of whole anchors: copies settled before, later ones of equal pieces, and what the index finds."""
        known, doc, th = ~t["doc_id"].is_null().to_numpy(zero_copy_only=False), t["doc_id"].fill_null(0).to_numpy(), t["th"].to_numpy()
        start, m = t["start"].to_numpy(), t["m"].to_numpy()
        kind = t["piece"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        order = np.lexsort((start, th, doc, known, kind))
        last, here = order[:-1], order[1:]
        equal, again = np.zeros(len(m), dtype=bool), np.zeros(len(m), dtype=bool)
        equal[here] = kind[here] == kind[last]
        again[here] = equal[here] & (start[here] == start[last]) & (th[here] == th[last]) & (doc[here] == doc[last]) & (known[here] == known[last])  # of a repeated row
        copy = equal & ~again | (kind < 0)
        rest = np.flatnonzero(~equal & (kind >= 0))
        _, place, size = np.unique(m[rest], return_inverse=True, return_counts=True)
        rest = rest[size[place] > 1]  # a piece alone has none to share with
        rest = rest[np.lexsort((start[rest], th[rest], doc[rest], known[rest]))]
        out = [t.filter(pa.array(copy)).select(["doc_id", "th", "start", "windows"])]
        if len(rest):
            new = np.ones(len(rest), dtype=bool)
            new[1:] = (known[rest[1:]] != known[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]]) | (th[rest[1:]] != th[rest[:-1]])
            chosen = t.take(pa.array(rest))
            data, offsets = binary_buffers(chosen["piece"].combine_chunks())
            owner, first, windows = covered(data, offsets, (np.cumsum(new) << 40) + start[rest], length, shard)
            own = chosen.take(pa.array(owner))
            out.append(pa.table({"doc_id": own["doc_id"], "th": own["th"], "start": start[rest][owner] + first, "windows": windows}))
        yield from pa.concat_tables(out).combine_chunks().to_batches()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(1).nbytes
            if size < pack:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            m = t["m"].to_numpy()
            edges = np.flatnonzero(m[1:] != m[:-1]) + 1
            lo, offsets = 0, binary_buffers(t["piece"].combine_chunks())[1]
            weight = offsets[1:] - offsets[0]
            while True:  # whole anchors, about ``pack`` bytes at a time
                done = int(weight[lo - 1]) if lo else 0
                k = int(np.searchsorted(weight[edges - 1], done + pack)) if len(edges) else 0
                if k >= len(edges):
                    break
                yield from settle(t.slice(lo, int(edges[k]) - lo))
                lo = int(edges[k])
            held, size = t.slice(lo).to_batches(), int(weight[-1]) - done
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    return pieces.repartition("m").sortWithinPartitions("m").mapInArrow(run, "doc_id long, th long, start long, windows long")


# --------------------------------------------------------------------------- tables
def named(documents: DataFrame) -> DataFrame:
    """(doc_id, text, th): th tells rows apart that repeat a doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))


def repeated_runs(documents: DataFrame, length: int = LENGTH, limit: int | None = None, pack: int | None = None, shard: int | None = None) -> DataFrame:
    """(doc_id, th, start, windows): runs of windows that start earlier too, of (doc_id, text, th)."""
    limit, pack, shard = limit or LIMIT, pack or PACK, shard or SHARD
    levels, runs, zero = grams(length), [], F.lit(0).cast("long")
    several = materialize(anchors(documents, length, levels[0]).groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    pieces = cut_pieces(documents.select(zero.alias("seed"), "text", "doc_id", "th", zero.alias("start")), length, levels[0], key_bitmap(several, "m"))
    heavy = several.filter(F.col("n") > limit // length).select("m")
    for k in levels[1:]:
        heavy = materialize(heavy, "heavy-anchors")
        if heavy.isEmpty():
            break
        runs.append(index(pieces.join(heavy, "m", "left_anti"), length, pack, shard))
        hot = materialize(pieces.join(heavy, "m", "left_semi"), "heavy-pieces")
        first = hot.groupBy("m", "piece").agg(F.min(F.struct("doc_id", "th", "start")).alias("f"))
        first = materialize(first.select("m", "piece", "f.doc_id", "f.th", "f.start"), "first-pieces")
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("doc_id", "th", "start")]
        runs.append(hot.alias("p").join(first.select("doc_id", "th", "start").alias("f"), same[0] & same[1] & same[2], "left_anti").select("doc_id", "th", "start", "windows"))
        pieces = materialize(cut_pieces(first.select(F.col("m").alias("seed"), F.col("piece").alias("text"), "doc_id", "th", "start"), length, k), "pieces")
        heavy = pieces.groupBy("m").agg(F.sum(F.octet_length("piece")).alias("size")).filter(F.col("size") > (limit if k < length else 1 << 62)).select("m")
    runs.append(index(pieces, length, pack, shard))
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    out = materialize(out, "runs")
    discard(several)
    return out


def cut_out(documents: DataFrame, length: int = LENGTH, **sizes) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the bytes of each row that stay, and the maximal removed runs (begin, end)."""
    docs = named(documents)
    runs = repeated_runs(docs, length, **sizes)
    runs = runs.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("windows"))
    held = docs.join(runs, (F.col("th") == F.col("of_th")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "starts", "windows")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            cut, kept, spans = offsets.tolist(), [], []
            for row, (starts, windows) in enumerate(zip(batch.column(2), batch.column(3))):
                body = data[cut[row] : cut[row + 1]]
                if not starts.is_valid:
                    kept.append(body.tobytes())
                    spans.append([])
                    continue
                begin = starts.values.to_numpy()
                end = begin + windows.values.to_numpy() + length - 1
                order = np.argsort(begin, kind="stable")
                begin, reach = begin[order], np.maximum.accumulate(end[order])
                new = np.concatenate([[True], begin[1:] > reach[:-1]])
                lows, highs = begin[new].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist()
                kept.append(b"".join(body[a:b].tobytes() for a, b in zip([0, *highs], [*lows, len(body)])))
                spans.append([{"begin": a, "end": b} for a, b in zip(lows, highs)])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return held.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = cut_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, octet_length(encode(COALESCE(text, ''))) AS n, hex(encode(COALESCE(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, n, base, substr(x, 2 * base + 1, {2 * (1000 + LENGTH - 1)}) AS y FROM (SELECT doc_id, n, x, unnest(range(0, greatest(0, n - {LENGTH - 1}), 1000)) AS base FROM d)),
w AS (SELECT doc_id, base + q AS p, md5(substr(y, 2 * q + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, base, y, unnest(range(0, least(1000, n - {LENGTH - 1} - base))) AS q FROM c)),
l AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM l),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM g),
r AS (SELECT doc_id, s, min(p) AS lo, max(p) + {LENGTH} AS hi FROM i GROUP BY doc_id, s),
b AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS past FROM r),
k AS (SELECT doc_id, string_agg(substr(x, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) AS x, max(hi) AS done, sum(hi - lo) AS gone, count(*) AS spans FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(COALESCE(gone, 0) AS BIGINT) AS n_removed, CAST(COALESCE(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(COALESCE(k.x, '') || substr(d.x, 2 * COALESCE(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
