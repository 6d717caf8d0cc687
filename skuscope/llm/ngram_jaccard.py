"""N-gram Jaccard self-join of documents (operator 3).

Rare-first prefix filtering: shingles are ordered by document frequency, a document indexes
only the first n - ceil(t n) + 1 of them, and documents sharing an indexed shingle are
candidates. Frequencies are counted over every document: a sketch of fixed size bounds each
shingle's from above, and those whose bound reaches a 2^18th of all shingles are then counted
exactly, so at most 2^18 heavy shingles are broadcast. Light shingles come first, by their
bound, then the heavy ones by exact frequency, ties by hash.
Length, positional and suffix filters prune candidate pairs before any set is fetched;
each surviving pair is verified once on the exact sets (64-bit shingle hashes).

Cases: null or blank text has an empty set and links with nothing; fewer than k words
give one shingle; equal sets are one class before the join, so copies never multiply;
rows repeating a doc_id are one node with the links of all their texts; a null doc_id links
with nothing (null component); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, in_bitmap, key_bitmap, materialize, mix, roots, shingle_sets, small_batches, sorted_groups, tile_groups

SKETCH_BITS, SLICES = 20, 16
#: At most 2^HEAVY_BITS shingles have a 2^HEAVY_BITS-th of all occurrences.
HEAVY_BITS = 18
PARITY_BITS = 512
#: Sets above this size also carry their hash partitions' counts (mod 256), one byte each.
LONG = 1024


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Document frequencies of shingles, by hash slot (2^20 counters, 4 MB)."""
    size = 1 << SKETCH_BITS
    part = size // SLICES

    def count(batches):
        total = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            held, n = [], 0
            for s in shingle_sets(batch.column(0), k):
                held.append(s)
                n += len(s)
                if n > 500_000:
                    total += np.bincount(np.concatenate(held) & np.uint64(size - 1), minlength=size).astype(np.uint32)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held) & np.uint64(size - 1), minlength=size).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_pydict(
                {"slice": pa.array(range(SLICES), pa.int32()),
                 "counts": pa.array([zlib.compress(total[i * part : (i + 1) * part].tobytes(), 1) for i in range(SLICES)], pa.binary())}
            )

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.setdefault(i, np.zeros(part, dtype=np.uint64))
                total[i] += np.frombuffer(zlib.decompress(raw), dtype=np.uint32)
        for i, c in total.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "counts": pa.array([c.tobytes()], pa.binary())})

    kind = "slice int, counts binary"
    rows = docs.select("text").mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect()
    out = np.zeros(size, dtype=np.uint32)
    for i, raw in rows:
        out[i * part : (i + 1) * part] = np.minimum(np.frombuffer(raw, dtype=np.uint64), 2**32 - 1)
    return out


def heavy_shingles(docs: DataFrame, k: int, sketch, least: int):
    """(sorted hashes, frequencies) of the shingles in at least ``least`` documents, exact."""

    def run(batches):
        freq, mask = sketch.value, np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            held = [s[freq[s & mask] >= least] for s in shingle_sets(batch.column(0), k)]
            if held:
                found, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_pydict({"s": pa.array(found.view(np.int64)), "n": pa.array(n, pa.int64())})

    found = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    got = found.toPandas()  # at most 2^HEAVY_BITS rows
    keys = got["s"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["n"].to_numpy(dtype=np.int64)[order]


def rare_first(s: np.ndarray, freq: np.ndarray, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Order of a set's shingles: light ones by their bound, heavy ones by frequency, ties by hash."""
    rank = freq[s & np.uint64(len(freq) - 1)].astype(np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        hit = keys[at] == s
        rank[hit] = times[at[hit]] + (1 << 40)
    return np.lexsort((s, rank))


def describe(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, parity, counts, prefix) of each row."""
    held = docs.sparkSession.sparkContext.broadcast
    counts = frequency_sketch(docs, k)
    sketch = held(counts)
    heavy = held(heavy_shingles(docs, k, sketch, max(2, -(-int(counts.sum(dtype=np.uint64)) >> HEAVY_BITS))))

    def run(batches):
        freq, (keys, times) = sketch.value, heavy.value
        for batch in batches:
            n, f1, f2, parity, counts, prefix, at = [], [], [], [], [], [], [0]
            for s in shingle_sets(batch.column(1), k):
                m = len(s)
                n.append(m)
                x, y = digests(s)
                f1.append(x)
                f2.append(y)
                count = np.bincount((s >> np.uint64(40)) & np.uint64(PARITY_BITS - 1), minlength=PARITY_BITS).astype(np.uint8)
                parity.append(np.packbits(count & 1).view(np.int64))
                counts.append(count.tobytes() if m > LONG else b"")
                p = m - -(-num * m // den) + 1 if m else 0
                prefix.append(s[rare_first(s, freq, keys, times)[:p]].view(np.int64))
                at.append(at[-1] + p)
            rows = batch.num_rows
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            bits = np.concatenate(parity) if parity else np.zeros(0, np.int64)
            words = PARITY_BITS // 64
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()),
                    signed(f1), signed(f2),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, rows * words + 1, words), pa.int32()), pa.array(bits)),
                    pa.array(counts, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "n_shingles", "f1", "f2", "parity", "counts", "prefix"],
            )

    kind = "doc_id long, n_shingles long, f1 long, f2 long, parity array<long>, counts binary, prefix array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def overlaps(a: list[np.ndarray], b: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Intersection sizes of every set of ``a`` with every set of ``b``, by blocks of columns."""
    if len(a) == len(b) == 1:
        return np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]])
    left, right = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(both):
        return out.astype(np.int64)

    def columns(sets, flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[col] == flat
        return row[hit], col[hit]

    (ra, ca), (rb, cb) = columns(a, left), columns(b, right)
    for lo in range(0, len(both), chunk):
        m = []
        for n, r, c in ((len(a), ra, ca), (len(b), rb, cb)):
            x = np.zeros((n, chunk), dtype=np.float32)
            sel = (c >= lo) & (c < lo + chunk)
            x[r[sel], c[sel] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


def screen(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (ti, tj, tile, id) of (..., size, parity, counts) that some row of the other side may link with.

    Length filter, and suffix filter on whole groups: sets differ by at least the sum over
    hash partitions of the circular distance of their counts (mod 2 for all, mod 256 for long sets).
    """
    words = PARITY_BITS // 64

    def run(batches):
        for (ti, tj), t in sorted_groups(batches, ["ti", "tj"]):
            tile, n = t["tile"].to_numpy(), t["size"].to_numpy()
            parity = t["parity"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
            counts = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in t["counts"]]
            long = np.array([len(c) > 0 for c in counts])
            own = np.flatnonzero(tile == ti)
            other = own if ti == tj else np.flatnonzero(tile == tj)
            keep = np.zeros(len(n), dtype=bool)
            far = other[long[other]]
            table = np.stack([counts[j] for j in far]) if len(far) else None
            for lo in range(0, len(own), 64):
                part = own[lo : lo + 64]
                total = n[part][:, None] + n[other][None, :]
                apart = np.bitwise_count(parity[part][:, None, :] ^ parity[other][None, :, :]).sum(axis=2, dtype=np.int64)
                ok = (apart * (num + den) <= total * (den - num)) & (np.minimum(n[part][:, None], n[other][None, :]) * den >= np.maximum(n[part][:, None], n[other][None, :]) * num)
                ok &= part[:, None] != other[None, :]
                if table is not None:
                    for r in np.flatnonzero(long[part]).tolist():
                        d = table - counts[part[r]][None, :]
                        off = np.minimum(d, np.negative(d)).sum(axis=1, dtype=np.int64)
                        ok[r, long[other]] &= off * (num + den) <= (n[far] + n[part[r]]) * (den - num)
                keep[part] |= ok.any(axis=1)
                keep[other] |= ok.any(axis=0)
            if keep.any():
                yield from t.select(["ti", "tj", "tile", "id"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return groups.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(run, "ti long, tj long, tile long, id long")


def verify(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that span the true links within each (ti, tj) of (ti, tj, tile, id, grams)."""

    def run(batches):
        for (ti, tj), t in sorted_groups(batches, ["ti", "tj"]):
            ids, tile = t["id"].to_numpy(), t["tile"].to_numpy()
            sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in t["grams"]]
            n = np.array([len(s) for s in sets])
            order = np.argsort(ids)
            own = [i for i in order if tile[i] == ti]
            other = own if ti == tj else [i for i in order if tile[i] != ti]
            if not own or not other or (ti == tj and len(own) < 2):
                continue
            inter = overlaps([sets[i] for i in own], [sets[i] for i in other])
            hit = den * inter >= num * (n[own][:, None] + n[other][None, :] - inter)
            if ti == tj:
                nodes, adj = ids[own], hit
            else:
                every = np.concatenate([own, other])
                pos = np.argsort(ids[every])
                nodes, k = ids[every][pos], len(own)
                adj = np.zeros((len(every), len(every)), dtype=bool)
                adj[:k, k:], adj[k:, :k] = hit, hit.T
                adj = adj[np.ix_(pos, pos)]
            low = roots(adj)
            far = np.flatnonzero(low != np.arange(len(low)))
            if len(far):
                yield pa.RecordBatch.from_pydict({"a": pa.array(nodes[far]), "b": pa.array(nodes[low[far]])})

    return groups.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(run, "a long, b long")


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set: its 128-bit fingerprint."""
    return int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64))


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def fetch_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(id, grams) of the needed classes (id, doc, f1, f2, size), read again from a text of each.

    A bitmap of the chosen rows' doc_ids keeps the other texts from being cut into shingles.
    """
    bitmap = key_bitmap(needed, "doc")

    def run(batches):
        for batch in batches:
            keep = in_bitmap(bitmap.value, batch.column(0).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            for lo in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.slice(lo, 256).column(1), k))
                f1, f2 = zip(*map(digests, sets))
                yield pa.RecordBatch.from_arrays(
                    [signed(f1), signed(f2), pa.array(map(len, sets), pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["f1", "f2", "size", "grams"]
                )

    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = ids.mapInArrow(run, "f1 long, f2 long, size long, grams binary")
    return found.join(needed.select("id", "f1", "f2", "size"), ["f1", "f2", "size"]).groupBy("id").agg(F.first("grams").alias("grams"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked when den*|A∩B| >= num*|A∪B|."""
    small_batches(docs.sparkSession)
    info = materialize(describe(docs, k, num, den), "shingles")
    full = info.filter("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "parity", "counts", "prefix")).alias("r"))
    reps = reps.select(F.monotonically_increasing_id().alias("id"), F.col("r.doc_id").alias("doc"), F.col("n_shingles").alias("size"), "f1", "f2", "r.parity", "r.counts", "r.prefix")
    reps = materialize(reps, "classes")  # ids are fixed by being written
    postings = reps.select("id", "size", F.posexplode("prefix").alias("pos", "g"))

    def near(a, b):
        """Length and positional filters; both are exact bounds."""
        length = F.least(a["size"], b["size"]) * den >= F.greatest(a["size"], b["size"]) * num
        ahead = F.least(a["pos"], b["pos"]) + 1 + F.least(a["size"] - a["pos"] - 1, b["size"] - b["pos"] - 1)
        return length & (ahead * (num + den) >= (a["size"] + b["size"]) * num)

    def suffix(pairs: DataFrame) -> DataFrame:
        """Suffix filter: parities of the sets' hash partitions bound their difference from below."""
        for c in ("a", "b"):
            pairs = pairs.join(reps.select(F.col("id").alias(c), F.col("parity").alias(f"p{c}")), c)
        apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return pairs.filter(apart * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b", "na", "nb")

    marks = reps.select("id", "size", "parity", "counts")
    tiles = tile_groups(postings, near, suffix)
    groups = materialize(screen(tiles.join(marks, "id").select("ti", "tj", "tile", "id", "size", "parity", "counts"), num, den), "groups")
    needed = materialize(groups.select("id").distinct().join(reps.select("id", "doc", "f1", "f2", "size"), "id"), "needed")
    links = materialize(verify(groups.join(fetch_sets(docs, needed, k), "id"), num, den), "links")
    member = full.select("doc_id", "f1", "f2", "n_shingles").join(reps.select("f1", "f2", F.col("size").alias("n_shingles"), "id"), ["f1", "f2", "n_shingles"])
    member = materialize(member.select("doc_id", "id"), "members")
    several = materialize(member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("doc_id", "a"), "repeated")
    repeated = member.join(several, "doc_id").select("a", F.col("id").alias("b"))
    label = materialize(components(links.unionByName(repeated)), "labels")
    linked = reps.select("id", "doc").join(label, "id", "left").select("id", "doc", F.coalesce("component", "id").alias("component"))
    least = materialize(linked.groupBy("component").agg(F.min("doc").alias("least")), "smallest")
    linked = materialize(linked.join(least, "component").select("id", "least"), "linked")
    own = member.join(linked, "id").groupBy("doc_id").agg(F.min("least").alias("least"))
    out = info.select("doc_id", "n_shingles").join(own.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))
    discard(tiles, groups, needed, links, several, label, least)
    return out


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, k=3, num=90, den=100)


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each near-duplicate group (5 words, 0.8) the smallest doc_id stays."""
    found = jaccard_components(docs.select("doc_id", "text"), 5, 80, 100)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
