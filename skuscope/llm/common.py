"""Shared plumbing: durable intermediate tables, graph components, text hashing.

Everything here is bounded in memory by a batch, a tile or a sketch of a stated size;
nothing is collected to the driver except sketches of a stated size. Keys that hold many
rows are found on a sample and their rows dealt over salts, so that no task gets a key whole.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
PASS_BYTES = 1 << 18
_scratch: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only if unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what stands there is deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back (survives lost executors)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch", None)
        if path in _scratch:
            _delete(path, _scratch.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _sweep() -> None:
    for path, spark in _scratch.items():
        try:
            if spark._jsc.sc().isStopped():
                return
            _delete(path, spark)
        except Exception:  # the gateway may be gone; the folder's owner clears what is left
            return


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most a thousand rows: whole documents are wide rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- hot keys
#: Keys are counted on the members whose hash is 0 modulo EVERY; LEAST of these make a key hot.
EVERY, LEAST, PART = 64, 8, 512


def in_sample(member: str, every: int | None = None):
    return F.pmod(F.xxhash64(F.lit("hot"), member), F.lit(every or EVERY)) == 0


def hot_keys(rows: DataFrame, keys: list[str], member: str, every: int | None = None) -> DataFrame:
    """(keys, parts): keys that seem to hold many members, and over how many salts to deal them.

    Only the dealing depends on the sample; a key it misses is handled whole and gives the same rows.
    """
    every = every or EVERY
    seen = rows.filter(in_sample(member, every)).groupBy(*keys).agg(F.count("*").alias("n"))
    return materialize(seen.filter(F.col("n") >= LEAST).select(*keys, (1 + F.floor(F.col("n") * every / PART)).cast("int").alias("parts")), "hot-keys")


def salt_of(member: str, parts: str = "parts"):
    return F.pmod(F.xxhash64(F.lit("salt"), member), F.col(parts)).cast("int")


def every_salt(parts: str = "parts"):
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


# --------------------------------------------------------------------------- bitmap prefilter
#: Bits for each key, and most bits in all (32 MB); beyond that more keys pass, no result changes.
BITS_A_KEY, MOST_BITS = 16, 1 << 28


def key_bitmap(df: DataFrame, column: str):
    """Broadcast bitmap of a column's hashes, sized by its row count.

    A prefilter for semi-joins inside Arrow scans: false positives pass and are
    removed by the exact join that follows, so its size never affects results.
    """
    size = min(MOST_BITS, max(1 << 16, 1 << (BITS_A_KEY * df.count()).bit_length()))
    slices = max(1, size >> 22)
    part = size // slices

    def build(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(size - 1)
            for k in np.unique(slot // np.uint64(part)).tolist():
                bits = held.setdefault(k, np.zeros(part, dtype=bool))
                bits[(slot[slot // np.uint64(part) == k] % np.uint64(part)).astype(np.int64)] = True
        for k, bits in held.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size // 8, dtype=np.uint8)
    found = df.select(F.col(column).cast("long")).repartition(min(slices * 4, 64)).mapInArrow(build, "slice int, bits binary")
    for k, raw in found.toLocalIterator():  # pieces of at most 512 kB, ored one by one
        out[k * part // 8 : (k + 1) * part // 8] |= np.frombuffer(raw, dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


# --------------------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) as (id, component), component = smallest id.

    Alternating large-star / small-star steps: each step moves O(edges) rows and is written
    out. Minima of neighbourhoods are aggregated map-side and written before they are joined
    back, so that a hub's rows are met by a broadcast or split by the adaptive skew join.
    Ids without an edge have no row.
    """
    cur = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")

    def neighbourhood_min(sym: DataFrame) -> tuple[DataFrame, DataFrame]:
        low = materialize(sym.groupBy("u").agg(F.min("v").alias("m")), "minima")
        return sym.join(low.withColumn("m", F.least("u", "m")), "u"), low

    def state(df: DataFrame) -> tuple:
        return tuple(
            df.agg(
                F.count("*").alias("n"),
                F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
            ).first()
        )

    before = state(cur)
    while before[0]:
        sym = cur.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        near, low = neighbourhood_min(sym)
        large = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        near, least = neighbourhood_min(down)
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, cur = cur, materialize(small.filter("a <> b").distinct(), "edges")
        discard(last, low, down, least)
        after = state(cur)
        if after == before:
            break
        before = after
    return cur.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


# --------------------------------------------------------------------------- tiles
#: Most members of one tile, most of their summed sizes, and the longest posting list whose
#: pairs are listed one by one. A tile exceeds WEIGHT by about one key's or member's share.
TILE, WEIGHT, SMALL = 1024, 1 << 19, 8


def tile_groups(postings: DataFrame, near=None, refine=None, tile: int = TILE, weight: int = WEIGHT, small: int = SMALL, every: int | None = None, sampled: DataFrame | None = None) -> DataFrame:
    """Which members must be compared with which: rows (ti, tj, tile, id).

    ``postings`` has (g, id, size, ...): id carries key g. One shuffle by g counts each
    list and gives the members of a short list their single partners; ``near`` (of two
    posting structs) and ``refine`` (of pairs (a, b, na, nb), n the sizes) prune those.
    Members of long lists are dealt into tiles of about ``tile`` (of bounded summed size):
    those with the same most frequent key lie side by side, and so do keys that two rounds
    of label propagation find connected, so that most groups meet inside one tile. Each
    member goes to the tiles that its lists reach, so a list of m members in k tiles costs
    m * k rows instead of m^2 pairs. Any two members meet in at most one (ti, tj).
    The lists of hot keys are dealt over salts wherever rows meet by key; ``sampled`` may hold
    the postings of ``in_sample`` members where that is cheaper than to filter them.
    """
    hot = hot_keys(postings if sampled is None else sampled, ["g"], "id", every)
    dealt = postings.join(hot, "g", "left").withColumn("salt", F.coalesce(salt_of("id"), F.lit(0)))
    w = Window.partitionBy("g", "salt")
    order = w.orderBy("id")
    row = F.struct(*[c for c in postings.columns if c != "g"])
    after = F.array_compact(F.array(*[F.lead(row, k).over(order) for k in range(1, small)]))
    shared = dealt.withColumns({"cnt": F.count("*").over(w), "after": after}).filter("cnt > 1 or parts is not null")

    def partner(x):
        return (x["id"] > F.col("id")) & (near(row, x) if near else F.lit(True))

    found = F.transform(F.filter("after", partner), lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))
    shared = shared.withColumn("partners", F.when((F.col("cnt") <= small) & F.col("parts").isNull(), found))
    shared = shared.filter("partners is null or size(partners) > 0").withColumns({"cnt": F.coalesce((F.col("parts") * F.lit(PART)).cast("long"), "cnt"), "parts": F.coalesce("parts", F.lit(1))})
    shared = materialize(shared.select("g", "id", "size", "cnt", "partners", "parts"), "postings")
    pairs = shared.filter("partners is not null").select(F.col("id").alias("a"), F.col("size").alias("na"), F.explode("partners").alias("p"))
    pairs = pairs.select("a", F.col("p.id").alias("b"), "na", F.col("p.size").alias("nb")).distinct()
    pairs = materialize(refine(pairs) if refine else pairs, "pairs")
    lists = shared.filter("partners is null").select("g", "id", "size", "cnt", "parts")
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("na").alias("size")), F.struct(F.col("b").alias("id"), F.col("nb").alias("size")))
    both = pairs.select(F.xxhash64("a", "b").alias("g"), F.explode(ends).alias("e"), F.lit(2).cast("long").alias("cnt"), F.lit(1).alias("parts"))
    home = tile_homes(lists.unionByName(both.select("g", "e.id", "e.size", "cnt", "parts")), tile, weight)
    both = pairs.join(home.select(F.col("id").alias("a"), F.col("tile").alias("ta")), "a").join(home.select(F.col("id").alias("b"), F.col("tile").alias("tb")), "b")
    member = F.array(F.struct(F.col("ta").alias("tile"), F.col("a").alias("id")), F.struct(F.col("tb").alias("tile"), F.col("b").alias("id")))
    single = both.select(F.least("ta", "tb").alias("ti"), F.greatest("ta", "tb").alias("tj"), F.explode(member).alias("e")).select("ti", "tj", "e.tile", "e.id")
    spread = lists.select("g", "id", "parts").join(home, "id")
    x = spread.select("g", salt_of("id").alias("salt"), "id", "tile").alias("x")
    y = spread.groupBy("g", "tile").agg(F.max("parts").alias("parts")).select("g", every_salt().alias("salt"), "tile").alias("y")
    met = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.salt") == F.col("y.salt")))  # a member travels only to the tiles of its own lists
    met = met.select(F.least("x.tile", "y.tile").alias("ti"), F.greatest("x.tile", "y.tile").alias("tj"), F.col("x.tile").alias("tile"), F.col("x.id").alias("id"))
    out = materialize(single.unionByName(met).distinct(), "tile-members")
    discard(hot, shared, pairs, home)
    return out


def tile_homes(links: DataFrame, tile: int, weight: int) -> DataFrame:
    """(id, tile) of the ids of (g, id, size, cnt, parts); a key with more than a tile holds deals its ids by hash."""
    home = materialize(links.groupBy("id").agg(F.max(F.struct("cnt", "g")).alias("sig"), F.max("size").alias("size")), "homes")
    label = home.select("id", F.col("sig").alias("label"))
    links = links.select("g", "id", "parts")
    for _ in range(2):
        top = links.join(label, "id").groupBy("g").agg(F.max("label").alias("label"), F.max("parts").alias("parts"))
        top = top.select("g", "label", every_salt().alias("salt"))
        label = links.withColumn("salt", salt_of("id")).join(top, ["g", "salt"]).groupBy("id").agg(F.max("label").alias("label"))
    first, home = home, materialize(home.join(label, "id").select("id", "size", F.col("sig.g").alias("sig"), F.col("label.g").alias("label")), "homes")
    load = F.greatest(F.col("size"), F.lit(-(-weight // tile)))
    keys = materialize(home.groupBy("label", "sig").agg(F.sum(load).alias("load")), "loads")
    whole = materialize(keys.groupBy("label").agg(F.sum("load").alias("whole")), "loads")
    places = F.when(F.col("whole") <= weight, F.lit(1).cast("long")).otherwise(F.ceil(F.col("whole") / weight))
    keys_ = materialize(keys.join(whole, "label").select("label", "sig", F.ceil(F.col("load") / weight).alias("parts"), F.pmod(F.xxhash64("sig"), places).alias("place")), "places")
    part = F.when(F.col("parts") > 1, F.xxhash64("sig", F.pmod(F.xxhash64("id"), "parts"))).otherwise(F.col("place"))
    out = materialize(home.join(keys_, ["label", "sig"]).select("id", F.xxhash64("label", part).alias("tile")), "tiles")
    discard(first, home, keys, whole, keys_)
    return out


def sorted_groups(batches, keys: list[str]):
    """Consecutive rows with equal keys of a sorted partition, as one Table a group."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def roots(adj: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each node of a boolean symmetric adjacency matrix."""
    label = np.arange(len(adj))
    while True:
        low = np.minimum(label, np.where(adj, label[None, :], len(adj)).min(axis=1, initial=len(adj)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


# --------------------------------------------------------------------------- hashing of words
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_pow = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, PASS_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, x in enumerate((_BASE, inverse)):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def passes(offsets: np.ndarray, limit: int = PASS_BYTES):
    """Ranges of documents of about ``limit`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None):
    """Hash of each word ([^\\x20\\x09-\\x0D]+, A-Z lowered) and the first word of each text.

    ``offsets`` delimit texts in ``data``; words never cross them.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    buf = data[base:end]
    cut = (offsets - base).astype(np.int64)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _WORD[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[cut] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * power[: len(buf)], out=total[1:])
    h = (total[e] - total[s]) * inverse[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(s, cut)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int):
    """Hashes of the k-word shingles of each text, and where each text's begin.

    A text of 1..k-1 words has its whole sequence as its one shingle.
    """
    n = len(words)
    count = np.diff(first)
    acc = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    factor = np.uint64(1)
    for j in range(k):
        factor = np.uint64((int(factor) * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & (2**64 - 1) | 1)
        acc += words[j : j + len(acc)] * factor
    acc = mix(acc)
    number = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(number, out=at[1:])
    out = np.empty(int(at[-1]), dtype=np.uint64)
    for d in np.flatnonzero(count > 0).tolist():
        lo, m = int(first[d]), int(count[d])
        if m >= k:
            out[at[d] : at[d + 1]] = acc[lo : lo + m - k + 1]
        else:
            f, a = 1, m
            for j in range(m):
                f = (f * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & (2**64 - 1) | 1
                a = (a + int(words[lo + j]) * f) & (2**64 - 1)
            out[at[d]] = mix(np.array([a ^ 0x5851F42D4C957F2D], dtype=np.uint64))[0]
    return out, at


def shingle_sets(column, k: int):
    """For each text of an Arrow string column, in order: its sorted distinct shingle hashes."""
    data, offsets = text_buffers(column)
    for lo, hi in passes(offsets):
        words, first = word_hashes(data, offsets[lo : hi + 1])
        grams, at = shingle_hashes(words, first, k)
        for d in range(hi - lo):
            yield np.unique(grams[at[d] : at[d + 1]])
