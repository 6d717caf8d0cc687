"""Embedding near-dedup by iterative quantisation (operator 10).

Rotations are learnt on a bounded sample (``SAMPLE`` vectors of smallest id hash): the first
principal axes, then alternating sign codes and orthogonal fits, so that bits are balanced
and lose little; several rotations from different starts give a code of ``BITS`` bits,
whatever the vectors' length. Every vector is put into multi-index Hamming tables, each keyed
by some blocks of its code. A key has a few bits more than the table's row count (so strangers
in a bucket don't grow with the table), and as many tables are made as it takes for synthetic partners,
at exactly the threshold, of a part of the sample that nothing was fitted on to be found with ``RECALL``;
if ``TABLES`` don't reach it, the job fails rather than lose links. Vectors that meet in a table
are reranked by their original components in double precision; a pair links exactly if its
cosine reaches the threshold. Candidates meet in tiles (see common.tile_groups), so a bucket
of any size gives no list of all its pairs.

Cases: equal vectors are one class before the search and count as links of each other;
null, zero or empty vectors, and those with null or non-finite components, link with
nothing; vectors are compared with those of their own length, each length being fitted by
itself or, where it has at most ``RARE`` different vectors, compared in full; rows repeating a
vec_id are one node; labels and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, in_sample, materialize, roots, sorted_groups, tile_groups

SAMPLE, ROUNDS, RARE = 10_000, 30, 512
#: Code bits, bits of a block, principal axes used, and the most tables; one in HELD of the sample isn't fitted on.
BITS, BLOCK, AXES, TABLES, HELD = 256, 2, 64, 1024, 4
#: Members of a tile: a large group is spread over many tasks.
TILE = 512
RECALL, PROBES = 0.985, 1500


def itq(v: np.ndarray, start: int, rounds: int = ROUNDS) -> np.ndarray:
    """Rotation of centred vectors that brings them closest to the corners of a cube."""
    r, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(start)).standard_normal((v.shape[1],) * 2))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
        r = u @ w
    return r


def unit(column) -> np.ndarray:
    """Rows of an Arrow list column (one length, no nulls) as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


class Tables:
    """Fitted to unit vectors of one length; ``keys`` gives each vector's key in each table."""

    def __init__(self, x: np.ndarray, rows: int, threshold: float):
        held, x = x[::HELD], np.delete(x, np.s_[::HELD], axis=0)
        self.mean = x.mean(axis=0)
        c = x - self.mean
        values, axes = np.linalg.eigh(c.T @ c)
        axes = axes[:, np.argsort(-values)[:AXES]]
        v = c @ axes
        turns = [itq(v, start) for start in range(-(-BITS // axes.shape[1]))]
        self.projection = (axes @ np.concatenate(turns, axis=1))[:, :BITS]
        width = min(40, max(12, int(rows).bit_length() + 3))
        rng = np.random.Generator(np.random.PCG64(11))
        self.chosen = np.stack([rng.permutation(BITS // BLOCK)[: -(-width // BLOCK)] for _ in range(TABLES)])
        self.chosen = self.chosen[: self.needed(held, threshold)]

    def code(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.projection >= 0
        return (bits.reshape(len(x), -1, BLOCK) * (1 << np.arange(BLOCK))).sum(axis=2).astype(np.uint64)

    def keys(self, x: np.ndarray) -> np.ndarray:
        code, out = self.code(x), np.zeros((len(x), len(self.chosen)), dtype=np.uint64)
        for k in range(self.chosen.shape[1]):
            out = out << np.uint64(BLOCK) | code[:, self.chosen[:, k]]
        return out

    def needed(self, x: np.ndarray, threshold: float) -> int:
        """Tables that find partners at the threshold, moved at random or towards other vectors."""
        rng = np.random.Generator(np.random.PCG64(13))
        a = x[rng.integers(0, len(x), PROBES)]
        most = 1
        for move in (rng.standard_normal(a.shape), x[rng.integers(0, len(x), PROBES)] - x[rng.integers(0, len(x), PROBES)]):
            move = move - (move * a).sum(axis=1)[:, None] * a
            size = np.linalg.norm(move, axis=1)
            b = threshold * a + np.sqrt(1 - threshold**2) * move / np.maximum(size, 1e-12)[:, None]
            met = (self.keys(a) == self.keys(b))[size > 1e-9]
            found = np.maximum.accumulate(met, axis=1).mean(axis=0) if len(met) else np.ones(1)
            if found[-1] < RECALL:
                raise ValueError(f"{TABLES} tables find {found[-1]:.3f} of the partners at cosine {threshold}; more are needed")
            most = max(most, int(np.searchsorted(found, RECALL)) + 1)
        return most


def usable():
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0)


def block_keys(vectors: DataFrame, fitted: dict[int, Tables]) -> DataFrame:
    """(id, g, size): one row a table for (id, embedding); lengths without a fit have one key each."""
    held = vectors.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                if n not in held.value:
                    yield rows(ids.take(pa.array(at)), np.full(len(at), n, dtype=np.uint64))
                    continue
                for lo in range(0, len(at), 2048):
                    part = pa.array(at[lo : lo + 2048])
                    key = held.value[n].keys(unit(column.take(part)))
                    for t in range(key.shape[1]):
                        yield rows(ids.take(part), key[:, t] << np.uint64(24) | np.uint64((n << 8 | t + 1) & 0xFFFFFF))

    def rows(ids, key):
        key = (key * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)  # odd: one to one
        return pa.RecordBatch.from_arrays([ids, pa.array(key), pa.array(np.ones(len(ids), np.int64))], ["id", "g", "size"])

    return vectors.mapInArrow(run, "id long, g long, size long")


def rerank(groups: DataFrame, threshold: float) -> DataFrame:
    """Per (ti, tj): rows (a, b, n): a links n vectors there (b null), or a and b are connected (n 0)."""

    def run(batches):
        for (ti, tj), t in sorted_groups(batches, ["ti", "tj"]):
            ids, tile, times = t["id"].to_numpy(), t["tile"].to_numpy(), t["times"].to_numpy()
            order = np.argsort(ids)
            ids, tile, times = ids[order], tile[order], times[order]
            x = unit(t["embedding"])[order]
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
            if ti != tj:
                hit &= tile[:, None] != tile[None, :]
            n = hit @ times
            low = roots(hit)
            with_links, far = np.flatnonzero(n), np.flatnonzero(low != np.arange(len(low)))
            if len(with_links):
                a = np.concatenate([ids[with_links], ids[far]])
                b = pa.array([None] * len(with_links) + ids[low[far]].tolist(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([n[with_links], np.zeros(len(far), np.int64)]))], ["a", "b", "n"])

    return groups.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(run, "a long, b long, n long")


def fit(classes: DataFrame, threshold: float, sample: int) -> dict[int, Tables]:
    """Tables of each length with more than RARE different vectors (at most one in RARE of the rows is a length)."""
    out = {}
    for width, n in classes.groupBy(F.size("embedding")).count().filter(F.col("count") > RARE).collect():
        chosen = classes.filter(F.size("embedding") == width).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding")
        x = unit(pa.array([r[0] for r in chosen.collect()]))  # at most ``sample`` rows
        out[width] = Tables(x, n, threshold)
    return out


def near_vectors(table: DataFrame, threshold: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = table.filter(usable() & F.col("vec_id").isNotNull())
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("doc"), F.count("*").alias("times"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")  # ids are fixed by being written
    tables, held = fit(classes, threshold, sample), classes.select("id", "embedding")
    groups = tile_groups(block_keys(held, tables), tile=TILE, sampled=block_keys(held.filter(in_sample("id")), tables))
    links = materialize(rerank(groups.join(classes.select("id", "embedding", "times"), "id"), threshold), "vector-links")
    counted = links.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    own = classes.join(counted, "id", "left").select("id", "embedding", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    member = materialize(good.join(own, "embedding").select("vec_id", "id", "n_links"), "members")
    several = materialize(member.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("vec_id", "a"), "repeated")
    edges = links.filter("b is not null").select("a", "b").unionByName(member.join(several, "vec_id").select("a", F.col("id").alias("b")))
    label = materialize(components(edges), "labels")
    linked = classes.select("id", "doc").join(label, "id", "left").select("id", "doc", F.coalesce("component", "id").alias("component"))
    least = materialize(linked.groupBy("component").agg(F.min("doc").alias("least")), "smallest")
    linked = materialize(linked.join(least, "component").select("id", "least"), "linked")
    found = member.join(linked, "id").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("least").alias("least"))
    out = table.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("least", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    discard(groups, links, several, label, least)
    return out


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
