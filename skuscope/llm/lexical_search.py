"""Ranked lexical search by Block-Max WAND (operator 12).

The index is a table of segments, one row each: a task packs the documents it reads into
segments of at most ``SEGMENT`` documents, so no posting is shuffled and no term, however
common, meets in one place. A segment's posting lists are cut into blocks of ``BLOCK``
postings; a block is compressed by frame of reference (document offsets and frequencies in
the fewest bytes that hold them), and its header states its first and last document and the
largest impact in it. Headers are written in a second pass over the segments, once the counts
of documents and terms are known.

A search moves its pointers over headers alone: the blocks of an item's terms cut the
segment into intervals, each bounded by the sum of the maxima of the blocks that cover it.
Intervals below the score of the item's k-th best document so far are skipped and their blocks
are never decompressed; the others are met in order of their bounds and scored in full. An
interval whose bound equals that score is scored too, since it may hold an equal document of
smaller id. The best documents carry over from segment to segment of a task; each task returns
k rows an item at most.

Items are searched in passes of about ``PASS_TERMS`` distinct terms (what the driver and a task
hold of the items); a segment holds the lists of the terms of its pass. Terms are told apart by
64-bit hashes.

Cases: a null or empty text has no terms, neither as a document nor as an item; an item without
a scoring document has no row; rows that repeat an item_id are one item with all their terms; rows that
repeat a doc_id are documents of their own; null ids are ids like others, before all others;
equal scores come by ascending doc_id; very long texts are read in passes of bounded size; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, _powers, materialize, mix, passes, text_buffers

#: Postings of a block, documents of a segment, distinct (item, term) pairs of a pass.
BLOCK, SEGMENT, PASS_TERMS = 128, 8192, 1 << 18
K1, FLAT, SCALE = 1000, 20, 1_000_000_000
NULL_ID = np.iinfo(np.int64).min
_TERM = np.zeros(256, dtype=bool)  # digits, letters and every byte beyond ASCII
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of consecutive texts (A-Z lowered) and the first term of each text."""
    base = int(offsets[0])
    buf, cut = data[base : int(offsets[-1])], (offsets - base).astype(np.int64)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _TERM[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[cut] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * power[: len(buf)], out=total[1:])
    return mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(s, cut)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of (item_id, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in passes(offsets):
                terms, first = term_hashes(data, offsets[lo : hi + 1])
                owner = np.repeat(np.arange(lo, hi), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(terms.view(np.int64))], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term long").distinct()


# --------------------------------------------------------------------------- segments
def postings(documents: DataFrame, terms: np.ndarray) -> DataFrame:
    """Segments of (doc_id, text): rows (n_docs, n_terms, doc_ids, lengths, terms, counts, docs, tfs).

    ``terms`` are sorted hashes; a list is named by its place there, lists lie one after another in
    ``docs`` and ``tfs``, documents are numbered by ascending doc_id.
    """
    held = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        wanted = held.value
        slot = np.zeros(1 << 20, dtype=bool)
        slot[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        ids, lengths, owners, found, n = [], [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(at, SEGMENT)
                if n and n + part.num_rows > SEGMENT:
                    yield segment(ids, lengths, owners, found, len(wanted))
                    ids, lengths, owners, found, n = [], [], [], [], 0
                data, offsets = text_buffers(part.column(1))
                for lo, hi in passes(offsets):
                    seen, first = term_hashes(data, offsets[lo : hi + 1])
                    lengths.append(np.diff(first))
                    hit = np.flatnonzero(slot[(seen & np.uint64((1 << 20) - 1)).astype(np.int64)])
                    place = np.minimum(np.searchsorted(wanted, seen[hit]), len(wanted) - 1)
                    same = wanted[place] == seen[hit]
                    found.append(place[same].astype(np.int32))
                    owners.append((np.searchsorted(first, hit[same], side="right") - 1 + lo + n).astype(np.int32))
                ids.append(part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                n += part.num_rows
        if n:
            yield segment(ids, lengths, owners, found, len(wanted))

    kind = "n_docs long, n_terms long, doc_ids binary, lengths binary, terms array<int>, counts array<int>, docs binary, tfs binary"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def segment(ids: list, lengths: list, owners: list, found: list, n_terms: int) -> pa.RecordBatch:
    ids, lengths = np.concatenate(ids), np.concatenate(lengths).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    key = np.concatenate(found).astype(np.int64) * len(ids) + place[np.concatenate(owners)]
    key, tf = np.unique(key, return_counts=True)
    term, doc = np.divmod(key, max(len(ids), 1))
    terms, counts = np.unique(term, return_counts=True)
    lengths = lengths[order]
    raw = (ids[order], lengths.astype(np.int64), doc.astype(np.uint16), tf.astype(np.int32))
    a, b, c, d = (pa.array([x.tobytes()], pa.binary()) for x in raw)
    lists = [pa.array([x.astype(np.int32).tolist()], pa.list_(pa.int32())) for x in (terms, counts)]
    named = {"n_docs": pa.array([int((lengths > 0).sum())]), "n_terms": pa.array([int(lengths.sum())]), "doc_ids": a, "lengths": b, "terms": lists[0], "counts": lists[1], "docs": c, "tfs": d}
    return pa.RecordBatch.from_pydict(named)


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (K1 * tf + FLAT * m)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes of 1, 2 and 4."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def seal(segments: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Segments with compressed blocks: (doc_ids, norms, terms, blocks, heads, body), ``heads`` of int64 rows
    (first document, last document, maximum impact, place in body, bytes of an offset, bytes of a frequency, postings)."""
    held = segments.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                norm = 50 + 50 * np.frombuffer(row["lengths"], np.int64) * n_docs // n_terms
                docs, tfs = np.frombuffer(row["docs"], np.uint16).astype(np.int64), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
                counts = np.array(row["counts"], dtype=np.int64)
                weight = held.value[np.array(row["terms"], dtype=np.int64)]
                impact = np.repeat(weight, counts) * saturation(tfs, norm[docs])
                begin = np.concatenate([[0], np.cumsum(counts)])
                blocks = -(-counts // BLOCK)
                edges = np.concatenate([np.arange(lo, hi, BLOCK) for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist())]) if len(counts) else np.zeros(0, np.int64)
                stops = np.minimum(np.concatenate([edges[1:], [len(docs)]]), np.repeat(begin[1:], blocks)).astype(np.int64) if len(edges) else edges
                peak = np.maximum.reduceat(impact, edges) if len(edges) else edges
                heads, body, size = np.zeros((len(edges), 7), np.int64), [], 0
                for k, (lo, hi) in enumerate(zip(edges.tolist(), stops.tolist())):
                    a, b = narrow(docs[lo:hi] - docs[lo]), narrow(tfs[lo:hi])
                    heads[k] = docs[lo], docs[hi - 1], peak[k], size, a.itemsize, b.itemsize, hi - lo
                    body += [a.tobytes(), b.tobytes()]
                    size += a.nbytes + b.nbytes
                named = {"doc_ids": row["doc_ids"], "norms": norm.tobytes(), "terms": np.array(row["terms"], np.int32).tobytes(), "blocks": blocks.astype(np.int32).tobytes(), "heads": heads.tobytes(), "body": b"".join(body)}
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in named.items()})

    return segments.select("doc_ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(run, "doc_ids binary, norms binary, terms binary, blocks binary, heads binary, body binary")


# --------------------------------------------------------------------------- search
class Segment:
    """A sealed segment; ``opened`` counts the blocks that searches have decompressed."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.doc_ids, self.norms = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["norms"], np.int64)
        self.heads, self.body = np.frombuffer(row["heads"], np.int64).reshape(-1, 7), row["body"]
        self.terms, blocks = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["blocks"], np.int32)
        self.begin = np.concatenate([[0], np.cumsum(blocks)])
        self.weight = np.repeat(weights[self.terms], blocks)
        self.cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.opened = 0

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if k not in self.cache:
            first, _, _, at, a, b, n = self.heads[k].tolist()
            docs = np.frombuffer(self.body, f"u{a}", n, at).astype(np.int64) + first
            tf = np.frombuffer(self.body, f"u{b}", n, at + n * a).astype(np.int64)
            self.cache[k] = docs, self.weight[k] * saturation(tf, self.norms[docs])
            self.opened += 1
        return self.cache[k]

    def search(self, terms: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, doc_ids) of the k best of ``best`` and this segment for the item with these term places."""
        place = np.searchsorted(self.terms, terms)
        place = place[place < len(self.terms)][self.terms[place[place < len(self.terms)]] == terms[place < len(self.terms)]]
        own = np.concatenate([np.arange(self.begin[p], self.begin[p + 1]) for p in place]) if len(place) else np.zeros(0, np.int64)
        own = own[self.heads[own, 2] > 0]
        if not len(own):
            return best
        first, after, peak = self.heads[own, 0], self.heads[own, 1] + 1, self.heads[own, 2]
        bounds = np.unique(np.concatenate([first, after]))
        rise = np.zeros(len(bounds), np.int64)
        lo, hi = np.searchsorted(bounds, first), np.searchsorted(bounds, after)
        np.add.at(rise, lo, peak)
        np.add.at(rise, hi, -peak)
        most = np.cumsum(rise)[:-1]
        order = np.argsort(-most, kind="stable")
        width, at, step = np.diff(bounds), 0, 4 * k
        while at < len(order):
            least = int(best[0][-1]) if len(best[0]) == k else 1
            stop = at + int(np.searchsorted(-most[order[at:]], -least, side="right"))  # bounds fall: the rest is below
            if stop == at:
                break
            take = order[at : min(stop, at + max(1, int(np.searchsorted(np.cumsum(width[order[at:stop]]), step))))]
            chosen = np.zeros(len(bounds), dtype=bool)
            chosen[take] = True
            reach = np.concatenate([[0], np.cumsum(chosen)])
            opened = [self.block(b) for b in own[reach[hi] > reach[lo]].tolist()]
            docs, impact = np.concatenate([d for d, _ in opened]), np.concatenate([i for _, i in opened])
            inside = chosen[np.searchsorted(bounds, docs, side="right") - 1]
            score = np.bincount(docs[inside], weights=impact[inside], minlength=1).astype(np.int64)  # sums below 2^53 are exact
            hit = np.flatnonzero(score >= least)
            scores, ids = np.concatenate([best[0], score[hit]]), np.concatenate([best[1], self.doc_ids[hit]])
            top = np.lexsort((ids, -scores))[:k]
            best = scores[top], ids[top]
            at, step = at + len(take), 2 * step
        return best


def search(index: DataFrame, items: dict, weights: np.ndarray, k: int) -> DataFrame:
    """(item_id, doc_id, score): for each task, the k best documents of its segments for each item ({item: term places})."""
    held = index.sparkSession.sparkContext.broadcast((weights, items))

    def run(batches):
        weights, items = held.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best = dict.fromkeys(items, none)
        for batch in batches:
            for row in batch.to_pylist():
                part = Segment(row, weights)
                for item, terms in items.items():
                    best[item] = part.search(terms, k, best[item])
        for item, (scores, ids) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids, mask=ids == NULL_ID), pa.array(scores)], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def weigh(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_pass(documents: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item of (item_id, term), unranked; the items' terms are held by the driver."""
    rows = asked.collect()  # about PASS_TERMS
    terms = np.unique(np.array([r[1] for r in rows], dtype=np.int64).view(np.uint64))
    segments = materialize(postings(documents, terms), "segments")
    total = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(total[0] or 0), int(total[1] or 0)
    df = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts"))
    weights = np.zeros(len(terms), dtype=np.int64)
    for term, n in df.collect():  # a row a term of the pass
        weights[term] = weigh(n_docs, n)
    items: dict = {}
    for item, term in rows:
        items.setdefault(item, []).append(np.searchsorted(terms, np.int64(term).view(np.uint64)))
    items = {i: np.sort(np.array(t, dtype=np.int64)) for i, t in items.items()}
    index = materialize(seal(segments, weights, n_docs, max(n_terms, 1)), "lexical-index")
    return search(index, items, weights, k)


def rank(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    asked = materialize(item_terms(items), "item-terms")
    n_passes = max(1, -(-asked.count() // PASS_TERMS))
    found = None
    for p in range(n_passes):
        part = search_pass(documents, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_passes)) == p), k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPLIT}') AS t FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPLIT}')) AS term FROM benchmark
), s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS nt FROM d WHERE len(t) > 0),
u AS (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d),
p AS (SELECT k, doc_id, term, min(n) AS n, count(*) AS tf FROM u SEMI JOIN q USING (term) GROUP BY k, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
r AS (
  SELECT item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, k, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
