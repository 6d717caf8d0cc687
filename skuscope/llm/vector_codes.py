"""Vector code compression by product quantisation with annular norm pruning (operator 13).

A vector is cut into ``PARTS`` parts, and each part is replaced by the index of its nearest
entry in that part position's codebook. Nearest entries are found by norms: the entries lie
sorted by norm, the entry of closest norm gives a first distance, a binary search gives the
interval of norms that this distance allows (a point's distance is at least the difference of
norms), and only the entries of that annulus are evaluated, in whole numbers, with both ends
included; a better entry narrows the annulus for those that follow.

Each round is one pass over the table: a task returns the sums and counts of its parts by
entry (a few thousand rows whatever its size), Spark adds them up, and the driver holds the
codebooks alone. Rounds end early once no entry changes, which gives the same codebooks.

Cases: a null vector, or one with a null or non-finite component, has no row; vectors of
different lengths have codebooks of their own; part i of a vector of n components begins at
n * i div PARTS, so a short vector has empty parts (index 0, distance 0); where a length has
fewer vectors than a codebook has entries, the codebook has one entry for each; rows that
repeat a vec_id count one by one (the first entries then follow the vectors' own order), null
ids come last; components beyond a bound at which squared distances still fit 64 bits count
as that bound (2^27 in whole numbers for 64 components); a label sum beyond 64 bits is null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
Books = dict[int, list[np.ndarray]]


def cuts(width: int, parts: int = PARTS) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


def whole_vectors(column) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """(kept rows, vectors by length in whole numbers, each kept row's length) of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = column.flatten()
    value = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    at = np.concatenate([[0], np.cumsum(length)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
    good = (bad[at[1:]] == bad[at[:-1]]) & ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    kept = np.flatnonzero(good)
    out = {}
    for n in np.unique(length[kept]).tolist():
        rows = kept[length[kept] == n]
        x = value[(at[rows][:, None] + np.arange(n)[None, :]).ravel()].reshape(len(rows), n)
        most = float(int((2**60 / max(n, 1)) ** 0.5))
        out[n] = np.clip(np.floor(SCALE * x), -most, most).astype(np.int64)
    return kept, out, length[kept]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties to the lower index) and its squared distance."""
    norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
    ring = np.sqrt((book * book).sum(axis=1).astype(np.float64))
    order = np.argsort(ring, kind="stable")
    ring = ring[order]
    right = np.clip(np.searchsorted(ring, norm), 0, len(ring) - 1)
    left = np.maximum(right - 1, 0)
    first = np.where(np.abs(ring[left] - norm) <= np.abs(ring[right] - norm), left, right)
    index = order[first]
    best = ((x - book[index]) ** 2).sum(axis=1)
    reach = np.sqrt(best * (1 + 1e-9) + 1)  # a little wide, so that rounding never shuts an entry out
    low, high = np.searchsorted(ring, norm - reach, "left"), np.searchsorted(ring, norm + reach, "right")
    for at in range(int(low.min(initial=0)), int(high.max(initial=0))):
        rows = np.flatnonzero((low <= at) & (at < high) & (first != at))
        rows = rows[(norm[rows] - ring[at]) ** 2 <= best[rows] * (1 + 1e-9) + 1]  # narrowed by what came before
        entry = int(order[at])
        far = ((x[rows] - book[entry]) ** 2).sum(axis=1)
        won = (far < best[rows]) | (far == best[rows]) & (entry < index[rows])
        best[rows[won]], index[rows[won]] = far[won], entry
    return index, best


def first_books(table: DataFrame, parts: int, entries: int) -> Books:
    """The parts of the kept vectors of smallest id, by length; at most ``entries`` rows a length reach the driver."""
    def keep(batches):
        for batch in batches:
            yield batch.take(pa.array(whole_vectors(batch.column(1))[0]))

    good = table.mapInArrow(keep, table.schema).withColumn("width", F.size("embedding"))
    by_id = Window.partitionBy("width").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    first = good.withColumn("k", F.row_number().over(by_id)).filter(F.col("k") <= entries)
    seen: dict[int, list] = {}
    for width, _, vector in sorted(first.select("width", "k", "embedding").collect(), key=lambda r: r[:2]):
        seen.setdefault(width, []).append(vector)
    kind = table.schema["embedding"].dataType
    out = {}
    for width, vectors in seen.items():
        x = whole_vectors(pa.array(vectors, pa.list_(pa.float32() if kind.elementType.typeName() == "float" else pa.float64())))[1][width]
        edge = cuts(width, parts)
        out[width] = [x[:, edge[p] : edge[p + 1]].copy() for p in range(parts)]
    return out


def part_sums(table: DataFrame, books: Books, parts: int) -> DataFrame:
    """(width, part, entry, at, total, n): sums of the parts of each entry, a row for each component."""
    held = table.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for width, x in whole_vectors(batch.column(1))[1].items():
                edge = cuts(width, parts)
                for p, book in enumerate(held.value[width]):
                    part = x[:, edge[p] : edge[p + 1]]
                    index, _ = nearest(part, book)
                    total, n = sums.setdefault((width, p), (np.zeros_like(book), np.zeros(len(book), np.int64)))
                    n += np.bincount(index, minlength=len(book))
                    for e in np.unique(index).tolist():
                        total[e] += part[index == e].sum(axis=0)
        for (width, p), (total, n) in sums.items():
            e, at = np.divmod(np.arange(total.size), max(total.shape[1], 1))
            used = n[e] > 0
            fields = [np.full(total.size, width), np.full(total.size, p), e, at, total.ravel(), n[e]]
            yield pa.RecordBatch.from_arrays([pa.array(f[used].astype(np.int64)) for f in fields], ["width", "part", "entry", "at", "total", "n"])

    return table.mapInArrow(run, "width long, part long, entry long, at long, total long, n long")


def learn(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks by length after ``rounds`` rounds of assigning and averaging."""
    books = first_books(table, parts, entries)
    for _ in range(rounds if books else 0):
        added = part_sums(table, books, parts).groupBy("width", "part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = {w: [b.copy() for b in book] for w, book in books.items()}
        for width, p, e, at, total, n in added.collect():  # entries * length rows a length
            new[width][p][e, at] = total // n
        same = all((a == b).all() for w in books for a, b in zip(books[w], new[w]))
        books = new
        if same:
            break
    return books


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for v in part.ravel().tolist()).encode()).hexdigest()


def encode(table: DataFrame, books: Books) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of the kept rows of (vec_id, embedding, label)."""
    held = table.sparkSession.sparkContext.broadcast((books, {w: digest(b) for w, b in books.items()}))
    kind = table.schema["label"].dataType.simpleString()

    def run(batches):
        books, digests = held.value
        for batch in batches:
            kept, vectors, length = whole_vectors(batch.column(1))
            code, error = np.zeros((len(kept), len(next(iter(books.values()), []))), np.uint8), np.zeros(len(kept), np.int64)
            for width, x in vectors.items():
                edge, rows = cuts(width, code.shape[1]), np.flatnonzero(length == width)
                for p, book in enumerate(books[width]):
                    index, far = nearest(x[:, edge[p] : edge[p + 1]], book)
                    code[rows, p] = index
                    error[rows] += far
            rows = batch.take(pa.array(kept))
            text = [c.hex() for c in map(bytes, code)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(text, pa.string()), pa.array(error), pa.array([digests[n] for n in length.tolist()], pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return table.mapInArrow(run, f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")


def decode(codes: list[str], book: list[np.ndarray]) -> np.ndarray:
    """Vectors (in whole numbers) that codes of one length stand for."""
    index = np.array([list(bytes.fromhex(c)) for c in codes], dtype=np.int64).reshape(len(codes), len(book))
    return np.concatenate([part[index[:, p]] for p, part in enumerate(book)], axis=1)


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per kept vector; at most 256 entries."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    coded = encode(rows, learn(rows.select("vec_id", "embedding"), parts, entries, rounds))
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = by_label.select(F.col("label").alias("of"), F.expr("try_cast(total as bigint)").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same rounds as SQL: one pair of tables for each, distances over whole numbers."""
    near = (
        "SELECT p.id, p.part, arg_min(b.e, (list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) AS e,"
        " min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS far FROM p JOIN b{k} b USING (part) GROUP BY p.id, p.part"
    )
    rounds = "".join(
        f""", a{k} AS MATERIALIZED ({near.format(k=k)}),
m{k} AS MATERIALIZED (SELECT part, e, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (SELECT part, e, pos, sum(v) AS s, count(*) AS n FROM
  (SELECT p.part, a.e, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS pos FROM p JOIN a{k} a USING (id, part)) GROUP BY part, e, pos)),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, COALESCE(n.x, b.x) AS x FROM b{k} b LEFT JOIN
  (SELECT part, e, list(v ORDER BY pos) AS x FROM m{k} GROUP BY part, e) n USING (part, e))"""
        for k in range(ROUNDS)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
    list_transform(embedding, lambda c: CAST(floor(4096.0 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS MATERIALIZED (
  SELECT id, part, x[len(x) * part // {PARTS} + 1 : len(x) * (part + 1) // {PARTS}] AS x FROM v, range({PARTS}) t(part)
), b0 AS MATERIALIZED (SELECT part, id - 1 AS e, x FROM p WHERE id <= {ENTRIES}){rounds}
, f AS MATERIALIZED ({near.format(k=ROUNDS)}),
r AS MATERIALIZED (SELECT id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM f GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM v JOIN r USING (id)
"""


SQL = _sql()
