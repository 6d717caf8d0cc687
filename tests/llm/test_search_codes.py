"""Lexical search and vector codes against brute force on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from skuscope.llm import lexical_search as S
from skuscope.llm import vector_codes as V

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, query in asked.items():
        found = []
        for doc, b in bags:
            m = 50 + (50 * len(b) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b.count(t)) // (1000 * b.count(t) + 20 * m)) for t in query if t in b)
            if score > 0:
                found.append((-score, doc is not None, doc if doc is not None else 0, doc))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def words(rng, n, many=60):
    return " ".join(f"w{min(int(rng.expovariate(0.08)), many)}" for _ in range(n))


@pytest.mark.parametrize("block,size", [(4, 37), (128, 8192)])
def test_search_equals_brute_force(spark, monkeypatch, block, size):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SEGMENT", size)
    rng = random.Random(3)
    docs = [(i, words(rng, rng.randrange(1, 60))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, " .,;\n"), (5, "w1 w2"), (5, "w1 w2"), (None, "w3 w3 ÄÖ w3"), (1003, "Ünï CAFÉ café w9" * 500), (1004, words(rng, 20_000)), (1005, "K k Kk")]
    items = [(i, words(rng, 12)) for i in range(20)] + [(50, None), (51, "zzz"), (52, "w3 ÄÖ café"), (52, "W1"), (None, "w2"), (53, "k")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, SCORE int, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, rank int")
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in S.rank(d, q, 10).collect()]
    assert sorted(got, key=str) == brute_search(docs, items, 10)


def test_search_in_passes_and_empty(spark, monkeypatch):
    monkeypatch.setattr(S, "PASS_TERMS", 5)
    docs, items = [(i, f"a b{i % 3} c{i}") for i in range(40)], [(i, f"b{i % 3} c{i} q r s") for i in range(9)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, S.rank(d, q, 4).select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_search(docs, items, 4)
    assert S.rank(d.limit(0), q, 4).count() == 0
    assert S.rank(d, q.limit(0), 4).count() == 0


def test_blocks_are_skipped():
    rng = np.random.Generator(np.random.PCG64(2))
    common, rare = np.arange(0, 8000, 2), np.array([17, 4001])
    docs = np.concatenate([common, rare])
    row = S.segment([np.arange(8000)], [rng.integers(1, 900, 8000)], [docs.astype(np.int32)], [np.repeat([0, 1], [4000, 2]).astype(np.int32)], 2).to_pylist()[0]
    weights = np.array([3, 9000])
    norm = 50 + np.frombuffer(row["lengths"], np.int64) // 10
    heads, body, tf = [], b"", np.ones(128, np.int64)
    for t, part in ((0, common), (1, rare)):
        for lo in range(0, len(part), S.BLOCK):
            d = part[lo : lo + S.BLOCK]
            raw = S.narrow(d - d[0]), S.narrow(tf[: len(d)])
            heads.append([d[0], d[-1], (weights[t] * S.saturation(tf[: len(d)], norm[d])).max(), len(body), raw[0].itemsize, raw[1].itemsize, len(d)])
            body += raw[0].tobytes() + raw[1].tobytes()
    sealed = {"doc_ids": row["doc_ids"], "norms": norm.tobytes(), "terms": np.array([0, 1], np.int32).tobytes(), "blocks": np.array([32, 1], np.int32).tobytes(), "heads": np.array(heads, np.int64).tobytes(), "body": body}
    part = S.Segment(sealed, weights)
    scores, ids = part.search(np.array([0, 1]), 2, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert sorted(ids.tolist()) == [17, 4001]
    assert part.opened < 33


def whole(v):
    return [math.floor(4096 * x) for x in v]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    good = [(i, whole(v), lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for width in {len(v) for _, v, _ in good}:
        own = [r for r in good if len(r[1]) == width]
        edge = [width * p // parts for p in range(parts + 1)]
        cut = [[v[edge[p] : edge[p + 1]] for p in range(parts)] for _, v, _ in own]
        seeds = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0] or 0, own[k][1]))[:entries]
        books = [[list(cut[k][p]) for k in seeds] for p in range(parts)]

        def assign(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for p in range(parts):
                at = [assign(c[p], books[p])[1] for c in cut]
                for e in range(len(books[p])):
                    members = [c[p] for c, a in zip(cut, at) if a == e]
                    if members:
                        books[p][e] = [sum(col) // len(members) for col in zip(*members)]
        sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
        for (i, _, lab), c in zip(own, cut):
            near = [assign(c[p], books[p]) for p in range(parts)]
            out.append([i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), lab, sha])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((r[0], r[1], r[2], total[r[3]], r[4]) for r in out), key=str)


KIND = "vec_id long, embedding array<float>, label int, error string, CODE int"


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], KIND).repartition(3)
    return sorted(map(tuple, V.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(n, width, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    centre = rng.standard_normal((9, width))
    return [np.float32(centre[rng.integers(9)] * rng.uniform(0.2, 3) + rng.standard_normal(width) / 4).tolist() for _ in range(n)]


def test_codes_equal_brute_force(spark):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors(150, 16, 1))]
    rows += [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [0.0] * 15, 1), (904, [0.0] * 16, 2), (905, [0.0] * 16, 2), (7, rows[7][1], 1)]
    assert coded(spark, rows) == brute_codes(rows)


def test_codes_of_other_shapes(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(5, 8, 2))] + [(50 + i, v, 2) for i, v in enumerate(vectors(30, 11, 3))] + [(90, [1.5], None), (None, [2.5], None), (91, [], 3)]
    assert coded(spark, rows) == brute_codes(rows)
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []
    assert len(coded(spark, [(1, [3.4e38] * 8, 1), (2, [-3.4e38] * 8, 1)] + [(i, [float(i)] * 8, 1) for i in range(3, 40)])) == 39


def test_annulus_finds_the_nearest(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    for spread in (3, 50, 10**6):
        x, book = rng.integers(-spread, spread, (500, 4)), rng.integers(-spread, spread, (16, 4))
        index, far = V.nearest(x, book)
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_codes_decode(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(60, 16, 4))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    book = V.learn(df.select("vec_id", "embedding"))[16]
    got = {r["vec_id"]: (r["code"], r["error"]) for r in V.compress(df).collect()}
    back = V.decode([got[i][0] for i, _, _ in rows], book)
    assert [got[i][1] for i, _, _ in rows] == [int(((np.array(whole(v)) - b) ** 2).sum()) for (_, v, _), b in zip(rows, back)]
