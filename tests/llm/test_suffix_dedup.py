"""Repeated byte strings against brute force; merged transforms against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest

from skuscope.llm import suffix_dedup as D


def brute(docs, length):
    """Digest rows of (doc_id, text) whose doc_ids are distinct."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, dtype=bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p + 1 : p + 1 + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df, length, **sizes):
    out = []
    for r in D.cut_out(df, length, **sizes).collect():
        out.append((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(4, 30))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 25)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), word()]
        docs.append((3 * i, " ".join(parts)))
    docs += [(1, docs[5][1]), (4, docs[5][1]), (7, "ab" * 200), (10, "a" * 90), (13, "x" + "ab" * 150), (16, None), (19, ""), (22, "a"), (None, docs[9][1])]
    return docs


@pytest.mark.parametrize("length,sizes", [(20, {}), (20, {"limit": 200, "pack": 300, "shard": 90}), (12, {"limit": 60, "pack": 4000, "shard": 500}), (100, {"limit": 1000})])
def test_equals_brute_force(spark, length, sizes):
    docs = corpus(length)
    df = spark.createDataFrame([(i, t, 1, 2, b"") for i, t in docs], "doc_id long, text string, M int, start int, piece binary").repartition(5)
    assert digests(df, length, **sizes) == brute(docs, length)


def test_long_text_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 512)  # not seen by workers that are forked already, but by the next two
    docs = [(i, t) for i, t in corpus(8, 20)] + [(500, " ".join(t for _, t in corpus(9, 300) if t) + "tail"), (501, " ".join(t for _, t in corpus(9, 200) if t))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert digests(df, 40) == brute(docs, 40)
    data = np.frombuffer(docs[-1][1].encode(), np.uint8)
    windows = [np.arange(s, s + w) for _, first, n in D.pieces_of(data, np.array([0, len(data)]), 40, 10) for s, w in zip(first, n)]
    assert (np.concatenate(windows) == np.arange(len(data) - 39)).all()


def test_repeated_rows_and_empty(spark):
    a, b = "0123456789abcdefghij" * 2 + "Q", "zyxwvutsrq0123456789abcdefghij"
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (2, "short")], "doc_id long, text string")
    got = digests(df, 20)
    assert got[0] == got[1] and got[0][2] == 20 and len(got) == 4
    assert (2, 30, 20, 1, hashlib.sha256(b"zyxwvutsrq").hexdigest()) in got
    assert D.cut_out(df.limit(0)).count() == 0


def test_merge_equals_sorted_suffixes():
    rng = random.Random(4)
    for length, letters in ((20, "ab"), (15, "abcd"), (7, "ab")):
        strings = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))).encode() for _ in range(40)]
        strings += strings[:3]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        held = D.Pieces(np.frombuffer(b"".join(strings), np.uint8), offsets, length)
        cuts = [0, 9, 10, 30, len(strings)]
        orders = [held.order(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:])]
        rows, common = held.merge(orders, length)
        assert sorted(rows.tolist()) == list(range(len(rows)))
        suffix = [strings[held.owner[r]][held.past[r] :][:length] for r in rows.tolist()]
        full = [s for s in suffix if len(s) == length]
        assert full == sorted(full)
        for (x, y), c in zip(zip(suffix, suffix[1:]), common[1:].tolist()):
            if len(x) == len(y) == length:
                same = next((i for i in range(length) if x[i] != y[i]), length)
                assert c == same // held.wide * held.wide
            else:
                assert c < length
