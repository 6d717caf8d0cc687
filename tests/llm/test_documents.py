"""Document operators against brute force on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skuscope.llm import chat_format as H
from skuscope.llm import embedding_dedup as E
from skuscope.llm import language_id as G
from skuscope.llm import line_dedup as L
from skuscope.llm import ngram_jaccard as N
from skuscope.llm import simhash as M
from skuscope.llm.common import components
from skuscope.llm.registry import oracle_sql

SF = "/root/testdata/sf0.001"


def rooted(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_jaccard(docs, k, num, den):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, shingles(t, k))
    links = []
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in rooted(sets, links).items()}


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard(spark, k, num):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5000 + i, t) for i, t in enumerate([None, "", " \n", "One two", "one TWO", "one", "a b c", "a b c"])]
    docs += [(6000 + i, t) for i, t in enumerate(near_copies(60, 90, 6, 1))]  # a long posting list
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, id int, g int, size int")
    got = {r[0]: (r[1], r[2]) for r in N.jaccard_components(df, k, num, 100).collect()}
    assert got == brute_jaccard(docs, k, num, 100)


def test_jaccard_edges(spark):
    kind = "doc_id long, text string"
    assert N.jaccard_components(spark.createDataFrame([], kind)).count() == 0
    got = N.jaccard_components(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "x"), (3, "x")], kind)).collect()
    assert sorted(tuple(r) for r in got if r[0]) == [(2, 1, 2), (2, 2, 2), (3, 1, 2)]
    assert [r["component_id"] for r in got if r[0] is None] == [None]


def test_jaccard_repeated_ids_and_hot_keys(spark, monkeypatch):
    """A doc_id with two texts has the links of both; hot keys dealt over salts give the same rows."""
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, b), (5, a + " i"), (6, b + " x"), (7, "nothing of all that is said here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in N.jaccard_components(df, 3, 80, 100).select("doc_id", "component_id").collect()} == {(1, 1), (5, 1), (6, 1), (7, 7)}
    monkeypatch.setattr("skuscope.llm.common.EVERY", 1)
    monkeypatch.setattr("skuscope.llm.common.PART", 16)
    docs = list(enumerate(near_copies(150, 90, 6, 2) + near_copies(40, 30, 2, 3) + ["the same text here again"] * 30 + ["word " * 5000 + f"end{i}" for i in range(3)]))
    got = {r[0]: (r[1], r[2]) for r in N.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == brute_jaccard(docs, 3, 90, 100)


def test_heavy_shingles_are_exact(spark, monkeypatch):
    docs = [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    monkeypatch.setattr(N, "SKETCH_BITS", 12)
    df = spark.createDataFrame([(t,) for t in docs], "text string")
    import pyarrow as pa

    sketch = N.frequency_sketch(df, 3)
    keys, times = N.heavy_shingles(df, 3, spark.sparkContext.broadcast(sketch), 5)
    every, n = np.unique(np.concatenate(list(N.shingle_sets(pa.array(docs), 3))), return_counts=True)
    assert (keys == every[n >= 5]).all() and (times == n[n >= 5]).all()
    order = N.rare_first(every, sketch, keys, times)
    assert (np.diff(n[order][-len(keys) :]) >= 0).all() and n[order][: -len(keys)].max() < 5


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    ids = {x for p in links for x in p}
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    want = rooted(ids, links)
    assert all(got.get(i, i) == want[i] for i in ids)


def test_chat_matches_sql(spark):
    got = sorted(tuple(r) for r in H.op2_chat_format(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == sorted(con.execute(oracle_sql()["op2_chat_format"]).fetchall())


def test_chat_layouts_and_escapes(spark):
    said = ["\\### Assistant: </turn> ok", "\\l\\b<turn user>\n</turn>\n", "", None, "\\", "<"]
    rows = spark.createDataFrame([(None, i, r, t, 1) for i, t in enumerate(said) for r in ("assistant", None, "a>\n<\\")], "conv_id long, turn long, role string, text string, loss_text int")
    got = H.read_back(H.format_turns(H.canonical_turns(rows))).collect()
    assert {(r["turn"], r["role"], r["text"]) for r in got} == {(i, r or "", t or "") for i, t in enumerate(said) for r in ("assistant", None, "a>\n<\\")}
    assert all(r["loss_text"] == (r["text"] if r["role"] == "assistant" else "") for r in got)
    layouts = {
        "messages": ("messages array<struct<role:string,content:string>>, x int", [([("user", "q"), ("assistant", "a")], 1)]),
        "from_value": ("conversations array<struct<from:string,value:string>>", [([("human", "q"), ("gpt", "a")],)]),
        "instruction_input": ("instruction string, input string, output string", [("q", " ", "a")]),
        "prompt_response": ("prompt string, response string", [("q", "a")]),
        "question_answer": ("Question string, Answer string", [("q", "a")]),
    }
    for name, (kind, data) in layouts.items():
        df = spark.createDataFrame(data, kind)
        assert H.layout_of(df.schema)["name"] == name
        assert [(r["role"], r["text"]) for r in H.canonical_turns(df).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        H.layout_of(spark.createDataFrame([(1,)], "other int").schema)
    assert H.digests(H.read_back(H.format_turns(H.canonical_turns(rows.limit(0))))).count() == 0


def xxhash64(raw, seed=42):
    import xxhash

    return xxhash.xxh64_intdigest(raw, seed)


def brute_terms(text):
    import regex

    unspaced = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17df\u3041-\u309f\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003fffd]"
    low = text.lower()
    found = [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", regex.sub(f"({unspaced})(?=({unspaced}))", r"\1\2 ", low)) if w]
    return found or [low] * bool(low)


def brute_simhash(text):
    """Weighted votes of the words on each bit, one by one."""
    votes = [0] * 64
    for w in brute_terms(text):
        h, weight = xxhash64(w.encode()), max(1, min(7, len(w) - 2))
        for b in range(64):
            votes[b] += weight if h >> b & 1 else -weight
    return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_simhash(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9000, None), (9001, ""), (9002, "tiny"), (9003, "word " * 9000), (9004, "word " * 9000), (9005, "the cat sat on a mat"), (9006, "to be or not to be"), (9007, "the cat sat on a mat"), (9008, "?! ..."), (9009, "...!"), (9010, "a,b;c\u00a0d\u3000e\r\nf 東京都 ภาษาไทย x9")]
    docs.sort()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, h string, n_chars int")
    out = M.fingerprint_documents(df)
    assert dict(out.dtypes) == {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
        "near_edited": "double", "near_next": "double", "n_near": "bigint",
    }
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(docs)
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) < 60_000:
            assert r["fingerprint"] == brute_simhash(t) and r["edited_fingerprint"] == brute_simhash(edited)
        assert r["near_next"] == 1 - apart(r["fingerprint"], got[docs[(k + 1) % len(docs)][0]]["fingerprint"]) / 64
        assert r["near_edited"] == 1 - apart(r["fingerprint"], r["edited_fingerprint"]) / 64
        assert r["n_near"] == sum(apart(r["fingerprint"], x["fingerprint"]) <= 3 for j, x in got.items() if j != i)
    assert len({got[i]["fingerprint"] for i in (9001, 9005, 9006)}) == 3 and got[9005]["fingerprint"] == got[9007]["fingerprint"]
    rows = [got[i] for i, t in docs if t and 1000 < len(t) < 40_000]
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.15


def test_simhash_of_unspaced_texts(spark):
    """A text without spaces is nearer to itself with a quarter replaced than to a stranger."""
    rng = random.Random(5)
    for lo, hi in ((0x4E00, 0x5200), (0x0E01, 0x0E2E), (0x3042, 0x3090)):
        words = ["".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
        docs = [(i, "".join(rng.choice(words) for _ in range(500))) for i in range(12)]
        rows = M.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.1


def test_simhash_edges(spark):
    kind = "doc_id long, text string"
    assert M.fingerprint_documents(spark.createDataFrame([], kind)).count() == 0
    got = M.fingerprint_documents(spark.createDataFrame([(1, "alpha beta gamma")] * 2 + [(None, "delta")], kind)).collect()
    assert sorted(((r["doc_id"] or 0), r["n_near"]) for r in got) == [(0, 0), (1, 1), (1, 1)]


@pytest.mark.parametrize("every,part", [(None, 512), (1, 8)])
def test_block_tables_find_every_near_fingerprint(spark, monkeypatch, every, part):
    """Against all pairs; the second time every bucket of eight is hot and dealt over salts."""
    monkeypatch.setattr("skuscope.llm.common.PART", part)
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for p in prints for _ in range(3)]
    prints += [prints[0] ^ (1 << b) ^ (1 << c) for b in range(16) for c in range(b)]
    signed = sorted({p - (1 << 64) if p >= 1 << 63 else p for p in prints})
    rows = spark.createDataFrame([(p, 1 + i % 3) for i, p in enumerate(signed)], "fingerprint long, times long")
    got = {r[0]: r[1] for r in M.near_counts(rows, every=every).collect()}
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    for i, a in enumerate(signed):
        assert got.get(a, 0) == i % 3 + sum(1 + j % 3 for j, b in enumerate(signed) if j != i and far(a, b) <= 3)


def test_language_id(spark):
    truth = {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = {r["doc_id"]: r for r in G.op5_language_id(spark, SF).collect()}
    assert len(got) == len(truth)
    right = total = 0
    for i, (text, lang) in truth.items():
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["held_out"] and r["lang_pred"] != "und":
            total, right = total + 1, right + (r["lang_pred"] == lang)
    assert right / total > 0.97


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "aba", " a"]
    lat = G.Lattice(pieces)
    prob = np.random.default_rng(0).random((len(pieces) + 1, 2)) / 10
    prob[-1] = 0
    words = ["a", "abab", " ab", "baa", "ax"]

    def brute(w, k):
        if not w:
            return 1.0
        out = 0.0
        for n in range(1, len(w) + 1):
            p = prob[pieces.index(w[:n]), k] if w[:n] in pieces else 0.0
            p = max(p, G.FLOOR) if n == 1 else p
            out += p * brute(w[n:], k) if p else 0.0
        return out

    got = lat.score(words, prob)
    assert np.allclose(got, np.log([[brute(w, k) for k in range(2)] for w in words]))
    m = G.Model(["x", "y"], prob, pieces)
    got = m.predict([None, "12 !", "½ ² ③ Ⅷ", "ab", "a" * 1000, "ab½ab"])
    assert [g[0] == "und" for g in got] == [True, True, True, False, False, False] and got[0] == ("und", 0.0)
    assert G.words_of("ab½Ab c_d") == ["ab", "ab", "c", "d"]


def test_expected_counts_equal_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "aba", " a", " abab"]
    lat = G.Lattice(pieces)
    prob = np.append(np.random.default_rng(1).random(len(pieces)) / 10, 0.0)
    words = sorted([" abab", "abab", " ab", "baa", "ax"], key=lambda w: -len(w))
    weight = np.arange(1.0, 6.0)

    def cuts(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if w[:n] in pieces or n == 1:
                for rest in cuts(w[n:]):
                    yield [w[:n], *rest]

    want = np.zeros(len(pieces))
    p = lambda x: max(prob[pieces.index(x)], G.FLOOR) if x in pieces and len(x) == 1 else prob[pieces.index(x)] if x in pieces else G.FLOOR
    for w, k in zip(words, weight):
        every = [(c, np.prod([p(x) for x in c])) for c in cuts(w)]
        whole = sum(x for _, x in every)
        for c, x in every:
            for piece in c:
                if piece in pieces:
                    want[pieces.index(piece)] += k * x / whole
    assert np.allclose(G.expected_counts(lat, words, weight, prob)[:-1], want)


def test_language_id_edges(spark):
    kind = "doc_id long, text string, lang string, score int, lang_pred int, source string"
    rows = [(i, "the cat and the dog of the house" if i % 2 else "le chat et le chien de la maison", "en" if i % 2 else "fr", i, i, "s") for i in range(40)]
    rows += [(100, None, "en", 1, 1, "s"), (101, "½ 12 ²", "en", 1, 1, "s"), (101, "", None, 1, 1, None), (None, "the dog and the cat", None, 1, 1, None)]
    df = spark.createDataFrame(rows, kind)
    got = G.predict(df, G.trained_on(df))
    assert got.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score"]
    assert all(r["lang_pred"] == (r["lang"] if r["doc_id"] < 100 else "und") for r in got.collect() if r["doc_id"] is not None)
    kept = G.keep_identified(spark, df, SF)
    assert kept.columns == df.columns and sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, *range(40)]
    assert [r["lang_pred"] for r in G.predict(df, G.trained_on(df.limit(0))).collect()] == ["und"] * len(rows)
    assert G.keep_identified(spark, df.limit(0), SF).count() == 0


def test_lines(spark):
    assert L.edit_distance(b"kitten", b"sitting", 5) == 3 and L.edit_distance(b"abc", b"xyz", 1) == 2
    line = "The quick brown fox jumps over the lazy dog near the old mill by the river bank today"
    words = " ".join(f"term{i:03d}" for i in range(200))
    docs = [
        (1, f"{line}\nunique line number one here"), (2, f"{line.upper()}!!\nanother thing entirely said"), (3, None), (4, ""), (5, f"x\nx\n\n{line}"),
        (6, words.replace("term", "word")), (7, words.replace("term", "word").replace("word007", "wordabc")), (None, line), (8, "wholly different words stand in this line"),
    ]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], "doc_id long, text string, line int, kept string")
    gone = {tuple(r) for r in L.duplicate_lines(df).collect()}
    assert {(2, 0), (5, 3)} <= gone and gone <= {(2, 0), (5, 3), (7, 0)}
    got = {r["doc_id"]: r["text"] for r in L.remove_lines(df, L.duplicate_lines(df)).collect()}
    assert got[1] == docs[0][1] and got[2] == "another thing entirely said" and got[5] == "x\nx\n" and got[3] is None and got[None] == line
    assert L.duplicate_lines(df.limit(0)).count() == 0


def test_lines_equal_brute_force(spark):
    """Against all pairs of lines by edit similarity alone: nothing wrong, all equal lines, and the bands' recall of the similar ones."""
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    import pyarrow as pa

    occ = []
    for i, t in docs:
        data, offsets = L.text_buffers(pa.array([t]))
        for _, line, h, h2, sim, words in zip(*L.describe_lines(data, offsets)):
            if words >= 3:
                occ.append((i, int(line), L.normalise(t.split("\n")[int(line)]), int(sim), (int(h), int(h2))))
    by = {}
    for o in occ:
        by.setdefault(o[2], []).append(o)
    assert len({o[4] for o in occ}) == len(by)
    keys = sorted(by)
    size = np.array([len(k) for k in keys])
    bytes_of = np.stack([np.bincount(np.frombuffer(k, np.uint8), minlength=256) for k in keys])
    links = []
    for x in range(len(keys)):  # all pairs whose bytes allow it (an edit changes one byte of either line), by edit similarity alone
        d, most = bytes_of[x] - bytes_of[x + 1 :], np.maximum(size[x], size[x + 1 :]) * 20 // 100
        least = np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1))
        for y in np.flatnonzero(least <= most) + x + 1:
            if L.edit_distance(keys[x], keys[y], int(most[y - x - 1])) <= most[y - x - 1]:
                links.append((x, int(y)))
    group = {}
    for x, root in rooted(range(len(keys)), links).items():
        group.setdefault(root, []).extend(o[:2] for o in by[keys[x]])
    want = {o for g in group.values() for o in g if o != min(g)}
    got = {tuple(r) for r in L.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    exact = {o[:2] for v in by.values() for o in v if o[:2] != min(x[:2] for x in v)}
    print("lines to remove", len(want), "found", len(got), "equal ones", len(exact))
    assert got <= want and exact <= got and len(got - exact) >= 0.95 * len(want - exact)


def test_lines_recall(spark):
    """Links that edit similarity alone, over all pairs, finds between lines with a few words or letters changed."""
    rng = random.Random(7)
    vocabulary = ["of", "to", "in", "the", *("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 11))) for _ in range(600))]
    docs = []
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.choice([5, 9, 20, 40, 90]))
        copy = list(words)
        for k in rng.sample(range(len(words)), max(1, len(words) // 10)):
            copy[k] = rng.choice(vocabulary) if i % 2 else copy[k][:-1] + "q"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    lines = [L.normalise(t) for _, t in docs]
    links = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if L.similar(lines[a], lines[b], 80, 100)]
    want = {i for i, root in rooted(range(len(docs)), links).items() if root != i}
    got = {r["doc_id"] for r in L.duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(want) > 140 and got <= want and len(got) >= 0.95 * len(want)


def test_lines_of_long_lists(spark, monkeypatch):
    """Lists longer than a tile, of lines that share a passage and of near copies: as by brute force, and no pair is shuffled."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    passage, base = [word() for _ in range(30)], [word() for _ in range(40)]
    lines = [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(3)]) for _ in range(60)]
    for _ in range(40):
        copy = list(base)
        copy[rng.randrange(40)] = word()
        lines.append(" ".join(copy))
    lines += [" ".join(x.split()[:-1] + [word()]) for x in lines[:5]]
    monkeypatch.setattr(L, "TILE", 8)
    monkeypatch.setattr("skuscope.llm.common.EVERY", 1)
    met, write = [], L.materialize

    def held(df, name):
        out = write(df, name)
        met.append((name, out.count()))
        return out

    monkeypatch.setattr(L, "materialize", held)
    got = {r["doc_id"] for r in L.duplicate_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    norm = [L.normalise(x) for x in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if L.similar(norm[a], norm[b], 80, 100)]
    assert got == {i for i, root in rooted(range(len(lines)), links).items() if root != i} == {*range(61, 105)}
    lists = max(n for name, n in met if name == "postings")
    assert max(n for name, n in met if name == "pairs") <= (L.NEXT + 1) * lists


def test_distances_are_given_up_only_beyond_the_bound():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcd ", k=n)).encode()
    norm, most = [], []
    for n in (150, 190, 170, 130, 180) * 8:
        a = text(n)
        b = bytearray(a)
        for _ in range(rng.choice([0, 3, 20, 60, 150])):
            b[rng.randrange(len(b))] = rng.choice(b"abcd ")
        norm += [a, bytes(b[rng.randrange(20):])]
        most.append(rng.choice([2, 20, 40]))
    i = np.arange(0, len(norm), 2)
    most, true = np.array(most), np.array([L.edit_distance(norm[k], norm[k + 1], 10**6) for k in i])
    got = L.distances(norm, i, i + 1, most)
    assert ((got <= most) == (true <= most)).all() and (got == true)[true <= most].all()


def test_embeddings(spark):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rng = np.random.default_rng(0)
    for i in range(40):
        v = np.array(rows[i][1]) + rng.standard_normal(64) * 0.02
        rows.append((10_000 + i, v.astype(np.float32).tolist()))
    rows += [(20_000 + i, rows[3][1]) for i in range(12)]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 5]
    rows += [(30_000 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, times int")
    got = {r["vec_id"]: r for r in E.near_vectors(df).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i < 30_000]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    want = hit.sum(axis=1)
    found = np.array([got[i]["n_links"] for i, _ in good])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert all(got[30_000 + i]["n_links"] == 0 and got[30_000 + i]["kept"] for i in range(len(bad)))
    comp = rooted([i for i, _ in good], [(good[a][0], good[b][0]) for a, b in np.argwhere(hit)])
    assert np.mean([got[i]["component_id"] == comp[i] for i, _ in good]) > 0.98
    assert E.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [16, 64, 384, 768])
def test_tables_find_partners_just_above_the_threshold(width):
    """Recall at cosine 0.95 and 0.96, for a table of a million rows, of vectors in clusters and with decaying spectrum."""
    rng = np.random.default_rng(width)
    x = rng.standard_normal((50, width))[rng.integers(0, 50, 3000)] + rng.standard_normal((3000, width))
    x *= 1 / np.sqrt(1 + np.arange(width)) if width == 384 else 1
    x /= np.linalg.norm(x, axis=1)[:, None]
    tables = E.Tables(x[:2000], 1_000_000, 0.95)
    for cosine in (0.95, 0.96):
        move = rng.standard_normal((1000, width))
        move -= (move * x[2000:]).sum(axis=1)[:, None] * x[2000:]
        y = cosine * x[2000:] + np.sqrt(1 - cosine**2) * move / np.linalg.norm(move, axis=1)[:, None]
        assert (tables.keys(x[2000:]) == tables.keys(y)).any(axis=1).mean() >= 0.9


def test_embeddings_of_several_lengths(spark, monkeypatch):
    """Planted partners at cosines from 0.95 to 0.97 and a few from below, in fitted lengths and a rare one; a repeated vec_id."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr("skuscope.llm.common.EVERY", 1)
    rows, at = [], 0
    for width, n in ((64, 700), (24, 600), (16, 40)):
        x = rng.standard_normal((n, width))
        x /= np.linalg.norm(x, axis=1)[:, None]
        move = rng.standard_normal((n, width))
        move -= (move * x).sum(axis=1)[:, None] * x
        move /= np.linalg.norm(move, axis=1)[:, None]
        c = rng.uniform(0.945, 0.97, n)[:, None]
        for v in np.concatenate([x, c * x + np.sqrt(1 - c * c) * move]):
            rows.append((at, v.tolist()))
            at += 1
    rows += [(at, rows[0][1]), (at, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component string")
    got = {r["vec_id"]: r for r in E.near_vectors(df).collect()}
    want, links = {}, []
    for width in (64, 24, 16):
        part = [(i, np.array(v)) for i, v in rows if len(v) == width]
        y = np.array([v / np.linalg.norm(v) for _, v in part])
        hit = y @ y.T >= 0.95
        np.fill_diagonal(hit, False)
        for k, (i, _) in enumerate(part):
            want[i] = max(want.get(i, 0), int(hit[k].sum()))
        links += [(part[p][0], part[q][0]) for p, q in np.argwhere(hit)]
    comp = rooted(want, links)
    assert got[at]["component_id"] == 0 and got[5]["component_id"] == 0
    assert all(got[i]["n_links"] <= want[i] for i in want) and sum(r["n_links"] for r in got.values()) >= 0.95 * sum(want.values())
    assert all(got[i]["n_links"] == want[i] for i, v in rows if len(v) == 16)
    assert np.mean([got[i]["component_id"] == comp[i] for i in want]) > 0.95


def test_lines_edges(spark):
    """Clashing names, repeated ids, a very long line, an empty table."""
    long = " ".join(f"token{i}" for i in range(30_000))
    rows = [(1, f"one line of words\n{long}", 1, 2, 3), (1, f"one line of words\n{long}", 1, 2, 3), (2, long, 4, 5, 6), (3, None, 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_removed int, __gone int")
    got = L.remove_lines(df, L.duplicate_lines(df))
    assert got.columns == ["doc_id", "text", "__gone", "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] < 3) == [(1, rows[0][1])] * 2 + [(2, "")]
    kept = L.drop_lines(spark, df, SF)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3]
    assert L.drop_lines(spark, df.limit(0), SF).count() == 0


def test_pipeline_edges(spark):
    """Nulls in any column, repeated ids, clashing names and an empty table, through all stages."""
    kind = "doc_id long, text string, lang string, id long, g int, size int, label int, component string, n_lines int, score double, lang_pred string, ids string, start long"
    more = (1, 2, 3, 4, "c", 5, 0.5, "x", "y", 6)
    said = "the house of the old man stands by the river and nobody lives in it any more"
    rows = [
        (1, said, "en", *more), (1, f"{said} today", "en", *more), (2, said, None, *more), (3, None, "en", *more), (4, "", "en", *more), (5, "12 ½", "en", *more), (None, f"a text without an id: {said}", "en", *more),
        (6, "la maison du vieil homme est au bord de la rivière et personne n'y habite plus", "fr", *more), (7, "word " * 20_000, None, *([None] * len(more))),
    ]
    docs = spark.createDataFrame(rows, kind)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "packing":
            break
        assert got.columns == docs.columns
        docs = spark.createDataFrame(got.collect(), docs.schema)
        kept = [r["doc_id"] for r in docs.collect()]
        if name == "language_id":
            assert sorted(kept, key=str) == [1, 1, 2, 6, 7, None]
        else:
            assert {1, 6, 7, None} <= set(kept) and 2 not in kept  # the copy of the first line, and then of the document, goes
    assert {r["doc_id"] for r in got.collect()} == set(kept)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "packing"]
    held = docs.withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, held, SF)
        assert got.columns == held.columns
        before, after = {r[0]: r for r in held.collect()}, {r[0]: r for r in got.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name == "ngram_jaccard":
            want = brute_jaccard([(r["doc_id"], r["text"]) for r in before.values()], 5, 80, 100)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        held = spark.createDataFrame(list(after.values()), held.schema)
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, held, SF).select("doc_id").distinct().collect()} == {r["doc_id"] for r in held.collect()}
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_similarity_bounds_change_nothing():
    """What is settled by trimming and matched words agrees with the distance in full."""
    rng = random.Random(1)
    for _ in range(1500):
        w = ["".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))]
        v = list(w)
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(v) + 1)
            v[k : k + rng.randrange(2)] = ["".join(rng.choices("abc", k=rng.randrange(1, 5)))] * rng.randrange(2)
        a, b = " ".join(w).encode(), " ".join(v).encode()
        d = L.edit_distance(a, b, 10**6)
        assert L.similar(a, b, 80, 100) == (bool(a and b) and d <= max(len(a), len(b)) * 20 // 100)
        assert L.edit_distance(*L.trimmed(a, b), 10**6) == d <= sum(L.edit_distance(x, y, 10**6) for x, y in L.aligned(a, b))


def test_distances_side_by_side():
    """Many pairs at once have the distances of each by itself, whatever their words and ends."""
    rng = random.Random(3)
    for low, high in ((1, 70), (120, 200)):
        norm = [bytes(rng.choices(b"abcd ", k=rng.randrange(low, high))) for _ in range(40)]
        norm += [x[: len(x) // 2] + b"zz" + x[len(x) // 2 :] for x in norm[:20]]
        words = np.array([-(-len(x) // 64) for x in norm])
        for w in np.unique(words):
            i = np.repeat(np.flatnonzero(words == w), 12)
            j = np.array([rng.randrange(len(norm)) for _ in i])
            assert L.distances(norm, i, j).tolist() == [L.edit_distance(norm[a], norm[b], 10**9) for a, b in zip(i, j)]
        i, j = np.triu_indices(len(norm), 1)
        assert L.all_similar(norm, i, j, 80, 100).tolist() == [L.similar(norm[a], norm[b], 80, 100) for a, b in zip(i, j)]


def test_names_that_differ_by_case(spark):
    """An input column named like an added one, in other letters, is replaced; others stay."""
    import public_tokenizers as P

    rows = [(1, "one line of words\nanother line of words here", "en", 5, 0.5, 1), (2, "one line of words", "en", 6, 0.5, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, N_Lines int, Score double, __GONE int")
    got = L.remove_lines(df, L.duplicate_lines(df.select("doc_id", "text")))
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "Score", "__GONE", "n_lines", "n_removed"])
    assert {r["doc_id"]: (r["text"], r["n_removed"], r["__GONE"]) for r in got.collect()} == {1: (rows[0][1], 0, 1), 2: ("", 1, 2)}
    model = G.train(df.select("doc_id", "text", "lang"), G.load_pieces(P.path("piece_bpe_32k.model")))
    out = G.predict(df, model)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "N_Lines", "__GONE", "lang_pred", "score"]) and out.count() == 2
