"""Tokenising operators against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from skuscope.llm import bpe_transducer as B
from skuscope.llm import packing as K
from skuscope.llm import token_counts as C
from skuscope.llm import token_shards as S
from skuscope.llm.library_tokens import encoder

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a", "a  b\n\n c\t d <|endoftext|> x", "I've 12,345 <|endoftext|>.", "日本語 テキスト 🎉🎉 naïve é", "don't 'RE 'll  ",
    " lead", "trail ", "ΣΑΣ İstanbul ß", "\x00\x1c \x85a\xa0b \x01 c", "<|startoftext|>hi<|endoftext|>", "x'y", "'", "((a.,), b.", "word, word. Word!\nWord", "z" * 5000, "a\n\nb\n\n\nc   d \n e  ", "x\n\n<|endoftext|>\n\n", "İ. נּ. נּ, ½.",
    "word, word. Word!\nWord", "<|endoftext|> b <|ENDOFTEXT|> <|EndOfText|>", "क़लम a ﬁn ﬀ ǅ ß ẞ aͅ b ẛ̣ q ªº ʰ ა Ა ᲀ İx",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, start double")


@pytest.fixture(scope="module")
def texts(spark):
    got = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] or "" for r in got}


def test_bpe_matches_tiktoken(spark, odd, texts):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = B.load_ranks(path)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in B.op1_byte_bpe(spark, SF).collect()}
    assert len(got) == len(texts)
    more = {r["doc_id"] + 10**6: r for r in B.encode_documents(odd, path, P.PATTERN).collect()}
    for i, t in [*texts.items(), *((10**6 + k, t or "") for k, t in enumerate(ODD))]:
        r, ids = {**got, **more}[i], ref.encode_ordinary(t)
        assert r["n_tokens"] == len(ids) and r["decoded_ok"]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert B.encode_documents(odd.limit(0), path, P.PATTERN).count() == 0


def test_transducer_lookahead_is_bounded_and_reset_is_harmless():
    m = B.Transducer({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"cd": 258, b"abcd": 259})
    for w in (b"abcd", b"abc", b"abab", b"xabcdcd", b"", b"cdab"):
        assert m.encode(w) == m.merge(w)
    assert max(len(out) for c in m.configs for out, _, _ in c) <= 4
    m.reset()
    assert m.encode(b"abcdab") == m.merge(b"abcdab")


def test_stream_decoder_waits_for_split_characters():
    d = B.StreamDecoder({i: bytes([i]) for i in range(256)})
    raw = "é🎉x".encode()
    assert [d.feed([b]) for b in raw] == ["", "é", "", "", "", "🎉", "x"]
    bad = b"\xe9a\xf0\x9f\xff\xed\xa0\x80b\xc3"
    assert d.feed(bad) + d.finish() == bad.decode("utf-8", "replace")
    assert not d.decode_bytes(np.frombuffer(bad, np.uint8).astype(np.uint32))[1]


def test_library_chunks_equal_whole_texts(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ref = Tokenizer.from_file(P.path(name))
        many = [t or "" for t in ODD] + list(texts.values())
        for t, ids in zip(many, encoder(P.path(name)).encode(many)):
            assert ids.tolist() == ref.encode(t, add_special_tokens=False).ids, t[:80]


def test_every_assigned_character():
    """Before and after a full stop, alone and in a word, in all four encoders."""
    import unicodedata

    texts = [f"x{c}. {c}, y" for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ref = [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
        assert [i.tolist() for i in encoder(P.path(name)).encode(texts)] == ref
    c = C.counter(P.path("word_bpe_49k.json"))
    assert [int(c.chunk_ends(t)[1][-1]) for t in texts] == [len(i) for i in ref]
    ranks = B.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = B.Encoder(ranks, P.PATTERN)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(own.encode(t).tolist() == want.encode_ordinary(t) for t in texts)


PIECES = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\x1c", "\x85", "a", "Bc", ".", ",", "'", "'s", "'re", "'R", "é", "e\u0301", "\u0301", "İ", "日本語", "1", "½", "<|endoftext|>", "<|", "!",
    "ﬁ", "क़", "नि", "한", "\u1112\u1161\u11ab", "\x01",
]


def test_random_strings_and_their_prefixes():
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(PIECES, rng.integers(1, 9))) for _ in range(20_000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        ref = [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)]
        assert [i.tolist() for i in encoder(P.path(name)).encode(texts)] == ref
    ranks = B.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    own, want = B.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(own.encode(t).tolist() == want.encode_ordinary(t) for t in texts)
    c = C.counter(P.path("word_bpe_49k.json"))
    for t in texts[:1000]:
        assert c.table(t).tolist() == [len(e.ids) for e in c.tokenizer.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)], t


def test_workers_remember_a_bounded_amount():
    texts = [f"word{i} one\n\n" + "日本" * i + "\n \n  tail  " for i in range(400)] + ["z" * 100_000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(P.path(name))
        list(e.encode(texts))
        assert max(map(len, e.known)) <= 64 and sum(map(len, e.known)) == e.chars
    own = B.Encoder(B.load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    for t in texts[:50]:
        own.encode(t)
    assert max(map(len, own.paths)) <= B.KEPT
    c = C.counter(P.path("word_bpe_49k.json"))
    assert len(c.table("日本語テキスト" * 1500)) == 7 * 1500 + 1  # linear: seconds, not minutes
    assert max(map(len, c.words)) <= C.KEPT


def test_token_counts(spark, odd, texts):
    path = P.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    for r in [*C.op9_token_counts(spark, SF).collect(), *C.count_tokens(odd.withColumn("doc_id", -1 - odd.doc_id), path).collect()]:
        t = texts[r["doc_id"]] if r["doc_id"] >= 0 else ODD[-1 - r["doc_id"]] or ""
        n = len(ref.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_every_prefix_count(texts):
    c = C.counter(P.path("word_bpe_49k.json"))
    for t in [t or "" for t in ODD if len(t or "") < 100] + [t[:200] for t in list(texts.values())[:20]]:
        want = [len(c.tokenizer.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert c.table(t).tolist() == want, t
        for budget in (0, 1, 5, 17):
            k = c.longest_prefix(t, budget)
            assert k == max(j for j, n in enumerate(want) if n <= budget)


def test_bit_packing_round_trip():
    rng = np.random.default_rng(1)
    for size in (2, 3, 300, 50257, 65536, 70000, 2**20):
        bits = S.bits_for(size)
        for n in (0, 1, 7, 1000):
            ids = rng.integers(0, size, n).astype(np.uint32)
            raw = S.pack_bits(ids, bits)
            assert len(raw) == -(-n * bits // 8) and (S.unpack_bits(raw, bits, n) == ids).all()


def test_shards(spark, odd, texts, tmp_path):
    path = P.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)

    def held(rows, docs):
        at = 0
        for r, (i, t) in zip(sorted(rows, key=lambda r: (r["start"])), docs, strict=True):
            ids = [*ref.encode(t, add_special_tokens=False).ids, 2]
            assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            at += len(ids)

    held(S.op7_token_shards(spark, SF).collect(), sorted(texts.items()))
    uri = f"file://{tmp_path}/odd"
    held(S.read_shards(spark, uri, S.write_shards(odd, uri, path, 2)).collect(), [(i, t or "") for i, t in enumerate(ODD)])
    assert S.read_shards(spark, uri, S.write_shards(odd.limit(0), f"{uri}-none", path, 2)).count() == 0


def test_shard_random_access(tmp_path):
    rng = np.random.default_rng(2)
    w = S.ShardWriter(str(tmp_path), "x", 17)
    docs = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 200_000, 1, 65_536, 3)]
    for i, d in enumerate(docs):
        w.add(None if i == 1 else i, d)
    assert w.close() == (6, sum(map(len, docs)))
    r = S.ShardReader(str(tmp_path), "x")
    for i in (5, 2, 0, 4, 3, 1):
        assert (r.document(i) == docs[i]).all()
    assert (r.ids(65_530, 65_550) == np.concatenate(docs)[65_530:65_550]).all()


def check_packing(rows, docs, ref):
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(docs)
    for i, t in docs.items():
        ids = np.array([*ref.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    pad = total = 0
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        pad += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    return pad / total


def test_packing(spark, odd, texts):
    ref = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert check_packing(K.op8_packing(spark, SF).collect(), texts, ref) < 0.001
    assert check_packing(K.pack(spark, odd, SF).collect(), dict(enumerate(t or "" for t in ODD)), ref) < 0.001
    assert K.pack(spark, odd.limit(0), SF).count() == 0


def test_subset_is_the_best_one():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(n): int(k) for n, k in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6))}
        cap = int(rng.integers(1, 90))
        got = K.best_subset(counts, cap)
        assert all(k <= counts[n] for n, k in got.items())
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1) if s + n * j <= cap}
        assert sum(n * k for n, k in got.items()) == max(sums)
