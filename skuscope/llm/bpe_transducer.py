"""Byte-level BPE as a lazily determinised transducer, and streaming decode (operator 1).

Encoding. A token sequence is the BPE encoding of a text exactly if each token encodes
to itself and each adjacent pair (s, t) is what BPE gives for bytes(s) + bytes(t). The
merges thus define a nondeterministic transducer whose configurations are (last token,
trie node of the token being read); exactly one configuration stands at a token boundary
after every byte. States of the deterministic machine are sets of configurations with
their not yet emitted outputs; they are built on demand and emit a token as soon as all
live configurations agree on it, so lookahead is bounded by the longest token. Paths of
short chunks (at most ``KEPT`` characters) are remembered up to a fixed number.

Decoding. Each token id moves a four-phase UTF-8 state machine; transitions of whole
tokens are compiled on demand from the byte-level machine, bytes of incomplete
characters wait for the next token, and ill-formed bytes become U+FFFD in the text form.

Cases: null text counts as empty (0 tokens, digests of the empty string); texts of any
length stream through in documents; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import cut

#: Bounds of what one Python worker remembers; beyond them it starts afresh.
MAX_STATES, MAX_PATHS, MAX_PAIRS, KEPT = 300_000, 700_000, 1_000_000, 24


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.terminal: list[int] = [-1]
        for word, token in ranks.items():
            node = 0
            for byte in word:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][byte] = nxt
                    self.children.append({})
                    self.terminal.append(-1)
                node = nxt
            self.terminal[node] = token
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.index: dict[tuple, int] = {}
        self.configs: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.ends: list[tuple] = []
        self.state((((), -1, 0),))

    def merge(self, word: bytes) -> list[int]:
        """BPE by lowest rank first, for the pair test."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, last: int, token: int) -> bool:
        key = (last, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            if last < 0:
                known = self.merge(self.tokens[token]) == [token]
            else:
                known = self.merge(self.tokens[last] + self.tokens[token]) == [last, token]
            self.pairs[key] = known
        return known

    def state(self, configs: tuple) -> int:
        number = self.index.get(configs)
        if number is None:
            number = len(self.configs)
            self.index[configs] = number
            self.configs.append(configs)
            self.moves.append({})
            self.ends.append(next((out for out, _, node in configs if node == 0), ()))
        return number

    def step(self, number: int, byte: int) -> tuple[int, tuple]:
        """Determinise one move: (next state, tokens emitted)."""
        after = []
        for out, last, node in self.configs[number]:
            nxt = self.children[node].get(byte)
            if nxt is None:
                continue
            token = self.terminal[nxt]
            if token >= 0 and self.fits(last, token):
                after.append((out + (token,), token, 0))
            if self.children[nxt]:
                after.append((out, last, nxt))
        first = after[0][0]
        common = len(first)
        for out, _, _ in after[1:]:
            k = 0
            while k < min(common, len(out)) and out[k] == first[k]:
                k += 1
            common = k
        if common:
            after = [(out[common:], last, node) for out, last, node in after]
        move = (self.state(tuple(sorted(after))), first[:common])
        self.moves[number][byte] = move
        return move

    def encode(self, word: bytes) -> list[int]:
        if len(self.configs) > MAX_STATES:
            self.reset()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in word:
            move = moves[state].get(byte)
            if move is None:
                move = self.step(state, byte)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.ends[state])
        return out


class Encoder:
    """Splits a text by the pattern and runs each match through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.paths: dict[str, bytes] = {}

    def _piece(self, chunk: str) -> bytes:
        """Ids (little-endian 32 bit) of one chunk that begins and ends at pattern boundaries."""
        ids: list[int] = []
        for match in self.find(chunk):
            ids += self.machine.encode(match.encode("utf-8", "surrogatepass"))
        raw = array("I", ids).tobytes()
        if len(chunk) <= KEPT:
            if len(self.paths) >= MAX_PATHS:
                self.paths.clear()
            self.paths[chunk] = raw
        return raw

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        known, piece = self.paths.get, self._piece
        return np.frombuffer(b"".join([known(c) or piece(c) for c in cut(text, False) if c]), dtype="<u4")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# ------------------------------------------------------------------------------- decoding
#: Phases of the UTF-8 machine: (bytes still due, lowest and highest next byte).
_START = (0, 0x00, 0x7F)


def utf8_step(phase: tuple, byte: int) -> tuple | None:
    """Next phase, or None if ``byte`` can't stand here (well-formed ranges of Unicode table 3-7)."""
    due, low, high = phase
    if due:
        return ((due - 1, 0x80, 0xBF) if due > 1 else _START) if low <= byte <= high else None
    if byte < 0x80:
        return _START
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


class StreamDecoder:
    """Incremental decoder: feed ids, get text; characters split over tokens wait."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.table: dict[tuple, tuple] = {}
        self.phase, self.held = _START, b""
        size = max(tokens) + 1
        self.whole = np.zeros(size, dtype=bool)  # tokens that are complete characters
        self.bytes: list[bytes] = [tokens.get(i, b"") for i in range(size)]
        for i, b in tokens.items():
            phase = _START
            for x in b:
                phase = phase and utf8_step(phase, x)
            self.whole[i] = phase == _START

    def _token(self, phase: tuple, held: bytes, raw: bytes) -> tuple[tuple, bytes, str]:
        out = ""
        for x in raw:
            nxt = utf8_step(phase, x)
            if nxt is None:
                out += "�" if held else ""
                held, phase = b"", _START
                nxt = utf8_step(_START, x)
                if nxt is None:
                    out += "�"
                    continue
            held, phase = held + bytes([x]), nxt
            if phase == _START:
                out, held = out + held.decode(), b""
        return phase, held, out

    def feed(self, ids) -> str:
        out = []
        for i in ids:
            key = (self.held, int(i))
            move = self.table.get(key)
            if move is None:
                if len(self.table) > MAX_STATES:
                    self.table.clear()
                move = self.table[key] = self._token(self.phase, self.held, self.bytes[int(i)])
            self.phase, self.held = move[0], move[1]
            out.append(move[2])
        return "".join(out)

    def finish(self) -> str:
        out = "�" if self.held else ""
        self.phase, self.held = _START, b""
        return out

    def decode_bytes(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """Bytes of the ids and whether they are well-formed UTF-8.

        Runs of complete tokens keep the machine in its start phase, so it only steps
        through the others.
        """
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        odd = np.flatnonzero(~self.whole[ids])
        phase: tuple | None = _START
        last = -2
        for p in odd.tolist():
            if p != last + 1 and phase != _START:
                return raw, False
            for x in self.bytes[int(ids[p])]:
                phase = utf8_step(phase, x)
                if phase is None:
                    return raw, False
            last = p
        return raw, phase == _START


_workers: dict[tuple, tuple] = {}


def _worker(path: str, pattern: str) -> tuple[Encoder, StreamDecoder, list[str]]:
    key = (path, pattern)
    if key not in _workers:
        ranks = load_ranks(path)
        encoder = Encoder(ranks, pattern)
        _workers[key] = (encoder, StreamDecoder(encoder.machine.tokens), [str(i) for i in range(max(ranks.values()) + 1)])
    return _workers[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_ok (and the ids)."""

    def run(batches):
        encoder, decoder, names = _worker(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, sha, back, ok, kept = [], [], [], [], []
                for text in part.column(1):
                    ids = encoder.encode(text.as_py() or "")
                    n.append(len(ids))
                    sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                    raw, fine = decoder.decode_bytes(ids)
                    back.append(hashlib.sha256(raw).hexdigest())
                    ok.append(fine)
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.array(ok)]
                names_ = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_ok"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names_.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names_)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, kind + (", ids array<int>" if with_ids else ""))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
