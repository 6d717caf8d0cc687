"""Exact token counts at every prefix (operator 9).

For one word (a match of the tokenizer's pattern) a dynamic program over its symbols
stores, for every prefix, the last token of its BPE encoding and the number of tokens:
the last token is the only vocabulary entry ending there that BPE keeps apart from the
last token before it. Words don't interact, so the count at any prefix of a text is the
running sum of its finished words plus the entry of the word it cuts. Totals, truncation
points and budget questions read the table; nothing is encoded again.

Text outside the program's alphabet (special strings, unnormalised or irregular scripts)
takes its total from the library; its prefixes run through the same program, one cluster (a
character and what composes with it) after another, in time linear in their length.

Cases: null text counts as empty (0 bytes, 0 tokens); texts of any length are whole;
an empty table gives an empty result; repeated rows and other columns are harmless.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import cut
from .library_tokens import texts_of

#: What a worker remembers: words of at most KEPT characters, and pairs of tokens.
MAX_WORDS, MAX_PAIRS, KEPT = 1_000_000, 2_000_000, 24


def composing() -> frozenset[str]:
    """Characters that may join with what stands before them when text is composed."""
    out = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        ch = chr(c)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out.add(chr(int(parts[1], 16)))
        if unicodedata.combining(ch):
            out.add(ch)
    return frozenset(out)


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte: itself if printable Latin-1, else from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Word:
    """The program's table of one word, grown and cut back symbol by symbol."""

    def __init__(self, owner: "PrefixCounter", text: str = ""):
        self.owner, self.text, self.last, self.count = owner, "", [""], [0]
        self.push(text)

    def push(self, more: str) -> None:
        self.text += more

    def upto(self, size: int) -> None:
        vocab, fits, longest, text = self.owner.vocab, self.owner.fits, self.owner.longest, self.text
        for i in range(len(self.last), size):
            for j in range(max(0, i - longest), i):
                t = text[j:i]
                if t in vocab and fits(self.last[j], t):
                    self.last.append(t)
                    self.count.append(self.count[j] + 1)
                    break

    def cut(self, size: int) -> None:
        self.text = self.text[:size]
        del self.last[max(size, 1) :], self.count[max(size, 1) :]

    def total(self) -> int:
        """Tokens of what stands there, taken as a whole word."""
        size, owner = len(self.text), self.owner
        self.upto(size)
        for j in range(max(0, size - owner.longest), size):
            t = self.text[j:] + owner.end
            if t in owner.vocab and owner.fits(self.last[j], t):
                return self.count[j] + 1
        return 0


class Scan:
    """Counts after each character of normalised text; ``mark`` and ``back`` undo trial steps.

    Kinds of the open word: L letters, P other signs, N closed, A an apostrophe that may begin
    a contraction, B an apostrophe and a letter that may.
    """

    def __init__(self, owner: "PrefixCounter"):
        self.owner, self.done, self.word, self.kind, self.before = owner, 0, Word(owner), "", (0, "")

    def mark(self) -> tuple:
        return self.done, self.word, len(self.word.text), self.kind, self.before

    def back(self, state: tuple) -> None:
        self.done, self.word, size, self.kind, self.before = state
        self.word.cut(size)

    def total(self) -> int:
        return self.done + self.word.total()

    def open(self, text: str, kind: str) -> None:
        self.done, self.word, self.kind = self.total(), Word(self.owner, text), kind

    def step(self, ch: str) -> None:
        kind, text = self.owner.kind_of(ch), self.owner._stand_in(ch)
        if self.kind == "B":
            done, first = self.before
            if first + ch in ("re", "ve", "ll"):
                self.done, self.word, self.kind = done, Word(self.owner, f"'{first}{ch}"), "N"
                return
            self.kind = "L"
        if self.kind == "A" and ch in "stmd":
            self.word.push(ch)
            self.kind = "N"
        elif self.kind == "A" and ch in "rvl":
            self.before = (self.done, ch)
            self.open(ch, "B")
        elif kind == "P" and self.kind in ("A", "P") or kind == "L" and self.kind == "L":
            self.word.push(text)
            self.kind = kind
        elif not kind:
            self.open("", "")
        else:
            self.open(text, "A" if ch == "'" else kind)


class PrefixCounter:
    def __init__(self, path: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {}
        for i, m in enumerate(model["merges"]):
            self.rank[tuple(m.split(" ")) if isinstance(m, str) else tuple(m)] = i
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).finditer
        self.letters = byte_alphabet()
        self.longest = max(map(len, self.vocab))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.kinds: dict[str, str] = {}
        self.joins: frozenset[str] = frozenset()

    def kind_of(self, ch: str) -> str:
        """L, N, P or nothing (white space), as the library's own pre-tokenizer splits."""
        kind = self.kinds.get(ch)
        if kind is None:
            pieces = lambda t: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(t))
            kind = "" if not pieces(ch) else "L" if pieces("a" + ch) == 1 else "P" if pieces("!" + ch) == 1 else "N"
            self.kinds[ch] = kind
        return kind

    def merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = self.rank.get((symbols[i], symbols[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def fits(self, last: str, token: str) -> bool:
        key = (last, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            known = self.merge(self.symbols(last) + self.symbols(token)) == ([last, token] if last else [token])
            self.pairs[key] = known
        return known

    def word_table(self, word: str, every: bool) -> list[int]:
        """Tokens of word[:1], word[:2], ... taken as whole words; only the last unless ``every``."""
        last, count = [""], [0]
        out = []
        vocab, end, longest, fits = self.vocab, self.end, self.longest, self.fits
        size = len(word)
        for i in range(1, size + 1):
            if every or i == size:
                low = max(0, i - longest)
                for j in range(low, i):
                    t = word[j:i] + end
                    if t in vocab and fits(last[j], t):
                        out.append(count[j] + 1)
                        break
            if i < size:
                for j in range(max(0, i - longest), i):
                    t = word[j:i]
                    if t in vocab and fits(last[j], t):
                        last.append(t)
                        count.append(count[j] + 1)
                        break
        return out

    def plain(self, chunk: str) -> bool:
        return (
            not chunk or chunk.isascii() or (max(chunk) < "ɐ" and unicodedata.is_normalized("NFC", chunk))
        ) and not ("<|" in chunk and any(s in chunk for s in self.special)) and "İ" not in chunk

    def _stand_in(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def chunk_total(self, chunk: str) -> int:
        n = self.words.get(chunk)
        if n is None:
            if self.plain(chunk):
                n = sum(self.word_table(self._stand_in(m[0]), False)[0] for m in self.find(chunk.lower()))
            else:
                n = self.library(chunk)
            if len(chunk) <= KEPT:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[chunk] = n
        return n

    def scan(self, text: str) -> list[int]:
        """Tokens of text[:1], text[:2], ...; ``text`` holds no special string."""
        self.joins = self.joins or composing()
        form, state, out, lo = self.tokenizer.normalizer.normalize_str, Scan(self), [], 0
        while lo < len(text):
            hi = lo + 1
            while hi < len(text) and text[hi] in self.joins:
                hi += 1
            start = state.mark()
            for k in range(lo + 1, hi + 1):
                state.back(start)
                for ch in form(text[lo:k]):
                    state.step(ch)
                out.append(state.total())
            lo = hi
        return out

    def chunk_table(self, chunk: str) -> list[int]:
        """Tokens of chunk[:1], chunk[:2], ..."""
        out, done = [], 0
        if not self.plain(chunk) or "'" in chunk:
            lo = 0
            while lo < len(chunk):
                at, special = min(((i, s) for s in self.special if (i := chunk.find(s, lo)) >= 0), default=(len(chunk), ""))
                hi = at + len(special)
                part = self.scan(chunk[lo : hi - 1] if special else chunk[lo:])
                out += [done + n for n in part]
                if special:
                    done += (part[at - lo - 1] if at > lo else 0) + 1
                    out.append(done)
                lo = hi
            return out
        for m in self.find(chunk.lower()):
            out += [done] * (m.start() - len(out))
            table, at = self.word_table(self._stand_in(m[0]), True), 0
            for ch in m[0]:
                at += len(ch.encode())
                out.append(done + table[at - 1])
            done = out[-1]
        return out + [done] * (len(chunk) - len(out))

    def chunk_ends(self, text: str) -> tuple[list[str], np.ndarray]:
        """The chunks and the running count after each: the table at chunk ends."""
        chunks = cut(text, True)
        known = self.words.get
        return chunks, np.cumsum([n if (n := known(c)) is not None else self.chunk_total(c) for c in chunks])

    def table(self, text: str) -> np.ndarray:
        """Exact counts at all len(text) + 1 prefixes."""
        out = [0]
        for chunk in cut(text, True):
            done = out[-1]
            out += [done + k for k in self.chunk_table(chunk)]
        return np.array(out, dtype=np.int64)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Length of the longest prefix that has at most ``budget`` tokens."""
        chunks, ends = self.chunk_ends(text)
        k = int(np.searchsorted(ends, budget, side="right"))
        at = sum(map(len, chunks[:k]))
        if k < len(chunks):  # counts at chunk ends never fall, so no later chunk holds a fit
            before = int(ends[k - 1]) if k else 0
            at += max((j for j, n in enumerate(self.chunk_table(chunks[k]), 1) if before + n <= budget), default=0)
        return at


_loaded: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (longest prefix within the limit)."""

    def run(batches):
        c = counter(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = texts_of(part.column(1))
                ends = [c.chunk_ends(t)[1] for t in texts]
                total = [int(e[-1]) for e in ends]
                fit = [len(t) if n <= limit else c.longest_prefix(t, limit) for t, n in zip(texts, total)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(total, pa.int64()),
                     pa.array([n > limit for n in total]), pa.array(fit, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    kind = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("word_bpe_49k.json"))
