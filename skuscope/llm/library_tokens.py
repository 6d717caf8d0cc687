"""Whole-text encoding by the tokenizers library, with chunks remembered.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct chunk is
encoded by the library once per worker, and ids are concatenated. What a worker remembers
is bounded in chunks and in characters; chunks of more than ``KEPT`` characters (texts for
which the cut isn't certain are one chunk) are encoded where they occur and forgotten.
"""

from __future__ import annotations

from array import array

import numpy as np

from .chunks import cut

#: At most so many chunks and characters of chunks are remembered, each of at most KEPT characters.
MAX_CHUNKS, MAX_CHARS, KEPT, WORDS_A_CALL = 700_000, 12_000_000, 64, 256
_loaded: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """kind "byte": byte-level pattern, white space joins the next word; kind "word": white
    space is dropped and letters are lowered; else texts are encoded whole."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        pre = spec.get("pre_tokenizer") or {}
        spaces = any(s.get("type") == "Replace" and s["pattern"].get("Regex") == "\\s+" for s in steps)
        removed = any(s.get("type") == "Split" and s.get("invert") for s in pre.get("pretokenizers", []))
        self.kind = "word" if spaces and removed else "byte" if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not steps else "whole"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or t["content"][:2] != "<|" for t in spec.get("added_tokens", [])):
            self.kind = "whole"
        self.size = self.tokenizer.get_vocab_size()
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.last = None  # ids that end a word, where the vocabulary marks them
        if self.kind == "word" and suffix:
            self.last = np.zeros(self.size, dtype=bool)
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.chars = 0
        self.encode_many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunks(self, text: str) -> list[str]:
        if self.kind == "whole":
            return [text]
        if self.kind == "word" and text.isascii():
            low = text.lower()  # as its normalizer does, but no special string may arise
            if not any(s in low for s in self.special):
                text = low
        return cut(text, self.kind == "word")

    def learn(self, new: list[str]) -> None:
        if self.last is not None:
            words, rest = [], []
            for c in new:
                (words if c.removeprefix(" ").isalpha() else rest).append(c)
            new = rest + self.learn_words(words)
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            for c, e in zip(part, self.encode_many(part, add_special_tokens=False)):
                self.known[c] = array("I", e.ids).tobytes()

    def learn_words(self, words: list[str]) -> list[str]:
        """Learns words of letters, many to a call; gives back those that must be encoded singly.

        Each has at least one pre-token, so as many word ends as words mean one each.
        """
        groups = [words[lo : lo + WORDS_A_CALL] for lo in range(0, len(words), WORDS_A_CALL)]
        left = []
        for lo in range(0, len(groups), 16):
            part = groups[lo : lo + 16]
            lines = [" ".join([w.removeprefix(" ") for w in g]) for g in part]
            for g, e in zip(part, self.encode_many(lines, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                if len(ends) != len(g):
                    left += g
                    continue
                data, at = ids.tobytes(), 0
                for w, end in zip(g, ends):
                    self.known[w] = data[at:end]
                    at = end
        return left

    def encode(self, texts: list[str]):
        """Ids (uint32 array) of each text, in order."""
        lo = 0
        while lo < len(texts):  # groups of bounded size
            hi, total = lo, 0
            while hi < len(texts) and (hi == lo or total + len(texts[hi]) < 1 << 20):
                total += len(texts[hi])
                hi += 1
            parts = [self.chunks(t) for t in texts[lo:hi]]
            known = self.known
            fresh = set().union(*parts).difference(known)
            more = sum(map(len, fresh))
            if len(known) + len(fresh) > MAX_CHUNKS or self.chars + more > MAX_CHARS:  # start afresh: memory stays bounded
                known.clear()
                fresh = {x for c in parts for x in c}
                self.chars, more = 0, sum(map(len, fresh))
            self.learn(list(fresh))
            found = [b"".join(map(known.__getitem__, c)) for c in parts]
            self.chars += more
            for c in fresh:
                if len(c) > KEPT:
                    del known[c]
                    self.chars -= len(c)
            for ids in found:
                yield np.frombuffer(ids, dtype="<u4")
            lo = hi


def encoder(path: str) -> ChunkEncoder:
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]


def texts_of(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]
