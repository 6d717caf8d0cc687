"""Language identification by segmentation-marginalised unigrams (operator 5).

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the product of
their probabilities: one forward pass per word, vectorised over many words and all
languages. A text's score for a language is the sum over its words; the prediction is the
language of the highest posterior under equal priors.

The probabilities are learnt by expectation maximisation on a bounded sample of labelled
rows (``per_language`` texts of each language, chosen by a hash, and their ``most_words``
most frequent words; documented bounds).

Cases: null text or text without a letter (Unicode category L) is ``und`` with score 0; words longer than
``BLOCK`` letters are scored in blocks; a null label isn't learnt from; ties go to the
alphabetically first language; with no labelled row every text is ``und``; an empty table
gives an empty result; doc_id, source and lang are never inputs of a prediction; columns named
lang_pred or score are replaced by the predicted ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

BLOCK = 48
#: What a worker remembers: at most so many words of so many letters in all.
MAX_WORDS, MAX_LETTERS = 300_000, 8_000_000
#: Scale per letter that keeps products of a block within double range.
SCALE, FLOOR = 500.0, 1e-6
_WORDS = re.compile(r"[^\W\d_]+").findall
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters of the lowered text; signs such as fractions or Roman numerals are none."""
    found = _WORDS((text or "").lower())
    if "".join(found).isalpha() or not found:
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def load_pieces(path: str) -> list[str]:
    """All pieces of letters, word start written as a space, in order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).replace("▁", " ").lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in pieces if p and all(c.isalpha() for c in p.removeprefix(" "))})


def _grow(h: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes of stretches that are one letter longer."""
    h = (h + letters.astype(np.uint64) + np.uint64(1)) * _MULT
    return h ^ (h >> np.uint64(29))


class Lattice:
    """Finds, for many words at once, the pieces that their stretches of letters are."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        keys = np.zeros(len(pieces), dtype=np.uint64)
        for k, p in enumerate(pieces):
            h = np.zeros(1, dtype=np.uint64)
            for c in p:
                h = _grow(h, np.array([ord(c)]))
            keys[k] = h[0]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True

    def letters(self, words: list[str]) -> np.ndarray:
        width = max(map(len, words))
        flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return flat.reshape(len(words), width)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, piece ids) of the stretches that are pieces."""
        rows = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if not len(rows):
            return rows, rows
        at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
        hit = self.keys[at] == h[rows]
        return rows[hit], self.order[at[hit]]

    def stretches(self, chars: np.ndarray, live: list[int]):
        """(end, length, rows, ids) of all pieces; ``live[i]`` leading rows have more than i letters."""
        hashes: dict[int, np.ndarray] = {}
        for i in range(1, chars.shape[1] + 1):
            n = live[i - 1]
            hashes[i - 1] = np.zeros(n, dtype=np.uint64)
            hashes.pop(i - 1 - self.longest, None)
            for start in range(i - 1, max(-1, i - 1 - self.longest), -1):
                hashes[start] = _grow(hashes[start][:n], chars[:n, i - 1])
                yield i, i - start, *self.find(hashes[start])

    def score(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log probability of each word (at most BLOCK letters and a space) in each language."""
        size = np.array([len(w) for w in words])
        by = np.argsort(-size, kind="stable")
        chars = self.letters([words[i] for i in by])
        size = size[by]
        live = [int(np.searchsorted(-size, -i, side="right")) for i in range(1, chars.shape[1] + 1)]
        out = np.zeros((len(words), prob.shape[1]))
        alpha = [np.ones((len(words), prob.shape[1]))]
        for i, n, rows, ids in self.stretches(chars, live):
            if n == 1:
                single = np.full((live[i - 1], prob.shape[1]), FLOOR)
                single[rows] = np.maximum(prob[ids], FLOOR)
                alpha.append(alpha[i - 1][: live[i - 1]] * single * SCALE)
            elif len(rows):
                alpha[i][rows] += alpha[i - n][rows] * prob[ids] * SCALE**n
        for i in range(1, chars.shape[1] + 1):
            ends = int(np.searchsorted(-size, -i, side="left"))
            out[by[ends : live[i - 1]]] = np.log(alpha[i][ends:]) - i * np.log(SCALE)
        return out


def expected_counts(lat: Lattice, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words (longest first), one language."""
    chars = lat.letters(words)
    size = np.array([len(w) for w in words])
    n_words, width = chars.shape
    live = [int(np.searchsorted(-size, -i, side="right")) for i in range(1, width + 1)]
    alpha = np.zeros((width + 1, n_words))
    beta = np.zeros((width + 1, n_words))
    alpha[0] = 1
    beta[size, np.arange(n_words)] = 1
    uses = []
    for i, n, rows, ids in lat.stretches(chars, live):
        p = prob[ids] * SCALE**n
        if n == 1:
            every = np.full(live[i - 1], FLOOR * SCALE)
            every[rows] = p = np.maximum(p, FLOOR * SCALE)
            alpha[i, : live[i - 1]] += alpha[i - 1, : live[i - 1]] * every
            uses.append((i, 1, np.arange(live[i - 1]), every, None))
        else:
            alpha[i, rows] += alpha[i - n, rows] * p
        uses.append((i, n, rows, p, ids))
    for i, n, rows, p, ids in sorted(uses, key=lambda u: -u[0]):
        if n > 1 or ids is None:
            beta[i - n, rows] += beta[i, rows] * p
    whole = alpha[size, np.arange(n_words)]
    counts = np.zeros(len(prob))
    for i, n, rows, p, ids in uses:
        if ids is not None:
            counts += np.bincount(ids, weights=weight[rows] * alpha[i - n, rows] * p * beta[i, rows] / whole[rows], minlength=len(prob))
    counts[-1] = 0
    return counts


def blocks(word: str) -> list[str]:
    return [(" " if i == 0 else "") + word[i : i + BLOCK] for i in range(0, len(word), BLOCK)]


class Model:
    def __init__(self, languages: list[str], prob: np.ndarray, pieces: list[str]):
        self.languages, self.prob, self.lat = languages, prob, Lattice(pieces)
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))
        self.letters = 0

    def __reduce__(self):
        return Model, (self.languages, self.prob, self.lat.pieces)

    def learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            cut = [blocks(w) for w in part]
            flat = self.lat.score([b for c in cut for b in c], self.prob)
            at = np.concatenate([[0], np.cumsum([len(c) for c in cut])[:-1]])
            scores = np.add.reduceat(flat, at, axis=0)
            base = len(self.index)
            if base + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(part), len(self.rows), 1 << 16), len(self.languages)))])
            self.rows[base : base + len(part)] = scores
            self.index.update(zip(part, range(base, base + len(part))))
            self.letters += sum(map(len, part))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [words_of(t) for t in texts]
        fresh = set().union(*cut).difference(self.index)
        if len(self.index) + len(fresh) > MAX_WORDS or self.letters > MAX_LETTERS:  # start afresh: memory stays bounded
            self.index, self.rows, self.letters = {}, self.rows[:0], 0
            fresh = set().union(*cut)
        if fresh and self.languages:
            self.learn(sorted(fresh))
        out = []
        for words in cut:
            if not words or not self.languages:
                out.append(("und", 0.0))
                continue
            total = self.rows[list(map(self.index.__getitem__, words))].sum(axis=0)
            p = np.exp(total - total.max())
            k = int(p.argmax())
            out.append((self.languages[k], float(p[k] / p.sum())))
        return out


def train(docs: DataFrame, pieces: list[str], per_language: int = 200, rounds: int = 2, most_words: int = 50_000) -> Model:
    """Fit on (doc_id, text, lang): at most ``per_language`` texts of each language, ``most_words`` words of up to 256 letters."""
    labelled = docs.filter("lang is not null and text is not null")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = labelled.select("doc_id", "lang").withColumn("rn", order).filter(F.col("rn") <= per_language).select("doc_id", "lang")
    sample = labelled.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])  # at most per_language rows a language

    def words(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                every = words_of(text)
                for lo in range(0, len(every), 100_000):
                    found = [w[:256] for w in every[lo : lo + 100_000]]
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "word": found})

    counts = sample.select("lang", "text").mapInArrow(words, "lang string, word string").groupBy("lang", "word").count()
    common = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    rows = counts.withColumn("rn", common).filter(F.col("rn") <= most_words).select("lang", "word", "count").collect()
    by: dict[str, dict[str, int]] = {}
    for lang, word, n in rows:
        for b in blocks(word):
            by.setdefault(lang, {}).setdefault(b, 0)
            by[lang][b] += n
    languages, lat = sorted(by), Lattice(pieces)
    prob = np.zeros((len(pieces) + 1, len(languages)))
    for k, lang in enumerate(languages):
        listed = sorted(by[lang], key=lambda w: (-len(w), w))
        weight = np.array([by[lang][w] for w in listed], dtype=float)
        p = np.full(len(pieces) + 1, 1.0 / len(pieces))
        for _ in range(rounds):
            counts = np.zeros(len(p))
            for lo in range(0, len(listed), 4000):
                counts += expected_counts(lat, listed[lo : lo + 4000], weight[lo : lo + 4000], p)
            counts[:-1] += 0.01
            p = counts / counts.sum()
            p[-1] = 0
        prob[:, k] = p
    return Model(languages, prob, pieces)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All rows of ``docs`` (all columns) with lang_pred and score added."""
    return _predict(docs, model, [c for c in docs.columns if c.lower() not in ("lang_pred", "score")])


def _predict(docs: DataFrame, model: Model, keep: list[str], report: bool = True) -> DataFrame:
    """Columns ``keep`` and the prediction; without ``report``, ``keep`` of the rows whose language is known."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x pieces, a fixed size

    def run(batches):
        m = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = m.predict(part.column("text").to_pylist())
                cols = [part.column(c) for c in keep]
                if report:
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*keep, "lang_pred", "score"]
                    )
                else:
                    yield pa.RecordBatch.from_arrays(cols, keep).filter(pa.array([g[0] != "und" for g in got], pa.bool_()))

    kind = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["lang_pred string", "score double"] * report
    return docs.mapInArrow(run, ", ".join(kind))


def fold(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def trained_on(docs: DataFrame) -> Model:
    """The model of a documents table, from the folds that aren't held out."""
    import public_tokenizers as P

    return train(docs.select("doc_id", "text", "lang").filter(fold() != 1), load_pieces(P.path("piece_bpe_32k.model")))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = _predict(docs.select("doc_id", "text"), trained_on(docs), ["doc_id"])
    return out.select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without an identifiable language (``und``) go."""
    return _predict(docs, trained_on(docs), docs.columns, report=False)
