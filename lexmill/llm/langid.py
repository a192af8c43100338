"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability in a language is the sum over all ways to write it as a sequence of
pieces, taken by the forward algorithm; expectation-maximisation with the backward
algorithm fits the pieces. Words are scored whole, in blocks of equal length, all languages at once.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, in_steps, map_batches, materialize

#: Labelled documents per language that the model is fitted on, at most; taken by hash of the id.
SAMPLE_DOCS = 400
#: Rounds of expectation-maximisation.
ROUNDS = 3
#: Words remembered by each Python worker.
MEMO_WORDS = 200_000
#: Characters of words of one length that are walked through at once.
BLOCK_CHARS = 32_768
#: Ends of a word between two rescalings of its forward values.
RESCALE = 16
UNDETERMINED = "und"


def _letter_runs(last: int) -> Callable[[str], list[str]]:
    """Finds runs of letters, by Unicode category, in texts of characters up to ``last``: word characters that are neither digits, the low line, nor other numerals (as ½ or Ⅷ)."""
    numerals = "".join(c for c in map(chr, range(0x80, last + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    return re.compile(rf"[^\W\d_{re.escape(numerals)}]+").findall


#: The pattern for the basic plane is ten times as fast as that for all characters.
_basic_letters, _all_letters, _beyond = _letter_runs(0xFFFF), _letter_runs(sys.maxunicode), re.compile("[\U00010000-\U0010ffff]").search


def _letters(text: str) -> list[str]:
    return (_all_letters if _beyond(text) else _basic_letters)(text)


_P = np.uint64(0x9E3779B97F4A7C15)


class PieceTable:
    """Piece numbers of substrings, looked up by rolling hash in vectors."""

    BITS = 20

    def __init__(self, pieces: list[str]):
        self.pieces = sorted(set(pieces) - {""})
        self.longest = max(map(len, self.pieces), default=1)
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        rng = np.random.default_rng(0)
        while True:
            self.odd = [np.uint64(int(x) | 1) for x in rng.integers(0, 1 << 62, 2)]
            self.keys = np.zeros((2, 1 << self.BITS), np.uint64)
            self.ids = np.full((2, 1 << self.BITS), -1, np.int32)
            first = self._slot(hashes, 0)
            self.keys[0, first], self.ids[0, first] = hashes, np.arange(len(hashes))
            rest = np.flatnonzero(self.ids[0, first] != np.arange(len(hashes)))
            second = self._slot(hashes[rest], 1)
            if len(np.unique(second)) == len(rest):
                self.keys[1, second], self.ids[1, second] = hashes[rest], rest
                return

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def _slot(self, hashes: np.ndarray, table: int) -> np.ndarray:
        return ((hashes * self.odd[table]) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where a hash is no piece's."""
        slot = self._slot(hashes, 0)
        out = np.where(self.keys[0, slot] == hashes, self.ids[0, slot], -1)
        miss = np.flatnonzero(out < 0)
        slot = self._slot(hashes[miss], 1)
        out[miss] = np.where(self.keys[1, slot] == hashes[miss], self.ids[1, slot], -1)
        return out

    def matches(self, words: list[str]) -> list[list[tuple[int, np.ndarray]]]:
        """For words of one length: at [end] the (start, piece numbers) with a piece in any word."""
        size = len(words[0])
        codes = np.array(words).view(np.uint32).reshape(len(words), -1)[:, :size].astype(np.uint64) + np.uint64(1)
        found: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(size + 1)]
        for start in range(size):
            h = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                h = h * _P + codes[:, end - 1]
                ids = self.find(h)
                if end == start + 1 or (ids >= 0).any():
                    found[end].append((start, ids))
        return found


@dataclass
class LanguageModel:
    """languages; log probabilities (pieces + 1, languages), the last row for a character that no piece covers."""

    languages: list[str]
    pieces: list[str]
    weights: np.ndarray

    def table(self) -> PieceTable:
        return PieceTable(self.pieces)


def _forward(found, count: int, chance: np.ndarray, longest: int) -> np.ndarray:
    """(word, language) log probabilities over all segmentations; values within a piece's reach are rescaled on the way, so words may be of any length."""
    alpha = [np.ones((count, chance.shape[1]))]
    shift = np.zeros((count, chance.shape[1]))
    for end in range(1, len(found)):
        now = np.zeros((count, chance.shape[1]))
        for start, ids in found[end]:
            # Number -1 is the last row: an uncovered character; longer non-pieces have no chance.
            step = chance[ids]
            if end - start > 1:
                step = step * (ids >= 0)[:, None]
            now += alpha[start] * step
        alpha.append(now)
        if end >= longest:
            alpha[end - longest] = None
        if end % RESCALE == 0:
            for k in range(max(0, end - longest + 1), end + 1):
                alpha[k] = alpha[k] / now
            shift += np.log(now)
    return np.log(alpha[-1]) + shift


#: Letters of a word that is walked in blocks side by side, and of one stretch of it.
LONG_WORD, STRETCH = 2048, 1 << 16


def _chances(table: PieceTable, codes: np.ndarray, start: int, stop: int, chance: np.ndarray) -> np.ndarray:
    """(end, piece length - 1, language): chances of the pieces that end at each place from ``start`` + 1 to ``stop``; places before the word have none."""
    reach = table.longest
    low = max(0, start - reach + 1)
    text = codes[low:stop]
    out = np.zeros((stop - start, reach, chance.shape[1]))
    h = np.zeros(len(text), np.uint64)
    for size in range(1, min(reach, len(text)) + 1):
        h = h[: len(text) - size + 1] * _P + text[size - 1 :]
        ids = table.find(h)
        step = chance[ids]
        if size > 1:
            step = step * (ids >= 0)[:, None]
        ends = low + size + np.arange(len(h)) - start - 1
        out[ends[ends >= 0], size - 1] = step[ends >= 0]
    return out


def _long_forward(word: str, table: PieceTable, chance: np.ndarray) -> np.ndarray:
    """What ``_forward`` says of one long word, by languages. A stretch is cut in blocks, all of which are walked at once from every state that
    they can be entered in (how far back the last piece ended); the blocks' transfer matrices are then applied one after another."""
    codes = np.array([word]).view(np.uint32)[: len(word)].astype(np.uint64) + np.uint64(1)
    reach, langs = table.longest, chance.shape[1]
    now, shift = np.zeros((reach, langs)), np.zeros(langs)
    now[0] = 1
    at = 0
    while at < len(word):
        size = min(STRETCH, len(word) - at)
        steps = max(1, int(size**0.5))
        blocks = size // steps
        size = steps * blocks  # what is left over is the next stretch
        p = _chances(table, codes, at, at + size, chance).reshape(blocks, steps, reach, langs)
        states = np.zeros((blocks, reach, reach, langs))
        states[:, np.arange(reach), np.arange(reach)] = 1
        scale = np.zeros((blocks, langs))
        for t in range(steps):
            fresh = np.einsum("bkic,bkc->bic", states, p[:, t])
            states = np.concatenate((fresh[:, None], states[:, :-1]), axis=1)
            if t % RESCALE == RESCALE - 1:
                most = states.max((1, 2))
                states /= most[:, None, None]
                scale += np.log(most)
        for b in range(blocks):
            now = np.einsum("jic,ic->jc", states[b], now)
            most = now.max(0)
            now /= most
            shift += scale[b] + np.log(most)
        at += size
    return np.log(now[0]) + shift


def _grouped(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def _blocks(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(length, places) of words of equal length, BLOCK_CHARS characters or one word at a time."""
    for size, members in _grouped(words).items():
        step = max(1, BLOCK_CHARS // size)
        for at in range(0, len(members), step):
            yield size, members[at : at + step]


def score_words(words: list[str], table: PieceTable, chance: np.ndarray) -> np.ndarray:
    """(word, language) log probabilities of whole words."""
    out = np.zeros((len(words), chance.shape[1]))
    for size, some in _blocks(words):
        if size > LONG_WORD:
            for i in some:
                out[i] = _long_forward(words[i], table, chance)
            continue
        out[some] = _forward(table.matches([words[i] for i in some]), len(some), chance, table.longest)
    return out


def _expected(words: list[str], langs: np.ndarray, counts: np.ndarray, table: PieceTable, chance: np.ndarray) -> np.ndarray:
    """(piece, language) expected uses of each piece in words that occur ``counts`` times in language ``langs``, by forward and backward sums of logarithms."""
    total = np.zeros_like(chance)
    log = np.log(np.maximum(chance, 1e-300))
    for size, some in _blocks(words):
        some = np.array(some)
        found = table.matches([words[i] for i in some])
        lang = langs[some]
        step_of = lambda ids, n, lang=lang: np.where((ids >= 0) | (n == 1), log[ids, lang], -np.inf)
        alpha = np.full((size + 1, len(some)), -np.inf)
        beta = np.full((size + 1, len(some)), -np.inf)
        alpha[0] = beta[size] = 0
        for end in range(1, size + 1):
            for start, ids in found[end]:
                alpha[end] = np.logaddexp(alpha[end], alpha[start] + step_of(ids, end - start))
        for end in range(size, 0, -1):
            for start, ids in found[end]:
                beta[start] = np.logaddexp(beta[start], beta[end] + step_of(ids, end - start))
        for end in range(1, size + 1):
            for start, ids in found[end]:
                uses = counts[some] * np.exp(alpha[start] + step_of(ids, end - start) + beta[end] - alpha[size])
                total += np.bincount(ids % len(chance) * total.shape[1] + lang, uses, total.size).reshape(total.shape)
    return total


def _normal(counts: np.ndarray) -> np.ndarray:
    """Probabilities by language, smoothed with the pieces' overall shares."""
    overall = counts.sum(1, keepdims=True) + 0.01
    overall = overall / overall.sum()
    mixed = counts + 200 * overall
    return mixed / mixed.sum(0)


def fit(docs: DataFrame, pieces: list[str], sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most ``sample_docs`` labelled rows a language (documented bound), the least by hash of id and text.

    Rows with a null text or language teach nothing. What reaches the driver is one
    number per piece and language. With no usable row the model has no language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("lang is not null and text is not null")
    # Rows of a language are taken by a cut of the hash's range, so none has to be ranked.
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.count("*")).alias("share"))
    chosen = {r.lang: r.share for r in share.collect()}
    languages = sorted(chosen)
    if not languages:
        return LanguageModel([], pieces, np.zeros((1, 0)))
    cut = F.create_map(*[F.lit(x) for k in languages for x in (k, float(chosen[k]))])
    sample = rows.where((F.col("h").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < cut[F.col("lang")])

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in in_steps(batches):
            count: dict[tuple[str, str], int] = {}
            for lang, text in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), strict=True):
                for w in _letters(text.lower()):
                    count[lang, w] = count.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["lang", "word", "n"])

    words = sample.select("lang", "text").transform(map_batches, words_of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words.repartition(max(8, spark.sparkContext.defaultParallelism)), "words")
    table = PieceTable(pieces)
    known = table.pieces
    sent = spark.sparkContext.broadcast(table)
    chance = np.full((len(known) + 1, len(languages)), 1.0 / (len(known) + 1))
    for _ in range(rounds):
        now = chance

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now)
            for step in in_steps(batches, 40_000):
                langs = np.array([languages.index(x) for x in step.column(0).to_pylist()], np.int64)
                total += _expected(step.column(1).to_pylist(), langs, step.column(2).to_numpy().astype(float), sent.value, now)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], names=["piece", "lang", "uses"])

        uses = words.transform(map_batches, expect, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toArrow()
        counts = np.zeros_like(chance)
        counts[uses.column("piece").to_numpy(), uses.column("lang").to_numpy()] = uses.column("uses").to_numpy()
        chance = _normal(counts)
    return LanguageModel(languages, known, np.log(chance))


class LanguageScorer:
    """Predicts texts with a fitted model; remembers the scores of frequent words."""

    def __init__(self, model: LanguageModel, memo: int = MEMO_WORDS):
        self.model, self.table, self.chance = model, model.table(), np.exp(model.weights)
        self.limit, self.rows = memo, {}
        self.scores = np.zeros((memo, len(model.languages)), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) > self.limit:
            rows.clear()
            new = list(dict.fromkeys(words))
            if len(new) > self.limit:
                self.limit = len(new)
                self.scores = np.zeros((self.limit, self.scores.shape[1]), np.float32)
        if new:
            self.scores[len(rows) : len(rows) + len(new)] = score_words(new, self.table, self.chance)
            rows.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [_letters(t.lower()) if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        if not flat or not self.model.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        each = self.scores[self._numbers(flat)].astype(np.float64)
        ends = np.cumsum([len(ws) for ws in words])
        sums = np.concatenate((np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)))
        total = sums[ends] - sums[ends - [len(ws) for ws in words]]
        best = total.argmax(1)
        top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [(self.model.languages[b], float(s)) if ws else (UNDETERMINED, 0.0) for ws, b, s in zip(words, best, top, strict=True)]


def _scorer(name: str, model) -> LanguageScorer:
    """One scorer for each Python worker and model."""
    return held(f"language {name}", lambda: LanguageScorer(model.value))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its posterior probability (0 to 1).

    ``und`` with score 0 where the text is null, empty or has no letter. Only the
    text is read; other columns stay as they are, those named in ``out`` are replaced.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    rest = docs.drop(*out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, sent)
        for step in in_steps(batches):
            found = scorer.predict(step.column(step.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([*step.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*step.schema.names, *out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"{out[0]} string", f"{out[1]} double"])
    return rest.transform(map_batches, run, schema, model=True)


def sentencepiece_vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model, without word marks and control pieces, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p.replace("▁", "").lower() for p in pieces} - {""})
