"""Toxicity by a convolutional text classifier, trained here in numpy.

A word is the sum of the hashed embeddings of itself and of its 4- and 6-letter
beginnings. Filters of several widths run over the whole text; the two largest
responses of each filter (max pooling with k = 2, so that a second occurrence counts)
feed a logistic output. The decision threshold is calibrated by language, the
language itself being guessed from the words by a unigram table over the same hashed words.

Every labelled row is learned from. In each epoch tasks train copies of the model on their own
rows, and the copies are averaged: dense weights by rows, an embedding over the tasks that moved it.
"""

from __future__ import annotations

import copy
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, Memo, discard, held, in_steps, map_batches, materialize

#: Labelled rows that one task trains a copy of the model on, or so; embeddings that are averaged in one group.
TASK_ROWS, BLOCK = 8_000, 1024
#: Logits are counted in steps of this size for the thresholds.
LOGIT_STEP = 1 / 1024
BUCKETS, WIDTH, FILTERS, WIDTHS, EPOCHS = 1 << 16, 16, 12, (1, 2, 3), 4
#: Score at which a text counts as toxic; calibrated thresholds are moved here.
DECISION = 0.7
MEMO_WORDS = 200_000
_words = re.compile(r"[^\W\d_]+").findall


def word_buckets(word: str) -> tuple[int, int, int]:
    """Hash buckets of a lower-case word and its beginnings."""
    return tuple(zlib.crc32(p.encode()) % BUCKETS for p in (word, f"4 {word[:4]}", f"6 {word[:6]}"))


@dataclass
class TextCNN:
    seed: int = 0
    languages: list[str] = field(default_factory=list)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, 2 * FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.float32(-1)
        self.lang_log = np.zeros((BUCKETS, 0), np.float32)
        self.thresholds = np.zeros(1)
        self.learned = {}  # rows of each class that were trained on
        self.g_embed = np.full(BUCKETS, 1e-6, np.float32)
        self.g_filters = [np.full_like(f, 1e-6) for f in self.filters]
        self.g_out, self.g_bias = np.full_like(self.out, 1e-6), np.float32(1e-6)

    def dense(self) -> np.ndarray:
        """All weights but the embeddings, with their squared gradients."""
        return np.concatenate([x.ravel() for x in (*self.filters, *self.g_filters, self.out, self.g_out)] + [[self.bias, self.g_bias]]).astype(np.float64)

    def set_dense(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.filters, *self.g_filters, self.out, self.g_out):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.bias, self.g_bias = np.float32(flat[at]), np.float32(flat[at + 1])

    def pooled(self, e: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Two largest responses of each filter over word vectors ``e``, and where they are."""
        short = max(WIDTHS) + 1 - len(e)
        if short > 0:
            e = np.concatenate((e, np.zeros((short, WIDTH), np.float32)))
        values, places = [], []
        for bank in self.filters:
            n = len(e) - len(bank) + 1
            r = e[:n] @ bank[0]
            for k in range(1, len(bank)):
                r += e[k : k + n] @ bank[k]
            first = r.argmax(0)
            cols = np.arange(FILTERS)
            top = r[first, cols]
            r[first, cols] = -np.inf
            second = r.argmax(0)
            values += [top, r[second, cols]]
            places.append(np.stack((first, second)))
        return np.maximum(np.concatenate(values), 0), places

    def logit(self, e: np.ndarray) -> float:
        return float(self.pooled(e)[0] @ self.out + self.bias)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, weight: dict[int, float], rng: np.random.Generator) -> None:
        """One pass of Adagrad on single texts in random order, each an (n, 3) array of buckets; ``weight`` is that of a class's texts."""
        for i in rng.permutation(len(texts)):
            ids = texts[i]
            e = self.embed[ids].sum(1)
            pooled, places = self.pooled(e)
            z = float(pooled @ self.out + self.bias)
            d = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weight[int(labels[i])])
            back = (d * self.out) * (pooled > 0)
            step = d * pooled + 1e-5 * self.out
            self.g_out += step * step
            self.out -= 0.05 * step / np.sqrt(self.g_out)
            self.g_bias += d * d
            self.bias -= np.float32(0.05 * d / np.sqrt(self.g_bias))
            touched, change = [], []
            for b, (bank, at) in enumerate(zip(self.filters, places, strict=True)):
                g = back[2 * b * FILTERS : 2 * (b + 1) * FILTERS].reshape(2, FILTERS)
                if not g.any():
                    continue
                for k in range(len(bank)):
                    spot = at + k
                    inside = spot < len(e)
                    x = np.where(inside[..., None], e[np.minimum(spot, len(e) - 1)] if len(e) else 0, 0)
                    touched.append(spot[inside])
                    change.append((g[..., None] * bank[k].T[None])[inside])
                    db = (g[..., None] * x).sum(0).T
                    self.g_filters[b][k] += db * db
                    bank[k] -= 0.05 * db / np.sqrt(self.g_filters[b][k])
            if touched and len(e):
                rows = ids[np.concatenate(touched)].reshape(-1)
                order = np.argsort(rows)
                rows, moves = rows[order], np.concatenate(change)[order // 3]
                first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                rows = rows[first]
                self.g_embed[rows] += np.add.reduceat((moves * moves).mean(1), first)
                self.embed[rows] -= 0.1 * np.add.reduceat(moves, first) / np.sqrt(self.g_embed[rows])[:, None]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, guessed: np.ndarray, least: int = 15, counts: np.ndarray | None = None) -> None:
        """Per guessed language the logit with the best F1, between texts; languages with few cases of a class take the threshold of all.

        With ``counts`` an entry stands for so many texts of about one logit, and ``labels`` says how many of them are toxic.
        """
        counts = np.ones(len(logits)) if counts is None else counts

        def best(z, y, n):
            order = np.argsort(-z)
            z, y, n = z[order], y[order], n[order]
            hits = np.cumsum(y)
            f1 = 2 * hits / (np.cumsum(n) + max(1, y.sum()))
            k = int(f1.argmax())
            return float((z[k] + z[min(k + 1, len(z) - 1)]) / 2)

        overall = best(logits, labels, counts) if len(logits) and labels.any() else 0.0
        self.thresholds = np.full(len(self.languages) + 1, overall)
        for k in range(len(self.languages)):
            mine = guessed == k
            if labels[mine].sum() >= least and (counts[mine] - labels[mine]).sum() >= least:
                self.thresholds[k] = best(logits[mine], labels[mine], counts[mine])

    def guess(self, lang_sum: np.ndarray) -> int:
        """Place of the likeliest language; the last threshold's for none."""
        return int(lang_sum.argmax()) if len(lang_sum) and lang_sum.any() else len(self.languages)


class ToxicityScorer:
    """Scores texts with a trained model; remembers the vectors of frequent words."""

    def __init__(self, model: TextCNN, memo: int = MEMO_WORDS):
        self.model, self.limit, self.rows = model, memo, {}
        self.vectors = np.zeros((memo, WIDTH), np.float32)
        self.langs = np.zeros((memo, model.lang_log.shape[1]), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) > self.limit:
            rows.clear()
            new = list(dict.fromkeys(words))
            if len(new) > self.limit:
                self.limit = len(new)
                self.vectors = np.zeros((self.limit, WIDTH), np.float32)
                self.langs = np.zeros((self.limit, self.langs.shape[1]), np.float32)
        if new:
            ids = np.array([word_buckets(w) for w in new])
            at = slice(len(rows), len(rows) + len(new))
            self.vectors[at] = self.model.embed[ids].sum(1)
            self.langs[at] = self.model.lang_log[ids[:, 0]]
            rows.update(zip(new, range(at.start, at.stop), strict=True))
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def raw(self, text: str | None) -> tuple[float, int]:
        """Logit and the place of the guessed language."""
        words = _words(text.lower()) if text else []
        at = self._numbers(words)
        return self.model.logit(self.vectors[at]), self.model.guess(self.langs[at].sum(0))

    def score(self, text: str | None) -> float:
        z, lang = self.raw(text)
        z += np.log(DECISION / (1 - DECISION)) - self.model.thresholds[lang]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _bucketed(labelled: BitFilter):
    """(id, lang, words) of (id, lang, text, key): texts whose key may be labelled, as the buckets of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda w: np.array(word_buckets(w), np.uint16).tobytes(), MEMO_WORDS)
        for step in in_steps(batches):
            step = step.filter(pa.array(labelled.passes(step.column(3).to_numpy())))
            raw = [b"".join(map(known.__getitem__, _words(t.lower()))) for t in step.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*step.columns[:2], pa.array(raw, pa.binary())], names=["id", "lang", "words"])

    return run


def _ids(raw: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).reshape(-1, 3).astype(np.int64) for x in raw.to_pylist()]


def _learn_languages(model: TextCNN, rows: DataFrame) -> None:
    """Word counts of each language over all rows, summed by language and block of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for step in in_steps(batches):
            for lang, ids in zip(step.column(0).to_pylist(), _ids(step.column(1)), strict=True):
                np.add.at(counts.setdefault(lang, np.zeros(BUCKETS, np.int64)), ids[:, 0], 1)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at])], names=["lang", "bucket", "n"])

    # A language without a word in its texts is known all the same.
    kinds = rows.where("lang <> ''").select(F.col("lang").cast("string").alias("lang"), "words")
    model.languages = sorted(r.lang for r in kinds.select("lang").distinct().collect())
    found = kinds.transform(map_batches, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones((BUCKETS, len(model.languages)))
    place = {lang: k for k, lang in enumerate(model.languages)}
    column = np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)
    counts[found.column("bucket").to_numpy(), column] += found.column("n").to_numpy()
    model.lang_log = np.log(counts / counts.sum(0)).astype(np.float32)


def _train_epoch(model: TextCNN, rows: DataFrame, weight: dict[int, float], epoch: int) -> None:
    """Copies of the model trained by the tasks on their rows, and averaged into it by blocks."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, own, seen = sent.value, copy.deepcopy(sent.value), 0
        rng = np.random.default_rng(own.seed + 1 + epoch)
        for step in in_steps(batches):
            own.train(_ids(step.column(1)), step.column(0).to_numpy(), weight, rng)
            seen += step.num_rows
        if not seen:
            return
        moved = own.g_embed != start.g_embed
        blocks, places, values = [-1], [b""], [(own.dense() * seen).tobytes()]
        for block in range(BUCKETS // BLOCK):
            at = np.flatnonzero(moved[block * BLOCK : (block + 1) * BLOCK]) + block * BLOCK
            if len(at):
                blocks.append(block)
                places.append(at.astype(np.int32).tobytes())
                values.append(np.concatenate((own.embed[at], own.g_embed[at, None]), 1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["block", "seen", "places", "changed"])

    def averaged(table: pa.Table) -> pa.Table:
        block, seen = table.column("block")[0].as_py(), sum(table.column("seen").to_pylist())
        if block < 0:
            places, values = b"", (sum(np.frombuffer(x, np.float64) for x in table.column("changed").to_pylist()) / seen).tobytes()
        else:
            total, n = np.zeros((BLOCK, WIDTH + 1)), np.zeros(BLOCK)
            for at, x in zip(table.column("places").to_pylist(), table.column("changed").to_pylist(), strict=True):
                at = np.frombuffer(at, np.int32) - block * BLOCK
                total[at] += np.frombuffer(x, np.float32).reshape(-1, WIDTH + 1)
                n[at] += 1
            at = np.flatnonzero(n)
            places, values = (at + block * BLOCK).astype(np.int32).tobytes(), (total[at] / n[at, None]).astype(np.float32).tobytes()
        return pa.table({"block": pa.array([block], pa.int32()), "places": pa.array([places], pa.binary()), "changed": pa.array([values], pa.binary())})

    copies = rows.select("y", "words").transform(map_batches, run, "block int, seen long, places binary, changed binary")
    for r in copies.groupBy("block").applyInArrow(averaged, "block int, places binary, changed binary").collect():
        if r.block < 0:
            model.set_dense(np.frombuffer(r.changed, np.float64))
        else:
            at, x = np.frombuffer(r.places, np.int32), np.frombuffer(r.changed, np.float32).reshape(-1, WIDTH + 1)
            model.embed[at], model.g_embed[at] = x[:, :WIDTH], x[:, WIDTH]
    sent.unpersist()


def _calibrate(model: TextCNN, rows: DataFrame) -> None:
    """Thresholds from all ``rows``, their logits counted in steps of LOGIT_STEP by guessed language."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for step in in_steps(batches):
            raw = [(own.logit(own.embed[x].sum(1)), own.guess(own.lang_log[x[:, 0]].sum(0))) for x in _ids(step.column(1))]
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array([z for z, _ in raw], pa.float64()), pa.array([k for _, k in raw], pa.int32())], names=["y", "z", "k"])

    told = rows.where(F.octet_length("words") > 0).select("y", "words").transform(map_batches, run, "y int, z double, k int")
    step = F.round(F.greatest(F.lit(-64.0), F.least(F.lit(64.0), F.col("z"))) / LOGIT_STEP).cast("int")
    found = told.groupBy("k", step.alias("step")).agg(F.avg("z").alias("z"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("k", "step").toArrow()
    column = lambda name, kind: np.array(found.column(name).to_pylist(), kind)
    model.calibrate(column("z", np.float64), column("y", np.int64), column("k", np.int64), counts=column("n", np.int64))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: dict[int, int] | None = None, seed: int = 0, task_rows: int = TASK_ROWS) -> TextCNN:
    """Train on all labelled documents, dealt over tasks of about ``task_rows``; three quarters of them, by hash of the id, teach the model and a quarter its thresholds.

    ``sample_rows`` bounds the rows of each class, taken by hash of the id; without it there is no bound. Rows with a null label, id
    or text teach nothing; of a document with several labels each counts. With one class or none the model scores near its prior.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if sample_rows is not None:
        there = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        share = {y: min(1.0, sample_rows[y] / max(1, there.get(y, 0))) for y in (0, 1)}
        part = F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
        rows = rows.where(part < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id").alias("key")).where("text is not null")
    # Texts without a label stay where they are, but for the few that share a bit with a labelled one; the join is exact.
    words = texts.transform(map_batches, _bucketed(BitFilter(rows.select(F.xxhash64("id").alias("key")), "key")), f"id {docs.schema['doc_id'].dataType.simpleString()}, lang string, words binary")
    tasks = max(1, -(-rows.count() // task_rows))
    apart = F.crc32(F.concat(F.lit("threshold "), F.col("id").cast("string")).cast("binary")) % 4 == 0
    # In the order of a hash, so that each task meets classes and languages mixed.
    joined = words.repartition(tasks, "id").join(rows.repartition(tasks, "id").hint("merge"), "id").withColumn("order", F.xxhash64("id", F.lit(seed)))
    table = materialize(joined.sortWithinPartitions("order", "y").select("y", apart.alias("apart"), "lang", "words"), "toxicity")
    model = TextCNN(seed)
    _learn_languages(model, table)
    train = table.where("not apart")
    model.learned = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Classes weigh the same.
    weight = {y: 0.5 * sum(model.learned.values()) / max(1, model.learned.get(y, 0)) for y in (0, 1)}
    for epoch in range(EPOCHS if model.learned else 0):
        _train_epoch(model, train, weight, epoch)
    _calibrate(model, table.where("apart"))
    discard(table)
    return model


def _scorer(name: str, model) -> ToxicityScorer:
    """One scorer for each Python worker and model."""
    return held(f"toxicity {name}", lambda: ToxicityScorer(model.value))


def score_documents(docs: DataFrame, model: TextCNN, text_col: str = "text", out_col: str = "tox_score") -> DataFrame:
    """``docs`` with ``out_col``, 0 to 1; DECISION and above means toxic.

    Only the whole text is read. A null or empty text has the score of no words, the same for all.
    A column called ``out_col`` is replaced, all others stay.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    rest = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, sent)
        for step in in_steps(batches):
            found = [scorer.score(t) for t in step.column(step.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*step.columns, pa.array(found, pa.float64())], names=[*step.schema.names, out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"{out_col} double"])
    return rest.transform(map_batches, run, schema, model=True)
