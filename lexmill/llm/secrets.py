"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest, grown here in numpy, sees a candidate's length, character classes,
entropy, character transitions, coverage by dictionary words, path form and the words
beside it. It is trained on labelled findings: findings of public credential formats, of passwords and of usual
false positives drawn from a seeded generator and set between words of the corpus, and candidates of the corpus that
neither stand beside a word for credentials nor begin like a public format, which count as none.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held, in_steps, map_batches, materialize

#: Documents that corpus candidates for training come from, at most. The dictionary and transitions are counted over all documents.
SAMPLE_DOCS = 3000
#: Words of the dictionary, those in most documents first.
DICTIONARY_WORDS = 20_000
#: Words counted in a task before they are handed on.
FLUSH_WORDS = 100_000
TREES, TREE_DEPTH, LEAF_ROWS, GENERATED = 40, 9, 3, 6000
#: Characters on either side of a candidate that its neighbours are taken from.
NEAR_CHARS = 48
_run = re.compile(r"[A-Za-z0-9+/_.\-]{12,}={0,2}")
_word = re.compile(r"[^\W\d_]+")
_classes = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[+/=]"), re.compile(r"[_.\-]"))
_hex = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_uuid = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_host = re.compile(r"(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}")
_name = re.compile(r"[A-Za-z_]+[0-9]{0,3}")
#: Words beside a credential, and words beside identifiers that are none.
SECRET_WORDS = "token secret password passwd pwd key apikey api auth authorization bearer credential credentials private access signing".split()
FORMATS = ("AKIA", "ghp_", "xoxb-", "sk_live_", "eyJ")
#: A name is looked at once, from its start: its word may stand anywhere in it, and what follows it begins where it ends.
_assigned = re.compile(
    r"(?i)(?:(?<![a-z0-9_])(?=[a-z0-9_]*?(?:token|secret|passw(?:or)?d|pwd|key|auth|credentials?))[a-z0-9_]++[\"'`]?\s*+(?:=>|:=|[:=])\s*|\bbearer\s+)[\"'`]?(?!bearer\b|basic\b)([^\s\"'`,;<>()\[\]{}|]{4,})"
)
PLAIN_WORDS = "commit sha sha1 sha256 md5 checksum digest hash revision rev etag integrity uuid guid id version build path file url image example sample placeholder card account".split()


@dataclass
class TextStatistics:
    """Corpus words (four letters or more) and log probabilities of character transitions in words."""

    words: frozenset[str]
    transitions: np.ndarray

    @staticmethod
    def place(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isdigit() else 28 if c.isascii() else 29

    @classmethod
    def steps(cls, word: str) -> tuple[list[int], list[int]]:
        """From where to where each transition of a word goes; words begin at place 0."""
        at = [0, *map(cls.place, word)]
        return at[:-1], at[1:]


def features(text: str, start: int, stop: int, stats: TextStatistics) -> list[float]:
    """Numbers that describe a candidate and its neighbourhood."""
    c = text[start:stop]
    n = len(c)
    low = c.lower()
    share = [len(p.findall(c)) / n for p in _classes]
    count: dict[str, int] = {}
    for x in c:
        count[x] = count.get(x, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in count.values())
    at = [stats.place(x) for x in low]
    transition = float(stats.transitions[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0
    parts = _word.findall(low)
    covered = sum(len(p) for p in parts if p in stats.words) / n
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(c, c[1:], strict=False)) / n
    before, after = text[max(0, start - NEAR_CHARS) : start], text[stop : stop + NEAR_CHARS // 2]
    left = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", before)][-4:]
    lead = before.rstrip(" \t\"'`")
    quoted = before[-1:] in "\"'`" and after[:1] in "\"'`" if before and after else False
    runs = max(len(m.group()) for m in re.finditer(r"(.)\1*", c))
    return [
        n, *share, entropy, entropy / math.log2(n), transition, covered, switches,
        float(_hex.fullmatch(c) is not None), float(_uuid.fullmatch(c) is not None), float(_host.fullmatch(c) is not None), float(_name.fullmatch(c) is not None),
        c.count("/"), c.count("."), float(c.isdigit()), float(before[-1:] == "@"), float(before.endswith("://") or "://" in c), runs / n,
        float(lead[-1:] in ("=", ":") or lead.endswith("=>")), float(quoted), float(any(w in SECRET_WORDS for w in left)), float(any(w in PLAIN_WORDS for w in left)),
    ]


def candidates(text: str | None) -> Iterator[tuple[int, int]]:
    """Places of what may be a secret, in order, none within another.

    Any value of four characters or more that is assigned to a word for credentials, and runs of 12 characters or more
    that hold a digit or mix cases within, or of 32 letters or more. A name before an equals sign is no part of a value.
    """
    values = {m.span(1) for m in _assigned.finditer(text or "")}
    found = sorted(values)
    for m in _run.finditer(text or ""):
        c = m.group().rstrip(".-")
        start, stop = m.start(), m.start() + len(c)
        if len(c) >= 12 and (len(c) >= 32 or any(x.isdigit() for x in c) or (c != c.lower() and c[1:] != c[1:].lower())):
            at = bisect.bisect_left(found, (stop, 0)) - 1
            if at < 0 or found[at][1] <= start or (start, stop) in values:
                values.add((start, stop))
    yield from sorted(values)


class RandomForest:
    """Bootstrapped trees on Gini impurity, a random share of features at each split."""

    def __init__(self, trees: int = TREES, depth: int = TREE_DEPTH, leaf: int = LEAF_ROWS, seed: int = 0):
        self.trees, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list] = []
            self._grow(x[rows], y[rows].astype(float), 0, nodes, rng)
            feature, cut, child, value = zip(*nodes, strict=True)
            self.grown.append((np.array(feature), np.array(cut), np.array(child), np.array(value)))
        return self

    def _grow(self, x, y, depth, nodes, rng) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, (0, 0), float(y.mean()) if len(y) else 0.0])
        if depth < self.depth and len(y) >= 2 * self.leaf and 0 < y.mean() < 1:
            best = None
            for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, hits = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y))
                ok = (v[1:] > v[:-1]) & (n >= self.leaf) & (len(y) - n >= self.leaf)
                if not ok.any():
                    continue
                left, right = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
                cost = np.where(ok, n * left * (1 - left) + (len(y) - n) * right * (1 - right), np.inf)
                k = int(cost.argmin())
                if best is None or cost[k] < best[0]:
                    best = (cost[k], f, (v[k] + v[k + 1]) / 2)
            if best is not None:
                _, f, cut = best
                low = x[:, f] <= cut
                nodes[me][:3] = [int(f), float(cut), (self._grow(x[low], y[low], depth + 1, nodes, rng), self._grow(x[~low], y[~low], depth + 1, nodes, rng))]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, child, value in self.grown:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(f >= 0, child[at, right.astype(int)], at)
            total += value[at]
        return total / len(self.grown)


def generated_findings(words: list[str], count: int = GENERATED, seed: int = 0) -> list[tuple[str, int, int, int]]:
    """(text, start, stop, label): public credential formats and usual false positives among corpus words."""
    rng = random.Random(seed)
    lower, upper, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word = lambda: rng.choice(words)
    secret = [
        lambda: some(hexa, rng.choice([32, 40, 64])),
        lambda: some(lower + upper + digit, rng.randint(20, 48)),
        lambda: some(lower + upper + digit + "+/", 43) + "=",
        lambda: "AKIA" + some(upper + digit, 16),
        lambda: "ghp_" + some(lower + upper + digit, 36),
        lambda: f"xoxb-{some(digit, 12)}-{some(lower + upper + digit, 24)}",
        lambda: "sk_live_" + some(lower + upper + digit, 24),
        lambda: f"eyJ{some(lower + upper + digit, 20)}.eyJ{some(lower + upper + digit, 40)}.{some(lower + upper + digit + '-_', 43)}",
    ]
    bare = secret[3:]
    password = [
        lambda: f"{word().lower()}{rng.randint(1, 9999)}{rng.choice('!?#$%')}",
        lambda: f"{word().capitalize()}{rng.choice('!@#$')}{rng.randint(1, 99)}",
        lambda: word().lower().replace("a", "@").replace("o", "0") + some(digit, 2) + rng.choice("!?*"),
        lambda: some(lower + digit + "!#%*", rng.randint(8, 14)),
    ]
    placeholder = [lambda: rng.choice(["changeme", "your_token", "example", "xxxxxxxx", "********", "null", "none", "true", "required", "${TOKEN}", "os.environ", "config.password", "get_token", "see-above", "redacted"]), lambda: f"{word().lower()}", lambda: f"your-{word().lower()}-here", lambda: f"{word().lower()}.{word().lower()}"]
    plain = [
        lambda: "/".join(word().lower() for _ in range(rng.randint(2, 5))) + f"/{word().lower()}{rng.randint(1, 99)}.py",
        lambda: f"mail{rng.randint(0, 99)}.{word().lower()}.com",
        lambda: f"{word().lower()}_{word().lower()}_{rng.randint(1, 999)}",
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + "Handler2",
        lambda: f"{some(hexa, 8)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 12)}",
        lambda: some(digit, rng.choice([12, 13, 16, 19])),
        lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(100, 255)}.{rng.randint(100, 255)}",
        lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}.{some(digit, 6)}",
        lambda: rng.choice(["x", "X", "0", "1234567890"]) * rng.randint(12, 20),
        lambda: f"your-{word().lower()}-goes-here-{rng.randint(1, 9)}",
    ]
    forms = ['{k} = "{v}"', "{k}={v}", "{k}: '{v}'", "{k}: {v}", '"{k}": "{v}"']
    keys = ["token", "secret", "api_key", "apiKey", "password", "access_key", "auth_token", "client_secret", "private_key"]
    out = []
    for _ in range(count):
        left, right = " ".join(word() for _ in range(rng.randint(1, 6))), " ".join(word() for _ in range(rng.randint(1, 6)))
        draw = rng.random()
        hit = draw < 0.5
        if draw < 0.28:
            value, form, key = rng.choice(secret)(), rng.choice([*forms, "Authorization: Bearer {v}"]), rng.choice(keys)
        elif draw < 0.38:
            value, form, key = rng.choice(bare)(), rng.choice(["{v}", "{k} {v}", "({v})"]), word().lower()
        elif hit:
            value, form, key = rng.choice(password)(), rng.choice(forms), rng.choice(["password", "passwd", "pwd", "db_password", "secret"])
        elif draw < 0.62:
            value, form, key = rng.choice(placeholder)(), rng.choice(forms), rng.choice(keys)
        elif draw < 0.75:
            value = some(hexa, rng.choice([32, 40, 64]))
            form, key = rng.choice(["{k} {v}", "{k}: {v}", '{k} = "{v}"']), rng.choice(["commit", "sha1", "md5", "checksum", "digest", "revision", "etag"])
        else:
            value = rng.choice(plain)()
            form, key = rng.choice(["{v}", "{k} {v}", '{k} = "{v}"', "{k}: {v}", "user@{v}"]), rng.choice([word().lower(), "path", "id", "version", "file", "card"])
        body = form.format(k=key, v=value)
        at = len(left) + 1 + body.rindex(value)
        out.append((f"{left} {body} {right}", at, at + len(value), int(hit)))
    return out


def labelled(findings: list[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, int, int]]:
    """The candidates of generated texts, as a scan would find them: labelled 1 where one shares text with a secret that was put there."""
    for text, start, stop, label in findings:
        for s, e in candidates(text):
            yield text, s, e, int(label and s < stop and start < e)


@dataclass
class SecretModel:
    stats: TextStatistics
    forest: RandomForest


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 0, text_col: str = "text") -> SecretModel:
    """Fit on generated findings and on candidates of at most ``sample_docs`` documents (documented bound), taken by hash of the text.

    Words and transitions are counted over all documents; the dictionary keeps the DICTIONARY_WORDS that are in most of them.
    Null texts teach nothing.
    """
    rows = docs.select(F.col(text_col).alias("text")).where("text is not null")
    n = max(1, rows.count())
    part = F.xxhash64("text").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that each word is in."""
        count: dict[str, int] = {}
        for step in in_steps(batches):
            for t in step.column(0).to_pylist():
                for w in set(_word.findall(t.lower())):
                    count[w] = count.get(w, 0) + 1
            if len(count) >= FLUSH_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["what", "n"])
                count = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["what", "n"])

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Transitions within words, each as often as documents have the word."""
        table = np.zeros((30, 30), np.int64)
        for batch in batches:
            for w, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(table, TextStatistics.steps(w), times)
        a, b = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(table[a, b])], names=["a", "b", "n"])

    told = materialize(rows.transform(map_batches, counted, "what string, n long").groupBy("what").agg(F.sum("n").alias("n")), "words")
    words = told.orderBy(F.desc("n"), "what").limit(DICTIONARY_WORDS).toArrow()
    steps = told.transform(map_batches, stepped, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()  # 900 rows at most
    discard(told)
    known = words.column("what").to_pylist() or ["the", "and"]
    table = np.full((30, 30), 0.5)
    table[steps.column("a").to_numpy(), steps.column("b").to_numpy()] += steps.column("n").to_numpy()
    stats = TextStatistics(frozenset(w for w in known if len(w) >= 4), np.log(table / table.sum(1, keepdims=True)))

    def findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates with what is beside them: texts themselves stay in the task."""
        for step in in_steps(batches):
            near = [(t[max(0, s - NEAR_CHARS) : e + NEAR_CHARS], min(s, NEAR_CHARS), e - s) for t in step.column(0).to_pylist() for s, e in candidates(t)]
            if near:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*near, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["what", "start", "size"])

    sample = rows.where(part < min(1.0, sample_docs / n)).transform(map_batches, findings, "what string, start long, size long")
    near = sample.orderBy(F.xxhash64("what"), "what", "start").limit(2 * sample_docs).toArrow()
    x, y = [], []
    for text, start, size in zip(*(near.column(c).to_pylist() for c in ("what", "start", "size")), strict=True):
        if not text[start:].startswith(FORMATS) and not any(w in SECRET_WORDS for w in _word.findall(text[:start].lower().replace("_", " "))):
            x.append(features(text, start, start + size, stats))
            y.append(0)
    for text, start, stop, label in labelled(generated_findings(sorted(known), seed=seed)):
        x.append(features(text, start, stop, stats))
        y.append(label)
    return SecretModel(stats, RandomForest(seed=seed).fit(np.array(x), np.array(y)))


def _model(name: str, sent) -> SecretModel:
    """One model for each Python worker."""
    return held(f"secrets {name}", lambda: sent.value)


def scan(docs: DataFrame, model: SecretModel, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, secret, score): one row per finding with score >= least, in whole texts.

    ``start`` counts characters from 0. Null and empty texts have no finding; repeated rows are
    reported again; a row with a null id is reported with it; other columns are ignored.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name, sent)
        for step in in_steps(batches):
            found = [(i, s, t[s:e], features(t, s, e, model.stats)) for i, t in zip(step.column(0).to_pylist(), step.column(1).to_pylist(), strict=True) for s, e in candidates(t)]
            if not found:
                continue
            scores = model.forest.predict(np.array([f[3] for f in found]))
            good = [(i, s, len(c), c, float(p)) for (i, s, c, _), p in zip(found, scores, strict=True) if p >= least]
            if good:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*good, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "secret", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(map_batches, run, "doc_id long, start long, length long, secret string, score double", model=True)
