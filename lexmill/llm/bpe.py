"""Byte-level BPE by longest matches and backtracking.

An Aho-Corasick automaton over the vocabulary, bytes written as Latin-1, gives the
longest token at every byte. A token may follow another only if merging their bytes
in rank order would leave the border between them; that is memoised per token pair.
Walking from longest matches and backing off to shorter prefixes then finds the one
compatible tokenisation, which is the one that the merges give.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, held, in_steps, map_batches

#: Pieces remembered by each Python worker.
MEMO_PIECES = 80_000
#: Characters other than ASCII and Latin letters, or separators on which regex flavours differ.
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f]")


def _plain(pattern: str) -> str | None:
    """The pattern for texts without odd characters in the standard library's syntax; None if it has other classes."""
    out = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return None if r"\p" in out else out


class BytePairCodec:
    """Encoder and decoder for a rank file in tiktoken's format and a pattern that cuts text into pieces."""

    def __init__(self, rank_file: bytes, pattern: str, memo: int = MEMO_PIECES):
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = {rank: len(token) for rank, token in self.tokens.items()}
        self.find_any = regex.compile(pattern).findall
        plain = _plain(pattern)
        self.find_plain = re.compile(plain).findall if plain else self.find_any
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.fits = Memo(self._fits, 150_000)
        self.halves = Memo(self._halves, len(self.ranks) + 1)
        self.shorter = Memo(self._shorter, len(self.ranks) + 1)
        self.pieces = Memo(self._piece, memo)

    def _halves(self, token: int) -> tuple[int, int] | tuple[()]:
        """The two tokens whose merge makes ``token``; () for one that no merge makes."""
        parts = [bytes([b]) for b in self.tokens[token]]
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], token)) < token), default=None)
            if best is None:
                return ()
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return tuple(self.ranks[p] for p in parts) if len(parts) == 2 else ()

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        raw = self.tokens[token]
        return next((self.ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ranks), -1)

    def find(self, text: str) -> list[str]:
        return self.find_any(text) if _ODD.search(text) else self.find_plain(text)

    def _fits(self, pair: int) -> bool:
        """Whether merges leave the border between two adjacent tokens.

        Undo both tokens' merges, latest first. Were the two parts at the border ever a
        token that is merged before the part undone last, the border would be lost.
        """
        left, right = divmod(pair, 1 << 32)
        bound = len(self.ranks) + (1 << 30)
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < bound:
                return False
            left_half, right_half = self.halves[left], self.halves[right]
            if not left_half and not right_half:
                return True
            if left_half and (left > right or not right_half):
                bound, left = left, left_half[1]
            else:
                # On equal ranks the left merge comes first.
                bound, right = right + 1, right_half[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * (size + 1)
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # ends ascend, so the longest stays
        sizes, fits, shorter = self.sizes, self.fits, self.shorter
        out: list[int] = []
        ends_at = [True] * (size + 1)
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                end = at + sizes[token]
                if ends_at[end] and (not out or fits[(out[-1] << 32) + token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            elif out:
                ends_at[at] = False
                token = out.pop()
                at -= sizes[token]
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return out

    def _piece(self, piece: str) -> tuple[str, tuple[int, ...]]:
        ids = self.encode_piece(piece.encode())
        return ",".join(map(str, ids)), tuple(ids)

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces
        return [i for piece in self.find(text) for i in pieces[piece][1]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
        pieces = self.pieces
        coded = [pieces[piece] for piece in self.find(text)]
        ids = [i for c in coded for i in c[1]]
        return len(ids), hashlib.sha256(",".join([c[0] for c in coded]).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _codec(rank_file: bytes, pattern: str) -> BytePairCodec:
    """One codec for each Python worker and vocabulary."""
    return held(f"bpe {hashlib.sha256(rank_file).hexdigest()} {pattern}", lambda: BytePairCodec(rank_file, pattern))


def _rank_file(spark: SparkSession, path: str):
    """The rank file as a broadcast: under 1 MB for 50,000 tokens, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``out_col``: array<int> of token ids; a null or empty text has an empty array.

    All columns of ``docs`` stay, one called ``out_col`` is replaced; long texts are
    encoded whole; repeated rows stay repeated.
    """
    ranks = _rank_file(docs.sparkSession, rank_path)
    rest = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for step in in_steps(batches):
            texts = step.column(step.schema.get_field_index(text_col)).to_pylist()
            ids = pa.array([codec.encode(t) if t else [] for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*step.columns, ids], names=[*step.schema.names, out_col])

    return rest.transform(map_batches, run, T.StructType([*rest.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))]), model=True)


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``: the decoded bytes; null ids decode to no bytes."""
    ranks = _rank_file(encoded.sparkSession, rank_path)
    rest = encoded.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for step in in_steps(batches):
            ids = step.column(step.schema.get_field_index(ids_col)).to_pylist()
            raw = pa.array([codec.decode(x) if x else b"" for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*step.columns, raw], names=[*step.schema.names, out_col])

    return rest.transform(map_batches, run, T.StructType([*rest.schema.fields, T.StructField(out_col, T.BinaryType())]), model=True)


def token_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) from an encoding and decoding of each whole text.

    A null text counts as empty: no tokens, and the digests of the empty string.
    The ids themselves never leave the task, so nothing but digests is written.
    """
    ranks = _rank_file(docs.sparkSession, rank_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for step in in_steps(batches):
            found = [codec.digest(t or "") for t in step.column(1).to_pylist()]
            n, ids, raw = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.transform(map_batches, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", model=True)
