import base64
import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.BytePairCodec(open(PATH, "rb").read(), P.PATTERN, memo=50)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text("abcdeé ñ\n'st0123²ª漢\x1c\x85\xa0_", max_size=120))
def test_ids_are_the_librarys(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_and_repetitive_pieces():
    for text in ("a" * 3000, "ab" * 2000, " " * 999, "the" * 700, "<|endoftext|>"):
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_tables(spark):
    rows = [(1, "Hello world, déjà vu!"), (2, None), (3, ""), (1, "Hello world, déjà vu!"), (None, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as token_ids", "1 as n_tokens")
    got = sorted(bpe.token_digests(docs, PATH, P.PATTERN).collect(), key=str)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted([type(got[0])(*w) for w in want], key=str)
    encoded = bpe.encode_documents(docs, PATH, P.PATTERN)
    back = bpe.decode_documents(encoded, PATH, P.PATTERN).select("text", "token_ids", "decoded").collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.token_ids == LIBRARY.encode_ordinary(r.text or "") for r in back)
    assert bpe.token_digests(docs.limit(0), PATH, P.PATTERN).count() == 0
