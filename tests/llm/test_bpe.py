import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TRUTH = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Bpe(RANKS, P.PATTERN)


def ids_of(text):
    return [i for x in OURS.encode_pieces([p.encode() for p in OURS.pattern.findall(text)]) for i in x]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=200))
def test_random_texts(text):
    assert ids_of(text) == TRUTH.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a", "aaaa" * 400, "hello world's <|endoftext|>", "é" * 700, "ab" * 3000, "   \n\n  x", "\U0001f600" * 90, "internationalization " * 40])
def test_hard_texts(text):
    assert ids_of(text) == TRUTH.encode_ordinary(text)
    assert OURS.decode(ids_of(text)) == text.encode()


def test_matrix_and_heap_agree():
    pieces = [b"abcabcabcdabcd" * k for k in range(1, 30)]
    assert OURS.encode_pieces(pieces) == [OURS._encode_long(p) for p in pieces]


def test_frames(spark):
    rows = [(1, "the quick brown fox", "x"), (2, None, "y"), (2, None, "y"), (3, "", None), (None, "ünï " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(out) == 5
    for r in out:
        assert r.ids == TRUTH.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    both = bpe.encode(docs, PATH, P.PATTERN, decoded="decoded").collect()
    assert [(r.ids, bytes(r.decoded)) for r in both] == [(r.ids, bytes(r.decoded)) for r in out]
    for r, (i, t, _) in zip(bpe.digests(docs, PATH, P.PATTERN).collect(), rows, strict=True):
        ids = TRUTH.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0
