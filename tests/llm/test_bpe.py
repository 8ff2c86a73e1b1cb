import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.BytePairs(RANKS, P.PATTERN)


def same(text):
    ids = OWN.encode(text)
    assert ids.tolist() == LIB.encode_ordinary(text), text[:80]
    assert OWN.decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sreé ß \n\t\r  \x1c\x1f\x85#19!😀語")), max_size=40))
def test_equals_library_on_odd_texts(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_equals_library_on_any_text(text):
    same(text)


def test_long_pieces_and_few_words():
    r = random.Random(1)
    for text in ["a" * 5000, "".join(r.choice("abcdehlorst") for _ in range(30_000)), " " * 700 + "x", "<|endoftext|> x", "é" * 999, "1" * 333, "the thing  is\n\n  so " * 50, " lead", "trail "]:
        same(text)


def test_memory_shrinks_without_changing_ids():
    r = random.Random(2)
    memory = bpe.Remembered(OWN.encode_segments, 50, wide=True)
    for _ in range(30):
        texts = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 30))) for _ in range(5)]
        for t, (idx, ids) in zip(texts, memory.of(texts), strict=True):
            assert ids.tolist() == LIB.encode_ordinary(t)
            assert memory.text(idx) == " ".join(map(str, ids.tolist()))


def test_query_and_operators(spark):
    texts = [None, "", "Hello there, it's 12 o'clock", "x  y \n z", "Hello there, it's 12 o'clock", "ü" * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("mine"))
    got = {r["doc_id"]: r for r in bpe.bpe_digest(docs, PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = LIB.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    e = bpe.encoded(docs, PATH, P.PATTERN)
    assert e.columns == ["doc_id", "text", "ids"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in bpe.decoded(e, PATH, P.PATTERN).collect())
    assert bpe.bpe_digest(docs.limit(0), PATH, P.PATTERN).count() == 0
