import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quern.llm import packing as K

PATH = P.path("byte_bpe_50k.json")


def padding(rows):
    size = {}
    for r in rows:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert max(size.values()) <= 2048
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.values()), sum(size.values())


def whole(rows, texts):
    tok = Tokenizer.from_file(PATH)
    own = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts}
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
        assert r["doc_tokens"] == len(own[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(own[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    assert by.keys() == own.keys()
    for i, rs in by.items():
        at = 0
        for r in sorted(rs, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(own[i])
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len(rs) <= 128


def test_documents(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé1'") for _ in range(r.randint(1, 9)))
    texts = [(0, None), (1, ""), (2, " x  y\n\n z "), (3, "a <|endoftext|> b<|endoftext|><|endoftext|>\n<|endoftext"), (701, "<|endoftext|>"), (4, "q" * 9000)]
    texts += [(i, " ".join(word() for _ in range(r.choice([0, 1, 5, 50, 400, 3000])))) for i in range(5, 160)]
    texts += [(i, "same") for i in range(160, 700)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = K.pack_documents(docs, PATH, P.PATTERN).collect()
    whole(rows, texts)
    pad, total = padding(rows)
    assert pad < 0.02 * total
    assert K.pack_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
    whole(K.pack_documents(docs, PATH, P.PATTERN).coalesce(1).collect(), texts)  # partitions that one task packs keep their own ids


@pytest.mark.parametrize("seed", range(6))
def test_packer_keeps_every_limit(seed):
    r = random.Random(seed)
    limits = K.Limits(64, 5, 40)
    p = K.Packer(limits, cut=False, pool=8)
    items = {}
    got = []
    for i in range(300):
        n = r.randint(1, 64)
        items[i] = (n, r.randint(0, min(n, 40)))
        p.add(i, *items[i])
        got += p.drain()
    got += p.finish()
    assert sorted(g[0] for g in got) == list(range(300))
    bins = {}
    for key, s, o, n, start in got:
        assert start == 0 and n == items[key][0]
        b = bins.setdefault(s, [0, 0, 0])
        b[0] += n
        b[1] += 1
        b[2] += items[key][1]
    assert all(a <= 64 and s <= 5 and m <= 40 for a, s, m in bins.values())
    best = max(sum(n for n, _ in items.values()) / 64, sum(m for _, m in items.values()) / 40)
    assert len(bins) < 1.3 * best + 2


def test_examples(spark):
    rows = [(i, (i * 37) % 90 + 1, (i * 11) % 40, "x") for i in range(400)] + [(400, None, 3, None), (401, 0, 0, "e"), (402, 5, None, "n"), (402, 5, None, "n")]
    df = spark.createDataFrame(rows, "id int, tokens int, loss int, offset string")
    out = K.pack_examples(df, "tokens", "loss", K.Limits(200, 6, 90)).collect()
    assert len(out) == len(rows)
    seq = {}
    for r in out:
        if not r["tokens"]:
            assert r["sequence_id"] is None
            continue
        seq.setdefault(r["sequence_id"], []).append(r)
    for rs in seq.values():
        assert sum(r["tokens"] for r in rs) <= 200 and len(rs) <= 6 and sum(min(r["loss"] or 0, r["tokens"]) for r in rs) <= 90
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["tokens"]


def test_odd_columns(spark):
    rows = spark.createDataFrame([("a", 3, 1, 9), ("b", 0, 0, 9)], "_tokens string, tokens int, loss int, _loss int")
    assert sorted((r["_tokens"], r["_loss"], r["offset"]) for r in K.pack_examples(rows, "tokens", "loss").collect()) == [("a", 9, 0), ("b", 9, None)]
    assert K.pack_examples(rows.limit(0), "tokens", "loss").count() == 0
    named = spark.createDataFrame([("x", "some text"), (None, None)], "doc_id string, text string")
    assert {r["doc_id"] for r in K.pack_documents(named, PATH, P.PATTERN).collect()} == {None, "x"}


@pytest.mark.parametrize("seed", range(4))
def test_the_heuristic_against_plain_loops(seed):
    """Of the waiting examples that fit, the one with the largest dot product of demand and what is left, in shares of the limits."""
    r = random.Random(seed)
    limits, pool = K.Limits(64, 4, 32), 6  # powers of two, so that sums are exact
    most = (64, 4, 32)
    items = [(i, n := r.randint(1, 64), r.randint(0, min(n, 32))) for i in range(120)]
    packer = K.Packer(limits, cut=False, pool=pool)
    for key, n, loss in items:
        packer.add(key, n, loss)
    got = {key: (s, o) for key, s, o, _, _ in packer.finish()}
    want, waiting, room, offset, sequence = {}, [], list(most), 0, 0
    todo = list(items)
    while todo or waiting:
        while todo and len(waiting) <= pool:
            waiting.append(todo.pop(0))
        fits = [(i, x) for i, x in enumerate(waiting) if x[1] <= room[0] and room[1] >= 1 and x[2] <= room[2]]
        if not fits:
            room, offset, sequence = list(most), 0, sequence + 1
            continue
        dot = lambda x: sum(d / m * (left / m) for d, m, left in zip((x[1], 1, x[2]), most, room))
        best = max(dot(x) for _, x in fits)
        i, (key, n, loss) = next((i, x) for i, x in fits if dot(x) == best)
        want[key] = (sequence, offset)
        offset += n
        room = [room[0] - n, room[1] - 1, room[2] - loss]
        last = waiting.pop()
        if i < len(waiting):
            waiting[i] = last
    assert got == want
