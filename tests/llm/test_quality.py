import random
import re

from pyspark.sql import functions as F

from quern.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    wins = {}
    for i in range(len(w) - 4):
        wins.setdefault(tuple(w[i : i + 5]), []).append(i)
    cov = {i + k for at in wins.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup, lines = set(), 0, 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": lines, "n_dup_lines": dup, "n_repeat_words": len(cov),
        "n_adjacent": sum(a == b for a, b in zip(w, w[1:])), "n_upper": len(re.findall("[A-Z]", t)), "n_letters": len(re.findall("[A-Za-z]", t)), "n_marks": len(re.findall("[!?]", t)),
        "n_alpha_words": sum(bool(re.search("[A-Za-z]", x) or any(ord(c) > 127 for c in x)) for x in w),
    }


def texts():
    r = random.Random(3)
    out = [None, "", " ", "\n\n", "x", "a b c d e a b c d e", "a b c d e f " * 40, "é\xa0ü #*|\n\té\xa0ü #*|\n \n x", "w" * 50_000, "ab " * 9000]
    for _ in range(300):
        out.append("".join(r.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "Z", "!", "1"]) for _ in range(r.randrange(0, 200))))
    return out


def test_measures_match_brute_force(spark, monkeypatch):
    ts = texts()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(ts)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in Q.ledger(docs.drop("n_words")).collect()}
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        for k, v in brute(t).items():
            assert got[i][k] == v, (i, k, t[:80] if t else t)
    again = Q.ledger(docs).agg(F.sum("n_words")).first()[0]  # a clashing column is replaced
    assert again == sum(brute(t)["n_words"] for t in ts)


def test_long_texts_are_chunked(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from quern.llm import words as W

    monkeypatch.setattr(W, "SLICE", 300)
    for t in ["ab cd " * 500, "x" * 2000 + " y " + "z" * 900, "a b c d e f g " * 90 + "\n" + "k" * 700]:
        raw, off = W.buffer(pa.array([t, None, "q r", t]))
        h, woff = W.word_hashes(raw, off, True)
        w = WORD.findall(t)
        assert list(np.diff(woff)) == [len(w), 0, 2, len(w)]
        assert (h[: len(w)] == h[len(w) + 2 :]).all()
        assert len(set(h[: len(w)].tolist())) == len(set(w))


def test_policy_ablation_and_filter(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten eleven"), (2, "few words"), (3, None), (4, "a### b### c### d### e### f### g### h### i### j###"), (4, "a### b### c### d### e### f### g### h### i### j###")],
        "doc_id long, text string",
    )
    book = Q.ledger(docs)
    assert sorted((r["doc_id"], r["kept"]) for r in Q.apply_policy(book).collect()) == [(1, True), (2, False), (3, False), (4, False), (4, False)]
    ab = {r["rule"]: (r["failed"], r["failed_alone"], r["rejected_without"]) for r in Q.ablation(book).collect()}
    assert ab["symbols"] == (2, 2, 2) and ab["few_words"][0] == 2
    kept = Q.filter_documents(docs.withColumn("failed_bits", F.lit("mine")))
    assert kept.columns == ["doc_id", "text", "failed_bits"] and [r["doc_id"] for r in kept.collect()] == [1]
    assert Q.quality_digest(docs.limit(0)).count() == 0
