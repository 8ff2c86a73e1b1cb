import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import langid as L

SYL = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "ör", "pe"], "cc": ["ñi", "que", "sta"]}


def text(r, one, n):
    return " ".join("".join(r.choice(SYL[one]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    r = random.Random(1)
    rows = [(i, text(r, one, r.randint(4, 60)), one) for i in range(600) for one in [r.choice(list(SYL))]]
    odd = [(600, None, "aa"), (601, "", "aa"), (602, "123 !!", "bb"), (603, "ka" * 60_000, None), (604, "日本", None), (None, "zu pe", "bb"), (605, "zu pe", None), (605, "zu pe", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    got = L.language_digest(docs).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: one for i, _, one in rows}
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert len(held) > 100 and sum(g["lang_pred"] == truth[g["doc_id"]] for g in held) / len(held) > 0.97
    by = {g["doc_id"]: g for g in got}
    assert [by[i]["lang_pred"] for i in (600, 601, 602)] == ["und"] * 3
    assert by[603]["lang_pred"] == "aa" and by[604]["lang_pred"] in SYL and by[605]["lang_pred"] == "bb"
    assert all(0 <= g["score"] <= 1 for g in got)


def test_predictions_ignore_held_out_labels(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, text(r, one, 20), one) for i in range(200) for one in [r.choice(list(SYL))]], "doc_id long, text string, lang string")
    lied = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("aa")).otherwise(F.col("lang")))
    assert sorted(map(tuple, L.language_digest(docs).collect())) == sorted(map(tuple, L.language_digest(lied).collect()))
    assert L.language_digest(docs.limit(0)).count() == 0
    assert {x["lang_pred"] for x in L.language_digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute(rows, texts):
    """Scores of texts by the rule, from dictionaries."""
    langs = sorted({one for _, one in rows})
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    known, gram = {one: Counter() for one in langs}, {one: Counter() for one in langs}
    for t, one in rows:
        for w in letters(t):
            known[one][w] += len(w) <= 64
            for n in range(1, 6):
                gram[one].update(L.grams(w, n))
    types = {w for c in known.values() for w, k in c.items() if k}
    out = []
    for t in texts:
        sums = []
        for one in langs:
            mass = sum(known[one].values()) + 0.5 * (len(types) + 1)
            total = sum(k for x, k in gram[one].items() if len(x) == 1)
            s = 0.0
            for w in letters(t):
                if w in types:
                    s += math.log((known[one][w] + 0.5) / mass)
                    continue
                m = f"<{w}>"
                for i in range(1, len(m)):
                    most = min(i + 1, 5)
                    for n in range(most, 0, -1):
                        x = m[i - n + 1 : i + 1]
                        if gram[one][x]:
                            s += math.log(gram[one][x] / (gram[one][x[:-1]] if n > 1 else total)) + (most - n) * math.log(0.4)
                            break
                    else:
                        s += math.log(0.5 / (total + 0.5)) + most * math.log(0.4)
            sums.append(s)
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        out.append((langs[best], 1 / sum(math.exp(max(x - sums[best], -700)) for x in sums)) if letters(t) else ("und", 0.0))
    return out


def test_scores_against_brute_force(spark):
    r = random.Random(4)
    rows = [(text(r, one, r.randint(1, 8)), one) for one in SYL for _ in range(30)] + [("q" * 70 + " kalo", "aa")]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    texts = [text(r, one, r.randint(1, 3)) for one in SYL for _ in range(20)]
    texts += ["kazu", "kalox", "日本 語", "x²y ½ 12 ⅣⅤ a_b", "² ½ 12 ①", "", "lomi" * 30, "kalo zuör " * 5, "q" * 70]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "score long, text string").withColumn("_text", F.lit("mine"))
    got = {r["text"]: r for r in L.identify(docs, model).coalesce(1).collect()}
    for t, (one, score) in zip(texts, brute(rows, texts), strict=True):
        assert got[t]["lang_pred"] == one and got[t]["score"] == pytest.approx(score, rel=1e-9), t
    assert got["² ½ 12 ①"]["lang_pred"] == "und" and got["² ½ 12 ①"]["_text"] == "mine"


def test_a_score_does_not_depend_on_other_rows(spark):
    r = random.Random(6)
    model = L.fit(spark.createDataFrame([(text(r, one, 20), one) for one in SYL for _ in range(20)], "text string, lang string"))
    texts = [" ".join(text(r, one, 2) for one in SYL) for _ in range(50)]
    s = L.Scorer(model)
    apart = [L.Scorer(model).sums([t])[0][0] for t in texts]
    assert (s.sums(texts)[0] == apart).all()


def test_long_runs_count_to_their_end(spark, monkeypatch):
    r = random.Random(3)
    docs = spark.createDataFrame([(text(r, one, 20), one) for one in SYL for _ in range(40)], "text string, lang string")
    model = L.fit(docs)
    long = spark.createDataFrame([("ka" * 32 + "zu" * 50_000,), ("zu" * 32 + "ka" * 500,)], "text string")
    assert [g["lang_pred"] for g in L.identify(long.coalesce(1), model).collect()] == ["bb", "aa"]
    late = L.fit(spark.createDataFrame([("x" * 64 + "qqq" * 9, "aa"), ("y" * 70, "bb")], "text string, lang string"))
    assert "qqqqq" in late["items"][5].to_pylist()
    s = L.Scorer(model)
    whole = s.unseen(["kazulo" * 40])
    monkeypatch.setattr(L, "BLOCK", 7)
    assert s.unseen(["kazulo" * 40]) == pytest.approx(whole)
