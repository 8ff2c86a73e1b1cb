import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import lines as L

WS = " \t\n\v\f\r"


def shingles(line):
    x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))
    return {x[i : i + L.SHINGLE] for i in range(len(x) - L.SHINGLE + 1)} if len(x) >= L.SHINGLE else ({x} if x else set())


def brute(rows):
    at = [(i, n, s) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if (s := shingles(x))]
    up = list(range(len(at)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(at)):
        for b in range(a):
            both = len(at[a][2] & at[b][2])
            if 100 * both >= L.PERCENT * (len(at[a][2]) + len(at[b][2]) - both):
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
    first = {}
    for a, (i, n, _) in enumerate(at):
        first[find(a)] = min(first.get(find(a), (i, n)), (i, n))
    gone = {(i, n) for a, (i, n, _) in enumerate(at) if first[find(a)] != (i, n)}
    return {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "é", "zu", "per", "th"]) for _ in range(r.randint(1, 4)))
    pool = [" ".join(word() for _ in range(r.choice([1, 2, 5, 12, 40]))) for _ in range(60)]
    rows = []
    for i in range(150):
        out = []
        for _ in range(r.randint(0, 6)):
            x = r.choice(pool) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 30)))
            if r.random() < 0.4:
                k = r.randrange(len(x) + 1)
                x = x[:k] + r.choice(["", "x", " ", "QQ"]) + x[k:]
            out.append(r.choice(["", " ", "\t"]) + (x.upper() if r.random() < 0.05 else x))
        rows.append((i * 2, "\n".join(out)))
    return rows + [(900, None), (901, ""), (902, "\n \n\n"), (903, "hot line of words here\n" * 300), (904, "y" * 70_000), (905, "y" * 70_001 + "\nhot line of words here")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("mine")).withColumn("h1", F.lit(1))
    out = L.dedup_lines(docs)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "removed_lines", "h1"}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute(rows)


def test_edges(spark):
    rows = [(None, "same line of text"), (1, "same line of text"), (1, "same line of text"), (2, "Same line of text \nown"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["text"], r["n_removed"]) for r in L.line_digest(docs).where("text is not null").collect())
    assert got == [(0, "same line of text", 0), (1, "same line of text", 0), (1, "same line of text", 0), (2, "own", 1)]
    assert L.line_digest(docs.limit(0)).count() == 0


def test_the_first_line_stays_in_any_row_order(spark):
    line = "a line of some words that repeats in many of the texts"
    rows = [(9, line), (1, f"own\n{line}\n{line}"), (5, f"{line}s"), (4, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()} == brute(sorted(rows))


def test_rows_that_share_an_id(spark):
    line = "a line of some words that repeats in many of the texts"
    rows = [(0, line), (1, line), (1, "wholly unique content only in this row"), (1, "wholly unique content only in this row"), (2, f"{line}\nlast of all the lines there are")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "d": F.lit(2), "removed_lines": F.lit(3)})
    got = sorted((r["doc_id"], r["text"], r["row"], r["d"]) for r in L.dedup_lines(docs).collect())
    assert got == [(0, line, 1, 2), (1, "", 1, 2), (1, rows[2][1], 1, 2), (1, rows[2][1], 1, 2), (2, "last of all the lines there are", 1, 2)]


def thue_morse(n):
    s = [0]
    while len(s) < n:
        s += [1 - v for v in s]
    return "".join("ab"[v] for v in s), "".join("ba"[v] for v in s)


def test_regular_spans_are_told_apart():
    from quern.llm import words as W

    one, other = thue_morse(2048)
    raw, off = W.buffer(pa.array([one, other]))
    for h in W.span_digests(raw, off[:-1], off[1:]):
        assert h[0] != h[1]


def test_shingles_do_not_depend_on_their_neighbours():
    from quern.llm import words as W

    texts = ["plain text of words", "short", "naïve text of words é", "plain text of words"]
    raw, off = W.buffer(pa.array(texts))
    mixed, moff = L.char_shingles(raw, off[:-1], off[1:], L.SHINGLE)
    for i, t in enumerate(texts):
        raw, off = W.buffer(pa.array([t]))
        own, _ = L.char_shingles(raw, off[:-1], off[1:], L.SHINGLE)
        assert (own == mixed[moff[i] : moff[i + 1]]).all() and len(set(own.tolist())) == len({t[k : k + 9] for k in range(max(1, len(t) - 8))})
