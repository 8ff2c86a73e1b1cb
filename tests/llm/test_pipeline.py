import random
import re

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from quern.llm import pii
from quern.llm import quality as Q
from quern.llm.shared import save
from tests.llm import test_lines, test_neardup, test_packing


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "é", "zu", "per", "th"]) for _ in range(r.randint(1, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(r.randint(14, 30))) for _ in range(n))
    rows = [(i, text(r.randint(1, 5)), "aa", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "bb", "copy") for i in range(10)]
    rows += [(200 + i, rows[i][1].replace("ka", "ki", 1) + "\n" + text(1), None, "near") for i in range(10)]
    rows += [(300, None, "aa", None), (301, "", None, "s"), (302, "short", "aa", "s"), (303, "a### " * 40, "aa", "junk"), (304, text(2) + " ann.b42@mail7.example.com 97.51.17.173", "aa", "pii")]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]


def test_every_stage_against_brute_force(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    names = docs.columns
    seen = {}
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = save(stage(spark, docs, ""), "stage")
        assert docs.columns == names
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        seen[name] = (before, after)
    before, after = seen["quality"]
    assert set(after) == set(before) - {300, 301, 302, 303} and all(after[i] == before[i] for i in after)
    before, after = seen["lines"]
    want = test_lines.brute(list(before.items()))
    assert after == {i: t for i, t in want.items() if t.strip() or not before[i].strip()}
    assert not any(100 <= i < 200 for i in after)
    before, after = seen["near_duplicates"]
    kept = test_neardup.brute(list(before.items()), k=5)
    assert after == {i: before[i] for i, (_, _, keep) in kept.items() if keep}
    before, after = seen["pseudonyms"]
    p = pii.Pseudonyms(pii.DEMONSTRATION_KEY)
    assert after == {i: p.text(t)[0] for i, t in before.items()} and "97.51.17.173" not in after[304]
    rows = C.STAGES[-1][1](spark, docs, "").collect()
    test_packing.whole(rows, list(after.items()))
    assert sum(r["length"] for r in rows) == sum(len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(t, add_special_tokens=False).ids) + 1 for t in after.values())


def test_run_equals_the_stages(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows = C.run(spark, str(tmp_path)).collect()
    assert rows and re.fullmatch(r"\d+", str(rows[0]["sequence_id"]))
    assert len({r["doc_id"] for r in rows}) == 71
    assert Q.POLICIES["v1"] & Q.BASE == Q.BASE


def test_odd_tables_pass_every_stage(spark):
    """Clashing column names, repeated ids, nulls; and the same without a row."""
    line = "the quick brown fox jumps over the lazy dog and runs away from it at once"
    rows = [(1, line, 7), (1, line, 7), (1, "another text that shares nothing with the first one but its id of course, yes", 8), (None, line, 9), (2, None, 10), (3, f"{line}\nwith a line of its own that is long enough to be kept as it is here", 11)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_lines long").withColumns({c: F.lit(c) for c in ("_text", "row", "d", "rest", "removed_lines", "lang_pred", "n_words", "pii_spans", "_id", "id", "line")})
    for docs in (odd, odd.limit(0)):
        for name, stage in C.STAGES[:-1]:
            docs = save(stage(spark, docs, ""), "odd")
            assert docs.columns == odd.columns, name
            assert all(r[c] == c for r in docs.collect() for c in odd.columns[3:])
            assert all(r["n_lines"] in range(7, 12) for r in docs.collect())
        pieces = C.STAGES[-1][1](spark, docs, "").collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    assert not pieces
    kept = odd
    for _, stage in C.STAGES[:2]:
        kept = save(stage(spark, kept, ""), "odd")
    assert sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in kept.collect()) == [(0, "the"), (1, "another"), (1, "the"), (1, "the"), (3, "with")]
