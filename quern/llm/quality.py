"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger row holds its failure bits and the measurements behind them;
policies, which are versioned masks over the rules, and ablations are then bitwise work on the ledger alone, without
reading a text again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.shared import unused

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent", "n_upper", "n_letters", "n_marks", "n_alpha_words"]


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Callable[[str], Column]], Column]
    says: str


#: A rule's place is its bit and never changes; new rules go to the end.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m("n_words") < 10, "under 10 words"),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"), "over 20 % of words in 5-word windows found twice or more"),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words"), "over one symbol to ten words"),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 12 * m("n_words")), "mean word length outside 2 to 12"),
    Rule("dup_lines", lambda m: (m("n_lines") >= 4) & (100 * m("n_dup_lines") > 35 * m("n_lines")), "over 35 % of at least 4 lines equal to an earlier one"),
    Rule("adjacent", lambda m: 4 * m("n_adjacent") > m("n_words"), "over 25 % of words equal to the word before"),
    Rule("shouting", lambda m: (m("n_letters") >= 40) & (2 * m("n_upper") > m("n_letters")), "over half of at least 40 ASCII letters are capitals"),
    Rule("marks", lambda m: 2 * m("n_marks") > m("n_words"), "over one ! or ? to two words"),
    Rule("alpha_words", lambda m: 10 * m("n_alpha_words") < 6 * m("n_words"), "under 60 % of words with a letter"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeats"]
#: Versions stay as they are once used; a changed policy gets a new name.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": sum(BIT.values()),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def measure_texts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """MEASURES of each text of a buffer."""
    n = len(off) - 1
    h, woff = W.word_hashes(raw, off, lower=False)
    nw = np.diff(woff)
    owner = np.repeat(np.arange(n), nw)

    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])

    count = np.maximum(nw - 4, 0)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(woff[:-1], count)
    key = np.zeros(len(at), W.U)
    for j in range(5):
        key += h[at + j] * W._ROLL[j]
    key = W.mix(W.mix(key) + owner[at].astype(W.U) * W.U(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:]
    hit = at[order[twin]]
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    covered = np.cumsum(edge)[: len(h)] > 0

    space = W.SPACE[raw]
    starts, ends, loff = W.line_spans(raw, off)
    inked = np.concatenate([[0], np.cumsum(~space)])
    full = inked[ends] > inked[starts]
    lines = W.mix(W.span_hashes(raw, starts, ends) + np.repeat(np.arange(n), np.diff(loff)).astype(W.U) * W.U(0x9E3779B97F4A7C15))
    order = np.argsort(lines, kind="stable")
    k = lines[order]
    again = np.zeros(len(k), bool)
    again[order[1:]] = k[1:] == k[:-1]

    wide = (raw >= 0x80) | _LETTER[raw]
    letters = np.concatenate([[0], np.cumsum(wide)])
    first = np.flatnonzero(~space & ~np.concatenate([[False], ~space[:-1]]) if len(raw) else space)
    cuts = off[(off > 0) & (off < len(raw))]
    first = np.union1d(first, cuts[~space[cuts]]) if len(raw) else first
    stop = np.append(first[1:], len(raw))
    alpha = letters[stop] > letters[first]

    of = lambda flags: W.per_text(flags, off)
    return {
        "n_words": nw,
        "word_chars": of(~space & ~_CONTINUES[raw]),
        "n_symbols": of(_SYMBOL[raw]),
        "n_lines": W.per_text(full, loff),
        "n_dup_lines": W.per_text(full & again, loff),
        "n_repeat_words": W.per_text(covered, woff),
        "n_adjacent": W.per_text(same, woff),
        "n_upper": of((raw >= 65) & (raw <= 90)),
        "n_letters": of(_LETTER[raw]),
        "n_marks": of(_MARK[raw]),
        "n_alpha_words": W.per_text(alpha, woff),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = W.buffer(batch.column(batch.num_columns - 1))
        for i, j in W.slices(off):
            got = measure_texts(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), *(pa.array(got[m], pa.int64()) for m in MEASURES)], [*batch.schema.names[:-1], *MEASURES])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the columns MEASURES. Existing columns of those names are replaced."""
    rest = [c for c in docs.columns if c != text and c not in MEASURES]
    (own,) = unused(docs.columns, "_text")
    source = docs.select(*(f"`{c}`" for c in rest), F.col(f"`{text}`").cast("string").alias(own))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), *(f"{m} bigint" for m in MEASURES)])
    return source.mapInArrow(_measure, schema)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: every column but the text, the measurements, and ``failed_bits`` (bit i: RULES[i] failed).

    A null or empty text has no words, so it fails ``few_words``; whole texts of any length are measured. Repeated
    rows give repeated ledger rows, an empty table an empty ledger.
    """
    m = measured(docs, text)
    bits = F.lit(0)
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(F.col), BIT[r.name]).otherwise(0))
    return m.withColumn("failed_bits", bits)


def apply_policy(book: DataFrame, version: str = "v1") -> DataFrame:
    """Adds base_failed, kept and policy to a ledger by the mask of ``version``; no text is read."""
    mask = POLICIES[version]
    return book.withColumns({"base_failed": F.col("failed_bits").bitwiseAND(BASE) != 0, "kept": F.col("failed_bits").bitwiseAND(mask | BASE) == 0, "policy": F.lit(version)})


def ablation(book: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that stay rejected without it.

    Ledger rows are first counted by their bits, of which there are 2 ** len(RULES) at most, so only those counts meet.
    """
    mask = POLICIES[version]
    combos = book.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).alias("bit")) for r in RULES if BIT[r.name] & mask))
    each = combos.select("b", "n", F.explode(rules).alias("r")).select("b", "n", "r.*")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        count(F.col("b").bitwiseAND(F.col("bit")) != 0)("failed"),
        count(F.col("b") == F.col("bit"))("failed_alone"),
        count(F.col("b").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0)("rejected_without"),
    )


def filter_documents(docs: DataFrame, version: str = "v1", text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns.

    The text passes through the measuring step beside its measurements, so no join is needed and repeated or null
    ids do no harm.
    """
    names = docs.columns
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{text}`").alias("_measured"))
    kept = apply_policy(ledger(carried, "_measured"), version)
    return kept.where("kept").select(*(F.col("_row").getField(c).alias(c) for c in names))


def quality_digest(docs: DataFrame) -> DataFrame:
    """The columns that query op10 returns."""
    done = apply_policy(ledger(docs.select("doc_id", "text")))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")
